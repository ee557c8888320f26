import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from selenite.llm.pii import KINDS, all_spans, joined, personal_spans, sanitized

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(PLAIN[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end(), kind))
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out)]


HARD = [
    "a@b.c_x@y.z", "a@b..c", "a@b.c.", "@a.b", "x@y", "a.b%c+d-e@h-1.co.uk, q@w.e@r.t", "é a@b.cé", "1.2.3.4.5.6.7.8 300.1.2.3.4 001.02.3.255 1.2.3.", "99999999999999999999.1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111x", "4111  1111 1111 1111", "4111111111111111 4111111111111111", "0" * 19 + " " + "0" * 5, "0" * 12, "0 0 0 0 0 0 0 0 0 0 0 0", "+49 (30) 123-4567.", "+1 23", "+1 202 555 0100 +44 20 7946 0958", "++123456789", "+1" + "2" * 15,
    "😀 mail: joe@site.org 😀 +49 30 1234567", "1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6-7-8-9-0-1", None, "", "x" * 50000 + "@" + "1." * 30000 + "1", "1 " * 40000, "a@" + "b." * 5000 + "c",
]


def test_base_spans_against_plain_patterns(spark):
    texts = HARD + [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    frame = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, base string")
    for r in personal_spans(frame).select("doc_id", joined(F.col("base")).alias("spans")).collect():
        assert r.spans == ",".join(brute(texts[r.doc_id])), texts[r.doc_id][:200]


def test_terms_that_disclose(spark):
    rows = [(i, "common words stand here with the zorblax of boss@corp.com and more common words") for i in range(4)]
    rows += [(10 + i, "common words stand here and more of the words with nothing") for i in range(200)]
    rows += [(500, "zorblax alone"), (501, None), (None, ""), (502, "lonely quux of once@corp.com"), (0, rows[0][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in personal_spans(frame).select("doc_id", joined(all_spans()).alias("spans")).collect()}
    text = rows[0][1]
    a, b = text.index("zorblax"), text.index("boss@")
    assert got[1] == f"term:{a}:{a + 7},email:{b}:{b + 13}" == got[0]
    assert got[500] == got[501] == got[None] == got[10] == "" and got[502] == "email:15:28"
    clean = {r.doc_id: r.text for r in sanitized(frame).collect()}
    assert clean[1] == text.replace("zorblax", "[term]").replace("boss@corp.com", "[email]") and clean[501] is None
    assert personal_spans(frame.limit(0)).count() == 0


def test_query_digest(spark):
    from selenite.llm.queries import op10_sanitise_pii

    got = op10_sanitise_pii(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in got:
        spans = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        kinds = Counter(s.split(":")[0] for s in spans)
        assert [kinds[k] for k in KINDS] == [r.n_email, r.n_ip, r.n_card, r.n_phone]
        assert [s for s in r.spans.split(",") if s and not s.startswith("term")] == spans


def test_terms_anywhere_in_the_document(spark):
    """A term far from the entity, behind another entity, and each of its occurrences."""
    filler = "common words stand here and more of the words with nothing " * 5
    rows = [(i, f"Zorblax {filler}quuxon x@other{i}.com boss@corp.com {filler}zorblax, {filler}") for i in range(4)]
    rows += [(10 + i, filler) for i in range(200)] + [(300, "zorblax alone")]
    got = {r.doc_id: r.spans.split(",") for r in personal_spans(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", joined(all_spans()).alias("spans")).collect()}
    text = rows[0][1].lower()
    places = [(m.start(), m.end()) for m in re.finditer("zorblax|quuxon", text)]
    assert len(places) == 3 and [s for s in got[0] if s.startswith("term")] == [f"term:{a}:{b}" for a, b in places]
    assert got[10] == got[300] == [""]
