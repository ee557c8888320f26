import re
from itertools import combinations

import pytest

from selenite.llm.ngram_join import keep_one, ngram_components

DOCS = "/root/testdata/sf0.001/documents.parquet"


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", lower) if w]


def shingles(text, n):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def brute(rows, n, num, den):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and num * max(len(sets[a]), len(sets[b])) <= den * min(len(sets[a]), len(sets[b])):
            common = len(sets[a] & sets[b])
            if den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min((x for x in (least.get(find(i)), d) if x is not None), default=None)
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 80, 100)])
def test_against_all_pairs(spark, n, num, den):
    docs = spark.read.parquet(DOCS)
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    extra = [(10**6 + i, " ".join(base.split()[:26] + [f"w{i}"])) for i in range(40)] + [(2 * 10**6 + i, base.replace("m", f"m{i % 7}").replace("t", f"t{i}")) for i in range(60)]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_components(docs, n, num, den).collect()), key=str)
    assert got == brute(rows, n, num, den)


def test_nulls_empties_repeats(spark):
    rows = [(1, "x y z", "k"), (1, "x y z", "k"), (2, "X y\tz", "k"), (None, "x y z", "k"), (3, None, "k"), (4, "", "k"), (5, " \n", "k"), (6, "one", "k"), (7, "one", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_components(docs).collect()}
    assert got == {(1, 1, 1), (2, 1, 1), (None, 1, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 1, 6)}
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == [1, 3, 4, 5, 6]
    assert keep_one(docs).columns == docs.columns
    assert ngram_components(docs.limit(0)).count() == 0


def test_ids_that_are_null(spark):
    """Components without an id stay apart, as different texts of one id do."""
    docs = spark.createDataFrame([(None, "a b c", 1), (None, "d e f", 2), (4, "g h i", 3), (4, "j k l", 4), (4, "j k l", 4)], "doc_id long, text string, n int")
    assert sorted(r.n for r in keep_one(docs).collect()) == [1, 2, 3, 4]


def test_hot_ngrams_and_small_slices(spark, monkeypatch):
    """One line in most documents, copies by the hundred, and sets over many slices."""
    import random

    draw = random.Random(5)
    line = " ".join(f"h{i}" for i in range(30))
    rows = []
    for i in range(400):
        own = " ".join(f"w{draw.randrange(10**6)}" for _ in range(draw.choice([3, 5, 30, 120])))
        rows.append((2 * i, f"{line} {own}" if i % 3 else own))
        if i % 5 == 0:
            rows.append((2 * i + 1, rows[-1][1] + draw.choice(["", " more", " a b c d e f g"])))
    rows += [(10**5 + i, f"{line} {line[:i % 40]} end") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_components(docs, 3, 80, 100).collect()), key=str)
    assert got == brute(rows, 3, 80, 100)


def test_lists_longer_than_a_block(spark):
    """Sets that share their rarest n-grams with many others but link with few of them."""
    common = [f"c{i}" for i in range(8)]
    rows = [(i, " ".join([*common, *(f"p{i // 2}x{j}" for j in range(3)), f"q{i}"])) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_components(docs, 1, 80, 100).collect()), key=str)
    assert got == sorted(((d, 12, d - d % 2) for d, _ in rows), key=str)


@pytest.mark.parametrize("size,num", [(10, 80), (40, 90)])
def test_chains_of_near_copies(spark, size, num):
    """In each of many chains X links L and M, and L and M do not link each other."""
    rows = []
    for i in range(2000):
        base = [f"w{i}x{j}" for j in range(size)]
        for c in range(3):
            rows.append((3 * i + c, " ".join([*base[:c], f"v{i}x{c}", *base[c + 1 :]] if c else base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in ngram_components(docs, 1, num, 100).collect()}
    assert [d for d, _ in rows if got[d] != d - d % 3] == []
