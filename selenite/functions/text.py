"""Column functions on text: cleaning, truth values, numbers, identifiers, tokens. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of the three readings of a truth value, and the class order of child keys.
FALSE_WORDS = ("", "0", "false", "n", "no", "none", "null")
TRUE_WORDS = ("1", "true", "t", "y", "yes")
# A sample number is five digits; these first two digits are of the early missions, a first 6 or 7 of the last two.
EARLY = {"10": "Apollo 11", "12": "Apollo 12", "14": "Apollo 14", "15": "Apollo 15"}
LATE = {"6": "Apollo 16", "7": "Apollo 17"}
PARENT = r"(?<![0-9])(10[0-9]{3}|12[0-9]{3}|14[0-9]{3}|15[0-9]{3}|6[0-9]{4}|7[0-9]{4})(?![0-9])"
GROUPED = r"(?<![0-9])(1[0245]|[67][0-9])\s*,\s*([0-9]{3})(?:\s*,\s*([A-Za-z0-9_-]+))?(?![0-9])"
# The heading of a legend of methods, and an entry of it.
LEGEND_HEAD = r"(?i)^.*?\b(?:technique|method)\s*:\s*"
LEGEND = r"\(\s*[A-Za-z]\s*\)\s*.*?(?=,\s*\(\s*[A-Za-z]\s*\)|$)"
OUTSIDE = r"(?i)\b(luna|lunokhod)\b"


def clean(c: Column) -> Column:
    """Runs of white space, no-break spaces among them, as one space; trimmed; null stays null."""
    return F.trim(F.regexp_replace(c, r"[\s ]+", " "))


def blank_to_null(c: Column) -> Column:
    return F.when(clean(c) != "", clean(c))


def canonical_id(c: Column) -> Column:
    """Upper case without the decimals of a whole number: 123.0 is 123."""
    return F.upper(F.regexp_replace(clean(c), r"^([0-9]+)\.0+$", "$1"))


def normalized_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def snake_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def not_false(c: Column) -> Column:
    """True unless the text is one of FALSE_WORDS; null and blank are false."""
    return ~F.lower(clean(F.coalesce(c, F.lit("")))).isin(*FALSE_WORDS)


def is_true(c: Column) -> Column:
    """True only for TRUE_WORDS."""
    return F.lower(clean(F.coalesce(c, F.lit("")))).isin(*TRUE_WORDS)


def says_no(c: Column) -> Column:
    """True only for the word no: a blank is neither yes nor no."""
    return F.lower(clean(F.coalesce(c, F.lit("")))) == "no"


def number(c: Column, least: float | None = None) -> Column:
    """The number that a text spells, or null if it spells none, or no finite one, or one below `least`."""
    x = F.expr("cast(null as double)") if c is None else F.when(clean(c).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), clean(c).try_cast("double"))
    x = F.when(F.abs(x) < float("inf"), x)
    return x if least is None else F.when(x >= least, x)


def strict_number(c: Column, context: Column) -> Column:
    """Like number, but a text that spells no finite number stops the job with its context."""
    return F.when(number(c).isNotNull(), number(c)).otherwise(F.raise_error(F.concat(F.lit("not a finite number: "), F.coalesce(c, F.lit("NULL")), F.lit(" in "), context)).cast("double"))


def qualified(c: Column) -> Column:
    """struct(qualifier, value) of texts such as <0.5 or ~12; the qualifier is never dropped into an equality."""
    text = clean(c)
    return F.struct(F.nullif(F.regexp_extract(text, "^([<>~≈])", 1), F.lit("")).alias("qualifier"), number(F.regexp_replace(text, "^[<>~≈]+\\s*", "")).alias("value"))


def numbers_in(c: Column) -> Column:
    """All decimal numbers of a text, in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?<![0-9.])[0-9]+(?:\.[0-9]+)?"), F.lit(0)), lambda x: x.cast("double"))


def sample_reference(name: Column, location: Column | None = None, outside: str = OUTSIDE) -> Column:
    """struct(scope, parent, normalized, has_context) of a free-text sample name.

    Names or locations matching `outside` are of no known scope; thousands-grouped ids such as 10,003,173 come before
    plain ones. Only numbers that begin as the missions' do are parents.
    """
    text = clean(F.coalesce(name, F.lit("")))
    away = (text if location is None else F.concat_ws(" ", text, location)).rlike(outside)
    grouped = F.regexp_extract(text, GROUPED, 0) != ""
    plain = PARENT + r"(?:\s*[,.;]\s*([A-Za-z0-9_-]+))?"
    parent = F.when(grouped, F.concat(F.regexp_extract(text, GROUPED, 1), F.regexp_extract(text, GROUPED, 2))).otherwise(F.regexp_extract(text, plain, 1))
    suffix = F.when(grouped, F.regexp_extract(text, GROUPED, 3)).otherwise(F.regexp_extract(text, plain, 2))
    found = F.when(grouped, F.regexp_extract(text, GROUPED, 0)).otherwise(F.regexp_extract(text, plain, 0))
    known = ~away & (parent != "")
    scope = F.when(away, "outside").when(parent == "", "unparsed").otherwise("known")
    return F.struct(
        scope.alias("scope"), F.when(known, parent).alias("parent"),
        F.when(known, F.concat(parent, F.when(suffix != "", F.concat(F.lit(","), suffix)).otherwise(""))).alias("normalized"),
        (known & ((suffix != "") | (F.length(clean(text)) > F.length(clean(found))))).alias("has_context"),
    )


def mission_of(parent: Column) -> Column:
    """The mission of a sample number, from the first digits in it; null if they are of none."""
    digits = F.regexp_replace(parent, "[^0-9]", "")
    early = F.create_map(*(F.lit(x) for pair in EARLY.items() for x in pair))
    late = F.create_map(*(F.lit(x) for pair in LATE.items() for x in pair))
    return F.when(F.length(digits) >= 2, F.coalesce(F.try_element_at(early, F.substring(digits, 1, 2)), F.try_element_at(late, F.substring(digits, 1, 1))))


def catalogue_ids(c: Column) -> Column:
    """Ids of five digits in a text in order, each once, also with letters after them or written 15,041."""
    found = F.regexp_extract_all(c, F.lit(r"(?<![A-Za-z0-9])(?:[0-9]{5}[A-Za-z]*|[0-9]{2},[0-9]{3}[A-Za-z]*)(?![A-Za-z0-9])"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, ",", "")))


def child_key(c: Column) -> Column:
    """A sort key of child ids: none, then numbers with their suffixes, then the others."""
    text = F.upper(clean(F.coalesce(c, F.lit(""))))
    head = F.regexp_extract(text, "^([0-9]+)", 1)
    rank = F.when(text == "", 0).when(head != "", 1).otherwise(2)
    return F.struct(rank.alias("rank"), head.try_cast("long").alias("number"), text.alias("text"))


def first_column(df: DataFrame, choices: Sequence[str], required: bool = True) -> str | None:
    """The first of the choices that df has."""
    found = next((c for c in choices if c in df.columns), None)
    if found is None and required:
        raise ValueError(f"none of the columns {', '.join(choices)}")
    return found


def require_columns(df: DataFrame, needed: Sequence[str], where: str = "table") -> DataFrame:
    """df, if it has all columns needed."""
    if missing := sorted(set(needed) - set(df.columns)):
        raise ValueError(f"{where} lacks columns: {', '.join(missing)}")
    return df


def safe_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(clean(c), "[^A-Za-z0-9._-]+", "_"), "^[._]+|[._]+$", "")


def document_id(url: Column, kind: Column) -> Column:
    """stem__kind__ten digits of the address's digest."""
    stem = safe_name(F.regexp_replace(F.regexp_extract(url, "([^/?#]*)(?:[?#].*)?$", 1), r"\.[A-Za-z0-9]+$", ""))
    return F.concat_ws("__", F.when(stem != "", stem).otherwise("document"), kind, F.substring(F.sha2(url, 256), 1, 10))


def row_text(df: DataFrame, omit: Sequence[str] = ()) -> Column:
    """A row as `name: value | name: value`, blanks and omitted columns left out."""
    parts = [F.when(clean(F.col(c).cast("string")) != "", F.concat(F.lit(f"{c}: "), clean(F.col(c).cast("string")))) for c in df.columns if c not in omit]
    return F.concat_ws(" | ", *parts)


def distinct_folded(items: Column) -> Column:
    """The items in order, each once without regard to case."""
    kept = lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)) | (clean(x) == ""), acc).otherwise(F.concat(acc, F.array(clean(x))))
    return F.aggregate(items, F.array().cast("array<string>"), kept)


def legend_codes(c: Column) -> Column:
    """map(code -> method) of a legend such as `technique: (a) wet chemistry, (b) probe`: what stands before the heading is
    left out, codes are in lower case, and of a code that comes again the last method counts."""
    bare = F.regexp_replace(c, LEGEND_HEAD, "")
    pairs = F.transform(F.regexp_extract_all(bare, F.lit(LEGEND), F.lit(0)), lambda x: F.struct(F.lower(F.regexp_extract(x, r"^\(\s*(.)", 1)).alias("code"), F.regexp_replace(F.regexp_replace(x, r"^\([^)]*\)", ""), r"^[\s,.;]+|[\s,.;]+$", "").alias("method")))
    return F.map_from_entries(F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["code"] == x["code"])))


def matched_once(c: Column, pattern: str, group: int = 1) -> Column:
    """The match if there is exactly one; with its status."""
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(group))
    status = F.when(F.size(found) == 0, "missing").when(F.size(found) == 1, "found").otherwise("ambiguous")
    return F.struct(F.when(F.size(found) == 1, found[0]).alias("value"), status.alias("status"))


def numbers_near(text: Column, pattern: str, before: int = 220, after: int = 300, most: float = 200.0) -> Column:
    """Numbers within the characters before and after each match; ids of five digits, years and large ones left out."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.struct(F.length(g).alias("gap"), F.length(h).alias("n")))
    ends = F.aggregate(pairs, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array((F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + x["gap"] + x["n"]).cast("int"))))
    cut = lambda end, n: F.substring(text, F.greatest(end - n - before, F.lit(0)) + 1, F.least(end - n, F.lit(before)) + n + after)
    window = F.zip_with(ends, F.transform(hits, F.length), cut)
    tokens = F.flatten(F.transform(window, lambda w: F.regexp_extract_all(w, F.lit(r"(?<![0-9.,])[0-9]+(?:\.[0-9]+)?(?![0-9])"), F.lit(0))))
    fine = lambda t: ~t.rlike("^[0-9]{5}$") & ~t.rlike("^(19|20)[0-9]{2}$") & (t.cast("double") <= most)
    return F.array_distinct(F.filter(tokens, fine))
