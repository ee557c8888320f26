"""Queries that run the operators over the driver's tables, each beside its SQL."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from selenite.functions import numeric, text
from selenite.operators import aggregates, documents, joins, learners, sequences, spectral

from . import learning

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _micros(c: str):
    """Microseconds since the epoch of a time, one without zone being in the session's."""
    return F.unix_micros(F.col(c).cast("timestamp"))


def _r(c, digits: int = 6):
    return F.round(c, digits)


@query("""
WITH cat AS (SELECT CAST(floor(abs(s_acctbal)) AS BIGINT) % 100 AS k, count(*) AS n FROM supplier GROUP BY 1),
parsed AS (SELECT c_custkey, CAST(regexp_extract(c_name, '([0-9]{2})$', 1) AS BIGINT) AS k FROM customer)
SELECT CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS match_class, count(*) AS n_customers
FROM parsed LEFT JOIN cat USING (k) GROUP BY 1""")
def crosswalk_match_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parse an id from a name, join it to a catalogue by how many rows match, count by class."""
    left = table(spark, sf_dir, "customer").select("c_custkey", F.regexp_extract("c_name", "([0-9]{2})$", 1).cast("long").alias("k"))
    right = table(spark, sf_dir, "supplier").select((F.floor(F.abs("s_acctbal")).cast("long") % 100).alias("ck"), "s_suppkey")
    out = joins.classify_left_join(left, right, "k", "ck", ["s_suppkey"])
    return out.groupBy("match_class").agg(F.count(F.lit(1)).alias("n_customers"))


_SEGMENTS = """
WITH l AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
s AS (SELECT *, sum(CASE WHEN value <= p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS segment FROM l)"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.split_segments(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value", width=1_000_000)


@query(_SEGMENTS + """, k AS (SELECT user_id, segment, count(DISTINCT value) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high FROM s GROUP BY ALL)
SELECT user_id, CAST(segment AS BIGINT) AS segment, n, low, high FROM k WHERE n >= 2""")
def segment_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of a user's values where they rise, of two points and more."""
    points = sequences.clean_segments(_segments(spark, sf_dir).withColumn("v", F.col("value")), ["user_id"], "v", "value")
    return points.groupBy("user_id", F.col("segment").cast("long").alias("segment")).agg(F.count(F.lit(1)).alias("n"), _r(F.min("v")).alias("low"), _r(F.max("v")).alias("high"))


@query("""
WITH l AS (SELECT user_id, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events)
SELECT user_id, round(min(step), 3) AS step_min, round(max(step), 3) AS step_max, round(median(step), 3) AS step_median, count(*) FILTER (step <= 0) AS n_not_rising, count(*) AS n_steps,
  max(step) - median(step) <= 1e-6 AND median(step) - min(step) <= 1e-6 AS uniform
FROM l WHERE step IS NOT NULL GROUP BY user_id""")
def step_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First differences of each user's times."""
    rows = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("o"), (_micros("ts") / 1e6).alias("t"))
    out = sequences.step_statistics(rows, ["user_id"], "o", "t")
    return out.select("user_id", *(_r(F.col(c), 3).alias(c) for c in ("step_min", "step_max", "step_median")), "n_not_rising", "n_steps", "uniform")


@query("""
WITH k AS (SELECT user_id, epoch_us(ts) // 1000000 AS x0, avg(value) AS y0 FROM events GROUP BY ALL),
b AS (SELECT *, lead(x0) OVER w AS x1, lead(y0) OVER w AS y1 FROM k WINDOW w AS (PARTITION BY user_id ORDER BY x0)),
g AS (SELECT *, unnest(range(CAST(ceil(x0 / 3600.0) AS BIGINT), CAST(ceil(coalesce(x1, x0 + 1) / 3600.0) AS BIGINT))) * 3600 AS p FROM b)
SELECT user_id, p AS "at", CASE WHEN p = x0 THEN y0 ELSE y0 + (p - x0) / (x1 - x0) * (y1 - y0) END AS value FROM g WHERE p = x0 OR (x1 - x0 <= 86400 AND p < x1)""")
def linear_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's values at full hours, in brackets of a day at most."""
    points = table(spark, sf_dir, "events").groupBy("user_id", F.floor(_micros("ts") / 1_000_000).alias("x")).agg(F.avg("value").alias("y"))
    low, high = F.ceil(F.col("x0") / 3600), F.ceil(F.coalesce("x1", F.col("x0") + 1) / 3600)
    grid = F.transform(F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>")), lambda h: h * 3600)
    out = spectral.linear_resample(points, ["user_id"], "x", "y", grid, 86400)
    return out.select("user_id", "at", "value")


_WEIGHTS = "SELECT CAST(a AS INT) AS d, CAST(b AS INT) AS band, greatest(0.0, 1 - abs(a - b * 30) / 30.0) AS weight FROM (SELECT unnest(range(1, 367)) AS a), (SELECT unnest(range(1, 13)) AS b) WHERE abs(a - b * 30) < 30"


def _weights(spark: SparkSession) -> DataFrame:
    days = spark.range(1, 367).select(F.col("id").cast("int").alias("d"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("band"))
    return days.where("abs(d - band * 30) < 30").select("d", "band", (1 - F.abs(F.col("d") - F.col("band") * 30) / 30).cast("double").alias("weight"))


@query(f"""
WITH w AS ({_WEIGHTS}), t AS (SELECT band, sum(weight) AS total FROM w GROUP BY band),
v AS (SELECT l_suppkey, CAST(dayofyear(l_shipdate) AS INT) AS d, avg(l_quantity) AS q FROM lineitem GROUP BY ALL)
SELECT l_suppkey, band, round(sum(weight * q) / nullif(sum(weight), 0), 6) AS response, round(sum(weight) / total, 6) AS coverage, sum(weight) / total >= 0.5 AND sum(weight) > 0 AS usable
FROM v JOIN w USING (d) JOIN t USING (band) GROUP BY l_suppkey, band, total""")
def bandpass_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangular bands over the day of the year; the weights are 366 x 12 numbers, here in thirtieths.

    Whole weights add up without error. What the order of the other sums changes, below 1e-13, goes at the 12th digit, so
    a response that is half a digit goes up in every run.
    """
    curve = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.dayofyear("l_shipdate").alias("d")).agg(F.avg("l_quantity").alias("q"))
    weights = _weights(spark).withColumn("weight", F.round(F.col("weight") * 30))
    out = spectral.bandpass(curve, weights, ["l_suppkey"], "d", "q", 0.5)
    return out.select("l_suppkey", "band", _r(_r(F.col("response"), 12)).alias("response"), _r(F.col("coverage")).alias("coverage"), "usable")


@query(f"WITH w AS ({_WEIGHTS}) SELECT band, round(sum(weight * d) / sum(weight), 6) AS centre FROM w GROUP BY band")
def band_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.band_centres(_weights(spark)).select("band", _r(F.col("centre")).alias("centre"))


_PAIRS = """
WITH p AS (SELECT month(l_shipdate) AS band, c_nationkey AS parent, l_extendedprice / nullif(l_quantity, 0) AS n, o_totalprice AS d
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.month("l_shipdate").alias("band"), F.col("c_nationkey").alias("parent"), (F.col("l_extendedprice") / F.nullif("l_quantity", F.lit(0.0))).alias("n"), F.col("o_totalprice").alias("d"))


@query(_PAIRS + """, r AS (SELECT band, parent, CASE WHEN abs(d) >= 1e-12 THEN n / d END AS v FROM p), g AS (SELECT band, parent, avg(v) AS m FROM r GROUP BY ALL)
SELECT band, 'member' AS weighting, count(v) AS n, round(avg(v), 8) AS mean, round(stddev_samp(v), 6) AS sd FROM r GROUP BY band
UNION ALL SELECT band, 'group', count(m), round(avg(m), 8), round(stddev_samp(m), 6) FROM g GROUP BY band""")
def pair_and_parent_weighted_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean ratio of each band, by pairs and by the means of their parents."""
    rows = _pairs(spark, sf_dir).select("band", "parent", numeric.safe_ratio(F.col("n"), F.col("d")).alias("v"))
    out = aggregates.member_and_group_means(rows, "band", "parent", "v")
    return out.select("band", "weighting", "n", _r(F.col("mean"), 8).alias("mean"), _r(F.col("sd")).alias("sd"))


@query(_PAIRS + " SELECT band, round(avg(n) / avg(d), 8) AS ratio_of_means, round(avg(CASE WHEN abs(d) >= 1e-12 THEN n / d END), 8) AS mean_of_ratios FROM p GROUP BY band")
def ratio_of_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.ratio_of_means(_pairs(spark, sf_dir), ["band"], "n", "d")
    return out.select("band", _r(F.col("ratio_of_means"), 8).alias("ratio_of_means"), _r(F.col("mean_of_ratios"), 8).alias("mean_of_ratios"))


@query("""
WITH u AS (SELECT l_orderkey AS m, l_partkey AS record, 1 AS rule FROM lineitem UNION ALL SELECT l_orderkey, l_suppkey, 2 FROM lineitem)
SELECT m, record, min(rule) AS rule FROM u GROUP BY ALL""")
def priority_union_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of an order by part, then by supplier; each once, by the earlier rule."""
    li = table(spark, sf_dir, "lineitem")
    part = li.select(F.col("l_orderkey").alias("m"), F.col("l_partkey").alias("record"))
    supp = li.select(F.col("l_orderkey").alias("m"), F.col("l_suppkey").alias("record"))
    return joins.priority_union([part, supp], ["m", "record"])


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
def last_wins_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.last_wins(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey")


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
def first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.first_wins(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey")


@query("""
SELECT p.user_id, p.event_id, s.event_id AS signup_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON p.user_id = s.user_id AND p.ts >= s.ts""")
def asof_preceding_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last sign-up at or before each purchase of a user."""
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    probe = ev.where("event_type = 'purchase'").drop("event_type")
    build = ev.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("signup_id"))
    return joins.asof_preceding(probe, build, ["user_id"], "ts", ["signup_id"], width=1).drop("ts")


@query("""
SELECT a.user_id, a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b ON a.user_id = b.user_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 600000000 AND a.event_id < b.event_id""")
def band_join_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a user's events within ten minutes."""
    ev = table(spark, sf_dir, "events").select("user_id", (_micros("ts") / 1e6).alias("t"), "event_id")
    left = ev.select("user_id", F.col("t").alias("t1"), F.col("event_id").alias("left_id"))
    right = ev.select("user_id", F.col("t").alias("t2"), F.col("event_id").alias("right_id"))
    return joins.band_join(left, right, ["user_id"], "t1", "t2", 600).where("left_id < right_id").select("user_id", "left_id", "right_id")


@query("""
SELECT lang, count(*) AS n_unlabelled, string_agg(DISTINCT source, ';' ORDER BY source) AS sources FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang""")
def coverage_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without labels, by language, with their sources."""
    rows = joins.uncovered(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), table(spark, sf_dir, "labels").select("doc_id"), ["doc_id"])
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n_unlabelled"), aggregates.joined_set(F.col("source")).alias("sources"))


@query("SELECT source, count(*) AS n_labelled FROM documents SEMI JOIN labels USING (doc_id) GROUP BY source")
def coverage_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = joins.covered(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id"), ["doc_id"])
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_labelled"))


@query("""
WITH c AS (SELECT DISTINCT l_partkey, round(l_quantity) AS value, l_returnflag FROM lineitem WHERE l_quantity BETWEEN 2 AND 49)
SELECT l_partkey, count(*) AS n_claims, round(avg(value), 6) AS claim_mean, min(value) AS claim_min, max(value) AS claim_max, round(stddev_samp(value), 6) AS claim_sd,
  count(DISTINCT value) AS n_values, round(list_avg(list(DISTINCT value)), 6) AS value_mean FROM c GROUP BY l_partkey""")
def claim_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct claims of a part within limits, and its distinct values."""
    fine, _ = aggregates.accept_within(table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_returnflag"), "l_quantity", 2, 49)
    out = aggregates.claim_summary(fine.withColumn("value", F.round("l_quantity")), ["l_partkey"], "value", ["l_returnflag"])
    return out.select("l_partkey", "n_claims", *(_r(F.col(c)).alias(c) for c in ("claim_mean", "claim_min", "claim_max", "claim_sd")), F.col("n_values").cast("long").alias("n_values"), _r(F.col("value_mean")).alias("value_mean"))


@query("SELECT CASE WHEN l_quantity < 2 THEN 'below' ELSE 'above' END AS reject_reason, count(*) AS n FROM lineitem WHERE NOT (l_quantity BETWEEN 2 AND 49) GROUP BY 1")
def claim_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = aggregates.accept_within(table(spark, sf_dir, "lineitem").select("l_quantity"), "l_quantity", 2, 49)
    return bad.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH t AS (SELECT l_partkey, l_linestatus AS tier, avg(l_quantity) AS mean, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_partkey, min(tier) AS tier, round(arg_min(mean, tier), 6) AS mean, arg_min(n, tier) AS n FROM t GROUP BY l_partkey""")
def tiered_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_linestatus").alias("tier"), "l_quantity")
    return aggregates.tiered_choice(rows, ["l_partkey"], "tier", "l_quantity").withColumn("mean", _r(F.col("mean")))


_HOURS = list(range(24))


@query("""
WITH h AS (SELECT user_id, hour(ts) AS h, avg(value) AS v FROM events GROUP BY ALL), f AS (SELECT user_id FROM h GROUP BY user_id HAVING count(*) = 24)
SELECT user_id, """ + ", ".join(f"round(max(v) FILTER (h = {h}), 6) AS b{h}" for h in _HOURS) + " FROM h SEMI JOIN f USING (user_id) GROUP BY user_id")
def band_pivot_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with events in every hour of the day, a column per hour."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.hour("ts").alias("h")).agg(F.avg("value").alias("v"))
    out = aggregates.complete_pivot(rows, "user_id", "h", "v", _HOURS)
    return out.select("user_id", *(_r(F.col(f"b{h}")).alias(f"b{h}") for h in _HOURS))


@query("""
WITH h AS (SELECT user_id, hour(ts) AS h, avg(value) AS v FROM events GROUP BY ALL), f AS (SELECT user_id FROM h GROUP BY user_id HAVING count(*) = 24)
SELECT user_id, 'b' || h AS band, round(v, 6) AS value FROM h SEMI JOIN f USING (user_id)""")
def band_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.unpivot_bands(band_pivot_complete(spark, sf_dir), "user_id", _HOURS)


@query("""
WITH u AS (SELECT user_id, min(value) AS lo, max(value) AS hi FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN lo IS NULL OR hi IS NULL THEN 'missing' WHEN lo <= 1 AND hi >= 400 THEN 'full' WHEN lo >= 1200 THEN 'long_only' WHEN lo > 1 AND hi < 400 THEN 'partial_both' WHEN lo > 1 THEN 'starts_late' ELSE 'ends_early' END AS coverage_class FROM u""")
def suitability_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's range of values against the one needed."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return rows.select("user_id", numeric.suitability(F.col("lo"), F.col("hi"), 1, 400).alias("coverage_class"))


@query("""
WITH a AS (SELECT l_orderkey, l_linenumber, l_discount + 0.1 AS x, (l_tax + 0.5) / (l_discount + 0.1) AS y FROM lineitem),
h AS (SELECT *, CASE WHEN abs(x - 0.08) < 1e-15 THEN (CASE WHEN -(y - 1.19) < 0 THEN -pi() / 2 ELSE pi() / 2 END) ELSE -atan((y - 1.19) / (x - 0.08)) END AS p,
  CASE WHEN -atan2(y - 1.19, x - 0.08) < 0 THEN -atan2(y - 1.19, x - 0.08) + 2 * pi() ELSE -atan2(y - 1.19, x - 0.08) END AS q,
  CASE WHEN abs(x - 0.08) < 1e-15 THEN (CASE WHEN -(y - 1.18) < 0 THEN -pi() / 2 ELSE pi() / 2 END) ELSE -atan((y - 1.18) / (x - 0.08)) END AS m FROM a)
SELECT l_orderkey, l_linenumber, round(17.427 * p - 7.565, 5) AS standard, round(17.427 * q - 7.565, 5) AS standard_full, round(12.92 * m - 2.107, 5) AS mean_linear, round(CASE WHEN m >= 0 THEN 10.59 * pow(m, 1.209) END, 5) AS mean_power FROM h""")
def iron_angle_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published angle formulas; the power form is undefined for negative angles."""
    x, y = F.col("l_discount") + 0.1, (F.col("l_tax") + 0.5) / (F.col("l_discount") + 0.1)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numeric.principal_angle(x, y, 0.08, 1.19).alias("p"), numeric.full_angle(x, y, 0.08, 1.19).alias("q"), numeric.principal_angle(x, y, 0.08, 1.18).alias("m"))
    return rows.select("l_orderkey", "l_linenumber", _r(numeric.linear_iron(F.col("p")), 5).alias("standard"), _r(numeric.linear_iron(F.col("q")), 5).alias("standard_full"), _r(numeric.linear_iron(F.col("m"), numeric.ANGLE_MEAN), 5).alias("mean_linear"), _r(numeric.power_iron(F.col("m")), 5).alias("mean_power"))


@query(r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
h AS (SELECT doc_id, a, unnest(range(len(a))) AS i FROM l), m AS (SELECT doc_id, a, greatest(i - 2, 0) AS s, least(i + 3, len(a)) AS e FROM h WHERE regexp_matches(a[i + 1], '[$#%&*]{3}|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+')),
n AS (SELECT *, CASE WHEN s <= max(e) OVER w THEN 0 ELSE 1 END AS new FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s, e) AS island FROM n)
SELECT doc_id, CAST(min(s) AS INT) AS start, CAST(max(e) AS INT) AS "end", count(*) AS n_hits, md5(array_to_string(first(a)[min(s) + 1:max(e)], chr(10))) AS block FROM g GROUP BY doc_id, island""")
def evidence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines around hits, merged where they touch."""
    out = sequences.evidence_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], "text", r"[$#%&*]{3}|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
    return out.select("doc_id", "start", "end", "n_hits", F.md5(F.col("block").cast("binary")).alias("block"))


@query(r"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS term FROM benchmark),
t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS term FROM documents)
SELECT doc_id, term, count(*) AS n FROM t SEMI JOIN w USING (term) GROUP BY ALL""")
def doc_mentions_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the documents that also stand in the benchmark."""
    wanted = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("term"))
    return documents.mentions(table(spark, sf_dir, "documents"), "doc_id", "text", wanted, "term", "[a-z]{6,}")


@query(r"""
WITH a AS (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1) AS h FROM pages), b AS (SELECT page_id, url, unnest(h) AS href, unnest(range(len(h))) AS pos FROM a)
SELECT page_id, CAST(pos AS INT) AS pos, href, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN href LIKE '//%' THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*:)', 1) || href
  WHEN href LIKE '/%' THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || href
  ELSE regexp_extract(regexp_replace(url, '[?#].*$', ''), '^([a-zA-Z][a-zA-Z0-9+.-]*://.*/)[^/]*$', 1) || href END AS absolute FROM b""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.anchors(table(spark, sf_dir, "pages"), "page_id", "url", "html")


@query("""
WITH h AS (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user'), l AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id)
SELECT conv_id, turn, least(coalesce(n - 1, last), turn + 2) AS section_end FROM h JOIN l USING (conv_id)""")
def section_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections from a user's turn to the next, of three turns at most."""
    out = sequences.sections(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.col("role") == "user", most=3)
    return out.select("conv_id", "turn", "section_end")


@query(r"""
WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS src FROM conversations),
q AS (SELECT *, substr(text, 1, 12) AS quote, regexp_extract(text, '-?[0-9]+(?:\.[0-9]+)?', 0) AS num FROM p WHERE src IS NOT NULL),
w AS (SELECT conv_id, turn, (num = '' OR NOT contains(src, num)) AS a, num <> '' AND NOT (TRY_CAST(num AS DOUBLE) BETWEEN 0 AND 200) AS b,
  NOT contains(trim(regexp_replace(lower(src), '[\s ]+', ' ', 'g')), trim(regexp_replace(lower(quote), '[\s ]+', ' ', 'g'))) AS c FROM q)
SELECT conv_id, turn, concat_ws(';', CASE WHEN a THEN 'number_not_in_source' END, CASE WHEN b THEN 'value_out_of_range' END, CASE WHEN c THEN 'quote_not_in_source' END) AS warnings, CASE WHEN a OR b OR c THEN 'review' ELSE 'accepted' END AS status FROM w""")
def validate_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first words of a turn held against the turn before it."""
    rows = table(spark, sf_dir, "conversations").withColumn("src", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("src IS NOT NULL")
    out = documents.validated(rows.withColumn("quote", F.substring("text", 1, 12)), "src", "quote", "text", 0, 200)
    return out.select("conv_id", "turn", "warnings", "status")


@query("""
WITH b AS (SELECT lang, doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'accepted' WHEN toxic = 1 THEN 'review' ELSE 'rejected' END AS k FROM labels JOIN documents USING (doc_id)),
g AS (SELECT lang, coalesce(string_agg(CAST(doc_id AS VARCHAR), ';' ORDER BY CAST(doc_id AS VARCHAR)) FILTER (k = 'accepted'), '') AS accepted, coalesce(string_agg(CAST(doc_id AS VARCHAR), ';' ORDER BY CAST(doc_id AS VARCHAR)) FILTER (k = 'review'), '') AS review, coalesce(string_agg(CAST(doc_id AS VARCHAR), ';' ORDER BY CAST(doc_id AS VARCHAR)) FILTER (k = 'rejected'), '') AS rejected FROM b GROUP BY lang)
SELECT *, CASE WHEN accepted <> '' THEN 'accepted' WHEN review <> '' THEN 'review' ELSE 'rejected' END AS status FROM g""")
def review_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    bucket = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "accepted").when(F.col("toxic") == 1, "review").otherwise("rejected")
    return aggregates.buckets_of(rows, "lang", bucket, "doc_id", ["accepted", "review", "rejected"])


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY event_type")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return rows.groupBy("event_type").agg(F.sum("p.k").alias("total"), F.count(F.lit(1)).alias("n"))


_PREDICTED = """
WITH a AS (SELECT event_type, avg(value) AS m FROM events GROUP BY event_type), p AS (SELECT user_id, event_type, value AS y, m AS f FROM events JOIN a USING (event_type)),
g AS (SELECT event_type, user_id, avg(y) AS y, avg(f) AS f FROM p GROUP BY ALL)"""
_METRICS = "event_type, count(*) AS n, round(avg(abs(f - y)), 6) AS mae, round(sqrt(avg((f - y) ** 2)), 6) AS rmse, round(median(abs(f - y)), 6) AS median_abs, round(avg(f - y), 6) AS bias, round(1 - sum((f - y) ** 2) / (var_pop(y) * count(*)), 6) AS r2"


@query(_PREDICTED + f" SELECT 'row' AS level, {_METRICS} FROM p GROUP BY event_type UNION ALL SELECT 'group', {_METRICS} FROM g GROUP BY event_type")
def parent_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of a type's mean as prediction, by row and by the means of users."""
    ev = table(spark, sf_dir, "events")
    rows = ev.join(ev.groupBy("event_type").agg(F.avg("value").alias("f")), "event_type").select("event_type", "user_id", F.col("value").alias("y"), "f")
    one = aggregates.regression_metrics(rows, ["event_type"], "y", "f").withColumn("level", F.lit("row"))
    two = aggregates.group_mean_metrics(rows, ["event_type"], "user_id", "y", "f").withColumn("level", F.lit("group"))
    return one.unionByName(two).select("level", "event_type", "n", *(_r(F.col(c)).alias(c) for c in ("mae", "rmse", "median_abs", "bias", "r2")))


_DOMAIN = """
WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS band FROM embeddings),
d AS (SELECT band, min(x) AS least, max(x) AS most, quantile_cont(x, 0.01) AS q01, quantile_cont(x, 0.99) AS q99, avg(x) AS mean, stddev_samp(x) AS sd FROM v GROUP BY band)"""


def _bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("band", "x"))
    return rows.withColumn("x", F.col("x").cast("double"))


@query(_DOMAIN + " SELECT CAST(band AS INT) AS band, round(least, 6) AS least, round(most, 6) AS most, round(q01, 6) AS q01, round(q99, 6) AS q99, round(mean, 6) AS mean, round(sd, 6) AS sd FROM d")
def quantile_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.column_domain(_bands(spark, sf_dir), "band", "x")
    return out.select("band", *(_r(F.col(c)).alias(c) for c in ("least", "most", "q01", "q99", "mean", "sd")))


@query(_DOMAIN + """, f AS (SELECT vec_id, sum(CASE WHEN x < q01 OR x > q99 THEN 1 ELSE 0 END) AS outside, max(x) AS top, min(x) AS low FROM v JOIN d USING (band) GROUP BY vec_id)
SELECT vec_id, CAST(outside AS BIGINT) AS n_outside, CAST((CASE WHEN outside > 1 THEN 4 ELSE 0 END) | (CASE WHEN low < -0.3 THEN 16 ELSE 0 END) | (CASE WHEN top > 0.3 THEN 32 ELSE 0 END) AS INT) AS mask FROM f""")
def flag_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bit flags of vectors out of the training range; the domain has a row per band."""
    rows = _bands(spark, sf_dir)
    domain = aggregates.column_domain(rows, "band", "x").select("band", "q01", "q99")
    counts = rows.join(domain, "band").groupBy("vec_id").agg(F.count_if((F.col("x") < F.col("q01")) | (F.col("x") > F.col("q99"))).alias("n_outside"), F.min("x").alias("low"), F.max("x").alias("top"))
    return counts.select("vec_id", "n_outside", numeric.flag_mask(outside_training=F.col("n_outside") > 1, negative=F.col("low") < -0.3, excessive=F.col("top") > 0.3).alias("mask"))


@query("""
SELECT vec_id, round(list_avg(list_filter([embedding[1], embedding[2], embedding[3]], lambda x: x > 0)), 6) AS mean, round(list_median(list_filter([embedding[1], embedding[2], embedding[3]], lambda x: x > 0)), 6) AS median,
  round(list_stddev_samp(list_filter([embedding[1]::DOUBLE, embedding[2], embedding[3]], lambda x: x > 0)), 6) AS sd FROM embeddings""".replace("[embedding[1], embedding[2]", "[embedding[1]::DOUBLE, embedding[2]"))
def row_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, median and deviation of the valid predictions of a row."""
    parts = [F.when(F.get("embedding", F.lit(k)) > 0, F.get("embedding", F.lit(k))) for k in range(3)]
    rows = table(spark, sf_dir, "embeddings").select("vec_id", numeric.consensus(parts).alias("c"))
    return rows.select("vec_id", _r(F.col("c.mean")).alias("mean"), _r(F.col("c.median")).alias("median"), _r(F.col("c.sd")).alias("sd"))


@query("""
WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank, event_id FROM events)
SELECT user_id, event_type, event_id, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3""")
def top_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return sequences.first_of_each(rows, ["user_id"], [F.col("value").desc(), F.col("event_id")], 3).drop("value")


@query("""
WITH d AS (SELECT doc_id, text, sha256(text) AS h FROM documents), done AS (SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id FROM d ANTI JOIN done USING (doc_id, h)""")
def pending_by_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is to be done again: new documents, and those whose text has changed since."""
    docs = table(spark, sf_dir, "documents")
    now = docs.select("doc_id", F.sha2("text", 256).alias("h"))
    done = docs.where("doc_id % 2 = 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"))
    return joins.pending(now, done, "doc_id", "h").select("doc_id")


@query("""
WITH r AS (SELECT conv_id, role, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AND row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 1 THEN 0 ELSE 1 END AS new FROM conversations)
SELECT conv_id, role, CAST(sum(new) AS BIGINT) AS n_runs FROM r GROUP BY ALL HAVING sum(new) > 1""")
def contiguity_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.breaks_of_contiguity(table(spark, sf_dir, "conversations"), ["conv_id"], "role", "turn").select("conv_id", "role", F.col("n_runs").cast("long").alias("n_runs"))


@query("""
WITH p AS (SELECT p_partkey, p_name, p_brand, p_type FROM part)
SELECT p_partkey, upper(trim(p_name)) AS canonical, regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g') AS key, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS snake, regexp_replace(trim(p_brand), '[^A-Za-z0-9._-]+', '_', 'g') AS safe FROM p""")
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    return rows.select("p_partkey", text.canonical_id(F.col("p_name")).alias("canonical"), text.normalized_key(F.col("p_brand")).alias("key"), text.snake_name(F.col("p_type")).alias("snake"), text.safe_name(F.col("p_brand")).alias("safe"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY ALL")
def count_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(_r(F.sum("l_quantity"), 2).alias("sum_qty"), _r(F.sum("l_extendedprice"), 2).alias("sum_price"), _r(F.avg("l_discount")).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey AS key, count(DISTINCT l_suppkey) AS n_l_suppkey, count(DISTINCT l_returnflag) AS n_l_returnflag FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1 OR count(DISTINCT l_returnflag) > 1")
def identity_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.conflicting(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_suppkey", "l_returnflag"]).withColumnRenamed("l_orderkey", "key")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def key_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.duplicates(table(spark, sf_dir, "orders"), ["o_custkey"])


@query("SELECT doc_id, CAST(i AS INT) AS chunk, sha256(substr(text, i * 800 + 1, 800)) AS sha256 FROM (SELECT doc_id, text, unnest(range(greatest(1, CAST(ceil(length(text) / 800.0) AS BIGINT)))) AS i FROM documents)")
def review_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.chunks(table(spark, sf_dir, "documents"), ["doc_id"], "text", 800).drop("text")


FEATURES = ("n", "low", "high", "sd", "hour", "q1", "q2", "q3", "q4")


def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A training row for each user and type of event, over all events; its mean value is to be predicted."""
    quarter = F.floor(F.hour("ts") / 6)
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"), F.avg(F.hour("ts")).alias("hour"),
        *(F.count_if(quarter == k).cast("double").alias(f"q{k + 1}") for k in range(4)), F.avg("value").alias("y"),
    )
    return rows.select(F.concat_ws("-", "user_id", "event_type").alias("key"), "user_id", "y", F.array(*FEATURES).alias("x"))


@query("""
WITH RECURSIVE g AS (SELECT user_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, user_id) AS k FROM events GROUP BY user_id),
f(k, load, fold) AS (SELECT CAST(0 AS BIGINT), [0::BIGINT, 0, 0, 0, 0], CAST(NULL AS BIGINT)
  UNION ALL SELECT g.k, [CASE WHEN i = list_position(load, list_min(load)) THEN load[i] + n ELSE load[i] END FOR i IN [1, 2, 3, 4, 5]], list_position(load, list_min(load)) - 1 FROM f JOIN g ON g.k = f.k + 1)
SELECT user_id, CAST(fold AS INT) AS fold FROM f JOIN g USING (k)""")
def group_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds of whole users, by falling number of events to the lightest fold."""
    return learning.group_folds(table(spark, sf_dir, "events"), "user_id", 5)


def _grid(**choices: list) -> list[dict]:
    return [dict(zip(choices, values, strict=True)) for values in itertools.product(*choices.values())]


#: The settings among which the inner folds choose, of every kind of model.
GRID = {
    "ridge": _grid(alpha=[0.1, 1.0, 10.0]),
    "elastic_net": _grid(alpha=[0.01, 0.1, 1.0], l1_ratio=[0.1, 0.5, 0.9]),
    "component_ridge": _grid(components=[5], alpha=[0.1, 1.0, 10.0]),
    "pls": _grid(components=[2, 4, 8]),
    "svr": _grid(c=[1.0, 10.0], epsilon=[0.1, 0.5], gamma=[None, 0.01]),
    "trees": _grid(n=[400], share=[0.5, 1.0], leaf=[1, 3]),
    "forest": _grid(n=[400], share=[0.5, 1.0], leaf=[1, 3]),
    "boosting": _grid(n=[100, 300], rate=[0.03, 0.1], depth=[1, 2], leaf=[3]),
    "gp": _grid(components=[5], alpha=[1e-4, 1e-2]),
}


@query()
def nested_cv_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of each kind of model on held-out groups, parameters tuned inside."""
    out = learning.nested_cv(_training(spark, sf_dir), "x", "y", "user_id", "key", GRID)
    return aggregates.group_mean_metrics(out, ["model"], "user_id", "y", "predicted")


_BASELINE = """
WITH RECURSIVE r AS (SELECT user_id, concat(user_id, '-', event_type) AS key, avg(value) AS y FROM events GROUP BY user_id, event_type),
g AS (SELECT user_id, count(*) AS n, avg(y) AS m, row_number() OVER (ORDER BY count(*) DESC, user_id) AS k FROM r GROUP BY user_id),
f(k, load, fold) AS (SELECT CAST(0 AS BIGINT), [0::BIGINT, 0, 0, 0, 0], CAST(NULL AS BIGINT)
  UNION ALL SELECT g.k, [CASE WHEN i = list_position(load, list_min(load)) THEN load[i] + n ELSE load[i] END FOR i IN [1, 2, 3, 4, 5]], list_position(load, list_min(load)) - 1 FROM f JOIN g ON g.k = f.k + 1),
h AS (SELECT user_id, fold, m FROM f JOIN g USING (k)), p AS (SELECT a.fold, avg(b.m) AS predicted FROM (SELECT DISTINCT fold FROM h) a JOIN h b ON b.fold <> a.fold GROUP BY 1)
"""


@query(_BASELINE + "SELECT key, user_id, CAST(fold AS INT) AS fold, round(y, 6) AS y, round(predicted, 6) AS predicted, round(predicted - y, 6) AS residual FROM r JOIN h USING (user_id) JOIN p USING (fold)")
def baseline_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each held-out row beside the mean of the other folds' group means, with its residual."""
    out = learning.group_mean_baseline(_training(spark, sf_dir), "y", "user_id", "key")
    wide = learning.wide_predictions(out, ["group_mean"], "key", "user_id")
    return wide.select("key", "user_id", "fold", _r(F.col("y")).alias("y"), _r(F.col("predicted_group_mean")).alias("predicted"), _r(F.col("residual_group_mean")).alias("residual"))


@query(_BASELINE + "SELECT 'group_mean' AS model, user_id, round(avg(y), 6) AS y, round(avg(predicted), 6) AS predicted, count(*) AS n FROM r JOIN h USING (user_id) JOIN p USING (fold) GROUP BY user_id")
def baseline_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of each held-out group: true and by the baseline."""
    out = learning.group_mean_baseline(_training(spark, sf_dir), "y", "user_id", "key")
    means = learning.group_predictions(out, "user_id")
    return means.select("model", "user_id", _r(F.col("y")).alias("y"), _r(F.col("predicted")).alias("predicted"), "n")


@query()
def held_out_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.permutation_importance(_training(spark, sf_dir), "x", "y", "user_id", "key", "ridge", {"alpha": 1.0})


@query()
def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user and type scored by two models, with flags and the screened consensus."""
    rows = _training(spark, sf_dir)
    _, _, y, x = learning.training_arrays(rows, "x", "y", "user_id", "key")
    models = {"ridge": learners.Ridge(1.0).fit(x, y), "pls": learners.PartialLeastSquares(3).fit(x, y)}
    return learning.score(rows.select("key", "x"), "x", models, learning.training_domain(x), 0, 1e6, 2, 1e3, 50).drop("x")


@query(_SEGMENTS + """,
p AS (SELECT user_id, segment, value AS x, avg(sqrt(abs(value))) AS y FROM s GROUP BY ALL),
d AS (SELECT *, count(*) OVER (PARTITION BY user_id, segment) AS n, (lead(x) OVER w) - x AS h, ((lead(y) OVER w) - y) / ((lead(x) OVER w) - x) AS d FROM p WINDOW w AS (PARTITION BY user_id, segment ORDER BY x)),
e AS (SELECT *, lag(h) OVER w AS g, lag(d) OVER w AS c, coalesce(h, lag(h) OVER w) AS h0, coalesce(d, lag(d) OVER w) AS d0, CASE WHEN h IS NULL THEN lag(h, 2) OVER w ELSE lead(h) OVER w END AS h1, CASE WHEN h IS NULL THEN lag(d, 2) OVER w ELSE lead(d) OVER w END AS d1
  FROM d WINDOW w AS (PARTITION BY user_id, segment ORDER BY x)),
f AS (SELECT *, ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1) AS ending FROM e),
m AS (SELECT *, CASE WHEN n = 2 THEN d0 WHEN c IS NOT NULL AND d IS NOT NULL THEN CASE WHEN c * d > 0 THEN 3 * (h + g) / ((2 * h + g) / c + (h + 2 * g) / d) ELSE 0 END
  WHEN sign(ending) <> sign(d0) THEN 0 WHEN sign(d0) <> sign(d1) AND abs(ending) > 3 * abs(d0) THEN 3 * d0 ELSE ending END AS slope FROM f WHERE n >= 2),
k AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(slope) OVER w AS slope1, (lead(x, 2) OVER w) IS NULL AS last FROM m WINDOW w AS (PARTITION BY user_id, segment ORDER BY x)),
v AS (SELECT *, (place - x) / h AS t FROM k JOIN (SELECT unnest(range(0, 400, 10)) AS place) ON place >= x AND (place < x1 OR (last AND place = x1)))
SELECT user_id, CAST(place AS DOUBLE) AS at, round(avg((1 + 2 * t) * (1 - t) ** 2 * y + t * (1 - t) ** 2 * h * slope + t ** 2 * (3 - 2 * t) * y1 + t ** 2 * (t - 1) * h * slope1), 6) AS value FROM v GROUP BY ALL""")
def pchip_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monotone cubic values of each user's segments at whole numbers, averaged where segments overlap."""
    rows = _segments(spark, sf_dir).withColumn("y", F.sqrt(F.abs("value")))
    return spectral.resample_segments(rows, "user_id", "value", "y", [float(k) for k in range(0, 400, 10)], "pchip").withColumn("value", _r(F.col("value")))


@query()
def spline_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _segments(spark, sf_dir).withColumn("y", F.sqrt(F.abs("value")))
    return spectral.resample_segments(rows, "user_id", "value", "y", [float(k) for k in range(0, 400, 10)], "spline", gap=100)


@query("""
WITH RECURSIVE b AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS k FROM conversations),
t(conv_id, k, used, n, digest) AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), '' FROM b
  UNION ALL SELECT b.conv_id, b.k, CASE WHEN fits THEN used + size ELSE used END, CASE WHEN fits THEN n + 1 ELSE n END, CASE WHEN fits THEN md5(digest || piece) ELSE digest END
  FROM (SELECT b.conv_id, b.k, used, n, digest, CASE WHEN n = 0 THEN left(text, 400) ELSE text END AS piece, length(piece) AS size, used + size <= 400 AS fits FROM t JOIN b ON b.conv_id = t.conv_id AND b.k = t.k + 1) b)
SELECT conv_id, CAST(n AS INT) AS n_taken, used AS n_chars, digest FROM t QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) = 1""")
def greedy_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation by length within a budget of characters: how many, their size, a digest of them in order."""
    blocks = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.length("text").alias("score"), F.col("turn").alias("pos"), "text")).alias("b"))
    taken = blocks.select("conv_id", sequences.greedy_budget(F.col("b"), 400).alias("t"))
    size = F.aggregate("t", F.lit(0).cast("long"), lambda acc, x: acc + F.length(x))
    return taken.select("conv_id", F.size("t").alias("n_taken"), size.alias("n_chars"), F.aggregate("t", F.lit(""), lambda acc, x: F.md5(F.encode(F.concat(acc, x), "UTF-8"))).alias("digest"))
