from fractions import Fraction

import duckdb
import pytest

from selenite.plans import evidence_queries, file_queries, more_queries, text_queries  # noqa: F401
from selenite.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    got = duckdb.connect()
    for t in TABLES:
        got.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return got


def plain(x):
    if isinstance(x, float):
        return None if x != x else float(f"{x:.10g}") + 0.0
    return x


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    want = con.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    got, rows = ordered(df.select(*columns).collect()), ordered([r[i] for i in at] for r in want.fetchall())
    assert rows and got == rows


def test_bandpass_at_half_digits(spark, tmp_path):
    """Responses that end with half a digit go up whatever the order of the sums, by fractions; half a band is usable."""
    halves = (49, 325, 360, 376, 474, 607, 739, 854, 949)
    got = duckdb.connect()
    got.sql(f"""COPY (SELECT l_suppkey, l_shipdate, l_quantity FROM '/root/testdata/sf0.1/lineitem.parquet' WHERE l_suppkey IN {halves}
        UNION ALL SELECT k, make_timestamp(2023, 1, 1, 0, 0, 0.0) + to_days(CAST(d - 1 AS INT)), 7.0 FROM range(5000, 5002) r(k), range(31, 76) s(d) WHERE d > 30 + k - 5000 AND (d < 60 OR d = 75)) TO '{tmp_path}/lineitem.parquet'""")
    weights = {(d, b): Fraction(30 - abs(d - 30 * b), 30) for d in range(1, 367) for b in range(1, 13) if abs(d - 30 * b) < 30}
    sums = {}
    for k, d, q, n in got.sql(f"SELECT l_suppkey, dayofyear(l_shipdate), CAST(sum(l_quantity) AS BIGINT), count(*) FROM '{tmp_path}/lineitem.parquet' GROUP BY ALL").fetchall():
        for b in range(1, 13):
            w, (s, t) = weights.get((d, b), 0), sums.get((k, b), (0, 0))
            sums[k, b] = (s + w * Fraction(q, n), t + w) if w else (s, t)
    total = {b: sum(w for (_, x), w in weights.items() if x == b) for b in range(1, 13)}
    up = lambda x: int(x * 10**6 + Fraction(1, 2)) / 10**6
    want = {(k, b): (up(s / t), up(t / total[b]), t / total[b] >= Fraction(1, 2)) for (k, b), (s, t) in sums.items() if t}
    rows = QUERIES["bandpass_weighted_mean"](spark, str(tmp_path)).collect()
    assert {(r.l_suppkey, r.band): (r.response, r.coverage, r.usable) for r in rows} == want


def test_catalogue_ids_of_every_key(spark, tmp_path):
    """A supplier's own id may be one of the note's; negative remainders have five digits too."""
    got = duckdb.connect()
    got.sql(f"COPY (SELECT unnest([1, 5041, 72, 95041, 90000, -5, 4000000000]) AS s_suppkey) TO '{tmp_path}/supplier.parquet'")
    got.sql(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet'; CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    df = QUERIES["catalogue_id_tokens"](spark, str(tmp_path))
    assert ordered(df.collect()) == ordered(got.sql(SQL["catalogue_id_tokens"]).fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).limit(1).count() == 1


def test_plans_are_lean(spark):
    """No query but the numbered report sorts a table in one task, and none uses a nested-loop or cartesian join."""
    for name in SQL:
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
