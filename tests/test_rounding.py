"""Medians and rounding as in SQL: halves that doubles don't hit, and quantiles that are worked out once."""

import duckdb

import __spark_entry__

from epochalis.operators import statistics as S


def test_sigma_rounds_halves_as_sql(spark, tmp_path):
    # 1.4826 times these distances ends in a 5 behind the fourth digit
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT 'k' || d AS event_type, 10 + s * d AS value FROM (VALUES (1.25), (2.25), (2.75), (4.75), (24.75)) a(d), (VALUES (-1), (0), (1)) b(s)".replace("s * d", "(s * d)::DOUBLE"))
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    got = __spark_entry__.queries()["robust_sigma"](spark, str(tmp_path)).collect()
    assert len(got) == 5 and sorted(map(tuple, got)) == sorted(con.execute(__spark_entry__.oracle_sql()["robust_sigma"]).fetchall())


def test_quantiles_of_stretches_are_worked_out_once(spark):
    # two runs of approximate quantiles may differ, and then so do the stretches
    df = spark.range(0, 6000, 1, 5).selectExpr("id % 2 as g", "cast((id * 7919) % 6007 as double) as v")
    for out in (S.exact_percentiles(df, "g", "v", [0.5]), S.cumulated(df.select("v").distinct().selectExpr("v", "1 as n"), "v", "n")):
        assert "percentile_approx" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_sums_have_sqls_order_and_rows(spark, tmp_path):
    # squares of these values end in halves of the sixth digit, so that the order of the addends decides; no target of user 3 is valid
    con = duckdb.connect()
    con.execute("CREATE TABLE e AS SELECT u * 1000 + i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i) HOUR AS ts, u AS user_id, CASE WHEN u = 3 AND i % 2 = 1 OR i % 7 = 6 THEN 'error' ELSE 'view' END AS event_type, ((i * 7919 + u % 50 * 104729) % 50021) / 100.0::DOUBLE AS value, '' AS props FROM range(400) a(u), range(60) b(i)")
    con.execute(f"COPY (FROM e ORDER BY hash(event_id)) TO '{tmp_path}/events.parquet' (ROW_GROUP_SIZE 2048)")
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
    rows = __spark_entry__.queries()["horizon_sums"](spark, str(tmp_path))
    want = con.execute(__spark_entry__.oracle_sql()["horizon_sums"])
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, rows.select(names).collect())) == sorted(want.fetchall())
