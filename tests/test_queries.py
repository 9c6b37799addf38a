"""Registered queries against their SQL on small tables that are made to tell them apart."""

import statistics
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from delaylens.config import ReliabilityConfig
from delaylens.operators import inference, reliability


@pytest.fixture
def same_as_sql(spark, tmp_path):
    """``same_as_sql(name, tables)``: rows of the query and of its SQL over tables given as SQL, both sorted."""

    def both(name, tables):
        con = duckdb.connect()
        con.sql("set timezone = 'UTC'")
        for table, sql in tables.items():
            con.sql(f"copy ({sql}) to '{tmp_path}/{table}.parquet' (format parquet)")
            con.sql(f"create view {table} as select * from '{tmp_path}/{table}.parquet'")
        want = con.sql(entry.oracle_sql()[name])
        got = entry.queries()[name](spark, str(tmp_path)).select(*want.columns).collect()
        order = lambda r: [str(v) for v in r]
        return sorted(map(tuple, got), key=order), sorted(want.fetchall(), key=order)

    return both


def leg_tables(lines):
    """The five tables under legs; ``lines`` has an order line a row: order, supplier, days on the way."""
    return {
        "customer": "select k as c_custkey, (k * 12)::int as c_nationkey from range(3) t(k)",
        "supplier": "select k as s_suppkey, (k % 25)::int as s_nationkey from range(100) t(k)",
        "part": "select 0::bigint as p_partkey, 'small' as p_type",
        "orders": "select k as o_orderkey, k % 3 as o_custkey, timestamp '1996-01-05' + to_days((k % 90)::int) as o_orderdate from range(30000) t(k)",
        "lineitem": f"select o as l_orderkey, 0::bigint as l_partkey, s as l_suppkey, (o % 7)::int as l_linenumber, (1 + o % 50)::double as l_quantity, (o % 11) / 100.0::double as l_discount, 'A' as l_returnflag, timestamp '1996-01-05' + to_days((o % 90 + days)::int) as l_shipdate from ({lines})",
    }


def test_worst_route_goes_by_rate_and_origin_together(same_as_sql):
    """Origin 12 is late in 50.01 % and origin 24 in 50.00 %: less than the 0.012 points that the larger number weighs."""
    late = "k % 3 = 1 and k < 15003 or k % 3 = 2 and k < 15000"
    got, want = same_as_sql("k8_k9_worst_route", leg_tables(f"select k as o, 7::bigint as s, case when {late} then 400 else 0 end as days from range(30000) t(k)"))
    assert got == want and ("all", 7, 24, 3) in got


def test_adjusted_p_values_run_from_the_first_row(same_as_sql, spark):
    """Each user's mean is half of a millionth of the largest value more than a round figure: rounded up, as in the SQL; no frame runs to the last row."""
    got, want = same_as_sql("t3_w5_adjusted_p", {"events": "select k as user_id, (k % 700 + 0.5) * 1.0::double as value from range(3000) t(k) union all select 5000, 1000000.0"})
    assert got == want and len(got) == 3001
    ps = [(i, None if i % 50 == 0 else ((i * 7919) % 1000) ** 2 / 1e6) for i in range(3000)]
    out = inference.benjamini_hochberg(spark.createDataFrame(ps, "i int, p_value double"))
    plan = out._jdf.queryExecution().executedPlan().toString().lower()
    assert "currentrow$(), unboundedfollowing$()" not in plan
    rows, low, want = [r for r in ps if r[1] is not None], 1.0, {}
    m = len(rows)
    for p in sorted({p for _, p in rows}, reverse=True):
        low = min(low, p * m / sum(q <= p for _, q in rows))
        want[p] = low
    for r in out.collect():
        assert r["p_adjusted"] == (None if r["p_value"] is None else pytest.approx(want[r["p_value"]], rel=1e-12))


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def many_legs(spark):
    """Legs of 40 operators, among them some without a delay and one operator without any."""
    return spark.range(4000).select(F.col("id"), (F.col("id") % 40).alias("operator"), (F.col("id") % 7).alias("origin"), F.when(F.col("id") % 11 > 0, F.col("id") % 5).alias("destination"), F.when((F.col("id") % 13 > 0) & (F.col("id") % 40 != 3), F.col("id") % 37 - 5.0).alias("arrival_delay_min"), (F.col("id") % 29 - 3.0).alias("departure_delay_min"), (F.col("id") % 300 - 10.0).alias("scheduled_duration_min"), F.concat(F.lit("2022-0"), F.col("id") % 9 + 1).alias("period"), F.expr("date_add(date '2022-01-01', int(id % 200))").alias("departure_date"))


def test_many_groups_are_shuffled_once_as_rows(spark):
    legs = many_legs(spark)
    few, many = (reliability.grouped_performance(legs, ["operator"], many=m) for m in (False, True))
    assert exchanges(many) == 1 < exchanges(few)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))


def test_operators_breadth_comes_from_the_same_pass(spark):
    legs = many_legs(spark)
    own = reliability.operator_performance(legs)
    assert exchanges(own) == 1
    got = {r["operator"]: r for r in own.collect()}
    assert 3 not in got and len(got) == 39
    rows = [r for r in legs.collect() if r["operator"] == 8]
    n = Counter((r["origin"], r["destination"]) for r in rows)
    assert (got[8]["routes"], got[8]["airports"]) == (len(n), len({p for k in n for p in k if p is not None}))
    assert got[8]["route_hhi"] == pytest.approx(sum((k / len(rows)) ** 2 for k in n.values()))


def test_breadth_alone_is_counted_by_route(spark, same_as_sql, tmp_path):
    """The same figures as with the quantiles, nulls included, but no leg is taken apart into measures."""
    legs = many_legs(spark)
    own = reliability.operator_breadth(legs)
    full = reliability.operator_performance(legs).select(*own.columns)
    key = lambda r: r["operator"]
    for r, want in zip(sorted(own.collect(), key=key), sorted(full.collect(), key=key), strict=True):
        assert r.asDict() == pytest.approx(want.asDict())
    got, want = same_as_sql("a4_operator_performance", leg_tables("select k as o, k % 100 as s, k % 500 as days from range(30000) t(k)"))
    assert got == want and len(got) == 100
    assert "Generate" not in entry.queries()["a4_operator_performance"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("by", ["operator", "period"])
def test_breakdowns_shuffle_legs_once(spark, by):
    legs = many_legs(spark)
    routes = spark.createDataFrame([("all", 1, 2, True), ("3h_or_more", 2, 3, True), ("all", 3, 3, False)], "scope string, origin long, destination long, eligible boolean")
    out = reliability.eligible_breakdown(legs, F.broadcast(routes), by)
    assert exchanges(out) == 1  # beside the broadcast
    own = [r for r in legs.collect() if r["arrival_delay_min"] is not None]
    want = Counter(("all", 1, 2, r[by]) for r in own if (r["origin"], r["destination"]) == (1, 2)) + Counter(("3h_or_more", 2, 3, r[by]) for r in own if (r["origin"], r["destination"]) == (2, 3) and r["scheduled_duration_min"] >= 180)
    assert {tuple(r)[:4]: r["flights"] for r in out.collect()} == want


@pytest.mark.parametrize("by", ["operator", "period"])
def test_breakdowns_hold_a_leg_once_for_all_scopes(spark, by):
    """Legs are ranked before they are divided into scopes; medians are those of each scope's legs, which may have no band."""
    legs = many_legs(spark).where("destination is not null")
    names = ("all", "under_3h", "3h_or_more")
    routes = spark.createDataFrame([(s, o, d) for s in names for o in range(7) for d in range(5)], "scope string, origin long, destination long")
    out = reliability.eligible_breakdown(legs, F.broadcast(routes), by)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Window [")
    want = {}
    for r in legs.collect():
        a, minutes = r["arrival_delay_min"], r["scheduled_duration_min"]
        for scope in [] if a is None else ["all", *(["under_3h"] if 0 < minutes < 180 else ["3h_or_more"] if minutes >= 180 else [])]:
            want.setdefault((scope, r["origin"], r["destination"], r[by]), []).append(a)
    got = {tuple(r)[:4]: (r["flights"], r["late_15_count"], r["arrival_median"]) for r in out.collect()}
    assert got == {k: (len(v), sum(a > 15 for a in v), statistics.median(v)) for k, v in want.items()}


def test_months_and_their_routes_come_from_one_pass(spark, same_as_sql, tmp_path):
    """Legs are joined once, and counted by delay before they are sorted; legs without a period count for their route, legs without a band only for all."""
    legs = many_legs(spark).withColumn("period", F.when(F.col("id") % 17 > 0, F.col("period")))
    config = ReliabilityConfig(min_route_flights=45, min_route_periods=9)
    out = reliability.eligible_months(legs, config=config)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert exchanges(out) == 2 and plan.rindex("Window [") < plan.rindex("HashAggregate(keys=[origin")
    want = reliability.eligible_breakdown(legs, F.broadcast(reliability.eligible_routes(legs, config=config)), "period")
    rows = sorted(map(tuple, out.collect()))
    assert rows == sorted(map(tuple, want.collect())) and {r[0] for r in rows} == {"all", "under_3h"}
    got, want = same_as_sql("a33_route_months", leg_tables("select k as o, k % 100 as s, k % 500 as days from range(30000) t(k)"))
    assert got == want and got
    assert entry.queries()["a33_route_months"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 4


def test_trend_arrays_need_no_quantiles_of_routes(spark, same_as_sql):
    tables = leg_tables("select k as o, k % 100 as s, k % 500 as days from range(30000) t(k)")
    got, want = same_as_sql("a67_trend_arrays", tables)
    assert got == want and got


def test_public_tables_read_the_joined_legs_from_one_table(spark, same_as_sql, tmp_path):
    got, want = same_as_sql("g7_public_tables", leg_tables("select k as o, k % 100 as s, k % 500 as days from range(30000) t(k)"))
    assert got == want
    plan = entry.queries()["g7_public_tables"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "arrival_delay_min" in plan
