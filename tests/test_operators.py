"""Operators on small frames, with the numbers of FIXTURES.md."""

import datetime as dt
import math
import re

import pytest
from pyspark.sql import functions as F

from delaylens import config
from delaylens.functions import expressions as ex
from delaylens.operators import clean, enrich, evaluate, inference, models, pointintime, profile, ranking, reliability, tally
from delaylens.sources import flights

T = lambda *a: dt.datetime(*a)


def legs(spark, extra=()):
    data = [
        (1, "AAA", "BBB", "OP1", "S", T(2022, 12, 1, 10), 20.0, 10.0, 120.0), (2, "AAA", "BBB", "OP1", "S", T(2022, 12, 2, 10), 30.0, 25.0, 120.0),
        (3, "BBB", "CCC", "OP2", "S", T(2022, 9, 3, 8), 0.0, 0.0, 60.0), (4, "AAA", "BBB", "OP1", "N", T(2022, 12, 4, 10), 50.0, 60.0, 120.0), (5, "AAA", "BBB", "OP1", "S", T(2023, 3, 1, 10), 40.0, 60.0, 120.0), *extra,
    ]
    return spark.createDataFrame(data, "id long, origin string, destination string, operator string, leg_type string, time timestamp, departure_delay_min double, arrival_delay_min double, scheduled_duration_min double")


@pytest.fixture(scope="module")
def prepared(spark):
    return clean.prepare_legs(legs(spark), config.RULES, "2023-03-01", "time").cache()


def test_delays_and_quality_rules(spark):
    raw = spark.createDataFrame([("01-01-2022 10:00:00", "01-01-2022 10:15:00", "01-01-2022 12:00:00", "01-01-2022 12:30:00"), ("01-01-2022 10:00:00", "01-01-2022 07:00:00", "01-01-2022 12:00:00", "01-01-2022 09:00:00"), ("01-01-2022 10:00:00", "bad", "01-01-2022 12:00:00", None)], "fo string, ao string, fa string, aa string")
    out = clean.calculate_delays(raw, "fo", "ao", "fa", "aa", config.TIME_FORMAT)
    assert [(r["departure_delay_min"], r["arrival_delay_min"]) for r in out.collect()] == [(15.0, 30.0), (-180.0, -180.0), (None, None)]
    assert clean.apply_quality_rules(out, config.RULES).count() == 2  # nulls stay
    kinds = spark.createDataFrame([("S",), ("N",), (None,)], "leg_type string")
    assert [r[0] for r in clean.apply_quality_rules(kinds, config.RULES).collect()] == ["S"]


def test_horizon_gate(spark):
    assert "ACTUAL OFF BLOCK TIME" not in config.known_columns("pre_departure", "Arrival_Delay_Min")
    assert "ACTUAL OFF BLOCK TIME" in config.known_columns("post_off_block", "Arrival_Delay_Min")
    with pytest.raises(ValueError):
        config.known_columns("post_off_block", "Departure_Delay_Min")
    with pytest.raises(ValueError):
        clean.forbid_columns(spark.range(1), ["id"])


def test_overall_and_groups(spark, prepared):
    k = reliability.overall_kpis(prepared).first()
    assert k["flights"] == 3 and k["otp15_pct"] == pytest.approx(200 / 3)
    r = {x["origin"]: x for x in reliability.route_performance(prepared).collect()}
    assert (r["AAA"]["flights"], r["AAA"]["late_15_pct"], r["AAA"]["recovered_pct"]) == (2, 50.0, 50.0)
    many = legs(spark, [(100 + i, "X", "Y", "OP9", "S", T(2022, 1, 1), 45.0, 45.0, 60.0) for i in range(300)])
    g = reliability.grouped_performance(clean.calendar_columns(many.where("operator = 'OP9'"), "time"), ["operator"]).first()
    assert g["late_15_count"] == g["flights"] == 300
    with pytest.raises(ValueError):
        reliability.airport_performance(prepared, "both")


def test_intervals_and_tests(spark):
    one = spark.range(1).select(ex.wilson(F.lit(80), F.lit(100)).alias("lo"), ex.wilson(F.lit(80), F.lit(100), upper=True).alias("hi"), ex.wilson(F.lit(0), F.lit(0)).alias("none"), ex.two_proportion_z(F.lit(80), F.lit(100), F.lit(60), F.lit(100)).alias("z"), ex.two_sided_p(F.lit(1.959963984540054)).alias("p"), ex.student_t_p(F.lit(2.570582), F.lit(5)).alias("t5"), ex.student_t_p(F.lit(2.228139), F.lit(10)).alias("t10"), ex.chi2_p(F.lit(7.814728), 3).alias("c3"), ex.chi2_p(F.lit(5.991465), 2).alias("c2"), ex.chi2_p(F.lit(3.841459), 1).alias("c1")).first()
    assert one["lo"] < 0.8 < one["hi"] and one["none"] is None and one["z"] == pytest.approx(3.0861, abs=1e-3)
    assert [one[c] for c in ("p", "t5", "t10", "c3", "c2", "c1")] == pytest.approx([0.05] * 6, abs=1e-6)
    ps = [0.01, 0.04, 0.03, None, 0.04]
    out = inference.benjamini_hochberg(spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p_value double")).orderBy("i").collect()
    assert [r["p_adjusted"] for r in out] == pytest.approx([0.04, 0.04, 0.04, None, 0.04])


def test_sql_functions(spark):
    ex.register_sql_functions(spark)
    r = spark.sql("select erfc_fit(0.5D) e, wilson_low(80D, 100D) lo, wilson_high(80D, 100D) hi").first()
    assert r["e"] == pytest.approx(math.erfc(0.5), rel=1e-6) and r["lo"] < 0.8 < r["hi"]


def rolling(spark, targets, events, **how):
    t = spark.createDataFrame(targets, "id long, place string, cutoff timestamp")
    e = spark.createDataFrame(events, "id long, place string, at timestamp, delay double")
    return {r["id"]: r for r in pointintime.rolling_event_features(t, e, ["place"], "at", "delay", "d", **how).collect()}


def test_rolling_excludes_future_and_self(spark):
    day = lambda h, m: T(2022, 1, 1, h, m)
    got = rolling(spark, [(2, "AAA", day(9, 0))], [(1, "AAA", day(8, 30), 10.0), (2, "AAA", day(8, 45), 20.0), (3, "AAA", day(9, 15), 100.0)])[2]
    assert (got["d_1h_count"], got["d_1h_mean"], got["d_1h_self_removed"]) == (1, 10.0, 1)
    with pytest.raises(ValueError):
        rolling(spark, [(2, "AAA", day(9, 0))], [(1, "AAA", day(8, 30), 10.0)], windows=(0,))


def test_rolling_equals_brute_force(spark):
    import random

    rng = random.Random(0)
    start = T(2022, 1, 1)
    at = lambda: start + dt.timedelta(minutes=rng.randrange(0, 4000, 20))
    events = [(i, rng.choice("ABC"), at(), float(rng.randint(-20, 60))) for i in range(150)]
    targets = [(i, p, t + dt.timedelta(minutes=rng.choice([-60, 0, 30]))) for i, p, t, _ in events[:60]] + [(999, "Z", start)]
    got = rolling(spark, targets, events)
    for i, p, cut in targets:
        for w in (1, 6, 24):
            own = [v for j, q, t, v in events if q == p and j != i and cut - dt.timedelta(hours=w) <= t <= cut]
            r = got[i]
            assert r[f"d_{w}h_count"] == len(own)
            if own:
                mean = sum(own) / len(own)
                assert r[f"d_{w}h_mean"] == pytest.approx(mean) and r[f"d_{w}h_late_rate"] == pytest.approx(sum(v > 15 for v in own) / len(own))
                assert r[f"d_{w}h_std"] == pytest.approx((sum((v - mean) ** 2 for v in own) / len(own)) ** 0.5, abs=1e-5)


def test_rotation(spark):
    day = lambda h, m=0: T(2022, 1, 1, h, m)
    t = spark.createDataFrame([(2, "REG1", day(9)), (3, "Unknown", day(9))], "id long, reg string, cutoff timestamp")
    e = lambda second: spark.createDataFrame([(1, "REG1", day(8, 30), 12.0, 5.0), (2, "REG1", second, 40.0, 30.0)], "id long, reg string, at timestamp, a double, d double")
    run = lambda ev, **k: {r["id"]: r for r in pointintime.rotation_features(t, ev, "reg", "at", "a", "d", **k).collect()}
    r = run(e(day(11)))
    assert set(r) == {2} and (r[2]["previous_arrival_delay"], r[2]["previous_departure_delay"], r[2]["minutes_since_previous"], r[2]["rotation_history"], r[2]["previous_positive_delay"]) == (12.0, 5.0, 30.0, 1, 17.0)
    own = run(e(day(8, 45)), fill_missing=True)
    assert own[2]["previous_arrival_delay"] is None and own[2]["rotation_history"] == 0 and own[3]["rotation_history"] == 0


def test_pressure(spark):
    day = lambda h, m: T(2022, 1, 1, h, m)
    s = spark.createDataFrame([(1, "AAA", "CCC", day(8, 0), day(10, 30)), (2, "AAA", "BBB", day(8, 10), day(10, 15)), (3, "DDD", "BBB", day(8, 50), day(10, 59))], "id long, o string, d string, dep timestamp, arr timestamp")
    r = pointintime.scheduled_pressure(s.where("id = 2"), s, "id", "o", "d", "dep", "arr").first()
    assert (r["origin_pressure"], r["destination_pressure"], r["total_pressure"]) == (2, 2, 4)


def test_blend_and_hurdle(spark):
    df = spark.createDataFrame([(10.0, 30.0), (20.0, 40.0)], "a double, b double")
    assert [r[0] for r in df.select(evaluate.blend(F.col("a"), F.col("b"), 0.25)).collect()] == [25.0, 35.0]
    with pytest.raises(ValueError):
        evaluate.blend(F.col("a"), F.col("b"), 1.5)
    p = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "p double")
    h = lambda s, cap=60.0: [r[0] for r in p.select(evaluate.hurdle(F.col("p"), ex.num(s), ex.num(-2), cap=cap)).collect()]
    assert h(30) == [-2, 14, 30] and h(4)[2] == 15 and h(120)[2] == 60


def test_classification_and_thresholds(spark):
    df = spark.createDataFrame([(-2.0, 0.1, 0.0), (10.0, 0.7, 20.0), (16.0, 0.8, 18.0), (45.0, 0.4, 10.0)], "y double, p double, m double")
    r = evaluate.classification_metrics(df, "y", 15, F.col("p") >= 0.5).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"], r["accuracy"]) == (1, 1, 1, 1, 0.5)
    table = evaluate.threshold_table(spark.createDataFrame([(20.0, 0.4), (30.0, 0.5), (0.0, 0.3), (1.0, 0.1)], "y double, p double"), "y", 15, "p", [0.3, 0.4, 0.5])
    best = evaluate.best_threshold(table).first()
    assert (best["threshold"], best["f1"]) == (0.4, 1.0)
    assert evaluate.threshold_table(df, "y", 15, "p").count() == 71
    with pytest.raises(ValueError):
        evaluate.best_threshold(table, "luck")


def test_alignment(spark):
    a, b = spark.createDataFrame([(1, 2.0), (2, 3.0)], "id long, p double"), spark.createDataFrame([(1, 1.0), (2, 1.0)], "id long, y double")
    assert evaluate.align(a, b, "id").count() == 2
    for bad in (b.where("id = 1"), b.unionByName(b), b.withColumn("id", F.col("id") + 1)):
        with pytest.raises(ValueError):
            evaluate.align(a, bad, "id")


def test_splits_and_samples(spark):
    df = spark.createDataFrame([(T(2022, 9, 1),), (T(2022, 12, 1),), (T(2023, 3, 1),), (T(2023, 6, 1),), (T(2030, 1, 1),)], "t timestamp")
    out = models.temporal_split(df, "t", ["2022-01-01", "2022-10-01", "2023-01-01", "2023-04-01", "2023-07-01"])
    assert sorted(r["split"] for r in out.collect()) == ["final_test", "test", "train", "validation"]
    ids = spark.range(2000)
    small, large = ({r[0] for r in flights.percent_sample(ids, p, "id").collect()} for p in (5, 20))
    assert small < large and 40 < len(small) < 180
    with pytest.raises(ValueError):
        flights.percent_sample(ids, 0, "id")


def test_transformer_and_models(spark, tmp_path):
    df = spark.createDataFrame([(9.0, 120.0), (-5.0, 10.0)], "a double, b double")
    one = models.ValueTransformer(columns=["a", "b"], applyLog=True, applyYeoJohnson=True, lambdas=[1.0, 1.0])
    r = one.transform(df).first()
    assert r["a_log"] == pytest.approx(math.log1p(9)) and r["a_yj"] == pytest.approx(9.0)
    assert models.ValueTransformer(columns=["a"]).transform(df).columns == ["a", "b"]
    train = spark.createDataFrame([("x", "AAA", 1.0, 5.0), ("y", "BBB", None, 7.0), ("x", "CCC", 3.0, 20.0)], "seg string, apt string, v double, y double")
    fitted = models.preprocessor(train, ["seg"], ["apt"], ["v"], 64).fit(train)
    unseen = spark.createDataFrame([("new", "ZZZ", None, 1.0)], train.schema)
    assert fitted.transform(train).first()["features"].size == fitted.transform(unseen).first()["features"].size
    with pytest.raises(ValueError):
        models.preprocessor(train.withColumn("v", F.lit(None).cast("double")), ["seg"], [], ["v"])
    best, scores = models.sweep(fitted.transform(train), fitted.transform(train), "y", {"a": models.ridge(train, "y", 1.0)})
    assert best == "a" and scores.count() == 1
    models.save_contract(fitted, str(tmp_path), {"target": "y", "horizon": "pre_departure"})
    model, contract = models.load_contract(spark, str(tmp_path))
    assert contract.first()["target"] == "y" and model.transform(train).count() == 3


def test_ridge_is_the_closed_form(spark):
    import numpy as np
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 2)) * [1.0, 8.0]
    y = 40 + x @ [3.0, -0.5] + rng.normal(size=60) * 6
    w = rng.uniform(0.5, 9, 60)
    df = spark.createDataFrame([(float(a), float(b), float(c), float(d)) for (a, b), c, d in zip(x, y, w)], "a double, b double, y double, w double")
    ready = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    for alpha, name, weights in ((5.0, None, np.ones(60)), (50.0, None, np.ones(60)), (50.0, "w", w), (400.0, "w", w)):
        xc, yc = x - np.average(x, axis=0, weights=weights), y - np.average(y, weights=weights)
        want = np.linalg.solve(xc.T @ (xc * weights[:, None]) + alpha * np.eye(2), xc.T @ (weights * yc))
        model = models.ridge(ready, "y", alpha, name).fit(ready)
        assert list(model.coefficients) == pytest.approx(list(want), rel=1e-4)
        assert model.intercept == pytest.approx(np.average(y - x @ want, weights=weights), rel=1e-4)
    flat = models.ridge(ready.withColumn("y", F.lit(7.0)), "y", 1.0).fit(ready.withColumn("y", F.lit(7.0)))
    assert flat.intercept == pytest.approx(7.0)


def test_sources(spark, tmp_path):
    files = ["/d/202106/Flights_20210601_20210630.csv.gz", "/d/flights/Flights_20210601_20210630.csv.gz", "/d/flights/Flights_20221201_20221231.csv.gz", "/d/flights/Flights_20221201_20230131.csv.gz", "/d/x.csv"]
    months = flights.monthly_files(spark, files)
    assert [(r["month"], r["from_legacy"]) for r in months.orderBy("month").collect()] == [("202106", False), ("202212", True)]
    assert flights.paths_between(months, "202201", "202301") == [files[2]]
    with pytest.raises(FileNotFoundError):
        flights.paths_between(months, "209901", "210001")
    line = "7,AAA,1.5,2.5,BBB,3.0,4.0,01-01-2022 10:00:00,01-01-2022 12:00:00,,,A320,OP,REG,S,Seg,350,500.5"
    for n in ("a", "b"):
        (tmp_path / f"{n}.csv").write_text(",".join(flights.RAW_COLUMNS) + "\n" + line + "\n")
    paths = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    assert flights.read_flights(spark, paths).count() == 2 and flights.smoke_read(spark, paths, 1).count() == 2
    assert {r["file"] for r in flights.rows_by_file(flights.read_flights(spark, paths)).collect()} == {"a.csv", "b.csv"}
    (tmp_path / "c.csv").write_text("ECTRL ID,NEW\n1,2\n")
    audit = flights.schema_audit(spark, [*paths, str(tmp_path / "c.csv")]).collect()
    assert [r["equal"] for r in audit] == [True, True, False] and audit[2]["extra"] == ["NEW"]
    built = []
    block = lambda: built.append(1) or spark.range(5)
    root = str(tmp_path / "blocks")
    assert flights.resumable_block(spark, root, "a", block, 5).count() == flights.resumable_block(spark, root, "a", block, 5, verify=True).count() == 5 and len(built) == 1
    with pytest.raises(ValueError):
        flights.resumable_block(spark, root, "a", block, 6)
    flights.write_bundle({"t": spark.createDataFrame([(1.23456789, 3)], "x double, flights long")}, str(tmp_path / "bundle"), metadata={"year": "2022"}, methodology=[("scope", "scheduled legs")])
    assert flights.read_bundle(spark, str(tmp_path / "bundle"), ["t"])["t"].first()["x"] == 1.2346
    told = flights.read_bundle(spark, str(tmp_path / "bundle"), ["metadata", "metric_definitions", "methodology"])
    assert {(r["tbl"], r["fact"], str(r["value"])) for r in told["metadata"].collect()} >= {(None, "year", "2022"), ("t", "rows", "1"), ("t", "columns", "x flights")}
    assert [r["metric"] for r in told["metric_definitions"].collect()] == ["flights"] and told["methodology"].count() == 1
    with pytest.raises(FileNotFoundError):
        flights.read_bundle(spark, str(tmp_path / "bundle"), ["t", "u"])


def test_dimensions(spark):
    df = spark.createDataFrame([("A",), ("B",), (None,)], "k string")
    dim = spark.createDataFrame([("A", 1)], "k string, v int")
    assert sorted(str(r["v_x"]) for r in enrich.left_join_dimension(df, dim, "k", "k", "_x", check_rows=True).collect()) == ["1", "None", "None"]
    with pytest.raises(ValueError):
        enrich.left_join_dimension(df, dim.unionByName(dim), "k", "k", "_x")
    v = enrich.validate_dimension(df, "k", dim, "k").first()
    assert (v["dimension_rows"], v["fact_keys"], v["matched_rows"], v["row_coverage_pct"]) == (1, 2, 1, 50.0)
    m = enrich.merged_dimension([("one", spark.createDataFrame([("A", None, 1)], "k string, n string, c int")), ("two", spark.createDataFrame([("A", "x", 2)], "k string, n string, c int"))], "k", ["n", "c"]).first()
    assert (m["n"], m["c"], m["sources"]) == ("x", 1, "one+two")
    c = spark.createDataFrame([("41.5, 2.0",), ("bad",), (None,)], "t string").select(*[x.alias(n) for x, n in zip(clean.split_coordinates(F.col("t")), ("lat", "lon"))]).collect()
    assert (c[0]["lat"], c[0]["lon"], c[1]["lat"], c[2]["lon"]) == (2.0, 41.5, None, None)


def test_profiles(spark):
    p = spark.createDataFrame([("old", "c", 100, 10), ("new", "c", 200, 40)], "month string, column string, rows long, nulls long")
    r = profile.null_cohorts(p, "month", ["new"]).first()
    assert (r["delta"], r["material"]) == (10.0, True)
    roles = {r["column"]: r["role"] for r in profile.column_roles(spark.createDataFrame([(float(i), "ab"[i % 2], T(2022, 1, 1)) for i in range(100)], "x double, c string, t timestamp"), ["x", "c", "t"]).collect()}
    assert roles == {"x": "numeric", "c": "category", "t": "datetime"}


def test_deciles_differ_from_ntile(spark):
    df = spark.createDataFrame([(float(v),) for v in range(23)], "arrival_delay_min double")
    got = {r["decile"]: r["flights"] for r in reliability.delay_deciles(df).collect()}
    want = {}
    for i in range(23):
        d = min(i * 10 // 23 + 1, 10)
        want[d] = want.get(d, 0) + 1
    assert got == want


def test_ranks_and_catalog(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 5.0)], "k string, v double")
    assert [r["p"] for r in ranking.load_percentile(df, "k", "v", "p").orderBy("v").collect()] == [0.25, 0.625, 0.625, 1.0]
    assert inference.hypothesis_catalog(spark).count() == 10


def test_registry_is_sound():
    import __spark_entry__ as entry

    found, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(found) and len(found) > 80


def test_interrupted_blocks_are_built_again(spark, tmp_path):
    root, calls = str(tmp_path / "blocks"), []

    def build(fail):
        calls.append(fail)
        df = spark.range(100).repartition(4)
        return df.select(F.when(F.lit(fail) & (F.col("id") == 77), F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))

    with pytest.raises(Exception, match="lost"):
        flights.resumable_block(spark, root, "x", lambda: build(True))
    spark.range(3).write.parquet(f"{root}/x-leftover")  # whole files that no manifest names
    assert flights.read_manifest(spark, root).count() == 0
    assert flights.resumable_block(spark, root, "x", lambda: build(False), 100).count() == 100 and calls == [True, False]
    found = flights.read_manifest(spark, root).first()
    assert found["rows"] == 100 and flights.content_of(spark.range(99, -1, -1)) == (100, found["content"])
    spark.range(101).write.mode("overwrite").parquet(found["path"])
    with pytest.raises(ValueError, match="what was written"):
        flights.resumable_block(spark, root, "x", lambda: build(False), verify=True)


def test_quantiles_and_totals_from_counts(spark):
    import random

    import numpy as np

    rng = random.Random(1)
    data = [(rng.choice(["a", "b", None]), rng.choice([float(rng.randint(0, 9)), rng.gauss(0, 50), None])) for _ in range(3000)] + [("c", 4.0), ("d", None)]
    df = spark.createDataFrame(data, "k string, v double")
    t = tally.Tally(df, ["k"], {"v": F.col("v")}, {"kinds": F.col("v")}, {"late": F.col("v") > 5})
    got = {r["k"]: r for r in t.agg({"n": t.rows("v"), "q": t.quantile("v", 0.3), "p90": t.quantile("v", 0.9), "mean": t.mean("v"), "kinds": t.differing("kinds"), "late": t.marked("late")}).collect()}
    for k in ("a", "b", None, "c"):
        own = [v for x, v in data if x == k and v is not None]
        r = got[k]
        assert (r["n"], r["kinds"], r["late"]) == (len(own), len(set(own)), sum(v > 5 for v in own))
        assert r["q"] == pytest.approx(np.quantile(own, 0.3)) and r["p90"] == pytest.approx(np.quantile(own, 0.9)) and r["mean"] == pytest.approx(np.mean(own))
    assert "d" not in got
    every = sorted(v for _, v in data if v is not None)
    whole = tally.Tally(df, [], {"v": F.col("v")})
    r = whole.agg({"m": whole.quantile("v", 0.5), "p": whole.quantile("v", 0.99)}).first()
    assert r["m"] == pytest.approx(np.quantile(every, 0.5)) and r["p"] == pytest.approx(np.quantile(every, 0.99))
    ranks = {r["v"]: r for r in ranking.value_ranks(df, "v").collect()}
    for v in set(every):
        below, rows = sum(x < v for x in every), every.count(v)
        assert (ranks[v]["below"], ranks[v]["rows"], ranks[v]["total"], ranks[v]["rank"]) == (below, rows, len(every), below + (rows + 1) / 2)
    none = df.where("false")
    assert ranking.value_ranks(none, "v").count() == 0 and tally.medians(none, ["v"]).first()["_v"] is None
    for made in (ranking.value_ranks(df, "v"), evaluate.ranking_quality(df.withColumn("p", F.col("v") / 100), F.col("v") > 5, "p"), tally.medians(df, ["v"])):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Window" in plan and not re.search(r"Window .*\n(.*Sort .*\n)?.*(Exchange|ShuffleQueryStage).*SinglePartition", plan)


def test_values_far_from_zero_keep_their_digits(spark):
    import random

    import numpy as np

    rng = random.Random(2)
    start = T(2022, 1, 1)
    events = [(i, "A", start + dt.timedelta(minutes=7 * i), 1e6 + rng.random()) for i in range(600)]
    targets = [(i, "A", at) for i, _, at, _ in events[::9]]
    got = rolling(spark, targets, events)
    for i, _, cut in targets:
        own = [v for j, _, t, v in events if j != i and cut - dt.timedelta(hours=24) <= t <= cut]
        if own:
            assert got[i]["d_24h_std"] == pytest.approx(np.std(own), abs=1e-6) and got[i]["d_24h_mean"] == pytest.approx(np.mean(own), abs=1e-6)
    x = np.array([1e8 + rng.random() for _ in range(500)])
    y = 2e8 + (x - x.mean()) + np.array([rng.random() for _ in range(500)])
    r = inference.correlations(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double"), ["x", "y"]).first()
    assert r["pearson"] == pytest.approx(np.corrcoef(x - x.mean(), y - y.mean())[0, 1], abs=1e-7)


def test_planted_future_events_are_found(spark):
    day = lambda h, m=0: T(2022, 1, 1, h, m)
    t = spark.createDataFrame([(1, "A", day(9)), (2, "A", day(12))], "id long, place string, cutoff timestamp")
    e = spark.createDataFrame([(3, "A", day(8, 30), 5.0), (4, "A", day(11, 30), 7.0), (5, "A", day(9, 1), 9.0)], "id long, place string, at timestamp, delay double")
    honest = pointintime.rolling_event_features(t, e, ["place"], "at", "delay", "d", windows=(1,))
    late = t.withColumn("cutoff", F.col("cutoff") + F.expr("interval 5 minutes"))
    leaking = pointintime.rolling_event_features(late, e, ["place"], "at", "delay", "d", windows=(1,))
    audit = lambda f: pointintime.recount_audit(f, t, e, ["place"], "at", "delay", "d", "id", "cutoff", (1,)).first()["violations"]
    assert audit(honest) == 0 and audit(leaking) == 1
    with pytest.raises(ValueError):
        pointintime.leakage_audit(leaking, t, "id", "cutoff", "d", (1,), fail=True)
    s = spark.createDataFrame([(1, "A", "B", day(10, 5), day(11), day(6)), (9, "A", "C", day(10, 50), day(12), day(9, 30)), (8, "D", "B", day(3), day(11, 59), day(2))], "id long, o string, d string, dep timestamp, arr timestamp, filed timestamp")
    own = s.where("id = 1").withColumn("cutoff", F.lit(day(9)))
    p = pointintime.scheduled_pressure(own, s, "id", "o", "d", "dep", "arr")
    check = lambda df, known=None: pointintime.pressure_audit(df, own, s, "id", "cutoff", "o", "d", "dep", "arr", known).first()["violations"]
    assert check(p) == 0 and check(p, "filed") == 1 and check(p.withColumn("origin_pressure", F.lit(7))) == 1


def test_families_are_brought_together_once(spark):
    """All families by brute force, with null keys, delays and cutoffs; one join with own events and one with what was seen serve them all."""
    import random

    rng, start = random.Random(1), T(2022, 1, 1)
    at = lambda: start + dt.timedelta(minutes=rng.randrange(0, 2000, 20))
    some = lambda v: None if rng.random() < 0.1 else v
    rows = [(i, some(rng.choice("AB")), some(rng.choice("XY")), rng.choice("PQ"), f"R{i % 5}", at(), at(), some(float(rng.randint(-20, 60))), some(float(rng.randint(-20, 60)))) for i in range(120)]
    names = "id long, o string, d string, op string, reg string, dep timestamp, arr timestamp, dd double, ad double"
    e = spark.createDataFrame(rows, names)
    cuts = {r[0]: some(r[5] + dt.timedelta(minutes=rng.choice([-60, 0, 40]))) for r in rows[:50]}
    t = e.join(spark.createDataFrame(list(cuts.items()), "id long, cutoff timestamp"), "id")
    roles = {"id": "id", "cutoff": "cutoff", "origin": "o", "destination": "d", "operator": "op", "registration": "reg", "departure_time": "dep", "arrival_time": "arr", "departure_delay": "dd", "arrival_delay": "ad", "scheduled_departure": "dep", "scheduled_arrival": "arr"}
    out, audit = pointintime.standard_features(t, e, roles, windows=(1, 6))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 5  # two of pressure, own events, families, rotation
    got = {r["id"]: r for r in out.collect()}
    families = {"origin_departure": ((1,), 5, 7), "destination_arrival": ((2,), 6, 8), "route_arrival": ((1, 2), 6, 8), "operator_departure": ((3,), 5, 7), "operator_arrival": ((3,), 6, 8)}
    seen = {f: [0, 0] for f in families}
    assert len(got) == 50
    for x in rows[:50]:
        for f, (keys, time, value) in families.items():
            known = cuts[x[0]] is not None and all(x[k] is not None for k in keys)
            seen[f][0] += known
            for w in (1, 6):
                if not known:
                    assert got[x[0]][f"{f}_{w}h_count"] is None and got[x[0]][f"{f}_{w}h_self_removed"] is None
                    continue
                inside = [y for y in rows if y[value] is not None and all(y[k] == x[k] for k in keys) and cuts[x[0]] - dt.timedelta(hours=w) <= y[time] <= cuts[x[0]]]
                own, r = [y[value] for y in inside if y[0] != x[0]], got[x[0]]
                seen[f][1] += len(inside) - len(own)
                assert (r[f"{f}_{w}h_count"], r[f"{f}_{w}h_self_removed"]) == (len(own), len(inside) - len(own))
                assert r[f"{f}_{w}h_mean"] == (pytest.approx(sum(own) / len(own)) if own else None)
                assert r[f"{f}_{w}h_late_rate"] == (pytest.approx(sum(v > 15 for v in own) / len(own)) if own else None)
    assert {r["block"]: [r["rows"], r["self_removed"]] for r in audit.collect() if r["block"] != "pressure" and r["violations"] == 0} == seen


def test_baselines_of_all_minimums(spark):
    import random

    import numpy as np

    rng = random.Random(3)
    row = lambda: (rng.choice("AB"), rng.choice("XYZ"), rng.choice([None, "o", "p"]), float(rng.randint(-10, 60)))
    train, test = [row() for _ in range(400)], [row() for _ in range(60)] + [("C", "X", "o", 5.0)]
    schema = "origin string, destination string, operator string, y double"
    levels = [("full", ["origin", "destination", "operator"], 1), ("route", ["origin", "destination"], 1), ("origin", ["origin"], 1)]
    got = {r["minimum"]: r for r in evaluate.baseline_search(spark.createDataFrame(test, schema), spark.createDataFrame(train, schema), "y", levels, (5, 40, 1000)).collect()}
    for least, r in got.items():
        errors, sources = [], []
        for a, b, c, y in test:
            groups = [("full", [v for p, q, o, v in train if (p, q, o) == (a, b, c) and o is not None]), ("route", [v for p, q, _, v in train if (p, q) == (a, b)]), ("origin", [v for p, *_, v in train if p == a]), ("global", [v for *_, v in train])]
            name, own = next((n, g) for n, g in groups if len(g) >= least or n == "global")
            errors.append(y - np.median(own))
            sources.append(name)
        assert (r["rows"], r["from_full"], r["from_route"], r["from_origin"], r["from_global"]) == (len(test), *[sources.count(n) for n in ("full", "route", "origin", "global")])
        assert r["mae"] == pytest.approx(np.mean(np.abs(errors))) and r["rmse"] == pytest.approx(np.sqrt(np.mean(np.square(errors))))


def test_values_are_checked_inside_the_operators(spark):
    bad = spark.createDataFrame([(0.5, 1.0), (1.5, 2.0)], "p double, v double")
    for c in (evaluate.hurdle(F.col("p"), F.col("v"), ex.num(0)), evaluate.chance(F.col("p")), evaluate.blend(F.lit(float("nan")), F.col("v"), 0.5), evaluate.finite(F.lit(float("inf")), "x")):
        with pytest.raises(Exception, match="probability|finite"):
            bad.select(c.alias("x")).collect()
    assert bad.where("p = 0.5").select(evaluate.hurdle(F.col("p"), ex.num(120), ex.num(0)).alias("x")).first()["x"] == 60.0  # no cap unless asked


def test_labels_extremes_and_names(spark):
    rows = [(f"r{k}", 100 + k, 3, 50.0 + k, 60.0 + k) for k in range(12)] + [("lucky", 3, 3, 40.0, 100.0)]
    frame = spark.createDataFrame(rows, "route string, flights long, periods_active long, otp15_low_pct double, otp15_high_pct double")
    assert {r["route"] for r in reliability.label_candidates(frame, ["route"]).collect()} == {"r11", "r10", "r9", "r8", "r0", "r1", "r2"}
    few = config.ReliabilityConfig(min_route_flights=50, min_route_periods=1)
    assert reliability.plot_frame(frame, ["route"], few).count() == 12 and reliability.plot_frame(frame, ["route"], few, executive=False).count() == 13
    t = spark.createDataFrame([("a", 9, "improving", 5.0), ("b", 8, "deteriorating", -7.0), ("c", 7, "no_material_trend", -20.0), ("d", 1, "improving", 50.0)], "k string, n long, signal string, change double")
    assert [(r["k"], r["side"]) for r in inference.trend_extremes(t, "k", "n", pool=3, n=1).collect()] == [("b", "worst"), ("a", "best")]
    w = spark.createDataFrame([("s", "a", 40, 10.0, 1.0), ("s", "b", 40, 10.0, None), ("s", "c", 5, 99.0, 1.0)], "scope string, origin string, flights long, late_15_pct double, lat double")
    assert reliability.worst_routes(w, ["scope"], "origin", 30).first()[:] == ("s", "b", 2) and reliability.worst_routes(w, ["scope"], "origin", 30, ["lat"]).first()["origin"] == "a"
    o = spark.createDataFrame([("AB",), ("ZZZ",), (None,)], "op string")
    assert [r["op"] for r in clean.named_operators(o, "op").collect()] == ["AB"]
    assert [r[0] for r in o.select(clean.operator_label(F.col("op"))).collect()] == ["AB", "Unknown operator", "Unknown operator"]
    g = spark.createDataFrame([(None, "US"), ("EU", "FR"), (" ", "BR"), (None, "XX")], "continent string, iso string")
    assert [r["continent"] for r in enrich.fill_by_code(g, "continent", "iso", {"NA": ["US"], "SA": ["BR"]}).collect()] == ["NA", "EU", "SA", None]


def test_profile_roles_and_casts(spark):
    rows = [(str(k), f"2022-01-{k % 28 + 1:02d}", "xy"[k % 2], f"free text {k}", k, " " if k % 2 else None) for k in range(400)]
    df = spark.createDataFrame(rows, "num string, day string, cat string, txt string, id long, nil string")
    roles = profile.column_roles(df, df.columns)
    got = {r["column"]: r for r in roles.collect()}
    assert {c: r["role"] for c, r in got.items()} == {"num": "numeric", "day": "datetime", "cat": "category", "txt": "text", "id": "numeric", "nil": "empty"}
    assert got["cat"]["frequent"] == ["x", "y"] or got["cat"]["frequent"] == ["y", "x"]
    assert got["nil"]["nulls"] == 400 and len(got["txt"]["samples"]) == 3 and set(got["txt"]["samples"]) <= {r[3] for r in rows}
    cast = dict(profile.coerce_by_profile(df, roles).dtypes)
    assert (cast["num"], cast["day"], cast["cat"], cast["id"]) == ("double", "timestamp", "string", "bigint")


def test_dimension_files_splits_and_variants(spark, tmp_path):
    (tmp_path / "dim.csv").write_text("code,lat\nAAA,1.5\nBBB,2.5\n")
    assert dict(flights.read_dimension(spark, str(tmp_path / "dim.csv")).dtypes) == {"code": "string", "lat": "double"}
    df = spark.createDataFrame([("train", 1), ("test", 2)], "split string, v long")
    back = flights.write_split(df, str(tmp_path / "split"), ["split"])
    assert sorted((r["split"], r["v"]) for r in back.collect()) == [("test", 2), ("train", 1)]
    made = models.ValueTransformer(columns=["a"], applyLog=True, applyYeoJohnson=True, lambdas=[1.0]).transform(spark.createDataFrame([(3.0,)], "a double"))
    value = lambda v: models.variant_assembler(["a"], v).transform(made).first()["features"][0]
    assert (value("original"), value("log"), value("yeo_johnson")) == (3.0, pytest.approx(math.log1p(3)), 3.0)
    with pytest.raises(ValueError):
        models.variant_assembler(["a"], "root")
    assert clean.available_features(made, ["a", "zz"], ["a_log"]).columns == ["a", "a_log"]
    dup = spark.createDataFrame([("k", 2, "a"), ("k", 1, "b")], "k string, x int, y string")
    assert enrich.dedupe_by_field(dup, "k").first()[:] == ("k", 1, "b") and enrich.dedupe_by_field(dup, "k", False).first()[:] == ("k", 1, "a")
