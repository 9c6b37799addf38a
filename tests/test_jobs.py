"""Jobs and the live stream end to end on small inputs."""

import pytest
from pyspark.sql import functions as F

from delaylens import config
from delaylens.config import RULES, ReliabilityConfig
from delaylens.plans import jobs, views
from delaylens.streaming.live import live_on_time

SF = "/root/testdata/sf0.001"
SMALL = ReliabilityConfig(min_route_flights=5, min_route_periods=1)


@pytest.fixture(scope="module")
def legs(spark):
    return views.legs(spark, SF).cache()


def test_exports(spark, legs):
    business = jobs.business_export(legs.drop("departure_hour"), SMALL, "scheduled_off_block", "1996-12", "1997-12")
    assert business["network"].first()["flights"] == legs.count() and business["operators"].count() > 1 and business["hypotheses"].count() == 10
    assert business["operator_tests"].where("p_adjusted < p_value - 1e-12").count() == 0
    nation = spark.read.parquet(f"{SF}/nation.parquet")
    report = jobs.report_tables(legs, nation, "n_nationkey", "n_regionkey", F.when(F.col("operator") < 5, "a").otherwise("b"), (1, 2), 1)
    assert report["countries"].agg(F.sum("movements")).first()[0] == 2 * legs.count() and report["largest_delays"].count() <= 5
    many = legs.withColumns({"origin": F.pmod("order_id", F.lit(300)), "destination": F.pmod("order_id", F.lit(7)) + 300})
    places = spark.range(307).select(F.col("id").alias("place"), (F.col("id") % 3).alias("land"))
    spread = jobs.report_tables(many, places, "place", "land", F.when(F.col("operator") < 5, "a").otherwise("b"), (1, 2), 1)["countries"]
    airports = many.select("origin").union(many.select("destination")).distinct().count()
    assert airports > 200 and spread.agg(F.sum("airports"), F.sum("movements")).first()[:] == (airports, 2 * legs.count())
    public = jobs.public_tables(legs, SMALL)
    assert public["deciles"].count() == 10 and public["overview"].count() == 3
    assert {n: df.schema for n, df in public.items()}


def test_features_and_selection(spark, legs, tmp_path):
    nation = spark.read.parquet(f"{SF}/nation.parquet").select("n_nationkey", F.col("n_regionkey").alias("region"))
    own = legs.withColumn("leg_type", F.lit("S"))
    bounds = ["1990-01-01", "1997-01-01", "1998-01-01", "2010-01-01"]
    made = jobs.base_features(own, RULES, nation, "n_nationkey", "scheduled_off_block", bounds, ["equipment"], ["scheduled_duration_min"], "arrival_delay_min", 10)
    split = made["features"].cache()
    parts = {r["split"]: r["rows"] for r in made["contract"].collect()}
    assert set(parts) == {"train", "validation", "test"} and sum(parts.values()) == split.count()
    train, validation, test = (split.where(F.col("split") == s) for s in ("train", "validation", "test"))
    best, search, errors = jobs.baseline_selection(train, validation, test, "arrival_delay_min", [["origin", "destination"], ["origin"]], (3, 20))
    rows = {r["minimum"]: r for r in search.collect()}
    assert set(rows) == {3, 20} and best == min(rows, key=lambda m: (rows[m]["mae"], m)) and errors.count() == 2
    assert all(r["rows"] == validation.count() == r["from_origin_destination"] + r["from_origin"] + r["from_global"] for r in rows.values())
    scores, metrics = jobs.select_and_freeze(train, validation, test, "arrival_delay_min", ["equipment"], [], ["scheduled_duration_min"], str(tmp_path / "m"), (0.1, 1.0))
    assert scores.count() == 2 and metrics.where("segment = 'all'").count() == 2


def test_operational_features(spark):
    t = views.timeline(spark, SF).withColumns({"dest": F.col("registration"), "dd": F.col("delay_min")}).drop("cutoff")
    roles = {"id": "leg_id", "cutoff": "cutoff", "origin": "registration", "destination": "dest", "operator": "event_type", "registration": "registration", "departure_time": "event_time", "arrival_time": "event_time", "departure_delay": "dd", "arrival_delay": "delay_min", "scheduled_departure": "event_time", "scheduled_arrival": "event_time"}
    out, audit = jobs.operational_features(t, t, roles, 20, "event_time")
    assert audit.count() == 6 and out.count() == out.select("leg_id").distinct().count()


def test_live_stream_equals_batch(spark, tmp_path):
    t = views.timeline(spark, SF).select("event_time", "registration", "delay_min")
    t.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    q = live_on_time(stream, "event_time", "registration", "delay_min").writeStream.format("memory").queryName("live").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    want = live_on_time(t, "event_time", "registration", "delay_min")
    assert spark.table("live").exceptAll(want.select(*spark.table("live").columns)).count() == 0 and spark.table("live").count() == want.count()


def test_rules_are_rows():
    assert config.leg_rules(delay={"low": -60.0})[0].low == -60.0 and len(config.leg_rules(without=("leg_type",))) == len(RULES) - 1
    with pytest.raises(ValueError):
        config.leg_rules(colour={})
    with pytest.raises(ValueError):
        config.known_columns("landing")


def test_benchmark_sweeps_and_combination(spark):
    from pyspark.ml.feature import VectorAssembler

    from delaylens.operators import evaluate, models

    own = VectorAssembler(inputCols=["yhat", "x"], outputCol="features").transform(views.predictions(spark, SF).withColumn("x", (F.col("leg_id") % 97) / 97.0)).cache()
    train, validation = own.where("leg_id % 4 <> 0").cache(), own.where("leg_id % 4 = 0").cache()
    made = jobs.model_benchmark(train, validation, "leg_id", "y", {"ridge": models.ridge(train, "y", 1.0), "forest_5_3": models.tree_grid("y", (5,), (3,))["forest_5_3"]}, [("type", ["event_type"], 5)], {"all": F.lit(True), "late": F.col("y") > 15})
    assert made["predictions"].count() == validation.count() and made["metrics"].count() == 6 and made["ranking"].where("candidate = 'baseline' and combined_gain = 0").count() == 1
    median = dict(train.groupBy("event_type").agg(F.median("y")).collect())
    assert all(abs(r["baseline"] - median[r["event_type"]]) < 1e-9 for r in made["predictions"].select("event_type", "baseline").collect())

    some = models.logistic_sweep(train, validation, "y", (15.0,), (0.01,), ("none", "balanced"))
    assert some.count() == 2 and some.where("roc_auc between 0 and 1").count() == 2
    weighed = models.weight_sweep(train, validation, "y", (1.0, 0.5))
    assert weighed.where("candidate = 'share_1.0' and gain = 0 and allowed").count() == 1
    assert models.two_stage_sweep(train, validation, "y", "probability", (1.0,)).count() == 1
    scored = made["predictions"].withColumns({"zero": F.lit(0.0), "some": F.col("probability")})
    out = jobs.combine_and_score(scored, "leg_id", "y", ["ridge", "baseline", "zero"], "probability", "some", 2.0)
    assert out["simplex"].count() == 66 and out["thresholds"].count() == 71 and out["predictions"].count() == validation.count()
    r = out["predictions"].orderBy("leg_id").first()
    assert abs(r["expected"] - (r["p_late"] * min(60, max(15, r["minutes"])) + (1 - r["p_late"]) * 2.0)) < 1e-9
    for wrong in (1.5, -0.1, float("nan"), None):
        with pytest.raises(ValueError):
            evaluate.checked_scores(scored.withColumn("some", F.lit(wrong).cast("double")), "probability", "some")
    with pytest.raises(ValueError):
        evaluate.align(scored.where("leg_id % 8 = 0").select("leg_id"), validation, "leg_id")


def test_expanded_features(spark, legs):
    nation = spark.read.parquet(f"{SF}/nation.parquet").select("n_nationkey", F.col("n_regionkey").alias("region"))
    own = legs.withColumns({"leg_type": F.lit("S"), "id": F.xxhash64("order_id", "line_no", "operator", "equipment"), "registration": F.col("operator"), "arrival_time": F.col("scheduled_off_block")}).dropDuplicates(["id"])
    history = own.select("id", "origin", "destination", "operator", "registration", "scheduled_off_block", "arrival_time", F.col("departure_delay_min"), F.col("arrival_delay_min"))
    roles = {"id": "id", "cutoff": "cutoff", "origin": "origin", "destination": "destination", "operator": "operator", "registration": "registration", "scheduled_departure": "scheduled_off_block", "scheduled_arrival": "arrival_time", "departure_time": "scheduled_off_block", "arrival_time": "arrival_time", "departure_delay": "departure_delay_min", "arrival_delay": "arrival_delay_min"}
    bounds = ["1990-01-01", "1996-06-01", "1997-01-01", "1998-01-01", "2010-01-01"]
    made = jobs.expanded_features(own, history, roles, "scheduled_off_block", "arrival_delay_min", rules=RULES, places=nation, place_key="n_nationkey", bounds=bounds, categories=["equipment"], numeric=["scheduled_duration_min"], least=10)
    parts = {r["split"]: r["rows"] for r in made["contract"].collect()}
    assert set(parts) == {"train", "validation", "test", "final_test"}
    assert sum(parts.values()) == made["features"].count() == made["features"].select("id").distinct().count() > 0.9 * own.count()
    assert made["audit"].where("violations > 0").count() == 0 and made["nulls"].count() > 4


def test_audit_of_monthly_files(spark, tmp_path):
    from delaylens.sources import flights

    line = "{},AAA,1.5,2.5,BBB,3.0,4.0,01-01-2022 10:00:00,01-01-2022 12:00:00,,,A320,{},REG,S,Seg,350,500.5"
    paths = []
    for month, last, operator in (("202201", "31", "OP"), ("202202", "28", "")):
        folder = tmp_path / month
        folder.mkdir()
        path = folder / f"Flights_{month}01_{month}{last}.csv"
        path.write_text(",".join(flights.RAW_COLUMNS) + "\n" + "\n".join(line.format(k, operator) for k in range(4)) + "\n")
        paths.append(str(path))
    made = jobs.audit_files(spark, paths, ["202202"], ["AC Operator", "ADEP"])
    assert made["catalog"].count() == 2 and made["schema"].where("equal").count() == 2
    assert {(r["month"], r["column"]): r["nulls"] for r in made["nulls"].collect()} == {("202201", "AC Operator"): 0, ("202202", "AC Operator"): 4, ("202201", "ADEP"): 0, ("202202", "ADEP"): 0}
    cohorts = {r["column"]: r for r in made["cohorts"].collect()}
    assert cohorts["AC Operator"]["delta"] == 100.0 and cohorts["AC Operator"]["material"] and not cohorts["ADEP"]["material"]


def test_training_to_locked_scoring(spark, tmp_path):
    import numpy as np

    views.predictions(spark, SF).withColumn("x", (F.col("leg_id") % 97) / 97.0).drop("probability").write.parquet(str(tmp_path / "rows"))
    own = spark.read.parquet(str(tmp_path / "rows"))
    part = lambda *k: own.where((F.col("leg_id") % 5).isin(*k))
    run = lambda locked, alphas=(0.1, 10.0): jobs.train_and_score(part(0, 1), part(2), locked, "leg_id", "y", ["event_type"], [], ["yhat", "x"], str(tmp_path / "ledger"), alphas=alphas, regs=(0.01,))
    made = run({"march": part(3), "june": part(4)})
    got = made["predictions"].collect()
    assert len(got) == part(3, 4).count() and {r["split"] for r in got} == {"march", "june"}
    cuts = {r["target"]: r["threshold"] for t in ("later_than_15", "later_than_1") for r in [max(made["thresholds"].where(F.col("target") == t).collect(), key=lambda r: (r["f1"], r["recall"], -r["threshold"]))]}
    reference = np.median([r["y"] for r in part(0, 1).where("y <= 15").collect()])
    for r in got:
        assert 0 <= r["p_late"] <= 1 and 0 <= r["p_some"] <= 1
        assert r["says_late"] == (r["p_late"] >= cuts["later_than_15"]) and r["says_some"] == (r["p_some"] >= cuts["later_than_1"])
        assert r["expected"] == pytest.approx(r["p_late"] * max(15, r["minutes"]) + (1 - r["p_late"]) * reference)
    assert made["minutes"].count() == 2 and made["chances"].count() == 2 and made["thresholds"].count() == 142
    again = run({"march": part(3)})["predictions"]  # the same contract: the stored rows
    assert sorted(map(tuple, again.collect())) == sorted(tuple(r) for r in got if r["split"] == "march")
    with pytest.raises(ValueError, match="another contract"):
        run({"march": part(3)}, alphas=(500.0,))
    with pytest.raises(ValueError, match="another contract"):
        run({"march": part(3).where("leg_id > 10")})


def test_scores_of_a_sweep_are_counted_once(spark, monkeypatch):
    """Ranking reads the counts of scores several times; what it reads is kept, and let go after."""
    from pyspark.ml.feature import VectorAssembler

    from delaylens.operators import evaluate, models

    kept, real = [], evaluate.running_totals

    def seen(counted, *args, **how):
        kept.append((counted, counted.storageLevel.useDisk))
        return real(counted, *args, **how)

    monkeypatch.setattr(evaluate, "running_totals", seen)
    own = VectorAssembler(inputCols=["yhat"], outputCol="features").transform(views.predictions(spark, SF).select("leg_id", "y", "yhat"))
    out = models.logistic_sweep(own.where("leg_id % 4 <> 0"), own.where("leg_id % 4 = 0"), "y", (15.0,), (0.01,), ("none",))
    assert out.count() == 1 and [k for _, k in kept] == [True] and not kept[0][0].storageLevel.useDisk


def test_sweep_cells_equal_single_fits(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from delaylens.operators import evaluate, models

    own = VectorAssembler(inputCols=["yhat", "x"], outputCol="features").transform(views.predictions(spark, SF).withColumn("x", (F.col("leg_id") % 97) / 97.0)).drop("probability").cache()
    train, validation = own.where("leg_id % 4 <> 0"), own.where("leg_id % 4 = 0")
    got = {(r["late"], r["candidate"], r["weights"]): r for r in models.logistic_sweep(train, validation, "y").collect()}
    assert len(got) == 12
    for late, reg, kind in ((15.0, 0.1, "balanced"), (1.0, 0.01, "none")):
        weighed = models.balanced_weights(train.withColumn("label", (F.col("y") > late).cast("int")), "label", "w")
        weighed = weighed if kind == "balanced" else weighed.withColumn("w", F.lit(1.0))
        model = models.logistic_candidates("label", (reg,), "w")[f"reg_{reg}"].fit(weighed)
        rows = model.transform(validation).select("y", vector_to_array("probability")[1].alias("p")).collect()
        yes, no = [r["p"] for r in rows if r["y"] > late], [r["p"] for r in rows if r["y"] <= late]
        auc = sum((a > b) + (a == b) / 2 for a in yes for b in no) / (len(yes) * len(no))
        assert got[late, f"reg_{reg}", kind]["roc_auc"] == pytest.approx(auc, abs=1e-6)
    best, scores = models.sweep(train, validation, "y", models.tree_grid("y", (3,), (2, 3)))
    rows = {r["candidate"]: r for r in scores.collect()}
    assert set(rows) == {"forest_3_2", "forest_3_3", "gbt_3_2", "gbt_3_3"} and best in rows
    alone = evaluate.compact_score(models.tree_grid("y", (3,), (2,))["gbt_3_2"].fit(train).transform(validation), "y", "prediction").first()
    assert rows["gbt_3_2"]["global_mae"] == pytest.approx(alone["global_mae"], rel=1e-6)
    weighed = {r["candidate"]: r for r in models.weight_sweep(train, validation, "y", (1.0, 0.5)).collect()}
    w = models.delayed_weights(train, "y", 0.5, name="_w")
    alone = evaluate.compact_score(models.ridge(w, "y", 1.0, "_w").fit(w).transform(validation), "y", "prediction").first()
    assert weighed["share_0.5"]["combined_mae"] == pytest.approx(alone["combined_mae"], rel=1e-4)
