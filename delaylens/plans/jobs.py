"""Compositions that a user runs: audits, feature tables, exports, baselines, model selection.

Each job takes frames and returns named frames; writing them is the caller's
choice (``sources.flights.write_split`` and ``write_bundle``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ReliabilityConfig, Rule
from ..functions.expressions import num
from ..operators import clean, enrich, evaluate, inference, models, pointintime, profile, ranking, reliability
from ..operators.tally import medians
from ..sources import flights


def audit_files(spark: SparkSession, files: Sequence[str], new_months: Sequence[str], columns: Sequence[str]) -> dict[str, DataFrame]:
    """All monthly files: the catalogue, header drift, nulls by month, and old against new months."""
    months = flights.monthly_files(spark, files)
    paths = [r["path"] for r in months.orderBy("month").collect()]  # one path a month
    month = F.regexp_extract(F.col("_metadata.file_name"), r"Flights_(\d{6})", 1)
    raw = flights.read_flights(spark, paths).withColumn("month", month)
    nulls = profile.null_profile(raw, columns, ["month"])
    return {"catalog": months, "schema": flights.schema_audit(spark, paths), "nulls": nulls, "cohorts": profile.null_cohorts(nulls, "month", new_months)}


def base_features(legs: DataFrame, rules: Sequence[Rule], places: DataFrame, place_key: str, time: str, bounds: Sequence[str], categories: Sequence[str], numeric: Sequence[str], target: str, least: int = 1000) -> dict[str, DataFrame]:
    """Cleaned, enriched and split legs; rare categories and medians are learnt from the training rows."""
    own = clean.fill_text(clean.normalise_text(clean.apply_quality_rules(legs, rules), categories), categories)
    own = enrich.left_join_dimension(own, places, "origin", place_key, "_origin")
    split = models.temporal_split(own, time, bounds)
    train = split.where("split = 'train'")
    for c in categories:
        split = enrich.map_rare(split, c, enrich.frequent_vocabulary(train, c, least))
    split = split.join(F.broadcast(medians(train, numeric))).withColumns({c: F.coalesce(c, f"_{c}") for c in numeric}).drop(*[f"_{c}" for c in numeric])
    split = split.where(F.col(target).isNotNull())
    return {"features": split, "contract": profile.split_contract(split, "split", target), "nulls": profile.null_profile(split, [*categories, *numeric], ["split"])}


def operational_features(targets: DataFrame, history: DataFrame, roles: dict[str, str], percent: float, time: str, lead: int = 60) -> tuple[DataFrame, DataFrame]:
    """The standard point-in-time blocks for a nested sample of targets, and their audit; raises on a leak."""
    own = clean.prediction_cutoff(flights.percent_sample(targets, percent, roles["id"]), time, lead, roles["cutoff"])
    out, audit = pointintime.standard_features(own, history, roles)
    if audit.where("violations > 0").limit(1).count():
        raise ValueError("a feature sees an event after its cutoff")
    return out, audit


def expanded_features(legs: DataFrame, history: DataFrame, roles: dict[str, str], time: str, target: str, percent: float = 100.0, lead: int = 60, **base) -> dict[str, DataFrame]:
    """Feature tables of all splits an hour before departure: cleaned, enriched and split legs (``base_features``) with the point-in-time blocks, and their audits by split; raises on a leak or on a column that only the flight itself tells."""
    made = base_features(legs, time=time, target=target, **base)
    out, audit = operational_features(made["features"], history, roles, percent, time, lead)
    added = [c for c in out.columns if c not in made["features"].columns]
    clean.forbid_columns(out.select(*added), ["departure_delay_min", target])
    return {"features": out, "audit": audit, "contract": profile.split_contract(out, "split", target), "nulls": profile.null_profile(out, added, ["split"]), "base_nulls": made["nulls"]}


def model_benchmark(train: DataFrame, validation: DataFrame, key: str, y: str, estimators: dict, levels: Sequence[tuple[str, Sequence[str], int]], segments: dict[str, Column]) -> dict[str, DataFrame]:
    """Models beside the grouped-median baseline on the same rows: metrics by segment, compact scores, and the ranking against the baseline.

    Predictions are aligned by id; a candidate that lacks rows, or has others, raises.
    """
    joint = evaluate.fallback_cascade(validation, train, y, levels).select(key, F.col("prediction").alias("baseline"))
    for name, estimator in estimators.items():
        joint = evaluate.align(joint, estimator.fit(train).transform(validation).select(key, F.col("prediction").alias(name)), key)
    joint = evaluate.align(joint, validation, key)
    names = ["baseline", *estimators]
    scores = None
    for name in names:
        one = evaluate.compact_score(joint, y, name).withColumn("candidate", F.lit(name))
        scores = one if scores is None else scores.unionByName(one)
    return {"predictions": joint, "metrics": evaluate.regression_metrics(joint, y, {n: F.col(n) for n in names}, segments), "scores": scores, "ranking": evaluate.rank_candidates(scores, "candidate", "baseline")}


def combine_and_score(scored: DataFrame, key: str, y: str, minutes: Sequence[str], chance: str, some: str, reference: float, late: float = 15.0, guardrail: float = 0.25, cap: float | None = None) -> dict[str, DataFrame]:
    """Blends, weights of three models, thresholds, the expected delay and the joint table of predictions.

    ``minutes`` names three predictions of minutes (the first two are blended),
    ``chance`` and ``some`` the probabilities of more than ``late`` and of more
    than one minute.  Scores that are no probabilities raise.
    """
    blends = evaluate.blend_grid(scored, y, minutes[0], minutes[1], late=late)
    weight = blends.orderBy("combined_mae", "global_mae", "weight").first()["weight"]
    table = evaluate.threshold_table(scored, y, late, chance)
    cut = evaluate.best_threshold(table).first()["threshold"]
    mixed = evaluate.blend(F.col(minutes[0]), F.col(minutes[1]), weight)
    expected = evaluate.hurdle(F.col(chance), mixed, num(reference), cap=cap)
    joint = scored.select(key, y, mixed.alias("minutes"), expected.alias("expected"), evaluate.chance(F.col(chance)).alias("p_late"), evaluate.chance(F.col(some)).alias("p_some"), (F.col(chance) >= cut).alias("says_late"), clean.severity_band(mixed).alias("band"))
    return {"blends": blends, "simplex": evaluate.simplex_grid(scored, y, minutes, guardrail=guardrail, late=late), "thresholds": table, "predictions": joint, "expected": evaluate.compact_score(joint, y, "expected", late)}


def business_export(legs: DataFrame, config: ReliabilityConfig, time: str, first: str, second: str) -> dict[str, DataFrame]:
    """The tables of the business analysis."""
    own = clean.calendar_columns(legs, time)
    routes, operators = reliability.route_performance(own), reliability.operator_performance(own)
    network = reliability.overall_kpis(own)
    otp = network.first()["otp15_pct"]
    weekdays = reliability.on_time_by(own, ["weekday"])
    trends = inference.period_trends(reliability.entity_periods(own, "origin"), "origin", materiality=config.materiality_points)
    banded = own.withColumn("duration_band", clean.duration_band(F.col("scheduled_duration_min")))
    return {
        "network": network, "routes": routes, "operators": operators, "origins": reliability.airport_performance(own, "origin"), "destinations": reliability.airport_performance(own, "destination"),
        "route_thresholds": reliability.threshold_sensitivity(reliability.route_volume(own), (100, config.min_route_flights), (1, config.min_route_periods)), "executive_routes": reliability.executive_routes(routes, otp, ["origin", "destination"], config),
        "operator_tests": inference.group_against_rest(operators, "operator", materiality=config.materiality_points), "weekday_tests": inference.group_against_rest(weekdays, "weekday", materiality=config.materiality_points), "trends": trends, "alerts": inference.period_alerts(own, "origin"),
        "correlations": inference.correlations(own, ["scheduled_duration_min", "departure_delay_min", "arrival_delay_min"]), "recovery": inference.recovery_signed_rank(own), "duration_test": inference.band_kruskal_wallis(banded), "period_test": inference.compare_periods(own, first, second), "hypotheses": inference.hypothesis_catalog(legs.sparkSession),
    }


def report_tables(legs: DataFrame, countries: DataFrame, place_key: str, country: str, family: Column, pair: tuple, least: int = 30) -> dict[str, DataFrame]:
    """Airports, countries, carriers, a city pair, hours and congestion."""
    airports = reliability.airport_profile(legs)
    named = enrich.left_join_dimension(reliability.airport_totals(legs), countries, "airport", place_key, "", [country])
    rolled = reliability.country_rollup(named, country)
    cells = reliability.airport_hours(legs)
    shared = reliability.family_routes(legs, family, "a", "b", ["origin", "destination"], least)
    a, b = pair
    city = legs.where(((F.col("origin") == a) & (F.col("destination") == b)) | ((F.col("origin") == b) & (F.col("destination") == a)))
    keys = ["period", "operator", "departure_hour"]
    return {
        "airports": airports, "countries": rolled, "country_tests": inference.group_against_rest(rolled, country, n="movements"), "carriers": reliability.relative_delay(legs, ["operator"]), "shared_routes": shared, "standardised": reliability.standardised_means(shared),
        "city_pair": reliability.grouping_study(city, keys, [[k] for k in keys]), "largest_delays": ranking.top_rows(city, [F.desc("arrival_delay_min"), *[F.asc(k) for k in keys]], 5), "hours": reliability.hourly_network(legs), "congestion": reliability.congestion_bands(cells), "peaks": reliability.recurring_peaks(cells),
    }


def public_tables(legs: DataFrame, config: ReliabilityConfig) -> dict[str, DataFrame]:
    """The published aggregates; no row describes a single leg.  Every table reads ``legs`` again: give stored ones."""
    routes, frequent = reliability.route_metrics(legs, config=config), reliability.eligible_routes(legs, config=config)
    return {
        "overview": reliability.scope_summary(legs), "monthly": reliability.scope_summary(legs, ["scope", "period"]), "severity": reliability.severity_distribution(legs), "durations": reliability.duration_hours(legs), "concentration": reliability.delay_concentration(clean.explode_scopes(legs), ["scope"]),
        "deciles": reliability.delay_deciles(legs), "worst_tenth": reliability.worst_and_rest(legs), "routes": routes, "route_scopes": reliability.route_scope_summary(legs), "route_months": reliability.eligible_months(legs, config=config), "route_operators": reliability.eligible_breakdown(legs, frequent, "operator"),
        "association": inference.correlations(legs.where("scheduled_duration_min > 0"), ["scheduled_duration_min", "arrival_delay_min"]),
    }


def baseline_selection(train: DataFrame, validation: DataFrame, test: DataFrame, y: str, keys: Sequence[Sequence[str]], minimums: Sequence[int] = (20, 50, 100, 200)) -> tuple[int, DataFrame, DataFrame]:
    """The minimum group size with the smallest validation error, what all of them gave, and the errors of the best on the locked test rows."""
    levels = [("_".join(k), list(k), 1) for k in keys]
    search = evaluate.baseline_search(validation, train, y, levels, minimums)
    found = search.collect()  # a row for each minimum
    best = min(found, key=lambda r: (r["mae"], r["minimum"]))["minimum"]
    scored = evaluate.fallback_cascade(test, train, y, [(name, k, best) for name, k, _ in levels])
    return best, train.sparkSession.createDataFrame(found, search.schema), evaluate.regression_metrics(scored, y, {"baseline": F.col("prediction")}, {"all": F.lit(True), "late": F.col(y) > 15})


def train_and_score(train: DataFrame, validation: DataFrame, locked: dict[str, DataFrame], key: str, y: str, few: Sequence[str], many: Sequence[str], numeric: Sequence[str], ledger: str, lates: tuple[float, float] = (15.0, 1.0), alphas: Sequence[float] = (0.1, 1.0, 10.0), regs: Sequence[float] = (0.01, 0.1), bins: int = 1 << 12) -> dict[str, DataFrame]:
    """From training to locked scoring in one job: features once, ridges and classifiers of two targets chosen on validation, thresholds, the expected delay, and one scoring of each locked split.

    Returns the scores of the minutes (``minutes``), of the classifiers
    (``chances``), the thresholds, and ``predictions`` of all locked splits:
    id, actual minutes, predicted ones, both probabilities and decisions,
    expected delay and band.  A split that was scored before comes from the
    ledger; under another contract that raises.
    """
    names = [f"later_than_{x:g}" for x in lates]
    prepared = models.preprocessor(train, few, many, numeric, bins).fit(train)
    ready = lambda df: prepared.transform(df).select(key, y, "features")
    with models.held(ready(train.where(F.col(y).isNotNull())), ready(validation.where(F.col(y).isNotNull()))) as (own, rows):
        ridges = models.fit_all({f"alpha_{a}": models.ridge(own, y, a) for a in alphas}, own)
        minutes = evaluate.compact_scores(models.score_all(rows, ridges, [y]), y, list(ridges))
        frames = {n: own.withColumn("_late", (F.col(y) > x).cast("int")) for n, x in zip(names, lates)}
        cells = {f"{n}|{r}": e for n in names for r, e in models.logistic_candidates("_late", regs, None).items()}
        fitted = models.fit_all(cells, {c: frames[c.split("|")[0]] for c in cells})
        scored = models.score_all(rows, fitted, [y], "probability")
        chances = None
        for cell in cells:
            late = lates[names.index(cell.split("|")[0])]
            one = evaluate.ranking_quality(scored.select(y, F.col(f"`{cell}`").alias("score")), F.col(y) > late, "score").withColumn("candidate", F.lit(cell))
            chances = one if chances is None else chances.unionByName(one)
        minutes, chances = (df.sparkSession.createDataFrame(df.collect(), df.schema) for df in (minutes, chances))  # a row for each candidate
        best = min(minutes.collect(), key=lambda r: (r["combined_mae"] if r["combined_mae"] is not None else r["global_mae"], r["global_mae"], r["candidate"]))["candidate"]
        classifier = {n: max((r for r in chances.collect() if r["candidate"].startswith(f"{n}|")), key=lambda r: (r["average_precision"] or 0.0, r["roc_auc"] or 0.0, r["candidate"]))["candidate"] for n in names}
        tables = {n: evaluate.threshold_table(scored.select(y, F.col(f"`{classifier[n]}`").alias("score")), y, x, "score").withColumn("target", F.lit(n)) for n, x in zip(names, lates)}
        cuts = {n: evaluate.best_threshold(t).first()["threshold"] for n, t in tables.items()}
        thresholds = tables[names[0]].unionByName(tables[names[1]])
        thresholds = thresholds.sparkSession.createDataFrame(thresholds.collect(), thresholds.schema)
        reference = medians(own.where(F.col(y) <= lates[0]), [y]).first()[0] or 0.0
    chosen = {"minutes": ridges[best], names[0]: fitted[classifier[names[0]]], names[1]: fitted[classifier[names[1]]]}
    settings = {"reference": reference, **cuts}

    def score(df: DataFrame) -> DataFrame:
        rows = ready(df)
        a = models.score_all(rows, {"minutes": chosen["minutes"]}, [key, y, "features"])
        b = models.score_all(a, {n: chosen[n] for n in names}, [key, y, "minutes"], "probability")
        p, q = F.col(names[0]), F.col(names[1])
        return b.select(key, y, evaluate.finite(F.col("minutes"), "minutes").alias("minutes"), evaluate.chance(p).alias("p_late"), evaluate.chance(q).alias("p_some"), (p >= cuts[names[0]]).alias("says_late"), (q >= cuts[names[1]]).alias("says_some"), evaluate.hurdle(p, F.col("minutes"), num(reference), lates[0]).alias("expected"), clean.severity_band(F.col("minutes")).alias("band"))

    columns = [key, y, *few, *many, *numeric]
    predictions = None
    for split, df in locked.items():
        one = models.score_locked(df, split, ledger, {"prepared": prepared, **chosen}, columns, settings, score).withColumn("split", F.lit(split))
        predictions = one if predictions is None else predictions.unionByName(one)
    return {"minutes": minutes, "chances": chances, "thresholds": thresholds, "predictions": predictions}


def select_and_freeze(train: DataFrame, validation: DataFrame, locked: DataFrame, y: str, few: Sequence[str], many: Sequence[str], numeric: Sequence[str], path: str, alphas: Sequence[float] = (0.1, 1.0, 10.0, 100.0)) -> tuple[DataFrame, DataFrame]:
    """Pre-processing and ridge chosen on validation, saved with its contract, then one scoring of the locked rows: (validation scores, locked metrics)."""
    from pyspark.ml import Pipeline

    prepared = models.preprocessor(train, few, many, numeric)
    candidates = {f"ridge_{a}": Pipeline(stages=[prepared, models.ridge(train, y, a)]) for a in alphas}
    best, scores = models.sweep(train, validation, y, candidates)
    frozen = candidates[best].fit(train)
    models.save_contract(frozen, path, {"target": y, "selected": best, "features": " ".join([*few, *many, *numeric])})
    scored = frozen.transform(locked)
    return scores, evaluate.regression_metrics(scored, y, {best: F.col("prediction"), "zero": num(0)}, {"all": F.lit(True), "late": F.col(y) > 15})
