"""Evaluation of predictions: regression and classification metrics by segment, curves, thresholds, blends, baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import num, ratio
from .tally import Tally, counted_quantiles, running_totals


def target_summary(df: DataFrame, y: str) -> DataFrame:
    """Rows, moments, late shares and quantiles of a target."""
    c = F.col(y)
    moments = df.agg(F.count(c).alias("rows"), F.avg(c).alias("mean"), F.stddev(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), ratio(F.count_if(c > 15), F.count(c)).alias("late_15"), ratio(F.count_if(c > 60), F.count(c)).alias("late_60"))
    t = Tally(df, [], {"y": c})
    return moments.join(F.broadcast(t.agg({f"q{int(q * 100)}": t.quantile("y", q) for q in (0.25, 0.5, 0.75, 0.9, 0.99)})))  # one row


def align(predictions: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Predictions beside their targets; repeated, missing or additional ids raise."""
    for name, df in (("predictions", predictions), ("targets", targets)):
        n, d = df.agg(F.count("*"), F.count_distinct(key)).first()
        if n != d:
            raise ValueError(f"ids of the {name} are not unique")
    if predictions.join(targets, key, "full").where(F.col(key).isNull()).limit(1).count() or predictions.count() != targets.count() or predictions.join(targets, key, "left_anti").limit(1).count():
        raise ValueError("predictions and targets have different ids")
    return predictions.join(targets, key)


def explode_segments(df: DataFrame, segments: dict[str, Column]) -> DataFrame:
    """A row for each segment that a row is in."""
    inside = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in segments.items()]))
    return df.withColumn("segment", F.explode(inside))


def regression_metrics(df: DataFrame, y: str, candidates: dict[str, Column], segments: dict[str, Column]) -> DataFrame:
    """Rows, MAE, RMSE, median and p90 of the absolute error for each candidate and segment; empty segments give no row."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("candidate"), c.cast("double").alias("yhat")) for n, c in candidates.items()])).alias("p")
    each = explode_segments(df, segments).select("segment", F.col(y).cast("double").alias("y"), pairs).select("segment", "y", "p.*")
    t = Tally(each, ["candidate", "segment"], {"row": num(0), "error": F.abs(F.col("y") - F.col("yhat"))})
    return t.agg({"rows": t.rows("row"), "mae": t.mean("error"), "rmse": F.sqrt(ratio(t.total("error", F.col("value") * F.col("value")), t.rows("error"))), "median_error": t.quantile("error", 0.5), "p90_error": t.quantile("error", 0.9)})


def haul_segments(haul: str = "haul", direction: str = "direction", out: str = "out") -> dict[str, Column]:
    """Six overlapping segments by haul and direction."""
    long, away = F.col(haul) == "long", F.col(direction) == out
    return {"all": F.lit(True), "short_medium": ~long, "long": long, "outbound": away, "other": ~away, "long_outbound": long & away}


def compact_score(df: DataFrame, y: str, yhat: str, late: float = 15.0, weight: float = 0.5) -> DataFrame:
    """Global MAE, MAE of late rows, and their weighted sum."""
    e = F.abs(F.col(y) - F.col(yhat))
    out = df.agg(F.avg(e).alias("global_mae"), F.avg(F.when(F.col(y) > late, e)).alias("delayed_mae"))
    return out.withColumn("combined_mae", weight * F.col("global_mae") + (1 - weight) * F.col("delayed_mae"))


def compact_scores(df: DataFrame, y: str, candidates: Sequence[str], late: float = 15.0, weight: float = 0.5) -> DataFrame:
    """``compact_score`` of every candidate column, in one pass: a row for each, with ``candidate``."""
    each = df.select(F.col(y).alias("_y"), F.explode(F.array(*[F.struct(F.lit(n).alias("candidate"), F.col(f"`{n}`").cast("double").alias("_p")) for n in candidates])).alias("c")).select("_y", "c.*")
    e = F.abs(F.col("_y") - F.col("_p"))
    out = each.groupBy("candidate").agg(F.avg(e).alias("global_mae"), F.avg(F.when(F.col("_y") > late, e)).alias("delayed_mae"))
    return out.withColumn("combined_mae", weight * F.col("global_mae") + (1 - weight) * F.col("delayed_mae")).select("global_mae", "delayed_mae", "combined_mae", "candidate")


def _confusion(actual: Column, said: Column) -> list[Column]:
    return [F.count_if(actual & said).alias("tp"), F.count_if(~actual & said).alias("fp"), F.count_if(actual & ~said).alias("fn"), F.count_if(~actual & ~said).alias("tn")]


def _rates(df: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    zero = lambda c: F.coalesce(c, num(0))
    recall, precision, specificity = zero(ratio(tp, tp + fn)), zero(ratio(tp, tp + fp)), zero(ratio(tn, tn + fp))
    n = tp + fp + fn + tn
    return df.withColumns({"accuracy": ratio(tp + tn, n), "recall": recall, "precision": precision, "specificity": specificity, "balanced_accuracy": (recall + specificity) / 2, "f1": zero(ratio(2 * tp, 2 * tp + fp + fn)), "actual_rate": ratio(tp + fn, n), "predicted_rate": ratio(tp + fp, n)})


def classification_metrics(df: DataFrame, y: str, late: float, said: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Confusion and rates of "later than ``late``"; undefined rates are 0."""
    actual = F.col(y) > late
    own = df.where(F.col(y).isNotNull())
    return _rates(own.groupBy(*keys).agg(*_confusion(actual, said)) if keys else own.agg(*_confusion(actual, said)))


def ranking_quality(df: DataFrame, actual: Column, score: str) -> DataFrame:
    """ROC-AUC from average ranks and average precision over the distinct scores, from one count of them."""
    return grouped_ranking_quality(df, actual, score)


def grouped_ranking_quality(df: DataFrame, actual: Column, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """``ranking_quality`` for each key; scores are cut into ranges, so no task holds all of a key."""
    return quality_of_counts(score_counts(df, actual, score, keys), score, keys)


def score_counts(df: DataFrame, actual: Column, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows ``n`` and positives ``pos`` of each distinct score (of each key)."""
    return df.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count("*").alias("n"), F.coalesce(F.sum(actual.cast("int")), F.lit(0)).alias("pos"))


def quality_of_counts(counted: DataFrame, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """``grouped_ranking_quality`` from ``score_counts``, which are read several times: keep them where scores are costly."""
    each = running_totals(counted, score, ["n", "pos"], keys, ranges=True)
    each = each.withColumns({"rank": F.col("n_before") + (F.col("n") + 1) / 2.0, "hits": F.col("pos_total") - F.col("pos_before"), "taken": F.col("n_total") - F.col("n_before")})
    one = each.groupBy(*keys).agg(F.sum(F.col("pos") * F.col("rank")).alias("r"), F.sum("pos").cast("double").alias("p"), F.max("n_total").cast("double").alias("t"), F.sum(F.col("pos") * F.col("hits") / F.col("taken")).alias("ap"))
    p = F.col("p")
    return one.select(*keys, ratio(F.col("r") - p * (p + 1) / 2, p * (F.col("t") - p)).alias("roc_auc"), ratio(F.col("ap"), p).alias("average_precision"))


def grid(df: DataFrame, name: str, values: Sequence[float]) -> DataFrame:
    """Every row with each of a few values; the values are aggregated away in the same pass."""
    return df.withColumn(name, F.explode(F.array(*[num(v) for v in values])))


def threshold_table(df: DataFrame, y: str, late: float, score: str, thresholds: Sequence[float] | None = None, miss_cost: float = 3.0) -> DataFrame:
    """Classification metrics and cost for each threshold (0.05 to 0.75 by 0.01 and 0.5)."""
    values = sorted({round(0.05 + 0.01 * k, 2) for k in range(71)} | {0.5}) if thresholds is None else list(thresholds)
    counted = df.where(F.col(y).isNotNull()).groupBy(F.col(score).alias("_s")).agg(F.count_if(F.col(y) > late).alias("pos"), F.count("*").alias("n"))  # scores once
    each = grid(counted, "threshold", values)
    said = F.col("_s") >= F.col("threshold")
    neg = F.col("n") - F.col("pos")
    out = each.groupBy("threshold").agg(F.sum(F.when(said, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(said, neg).otherwise(0)).alias("fp"), F.sum(F.when(~said, F.col("pos")).otherwise(0)).alias("fn"), F.sum(F.when(~said, neg).otherwise(0)).alias("tn"))
    return _rates(out).withColumn("cost", (miss_cost * F.col("fn") + F.col("fp")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))


def best_threshold(table: DataFrame, by: str = "f1") -> DataFrame:
    """The row with the best ``f1``, ``balanced_accuracy`` or ``cost``; ties go to recall, then to the lower threshold."""
    if by not in ("f1", "balanced_accuracy", "cost"):
        raise ValueError(f"unknown criterion {by!r}")
    return table.orderBy(F.asc(by) if by == "cost" else F.desc(by), F.desc("recall"), F.asc("threshold")).limit(1)


def checked_scores(df: DataFrame, *columns: str) -> DataFrame:
    """``df``, if all probabilities named are numbers within [0, 1]; raises otherwise."""
    fine = lambda c: F.coalesce(F.col(c).cast("double").between(0, 1), F.lit(False))
    bad = df.agg(*[F.count_if(~fine(c)).alias(c) for c in columns]).first().asDict()
    if any(bad.values()):
        raise ValueError(f"not probabilities: {({c: n for c, n in bad.items() if n})}")
    return df


def within_guardrail(scores: DataFrame, baseline: str, most: float = 0.25, name: str = "candidate") -> DataFrame:
    """Scores of candidates with ``allowed``: the global MAE is at most ``most`` above the baseline's, and ``gain`` on its combined MAE."""
    base = scores.where(F.col(name) == baseline).select(F.col("global_mae").alias("_g"), F.col("combined_mae").alias("_c"))
    return scores.join(F.broadcast(base)).withColumns({"allowed": F.col("global_mae") <= F.col("_g") + most, "gain": F.col("_c") - F.col("combined_mae")}).drop("_g", "_c")


def quantile_risk(df: DataFrame, y: str, yhat: str, q: float = 0.9, severe: float = 60.0) -> DataFrame:
    """Pinball loss, coverage, and recall and precision of severe delays for a predicted quantile."""
    d, p = F.col(y) - F.col(yhat), F.col(yhat) > severe
    a = F.col(y) > severe
    return df.agg(F.avg(F.when(d >= 0, q * d).otherwise((q - 1) * d)).alias("pinball"), ratio(F.count_if(F.col(y) <= F.col(yhat)), F.count("*")).alias("coverage"), F.coalesce(ratio(F.count_if(a & p), F.count_if(a)), num(0)).alias("severe_recall"), F.coalesce(ratio(F.count_if(a & p), F.count_if(p)), num(0)).alias("severe_precision"))


Level = tuple[str, Sequence[str], int]


def level_quantiles(train: DataFrame, y: str, levels: Sequence[Level], q: float = 0.5) -> tuple[list[DataFrame], DataFrame]:
    """A lattice of baselines: for each level (name, keys, minimum) its groups with ``_n_{name}`` rows and quantile ``_v_{name}``, and one row for all rows (``_global``).

    Training rows are counted once, by all keys and value; a level is summed
    from the counts of the finest level before it that has its keys, so coarse
    levels never see rows.  Groups of every size are there; minimums are the
    reader's.
    """
    every = list(dict.fromkeys(k for _, keys, _ in levels for k in keys))
    finest = train.where(F.col(y).isNotNull()).groupBy(*every, F.col(y).cast("double").alias("_y")).agg(F.count("*").alias("_c"))
    counts, made = {tuple(every): finest}, []
    for name, keys, _ in levels:
        above = min((k for k in counts if set(keys) <= set(k)), key=len)
        if set(above) != set(keys):
            counts[tuple(keys)] = counts[above].groupBy(*keys, "_y").agg(F.sum("_c").alias("_c"))
        own = counts[tuple(keys)] if tuple(keys) in counts else counts[above]
        made.append(counted_quantiles(own, keys, "_y", "_c", {f"_v_{name}": q}, f"_n_{name}"))
    least = min(counts, key=len)
    return made, counted_quantiles(counts[least], [], "_y", "_c", {"_global": q}, "_rows").drop("_rows")


def median_levels(train: DataFrame, y: str, levels: Sequence[Level], approx: bool = False) -> list[tuple[str, list[str], DataFrame]]:
    """Grouped medians of groups with enough rows, for each level (name, keys, minimum); ``approx`` takes Spark's sketch of the rows instead."""
    if approx:
        return [(name, list(keys), train.where(F.col(y).isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx(y, 0.5).alias(f"_{name}")).where(F.col("_n") >= least).drop("_n")) for name, keys, least in levels]
    made, _ = level_quantiles(train, y, levels)
    return [(name, list(keys), known.where(F.col(f"_n_{name}") >= least).select(*keys, F.col(f"_v_{name}").alias(f"_{name}"))) for (name, keys, least), known in zip(levels, made)]


def with_levels(df: DataFrame, train: DataFrame, y: str, levels: Sequence[Level], q: float = 0.5) -> DataFrame:
    """``df`` with the size and quantile of its group on every level, and the global one; adaptive execution broadcasts levels that turn out small."""
    made, whole = level_quantiles(train, y, levels, q)
    for (_, keys, _), known in zip(levels, made):
        df = df.join(known, list(keys), "left")
    return df.join(F.broadcast(whole))  # one row


def _chosen(levels: Sequence[Level], minimum: Column | None = None) -> tuple[Column, Column]:
    """The first level whose group is large enough: its value and its name; ``minimum`` replaces the levels' own."""
    value = source = None
    for name, _, least in levels:
        enough = F.col(f"_n_{name}") >= (F.lit(least) if minimum is None else minimum)
        value = (F if value is None else value).when(enough, F.col(f"_v_{name}"))
        source = (F if source is None else source).when(enough, F.lit(name))
    return value.otherwise(F.col("_global")), source.otherwise(F.lit("global"))


def fallback_cascade(df: DataFrame, train: DataFrame, y: str, levels: Sequence[Level], q: float = 0.5, out: str = "prediction") -> DataFrame:
    """The first level that knows a row's group gives its quantile, else the global one; ``source`` names the level."""
    value, source = _chosen(levels)
    joined = with_levels(df, train, y, levels, q).withColumns({out: value, "source": source})
    return joined.drop(*[f"_{x}_{n}" for n, _, _ in levels for x in "nv"], "_global")


def baseline_search(df: DataFrame, train: DataFrame, y: str, levels: Sequence[Level], minimums: Sequence[int] = (20, 50, 100, 200)) -> DataFrame:
    """For each minimum group size, in one pass: rows, rows that a level covers, those whose finest group was never seen, MAE, RMSE, and rows by source."""
    joined = with_levels(df.where(F.col(y).isNotNull()), train, y, levels)
    each = joined.withColumn("minimum", F.explode(F.array(*[F.lit(m).cast("long") for m in minimums])))
    value, source = _chosen(levels, F.col("minimum"))
    each = each.select("minimum", F.col(f"_n_{levels[0][0]}").isNull().alias("unseen"), source.alias("source"), (F.col(y) - value).alias("e"))
    names = [*[n for n, _, _ in levels], "global"]
    return each.groupBy("minimum").agg(F.count("*").alias("rows"), F.count_if(F.col("source") != "global").alias("covered"), F.count_if("unseen").alias("unseen"), F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), *[F.count_if(F.col("source") == n).alias(f"from_{n}") for n in names])


def majority_rate(df: DataFrame, train: DataFrame, y: str, late: float = 15.0, out: str = "probability") -> DataFrame:
    """Every row with the share of late training rows as its probability; 0 without any."""
    rate = train.where(F.col(y).isNotNull()).agg(F.coalesce(F.avg((F.col(y) > late).cast("int")), num(0)).alias(out))
    return df.drop(out).join(F.broadcast(rate))  # one row


def finite(value: Column, name: str) -> Column:
    """``value``, if it is a finite number; raises when the row is worked out otherwise."""
    v = value.cast("double")
    return F.when(F.coalesce((F.abs(v) < float("inf")) & ~F.isnan(v), F.lit(False)), v).otherwise(F.raise_error(F.lit(f"{name} is not a finite number")).cast("double"))


def chance(value: Column) -> Column:
    """``value``, if it is a probability; raises when the row is worked out otherwise."""
    v = value.cast("double")
    return F.when(F.coalesce(v.between(0, 1), F.lit(False)), v).otherwise(F.raise_error(F.lit("a probability does not lie in [0, 1]")).cast("double"))


def blend(a: Column, b: Column, weight: float) -> Column:
    """``weight`` parts of ``a`` and the rest of ``b``; values that are no finite numbers raise when the row is worked out."""
    if not 0 <= weight <= 1:
        raise ValueError("the weight must lie between 0 and 1")
    return weight * finite(a, "a prediction") + (1 - weight) * finite(b, "a prediction")


def blend_grid(df: DataFrame, y: str, a: str, b: str, steps: int = 21, late: float = 15.0) -> DataFrame:
    """Scores of the blends of two predictions for evenly spaced weights of the first."""
    each = grid(df, "weight", [k / (steps - 1) for k in range(steps)])
    e = F.abs(F.col(y) - (F.col("weight") * F.col(a) + (1 - F.col("weight")) * F.col(b)))
    return _scored(each.groupBy("weight"), e, y, late)


def _scored(groups, error: Column, y: str, late: float) -> DataFrame:
    out = groups.agg(F.avg(error).alias("global_mae"), F.avg(F.when(F.col(y) > late, error)).alias("delayed_mae"))
    return out.withColumn("combined_mae", (F.col("global_mae") + F.col("delayed_mae")) / 2)


def simplex_grid(df: DataFrame, y: str, models: Sequence[str], parts: int = 10, guardrail: float | None = None, late: float = 15.0) -> DataFrame:
    """Scores of all weights of three predictions in steps of 1 / ``parts``; ``allowed`` while the global MAE stays within the guardrail of the best single model."""
    cells = [(i, j, parts - i - j) for i in range(parts + 1) for j in range(parts + 1 - i)]
    each = df.withColumn("_w", F.explode(F.array(*[F.array(*[num(x / parts) for x in c]) for c in cells])))
    w = [F.col("_w")[k] for k in range(3)]
    e = F.abs(F.col(y) - (w[0] * F.col(models[0]) + w[1] * F.col(models[1]) + w[2] * F.col(models[2])))
    out = _scored(each.groupBy(*[x.alias(f"w{k + 1}") for k, x in enumerate(w)]), e, y, late)
    if guardrail is None:
        return out
    single = out.where("w1 = 1 or w2 = 1 or w3 = 1").agg(F.min("global_mae").alias("_best"))
    return out.join(F.broadcast(single)).withColumn("allowed", F.col("global_mae") <= F.col("_best") + guardrail).drop("_best")


def hurdle(probability: Column, severity: Column, reference: Column, low: float = 15.0, cap: float | None = None) -> Column:
    """Expected delay: p * severity, at least ``low`` and at most ``cap`` if there is one, + (1 - p) * reference.

    Probabilities outside [0, 1] and values that are no finite numbers raise when the row is worked out.
    """
    if cap is not None and cap < low:
        raise ValueError("the cap lies below the threshold")
    worst = F.greatest(num(low), finite(severity, "severity"))
    return chance(probability) * (worst if cap is None else F.least(num(cap), worst)) + (1 - chance(probability)) * finite(reference, "reference")


def rank_candidates(scores: DataFrame, name: str, baseline: str, improvement: float = 0.2, degradation: float = 0.25) -> DataFrame:
    """Candidates by combined, then global MAE, with their gain on the baseline and whether it warrants more data."""
    base = scores.where(F.col(name) == baseline).select(F.col("combined_mae").alias("_c"), F.col("global_mae").alias("_g"))
    out = scores.join(F.broadcast(base))
    out = out.withColumns({"combined_gain": F.col("_c") - F.col("combined_mae"), "global_gain": F.col("_g") - F.col("global_mae")}).drop("_c", "_g")
    return out.withColumn("scale_up", (F.col("combined_gain") >= improvement) & (F.col("global_gain") >= -degradation))


def selection_table(metrics: DataFrame, segments: Sequence[str]) -> DataFrame:
    """One row for each candidate with the MAE of each segment, by conditional aggregation."""
    return metrics.groupBy("candidate").agg(*[F.max(F.when(F.col("segment") == s, F.col("mae"))).alias(f"{s}_mae") for s in segments])
