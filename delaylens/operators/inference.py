"""Tests, trends and correlations over aggregated tables; p values are column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import chi2_p, num, percent, ratio, student_t_p, two_proportion_z, two_sided_p
from .ranking import top_rows, value_ranks
from .reliability import ARRIVAL, DEPARTURE, DURATION
from .tally import heard, with_range


def benjamini_hochberg(df: DataFrame, p: str = "p_value", name: str = "p_adjusted", keys: Sequence[str] = ()) -> DataFrame:
    """Adjusted p values: the running minimum of p * m / rank from the largest p; null p values stay null and do not count.

    Without keys the p values are cut into ranges, which tell each other how
    many they hold and their smallest p * m / rank, so no task holds all rows.
    With keys a task holds the rows of a key.  All frames run from their first row.
    """
    by = [*keys] if keys else ["_range"]
    own = Window.partitionBy(*by)
    upto = lambda order: own.orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = (df if keys else with_range(df, p)).withColumns({"_r": F.count(p).over(upto(F.asc(p))), "_m": F.count(p).over(own)})
    if not keys:
        below = F.when(F.col("_from") < F.col("_range"), F.col("_m"))
        out = heard(out, p, {"_below": (F.sum, below), "_all": (F.sum, F.col("_m"))}).withColumns({"_r": F.col("_r") + F.coalesce("_below", F.lit(0)), "_m": F.col("_all")})
    out = out.withColumn("_q", F.col(p) * F.col("_m") / F.col("_r"))
    out = out.withColumns({"_low": F.min("_q").over(upto(F.desc(p))), "_least": F.min("_q").over(own)})
    if not keys:
        above = F.when(F.col("_from") > F.col("_range"), F.col("_least"))
        out = heard(out, p, {"_above": (F.min, above)}).withColumn("_low", F.least("_low", "_above"))
    return out.withColumn(name, F.when(F.col(p).isNotNull(), F.least(num(1), "_low"))).select(*df.columns, name)


def group_against_rest(groups: DataFrame, key: str, successes: str = "otp15_count", n: str = "flights", least: int = 0, materiality: float = 3.0, alpha: float = 0.05) -> DataFrame:
    """Each group with enough rows against all others: rates, difference in points, z, p, adjusted p, signal."""
    every = Window.partitionBy(F.lit(1))
    own = groups.withColumns({"_s": F.sum(successes).over(every), "_n": F.sum(n).over(every)}).where(F.col(n) >= least)
    rest_s, rest_n = F.col("_s") - F.col(successes), F.col("_n") - F.col(n)
    z = two_proportion_z(F.col(successes), F.col(n), rest_s, rest_n)
    out = own.select(key, F.col(n).alias("flights"), percent(F.col(successes), F.col(n)).alias("rate_pct"), percent(rest_s, rest_n).alias("rest_pct"), z.alias("z")).withColumns({"difference": F.col("rate_pct") - F.col("rest_pct"), "p_value": two_sided_p(F.col("z"))})
    out = benjamini_hochberg(out)
    sure = (F.col("p_adjusted") < alpha) & (F.abs("difference") >= materiality)
    return out.withColumn("signal", F.when(sure & (F.col("difference") > 0), "better").when(sure, "worse").otherwise("no_material_difference"))


def period_trends(periods: DataFrame, key: str, least_periods: int = 3, materiality: float = 3.0, alpha: float = 0.05) -> DataFrame:
    """A line through each entity's on-time rates over elapsed months: slope a year, fitted ends within 0 to 100, R², p of the slope, signal."""
    x, y = F.col("elapsed_months").cast("double"), F.col("otp15_pct")
    fit = periods.where(y.isNotNull()).groupBy(key).agg(F.count("*").alias("periods"), F.min("elapsed_months").alias("x0"), F.max("elapsed_months").alias("x1"), F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"), F.regr_r2(y, x).alias("r2")).where((F.col("periods") >= least_periods) & F.col("b").isNotNull())
    at = lambda c: F.least(num(100), F.greatest(num(0), F.col("a") + F.col("b") * F.col(c)))
    df = F.col("periods") - 2
    out = fit.withColumns({"slope_per_year": F.col("b") * 12, "fitted_start": at("x0"), "fitted_end": at("x1")}).withColumn("change", F.col("fitted_end") - F.col("fitted_start"))
    t = F.when(F.col("r2") < 1, F.sqrt(F.col("r2") * df / (1 - F.col("r2"))))
    out = benjamini_hochberg(out.withColumn("p_value", F.when(df >= 1, F.when(F.col("r2") >= 1, num(0)).otherwise(student_t_p(t, df)))))
    sure = (F.col("p_adjusted") < alpha) & (F.abs("change") >= materiality)
    return out.withColumns({"signal": F.when(sure & (F.col("change") > 0), "improving").when(sure, "deteriorating").otherwise("no_material_trend"), "capped": (F.col("a") + F.col("b") * F.col("x1") > 100) | (F.col("a") + F.col("b") * F.col("x1") < 0)}).drop("a", "b", "x0", "x1")


def period_alerts(legs: DataFrame, key: str, top: int = 10, materiality: float = 3.0, alpha: float = 0.05) -> DataFrame:
    """The busiest keys' periods against their own other periods."""
    own = legs.where(F.col(ARRIVAL).isNotNull())
    busy = top_rows(own.groupBy(key).count(), [F.desc("count"), F.asc(key)], top).select(key)
    cells = own.join(F.broadcast(busy), key, "left_semi").groupBy(key, "period").agg(F.count("*").alias("flights"), F.count_if(F.col(ARRIVAL) <= 15).alias("otp15_count"))
    w = Window.partitionBy(key)
    s, n = F.sum("otp15_count").over(w) - F.col("otp15_count"), F.sum("flights").over(w) - F.col("flights")
    cells = cells.withColumns({"_s": s, "_n": n})
    z = two_proportion_z(F.col("otp15_count"), F.col("flights"), F.col("_s"), F.col("_n"))
    out = cells.withColumns({"rate_pct": percent(F.col("otp15_count"), F.col("flights")), "other_pct": percent(F.col("_s"), F.col("_n")), "p_value": two_sided_p(z)}).withColumn("difference", F.col("rate_pct") - F.col("other_pct")).drop("_s", "_n")
    out = benjamini_hochberg(out)
    status = F.when(F.abs("difference") <= materiality, "green_within_3pp").when(F.coalesce(F.col("p_adjusted") >= alpha, F.lit(True)), "amber_not_significant").when(F.col("difference") < 0, "red_worse").otherwise("blue_better")
    return out.withColumn("status", status)


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson and Spearman of every pair over rows that have both, with p values; constant and short pairs are left out.

    Pearson is Spark's: centred moments of each task, merged pairwise, so large
    offsets cost no digits.  Ranks have the mean (n + 1) / 2 and are centred by
    it; equal pairs are counted once.
    """
    out = None
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            own = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
            direct = own.agg(F.count("*").alias("rows"), F.corr("a", "b").alias("pearson"))
            pairs = own.groupBy("a", "b").agg(F.count("*").alias("w"))
            ra, rb = (value_ranks(own, c).select(F.col(c).alias(f"_{c}"), (F.col("rank") - (F.col("total") + 1) / 2.0).alias(f"r{c}")) for c in ("a", "b"))
            ranked = pairs.join(ra, F.col("a") == F.col("_a")).join(rb, F.col("b") == F.col("_b"))
            x, y, w = F.col("ra"), F.col("rb"), F.col("w")
            spread = ranked.agg(F.sum(w * x * y).alias("xy"), F.sum(w * x * x).alias("xx"), F.sum(w * y * y).alias("yy"))
            rho = F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / (F.sqrt("xx") * F.sqrt("yy")))
            one = direct.join(F.broadcast(spread.select(rho.alias("spearman")))).select(F.lit(a).alias("variable_1"), F.lit(b).alias("variable_2"), "rows", "pearson", "spearman")  # one row each
            out = one if out is None else out.unionByName(one)
    out = out.where((F.col("rows") >= 3) & F.col("pearson").isNotNull() & ~F.isnan("pearson"))
    t = lambda c: F.col(c) * F.sqrt((F.col("rows") - 2) / (1 - F.col(c) * F.col(c)))
    # Student's law; the normal tail where it cannot be told from that
    p = lambda c: F.when(F.abs(c) >= 1, num(0)).when(F.col("rows") <= 1000, student_t_p(t(c), F.col("rows") - 2)).otherwise(two_sided_p(t(c)))
    return out.withColumns({"pearson_p": p("pearson"), "spearman_p": p("spearman")})


def pearson_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson of every pair of columns, in one pass: ``variable_1``, ``variable_2``, ``r``."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("variable_1"), F.lit(b).alias("variable_2"), F.col(f"{a}|{b}").alias("r")) for a, b in pairs])).alias("c")).select("c.*")


def recovery_signed_rank(legs: DataFrame, least: int = 10) -> DataFrame:
    """Wilcoxon's signed-rank test of recovery among legs that left more than 15 minutes late (normal law, ties corrected)."""
    own = legs.where((F.col(DEPARTURE) > 15) & F.col(ARRIVAL).isNotNull()).select((F.col(DEPARTURE) - F.col(ARRIVAL)).alias("v")).where("v <> 0").withColumn("size", F.round(F.abs("v"), 9))
    ranks = value_ranks(own, "size").select(F.col("size").alias("_s"), "rank", F.col("rows").cast("double").alias("ties"))
    each = own.groupBy("size").agg(F.count_if(F.col("v") > 0).alias("up"), F.count("*").alias("n")).join(ranks, F.col("size") == F.col("_s"))
    one = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(F.col("up") * F.col("rank")).alias("w_plus"), F.sum((F.col("n") - F.col("up")) * F.col("rank")).alias("w_minus"), F.sum(F.col("ties") ** 3 - F.col("ties")).alias("t"))
    n = F.col("n").cast("double")
    se = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("t") / 48)
    w = F.least("w_plus", "w_minus")
    return one.select("n", w.alias("statistic"), F.when(F.col("n") >= least, two_sided_p(ratio(w - n * (n + 1) / 4, se))).alias("p_value"))


def band_kruskal_wallis(legs: DataFrame, band: str = "duration_band", least: int = 10) -> DataFrame:
    """Kruskal-Wallis of arrival delay over the four duration bands with enough legs, and epsilon squared."""
    own = legs.where(F.col(ARRIVAL).isNotNull() & F.col(band).isNotNull())
    big = own.groupBy(band).count().where(F.col("count") >= least).select(band)
    own = own.join(F.broadcast(big), band, "left_semi")
    ranks = value_ranks(own, ARRIVAL).select(F.col(ARRIVAL).alias("_v"), "rank", F.col("rows").cast("double").alias("ties"))
    each = own.groupBy(band, ARRIVAL).agg(F.count("*").alias("n")).join(ranks, F.col(ARRIVAL) == F.col("_v"))
    groups = each.groupBy(band).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("r"))
    h = groups.agg(F.count("*").alias("groups"), F.sum("n").cast("double").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("rr"))
    ties = ranks.agg(F.sum(F.col("ties") ** 3 - F.col("ties")).alias("t"))
    n = F.col("n")
    out = h.join(F.broadcast(ties)).withColumn("statistic", ratio(12 / (n * (n + 1)) * F.col("rr") - 3 * (n + 1), 1 - F.col("t") / (n**3 - n)))
    p = F.when(F.col("groups") == 4, chi2_p(F.col("statistic"), 3)).when(F.col("groups") == 3, chi2_p(F.col("statistic"), 2)).when(F.col("groups") == 2, chi2_p(F.col("statistic"), 1))
    return out.select("groups", n.cast("long").alias("n"), "statistic", p.alias("p_value"), ratio(F.col("statistic") - F.col("groups") + 1, n - F.col("groups")).alias("epsilon_squared"))


def compare_periods(legs: DataFrame, first: str, second: str) -> DataFrame:
    """On-time rates of two periods: both rates, difference in points (second less first), z, p."""
    a = F.col(ARRIVAL)
    one = legs.where(a.isNotNull()).agg(*[c for k, p in (("1", first), ("2", second)) for c in (F.count_if(F.col("period") == p).alias(f"n{k}"), F.count_if((F.col("period") == p) & (a <= 15)).alias(f"s{k}"))])
    z = two_proportion_z(F.col("s2"), F.col("n2"), F.col("s1"), F.col("n1"))
    return one.select("n1", "n2", percent(F.col("s1"), F.col("n1")).alias("first_pct"), percent(F.col("s2"), F.col("n2")).alias("second_pct"), z.alias("z"), two_sided_p(z).alias("p_value")).withColumn("difference", F.col("second_pct") - F.col("first_pct"))


# The questions that the statistics answer.
HYPOTHESES = (
    ("H01", "on-time performance is the same in two Decembers", "two-proportion z"), ("H02", "routes do not differ from the network", "two-proportion z, false discovery control"),
    ("H03", "operators do not differ from the network", "two-proportion z, false discovery control"), ("H04", "airports do not differ from the network", "two-proportion z, false discovery control"),
    ("H05", "weekdays do not differ", "two-proportion z, false discovery control"), ("H06", "there is no trend over periods", "linear regression"),
    ("H07", "delay does not depend on duration", "Kruskal-Wallis"), ("H08", "late departures recover nothing", "Wilcoxon signed rank"),
    ("H09", "delays do not go with duration or buffer", "Pearson and Spearman"), ("H10", "operators do not differ at equal routes", "adjusted logistic comparison (not carried out)"),
)


def hypothesis_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(HYPOTHESES), "id string, null_hypothesis string, method string")


def trend_extremes(trends: DataFrame, key: str, volume: str, pool: int = 50, n: int = 3) -> DataFrame:
    """Among the busiest entities with a material trend, the ``n`` worst and the ``n`` best."""
    own = top_rows(trends, [F.desc(volume), F.asc(key)], pool).where(F.col("signal").isin("improving", "deteriorating"))
    worst = top_rows(own, [F.asc("change"), F.asc(key)], n).withColumn("side", F.lit("worst"))
    return worst.unionByName(top_rows(own, [F.desc("change"), F.asc(key)], n).withColumn("side", F.lit("best")))
