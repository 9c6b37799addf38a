"""Punctuality statistics of legs: grouped reliability, profiles, severity, concentration, rankings.

A leg is on time up to 15 minutes; "late N" means strictly more than N.
Percentiles are exact and interpolated, selected from counted values (``tally``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import ReliabilityConfig
from ..functions.expressions import num, percent, ratio, wilson
from .clean import duration_band, explode_scopes, grid_cell, hour_bucket, scope_band, scopes_of, severity_band
from .enrich import role_union
from .ranking import top_rows, value_ranks
from .tally import Tally, counted_quantile, gathered, ranked, ranked_quantile, running_totals

CONFIG = ReliabilityConfig()
ARRIVAL, DEPARTURE, DURATION = "arrival_delay_min", "departure_delay_min", "scheduled_duration_min"


def late_share(limit: float, delay: str = ARRIVAL) -> Column:
    """Percentage later than ``limit`` among all rows of the group."""
    return percent(F.count_if(F.col(delay) > limit), F.count("*"))


def wilson_pct(successes: Column, n: Column, upper: bool = False, z: float = CONFIG.z) -> Column:
    return 100 * wilson(successes, n, z, upper)


def overall_kpis(legs: DataFrame, operator: str = "operator", origin: str = "origin", destination: str = "destination", config: ReliabilityConfig = CONFIG) -> DataFrame:
    """The network in one row."""
    a, d, value = F.col(ARRIVAL), F.col(DEPARTURE), F.col("value")
    slow = (d > 15) & a.isNotNull()
    code = lambda *c: F.when(F.coalesce(*[F.col(x) for x in c]).isNotNull(), F.to_json(F.struct(*c)))
    pair = F.when(F.col(origin).isNotNull() & F.col(destination).isNotNull(), code(origin, destination))
    t = Tally(legs, [], {"row": num(0), "arrival": a, "departure": d, "duration": F.col(DURATION), "recovery": d - a}, {"routes": pair, "operators": F.col(operator), "origins": F.col(origin), "destinations": F.col(destination), "periods": F.col("period")}, {"slow": slow, "recovered": slow & (a <= 15)})
    seen = t.rows("arrival")
    return t.agg(
        {"flights": t.rows("row"), **{c: t.differing(c) for c in ("routes", "operators", "origins", "destinations", "periods")}, "arrival_observed": seen, "otp15_pct": percent(t.rows("arrival", value <= 15), seen)}
        | {"arrival_median": t.quantile("arrival", 0.5), "arrival_p90": t.quantile("arrival", 0.9), "arrival_p95": t.quantile("arrival", 0.95), "departure_median": t.quantile("departure", 0.5), "duration_median": t.quantile("duration", 0.5), "recovery_median": t.quantile("recovery", 0.5)}
        | {"recovered_pct": percent(t.marked("recovered"), t.marked("slow"))}
        | {f"late_{m}_pct": percent(t.rows("arrival", value > m), seen) for m in config.delay_thresholds}
    )


def grouped_performance(legs: DataFrame, keys: Sequence[str], config: ReliabilityConfig = CONFIG, many: bool = False) -> DataFrame:
    """Volume, reliability, severity and recovery for each group of legs with an arrival delay; null keys are a group.

    ``many`` groups, with few legs each, are gathered before legs are counted.
    """
    own = legs.where(F.col(ARRIVAL).isNotNull())
    return _performance(gathered(own, keys) if many else own, keys, config, many)


def _performance(legs: DataFrame, keys: Sequence[str], config: ReliabilityConfig, together: bool, distinct: dict | None = None, more=lambda t: {}) -> DataFrame:
    """The columns of ``grouped_performance``; ``distinct`` columns count over legs without a delay too, ``more`` makes columns of them."""
    a, d, value = F.col(ARRIVAL), F.col(DEPARTURE), F.col("value")
    seen = lambda c: F.when(a.isNotNull(), F.col(c))
    t = Tally(legs, keys, {"arrival": a, "departure": seen(DEPARTURE), "recovery": d - a, "duration": seen(DURATION)}, {"periods": seen("period"), "days": seen("departure_date"), **(distinct or {})}, {"recovered": (d > 15) & (a <= 15)}, together)
    out = t.agg(
        {"flights": t.rows("arrival"), "periods_active": t.differing("periods"), "active_days": t.differing("days"), "otp15_count": t.rows("arrival", value <= config.on_time_minutes), "arrival_mean": t.mean("arrival")}
        | {"arrival_median": t.quantile("arrival", 0.5), "arrival_p90": t.quantile("arrival", 0.9), "arrival_p95": t.quantile("arrival", 0.95), "departure_median": t.quantile("departure", 0.5), "recovery_median": t.quantile("recovery", 0.5), "duration_median": t.quantile("duration", 0.5)}
        | {"departed_late_15": t.rows("departure", value > 15), "recovered_count": t.marked("recovered"), "worsened_count": t.rows("recovery", value < 0)}
        | {f"late_{m}_count": t.rows("arrival", value > m) for m in config.delay_thresholds}
        | more(t)
    ).where("flights > 0")
    n = F.col("flights")
    rates = {"otp15_pct": percent(F.col("otp15_count"), n), "worsened_pct": percent(F.col("worsened_count"), n), "recovered_pct": percent(F.col("recovered_count"), F.col("departed_late_15")), "otp15_low_pct": wilson_pct(F.col("otp15_count"), n, z=config.z), "otp15_high_pct": wilson_pct(F.col("otp15_count"), n, True, config.z)}
    return out.withColumns(rates | {f"late_{m}_pct": percent(F.col(f"late_{m}_count"), n) for m in config.delay_thresholds})


def route_performance(legs: DataFrame, origin: str = "origin", destination: str = "destination") -> DataFrame:
    return grouped_performance(legs, [origin, destination])


def operator_performance(legs: DataFrame, operator: str = "operator", origin: str = "origin", destination: str = "destination") -> DataFrame:
    """``grouped_performance`` by operator with breadth and route concentration over all of its legs, from one pass over them."""
    breadth = {"routes": F.to_json(F.struct(F.col(origin).alias("o"), F.col(destination).alias("d"))), "airports": [F.col(origin).cast("string"), F.col(destination).cast("string")]}
    more = lambda t: {"routes": t.differing("routes"), "route_hhi": t.concentration("routes"), "airports": t.differing("airports")}
    return _performance(gathered(legs, [operator]), [operator], CONFIG, True, breadth, more)


def operator_breadth(legs: DataFrame, operator: str = "operator", origin: str = "origin", destination: str = "destination") -> DataFrame:
    """The columns of ``operator_performance`` that need no quantile, from counts by operator and route alone: no row is taken apart into measures."""
    a, n = F.col(ARRIVAL), F.col("n").cast("double")
    counted = legs.groupBy(operator, origin, destination).agg(F.count("*").alias("n"), F.count(a).alias("seen"), F.count_if(a <= CONFIG.on_time_minutes).alias("early"))
    places = F.array_union(*[F.collect_set(F.col(c).cast("string")) for c in (origin, destination)])
    out = counted.groupBy(operator).agg(F.sum("seen").alias("flights"), F.sum("early").alias("otp15_count"), F.count("*").alias("routes"), F.size(places).cast("long").alias("airports"), (F.sum(n * n) / (F.sum(n) * F.sum(n))).alias("route_hhi"))
    return out.where("flights > 0").withColumn("otp15_pct", percent(F.col("otp15_count"), F.col("flights")))


def airport_performance(legs: DataFrame, role: str, origin: str = "origin", destination: str = "destination") -> DataFrame:
    if role not in ("origin", "destination"):
        raise ValueError("role must be 'origin' or 'destination'")
    key = origin if role == "origin" else destination
    return grouped_performance(legs, [key]).withColumnRenamed(key, "airport").withColumn("role", F.lit(role))


def route_volume(legs: DataFrame, origin: str = "origin", destination: str = "destination") -> DataFrame:
    return legs.groupBy(origin, destination).agg(F.count("*").alias("flights"), F.count_distinct("period").alias("periods_active"))


def on_time_by(legs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Legs with a delay, on-time count and rate with its interval; for weekday, hour, or both."""
    out = legs.where(F.col(ARRIVAL).isNotNull()).groupBy(*keys).agg(F.count("*").alias("flights"), F.count_if(F.col(ARRIVAL) <= 15).alias("otp15_count"), F.avg(ARRIVAL).alias("arrival_mean"))
    n, s = F.col("flights"), F.col("otp15_count")
    return out.withColumns({"otp15_pct": percent(s, n), "otp15_low_pct": wilson_pct(s, n), "otp15_high_pct": wilson_pct(s, n, True)})


def duration_performance(legs: DataFrame, thresholds: Sequence[int] = (15, 30, 60)) -> DataFrame:
    """By duration band (positive durations only): share of legs, late counts and rates."""
    out = legs.where(F.col(ARRIVAL).isNotNull()).withColumn("band", duration_band(F.col(DURATION), True)).where("band is not null").groupBy("band").agg(F.count("*").alias("flights"), *[F.count_if(F.col(ARRIVAL) > t).alias(f"late_{t}_count") for t in thresholds])
    n = F.col("flights")
    out = out.withColumn("share_pct", percent(n, F.sum("flights").over(Window.partitionBy(F.lit(1)))))
    return out.withColumns({f"late_{t}_pct": percent(F.col(f"late_{t}_count"), n) for t in thresholds} | {"late_15_low_pct": wilson_pct(F.col("late_15_count"), n), "late_15_high_pct": wilson_pct(F.col("late_15_count"), n, True)})


def relative_delay(legs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Positive delay relative to scheduled time: ratio of sums, mean ratio, share of legs delayed by more than their duration."""
    late = F.greatest(F.col(ARRIVAL), num(0))
    own = legs.where(F.col(ARRIVAL).isNotNull() & (F.col(DURATION) > 0))
    return own.groupBy(*keys).agg(F.count("*").alias("flights"), F.sum(late).alias("positive_delay_min"), F.sum(DURATION).alias("scheduled_min"), percent(F.sum(late), F.sum(DURATION)).alias("relative_delay_pct"), (100 * F.avg(late / F.col(DURATION))).alias("mean_leg_ratio_pct"), percent(F.count_if(F.col(ARRIVAL) > F.col(DURATION)), F.count("*")).alias("exceeds_duration_pct"))


def threshold_sensitivity(routes: DataFrame, flights: Sequence[int], periods: Sequence[int]) -> DataFrame:
    """For each pair of minimums: eligible routes and the flights they cover; one pass over the routes."""
    grid = routes.sparkSession.createDataFrame([(f, p) for f in flights for p in periods], "minimum_flights long, minimum_periods long")
    ok = (F.col("flights") >= F.col("minimum_flights")) & (F.col("periods_active") >= F.col("minimum_periods"))
    cells = F.explode(F.array(*[F.struct(F.lit(f).cast("long").alias("minimum_flights"), F.lit(p).cast("long").alias("minimum_periods")) for f in flights for p in periods])).alias("c")
    each = routes.select("flights", "periods_active", cells).select("flights", "periods_active", "c.*")
    out = each.groupBy("minimum_flights", "minimum_periods").agg(F.count_if(ok).alias("eligible_routes"), F.coalesce(F.sum(F.when(ok, F.col("flights"))), F.lit(0)).alias("covered_flights"), percent(F.count_if(ok), F.count("*")).alias("route_pct"), percent(F.sum(F.when(ok, F.col("flights")).otherwise(0)), F.sum("flights")).alias("flight_pct"))
    return F.broadcast(grid).join(out, ["minimum_flights", "minimum_periods"], "left")


def entity_periods(legs: DataFrame, entity: str) -> DataFrame:
    """Entity by period, with the months since the first period of all."""
    out = on_time_by(legs, [entity, "period"])
    first = legs.where(F.col(ARRIVAL).isNotNull()).agg(F.min("period").alias("_p"))
    month = lambda c: F.to_date(F.concat(F.col(c), F.lit("-01")))
    return out.join(F.broadcast(first)).withColumn("elapsed_months", F.months_between(month("period"), month("_p")).cast("long")).drop("_p")


def airport_totals(legs: DataFrame, origin: str = "origin", destination: str = "destination") -> DataFrame:
    """Both roles of each airport together; every airport."""
    out = role_union(legs.where(F.col(ARRIVAL).isNotNull()), origin, destination).groupBy("airport").agg(F.count("*").alias("movements"), F.count_if(F.col("role") == "origin").alias("departures"), F.count_if(F.col("role") == "destination").alias("arrivals"), F.count_if(F.col(ARRIVAL) <= 15).alias("otp15_count"), F.avg(ARRIVAL).alias("arrival_mean"))
    return out.withColumns({"delayed": F.col("movements") - F.col("otp15_count"), "otp15_pct": percent(F.col("otp15_count"), F.col("movements")), "otp15_low_pct": wilson_pct(F.col("otp15_count"), F.col("movements")), "otp15_high_pct": wilson_pct(F.col("otp15_count"), F.col("movements"), True)})


def airport_profile(legs: DataFrame, origin: str = "origin", destination: str = "destination", n: int = 200) -> DataFrame:
    """``airport_totals`` of the ``n`` airports with most movements."""
    return top_rows(airport_totals(legs, origin, destination), [F.desc("movements"), F.asc("airport")], n)


def country_rollup(airports: DataFrame, country: str, least_movements: int = 1000) -> DataFrame:
    """Airports summed by country, with shares and whether the country is well represented."""
    out = airports.groupBy(country).agg(F.count("*").alias("airports"), F.sum("movements").alias("movements"), F.sum("otp15_count").alias("otp15_count"))
    every = Window.partitionBy(F.lit(1))
    return out.withColumns({"otp15_pct": percent(F.col("otp15_count"), F.col("movements")), "movement_share_pct": percent(F.col("movements"), F.sum("movements").over(every)), "represented": F.col("movements") >= least_movements})


def grid_hotspots(places: DataFrame, latitude: str, longitude: str, movements: str = "movements", delayed: str = "delayed") -> DataFrame:
    lat, lon = grid_cell(F.col(latitude), F.col(longitude))
    return places.withColumns({"lat_band": lat, "lon_band": lon}).groupBy("lat_band", "lon_band").agg(F.count("*").alias("places"), F.sum(movements).alias("movements"), percent(F.sum(delayed), F.sum(movements)).alias("delayed_pct")).withColumns({"centre_lat": F.col("lat_band") + 2.5, "centre_lon": F.col("lon_band") + 2.5})


def hourly_network(legs: DataFrame, hour: str = "departure_hour", observed_only: bool = True) -> DataFrame:
    """By hour; ``observed_only=False`` counts legs without a delay as late."""
    own = legs.where(F.col(ARRIVAL).isNotNull()) if observed_only else legs
    return own.groupBy(hour).agg(F.count("*").alias("flights"), percent(F.count_if(F.col(ARRIVAL) <= 15), F.count("*")).alias("otp15_pct"), F.avg(ARRIVAL).alias("arrival_mean"))


def airport_hours(legs: DataFrame, airport: str = "origin", date: str = "departure_date", hour: str = "departure_hour") -> DataFrame:
    """Departures and on-time departures of each airport, day and hour."""
    return legs.where(F.col(ARRIVAL).isNotNull()).groupBy(airport, date, hour).agg(F.count("*").alias("departures"), F.count_if(F.col(ARRIVAL) <= 15).alias("otp15_count"), F.sum(ARRIVAL).alias("delay_sum"))


def congestion_bands(cells: DataFrame, airport: str = "origin") -> DataFrame:
    """Cells by the percentile of their load within their airport."""
    ranks = value_ranks(cells, "departures", [airport]).select(F.col(airport).alias("_k"), F.col("departures").alias("_v"), (F.col("rank") / F.col("total")).alias("pct"))
    each = cells.join(ranks, (F.col(airport) == F.col("_k")) & (F.col("departures") == F.col("_v")))
    band = F.when(F.col("pct") <= 0.5, "low").when(F.col("pct") <= 0.75, "medium").when(F.col("pct") <= 0.9, "high").otherwise("peak")
    return each.groupBy(band.alias("band")).agg(F.count("*").alias("cells"), F.sum("departures").alias("flights"), percent(F.sum("otp15_count"), F.sum("departures")).alias("otp15_pct"), ratio(F.sum("delay_sum"), F.sum("departures")).alias("arrival_mean"))


def recurring_peaks(cells: DataFrame, airport: str = "origin", hour: str = "departure_hour", least_days: int = 30, n: int = 30) -> DataFrame:
    out = cells.groupBy(airport, hour).agg(F.count("*").alias("active_days"), F.avg("departures").alias("mean_departures"), F.max("departures").alias("peak_departures")).where(F.col("active_days") >= least_days)
    return top_rows(out, [F.desc("mean_departures"), F.asc(airport), F.asc(hour)], n)


def best_and_worst(df: DataFrame, measure: str, key: str, n: int = 10) -> DataFrame:
    """The ``n`` smallest and ``n`` largest rows, marked in ``side``."""
    low = top_rows(df, [F.asc(measure), F.asc(key)], n).withColumn("side", F.lit("lowest"))
    return low.unionByName(top_rows(df, [F.desc(measure), F.asc(key)], n).withColumn("side", F.lit("highest")))


def family_routes(legs: DataFrame, family: Column, first: str, second: str, keys: Sequence[str], least: int) -> DataFrame:
    """Routes that both families fly often enough, with their rates and the differences."""
    own = legs.where(F.col(ARRIVAL).isNotNull()).withColumn("_f", family)
    out = own.groupBy(*keys).agg(*[c for n, f in (("a", first), ("b", second)) for c in (F.count_if(F.col("_f") == f).alias(f"{n}_flights"), percent(F.count_if((F.col("_f") == f) & (F.col(ARRIVAL) <= 15)), F.count_if(F.col("_f") == f)).alias(f"{n}_otp15_pct"), F.avg(F.when(F.col("_f") == f, F.col(ARRIVAL))).alias(f"{n}_arrival_mean"))])
    return out.where((F.col("a_flights") >= least) & (F.col("b_flights") >= least)).withColumns({"otp15_difference": F.col("a_otp15_pct") - F.col("b_otp15_pct"), "delay_difference": F.col("a_arrival_mean") - F.col("b_arrival_mean")})


def standardised_means(routes: DataFrame) -> DataFrame:
    """Means over shared routes with the smaller family's volume as weight."""
    w = F.least("a_flights", "b_flights")
    return routes.agg(F.count("*").alias("routes"), F.sum(w).alias("weight"), *[ratio(F.sum(w * F.col(c)), F.sum(w)).alias(c) for c in ("a_otp15_pct", "b_otp15_pct", "a_arrival_mean", "b_arrival_mean")])


def grouping_study(legs: DataFrame, keys: Sequence[str], sets: Sequence[Sequence[str]]) -> DataFrame:
    """The same measures for several groupings at once; ``level`` names the grouping.

    Legs are counted once by all keys; each grouping sums these counts.
    """
    a, value = F.col(ARRIVAL), F.col("value")
    kinds = dict(legs.dtypes)
    finest = Tally(legs.where(a.isNotNull()), keys, {"arrival": a})
    levels = F.array(*[F.struct(F.lit(" ".join(s)).alias("level"), *[(F.col(k) if k in s else F.lit(None).cast(kinds[k])).alias(k) for k in keys]) for s in sets])
    t = finest.spread("_level", levels, list(keys))
    out = t.agg({"flights": t.rows("arrival"), "otp15_pct": percent(t.rows("arrival", value <= 15), t.rows("arrival")), "arrival_mean": t.mean("arrival"), "arrival_median": t.quantile("arrival", 0.5)})
    return out.select(*[F.col(f"_level.{k}").alias(k) for k in keys], F.col("_level.level").alias("level"), *[c for c in out.columns if c != "_level"])


def _by_scope(legs: DataFrame, keys: Sequence[str], *measures: str, **more) -> Tally:
    """Legs with an arrival delay counted by keys and band of duration once, then summed by scope."""
    a = F.col(ARRIVAL)
    values = {"arrival": a, "late": F.when(a > 15, a), "duration": F.col(DURATION)}
    own = legs.where(a.isNotNull()).withColumn("_band", scope_band(DURATION))
    return Tally(own, ["_band", *keys], {m: values[m] for m in ("arrival", *measures)}, **more).spread("scope", scopes_of("_band"), ["_band"])


def scope_summary(legs: DataFrame, keys: Sequence[str] = ("scope",)) -> DataFrame:
    """Late shares, interval (z 1.96, percentages), medians and late hours of each scope (or scope and period)."""
    t = _by_scope(legs, [k for k in keys if k != "scope"], "late")
    return t.agg(_severity(t, zero=True))


def _severity(t: Tally, zero: bool = False) -> dict[str, Column]:
    """The columns that scopes and hours of duration have in common."""
    value = F.col("value")
    n, s, early = t.rows("arrival"), t.rows("arrival", value > 15), t.rows("arrival", value > 0)
    out = {"flights": n}
    if zero:
        out |= {"late_0_count": early, "late_0_pct": percent(early, n), "late_15_count": s}
    out |= {"late_15_pct": percent(s, n), "late_15_low_pct": 100 * wilson(s, n, 1.96, clip=False), "late_15_high_pct": 100 * wilson(s, n, 1.96, True, clip=False)}
    if zero:
        out["late_60_pct"] = percent(t.rows("arrival", value > 60), n)
    return out | {"arrival_median": t.quantile("arrival", 0.5), "late_median": t.quantile("late", 0.5), "arrival_p90": t.quantile("arrival", 0.9), "late_hours": t.total("arrival", F.greatest(value, num(0))) / 60}


def severity_distribution(legs: DataFrame) -> DataFrame:
    """Every band of every scope, empty ones included."""
    own = explode_scopes(legs.where(F.col(ARRIVAL).isNotNull()))
    counted = own.groupBy("scope", severity_band(F.col(ARRIVAL)).alias("band")).agg(F.count("*").alias("flights"))
    bands = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.lit(k).alias("band_order")) for k, b in enumerate(("early", "within_15", "moderate", "severe"))])).alias("b")
    grid = own.groupBy("scope").agg(F.count("*").alias("_n")).select("scope", "_n", bands).select("scope", "_n", "b.*")
    return grid.join(counted, ["scope", "band"], "left").select("scope", "band", "band_order", F.coalesce("flights", F.lit(0)).alias("flights"), percent(F.coalesce("flights", F.lit(0)), F.col("_n")).alias("flights_pct"))


def duration_hours(legs: DataFrame) -> DataFrame:
    a = F.col(ARRIVAL)
    own = legs.where(a.isNotNull() & (F.col(DURATION) > 0)).withColumn("hour_order", hour_bucket(F.col(DURATION)))
    t = Tally(own, ["hour_order"], {"arrival": a, "late": F.when(a > 15, a)})
    out = t.agg(_severity(t))
    return out.withColumn("duration_hour", F.when(F.col("hour_order") < 12, F.concat_ws("", F.col("hour_order").cast("string"), F.lit("-"), (F.col("hour_order") + 1).cast("string"), F.lit(" h"))).otherwise("12+ h"))


def _ranked_delay(legs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Positive delays from the largest down, one row for each distinct value: ``above`` rows are larger, of ``total``."""
    own = legs.where(F.col(ARRIVAL).isNotNull()).withColumn("_d", F.greatest(F.col(ARRIVAL), num(0)))
    r = value_ranks(own, "_d", keys)
    return r.select(*keys, "_d", "rows", (F.col("total") - F.col("below") - F.col("rows")).alias("above"), "total")


def _within(limit: Column) -> Column:
    """How many of a value's rows are among the first ``limit``."""
    return F.least(F.col("rows"), F.greatest(limit - F.col("above"), F.lit(0)))


def delay_concentration(legs: DataFrame, keys: Sequence[str], tops: Sequence[int] = (1, 5, 10, 20)) -> DataFrame:
    """Share of all positive delay in the worst legs: the first ceil(n * top / 100), at least one."""
    cells = F.explode(F.array(*map(F.lit, tops))).alias("top_pct")
    each = _ranked_delay(legs, keys).select("*", cells).withColumn("_n", F.greatest(F.ceil(F.col("total") * F.col("top_pct") / 100), F.lit(1)))
    took = _within(F.col("_n"))
    return each.groupBy(*keys, "top_pct").agg(F.max("_n").alias("flights"), (F.sum(took * F.col("_d")) / 60).alias("late_hours"), percent(F.sum(took * F.col("_d")), F.sum(F.col("rows") * F.col("_d"))).alias("share_pct"))


def worst_and_rest(legs: DataFrame, keys: Sequence[str] = (), top: int = 10) -> DataFrame:
    worst = _within(F.ceil(F.col("total") * top / 100))
    out = _ranked_delay(legs, keys).groupBy(*keys).agg(F.sum(worst).alias("worst"), F.sum("rows").alias("n"), F.sum(worst * F.col("_d")).alias("worst_min"), F.sum(F.col("rows") * F.col("_d")).alias("all_min"))
    parts = F.explode(F.array(F.struct(F.lit("worst").alias("segment"), F.col("worst").alias("flights"), F.col("worst_min").alias("m")), F.struct(F.lit("rest").alias("segment"), (F.col("n") - F.col("worst")).alias("flights"), (F.col("all_min") - F.col("worst_min")).alias("m")))).alias("p")
    return out.select(*keys, "all_min", parts).select(*keys, "p.segment", "p.flights", (F.col("p.m") / 60).alias("late_hours"), percent(F.col("p.m"), F.col("all_min")).alias("share_pct"))


def delay_deciles(legs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Positive delay by tenths of the ranking from the worst: row i of n is in tenth floor(10 * i / n) + 1."""
    first = lambda k: F.ceil((k - 1) * F.col("total") / 10)  # noqa: E731  the first row of a tenth
    each = _ranked_delay(legs, keys).select("*", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("decile"))
    took = _within(first(F.col("decile") + 1)) - _within(first(F.col("decile")))
    out = each.groupBy(*keys, "decile").agg(F.sum(took).alias("flights"), (F.sum(took * F.col("_d")) / 60).alias("late_hours"), F.sum(F.col("rows") * F.col("_d")).alias("_all"))
    return out.withColumn("share_pct", percent(F.col("late_hours") * 60, F.col("_all"))).drop("_all")


def route_metrics(legs: DataFrame, origin: str = "origin", destination: str = "destination", config: ReliabilityConfig = CONFIG) -> DataFrame:
    """Routes of each scope with at least two legs, and whether they are frequent enough for rankings."""
    value = F.col("value")
    t = _by_scope(legs.where(F.col(origin).isNotNull() & F.col(destination).isNotNull()), [origin, destination], "duration", distinct={"periods": F.col("period")})
    out = t.agg({"flights": t.rows("arrival"), "periods_active": t.differing("periods"), "late_15_count": t.rows("arrival", value > 15), "arrival_mean": t.mean("arrival"), "positive_delay_min": t.total("arrival", F.greatest(value, num(0))), "duration_median": t.quantile("duration", 0.5), "arrival_median": t.quantile("arrival", 0.5), "arrival_p90": t.quantile("arrival", 0.9)}).where("flights >= 2")
    return out.withColumns({"late_15_pct": percent(F.col("late_15_count"), F.col("flights")), "eligible": (F.col("flights") >= config.min_route_flights) & (F.col("periods_active") >= config.min_route_periods)})


def eligible_routes(legs: DataFrame, origin: str = "origin", destination: str = "destination", config: ReliabilityConfig = CONFIG) -> DataFrame:
    """The routes of each scope that are frequent enough for rankings, from counts of their periods alone."""
    own = legs.where(F.col(ARRIVAL).isNotNull() & F.col(origin).isNotNull() & F.col(destination).isNotNull()).groupBy(scope_band(DURATION).alias("_band"), origin, destination, "period").agg(F.count("*").alias("n"))
    months = own.withColumn("scope", F.explode(scopes_of("_band"))).groupBy("scope", origin, destination, "period").agg(F.sum("n").alias("n"))
    counted = months.groupBy("scope", origin, destination).agg(F.sum("n").alias("flights"), F.count("period").alias("periods_active"))
    return counted.where((F.col("flights") >= config.min_route_flights) & (F.col("periods_active") >= config.min_route_periods)).select("scope", origin, destination)


def route_scope_summary(legs: DataFrame, origin: str = "origin", destination: str = "destination") -> DataFrame:
    pair = F.when(F.col(origin).isNotNull() & F.col(destination).isNotNull(), F.to_json(F.struct(origin, destination)))
    t = _by_scope(legs, [], distinct={"routes": pair})
    return t.agg({"flights": t.rows("arrival"), "routes": t.differing("routes"), "late_15_pct": percent(t.rows("arrival", F.col("value") > 15), t.rows("arrival")), "arrival_median": t.quantile("arrival", 0.5)})


def eligible_breakdown(legs: DataFrame, routes: DataFrame, by: str, origin: str = "origin", destination: str = "destination") -> DataFrame:
    """Eligible routes of each scope by a further key (period or operator); ``routes`` has ``scope``, the route, and ``eligible`` unless all of them are.

    Legs are gathered once by route and key; one sort of them there serves the
    medians of all scopes, so that no leg is held once for each scope.  Routes
    are chosen at the end, so that only finished rows meet them.
    """
    chosen = (routes.where("eligible") if "eligible" in routes.columns else routes).select("scope", origin, destination)
    keys = [origin, destination, by]
    own = gathered(_scoped_delays(legs.dropna(subset=keys), keys), keys)
    parts = {"all": F.lit(True), "under_3h": F.col("_short"), "3h_or_more": ~F.col("_short")}
    late, count = F.col(ARRIVAL) > 15, lambda c: F.count_if(c).cast("long")
    scopes = [F.struct(F.lit(p).alias("scope"), count(c).alias("flights"), count(c & late).alias("late_15_count"), ranked_quantile(ARRIVAL, p, c, 0.5).alias("arrival_median")).alias(p) for p, c in parts.items()]
    return _scope_rows(ranked(own, keys, ARRIVAL, parts).groupBy(*keys).agg(*scopes), keys, list(parts)).join(chosen, ["scope", origin, destination], "left_semi")


def eligible_months(legs: DataFrame, origin: str = "origin", destination: str = "destination", config: ReliabilityConfig = CONFIG) -> DataFrame:
    """``eligible_breakdown`` by period with the routes of ``eligible_routes``, both from one pass over legs.

    Legs are gathered once by route and period and counted there by delay, for
    all scopes together, so that a task holds different delays and not legs.
    Finished rows say which routes are frequent enough.
    """
    keys, parts = [origin, destination, "period"], ["all", "under_3h", "3h_or_more"]
    own = gathered(_scoped_delays(legs.dropna(subset=keys[:2]), keys), keys)
    counted = own.groupBy(*keys, ARRIVAL).agg(F.count("*").alias("all"), F.count_if("_short").alias("under_3h"), F.count_if(~F.col("_short")).alias("3h_or_more"))
    placed = running_totals(counted, ARRIVAL, parts, keys)
    late = F.col(ARRIVAL) > 15
    scopes = [F.struct(F.lit(p).alias("scope"), F.sum(p).alias("flights"), F.coalesce(F.sum(F.when(late, F.col(p))), F.lit(0)).alias("late_15_count"), counted_quantile(ARRIVAL, p, 0.5).alias("arrival_median")).alias(p) for p in parts]
    out = _scope_rows(placed.groupBy(*keys).agg(*scopes), keys, parts)
    route = Window.partitionBy("scope", origin, destination)
    enough = (F.sum("flights").over(route) >= config.min_route_flights) & (F.count("period").over(route) >= config.min_route_periods)
    return out.withColumn("_enough", enough).where("_enough and period is not null").drop("_enough")


def _scoped_delays(legs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys and delay of the legs that have one, and whether they are ``_short`` (null without a band)."""
    return legs.where(F.col(ARRIVAL).isNotNull()).select(*keys, ARRIVAL, (scope_band(DURATION) == "under_3h").alias("_short"))


def _scope_rows(each: DataFrame, keys: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """A row for each scope that has legs, from a struct column for each scope."""
    out = each.select(*keys, F.explode(F.array(*[F.col(f"`{p}`") for p in parts])).alias("c"))
    return out.select("c.scope", *keys, "c.flights", "c.late_15_count", percent(F.col("c.late_15_count"), F.col("c.flights")).alias("late_15_pct"), "c.arrival_median").where("flights > 0")


def plot_frame(routes: DataFrame, key: Sequence[str], config: ReliabilityConfig = CONFIG, n: int = 500, executive: bool = True) -> DataFrame:
    """The ``n`` busiest routes with at least two legs, on demand only those frequent enough for rankings."""
    own = routes.where("flights >= 2")
    if executive:
        own = own.where((F.col("flights") >= config.min_route_flights) & (F.col("periods_active") >= config.min_route_periods))
    return top_rows(own, [F.desc("flights"), *[F.asc(k) for k in key]], n)


def label_candidates(frame: DataFrame, key: Sequence[str], low: str = "otp15_low_pct", high: str = "otp15_high_pct", busiest: int = 4, extremes: int = 3) -> DataFrame:
    """The routes that get a label, each once: the busiest, the surely worst (smallest upper bound of on-time share) and the surely best (largest lower bound)."""
    ties = [F.asc(k) for k in key]
    picks = [top_rows(frame, [order, *ties], m) for order, m in ((F.desc("flights"), busiest), (F.asc(high), extremes), (F.desc(low), extremes))]
    return picks[0].unionByName(picks[1]).unionByName(picks[2]).dropDuplicates(list(key))


def busy_and_relative(legs: DataFrame, n: int = 10, least: int = 100, origin: str = "origin", destination: str = "destination") -> DataFrame:
    """The ``n`` airports with most departures beside the relative delay of legs to them; null where fewer than ``least`` legs arrive."""
    top = top_rows(legs.groupBy(F.col(origin).alias("airport")).agg(F.count("*").alias("movements")), [F.desc("movements"), F.asc("airport")], n)
    rel = relative_delay(legs, [destination]).where(F.col("flights") >= least).select(F.col(destination).alias("airport"), "relative_delay_pct")
    return top.join(rel, "airport", "left")


def worst_routes(routes: DataFrame, keys: Sequence[str], name: str, least: int, located: Sequence[str] = (), rate: str = "late_15_pct") -> DataFrame:
    """For each key the route with the highest rate among those with at least ``least`` flights (and, for a map, known ``located`` columns), and how many these are; ties go to the larger ``name``."""
    own = routes.where(F.col("flights") >= least)
    for c in located:
        own = own.where(F.col(c).isNotNull())
    worst = F.max(F.struct(F.round(F.col(rate) + 1e-9, 9).alias("rate"), F.col(name).alias("name")))
    return own.groupBy(*keys).agg(worst.alias("w"), F.count("*").alias("routes")).select(*keys, F.col("w.name").alias(name), "routes")


def roll_up(routes: DataFrame, key: str, keys: Sequence[str] = ()) -> DataFrame:
    """Route aggregates summed again by airport, operator or period."""
    out = routes.groupBy(*keys, key).agg(F.sum("flights").alias("flights"), F.sum("late_15_count").alias("late_15_count"))
    return out.withColumn("late_15_pct", percent(F.col("late_15_count"), F.col("flights")))


def leaderboard(rolled: DataFrame, key: str, entity: str, least: int = 500, n: int = 3) -> DataFrame:
    """The ``n`` most and least reliable entities with enough flights."""
    if entity not in ("route", "airport", "airline"):
        raise ValueError(f"unknown entity {entity!r}")
    return best_and_worst(rolled.where(F.col("flights") >= least), "late_15_pct", key, n).withColumn("entity", F.lit(entity))


def executive_routes(routes: DataFrame, network_otp15_pct: float, key: Sequence[str], config: ReliabilityConfig = CONFIG) -> DataFrame:
    """``popular_reliable`` and ``least_reliable`` routes among the frequent ones, at most ``top_n`` each."""
    own = routes.where((F.col("flights") >= config.min_route_flights) & (F.col("periods_active") >= config.min_route_periods))
    t = Tally(own, [], {"flights": F.col("flights")})
    cut = t.agg({"_cut": t.quantile("flights", 0.75)})
    ties = [F.asc(k) for k in key]
    good = own.join(F.broadcast(cut)).where((F.col("flights") >= F.col("_cut")) & (F.col("otp15_low_pct") > network_otp15_pct)).drop("_cut")
    good = top_rows(good, [F.desc("otp15_pct"), F.desc("flights"), *ties], config.top_n).withColumn("view", F.lit("popular_reliable"))
    return good.unionByName(top_rows(own, [F.asc("otp15_high_pct"), F.desc("arrival_p90"), *ties], config.top_n).withColumn("view", F.lit("least_reliable")))


def trend_arrays(monthly: DataFrame, keys: Sequence[str], periods: Sequence[str], value: str = "late_15_pct") -> DataFrame:
    """An ordered array of ``value`` over the periods given; null where a period is missing."""
    own = monthly.groupBy(*keys).agg(F.sum("flights").alias("flights"), F.map_from_entries(F.collect_list(F.struct("period", value))).alias("_m"))
    return own.withColumn("trend", F.transform(F.array(*map(F.lit, periods)), lambda p: F.try_element_at("_m", p))).drop("_m")


def delay_histogram(legs: DataFrame, low: float, high: float, bins: int = 80) -> DataFrame:
    """Arrival delays in equal bins; what lies outside goes to bin 0 and ``bins`` + 1."""
    return legs.where(F.col(ARRIVAL).isNotNull()).groupBy(F.width_bucket(F.col(ARRIVAL), num(low), num(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("flights"))


def delay_density(legs: DataFrame, bins: int = 40) -> DataFrame:
    """Departure by arrival delay in square bins between their 1st and 99th percentiles."""
    own = legs.where(F.col(ARRIVAL).isNotNull() & F.col(DEPARTURE).isNotNull())
    t = Tally(own, [], {"a": F.col(ARRIVAL), "d": F.col(DEPARTURE)})
    lim = t.agg({f"{n}{k}": t.quantile(n, q) for n in ("a", "d") for k, q in ((0, 0.01), (1, 0.99))})
    inside = own.join(F.broadcast(lim)).where(F.col(ARRIVAL).between(F.col("a0"), F.col("a1")) & F.col(DEPARTURE).between(F.col("d0"), F.col("d1")) & (F.col("a1") > F.col("a0")) & (F.col("d1") > F.col("d0")))
    cell = lambda c, n: F.least(F.floor((F.col(c) - F.col(f"{n}0")) / (F.col(f"{n}1") - F.col(f"{n}0")) * bins), F.lit(bins - 1))
    return inside.groupBy(cell(DEPARTURE, "d").alias("departure_bin"), cell(ARRIVAL, "a").alias("arrival_bin")).agg(F.count("*").alias("flights"))


def matrix(df: DataFrame, rows: str, columns: str, values: Sequence, measure: Column) -> DataFrame:
    """A pivot with the column values given."""
    return df.groupBy(rows).pivot(columns, list(values)).agg(measure)
