"""Cleaning and derived columns of legs.  Column roles are parameters; nulls follow the rule of each function."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RULES, TIME_FORMAT, Rule
from ..functions.expressions import num


def parse_times(df: DataFrame, columns: Sequence[str], fmt: str = TIME_FORMAT) -> DataFrame:
    """Text columns as timestamps; text that is no time becomes null."""
    return df.withColumns({c: F.try_to_timestamp(F.col(c), F.lit(fmt)) for c in columns})


def minutes_between(end: str | Column, start: str | Column) -> Column:
    """Minutes from ``start`` to ``end`` as double."""
    micros = lambda c: F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))
    return (micros(end) - micros(start)) / num(60_000_000)


def calculate_delays(df: DataFrame, filed_off: str, actual_off: str, filed_arr: str, actual_arr: str, fmt: str | None = None) -> DataFrame:
    """Adds ``departure_delay_min`` and ``arrival_delay_min`` (actual less filed)."""
    df = parse_times(df, (filed_off, actual_off, filed_arr, actual_arr), fmt) if fmt else df
    return df.withColumns({"arrival_delay_min": minutes_between(actual_arr, filed_arr), "departure_delay_min": minutes_between(actual_off, filed_off)})


#: The columns that play the roles of ``config.RULES``.
ROLES = {"delay": ("arrival_delay_min", "departure_delay_min"), "leg_type": ("leg_type",), "level": ("flight_level",), "distance": ("distance",)}


def _holds(df: DataFrame, column: str, rule: Rule) -> Column:
    """Whether a row meets a rule; a missing column passes."""
    if column not in df.columns:
        return F.lit(True)
    x, tests = F.col(column), []
    if rule.equal is not None:
        tests.append(x == rule.equal)
    if rule.low is not None:
        tests.append(x > rule.low if rule.strict else x >= rule.low)
    if rule.high is not None:
        tests.append(x <= rule.high)
    return F.coalesce(reduce(lambda p, q: p & q, tests), F.lit(rule.nulls))


def quality_rules(df: DataFrame, rules: Sequence[Rule] = RULES, **columns: Sequence[str]) -> dict[str, Column]:
    """Each rule by name, for the columns in its role (``ROLES``, changed by ``columns``)."""
    named = {"leg_type": "regular", "level": "level", "distance": "distance"}
    out = {}
    for rule in rules:
        for c in (ROLES | columns).get(rule.role, ()):
            out[f"{c}_min" if rule.role == "delay" else named.get(rule.role, c)] = _holds(df, c, rule)
    return out


def apply_quality_rules(df: DataFrame, rules: Sequence[Rule] = RULES, **columns: Sequence[str]) -> DataFrame:
    """Only the rows that meet every rule."""
    for rule in quality_rules(df, rules, **columns).values():
        df = df.where(rule)
    return df


def rule_impact(df: DataFrame, rules: Sequence[Rule] = RULES, scope: Column | None = None, **columns: Sequence[str]) -> DataFrame:
    """One row: raw, in scope, excluded, failures of each rule, kept, percentage removed; one pass."""
    tests = quality_rules(df, rules, **columns)
    inside = F.lit(True) if scope is None else F.coalesce(scope, F.lit(False))
    every = inside
    for test in tests.values():
        every = every & test
    out = df.agg(F.count("*").alias("raw_rows"), F.count_if(inside).alias("in_scope_rows"), *[F.count_if(inside & ~test).alias(f"fail_{name}") for name, test in tests.items()], F.count_if(every).alias("kept_rows"))
    return out.withColumn("excluded_rows", F.col("raw_rows") - F.col("in_scope_rows")).withColumn("removed_pct", F.try_divide(100.0 * (F.col("in_scope_rows") - F.col("kept_rows")), F.col("in_scope_rows")))


# Texts that stand for a missing value.
SENTINELS = ("?", "NA", "NULL", "null", "nan", "None")


def normalise_text(df: DataFrame, columns: Sequence[str], sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """Trimmed text; blanks and sentinels become null."""
    trimmed = lambda c: F.trim(F.col(c))
    return df.withColumns({c: F.when((trimmed(c) != "") & ~trimmed(c).isin(*sentinels), trimmed(c)) for c in columns})


def fill_text(df: DataFrame, columns: Sequence[str], value: str = "Unknown") -> DataFrame:
    return df.fillna(value, list(columns))


def calendar_columns(df: DataFrame, time: str) -> DataFrame:
    """``period`` (yyyy-MM), ``departure_date``, ``departure_hour``, ``weekday`` and its order (Monday 0)."""
    t = F.col(time)
    names = F.array(*map(F.lit, ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")))
    return df.withColumns({"period": F.date_format(t, "yyyy-MM"), "departure_date": F.to_date(t), "departure_hour": F.hour(t), "weekday_order": F.weekday(t), "weekday": F.element_at(names, F.weekday(t) + 1)})


def duration_columns(df: DataFrame, filed_off: str, actual_off: str, filed_arr: str, actual_arr: str) -> DataFrame:
    """Scheduled and actual duration, buffer (scheduled less actual) and recovery (departure less arrival delay)."""
    df = df.withColumns({"scheduled_duration_min": minutes_between(filed_arr, filed_off), "actual_duration_min": minutes_between(actual_arr, actual_off)})
    return df.withColumns({"schedule_buffer_min": F.col("scheduled_duration_min") - F.col("actual_duration_min"), "recovery_min": F.col("departure_delay_min") - F.col("arrival_delay_min")})


def route_columns(df: DataFrame, origin: str = "origin", destination: str = "destination") -> DataFrame:
    """``route`` (directional) and ``airport_pair`` (unordered)."""
    a, b = F.col(origin).cast("string"), F.col(destination).cast("string")
    return df.withColumns({"route": F.concat_ws(" → ", a, b), "airport_pair": F.concat_ws(" ↔ ", F.least(a, b), F.greatest(a, b))})


def duration_band(duration: Column, positive_only: bool = False) -> Column:
    """0-90, 90-180, 180-360 and over 360 minutes, upper ends included; negatives (and 0, if so asked) are null."""
    low = duration > 0 if positive_only else duration >= 0
    return F.when(low & (duration <= 90), "0-90").when((duration > 90) & (duration <= 180), "90-180").when((duration > 180) & (duration <= 360), "180-360").when(duration > 360, ">360")


def flag_columns(df: DataFrame, arrival: str = "arrival_delay_min", departure: str = "departure_delay_min", thresholds: Sequence[int] = (15, 30, 60), on_time: float = 15.0) -> DataFrame:
    """0/1 flags; a null delay gives 0 everywhere, in ``arrival_otp15`` too."""
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    a, d = F.col(arrival), F.col(departure)
    out = {f"arrival_delayed_{t}": flag(a > t) for t in thresholds} | {f"departure_delayed_{t}": flag(d > t) for t in thresholds}
    return df.withColumns(out | {"arrival_otp15": flag(a <= on_time), "departure_otp15": flag(d <= on_time), "recovered_to_otp15": flag((d > on_time) & (a <= on_time)), "worsened_after_departure": flag(a > d)})


def prepare_legs(df: DataFrame, rules: Sequence[Rule], reporting_end: str | None, time: str, origin: str = "origin", destination: str = "destination") -> DataFrame:
    """Scope, reporting boundary, labels, calendar, bands and flags of legs that have delays already."""
    df = apply_quality_rules(df, rules)
    df = df.where(F.col(time) < F.lit(reporting_end).cast("timestamp")) if reporting_end else df
    df = flag_columns(calendar_columns(route_columns(df, origin, destination), time))
    return df.withColumns({"duration_band": duration_band(F.col("scheduled_duration_min")), "recovery_min": F.col("departure_delay_min") - F.col("arrival_delay_min")})


# Overlapping scopes by scheduled duration in minutes.
SCOPES = (("all", None, None), ("under_3h", 0, 180), ("3h_or_more", 180, None))


def scope_band(duration: str | Column = "scheduled_duration_min") -> Column:
    """The one scope besides ``all`` that a leg is in; null if its duration is unknown or not positive."""
    d = F.col(duration) if isinstance(duration, str) else duration
    return F.when((d > 0) & (d < 180), F.lit("under_3h")).when(d >= 180, F.lit("3h_or_more"))


def scopes_of(band: str) -> Column:
    """The scopes of a leg in a band, as an array."""
    return F.array_compact(F.array(F.lit("all"), F.col(band)))


def explode_scopes(df: DataFrame, duration: str = "scheduled_duration_min") -> DataFrame:
    """A row for each scope that a leg is in; a leg may be in several."""
    return df.withColumn("_band", scope_band(duration)).withColumn("scope", F.explode(scopes_of("_band"))).drop("_band")


def available_features(df: DataFrame, allowed: Sequence[str], derived: Sequence[str] = ()) -> DataFrame:
    """Only the columns known at the horizon, in their order."""
    return df.select([c for c in (*allowed, *derived) if c in df.columns])


def forbid_columns(df: DataFrame, forbidden: Sequence[str]) -> DataFrame:
    """Raises if a column that would leak is there."""
    if found := sorted(set(forbidden) & set(df.columns)):
        raise ValueError(f"columns not allowed here: {found}")
    return df


def same_schema(*frames: DataFrame) -> None:
    if any(f.schema.simpleString() != frames[0].schema.simpleString() for f in frames):
        raise ValueError("the schemas differ")


def prediction_cutoff(df: DataFrame, time: str, minutes: int = 60, name: str = "cutoff") -> DataFrame:
    if minutes <= 0:
        raise ValueError("the lead must be positive")
    return df.withColumn(name, F.col(time) - F.expr(f"interval {int(minutes)} minutes"))


def schedule_features(df: DataFrame, time: str, duration: str, direction: str | None = None, compact: bool = False) -> DataFrame:
    """Cyclic hour and weekday, month, haul.  ``compact``: whole hours, Sunday 0, and only durations within a day."""
    t, d = F.col(time), F.col(duration)
    hour = F.hour(t).cast("double") if compact else F.hour(t) + F.minute(t) / num(60)
    day = (F.dayofweek(t) - 1 if compact else F.weekday(t)).cast("double")
    turn = num(2 * 3.141592653589793)
    out = {"hour_sin": F.sin(turn * hour / 24), "hour_cos": F.cos(turn * hour / 24), "dow_sin": F.sin(turn * day / 7), "dow_cos": F.cos(turn * day / 7), "month": F.month(t)}
    out["duration"] = F.when((d > 0) & (d <= 1440), d) if compact else d
    out["haul"] = F.when(d > 360, "long").when(d.isNotNull(), "short_medium")
    if direction:
        out["haul_direction"] = F.concat_ws("_", out["haul"], F.col(direction))
    return df.withColumns(out)


def direction_columns(df: DataFrame, origin_continent: str, destination_continent: str, home: str = "EU", away: str = "NA") -> DataFrame:
    """``transatlantic`` and a ``direction`` label from two continents."""
    a, b = F.col(origin_continent), F.col(destination_continent)
    return df.withColumns({"transatlantic": F.coalesce(((a == home) & (b == away)) | ((a == away) & (b == home)), F.lit(False)), "direction": F.when((a == home) & (b == home), "within").when((a == home) & (b == away), "out").when((a == away) & (b == home), "in").otherwise("other")})


def yeo_johnson(x: Column, lam: float) -> Column:
    """The Yeo-Johnson transform for a given lambda."""
    up = F.log1p(x) if lam == 0 else (F.pow(x + 1, num(lam)) - 1) / num(lam)
    down = -F.log1p(-x) if lam == 2 else -(F.pow(1 - x, num(2 - lam)) - 1) / num(2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def map_family(code: Column, families: dict[str, Sequence[str]], other: str = "other") -> Column:
    """The family whose codes contain ``code``."""
    out = None
    for name, codes in families.items():
        out = (F if out is None else out).when(code.isin(*codes), name)
    return out.otherwise(other)


def severity_band(delay: Column) -> Column:
    return F.when(delay <= -5, "early").when(delay <= 15, "within_15").when(delay <= 60, "moderate").when(delay > 60, "severe")


# Codes that name no operator.
NO_OPERATOR = ("ZZZ", "UNK", "UNKNOWN", "Unknown")


def named_operators(df: DataFrame, operator: str, sentinels: Sequence = NO_OPERATOR) -> DataFrame:
    """Only rows of a known operator; null and sentinel codes go."""
    return df.where(F.coalesce(~F.col(operator).isin(*sentinels), F.lit(False)))


def operator_label(operator: Column, sentinels: Sequence = NO_OPERATOR, label: str = "Unknown operator") -> Column:
    """The operator as a label; null and sentinel codes share one."""
    return F.when(operator.isNull() | operator.isin(*sentinels), F.lit(label)).otherwise(operator.cast("string"))


def hour_bucket(minutes: Column, most: int = 12) -> Column:
    return F.least(F.floor(minutes / 60), F.lit(most)).cast("int")


def grid_cell(latitude: Column, longitude: Column, degrees: float = 5.0) -> tuple[Column, Column]:
    """South-west corner of the cell that holds a place."""
    return F.floor(latitude / degrees) * degrees, F.floor(longitude / degrees) * degrees


def split_coordinates(text: Column) -> tuple[Column, Column]:
    """Latitude and longitude from a text ``"lon, lat"``; null where it is none."""
    part = lambda k: F.trim(F.try_element_at(F.split(text, ","), F.lit(k))).try_cast("double")
    return part(2), part(1)


def strength_label(rho: Column) -> Column:
    size = F.abs(rho)
    return F.when(size < 0.1, "very weak").when(size < 0.3, "weak").when(size < 0.5, "moderate").when(size < 0.7, "strong").when(size >= 0.7, "very strong")


def coerce_types(df: DataFrame, times: Sequence[str] = (), categories: Sequence[str] = (), fmt: str = TIME_FORMAT) -> DataFrame:
    """Casts chosen by a column profile: times parsed, categories as text."""
    return parse_times(df, times, fmt).withColumns({c: F.col(c).cast("string") for c in categories})
