"""Point-in-time features: nothing after a target's cutoff can enter.

A look-back of w hours is cut at the multiples of w: it always reaches over
one such cut, so it is the end of one block and the beginning of the next.
Both are running aggregates inside a block, one backwards and one forwards in
time, merged as count, mean and centred squares.  Nothing is subtracted from
totals over a history, so values keep their digits whatever their offset, and
no task holds more than a block of a key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import num

HOUR = 3_600_000_000


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def rolling_event_features(targets: DataFrame, events: DataFrame, keys: Sequence[str], event_time: str, value: str, prefix: str, id_column: str = "id", cutoff: str = "cutoff", windows: Sequence[int] = (1, 6, 24), late: float = 15.0) -> DataFrame:
    """For each target and window of hours up to its cutoff: count, mean, population deviation, share late, last event time, whether its own event was taken out.

    Both ends of a window count.  A target's own event (same id) is left out
    of its figures.  Ids must be unique in targets and events.  Events and
    targets are shuffled once, by key and block of the longest window; every
    window sorts them within their partitions.
    """
    family = (prefix, list(keys), event_time, value)
    aim = targets.select(*dict.fromkeys([id_column, *keys, cutoff])).dropna(subset=[*keys, cutoff])
    out = rolling_families(targets, events, [family], id_column, cutoff, windows, late, aim)
    return out.select(F.col(id_column).cast("long").alias(id_column), *[c for c in out.columns if c.startswith(f"{prefix}_") and c not in aim.columns])


def rolling_families(targets: DataFrame, events: DataFrame, families: Sequence[tuple[str, list[str], str, str]], id_column: str = "id", cutoff: str = "cutoff", windows: Sequence[int] = (1, 6, 24), late: float = 15.0, onto: DataFrame | None = None) -> DataFrame:
    """The columns of ``rolling_event_features`` for each family (prefix, keys, event time, value), beside those of ``onto`` (the targets).

    A row is there for each target; columns of a family are null where the
    cutoff or one of its keys is.  What all families have seen of a target is
    brought together by one shuffle, own events by another; families that
    read the same columns are worked out once.
    """
    if not families or not all(keys for _, keys, _, _ in families) or not windows or min(windows) <= 0:
        raise ValueError("keys and positive windows are needed")
    read = list(dict.fromkeys((tuple(keys), time, value) for _, keys, time, value in families))
    seen = reduce(DataFrame.unionByName, [_sides(targets, events, keys, time, value, id_column, cutoff, windows, late).withColumn("f", F.lit(f)) for f, (keys, time, value) in enumerate(read)])
    cell = lambda f, w, s, c: F.max(F.when((F.col("f") == f) & (F.col("w") == w) & (F.col("side") == s), F.col(c))).alias(f"_{c}{w}{s}{f}")
    flat = seen.repartition("_id").groupBy("_id").agg(*[cell(f, w, s, c) for f in range(len(read)) for w in windows for s in "fb" for c in "naqlm"])
    own = events.select(F.col(id_column).cast("long").alias("_id"), *[c for f, (keys, time, value) in enumerate(read) for c in (*[F.col(k).alias(f"_k{i}_{f}") for i, k in enumerate(keys)], _micros(time).alias(f"_t{f}"), F.col(value).cast("double").alias(f"_v{f}"))])
    base, kinds = targets if onto is None else onto, dict(targets.dtypes)
    known_key = lambda k: F.col(k).isNotNull() & ~F.isnan(k) if kinds[k] in ("double", "float") else F.col(k).isNotNull()  # noqa: E731  as dropna
    known = base.withColumns({"_id": F.col(id_column).cast("long"), "_c": _micros(cutoff)}).join(own, "_id", "left").join(flat, "_id", "left")
    out = {}
    for prefix, keys, time, value in families:
        f = read.index((tuple(keys), time, value))
        here = reduce(lambda a, b: a & b, map(known_key, keys), F.col("_c").isNotNull())
        out |= {name: F.when(here, c) for name, c in _figures(prefix, f, keys, windows, late).items()}
    return known.select(*base.columns, *[c.alias(name) for name, c in out.items()])


def _sides(targets: DataFrame, events: DataFrame, keys: Sequence[str], event_time: str, value: str, id_column: str, cutoff: str, windows: Sequence[int], late: float) -> DataFrame:
    """For each target, window and side of the window's cut: count, mean, centred squares, late ones and last time of the events there."""
    keys, longest = list(keys), max(windows) * HOUR
    own = events.select(*keys, _micros(event_time).alias("_t"), F.col(value).cast("double").alias("_v")).where("_t is not null and _v is not null").dropna(subset=keys)
    aim = targets.select(F.col(id_column).alias("_id"), *keys, _micros(cutoff).alias("_c")).where("_c is not null").dropna(subset=keys)
    ends = F.explode(F.array(*[F.struct((F.col("_c") - w * HOUR).alias("t"), F.lit(w).alias("w")) for w in windows], F.struct(F.col("_c").alias("t"), F.lit(0).alias("w")))).alias("p")
    probes = aim.select(*keys, F.col("_id").cast("long").alias("_id"), ends).select(*keys, "_id", F.col("p.t").alias("_t"), F.lit(None).cast("double").alias("_v"), F.col("p.w").alias("_w"))
    line = own.select(*keys, F.lit(None).cast("long").alias("_id"), "_t", "_v", F.lit(-1).alias("_w")).unionByName(probes)
    # blocks of all windows that divide the longest lie inside of its blocks
    inside = [w for w in windows if longest % (w * HOUR) == 0]
    lines = {w: line.withColumn("_b", F.floor(F.col("_t") / (longest if w in inside else w * HOUR))).repartition(*keys, "_b") for w in ({max(windows)} | (set(windows) - set(inside)))}
    parts = []
    for w in windows:
        shared = lines[max(windows)] if w in inside else lines[w]
        block = F.floor(F.col("_t") / (w * HOUR))
        for forwards, probe in ((True, 0), (False, w)):  # from the last cut to the cutoff; from the window's start to that cut
            some = shared.where(F.col("_w").isin(-1, probe)).withColumns({"_block": block, "_o": (F.col("_w") >= 0).cast("int")})
            run = Window.partitionBy(*keys, "_b", "_block").orderBy(F.asc("_t") if forwards else F.desc("_t"), "_o").rowsBetween(Window.unboundedPreceding, 0)
            seen = some.select("_id", "_w", F.count("_v").over(run).alias("n"), F.avg("_v").over(run).alias("a"), F.var_pop("_v").over(run).alias("q"), F.count_if(F.col("_v") > late).over(run).alias("l"), F.max(F.when(F.col("_v").isNotNull(), F.col("_t"))).over(run).alias("m"))
            parts.append(seen.where("_w >= 0").select("_id", F.lit(w).alias("w"), F.lit("f" if forwards else "b").alias("side"), "n", "a", (F.col("q") * F.col("n")).alias("q"), "l", "m"))
    return reduce(DataFrame.unionByName, parts)


def _figures(prefix: str, f: int, keys: Sequence[str], windows: Sequence[int], late: float) -> dict[str, Column]:
    """A family's columns from what was seen on both sides and the target's own event."""
    out, t, v = {}, F.col(f"_t{f}"), F.col(f"_v{f}")
    same = [F.col(k) == F.col(f"_k{i}_{f}") for i, k in enumerate(keys)]
    for w in windows:
        inside = v.isNotNull() & (t <= F.col("_c")) & (t >= F.col("_c") - w * HOUR)
        mine = F.coalesce(reduce(lambda a, b: a & b, same, inside), F.lit(False))
        at = lambda c, s: F.col(f"_{c}{w}{s}{f}")  # noqa: B023, E731
        n, mean, squares = _without(mine, v, *_merged(*[F.coalesce(at(c, s), num(0)) for s in "bf" for c in "naq"]))
        late_n = F.coalesce(at("l", "f"), F.lit(0)) + F.coalesce(at("l", "b"), F.lit(0)) - F.when(mine & (v > late), 1).otherwise(0)
        some = n > 0
        out |= {f"{prefix}_{w}h_count": n.cast("long"), f"{prefix}_{w}h_mean": F.when(some, mean), f"{prefix}_{w}h_std": F.when(some, F.sqrt(F.greatest(num(0), squares / n))), f"{prefix}_{w}h_late_rate": F.try_divide(late_n.cast("double"), n), f"{prefix}_{w}h_self_removed": mine.cast("int")}
        out[f"{prefix}_{w}h_max_event_time"] = F.timestamp_micros(F.greatest(at("m", "f"), at("m", "b")))
    return out


def _merged(n1: Column, a1: Column, q1: Column, n2: Column, a2: Column, q2: Column) -> tuple[Column, Column, Column]:
    """Count, mean and centred squares of two parts together."""
    n, d = n1 + n2, a2 - a1
    part = F.coalesce(F.try_divide(n2, n), num(0))
    mean = F.when(n1 == 0, a2).when(n2 == 0, a1).otherwise(a1 + d * part)
    return n, mean, q1 + q2 + F.when((n1 > 0) & (n2 > 0), d * d * n1 * part).otherwise(num(0))


def _without(mine: Column, v: Column, n: Column, mean: Column, squares: Column) -> tuple[Column, Column, Column]:
    """The same without one value, where ``mine`` says so."""
    left = F.try_divide(n * mean - v, n - 1)
    left = F.when(n > 1, mean + F.try_divide(mean - v, n - 1)).otherwise(left)
    return n - mine.cast("int"), F.when(mine, left).otherwise(mean), F.when(mine, F.when(n > 1, squares - (v - mean) * (v - left)).otherwise(num(0))).otherwise(squares)


def rotation_features(targets: DataFrame, history: DataFrame, key: str, event_time: str, arrival: str, departure: str, id_column: str = "id", cutoff: str = "cutoff", unknown: str = "Unknown", fill_missing: bool = False) -> DataFrame:
    """The last completed leg of the same aircraft at the cutoff: its delays, minutes since, their positive sum.

    All values are of one leg.  A target that would meet itself gets nulls;
    unknown aircraft have no history and give no row, unless ``fill_missing``.
    """
    own = history.where(F.col(key).isNotNull() & (F.col(key).cast("string") != unknown)).select(F.col(key), _micros(event_time).alias("_t"), F.lit(0).alias("_o"), F.struct(F.col(id_column).alias("id"), F.col(arrival).alias("a"), F.col(departure).alias("d"), _micros(event_time).alias("t")).alias("leg"), F.lit(None).cast(dict(targets.dtypes)[id_column]).alias("_id")).where("_t is not null")
    aim = targets.where(F.col(key).isNotNull() & (F.col(key).cast("string") != unknown)).select(F.col(key), _micros(cutoff).alias("_t"), F.lit(1).alias("_o"), F.lit(None).cast(own.schema["leg"].dataType).alias("leg"), F.col(id_column).alias("_id"))
    past = Window.partitionBy(key).orderBy("_t", "_o", F.col("leg.id")).rowsBetween(Window.unboundedPreceding, 0)
    met = own.unionByName(aim).withColumn("last", F.last("leg", ignorenulls=True).over(past)).where("_o = 1")
    leg = F.when(F.col("last.id") != F.col("_id"), F.col("last"))
    met = met.withColumn("last", leg)
    out = met.select(F.col("_id").alias(id_column), F.col("last.a").alias("previous_arrival_delay"), F.col("last.d").alias("previous_departure_delay"), ((F.col("_t") - F.col("last.t")) / num(60_000_000)).alias("minutes_since_previous"), F.col("last").isNotNull().cast("int").alias("rotation_history"), (F.greatest(F.col("last.a"), F.lit(0.0)) + F.greatest(F.col("last.d"), F.lit(0.0))).alias("previous_positive_delay"))
    if fill_missing:
        out = targets.select(id_column).join(out, id_column, "left").fillna(0, ["rotation_history"])
    return out


def scheduled_pressure(targets: DataFrame, schedule: DataFrame, id_column: str, origin: str, destination: str, departure: str, arrival: str) -> DataFrame:
    """Distinct movements scheduled in the departure hour at the origin, in the arrival hour at the destination, and their sum."""

    return _with_pressure(targets, schedule, id_column, origin, destination, departure, arrival).select(id_column, "origin_pressure", "destination_pressure", "total_pressure")


def _with_pressure(targets: DataFrame, schedule: DataFrame, id_column: str, origin: str, destination: str, departure: str, arrival: str) -> DataFrame:
    """Targets with the columns of ``scheduled_pressure``; the same place and time are counted once."""
    ends, out = ((origin, departure), (destination, arrival)), targets
    names = {end: f"_n{k}" for k, end in enumerate(dict.fromkeys(ends))}
    for (place, time), name in names.items():
        counts = schedule.groupBy(F.col(place).alias("_p"), F.date_trunc("hour", F.col(time)).alias("_h")).agg(F.count_distinct(id_column).alias(name))
        out = out.withColumn("_hour", F.date_trunc("hour", F.col(time))).join(counts, (F.col(place) == F.col("_p")) & (F.col("_hour") == F.col("_h")), "left").drop("_p", "_h", "_hour")
    there, here = (F.coalesce(F.col(names[end]), F.lit(0)) for end in ends)
    return out.select(*targets.columns, there.alias("origin_pressure"), here.alias("destination_pressure"), (there + here).alias("total_pressure"))


def leakage_audit(features: DataFrame, targets: DataFrame, id_column: str, cutoff: str, prefix: str, windows: Sequence[int] = (1, 6, 24), fail: bool = False) -> DataFrame:
    """One row: targets, events after the cutoff (must be 0), own events taken out.  ``fail`` raises on a violation."""
    joined = features.join(targets.select(id_column, F.col(cutoff).alias("_c")), id_column)
    after = F.lit(False)
    removed = F.lit(0)
    for w in windows:
        after = after | F.coalesce(F.col(f"{prefix}_{w}h_max_event_time") > F.col("_c"), F.lit(False))
        removed = removed + F.col(f"{prefix}_{w}h_self_removed")
    out = joined.agg(F.lit(prefix).alias("block"), F.count("*").alias("rows"), F.count_if(after).alias("violations"), F.coalesce(F.sum(removed), F.lit(0)).alias("self_removed"))
    if fail and (n := out.first()["violations"]):
        raise ValueError(f"{n} targets see events after their cutoff")
    return out


def _family_audit(features: DataFrame, cutoff: str, prefixes: Sequence[str], windows: Sequence[int]) -> DataFrame:
    """``leakage_audit`` of several families beside each other, from one pass."""
    blocks = []
    for k, prefix in enumerate(prefixes):
        after = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"{prefix}_{w}h_max_event_time") > F.col(cutoff), F.lit(False)) for w in windows])
        removed = reduce(lambda a, b: a + b, [F.col(f"{prefix}_{w}h_self_removed") for w in windows])
        blocks.append((prefix, F.count(f"{prefix}_{windows[0]}h_count").alias(f"n{k}"), F.count_if(after).alias(f"a{k}"), F.coalesce(F.sum(removed), F.lit(0)).alias(f"r{k}")))
    total = features.agg(*[c for _, *three in blocks for c in three])
    rows = F.array(*[F.struct(F.lit(prefix).alias("block"), F.col(f"n{k}").alias("rows"), F.col(f"a{k}").alias("violations"), F.col(f"r{k}").alias("self_removed")) for k, (prefix, *_) in enumerate(blocks)])
    return total.select(F.explode(rows).alias("b")).select("b.*")


def recount(targets: DataFrame, events: DataFrame, keys: Sequence[str], event_time: str, value: str, hours: int, id_column: str = "id", cutoff: str = "cutoff") -> DataFrame:
    """``visible``: how many events each target could see in its window, by an interval join and not by running aggregates.

    Events meet targets by key and block of the window's length (a window
    touches two blocks), then by time; an event with the target's id does not
    count.
    """
    size = hours * HOUR
    own = events.select(F.col(id_column).alias("_e"), *keys, _micros(event_time).alias("_t"), F.col(value).alias("_v")).where("_t is not null and _v is not null").drop("_v").withColumn("_b", F.floor(F.col("_t") / size))
    aim = targets.select(F.col(id_column).alias("_id"), *keys, _micros(cutoff).alias("_c"))
    near = F.explode(F.array(F.floor(F.col("_c") / size) - 1, F.floor(F.col("_c") / size))).alias("_b")
    met = aim.select("*", near).join(own, [*keys, "_b"]).where((F.col("_t") <= F.col("_c")) & (F.col("_t") >= F.col("_c") - size) & (F.col("_e") != F.col("_id")))
    counted = met.groupBy("_id").agg(F.count("*").alias("visible"))
    return aim.select("_id").join(counted, "_id", "left").select(F.col("_id").alias(id_column), F.coalesce("visible", F.lit(0)).alias("visible"))


def recount_audit(features: DataFrame, targets: DataFrame, events: DataFrame, keys: Sequence[str], event_time: str, value: str, prefix: str, id_column: str, cutoff: str, windows: Sequence[int]) -> DataFrame:
    """One row for each window: targets, and those whose count is not what an interval join lets them see."""
    out = None
    for w in windows:
        seen = recount(targets, events, keys, event_time, value, w, id_column, cutoff)
        both = seen.join(features.select(id_column, F.coalesce(f"{prefix}_{w}h_count", F.lit(0)).alias("_n")), id_column, "left")
        one = both.agg(F.lit(prefix).alias("block"), F.lit(w).alias("hours"), F.count("*").alias("rows"), F.count_if(F.coalesce(F.col("_n"), F.lit(0)) != F.col("visible")).alias("violations"))
        out = one if out is None else out.unionByName(one)
    return out


def pressure_audit(pressure: DataFrame, targets: DataFrame, schedule: DataFrame, id_column: str, cutoff: str, origin: str, destination: str, departure: str, arrival: str, known: str | None = None) -> DataFrame:
    """One row: targets, and those whose pressure counts a movement that became known (``known``) after the cutoff, or is not the number that the schedule known by then gives.

    Movements are summed by place and hour with the latest time at which one
    became known; without ``known`` a plan counts as known from the start.
    """
    told = _micros(known) if known else F.lit(None).cast("long")
    seen = targets.select(id_column, _micros(cutoff).alias("_c"), origin, destination, departure, arrival)
    for place, time, name in ((origin, departure, "o"), (destination, arrival, "d")):
        hours = schedule.select(F.col(place).alias("_p"), F.date_trunc("hour", F.col(time)).alias("_h"), F.col(id_column).alias("_i"), told.alias("_k"))
        cells = hours.groupBy("_p", "_h").agg(F.count_distinct("_i").alias(f"_n{name}"), F.max("_k").alias(f"_k{name}"))
        seen = seen.withColumn("_hour", F.date_trunc("hour", F.col(time))).join(cells, (F.col(place) == F.col("_p")) & (F.col("_hour") == F.col("_h")), "left").drop("_p", "_h", "_hour")
    both = seen.join(pressure.select(id_column, "origin_pressure", "destination_pressure"), id_column, "left")
    future = F.coalesce(F.greatest("_ko", "_kd") > F.col("_c"), F.lit(False))
    other = (F.coalesce("_no", F.lit(0)) != F.coalesce("origin_pressure", F.lit(0))) | (F.coalesce("_nd", F.lit(0)) != F.coalesce("destination_pressure", F.lit(0)))
    return both.agg(F.lit("pressure").alias("block"), F.count("*").alias("rows"), F.count_if(future | other).alias("violations"), F.lit(0).cast("long").alias("self_removed"))


def standard_features(targets: DataFrame, events: DataFrame, roles: dict[str, str], windows: Sequence[int] = (1, 6, 24)) -> tuple[DataFrame, DataFrame]:
    """Pressure, five rolling families and rotation, side by side by id, and their audit (a row for each block).

    ``roles`` may name ``known_time``, when a movement became known; the audit
    of pressure then finds movements that were counted before that.
    """
    i, cut = roles["id"], roles["cutoff"]
    families = (("origin_departure", [roles["origin"]], roles["departure_time"], roles["departure_delay"]), ("destination_arrival", [roles["destination"]], roles["arrival_time"], roles["arrival_delay"]), ("route_arrival", list(dict.fromkeys([roles["origin"], roles["destination"]])), roles["arrival_time"], roles["arrival_delay"]), ("operator_departure", [roles["operator"]], roles["departure_time"], roles["departure_delay"]), ("operator_arrival", [roles["operator"]], roles["arrival_time"], roles["arrival_delay"]))
    places = [roles[k] for k in ("origin", "destination", "scheduled_departure", "scheduled_arrival")]
    pressed = _with_pressure(targets, events, i, *places)
    audit = pressure_audit(pressed, targets, events, i, cut, *places, roles.get("known_time"))
    out = rolling_families(targets, events, families, i, cut, windows, onto=pressed.select(i, *[c for c in pressed.columns if c != i]))
    audit = audit.unionByName(_family_audit(out, cut, [name for name, *_ in families], windows))
    rotation = rotation_features(targets, events, roles["registration"], roles["arrival_time"], roles["arrival_delay"], roles["departure_delay"], i, cut)
    return out.join(rotation, i, "left"), audit
