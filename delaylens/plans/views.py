"""The given tables as legs, a timeline and predictions, in Spark and in SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as legs between the customer's and the supplier's nation.

    Orders meet their customers, and lines their suppliers and parts, before
    lines meet orders: what is larger is not moved again for what is smaller.
    """
    t = {n: read(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "supplier", "part")}
    ends = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    lines = t["lineitem"].join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey")).join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
    j = lines.join(ends, F.col("l_orderkey") == F.col("o_orderkey"))
    arrival = F.datediff("l_shipdate", "o_orderdate") / F.lit(20.0)
    return j.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"), F.col("c_nationkey").alias("origin"), F.col("s_nationkey").alias("destination"), F.col("l_suppkey").alias("operator"), F.col("p_type").alias("equipment"), F.col("l_returnflag").alias("leg_type"),
        F.col("o_orderdate").cast("timestamp").alias("scheduled_off_block"), F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.to_date("o_orderdate").alias("departure_date"), (F.col("l_linenumber") * 3).alias("departure_hour"), (F.col("l_quantity") * 12).alias("scheduled_duration_min"),
        arrival.alias("arrival_delay_min"), (arrival + (F.round(F.col("l_discount") * 100) - 5) * 2).alias("departure_delay_min"),
    )


LEGS_SQL = """legs as (
  select l_orderkey as order_id, l_linenumber as line_no, c_nationkey as origin, s_nationkey as destination, l_suppkey as operator, p_type as equipment, l_returnflag as leg_type,
    o_orderdate as scheduled_off_block, strftime(o_orderdate, '%Y-%m') as period, cast(o_orderdate as date) as departure_date, l_linenumber * 3 as departure_hour, l_quantity * 12 as scheduled_duration_min,
    date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date)) / 20.0::double as arrival_delay_min,
    date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date)) / 20.0::double + (round(l_discount * 100) - 5) * 2 as departure_delay_min
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey
)"""

SCOPED_SQL = """scoped as (
  select 'all' as scope, * from legs union all select 'under_3h', * from legs where scheduled_duration_min > 0 and scheduled_duration_min < 180 union all select '3h_or_more', * from legs where scheduled_duration_min >= 180
)"""


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as targets and history at once; the cutoff lies an hour before the event."""
    e = read(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    return e.select(F.col("event_id").alias("leg_id"), F.col("user_id").alias("registration"), "event_type", ts.alias("event_time"), (ts - F.expr("interval 60 minutes")).alias("cutoff"), F.col("value").alias("delay_min"))


TIMELINE_SQL = "timeline as (select event_id as leg_id, user_id as registration, event_type, ts as event_time, ts - interval 60 minute as cutoff, value as delay_min from events)"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the mean of their type as prediction and a score free of ranks."""
    t = timeline(spark, sf_dir)
    mean = t.groupBy("event_type").agg(F.avg("delay_min").alias("yhat"))
    return t.join(F.broadcast(mean), "event_type").select("leg_id", "event_type", F.col("delay_min").alias("y"), "yhat", ((F.col("leg_id") % 100) / 100.0).alias("probability"))  # a row for each event type


PREDICTIONS_SQL = TIMELINE_SQL + """, predictions as (
  select leg_id, event_type, delay_min as y, avg(delay_min) over (partition by event_type) as yhat, (leg_id % 100) / 100.0::double as probability from timeline
)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded; what is added first keeps halves and the sign of zero from hanging on the last bit."""
    return df.select(*[F.round(F.col(c) + F.lit(1e-9), digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for what a query has to write: in the session's ``spark.checkpoint.dir``; a local session without one gets a temporary folder, a cluster raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local[") and spark.conf.get("spark.master", "") != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"
