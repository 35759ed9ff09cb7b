"""The event table as a packet relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Which event types the initiator sends, and the TCP flag bits that each type stands for.
INITIATOR = ("click", "view", "signup")
FLAGS = {"signup": 0x02, "view": 0x10, "click": 0x18, "purchase": 0x11, "error": 0x04}


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without a time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, us, src, svc, side, bytes, flags, value of every event."""
    flag = F.lit(0)
    for name, bits in FLAGS.items():
        flag = F.when(F.col("event_type") == name, F.lit(bits)).otherwise(flag)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("seq"),
        micros("ts").alias("us"),
        F.col("user_id").alias("src"),
        F.col("event_type").alias("svc"),
        F.when(F.col("event_type").isin(*INITIATOR), "initiator").otherwise("responder").alias("side"),
        F.round(F.col("value") * 100).cast("long").alias("bytes"),
        flag.alias("flags"),
        "value",
    )
