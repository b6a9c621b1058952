"""Device packets: JSON text with the station, three values and the flags of the device's own checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "id string, t double, p double, rh double, flags int"
FLAGS = {"missing": 1, "range": 2, "step": 4, "stuck": 8, "dew_point": 16, "z_score": 32}


def parse_packets(packets: DataFrame, value: str = "value") -> DataFrame:
    """``packets`` with ``value`` parsed to station, T_raw, P_raw, RH_raw and flags; text that is no packet gives nulls.  Works on streams."""
    read = packets.withColumn("r", F.from_json(F.col(value), SCHEMA))
    rest = [c for c in packets.columns if c != value]
    return read.select(*rest, F.col("r.id").alias("station"), F.col("r.t").alias("T_raw"), F.col("r.p").alias("P_raw"), F.col("r.rh").alias("RH_raw"), F.coalesce("r.flags", F.lit(0)).alias("flags"))


def decode_flags(packets: DataFrame) -> DataFrame:
    """Adds one boolean a flag, and suspicious: any."""
    out = packets.withColumns({f"flag_{k}": F.col("flags").bitwiseAND(b) != 0 for k, b in FLAGS.items()})
    return out.withColumn("suspicious", F.col("flags").bitwiseAND(sum(FLAGS.values())) != 0)
