"""Helpers that the training-data operators share: scratch tables, column care, links to components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as every word rule of this subpackage reads it.
SPACE = r"[\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` where it is set.

    Only a local master, where driver and executors are one process, may fall back on a temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-scratch-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: lineage ends here and losing an executor costs nothing."""
    path = f"{scratch_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    read.scratch = path
    return read


#: Spark's bound on the bytes of a batch that goes to Python (64 MB, where none is set), and a lower one for rows of megabytes.
BATCH_BYTES, SMALL_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 23


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run meanwhile send rows to Python in batches of about :data:`SMALL_BATCH` bytes: executor and worker hold a batch, and buffers twice its size, for each core."""
    was = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, str(SMALL_BATCH))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_BYTES) if was is None else spark.conf.set(BATCH_BYTES, was)


def forget(*tables: DataFrame) -> None:
    """Deletes what :func:`stored` wrote, once everything that reads it is stored itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, *stems: str) -> list[str]:
    """Names like ``stems`` that no column of ``df`` has, whatever its case: helper columns never meet those of the user."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in stems:
        while name.lower() in taken:
            name += "_"
        found.append(name)
        taken.add(name.lower())
    return found


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an operator is about to add; an input column of an output's name gives way to it."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text as an array; empty for null, empty and blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst: long); component is the smallest node reachable.

    Alternates the large-star and the small-star step (Kiveris et al., 2014) until nothing changes.  Each round is a
    minimum per node, combined before the shuffle, and an equi-join that adaptive execution can split when one node has
    most links.  Every round is stored, so lineage stays short.  Nothing goes to the driver but two counts.
    """
    now = stored(edges.where("src != dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "cc")
    for _ in range(max_rounds):
        if _settled(now):
            break
        both = now.union(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src != dst").distinct()
        large = stored(large, "cc")
        least = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(least, "src").select(F.when(F.col("dst") == F.col("m"), F.col("src")).otherwise(F.col("dst")).alias("src"), F.col("m").alias("dst"))
        old, now = now, stored(small.union(least.select("src", F.col("m").alias("dst"))).where("src != dst").distinct(), "cc")
        forget(old, large)
    else:
        raise RuntimeError(f"links did not settle within {max_rounds} rounds")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())


def _settled(edges: DataFrame) -> bool:
    """Whether all links (src > dst) are those of stars to their centres: no node has two, and no centre has one of its own."""
    several = edges.groupBy("src").count().where("count > 1").select("src")
    return several.isEmpty() and edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").isEmpty()


#: Bits of a slot bitmap: 16 MB, whatever the input.  Too many keys for it only mean more rows to join, never a wrong row.
SLOT_BITS = 27


def slot_bitmap(keys: DataFrame, bits: int = SLOT_BITS) -> DataFrame:
    """(bucket, bitmap): a bit for each of ``2**bits`` slots that a 64-bit hash in the one column of ``keys`` falls into.

    At most ``2**bits / 32768`` rows of 4 KB, so it may be broadcast.
    """
    slot = F.shiftrightunsigned(F.col(keys.columns[0]), 64 - bits)
    slots = keys.select(slot.alias("slot")).distinct()
    return slots.groupBy(F.floor(F.col("slot") / 32768).alias("bucket")).agg(F.bitmap_construct_agg(F.pmod("slot", F.lit(32768))).alias("bitmap"))


def in_slots(rows: DataFrame, key: Column, bitmap: DataFrame, name: str, bits: int = SLOT_BITS) -> DataFrame:
    """``rows`` plus ``name``: false means that the hash ``key`` is not among those of the bitmap, true that it may be."""
    slot, bucket, held = unused(rows, "__slot", "__bucket", "__bitmap")
    met = rows.withColumn(slot, F.shiftrightunsigned(key, 64 - bits)).join(F.broadcast(bitmap.toDF(bucket, held)), F.floor(F.col(slot) / 32768) == F.col(bucket), "left")
    at = F.pmod(slot, F.lit(32768))
    byte = F.conv(F.hex(F.substring(F.col(held), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.get(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.pmod(F.floor(byte / F.pow(F.lit(2), k)), F.lit(2)) == 1), F.pmod(at, F.lit(8)).cast("int"))
    return met.withColumn(name, F.coalesce(bit, F.lit(False))).drop(slot, bucket, held)


def drop_listed(docs: DataFrame, keys: list[Column], gone: DataFrame) -> DataFrame:
    """``docs`` without rows whose ``keys`` are a row of ``gone`` (stored; columns in that order).  A null key is never listed.

    Only rows whose slot is taken are shuffled to be compared; the others, most of them, stay where they are.
    """
    cols = [F.col(f"`{c}`") for c in docs.columns]
    maybe, *names = unused(docs, "__maybe", *[f"__k{i}" for i in range(len(keys))])
    named = docs.select(*cols, *[k.alias(n) for n, k in zip(names, keys)])
    gone = gone.toDF(*names)
    marked = in_slots(named, F.xxhash64(*names), slot_bitmap(gone.select(F.xxhash64(*names).alias("h"))), maybe)
    return marked.where(~F.col(maybe)).select(*cols).unionByName(marked.where(F.col(maybe)).join(gone, names, "left_anti").select(*cols))


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a stored row number, and that column's name."""
    (row,) = unused(docs, "__row")
    return stored(docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.monotonically_increasing_id().alias(row)), "rows"), row


def keep_first(rows: DataFrame, number: str, members: DataFrame) -> DataFrame:
    """``rows`` (see :func:`numbered`) with one of each component of ``members`` (row, id, component): that with the smallest id, null ids last.

    Rows that are no member stay.  The column ``number`` goes.
    """
    keep = members.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("k")).select(F.col("k.row").alias("row"))
    gone = stored(members.join(keep, "row", "left_anti").select("row"), "extra")
    return drop_listed(rows, [F.col(number)], gone).drop(number)
