"""Line dedup over content-defined line chunks.

Lines without a word don't count.  A rolling hash over the hashes of successive lines alone decides where a chunk ends, so
boundaries move with their content when lines are put in before; chunks of three lines and more are compared across all documents.
A repeated run may begin and end within a chunk, so it is followed line by line to both its ends: every two neighbouring
lines are compared too, which finds runs of two lines as well.  All in all, each run of two and more lines that occurs again
goes, wherever boundaries fall, and so does a line of its own of over ``passage_words`` words.  First the hashes are compared
(partial counts, then one shuffle of numbers), then the digests of what is found twice, then the bytes of the lines, each distinct
line once.  The first occurrence stays, by document id and place.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slots, let, slot_bitmap, stored, unused, without

#: Repeated hashes up to which a bitmap of them, 16 bits each (32 MB), is broadcast; more are met in a join.
MOST_SLOTS = 1 << 24
WORD = r"[^\x20\x09-\x0D]"


def line_digest(line):
    """MD5 of the line; lines of one digest are compared byte by byte later."""
    return F.md5(line.cast("binary"))


def stretches(keyed: DataFrame, window: int, divisor: int, passage_words: int, with_lines: bool) -> DataFrame:
    """``keyed`` (id, key, text) to a row for each of its stretches: id, key, h, and with lines also first, n (places among all lines, from 0) and lines."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("t")))
    long = lambda x: F.when(F.length(x) > 2 * passage_words, F.regexp_count(x, F.lit(WORD + "+")) > passage_words).otherwise(F.lit(False))
    kept = F.transform(F.filter(lines, lambda x: x["t"].rlike(WORD)), lambda x: F.struct(x["i"], F.xxhash64(x["t"]).alias("h"), long(x["t"]).alias("long"), *([x["t"]] if with_lines else [])))

    def of(f):
        last = F.size(f) - 1
        numbers = F.transform(f, lambda x: F.pmod(x["h"], F.lit(1_000_003)))

        def stretch(h, k, n):
            """The ``n`` lines from the one at ``k`` on."""
            if not with_lines:
                return h
            return F.struct(h.alias("h"), F.get(f, k)["i"].alias("first"), (F.get(f, k + n - 1)["i"] - F.get(f, k)["i"] + 1).alias("n"), F.transform(F.slice(f, k + 1, n), lambda x: x["t"]).alias("lines"))

        def ends(h):
            def stop(k):
                rolled = F.get(h, k)
                for back in range(1, window):
                    rolled = rolled + (31**back) * F.coalesce(F.get(h, k - back), F.lit(0))
                return (F.pmod(rolled, F.lit(divisor)) == 0) | (k == last)

            return F.filter(F.sequence(F.lit(0), last), stop)

        def between(s):
            starts = F.transform(s, lambda e, k: F.struct(F.coalesce(F.get(s, k - 1) + 1, F.lit(0)).alias("k"), e.alias("e")))
            wide = F.filter(starts, lambda c: c["e"] - c["k"] >= 2)
            return F.transform(wide, lambda c: let(c["e"] - c["k"] + 1, lambda n: stretch(F.xxhash64(F.transform(F.slice(f, c["k"] + 1, n), lambda x: x["h"])), c["k"], n)))

        chunks = let(let(numbers, ends), between)
        pairs = F.transform(F.sequence(F.lit(0), last - 1), lambda k: stretch(F.xxhash64(F.get(f, k)["h"], F.get(f, k + 1)["h"]), k, F.lit(2)))
        alone = F.filter(F.transform(f, lambda x, k: F.struct(x["long"].alias("long"), stretch(F.xxhash64(x["h"]), k, F.lit(1)).alias("s"))), lambda c: c["long"])
        one = F.transform(alone, lambda c: c["s"])
        return F.when(F.size(f) > 1, F.concat(chunks, pairs, one)).otherwise(one)

    found = keyed.select("id", "key", F.explode(let(kept, of)).alias("c"))
    return found.select("id", "key", "c.*") if with_lines else found.select("id", "key", F.col("c").alias("h"))


def _among(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """Those of ``rows`` whose h may be one of ``hashes`` (h, stored)."""
    n = hashes.count()
    if n > MOST_SLOTS:
        return rows.join(hashes, "h", "left_semi")
    bits = max(20, math.ceil(math.log2(max(n, 1))) + 4)
    (maybe,) = unused(rows, "maybe")
    return in_slots(rows, F.col("h"), stored(slot_bitmap(hashes, bits), "slots"), maybe, bits).where(maybe).drop(maybe)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2, divisor: int = 4, passage_words: int = 50) -> DataFrame:
    """``docs`` with repeated runs of lines taken out of the text, plus n_lines, n_removed_lines and n_removed_chunks (long).

    A null text stays null and an empty one empty; both have one line, or none, and lose nothing.  Lines without a word don't
    count, as if they weren't there; those within a run that goes go with it.  Within a document, too, only the
    first occurrence stays.  Runs may overlap; a line goes if any run that holds it goes, and at least one occurrence of each
    line with a word stays.  n_removed_chunks counts the stretches of neighbouring lines that go.  Ids that are null come last; rows
    that repeat an id count as one document by its distinct texts, in the order of those texts.  Documents all of whose lines
    go keep an empty text.  Lines and texts of any length are compared whole, at a cost in proportion to their lines, and an
    empty table stays empty.  Input columns named like the counts give way; all others, whatever their names, pass
    through.  A run that a third of all documents share is combined before every grouping; its occurrences meet their first
    one in a join on (hash, digest) that adaptive execution splits.
    """
    docs = without(docs, "n_lines", "n_removed_lines", "n_removed_chunks")
    body = F.col(f"`{text_col}`").cast("string")
    own = [F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.coalesce(body, F.lit(""))).alias("key")]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *own)  # one copy of the text

    def found(with_lines):
        return stretches(docs.select(*own, body.alias("text")), window, divisor, passage_words, with_lines)

    repeated = stored(found(False).groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select("h"), "repeated")
    # Only what has a repeated hash goes on.  The bytes of a chunk's lines are those of its pairs.
    digest = F.unhex(F.sha2(F.array_join(F.transform("lines", line_digest), "").cast("binary"), 256))
    met = _among(found(True), repeated).select("id", "key", "h", "first", "n", digest.alias("sha"), F.when(F.size("lines") < 3, F.col("lines")).alias("lines"))
    suspects = stored(met, "chunks")
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("key").alias("key"), F.col("first").alias("first"))
    firsts = suspects.groupBy("h", "sha").agg(F.min(place).alias("p"), F.count("*").alias("times")).where("times > 1").select("h", "sha", "p")
    # Byte comparison: what holds a line whose digest other bytes have, too, is left alone.  Copies are combined before the shuffle.
    held = suspects.select("h", "sha", F.explode("lines").alias("line")).withColumn("d", line_digest(F.col("line")))
    unlike = stored(held.groupBy("d", "line").agg(F.count("*").alias("times")).groupBy("d").count().where("count > 1").select("d"), "unlike")
    if not unlike.isEmpty():  # such lines may hide in chunks as well, so chunks are left to their pairs
        unequal = held.join(unlike, "d", "left_semi").select("h", "sha").union(suspects.where("lines IS NULL").select("h", "sha")).distinct()
        firsts = firsts.join(stored(unequal, "unequal"), ["h", "sha"], "left_anti")
    gone = suspects.drop("lines").join(firsts, ["h", "sha"]).where(~(F.col("p.id").eqNullSafe(F.col("id")) & (F.col("p.key") == F.col("key")) & (F.col("p.first") == F.col("first"))))
    at = gone.select("id", "key", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("i")).groupBy("id", "key").agg(F.array_sort(F.collect_set("i")).alias("at"))
    starts = F.filter("at", lambda x, k: ~F.coalesce(F.get("at", k - 1) == x - 1, F.lit(False)))
    stops = F.filter("at", lambda x, k: ~F.coalesce(F.get("at", k + 1) == x + 1, F.lit(False)))
    each = at.select("id", "key", F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("first"), (b - a + 1).alias("n"))).alias("gone"))
    removed = stored(each, "removed").toDF("of_id", "of_key", "gone")

    marked = in_slots(keyed, F.xxhash64("id", "key"), stored(slot_bitmap(removed.select(F.xxhash64("of_id", "of_key").alias("h"))), "affected"), "maybe")
    met = marked.where("maybe").join(removed, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key")), "left").drop("of_id", "of_key")
    joined = met.unionByName(marked.where("NOT maybe").withColumn("gone", F.lit(None).cast(met.schema["gone"].dataType)))
    # lines that stay: between the removed stretches, cut by their sorted bounds, so the work grows with the lines
    stay = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size("gone")),
            lambda i: let(F.coalesce(F.get("gone", i - 1)["first"] + F.get("gone", i - 1)["n"], F.lit(0)), lambda a: F.slice("split", a + 1, F.coalesce(F.get("gone", i)["first"], F.size("split")) - a)),
        )
    )
    given = F.col("row").getField(text_col)
    whole = joined.withColumn("split", F.split(given.cast("string"), "\n"))
    cleaned = F.when(F.col("gone").isNull(), given).otherwise(F.array_join(stay, "\n"))
    return whole.select(
        *[cleaned.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns],
        F.when(F.col("split").isNull(), 0).otherwise(F.size("split")).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.aggregate("gone", F.lit(0), lambda s, g: s + g["n"])).cast("long").alias("n_removed_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed_chunks"),
    )
