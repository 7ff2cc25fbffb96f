"""Mixing sources to target weights with a low-discrepancy schedule (operator 4).

DataFrame functions only. Slot i of the schedule is the point frac(i * golden ratio) on the line of
cumulative target shares, which names the slot's source; the k-th slot of a source takes the k-th block
of equally many words of that source's shuffled documents, and goes round again at the end. How many words a
source gives is decided by the points alone; by their low discrepancy that is its target within a few blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, meet, running, written

#: Words of a block: a source gives its target within a few of them.
BLOCK_WORDS = 16
#: Cumulative shares are whole multiples of one part in so many, so their sums are exact in any order.
UNITS = 1 << 46
#: Parts of the line of shares, in which slots look for their source.
PARTS = 1 << 12
REPEATS = 3
#: Slots are ranked in chunks of so many: counts of chunks first, then places inside a chunk.
CHUNK = 1 << 16
#: Fractional part of the golden ratio.
GOLDEN = 0.6180339887498949


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.0, repeats: int = REPEATS) -> DataFrame:
    """source, source_size -> with weight and target.

    Weights run 1, 2, 3, 1, ... over the sources by code point, null last. All words times share are dealt
    out by weight; no target exceeds repeats times its source, and what a source cannot take is dealt out
    again by weight. Sources that fill first have the smallest limit for their weight, so one pass over the
    sources in that order finds how many are full.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    limit = F.col("source_size") * repeats
    rows = sizes.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1).withColumn("_limit", limit)
    order = Window.orderBy(F.col("_limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("_limit").over(before), F.lit(0))
    weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    rows = rows.withColumn("_level", left / weight)
    fits = F.min(F.when(F.col("_limit") >= F.col("_level") * F.col("weight"), F.struct(F.col("_limit") / F.col("weight"), F.col("source").isNull(), "source", "_level"))).over(every)
    level = fits["_level"]
    target = F.when(level.isNull(), F.col("_limit").cast("double")).otherwise(F.least(F.col("_limit").cast("double"), level * F.col("weight")))
    return rows.withColumn("target", target).select("source", "source_size", "weight", "target")


def source_key(source: Column) -> Column:
    """A source's name that is never null."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def schedule(targets: DataFrame, total: int, block: int) -> DataFrame:
    """_key, slot, slot_rank: the source of each slot of a mix of total words, and its number among the source's slots.

    A slot and the sources meet in the part of the line that its point lies in, so no slot looks at all sources.
    """
    spark = targets.sparkSession
    slots = max(1, -(-total // block))
    line = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    units = F.floor(F.col("target") / F.lit(float(max(total, 1))) * F.lit(float(UNITS)))
    shares = targets.where("target > 0").withColumn("_to", F.least(F.lit(1.0), F.sum(units).over(line) / F.lit(float(UNITS))))
    last = F.row_number().over(Window.orderBy(F.col("source").desc_nulls_first())) == 1
    shares = shares.withColumn("_to", F.when(last, 1.0).otherwise(F.col("_to"))).withColumn("_from", F.lag("_to", 1, 0.0).over(Window.orderBy("_to", F.col("source").asc_nulls_last())))
    parts = shares.select(source_key(F.col("source")).alias("_key"), "_from", "_to", F.explode(F.sequence(F.floor(F.col("_from") * PARTS), F.floor(F.col("_to") * PARTS))).alias("_part"))
    low, high = F.col("id") % (1 << 26), F.floor(F.col("id") / (1 << 26))
    point = (low * F.lit(GOLDEN) + (high * F.lit((1 << 26) * GOLDEN % 1.0)) % 1.0) % 1.0
    points = spark.range(slots).withColumn("_point", point).withColumn("_part", F.floor(F.col("_point") * PARTS))
    drawn = points.join(parts, "_part").where("_point >= _from and _point < _to")
    drawn = drawn.select("_key", "id", F.floor(F.col("id") / CHUNK).alias("_slots"))
    ranked = running(drawn, {"slot_rank": F.lit(1)}, ["_key"], "_slots", ["id"])
    return ranked.select("_key", F.col("id").alias("slot"), F.col("slot_rank").cast("long").alias("slot_rank"))


def mix(docs: DataFrame, share: float = 1.0, block: int = BLOCK_WORDS, repeats: int = REPEATS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, first_slot for every row.

    size counts words (null: 0), taken the words that the mix takes of this row, repeats counted, and first_slot is the
    first slot of the schedule that takes one. A source's documents lie one after another in the order of
    sha256(doc_id) (then doc_id, then the text's digest); its k-th slot takes the k-th block of words of that line,
    which starts again at its end, and stops after `repeats` rounds, so no row exceeds repeats times its size. A
    source's taken words are its target within a few blocks. A null source is a source of its own, a null doc_id counts
    as an empty one in the order. Repeated rows are separate rows. A source without words has target 0. A very long
    text is only counted. Columns of docs named otherwise change nothing. An empty table gives no rows.
    """
    order = F.sha2(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 256)
    rows = docs.select("doc_id", "source", source_key(F.col("source")).alias("_key"), word_count(F.col("text")).alias("size"), order.alias("_order"), F.xxhash64("text").alias("_text"), F.monotonically_increasing_id().alias("_row"))
    rows = written(rows.withColumn("_part", F.substring("_order", 1, 3)))
    totals = rows.groupBy("source", "_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    totals = written(totals)
    targets = source_targets(totals.select("source", "source_size"), share, repeats)
    targets = written(targets.withColumn("_key", source_key(F.col("source"))).join(totals.select("_key", "_rows"), "_key"))
    words = int(totals.agg(F.sum("source_size")).first()[0] or 0)
    total = min(int(words * share), words * repeats)
    placed = running(rows, {"_start": "size"}, ["_key"], "_part", ["_order", "doc_id", "_text", "_row"])
    placed = written(placed.select("doc_id", "source", "_key", "size", "_row", "_start"))

    # a slot that passes the end of its source's line goes on at the start, until the last round is over
    sizes = targets.select("_key", "source_size")
    slots = schedule(targets, total, block).join(sizes, "_key").withColumn("_begin", F.col("slot_rank") * block)
    slots = slots.withColumn("_end", F.least(F.col("_begin") + block, F.col("source_size") * repeats)).where("_begin < _end")
    laps = F.sequence(F.floor(F.col("_begin") / F.col("source_size")), F.floor((F.col("_end") - 1) / F.col("source_size")))
    spans = slots.withColumn("_lap", F.explode(laps))
    spans = spans.select("_key", "slot", F.greatest(F.lit(0), F.col("_begin") - F.col("_lap") * F.col("source_size")).alias("_from"), F.least("source_size", F.col("_end") - F.col("_lap") * F.col("source_size")).alias("_to"))
    cells = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_from") / block), F.floor((F.col("_to") - 1) / block))))
    cells = cells.select("_key", "slot", "_cell", F.greatest("_from", F.col("_cell") * block).alias("_from"), F.least("_to", (F.col("_cell") + 1) * block).alias("_to"))
    cells = cells.groupBy("_key", "_cell", "_from", "_to").agg(F.count("*").alias("_times"), F.min("slot").alias("_slot"))

    held = placed.where("size > 0").select("_row", "_key", "_start", "size", F.explode(F.sequence(F.floor(F.col("_start") / block), F.floor((F.col("_start") + F.col("size") - 1) / block))).alias("_cell"))
    # a row for each block of words, which Spark sizes like a row for each text: never broadcast
    both = held.join(cells.hint("merge"), ["_key", "_cell"])
    common = F.greatest(F.lit(0), F.least(F.col("_to"), F.col("_start") + F.col("size")) - F.greatest("_from", "_start"))
    took = both.groupBy("_row").agg(F.sum(common * F.col("_times")).cast("long").alias("taken"), F.min(F.when(common > 0, F.col("_slot"))).alias("first_slot"))
    named = meet(placed.select("doc_id", "source", "_key", "size", "_row"), targets.select("_key", "source_size", "target", "_rows"), ["_key"], "_rows")
    done = named.join(took, "_row", "left")
    return done.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "first_slot")
