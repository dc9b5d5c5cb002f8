"""Mixing sources to target weights (operator 8): a low-discrepancy schedule of equal-token blocks.

The documents of a source, in hashed order, are one stream of words, passed over up to ``max_passes`` times and cut
into blocks of equal size, smaller ones for a small source. Slot k of the schedule has the golden-ratio point frac((k + 1) / phi), which the
cumulative target shares, counted in blocks, map to a source; the slot's rank among those of its source names the block that it takes.
Joining slots and blocks gives the words that the mix takes of every document.

Slots are made in chunks, whose counts per source are summed up to give every chunk its first rank, and documents
are placed on their stream by range partitions (``ordered.running_totals``), so a source with a third of all rows
is in no single task. The driver holds one row per source: the targets, which are a setting of the job.

Defined results: a null text has size 0; documents without words are taken 0 times. Null is a source, the last.
Rows that repeat each have their own place and words. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creditloom.llm.base import packed, same, settled, table, text_key, unpacked
from creditloom.llm.words import word_array
from creditloom.operators.ordered import running_totals

WEIGHTS, MAX_PASSES = (5, 2, 1), 3
MAX_BLOCK, SLOTS_OF_SMALLEST = 4096, 1000
GOLDEN = 0.6180339887498949
SLACK = 100  # blocks by which the slots of a source may exceed its target; far above the discrepancy of the points
SEED = "mix"


def targets(sizes: Sequence[int], weights: Sequence[float], most: int = MAX_PASSES) -> list[float]:
    """Shares of the sum of ``sizes`` by weight; a share stops at ``most`` times its size, the excess is shared again."""
    total, out, free = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in free)
        weight = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = float(most * sizes[i])
        free -= set(over)
    return out


def sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MAX_PASSES) -> list[tuple]:
    """(place, source, size, target) of every source in code point order, null last."""
    found = docs.groupBy("source").agg(F.sum("size").alias("size")).collect()  # one row per source
    found.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    goal = targets([r.size for r in found], [weights[i % len(weights)] for i in range(len(found))], most)
    return [(i, r.source, int(r.size), t) for i, (r, t) in enumerate(zip(found, goal))]


def block_size(target: float) -> int:
    """Words in a block of a source: its target has SLOTS_OF_SMALLEST blocks at least, but a block at most MAX_BLOCK words.

    So there are at most one slot in MAX_BLOCK words, and SLOTS_OF_SMALLEST for each source, whatever the smallest one is.
    """
    return int(min(MAX_BLOCK, max(1, target // SLOTS_OF_SMALLEST)))


def schedule(spark: SparkSession, plan: list[tuple]) -> DataFrame:
    """slot, place (of the source) and rank: the slot takes block ``rank`` of its source.

    A source has slots in proportion to its target in blocks, so the words of any stretch of slots are in proportion to the targets.
    """
    blocks = np.array([t / block_size(t) for *_, t in plan])
    n = int(np.ceil(blocks.sum()))
    chunk = max(1024, int(np.sqrt(n)))
    bounds = np.cumsum(blocks) / blocks.sum() if n else np.ones(len(plan))

    def points(batches):
        for batch in batches:
            for c in batch["id"]:
                slot = np.arange(c * chunk, min(n, (c + 1) * chunk), dtype=np.int64)
                place = np.minimum(np.searchsorted(bounds, (slot + 1) * GOLDEN % 1.0, side="right"), len(bounds) - 1)
                order = np.argsort(place, kind="stable")
                count = np.bincount(place, minlength=len(bounds))
                rank = np.empty(len(slot), dtype=np.int64)
                rank[order] = np.arange(len(slot)) - np.repeat(np.cumsum(count) - count, count)
                yield pd.DataFrame({"slot": slot, "chunk": c, "place": place.astype(np.int32), "inner": rank})

    slots = spark.range(-(-n // chunk)).mapInPandas(points, "slot long, chunk long, place int, inner long")
    counts = slots.groupBy("chunk", "place").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("chunk", "place", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    return slots.join(first, ["chunk", "place"]).select("slot", "place", (F.col("first") + F.col("inner")).alias("rank"))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", text_key(F.col("text")).alias("text_key"), F.size(word_array(F.col("text"))).cast("long").alias("size"))


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MAX_PASSES) -> DataFrame:
    """doc_id, text_key, source, size, source_size, target, taken: one row per row of ``docs``."""
    spark = docs.sparkSession
    base = settled(sized(docs))
    plan = sources(base, weights, most)
    if not plan:
        return base.select("doc_id", "text_key", "source", "size", F.col("size").alias("source_size"),
                           F.lit(0.0).alias("target"), F.col("size").alias("taken"))  # no rows
    known = spark.createDataFrame(
        [(*row, block_size(row[-1])) for row in plan], "place int, name string, source_size long, target double, block long")
    base = base.join(F.broadcast(known), same(base["source"], F.col("name"))).drop("name")
    base = base.withColumn("row", F.monotonically_increasing_id())
    base = base.withColumn("draw", F.xxhash64(F.lit(SEED), "doc_id", "text_key"))
    placed = running_totals(base, ["draw", "doc_id", "row"], ["size"], ["place"]).withColumnRenamed("size_before", "start")
    slots = settled(schedule(spark, plan))
    # Passes beyond the target find no slot; the last block of the last pass is as long as what is left of it.
    passes = F.sequence(F.lit(0), F.lit(most - 1))
    each = placed.where(F.col("size") > 0).withColumn("pass", F.explode(passes))
    each = each.withColumn("from", F.col("start") + F.col("pass") * F.col("source_size")).where(F.col("from") < F.col("target") + SLACK * F.col("block"))
    first, last = F.expr("`from` div block"), F.expr("(`from` + size - 1) div block")
    pieces = each.select("row", "place", "from", "size", "block", F.explode(F.sequence(first, last)).alias("rank"))
    inside = F.least(F.col("from") + F.col("size"), (F.col("rank") + 1) * F.col("block")) - F.greatest("from", F.col("rank") * F.col("block"))
    taken = pieces.withColumn("words", inside).join(slots, ["place", "rank"]).groupBy("row").agg(F.sum("words").alias("taken"))
    return placed.join(taken, "row", "left").select(
        "doc_id", "text_key", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mix_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MAX_PASSES) -> DataFrame:
    """The mix itself: the rows of ``docs`` once for each pass that takes them, cut in the pass that ends within them.

    Columns are those of ``docs``; ``n_chars``, if there, follows the text. Repeated rows of one id and text take
    what the first of them takes.
    """
    plan = mixed(docs, weights, most).groupBy(F.col("doc_id").alias("mix_id"), F.col("text_key").alias("mix_key")).agg(
        F.max("size").alias("mix_size"), F.max("taken").alias("mix_taken")
    ).where(F.col("mix_taken") > 0)
    rows = packed(docs)
    match = same(rows["doc_id"], plan["mix_id"]) & (text_key(rows["text"]) == plan["mix_key"])
    passes = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("mix_taken") - 1) / F.col("mix_size"))))
    each = rows.join(plan, match).withColumn("mix_pass", passes)
    rest = F.col("mix_taken") - F.col("mix_pass") * F.col("mix_size")
    cut = F.array_join(F.slice(word_array(F.col("text")), 1, rest.cast("int")), " ")
    return unpacked(each, docs, F.when(rest >= F.col("mix_size"), F.col("text")).otherwise(cut))


def op8_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixed(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")
