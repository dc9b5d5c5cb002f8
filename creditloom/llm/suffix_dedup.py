"""Suffix-array dedup (operator 1): a sparse suffix array over content-selected positions.

Suffixes are kept at minimisers alone: positions whose 8-word window is the least, by hash, of some run of 50 words,
so equal passages of 50 words hold an equal kept position at the same place. Kept positions whose window
occurs under one id only are dropped. The other suffixes are range-partitioned and sorted by their first 50 words,
and once more by the 50 words before them, read backwards. In either order each is compared with its neighbours: the
nearest suffix above and below that belongs to a smaller id, and the first document's suffix with the same window.
A match is extended to the right and to the left, up to 50 words each way; of 50 words or more, it is a span to
remove. Overlapping spans of a longer passage, one per kept position, join up. A run of equal suffixes, however
long, is range-partitioned by id as well, so it fills no single task.

Every span also stands under a smaller id. Neighbours alone would miss passages: where a partition ends between two
of them, and where a text overlaps several earlier ones of which neither the one that shares most to the right nor the
one that shares most to the left holds the passage. So the passes also say how far a suffix agrees with any other id
on their side, as far as it goes where a partition's end hides the neighbour. Passages of 50 words within both reaches
that no span covers are open; of equal open ones all but those of the least id are removed as well. The first document
that holds a passage has it open always, so the result is exact and doesn't depend on the partitions.

Defined results: a null or empty text has no words and no spans. Ids are compared as longs, null after all others.
Documents with the same words are looked at once; of more than one, the later ones are removed whole if they have
50 words. Rows alike in id and text get the same result. Extra columns are not read. Words are compared by 32 bits
of their hash beside the 64 bits of the window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.base import settled, table
from creditloom.llm.passages import _list, first_documents, keyed, repeated_marks, texts_of
from creditloom.llm.substring_dedup import REMOVED_CTES, _repeats, _windows
from creditloom.llm.words import Texts, selected, slices

WINDOW, LEAST = 8, 50


def suffixes(docs: DataFrame, chosen: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """mark, doc, text_key, at, right, left: the words from ``at`` on and those before it, nearest first, as bytes.

    Four bytes a word; beyond the text's ends come fewer.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = Texts(part.column("text"))
                n = len(texts)
                start, value = selected(texts, window, least)
                found = part.column("marks")
                given = found.flatten().to_numpy(zero_copy_only=False)
                if not len(start) or not len(given):
                    continue
                value, owner = value.view(np.int64), texts.owner()[start]
                doc_of = np.repeat(np.arange(n), found.value_lengths().to_numpy(zero_copy_only=False))
                names, code = np.unique(given, return_inverse=True)
                place = np.minimum(np.searchsorted(names, value), len(names) - 1)
                good = (names[place] == value) & np.isin(owner * len(names) + place, np.unique(doc_of * len(names) + code))
                start, value, owner = start[good], value[good], owner[good]
                short = (texts.hashes >> np.uint64(32)).astype(">u4")
                back = short[::-1].tobytes()
                short, total = short.tobytes(), len(texts.hashes)
                first, last = texts.first[owner], texts.first[owner + 1]
                right = [short[4 * s:4 * min(s + least, e)] for s, e in zip(start.tolist(), last.tolist())]
                left = [back[4 * (total - s):4 * (total - max(s - least, f))] for s, f in zip(start.tolist(), first.tolist())]
                rows = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value), part.column("doc").take(rows), part.column("text_key").take(rows),
                     pa.array((start - first).astype(np.int32)), pa.array(right, pa.binary()), pa.array(left, pa.binary())],
                    ["mark", "doc", "text_key", "at", "right", "left"],
                )

    return texts_of(docs, chosen).select("doc", "text_key", "text", "marks").mapInArrow(
        work, "mark long, doc long, text_key long, at int, right binary, left binary"
    )


def _equal_words(a: bytes, b: bytes) -> int:
    """Length of the common beginning, in words of four bytes."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // 4
    differing = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return (8 * n - differing.bit_length()) // 32


SPAN = "doc long, text_key long, start int, end int"


def _spans(found: list[tuple]) -> pa.RecordBatch:
    doc, key, start, end = zip(*found)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), pa.array(key, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32())],
        ["doc", "text_key", "start", "end"],
    )


def _extended(row: tuple, other: tuple, least: int) -> list[tuple]:
    """The span of a row (doc, text_key, at, right, left) that another shares, if it is long enough."""
    right, left = _equal_words(row[3], other[3]), _equal_words(row[4], other[4])
    return [(row[0], row[1], row[2] - left, row[2] + right)] if left + right >= least else []


def first_matches(suffixes: DataFrame, least: int = LEAST) -> DataFrame:
    """Spans that the first document's suffix of the same mark shares: all that have a passage meet it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc", "text_key", "at", "right", "left", "low_right", "low_left")]
            out = [s for *row, right, left in zip(*columns) for s in _extended(row, (None, None, None, right, left), least)]
            if out:
                yield _spans(out)

    # Stored, so that the join reads two plain exchanges and a mark with very many suffixes can be split.
    low = settled(suffixes.groupBy("mark").agg(F.min(F.struct("doc", "at", "text_key", "right", "left")).alias("low")))
    later = suffixes.join(low, "mark").where(F.col("low.doc") < F.col("doc"))
    return later.select("doc", "text_key", "at", "right", "left", F.col("low.right").alias("low_right"),
                        F.col("low.left").alias("low_left")).mapInArrow(work, SPAN)


FOUND = "doc long, text_key long, at int, start int, end int"


def _found(spans: list[tuple], reaches: list[tuple]) -> pa.RecordBatch:
    rows = [(doc, key, None, start, end) for doc, key, start, end in spans] + reaches
    names = ["doc", "text_key", "at", "start", "end"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


class _Reaches:
    """How far each suffix agrees on one side with the nearest suffixes of other ids, above and below in the order.

    ``run`` holds the latest suffixes of one id and mark: doc, text_key, at, words of both sides, what is shared above,
    and what is shared with the suffix before it. What lies beyond the partition may share all.
    """

    def __init__(self, side: int, least: int):
        self.side, self.least, self.run, self.last, self.mark = side, least, [], None, None

    def closed(self, below: int | None) -> list[tuple]:
        """The run's rows for the result; ``below`` is shared by its last suffix and the next id's, None if unknown."""
        out = []
        for doc, key, at, right, left, above, step in reversed(self.run):
            own, other = (right, left) if self.side == 3 else (left, right)
            reach = own if above is None or below is None else max(above, below)
            if reach + other >= self.least:
                out.append((doc, key, at, None, at + reach) if self.side == 3 else (doc, key, at, at - reach, None))
            below = None if below is None else min(below, step)
        self.run = []
        return out

    def add(self, mark: int, row: tuple) -> list[tuple]:
        out, step = [], 0
        if mark != self.mark:
            out = self.closed(0)
            above = 0 if self.last else None
        else:
            step = _equal_words(self.last[self.side], row[self.side])
            if self.run[-1][0] != row[0]:
                out, above = self.closed(step), step
            else:
                above = self.run[-1][5]
                above = None if above is None else min(above, step)
        self.run.append((*row[:3], len(row[3]) // 4, len(row[4]) // 4, above, step))
        self.last, self.mark = row, mark
        return out


def matches(sorted_suffixes: DataFrame, side: str = "right", least: int = LEAST) -> DataFrame:
    """Of rows sorted within partitions, by mark and ``side`` first: spans that a neighbour of a smaller id shares, with
    null as ``at``; and for each suffix the end (right) or the start (left) of what other ids can share with it.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The stack has one entry for each id that is smaller than all ids after it: [id, suffixes that came with it].
        stack: list = []
        mark, reaches = None, _Reaches(3 if side == "right" else 4, least)

        for batch in batches:
            out: list = []
            reached: list = []
            columns = [batch.column(c).to_pylist() for c in ("mark", "doc", "text_key", "at", "right", "left")]
            for m, doc, key, at, right, left in zip(*columns):
                row = (doc, key, at, right, left)
                reached += reaches.add(m, row)
                if m != mark:
                    stack, mark = [], m
                while stack and stack[-1][0] > doc:
                    for waiting in stack.pop()[1]:
                        out += _extended(waiting, row, least)
                if stack and stack[-1][0] == doc:
                    stack[-1][1].append(row)
                    above = stack[-2:-1]
                else:
                    above = stack[-1:]
                    stack.append([doc, [row]])
                if above:
                    out += _extended(row, above[0][1][-1], least)
            if out or reached:
                yield _found(out, reached)
        reached = reaches.closed(None)
        if reached:
            yield _found([], reached)

    return sorted_suffixes.mapInArrow(work, FOUND)


def open_starts(spans: DataFrame, reaches: DataFrame, least: int = LEAST) -> DataFrame:
    """doc, text_key, found: starts of the passages that lie within both reaches of a suffix, and in no single span."""
    wide = reaches.groupBy("doc", "text_key", "at").agg(F.min("start").alias("start"), F.max("end").alias("end")).where(
        F.col("end") - F.col("start") >= least).select("doc", "text_key", "start", "end", F.lit(True).alias("wide"))
    each = wide.union(spans.select("doc", "text_key", "start", "end", F.lit(False)))
    pair = F.struct("start", (F.col("end") - least).alias("end"))
    per_doc = each.groupBy("doc", "text_key").agg(
        F.collect_set(F.when(F.col("wide"), pair)).alias("wide"), F.collect_set(F.when(~F.col("wide"), pair)).alias("known"))
    starts = lambda c: F.flatten(F.transform(c, lambda x: F.sequence(x["start"], x["end"])))
    found = per_doc.where(F.size("wide") > 0).select("doc", "text_key", F.array_except(starts("wide"), starts("known")).alias("found"))
    return found.where(F.size("found") > 0)


def removed_spans(docs: DataFrame, window: int = WINDOW, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """The scan of all documents, and (doc, text_key, starts, ends) of the first documents with spans to remove."""
    scan, firsts = first_documents(docs, window, least)
    chosen = settled(repeated_marks(firsts))
    rows = settled(suffixes(docs, chosen, window, least))
    spans, passes = settled(first_matches(rows, least).distinct()), []
    for side, other in (("right", "left"), ("left", "right")):
        order = ["mark", side, other, "doc", "at"]
        passes.append(settled(matches(rows.repartitionByRange(*order).sortWithinPartitions(*order), side, least)))
    del rows
    found = passes[0].union(passes[1])
    spans = settled(spans.union(found.where(F.col("at").isNull()).select(spans.columns)).distinct())
    still = settled(open_starts(spans, found.where(F.col("at").isNotNull()), least))
    del found, passes
    late = _repeats(settled(_windows(docs, still, least, least, False)), True)
    late = late.select("doc", "text_key", F.explode("found").alias("start"))
    spans = spans.union(late.select("doc", "text_key", "start", (F.col("start") + least).alias("end")))
    per_doc = spans.groupBy("doc", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    start = F.array().cast("array<struct<start:int,end:int>>")
    merged = F.aggregate("spans", start, lambda s, x: F.when(
        (F.size(s) > 0) & (F.coalesce(F.try_element_at(s, F.lit(-1))["end"], F.lit(-1)) >= x["start"]),
        F.concat(F.slice(s, 1, F.size(s) - 1), F.array(F.struct(
            F.try_element_at(s, F.lit(-1))["start"].alias("start"),
            F.greatest(F.try_element_at(s, F.lit(-1))["end"], x["end"]).alias("end")))),
    ).otherwise(F.concat(s, F.array(x))))
    return scan, settled(per_doc.select("doc", "text_key", merged.alias("spans")))


def deduped(docs: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, n_removed, spans: array of (start, end), word numbers, end exclusive."""
    scan, found = removed_spans(docs, window, least)
    kind = "array<struct<start:int,end:int>>"
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    copy = (F.col("first") < F.col("doc")) & (F.col("n_words") >= least)
    spans = F.when(copy, whole).otherwise(F.coalesce(F.when(F.col("first") == F.col("doc"), F.col("spans")), F.array().cast(kind)))
    joined = scan.drop("marks").join(found, ["doc", "text_key"], "left").withColumn("spans", spans)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["end"] - x["start"]))
    return joined.select("doc_id", "n_words", removed.alias("n_removed"), "spans")


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    shown = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return deduped(table(spark, folder, "documents")).select("doc_id", "n_words", "n_removed", shown.alias("spans"))


SQL = f"""WITH {REMOVED_CTES},
edge AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM gone),
span AS (SELECT doc_id, min(i) - 1 AS s, max(i) AS e FROM edge GROUP BY doc_id, grp),
listed AS (SELECT doc_id, string_agg(s || ':' || e, ',' ORDER BY s) AS spans, sum(e - s) AS n FROM span GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       coalesce(spans, '') AS spans FROM d LEFT JOIN listed USING (doc_id)"""
