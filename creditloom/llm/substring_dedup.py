"""Substring dedup (operator 2): level-wise doubling of repeated word windows.

Level by level the windows get twice as long, 25 and then 50 words by default, and only what repeats at one level is
looked at on the next. The first level takes content-selected windows alone: of the shorter windows in each longer
one the least by hash, which is the same wherever the longer one stands, so a longer window can only repeat if that
one does. Later levels take every window whose two halves repeat. The last level finds for each window the
smallest id that it starts in; words under a window that also starts in a document with a smaller id are removed.
Counts per window are combined before the exchange, joins on windows are left to adaptive skew handling, and no
window's documents are gathered in one place. Documents with the same words are looked at once.

Defined results: a null or empty text has no words. Ids are compared as longs, null after all others; documents of
one id don't remove each other's words. Rows alike in id and text get the same result. Extra columns are not read.
Word sequences are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.base import settled, table
from creditloom.llm.passages import _list, first_documents, keyed, repeated_marks, texts_of
from creditloom.llm.words import Texts, sliding, slices

LENGTHS = (25, 50)


def _windows(docs: DataFrame, chosen: DataFrame, short: int, length: int, marked: bool) -> DataFrame:
    """doc, text_key, at, window: the windows of ``length`` words that may repeat.

    ``chosen`` has per document the repeated windows of ``short`` words: their hashes if ``marked``, else their places.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = Texts(part.column("text"))
                n, counts = len(texts), texts.counts
                start, value = texts.windows(length)
                offset = np.arange(len(texts.hashes)) - np.repeat(texts.first[:-1], counts)
                found = part.column("found")
                given, doc_of = found.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(n), found.value_lengths().to_numpy(zero_copy_only=False))
                if not len(start) or not len(given):
                    continue
                owner = texts.owner()[start]
                if marked:
                    inner_start, inner = texts.windows(short)
                    full = np.full(len(texts.hashes), np.iinfo(np.uint64).max, dtype=np.uint64)
                    full[inner_start] = inner
                    own = sliding(full, length - short + 1, np.minimum)[start].view(np.int64)
                    # A mark belongs to a document: pairs are compared by their place in one sorted list.
                    names, code = np.unique(given, return_inverse=True)
                    place = np.minimum(np.searchsorted(names, own), len(names) - 1)
                    known = np.unique(doc_of * len(names) + code)
                    good = (names[place] == own) & np.isin(owner * len(names) + place, known)
                else:
                    at = np.zeros(len(texts.hashes) + 1, dtype=bool)
                    at[texts.first[doc_of] + given] = True
                    good = at[start] & at[start + length - short]
                start, value, owner = start[good], value[good], owner[good]
                hits = np.bincount(owner, minlength=n)
                rows = pa.array(hits > 0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc").filter(rows), part.column("text_key").filter(rows),
                     _list(offset[start].astype(np.int32), hits[hits > 0], pa.int32()),
                     _list(value.view(np.int64), hits[hits > 0], pa.int64())],
                    ["doc", "text_key", "at", "window"],
                )

    return texts_of(docs, chosen).select("doc", "text_key", "text", "found").mapInArrow(
        work, "doc long, text_key long, at array<int>, window array<long>"
    )


def _repeats(windows: DataFrame, only_later: bool) -> DataFrame:
    """doc, text_key, found (places): the windows that two ids hold; ``only_later``: that a smaller id holds."""
    each = windows.select("doc", "text_key", F.explode(F.arrays_zip("at", "window")).alias("w")).select(
        "doc", "text_key", F.col("w.at").alias("at"), F.col("w.window").alias("window")
    )
    # Stored, so that the join reads two plain exchanges and a window in very many documents can be split.
    shared = settled(
        each.groupBy("window").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where(F.col("low") < F.col("high"))
        .select("window", "low")
    )
    hit = each.join(shared, "window")
    hit = hit.where(F.col("low") < F.col("doc")) if only_later else hit
    return hit.groupBy("doc", "text_key").agg(F.collect_list("at").alias("found"))


def repeated_windows(docs: DataFrame, lengths: Sequence[int] = LENGTHS) -> tuple[DataFrame, DataFrame]:
    """The scan of all documents, and per first document the places of windows that a smaller id holds."""
    scan, firsts = first_documents(docs, lengths[0], lengths[1])
    found, marked = settled(repeated_marks(firsts).withColumnRenamed("marks", "found")), True
    for short, length in zip(lengths, lengths[1:]):
        windows = settled(_windows(docs, found, short, length, marked))
        found, marked = settled(_repeats(windows, length == lengths[-1])), False
    return scan, found


def deduped(docs: DataFrame, lengths: Sequence[int] = LENGTHS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and text (the kept words; null where nothing was removed)."""
    scan, found = repeated_windows(docs, lengths)
    length = lengths[-1]
    copy = F.col("first") < F.col("doc")
    gone = copy & (F.col("n_words") >= length)  # the whole text also stands in a smaller id
    untouched = scan.where(~copy).join(found.select("doc", "text_key"), ["doc", "text_key"], "left_anti")
    plain = scan.where(copy).select(untouched.columns).unionByName(untouched).select(
        "doc_id", "n_words", F.when(gone, F.col("n_words")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.col("all_sha")).alias("kept_sha256"),
        F.when(gone, F.lit("")).alias("text"),
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = Texts(part.column("text"))
                n, counts = len(texts), texts.counts
                found = part.column("found")
                doc_of = np.repeat(np.arange(n), found.value_lengths().to_numpy(zero_copy_only=False))
                edge = np.zeros(len(texts.hashes) + 1, dtype=np.int32)
                start = texts.first[doc_of] + found.flatten().to_numpy(zero_copy_only=False)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + length, -1)
                keep = np.cumsum(edge)[:-1] == 0
                kept = [texts.words(i, keep[texts.first[i]:texts.first[i + 1]]) for i in range(n)]
                left = np.bincount(texts.owner(), weights=keep, minlength=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(counts - left, pa.int64()),
                     pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array([k.decode("utf-8", "replace") for k in kept])],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "text"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    hit = keyed(docs).join(found, ["doc", "text_key"]).select("doc_id", "text", "found")
    changed = hit.mapInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, text string")
    return plain.unionByName(changed)


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return deduped(table(spark, folder, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


REMOVED_CTES = r"""
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h
        FROM d, unnest(range(1, len(w) - 48)) AS r(i) WHERE len(w) >= 50),
firsts AS (SELECT h, min(doc_id) AS low FROM win GROUP BY h),
hit AS (SELECT win.doc_id, i FROM win JOIN firsts USING (h) WHERE low < win.doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hit, unnest(range(0, 50)) AS r(k)),
word AS (SELECT d.doc_id, i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS r(i)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n
         FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)"""

SQL = f"""WITH {REMOVED_CTES}
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""
