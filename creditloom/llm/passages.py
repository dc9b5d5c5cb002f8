"""What the two passage operators share: scanned documents, copies, and repeated marks.

Documents are told apart by (doc, text_key): the id, null last of all, and a hash of the text. Rows alike in both
are one document. A passage counts as repeated when it also starts in a document with a smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm.base import settled, text_key
from creditloom.llm.words import WORD_BASE, Texts, range_hashes, selected, slices

NO_ID = (1 << 63) - 1


def doc_order(doc_id: Column) -> Column:
    """The id as a long; null comes after all ids."""
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(doc_order(F.col("doc_id")).alias("doc"), text_key(F.col("text")).alias("text_key"), "doc_id", "text")


def whole_hashes(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each document's word sequence."""
    first, last = texts.first[:-1], texts.first[1:]
    return range_hashes(texts.hashes, first, last, WORD_BASE), range_hashes(texts.hashes, first, last, WORD_BASE ^ 0x5A5A5A5A5A5A5A50)


def _list(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def distinct_per_doc(owner: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct values, one after the other, and how many."""
    order = np.lexsort((values, owner))
    o, v = owner[order], values[order]
    fresh = np.ones(len(v), dtype=bool)
    fresh[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
    return v[fresh], np.bincount(o[fresh], minlength=n)


def scanned(docs: DataFrame, length: int, span: int) -> DataFrame:
    """doc, text_key, doc_id, n_words, whole (array of two longs), all_sha (of all words), marks.

    ``marks`` are the distinct hashes of the document's selected windows of ``length`` words: every passage of
    ``span`` words holds the same ones wherever it stands.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for part in slices(batch):
                texts = Texts(part.column("text"))
                n, owner = len(texts), texts.owner()
                start, value = selected(texts, length, span)
                marks, counts = distinct_per_doc(owner[start], value.view(np.int64), n)
                whole = np.stack(whole_hashes(texts), 1).view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), part.column("text_key"), part.column("doc_id"), pa.array(texts.counts, pa.int64()),
                     _list(whole, np.full(n, 2), pa.int64()),
                     pa.array([hashlib.sha256(texts.words(i)).hexdigest() for i in range(n)]),
                     _list(marks, counts, pa.int64())],
                    ["doc", "text_key", "doc_id", "n_words", "whole", "all_sha", "marks"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return keyed(docs).mapInArrow(
        work, f"doc long, text_key long, doc_id {kind}, n_words long, whole array<long>, all_sha string, marks array<long>"
    )


def with_first_copy(scan: DataFrame) -> DataFrame:
    """Adds ``first``: the smallest id among the documents with the same words."""
    first = scan.groupBy("whole", "n_words").agg(F.min("doc").alias("first"))
    return scan.join(first, ["whole", "n_words"])


def repeated_marks(firsts: DataFrame) -> DataFrame:
    """doc, text_key, marks: of the documents given, those marks that two or more ids hold."""
    each = firsts.select("doc", "text_key", F.explode("marks").alias("mark"))
    shared = settled(  # stored, so that the join can split a mark in very many documents
        each.groupBy("mark").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where(F.col("low") < F.col("high"))
        .select("mark")
    )
    return each.join(shared, "mark").groupBy("doc", "text_key").agg(F.collect_set("mark").alias("marks"))


def texts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc, text_key, text and the other columns of ``chosen`` (distinct by doc and text_key), a row per document."""
    texts = keyed(docs).select("doc", "text_key", "text")
    return texts.join(chosen, ["doc", "text_key"])


def first_documents(docs: DataFrame, length: int, span: int) -> tuple[DataFrame, DataFrame]:
    """The scan with ``first``, stored, and the distinct first documents of it (doc, text_key, marks)."""
    scan = settled(with_first_copy(settled(scanned(docs, length, span))))
    firsts = scan.where((F.col("first") == F.col("doc")) & (F.size("marks") > 0)).select("doc", "text_key", "marks")
    return scan, firsts.dropDuplicates(["doc", "text_key"])
