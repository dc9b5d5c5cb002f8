"""Quality classifier (operator 9): random Fourier features, ridge by summed normal equations, isotonic calibration.

Statistics of every whole text are computed once and stored. Their Gaussian kernel is approximated by
``features`` random cosines. Each partition of the training rows sums its part of the normal equations, the parts
are added up by row of the matrix, and the driver solves one system of that fixed size. Scores of calibration rows
are counted in ``BINS`` bins, pooled into a monotone curve, and the curve maps every ridge score to [0, 1].

Training takes at most ``max_rows`` labelled rows, drawn by hash of the id; everything else covers all rows. Labels
are read from training rows only; label, language, source and id are never inputs of a score.

Defined results: a null text counts as empty, and empty texts are scored by the same curve. A null id counts as the
empty string in the held-out rule and has no label. Repeated rows are scored alike. With no training row, or labels
of one kind only, the score is their mean (0.5 if there are none). Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.base import settled, table
from creditloom.llm.words import Texts, slices

FEATURES, RIDGE, MAX_ROWS, BINS, LIMIT, SEED = 384, 1e-3, 200_000, 2000, 4.0, 11
CUTOFF = 0.7
SYMBOLS = b"#*$%&|<>"
STATISTICS = (
    "log_words", "word_bytes", "long_word", "symbols", "digits", "capitals", "marks", "exclaims", "wide_bytes", "blanks",
    "distinct_words", "top_word", "equal_neighbours", "lone_symbols", "log_lines", "repeated_lines", "capital_words", "short_words",
)


def _flags(chars: bytes) -> np.ndarray:
    flags = np.zeros(256, dtype=bool)
    flags[list(chars)] = True
    return flags


_SYMBOL, _DIGIT, _UPPER = _flags(SYMBOLS), _flags(b"0123456789"), _flags(bytes(range(65, 91)))
_MARK, _BLANK, _WIDE = _flags(b".,;:?'\"()-"), _flags(b" \t\n\r\x0b\x0c"), _flags(bytes(range(128, 192)))


def _share(amount: np.ndarray, of: np.ndarray) -> np.ndarray:
    return amount / np.maximum(of, 1)


def statistics_of(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS per text."""
    texts = Texts(column)
    n, data, bounds = len(texts), texts.data, texts.bounds
    size, words, owner = np.diff(bounds), texts.counts, texts.owner()

    def held(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[bounds[1:]] - total[bounds[:-1]]

    # Capitals beyond ASCII: of the two-byte letters C3 80 to C3 9E.
    latin = np.zeros(len(data), dtype=bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    upper = _UPPER[data] | latin
    length = texts.end - texts.start
    longest = np.zeros(n)
    np.maximum.at(longest, owner, length)

    order = np.lexsort((texts.hashes, owner))
    o, h = owner[order], texts.hashes[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    runs = np.diff(np.append(np.flatnonzero(fresh), len(h)))
    top = np.zeros(n)
    np.maximum.at(top, o[fresh], runs)
    twin = np.zeros(len(texts.hashes), dtype=bool)
    twin[1:] = (texts.hashes[1:] == texts.hashes[:-1]) & (owner[1:] == owner[:-1])

    def per_word(flags: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=flags, minlength=n)

    lines = pc.split_pattern(pc.fill_null(column.cast(pa.large_string()), ""), "\n")
    flat, at = lines.flatten(), np.asarray(pc.list_parent_indices(lines))
    code = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    n_lines = np.bincount(at, minlength=n)
    seen = np.unique(at.astype(np.int64) * (len(flat) + 1) + code) // (len(flat) + 1)
    kinds = np.bincount(seen, minlength=n)
    capital = upper[texts.start] if len(data) else np.zeros(0)
    lone = (length == 1) & _SYMBOL[data[texts.start]] if len(data) else np.zeros(0)
    return np.stack([
        np.log1p(words), _share(np.bincount(owner, weights=length, minlength=n), words), np.log1p(longest),
        _share(held(_SYMBOL[data]), size), _share(held(_DIGIT[data]), size), _share(held(upper), size),
        _share(held(_MARK[data]), size), _share(held(data == 33), size), _share(held(_WIDE[data]), size),
        _share(held(_BLANK[data]), size), _share(np.bincount(o[fresh], minlength=n), words), _share(top, words), _share(per_word(twin), words),
        _share(per_word(lone), words), np.log1p(n_lines), 1 - _share(kinds, n_lines),
        _share(per_word(capital), words), _share(per_word(length <= 2), words),
    ], 1)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and stats (array<double>) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                stats = statistics_of(part.column("text"))
                offsets = np.arange(len(stats) + 1, dtype=np.int32) * len(STATISTICS)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(stats.ravel()))], ["doc_id", "stats"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, stats array<double>")


class Model:
    """Scaled statistics, random cosines, ridge weights and the calibration curve; all of fixed size."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int = FEATURES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        d = len(mean)
        self.mean, self.spread = mean, np.where(spread > 1e-12, spread, 1.0)
        self.directions = rng.normal(scale=1 / np.sqrt(d), size=(d, features))
        self.phases = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.curve = (np.array([0.0]), np.array([0.5]))

    def design(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.spread, -LIMIT, LIMIT)
        waves = np.cos(x @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.concatenate([waves, np.ones((len(x), 1))], 1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.design(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.round(np.clip(np.interp(self.raw(stats), *self.curve), 0, 1), 6)


def pooled(at: np.ndarray, n: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic curve by pooling adjacent violators: centres and values, both rising."""
    blocks: list[list[float]] = []
    for x, c, p in zip(at, n, positive):
        blocks.append([x * c, c, p])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def _stack(stats: pd.Series) -> np.ndarray:
    return np.stack(stats.to_numpy()) if len(stats) else np.zeros((0, len(STATISTICS)))


def fit(rows: DataFrame, max_rows: int = MAX_ROWS, features: int = FEATURES, ridge: float = RIDGE) -> Model:
    """Fit on rows of (doc_id, stats, label 0/1)."""
    total = rows.count()
    share = min(1.0, max_rows / max(total, 1))
    draw = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1_000_000))
    rows = rows.withColumn("draw", draw).where(F.col("draw") < int(share * 1_000_000))
    rows = settled(rows.repartition(max(1, min(64, int(total * share) // 4096 + 1)), "draw"))
    each = [F.col("stats")[i] for i in range(len(STATISTICS))]
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("rate"),
                    *[F.avg(c).alias(f"m{i}") for i, c in enumerate(each)],
                    *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(each)]).first()
    d = len(STATISTICS)
    if not sums.n or sums.rate in (0.0, 1.0):
        model = Model(np.zeros(d), np.ones(d), features)
        model.curve = (np.array([0.0]), np.array([0.5 if not sums.n else sums.rate]))
        return model
    model = Model(np.array([sums[f"m{i}"] for i in range(d)]), np.array([sums[f"s{i}"] for i in range(d)]), features)
    calibrates = F.col("draw") % 5 == 0

    def part(batches):
        gram = np.zeros((features + 1, features + 2))
        for batch in batches:
            if len(batch):
                phi = model.design(_stack(batch["stats"]))
                gram += phi.T @ np.concatenate([phi, batch[["label"]].to_numpy(float)], 1)
        yield pd.DataFrame({"line": np.arange(features + 1), "sums": list(gram)})

    def add(pdf):
        return pd.DataFrame({"line": pdf["line"].iloc[:1], "sums": [np.sum(np.stack(pdf["sums"].to_numpy()), 0)]})

    schema = "line int, sums array<double>"
    lines = rows.where(~calibrates).select("stats", "label").mapInPandas(part, schema).groupBy("line").applyInPandas(add, schema)
    gram = np.stack([r.sums for r in sorted(lines.collect(), key=lambda r: r.line)])  # features + 1 rows
    n = max(gram[-1, -2], 1.0)
    model.weights = np.linalg.solve(gram[:, :-1] / n + ridge / features * np.eye(features + 1), gram[:, -1] / n)

    def binned(batches):
        for batch in batches:
            if len(batch):
                raw = np.clip(model.raw(_stack(batch["stats"])), -0.5, 1.5)
                yield pd.DataFrame({"bin": ((raw + 0.5) / 2 * (BINS - 1)).round().astype(np.int32), "label": batch["label"].to_numpy(float)})

    counted = rows.where(calibrates).select("stats", "label").mapInPandas(binned, "bin int, label double")
    bins = sorted(counted.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).collect())  # BINS rows at most
    if bins:
        model.curve = pooled(*(np.array(x, float) for x in ([b.bin * 2 / (BINS - 1) - 0.5 for b in bins], [b.n for b in bins], [b.p for b in bins])))
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    stats = settled(statistics(docs))
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(
        F.max(F.col(label)).cast("double").alias("label"))
    train = stats.where(~held_out(F.col("doc_id"))).join(known, F.col("doc_id") == F.col("label_id")).select("doc_id", "stats", "label")
    model = fit(train, max_rows)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("stats").flatten().to_numpy(zero_copy_only=False)
            score = model.score(flat.reshape(batch.num_rows, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    scored = stats.mapInArrow(apply, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))


def op9_quality_model(spark: SparkSession, folder: str) -> DataFrame:
    return classify(table(spark, folder, "documents"), table(spark, folder, "labels"))
