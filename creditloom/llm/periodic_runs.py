"""Periodic run detection (operator 12): multi-scale minimizers.

A run is a stretch of words with smallest period p, at least ``MIN_LENGTH`` words and two periods long, that no
neighbouring word extends keeping the period. Periods below ``SHORT`` are found by direct scans: the text is
compared with itself shifted by each of them. Longer ones are found scale by scale, the scale S for periods S to
2 S - 1, with k-grams of S / 2 words and windows of S - 1 words:

1. Within a run of period p the text repeats after p words, so a window and the window p words later have equal minima,
   one period apart, and both lie in the run. All k-grams that are the least of some window that covers them are
   chosen, and chosen k-grams with equal hashes between S and 2 S - 1 words apart are seeds.
2. A k-gram that itself has a period of at most k / 2 could occur everywhere (``la la la``); such k-grams lie in runs found at smaller
   scales and aren't chosen. What is left occurs at most every k / 2 words, so each has a few partners at most. A window in which
   nothing is left lies in one run of shorter period, and the first of two periods of a run hidden there does too; each
   period of the scale is then a seed at places a window apart near the end of that shorter run, where alone it can be.
3. Seeds are extended left and right by bisection on range hashes, and kept if long enough. Of those with the same
   bounds the smallest period counts, as a longer one is a multiple of it.

Every run is found whatever its text, since seeds exist for all and are verified; work is near linear in the words
but for the logarithm of the length. Texts are dealt with in runs of about 2 MB, a longer text by itself, in memory
proportional to it.

Defined results: a null, empty or blank text has no words and no runs. Rows are independent, so null and repeated ids,
repeated rows and ties matter to no other row. Columns beyond the text are neither read nor changed; results
are added as ``runs`` and ``collapsed``, replacing columns of these names. Words are compared by 64-bit hashes, stretches
by two hashes modulo primes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.llm.base import bound, table
from creditloom.llm.words import WORD_BASE, Texts, mix, range_hashes, slices, sliding, word_array

MIN_LENGTH, SHORT = 12, 24
MODULI = (2147483647, 2147483629)  # fixed values: the two greatest primes below 2 ** 31
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]  # start, end, period


class Stretches:
    """Tells whether two stretches of a word sequence are equal, by prefix sums modulo two primes."""

    def __init__(self, hashes: np.ndarray):
        self.sums, self.powers = [], []
        for m in MODULI:
            power, base = np.ones(1, dtype=np.uint64), int(WORD_BASE % m)
            while len(power) <= len(hashes):
                power = np.concatenate([power, power * np.uint64(pow(base, len(power), m)) % np.uint64(m)])
            power = power[:len(hashes) + 1]
            total = np.zeros(len(hashes) + 1, dtype=np.uint64)
            np.cumsum(hashes % np.uint64(m) * power[:-1] % np.uint64(m), out=total[1:])
            self.sums.append(total)  # sums of less than 2 ** 33 values below 2 ** 31
            self.powers.append(power)

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether [a, a + length) equals [b, b + length), b not before a, for each."""
        same = np.ones(len(a), dtype=bool)
        for m, total, power in zip(MODULI, self.sums, self.powers):
            left = (total[a + length] - total[a]) % np.uint64(m) * power[b - a] % np.uint64(m)
            same &= left == (total[b + length] - total[b]) % np.uint64(m)
        return same

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """Length, up to ``most``, of the longest equal stretches from a and b on, or before them."""
        low, high = np.zeros(len(a), dtype=np.int64), np.maximum(most, 0)
        while (open_ := low < high).any():
            middle = np.where(open_, (low + high + 1) // 2, low)
            shift = middle if back else 0
            same = self.equal(a - shift, b - shift, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


def _stretches_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every stretch of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _smallest(runs: list[Runs]) -> Runs:
    """One run for each pair of bounds, the one of least period, by start and period."""
    start, end, period = (np.concatenate(x) for x in zip(*runs)) if runs else (np.zeros(0, dtype=np.int64),) * 3
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    fresh = np.ones(len(start), dtype=bool)
    fresh[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[fresh], end[fresh], period[fresh]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _scan(hashes: np.ndarray, owner: np.ndarray, lag: int, least: int) -> Runs:
    """Runs of which ``lag`` is a period."""
    start, end = _stretches_of((hashes[lag:] == hashes[:-lag]) & (owner[lag:] == owner[:-lag]))
    end = end + lag
    long = end - start >= max(least, 2 * lag)
    return start[long], end[long], np.full(long.sum(), lag)


def _periodic(runs: Runs, n: int, k: int) -> np.ndarray:
    """Positions of the k-grams that have a period of at most k / 2, from the runs of such periods."""
    start, end, period = runs
    deep = (2 * period <= k) & (end - start >= k)
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, start[deep], 1)
    np.add.at(edge, end[deep] - k + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _minimizer_pairs(value: np.ndarray, position: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances of equal values low to high - 1 apart."""
    order = np.lexsort((position, value))
    value, position = value[order], position[order]
    at, lag, ahead = [], [], 1
    while ahead < len(value):
        near = (value[ahead:] == value[:-ahead]) & (position[ahead:] - position[:-ahead] < high)
        if not near.any():
            break
        gap = (position[ahead:] - position[:-ahead])[near]
        far = gap >= low
        at.append(position[:-ahead][near][far])
        lag.append(gap[far])
        ahead += 1
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(at), np.concatenate(lag)) if at else (none, none)


def _hidden_seeds(runs: Runs, k: int, width: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds for runs whose first period lies in a run of a period of at most k / 2: see the module's text."""
    at, lag = [], []
    for start, end, period in zip(*(x.tolist() for x in runs)):
        if 2 * period > k or end - start < k:
            continue
        first = -(-max(start, end - high - period - width) // width) * width
        for i in range(first, end - k + 1, width):
            lags = np.arange(max(low, end - period - i), high)  # shorter ones stay inside the run of that period
            at.append(np.full(len(lags), i))
            lag.append(lags)
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(at), np.concatenate(lag)) if at else (none, none)


def find_runs(hashes: np.ndarray, first: np.ndarray, least: int = MIN_LENGTH, short: int = SHORT) -> Runs:
    """All runs of the texts whose words have these hashes, text i being hashes[first[i]:first[i + 1]]."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    short = max(short, 2 * least)  # so that what a scale takes for periodic is among the runs found before it
    found = [_scan(hashes, owner, lag, least) for lag in range(1, min(short, len(hashes)))]
    longest = int(np.diff(first).max(initial=0))
    if longest < 2 * short:
        return _smallest(found)
    stretches, low = Stretches(hashes), short
    bound_low, bound_high = first[owner], first[owner + 1]
    while 2 * low <= longest:
        high, k = 2 * low, low // 2
        width = low - k  # k-grams in a window
        n = len(hashes) - k + 1
        known = _smallest(found)
        whole = owner[:n] == owner[k - 1:]
        masked = _periodic(known, len(hashes), k)[:n]
        grams = np.arange(n)
        value = range_hashes(hashes, grams, grams + k, WORD_BASE)
        value = np.where(value == NEVER, np.uint64(0), value)
        seen = np.where(whole & ~masked, value, NEVER)
        least_of = sliding(seen, width, np.minimum)
        inside = owner[:len(least_of)] == owner[low - 2:low - 2 + len(least_of)]  # windows within one text
        least_of = np.where(inside, least_of, np.uint64(0))
        chosen = np.flatnonzero(_chosen(seen, least_of, width) & (seen != NEVER))
        at, lag = _minimizer_pairs(mix(value[chosen] ^ mix(owner[chosen].astype(np.uint64))), chosen, low, high)
        hidden_at, hidden_lag = _hidden_seeds(known, k, width, low, high)
        at, lag = np.concatenate([at, hidden_at]), np.concatenate([lag, hidden_lag])
        ok = at + lag < bound_high[at]
        at, lag = at[ok], lag[ok]
        ok = hashes[at] == hashes[at + lag]
        at, lag = at[ok], lag[ok]
        after = stretches.common(at, at + lag, bound_high[at] - at - lag)
        before = stretches.common(at, at + lag, at - bound_low[at], back=True)
        long = (after + before >= lag) & (after + before + lag >= least)
        found.append((at[long] - before[long], at[long] + lag[long] + after[long], lag[long]))
        low = high
    return _smallest(found)


def _chosen(seen: np.ndarray, least_of: np.ndarray, width: int) -> np.ndarray:
    """Places whose value is the minimum of a window that holds them."""
    # A value is at least the minimum of each window that holds it, so it is one of them if it equals the greatest.
    padded = np.zeros(len(least_of) + 2 * (width - 1), dtype=np.uint64)
    padded[width - 1:width - 1 + len(least_of)] = least_of
    return sliding(padded, width, np.maximum)[:len(seen)] == seen


def dropped(runs: Runs, n: int) -> np.ndarray:
    """Words that lie in a run after its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, runs[0] + runs[2], 1)
    np.add.at(edge, runs[1], -1)
    return np.cumsum(edge[:-1]) > 0


def with_runs(docs: DataFrame, text: str = "text", least: int = MIN_LENGTH) -> DataFrame:
    """``docs`` with runs (start word, length, period; by start, then period) and collapsed: the words that are in no run
    after its first period, joined by one space."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = Texts(part.column("text"))
                runs = find_runs(texts.hashes, texts.first, least)
                keep = ~dropped(runs, len(texts.hashes))
                of = np.searchsorted(texts.first, runs[0], side="right") - 1  # of equal bounds the last text holds the word
                parts = [runs[0] - texts.first[of], runs[1] - runs[0], runs[2]]
                fields = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in parts], ["start", "length", "period"])
                offsets = np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(offsets), fields)
                left = [texts.words(d, keep[texts.first[d]:texts.first[d + 1]]) for d in range(len(texts))]
                collapsed = pa.array(left, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("row"), listed, collapsed], ["row", "runs", "collapsed"])

    names = [c for c in docs.columns if c not in ("runs", "collapsed")]
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    packed = docs.select(row.alias("row"), F.col(f"`{text}`").alias("text"))
    run = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])
    schema = T.StructType([packed.schema["row"], T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())])
    done = packed.mapInArrow(work, schema)
    return done.select(*[F.col(f"row.`{c}`").alias(c) for c in names], "runs", "collapsed")


def planted(doc_id: Column, text: Column) -> Column:
    """The query's text: for a tenth of the ids, by checksum, a stretch of words is repeated up to the end."""
    check = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(check / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        start = F.pmod(g, n)
        period = 1 + F.floor((n - start) / (3 + F.pmod(g, F.lit(8))))
        base = F.slice(words, (start + 1).cast("int"), period.cast("int"))
        times = F.ceil((n - start) / period).cast("int")
        again = F.slice(F.flatten(F.array_repeat(base, times)), 1, (n - start).cast("int"))
        return F.array_join(F.concat(F.slice(words, 1, start.cast("int")), again), " ")

    changed = bound(word_array(text), lambda words: F.when(F.size(words) > 0, repeated(words)).otherwise(""))
    return F.when(F.pmod(check, F.lit(10)) == 0, changed).otherwise(text)


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = with_runs(docs).select("doc_id", "runs", "collapsed")
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
                              r["period"].cast("string"), F.lit("\n"))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), "runs", "collapsed")
    return rows.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
