"""Periodic runs against brute force."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditloom.llm import periodic_runs
from tests.llm.common import corpus, documents, odd_rows, words


def brute_runs(seq, least=12):
    """(start, length, period) of every run, by comparing the sequence with each shift of itself."""
    bounds = {}
    for p in range(1, len(seq) // 2 + 1):
        at = 0
        while at + p < len(seq):
            if seq[at] != seq[at + p]:
                at += 1
                continue
            end = at
            while end + p < len(seq) and seq[end] == seq[end + p]:
                end += 1
            if end + p - at >= max(least, 2 * p):
                bounds.setdefault((at, end + p), p)
            at = end
    return sorted((s, e - s, p) for (s, e), p in bounds.items())


def runs_of(seqs, **more):
    code = {}
    flat = np.array([code.setdefault(x, periodic_runs.mix(np.array([len(code) + 1], dtype=np.uint64))[0]) for s in seqs for x in s], dtype=np.uint64)
    first = np.concatenate([[0], np.cumsum([len(s) for s in seqs])]).astype(np.int64)
    start, end, period = periodic_runs.find_runs(flat, first, **more)
    out = [[] for _ in seqs]
    for s, e, p in zip(start.tolist(), end.tolist(), period.tolist()):
        of = int(np.searchsorted(first, s, side="right")) - 1
        out[of].append((s - int(first[of]), e - s, p))
    return [sorted(x) for x in out]


def morphic(rule, n, seed="a"):
    text = seed
    while len(text) < n:
        text = "".join(rule[c] for c in text)
    return text[:n]


def test_find_runs():
    rng = np.random.default_rng(5)
    seqs = ["", "a", "ab" * 6, "a" * 11, "a" * 12, "a" * 700]
    seqs += [morphic({"a": "ab", "b": "a"}, 900), morphic({"a": "ab", "b": "ba"}, 900), morphic({"a": "aab", "b": "ab"}, 700)]
    seqs += ["aab" * m + "a" + "aab" * k + "a" + "aab" * m for m, k in [(9, 9), (30, 30), (31, 60), (60, 20)]]  # hidden in a shorter run
    for _ in range(60):
        size, letters = int(rng.integers(50, 700)), int(rng.choice([2, 2, 3, 20]))
        text = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz")[:letters], size))
        for _ in range(int(rng.integers(0, 4))):  # plant repetitions, one inside another
            at, p = int(rng.integers(0, len(text))), int(rng.integers(1, 120))
            text = text[:at] + (text[at:at + p] * 9)[:int(p * rng.uniform(2, 5))] + text[at:]
            if rng.random() < 0.3:
                spot = int(rng.integers(0, len(text)))
                text = text[:spot] + "z" + text[spot + 1:]
        seqs.append(text[:1500])
    for least, short in ((12, 24), (4, 8)):
        assert runs_of(seqs, least=least, short=short) == [brute_runs(s, least) for s in seqs]


def test_long_text():
    """Half a million words in few periods: work stays near linear."""
    unit = [f"u{i}" for i in range(70001)]
    seq = (unit * 5)[:300007] + ["la"] * 100000 + ["x", "y", "z"] * 40000
    assert runs_of([seq])[0] == [(0, 300007, 70001), (300007, 100000, 1), (400007, 120000, 3)]


def repeated(doc_id, tokens):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(tokens), h // 10
    if h % 10 or not n:
        return tokens
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [tokens[i] if i < a else tokens[a + (i - a) % p] for i in range(n)]


def contract(doc_id, tokens):
    tokens = repeated(doc_id, tokens)
    runs = brute_runs(tokens)
    gone = set()
    for s, length, p in runs:
        gone.update(range(s + p, s + length))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    shown = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    kept = " ".join(w for i, w in enumerate(tokens) if i not in gone)
    return (doc_id, len(runs), *shown, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(kept))


@pytest.mark.parametrize("rows", [corpus(4), odd_rows(), []], ids=["corpus", "odd", "none"])
def test_query(spark, tmp_path, rows):
    rows = [r for r in rows if len(words(r[1])) < 5000] + [(1000 + i, t, s) for i, (_, t, s) in enumerate(rows) if len(words(t)) < 400]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic_runs.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((contract(d, words(t)) for d, t, _ in rows), key=repr)


def test_general_use(spark):
    """Columns that clash, a renamed text column, and the texts and runs themselves."""
    docs = documents(spark, [(1, "x " + "la di " * 9 + "y", "s"), (2, None, "s")]).withColumn("runs", F.lit(7)).withColumnRenamed("text", "body")
    out = periodic_runs.with_runs(docs, "body")
    assert out.columns == [c for c in docs.columns if c != "runs"] + ["runs", "collapsed"]
    got = {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed, r.row) for r in out.collect()}
    assert got == {1: ([(1, 18, 2)], "x la di y", "row"), 2: ([], "", "row")}
