"""Small tables for the operators' tests."""

import re

import numpy as np
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = ["doc", "text_key", "key", "n", "at", "row", "words", "label", "node", "kept_id", "gone_id", "mix_id", "kept", "score", "size"]


def words(text):
    return WORD.findall(text or "")


def prose(rng, n, vocabulary=4000):
    return [f"w{i:x}" for i in rng.integers(0, vocabulary, n)]


def documents(spark, rows, extra=True):
    """rows of (doc_id, text, source); with columns whose names the operators use inside."""
    df = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows],
                               "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(c) for c in EXTRA}) if extra else df


def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows, one id with two texts, odd characters, a long text."""
    long = " ".join(f"t{i}" for i in range(30000))
    text = " ".join(f"p{i}" for i in range(120))
    return [
        (1, None, "a"), (2, "", "a"), (3, " \n\t \x0b", None), (4, text, None), (4, text, None), (5, text, "b"),
        (None, text, "b"), (None, None, None), (6, text + " tail", "b"), (7, long, "a"), (8, "x\x1cy\x85z é漢 😀", "c"),
        (9, "one", "c"), (9, "two", "c"), (10, "same " * 3000, "a"), (11, "z" * 50000, "c"), (12, "\n".join([text] * 4), "a"),
    ]


def near(rng, tokens, share):
    out = list(tokens)
    for i in rng.choice(len(out), max(1, int(share * len(out))), replace=False):
        out[i] = f"changed{rng.integers(1 << 30)}"
    return out


def corpus(seed=3):
    """Copies, near copies, shared passages and plain documents, as (doc_id, text, source)."""
    rng = np.random.default_rng(seed)
    passage, rows = prose(rng, 70), []
    for i in range(60):
        kind, tokens = i % 6, prose(rng, int(rng.integers(15, 260)))
        if kind == 1 and rows:
            tokens = words(rows[int(rng.integers(len(rows)))][1])
        elif kind == 2 and rows:
            tokens = words(rows[int(rng.integers(len(rows)))][1])
            tokens = near(rng, tokens, 0.01) if tokens else ["none"]
        elif kind == 3:
            cut = int(rng.integers(0, len(tokens)))
            a, b = sorted(rng.integers(0, 71, 2))
            tokens = tokens[:cut] + passage[a:b] + tokens[cut:]
        elif kind == 4:
            cut = int(rng.integers(0, len(tokens)))
            tokens = tokens[:cut] + passage + tokens[cut:]
        text = " ".join(tokens)
        text = re.sub(r"(\S+ ){9}\S+", lambda m: m.group(0) + "\n", text) if i % 2 else text
        rows.append((int(i * 7 % 61), text, f"s{i % 4}"))
    return rows


def removed_words(rows, least=50):
    """By brute force: per row, flags of the words under a window that also starts under a smaller id."""
    first = {}
    for d, t, _ in rows:
        w = words(t)
        for i in range(len(w) - least + 1):
            k = tuple(w[i:i + least])
            first[k] = min(first.get(k, 1 << 63), (1 << 63) - 1 if d is None else d)
    out = []
    for d, t, _ in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - least + 1):
            if first[tuple(w[i:i + least])] < ((1 << 63) - 1 if d is None else d):
                gone[i:i + least] = [True] * least
        out.append(gone)
    return out
