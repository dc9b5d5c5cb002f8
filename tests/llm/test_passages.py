"""Passage and near-duplicate operators against brute force."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import pyarrow as pa
from creditloom.llm import components, minhash_dedup, substring_dedup, suffix_dedup
from creditloom.llm.words import Texts, selected
from tests.llm.common import corpus, documents, near, odd_rows, prose, removed_words, words


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \n\tab\x0b\x1c\x85é漢", max_size=40)), max_size=6))
@settings(max_examples=150, deadline=None)
def test_words_of_texts(texts):
    got = Texts(pa.array(texts, pa.string()))
    assert [got.words(i).decode() for i in range(len(texts))] == [" ".join(words(t)) for t in texts]
    hashes = {}
    for t, a, b in zip(texts, got.first, got.first[1:]):
        for w, h in zip(words(t), got.hashes[a:b]):
            assert hashes.setdefault(w, h) == h
    assert len(set(hashes.values())) == len(hashes)


def test_equal_passages_hold_equal_selected_windows():
    rng = np.random.default_rng(1)
    shared = [f"s{i}" for i in rng.integers(0, 30, 50)]
    texts = [" ".join([f"x{i}" for i in rng.integers(0, 9, n)] + shared + [f"y{i}" for i in rng.integers(0, 9, 40)]) for n in (0, 3, 77)]
    got = Texts(pa.array(texts))
    start, value = selected(got, 8, 50)
    offsets = [{(s - got.first[i] - n, v) for s, v in zip(start, value) if got.first[i] + n <= s <= got.first[i] + n + 42}
               for i, n in enumerate((0, 3, 77))]
    assert offsets[0] & offsets[1] & offsets[2]


@pytest.mark.parametrize("rows", [corpus(3), odd_rows(), [], corpus(8) + odd_rows()], ids=["corpus", "odd", "none", "both"])
def test_repeated_passages(spark, rows):
    docs, gone = documents(spark, rows), removed_words(rows)
    kept = [[w for w, g in zip(words(t), flags) if not g] for (_, t, _), flags in zip(rows, gone)]
    want = sorted((str(d), len(words(t)), sum(g), sha(" ".join(k))) for (d, t, _), g, k in zip(rows, gone, kept))
    got = substring_dedup.deduped(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    # Neighbours in suffix order find all spans but, at most, a few of texts that overlap several earlier ones.
    found, wanted = 0, sum(map(sum, gone))
    left = sorted(((str(d), len(words(t)), flags) for (d, t, _), flags in zip(rows, gone)), key=lambda x: x[:2] + (sum(x[2]),))
    got = sorted(suffix_dedup.deduped(docs).collect(), key=lambda r: (str(r.doc_id), r.n_words, r.n_removed))
    for r, (d, n, flags) in zip(got, left):
        mine = {i for a, b in r.spans for i in range(a, b)}
        assert (str(r.doc_id), r.n_words, r.n_removed) == (d, n, len(mine)) and all(flags[i] for i in mine)
        found += len(mine)
    assert len(got) == len(rows) and found >= 0.98 * wanted


def test_planted_passages(spark):
    """Passages set into otherwise different texts are found whole, however many share them."""
    rng = np.random.default_rng(12)
    passages, rows = [prose(rng, n) for n in (50, 57, 130)], []
    for i in range(200):
        before, after = ([f"own{i}x{j}" for j in range(int(n))] for n in rng.integers(0, 90, 2))
        rows.append((i, " ".join(before + passages[i % 3] + after), "s"))
    gone = removed_words(rows)
    got = {r.doc_id: [tuple(x) for x in r.spans] for r in suffix_dedup.deduped(documents(spark, rows)).collect()}
    for (d, _, _), flags in zip(rows, gone):
        edges = np.flatnonzero(np.diff([0, *map(int, flags), 0]))
        assert got[d] == [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]


def exact_spans(spark, rows):
    got = {r.doc_id: [tuple(x) for x in r.spans] for r in suffix_dedup.deduped(documents(spark, rows)).collect()}
    for (d, _, _), flags in zip(rows, removed_words(rows)):
        edges = np.flatnonzero(np.diff([0, *map(int, flags), 0]))
        assert got[d] == [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])], d


def test_passages_on_both_sides_of_a_partition_boundary(spark):
    """Pairs of passages that end with one phrase; an earlier document has the phrase alone."""
    rng, name = np.random.default_rng(14), "spark.sql.adaptive.enabled"
    # A phrase whose hash lies below that of all other windows of its passages, so that it is their only kept position.
    phrases = [" ".join(f"p{i}x{j}" for j in range(8)) for i in range(20000)]
    value = Texts(pa.array(phrases)).windows(8)[1]
    phrase = phrases[int(value.argmin())].split()
    tail = lambda: [f"t{x}" for x in rng.integers(0, 1 << 40, 20)]
    rows = [(0, " ".join(["alone"] + phrase + tail()), "s")]
    for i in range(150):
        passage = [f"q{i}x{j}" for j in range(42)] + phrase
        rows += [(1 + i, " ".join(passage + tail()), "s"), (1000 + i, " ".join(passage + tail()), "s")]
    spark.conf.set(name, "false")
    try:
        exact_spans(spark, rows)
    finally:
        spark.conf.set(name, "true")


def test_passage_that_no_neighbour_shares(spark):
    """One document shares more to the right, one more to the left, and a third one the passage; then many at random."""
    rng = np.random.default_rng(15)
    text = [f"c{j}" for j in range(100)]
    rows = [(i, " ".join([f"a{i}"] + text[50 - low:50 + high] + [f"b{i}"]), "s")
            for i, (low, high) in enumerate([(4, 44), (44, 4), (10, 39), (39, 10), (30, 30), (30, 28), (28, 30), (50, 50)])]
    exact_spans(spark, rows)
    texts = [[f"c{k}x{j}" for j in range(200)] for k in range(2)]
    rows = []
    for i in range(150):
        at, n = int(rng.integers(0, 140)), int(rng.integers(40, 62))
        rows.append((i, " ".join([f"a{i}"] + texts[i % 2][at:at + n] + [f"b{i}"]), "s"))
    exact_spans(spark, rows)


def test_levels_below_the_first_pair(spark):
    rows = corpus(5)
    docs, gone = documents(spark, rows), removed_words(rows, 48)
    got = substring_dedup.deduped(docs, (12, 24, 48)).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == sorted((d, sum(g)) for (d, _, _), g in zip(rows, gone))


def similarity(a, b):
    """Probability Jaccard by its definition; for plain sets that is the Jaccard similarity."""
    if {*a.values(), *b.values()} == {1}:
        return len(a.keys() & b.keys()) / len(a.keys() | b.keys())
    both = [x for x in a if x in b]
    every = set(a) | set(b)
    return sum(1 / sum(max(a.get(y, 0) / a[x], b.get(y, 0) / b[x]) for y in every) for x in both)


def bag(text):
    w = words(text)
    parts = [tuple(w[i:i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])
    return {p: parts.count(p) for p in set(parts)}


def classes(rows, least=0.8):
    bags, name = [bag(t) for _, t, _ in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j] and name[i] != name[j] and similarity(bags[i], bags[j]) >= least:
                name = [name[j] if x == name[i] else x for x in name]
    low = {}
    for (d, _, _), x in zip(rows, name):
        low[x] = min(low.get(x, 1 << 63), (1 << 63) - 1 if d is None else d)
    return [low[x] for x in name]


@pytest.mark.parametrize("rows", [corpus(3), [r for r in odd_rows() if r[1] != "two"], []], ids=["corpus", "odd", "none"])
def test_near_classes(spark, rows):
    small = [r for r in rows if len(words(r[1])) < 1000]
    got = minhash_dedup.near_classes(documents(spark, small)).collect()
    assert sorted((r.doc, r.class_doc) for r in got) == sorted(((1 << 63) - 1 if d is None else d, c) for (d, _, _), c in zip(small, classes(small)))
    left = minhash_dedup.one_of_each(documents(spark, small))
    assert left.columns == documents(spark, small).columns
    named = [c for (d, t, _), c in zip(small, classes(small)) if words(t)]
    assert sorted(r.doc_id for r in left.collect() if words(r.text) and r.doc_id is not None) == sorted(c for c in set(named) if c < (1 << 63) - 1)


def test_registers_estimate_similarity():
    a, b = {f"{i}": 1 + i % 3 for i in range(60)}, {f"{i}": 1 + i % 2 for i in range(20, 75)}
    value = {x: np.uint64(hash(("v", i)) & ((1 << 63) - 1)) for i, x in enumerate(sorted(set(a) | set(b)))}
    owner = np.repeat([0, 1], [len(a), len(b)])
    got = minhash_dedup.signatures(owner, np.array([value[x] for x in [*a, *b]]), np.array([*a.values(), *b.values()], float), 2, 8192)
    assert abs((got[0] == got[1]).mean() - similarity(a, b)) < 0.03
    packed = [np.sort(np.concatenate([np.full(n, value[x] >> np.uint64(32), np.uint32) for x, n in s.items()])).tobytes() for s in (a, b)]
    assert abs(minhash_dedup.similarity(*packed)[0] - similarity(a, b)) < 1e-9


def test_bands_with_several_classes(spark):
    """The last pairs of a band with many classes, and the components of links."""
    rng = np.random.default_rng(4)
    kinds = ("band long, node long, label long, members long, r double, n long, own long, plain boolean, "
             "centre long, s double, both int")
    texts = {i: [f"g{i % 7}w{j}" for j in range(30)] + [f"own{i}"] * (i >= 350) * 30 for i in range(400)}  # seven groups, and 50 apart
    bags = {i: np.array([np.uint32(zlib.crc32(w.encode())) for w in t], np.uint32) for i, t in texts.items()}
    bag = spark.createDataFrame([(i, bytearray(np.sort(b).tobytes())) for i, b in bags.items()], "node long, bag binary")
    rows = spark.createDataFrame([(band, i, i, 400, 0.0, len(set(texts[i])), 0, False, None, None, None) for band in (1, 2) for i in range(400)], kinds)
    got = {tuple(r) for r in minhash_dedup._block_links(rows, bag, 0.8).collect()}
    assert all(a < b < 350 and a % 7 == b % 7 for a, b in got)
    joined = components.components(spark.createDataFrame(list(got), "a long, b long")).collect()
    assert {(r.node, r.label) for r in joined} == {(i, i % 7) for i in range(350)}
    assert len(got) < 400 * 399 / 2 / 7 / 5  # a few links for each two blocks, not all pairs
    none = minhash_dedup._block_links(rows.withColumn("label", F.col("node") % 7).where("node < 350"), bag, 0.8)
    assert none.count() == 0
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(400, 460)]
    name = {}
    for a, b in edges:
        x, y = name.setdefault(a, a), name.setdefault(b, b)
        name = {k: min(x, y) if v in (x, y) else v for k, v in name.items()}
    got = components.components(spark.createDataFrame([e for e in edges if e[0] != e[1]], "a long, b long"))
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert {(r.node, r.label) for r in got.collect()} == {(k, v) for k, v in name.items() if k in linked}


def test_components_of_labels_take_no_step(spark, monkeypatch):
    """Stars around their least nodes, as labels are, are stored once and left; one further link costs a step, not all over again."""
    stored, settled = [], components.settled
    monkeypatch.setattr(components, "settled", lambda df: stored.append(settled(df)) or stored[-1])

    def found(edges):
        stored.clear()
        frame = spark.createDataFrame(edges, "a long, b long")
        out = {(r.node, r.label) for r in components.components(frame).collect()}
        assert len({n for n, _ in out}) == len(out)
        return out, len(stored)

    stars = [(c, c + 10 * i) for c in range(10) for i in range(40)]  # with a == b, as in labels
    assert found(stars) == ({(n, n % 10) for n in range(400)}, 1)
    assert found([]) == (set(), 1)
    turned = found([(399, i) for i in range(398, 300, -1)])
    assert turned == ({(i, 301) for i in range(301, 400)}, 2)
    joined, steps = found(stars + [(391, 392)])
    assert joined == {(n, 1 if n % 10 == 2 else n % 10) for n in range(400)} and steps <= 3


def test_bounds_rule_out_no_link(spark):
    """Many near copies with edits of their own and shared ones: classes as by brute force."""
    rng = np.random.default_rng(21)
    base = prose(rng, 120)
    shared = [near(rng, base, 0.04) for _ in range(4)]
    rows = [(i, " ".join(near(rng, shared[i % 4] if i % 3 else base, float(rng.choice([0.01, 0.02, 0.04, 0.06])))), "s") for i in range(150)]
    got = minhash_dedup.near_classes(documents(spark, rows)).collect()
    assert sorted((r.doc, r.class_doc) for r in got) == sorted((d, c) for (d, _, _), c in zip(rows, classes(rows)))
    assert 1 < len(set(classes(rows))) < 150
