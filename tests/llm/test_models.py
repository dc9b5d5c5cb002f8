"""Encoding, mixing, the quality model and top-k search: exact round trips, brute force, held-out accuracy."""

import zlib

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from check import compare
from creditloom.llm import knn_join, mixing, quality_model, sentencepiece_fst
from tests.llm.common import corpus, documents, odd_rows, words

SMALL = "/root/testdata/sf0.01"


def test_ids_are_the_librarys(spark):
    rng = np.random.default_rng(0)
    texts = ["Hello  wor\nld é\t漢\x00  x ﬁ", " ", "   a", "▁x ▁▁ y", "<s> <0x0A> <unk>", "a" * 300 + "  " + "ab" * 200, "😀👍🏽 x", " " * 50 + "x"]
    texts += ["".join(rng.choice(list("ab e▁ tion.()x\né漢"), rng.integers(1, 400))) for _ in range(60)]
    texts += ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(90, 400))) for _ in range(20)]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(100 + (r[0] or 0), *r[1:]) for r in odd_rows()]
    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.default_model())
    coded = sentencepiece_fst.encoded(documents(spark, rows))
    got = coded.collect()
    assert sorted((r.doc_id, list(r.token_ids)) for r in got) == sorted((d, model.encode(t) if t else []) for d, t, _ in rows)
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in got)
    back = sorted((r.doc_id, r.text) for r in sentencepiece_fst.decoded(coded).collect())
    assert back == sorted((d, (t or "").replace("▁", " ")) for d, t, _ in rows)
    assert sentencepiece_fst.encoded(documents(spark, [])).count() == 0


def check_mix(rows, got, exact=0.02):
    sizes, names = {}, sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, free = {}, set(names)
    while free:  # water level: one stopped source at a time
        left = sum(sizes.values()) - sum(goal.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            goal |= share
            break
        goal[over[0]] = 3.0 * sizes[over[0]]
        free.discard(over[0])
    taken = dict.fromkeys(names, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) < 1e-6 * max(1, goal[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - goal[s]) <= max(exact * goal[s], 3), (s, taken[s], goal[s])


def test_mixing(spark):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 300))), "ab"[i % 2] if i % 7 else None) for i in range(150)]
    rows += [(500, "only few words", "c"), (501, None, "d"), (7, rows[7][1], rows[7][2]), (None, "x y z", "a")]
    docs = documents(spark, rows)
    got = mixing.mixed(docs).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(d), len(words(t))) for d, t, _ in rows)
    check_mix(rows, got)
    again = mixing.mixed(docs.repartition(5)).collect()
    assert sorted((str(r.doc_id), r.taken) for r in got) == sorted((str(r.doc_id), r.taken) for r in again)
    out = mixing.mix_documents(docs.where("doc_id <> 7"))
    assert out.columns == docs.columns
    plan = {r.doc_id: r.taken for r in mixing.mixed(docs.where("doc_id <> 7")).collect() if r.taken}
    words_out = {}
    for r in out.collect():
        words_out[r.doc_id] = words_out.get(r.doc_id, 0) + len(words(r.text))
        assert r.n_chars == len(r.text)
    assert words_out == plan
    assert mixing.mixed(documents(spark, [])).count() == 0 and mixing.mix_documents(documents(spark, [])).count() == 0
    assert mixing.mixed(documents(spark, [(1, None, None), (2, "", "a")])).agg(F.sum("taken")).first()[0] == 0


def brute_mix(rows, stream):
    """Words taken per row, slot by slot: each golden-ratio point names a source, whose next block of words it takes."""
    spans, plan = {}, {}
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = {s: sum(len(words(t)) for _, t, x in rows if x == s) for s in names}
    goal = mixing.targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    for s, t in zip(names, goal):
        plan[s] = (t, min(4096, max(1, int(t // 1000))))
    for i, (_, t, s) in stream:
        n = len(words(t))
        start = spans[s][-1][2] if spans.get(s) else 0
        spans.setdefault(s, []).append((i, start, start + n))
    blocks = [t / b for t, b in plan.values()]
    bounds, rank, taken = np.cumsum(blocks) / max(sum(blocks), 1e-300), dict.fromkeys(names, 0), [0] * len(rows)
    for slot in range(int(np.ceil(sum(blocks)))):
        s = names[min(int(np.searchsorted(bounds, (slot + 1) * mixing.GOLDEN % 1.0, side="right")), len(names) - 1)]
        low, high = rank[s] * plan[s][1], (rank[s] + 1) * plan[s][1]
        rank[s] += 1
        for again in range(3):
            for i, a, b in spans.get(s, []):
                taken[i] += max(0, min(b + again * sizes[s], high) - max(a + again * sizes[s], low))
    return taken, rank, plan


def test_mixing_slot_by_slot(spark):
    """Every document's words, with a source of one word, one of null and a large one; very long texts; few slots."""
    rng = np.random.default_rng(16)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 80))), "ab"[i % 2] if i % 7 else None) for i in range(60)]
    rows += [(100, "single", "c"), (101, "w " * 50000, "a"), (102, "w " * 30000, "d"), (103, "", "c")]
    docs = documents(spark, rows)
    draws = docs.select("doc_id", F.xxhash64(F.lit(mixing.SEED), "doc_id", mixing.text_key(F.col("text"))).alias("draw")).collect()
    draw = {r.doc_id: r.draw for r in draws}
    taken, slots, plan = brute_mix(rows, sorted(enumerate(rows), key=lambda x: (draw[x[1][0]], x[1][0])))
    got = {r.doc_id: r.taken for r in mixing.mixed(docs).collect()}
    assert got == {d: n for (d, *_), n in zip(rows, taken)}
    check_mix(rows, mixing.mixed(docs).collect())
    assert sum(slots.values()) < sum(t for t, _ in plan.values()) / 15  # though one source has a single word


def test_slots_do_not_follow_the_smallest_source(spark):
    plan = [(0, "a", 10 ** 9, 1e9), (1, "b", 10 ** 9, 1e9), (2, "c", 1, 3.0)]
    n = mixing.schedule(spark, plan).groupBy("place").count().collect()
    assert sum(r["count"] for r in n) <= 2e9 / mixing.MAX_BLOCK + 10
    assert abs({r["place"]: r["count"] for r in n}.get(2, 0) - 3) <= 3


@pytest.mark.parametrize("sizes,weights", [([10, 10, 10], [5, 2, 1]), ([1, 100, 50], [5, 2, 1]), ([0, 0], [1, 1]), ([1, 1, 1, 500], [5, 5, 5, 1])])
def test_targets(sizes, weights):
    got = mixing.targets(sizes, weights)
    assert all(t <= 3 * s + 1e-9 for s, t in zip(sizes, got)) and abs(sum(got) - sum(sizes)) < 1e-9 * max(1, sum(sizes))
    open_ = [t / w for s, t, w in zip(sizes, got, weights) if t < 3 * s - 1e-9]
    assert not open_ or max(open_) - min(open_) < 1e-9 * max(open_)


def area(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_model.classify(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    score, label = np.array([r.score for r in held]), np.array([r.quality for r in held])
    assert area(score, label) > 0.9
    assert ((score >= 0.5) == label).mean() > 0.9


def test_quality_of_odd_rows(spark):
    rows = odd_rows() + [(100 + r[0], *r[1:]) for r in corpus(2)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100, 160)], "doc_id long, quality int, toxic int")
    got = quality_model.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    none = quality_model.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_model.classify(documents(spark, []), labels).count() == 0


def test_scores_by_direct_fit(spark):
    """Every row's score from a direct kernel map, ridge solution and isotonic curve over all training rows at once."""
    rng = np.random.default_rng(19)
    rows = corpus(7) + [(100 + i, " ".join(rng.choice(["good", "Word", "x1", "#", "end.", "é"], int(rng.integers(1, 90)))), "s") for i in range(240)]
    rows += [(400, None, "s"), (401, "", "s"), (402, "w " * 30000, "s")]
    docs = documents(spark, rows)
    labels = [(d, int((t or "").count("#") * 5 < len(words(t)))) for d, t, _ in rows if d % 3]
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality_model.classify(docs, table).collect()}

    stats = {r.doc_id: np.array(r.stats) for r in quality_model.statistics(docs).collect()}
    ids = [d for d, _ in labels if zlib.crc32(str(d).encode()) % 4 != 2]
    draw = {r.doc_id: r.draw for r in docs.select("doc_id", F.pmod(F.xxhash64(F.lit(quality_model.SEED), "doc_id"), F.lit(1_000_000)).alias("draw")).collect()}
    x, y = np.array([stats[d] for d in ids]), np.array([dict(labels)[d] for d in ids], dtype=float)
    calibrates = np.array([draw[d] % 5 == 0 for d in ids])
    random = np.random.default_rng(quality_model.SEED)
    many, width = quality_model.FEATURES, x.shape[1]
    directions, phases = random.normal(scale=width ** -0.5, size=(width, many)), random.uniform(0, 2 * np.pi, many)
    spread = x.std(0)

    def wave(s):
        z = np.clip((s - x.mean(0)) / np.where(spread > 1e-12, spread, 1), -quality_model.LIMIT, quality_model.LIMIT)
        return np.append(np.sqrt(2 / many) * np.cos(z @ directions + phases), 1.0)

    phi = np.array([wave(s) for s in x[~calibrates]])
    n = len(phi)
    # Ridge as least squares of rows with the penalty's rows below them.
    penalty = np.sqrt(n * quality_model.RIDGE / many) * np.eye(many + 1)
    weights = np.linalg.lstsq(np.concatenate([phi, penalty]), np.concatenate([y[~calibrates], np.zeros(many + 1)]), rcond=None)[0]
    raw = np.array([np.clip(wave(s) @ weights, -0.5, 1.5) for s in x[calibrates]])
    step = 2 / (quality_model.BINS - 1)
    at = np.round((raw + 0.5) / step) * step - 0.5
    places = np.unique(at)
    mean = lambda a, b: y[calibrates][(at >= places[a]) & (at <= places[b])].mean()
    value = [max(min(mean(a, b) for b in range(i, len(places))) for a in range(i + 1)) for i in range(len(places))]
    level = np.unique(np.round(value, 12))
    of_point = np.round([value[int(np.searchsorted(places, p))] for p in at], 12)
    centre = [at[of_point == v].mean() for v in level]
    want = {d: np.clip(np.interp(wave(s) @ weights, centre, level), 0, 1) for d, s in stats.items()}
    assert len(level) > 1 and got.keys() == want.keys()
    assert max(abs(got[d] - want[d]) for d in got) < 2e-6


def test_isotonic_curve_rises():
    rng = np.random.default_rng(1)
    n = rng.integers(1, 9, 200).astype(float)
    at, value = quality_model.pooled(np.arange(200.0), n, rng.binomial(n.astype(int), np.linspace(0, 1, 200)).astype(float))
    assert (np.diff(value) > 0).all() and (np.diff(at) > 0).all()


def brute_top(rows, k):
    good = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, u in good:
        if q % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(u, v)), i) for i, v in good if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"group_queries": 3, "chunk_points": 20, "max_pivots": 9}], ids=["plain", "split"])
def test_top_k(spark, sizes):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 5)) * 2
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] + rng.normal(size=5) * 0.1]) for i in range(500)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)] + [(2000, [0.0] * 5), (2050, None), (2051, [None] * 5), (2052, [float("nan")] * 5)]
    rows += [(2100, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (2150, []), (2200, [0.5, -0.25]), (None, [1.0] * 5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("vec", "ids", "cell", "score", "rank")})
    data = knn_join.whole_vectors(table)
    got = knn_join.top_k(data, data.where("vec_id % 50 = 0"), **sizes).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute_top(rows, 5)


def test_top_k_of_few_rows(spark):
    for rows in ([], [(50, [1.0])], [(50, [1.0]), (51, [2.0])], [(1, [1.0])]):
        data = knn_join.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
        got = knn_join.top_k(data, data.where("vec_id % 50 = 0")).collect()
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute_top(rows, 5)


def test_top_k_of_repeated_ids(spark, tmp_path):
    """Ids that repeat one vector or several, among the queries and among the candidates."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 4)) * 2
    vector = lambda i, wide=0.1: [float(np.float32(x)) for x in centres[i % 6] + rng.normal(size=4) * wide]
    rows = [(i, vector(i)) for i in range(400)]
    rows += [(50, rows[50][1])] + [(100, [9.0 * x for x in rows[100][1]])] * 10 + [(7, rows[150][1])] * 8
    rows += [(200, [x * (1 + i / 64) for x in rows[200][1]]) for i in range(40)]
    rows += [(500 + i, rows[100][1]) for i in range(12)] + [(13, [20.0 * x for x in rows[13][1]])] * 7
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    data = knn_join.whole_vectors(table)
    want = brute_top(rows, 5)
    for sizes in ({}, {"group_queries": 3, "chunk_points": 20, "max_pivots": 30}):
        got = knn_join.top_k(data, data.where("vec_id % 50 = 0"), **sizes).collect()
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == want
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert compare(knn_join.op10_voronoi_topk(spark, str(tmp_path)), con.execute(knn_join.SQL)) == ""
