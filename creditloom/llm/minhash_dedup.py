"""MinHash near-dedup (operator 6): ProbMinHash signatures, banding, verification.

A document is the bag of its shingles of five words (one shingle of all words if there are fewer), weighted by how
often each occurs. Every shingle is a Poisson process with its weight as rate, driven by its hash; each arrival falls
on one of ``COMPONENTS`` registers and the first to arrive at a register is its value. Arrivals are made in rounds
for all shingles of a run of documents, and a shingle stops as soon as its next arrival is later than all its
document's registers. Two documents agree in a register with the probability Jaccard similarity of their bags.

Registers are cut in ``BANDS`` bands; at 0.8 a pair shares none with a chance of 5e-8. Candidates of a band are
verified on the exact similarity of their bags, and classes are the components of the verified links:

1. Every document is compared with the least, by hash, of its bands' centres: one pair for each.
2. Of the bands that still hold several classes, every document gets the share m of its bag that no other document
   left holds. With r = m / (1 - m), a pair's similarity is at most 1 / (1 + r + r'), so documents with r above
   1 / similarity - 1 have no link, and the centre is now the document with the least r, often the original.
3. Pairs left across classes are compared inside tasks that hold two blocks of a band with their bags; only links that
   join classes come out. Not compared are those that a bound rules out: the one above;
   for two documents with one centre, the triangle inequality (one minus the chance of equal registers is a metric);
   and for two of them without repeated shingles, that they can only share what each shares with the centre, and
   shingles outside of it that are not one document's own.

No pairs are made within a class, so a group of copies costs a link for each. Documents with the same words are one
node from the start. Labels, links and classes stay in tables.

Defined results: a document without words is a class of its own. Ids are ordered with null last, and a class is
named by its least id. Rows alike in id and text are one document. Extra columns are not read. Documents are told
apart by a 64-bit hash of their words, shingles of a bag by 32 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.base import packed, same, settled, table, text_key, unpacked
from creditloom.llm.components import components
from creditloom.llm.passages import NO_ID, _list, keyed, texts_of, whole_hashes
from creditloom.llm.words import Texts, mix, slices

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 4
COMPONENTS = BANDS * ROWS
BLOCK, BLOCK_BYTES, SLACK = 256, 8 << 20, 1e-9
ROUND = np.uint64(0xA0761D6478BD642F)  # fixed value: an odd constant that tells the rounds' random numbers apart


def shingles(texts: Texts, length: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of every shingle; a shorter text has one, of all its words."""
    start, value = texts.windows(length)
    owner = texts.owner()[start]
    short = np.flatnonzero((texts.counts > 0) & (texts.counts < length))
    whole = whole_hashes(texts)[0][short]
    return np.concatenate([owner, short]), np.concatenate([value, whole])


def weighted(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) with the number of times it occurs."""
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    fresh = np.ones(len(v), dtype=bool)
    fresh[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(fresh)
    return o[at], v[at], np.diff(np.append(at, len(v))).astype(float)


def signatures(owner: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, size: int = COMPONENTS) -> np.ndarray:
    """The registers of n documents: [document, register], the value that arrived first (0 for no document)."""
    first = np.full(n * size, np.inf)
    held = np.zeros(n * size, dtype=np.uint64)
    arrival, turn = np.zeros(len(value)), 0
    while len(value):
        turn += 1
        draw = mix(value ^ mix(np.array([turn], dtype=np.uint64) * ROUND))
        uniform = ((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0 ** -53
        arrival = arrival - np.log(uniform) / weight
        spot = owner * size + (mix(draw ^ ROUND) % np.uint64(size)).astype(np.int64)
        sooner = np.flatnonzero(arrival < first[spot])
        np.minimum.at(first, spot[sooner], arrival[sooner])
        won = sooner[arrival[sooner] == first[spot[sooner]]]
        held[spot[won]] = value[won]
        # Early termination: later arrivals of a shingle can't be first once all registers were reached before.
        go = arrival < first.reshape(n, size).max(1)[owner]
        if not go.all():
            owner, value, weight, arrival = owner[go], value[go], weight[go], arrival[go]
    return held.reshape(n, size)


def band_keys(registers: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One hash per band and document, the band's number in it."""
    n, size = registers.shape
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * ROUND, (n, 1))
    for part in np.moveaxis(registers.reshape(n, bands, size // bands), 2, 0):
        out = mix(out ^ part) * ROUND
    return mix(out)


Counted = tuple[np.ndarray, np.ndarray]


def counted(bag: bytes) -> Counted:
    """Distinct shingles of a bag (sorted 32-bit shingles with repeats) and how often each occurs."""
    return np.unique(np.frombuffer(bag, np.uint32), return_counts=True)


def similarity(a: bytes, b: bytes) -> tuple[float, int]:
    """Probability Jaccard similarity of two bags, and the number of shared shingles."""
    return similarity_of(counted(a), counted(b))


def similarity_of(a: Counted, b: Counted) -> tuple[float, int]:
    (x, p), (y, q) = a, b
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0, 0
    p_both, q_both = p[i].astype(float), q[j].astype(float)
    order = np.argsort(q_both / p_both, kind="stable")
    p_both, q_both = p_both[order], q_both[order]
    ratio = q_both / p_both
    only_p, only_q = p.sum() - p_both.sum(), q.sum() - q_both.sum()
    # For shingle d the denominator sums p(d') / p(d) where q(d') / p(d') is at most that of d, else q(d') / q(d).
    upto = np.searchsorted(ratio, ratio, side="right")
    p_sum, q_sum = np.concatenate([[0], np.cumsum(p_both)]), np.concatenate([[0], np.cumsum(q_both)])
    return float((1 / ((only_p + p_sum[upto]) / p_both + (only_q + q_sum[-1] - q_sum[upto]) / q_both)).sum()), len(i)


def signed(docs: DataFrame) -> DataFrame:
    """doc, text_key, doc_id, node (null without words), bands."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = Texts(part.column("text"))
                n = len(texts)
                keys = band_keys(signatures(*weighted(*shingles(texts)), n))
                some = texts.counts > 0
                node = pa.array(whole_hashes(texts)[0].view(np.int64), mask=~some)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), part.column("text_key"), part.column("doc_id"), node,
                     _list(keys[some].view(np.int64).ravel(), np.where(some, keys.shape[1], 0), pa.int64())],
                    ["doc", "text_key", "doc_id", "node", "bands"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return keyed(docs).mapInArrow(work, f"doc long, text_key long, doc_id {kind}, node long, bands array<long>")


def bags(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """node and bag (binary) of the chosen documents (doc, text_key, node)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = Texts(part.column("text"))
                owner, value = shingles(texts)
                value = (value >> np.uint64(32)).astype(np.uint32)
                order = np.lexsort((value, owner))
                bounds = np.searchsorted(owner[order], np.arange(len(texts) + 1))
                value = value[order]
                out = [value[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(out, pa.binary())], ["node", "bag"])

    return texts_of(docs, chosen).select("node", "text").mapInArrow(work, "node long, bag binary")


def compared(pairs: DataFrame, bag: DataFrame) -> DataFrame:
    """The pairs (a, b) with their similarity s and the number of shingles they share."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [similarity(a.as_py(), b.as_py()) for a, b in zip(batch.column("bag_a"), batch.column("bag_b"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array([s for s, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int32())],
                ["a", "b", "s", "both"])

    left = bag.select(F.col("node").alias("a"), F.col("bag").alias("bag_a"))
    right = bag.select(F.col("node").alias("b"), F.col("bag").alias("bag_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "bag_a", "bag_b").mapInArrow(work, "a long, b long, s double, both int")


def own_shares(bag: DataFrame) -> DataFrame:
    """node, r = m / (1 - m) with m the share of its bag that no other of the bags holds (null for m = 1), n (distinct
    shingles), own (those that no other holds) and plain (none is repeated)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                value, count = np.unique(np.frombuffer(batch.column("bag")[row].as_py(), np.uint32), return_counts=True)
                node = np.full(len(value), batch.column("node")[row].as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node), pa.array(value.astype(np.int64)), pa.array(count / count.sum())], ["node", "shingle", "share"])

    each = bag.select("node", "bag").mapInArrow(work, "node long, shingle long, share double")
    alone = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"), F.min("share").alias("share")).where("n = 1")
    mass = alone.groupBy("node").agg(F.sum("share").alias("m"), F.count(F.lit(1)).alias("own"))
    sizes = each.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    r = F.when(F.col("m").isNull(), 0.0).when(F.col("m") < 1 - SLACK, F.col("m") / (1 - F.col("m")))
    return bag.select("node", (F.octet_length("bag") / 4).alias("length")).join(sizes, "node").join(mass, "node", "left").select(
        "node", r.alias("r"), "n", F.coalesce("own", F.lit(0)).alias("own"), (F.col("n") == F.col("length")).alias("plain"))


def _centred(rows: DataFrame, order: Column) -> DataFrame:
    """node and centre: of the first documents, by ``order``, of a document's bands, the first that is of another class."""
    ranked = F.struct(order.alias("order"), F.col("node").alias("node"), F.col("label").alias("label"))
    centre = rows.groupBy("band").agg(F.min(ranked).alias("c"))
    far = rows.join(centre, "band").where(F.col("label") != F.col("c.label"))
    return far.groupBy("node").agg(F.min("c").alias("c")).select("node", F.col("c.node").alias("centre"))


def _pairs(centred: DataFrame) -> DataFrame:
    return centred.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()


def _possible(t: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Which of the pairs (i, j) of rows no bound rules out."""
    shared = np.minimum(t["both"][i], t["both"][j]) + np.minimum(t["outside"][i], t["outside"][j])
    enough = ~(t["plain"][i] & t["plain"][j]) | (shared * (1 + least) >= least * (t["n"][i] + t["n"][j]) - SLACK)
    apart = np.abs(t["s"][i] - t["s"][j])
    one_centre = t["centred"][i] & t["centred"][j] & (t["centre"][i] == t["centre"][j])
    near = ~one_centre | (apart <= 1 - least + SLACK) & enough
    return (t["label"][i] != t["label"][j]) & (t["r"][i] + t["r"][j] <= 1 / least - 1 + SLACK) & near


def _block_links(rows: DataFrame, bag: DataFrame, least: float) -> DataFrame:
    """Verified links (a, b) between the classes that meet in a band; members meet block by block, so no task holds a band.

    Two blocks of about BLOCK members, or of BLOCK_BYTES of bags if those are less, come together. Pairs that no bound rules out are verified in the
    task, but for those whose classes its own links have joined already, so at most one link less than there are members
    comes out of two blocks. A pair with several bands in common is looked at in the least of them.

    rows: band, node, label, r, n, own and plain as in own_shares, centre, s and both (similarity to the centre
    and shingles shared with it; the three are null without one).
    """

    def work(table: pa.Table) -> pa.Table:
        t = {c: table[c].to_numpy(zero_copy_only=False) for c in ("band", "node", "label", "block", "r", "n", "plain")}
        t["centred"] = pc.is_valid(table["centre"]).to_numpy(zero_copy_only=False)
        for c in ("centre", "s", "both", "outside"):
            t[c] = pc.fill_null(table[c], 0).to_numpy(zero_copy_only=False)
        i, j = np.triu_indices(table.num_rows, 1)
        if len(set(t["block"].tolist())) > 1:  # within a block they meet when it is alone
            across = t["block"][i] != t["block"][j]
            i, j = i[across], j[across]
        elif table["i"][0] != table["j"][0]:
            i, j = i[:0], j[:0]
        able = _possible(t, i, j, least)
        i, j = i[able], j[able]
        bands = [frozenset(x) for x in table["held"].to_pylist()] if len(i) else []
        bags = {x: counted(table["bag"][x].as_py()) for x in np.unique(np.concatenate([i, j])).tolist()}
        band, parent, out = t["band"][0] if len(i) else None, {}, []

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = up = parent[up]
                x = up
            return x

        for x, y in zip(i.tolist(), j.tolist()):
            one, other = root(int(t["label"][x])), root(int(t["label"][y]))
            if one == other or min(bands[x] & bands[y]) != band or similarity_of(bags[x], bags[y])[0] < least:
                continue
            parent[one] = other
            out.append(sorted((int(t["node"][x]), int(t["node"][y]))))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    held = rows.groupBy("node").agg(F.collect_set("band").alias("held"))  # BANDS at most
    sized = rows.join(bag.select("node", F.octet_length("bag").alias("bytes")), "node")
    counted_blocks = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("bytes") / BLOCK_BYTES)
    blocks = sized.groupBy("band").agg(F.ceil(counted_blocks).cast("int").alias("blocks"))
    placed = rows.join(blocks, "band").join(held, "node").join(bag, "node").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sent = placed.withColumn("outside", F.col("n") - F.col("both") - F.col("own")).withColumn("other", other).select(
        "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "label", "r", "n",
        "plain", "centre", "s", "both", "outside", "held", "bag")
    return sent.groupBy("band", "i", "j").applyInArrow(work, "a long, b long").distinct()


def _mixed(bands: DataFrame, labels: DataFrame) -> DataFrame:
    """band, node, label, members of the bands with several classes, in which members are counted anew."""
    rows = bands.select("band", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = rows.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("members"))
    return rows.join(several.where("lo <> hi").select("band", "members"), "band")


def _label_edges(labels: DataFrame) -> DataFrame:
    """Edges (a, b) that stand for all links that led to the labels."""
    return labels.select(F.col("label").alias("a"), F.col("node").alias("b"))


def near_classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc, text_key, doc_id, class_doc (least id of the class as a long), class_key (its text's key): per row."""
    scan = settled(signed(docs))
    nodes = scan.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.min(F.struct("doc", "text_key")).alias("at"), F.first("bands").alias("bands"))
    each = nodes.select("node", F.explode("bands").alias("band"))
    members = each.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > 1)
    bands = settled(each.join(members, "band"))
    chosen = nodes.select("node", "at.doc", "at.text_key").join(bands.select("node").distinct(), "node", "left_semi")
    bag = settled(bags(docs, chosen))
    start = bands.withColumn("label", F.col("node"))
    links = settled(compared(_pairs(_centred(start, F.xxhash64("node"))), bag).where(F.col("s") >= least).select("a", "b"))
    labels = settled(components(links))
    rows = settled(_mixed(bands, labels))
    left = rows.select("node").distinct()
    shares = settled(own_shares(bag.join(left, "node", "left_semi")).where(F.col("r") <= 1 / least - 1 + SLACK))
    rows = settled(_mixed(rows.join(shares, "node", "left_semi"), labels).join(shares, "node"))
    centred = settled(_centred(rows, F.struct("r", F.xxhash64("node"))))
    scores = settled(compared(_pairs(centred), bag))
    labels = settled(components(scores.where(F.col("s") >= least).select("a", "b").union(_label_edges(labels))))
    known = centred.select("node", "centre", F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).join(
        scores, ["a", "b"]).select("node", "centre", "s", "both")
    rows = _mixed(rows, labels).join(shares, "node").join(known, "node", "left")
    rest = settled(_block_links(settled(rows), bag, least))
    labels = settled(components(rest.union(_label_edges(labels))))
    lowest = nodes.select("node", "at").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    names = lowest.groupBy("label").agg(F.min("at").alias("first"))
    named = settled(lowest.join(names, "label").select("node", "first"))
    joined = scan.drop("bands").join(named, "node", "left")
    return joined.select("doc", "text_key", "doc_id", F.coalesce("first.doc", "doc").alias("class_doc"),
                         F.coalesce("first.text_key", "text_key").alias("class_key"))


def one_of_each(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class, the one that names it; of rows alike in id and text, one."""
    classes = near_classes(docs, least)
    kept = classes.where((F.col("doc") == F.col("class_doc")) & (F.col("text_key") == F.col("class_key"))).groupBy(
        F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key")).agg(F.count(F.lit(1)).alias("kept_times"))
    rows = packed(docs)
    match = same(rows["doc_id"], kept["kept_id"]) & (text_key(rows["text"]) == kept["kept_key"])
    rows = settled(rows.join(kept, match))
    again = rows.where(F.col("kept_times") > 1).dropDuplicates(["kept_id", "kept_key"])
    return unpacked(rows.where(F.col("kept_times") == 1).unionByName(again), docs)


def op6_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    named = F.when(F.col("class_doc") != NO_ID, F.col("class_doc"))
    return near_classes(table(spark, folder, "documents")).select("doc_id", named.alias("class_id"))


SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT doc_id, md5(array_to_string(list_slice(w, i, i + 4), ' ')) AS s FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS r(i)
       WHERE len(w) > 0),
bag AS (SELECT doc_id, s, count(*) AS c FROM sh GROUP BY 1, 2),
near AS (SELECT a.doc_id AS x, b.doc_id AS y FROM bag a JOIN bag b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
every AS (SELECT x, y, coalesce(p.s, q.s) AS s, coalesce(p.c, 0) AS p, coalesce(q.c, 0) AS q FROM
    (SELECT x, y, s, c FROM near JOIN bag ON doc_id = x) p FULL JOIN (SELECT x, y, s, c FROM near JOIN bag ON doc_id = y) q USING (x, y, s)),
shared AS (SELECT x, y, CAST(q AS DOUBLE) / p AS r, p, q FROM every WHERE p > 0 AND q > 0),
total AS (SELECT x, y, sum(p) AS p, sum(q) AS q, sum(CASE WHEN q = 0 THEN p ELSE 0 END) AS only_p FROM every GROUP BY 1, 2),
step AS (SELECT x, y, r, p AS p1, q AS q1, count(*) AS n, sum(p) AS ps, sum(q) AS qs FROM shared GROUP BY 1, 2, 3, 4, 5),
cum AS (SELECT x, y, p1, q1, n, sum(ps) OVER w AS up, sum(qs) OVER w AS uq FROM step WINDOW w AS (PARTITION BY x, y ORDER BY r)),
sim AS (SELECT x, y, sum(n / ((only_p + up) / CAST(p1 AS DOUBLE) + (total.q - uq) / CAST(q1 AS DOUBLE))) AS j
        FROM cum JOIN total USING (x, y) GROUP BY 1, 2),
link AS (SELECT x, y FROM sim WHERE j >= 0.8 UNION SELECT y, x FROM sim WHERE j >= 0.8),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT a, y FROM reach JOIN link ON b = x)
SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a"""
