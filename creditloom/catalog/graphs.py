"""Queries: functions, vectors, graphs, sequences, evaluation, attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditloom.catalog.base import Catalog, r6, rounded
from creditloom.functions import columns as C
from creditloom.functions import vectors as V
from creditloom.operators import pairs as P
from creditloom.plans import evaluate as E
from creditloom.plans import explain as X
from creditloom.plans import graph as G
from creditloom.plans import sequences as S

catalog = Catalog()
DIM = 64
# The default threshold 0.85 has no edges on these embeddings; 0.3 has many.
LIMIT = 0.3
# The view of twins has near neighbours and copies, so the default has edges there.
STRICT = 0.85

# ---------------------------------------------------------------- F: functions
catalog.add(
    "f1_arithmetic",
    lambda v: rounded(
        v.app.select(
            "sk_id_curr",
            (F.col("amt_credit") + F.col("amt_annuity") * 2 - F.col("amt_goods_price")).alias("mixed"),
            F.pow(F.col("amt_annuity") / F.lit(100.0), 2).alias("squared"),
            F.sqrt("amt_income_total").alias("root"),
            F.abs("days_birth").alias("age"),
            F.cos(F.col("ext_source_1")).alias("cosine"),
            F.exp(-F.col("ext_source_3")).alias("decay"),
            C.sigmoid(F.col("ext_source_2") * F.lit(5.0)).alias("logistic"),
            F.signum(F.col("amt_goods_price") - F.col("amt_credit")).alias("side"),
            C.clamp(F.col("amt_credit"), 1000.0, 5000.0).alias("clamped"),
        ),
        "squared", "root", "cosine", "decay", "logistic",
    ),
    f"""SELECT sk_id_curr, amt_credit + amt_annuity * 2 - amt_goods_price AS mixed,
  {r6('pow(amt_annuity / 100, 2)')} AS squared, {r6('sqrt(amt_income_total)')} AS root, abs(days_birth) AS age,
  {r6('cos(ext_source_1)')} AS cosine, {r6('exp(-ext_source_3)')} AS decay,
  {r6('1 / (1 + exp(-(ext_source_2 * 5)))')} AS logistic,
  CAST(sign(amt_goods_price - amt_credit) AS DOUBLE) AS side,
  CASE WHEN amt_credit IS NOT NULL THEN least(greatest(amt_credit, CAST(1000 AS DOUBLE)), CAST(5000 AS DOUBLE)) END AS clamped
FROM app""",
)
catalog.add(
    "f2_conditionals",
    lambda v: v.prev.select(
        "sk_id_prev",
        F.when(F.col("amt_credit").isNull(), "none").when(F.col("amt_credit") > 100000, "large").otherwise("small")
        .alias("size"),
        F.coalesce("amt_down_payment", F.lit(0.0)).alias("down"),
        F.col("name_contract_status").isin("Approved", "Refused").alias("decided"),
        ((F.col("amt_annuity") > 0) & (F.col("cnt_payment") >= 12)).alias("long_term"),
    ),
    """SELECT sk_id_prev, CASE WHEN amt_credit IS NULL THEN 'none' WHEN amt_credit > 100000 THEN 'large' ELSE 'small'
  END AS size, coalesce(amt_down_payment, CAST(0 AS DOUBLE)) AS down,
  name_contract_status IN ('Approved', 'Refused') AS decided, amt_annuity > 0 AND cnt_payment >= 12 AS long_term FROM prev""",
)
catalog.add(
    "f3_casts_and_text",
    lambda v: v.bureau_bal.select(
        "sk_id_bureau", "months_balance", F.upper("status").alias("status"),
        F.col("status").try_cast("int").alias("bucket"),
        (F.round(F.col("months_balance") / F.lit(7.0), 2) + F.lit(0.0)).alias("weeks"),
        F.contains(F.col("status"), F.lit("5")).alias("worst"),
    ),
    """SELECT sk_id_bureau, months_balance, upper(status) AS status, TRY_CAST(status AS INTEGER) AS bucket,
  round(months_balance / CAST(7 AS DOUBLE), 2) + CAST(0 AS DOUBLE) AS weeks, contains(status, '5') AS worst FROM bureau_bal""",
)
PAIRS = """WITH n AS (SELECT sk_id, CAST(embedding AS DOUBLE[]) AS e FROM nodes),
u AS (SELECT min(sk_id) AS sk_id, e, count(*) AS copies FROM n GROUP BY e),
p AS (SELECT a.sk_id AS src, b.sk_id AS dst, list_cosine_similarity(a.e, b.e) AS w FROM u a JOIN u b ON a.sk_id < b.sk_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.3)"""
TWINS = """WITH n AS (SELECT sk_id, CAST(embedding AS DOUBLE[]) AS e FROM twins),
u AS (SELECT min(sk_id) AS sk_id, e, count(*) AS copies FROM n GROUP BY e),
v AS (SELECT * FROM u WHERE list_dot_product(e, e) > 0),
p AS (SELECT a.sk_id AS src, b.sk_id AS dst, list_cosine_similarity(a.e, b.e) AS w FROM v a JOIN v b ON a.sk_id < b.sk_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.85)"""
# By brute force over all nodes, copies and all: both directions and loops.
EVERY = """WITH n AS (SELECT sk_id, CAST(embedding AS DOUBLE[]) AS e FROM twins),
v AS (SELECT * FROM n WHERE list_dot_product(e, e) > 0),
g AS (SELECT a.sk_id AS src, b.sk_id AS dst FROM v a JOIN v b ON a.sk_id <> b.sk_id WHERE list_cosine_similarity(a.e, b.e) >= 0.85
  UNION ALL SELECT sk_id, sk_id FROM n),
d AS (SELECT src, CAST(count(*) AS DOUBLE) AS degree FROM g GROUP BY src),
nw AS (SELECT g.src, g.dst, 1 / sqrt(a.degree * b.degree) AS w FROM g JOIN d a ON a.src = g.src JOIN d b ON b.src = g.dst),
x0 AS (SELECT sk_id, CAST(i - 1 AS INTEGER) AS dim, e[i] AS value FROM (SELECT *, unnest(generate_series(1, 64)) AS i FROM n))"""
# The factored form: edges between representatives, with the multiplicity of the far node.
GRAPH = TWINS + """, g0 AS (SELECT src, dst, w FROM p UNION ALL SELECT dst, src, w FROM p
  UNION ALL SELECT sk_id, sk_id, CAST(1 AS DOUBLE) FROM u),
g AS (SELECT src, dst, w, copies FROM g0 JOIN u ON u.sk_id = dst)"""
DEGREE = GRAPH + ", d AS (SELECT src, CAST(sum(copies) AS DOUBLE) AS degree FROM g GROUP BY src)"
NORMAL = DEGREE + """, nw AS (SELECT g.src, g.dst, 1 / sqrt(a.degree * b.degree) AS w, copies FROM g
  JOIN d a ON a.src = g.src JOIN d b ON b.src = g.dst)"""


def centre_columns(vector: str):
    """Cosine of every node with node-independent reference vectors, for the vector functions."""
    ramp = F.transform(F.sequence(F.lit(1), F.lit(DIM)), lambda i: i.cast("double") / F.lit(float(DIM)))
    return {
        "length": V.norm(vector), "dot": V.dot(vector, ramp), "cosine": V.cosine(vector, ramp),
        "first_unit": V.normalise(vector)[0],
    }


catalog.add(
    "f4_vectors",
    lambda v: rounded(
        v.nodes.withColumns(centre_columns("embedding")).select("sk_id", "length", "dot", "cosine", "first_unit"),
        "length", "dot", "cosine", "first_unit",
    ),
    f"""WITH n AS (SELECT sk_id, CAST(embedding AS DOUBLE[]) AS e,
  list_transform(generate_series(1, 64), lambda i: CAST(i AS DOUBLE) / 64) AS r FROM nodes)
SELECT sk_id, {r6('sqrt(list_dot_product(e, e))')} AS length, {r6('list_dot_product(e, r)')} AS dot,
  {r6('list_cosine_similarity(e, r)')} AS cosine, {r6('e[1] / sqrt(list_dot_product(e, e))')} AS first_unit FROM n""",
)
KERNELS = {"similarity": "w", "gaussian": "exp(-pow(1 - w, 2) / 0.1)", "smooth": "1 / (1 + exp(-(w * 5)))"}
catalog.add(
    "f5_edge_kernels",
    lambda v: rounded(
        v.nodes.select("sk_id", (F.element_at("embedding", 1).cast("double")).alias("w")).select(
            "sk_id", C.gaussian_kernel(F.col("w")).alias("gaussian"), C.smooth_threshold(F.col("w")).alias("smooth")
        ),
        "gaussian", "smooth",
    ),
    f"""WITH n AS (SELECT sk_id, CAST(embedding[1] AS DOUBLE) AS w FROM nodes)
SELECT sk_id, {r6(KERNELS['gaussian'])} AS gaussian, {r6(KERNELS['smooth'])} AS smooth FROM n""",
)
catalog.add(
    "f6_arrays",
    lambda v: rounded(
        v.nodes.select(
            "sk_id",
            V.mean_over("embedding").alias("mean"),
            F.size(V.pad_to(F.col("embedding"), 70, F.lit(0).cast("float"))).alias("padded_size"),
            V.mean_over(V.pad_to(F.col("embedding"), 128, F.lit(0).cast("float"))).alias("padded_mean"),
            F.size(F.concat("embedding", "embedding")).alias("doubled"),
        ),
        "mean", "padded_mean",
    ),
    f"""WITH n AS (SELECT sk_id, CAST(embedding AS DOUBLE[]) AS e FROM nodes)
SELECT sk_id, {r6('list_sum(e) / len(e)')} AS mean, CAST(greatest(len(e), 70) AS INTEGER) AS padded_size,
  {r6('list_sum(e) / greatest(len(e), 128)')} AS padded_mean, CAST(2 * len(e) AS INTEGER) AS doubled FROM n""",
)

# ---------------------------------------------------------------- J6, J7, W4, K
catalog.add(
    "j6_cluster_adjacency", lambda v: G.cluster_adjacency(v.nodes),
    "SELECT cluster, count(*) AS n_nodes, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS n_edges, count(*) AS n_loops "
    "FROM nodes GROUP BY cluster",
)
catalog.add(
    "j7_similarity_pairs",
    lambda v: rounded(
        P.similarity_pairs(P.distinct_vectors(v.nodes, "sk_id", "embedding"), "sk_id", "embedding", LIMIT), "weight"
    ),
    PAIRS + f" SELECT src, dst, {r6('w')} AS weight FROM p",
)
catalog.add(
    "w4_strongest_edges",
    lambda v: rounded(
        G.strongest_edges(
            P.similarity_pairs(P.distinct_vectors(v.nodes, "sk_id", "embedding"), "sk_id", "embedding", LIMIT), 100
        ),
        "weight",
    ),
    PAIRS + f" SELECT src, dst, {r6('w')} AS weight FROM p ORDER BY w DESC, src, dst LIMIT 100",
)
SAMPLE_HASH = "('0x' || substr(md5(sk_id || ':42'), 1, 8))::BIGINT"
catalog.add(
    "j7_split_cells",
    lambda v: rounded(
        P.similarity_pairs(
            P.distinct_vectors(v.nodes, "sk_id", "embedding"), "sk_id", "embedding", LIMIT, block_rows=32, cell_rows=48, pivots=4
        ), "weight",
    ),
    PAIRS + f" SELECT src, dst, {r6('w')} AS weight FROM p",
)
catalog.add(
    "k1_similarity_edges",
    lambda v: rounded(G.similarity_edges(v.nodes, LIMIT), "weight"),
    f"""WITH s AS (SELECT sk_id, CAST(embedding AS DOUBLE[]) AS e FROM nodes ORDER BY {SAMPLE_HASH}, sk_id LIMIT 500),
p AS (SELECT a.sk_id AS src, b.sk_id AS dst, list_cosine_similarity(a.e, b.e) AS w FROM s a JOIN s b ON a.sk_id < b.sk_id)
SELECT src, dst, {r6('w')} AS weight FROM p WHERE w >= 0.3 ORDER BY w DESC, src, dst LIMIT 1000""",
)
catalog.add(
    "k2_cluster_edges",
    lambda v: rounded(G.cluster_membership(v.nodes), "edge_weight"),
    f"""SELECT sk_id, cluster, degree, {r6('1 / CAST(degree AS DOUBLE)')} AS edge_weight
FROM nodes JOIN (SELECT cluster, count(*) AS degree FROM nodes GROUP BY cluster) USING (cluster)""",
)


catalog.add(
    "j7_pairs_of_representatives",
    lambda v: rounded(
        P.similarity_pairs(P.distinct_vectors(v.twins, "sk_id", "embedding"), "sk_id", "embedding", STRICT), "weight"
    ),
    TWINS + f" SELECT src, dst, {r6('w')} AS weight FROM p",
)
catalog.add(
    "j7_pairs_in_cells",
    lambda v: rounded(
        P.similarity_pairs(P.distinct_vectors(v.twins, "sk_id", "embedding"), "sk_id", "embedding", STRICT, 32), "weight"
    ),
    TWINS + f" SELECT src, dst, {r6('w')} AS weight FROM p",
)
catalog.add(
    "j7_copy_members", lambda v: members(v),
    "SELECT sk_id, min(sk_id) OVER (PARTITION BY embedding) AS representative FROM twins",
)
catalog.add(
    "j7_links_per_node", lambda v: G.node_links(graph(v), members(v)),
    EVERY + " SELECT src AS sk_id, count(*) - 1 AS links FROM g GROUP BY src",
)


def graph(v):
    return G.threshold_graph(v.twins, STRICT)


def members(v):
    return P.copy_members(v.twins, "sk_id", "embedding")


def vectors(v):
    return v.twins.select("sk_id", "embedding")


catalog.add(
    "k3_threshold_graph", lambda v: rounded(graph(v), "weight"),
    GRAPH + f" SELECT src, dst, {r6('w')} AS weight, copies FROM g",
)
catalog.add(
    "k4_normalised_edges", lambda v: rounded(G.normalised(graph(v)), "weight"),
    NORMAL + f" SELECT src, dst, {r6('w')} AS weight, copies FROM nw",
)
catalog.add(
    "k4_degrees",
    lambda v: G.for_every_node(G.degrees(graph(v)).withColumnRenamed("src", "sk_id"), members(v)),
    EVERY + " SELECT src AS sk_id, degree FROM d",
)
catalog.add(
    "k5_edge_features",
    lambda v: rounded(G.edge_features(graph(v)), "similarity", "gaussian", "smooth"),
    GRAPH + " SELECT src, dst, " + ", ".join(f"{r6(sql)} AS {name}" for name, sql in KERNELS.items()) + " FROM g",
)


def long_vectors(df, name="value"):
    """(sk_id, dim, value) of a vector table, so that results are scalar columns."""
    return rounded(df.select("sk_id", F.posexplode("embedding").alias("dim", name)), name)


HOP = """, x{out} AS (SELECT nw.src AS sk_id, dim, sum(nw.w * x{of}.value) AS value FROM nw
  JOIN x{of} ON x{of}.sk_id = nw.dst GROUP BY 1, 2)"""
catalog.add(
    "k6_neighbour_mean",
    lambda v: long_vectors(G.for_every_node(G.neighbour_mean(graph(v), vectors(v), DIM), members(v))),
    EVERY + f""" SELECT src AS sk_id, dim, {r6('avg(value)')} AS value
FROM g JOIN x0 ON x0.sk_id = dst GROUP BY src, dim""",
)
catalog.add(
    "k6_two_hops",
    lambda v: long_vectors(G.for_every_node(G.propagate(graph(v), vectors(v), DIM, 2), members(v))),
    EVERY + HOP.format(out=1, of=0) + HOP.format(out=2, of=1)
    + f" SELECT sk_id, dim, {r6('value')} AS value FROM x2",
)
catalog.add(
    "k6_cluster_means",
    lambda v: rounded(
        G.cluster_means(v.nodes, DIM).select("cluster", F.posexplode("embedding").alias("dim", "value")), "value"
    ),
    f"""SELECT cluster, CAST(i - 1 AS INTEGER) AS dim, {r6('avg(CAST(embedding[i] AS DOUBLE))')} AS value
FROM (SELECT *, unnest(generate_series(1, 64)) AS i FROM nodes) GROUP BY cluster, i""",
)
ATTENTION = GRAPH + """, s AS (SELECT g.src, g.dst, g.copies, list_dot_product(a.e, b.e) / 8 AS score FROM g
  JOIN u a ON a.sk_id = g.src JOIN u b ON b.sk_id = g.dst),
t AS (SELECT src, max(score) AS top FROM s GROUP BY src),
z AS (SELECT src, sum(exp(score - top) * copies) AS total FROM s JOIN t USING (src) GROUP BY src),
aw AS (SELECT src, dst, exp(score - top) / total AS attention, copies FROM s JOIN t USING (src) JOIN z USING (src))"""
catalog.add(
    "k7_attention_weights",
    lambda v: rounded(G.attention(graph(v), vectors(v), DIM), "attention"),
    ATTENTION + f" SELECT src, dst, {r6('attention')} AS attention, copies FROM aw",
)
catalog.add(
    "k7_attention_sum",
    lambda v: long_vectors(G.for_every_node(G.attend(graph(v), vectors(v), DIM), members(v))),
    EVERY + f""", s AS (SELECT g.src, g.dst, list_dot_product(a.e, b.e) / 8 AS score FROM g
  JOIN n a ON a.sk_id = g.src JOIN n b ON b.sk_id = g.dst),
t AS (SELECT src, max(score) AS top FROM s GROUP BY src),
z AS (SELECT src, sum(exp(score - top)) AS total FROM s JOIN t USING (src) GROUP BY src)
SELECT src AS sk_id, dim, {r6('sum(exp(score - top) / total * value)')} AS value
FROM s JOIN t USING (src) JOIN z USING (src) JOIN x0 ON x0.sk_id = dst GROUP BY src, dim""",
)
catalog.add(
    "k8_fusion",
    lambda v: long_vectors(
        G.fuse(vectors(v), G.for_every_node(G.neighbour_mean(graph(v), vectors(v), DIM), members(v)), 0.5)
    ),
    EVERY + f""", m AS (SELECT src AS sk_id, dim, avg(value) AS value
FROM g JOIN x0 ON x0.sk_id = dst GROUP BY src, dim)
SELECT sk_id, dim, {r6('0.5 * x0.value + 0.5 * m.value')} AS value FROM x0 JOIN m USING (sk_id, dim)""",
)

# ---------------------------------------------------------------- W1
ORDER = ["days_instalment", "sk_id_prev", "num_instalment_number", "amt_instalment", "amt_payment"]


def histories(v):
    labels = v.app.select("sk_id_curr", "target")
    found = S.sequences(v.inst, "sk_id_curr", ORDER, ["days_instalment", "amt_payment"], 32, labels)
    days = F.concat_ws(",", F.transform("steps", lambda s: s["days_instalment"].cast("string")))
    paid = F.aggregate(
        "steps", F.lit(0.0), lambda acc, s: acc + F.coalesce(s["amt_payment"], F.lit(0.0))
    )
    return found.select(
        "sk_id_curr", "target", "chunk", "n_steps", "length", "padding", days.alias("days"), paid.alias("paid")
    )


catalog.add(
    "w1_sequences", histories,
    f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY sk_id_curr ORDER BY {', '.join(ORDER)}) - 1 AS step FROM inst),
c AS (SELECT sk_id_curr, CAST(step // 32 AS INTEGER) AS chunk, count(*) AS n_steps,
  string_agg(CAST(days_instalment AS VARCHAR), ',' ORDER BY step) AS days, sum(coalesce(amt_payment, 0)) AS paid
  FROM s GROUP BY 1, 2),
l AS (SELECT sk_id_curr, count(*) AS total, CAST((count(*) - 1) // 32 AS INTEGER) AS last FROM inst GROUP BY 1)
SELECT sk_id_curr, target, chunk, n_steps, (SELECT max(total) FROM l) AS length,
  CASE WHEN chunk = last THEN (SELECT max(total) FROM l) - total ELSE 0 END AS padding, days, paid
FROM c JOIN l USING (sk_id_curr) JOIN app USING (sk_id_curr)""",
)

# ---------------------------------------------------------------- E
CUM = """WITH c AS (SELECT score, count(*) FILTER (WHERE target = 1) AS pos, count(*) FILTER (WHERE target = 0) AS neg
  FROM scores GROUP BY score),
k AS (SELECT *, coalesce(sum(neg) OVER w, 0) AS neg_before, coalesce(sum(pos) OVER w, 0) AS pos_before FROM c
  WINDOW w AS (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
catalog.add(
    "e1_roc_auc",
    lambda v: rounded(E.roc_auc(v.scores, "score", "target"), "auc"),
    CUM + f""" SELECT {r6('CAST(sum(pos * (neg_before + neg / CAST(2 AS DOUBLE))) AS DOUBLE) / nullif(CAST(sum(pos) * sum(neg) AS DOUBLE), 0)')}
  AS auc, CAST(sum(pos) AS BIGINT) AS p, CAST(sum(neg) AS BIGINT) AS n FROM k""",
)
catalog.add(
    "e2_roc_points",
    lambda v: rounded(E.roc_points(v.scores, "score", "target"), "fpr", "tpr"),
    CUM + f""", t AS (SELECT CAST(sum(pos) AS DOUBLE) AS p, CAST(sum(neg) AS DOUBLE) AS n FROM c)
SELECT score AS threshold, {r6('(n - CAST(neg_before AS DOUBLE)) / nullif(n, 0)')} AS fpr,
  {r6('(p - CAST(pos_before AS DOUBLE)) / nullif(p, 0)')} AS tpr FROM k, t""",
)
TIERS = """WITH q AS (SELECT quantile_cont(score, 0.4) AS lo, quantile_cont(score, 0.8) AS hi FROM scores),
t AS (SELECT sk_id_curr, score, CASE WHEN score > hi THEN 2 WHEN score > lo THEN 1 ELSE 0 END AS risk_level FROM scores, q)"""
catalog.add("e3_risk_tiers", lambda v: E.risk_tiers(v.scores, "score").drop("target"), TIERS + " SELECT * FROM t")
catalog.add(
    "e4_tier_distribution",
    lambda v: rounded(E.tier_distribution(E.risk_tiers(v.scores, "score")), "percent"),
    TIERS + f" SELECT risk_level, count(*) AS n, {r6('count(*) * CAST(100 AS DOUBLE) / (SELECT count(*) FROM t)')} "
    "AS percent FROM t GROUP BY risk_level",
)
catalog.add(
    "e5_class_separation",
    lambda v: rounded(
        E.class_separation(v.nodes.withColumn("y", C.flag(F.col("cluster") < 3)), "embedding", "y", DIM), "similarity"
    ),
    f"""WITH s AS (SELECT i, sum(CAST(embedding[i] AS DOUBLE)) FILTER (WHERE cluster < 3) AS a,
  sum(CAST(embedding[i] AS DOUBLE)) FILTER (WHERE cluster >= 3) AS b
  FROM (SELECT *, unnest(generate_series(1, 64)) AS i FROM nodes) GROUP BY i)
SELECT {r6('abs(sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))))')} AS similarity FROM s""",
)
catalog.add(
    "e7_log_loss",
    lambda v: rounded(E.log_loss(v.scores, "score", "target"), "log_loss"),
    f"""WITH s AS (SELECT target, least(greatest(score, CAST(1e-7 AS DOUBLE)), CAST(1 AS DOUBLE) - CAST(1e-7 AS DOUBLE)) AS p FROM scores
  WHERE score IS NOT NULL AND target IS NOT NULL)
SELECT {r6('avg(CASE WHEN target = 1 THEN -ln(p) ELSE -ln(1 - p) END)')} AS log_loss FROM s""",
)

# ---------------------------------------------------------------- X, W2, W3
IMPORTANCE = """WITH i AS (SELECT risk, feature, avg(abs(value)) AS importance FROM attr GROUP BY risk, feature),
r AS (SELECT *, row_number() OVER (PARTITION BY risk ORDER BY importance DESC, feature) AS rank FROM i)"""
catalog.add(
    "x2_importance_by_risk",
    lambda v: rounded(X.importance(v.attr, ["risk"]), "importance"),
    IMPORTANCE + f" SELECT risk, feature, {r6('importance')} AS importance FROM i",
)
catalog.add(
    "w2_top_features_per_risk",
    lambda v: rounded(X.top_features_per_risk(v.attr), "importance"),
    IMPORTANCE + f" SELECT risk, feature, {r6('importance')} AS importance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10",
)
catalog.add(
    "x3_signed_by_risk",
    lambda v: rounded(X.signed_by_risk(v.attr), "importance", "low", "medium", "high"),
    f"""WITH o AS (SELECT feature, avg(abs(value)) AS importance, avg(value) FILTER (WHERE risk = 0) AS low,
  avg(value) FILTER (WHERE risk = 1) AS medium, avg(value) FILTER (WHERE risk = 2) AS high FROM attr GROUP BY feature)
SELECT feature, {', '.join(r6(c) + f' AS {c}' for c in ('importance', 'low', 'medium', 'high'))}
FROM o ORDER BY o.importance DESC, feature LIMIT 20""",
)
NODE = """WITH r AS (SELECT sk_id, feature, value, CAST(row_number() OVER (PARTITION BY sk_id ORDER BY abs(value) DESC, feature)
  AS INTEGER) AS rank FROM attr)"""
catalog.add(
    "w3_top_per_node",
    lambda v: X.top_per_node(v.attr.drop("risk")),
    NODE + " SELECT sk_id, feature, value, rank FROM r WHERE rank <= 5",
)
catalog.add(
    "x4_node_explanations",
    lambda v: X.node_explanations(v.attr),
    NODE + """ SELECT sk_id, rank, feature, abs(value) AS size,
  CASE WHEN value > 0 THEN 'increases risk' ELSE 'decreases risk' END AS direction FROM r WHERE rank <= 5""",
)


def with_classes(v, classes: int):
    """Attributions with a class axis: class c scales the value, alternating in sign."""
    sign = F.when(F.col("class") % 2 == 1, 1.0).otherwise(-1.0)
    numbers = F.array(*[F.lit(c) for c in range(classes)])
    return v.attr.select("sk_id", "feature", "value", F.explode(numbers).alias("class")).withColumn(
        "value", F.col("value") * sign * (F.col("class") + 1)
    )


catalog.add(
    "x5_binary_classes",
    lambda v: X.reduce_classes(with_classes(v, 2), 2),
    "SELECT sk_id, feature, value * 2 AS value FROM attr",
)
catalog.add(
    "x5_many_classes",
    lambda v: rounded(X.reduce_classes(with_classes(v, 3), 3), "value"),
    f"SELECT sk_id, feature, {r6('-value + 2 * value - 3 * value')} AS value FROM attr",
)
