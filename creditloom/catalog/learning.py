"""Queries: sources, stores, projections, clusters, rebalancing, classifiers."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from creditloom.catalog.base import Catalog, rounded
from creditloom.catalog.features import loan_tables
from creditloom.plans import evaluate as E
from creditloom.plans import explain as X
from creditloom.plans import families as fam
from creditloom.plans import jobs
from creditloom.plans import learn as L
from creditloom.plans import prepare as PR
from creditloom.plans import trees as TR
from creditloom.session import fresh_path
from creditloom.sources import csv_tables as CSV
from creditloom.sources import schemas, store

catalog = Catalog()
DIM = 64
INST_SCHEMA = (
    "sk_id_curr BIGINT, sk_id_prev BIGINT, num_instalment_number INT, num_instalment_version INT, "
    "days_instalment BIGINT, days_entry_payment BIGINT, amt_instalment DOUBLE, amt_payment DOUBLE"
)


def written(v, view: str) -> str:
    """The view as CSV with a header, below the shared folder."""
    path = fresh_path(v.spark, view)
    getattr(v, view).write.option("header", True).csv(path)
    return path


def typed(v):
    return CSV.read_typed(v.spark, written(v, "inst"), INST_SCHEMA)


catalog.add("s1_read_typed", typed, "SELECT * FROM inst")
catalog.add(
    "s1_range_report",
    lambda v: CSV.range_report(
        typed(v),
        {"sk_id_curr": schemas.UINT32, "sk_id_prev": schemas.UINT32, "num_instalment_number": schemas.INT16,
         "days_instalment": (-1000, 0)},
    ),
    """SELECT 'sk_id_curr' AS column_name, count(*) FILTER (WHERE sk_id_curr NOT BETWEEN 0 AND 4294967295) AS out_of_range FROM inst
UNION ALL SELECT 'sk_id_prev', count(*) FILTER (WHERE sk_id_prev NOT BETWEEN 0 AND 4294967295) FROM inst
UNION ALL SELECT 'num_instalment_number', count(*) FILTER (WHERE num_instalment_number NOT BETWEEN -32768 AND 32767) FROM inst
UNION ALL SELECT 'days_instalment', count(*) FILTER (WHERE days_instalment NOT BETWEEN -1000 AND 0) FROM inst""",
)
KNOWN_BUREAU = {
    "BIGINT": ["SK_ID_CURR", "SK_ID_BUREAU", "DAYS_CREDIT", "CREDIT_DAY_OVERDUE", "DAYS_CREDIT_ENDDATE",
               "DAYS_ENDDATE_FACT"],
    "DOUBLE": ["AMT_CREDIT_MAX_OVERDUE", "AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM_OVERDUE",
               "AMT_ANNUITY"],
}
catalog.add(
    "s2_read_known", lambda v: CSV.read_known(v.spark, written(v, "bureau"), KNOWN_BUREAU, other="STRING"), "SELECT * FROM bureau"
)


def wide_application(v):
    """An applicant file with columns that no job names, read back by the declared types and rules."""
    path = fresh_path(v.spark, "wide")
    key = F.col("sk_id_curr")
    v.app.select(
        "sk_id_curr", "target", "amt_credit", (key % 13).alias("cnt_children"), (key % 2).alias("flag_document_3"),
        F.when(key % 5 != 0, (key % 97) / F.lit(128.0)).alias("apartments_avg"), (key % 7).alias("amt_req_credit_bureau_year"),
        F.when(key % 3 != 0, F.concat(F.lit("kind "), (key % 4).cast("string"))).alias("housetype_mode"),
        (key % 9 / F.lit(2.0)).alias("obs_30_cnt_social_circle"),
    ).write.option("header", True).csv(path)
    return CSV.read_known(v.spark, path, schemas.KNOWN_TYPES["app"], schemas.NAME_RULES)


catalog.add(
    "s2_wide_application", wide_application,
    """SELECT sk_id_curr, CAST(target AS INTEGER) AS target, amt_credit, CAST(sk_id_curr % 13 AS INTEGER) AS cnt_children,
  CAST(sk_id_curr % 2 AS INTEGER) AS flag_document_3,
  CASE WHEN sk_id_curr % 5 <> 0 THEN CAST(sk_id_curr % 97 AS DOUBLE) / 128 END AS apartments_avg,
  CAST(sk_id_curr % 7 AS DOUBLE) AS amt_req_credit_bureau_year,
  CASE WHEN sk_id_curr % 3 <> 0 THEN 'kind ' || (sk_id_curr % 4) END AS housetype_mode,
  CAST(sk_id_curr % 9 AS DOUBLE) / 2 AS obs_30_cnt_social_circle FROM app""",
)


def wide_codes(v):
    """Codes of the text columns of that file, as the training job makes them; numeric columns stay as they are."""
    table = wide_application(v)
    texts = [name for name, kind in table.dtypes if kind == "string"]
    return PR.factorise(table, texts).apply(table).select("sk_id_curr", "cnt_children", "apartments_avg", "housetype_mode")


catalog.add(
    "s2_wide_codes", wide_codes,
    """WITH w AS (SELECT sk_id_curr, CASE WHEN sk_id_curr % 3 <> 0 THEN 'kind ' || (sk_id_curr % 4) END AS h FROM app),
c AS (SELECT h, CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT h FROM w WHERE h IS NOT NULL))
SELECT sk_id_curr, CAST(sk_id_curr % 13 AS INTEGER) AS cnt_children,
  CASE WHEN sk_id_curr % 5 <> 0 THEN CAST(sk_id_curr % 97 AS DOUBLE) / 128 END AS apartments_avg,
  coalesce(code, -1) AS housetype_mode FROM w LEFT JOIN c USING (h)""",
)


def marked_header(v):
    """A CSV whose header starts with a byte order mark, read back under clean names."""
    path = fresh_path(v.spark, "marked")
    first, *rest = v.bureau_bal.columns
    v.bureau_bal.withColumnRenamed(first, CSV.BYTE_ORDER_MARK + first).select(
        CSV.BYTE_ORDER_MARK + first, *rest
    ).write.option("header", True).csv(path)
    return CSV.read_known(v.spark, path, schemas.KNOWN_TYPES["bureau_bal"])


catalog.add("s3_marked_header", marked_header, "SELECT sk_id_bureau, months_balance, status FROM bureau_bal")
catalog.add(
    "s4_deferred_scan",
    lambda v: v.table("lineitem").where(F.col("l_quantity") > 45).select("l_orderkey", "l_quantity"),
    "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45",
)


# The applicant view has one column that the published files don't have.
OWN_COLUMNS = {"app": {"BIGINT": ["REGION"]}}


def written_tables(v) -> str:
    """The views written as the seven input files, under their declared columns; returns the folder."""
    folder = fresh_path(v.spark, "tables")
    for name, file in schemas.FILES.items():
        df = getattr(v, name)
        df = df.toDF(*[c.upper() for c in df.columns])
        if name in schemas.DECLARED:
            df = df.select(
                *[
                    (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                    for f in StructType.fromDDL(schemas.DECLARED[name])
                ]
            )
        df.write.option("header", True).csv(f"{folder}/{file}")
    return folder


def loaded_tables(v):
    return CSV.load_tables(v.spark, written_tables(v), more=OWN_COLUMNS)


def seven_tables(v):
    """The views written as the seven input files, loaded as one set, counted per table."""
    counts = [
        df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"),
               F.sum(df.columns[0] if "sk_id_curr" not in df.columns else "sk_id_curr").alias("key_sum"))
        for name, df in loaded_tables(v).items()
    ]
    return reduce(DataFrame.unionByName, counts)


catalog.add(
    "s5_load_tables", seven_tables,
    "\nUNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS n, CAST(sum({'sk_id_bureau' if t == 'bureau_bal' else 'sk_id_curr'}) "
        f"AS BIGINT) AS key_sum FROM {t}" for t in schemas.FILES
    ),
)


def loaded(v, name: str):
    """All values of one of them, under the view's types."""
    view = getattr(v, name)
    return loaded_tables(v)[name].select(*[F.col(f.name).cast(f.dataType) for f in view.schema])


for _name in ("app", "card"):
    catalog.add(f"s5_loaded_{_name}", lambda v, name=_name: loaded(v, name), f"SELECT * FROM {_name}")


def round_trip(v):
    """An epoch saved without attributions and loaded again."""
    folder = fresh_path(v.spark, "run")
    tiers = E.risk_tiers(v.nodes.withColumn("score", F.col("sk_id") * 7919 % 1000 / F.lit(1000.0)), "score")
    store.save_run({"embeddings": v.nodes, "risk_levels": tiers}, folder, "a", 5)
    parts = store.load_run(v.spark, folder, "a", 5)
    return (
        parts["embeddings"].join(parts["risk_levels"], "sk_id")
        .join(parts["attributions"].groupBy("sk_id").agg(F.count("feature").alias("attributed")), "sk_id", "left")
        .select("sk_id", "cluster", "risk_level", F.size("embedding").alias("dim"), "attributed")
    )


catalog.add(
    "s6_save_and_load_run", round_trip,
    """WITH s AS (SELECT sk_id, cluster, CAST(sk_id * 7919 % 1000 AS DOUBLE) / 1000 AS score, len(embedding) AS dim FROM nodes),
q AS (SELECT quantile_cont(score, 0.4) AS lo, quantile_cont(score, 0.8) AS hi FROM s)
SELECT sk_id, cluster, CASE WHEN score > hi THEN 2 WHEN score > lo THEN 1 ELSE 0 END AS risk_level,
  CAST(dim AS INTEGER) AS dim, CAST(NULL AS BIGINT) AS attributed FROM s, q""",
)

APP_FEATURES = ["amt_income_total", "amt_credit", "amt_annuity", "amt_goods_price", "days_birth", "days_employed",
                "ext_source_1", "ext_source_2", "ext_source_3"]


def stored_assignment(v):
    folder = fresh_path(v.spark, "assignment")
    name = store.assignment_id(APP_FEATURES, 8, 42)
    rows = v.app.select("sk_id_curr")

    def compute():
        return L.cluster_rows(v.app, "sk_id_curr", APP_FEATURES, 8, 1)

    first = store.stored_clusters(rows, "sk_id_curr", folder, name, compute)
    again = store.stored_clusters(rows, "sk_id_curr", folder, name, compute)
    return first.join(again.withColumnRenamed("cluster", "reused"), "sk_id_curr")


catalog.add("s7_stored_clusters", stored_assignment)
catalog.add(
    "s7_reused_clusters",
    lambda v: stored_assignment(v).select("sk_id_curr", (F.col("cluster") == F.col("reused")).alias("same")),
    "SELECT sk_id_curr, true AS same FROM app",
)

# ---------------------------------------------------------------- T6 - T8
ROW_FEATURES = [*APP_FEATURES, "own_car_age", "cnt_fam_members"]


def app_vectors(v):
    return L.assemble_vector(fam.derive_app(v.app), ROW_FEATURES).select("sk_id_curr", "features")


def projected(v):
    table = app_vectors(v)
    return L.fit_projection(table, "features", len(ROW_FEATURES), 5).apply(table)


catalog.add(
    "t6_projection",
    lambda v: projected(v).select(
        "sk_id_curr", F.posexplode(L.vector_to_array("projected")).alias("component", "value")
    ),
)


def projected_lengths(v):
    """Distance of every row from the mean, from all its coordinates (as a rounded logarithm)."""
    table = app_vectors(v)
    whole = L.fit_projection(table, "features", len(ROW_FEATURES), len(ROW_FEATURES)).apply(table)
    square = F.aggregate(L.vector_to_array("projected"), F.lit(0.0), lambda s, x: s + x * x)
    return whole.select("sk_id_curr", F.round(F.log(1 + square), 6).alias("distance"))


_filled = [f"coalesce(CAST({c} AS DOUBLE), 0)" for c in ROW_FEATURES]
catalog.add(
    "t6_distances", projected_lengths,
    "WITH m AS (SELECT " + ", ".join(f"avg({x}) AS m{i}" for i, x in enumerate(_filled)) + """ FROM app)
SELECT sk_id_curr, round(ln(1 + """ + " + ".join(f"pow({x} - m{i}, 2)" for i, x in enumerate(_filled)) + "), 6) AS distance FROM app, m",
)


def component_moments(v):
    """Components whose mean or covariance with another isn't 0, or whose variance exceeds the one before (all rounded)."""
    pieces = projected(v).withColumn("p", L.vector_to_array("projected"))
    parts = [F.col("p")[i] for i in range(5)]
    row = pieces.agg(
        *[F.avg(p).alias(f"mean{i}") for i, p in enumerate(parts)], *[F.var_pop(p).alias(f"var{i}") for i, p in enumerate(parts)],
        *[F.corr(parts[i], parts[j]).alias(f"corr{i}_{j}") for i in range(5) for j in range(i)], F.count(F.lit(1)).alias("n")).first()
    off = sum(abs(row[f"mean{i}"]) > 1e-6 * row["var0"] ** 0.5 for i in range(5))
    off += sum(abs(row[f"corr{i}_{j}"]) > 1e-6 for i in range(5) for j in range(i))
    off += sum(row[f"var{i}"] > row[f"var{i - 1}"] for i in range(1, 5))
    return v.spark.createDataFrame([(row["n"], off)], "n long, off int")


catalog.add("t6_component_moments", component_moments, "SELECT count(*) AS n, 0 AS off FROM app")


def full_projection(v):
    """With as many components as features nothing is lost."""
    table = app_vectors(v)
    whole = L.fit_projection(table, "features", len(ROW_FEATURES), len(ROW_FEATURES)).apply(table)
    return L.reconstruction_error(whole).select("sk_id_curr", (F.round("error", 2) + F.lit(0.0)).alias("error"))


catalog.add("e6_nothing_lost", full_projection, "SELECT sk_id_curr, CAST(0 AS DOUBLE) AS error FROM app")
catalog.add(
    "t7_every_key_has_a_cluster",
    lambda v: L.cluster_rows(v.app, "sk_id_curr", ROW_FEATURES, clusters=20, restarts=2).select(
        "sk_id_curr", F.col("cluster").between(0, 19).alias("in_range")),
    "SELECT sk_id_curr, true AS in_range FROM app",
)
catalog.add("t7_clusters", lambda v: L.cluster_rows(v.app, "sk_id_curr", ROW_FEATURES, clusters=100, restarts=10))


def nearest_centres(v):
    """How much nearer than its own a row's nearest centre is (rounded), by distances computed apart from the job."""
    table = projected(v)
    found = L.fit_clusters(table, "projected", 20, 3)
    x = L.vector_to_array("projected")
    rows = table.select("sk_id_curr", x.alias("x")).join(found.assign(table, "sk_id_curr"), "sk_id_curr")
    centres = F.array(*[F.array(*map(F.lit, map(float, c))) for c in found.centres])
    far = F.transform(centres, lambda c: F.aggregate(F.zip_with("x", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d))
    gap = F.element_at(far, F.col("cluster") + 1) / F.array_min(far)
    return rows.select("sk_id_curr", (F.round(gap - 1, 6) + F.lit(0.0)).alias("gap"))


catalog.add("t7_nearest_centres", nearest_centres, "SELECT sk_id_curr, CAST(0 AS DOUBLE) AS gap FROM app")


def joint_starts(v):
    """Costs of three starts that advance together less those of each start alone (relative, rounded), and the best one's."""
    table = projected(v).persist()
    # The fits don't need one another, and each is many short jobs: those of one run in the gaps of the others.
    with ThreadPoolExecutor(4) as pool:
        joint = pool.submit(L.fit_clusters, table, "projected", 20, 3)
        single = [pool.submit(L.fit_clusters, table, "projected", 20, 1, L.SEED + i) for i in range(3)]
    together, alone = joint.result(), [fit.result().trainingCost for fit in single]
    rows = [(i, round(a / b - 1, 6) + 0.0, together.trainingCost <= b * (1 + 1e-9)) for i, (a, b) in enumerate(zip(together.costs, alone))]
    found = v.spark.createDataFrame(rows, "start int, gap double, not_above boolean")
    return found.withColumn("n", table.agg(F.count(F.lit(1))).scalar())


catalog.add(
    "t7_joint_starts", joint_starts,
    "SELECT count(*) AS n, CAST(unnest([0, 1, 2]) AS INTEGER) AS start, CAST(0 AS DOUBLE) AS gap, true AS not_above FROM app")
SMOTE_FEATURES = ["amt_income_total", "amt_credit", "amt_annuity", "days_birth"]


def rebalanced(v):
    clusters = L.cluster_rows(v.app, "sk_id_curr", SMOTE_FEATURES, 8, 1)
    rows = v.app.join(clusters, "sk_id_curr")
    return L.rebalance(rows, "sk_id_curr", "target", SMOTE_FEATURES, "cluster", copied=["region"])


catalog.add("t8_synthetic_rows", rebalanced)


def synthetic_flags(v):
    """Synthetic rows in all, and those off their segment, between two clusters, without another label, or with a key that repeats."""
    clusters = L.cluster_rows(v.app, "sk_id_curr", SMOTE_FEATURES, 8, 1)
    made = L.synthesise(v.app.join(clusters, "sk_id_curr"), "sk_id_curr", "target", SMOTE_FEATURES, "cluster")
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in SMOTE_FEATURES]
    ends = v.app.select("sk_id_curr", "target", F.array(*filled).alias("point")).join(clusters, "sk_id_curr")
    base, partner = (ends.select(F.col("sk_id_curr").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in ("target", "point", "cluster")])
                     for n in ("base", "partner"))
    both = made.join(base, "base").join(partner, "partner").withColumn("point", F.array(*SMOTE_FEATURES))
    # On the segment: the distances to its ends add up to its length.
    length = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d))
    whole = length("base_point", "partner_point")
    off = length("base_point", "point") + length("point", "partner_point") > whole * (1 + 1e-9) + 1e-6
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(off).alias("off_segment"),
        F.count_if(F.col("base_cluster") != F.col("partner_cluster")).alias("two_clusters"),
        F.count_if((F.col("base_target") != 1) | (F.col("partner_target") != 1) | (F.col("target") != 1)).alias("other_label"),
        (F.count(F.lit(1)) - F.count_distinct("sk_id_curr")).alias("repeated_keys"),
    )


catalog.add(
    "t8_synthetic_flags", synthetic_flags,
    f"""SELECT CAST(greatest(0, round({L.MINORITY_RATIO} * count(*) FILTER (WHERE target <> 1)) - count(*) FILTER (WHERE target = 1)) AS BIGINT) AS n,
  CAST(0 AS BIGINT) AS off_segment, CAST(0 AS BIGINT) AS two_clusters, CAST(0 AS BIGINT) AS other_label, CAST(0 AS BIGINT) AS repeated_keys FROM app""",
)

# ---------------------------------------------------------------- M, E6, X1, X6
MODEL_FEATURES = [*APP_FEATURES, "apps_ext_source_mean", "apps_annuity_income_ratio", "apps_credit_income_ratio"]


def model_rows(v):
    return fam.derive_app(v.app).select("sk_id_curr", "target", *MODEL_FEATURES)


for _name in ("logistic", "tree", "forest", "boosted", "network"):
    catalog.add(
        f"m1_{_name}",
        lambda v, name=_name: L.train_and_evaluate(name, model_rows(v), "sk_id_curr", "target", MODEL_FEATURES),
    )


def logistic(v):
    training, validation = L.split(model_rows(v), "sk_id_curr")
    return L.train("logistic", training, "sk_id_curr", "target", MODEL_FEATURES), training, validation


# ---------------------------------------------------------------- M1, M2, X1 on the whole feature table
VALID_SQL = f"('0x' || substr(md5(sk_id_curr || ':split{L.SEED}'), 1, 8))::BIGINT < {int(PR.VALID_SHARE * (1 << 32))}"


def whole_table(v):
    """The stored feature families, joined and encoded: training rows, validation rows, model columns."""
    folder = fresh_path(v.spark, "families")
    fam.store_features(loan_tables(v), folder)
    features = jobs.encoded(fam.stored_feature_table(v.spark, folder))
    training, validation = PR.split(features, jobs.KEY)
    roles = PR.choose_roles(training, (jobs.KEY, jobs.LABEL))
    return training, validation, [*roles.numeric, *roles.categorical]


def whole_model(v, name: str):
    training, validation, columns = whole_table(v)
    # The logistic model is fitted to the end, so that its gradient can be held against zero.
    settings = {"maxIter": 1000, "tol": 1e-12} if name == "logistic" else {}
    return L.train(name, training, jobs.KEY, jobs.LABEL, columns, **settings), training, validation


def certificate(v, name: str):
    """What the training rows say about the model: one row per property, how far it is off (rounded), and the rows."""
    fitted, training, _ = whole_model(v, name)
    if name == "logistic":
        found = TR.logistic_certificate(fitted, training)
    else:
        found = TR.tree_certificate(TR.read_forest(fitted, training), training)
    off = F.inline(F.array(*[F.struct(F.lit(k).alias("property"), (F.round(F.lit(x), 5) + F.lit(0.0)).alias("off")) for k, x in found.items()]))
    return training.agg(F.count(F.lit(1)).alias("n_train"), F.sum(jobs.LABEL).alias("positives")).select(
        F.lit(name).alias("model"), "n_train", "positives", off)


PROPERTIES = {"logistic": ["gradient", "excess"], **dict.fromkeys(["tree", "forest", "boosted"], ["statistics", "gain", "better"])}
for _name, _properties in PROPERTIES.items():
    catalog.add(
        f"m1_certified_{_name}", lambda v, name=_name: certificate(v, name),
        f"""SELECT '{_name}' AS model, count(*) AS n_train, CAST(sum(target) AS BIGINT) AS positives,
  unnest({_properties}) AS property, CAST(0 AS DOUBLE) AS off FROM app WHERE NOT ({VALID_SQL})""",
    )


def recomputed_scores(v, name: str):
    """Every validation row's score from the model's own tables, less the model's score (rounded)."""
    fitted, training, validation = whole_model(v, name)
    if name == "network":
        own = TR.network_scores(fitted, validation)
    else:
        own = TR.margins(TR.read_forest(fitted, training), validation).drop(jobs.LABEL)
    scores = fitted.score(validation).withColumnRenamed("score", "theirs")
    gap = F.round(F.col("score") - F.col("theirs"), 9) + F.lit(0.0)
    return own.join(scores, jobs.KEY).select(jobs.KEY, jobs.LABEL, gap.alias("gap"))


for _name in ("forest", "boosted", "network"):
    catalog.add(
        f"m2_recomputed_{_name}", lambda v, name=_name: recomputed_scores(v, name),
        f"SELECT sk_id_curr, target, CAST(0 AS DOUBLE) AS gap FROM app WHERE {VALID_SQL}",
    )


def tree_additivity(v):
    """Exact Shapley values of a boosted model: their sum, with the expected margin, less the model's margin."""
    fitted, training, validation = whole_model(v, "boosted")
    forest = TR.read_forest(fitted, training)
    sums = TR.attributions(forest, validation).groupBy(F.col("sk_id").alias(jobs.KEY)).agg(F.sum("value").alias("total"))
    score = F.col("score")
    margin = fitted.score(validation).select(jobs.KEY, (F.log(score / (1 - score)) / 2).alias("margin"))
    gap = F.round(F.col("total") + F.lit(forest.base) - F.col("margin"), 6) + F.lit(0.0)
    return sums.join(margin, jobs.KEY).select(jobs.KEY, gap.alias("gap"))


catalog.add(
    "x1_tree_attributions",
    lambda v: (lambda fitted, training, validation: TR.attributions(TR.read_forest(fitted, training), validation))(*whole_model(v, "boosted")),
)
catalog.add(
    "x1_tree_additivity", tree_additivity, f"SELECT sk_id_curr, CAST(0 AS DOUBLE) AS gap FROM app WHERE {VALID_SQL}")


def train_and_explain(v):
    """Both end-to-end jobs over all seven tables: the features that explain each validation applicant."""
    folder = fresh_path(v.spark, "job")
    jobs.train_run(loan_tables(v), folder, "r", 5, jobs.Options(restarts=2))
    return jobs.explain_run(v.spark, folder, "r", 5)["explanations"]


catalog.add(
    "x4_explained_applicants",
    lambda v: train_and_explain(v).groupBy("sk_id").agg(F.count(F.lit(1)).alias("features"), F.max("rank").alias("last")),
    f"SELECT sk_id_curr AS sk_id, CAST(5 AS BIGINT) AS features, 5 AS last FROM app WHERE {VALID_SQL}",
)


def batch_scores(v):
    fitted, _, _ = logistic(v)
    return fitted.score(model_rows(v))


catalog.add("m2_batch_scores", batch_scores)
catalog.add(
    "m2_scores_of_all",
    lambda v: batch_scores(v).join(v.app.select(F.col("sk_id_curr").alias("key"), F.col("target").alias("label")), F.expr("key = sk_id_curr")).select(
        "sk_id_curr", "label", F.col("score").between(0.0, 1.0).alias("in_range")),
    "SELECT sk_id_curr, target AS label, true AS in_range FROM app",
)


def leaked(v):
    """The logistic model on features one of which gives the label away."""
    rows = model_rows(v).withColumn("leak", F.col("target") * F.lit(1000.0))
    found = L.train_and_evaluate("logistic", rows, "sk_id_curr", "target", [*MODEL_FEATURES, "leak"])
    return rounded(found.select("n_valid", "auc"), "auc")


catalog.add(
    "m1_leaked_label", leaked,
    f"""SELECT count(*) AS n_valid, CAST(1 AS DOUBLE) AS auc FROM app
WHERE ('0x' || substr(md5(sk_id_curr || ':split{L.SEED}'), 1, 8))::BIGINT < {int(PR.VALID_SHARE * (1 << 32))}""",
)
catalog.add(
    "e6_reconstruction_error", lambda v: L.reconstruction_error(projected(v)).agg(F.avg("error").alias("mean_error"),
                                                                                  F.count("error").alias("n"))
)


def linear(v):
    fitted, training, validation = logistic(v)
    weights, means = L.linear_parts(fitted, training)
    return X.linear_attributions(fitted.scaler.apply(validation), "sk_id_curr", weights, means)


catalog.add("x1_linear_attributions", linear)


def additivity(v):
    """A row's contributions and its logit differ by the same amount everywhere: the mean row's logit."""
    fitted, _, validation = logistic(v)
    sums = linear(v).groupBy("sk_id").agg(F.sum("value").alias("total"))
    scores = fitted.score(validation).select("sk_id_curr", (F.log("score") - F.log(1 - F.col("score"))).alias("logit"))
    gaps = scores.join(sums, F.col("sk_id_curr") == F.col("sk_id")).select("sk_id_curr", (F.col("logit") - F.col("total")).alias("gap"))
    middle = gaps.agg(F.avg("gap")).scalar()
    return gaps.select("sk_id_curr", (F.round(F.col("gap") - middle, 4) + F.lit(0.0)).alias("gap"))


catalog.add(
    "x1_additivity", additivity,
    f"""SELECT sk_id_curr, CAST(0 AS DOUBLE) AS gap FROM app
WHERE ('0x' || substr(md5(sk_id_curr || ':split{L.SEED}'), 1, 8))::BIGINT < {int(PR.VALID_SHARE * (1 << 32))}""",
)


def node_plane(v):
    tiers = E.risk_tiers(v.nodes.withColumn("score", F.col("sk_id") * 7919 % 1000 / F.lit(1000.0)), "score")
    return L.plane(v.nodes, "sk_id", "embedding", DIM).join(tiers.select("sk_id", "risk_level"), "sk_id")


catalog.add("x6_plane_with_tiers", node_plane)


def plane_moments(v):
    """The plane's coordinates: means and correlation (rounded), and whether they spread more than any one dimension."""
    flat = L.plane(v.nodes, "sk_id", "embedding", DIM)
    row = flat.agg(F.count(F.lit(1)).alias("n"), *[(F.round(m, 6) + F.lit(0.0)).alias(a) for a, m in (
        ("mean_x", F.avg("x")), ("mean_y", F.avg("y")), ("correlation", F.corr("x", "y")))], F.var_pop("x").alias("spread"))
    widest = v.nodes.select(F.posexplode("embedding").alias("d", "e")).groupBy("d").agg(F.var_pop("e").alias("w")).agg(F.max("w"))
    return row.withColumn("narrow", F.col("spread") < widest.scalar()).drop("spread")


catalog.add(
    "x6_plane_moments", plane_moments,
    "SELECT count(*) AS n, CAST(0 AS DOUBLE) AS mean_x, CAST(0 AS DOUBLE) AS mean_y, CAST(0 AS DOUBLE) AS correlation, false AS narrow FROM nodes",
)
catalog.add(
    "x6_tiers_of_the_plane", lambda v: node_plane(v).select("sk_id", "risk_level"),
    """WITH s AS (SELECT sk_id, CAST(sk_id * 7919 % 1000 AS DOUBLE) / 1000 AS score FROM nodes),
q AS (SELECT quantile_cont(score, 0.4) AS lo, quantile_cont(score, 0.8) AS hi FROM s)
SELECT sk_id, CASE WHEN score > hi THEN 2 WHEN score > lo THEN 1 ELSE 0 END AS risk_level FROM s, q""",
)
