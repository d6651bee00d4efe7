"""Feature preparation, clustering, regression, evaluation, scenarios, attribution."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window, functions as F

from cohortry.catalog.base import CATEGORICAL, NUMERIC, ROLES, ROWS_SQL, fact, lines, query, r6, rounded, table
from cohortry.operators import attribution as T
from cohortry.operators import clusters as C
from cohortry.operators import evaluation as E
from cohortry.operators import features as P
from cohortry.operators import kernels as L
from cohortry.operators import kprototypes as K
from cohortry.operators import regression as M
from cohortry.operators import scenarios as W
from cohortry.operators import tuning as G
from cohortry.operators.kmeans import MiniBatchKMeans
from cohortry.operators.hypothesis import long_categories
from cohortry.operators.reshape import stack
from cohortry.operators.rows import with_fold
from cohortry.plans.study import compare_cluster_counts, policy_report, run_study, study_reports
from cohortry.roles import ColumnRoles
from cohortry.session import shared_dir, stored
from cohortry.sources.stores import load_model_with_features, params_frame, read_params, save_model, write_params

KEYS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
TARGETED = ColumnRoles(("l_quantity", "l_discount", "l_tax"), tuple(CATEGORICAL), "l_extendedprice", KEYS)
_BUCKET = "CAST(concat('0x', substr(md5(concat_ws(':', '42', l_orderkey, l_partkey, l_suppkey, l_linenumber)), 1, 8)) AS BIGINT) % 100"


def _columns(spark, sf):
    """The model columns of the study rows."""
    return lines(spark, sf).select(*KEYS, *NUMERIC, *CATEGORICAL, "l_shipdate", "ratio", "p_size", "o_orderstatus")


def _held(spark, sf):
    """The model columns written to the shared folder once, for queries that read them several times."""
    return stored(_columns(spark, sf), "columns")


# ---------------------------------------------------------------- feature preparation

_HOLES = """holes AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber <> 3 THEN l_tax END AS l_tax,
                    CASE WHEN l_linenumber <> 5 THEN l_returnflag END AS l_returnflag FROM lineitem)"""


def _holes(spark, sf):
    return fact(spark, sf).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.when(F.col("l_linenumber") != 3, F.col("l_tax")).alias("l_tax"),
        F.when(F.col("l_linenumber") != 5, F.col("l_returnflag")).alias("l_returnflag"),
    )


@query(
    "f01_impute",
    f"""WITH {_HOLES}, fill AS (SELECT (SELECT median(l_tax) FROM holes) AS t,
          (SELECT l_returnflag FROM holes WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS f)
        SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce(l_tax, t), 6) AS l_tax, coalesce(l_returnflag, f) AS l_returnflag FROM holes, fill""",
)
def _(spark, sf):
    rows = _holes(spark, sf)
    return rounded(P.MixedImputer(numericCols=["l_tax"], categoricalCols=["l_returnflag"]).fit(rows).transform(rows))


def _z_sql(columns, source="lineitem"):
    return ", ".join(f"round(({c} - (SELECT avg({c}) FROM {source})) / (SELECT stddev_pop({c}) FROM {source}), 6) + 0.0 AS {c}" for c in columns)


@query("f02_population_scaling", f"SELECT l_orderkey, l_linenumber, l_partkey, {_z_sql(NUMERIC)} FROM lineitem")
def _(spark, sf):
    rows = fact(spark, sf)
    scaled = P.PopulationScaler(inputCols=NUMERIC, outputCols=NUMERIC).fit(rows).transform(rows)
    return rounded(scaled.select("l_orderkey", "l_linenumber", "l_partkey", *NUMERIC))


@query(
    "f03_one_hot_unknown",
    """SELECT o_orderpriority, count(*) AS n, CAST(sum(CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE 1 END) AS DOUBLE) AS ones FROM orders GROUP BY 1""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderpriority")
    stages = Pipeline(stages=P.encoding_stages(ColumnRoles(categorical=("o_orderpriority",))))
    model = stages.fit(orders.filter("o_orderpriority <> '5-LOW'"))
    ones = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x)
    return model.transform(orders).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum(ones).alias("ones"))


@query(
    "f04_dummy_columns",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_returnflag = 'A' AS INTEGER) AS "l_returnflag_A", CAST(l_returnflag = 'N' AS INTEGER) AS "l_returnflag_N",
       CAST(l_returnflag = 'R' AS INTEGER) AS "l_returnflag_R", CAST(l_linestatus = 'F' AS INTEGER) AS "l_linestatus_F", CAST(l_linestatus = 'O' AS INTEGER) AS "l_linestatus_O" FROM lineitem""",
)
def _(spark, sf):
    return P.dummy_columns(fact(spark, sf), ["l_returnflag", "l_linestatus"], ["l_orderkey", "l_linenumber", "l_partkey"])


@query(
    "f04_dummies_long",
    """SELECT l_linenumber, u.f AS feature, u.c AS category, count(*) AS n FROM
       (SELECT l_linenumber, unnest([{'f': 'l_returnflag', 'c': l_returnflag}, {'f': 'l_linestatus', 'c': l_linestatus}]) AS u FROM lineitem) GROUP BY ALL""",
)
def _(spark, sf):
    long = long_categories(fact(spark, sf), ["l_returnflag", "l_linestatus"], ["l_linenumber"])
    return long.groupBy("l_linenumber", "feature", "category").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f05_f06_f08_prepare_regression",
    f"""WITH {ROWS_SQL}, kept AS (SELECT *, CASE WHEN {_BUCKET} < 20 THEN 'test' ELSE 'train' END AS part FROM lines WHERE year(l_shipdate) >= 1997)
        SELECT part, count(*) AS n, round(sum(l_extendedprice), 2) AS label, (SELECT CAST(1 + count(DISTINCT l_returnflag) + count(DISTINCT l_linestatus) + count(DISTINCT o_orderpriority) AS INTEGER) FROM kept) AS slots FROM kept GROUP BY 1""",
)
def _(spark, sf):
    rows = lines(spark, sf).withColumn("year", F.year("l_shipdate"))
    roles = ColumnRoles(("l_quantity", "l_discount", "l_tax", "o_totalprice"), (*CATEGORICAL, "p_brand"), "l_extendedprice", KEYS)
    made = P.prepare_regression(rows, roles, min_year=("year", 1997), leakage=("l_tax", "o_totalprice", "l_discount"), max_categories=20)
    both = stack([made.train.withColumn("part", F.lit("train")), made.test.withColumn("part", F.lit("test"))])
    return both.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("label"), 2).alias("label"), F.max(F.size(vector_to_array("features"))).alias("slots")
    )


@query(
    "f09_prepare_kmeans",
    f"""WITH {ROWS_SQL}, n AS (SELECT count(*) AS n FROM lines)
        SELECT feature, share FROM (
          SELECT 'l_quantity' AS feature, 1.0 AS share UNION ALL SELECT 'l_tax', 1.0
          UNION ALL SELECT concat('l_returnflag_', l_returnflag), round(count(*) / any_value(n), 6) FROM lines, n GROUP BY l_returnflag
          UNION ALL SELECT concat('o_orderpriority_', o_orderpriority), round(count(*) / any_value(n), 6) FROM lines, n GROUP BY o_orderpriority)""",
)
def _(spark, sf):
    roles = ColumnRoles(("l_quantity", "l_tax"), ("l_returnflag", "o_orderpriority"))
    rows, stages = P.prepare_kmeans(_columns(spark, sf), roles)
    slots = rows.select(F.posexplode(vector_to_array("features")).alias("slot", "x"))
    means = slots.groupBy("slot").agg(r6(F.avg(F.col("x") * F.col("x"))).alias("share"))  # the second moment: 1 for a scaled number
    return means.join(P.names_frame(spark, stages, roles), "slot").select("feature", "share")


@query(
    "f10_f11_prepare_kprototypes",
    f"""WITH {_HOLES}, filled AS (SELECT l_orderkey, l_linenumber, l_partkey, coalesce(l_tax, (SELECT median(l_tax) FROM holes)) AS l_tax,
          coalesce(l_returnflag, (SELECT l_returnflag FROM holes WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS l_returnflag FROM holes)
        SELECT l_orderkey, l_linenumber, l_partkey, {_z_sql(['l_tax'], 'filled')}, l_returnflag FROM filled""",
)
def _(spark, sf):
    ready, _ = P.prepare_kprototypes(_holes(spark, sf), ColumnRoles(("l_tax",), ("l_returnflag",)))
    return rounded(ready)


@query(
    "f12_encoded_names",
    f"""WITH {ROWS_SQL} SELECT 'l_quantity' AS feature, 'l_quantity' AS base UNION ALL SELECT DISTINCT concat('l_returnflag_', l_returnflag), 'l_returnflag' FROM lines
        UNION ALL SELECT DISTINCT concat('p_brand_', p_brand), 'p_brand' FROM lines""",
)
def _(spark, sf):
    roles = ColumnRoles(("l_quantity",), ("l_returnflag", "p_brand"))
    stages = Pipeline(stages=P.encoding_stages(roles)).fit(lines(spark, sf))
    return P.names_frame(spark, stages, roles).select("feature", "base")


@query("s11_s12_model_round_trip", f"SELECT l_orderkey, l_linenumber, l_partkey, {_z_sql(['l_quantity', 'l_tax'])} FROM lineitem")
def _(spark, sf):
    rows = fact(spark, sf)
    scaler = P.PopulationScaler(inputCols=["l_quantity", "l_tax"], outputCols=["l_quantity", "l_tax"])
    base = shared_dir(spark, "models")
    save_model(Pipeline(stages=[scaler]).fit(rows), f"{base}/searched")
    save_model(Pipeline(stages=[P.CodeText(inputCols=["l_linenumber"], outputCols=["line"])]).fit(rows), f"{base}/features")
    model, features = load_model_with_features(spark, [f"{base}/main", f"{base}/searched"], f"{base}/features")
    return rounded(features.transform(model.transform(rows)).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax"))


# ---------------------------------------------------------------- clustering

# fixed prototypes over raw columns, for the steps that SQL can follow
_PROTOTYPES = [((10.0, 0.02), ("A", "1-URGENT")), ((25.0, 0.05), ("N", "3-MEDIUM")), ((40.0, 0.08), ("R", "5-LOW"))]
_PN, _PC = ["l_quantity", "l_discount"], ["l_returnflag", "o_orderpriority"]
_DIST = [
    f"(l_quantity - {a}) * (l_quantity - {a}) + (l_discount - {b}) * (l_discount - {b}) + 7.5 * (CAST(l_returnflag <> '{c}' AS INTEGER) + CAST(o_orderpriority <> '{d}' AS INTEGER))"
    for (a, b), (c, d) in _PROTOTYPES
]
_ASSIGN = f"""{ROWS_SQL}, dist AS (SELECT *, {', '.join(f'{d} AS d{j}' for j, d in enumerate(_DIST))} FROM lines),
    near AS (SELECT *, least(d0, d1, d2) AS d, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS cluster FROM dist)"""


def _fixed_model():
    state = {"numeric": _PN, "categorical": _PC, "gamma": 7.5, "cost": 0.0, "iterations": 0, "history": [], "prototypes": _PROTOTYPES}
    return K.KPrototypesModel(state=json.dumps(state))


@query("c03_assign_prototypes", f"WITH {_ASSIGN} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, cluster FROM near")
def _(spark, sf):
    out = _fixed_model().transform(_columns(spark, sf))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "cluster")


@query("c04_clustering_cost", f"WITH {_ASSIGN} SELECT round(sum(d), 3) AS cost FROM near")
def _(spark, sf):
    return rounded(_fixed_model().compute_cost(_columns(spark, sf)), 3)


def _near_mode(c):
    return f"(SELECT cluster, {c} FROM (SELECT cluster, {c}, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, {c}) AS rn FROM near GROUP BY 1, 2) WHERE rn = 1)"


@query(
    "c01_prototype_step",
    f"""WITH {_ASSIGN}, s AS (SELECT cluster, count(*) AS size, round(sum(d), 3) AS cost, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_discount), 6) AS l_discount FROM near GROUP BY 1)
        SELECT cluster AS label, size, cost, l_quantity, l_discount, l_returnflag, o_orderpriority FROM s JOIN {_near_mode('l_returnflag')} USING (cluster) JOIN {_near_mode('o_orderpriority')} USING (cluster)""",
)
def _(spark, sf):
    out = K.step(K.coded(K.typed(_columns(spark, sf), _PN, _PC), _PN, _PC), _PN, _PC, {0: _PROTOTYPES}, 7.5).drop("run")
    return rounded(out.withColumn("cost", F.round("cost", 3)))


@query(
    "c02_category_densities",
    f"""WITH {ROWS_SQL}, n AS (SELECT count(*) AS n FROM lines), t AS (SELECT l_returnflag, l_linestatus, o_orderpriority FROM lines GROUP BY ALL),
        a AS (SELECT l_returnflag, count(*) AS na FROM lines GROUP BY 1), b AS (SELECT l_linestatus, count(*) AS nb FROM lines GROUP BY 1),
        c AS (SELECT o_orderpriority, count(*) AS nc FROM lines GROUP BY 1)
        SELECT l_returnflag, l_linestatus, o_orderpriority, round((na + nb + nc) / n / 3, 6) AS density FROM t JOIN a USING (l_returnflag) JOIN b USING (l_linestatus) JOIN c USING (o_orderpriority), n""",
)
def _(spark, sf):
    return rounded(K.cao_densities(K.typed(_columns(spark, sf), [], CATEGORICAL), CATEGORICAL))


def _prepared(spark, sf):
    return P.prepare_kprototypes(_held(spark, sf), ROLES)[0]


@query("c01_c02_kprototypes_fit")
def _(spark, sf):
    rows = _prepared(spark, sf)
    model = K.KPrototypes(numericCols=NUMERIC, categoricalCols=CATEGORICAL, k=3, maxIter=10).fit(rows)
    return C.cluster_sizes(model.transform(rows)).withColumn("cost", F.lit(model.cost))


@query("c05_k_sweep")
def _(spark, sf):
    return K.k_sweep(_prepared(spark, sf), K.KPrototypes(numericCols=NUMERIC, categoricalCols=CATEGORICAL), range(2, 16))[0]


@query("c06_c07_kmeans")
def _(spark, sf):
    rows = _held(spark, sf)
    model = C.fit_kmeans(rows, ROLES, 3, max_iter=10)
    return C.cluster_sizes(C.predict_kmeans(model, rows, ROLES))


@query("c06_nearest_centre", "SELECT count(*) AS n, count(*) AS n_nearest, CAST(3 AS BIGINT) AS n_clusters FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey")
def _(spark, sf):
    """Every row lies in the cluster whose centre is nearest, by distances worked out from the centres."""
    rows = _held(spark, sf)
    model = C.fit_kmeans(rows, ROLES, 3, max_iter=10)
    x = vector_to_array("kmeans_features")
    far = [
        F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in centre]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
        for centre in model.stages[-1].clusterCenters()
    ]
    least = F.least(*far)
    own = F.element_at(F.array(*far), F.col("cluster") + 1)
    return model.transform(rows).select("cluster", (own <= least + 1e-9).alias("near")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("near").alias("n_nearest"), F.count_distinct("cluster").alias("n_clusters")
    )


@query(
    "c06_mini_batch_step",
    """WITH a AS (SELECT l_quantity AS x, l_linenumber AS y, CASE WHEN (l_quantity - 10) ^ 2 + (l_linenumber - 2) ^ 2 <= (l_quantity - 40) ^ 2 + (l_linenumber - 5) ^ 2 THEN 0 ELSE 1 END AS c FROM lineitem)
       SELECT CAST(c AS INTEGER) AS cluster, round(avg(x), 5) AS quantity, round(avg(y), 5) AS line FROM a GROUP BY 1""",
)
def _(spark, sf):
    """One epoch of one batch moves every centre to the mean of the rows nearest to it."""
    rows = VectorAssembler(inputCols=["l_quantity", "l_linenumber"], outputCol="features").transform(fact(spark, sf))
    model = MiniBatchKMeans(k=2, batches=1, maxIter=1, start="[[10, 2], [40, 5]]").fit(rows)
    found = [(i, round(float(x), 5), round(float(y), 5)) for i, (x, y) in enumerate(model.clusterCenters())]
    return spark.createDataFrame(found, "cluster int, quantity double, line double")


# a cluster column SQL can reproduce
_CLUSTERED = f"{ROWS_SQL}, k AS (SELECT *, CAST(l_linenumber % 3 AS INTEGER) AS cluster FROM lines)"


def _clustered(spark, sf):
    return _columns(spark, sf).withColumn("cluster", (F.col("l_linenumber") % 3).cast("int"))


@query("c08_cluster_sizes", f"WITH {_CLUSTERED} SELECT cluster, count(*) AS count FROM k GROUP BY 1")
def _(spark, sf):
    return C.cluster_sizes(_clustered(spark, sf))


@query("c09_numeric_profile", f"WITH {_CLUSTERED} SELECT cluster, {', '.join(f'round(avg({c}), 6) AS {c}' for c in NUMERIC)} FROM k GROUP BY 1")
def _(spark, sf):
    return rounded(C.numeric_profile(_clustered(spark, sf), NUMERIC))


def _k_mode(c):
    return f"(SELECT cluster, {c} FROM (SELECT cluster, {c}, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, {c}) AS rn FROM k GROUP BY 1, 2) WHERE rn = 1)"


@query("c10_categorical_profile", f"WITH {_CLUSTERED} SELECT * FROM {_k_mode('l_returnflag')} JOIN {_k_mode('l_linestatus')} USING (cluster) JOIN {_k_mode('o_orderpriority')} USING (cluster)")
def _(spark, sf):
    return C.categorical_profile(_clustered(spark, sf), CATEGORICAL)


def _dummy(feature, value):
    return f"SELECT cluster, '{feature}' AS feature, '{value}' AS value, CAST({feature} = '{value}' AS DOUBLE) AS x FROM k"


_DUMMIES = " UNION ALL ".join(
    [f"SELECT cluster, '{c}' AS feature, NULL AS value, {c} AS x FROM k" for c in NUMERIC]
    + [_dummy("l_returnflag", v) for v in "ANR"]
    + [_dummy("o_orderpriority", v) for v in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")]
)
_ZSQL = f"""{_CLUSTERED}, x AS ({_DUMMIES}), g AS (SELECT feature, value, avg(x) AS m, stddev_samp(x) AS s FROM x GROUP BY 1, 2),
    z AS (SELECT cluster, x.feature, x.value, (avg(x) - any_value(m)) / (any_value(s) + 1e-9) AS z FROM x JOIN g ON x.feature = g.feature AND x.value IS NOT DISTINCT FROM g.value GROUP BY 1, 2, 3)"""


@query("c11_relative_importance", f"WITH {_ZSQL} SELECT cluster, feature, value, round(z, 6) + 0.0 AS z FROM z")
def _(spark, sf):
    return rounded(C.relative_importance(_clustered(spark, sf), NUMERIC, ["l_returnflag", "o_orderpriority"]))


@query(
    "c12_a18_aggregated_importance",
    f"WITH {_ZSQL} SELECT cluster, feature, round(CASE WHEN max(value) IS NULL THEN max(z) ELSE avg(abs(z)) END, 6) + 0.0 AS score FROM z GROUP BY 1, 2",
)
def _(spark, sf):
    return rounded(C.aggregated_importance(C.relative_importance(_clustered(spark, sf), NUMERIC, ["l_returnflag", "o_orderpriority"])))


def _labelled(spark, sf):
    return stored(_fixed_model().transform(_columns(spark, sf)), "labelled")


@query("c13_cluster_drivers")
def _(spark, sf):
    return C.cluster_drivers(_labelled(spark, sf), ROLES, trees=10, depth=5)


@query(
    "c13_driver_names",
    """SELECT feature, CAST(1.0 AS DOUBLE) AS total FROM (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature
       UNION SELECT 'l_returnflag_' || l_returnflag FROM lineitem UNION SELECT 'l_linestatus_' || l_linestatus FROM lineitem
       UNION SELECT 'o_orderpriority_' || o_orderpriority FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)""",
)
def _(spark, sf):
    """One driver per number and per category met, with importances that sum to one."""
    drivers = C.cluster_drivers(_labelled(spark, sf), ROLES, trees=10, depth=5)
    return drivers.select("feature", F.round(F.sum("importance").over(Window.partitionBy()), 9).alias("total"))


@query("c14_rule_rows", "SELECT count(*) AS n, true AS pure FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey")
def _(spark, sf):
    """The rules of a tree part the rows: every row is in one leaf."""
    rules = C.cluster_rules(_labelled(spark, sf), ROLES, depth=3)
    return rules.agg(F.sum("n_rows").alias("n"), F.min(F.col("purity") >= 1 / 3).alias("pure"))


@query("c14_cluster_rules")
def _(spark, sf):
    return C.cluster_rules(_labelled(spark, sf), ROLES, depth=3)


@query("c15_mixed_projection")
def _(spark, sf):
    out = C.mixed_projection(_held(spark, sf), ROLES, 5, ["l_linestatus"])
    return out.select("l_linestatus", F.posexplode("components").alias("axis", "x")).groupBy("l_linestatus", "axis").agg(
        F.avg("x").alias("mean"), F.var_pop("x").alias("variance")
    )


def _projection_sql():
    """Sums of the variances and of their squares over all axes, from shares, deviations and pair counts alone."""
    flags = "\n UNION ALL ".join(f"SELECT id, '{c}' AS f, {c} AS u FROM t WHERE {c} IS NOT NULL" for c in CATEGORICAL)
    numbers = " + ".join(f"2 * (SELECT corr({c}, {d}) ^ 2 FROM t)" for c in NUMERIC for d in NUMERIC if c < d)
    mixed = " + ".join(f"2 * (SELECT sum((n * m / total) ^ 2 / (n / total)) FROM (SELECT u, count(*) AS n, avg(z) AS m FROM flags JOIN (SELECT id, ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS z FROM t) USING (id) GROUP BY f, u), (SELECT count(*) AS total FROM t))" for c in NUMERIC)
    return f"""WITH t AS MATERIALIZED (SELECT row_number() OVER () AS id, {', '.join([*NUMERIC, *CATEGORICAL])} FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
        flags AS ({flags}), one AS (SELECT f, u, count(*) / (SELECT count(*) FROM t) AS p FROM flags GROUP BY 1, 2),
        two AS (SELECT a.f, a.u, b.f AS g, b.u AS v, count(*) / (SELECT count(*) FROM t) AS p FROM flags a JOIN flags b USING (id) GROUP BY 1, 2, 3, 4),
        grid AS (SELECT (coalesce(two.p, 0) - a.p * b.p) ^ 2 / (a.p * b.p) AS c FROM one a CROSS JOIN one b LEFT JOIN two ON two.f = a.f AND two.u = a.u AND two.g = b.f AND two.v = b.u)
        SELECT round({len(NUMERIC)} + (SELECT sum(1 - p) FROM one), 6) AS variances, round({len(NUMERIC)} + {numbers} + {mixed} + (SELECT sum(c) FROM grid), 6) AS squares"""


@query("c15_axis_variances", _projection_sql())
def _(spark, sf):
    """All axes of the projected rows: their variances add up to that of the table, their squares to its squared covariances."""
    every = C.mixed_projection(_held(spark, sf), ROLES, 100)
    axes = every.select(F.posexplode("components").alias("axis", "x")).groupBy("axis").agg(F.var_pop("x").alias("v"))
    return axes.agg(F.round(F.sum("v"), 6).alias("variances"), F.round(F.sum(F.col("v") * F.col("v")), 6).alias("squares"))


@query("c16_compare_cluster_counts")
def _(spark, sf):
    return compare_cluster_counts(
        _columns(spark, sf), "all", TARGETED, ColumnRoles(NUMERIC, CATEGORICAL), [2, 3], params={"n_estimators": 5, "max_depth": 4},
        options={"nInit": 1, "maxIter": 4},
    )


# ---------------------------------------------------------------- regression


def _made(spark, sf, roles=TARGETED):
    return P.prepare_regression(_columns(spark, sf), roles)


def _metrics(model, made):
    return E.metrics_report({"all": model.transform(made.test)})


@query("m01_e02_forest")
def _(spark, sf):
    made = _made(spark, sf)
    return _metrics(M.fit_cached(M.forest({"n_estimators": 10, "max_depth": 5, "max_features": "sqrt"}), made.train), made)


@query("m02_gradient_boosting")
def _(spark, sf):
    made = _made(spark, sf)
    return _metrics(M.fit_cached(M.boosting({"n_estimators": 5, "learning_rate": 0.1, "max_depth": 3, "subsample": 0.9}), made.train), made)


@query("m03_histogram_boosting")
def _(spark, sf):
    made = _made(spark, sf)
    return _metrics(M.fit_cached(M.histogram_boosting({"n_estimators": 5, "learning_rate": 0.1, "num_leaves": 70, "max_depth": 20, "min_child_samples": 20, "reg_alpha": 0.1, "reg_lambda": 0.1}), made.train), made)


_THREE = ("l_quantity", "l_discount", "l_tax")


def _three(spark, sf):
    """Lines with three numbers as features and the price as label."""
    rows = table(spark, sf, "lineitem").select(*KEYS, "l_linestatus", *_THREE, F.col("l_extendedprice").alias("label"))
    return VectorAssembler(inputCols=list(_THREE), outputCol="features").transform(rows)


@query(
    "m01_tree_to_the_leaves",
    """SELECT l_linestatus, count(*) AS n, round(avg(p), 4) AS mean, round(avg(p * y) / 1e6, 4) AS product FROM
       (SELECT l_linestatus, l_extendedprice AS y, avg(l_extendedprice) OVER (PARTITION BY l_quantity, l_discount, l_tax) AS p FROM lineitem) GROUP BY 1""",
)
def _(spark, sf):
    """A tree without limits ends in leaves of equal features, so it predicts their mean label."""
    rows = _three(spark, sf)
    scored = M.fit_cached(M.forest({"n_estimators": 1, "max_depth": None, "bootstrap": False}), rows).transform(rows)
    return scored.groupBy("l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("prediction"), 4).alias("mean"), F.round(F.avg(F.col("prediction") * F.col("label")) / 1e6, 4).alias("product")
    )


@query(
    "m03_first_split_gain",
    """WITH r AS (SELECT *, l_extendedprice - avg(l_extendedprice) OVER () AS g FROM lineitem),
       u AS (SELECT unnest([{'f': 'l_quantity', 'v': l_quantity}, {'f': 'l_discount', 'v': l_discount}, {'f': 'l_tax', 'v': l_tax}], recursive := true), g FROM r),
       v AS (SELECT f, v, count(*) AS n, sum(g) AS s FROM u GROUP BY 1, 2),
       c AS (SELECT f, v, lead(v) OVER w AS nxt, sum(n) OVER w AS nl, sum(s) OVER w AS gl, sum(n) OVER a AS n, sum(s) OVER a AS g FROM v
             WINDOW w AS (PARTITION BY f ORDER BY v), a AS (PARTITION BY f)),
       p AS (SELECT f, (v + nxt) / 2 AS t, gl, nl, abs(gl) - 1000.0 AS tl, abs(g - gl) - 1000.0 AS tr, n - nl AS nr FROM c WHERE nxt IS NOT NULL AND nl >= 20 AND n - nl >= 20),
       q AS (SELECT *, greatest(tl, 0) ^ 2 / (nl + 50.0) + greatest(tr, 0) ^ 2 / (nr + 50.0) AS gain FROM p ORDER BY gain DESC LIMIT 1)
       SELECT f AS feature, round(t, 6) AS threshold, round(gain / 1e12, 5) AS gain, round(sign(gl) * greatest(tl, 0) / (nl + 50.0), 3) AS left_value FROM q""",
)
def _(spark, sf):
    """The first split of leaf-wise boosting with both penalties: the best of all boundaries of all features."""
    model = M.fit_cached(M.histogram_boosting({"n_estimators": 1, "learning_rate": 1.0, "num_leaves": 2, "reg_alpha": 1000.0, "reg_lambda": 50.0}), _three(spark, sf))
    names = F.array(*map(F.lit, _THREE))
    return model.rows.select(
        F.element_at(names, F.get("slot", F.lit(0)) + 1).alias("feature"),
        F.round(F.get("threshold", F.lit(0)), 6).alias("threshold"),
        F.round(F.get("gain", F.lit(0)) / 1e12, 5).alias("gain"),
        F.round(F.get("value", F.get("left", F.lit(0))), 3).alias("left_value"),
    )


@query(
    "m02_two_rounds_of_one_feature",
    """WITH a AS (SELECT *, l_extendedprice - avg(l_extendedprice) OVER () AS g, avg(l_extendedprice) OVER () AS base FROM lineitem),
       b AS (SELECT *, avg(g) OVER (PARTITION BY l_linenumber) AS p1 FROM a)
       SELECT l_linenumber, count(*) AS n, round(base + 0.5 * p1 + 0.5 * 0.5 * p1, 4) AS prediction FROM b GROUP BY l_linenumber, base, p1""",
)
def _(spark, sf):
    """Seven line numbers fit seven leaves; the second round finds half of the first one's values left."""
    rows = table(spark, sf, "lineitem").select(*KEYS, F.col("l_extendedprice").alias("label"))
    rows = VectorAssembler(inputCols=["l_linenumber"], outputCol="features").transform(rows)
    model = M.fit_cached(M.boosting({"n_estimators": 2, "learning_rate": 0.5, "max_depth": 7}), rows)
    return model.transform(rows).groupBy("l_linenumber", F.round("prediction", 4).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "m04_ridge_closed_form",
    """SELECT round(sxy / (sxx + 1000.0), 5) AS slope, round(my - sxy / (sxx + 1000.0) * mx, 3) AS intercept FROM
       (SELECT covar_pop(l_extendedprice, l_quantity) * count(*) AS sxy, var_pop(l_quantity) * count(*) AS sxx, avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem)""",
)
def _(spark, sf):
    rows = table(spark, sf, "lineitem").withColumnRenamed("l_extendedprice", "label")
    train = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(rows)
    model = M.Ridge(alpha=1000.0).fit(train)
    fitted = (F.lit(float(model.coefficients[0])), F.lit(float(model.intercept)))
    return rows.agg(F.round(F.max(fitted[0]), 5).alias("slope"), F.round(F.max(fitted[1]), 3).alias("intercept"))


@query("m05_support_vector")
def _(spark, sf):
    made = _made(spark, sf)
    return _metrics(M.fit_cached(M.support_vector({"kernel": "linear", "C": 1.0, "epsilon": 0.1}, maxIter=15), made.train), made)


@query("m05_rbf_support_vector")
def _(spark, sf):
    """Metrics of the rbf kernel over 64 landmarks, with the kernel's error over the training rows."""
    made = _made(spark, sf)
    model = M.fit_cached(M.support_vector({"kernel": "rbf", "C": 10.0, "epsilon": 0.1}, maxIter=5, smooth=0.01, landmarks=64), made.train)
    error = model.kernel_error
    return _metrics(model, made).withColumns({"kernel_error": F.lit(error["mean"]), "largest_error": F.lit(error["largest"])})


@query(
    "m05_kernel_error_of_two_landmarks",
    """WITH k AS (SELECT exp(-0.005 * (l_quantity - 10) ^ 2) AS a, exp(-0.005 * (l_quantity - 40) ^ 2) AS b, exp(-0.005 * 30 * 30) AS c FROM lineitem),
       e AS (SELECT 1 - (a * a + b * b - 2 * a * b * c) / (1 - c * c) AS left_out FROM k)
       SELECT round(avg(left_out), 8) AS mean, round(max(left_out), 8) AS largest FROM e""",
)
def _(spark, sf):
    """What two fixed landmarks leave out of the kernel, over all lines."""
    rows = table(spark, sf, "lineitem").select(F.array(F.col("l_quantity").cast("double")).alias("x"))
    mean, largest = L.kernel_error(rows, L.Landmarks([[10.0], [40.0]], 0.005))
    return spark.range(1).select(F.round(F.lit(mean), 8).alias("mean"), F.round(F.lit(largest), 8).alias("largest"))


@query("m05_chosen_landmarks", "SELECT DISTINCT CAST(l_quantity AS DOUBLE) AS l_quantity FROM lineitem")
def _(spark, sf):
    """Where there are no more distinct rows than landmarks, each is one, and the kernel is exact."""
    rows = table(spark, sf, "lineitem").select(F.array(F.col("l_quantity").cast("double")).alias("x"))
    return spark.createDataFrame([(float(v[0]),) for v in L.choose_landmarks(rows, 64)], "l_quantity double")


@query("m06_model_per_group")
def _(spark, sf):
    used = lines(spark, sf).select(*KEYS, *NUMERIC, *CATEGORICAL, "o_orderstatus").filter(F.col("o_orderstatus").isin("F", "O"))
    rows = stored(used, "groups", by="o_orderstatus")
    prepared = {g: P.prepare_regression(rows.filter(F.col("o_orderstatus") == g), TARGETED) for g in ("F", "O")}
    models = M.fit_per_group(prepared, lambda g, train: M.Ridge(alpha=1.0))
    return E.metrics_report({g: m.transform(prepared[g].test) for g, m in models.items()})


@query(
    "m06_ridge_closed_form_per_group",
    """SELECT o_orderstatus AS grp, round(sxy / (sxx + 10.0), 5) AS slope, round(my - sxy / (sxx + 10.0) * mx, 3) AS intercept FROM
       (SELECT o_orderstatus, covar_pop(l_extendedprice, l_quantity) * count(*) AS sxy, var_pop(l_quantity) * count(*) AS sxx, avg(l_quantity) AS mx, avg(l_extendedprice) AS my
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus IN ('F', 'O') GROUP BY 1)""",
)
def _(spark, sf):
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(joined.withColumnRenamed("l_extendedprice", "label"))
    parts = {g: P.Prepared(rows.filter(F.col("o_orderstatus") == g), rows.limit(0), None, ROLES) for g in ("F", "O")}
    models = M.fit_per_group(parts, lambda g, train: M.Ridge(alpha=10.0))
    found = [(g, round(float(m.coefficients[0]), 5), round(float(m.intercept), 3)) for g, m in models.items()]
    return spark.createDataFrame(found, "grp string, slope double, intercept double")


_FOLD = f"{_BUCKET.replace(chr(39) + '42' + chr(39), chr(39) + '43' + chr(39)).removesuffix(' % 100')} % 5"


@query(
    "g01_ridge_fold_errors",
    f"""WITH d AS (SELECT {_FOLD} AS fold, l_quantity AS x, l_extendedprice AS y FROM lineitem),
        s AS (SELECT f.fold, covar_pop(y, x) * count(*) AS sxy, var_pop(x) * count(*) AS sxx, avg(x) AS mx, avg(y) AS my FROM (SELECT DISTINCT fold FROM d) f JOIN d ON d.fold <> f.fold GROUP BY 1),
        a AS (SELECT unnest([0.1, 1000.0, 100000.0]) AS alpha),
        e AS (SELECT alpha, s.fold, avg((y - my - sxy / (sxx + alpha) * (x - mx)) ^ 2) AS mse FROM s JOIN d USING (fold), a GROUP BY 1, 2)
        SELECT CAST(alpha AS DOUBLE) AS alpha, round(avg(mse) / 1e6, 5) AS mse FROM e GROUP BY 1""",
)
def _(spark, sf):
    """The errors of three penalties over five folds, from one pass that sums products per fold."""
    rows = table(spark, sf, "lineitem").select(*KEYS, "l_quantity", F.col("l_extendedprice").alias("label"))
    rows = with_fold(VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(rows), KEYS, 5)
    alphas = [0.1, 1000.0, 100000.0]
    found = [(a, round(e / 1e6, 5)) for a, e in zip(alphas, G.ridge_scores(rows, alphas))]
    return spark.createDataFrame(found, "alpha double, mse double")


@query("g01_g04_g05_grid_search")
def _(spark, sf):
    return G.search_groups({"all": _made(spark, sf)}, "Ridge", "grid")[1]


@query(
    "g05_tuned_parameters_per_group",
    """SELECT 'F' AS grp, CAST(10.0 AS DOUBLE) AS alpha, count(*) > 0 AS scored FROM orders WHERE o_orderstatus = 'F'
       UNION ALL SELECT 'O', CAST(0.5 AS DOUBLE), count(*) > 0 FROM orders WHERE o_orderstatus = 'O'""",
)
def _(spark, sf):
    """Stored per group, read back, and the model that a group's study fits."""
    path = shared_dir(spark, "tuned")
    write_params(params_frame(spark, [("Ridge", "F", {"alpha": 10.0}), ("Ridge", "O", {"alpha": 0.5}), ("SVR", "O", {"C": 2.0})]), path)
    roles = ColumnRoles(("l_quantity", "l_discount", "l_tax"), ("l_returnflag",), "l_extendedprice", KEYS)
    studies = run_study(_columns(spark, sf), ["F", "O"], roles, "o_orderstatus", family="Ridge", params={"alpha": 1.0}, tuned=path)
    found = [(g, float(read_params(spark, path, "Ridge", g)["alpha"]), s.scored.filter("prediction IS NOT NULL").count() > 0) for g, s in studies.items()]
    return spark.createDataFrame(found, "grp string, alpha double, scored boolean")


@query("g02_random_search")
def _(spark, sf):
    return G.search_groups({"all": _made(spark, sf)}, "Ridge", "random")[1]


# ---------------------------------------------------------------- evaluation


@query(
    "e01_regression_metrics",
    """SELECT l_linestatus, count(*) AS n, round(avg((l_extendedprice - 2000 * l_quantity) ^ 2), 2) AS mse,
       round(1 - avg((l_extendedprice - 2000 * l_quantity) ^ 2) / var_pop(l_extendedprice), 6) AS r2 FROM lineitem GROUP BY 1""",
)
def _(spark, sf):
    scored = table(spark, sf, "lineitem").withColumn("prediction", 2000 * F.col("l_quantity")).withColumnRenamed("l_extendedprice", "label")
    return rounded(E.regression_metrics(scored, by=["l_linestatus"])).withColumn("mse", F.round("mse", 2))


@query("e03_feature_importance")
def _(spark, sf):
    made = _made(spark, sf)
    model = M.fit_cached(M.forest({"n_estimators": 10, "max_depth": 5}), made.train)
    return E.top_importance(E.importance_table(spark, model, P.feature_names(made.stages, made.roles), "all"))


# importance stand-ins that SQL can compute: a brand's and a flag's share of the quantity, per line status
_SHARES = """sh AS (SELECT l_linestatus AS instituicao, concat('p_brand_', p_brand) AS feature, 'p_brand' AS base, sum(l_quantity) / 1e6 AS importance
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
    UNION ALL SELECT l_linestatus, concat('l_returnflag_', l_returnflag), 'l_returnflag', sum(l_quantity) / 1e6 FROM lineitem GROUP BY 1, 2)"""


def _shares(spark, sf):
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    parts = []
    for rows, base in ((joined, "p_brand"), (table(spark, sf, "lineitem"), "l_returnflag")):
        parts.append(
            rows.groupBy(F.col("l_linestatus").alias("instituicao"), F.concat_ws("_", F.lit(base), base).alias("feature"))
            .agg((F.sum("l_quantity") / 1e6).alias("importance"))
            .withColumn("base", F.lit(base))
        )
    return stack(parts)


@query(
    "e04_compare_importance",
    f"""WITH {_SHARES}, named AS (SELECT *, CASE WHEN base = 'p_brand' THEN concat('P Brand ', feature[9:]) ELSE concat('L Returnflag ', feature[14:]) END AS shown FROM sh)
        SELECT instituicao, shown AS feature, base, round(importance, 9) AS importance, round(avg(importance) OVER (PARTITION BY shown), 9) AS mean_importance FROM named""",
)
def _(spark, sf):
    rows = _shares(spark, sf)
    return rounded(E.compare_importance([rows.filter("instituicao = 'F'"), rows.filter("instituicao = 'O'")]), 9)


@query("e05_importance_by_base", f"WITH {_SHARES} SELECT instituicao, base AS feature, round(sum(importance), 6) AS importance FROM sh GROUP BY 1, 2")
def _(spark, sf):
    by_name = E.aggregate_importance(_shares(spark, sf), plain=["p_size"])
    carried = E.aggregate_importance(_shares(spark, sf))
    return rounded(by_name.join(carried.select("instituicao", "feature"), ["instituicao", "feature"]))


# ---------------------------------------------------------------- scenarios

# a group-mean model: prediction = mean ratio of flag and status, scored by an equi-join
_MEANS = f"{ROWS_SQL}, model AS (SELECT l_returnflag, l_linestatus, avg(ratio) AS prediction FROM lines GROUP BY 1, 2)"
_GRID = f"""{_MEANS}, grid AS (SELECT l_returnflag, l_linestatus, faixa, CAST(CASE faixa WHEN 1 THEN 0.5 WHEN 3 THEN 2.5 ELSE 4.5 END AS DOUBLE) AS igc, cluster FROM (SELECT unnest(['A', 'N', 'R']) AS l_returnflag),
    (SELECT unnest(['F', 'O']) AS l_linestatus), (SELECT unnest([1, 3, 5]) AS faixa), (SELECT unnest([0, 1]) AS cluster)),
    scored AS (SELECT *, 'publica' AS grupo, round(prediction * igc, 2) AS previsao_anos,
      CASE WHEN prediction * igc - igc < -0.5 THEN 'Evasão Provável' WHEN prediction * igc - igc > 0.5 THEN 'Atraso' ELSE 'Conclusão no Prazo' END AS status FROM grid JOIN model USING (l_returnflag, l_linestatus))"""


def _scenarios(spark, sf):
    means = lines(spark, sf).groupBy("l_returnflag", "l_linestatus").agg(F.avg("ratio").alias("prediction"))
    values = {"l_returnflag": ["A", "N", "R"], "l_linestatus": ["F", "O"]}
    grid = W.scenario_grid(spark, values, ("faixa", "igc", {1: 0.5, 3: 2.5, 5: 4.5}), clusters=[0, 1])
    return W.score_scenarios(grid, lambda g: g.join(means, ["l_returnflag", "l_linestatus"]), "igc", "publica")


@query("e06_scenario_grid", f"WITH {_GRID} SELECT l_returnflag, l_linestatus, faixa, igc, cluster, grupo, round(prediction, 6) AS prediction, previsao_anos, status FROM scored")
def _(spark, sf):
    return rounded(_scenarios(spark, sf))


@query("e07_status_counts", f"WITH {_GRID} SELECT status, grupo, count(*) AS count FROM scored GROUP BY 1, 2")
def _(spark, sf):
    return W.status_by_group(_scenarios(spark, sf))


@query(
    "e07_impact_by_feature",
    f"""WITH {_GRID}, u AS (SELECT grupo, previsao_anos AS y, unnest([{{'f': 'l_returnflag', 'c': l_returnflag}}, {{'f': 'faixa', 'c': CAST(faixa AS VARCHAR)}}]) AS u FROM scored)
        SELECT u.f AS feature, u.c AS category, grupo, count(*) AS n, round(avg(y), 4) AS mean, round(avg(y) - 1.959963984540054 * stddev_samp(y) / sqrt(count(*)), 4) AS low,
          round(avg(y) + 1.959963984540054 * stddev_samp(y) / sqrt(count(*)), 4) AS high FROM u GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return rounded(W.impact_by_feature(_scenarios(spark, sf), ["l_returnflag", "faixa"]), 4)


@query(
    "e06_scenarios_by_group",
    """WITH m AS (SELECT l_linestatus, l_returnflag, avg(l_quantity) AS y FROM lineitem GROUP BY 1, 2),
       g AS (SELECT f.flag AS l_returnflag, s.grupo, s.code, b.faixa, b.v, c.cluster FROM (SELECT DISTINCT l_returnflag AS flag FROM lineitem) f,
         (VALUES ('first', 'F', 3), ('second', 'O', 2)) s(grupo, code, k), (VALUES (1, 0.5), (5, 4.5)) b(faixa, v), (SELECT unnest(range(3)) AS cluster) c WHERE c.cluster < s.k)
       SELECT grupo, g.l_returnflag, faixa, CAST(cluster AS INTEGER) AS cluster, round(y * CAST(v AS DOUBLE) + cluster, 2) AS previsao_anos FROM g JOIN m ON m.l_linestatus = g.code AND m.l_returnflag = g.l_returnflag""",
)
def _(spark, sf):
    """Two groups, each with its code, its clusters and its own scoring."""
    rows = table(spark, sf, "lineitem")
    means = rows.groupBy("l_linestatus", "l_returnflag").agg(F.avg("l_quantity").alias("y"))

    def scorer(code):
        own = means.filter(F.col("l_linestatus") == code).drop("l_linestatus")
        return lambda grid: grid.join(own, "l_returnflag").withColumn("prediction", F.col("y") * F.col("v") + F.col("cluster"))

    flags = [r[0] for r in rows.select("l_returnflag").distinct().collect()]
    out = W.scenarios_by_group(
        spark, {"l_returnflag": flags}, {"first": scorer("F"), "second": scorer("O")}, "ideal", "code", {"first": "F", "second": "O"},
        ("faixa", "v", {1: 0.5, 5: 4.5}), {"first": [0, 1, 2], "second": [0, 1]}, {"ideal": 4.0}, prediction_is_ratio=False,
    )
    return out.select("grupo", "l_returnflag", "faixa", "cluster", "previsao_anos")


@query("e06_scenarios_with_model")
def _(spark, sf):
    made = _made(spark, sf, ColumnRoles(("l_quantity", "l_discount"), ("l_returnflag", "l_linestatus"), "ratio", KEYS))
    model = M.fit_cached(M.forest({"n_estimators": 5, "max_depth": 4}), made.train)
    grid = W.scenario_grid(
        spark, {"l_returnflag": ["A", "N", "R", "X"], "l_linestatus": ["F", "O"]}, ("faixa", "l_quantity", {1: 5.0, 3: 25.0, 5: 45.0}), defaults={"l_discount": 0.05, "ideal": 4.0}
    )
    scored = W.score_scenarios(grid, lambda g: model.transform(made.stages.transform(g)), "ideal", "publica")
    unknown = W.unknown_categories(grid, made.stages, ["l_returnflag", "l_linestatus"]).select(F.col("category").alias("l_returnflag"), F.lit(True).alias("unseen"))
    return scored.join(unknown, "l_returnflag", "left").select("l_returnflag", "l_linestatus", "faixa", "previsao_anos", "status", "unseen")


_POLICY = """model AS (SELECT l_discount, l_tax, avg(l_extendedprice) AS prediction FROM lineitem GROUP BY 1, 2),
    s AS (SELECT 'Base' AS p, l_discount, l_tax FROM lineitem UNION ALL SELECT 'Apoio', 0.05, l_tax FROM lineitem UNION ALL SELECT 'Financ', l_discount, 0.02 FROM lineitem),
    m AS (SELECT p, avg(prediction) AS y FROM s JOIN model USING (l_discount, l_tax) GROUP BY 1)"""


@query(
    "e08_e09_a20_policy_what_if",
    f"""WITH {_POLICY}, w AS (SELECT max(y) FILTER (WHERE p = 'Base') AS b, max(y) FILTER (WHERE p = 'Apoio') AS a, max(y) FILTER (WHERE p = 'Financ') AS f FROM m)
        SELECT 'all' AS "Instituicao", round(b, 4) AS "Base", round(a, 4) AS "Apoio_Universal", round(f, 4) AS "Financ_Universal", round(a - b, 4) AS "Delta_Apoio", round(f - b, 4) AS "Delta_Financ" FROM w""",
)
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_discount", "l_tax", "l_extendedprice")
    means = rows.groupBy("l_discount", "l_tax").agg(F.avg("l_extendedprice").alias("prediction"))
    policies = {"Base": {}, "Apoio_Universal": {"l_discount": 0.05}, "Financ_Universal": {"l_tax": 0.02}}
    summary = W.policy_means(rows.drop("l_extendedprice"), lambda g: g.join(means, ["l_discount", "l_tax"]), policies, "all")
    return rounded(W.with_deltas(summary, list(policies)), 4)


@query("study_two_groups_with_policies")
def _(spark, sf):
    rows = _held(spark, sf)
    roles = ColumnRoles(("l_quantity", "l_discount", "l_tax"), ("l_returnflag", "o_orderpriority"), "ratio", KEYS)
    studies = run_study(
        rows, ["F", "O"], roles, "o_orderstatus", ks={"F": 2, "O": 2}, cluster_roles=ColumnRoles(NUMERIC, CATEGORICAL),
        params={"n_estimators": 5, "max_depth": 4}, cluster_options={"nInit": 1, "maxIter": 3, "drivers": False},
    )
    metrics = study_reports(studies)["metrics"].withColumnRenamed("instituicao", "Instituicao")
    policies = {"Base": {}, "Apoio_Universal": {"l_discount": 0.1}, "Financ_Universal": {"l_tax": 0.0}}
    parts = {g: rows.filter(F.col("o_orderstatus") == g) for g in studies}
    return metrics.join(policy_report(studies, parts, policies), "Instituicao")


# ---------------------------------------------------------------- attribution


@query("e10_tree_attribution")
def _(spark, sf):
    made = _made(spark, sf)
    model = M.fit_cached(M.forest({"n_estimators": 5, "max_depth": 4}), made.train)
    rows = T.tree_attributions(made.test, model)
    return T.attribution_table(rows, P.feature_names(made.stages, made.roles))


@query(
    "e10_additivity",
    f"WITH {ROWS_SQL} SELECT count(*) AS n, count(*) AS n_additive FROM lines WHERE {_BUCKET} < 20",
)
def _(spark, sf):
    """On every test row the attributions sum to the prediction minus one baseline."""
    made = _made(spark, sf)
    model = M.fit_cached(M.forest({"n_estimators": 5, "max_depth": 4}), made.train)
    total = F.aggregate("attributions", F.lit(0.0), lambda a, x: a + x)
    rows = T.tree_attributions(model.transform(made.test), model).select((F.col("prediction") - total).alias("rest"))
    base = F.lit(T.model_baseline(model))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("rest") - base) < 1e-6 * F.abs(base)).alias("n_additive"))


@query(
    "e11_permutation_attribution",
    """WITH bg AS (SELECT avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_tax) AS t FROM
         (SELECT * FROM lineitem ORDER BY md5(concat_ws(':', '42', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice)), l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice LIMIT 4)),
       f AS (SELECT unnest([{'f': 'l_quantity', 'p': 2 * (l_quantity - q)}, {'f': 'l_discount', 'p': 30 * (l_discount - d)}, {'f': 'l_tax', 'p': -50 * (l_tax - t)}]) AS u FROM lineitem, bg)
       SELECT u.f AS feature, round(avg(abs(u.p)), 4) AS mean_abs, round(avg(u.p), 4) + 0.0 AS mean FROM f GROUP BY 1""",
)
def _(spark, sf):
    whole = (*KEYS, "l_extendedprice")  # the four keys repeat in a few lines
    score = lambda g: g.withColumn("prediction", 2 * F.col("l_quantity") + 30 * F.col("l_discount") - 50 * F.col("l_tax"))
    rows = fact(spark, sf).select(*whole, "l_quantity", "l_discount", "l_tax")
    phi = T.permutation_attributions(rows, score, ["l_quantity", "l_discount", "l_tax"], whole, permutations=4)
    return rounded(T.permutation_table(phi), 4)
