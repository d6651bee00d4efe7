"""Joins, reshapes, aggregates, order statistics and tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from cohortry.catalog.base import NUMERIC, ROWS_SQL, SIDES, fact, lines, query, r6, rounded, table
from cohortry.functions.columns import group_tag, rounded_ratio
from cohortry.operators import aggregates as A
from cohortry.operators import hypothesis as H
from cohortry.operators import joins as J
from cohortry.operators import order_stats as O
from cohortry.operators import reshape as S
from cohortry.operators.evaluation import bin_means, category_means, duration_comparison, status_counts

# ---------------------------------------------------------------- joins and reshapes


def _pair_counts(spark, sf):
    """Lines per part and supplier, and those returned; most pairs have none of the latter."""
    rows = table(spark, sf, "lineitem")
    return (
        A.count_by(rows, ["l_partkey", "l_suppkey"], "n_lines"),
        A.count_by(rows.filter("l_returnflag = 'R'"), ["l_partkey", "l_suppkey"], "n_returned"),
    )


@query(
    "j01_unpivot_years",
    """SELECT c_nationkey AS nation, CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(o_totalprice), 2) AS total
       FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders")
    first, last = orders.agg(F.min(F.year("o_orderdate")), F.max(F.year("o_orderdate"))).first()
    years = [str(y) for y in range(first, last + 1)]
    joined = orders.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    wide = joined.groupBy(F.col("c_nationkey").alias("nation")).agg(
        *[F.round(F.sum(F.when(F.year("o_orderdate") == int(y), F.col("o_totalprice"))), 2).alias(y) for y in years]
    )
    return S.unpivot_years(wide, ["nation"], years, "year", "total").filter(F.col("total").isNotNull())


@query(
    "j02_j03_j04_j05_dimension_chain",
    """SELECT s_suppkey, s_nationkey, n_name, r_name, k.n_parts FROM supplier JOIN nation ON s_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey
       LEFT JOIN (SELECT l_suppkey AS s_suppkey, count(*) AS n_parts FROM lineitem GROUP BY 1) k USING (s_suppkey)""",
)
def _(spark, sf):
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    with_nation = J.join_renamed(supplier.withColumn("key", F.col("s_nationkey")), nation, [("key", "n_nationkey")]).drop("key")
    with_region = J.join_renamed(with_nation, region, [("n_regionkey", "r_regionkey")]).drop("n_regionkey")
    parts = A.count_by(table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "s_suppkey"), ["s_suppkey"], "n_parts")
    return J.join_shared(with_region, parts, ["s_suppkey"], "left")


@query(
    "j03_two_renamed_keys",
    """SELECT a.l_partkey, a.l_suppkey, a.n_lines, b.n_returned FROM (SELECT l_partkey, l_suppkey, count(*) AS n_lines FROM lineitem GROUP BY 1, 2) a
       JOIN (SELECT l_partkey, l_suppkey, count(*) AS n_returned FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) b USING (l_partkey, l_suppkey)""",
)
def _(spark, sf):
    whole, returned = _pair_counts(spark, sf)
    other_names = returned.withColumnsRenamed({"l_partkey": "part", "l_suppkey": "supp"})
    return J.join_renamed(whole, other_names, [("l_partkey", "part"), ("l_suppkey", "supp")])


@query(
    "j04_j05_two_shared_keys_left",
    """SELECT l_partkey, l_suppkey, count(*) AS n_lines, nullif(count(*) FILTER (WHERE l_returnflag = 'R'), 0) AS n_returned FROM lineitem GROUP BY 1, 2""",
)
def _(spark, sf):
    whole, returned = _pair_counts(spark, sf)
    return J.join_shared(whole, returned, ["l_partkey", "l_suppkey"], "left")


@query(
    "j05_left_join_unmatched",
    """SELECT source, count(*) AS n, count(quality) AS n_labelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
)
def _(spark, sf):
    joined = J.join_shared(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), ["doc_id"], "left")
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("n_labelled"))


@query(
    "j06_fact_dimension_join",
    """SELECT p_brand, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""",
)
def _(spark, sf):
    fact = table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    joined = J.join_shared(fact, table(spark, sf, "part"), ["p_partkey"])
    return joined.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query(
    "j07_join_audit",
    """SELECT (SELECT count(*) FROM documents) AS left_rows, (SELECT count(*) FROM labels) AS right_rows,
       (SELECT count(*) FROM documents d JOIN labels l ON d.doc_id = l.doc_id) AS joined_rows,
       (SELECT count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE d.doc_id = l.doc_id)) AS left_unmatched,
       (SELECT count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)) AS right_unmatched""",
)
def _(spark, sf):
    return J.join_audit(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"])


@query(
    "j08_j09_grid_with_clusters",
    """SELECT flag, status, band, o_orderpriority AS priority, n FROM (SELECT unnest(['A', 'N', 'R']) AS flag), (SELECT unnest(['F', 'O']) AS status),
       (SELECT unnest([1, 3, 5]) AS band), (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)""",
)
def _(spark, sf):
    priorities = A.count_by(table(spark, sf, "orders"), ["o_orderpriority"], "n")
    grid = S.expand_values(priorities, {"flag": ["A", "N", "R"], "status": ["F", "O"], "band": [1, 3, 5]})
    return grid.withColumnRenamed("o_orderpriority", "priority")


@query(
    "u01_union_all",
    """SELECT 'customer' AS kind, c_nationkey AS nation, c_acctbal AS balance FROM customer
       UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier""",
)
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    s = table(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation"))
    return S.stack([c, s])


# ---------------------------------------------------------------- aggregates


@query("a01_global_mean", "SELECT l_linestatus, round(avg(l_extendedprice), 6) AS mean FROM lineitem GROUP BY 1")
def _(spark, sf):
    return A.mean_by(table(spark, sf, "lineitem"), ["l_extendedprice"], ["l_linestatus"]).select("l_linestatus", r6("l_extendedprice").alias("mean"))


@query(
    "a02_fill_with_mean",
    """WITH j AS (SELECT d.doc_id, CAST(l.quality AS DOUBLE) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
       SELECT doc_id, round(coalesce(quality, (SELECT avg(quality) FROM j)), 6) AS quality FROM j""",
)
def _(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"))
    joined = J.join_shared(table(spark, sf, "documents").select("doc_id"), labels, ["doc_id"], "left")
    return rounded(J.fill_with_mean(joined, "quality"))


@query(
    "a03_mean_and_std",
    "SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_std" for c in NUMERIC) + " FROM lineitem",
)
def _(spark, sf):
    return rounded(A.mean_and_std(table(spark, sf, "lineitem"), NUMERIC))


@query("a04_mean_by_key", "SELECT l_returnflag, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in NUMERIC) + " FROM lineitem GROUP BY 1")
def _(spark, sf):
    return rounded(A.mean_by(table(spark, sf, "lineitem"), NUMERIC, ["l_returnflag"]))


@query(
    "a04_mean_ignores_nan",
    """SELECT l_returnflag, round(avg(l_tax) FILTER (WHERE l_linenumber <> 3), 6) AS l_tax, round(stddev_samp(l_tax) FILTER (WHERE l_linenumber <> 3), 6) AS std,
       round(sum(l_tax) FILTER (WHERE l_linenumber <> 3), 4) AS total FROM lineitem GROUP BY 1""",
)
def _(spark, sf):
    tax = F.when(F.col("l_linenumber") == 3, float("nan")).otherwise(F.col("l_tax"))
    rows = table(spark, sf, "lineitem").select("l_returnflag", tax.alias("l_tax"))
    spread = A.mean_with_interval(rows, "l_tax", ["l_returnflag"]).select("l_returnflag", ((F.col("high") - F.col("mean")) * F.sqrt("n") / 1.959963984540054).alias("std"))
    total = A.sum_by(rows, "l_tax", ["l_returnflag"]).withColumn("total", F.round("l_tax", 4)).drop("l_tax")
    return rounded(A.mean_by(rows, ["l_tax"], ["l_returnflag"]).join(spread, "l_returnflag").join(total, "l_returnflag"))


@query(
    "a05_mean_by_two_keys",
    f"WITH {ROWS_SQL} SELECT side, l_returnflag, round(avg(ratio), 9) AS ratio FROM lines WHERE side IS NOT NULL GROUP BY 1, 2",
)
def _(spark, sf):
    return rounded(A.mean_by(lines(spark, sf), ["ratio"], ["side", "l_returnflag"]), 9)


def _bins_sql(bins: int) -> str:
    """Right-closed equal-frequency bins of l_quantity, l_extendedprice and l_discount with the lowest edge in bin 0."""
    shares = "[" + ", ".join(str(i / bins) for i in range(bins + 1)) + "]"
    return f"""
    src AS (SELECT l_linestatus AS side, l_tax AS y, unnest([{{'f': 'l_quantity', 'x': l_quantity}}, {{'f': 'l_extendedprice', 'x': l_extendedprice}},
              {{'f': 'l_discount', 'x': l_discount}}]) AS u FROM lineitem),
    vals AS (SELECT side, y, u.f AS feature, u.x AS x FROM src),
    edges AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, {shares}))) AS e FROM vals GROUP BY 1),
    binned AS (SELECT v.*, CAST(len(list_filter(e[2:len(e) - 1], lambda q: q < v.x)) AS INTEGER) AS bin FROM vals v JOIN edges USING (feature))"""


_BINNED = ["l_quantity", "l_extendedprice", "l_discount"]


@query(
    "a06_mean_by_bin_and_key",
    f"WITH {_bins_sql(10)} SELECT feature, bin, side, round(avg(y), 6) AS mean FROM binned GROUP BY 1, 2, 3",
)
def _(spark, sf):
    binned = O.quantile_bins(fact(spark, sf), _BINNED, ["l_linestatus", "l_tax"])
    return rounded(A.mean_by(binned.withColumnsRenamed({"l_linestatus": "side", "l_tax": "mean"}), ["mean"], ["feature", "bin", "side"]))


@query(
    "a07_median_per_group",
    "SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 6) AS l_extendedprice, round(median(l_discount), 6) AS l_discount FROM lineitem GROUP BY 1, 2",
)
def _(spark, sf):
    return rounded(O.medians(fact(spark, sf), ["l_extendedprice", "l_discount"], ["l_returnflag", "l_linestatus"]))


@query("a08_global_medians", "SELECT " + ", ".join(f"round(median({c}), 6) AS {c}" for c in NUMERIC) + " FROM lineitem")
def _(spark, sf):
    return rounded(O.medians(fact(spark, sf), NUMERIC))


def _mode_sql(columns, by=()):
    keys = ", ".join(by)
    parts = []
    for c in columns:
        key_list = f"{keys}, " if by else ""
        part = f"PARTITION BY {keys} " if by else ""
        parts.append(
            f"(SELECT {key_list}{c} FROM (SELECT {key_list}{c}, row_number() OVER ({part}ORDER BY n DESC, {c}) AS rn FROM "
            f"(SELECT {key_list}{c}, count(*) AS n FROM lines WHERE {c} IS NOT NULL GROUP BY ALL)) WHERE rn = 1)"
        )
    if not by:
        return f"WITH {ROWS_SQL} SELECT * FROM " + ", ".join(parts)
    return f"WITH {ROWS_SQL} SELECT * FROM " + reduce(lambda a, b: f"{a} JOIN {b} USING ({keys})", parts)


_MODES = ["l_linenumber", "l_returnflag", "o_orderpriority", "p_brand"]


@query("a09_global_modes", _mode_sql(_MODES))
def _(spark, sf):
    return A.modes(lines(spark, sf), _MODES)


@query("a10_modes_per_group", _mode_sql(_MODES, ["side"]).replace("FROM lines WHERE", "FROM lines WHERE side IS NOT NULL AND"))
def _(spark, sf):
    return A.modes(lines(spark, sf), _MODES, ["side"])


@query("a11_count_by_key", "SELECT l_linenumber, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY 1")
def _(spark, sf):
    return A.count_by(table(spark, sf, "lineitem"), ["l_linenumber"]).orderBy("l_linenumber")


@query("a12_count_by_status", "SELECT o_orderstatus, count(*) AS count FROM orders GROUP BY 1")
def _(spark, sf):
    return status_counts(table(spark, sf, "orders"), "o_orderstatus")


@query("a13_count_by_status_and_group", "SELECT o_orderstatus, o_orderpriority, count(*) AS count FROM orders GROUP BY 1, 2")
def _(spark, sf):
    return status_counts(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


@query("a14_sum_by_two_keys", "SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1, 2")
def _(spark, sf):
    return rounded(A.sum_by(table(spark, sf, "orders"), "o_totalprice", ["o_orderstatus", "o_orderpriority"]), 2)


@query(
    "a15_w05_order_by_mean",
    """WITH t AS (SELECT o_orderstatus, o_orderpriority, avg(o_totalprice) AS m FROM orders GROUP BY 1, 2)
       SELECT o_orderstatus, o_orderpriority, round(m, 4) AS m, round(avg(m) OVER (PARTITION BY o_orderpriority), 4) AS mean_value FROM t""",
)
def _(spark, sf):
    means = A.mean_by(table(spark, sf, "orders"), ["o_totalprice"], ["o_orderstatus", "o_orderpriority"]).withColumnRenamed("o_totalprice", "m")
    ordered = A.mean_order(means, "o_orderpriority", "m").orderBy("o_orderstatus", F.col("mean_value").desc(), "o_orderpriority")
    return rounded(ordered, 4)


_COUNTED = ["p_brand", "p_type", "p_name", "p_size"]


@query("a16_distinct_counts", "SELECT " + ", ".join(f"count(DISTINCT {c}) AS {c}" for c in _COUNTED) + " FROM part")
def _(spark, sf):
    return A.distinct_counts(table(spark, sf, "part"), _COUNTED)


@query(
    "a17_sizes_by_side",
    f"""WITH {ROWS_SQL} SELECT l_returnflag, count(*) FILTER (WHERE side = 'first' AND ratio IS NOT NULL) AS n_first,
        count(*) FILTER (WHERE side = 'second' AND ratio IS NOT NULL) AS n_second FROM lines GROUP BY 1""",
)
def _(spark, sf):
    sides = {"n_first": F.col("side") == "first", "n_second": F.col("side") == "second"}
    return A.sizes_by_side(lines(spark, sf), ["l_returnflag"], "ratio", sides)


@query(
    "a19_mean_with_interval",
    """SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean,
       round(avg(o_totalprice) - 1.959963984540054 * stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS low,
       round(avg(o_totalprice) + 1.959963984540054 * stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS high FROM orders GROUP BY 1, 2""",
)
def _(spark, sf):
    return rounded(A.mean_with_interval(table(spark, sf, "orders"), "o_totalprice", ["o_orderpriority", "o_orderstatus"]), 4)


# ---------------------------------------------------------------- windows and ranks


@query(
    "w01_latest_per_key",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1""",
)
def _(spark, sf):
    newest = S.latest_per_key(table(spark, sf, "orders"), ["o_custkey"], "o_orderdate", ["o_orderkey"])
    return newest.select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "w02_average_ranks",
    """WITH c AS (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2)
       SELECT l_returnflag, l_quantity, n,
              coalesce(sum(n) OVER (PARTITION BY l_returnflag ORDER BY l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS avg_rank FROM c""",
)
def _(spark, sf):
    return O.average_ranks(fact(spark, sf), "l_quantity", ["l_returnflag"])


@query(
    "w03_equal_frequency_bins",
    f"WITH {_bins_sql(10)} SELECT feature, bin, count(*) AS n, round(min(x), 6) AS low, round(max(x), 6) AS high FROM binned GROUP BY 1, 2",
)
def _(spark, sf):
    binned = O.quantile_bins(fact(spark, sf), _BINNED)
    return rounded(binned.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")))


@query("w04_top_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(spark, sf):
    return S.top_rows(table(spark, sf, "orders"), "o_totalprice", 20, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query(
    "w06_arg_min",
    """SELECT o_orderpriority, round(mean, 4) AS mean FROM (SELECT o_orderpriority, avg(o_totalprice) AS mean FROM orders GROUP BY 1) ORDER BY mean, 1 LIMIT 1""",
)
def _(spark, sf):
    means = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("mean"))
    return rounded(S.arg_min(means, "o_orderpriority", "mean"), 4)


# ---------------------------------------------------------------- tests


def _rank_sql(source: str, keys: str) -> str:
    """Mann-Whitney statistics from mid-ranks of (keys, value, side) rows."""
    return f"""
    cnt AS (SELECT {keys}, value, count(*) FILTER (WHERE side = 'first') AS c1, count(*) FILTER (WHERE side = 'second') AS c2, count(*) AS t
            FROM {source} WHERE value IS NOT NULL AND side IS NOT NULL GROUP BY ALL),
    mid AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY {keys} ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2 AS rk FROM cnt),
    agg AS (SELECT {keys}, CAST(sum(c1) AS BIGINT) AS n1, CAST(sum(c2) AS BIGINT) AS n2, sum(c1 * rk) AS r1, sum(t::DOUBLE * t * t - t) AS ties FROM mid GROUP BY ALL),
    uu AS (SELECT *, r1 - n1::DOUBLE * (n1 + 1) / 2 AS u1,
             n1::DOUBLE * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2)::DOUBLE * (n1 + n2 - 1))) AS v FROM agg),
    stat AS (SELECT *, (greatest(u1, n1::DOUBLE * n2 - u1) - n1::DOUBLE * n2 / 2 - 0.5) / sqrt(nullif(v, 0)) AS z FROM uu)"""


@query(
    "h01_mann_whitney_overall",
    f"""WITH {ROWS_SQL}, src AS (SELECT 0 AS k, ratio AS value, side FROM lines), {_rank_sql('src', 'k')}
        SELECT n1, n2, round(u1, 1) AS u1, round(z, 6) AS z FROM stat""",
)
def _(spark, sf):
    out = H.mann_whitney(lines(spark, sf), "ratio", "side", SIDES)
    return out.select("n1", "n2", F.round("u1", 1).alias("u1"), r6("z").alias("z"))


_LONG = "src AS (SELECT ratio AS value, side, unnest([{'f': 'l_returnflag', 'c': l_returnflag}, {'f': 'o_orderpriority', 'c': o_orderpriority}, {'f': 'l_linenumber', 'c': CAST(l_linenumber AS VARCHAR)}, {'f': 'p_brand', 'c': p_brand}]) AS u FROM lines), lng AS (SELECT value, side, u.f AS feature, u.c AS category FROM src WHERE u.c IS NOT NULL)"
_FEATURES = ["l_returnflag", "o_orderpriority", "l_linenumber", "p_brand"]


@query(
    "h03_test_per_category",
    f"""WITH {ROWS_SQL}, {_LONG}, {_rank_sql('lng', 'feature, category')}
        SELECT feature, category, n1, n2, round(u1, 1) AS u1, round(z, 6) AS z FROM stat""",
)
def _(spark, sf):
    out = H.category_tests(lines(spark, sf), _FEATURES, "ratio", "side", SIDES)
    return out.select("feature", "category", "n1", "n2", F.round("u1", 1).alias("u1"), r6("z").alias("z"))


# |z| >= 1.959963985 is p <= 0.05; both sides have far more than eight rows with ties here
@query(
    "h04_significance_flags",
    f"""WITH {ROWS_SQL}, {_LONG}, {_rank_sql('lng', 'feature, category')}
        SELECT feature AS "Feature", category AS "Categoria", CASE WHEN n1 >= 2 AND n2 >= 2 AND z > 1.959963984540054 THEN 'SIGNIFICATIVO' ELSE 'Não sig.' END AS "Significancia",
               n1 AS "N_Publica", n2 AS "N_Privada" FROM stat""",
)
def _(spark, sf):
    return H.comparison_report(H.category_tests(lines(spark, sf), _FEATURES, "ratio", "side", SIDES)).drop("P-Valor")


@query(
    "h02_welch_statistics",
    f"""WITH {ROWS_SQL}, s AS (SELECT l_returnflag, count(*) FILTER (WHERE side = 'first') AS n1, count(*) FILTER (WHERE side = 'second') AS n2,
          avg(ratio) FILTER (WHERE side = 'first') AS m1, avg(ratio) FILTER (WHERE side = 'second') AS m2,
          var_samp(ratio) FILTER (WHERE side = 'first') AS v1, var_samp(ratio) FILTER (WHERE side = 'second') AS v2
          FROM lines WHERE ratio IS NOT NULL AND side IS NOT NULL GROUP BY 1)
        SELECT l_returnflag, n1, n2, round(m1, 6) AS mean1, round(m2, 6) AS mean2, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t,
          round((v1 / n1 + v2 / n2) ^ 2 / ((v1 / n1) ^ 2 / (n1 - 1) + (v2 / n2) ^ 2 / (n2 - 1)), 4) AS dof FROM s""",
)
def _(spark, sf):
    out = H.welch(lines(spark, sf), "ratio", "side", SIDES, ["l_returnflag"])
    return out.select("l_returnflag", "n1", "n2", r6("mean1").alias("mean1"), r6("mean2").alias("mean2"), r6("t").alias("t"), F.round("dof", 4).alias("dof"))


@query("h01_h02_p_values")
def _(spark, sf):
    rows = lines(spark, sf)
    rank = H.mann_whitney(rows, "ratio", "side", SIDES, ["l_returnflag"]).select("l_returnflag", F.col("p_value").alias("rank_p"))
    return rank.join(H.welch(rows, "ratio", "side", SIDES, ["l_returnflag"]).select("l_returnflag", F.col("p_value").alias("welch_p")), "l_returnflag")


# ---------------------------------------------------------------- descriptive reports


@query(
    "e12_duration_comparison",
    f"""WITH {ROWS_SQL}, d AS (SELECT l_quantity / 10 - l_linenumber AS gap, CASE WHEN l_linenumber IN (1, 2, 3) THEN 'Pública' ELSE 'Privada' END AS tipo_ies FROM lines)
        SELECT tipo_ies, CASE WHEN gap <= -0.5 THEN 'Evasão Provável' WHEN gap <= 0.5 THEN 'Conclusão no Prazo' ELSE 'Atraso' END AS status_conclusao, count(*) AS count
        FROM d GROUP BY 1, 2""",
)
def _(spark, sf):
    rows = lines(spark, sf).withColumn("actual", F.col("l_quantity") / 10)
    compared = duration_comparison(rows, "actual", "l_linenumber", "l_linenumber", [1, 2, 3])
    return status_counts(compared, "status_conclusao", "tipo_ies")


@query(
    "e13_category_means",
    f"""WITH {ROWS_SQL}, {_LONG} SELECT side, feature, category, count(value) AS n, round(avg(value), 9) AS mean FROM lng WHERE side IS NOT NULL GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return rounded(category_means(lines(spark, sf), _FEATURES, "ratio", "side"), 9)


@query(
    "e13_bin_means",
    f"""WITH {_bins_sql(10)}, med AS (SELECT feature, bin, median(x) AS bin_median FROM binned GROUP BY 1, 2)
        SELECT feature, bin, side AS l_linestatus, round(avg(y), 6) AS mean, round(any_value(bin_median), 6) AS bin_median FROM binned JOIN med USING (feature, bin) GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return rounded(bin_means(fact(spark, sf), _BINNED, "l_tax", "l_linestatus"))


@query(
    "flagship_ratio_comparison",
    f"""WITH {ROWS_SQL},
        geo AS (SELECT lines.*, r_name FROM lines JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
                JOIN region ON n_regionkey = r_regionkey WHERE l_quantity > 0 AND l_quantity < 50),
        src AS (SELECT ratio AS value, side, unnest([{{'f': 'l_returnflag', 'c': l_returnflag}}, {{'f': 'r_name', 'c': r_name}}]) AS u FROM geo),
        lng AS (SELECT value, side, u.f AS feature, u.c AS category FROM src WHERE u.c IS NOT NULL),
        means AS (SELECT feature, category, round(avg(value) FILTER (WHERE side = 'first'), 9) AS mean1, round(avg(value) FILTER (WHERE side = 'second'), 9) AS mean2 FROM lng GROUP BY 1, 2),
        {_rank_sql('lng', 'feature, category')}
        SELECT feature, category, n1, n2, mean1, mean2, round(z, 6) AS z, CASE WHEN n1 >= 2 AND n2 >= 2 AND z > 1.959963984540054 THEN 'SIGNIFICATIVO' ELSE 'Não sig.' END AS significance
        FROM stat JOIN means USING (feature, category)""",
)
def _(spark, sf):
    li = fact(spark, sf).filter((F.col("l_quantity") > 0) & (F.col("l_quantity") < 50))
    o, c, n, r = (table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    geography = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    orders = o.join(geography, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderstatus", "r_name")
    rows = (
        li.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .withColumn("ratio", rounded_ratio("l_quantity", "p_size"))
        .withColumn("side", group_tag("o_orderstatus", {"first": ["F"], "second": ["O"]}))
    )
    tests = H.category_tests(rows, ["l_returnflag", "r_name"], "ratio", "side", SIDES)
    means = [F.round(m, 9).alias(m) for m in ("mean1", "mean2")]
    return tests.select("feature", "category", "n1", "n2", *means, r6("z").alias("z"), "significance")
