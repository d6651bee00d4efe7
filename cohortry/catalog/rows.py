"""Sources, sinks, projections, derivations and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.catalog.base import ROWS_SQL, lines, query, r6, table
from cohortry.functions import columns as X
from cohortry.operators import rows as R
from cohortry.operators.reshape import stack
from cohortry.roles import ColumnRoles
from cohortry.session import shared_dir
from cohortry.sources import delimited, stores

_SUMS = """SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_discount), 2) AS discount,
                  count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1"""


def _sums(df):
    return df.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("l_quantity"), 2).alias("quantity"),
        F.round(F.sum("l_discount"), 2).alias("discount"),
        F.countDistinct("l_orderkey").alias("orders"),
    )


@query("s01_scan_delimited_glob", _SUMS)
def _(spark, sf):
    path = shared_dir(spark, "lines-csv")
    rows = table(spark, sf, "lineitem")
    for part, order in ((0, rows.columns), (1, rows.columns[::-1])):  # files that order their columns differently
        half = rows.filter(F.col("l_linenumber") % 2 == part).select(*order)
        half.write.mode("append").option("header", True).option("sep", ";").option("encoding", delimited.LATIN1).csv(path)
    cols = {"l_orderkey": "bigint", "l_quantity": "double", "l_discount": "double", "l_returnflag": "string"}
    return _sums(delimited.read_delimited(spark, f"{path}/*.csv", cols))


@query(
    "s02_s04_s05_scan_dimension",
    "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer",
)
def _(spark, sf):
    path = shared_dir(spark, "customers-csv")
    out = table(spark, sf, "customer").withColumn("c_custkey", F.col("c_custkey").cast("double"))
    out.write.option("header", True).option("sep", ";").option("encoding", delimited.LATIN1).csv(path)
    cols = {"c_custkey": "bigint", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}
    return delimited.read_delimited(spark, path, cols)


@query("s03_scan_comma_utf8", "SELECT p_partkey, p_name, p_type, p_retailprice FROM part")
def _(spark, sf):
    path = shared_dir(spark, "parts-csv")
    delimited.write_report(table(spark, sf, "part"), path)
    cols = {"p_partkey": "bigint", "p_name": "string", "p_type": "string", "p_retailprice": "double"}
    return delimited.read_delimited(spark, path, cols, sep=",", encoding="UTF-8")


@query("s06_s07_snapshot_by_group", _SUMS)
def _(spark, sf):
    path = shared_dir(spark, "snapshot")
    stores.write_snapshot(table(spark, sf, "lineitem"), path, "l_returnflag")
    return _sums(stores.read_snapshot(spark, path, ["l_quantity", "l_orderkey"]))


@query(
    "s07_tagged_csv_union",
    "SELECT CASE o_orderstatus WHEN 'F' THEN 'first' ELSE 'second' END AS tag, count(*) AS n, round(sum(o_totalprice), 2) AS total "
    "FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1",
)
def _(spark, sf):
    orders, paths = table(spark, sf, "orders"), {}
    for tag, status in (("first", "F"), ("second", "O")):
        paths[tag] = shared_dir(spark, f"orders-{tag}")
        orders.filter(F.col("o_orderstatus") == status).write.option("header", True).csv(paths[tag])
    both = stores.read_tagged_csv(spark, paths, "tag", orders.schema)
    return both.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("s08_report_csv", "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY 1")
def _(spark, sf):
    path = shared_dir(spark, "report")
    report = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("o_totalprice")).alias("mean"))
    delimited.write_report(report, path)
    return spark.read.schema(report.schema).option("header", True).csv(path)


@query("s09_locale_csv", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, sf):
    path = shared_dir(spark, "locale")
    delimited.write_locale_report(table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), path)
    return delimited.read_locale_report(spark, path, {"c_custkey": "bigint", "c_acctbal": "double", "c_mktsegment": "string"})


@query("s10_parameter_json", "SELECT o_orderstatus AS grp, count(*) AS n_orders FROM orders GROUP BY 1")
def _(spark, sf):
    path = shared_dir(spark, "params")
    counts = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_orders"))
    stores.write_params(
        counts.select(F.lit("counts").alias("model"), F.col("o_orderstatus").alias("grp"), F.to_json(F.struct("n_orders")).alias("params")), path
    )
    groups = [r[0] for r in counts.select("o_orderstatus").collect()]  # one row per status
    found = {g: stores.read_params(spark, path, "counts", g) for g in groups}
    return spark.createDataFrame([(g, p["n_orders"]) for g, p in found.items()], "grp string, n_orders bigint")


_NAMES = "(SELECT string_agg(column_name, '|') FROM (DESCRIBE SELECT * FROM {}))"


@query(
    "s13_header_audit",
    f"""SELECT * FROM (VALUES ('both', true, ',', {_NAMES.format('nation')}, 'r_regionkey|r_name', 3), ('both', true, ';', {_NAMES.format('region')}, '', 2),
       ('absent', false, NULL, NULL, 'x', NULL)) t(source, exists, delimiter, columns, missing, n_columns)""",
)
def _(spark, sf):
    path = shared_dir(spark, "headers-csv")
    delimited.write_report(table(spark, sf, "nation").coalesce(1), path)
    table(spark, sf, "region").coalesce(1).write.mode("append").option("header", True).option("sep", ";").csv(path)
    expected = {"both": (path, ["r_regionkey", "r_name"]), "absent": (f"{path}-none", ["x"])}
    report = delimited.header_report(spark, expected)
    return report.select("source", "exists", "delimiter", F.array_join("columns", "|").alias("columns"), F.array_join("missing", "|").alias("missing"), "n_columns")


@query(
    "p01_p02_p03_rename_and_choose_level",
    "SELECT p_partkey AS id, p_brand AS category, p_size AS size FROM part",
)
def _(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("P_PARTKEY"), "p_brand", "p_type", "p_size")
    picked = R.choose_level(R.lower_names(part), {"brand": "p_brand", "type": "p_type"}, "brand", "category")
    return R.rename(picked, {"p_partkey": "id", "p_size": "size"})


@query("p04_drop_tolerant", "SELECT s_suppkey, s_nationkey FROM supplier")
def _(spark, sf):
    return table(spark, sf, "supplier").drop("s_name", "s_acctbal", "not_there")


@query(
    "p05_difference",
    "SELECT l_orderkey, l_linenumber, CAST(year(l_shipdate) - year(o_orderdate) AS INTEGER) AS years "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
def _(spark, sf):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", X.difference(F.year("l_shipdate"), F.year("o_orderdate")).alias("years"))


@query(
    "p06_guarded_ratio",
    "SELECT l_orderkey, l_linenumber, l_discount, round(CASE WHEN l_discount = 0 THEN 0.0 ELSE l_tax / nullif(l_discount, 0) END, 6) AS ratio FROM lineitem",
)
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", r6(X.guarded_ratio("l_tax", "l_discount")).alias("ratio"))


@query("p07_rounded_ratio", f"WITH {ROWS_SQL} SELECT l_orderkey, l_linenumber, l_partkey, ratio FROM lines")
def _(spark, sf):
    return lines(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "ratio")


@query(
    "p08_p09_coerce_numbers",
    "SELECT c_custkey, c_acctbal AS balance, TRY_CAST(c_mktsegment AS DOUBLE) AS broken, c_custkey AS key_again, "
    "CAST(NULL AS BIGINT) AS no_key FROM customer",
)
def _(spark, sf):
    c = table(spark, sf, "customer").withColumn("comma", F.translate(F.col("c_acctbal").cast("string"), ".", ","))
    return c.select(
        "c_custkey",
        X.decimal_comma("comma").alias("balance"),
        X.decimal_comma("c_mktsegment").alias("broken"),
        X.to_long(F.concat(F.col("c_custkey").cast("string"), F.lit(".0"))).alias("key_again"),
        X.to_long("c_name").alias("no_key"),
    )


@query(
    "p10_p11_choose_column",
    """SELECT l_orderkey, l_linenumber,
         CASE WHEN l_linestatus = 'F' THEN l_extendedprice
              ELSE CASE l_linenumber WHEN 1 THEN l_quantity WHEN 2 THEN l_discount WHEN 3 THEN l_tax WHEN 4 THEN l_extendedprice END
         END AS chosen FROM lineitem""",
)
def _(spark, sf):
    by_line = X.choose_by_code("l_linenumber", {1: "l_quantity", 2: "l_discount", 3: "l_tax", 4: "l_extendedprice"})
    chosen = X.override_when("l_linestatus", "F", "l_extendedprice", by_line)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", chosen.alias("chosen"))


@query(
    "p12_p13_p14_filters",
    "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 5 AND l_quantity < 40 "
    "AND l_discount >= 0.02",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").filter(F.col("l_returnflag") == "N")
    return R.at_least(R.between_open(li, "l_quantity", 5, 40), "l_discount", 0.02).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query(
    "p15_split_by_codes",
    "SELECT n_nationkey, n_name, CASE WHEN n_regionkey IN (0, 1) THEN 'publica' ELSE 'privada' END AS tag FROM nation WHERE n_regionkey IN (0, 1, 2, 3)",
)
def _(spark, sf):
    return R.split_by_codes(table(spark, sf, "nation"), "n_regionkey", {"publica": [0, 1], "privada": [2, 3]}, "tag").select("n_nationkey", "n_name", "tag")


@query("p16_binary_label", "SELECT n_nationkey, CASE WHEN n_regionkey IN (0, 1) THEN 'Pública' ELSE 'Privada' END AS label FROM nation")
def _(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", X.binary_label("n_regionkey", [0, 1], "Pública", "Privada").alias("label"))


@query(
    "p17_p18_drop_incomplete",
    "SELECT d.doc_id, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL",
)
def _(spark, sf):
    joined = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return R.drop_incomplete(joined)


_HASH = "CAST(concat('0x', substr(md5(concat('42:', CAST(o_orderkey AS VARCHAR))), 1, 8)) AS BIGINT)"


@query("p19_sample_fraction", f"SELECT o_orderkey, o_totalprice FROM orders WHERE {_HASH} / 4294967296.0 < 0.1")
def _(spark, sf):
    return R.sample_fraction(table(spark, sf, "orders"), 0.1, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query(
    "p20_sample_rows",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(concat('42:', CAST(o_orderkey AS VARCHAR))), o_orderkey LIMIT 300",
)
def _(spark, sf):
    return R.sample_rows(table(spark, sf, "orders"), 300, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query(
    "p21_coded_boolean",
    "SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN true WHEN 2 THEN false ELSE l_linenumber <> 0 END AS flag FROM lineitem",
)
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.coded_boolean(F.col("l_linenumber").cast("double")).alias("flag"))


@query(
    "p22_category_text",
    "SELECT CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS code, count(*) AS n FROM lineitem GROUP BY 1",
)
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy(X.code_text("l_quantity").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p22_large_codes",
    "SELECT CAST(l_orderkey * 12345678 + 1 AS VARCHAR) AS code, count(*) AS n FROM lineitem GROUP BY 1",
)
def _(spark, sf):
    code = (F.col("l_orderkey") * 12345678 + 1).cast("double")
    return table(spark, sf, "lineitem").groupBy(X.code_text(code).alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p23_p24_status_bins",
    f"""WITH {ROWS_SQL}, d AS (SELECT *, round_even(ratio - 1, 1) AS gap FROM lines)
    SELECT l_orderkey, l_linenumber, l_partkey, gap,
      CASE WHEN gap <= -0.5 THEN 'Evasão Provável' WHEN gap <= 0.5 THEN 'Conclusão no Prazo' WHEN gap > 0.5 THEN 'Atraso' END AS closed,
      CASE WHEN gap < -0.5 THEN 'Evasão Provável' WHEN gap > 0.5 THEN 'Atraso' WHEN gap IS NOT NULL THEN 'Conclusão no Prazo' END AS strict FROM d""",
)
def _(spark, sf):
    d = lines(spark, sf).withColumn("gap", X.round_half_even(F.col("ratio") - 1, 1))
    return d.select(
        "l_orderkey", "l_linenumber", "l_partkey", "gap", X.status_closed_right("gap").alias("closed"), X.status_strict("gap").alias("strict")
    )


@query(
    "p25_p26_p27_label_maps",
    """SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' ELSE l_returnflag END AS with_fallback,
       CASE l_linenumber WHEN 1 THEN 'one' WHEN 2 THEN 'two' END AS without_fallback, 'lines' AS tag FROM lineitem""",
)
def _(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        X.label_map("l_returnflag", {"A": "accepted", "R": "returned"}, fallback="l_returnflag").alias("with_fallback"),
        X.label_map("l_linenumber", {1: "one", 2: "two"}).alias("without_fallback"),
        F.lit("lines").alias("tag"),
    )


@query("p28_replace_text", "SELECT p_partkey, replace(p_brand, 'Brand#', 'B') AS brand FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.replace("p_brand", F.lit("Brand#"), F.lit("B")).alias("brand"))


@query("p29_log1p", "SELECT o_orderkey, round(ln(1 + o_totalprice), 6) AS log_price FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", r6(F.log1p("o_totalprice")).alias("log_price"))


@query(
    "p30_display_name",
    """SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(replace(replace(p_name, ' ', '_'), '_', ' '), '[a-zA-Z]+|[^a-zA-Z]+'),
       lambda x: upper(x[1]) || lower(x[2:])), '') AS shown FROM part""",
)
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.display_name(F.translate("p_name", " ", "_")).alias("shown"))


@query(
    "p31_base_feature_name",
    """SELECT concat('p_brand_', p_brand) AS encoded, 'p_brand' AS base, count(*) AS n FROM part GROUP BY 1
       UNION ALL SELECT 'p_size' AS encoded, 'p_size' AS base, count(*) AS n FROM part""",
)
def _(spark, sf):
    part = table(spark, sf, "part")
    names = part.select(F.explode(F.array(F.concat(F.lit("p_brand_"), "p_brand"), F.lit("p_size"))).alias("encoded"))
    return names.groupBy("encoded", X.base_feature_name("encoded", ["p_size"]).alias("base")).agg(F.count(F.lit(1)).alias("n"))


@query("p32_overwrite_constant", "SELECT l_orderkey, l_linenumber, l_tax, CAST(0.05 AS DOUBLE) AS l_discount FROM lineitem")
def _(spark, sf):
    return R.overwrite_constants(table(spark, sf, "lineitem"), {"l_discount": 0.05}).select("l_orderkey", "l_linenumber", "l_tax", "l_discount")


@query(
    "p33_p34_columns_by_role",
    "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderpriority FROM orders",
)
def _(spark, sf):
    orders = table(spark, sf, "orders")
    roles = ColumnRoles.from_schema(orders, target="o_totalprice")
    return R.require_columns(orders, [*roles.features, "o_totalprice"]).select("o_orderkey", "o_custkey", "o_totalprice", *roles.categorical)


@query("p35_distinct_values", "SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority IS NOT NULL")
def _(spark, sf):
    return table(spark, sf, "orders").filter(F.col("o_orderpriority").isNotNull()).select("o_orderpriority").distinct()


@query(
    "f07_train_test_split",
    f"SELECT CASE WHEN {_HASH} % 100 < 20 THEN 'test' ELSE 'train' END AS part, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
)
def _(spark, sf):
    train, test = R.train_test_split(table(spark, sf, "orders"), ["o_orderkey"])
    both = stack([train.withColumn("part", F.lit("train")), test.withColumn("part", F.lit("test"))])
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "g03_stable_folds",
    f"SELECT CAST({_HASH.replace('42:', '43:')} % 5 AS INTEGER) AS fold, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
)
def _(spark, sf):
    folded = R.with_fold(table(spark, sf, "orders"), ["o_orderkey"], 5)
    return folded.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
