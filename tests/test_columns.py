"""Traps of missing values, division, rounding and edges, on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from cohortry.functions import columns as X
from cohortry.operators import aggregates as A
from cohortry.operators import joins as J
from cohortry.operators import reshape as S
from cohortry.operators import rows as R
from cohortry.roles import ColumnRoles
from cohortry.sources.delimited import clean_nan


def one(df):
    return [tuple(r) for r in df.collect()]


def test_nan_is_missing(spark):
    df = clean_nan(spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double"))
    assert df.agg(F.avg("x")).first()[0] == 2.0
    assert R.drop_incomplete(df).count() == 2


def test_zero_denominator(spark):
    df = spark.createDataFrame([(5.0, 0.0), (5.0, None), (5.0, 2.0)], "a double, b double")
    assert one(df.select(X.guarded_ratio("a", "b"), X.rounded_ratio("a", "b"))) == [(0.0, None), (None, None), (2.5, 2.5)]


def test_bad_numbers(spark):
    df = spark.createDataFrame([("4,5",), ("x",), ("",), (None,), ("NaN",)], "t string")
    assert one(df.select(X.decimal_comma("t"))) == [(4.5,), (None,), (None,), (None,), (None,)]
    keys = spark.createDataFrame([("12",), ("12.0",), ("x",), ("9007199254740993",)], "t string")
    assert one(keys.select(X.to_long("t"))) == [(12,), (12,), (None,), (9007199254740993,)]


def test_null_keys(spark):
    df = spark.createDataFrame([(None, 1.0), ("a", 2.0)], "k string, v double")
    assert one(A.mean_by(df, ["v"], ["k"])) == [("a", 2.0)]
    assert J.join_shared(df, df.withColumnRenamed("v", "w"), ["k"]).count() == 1
    audit = J.join_audit(df, df, ["k"]).first()
    assert (audit.left_rows, audit.joined_rows, audit.left_unmatched, audit.right_unmatched) == (2, 1, 1, 1)


def test_rounding(spark):
    df = spark.createDataFrame([(0.00015,), (0.12345,), (1.00005,)], "x double")
    assert one(df.select(X.round_half_even("x", 4))) == [(0.0001,), (0.1234,), (1.0001,)]


def test_status_edges(spark):
    df = spark.createDataFrame([(-0.5,), (0.5,), (0.50001,), (None,)], "d double")
    closed, strict = zip(*one(df.select(X.status_closed_right("d"), X.status_strict("d"))))
    assert closed == ("Evasão Provável", "Conclusão no Prazo", "Atraso", None)
    assert strict == ("Conclusão no Prazo", "Conclusão no Prazo", "Atraso", None)


def test_mode_ties_and_types(spark):
    df = spark.createDataFrame([("b", 10), ("a", 9), ("a", 10), ("b", 9), (None, None)], "t string, n int")
    modes = A.modes(df, ["t", "n"])
    assert one(modes) == [("a", 9)] and dict(modes.dtypes)["n"] == "int"
    assert one(A.distinct_counts(df, ["t", "n"])) == [(2, 2)]
    empty_group = spark.createDataFrame([("g", None, 1)], "g string, t string, n int")
    assert one(A.modes(empty_group, ["t", "n"], ["g"])) == [("g", None, 1)]


def test_modes_over_many_columns(spark):
    names = [f"c{i}" for i in range(130)]
    df = spark.createDataFrame([tuple(range(130)), tuple(range(130)), tuple([0] * 130)], ", ".join(f"{n} int" for n in names))
    assert one(A.modes(df, names)) == [tuple(range(130))]


def test_latest_row_tie_break(spark):
    rows = [(1, 2019, 30), (1, 2019, 20), (1, 2018, 10), (2, None, 5)]
    df = spark.createDataFrame(rows, "k int, y int, load int")
    for parts in (1, 4):
        assert sorted(one(S.latest_per_key(df.repartition(parts), ["k"], "y"))) == [(1, 2019, 20), (2, None, 5)]


def test_case_clashes_are_refused(spark):
    df = spark.createDataFrame([(1, 2)], "t int, u int")
    with pytest.raises(ValueError):
        R.rename(df, {"u": "T"})
    with pytest.raises(ValueError):
        J.join_shared(df, df, ["t"])
    with pytest.raises(ValueError):
        R.require_columns(df, ["none"])


def test_codes_outside_all_groups(spark):
    df = spark.createDataFrame([(1,), (5,), (9,), (None,)], "c int")
    groups = {"publica": [1, 2, 3], "privada": [4, 5, 6, 7, 8]}
    assert sorted(one(R.split_by_codes(df, "c", groups, "g"))) == [(1, "publica"), (5, "privada")]
    assert [r[0] for r in one(df.select(X.binary_label("c", [1, 2, 3], "Pública", "Privada")))] == ["Pública"] + ["Privada"] * 3
    assert R.split_by_codes(df, "missing", groups, "g").count() == 0


def test_names(spark):
    df = spark.createDataFrame([("tp_cor_raca_1.0",), ("tp_sexo",), ("igc",), ("in_apoio_social",)], "n string")
    plain = ["igc", "tp_sexo", "in_apoio_social"]
    assert [r[0] for r in one(df.select(X.base_feature_name("n", plain)))] == ["tp_cor_raca", "tp_sexo", "igc", "in_apoio_social"]
    shown = [r[0] for r in one(df.select(X.display_name("n")))]
    assert shown == [n.replace("_", " ").title() for n, in one(df)]


def test_code_text_and_boolean(spark):
    df = spark.createDataFrame([("1",), ("1.0",), ("2.0",), ("x.0",), ("0",)], "t string")
    assert [r[0] for r in one(df.select(X.code_text("t")))] == ["1", "1", "2", "x.0", "0"]
    assert [r[0] for r in one(df.select(X.coded_boolean("t")))] == [True, True, False, None, False]


def test_label_fallback(spark):
    df = spark.createDataFrame([(1.0,), (7.0,), (None,)], "c double")
    assert one(df.select(X.label_map("c", {1: "one"}), X.label_map("c", {1: "one"}, "c"))) == [("one", "one"), (None, "7.0"), (None, None)]


def test_samples_and_splits_ignore_partitions(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    for op in (lambda d: R.sample_fraction(d, 0.1, ["k"]), lambda d: R.sample_rows(d, 50, ["k"]), lambda d: R.train_test_split(d, ["k"])[1]):
        a, b = (sorted(r[0] for r in op(df.repartition(n)).collect()) for n in (1, 7))
        assert a == b and a
    train, test = R.train_test_split(df, ["k"])
    assert train.count() + test.count() == 2000
    assert 300 < test.count() < 500


def test_roles(spark):
    df = spark.createDataFrame([(1, "a", 2.0, True)], "i int, t string, d double, b boolean")
    roles = ColumnRoles.from_schema(df, forced_categorical=("i",), target="d")
    assert roles.numeric == ("b",) and roles.categorical == ("i", "t")
