"""First lines of many delimited files are read by tasks, in one job."""

import pytest

from cohortry.sources import delimited


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("many files")
    for i in range(60):
        header, row = (("a;b;c", f"{i};2;3"), ("c;a;b", f"3;{i};2"), ('"b";"a";"c";"d"', f"2;{i};3;4"))[i % 3]
        (path / f"part {i:02}.csv").write_bytes(f"{header}\r\n{row}\r\n".encode() + f"{row}\r\n".encode() * (i % 5))
    (path / "nothing.csv").write_bytes(b"")
    return path


def _jobs(spark, run):
    spark.sparkContext.setJobGroup("headers", "headers")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("headers"))
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup("headers")) - before
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_scan_finds_columns_by_name(spark, folder):
    kinds = {"a": "bigint", "b": "bigint", "c": "bigint"}
    df, jobs = _jobs(spark, lambda: delimited.read_delimited(spark, f"{folder}/*.csv", kinds))
    assert jobs <= 8  # listings, first lines, and one look at each of three headers: no job a file
    rows = df.collect()
    assert len(rows) == sum(1 + i % 5 for i in range(60))
    assert {r.a for r in rows} == set(range(60)) and {(r.b, r.c) for r in rows} == {(2, 3)}
    with pytest.raises(ValueError, match="lacks"):
        delimited.read_delimited(spark, f"{folder}/*.csv", {"d": "string"})


def test_audit_of_many_files_and_sources(spark, folder):
    expected = {"first": (f"{folder}/part 0*.csv", ["a", "d"]), "all": (str(folder), ["a"]), "none": (f"{folder}/x*.csv", ["a"])}
    report, jobs = _jobs(spark, lambda: delimited.header_report(spark, expected))
    assert jobs <= 4
    rows = report.collect()
    assert [r.source for r in rows].count("all") == 60 and [r.source for r in rows].count("first") == 10
    assert {(tuple(r.columns), tuple(r.missing)) for r in rows if r.source == "first"} == {
        (("a", "b", "c"), ("d",)), (("c", "a", "b"), ("d",)), (("b", "a", "c", "d"), ()),
    }
    assert [(r.exists, r.missing) for r in rows if r.source == "none"] == [(False, ["a"])]


def test_wide_files_are_not_read_to_the_end(spark, tmp_path):
    (tmp_path / "long.csv").write_text("x,y\n" + "1,2\n" * 2_000_000)
    assert delimited.header_report(spark, {"l": (str(tmp_path), ["x"])}).select("n_columns").collect()[0][0] == 2
