"""The census preset end to end on generated raw files, sources and sinks, and streaming use."""

import random

import pytest
from pyspark.sql import functions as F

from cohortry.functions.columns import rounded_ratio, status_strict
from cohortry.operators.joins import join_shared
from cohortry.operators.kprototypes import KPrototypesModel
from cohortry.operators.scenarios import POLICIES, SCENARIO_DEFAULTS, SCENARIO_LABELS, scenario_grid, scenario_report, score_scenarios
from cohortry.plans import census, study
from cohortry.sources import delimited, stores


def write(path, header, rows, sep=";", encoding="latin-1"):
    path.parent.mkdir(parents=True, exist_ok=True)
    lines = [sep.join(header)] + [sep.join("" if v is None else str(v) for v in r) for r in rows]
    path.write_text("\n".join(lines) + "\n", encoding=encoding)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base, rnd = tmp_path_factory.mktemp("raw"), random.Random(7)
    for year in (2018, 2019, 2020):
        rows = []
        for _ in range(400):
            rows.append(
                [f"{year}.0", year - rnd.randint(0, 7), rnd.choice([2, 2, 2, 3]), rnd.randint(1, 4), rnd.randint(10, 14), rnd.randint(0, 5), rnd.randint(1, 2), rnd.randint(1, 8),
                 rnd.choice([1, 2, 9]), rnd.randint(0, 1), rnd.choice([0, 1, None] if _ % 50 == 0 else [0, 1]), rnd.choice([1, 1, 2]), rnd.randint(1, 4), "extra"]
            )
        write(base / f"ces/SoU_censo_alunos/SoU_censo_alunos_{year}/alunos.csv", [*census.STUDENTS, "other"], rows)
    courses = [
        [year, ies, curso, 3000 + curso, 1, 1 + curso % 3, "4,5", "4", "x" if curso == 14 else "5,0", "4.0", "3,5", 100, 0 if curso == 10 else 40, f"L{curso % 2}", "SP" if ies < 3 else "MG"]
        for year in (2018, 2019) for ies in range(1, 5) for curso in range(10, 15)
    ]
    write(base / "ces/SoU_censo_cursos/SoU_censo_curso.csv", list(census.COURSES), courses)
    write(base / "ces/SoU_censo_IES/SoU_censo_IES.csv", list(census.INSTITUTIONS), [[i, y, [1, 2, 4, 9][i - 1], "Nordéste"] for i in range(1, 5) for y in (2018, 2019)])
    write(base / "igc/igc_tratado.csv", ["ano", "cod_ies", "igc", "igc_fx"], [[2019, 1, 2.5, 3], [2019, 2, 3.5, 4]])
    write(base / "cine/cine.csv", ["CO_CINE_AREA_GERAL", *census.SUBJECTS], [["g", "Geral A", "Programas interdisciplinares abrangendo X", "L0"], ["g", "Geral A", "Direito", "L1"]], ",", "utf-8")
    write(base / "ibge/pib_tratado.csv", list(census.GDP), [["SP", "São Paulo", *range(100, 109)], ["MG", "Minas", *range(200, 209)]])
    return str(base)


@pytest.fixture(scope="module")
def table(spark, root):
    return census.integrate(census.read_sources(spark, root), fraction=None, keep_duration=True).cache()


def test_course_dimension(spark, root):
    dim = {(r.co_ies, r.co_curso): r for r in census.course_dimension(census.read_sources(spark, root)).collect()}
    assert len(dim) == 20  # one row per course, the newest year
    a = dim[1, 10]
    assert (a.nu_ano_censo, a.inscritos_por_vaga, a.pib, a.nm_categoria) == (2019, 0.0, 105, "Programas interdisciplinares abrangendo X")
    assert a.no_regiao_ies == "Nordéste" and a.nu_integralizacao_integral == 4.5 and dim[1, 11].inscritos_por_vaga == 2.5
    assert dim[1, 14].nu_integralizacao_vespertino is None
    assert dim[3, 10].igc == pytest.approx(3.0)  # the mean over the joined courses
    general = census.course_dimension(census.read_sources(spark, root), "general")
    assert {r.nm_categoria for r in general.collect()} == {"Geral A"}


def test_integration(table, spark, root):
    assert table.filter("tempo_permanencia <= 0 or taxa_integralizacao is null").count() == 0
    assert {(r.tp_categoria_administrativa, r.tipo_ies) for r in table.select("tp_categoria_administrativa", "tipo_ies").distinct().collect()} == {(1, "publica"), (2, "publica"), (4, "privada")}
    row = table.first()
    assert row.taxa_integralizacao == pytest.approx(row.tempo_permanencia / row.duracao_ideal_anos, abs=5.1e-5)
    plain = census.integrate(census.read_sources(spark, root), fraction=None)
    assert set(plain.columns) == {*census.CLUSTER_ROLES.features, "tipo_ies"}
    # the raw files by hand
    want = 0
    for year in (2018, 2019, 2020):
        text = open(f"{root}/ces/SoU_censo_alunos/SoU_censo_alunos_{year}/alunos.csv", encoding="latin-1").read().split("\n")[1:-1]
        for line in text:
            f = line.split(";")
            if "" in f or f[2] != "2" or not 0 < year - int(f[1]) < 20 or f[3] == "4":
                continue
            if f[4] == "14" and f[11] != "2" and f[12] == "2":
                continue  # no duration for that shift
            want += 1
    assert plain.count() == want


def test_sampling(spark, root):
    sources = census.read_sources(spark, root)
    a = census.integrate(sources, fraction=0.5, keys=("co_ies", "co_curso", "nu_ano_ingresso", "faixa_etaria", "tp_cor_raca"))
    assert 0 < a.count() < census.integrate(sources, fraction=None).count()
    assert a.count() == a.count()


def test_comparison_report(table):
    out = census.compare_groups(table.drop("tempo_permanencia"))
    overall = out["overall"].first()
    assert overall.n1 + overall.n2 == table.count()
    tests = out["tests"].collect()
    assert out["tests"].columns == ["Feature", "Categoria", "P-Valor", "Significancia", "N_Publica", "N_Privada"]
    assert {r.Categoria for r in tests if r.Feature == "nm_categoria"} == {"Prog. Interdisciplinar X", "Direito"}
    assert {r.Categoria for r in tests if r.Feature == "tp_sexo"} == {"Feminino", "Masculino"}
    assert sum(r.N_Publica + r.N_Privada for r in tests if r.Feature == "no_regiao_ies") == table.count()
    assert {r.feature for r in out["bins"].collect()} <= set(census.BINNED)
    statuses = census.durations(table).groupBy("status_conclusao", "tipo_ies").count().collect()
    assert sum(r["count"] for r in statuses) == table.count() and {r.tipo_ies for r in statuses} == {"Pública", "Privada"}


def test_study_and_policies(spark, table):
    rows = table.drop("tempo_permanencia")
    done = study.run_study(
        rows, ["publica", "privada"], census.REGRESSION_ROLES, ks={"publica": 2, "privada": 2}, cluster_roles=census.CLUSTER_ROLES,
        params={"n_estimators": 3, "max_depth": 3}, cluster_options={"nInit": 1, "maxIter": 3, "drivers": False},
        min_year=None, boolean_codes=("tp_sexo",), leakage=census.LEAKAGE,
    )
    assert done["publica"].clusters.cost > 0
    sizes = done["publica"].reports["cluster_sizes"].collect()
    assert sum(r["count"] for r in sizes) == rows.filter("tipo_ies = 'publica'").count()
    reports = study.study_reports(done)
    assert {r.instituicao for r in reports["metrics"].collect()} == {"publica", "privada"}
    assert reports["importance"].count() > 4
    base = done["publica"].reports["importance_base"].collect()
    assert sum(r.importance for r in base) == pytest.approx(1)
    parts = {g: rows.filter(F.col("tipo_ies") == g) for g in done}
    policy = study.policy_report(done, parts, POLICIES).collect()
    assert policy[0].Delta_Apoio == pytest.approx(policy[0].Apoio_Universal - policy[0].Base)
    values = {c: list(v) for c, v in SCENARIO_LABELS.items()}
    grid = scenario_grid(spark, values, ("faixa", "igc", {1: 0.5, 3: 2.5, 5: 4.5}), defaults=SCENARIO_DEFAULTS | {"tp_categoria_administrativa": 1})
    scored = score_scenarios(grid.withColumn("tp_sexo", (F.col("tp_sexo") == 2).cast("double")).withColumn("sexo", F.col("tp_sexo")), done["publica"].score, "duracao_ideal_anos", "publica")
    assert scored.count() == 6 * 2 * 2 * 2 * 2 * 2 * 3
    report = scenario_report(scored.withColumn("tp_sexo", F.col("sexo") + 1))
    assert set(report.columns) == {"Tipo IES", "Cor/Raça", "Sexo", "Escola Média", "Modalidade", "Financiamento", "Apoio Social", "Faixa IGC", "Previsão (anos)", "Taxa Prevista", "Status Conclusão"}
    assert report.filter(F.col("Sexo").isNull()).count() == 0


def test_compare_cluster_counts(table):
    rows = table.filter("tipo_ies = 'publica'").drop("tempo_permanencia", "tipo_ies")
    out = study.compare_cluster_counts(
        rows, "publica", census.REGRESSION_ROLES, census.CLUSTER_ROLES, [2, 3], params={"n_estimators": 2, "max_depth": 3},
        options={"nInit": 1, "maxIter": 3},
    ).collect()
    assert [r.k for r in out] == [2, 3]
    assert all(sum(r.sizes) == rows.count() for r in out)


def test_sources(spark, root, tmp_path):
    with pytest.raises(ValueError):
        delimited.read_delimited(spark, f"{root}/igc/igc_tratado.csv", {"none": "string"})
    report = spark.createDataFrame([("a", 1.25, 3), ("b", None, 4)], "t string, x double, n bigint")
    delimited.write_locale_report(report, f"{tmp_path}/locale")
    text = "".join(r.value for r in spark.read.text(f"{tmp_path}/locale").collect())
    assert "a;1,25;3" in text
    again = delimited.read_locale_report(spark, f"{tmp_path}/locale", {"t": "string", "x": "double", "n": "bigint"})
    assert sorted(again.collect()) == sorted(report.collect())
    stores.write_params(stores.params_frame(spark, [("RandomForest", "publica", {"n_estimators": 7, "max_depth": None})]), f"{tmp_path}/params")
    assert stores.read_params(spark, f"{tmp_path}/params", "RandomForest", "publica") == {"max_depth": None, "n_estimators": 7}
    assert stores.read_params(spark, f"{tmp_path}/params", "Ridge", "publica") is None
    assert stores.read_params(spark, f"{tmp_path}/absent", "Ridge", "publica") is None
    assert stores.load_model_with_features(spark, [f"{tmp_path}/a", f"{tmp_path}/b"], f"{tmp_path}/c") == (None, None)
    stores.write_snapshot(report, f"{tmp_path}/snap", "t")
    assert stores.read_snapshot(spark, f"{tmp_path}/snap", ["x"]).count() == 2
    with pytest.raises(ValueError):
        stores.read_snapshot(spark, f"{tmp_path}/snap", ["y"])


def test_pushdown_reaches_the_scan(spark, sf):
    from cohortry.operators.rows import at_least, between_open

    df = at_least(between_open(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_quantity", 5, 40), "l_discount", 0.02).select("l_tax")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), IsNotNull(l_discount), GreaterThan(l_quantity,5.0)" in plan
    assert "l_returnflag" not in plan


def test_row_operators_on_a_stream(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/lineitem.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{sf}/lineitem.parquet").write.parquet(f"{tmp_path}/in/lines")
    part = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    import json

    state = {"numeric": ["l_quantity"], "categorical": ["l_returnflag"], "gamma": 1.0, "cost": 0.0, "iterations": 0, "history": [], "prototypes": [[[10.0], ["A"]], [[40.0], ["R"]]]}
    model = KPrototypesModel(state=json.dumps(state))

    def steps(df):
        rows = join_shared(df, part, ["l_partkey"]).withColumn("ratio", rounded_ratio("l_quantity", "p_size"))
        return model.transform(rows.withColumn("status", status_strict(F.col("ratio") - 1))).select("l_orderkey", "l_linenumber", "ratio", "status", "cluster")

    stream = steps(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/lines"))
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start(f"{tmp_path}/out")
    run.awaitTermination(120)
    batch = steps(spark.read.schema(schema).parquet(f"{tmp_path}/in/lines"))
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(str, batch.collect()))
