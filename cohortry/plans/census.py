"""Preset for higher-education census files: sources, integration, and the comparison report.

The census column names live here only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortry.functions.columns import (
    choose_by_code,
    coded_boolean,
    decimal_comma,
    difference,
    guarded_ratio,
    label_map,
    override_when,
    rounded_ratio,
    to_double,
)
from cohortry.operators.evaluation import bin_means, category_means, duration_comparison
from cohortry.operators.hypothesis import category_tests, comparison_report, mann_whitney
from cohortry.operators.joins import fill_with_mean, join_renamed, join_shared
from cohortry.operators.reshape import latest_per_key, unpivot_years
from cohortry.operators.rows import between_open, choose_level, drop_incomplete, lower_names, rename, sample_fraction, split_by_codes
from cohortry.roles import ColumnRoles
from cohortry.sources.delimited import read_delimited

# Files, separators, encodings and columns of the raw sources.
STUDENTS = {
    "nu_ano_censo": "double",
    "nu_ano_ingresso": "double",
    "tp_situacao": "double",
    "co_ies": "bigint",
    "co_curso": "bigint",
    "tp_cor_raca": "double",
    "tp_sexo": "double",
    "faixa_etaria": "double",
    "tp_escola_conclusao_ens_medio": "double",
    "in_apoio_social": "double",
    "in_financiamento_estudantil": "double",
    "tp_modalidade_ensino": "double",
    "tp_turno": "double",
}
DURATIONS = [
    "NU_INTEGRALIZACAO_INTEGRAL",
    "NU_INTEGRALIZACAO_MATUTINO",
    "NU_INTEGRALIZACAO_VESPERTINO",
    "NU_INTEGRALIZACAO_NOTURNO",
    "NU_INTEGRALIZACAO_EAD",
]
COURSES = {
    "NU_ANO_CENSO": "bigint",
    "CO_IES": "bigint",
    "CO_CURSO": "bigint",
    "NU_CARGA_HORARIA": "bigint",
    "TP_MODALIDADE_ENSINO": "int",
    "TP_GRAU_ACADEMICO": "int",
    "NU_INTEGRALIZACAO_INTEGRAL": "string",
    "NU_INTEGRALIZACAO_MATUTINO": "string",
    "NU_INTEGRALIZACAO_VESPERTINO": "string",
    "NU_INTEGRALIZACAO_NOTURNO": "string",
    "NU_INTEGRALIZACAO_EAD": "string",
    "QT_INSCRITO_TOTAL": "double",
    "QT_VAGA_TOTAL": "double",
    "CO_CINE_ROTULO": "string",
    "SIGLA_UF_CURSO": "string",
}
INSTITUTIONS = {"co_ies": "bigint", "nu_ano_censo": "bigint", "tp_categoria_administrativa": "int", "no_regiao_ies": "string"}
QUALITY = {"ano": "bigint", "cod_ies": "bigint", "igc": "double"}
SUBJECTS = {"NM_CINE_AREA_GERAL": "string", "NM_CINE_AREA_ESPECIFICA": "string", "CO_CINE_ROTULO": "string"}
YEARS = ["2014", "2015", "2016", "2017", "2018", "2019", "2020", "2021", "2022"]
GDP = {"Sigla": "string", "UF": "string"} | {y: "bigint" for y in YEARS}
FILES = {
    "students": ("ces/SoU_censo_alunos/SoU_censo_alunos_*/*.csv", STUDENTS, ";", "ISO-8859-1"),
    "courses": ("ces/SoU_censo_cursos/SoU_censo_curso.csv", COURSES, ";", "ISO-8859-1"),
    "institutions": ("ces/SoU_censo_IES/SoU_censo_IES.csv", INSTITUTIONS, ";", "ISO-8859-1"),
    "quality": ("igc/igc_tratado.csv", QUALITY, ";", "ISO-8859-1"),
    "subjects": ("cine/cine.csv", SUBJECTS, ",", "UTF-8"),
    "gdp": ("ibge/pib_tratado.csv", GDP, ";", "ISO-8859-1"),
}
GROUPS = {"publica": [1, 2, 3], "privada": [4, 5, 6, 7, 8]}
LEVELS = {"specific": "NM_CINE_AREA_ESPECIFICA", "general": "NM_CINE_AREA_GERAL"}
LEAKAGE = ("nu_ano_censo", "diferenca_permanencia", "status_conclusao", "tipo_ies")
CATEGORY_LABELS = {
    "tp_cor_raca": {0: "Não Declarada", 1: "Branca", 2: "Preta", 3: "Parda", 4: "Amarela", 5: "Indígena", 9: "Não Dispõe"},
    "tp_sexo": {1: "Feminino", 2: "Masculino"},
    "tp_escola_conclusao_ens_medio": {1: "Pública", 2: "Privada", 9: "Não Informado"},
    "tp_grau_academico": {1: "Bacharelado", 2: "Licenciatura", 3: "Tecnológico", 4: "Bacharelado e Licenciatura", 5: "Outros"},
    "faixa_etaria": {
        1: "1 até 17",
        2: "18 - 21",
        3: "22 - 25",
        4: "26 - 29",
        5: "30 - 33",
        6: "34 - 37",
        7: "38 - 41",
        8: "42 - 45",
        9: "46 - 49",
        10: "50 - 53",
        11: "54 - 57",
        12: "58 - 61",
        13: "62 - 65",
        14: "maior do que 65",
    },
}
COMPARED = [
    "tp_cor_raca",
    "tp_sexo",
    "faixa_etaria",
    "tp_escola_conclusao_ens_medio",
    "tp_grau_academico",
    "no_regiao_ies",
    "nm_categoria",
    "sigla_uf_curso",
]
BINNED = ["igc", "pib", "inscritos_por_vaga", "duracao_ideal_anos"]
LONG_NAME, SHORT_NAME = "Programas interdisciplinares abrangendo", "Prog. Interdisciplinar"

TARGET = "taxa_integralizacao"
REGRESSION_ROLES = ColumnRoles(
    numeric=(
        "tp_sexo",
        "faixa_etaria",
        "in_apoio_social",
        "nu_carga_horaria",
        "pib",
        "inscritos_por_vaga",
        "igc",
        "duracao_ideal_anos",
    ),
    categorical=(
        "tp_cor_raca",
        "tp_escola_conclusao_ens_medio",
        "in_financiamento_estudantil",
        "tp_grau_academico",
        "tp_modalidade_ensino",
        "tp_categoria_administrativa",
        "sigla_uf_curso",
        "nm_categoria",
        "no_regiao_ies",
    ),
    target=TARGET,
)
# the target is part of the clustering input, as published; drop it with .without(TARGET)
CLUSTER_ROLES = ColumnRoles(
    numeric=("nu_ano_censo", *REGRESSION_ROLES.numeric, TARGET), categorical=REGRESSION_ROLES.categorical
)
CLUSTERS_PER_GROUP = {"publica": 3, "privada": 5}
SWEEP_PER_STUDY = (4, 5, 6, 10, 11, 14, 15)


def read_sources(spark: SparkSession, root: str, files: Mapping[str, tuple] = FILES) -> dict[str, DataFrame]:
    return {
        name: read_delimited(spark, f"{root.rstrip('/')}/{path}", columns, sep, encoding)
        for name, (path, columns, sep, encoding) in files.items()
    }


def course_dimension(sources: Mapping[str, DataFrame], level: str = "specific") -> DataFrame:
    """One row per course and institution: the newest census year, with subject, state GDP, institution and quality."""
    subjects = choose_level(sources["subjects"], LEVELS, level, "nm_categoria")
    gdp = unpivot_years(sources["gdp"], ["Sigla", "UF"], YEARS, "ano", "pib").drop("UF")
    courses = join_shared(sources["courses"], subjects, ["CO_CINE_ROTULO"])
    courses = join_renamed(courses, gdp, [("SIGLA_UF_CURSO", "Sigla"), ("NU_ANO_CENSO", "ano")])
    courses = courses.withColumns({c: decimal_comma(c) for c in DURATIONS})
    courses = courses.withColumn("inscritos_por_vaga", guarded_ratio("QT_INSCRITO_TOTAL", "QT_VAGA_TOTAL"))
    courses = lower_names(courses.drop("QT_INSCRITO_TOTAL", "QT_VAGA_TOTAL"))
    newest = latest_per_key(courses, ["co_ies", "co_curso"], "nu_ano_censo")
    joined = join_shared(newest, sources["institutions"], ["co_ies", "nu_ano_censo"])
    quality = rename(sources["quality"], {"ano": "nu_ano_censo", "cod_ies": "co_ies"})
    return fill_with_mean(join_shared(joined, quality, ["co_ies", "nu_ano_censo"], "left"), "igc")


def student_rows(students: DataFrame, fraction: float | None = 0.01, keys: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """Complete, active rows with 0 < years since entry < 20, sampled.

    The census files carry no row id. With ``keys`` the sample depends on the key alone; without, Spark's seeded sample
    is used, which depends on how the files are split.
    """
    rows = rename(drop_incomplete(students), {"tp_modalidade_ensino": "tp_modalidade_ensino_x"})
    rows = rows.withColumn("tempo_permanencia", difference("nu_ano_censo", "nu_ano_ingresso")).filter(F.col("tp_situacao") == 2)
    rows = between_open(rows, "tempo_permanencia", 0, 20)
    if fraction is None:
        return rows
    return sample_fraction(rows, fraction, keys, seed) if keys else rows.sample(fraction, seed)


def with_ratio(rows: DataFrame) -> DataFrame:
    on_site = choose_by_code(
        "tp_turno",
        {
            1: "nu_integralizacao_matutino",
            2: "nu_integralizacao_vespertino",
            3: "nu_integralizacao_noturno",
            4: "nu_integralizacao_integral",
        },
    )
    ideal = override_when("tp_modalidade_ensino_x", 2, "nu_integralizacao_ead", on_site)
    return rows.withColumn("duracao_ideal_anos", ideal).withColumn(
        TARGET, rounded_ratio("tempo_permanencia", "duracao_ideal_anos")
    )


def integrate(
    sources: Mapping[str, DataFrame],
    level: str = "specific",
    fraction: float | None = 0.01,
    keys: Sequence[str] = (),
    seed: int = 42,
    keep_duration: bool = False,
) -> DataFrame:
    """The study table: one row per kept student record, tagged with ``tipo_ies``.

    ``keep_duration`` keeps the years since entry for :func:`durations`.
    """
    dimension = course_dimension(sources, level).drop("nu_ano_censo")
    students = student_rows(sources["students"], fraction, keys, seed)
    rows = with_ratio(join_shared(students, dimension, ["co_curso", "co_ies"]))
    spent = [
        "tp_modalidade_ensino_x",
        "tp_turno",
        "nu_ano_ingresso",
        "tp_situacao",
        "co_ies",
        "co_curso",
        "co_cine_rotulo",
        *[c.lower() for c in DURATIONS],
    ]
    if not keep_duration:
        spent.append("tempo_permanencia")
    rows = drop_incomplete(rows.drop(*spent)).withColumn("nu_ano_censo", F.col("nu_ano_censo").cast("bigint"))
    return split_by_codes(rows, "tp_categoria_administrativa", GROUPS, "tipo_ies")


def durations(study: DataFrame) -> DataFrame:
    """Actual against ideal years (needs ``integrate(..., keep_duration=True)``)."""
    rows = study.drop("tipo_ies")
    return duration_comparison(rows, "tempo_permanencia", "duracao_ideal_anos", "tp_categoria_administrativa", GROUPS["publica"])


def labelled(study: DataFrame) -> DataFrame:
    """Codes as labels, the long subject name shortened, the logarithm of GDP, and the group in capitals."""
    out = {c: label_map(c, table) for c, table in CATEGORY_LABELS.items()}
    out["tp_cor_raca"] = label_map("tp_cor_raca", CATEGORY_LABELS["tp_cor_raca"], fallback="tp_cor_raca")
    sex = F.when(coded_boolean("tp_sexo"), 1.0).otherwise(2.0) if dict(study.dtypes)["tp_sexo"] == "boolean" else F.col("tp_sexo")
    out["tp_sexo"] = label_map(sex, CATEGORY_LABELS["tp_sexo"], fallback="tp_sexo")
    out["nm_categoria"] = F.replace(F.col("nm_categoria"), F.lit(LONG_NAME), F.lit(SHORT_NAME))
    out["duracao_ideal_anos"] = to_double("duracao_ideal_anos")
    out["pib_log"] = F.log1p("pib")
    out["Tipo IES"] = F.upper("tipo_ies")
    return study.withColumns(out)


def compare_groups(study: DataFrame, target: str = TARGET) -> dict[str, DataFrame]:
    """The descriptive report: overall test, test per category, means per category, means along numeric bins."""
    rows, sides = labelled(study), ("PUBLICA", "PRIVADA")
    return {
        "overall": mann_whitney(rows, target, "Tipo IES", sides),
        "tests": comparison_report(category_tests(rows, COMPARED, target, "Tipo IES", sides)),
        "means": category_means(rows, COMPARED, target, "Tipo IES"),
        "bins": bin_means(rows, BINNED, target, "Tipo IES"),
    }
