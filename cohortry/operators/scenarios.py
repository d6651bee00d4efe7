"""Scenario grids and policy what-ifs: one ``transform`` over a tagged frame per model."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import Column, DataFrame, functions as F

from cohortry.functions.columns import code_text, label_map, status_strict
from cohortry.operators.aggregates import count_by, mean_with_interval
from cohortry.operators.reshape import expand_values, stack, value_grid

# The profile of the published scenario study.
SCENARIO_LABELS = {
    "tp_cor_raca": {0: "Não declarado", 1: "Branca", 2: "Preta", 3: "Parda", 4: "Amarela", 5: "Indígena"},
    "tp_sexo": {1: "Masculino", 2: "Feminino"},
    "tp_escola_conclusao_ens_medio": {1: "Privada", 2: "Pública"},
    "tp_modalidade_ensino": {1: "Presencial", 2: "EAD"},
    "in_financiamento_estudantil": {0: "Não", 1: "Sim"},
    "in_apoio_social": {0: "Não", 1: "Sim"},
}
SCENARIO_TITLES = {
    "tp_cor_raca": "Cor/Raça",
    "tp_sexo": "Sexo",
    "tp_escola_conclusao_ens_medio": "Escola Média",
    "tp_modalidade_ensino": "Modalidade",
    "in_financiamento_estudantil": "Financiamento",
    "in_apoio_social": "Apoio Social",
}
SCENARIO_BANDS = {1: 0.5, 3: 2.5, 5: 4.5}
SCENARIO_GROUP_CODES = {"publica": 1, "privada": 5}
SCENARIO_DEFAULTS = {
    "faixa_etaria": 3.0,
    "tp_grau_academico": 1.0,
    "nu_carga_horaria": 3000,
    "duracao_ideal_anos": 4.0,
    "pib": 500000000,
    "inscritos_por_vaga": 5.0,
    "sigla_uf_curso": "SP",
    "nm_categoria": "Direito",
    "no_regiao_ies": "Sudeste",
    "nu_ano_censo": 2019,
}


def scenario_grid(
    spark,
    values: Mapping[str, Sequence],
    band: tuple[str, str, Mapping] | None = None,
    clusters: Sequence[int] = (),
    defaults: Mapping[str, object] = {},
) -> DataFrame:
    """Every combination of the values, bands and clusters, with defaults for the other model inputs.

    ``band`` is (band column, value column, {band: value}).
    """
    lists = dict(values)
    if band:
        lists[band[0]] = list(band[2])
    if clusters:
        lists["cluster"] = list(clusters)
    grid = value_grid(spark, lists)
    if band:
        name, target, table = band
        grid = grid.withColumn(target, label_map(name, table).cast("double"))
    return grid.withColumns({c: F.lit(v) for c, v in defaults.items()})


def unknown_categories(df: DataFrame, stages: PipelineModel, columns: Sequence[str]) -> DataFrame:
    """(feature, category, n_rows) of categories the fitted encoder has never seen; they would score as all zeros."""
    known = {}
    for stage in stages.stages:
        if isinstance(stage, StringIndexerModel):
            known |= {c.removesuffix("__text"): list(labels) for c, labels in zip(stage.getInputCols(), stage.labelsArray)}
    parts = [
        df.select(F.lit(c).alias("feature"), code_text(c).alias("category")).filter(~F.col("category").isin(known[c]))
        for c in columns
    ]
    return stack(parts).groupBy("feature", "category").agg(F.count(F.lit(1)).alias("n_rows"))


def score_scenarios(
    grid: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    ideal: Column | str,
    group: str,
    prediction_is_ratio: bool = True,
) -> DataFrame:
    """Grid rows with predicted ratio, years (two digits) and status; a predicted ratio is turned into years first."""
    ideal = F.col(ideal) if isinstance(ideal, str) else ideal
    years = F.col("prediction") * ideal if prediction_is_ratio else F.col("prediction")
    return score(grid).withColumns(
        {"grupo": F.lit(group), "previsao_anos": F.round(years, 2), "status": status_strict(years - ideal)}
    )


def scenarios_by_group(
    spark,
    values: Mapping[str, Sequence],
    scorers: Mapping[str, Callable[[DataFrame], DataFrame]],
    ideal: Column | str,
    code: str,
    codes: Mapping[str, object] = SCENARIO_GROUP_CODES,
    band: tuple[str, str, Mapping] | None = None,
    clusters: Mapping[str, Sequence[int]] = {},
    defaults: Mapping[str, object] = {},
    prediction_is_ratio: bool = True,
) -> DataFrame:
    """The grid of every group, with the group's code and its own clusters, scored by the group's own model, stacked."""
    parts = []
    for group, score in scorers.items():
        grid = scenario_grid(spark, values, band, clusters.get(group, ()), {**defaults, code: codes[group]})
        parts.append(score_scenarios(grid, score, ideal, group, prediction_is_ratio))
    return stack(parts)


def scenario_report(scored: DataFrame, labels: Mapping[str, Mapping] = SCENARIO_LABELS, titles: Mapping[str, str] = SCENARIO_TITLES, band: str = "faixa") -> DataFrame:
    """The published column names."""
    return scored.select(
        F.upper("grupo").alias("Tipo IES"),
        *[label_map(c, labels[c]).alias(titles[c]) for c in labels],
        F.col(band).alias("Faixa IGC"),
        F.col("previsao_anos").alias("Previsão (anos)"),
        F.col("prediction").alias("Taxa Prevista"),
        F.col("status").alias("Status Conclusão"),
    )


def status_by_group(report: DataFrame, status: str = "status", group: str = "grupo") -> DataFrame:
    return count_by(report, [status, group])


def impact_by_feature(scored: DataFrame, features: Sequence[str], value: str = "previsao_anos", group: str = "grupo") -> DataFrame:
    """(feature, category, group, n, mean, low, high): mean prediction per feature value and group."""
    wide = scored.select(F.col(group), F.col(value), *[code_text(f).alias(f) for f in features])
    long = wide.unpivot([group, value], list(features), "feature", "category")
    return mean_with_interval(long, value, ["feature", "category", group])


def what_if_rows(df: DataFrame, policies: Mapping[str, Mapping[str, object]], name: str = "cenario") -> DataFrame:
    """Each row once per policy, with that policy's constants written over its columns."""
    tagged = expand_values(df, {name: list(policies)})
    changed = {}
    for policy, values in policies.items():
        for column, value in values.items():
            current = changed.get(column, F.col(column))
            changed[column] = F.when(F.col(name) == policy, F.lit(value).cast(df.schema[column].dataType)).otherwise(current)
    return tagged.withColumns(changed) if changed else tagged


# The two policies of the published study, after the unchanged baseline.
POLICIES = {
    "Base": {},
    "Apoio_Universal": {"in_apoio_social": 1.0},
    "Financ_Universal": {"in_financiamento_estudantil": 1.0},
}


def policy_means(df: DataFrame, score: Callable[[DataFrame], DataFrame], policies: Mapping[str, Mapping], group: str) -> DataFrame:
    """(Instituicao, one mean prediction per policy) in one pass over the rows."""
    scored = score(what_if_rows(df, policies))
    return scored.groupBy().agg(
        *[F.avg(F.when(F.col("cenario") == p, F.col("prediction"))).alias(p) for p in policies]
    ).select(F.lit(group).alias("Instituicao"), *policies)


def with_deltas(summary: DataFrame, policies: Sequence[str], base: str = "Base") -> DataFrame:
    """``Delta_<policy>``: difference of a policy's mean from the baseline."""
    return summary.withColumns({f"Delta_{p.split('_')[0]}": F.col(p) - F.col(base) for p in policies if p != base})
