"""Column expressions: every one stays inside the JVM and works on batch and streaming frames alike."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

# Labels of the completion status.
STATUS_EARLY = "Evasão Provável"
STATUS_ON_TIME = "Conclusão no Prazo"
STATUS_LATE = "Atraso"
# Significance flags.
FLAG_SIGNIFICANT = "SIGNIFICATIVO"
FLAG_NOT_SIGNIFICANT = "Não sig."


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_nan(c: Column | str) -> Column:
    return F.nanvl(_c(c), F.lit(None).cast("double"))


def number(c: Column | str) -> Column:
    """The column as a double with NaN as missing, for aggregates."""
    return null_if_nan(_c(c).cast("double"))


def difference(a: Column | str, b: Column | str) -> Column:
    return _c(a) - _c(b)


def guarded_ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den``; 0.0 where the denominator is zero, null where it is missing."""
    return F.when(_c(den) == 0, F.lit(0.0)).otherwise(F.try_divide(_c(num), _c(den)))


def round_half_even(c: Column | str, digits: int) -> Column:
    """Scale, round half to even, unscale: the rounding of floating-point array libraries."""
    scale = float(10**digits)
    return F.rint(_c(c) * scale) / scale


def rounded_ratio(num: Column | str, den: Column | str, digits: int = 4) -> Column:
    """``num / den`` rounded; null where the denominator is zero or missing."""
    return round_half_even(F.try_divide(_c(num).cast("double"), _c(den).cast("double")), digits)


def to_double(c: Column | str) -> Column:
    """Number in text or any numeric type; anything else is null, never an error."""
    return null_if_nan(_c(c).try_cast("double"))


def to_long(c: Column | str) -> Column:
    """Integer key; text such as ``"12.0"`` counts, text that is no number is null."""
    text = _c(c).cast("string")
    return F.coalesce(text.try_cast("bigint"), to_double(text).try_cast("bigint"))


def decimal_comma(c: Column | str) -> Column:
    """``"4,5"`` becomes 4.5."""
    return to_double(F.translate(_c(c).cast("string"), ",", "."))


def choose_by_code(code: Column | str, choices: Mapping[object, Column | str], default: Column | None = None) -> Column:
    """The column that belongs to a code; null (or ``default``) for any other code."""
    picked = None
    for value, column in choices.items():
        test = _c(code) == F.lit(value)
        picked = F.when(test, _c(column)) if picked is None else picked.when(test, _c(column))
    return picked.otherwise(default if default is not None else F.lit(None))


def override_when(code: Column | str, value, then: Column | str, otherwise: Column | str) -> Column:
    return F.when(_c(code) == F.lit(value), _c(then)).otherwise(_c(otherwise))


def group_tag(code: Column | str, groups: Mapping[str, Sequence]) -> Column:
    """Name of the group whose code set holds the value; null when none does."""
    tag = None
    for name, codes in groups.items():
        test = _c(code).isin(list(codes))
        tag = F.when(test, F.lit(name)) if tag is None else tag.when(test, F.lit(name))
    return tag


def binary_label(code: Column | str, members: Sequence, yes: str, no: str) -> Column:
    """``yes`` for a member, ``no`` for everything else, missing codes included."""
    return F.when(_c(code).isin(list(members)), F.lit(yes)).otherwise(F.lit(no))


def status_closed_right(diff: Column | str, margin: float = 0.5) -> Column:
    """Bins (-inf, -m], (-m, m], (m, inf]."""
    d = _c(diff)
    return F.when(d <= -margin, STATUS_EARLY).when(d <= margin, STATUS_ON_TIME).when(d > margin, STATUS_LATE)


def status_strict(diff: Column | str, margin: float = 0.5) -> Column:
    """Below -m, above m, and everything between with both edges."""
    d = _c(diff)
    return F.when(d < -margin, STATUS_EARLY).when(d > margin, STATUS_LATE).when(d.isNotNull(), STATUS_ON_TIME)


def label_map(code: Column | str, labels: Mapping, fallback: Column | str | None = None) -> Column:
    """Label of a code; unmapped codes become ``fallback`` (null when there is none)."""
    pairs = [F.lit(x) for item in labels.items() for x in item]
    key = _c(code)
    if all(isinstance(k, (int, float)) for k in labels):
        pairs = [F.lit(float(k)) if i % 2 == 0 else F.lit(k) for i, k in enumerate(x for item in labels.items() for x in item)]
        key = to_double(key)
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if fallback is None else F.coalesce(found, _c(fallback).cast("string"))


def coded_boolean(c: Column | str, true_code: float = 1.0, false_code: float = 2.0) -> Column:
    v = to_double(_c(c).cast("string"))
    return F.when(v == true_code, True).when(v == false_code, False).otherwise(v != 0)


def code_text(c: Column | str) -> Column:
    """One canonical text per category: 1, 1.0, ``"1.0"`` and ``"1.0E0"`` all become ``"1"``.

    Large doubles, which Spark writes with an exponent, are written out (up to 32 digits). The input is named three times
    only, as these expressions are nested in plans.
    """
    text = _c(c).cast("string")
    digits = F.regexp_replace(text.try_cast("decimal(38,6)").cast("string"), r"\.?0+$", "")
    written_out = F.when(text.rlike(r"^-?[0-9]+(\.[0-9]+)?[eE][+]?[0-9]+$"), digits)
    return F.coalesce(written_out, F.regexp_replace(text, r"^(-?[0-9]+)\.0+$", "$1"))


def display_name(c: Column | str) -> Column:
    """Underscores become spaces and every run of letters starts with a capital."""
    spaced = F.translate(_c(c), "_", " ")
    runs = F.regexp_extract_all(spaced, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def base_feature_name(c: Column | str, plain: Sequence[str]) -> Column:
    """Feature behind an encoded ``feature_value`` name; names in ``plain`` are their own base."""
    name = _c(c)
    stem = F.regexp_replace(name, "_[^_]*$", "")
    keep = name.isin(list(plain)) | F.split_part(name, F.lit("_"), F.lit(1)).isin(list(plain)) | (stem == "")
    return F.when(keep, name).otherwise(stem)


def hash_unit(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) fixed by seed and key alone, so it survives any repartitioning."""
    text = F.concat_ws(":", F.lit(str(seed)), *[_c(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_bucket(seed: int, buckets: int, *keys: Column | str) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), *[_c(k).cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % F.lit(buckets)).cast("int")


def significance_flag(p: Column | str, alpha: float = 0.05) -> Column:
    return F.when(_c(p) < alpha, FLAG_SIGNIFICANT).otherwise(FLAG_NOT_SIGNIFICANT)
