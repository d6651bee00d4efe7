"""Which column plays which part in a study."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, types as T


@dataclass(frozen=True)
class ColumnRoles:
    """Explicit roles, so nothing downstream has to guess from a column's type."""

    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    target: str | None = None
    keys: tuple[str, ...] = field(default=())

    def __post_init__(self):
        for name in ("numeric", "categorical", "keys"):
            object.__setattr__(self, name, tuple(getattr(self, name)))

    @property
    def features(self) -> tuple[str, ...]:
        return self.numeric + self.categorical

    def without(self, *columns: str) -> ColumnRoles:
        return replace(
            self,
            numeric=tuple(c for c in self.numeric if c not in columns),
            categorical=tuple(c for c in self.categorical if c not in columns),
        )

    @classmethod
    def from_schema(
        cls,
        df: DataFrame,
        forced_categorical: tuple[str, ...] = (),
        exclude: tuple[str, ...] = (),
        target: str | None = None,
    ) -> ColumnRoles:
        """Numbers and booleans are numeric, text is categorical; ``forced_categorical`` wins."""
        numeric, categorical = [], []
        for f in df.schema.fields:
            if f.name in exclude or f.name == target:
                continue
            if f.name in forced_categorical or isinstance(f.dataType, T.StringType):
                categorical.append(f.name)
            elif isinstance(f.dataType, (T.NumericType, T.BooleanType)):
                numeric.append(f.name)
        return cls(tuple(numeric), tuple(categorical), target)
