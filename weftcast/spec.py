"""Panel description shared by every operator.

A panel is a long DataFrame: one row per (entity, period), predictor columns,
a target, and a ``split`` tag (``train`` rows carry a target, ``test`` rows do
not).  The reference's per-city dictionaries of frames become one DataFrame
partitioned by ``entity``.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql.types import NumericType


@dataclass(frozen=True)
class PanelSpec:
    entity: str = "entity"
    period: str = "period"
    target: str = "target"
    split: str = "split"
    extra_keys: tuple = ()
    # columns never treated as predictors besides keys/target/split
    reserved: tuple = field(default_factory=tuple)

    @property
    def keys(self) -> list[str]:
        return [self.entity, self.period, *self.extra_keys]

    def non_features(self) -> set[str]:
        return set(self.keys) | {self.target, self.split} | set(self.reserved)

    def with_(self, **kw) -> "PanelSpec":
        return replace(self, **kw)


def feature_columns(df: DataFrame, spec: PanelSpec) -> list[str]:
    """Predictors = every column that is not a key, the target or the split tag."""
    skip = spec.non_features()
    return [c for c in df.columns if c not in skip]


def numeric_columns(df: DataFrame, cols: list[str] | None = None) -> list[str]:
    """Numeric columns only (the reference's ``select_dtypes(number)``)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = cols if cols is not None else df.columns
    return [c for c in cols if isinstance(types[c], NumericType)]
