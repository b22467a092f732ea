"""Feature vectors: assembly, scaling, and the map from columns to vector slots."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Normalizer, StandardScaler, StandardScalerModel, VectorAssembler, VectorSlicer
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame

from tabloom.functions.columns import ref

FEATURES = "features"
NORMALIZED = "normFeatures"
STANDARDIZED = "scaledFeatures"
SELECTED = "selectedFeatures"
INDEXED = "indexedFeatures"


@dataclass(frozen=True)
class SlotMap:
    """Which slots of the assembled vector belong to which feature column."""

    columns: tuple[str, ...]
    sizes: tuple[int, ...]

    @property
    def width(self) -> int:
        return sum(self.sizes)

    def slots(self, column: str) -> range:
        i = self.columns.index(column)
        start = sum(self.sizes[:i])
        return range(start, start + self.sizes[i])

    def slots_of(self, columns: Sequence[str]) -> list[int]:
        """All slots of the columns, in vector order."""
        wanted = set(columns)
        return [s for c in self.columns if c in wanted for s in self.slots(c)]


def slot_map(df: DataFrame, columns: Sequence[str]) -> SlotMap:
    """Slot sizes from the column metadata; vectors without it are measured on one row."""
    fields = {f.name: f for f in df.schema.fields}
    sizes: dict[str, int] = {}
    for c in columns:
        if not isinstance(fields[c].dataType, VectorUDT):
            sizes[c] = 1
            continue
        attributes = fields[c].metadata.get("ml_attr", {})
        known = attributes.get("num_attrs") or sum(len(v) for v in attributes.get("attrs", {}).values())
        if known:
            sizes[c] = known
    unknown = [c for c in columns if c not in sizes]
    if unknown:
        row = df.select([ref(c) for c in unknown]).first()
        if row is None:
            raise ValueError("no rows to measure a vector on")
        sizes.update({c: row[c].size for c in unknown})
    return SlotMap(tuple(columns), tuple(sizes[c] for c in columns))


def assembler(columns: Sequence[str], output: str = FEATURES, invalid: str = "error") -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol=output, handleInvalid=invalid)


def normalizer(features: str = FEATURES, output: str = NORMALIZED, p: float = 1.0) -> Normalizer:
    return Normalizer(inputCol=features, outputCol=output, p=p)


def standardizer(df: DataFrame, features: str = FEATURES, output: str = STANDARDIZED) -> StandardScalerModel:
    """Unit sample deviation, not centred, so sparse vectors stay sparse."""
    return StandardScaler(inputCol=features, outputCol=output, withStd=True, withMean=False).fit(df)


def slicer(slots: Sequence[int], features: str = FEATURES, output: str = SELECTED) -> VectorSlicer:
    if not slots:
        raise ValueError("a feature subset needs at least one slot")
    return VectorSlicer(inputCol=features, outputCol=output, indices=list(slots))
