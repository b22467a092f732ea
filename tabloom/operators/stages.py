"""Base for fitted stages that carry a table next to their parameters."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLWritable
from pyspark.sql import SparkSession

from tabloom.operators.keyed import Lookup


class _TableWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        for name, lookup in self.instance.lookups.items():
            lookup.frame.write.parquet(f"{path}/tables/{name}")


class _TableReader(DefaultParamsReader):
    def load(self, path: str):
        model = super().load(path)
        spark = SparkSession.active()
        for name, spec in model.getOrDefault(model.tables).items():
            frame = spark.read.parquet(f"{path}/tables/{name}")
            model.lookups[name] = Lookup(frame, spec["key"], spec["small"], spec["total"])
        return model


class TableModel(Model, MLWritable, MLReadable):
    """A model whose statistics are lookup tables; ``save`` writes them as Parquet."""

    tables = Param(Params._dummy(), "tables", "Key, size class and row total of each lookup table.",
                   TypeConverters.identity)

    def __init__(self) -> None:
        super().__init__()
        self.lookups: dict[str, Lookup] = {}

    def _hold(self, lookups: dict[str, Lookup]) -> None:
        self.lookups = lookups
        self._set(tables={n: {"key": x.key, "small": x.small, "total": x.total} for n, x in lookups.items()})

    def copy(self, extra=None):
        twin = super().copy(extra)
        twin.lookups = self.lookups
        return twin

    def write(self) -> _TableWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> _TableReader:
        return _TableReader(cls)
