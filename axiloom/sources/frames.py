"""Relations as sources of values: a column of any DataFrame bound to an index, keyed by axes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axiloom.axes import Axis


@dataclass
class AxisTable:
    """One axis as rows: its key, for an ensemble a weight, and columns of values by node id."""

    axis: Axis
    df: DataFrame
    columns: dict[int, str]
    kinds: dict[int, str]
    weight: str | None = None


@dataclass
class BoundFrame:
    """``df[value]`` as the value of an index; ``keys`` names the column that holds the position on each axis."""

    df: DataFrame
    keys: dict[Axis, str]
    value: str = "value"

    def select(self, name: str) -> DataFrame:
        return self.df.select(*[F.col(c).alias(a.key) for a, c in self.keys.items()], F.col(self.value).alias(name))


def hashed_uniform(seed: int, name: str, ident: Column) -> Column:
    """A number in (0, 1) that depends on seed, name and ident alone, however the rows are partitioned."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), F.lit(name), ident.cast("long")), 11)
    return (bits.cast("double") + 0.5) * float(2.0**-53)


def value_kind(values: np.ndarray) -> str:
    return {"b": "bool", "i": "int", "u": "int", "f": "float"}.get(np.asarray(values).dtype.kind, "str")


def plain(value):
    """A NumPy scalar as a Python one."""
    return value.item() if isinstance(value, np.generic) else value


_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
SPARK_TYPE = {"bool": "boolean", "int": "bigint", "float": "double", "str": "string"}


def array_table(spark: SparkSession, key: str, columns: dict[str, np.ndarray]) -> DataFrame:
    """(key, columns): the position and one column for each array."""
    kinds = {c: value_kind(v) for c, v in columns.items()}
    n = len(next(iter(columns.values())))
    lists = {c: (SPARK_TYPE[kinds[c]], [plain(x) if kinds[c] != "str" else str(x) for x in v]) for c, v in columns.items()}
    return local_frame(spark, {key: ("int", list(range(n))), **lists})


def local_frame(spark: SparkSession, columns: dict[str, tuple[str, list]]) -> DataFrame:
    """A DataFrame of driver values, {name: (type, values)}. It goes by Arrow into the plan itself, so that its size is
    known and the planner decides by that whether to broadcast it."""
    arrow = pa.table({c: pa.array(v, _ARROW[t]) for c, (t, v) in columns.items()})
    return spark.createDataFrame(arrow, ", ".join(f"`{c}` {t}" for c, (t, _) in columns.items()))
