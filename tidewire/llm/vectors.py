"""Reading embedding columns in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Whether an array of numbers is neither null nor holds null, NaN or infinite entries."""
    finite = lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False))  # noqa: E731  NaN counts as larger than all
    return F.col(vector).isNotNull() & F.forall(vector, finite)


def matrix(column: pa.Array, width: int, dtype: type = np.float64) -> np.ndarray:
    """The rows of an Arrow list column whose lists all have `width` entries and no nulls."""
    values = column.flatten()  # of this slice only
    return np.asarray(pc.cast(values, pa.from_numpy_dtype(dtype)).to_numpy(zero_copy_only=False), dtype=dtype).reshape(len(column), width)


def common_width(df: DataFrame, vector: str) -> int:
    """The number of entries that most vectors have; of equally frequent numbers the larger. 0 if there is no vector with an entry."""
    sizes = df.where(usable(vector) & (F.size(vector) > 0)).groupBy(F.size(vector).alias("width")).count()
    most = sizes.orderBy(F.desc("count"), F.desc("width")).first()
    return most["width"] if most else 0
