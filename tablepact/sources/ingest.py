"""Turn what user code returned into a DataFrame."""

from __future__ import annotations

from functools import singledispatch
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tablepact.errors import ScriptError


@singledispatch
def _arrow(result: Any) -> pa.Table:
    """The result as an Arrow table; further kinds may be registered."""
    if not hasattr(result, "__arrow_c_stream__"):
        raise ScriptError(
            f"run() returned {type(result).__name__}; expected a dataframe of Spark, Arrow, "
            "pandas or an Arrow stream"
        )
    return pa.table(result)


_arrow.register(pa.Table, lambda result: result)
_arrow.register(pd.DataFrame, lambda result: pa.Table.from_pandas(result, preserve_index=False))


def to_dataframe(spark: SparkSession, result: Any) -> DataFrame:
    """A frame of Spark stays lazy; others are in this process already and are sent out."""
    return result if isinstance(result, DataFrame) else spark.createDataFrame(_arrow(result))
