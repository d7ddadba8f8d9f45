"""Steps of one item at a time whose errors cost that item only."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from refrain.session import Scratch


def isolated(df: DataFrame, key: str, each: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, failed): what ``each`` makes of the items of ``df``, and key and error of the items for which it raised.

    An item that raises leaves none of its rows; the others' are whole. Both results are read from one written table, so
    that no item is tried twice. schema: that of the rows, the key among them.
    """
    columns = StructType.fromDDL(schema).names

    def tried(rows: pd.DataFrame) -> pd.DataFrame:
        try:
            return each(rows)[columns].assign(error=None)
        except Exception as e:
            return pd.DataFrame([{**dict.fromkeys(columns), key: rows[key].iloc[0], "error": f"{type(e).__name__}: {e}"}])

    out = Scratch(df.sparkSession, "isolated").save(df.groupBy(key).applyInPandas(tried, f"{schema}, error string"), "tried")
    return out.where("error is null").drop("error"), out.where("error is not null").select(key, F.col("error"))
