"""Helpers shared by the query plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import rnd
from pyspark.sql.types import DoubleType, FloatType


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every floating column (both sides of an oracle check round the same way)."""
    return df.select(*[
        rnd(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType))
        else F.col(f.name) for f in df.schema.fields])


LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_TXT = ["l_returnflag", "l_linestatus"]
LINEITEM_ALL = LINEITEM_NUM + LINEITEM_TXT + ["l_shipdate"]
