"""The functions for SQL text: `register(spark)` makes them callable by name.

JVM-side expressions are registered as SQL functions of their text form; what needs Python is registered as Arrow-batched
UDFs, and the layout as a table function.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import kernels as K
from .text import TAIL_PUNCT, WS

#: SQL functions of one expression each (temporary, for the session); cw_strip takes ASCII white space.
EXPRESSIONS = {
    "cw_strip(t STRING) RETURNS STRING": r"regexp_replace(t, '^\\s+|\\s+$', '')",
    "cw_timecode(ms BIGINT) RETURNS STRING": "printf('%02d:%02d:%02d,%03d', greatest(ms, 0) div 3600000, greatest(ms, 0) div 60000 % 60, greatest(ms, 0) div 1000 % 60, greatest(ms, 0) % 1000)",
    "cw_reading_chars(t STRING) RETURNS BIGINT": f"length(regexp_replace(t, r'{WS}', ''))",
    "cw_repair_form(t STRING) RETURNS STRING": f"lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, r'^{WS}+|{WS}+$', ''), r'{WS}*-{WS}*', '-'), r'{WS}+', ' '), r'{TAIL_PUNCT}', ''), r'^{WS}+|{WS}+$', ''))",
    "cw_overlap_ms(a0 BIGINT, a1 BIGINT, b0 BIGINT, b1 BIGINT) RETURNS BIGINT": "greatest(0, least(a1, b1) - greatest(a0, b0))",
}


@F.pandas_udf(T.StringType())
def dedupe_form(t: pd.Series) -> pd.Series:
    """The form in which near duplicates are compared."""
    return t.map(K.dedupe_form, na_action="ignore")


@F.pandas_udf(T.DoubleType())
def text_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks; a null is an empty text."""
    return pd.Series([K.similarity(x or "", y or "") for x, y in zip(a, b)])


@F.pandas_udf(T.StringType())
def wrap_zh(t: pd.Series) -> pd.Series:
    """Chinese lines of at most 18 characters, in two lines."""
    return t.map(K.wrap_zh, na_action="ignore")


@F.udtf(returnType="part INT, start_ms BIGINT, end_ms BIGINT, text STRING")
class ZhLayout:
    """The cues that a segment is laid out in."""

    def eval(self, start_ms: int, end_ms: int, text: str):  # noqa: ANN201, D102
        if start_ms is not None and end_ms is not None and text is not None:
            for _, part, a, b, t in K.layout_zh(iter([(0, start_ms, end_ms, text, None)])):
                yield part, a, b, t


def register(spark: SparkSession) -> list[str]:
    """Registers all functions; returns their names."""
    names = []
    for head, body in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
        names.append(head.split("(")[0])
    for f in (dedupe_form, text_similarity, wrap_zh):
        name = f"cw_{f.__name__}"
        spark.udf.register(name, f)
        names.append(name)
    spark.udtf.register("cw_zh_layout", ZhLayout)
    return [*names, "cw_zh_layout"]
