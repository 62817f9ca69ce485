"""Rows that go through Python beside their texts, each text only once.

A batch that held a text as such and again inside its row would take twice the memory, in the executor's JVM as
well as in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def split(docs: DataFrame, text: str, kept: str) -> tuple[Column, Column]:
    """A column ``row`` without the text, and the whole row again, from that and the text as it is in a column ``kept``.

    A text of another type stays in its row, and so does one that is the only column.
    """
    apart = len(docs.columns) > 1 and docs.columns.count(text) == 1 and docs.schema[text].dataType == StringType()
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if not (apart and c == text)]).alias("row")
    if not apart:
        return rest, F.col("row")
    return rest, F.struct(*[F.col(kept).alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns]).alias("row")
