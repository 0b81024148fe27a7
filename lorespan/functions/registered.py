"""Functions under SQL names: a table function that splits texts, and the text functions as SQL functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lorespan.sources.split import Splitter


class SplitText:
    """split_text(text): ordinal, title, content of a text's parts by its headings."""

    def __init__(self) -> None:
        self.by = Splitter()

    def eval(self, text: str | None) -> Iterator[tuple[int, str, str]]:
        for n, (title, content) in enumerate(self.by.split(text)):
            yield n, title, content


def register(spark: SparkSession, tools: dict[str, tuple] | None = None) -> None:
    """Make split_text known to SQL, and tools by name: (function over Series, result type), called by Arrow batches. A tool is
    a function of the caller's program; stored source texts are never compiled."""
    spark.udtf.register("split_text", F.udtf(SplitText, returnType="ordinal int, title string, content string"))
    for name, (function, result) in (tools or {}).items():
        spark.udf.register(name, _vectorised(function, result))


def _vectorised(function, result: str):
    @F.pandas_udf(result)
    def tool(a: pd.Series) -> pd.Series:
        return function(a)

    return tool
