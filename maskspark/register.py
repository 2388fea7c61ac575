"""SQL functions and table functions: register(spark) makes them known to a session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from maskspark.config import MaskConfig
from maskspark.functions.masking import Session
from maskspark.operators import documents


def register(spark: SparkSession, cfg: MaskConfig = MaskConfig()) -> None:
    """mask_text(text) and find_sensitive(text), each text a session of its own, and docx_texts(content) of Word files."""

    @F.pandas_udf("string")
    def mask_text(texts: pd.Series) -> pd.Series:
        own = documents.masker(cfg)
        return pd.Series([documents.mask_cell(t, own, Session())[0] for t in texts], dtype=object)

    @F.pandas_udf("array<struct<cat:string,value:string,placeholder:string>>")
    def find_sensitive(texts: pd.Series) -> pd.Series:
        own = documents.masker(cfg)
        return pd.Series([[dict(zip(("cat", "value", "placeholder"), h)) for h in documents.mask_cell(t, own, Session())[1]] for t in texts], dtype=object)

    class DocxTexts:
        def eval(self, content: bytes) -> Iterator[tuple]:
            from maskspark.sources.docx import nodes

            if content is not None:
                try:
                    yield from nodes(bytes(content))
                except Exception:  # what is no Word file has no texts
                    return

    spark.udf.register("mask_text", mask_text)
    spark.udf.register("find_sensitive", find_sensitive)
    spark.udtf.register("docx_texts", F.udtf(DocxTexts, returnType="part string, paragraph int, node int, text string"))


def observed(masked: DataFrame, observation: Observation) -> DataFrame:
    """`masked` (of mask_documents or mask_sessions), counting as it runs: rows, changed and refused ones, values by then masked."""
    values = F.sum(F.aggregate(F.map_values("mask_counts"), F.lit(0).cast("long"), lambda a, b: a + b))
    return masked.observe(
        observation, F.count(F.lit(1)).alias("rows"), F.count_if("mask_changed").alias("changed"), F.count_if(F.col("mask_error").isNotNull()).alias("refused"),
        F.coalesce(values, F.lit(0)).alias("values"),
    )
