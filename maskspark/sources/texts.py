"""Plain text files: a file is one cell."""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskspark.config import MaskConfig
from maskspark.operators.documents import mask_documents
from maskspark.operators.restoring import categories


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files, line ends as they are."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def redacted_name(path: str) -> str:
    """Where the masked file of a path goes: never the file itself."""
    stem, ending = os.path.splitext(path)
    return f"{stem}.redacted{ending}"


def mask_files(spark: SparkSession, path: str, cfg: MaskConfig = MaskConfig()) -> DataFrame:
    """(path, out_path, text, and what mask_documents adds)."""
    files = mask_documents(read(spark, path), cfg=cfg)
    return files.withColumn("out_path", F.regexp_replace("path", r"^(.*?)(\.[^./]*)?$", "$1.redacted$2"))


def report(masked: DataFrame) -> DataFrame:
    """(cat, n) of all placeholders in the texts, those that were there before included."""
    return masked.select(F.explode(categories(F.col("text"))).alias("cat")).groupBy("cat").agg(F.count("*").alias("n"))


def file_report(masked: DataFrame) -> DataFrame:
    """A row a file of mask_files(): path, out_path, counts by category, n in all, error, and at_risk.

    At risk is a file that was refused, or whose text holds more placeholders than were put there: some stood in it before.
    """
    n = F.aggregate(F.map_values(F.coalesce("mask_counts", F.create_map().cast("map<string,int>"))), F.lit(0), lambda a, b: a + b)
    at_risk = F.col("mask_error").isNotNull() | F.coalesce(F.size(categories(F.col("text"))) > n, F.lit(False))
    return masked.select("path", "out_path", F.col("mask_counts").alias("counts"), n.alias("n"), F.col("mask_error").alias("error"), at_risk.alias("at_risk"))


def preview(df: DataFrame, text_col: str = "text", cfg: MaskConfig = MaskConfig()) -> DataFrame:
    """df with masked and restored beside the text, and the counts."""
    from maskspark.operators.documents import mask_column
    from maskspark.operators.names import unused
    from maskspark.operators.restoring import restored

    name = unused(df, "preview")
    wide = df.withColumn(name, mask_column(F.col(f"`{text_col}`"), cfg))
    pairs = F.map_from_entries(F.array_distinct(F.transform(f"{name}.found", lambda x: F.struct(x["placeholder"], x["value"]))))
    return (
        wide.withColumn("masked", F.col(f"{name}.text")).withColumn("mask_counts", F.col(f"{name}.counts"))
        .withColumn("mask_changed", F.coalesce(f"{name}.changed", F.lit(False))).withColumn("mask_error", F.col(f"{name}.error"))
        .withColumn("restored", restored(F.col("masked"), pairs)).drop(name)
    )


def write(masked: DataFrame) -> DataFrame:
    """(path, out_path, written, error) of masked files, each written beside its input; a path that is there is left alone.

    Runs where rows are: for folders that all executors share. Through other stores write `text` with a Spark writer.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, out, text in zip(pdf["path"], pdf["out_path"], pdf["text"]):
                try:
                    if text is None:
                        raise ValueError("refused")
                    with open(unquote(urlsplit(out).path), "x", encoding="utf-8", newline="") as f:  # never over a file
                        f.write(text)
                    rows.append((path, out, True, None))
                except (OSError, ValueError) as e:
                    rows.append((path, out, False, type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "out_path", "written", "error"])

    return masked.select("path", "out_path", "text").mapInPandas(run, "path string, out_path string, written boolean, error string")
