"""Masking where many rows share a session and its numbers.

Rows are dealt by session and sorted by their order; each partition is read as a stream, holding the numbers of one
session at a time and no more rows than a batch. Sessions are many and bounded by the 2000 values a category keeps;
a very long session is one stream, as its numbers depend on all rows before.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskspark.config import MaskConfig
from maskspark.functions.masking import Session, counts
from maskspark.operators.documents import mask_cell, masker
from maskspark.operators.names import fields, unused

DEFAULT_SESSION = "__default__"


def dealt(df: DataFrame, session_col: str, order_cols: list[str]) -> tuple[DataFrame, str]:
    """df dealt by session and sorted by its order, and the column that names the session.

    Rows without a session are one session, as its numbers go on from row to row; give them keys of their own where there are many.
    """
    key = unused(df, "session_key")
    keyed = df.withColumn(key, F.coalesce(F.col(f"`{session_col}`").cast("string"), F.lit(DEFAULT_SESSION)))
    return keyed.repartition(key).sortWithinPartitions(key, *[F.col(f"`{c}`") for c in order_cols]), key


def mask_sessions(df: DataFrame, session_col: str, order_cols: list[str], text_col: str = "text", cfg: MaskConfig = MaskConfig()) -> DataFrame:
    """df with texts masked in place, and mask_counts, mask_changed, mask_error.

    A null session is one session of its own. Without cfg.persist_mapping each row numbers afresh. Columns of these three
    names are replaced.
    """
    added = ("mask_counts", "mask_changed", "mask_error")
    schema = fields(df, added)
    names = [c for c in df.columns if c not in added]
    rows, key_col = dealt(df, session_col, order_cols)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, name, session = masker(cfg), None, Session()
        for pdf in batches:
            texts, found, errors = [], [], []
            for key, t in zip(pdf[key_col], pdf[text_col]):
                if key != name or not cfg.persist_mapping:
                    name, session = key, Session()
                out, hits, error = mask_cell(t, own, session)
                texts.append(out)
                found.append(counts(hits))
                errors.append(error)
            before = pdf[text_col].tolist()
            out = pdf[names].copy()
            out[text_col] = texts
            out["mask_counts"], out["mask_changed"], out["mask_error"] = found, [a != b for a, b in zip(before, texts)], errors
            yield out

    return rows.mapInPandas(run, f"{schema}, mask_counts map<string,int>, mask_changed boolean, mask_error string")


MAPPING = "session_id string, cat string, value string, n long, placeholder string"


def session_mapping(df: DataFrame, session_col: str, order_cols: list[str], text_col: str = "text", cfg: MaskConfig = MaskConfig()) -> DataFrame:
    """(session_id, cat, value, n, placeholder): the numbers that masking the session gives, those still kept at its end."""
    sorted_rows, key_col = dealt(df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([session_col, *order_cols, text_col])]), session_col, order_cols)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, name, session = masker(cfg), None, Session()

        def rows() -> pd.DataFrame:
            kept = [(name, cat, v, n, f"[REDACTED_{cat.upper()}_{n}]") for cat, values in session.values.items() for v, n in values.items()]
            return pd.DataFrame(kept, columns=["session_id", "cat", "value", "n", "placeholder"])

        for pdf in batches:
            for key, t in zip(pdf[key_col], pdf[text_col]):
                if key != name:
                    if session.values:
                        yield rows()
                    name, session = key, Session()
                mask_cell(t, own, session)
        if session.values:
            yield rows()

    return sorted_rows.mapInPandas(run, MAPPING)


def number_by_first_place(spans: DataFrame, session_col: str, order_cols: list[str]) -> DataFrame:
    """Spans (session, cat, value, ...) with n and placeholder: numbers by first appearance in each session and category.

    Valid while no session holds more values of a category than are kept. The window sees one row a distinct value.
    """
    from pyspark.sql.window import Window

    keys = [session_col, "cat"]
    first = unused(spans, "first")
    firsts = spans.groupBy(*keys, "value").agg(F.min(F.struct(*order_cols)).alias(first))
    firsts = firsts.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(first)).cast("long")).drop(first)
    firsts = firsts.withColumn("placeholder", F.concat(F.lit("[REDACTED_"), F.upper("cat"), F.lit("_"), F.col("n").cast("string"), F.lit("]")))
    return spans.join(firsts, [*keys, "value"])
