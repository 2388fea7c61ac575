"""Masking and detection of text columns where each row is a session of its own. No shuffle."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskspark.config import MaskConfig
from maskspark.functions import rules
from maskspark.functions.masking import Masker, Session, TooLong, counts
from maskspark.operators.names import unused

_maskers: dict[MaskConfig, Masker] = {}


def masker(cfg: MaskConfig) -> Masker:
    """One a worker and configuration."""
    if cfg not in _maskers:
        _maskers[cfg] = Masker(cfg)
    return _maskers[cfg]


ENTITY = T.StructType([
    T.StructField("ord", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in ("cat", "value", "placeholder", "error")],
])
MASKED = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("counts", T.MapType(T.StringType(), T.IntegerType())),
    T.StructField("changed", T.BooleanType()), T.StructField("error", T.StringType()), T.StructField("found", T.ArrayType(ENTITY)),
])


def mask_column(text: Column, cfg: MaskConfig = MaskConfig()) -> Column:
    """Struct of the masked text, occurrences by category, whether it changed, why a text was refused, and what was found.

    A refused text is null under cfg.fail_closed, and stays as it is otherwise.
    """

    @F.pandas_udf(MASKED)
    def run(texts: pd.Series) -> pd.DataFrame:
        own, rows = masker(cfg), []
        for t in texts:
            out, hits, error = mask_cell(t, own, Session())
            found = [{"ord": i, "cat": c, "value": v, "placeholder": p, "error": None} for i, (c, v, p) in enumerate(hits)]
            rows.append((out, counts(hits), out != t, error, found))
        return pd.DataFrame(rows, columns=["text", "counts", "changed", "error", "found"])

    return run(text.cast("string"))


def mask_cell(text: str | None, own: Masker, session: Session) -> tuple[str | None, list, str | None]:
    """The text masked, what was found in it, and why it was refused: numbers that it used until then stay used."""
    hits: list = []
    try:
        return own.mask(text, session, hits) if text else text, hits, None
    except TooLong as e:
        return None if own.cfg.fail_closed else text, [], f"TOO_LONG: {e}"


def mask_documents(df: DataFrame, text_col: str = "text", cfg: MaskConfig = MaskConfig(), out_col: str | None = None) -> DataFrame:
    """df with the text masked (into out_col, else in place), and mask_counts, mask_changed, mask_error.

    Null and empty texts stay. With cfg.enabled off the texts stay as they are. Columns of these three names are replaced.
    """
    name = unused(df, "masked")
    done = df.withColumn(name, mask_column(F.col(f"`{text_col}`"), cfg))
    return (
        done.withColumn(out_col or text_col, F.col(f"{name}.text")).withColumn("mask_counts", F.col(f"{name}.counts"))
        .withColumn("mask_changed", F.coalesce(f"{name}.changed", F.lit(False))).withColumn("mask_error", F.col(f"{name}.error")).drop(name)
    )


def entities_column(text: Column, cfg: MaskConfig = MaskConfig()) -> Column:
    """What masking would replace, in the order of its numbers; of a refused text one entry without a value, with its error."""

    @F.pandas_udf(T.ArrayType(ENTITY))
    def run(texts: pd.Series) -> pd.Series:
        own, rows = masker(cfg), []
        for t in texts:
            _, hits, error = mask_cell(t, own, Session())
            found = [(c, v, p, None) for c, v, p in hits] if error is None else [(None, None, None, error)]
            rows.append([dict(zip(ENTITY.names, (i, *x))) for i, x in enumerate(found)])
        return pd.Series(rows)

    return run(text.cast("string"))


def union_cells(*sources: DataFrame) -> DataFrame:
    """Cells of several sources as one table, by name; a column that a source lacks is null there."""
    out, *rest = sources
    for df in rest:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def detect_entities(df: DataFrame, text_col: str = "text", cfg: MaskConfig = MaskConfig()) -> DataFrame:
    """A row an occurrence: the other columns of df, and ord, cat, value, placeholder, error.

    A text that is refused gives one row with its error and nulls; null and empty texts give none. Columns of df that have
    one of these names are left out.
    """
    name = unused(df, "found")
    found = df.withColumn(name, F.explode(entities_column(F.col(f"`{text_col}`"), cfg)))
    return found.select(*[F.col(f"`{c}`") for c in df.columns if c != text_col and c not in ENTITY.names], f"{name}.*")


# ---- single rules, without Python ---------------------------------------------------------------------------------

_WORD = "[A-Za-z0-9_]"
_EDGE = re.compile(r"\\b")


def java_pattern(rule: rules.Rule) -> str:
    """A rule's pattern in the dialect of the JVM, where word boundaries and digits are not ASCII by themselves."""
    out, at = "", 0
    for m in _EDGE.finditer(rule.pattern):
        before, after = rule.pattern[: m.start()], rule.pattern[m.end() :]
        # at the ends of a pattern or of an alternative, what is beside it tells which side of the border the word is on
        if not before or before[-1] in "(|" or before.endswith("(?i)"):
            edge = f"(?<!{_WORD})(?={_WORD})"
        elif not after or after[0] in ")|":
            edge = f"(?<={_WORD})(?!{_WORD})"
        else:
            edge = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"
        out += rule.pattern[at : m.start()] + edge
        at = m.end()
    return out + rule.pattern[at:]


def find_all(text: Column, rule: rules.Rule, group: int = 0) -> Column:
    """All values of one rule, alone, without its check."""
    return F.regexp_extract_all(text, F.lit(java_pattern(rule)), group)


def replace_all(text: Column, rule: rules.Rule, by: str) -> Column:
    """The text with whole matches of one rule replaced by a constant."""
    return F.regexp_replace(text, java_pattern(rule), by.replace("\\", "\\\\").replace("$", "\\$"))


def longest_run(text: Column) -> Column:
    """Length of the longest run of ASCII characters without white space."""
    runs = F.regexp_extract_all(text, F.lit(r"[\x00-\x7f&&[^ \t\n\r\f]]+"), 0)
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))
