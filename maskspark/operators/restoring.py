"""Restoring masked texts from a mapping table. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskspark.operators.names import unused
from maskspark.operators.sessions import DEFAULT_SESSION

PLACEHOLDER = r"\[REDACTED_([A-Z0-9_]+)_[0-9]+\]"


def restored(text: Column, values: Column) -> Column:
    """text with each placeholder that the map `values` knows replaced, in one pass."""
    found = F.regexp_extract_all(text, F.lit(PLACEHOLDER), 0)
    value = lambda p: F.coalesce(F.try_element_at(values, p), p)
    joined = F.array_join(F.transform(F.split(text, PLACEHOLDER, -1), lambda part, i: F.concat(part, F.coalesce(value(F.get(found, i)), F.lit("")))), "")
    return F.when(values.isNotNull() & text.contains("REDACTED_"), joined).otherwise(text)


def misses(text: Column) -> Column:
    """Placeholders (or what looks like one) left in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("REDACTED_")), F.lit(0))


def categories(text: Column) -> Column:
    """Lower-case categories of all placeholders in a text, whoever put them there."""
    return F.transform(F.regexp_extract_all(text, F.lit(PLACEHOLDER), 1), F.lower)


def restore(df: DataFrame, mapping: DataFrame, session_col: str = "session_id", text_col: str = "text") -> DataFrame:
    """df with text restored by the mapping of its session, and restore_misses: what could not be.

    A session's mapping is one row, bounded by the values that a session keeps; sessions that lack one keep their texts. Of
    equal placeholders of a session, which a sound mapping has none of, the least value counts. A column restore_misses that
    is there already is replaced.
    """
    s, values = unused(df, "map_session", "map_values")
    once = mapping.groupBy("session_id", "placeholder").agg(F.min("value").alias("value"))
    maps = once.groupBy(F.col("session_id").alias(s)).agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "value"))).alias(values))
    key = F.coalesce(F.col(f"`{session_col}`").cast("string"), F.lit(DEFAULT_SESSION))
    out = df.join(maps, key == F.col(s), "left").withColumn(text_col, restored(F.col(f"`{text_col}`"), F.col(values))).drop(s, values)
    return out.withColumn("restore_misses", misses(F.col(f"`{text_col}`")))


def missed(text: Column, most: int = 3) -> Column:
    """Up to `most` different placeholders left in a text."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(PLACEHOLDER), 0)), 1, most)


def restore_relational(df: DataFrame, mapping: DataFrame, keys: list[str], session_col: str = "session_id", text_col: str = "text") -> DataFrame:
    """As restore(), with each placeholder joined on its own: for sessions whose mapping is too large for one row.

    `keys` tell the rows of df apart.
    """
    tokens = df.select(*keys, F.coalesce(F.col(session_col).cast("string"), F.lit(DEFAULT_SESSION)).alias("session_id"), F.explode(F.array_distinct(F.regexp_extract_all(text_col, F.lit(PLACEHOLDER), 0))).alias("placeholder"))
    known = tokens.join(mapping.select("session_id", "placeholder", "value"), ["session_id", "placeholder"])
    values = unused(df, "map_values")
    maps = known.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "value"))).alias(values))
    out = df.join(maps, keys, "left").withColumn(text_col, restored(F.col(text_col), F.col(values))).drop(values)
    return out.withColumn("restore_misses", misses(F.col(text_col)))
