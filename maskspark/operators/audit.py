"""The audit log: one JSON object a line, and its summary. DataFrame functions only; message texts are never logged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "v int, ts string, provider string, model string, decision string, reason string, fields bigint, counts map<string,bigint>, "
    "media struct<dropped:bigint,preflight:bigint,raw:bigint>, rawMedia boolean"
)
DECISIONS = ("masked", "clean", "blocked", "error")


def parse(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """Lines of text to audit rows, with line (as it stands) and broken; blank lines are skipped, "null" is broken."""
    kept = lines.where(F.trim(F.col(value_col)) != "")
    parsed = kept.withColumn("__a", F.from_json(F.col(value_col), SCHEMA + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    rest = [c for c in lines.columns if c != value_col]
    broken = F.col("__a").isNull() | F.col("__a._corrupt_record").isNotNull() | (F.trim(F.col(value_col)) == "null")
    return parsed.select(*rest, F.col(value_col).alias("line"), broken.alias("broken"), "__a.*").drop("_corrupt_record").withColumn("ts", F.try_to_timestamp("ts"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))


def write(audit: DataFrame, path: str) -> None:
    """Appends; one folder a day, so that a day's log can go as a whole."""
    audit.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").json(path)


def entries(masked: DataFrame, counts_col: str = "mask_counts", error_col: str = "mask_error") -> DataFrame:
    """An audit row a masked row: decision, fields and counts."""
    total = F.coalesce(F.aggregate(F.map_values(counts_col), F.lit(0), lambda a, b: a + b), F.lit(0))
    decision = F.when(F.col(error_col).isNotNull(), "error").when(F.col("mask_changed"), "masked").otherwise("clean")
    return masked.select(
        F.lit(1).alias("v"), F.current_timestamp().alias("ts"), decision.alias("decision"), F.col(error_col).alias("reason"),
        F.when(total > 0, 1).otherwise(0).cast("long").alias("fields"), F.col(counts_col).cast("map<string,bigint>").alias("counts"),
    )


def since(audit: DataFrame, ts: str | None) -> DataFrame:
    """Entries from ts on; without a ts, or with one that is no time, all of them."""
    at = F.try_to_timestamp(F.lit(ts)) if ts else F.lit(None).cast("timestamp")
    return audit.where(at.isNull() | F.coalesce(F.col("ts") >= at, F.lit(False)))


def decisions(audit: DataFrame) -> DataFrame:
    """(decision, n); what is no known decision counts as clean."""
    return audit.where("not broken").groupBy(F.when(F.col("decision").isin(*DECISIONS), F.col("decision")).otherwise("clean").alias("decision")).agg(F.count("*").alias("n"))


def totals(audit: DataFrame) -> DataFrame:
    """One row: lines valid and broken, sums of fields and media."""
    of: Column = F.col("broken")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c.replace("media.", "media_"))
    return audit.agg(F.count_if(~of).alias("valid"), F.count_if(of).alias("broken_lines"), total("fields"), total("media.raw"), total("media.dropped"), total("media.preflight"))


def category_totals(audit: DataFrame) -> DataFrame:
    """(cat, n) over all entries."""
    return audit.where("not broken").select(F.explode("counts").alias("cat", "c")).groupBy("cat").agg(F.sum("c").alias("n"))


def top_categories(audit: DataFrame, most: int = 8, order_cols: tuple[str, ...] | None = None) -> DataFrame:
    """The most frequent categories; of equal ones that which appears first, by order_cols and then by place in its entry.

    Without order_cols the order is that of line_no where there is one, else of ts.
    """
    order_cols = order_cols or (("line_no",) if "line_no" in audit.columns else ("ts",))
    of = audit.where("not broken").select(*order_cols, F.posexplode(F.map_entries("counts")).alias("place", "x"))
    sums = of.groupBy(F.col("x.key").alias("cat")).agg(F.sum("x.value").alias("n"), F.min(F.struct(*order_cols, "place")).alias("first"))
    return sums.orderBy(F.desc("n"), "first").limit(most).select("cat", "n")


def raw_media(audit: DataFrame, order_cols: list[str], most: int = 10) -> DataFrame:
    """The first entries by which media went out as they were."""
    return audit.where("rawMedia or media.raw > 0").orderBy(*order_cols).limit(most)
