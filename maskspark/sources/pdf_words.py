"""Words with boxes, as PDF readers give them: lines, masked lines, and the boxes to cover."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskspark.config import MaskConfig
from maskspark.functions.masking import Session
from maskspark.operators.documents import masker

#: A word belongs to a line if its top is nearer than this to that of the line's first word.
LINE_GAP = 4.0
LONGEST_VALUE = 2000


def lines(words: DataFrame) -> DataFrame:
    """words (file, page, x0, y0, x1, y1, text) with line: words by (y0, x0), a line anchored at its first word.

    A page is one group, bounded by what fits on a page.
    """
    ordered = F.array_sort(F.collect_list(F.struct("y0", "x0", "x1", "y1", "text")))
    pages = words.groupBy("file", "page").agg(ordered.alias("w"))
    start = F.struct(F.lit(-1).alias("line"), F.lit(None).cast("double").alias("top"), F.array().cast("array<int>").alias("of"))
    same = lambda s, w: s["top"].isNotNull() & (F.abs(w["y0"] - s["top"]) < LINE_GAP)
    step = lambda s, w: F.struct(
        F.when(same(s, w), s["line"]).otherwise(s["line"] + 1).alias("line"), F.when(same(s, w), s["top"]).otherwise(w["y0"]).alias("top"),
        F.concat(s["of"], F.array(F.when(same(s, w), s["line"]).otherwise(s["line"] + 1))).alias("of"),
    )
    numbered = pages.withColumn("of", F.aggregate("w", start, step, lambda s: s["of"]))
    pairs = F.arrays_zip("of", "w")
    return numbered.select("file", "page", F.explode(pairs).alias("p")).select("file", "page", F.col("p.of").alias("line"), "p.w.x0", "p.w.y0", "p.w.x1", "p.w.y1", "p.w.text")


def line_texts(lined: DataFrame) -> DataFrame:
    """(file, page, line, text, words): words by x0 joined by a space, each with where it starts and ends in the text."""
    words = F.array_sort(F.collect_list(F.struct("x0", "y0", "x1", "y1", "text")))
    grouped = lined.groupBy("file", "page", "line").agg(words.alias("w"))
    ends = F.aggregate("w", F.array().cast("array<int>"), lambda a, w: F.concat(a, F.array(F.when(F.size(a) == 0, 0).otherwise(F.element_at(a, -1) + 1) + F.length(w["text"]))))
    zipped = F.zip_with("w", ends, lambda w, e: F.struct((e - F.length(w["text"])).alias("start"), e.alias("end"), w["x0"].alias("x0"), w["y0"].alias("y0"), w["x1"].alias("x1"), w["y1"].alias("y1")))
    return grouped.select("file", "page", "line", F.array_join(F.transform("w", lambda w: w["text"]), " ").alias("text"), zipped.alias("words"))


def sensitive_spans(texts: DataFrame, cfg: MaskConfig = MaskConfig()) -> DataFrame:
    """(file, page, line, start, end, cat): every place on a line where a masked value of its file stands.

    All values of a file count on all its lines. A file is masked in order of page and line, as one session.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, session = masker(cfg), Session()
        pdf = pdf.sort_values(["page", "line"])
        for text in pdf["text"]:
            own.mask(text, session)
        values = sorted(((v, cat) for cat, vs in session.values.items() for v in vs if 0 < len(v) < LONGEST_VALUE), key=lambda x: (-len(x[0]), x))
        rows = []
        for f, page, line, text in zip(pdf["file"], pdf["page"], pdf["line"], pdf["text"]):
            for value, cat in values:
                at = text.find(value)
                while at >= 0:
                    rows.append((f, page, line, at, at + len(value), cat))
                    at = text.find(value, at + len(value))
        return pd.DataFrame(rows, columns=["file", "page", "line", "start", "end", "cat"])

    return texts.select("file", "page", "line", "text").groupBy("file").applyInPandas(run, "file string, page int, line int, start int, end int, cat string")


def cover_boxes(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(file, page, x0, y0, x1, y1) of the words that a span overlaps, each box once, to one decimal."""
    words = texts.select("file", "page", "line", F.explode("words").alias("w"))
    on = ["file", "page", "line"]
    hit = words.join(spans.select(*on, "start", "end"), on).where((F.col("w.start") < F.col("end")) & (F.col("start") < F.col("w.end")))
    return hit.select("file", "page", *[F.round(f"w.{c}", 1).alias(c) for c in ("x0", "y0", "x1", "y1")]).dropDuplicates()


def mask_pages(texts: DataFrame, cfg: MaskConfig = MaskConfig()) -> DataFrame:
    """(file, page, text) with the lines of a page joined and masked; numbers by file."""
    from maskspark.operators.sessions import mask_sessions

    pages = texts.groupBy("file", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return mask_sessions(pages, "file", ["page"], cfg=cfg)
