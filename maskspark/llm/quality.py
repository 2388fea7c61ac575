"""Quality rules: fixed limits, then robust outliers by minimum-covariance-determinant estimates per language and source.

Each document gives a vector of transformed statistics. For each language and source the mean and covariance of the
COVERAGE of documents with the smallest determinant are sought by concentration steps over all documents: distances under
the present estimate, then mean and covariance of the nearest ones. A step is one aggregation: documents are summed up by
group and by bins of distance, 64 to a doubling, and the nearest bins that hold the coverage make the next estimate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskspark.llm.shared import WordHashes, cut, lean, windows

MIN_WORDS = 10
#: Per cent of words in repeated windows of REPEAT words that a document may have.
MAX_REPEATED = 20
REPEAT = 5
SYMBOLS = "#*$%&|<>"
#: Part of the documents of a group that an estimate rests on, concentration steps, and the tail that is rejected.
COVERAGE = 0.75
STEPS = 4
TAIL_Z = 4.75  # normal quantile of 1 - 1e-6
#: Standard deviations that are always allowed for in each statistic: no group is so even that less would be an outlier.
#: The last two are small against their statistics' ranges, log 11 and, under MAX_REPEATED, log 3: alone they can pass the limit.
FLOOR = (0.5, 0.15, 0.5, 0.2, 0.1)
#: Models of this many groups at most are broadcast.
BROADCAST_GROUPS = 20_000
_P = len(FLOOR)
_X = [f"x{i}" for i in range(_P)]
_SPACE = " \t\n\r\x0b\x0c"
_PAIRS = [(i, j) for i in range(_P) for j in range(i, _P)]
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(text: str | None, hashes: WordHashes) -> tuple[int, int, int, int, int, int]:
    """BASE and the number of lines with a word."""
    if not text:
        return (0,) * 6
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    repeated = 0
    if n > REPEAT:
        found = windows(hashes.of(words), REPEAT)
        order = np.argsort(found, kind="stable")
        same = found[order][1:] == found[order][:-1]
        twice = np.zeros(len(found), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        ends = np.zeros(n + 1, np.int32)
        ends[: len(found)] += twice
        ends[REPEAT : REPEAT + len(found)] -= twice
        repeated = int(np.count_nonzero(np.cumsum(ends)[:n]))
    return n, len(text) - sum(map(text.count, _SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(..., text) to (..., BASE, x0, ...)."""
    hashes = WordHashes()
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        s = np.array([statistics(t, hashes) for t in texts], np.int64).reshape(len(texts), 6)
        n = np.maximum(s[:, 0], 1)
        x = [np.log1p(s[:, 0]), np.log(np.maximum(s[:, 1], 1) / n), np.log1p(100 * s[:, 2] / n), np.log1p(10 * s[:, 3] / np.maximum(s[:, 5], 1)), np.log1p(10 * s[:, 4] / n)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(s[:, i]) for i in range(5)], *map(pa.array, x)], names=[*batch.schema.names[:-1], *BASE, *_X])


def chi2_quantile(p: int, z: float) -> float:
    """Of chi-square with p degrees of freedom, where a normal variable has z (Wilson and Hilferty)."""
    return p * (1 - 2 / (9 * p) + z * (2 / (9 * p)) ** 0.5) ** 3


def _model(keys: list, mean: np.ndarray, cov: np.ndarray, scale: float) -> list:
    cov = cov + np.diag(np.square(FLOOR))
    return [*keys, float(np.linalg.slogdet(cov)[1]), float(scale), mean.tolist(), np.linalg.inv(cov).ravel().tolist()]


_MODEL = "g string, start int, logdet double, scale double, mean array<double>, inverse array<double>"
_BIN = 64  # bins to a doubling of the distance
_HALF = 32  # bins to one unit of a statistic, for the first estimate


def _first(pdf: pd.DataFrame) -> pd.DataFrame:
    """Two starts: medians and absolute deviations of each statistic, and mean and covariance of all."""
    g = pdf["g"].iloc[0]
    mean, spread, median = np.zeros(_P), np.zeros(_P), np.zeros(_P)
    for d, part in pdf.groupby("dim"):
        x, n = part["bin"].to_numpy() / _HALF, part["n"].to_numpy(np.float64)
        order = np.argsort(x)
        x, n = x[order], n[order]
        median[d] = x[np.searchsorted(np.cumsum(n), n.sum() / 2)]
        far, order = np.abs(x - median[d]), np.argsort(np.abs(x - median[d]))
        spread[d] = 1.4826 * far[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)]
        mean[d] = np.average(x, weights=n)
        spread_all = np.average(np.square(x - mean[d]), weights=n)
        pdf.loc[part.index, "var"] = spread_all
    var = pdf.groupby("dim")["var"].first().to_numpy()
    return pd.DataFrame([_model([g, 0], median, np.diag(np.square(spread)), 1.0), _model([g, 1], mean, np.diag(var), 1.0)], columns=["g", "start", "logdet", "scale", "mean", "inverse"])


def _step(pdf: pd.DataFrame) -> pd.DataFrame:
    """The estimate of the nearest bins that hold the coverage; scale brings the median distance to that of chi-square."""
    pdf = pdf.sort_values("bin", kind="stable")
    n = pdf["n"].to_numpy(np.float64)
    at = int(np.searchsorted(np.cumsum(n), COVERAGE * n.sum()))
    near = pdf.iloc[: at + 1]
    total = near["n"].sum()
    mean = near[[f"s{i}" for i in range(_P)]].sum().to_numpy(np.float64) / total
    cov = np.zeros((_P, _P))
    for i, j in _PAIRS:
        cov[i, j] = cov[j, i] = near[f"q{i}{j}"].sum() / total - mean[i] * mean[j]
    middle = pdf["bin"].iloc[int(np.searchsorted(np.cumsum(n), n.sum() / 2))]
    scale = max(1.0, 2.0 ** (middle / _BIN) / chi2_quantile(_P, 0.0))
    return pd.DataFrame([_model([pdf["g"].iloc[0], pdf["start"].iloc[0]], mean, cov, scale)], columns=["g", "start", "logdet", "scale", "mean", "inverse"])


def _distance(mean: str = "mean", inverse: str = "inverse") -> Column:
    """Squared Mahalanobis distance of the row's vector."""
    d = [F.col(x) - F.element_at(mean, i + 1) for i, x in enumerate(_X)]
    return sum((d[i] * d[j] * F.element_at(inverse, i * _P + j + 1) * (1 if i == j else 2) for i, j in _PAIRS), F.lit(0.0))


def _with_model(vectors: DataFrame, model: DataFrame, groups: int) -> DataFrame:
    return vectors.join(F.broadcast(model) if groups <= BROADCAST_GROUPS else model, "g")


def estimates(vectors: DataFrame) -> DataFrame:
    """The model of each group g of vectors (g, x0, ...): of the start whose steps end with the smaller determinant.

    A group of any number of rows has one: FLOOR is added to its covariance.
    """
    dims = F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.floor(F.col(x) * _HALF + 0.5).alias("bin")) for i, x in enumerate(_X)])).alias("v")
    counts = vectors.select("g", dims).groupBy("g", "v.dim", "v.bin").agg(F.count("*").alias("n")).withColumn("var", F.lit(0.0))
    model = cut(counts.groupBy("g").applyInPandas(_first, _MODEL), free=False)  # a row a group, as all that follow
    groups = model.count()
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(_X)] + [F.sum(F.col(_X[i]) * F.col(_X[j])).alias(f"q{i}{j}") for i, j in _PAIRS]
    bins = F.floor(F.log2(_distance() + 2.0**-20) * _BIN).cast("int")
    for _ in range(STEPS):
        by_bin = _with_model(vectors, model.select("g", "start", "mean", "inverse"), groups).groupBy("g", "start", bins.alias("bin")).agg(F.count("*").alias("n"), *sums)
        model = cut(by_bin.groupBy("g", "start").applyInPandas(_step, _MODEL), free=False)
    best = model.groupBy("g").agg(F.min(F.struct("logdet", "start", "scale", "mean", "inverse")).alias("m"))
    return best.select("g", "m.scale", "m.mean", "m.inverse")


def _group(lang: str, source: str) -> Column:
    return F.concat_ws("\x01", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in (lang, source)])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row a row of docs: doc_id, BASE (long), base_failed, distance (double), kept.

    Words are the runs without [\\x20\\x09-\\x0D]; word_chars counts their code points, n_symbols the signs #*$%&|<>, n_dup_lines
    the lines with a word that equal an earlier line, n_repeat_words the words in windows of 5 words that the text holds
    twice or more. base_failed: fewer than MIN_WORDS words, or more than MAX_REPEATED per cent of words repeated.
    Documents that pass the base take part in the estimates of their language and source (a null is a value of its own)
    and are kept if the squared distance, over the group's scale, is within the chi-square limit. Null and empty texts
    have no words and fail; texts are taken whole; repeated rows count as often as they stand; no other column is read.
    No rows give no rows.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), _group(lang_col, source_col).alias("g"), F.col(text_col).cast("string").alias("text"))
    fields = "doc_id long, g string, " + ", ".join(f"{c} long" for c in BASE) + ", " + ", ".join(f"{x} double" for x in _X)
    rows = cut(slim.mapInArrow(lean(_vectors), fields))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    model = cut(estimates(rows.where("not base_failed")))
    groups = model.count()
    judged = rows.join(F.broadcast(model) if groups <= BROADCAST_GROUPS else model, "g", "left").withColumn("distance", _distance() / F.col("scale"))
    kept = F.when(F.col("base_failed"), False).otherwise(F.col("distance") <= chi2_quantile(_P, TAIL_Z))
    return judged.select("doc_id", *BASE, "base_failed", F.when(~F.col("base_failed"), F.col("distance")).alias("distance"), kept.alias("kept"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """docs without the rows that judge() rejects, same columns, whatever their names.

    Null and empty texts have too few words and go; null languages and sources are groups of their own; null ids are kept or
    rejected by their texts; repeated rows stay or go together and count as often as they stand; a distance that equals the
    limit is within it. Texts are taken whole. No rows give no rows.
    """
    fields = "g string, " + ", ".join(f"{c} long" for c in BASE) + ", " + ", ".join(f"{x} double" for x in _X)
    slim = docs.select(_group(lang_col, source_col).alias("g"), F.col(text_col).cast("string").alias("text"))
    rows = cut(slim.mapInArrow(lean(_vectors), fields))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    model = cut(estimates(rows.where(~failed)))
    groups = model.count()
    # the texts are gone over once more instead of being shuffled to meet their verdicts
    names = [f"__c{i}" for i in range(len(docs.columns))]
    at = {c: names[docs.columns.index(c)] for c in (text_col, lang_col, source_col)}
    moved = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)])
    wide = moved.withColumn("g", _group(at[lang_col], at[source_col])).withColumn("__text", F.col(at[text_col]).cast("string"))
    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema))
    judged = wide.mapInArrow(lean(_vectors), f"{kinds}, {fields}")
    judged = judged.where(~failed).join(F.broadcast(model) if groups <= BROADCAST_GROUPS else model, "g")
    good = judged.where(_distance() / F.col("scale") <= chi2_quantile(_P, TAIL_Z))
    return good.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])
