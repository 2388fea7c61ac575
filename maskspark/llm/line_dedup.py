"""Line dedup: lines that many documents share stay in one document only.

Hashes of long lines are range-partitioned with a secondary sort by document and position; each partition is then
read as a stream that knows, when a run of equal hashes ends, which of its lines to drop. What comes back is a
compressed keep bitmap a document, not text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskspark.llm.shared import as_bytes, cut, lean, partitions, positional, signed

MIN_CHARS = 40
MIN_DOCUMENTS = 5
_SPACE = b"\x20\t\n\r\x0b\x0c"
_LINE = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("pos", pa.int32())])
_FOUND = pa.schema([*_LINE, ("open", pa.bool_())])


def line_key(line: bytes) -> bytes:
    return line.strip(_SPACE).lower()


def _lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, texts = batch.column(0), as_bytes(batch.column(1))
            hashes, rows, positions, tags = [], [], [], np.zeros(len(texts), np.int64)
            for i, text in enumerate(texts):
                if not text:
                    continue
                tags[i] = zlib.crc32(text)
                for k, line in enumerate(text.split(b"\n")):
                    if len(line) >= min_chars:
                        key = line_key(line)
                        if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
                            hashes.append(xxhash.xxh3_64_intdigest(key))
                            rows.append(i)
                            positions.append(k)
            rows = np.array(rows, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(np.array(hashes, np.uint64))), doc_ids.take(pa.array(rows)), pa.array(tags[rows]), pa.array(positions, pa.int32())],
                schema=_LINE,
            )

    return run


def _stream(min_documents: int):
    """Over rows sorted by hash, document and position: the lines to drop, and the rows of runs that may go on elsewhere.

    A run is judged where it ends. The first and the last run of a partition, and a run longer than a batch, are
    handed on with open = true, so that no run is ever held as a whole.
    """

    def judged(t: pa.Table, first: bool, last: bool, going_on: set[int]) -> tuple[pa.Table, pa.Table]:
        h = t.column("h").to_numpy()
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        ends = np.r_[starts[1:], len(h)]
        keep_back = 0 if last else len(h) - starts[-1]
        doc = t.column("doc_id").combine_chunks()
        null = doc.is_null().to_numpy(zero_copy_only=False)
        ids = doc.fill_null(0).to_numpy(zero_copy_only=False)
        new_doc = np.r_[True, (h[1:] != h[:-1]) | (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])]
        run = np.cumsum(np.r_[False, h[1:] != h[:-1]])
        docs = np.add.reduceat(new_doc.astype(np.int64), starts)
        lasts = ends - 1
        is_open = np.isin(h[starts], np.fromiter(going_on, np.int64, len(going_on))) if going_on else np.zeros(len(starts), bool)
        is_open[0] |= first
        is_open[-1] |= last
        of_last = (ids == ids[lasts][run]) & (null == null[lasts][run])
        out = (is_open | (docs >= min_documents))[run] & (is_open[run] | ~of_last)
        n = len(h) - keep_back
        rows = np.flatnonzero(out[:n])
        return t.take(pa.array(rows)).append_column("open", pa.array(is_open[run][rows])), t.slice(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, first, going_on = None, True, set()
        for batch in batches:
            if not batch.num_rows:
                continue
            if rest is not None and len(rest) and rest.column("h")[0] == rest.column("h")[-1] == batch.column("h")[0] and len(rest) >= batch.num_rows:
                # a run longer than a batch: what came so far goes out, the rest follows as open
                going_on = {rest.column("h")[0].as_py()}
                yield from rest.append_column("open", pa.array(np.ones(len(rest), bool))).to_batches()
                rest, first = None, False
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None and len(rest) else t
            whole, rest = judged(t, first, False, going_on)
            first = first and not len(t) - len(rest)
            yield from whole.to_batches()
        if rest is not None and len(rest):
            yield from judged(rest, first, True, going_on)[0].to_batches()

    return run


def _bitmap(n_lines: int, positions: list[int]) -> bytes:
    bits = np.ones(n_lines, bool)
    bits[positions] = False
    return zlib.compress(np.packbits(bits).tobytes(), 6)


def _unpacked(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tag, pos) of every line that goes; tag is the CRC-32 of the document's text."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = partitions(docs.sparkSession)
    lines = slim.mapInArrow(lean(_lines(min_chars)), "h long, doc_id long, tag long, pos int")
    order = ("h", "doc_id", "tag", "pos")
    found = lines.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(lean(_stream(min_documents)), "h long, doc_id long, tag long, pos int, open boolean")
    found = cut(found)
    # Runs that a partition's end cut in two: two at most a partition and one for each run longer than a batch.
    held = found.where("open").select("h", F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id").alias("doc"))
    totals = held.groupBy("h", "doc").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("*").alias("docs"), F.max("doc").alias("last"))
    late = (
        found.where("open").join(totals.where(F.col("docs") >= min_documents), "h")
        .where(~F.col("doc_id").eqNullSafe(F.col("last.doc_id"))).select("doc_id", "tag", "pos")
    )
    return found.where("not open").select("doc_id", "tag", "pos").unionAll(late)


def _to_bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        positions, n_lines = batch.column(2).to_pylist(), [max(p) + 1 for p in batch.column(2).to_pylist()]
        maps = [_bitmap(n, p) for n, p in zip(n_lines, positions, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n_lines, pa.int32()), pa.array([len(p) for p in positions], pa.int64()), pa.array(maps, pa.binary())],
            names=["doc_id", "tag", "upto", "n_dropped", "keep"],
        )


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The keep bitmap of every document that loses a line: (doc_id, tag, upto int, n_dropped long, keep binary).

    A text is cut at \\n. A line's key is the line without [\\x20\\x09-\\x0D] at either end, A-Z lower-cased. A key of at
    least `min_chars` code points that is found in at least `min_documents` documents loses all its lines but those of
    the largest document id that holds it. `keep` is a zlib-compressed bit string of the first `upto` lines, 1 for a line
    that stays; lines behind it, and all lines of documents without a row here, stay.

    Nulls and empty texts have one empty line and lose nothing. A null id is smaller than any other. Rows of one id
    count as one document; `tag` (CRC-32 of the text) tells rows of one id with different texts apart, equal rows are
    treated alike. Very long texts are taken whole. Other columns are neither read nor clash. No rows give no rows.
    """
    gone = dropped_lines(docs, min_chars, min_documents, id_col, text_col)
    lists = gone.distinct().groupBy("doc_id", "tag").agg(F.collect_list("pos").alias("positions"))
    return lists.mapInArrow(lean(_to_bitmaps), "doc_id long, tag long, upto int, n_dropped long, keep binary")


def _applied(text_at: int, upto_at: int, keep_at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upto, keep = batch.column(upto_at).to_pylist(), batch.column(keep_at).to_pylist()
            rows = [i for i, k in enumerate(keep) if k is not None]
            if rows:
                texts = batch.column(text_at).to_pylist()
                for i in rows:
                    lines, bits = texts[i].split("\n"), _unpacked(keep[i], upto[i])
                    texts[i] = "\n".join([x for x, stays in zip(lines, bits) if stays] + lines[upto[i] :])
                batch = batch.set_column(text_at, batch.schema.field(text_at), pa.array(texts, batch.schema.field(text_at).type))
            yield batch.drop_columns([batch.schema.names[upto_at], batch.schema.names[keep_at]]).rename_columns(names)

    return run


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the columns of its bitmaps, null where all lines stay, as __n_dropped, __upto and __keep."""
    maps = bitmaps.select(*[F.col(c).alias(f"__{c}") for c in ("doc_id", "tag", "upto", "n_dropped", "keep")])
    tagged = docs.withColumn("__crc", F.crc32(F.col(text_col).cast("binary")))
    on = F.col(id_col).cast("long").eqNullSafe(F.col("__doc_id")) & (F.col("__crc") == F.col("__tag"))
    return tagged.join(maps, on, "left").drop("__doc_id", "__tag", "__crc")


def drop_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, same columns, with the texts that the bitmaps leave; rows without a bitmap, null texts among them, stay as they are."""
    names = docs.columns
    id_at, text_at = names.index(id_col), names.index(text_col)
    wide = with_bitmaps(docs.select(*positional(docs, names)), bitmaps, f"c{id_at}", f"c{text_at}").drop("__n_dropped")
    return wide.mapInArrow(lean(_applied(text_at, wide.columns.index("__upto"), wide.columns.index("__keep"), names)), docs.schema)


def digests(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every row of docs."""
    wide = with_bitmaps(docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), bitmaps)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            texts, upto, keep = as_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(4).to_pylist()
            n_lines, shas = [], []
            for text, n, bitmap in zip(texts, upto, keep, strict=True):
                lines = text.split(b"\n")
                n_lines.append(len(lines))
                if bitmap is not None:
                    bits = _unpacked(bitmap, n)
                    text = b"\n".join([x for x, stays in zip(lines, bits) if stays] + lines[n:])
                shas.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_lines, pa.int64()), batch.column(3).fill_null(0), pa.array(shas)], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"]
            )

    return wide.select("doc_id", "text", "__upto", "__n_dropped", "__keep").mapInArrow(lean(hashed), "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, same columns of any name, with the lines dropped that keep_bitmaps() drops: by whole texts, ties, nulls and all.

    Null texts stay null, empty ones empty; a null id is smaller than any other, so its lines go where others have them;
    repeated rows lose the same lines. A text may lose all its lines and then is empty. No rows give no rows.
    """
    return drop_lines(docs, keep_bitmaps(docs, min_chars, min_documents, id_col, text_col), id_col, text_col)
