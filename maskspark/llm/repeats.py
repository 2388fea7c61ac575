"""Substring dedup by fixed-block anchors.

Every document is cut into blocks of 7 words that do not overlap: the index. Every window of 7 words in a row, at each
word of each document, probes it. Any 13 words in a row hold one whole block of their document, so a passage of 13 words
or more that another document has too is hit. A hit is extended: the 13-word windows around it are compared as wholes,
and those found in an earlier document, which overlap along a repeat, add up to the maximal exact repeat.

Both steps deal packed arrays by hash: a row for each task and block of hashes, not for each word. No pair of places is
ever formed: a block of hashes knows which hits there are, and of a window only the smallest document id matters, so a
passage that a third of all documents share costs what any other text costs. The number of blocks follows the bytes of
text, and a block is gone through by ranges of its hashes: its packed arrays and one range are what a task holds.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskspark.llm.shared import WordHashes, as_bytes, cut, mixed, partitions, positional, release, windows

#: Words of a window, and of an anchor: any WINDOW words hold a whole block of ANCHOR words, at whatever place they start.
WINDOW = 13
ANCHOR = (WINDOW + 1) // 2

#: A null id counts as larger than any other.
_NULL = np.iinfo(np.int64).max
#: Words gathered before packed arrays are sent: bounds a worker's memory.
_GATHER = 400_000
#: Bytes of text to a block of hashes, and hashes judged together.
BLOCK_BYTES, _JUDGED = 256 << 20, 4 << 20
_PACKED = pa.schema([("block", pa.int32()), ("docs", pa.binary()), ("items", pa.binary())])
_DOC = np.dtype([("doc_id", "<i8"), ("tag", "<u4"), ("count", "<u4")])


def _texts(batches: Iterator[pa.RecordBatch], id_at: int = 0, text_at: int = 1) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[bytes]]]:
    for batch in batches:
        ids = batch.column(id_at).fill_null(_NULL).to_numpy(zero_copy_only=False)
        yield batch, ids, [t or b"" for t in as_bytes(batch.column(text_at))]


class _Packer:
    """Gathers (hash, mark) of documents and deals them to n blocks by hash, packed by `packing`."""

    def __init__(self, n: int, packing: Callable[[np.ndarray, np.ndarray], bytes]):
        self.n, self.packing, self.docs, self.hashes, self.marks, self.held = n, packing, [], [], [], 0

    def add(self, doc_id: int, tag: int, hashes: np.ndarray, marks: np.ndarray) -> None:
        self.docs.append((doc_id, tag, len(hashes)))
        self.hashes.append(hashes)
        self.marks.append(marks)
        self.held += len(hashes)

    def send(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            hashes, marks = np.concatenate(self.hashes), np.concatenate(self.marks)
            doc = np.repeat(np.arange(len(self.docs)), [d[2] for d in self.docs])
            block = (mixed(hashes) % np.uint64(self.n)).astype(np.int32)
            order = np.argsort(block, kind="stable")
            hashes, marks, doc, block = hashes[order], marks[order], doc[order], block[order]
            starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            rows = []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(block)]):
                own, counts = np.unique(doc[s:e], return_counts=True)
                head = np.array([(*self.docs[d][:2], c) for d, c in zip(own.tolist(), counts.tolist())], _DOC)
                rows.append((int(block[s]), head.tobytes(), self.packing(hashes[s:e], marks[s:e])))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _PACKED)], schema=_PACKED)
        self.docs, self.hashes, self.marks, self.held = [], [], [], 0


def short(hashes: np.ndarray) -> np.ndarray:
    """The 31 bits of a hash by which anchors are told apart: a false hit costs a comparison of whole windows and no more."""
    return (hashes & np.uint64(0x7FFFFFFF)).astype("<u4")


def pack_anchors(hashes: np.ndarray, indexed: np.ndarray) -> bytes:
    """Four bytes for each: the short hash, and whether it is a block of the index."""
    return (short(hashes) << np.uint32(1) | indexed.astype("<u4")).tobytes()


def pack(hashes: np.ndarray, places: np.ndarray) -> bytes:
    """All bytes of hashes, then those of places, as few as the largest place needs."""
    most = int(places.max()) if len(places) else 0
    wide = 2 if most < 1 << 16 else 3 if most < 1 << 24 else 8
    columns = [x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].tobytes() for x, n in ((hashes, 8), (places, wide))]
    return bytes([8, wide]) + b"".join(columns)


def unpack(items: bytes) -> tuple[np.ndarray, np.ndarray]:
    width, wide = items[:2]
    n = (len(items) - 2) // (width + wide)
    out = []
    for at, size in ((2, width), (2 + width * n, wide)):
        x = np.zeros((n, 8), np.uint8)
        x[:, :size] = np.frombuffer(items, np.uint8, n * size, at).reshape(n, size)
        out.append(x.view("<u8").ravel())
    return out[0], out[1]


def _probes(n: int):
    """All windows of ANCHOR words; marked where they are a block of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, out = WordHashes(), _Packer(n, pack_anchors)
        for _, ids, texts in _texts(batches):
            for doc_id, text in zip(ids.tolist(), texts):
                split = text.split()
                if len(split) >= WINDOW:
                    found = windows(words.of(split), ANCHOR)
                    out.add(doc_id, zlib.crc32(text), found, np.arange(len(found)) % ANCHOR == 0)
                    if out.held >= _GATHER:
                        yield from out.send()
        yield from out.send()

    return run


def _candidates(n: int):
    """All windows of WINDOW words that hold a hit; the last column has the short hashes of the hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, out = WordHashes(), _Packer(n, pack)
        for batch, ids, texts in _texts(batches):
            for doc_id, text, hits in zip(ids.tolist(), texts, batch.column(2).to_pylist()):
                hashes = words.of(text.split())
                found, near = windows(hashes, WINDOW), np.zeros(len(hashes) + 1, np.int32)
                hit = np.flatnonzero(np.isin(short(windows(hashes, ANCHOR)), np.concatenate([np.frombuffer(x, "<u4") for x in hits])))
                np.add.at(near, np.maximum(hit - (WINDOW - ANCHOR), 0), 1)
                np.add.at(near, hit + 1, -1)
                at = np.flatnonzero(np.cumsum(near)[: len(found)] > 0)
                if len(at):
                    out.add(doc_id, zlib.crc32(text), found[at], at.astype(np.uint64))
                if out.held >= _GATHER:
                    yield from out.send()
        yield from out.send()

    return run


_PLACES = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("places", pa.list_(pa.binary()))])


def _ranges(parts: list[tuple[bytes, bytes]], whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Heads of all documents of a block and, range by range of its hashes, documents, hashes and marks in order of the hash."""
    heads = np.concatenate([np.frombuffer(d, _DOC) for d, _ in parts])
    total = int(heads["count"].sum(dtype=np.int64))
    ranges = -(-total // _JUDGED)
    firsts = np.cumsum([0, *[len(d) // _DOC.itemsize for d, _ in parts]])
    for r in range(ranges):
        docs, hashes, marks = [], [], []
        for first, (d, items) in zip(firsts.tolist(), parts):
            if whole:
                h, m = unpack(items)
            else:
                x = np.frombuffer(items, "<u4")
                h, m = x >> np.uint32(1), x & np.uint32(1)
            counts = np.frombuffer(d, _DOC)["count"]
            doc = np.repeat(np.arange(first, first + len(counts)), counts)
            own = slice(None) if ranges == 1 else (mixed(h.astype(np.uint64) + np.uint64(1)) >> np.uint64(32)) % np.uint64(ranges) == r
            docs.append(doc[own]), hashes.append(h[own]), marks.append(m[own])
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        yield heads, np.concatenate(docs)[order], h[order], np.concatenate(marks)[order]


def _judge(n: int, whole: bool):
    """Over all packed arrays of a block: what goes on. One partition holds one block or several.

    Of anchors (whole = false) the hashes of those of an index block that another document has too, or that equal one; of
    whole windows the places of those of which a document with a smaller id has one.
    """

    def judged(parts: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        for heads, doc, h, marks in _ranges(parts, whole):
            if not len(h):
                continue
            new = np.r_[True, h[1:] != h[:-1]]
            starts, run = np.flatnonzero(new), np.cumsum(new) - 1
            ids = heads["doc_id"][doc]
            least = np.minimum.reduceat(ids, starts)
            if whole:
                out = least[run] < ids
            else:
                out = ((np.maximum.reduceat(marks, starts) > 0) & (np.maximum.reduceat(ids, starts) > least))[run]
                out &= np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]  # once for each document
            yield from sent(heads, doc[out], (marks if whole else h)[out].astype("<u4"))

    def sent(heads: np.ndarray, doc: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A row for each block of documents, not for each document."""
        if not len(doc):
            return
        to = (mixed(heads["doc_id"].astype(np.uint64) ^ heads["tag"]) % np.uint64(n)).astype(np.int32)
        order = np.lexsort((doc, to[doc]))
        doc, values = doc[order], values[order]
        firsts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        own = heads[doc[firsts]]
        own["count"] = np.diff(np.r_[firsts, len(doc)])
        target = to[doc[firsts]]
        cuts = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
        ends, starts = [*cuts[1:].tolist(), len(own)], [*firsts.tolist(), len(doc)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(target[cuts]), pa.array([own[s:e].tobytes() for s, e in zip(cuts.tolist(), ends)], pa.binary()),
             pa.array([values[starts[s] : starts[e]].tobytes() for s, e in zip(cuts.tolist(), ends)], pa.binary())], schema=_PACKED
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts = None, []
        for batch in batches:  # sorted by block
            for b, docs, items in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if b != block and parts:
                    yield from judged(parts)
                    parts = []
                block = b
                parts.append((docs, items))
        if parts:
            yield from judged(parts)

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over all packed places of a block of documents, sorted by block: a row a document."""

    def rows(parts: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        heads = np.concatenate([np.frombuffer(d, _DOC) for d, _ in parts])
        places = np.concatenate([np.frombuffer(i, "<u4") for _, i in parts])
        names, tags = np.repeat(heads["doc_id"], heads["count"]), np.repeat(heads["tag"], heads["count"])
        order = np.lexsort((places, tags, names))
        names, tags, places = names[order], tags[order], places[order]
        firsts = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]) | (tags[1:] != tags[:-1])])
        ends = [*firsts[1:].tolist(), len(places)]
        lists = [[places[s:e].tobytes()] for s, e in zip(firsts.tolist(), ends)]
        yield pa.RecordBatch.from_arrays([pa.array(names[firsts]), pa.array(tags[firsts].astype(np.int64)), pa.array(lists, pa.list_(pa.binary()))], schema=_PLACES)

    block, parts = None, []
    for batch in batches:
        for b, docs, items in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if b != block and parts:
                yield from rows(parts)
                parts = []
            block = b
            parts.append((docs, items))
    if parts:
        yield from rows(parts)


def _by_block(packed: DataFrame, n: int, whole: bool) -> DataFrame:
    dealt = packed.repartitionById(n, "block").sortWithinPartitions("block")
    found = dealt.mapInArrow(_judge(n, whole), "block int, docs binary, items binary").repartitionById(n, "block").sortWithinPartitions("block")
    return found.mapInArrow(_gathered, "doc_id long, tag long, places array<binary>")


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tag, places array<binary>) of each document that has a window to remove: where such windows start.

    tag is the CRC-32 of the text; a null id is 2^63 - 1 here.
    """
    slim = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(_NULL))).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(partitions(docs.sparkSession), -(-size // BLOCK_BYTES))
    packed = "block int, docs binary, items binary"
    hits = cut(_by_block(slim.mapInArrow(_probes(n), packed), n, whole=False))
    release(docs.sparkSession)  # the packed probes, before the texts are dealt out
    tagged = slim.withColumn("tag", F.crc32(F.col("text").cast("binary"))).join(hits, ["doc_id", "tag"])
    found = cut(_by_block(tagged.select("doc_id", "text", "places").mapInArrow(_candidates(n), packed), n, whole=True))
    del tagged
    release(docs.sparkSession)
    return found


def removed(n_words: int, places: list[bytes] | None) -> np.ndarray:
    """Which words the windows at these places cover."""
    ends = np.zeros(n_words + 1, np.int64)
    if places:
        at = np.unique(np.concatenate([np.frombuffer(x, "<u4") for x in places])).astype(np.int64)
        ends[at] += 1
        ends[at + WINDOW] -= 1
    return np.cumsum(ends)[:n_words] > 0


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """docs with `text_col` less its repeated passages, and n_words, n_removed long; or, with digest, only (doc_id,
    n_words, n_removed, kept_sha256).

    Words are the runs without [\\x20\\x09-\\x0D], unchanged. Each word covered by a window of 13 words whose words also
    start, in that order, in a document with a smaller id goes; windows are judged on the input. The words that stay are
    joined by one space; a text that loses none keeps its white space, unless digested. Null texts stay null and have no
    words, as empty ones. A null id is larger than any other; rows of one id do not remove each other's words. Texts are
    taken whole (up to 2^32 words). Columns n_words and n_removed that are there already are replaced. No rows give none.

    Windows are compared by 64-bit hashes.
    """
    places = repeated_windows(docs, id_col, text_col).select(*[F.col(c).alias(f"__{c}") for c in ("doc_id", "tag", "places")])
    names = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("__text")) if digest else docs.select(*positional(docs, names), F.col(f"`{text_col}`").cast("string").alias("__text"))
    key = F.coalesce(F.col("doc_id" if digest else f"c{names.index(id_col)}").cast("long"), F.lit(int(_NULL)))
    on = (key == F.col("__doc_id")) & (F.crc32(F.col("__text").cast("binary")) == F.col("__tag"))
    wide = base.join(places, on, "left").drop("__doc_id", "__tag")
    text_at = -1 if digest else names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = as_bytes(batch.column(batch.num_columns - 2)), batch.column(batch.num_columns - 1).to_pylist()
            n_words, n_removed, kept = [], [], []
            for text, at in zip(texts, found, strict=True):
                words = (text or b"").split()
                n_words.append(len(words))
                gone = removed(len(words), at) if at else None
                n_removed.append(int(gone.sum()) if at else 0)
                stay = [w for w, g in zip(words, gone.tolist()) if not g] if at else words
                kept.append(hashlib.sha256(b" ".join(stay)).hexdigest() if digest else b" ".join(stay).decode() if at else text and text.decode())
            counts = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
            if digest:
                yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(kept)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])
            else:
                columns = [pa.array(kept, pa.string()) if i == text_at else batch.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, *counts], names=[*names, "n_words", "n_removed"])

    if digest:
        return wide.select("doc_id", "__text", "__places").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[F.col(f"`{c}`") for c in names]).schema)
    return wide.select(*[f"c{i}" for i in range(len(names))], "__text", "__places").mapInArrow(run, f"{fields}, n_words long, n_removed long")
