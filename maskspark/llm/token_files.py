"""Token ids in a binary file format of patched frame-of-reference blocks.

A part (one row of the written table, its bytes in column `payload`) holds whole documents in ascending order of id:

    magic "PFR2", then as little-endian u32: documents D, ids N, blocks B, bytes of the exception area
    D times doc_id as i64, D times a null flag as u8, D times the number of ids as u32
    B times a block's place in the data area as u32, its place in the exception area as u32, its minimum as u32, its
    width as u8 and its number of exceptions as u16: the block index
    data area: for each block its BLOCK values less the minimum, the low `width` bits of each, packed
    exception area: for each block the places of its exceptions as u16, then their high bits as u32

The width is chosen where PERCENTILE of a block's values fit; the few that don't are exceptions. By the block index any
block can be read without those before it.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskspark.llm.shared import checkpoint_dir, partitions

BLOCK = 1024
PERCENTILE = 0.9
#: Id appended to each document.
END = 2
#: Ids after which a part is closed, at the end of a document.
PART = 1 << 20
_MAGIC = b"PFR2"


def _packed(values: np.ndarray, width: int) -> bytes:
    """The low `width` bits of each value, one after the other."""
    if not width or not len(values):
        return b""
    bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def _unpacked(data: bytes, n: int, width: int) -> np.ndarray:
    if not width or not n:
        return np.zeros(n, np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    full = np.zeros((n, 32), np.uint8)
    full[:, :width] = bits
    return np.packbits(full, axis=1, bitorder="little").view("<u4").ravel()


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


_BLOCK = np.dtype([("data", "<u4"), ("patch", "<u4"), ("low", "<u4"), ("width", "u1"), ("exceptions", "<u2")])


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, bytes, bytes]:
    """Block index, data area and exception area of an array of ids."""
    index, data, patches, at_data, at_patch = [], [], [], 0, 0
    for at in range(0, len(ids), BLOCK):
        block = ids[at : at + BLOCK].astype(np.uint32)
        low = block.min()
        rest = block - low
        bits = _widths(rest)
        width = int(np.sort(bits)[min(len(bits) - 1, int(np.ceil(PERCENTILE * len(bits))) - 1)])
        out = np.flatnonzero(bits > width)
        index.append((at_data, at_patch, low, width, len(out)))
        data.append(_packed(rest, width))
        patches.append(out.astype("<u2").tobytes() + (rest[out] >> np.uint32(width)).astype("<u4").tobytes())
        at_data, at_patch = at_data + len(data[-1]), at_patch + len(patches[-1])
    return np.array(index, _BLOCK), b"".join(data), b"".join(patches)


def write_part(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    every = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    index, data, patches = encode_blocks(every)
    return b"".join([
        _MAGIC, np.array([len(ids), len(every), len(index), len(patches)], "<u4").tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(),
        np.array([len(x) for x in ids], "<u4").tobytes(), index.tobytes(), data, patches,
    ])


class Part:
    """A part of token ids, its documents and block index read; blocks are read as they are asked for."""

    def __init__(self, payload: bytes):
        if payload[:4] != _MAGIC:
            raise ValueError("no part of token ids")
        docs, self.total, blocks, patched = np.frombuffer(payload, "<u4", 4, 4).tolist()
        names, null = np.frombuffer(payload, "<i8", docs, 20), np.frombuffer(payload, "u1", docs, 20 + 8 * docs)
        self.doc_ids = [None if x else int(d) for d, x in zip(names, null)]
        self.counts = np.frombuffer(payload, "<u4", docs, 20 + 9 * docs)
        self.index = np.frombuffer(payload, _BLOCK, blocks, 20 + 13 * docs)
        self.payload, self.data, self.patch = payload, 20 + 13 * docs + blocks * _BLOCK.itemsize, len(payload) - patched

    def block(self, b: int) -> np.ndarray:
        """The ids of block b, read by the index alone."""
        head, n = self.index[b], min(BLOCK, self.total - b * BLOCK)
        width, e = int(head["width"]), int(head["exceptions"])
        start = self.data + int(head["data"])
        values = _unpacked(self.payload[start : start + (n * width + 7) // 8], n, width)
        if e:
            at = self.patch + int(head["patch"])
            values[np.frombuffer(self.payload, "<u2", e, at)] |= np.frombuffer(self.payload, "<u4", e, at + 2 * e) << np.uint32(width)
        return values + head["low"]

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids from place `start` to before place `end` of the part."""
        first = start // BLOCK
        found = [self.block(b) for b in range(first, -(-end // BLOCK))] if end > start else []
        return np.concatenate(found)[start - first * BLOCK : end - first * BLOCK] if found else np.empty(0, np.uint32)

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        start = int(self.counts[:k].sum(dtype=np.int64))
        return self.ids(start, start + int(self.counts[k]))


def read_part(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, numbers of ids, and all ids of a part."""
    part = Part(payload)
    return part.doc_ids, part.counts, part.ids(0, part.total)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Distinct pieces of text that a worker remembers before it starts afresh.
CACHE = 600_000
#: Bytes of texts that are cut into pieces together, one text at least.
SLICE = 4 << 20
_libraries: dict[str, object] = {}


def _library(path: str):
    if path not in _libraries:
        from tokenizers import Tokenizer

        _libraries[path] = Tokenizer.from_file(path)
        _libraries[path].no_truncation()
        _libraries[path].no_padding()
    return _libraries[path]


#: Kinds of bytes in texts that are cut into pieces here: letters (of Latin-1, in UTF-8), digits, other signs, space, and what
#: the library cuts.
_LETTER, _DIGIT, _SIGN, _SPACE, _FOREIGN = range(5)
_KINDS = np.full(256, _FOREIGN, np.uint8)
_KINDS[33:127] = _SIGN
_KINDS[[9, 10, 13, 32]] = _SPACE
_KINDS[48:58] = _DIGIT
_KINDS[65:91] = _KINDS[97:123] = _KINDS[128:192] = _KINDS[0xC3] = _LETTER
#: Other texts are cut only before a space that follows a printable character.
_CUT = re.compile("(?<=[!-~À-ÖØ-öø-ÿ])(?= )")


def _byte_letters() -> dict[int, str]:
    """Bytes as byte-level vocabularies write them, a printable character for each."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}


_LETTERS = _byte_letters()
_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One a worker, which keeps its pieces from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (without nulls), one after the other, and their bounds there."""
    texts = texts.cast(pa.large_binary())
    _, bounds, data = texts.buffers()
    bounds = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.empty(0, np.uint8)
    return data, bounds - bounds[0]


def _foreign(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which of the texts have a character that is not cut here, or may have a special token (also one that begins where the text before ends)."""
    bad = _KINDS[data] == _FOREIGN
    # multiplication and division signs are no letters
    bad[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    bad[1:] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
    out = np.zeros(len(bounds) - 1, bool)
    out[np.searchsorted(bounds, np.flatnonzero(bad), side="right") - 1] = True
    return out


def _piece_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the pieces of the byte-level pattern start: 's|'t|'re|'ve|'m|'ll|'d| ?letters| ?digits| ?signs|spaces(?!other)|spaces."""
    kinds = _KINDS[data]
    firsts = np.unique(bounds[:-1][bounds[:-1] < bounds[1:]])
    starts = np.empty(len(data), bool)
    starts[:1] = True
    np.not_equal(kinds[1:], kinds[:-1], out=starts[1:])
    space = kinds == _SPACE
    # the last of the spaces before another character of the same text starts a piece, which goes on after U+0020
    last = space[:-1] > space[1:]
    last[firsts[1:] - 1] = False
    starts[:-1] |= last
    starts[1:] &= ~(last & (data[:-1] == 32))
    starts[firsts] = True
    marks = np.flatnonzero(data == ord("'"))
    if len(marks):
        first = np.ones(len(data) + 3, bool)  # of a text, or past the end
        first[: len(data)] = False
        first[firsts] = True
        after = np.r_[data, np.zeros(3, np.uint8)]
        marks = marks[starts[marks] & ~first[marks + 1]]
        one, two = after[marks + 1], after[marks + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ~first[marks + 2] & ((np.isin(one, np.frombuffer(b"rv", np.uint8)) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        starts[marks[short | long] + 1] = False
        ends = np.r_[marks[short] + 2, marks[long] + 3]
        starts[ends[ends < len(data)]] = True
    return np.flatnonzero(starts)


class Encoder:
    """The library's encoding of whole texts; pieces that it always encodes alike are encoded once.

    The library merges within the pieces of the byte-level pattern only; no piece goes over the border between a
    printable ASCII character or a Latin-1 letter and a space. A vocabulary file of another make is left to the library.
    """

    def __init__(self, path: str):
        self.library, self.known = _library(path), {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cutter, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.by_piece = (
            model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback", "unk_token"))
            and spec.get("normalizer") is None and cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex", True)
            and all(t.startswith("<|") and " " not in t for t in self.specials) and not any(t.get(x) for t in spec.get("added_tokens", []) for x in ("lstrip", "rstrip", "single_word"))
        )

    def _by_pieces(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of texts without foreign characters: each distinct piece of them is looked up once, and merged where it is new."""
        starts = _piece_starts(data, bounds)
        every = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.r_[starts, len(data)]), pa.py_buffer(data)]).dictionary_encode()
        merged, known, found = self.library.model.tokenize, self.known, []
        for piece in every.dictionary.to_numpy(zero_copy_only=False).tolist():
            ids = known.get(piece)
            if ids is None:
                word = piece.decode("latin-1")
                # of a piece that ends in a printable character, only U+0020 in front is written otherwise
                word = word.replace(" ", _LETTERS[32]) if word[-1] > " " and word.isascii() else word.translate(_LETTERS)
                ids = known[piece] = array("I", [token.id for token in merged(word)]).tobytes()
            found.append(ids)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        which = every.indices.to_numpy()
        counts = sizes[which]
        ends = np.cumsum(np.r_[0, counts])
        places = np.repeat((np.cumsum(sizes) - sizes)[which] - ends[:-1], counts) + np.arange(ends[-1])
        return np.frombuffer(b"".join(found), np.uint32)[places], np.diff(ends[np.searchsorted(starts, bounds)])

    def _by_library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of any texts: in runs of pieces, or as wholes where the vocabulary file is of another make."""
        if self.by_piece:
            cuts, known = [_CUT.split(t) for t in texts], self.known
            rest = [p for p in set().union(*cuts) if p.encode() not in known]
            for piece, found in zip(rest, self.library.encode_batch(rest, add_special_tokens=False)):
                known[piece.encode()] = array("I", found.ids).tobytes()
            ids = [b"".join([known[p.encode()] for p in c]) for c in cuts]
        else:
            ids = [array("I", found.ids).tobytes() for found in self.library.encode_batch(texts, add_special_tokens=False)]
        return np.frombuffer(b"".join(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)) // 4

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the number of each; of a null none. Texts that are no UTF-8 are an error."""
        if len(self.known) > CACHE:
            self.known.clear()
        texts = texts.fill_null("")
        texts.validate(full=True)
        data, bounds = _joined(texts)
        foreign = _foreign(data, bounds) if self.by_piece else np.ones(len(texts), bool)
        if not foreign.any():
            return self._by_pieces(data, bounds)
        ids, counts = self._by_library(texts.filter(pa.array(foreign)).to_pylist())
        if foreign.all():
            return ids, counts
        more, sizes = self._by_pieces(*_joined(texts.filter(pa.array(~foreign))))
        every = np.empty(len(texts), np.int64)
        every[foreign], every[~foreign] = counts, sizes
        out, own = np.empty(len(ids) + len(more), np.uint32), np.repeat(foreign, every)
        out[own], out[~own] = ids, more
        return out, every

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian u32 ids of each text."""
        ids, counts = self.column(pa.array(texts, pa.large_string()))
        raw, ends = ids.astype("<u4").tobytes(), np.cumsum(counts)
        return [raw[4 * s : 4 * e] for s, e in zip((ends - counts).tolist(), ends.tolist())]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """First row of each slice, and the number of its rows."""
    sizes = np.cumsum(np.r_[0, pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)])
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + SLICE, side="right")) - 1)
        yield at, end - at
        at = end


def _written(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, names, ids, held, place, seq = encoder(path), [], [], 0, None, 0

        def part() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([place], pa.int32()), pa.array([seq], pa.int32()), pa.array([held], pa.int64()), pa.array([write_part(names, ids)], pa.binary())],
                names=["place", "seq", "n_ids", "payload"],
            )

        for batch in batches:
            for at, n in _slices(batch.column(2)):
                rows = batch.slice(at, n)
                found, counts = own.column(rows.column(2))
                found = np.insert(found, np.cumsum(counts), END)
                ends = np.cumsum(counts + 1).tolist()
                for p, name, s, e in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), [0, *ends], ends):
                    if names and (p != place or held >= PART):
                        yield part()
                        names, ids, held, seq = [], [], 0, seq + 1
                    place = p
                    names.append(name)
                    ids.append(found[s:e])
                    held += e - s
        if names:
            yield part()

    return run


def write(docs: DataFrame, to: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes each whole text, appends END, and writes parts of ids to the folder `to`, in ascending order of id.

    Null texts are encoded as empty ones; rows without an id come first, dealt over a place a batch of them; rows of one id
    stay together in any order; texts of any length are taken whole, a part holds one at least. Other columns are not read.
    No rows write no part. Ranges of ids come from approximate quantiles of the id column; texts move once to their range.
    """
    path = path or default_path()
    n = partitions(docs.sparkSession)
    ids = F.col(id_col).cast("long")
    bounds = docs.select(F.percentile_approx(ids, [i / n for i in range(1, n)] if n > 1 else [0.5], 10_000)).first()[0] or []
    bounds = np.array(sorted(set(bounds)), np.int64)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0)
            place = np.searchsorted(bounds, own.fill_null(0).to_numpy(zero_copy_only=False), side="left").astype(np.int32) + n
            null = own.is_null().to_numpy(zero_copy_only=False)
            place[null] = np.arange(int(null.sum())) % n
            yield pa.RecordBatch.from_arrays([pa.array(place), *batch.columns], names=["place", "doc_id", "text"])

    slim = docs.select(ids.alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sent = slim.mapInArrow(placed, "place int, doc_id long, text string")
    # places below n have the rows without an id, the others the ranges of ids
    ordered = sent.repartitionById(n + len(bounds) + 1, "place").sortWithinPartitions("place", "doc_id")
    ordered.mapInArrow(_written(path), "place int, seq int, n_ids long, payload binary").write.mode("error").parquet(to)


def parts(spark: SparkSession, folder: str) -> DataFrame:
    """The parts of a folder (place, seq, n_ids, payload)."""
    return spark.read.schema("place int, seq int, n_ids long, payload binary").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files: the ids before it, its own, their CRC-32.

    Where a part starts is the sum of what the places before it hold, a row a place, and of what its own place holds before
    it, found within the place. No parts give no rows.
    """
    found = parts(spark, folder)
    sizes = found.select("place", "seq", "n_ids")
    totals = sizes.groupBy("place").agg(F.sum("n_ids").alias("held"))
    before = totals.select("place", (F.sum("held").over(Window.orderBy("place")) - F.col("held")).alias("before"))  # a row a place
    within = F.sum("n_ids").over(Window.partitionBy("place").orderBy("seq")) - F.col("n_ids")
    starts = sizes.withColumn("within", within).join(before, "place").select("place", "seq", (F.col("before") + F.col("within")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, seq, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                names, counts, ids = read_part(payload.as_py())
                ends = np.cumsum(counts, dtype=np.int64)
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(names), place, np.int32)), pa.array(np.full(len(names), seq, np.int32)), pa.array(names, pa.int64()),
                     pa.array(ends - counts), pa.array(counts.astype(np.int64)), pa.array(crcs, pa.int64())],
                    names=["place", "seq", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    rows = found.select("place", "seq", "payload").mapInArrow(run, "place int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["place", "seq"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def new_folder(spark: SparkSession) -> str:
    """A folder of its own under the shared checkpoint folder."""
    import uuid

    checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tokens-{uuid.uuid4()}"
