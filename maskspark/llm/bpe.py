"""BPE encoding and decoding by a pair occurrence index.

The distinct words that a worker has not met before form one string of symbols. An index maps each pair of
neighbouring symbols to all its positions there; the active ranks are applied in ascending order, each at all its
positions at once, and only the lists that a merge touches are updated. The library of the vocabulary file supplies
the normaliser and the pre-tokeniser and reads the special tokens; the merges are done here.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import accumulate, pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskspark.llm.shared import kept, lean, positional

#: Characters of words, ids and tokens, a constant for each word included, that a worker remembers before it starts afresh:
#: bounds its memory, has no influence on results.
CACHE, _ENTRY = 96 << 20, 256

#: Texts of these characters alone are cut into words here; all others by the library's normaliser and pre-tokeniser.
#: Each of them is its own NFC form and lower-cases to one character.
_PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-ÿ]*")
#: The words of the vocabulary's pre-tokeniser, for lower-cased texts of those characters.
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t\n\r0-9a-zß-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """Latin-1 letters as byte-level vocabularies write them: a printable character for each byte of their UTF-8."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    return {c: "".join(names[b] for b in chr(c).encode()) for c in range(128, 256)}


_LETTERS = _byte_letters()


#: A pair of ids as one integer.
_SHIFT = 20

#: How the vocabulary files that are read here normalise texts and cut them into words.
_NORMAL = [("NFC", None), ("Replace", "\\s+"), ("Lowercase", None)]
_CUTS = [("Split", "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"), ("ByteLevel", None)]


def of_this_make(spec: dict) -> bool:
    """Whether a vocabulary file is one whose words and merges are done here; others are left to the library."""
    steps = lambda part, name: [(x["type"], x.get("pattern", {}).get("Regex")) for x in (part or {}).get(name, [])]
    model = spec["model"]
    plain = not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "ignore_merges", "byte_fallback", "unk_token"))
    marks = [t for t in spec.get("added_tokens", []) if any(t.get(x) for x in ("lstrip", "rstrip", "single_word")) or not t["content"].startswith("<|")]
    same = steps(spec.get("normalizer"), "normalizers") == _NORMAL and steps(spec.get("pre_tokenizer"), "pretokenizers") == _CUTS
    return model["type"] == "BPE" and plain and same and not marks and spec.get("decoder") is None and len(model["vocab"]) < 1 << _SHIFT


class PairIndex:
    """Merges of a vocabulary, applied to many words together."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        self.vocab, self.suffix = vocab, suffix
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in merges]
        self.ranks = {vocab[a] << _SHIFT | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}

    def encode(self, words: list[str]) -> list[list[int]]:
        """The ids of each word; characters that the vocabulary lacks give no id, as there is no unknown token."""
        symbols: list[int] = []
        bounds = [0]
        get, suffix = self.vocab.get, self.suffix
        for word in words:
            if word:
                symbols.extend(map(get, word[:-1], repeat(-2)))
                symbols.append(get(word[-1] + suffix, -2))
            symbols.append(-1)  # no pair reaches over the end of a word
            bounds.append(len(symbols))
        if -2 in symbols:
            ends = [len([x for x in symbols[s:e] if x != -2]) for s, e in pairwise(bounds)]
            symbols, bounds = [x for x in symbols if x != -2], [0, *accumulate(ends)]
        index = self._index(symbols)
        ranks, n = self.ranks, len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        active = [(*ranks[pair], pair) for pair in index]
        heapq.heapify(active)
        while active:
            _, merged, pair = heapq.heappop(active)
            a, b = pair >> _SHIFT, pair & (1 << _SHIFT) - 1
            for i in sorted(index.pop(pair)):
                j = after[i]
                if symbols[i] != a or symbols[j] != b:
                    continue  # an earlier merge has taken one of the two
                symbols[i], symbols[j] = merged, -2
                k = after[i] = after[j]
                before[k], h = i, before[i]
                for at, left, right in ((h, symbols[h], merged), (i, merged, symbols[k])):
                    if left >= 0 and right >= 0 and (new := left << _SHIFT | right) in ranks:
                        if new not in index:
                            index[new] = []
                            heapq.heappush(active, (*ranks[new], new))
                        index[new].append(at)
        return [[x for x in symbols[s : e - 1] if x >= 0] for s, e in pairwise(bounds)]

    def _index(self, symbols: list[int]) -> dict[int, list[int]]:
        """All positions of each pair that has a rank."""
        x = np.array(symbols, np.int64)
        at = np.flatnonzero((x[:-1] >= 0) & (x[1:] >= 0)) if len(x) else np.empty(0, np.int64)
        pairs = x[at] << _SHIFT | x[at + 1] if len(at) else at
        order = np.argsort(pairs, kind="stable")
        pairs, at = pairs[order], at[order]
        starts = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]) if len(at) else at
        return {p: at[s:e].tolist() for p, s, e in zip(pairs[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(at)]) if p in self.ranks}


class Codec:
    """One vocabulary file, in one worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        gc.freeze()  # what follows is long-lived and has no cycles
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.own = of_this_make(spec)
        self.pairs = PairIndex(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "") if self.own else None
        self.pieces = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()} if self.own else {}
        self.held = 0
        # by word: ids in decimal and pieces, each joined by a space
        self.written: dict[str, str] = {}
        self.read: dict[str, str] = {}
        gc.freeze()
        gc.set_threshold(200_000, 50, 100)

    def cut(self, text: str | None) -> list[str]:
        """The words of a text, as normaliser and pre-tokeniser give them; special tokens stand as they are.

        With a file of another make, the whole text.
        """
        if not text:
            return []
        if not self.own:
            return [text]
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return _WORDS.findall(text.lower())
        out: list[str] = []
        for i, part in enumerate(self.pattern.split(text) if self.pattern else [text]):
            if i % 2:
                out.append(part)
            elif part:
                normal = self.library.normalizer.normalize_str(part) if self.library.normalizer else part
                out += ["\0" + w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return out

    def learn(self, words: set[str]) -> None:
        """Encodes the words that were not met before, all in one go."""
        if self.held > CACHE:
            self.written.clear(), self.read.clear()
            self.held = 0
        new = [w for w in words if w not in self.written]
        if self.own:
            # "\0" marks a word that is in byte letters already
            found = self.pairs.encode([w[1:] if w[0] == "\0" else w if w.isascii() else w.translate(_LETTERS) for w in new])
            found = [[self.special[w]] if w in self.special else ids for w, ids in zip(new, found, strict=True)]
        else:
            found = [x.ids for x in self.library.encode_batch(new, add_special_tokens=False)]
        for w, ids in zip(new, found, strict=True):
            self.written[w] = " ".join(map(str, ids))
            self.read[w] = self.decode(ids)
            self.held += _ENTRY + len(w) + len(self.written[w]) + len(self.read[w])

    def ids(self, words: list[str]) -> np.ndarray:
        """The ids of a text of these words, all of them learned."""
        written = " ".join(filter(None, map(self.written.__getitem__, words)))
        return np.array(written.split(" ") if written else [], np.int32)

    def text(self, words: list[str]) -> str:
        """What the ids of a text of these words decode to, all of them learned."""
        return " ".join(filter(None, map(self.read.__getitem__, words)))

    def decode(self, ids: list[int]) -> str:
        """As a vocabulary without a decoder of its own reads: tokens joined by a space; ids that it lacks are left out."""
        if not self.own:
            return self.library.decode(ids, skip_special_tokens=False)
        return " ".join([self.pieces[i] for i in ids if i in self.pieces])


_codecs: dict[str, Codec] = kept("bpe")


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _by_text(batches: Iterator[pa.RecordBatch], own: Codec) -> Iterator[tuple[pa.RecordBatch, list[list[str]]]]:
    """Batches of rows with the words of each text (the last column), all of them learned."""
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        for at in range(0, batch.num_rows, 256):
            cuts = [own.cut(t) for t in texts.slice(at, 256).to_pylist()]
            own.learn(set().union(*cuts))
            yield batch.slice(at, 256), cuts


def _ids(own: Codec, cuts: list[list[str]]) -> pa.Array:
    ids = [own.ids(words) for words in cuts]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)], dtype=np.int32)), pa.array(np.concatenate(ids)))


def _fields(docs: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.select(*[F.col(f"`{c}`") for c in names]).schema)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """docs with `out_col` array<int>: the ids of each whole text, as the library encodes without special tokens of its own.

    Null texts give an empty list, as empty ones do; special tokens written in a text become their ids, as in the
    library; texts of any length are taken whole; equal rows give equal results; a column `out_col` that is there
    already is replaced; other columns pass through. No rows give no rows.
    """
    path = path or default_path()
    names = [c for c in docs.columns if c != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for rows, cuts in _by_text(batches, own):
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], _ids(own, cuts)], names=[*names, out_col])

    wide = docs.select(*positional(docs, names), F.col(f"`{text_col}`").cast("string").alias("text"))
    return wide.mapInArrow(lean(run, "bpe"), f"{_fields(docs, names)}, `{out_col}` array<int>")


def decode(encoded: DataFrame, path: str | None = None, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded with `out_col`: the text of each list of ids, special tokens kept.

    Null lists give null, empty ones an empty text; null ids and ids that the vocabulary lacks are left out, as in the
    library; a column `out_col` that is there already is replaced; other columns pass through. No rows give no rows.
    """
    path = path or default_path()
    names = [c for c in encoded.columns if c != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):  # ids as Python numbers take ten times their room
                rows = batch.slice(at, 128)
                texts = [None if ids is None else own.decode([i for i in ids if i is not None]) for ids in rows.column(rows.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(texts, pa.string())], names=[*names, out_col])

    wide = encoded.select(*positional(encoded, names), F.col(f"`{ids_col}`").alias("ids"))
    return wide.mapInArrow(lean(run, "bpe"), f"{_fields(encoded, names)}, `{out_col}` string")


def round_trip(docs: DataFrame, path: str | None = None, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """docs with the ids of each whole text in place of the text, and what they decode to: encode() and decode() in one pass.

    Nulls, special tokens, repeated rows and columns of the same names are as in these two; a null text gives an empty list
    and an empty text. No rows give no rows.
    """
    path = path or default_path()
    names = [c for c in docs.columns if c not in (text_col, ids_col, out_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for rows, cuts in _by_text(batches, own):
            texts = pa.array([own.text(words) for words in cuts], pa.string())
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], _ids(own, cuts), texts], names=[*names, ids_col, out_col])

    wide = docs.select(*positional(docs, names), F.col(f"`{text_col}`").cast("string").alias("text"))
    return wide.mapInArrow(lean(run, "bpe"), f"{_fields(docs, names)}, `{ids_col}` array<int>, `{out_col}` string" if names else f"`{ids_col}` array<int>, `{out_col}` string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, from the same encoding and decoding."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for rows, cuts in _by_text(batches, own):
            counts, ids, texts = [], [], []
            for words in cuts:
                written = " ".join(filter(None, map(own.written.__getitem__, words)))
                counts.append(written.count(" ") + 1 if written else 0)
                ids.append(hashlib.sha256(written.encode()).hexdigest())
                texts.append(hashlib.sha256(own.text(words).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(counts, pa.int64()), pa.array(ids), pa.array(texts)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(lean(run, "bpe"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
