"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

The incidence matrix is held as rows (n-gram, document class); equal sets are one class. Bounds derived from the sizes keep
the product small without losing a pair of similarity `t` or more:

1. Two sets with |x & y| >= t * |x | y| have at least need(n) = ceil(t * n) common elements. In any fixed order of all
   n-grams the first k + 1 common ones lie among the first n - need(n) + k + 1 of either set; only these columns are
   multiplied, with k = n // 5. The order is that of hashes, with the most frequent n-grams last.
2. Of its columns there, a document must share more than need(n) // 5 with other documents. Those that don't go.
   Those that do may leave out need(n) // 5 columns, the most frequent ones: a common column remains for each pair.
3. Linked sets differ in (1 - t) / (1 + t) * (|x| + |y|) elements at most. Each set has a parity sketch: bit b tells
   whether an odd number of elements hash to b. Sketches differ in no more bits than sets in elements. A sketch has twice
   as many bits as the set has elements, or more; its halves added up are the sketch of half the bits.

What is left of the matrix is multiplied by blocks. A block holds the whole rows of some documents that share a column;
overlap counts of its documents are accumulated over its n-grams, some thousand columns at a time, and pairs below the bound
are discarded there. No pair leaves a block: what comes out is a star for each group that it links. In two first rounds each
document is in one block, that of its column with the smallest hash, so a family of near copies becomes one component at the
cost of two rows a document. In the last round every column is a block of the documents that are still in different
components; those whose sketches allow a link across components are multiplied, a pair in the first of the columns that it
shares. Each row has the first few columns of its document with it, so a block sees by itself which of its pairs have met
before, and sends on rows, never pairs: not more than it was given. So no link between different groups is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskspark.llm.components import components, roots
from maskspark.llm.shared import as_bytes, cut, lean, partitions, signed, unused, windows

#: Similarity as a fraction, and words in a shingle.
THRESHOLD = (80, 100)
WIDTH = 5
#: An n-gram counts as frequent that one in so many documents has; the order has the MOST_HOT most frequent ones last.
HOT = 512
MOST_HOT = 1 << 18
#: Documents whose n-grams are counted together to find the frequent ones.
_COUNTED = 8 * HOT
#: Tasks over which the rows of a frequent n-gram are dealt.
SALT = 64
#: A block has this many documents at most, or elements if they are long.
BLOCK_ROWS, BLOCK_ELEMENTS = 4096, 4 << 20
#: Bits of the shortest sketch.
PARITY = 256


def need(n, t: tuple[int, int] = THRESHOLD):
    """Fewest common elements of a set of n elements with any set it links to."""
    return -(-t[0] * n // t[1])


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; of fewer words than `width`, the whole sequence is the one."""
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    found = np.sort(windows(hashes, min(width, len(words))) + np.uint64(min(width, len(words)) % width))
    return found[np.r_[True, found[1:] != found[:-1]]]


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, list[np.ndarray], np.ndarray]]:
    """Document ids, sets and 64-bit digests of the sets of each batch of (doc_id, text)."""
    for batch in batches:
        sets = [shingle_set((t or b"").lower().split(), width) for t in as_bytes(batch.column(1))]
        yield batch.column(0), sets, np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64)


def parity(elements: np.ndarray) -> np.ndarray:
    """The parity sketch of a set as 64-bit words."""
    bits = PARITY
    while bits < 2 * len(elements):
        bits *= 2
    odd = np.bincount((elements % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.uint64)


class Sketches:
    """Sketches of many sets, compared in pairs."""

    def __init__(self, sketches: list[np.ndarray]):
        self.width = np.array([len(x) for x in sketches])
        # by width: the sketches of that width, and those of the double width added up; and where each stands
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w in np.unique(self.width).tolist():
            for width in (w, w // 2):
                own = np.flatnonzero((self.width == width) | (self.width == 2 * width))
                at = np.full(len(sketches), -1)
                at[own] = np.arange(len(own))
                self.of[width] = at, np.array([sketches[k] if len(sketches[k]) == width else sketches[k][:width] ^ sketches[k][width:] for k in own.tolist()])

    def bits(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many bits sketches i and j differ, at the width of the shorter; no width may be over twice the other."""
        out, width = np.zeros(len(i), np.int64), np.minimum(self.width[i], self.width[j])
        for w in np.unique(width).tolist():
            own, (at, rows) = width == w, self.of[w]
            out[own] = np.bitwise_count(rows[at[i[own]]] ^ rows[at[j[own]]]).sum(axis=1, dtype=np.int64)
        return out


_CLASS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("tok", pa.int64())])


def _classes(width: int):
    """(doc_id, n, cls, null) of each document; (null, count, null, tok) of n-grams that are frequent among documents here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def frequent() -> pa.RecordBatch:
            toks, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= max(8, len(held) // HOT)
            n = int(often.sum())
            return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(counts[often]), pa.nulls(n, pa.int64()), pa.array(signed(toks[often]))], schema=_CLASS)

        for ids, sets, digests in _sets(batches, width):
            n = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(signed(digests), mask=n == 0), pa.nulls(len(n), pa.int64())], schema=_CLASS)
            held += sets
            if len(held) >= _COUNTED:
                yield frequent()
                held = []
        if held:
            yield frequent()

    return run


def first_columns(elements: np.ndarray, hot: np.ndarray, rank: np.ndarray, t: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The columns of a sorted set by bound 1, and the rank of each among the frequent ones (sorted `hot`), 0 if it is none."""
    n = len(elements)
    keep = n - need(n, t) + n // 5 + 1
    if not len(hot):
        return elements[:keep], np.zeros(min(n, keep), np.int32)
    at = np.searchsorted(hot, elements)
    at[at == len(hot)] = 0
    ranks = np.where(hot[at] == elements, rank[at], 0)
    order = np.argsort(ranks, kind="stable")[:keep]
    return elements[order], ranks[order].astype(np.int32)


def _columns(width: int, t: tuple[int, int], hot: np.ndarray, rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a class is sent once by a task, or a few times if there are very many, however many copies it has
        for _, sets, digests in _sets(batches, width):
            if len(seen) > 1_000_000:
                seen.clear()
            new = []
            for i, d in enumerate(digests.tolist()):
                if len(sets[i]) and d not in seen:
                    seen.add(d)
                    new.append(i)
            if not new:
                continue
            first = [first_columns(sets[i], hot, rank, t) for i in new]
            counts = [len(x) for x, _ in first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(np.concatenate([x for x, _ in first]))), pa.array(signed(np.repeat(digests[new], counts))),
                 pa.array(np.repeat([len(sets[i]) for i in new], counts).astype(np.int32)), pa.array(np.concatenate([r for _, r in first]))],
                names=["tok", "cls", "n", "hot"],
            )

    return run


def _whole(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets, digests in _sets(batches, width):
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(digests)), pa.array([parity(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["cls", "sketch", "elements"],
            )

    return run


def overlaps(x: list[np.ndarray], y: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Overlap counts of the sets x by the sets y, accumulated over blocks of columns."""
    total = np.zeros((len(x), len(y)), np.float32)
    both = np.intersect1d(np.concatenate(x), np.concatenate(y))

    def entries(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of ones, by column."""
        elements, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(both, elements)
        at[at == len(both)] = 0
        ok = both[at] == elements
        order = np.argsort(at[ok], kind="stable")
        return row[ok][order], at[ok][order]

    if not len(both):
        return total.astype(np.int64)
    (x_row, x_at), (y_row, y_at) = entries(x), entries(y)
    for start in range(0, len(both), columns):
        factors = []
        for row, at, n in ((x_row, x_at, len(x)), (y_row, y_at, len(y))):
            s, e = np.searchsorted(at, [start, start + columns])
            dense = np.zeros((n, min(columns, len(both) - start)), np.float32)
            dense[row[s:e], at[s:e] - start] = 1
            factors.append(dense)
        total += factors[0] @ factors[1].T
    return total.astype(np.int64)  # exact: counts are far below 2^24


def linked(x: list[np.ndarray], y: list[np.ndarray], t: tuple[int, int]) -> np.ndarray:
    """Which sets x link to which sets y."""
    n, m = np.array([len(s) for s in x])[:, None], np.array([len(s) for s in y])[None, :]
    both = overlaps(x, y)
    return t[1] * both >= t[0] * (n + m - both)


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _stars(cls: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """The links i, j between classes cls as stars."""
    root = roots(i, j, len(cls))
    far = root != np.arange(len(cls))
    return pa.RecordBatch.from_arrays([pa.array(cls[root[far]]), pa.array(cls[far])], schema=_EDGE)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Whole blocks: of rows sorted by their first `keys` columns, those with equal keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(keys)]
        starts = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)]).tolist()
        for s, e in zip(starts, [*starts[1:], batch.num_rows]):
            own = tuple(c[s] for c in columns)
            if own != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = own
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _elements(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in table.column("elements").to_pylist()]


def _families(t: tuple[int, int], rows: int = 256):
    """Over blocks of (tok, salt, cls, elements): links of documents with those of the same slice and with what slices before it left.

    Of each slice that document of each group goes on which links to most here, of at most as many groups as a slice has rows:
    what is missed here the last round finds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _runs(batches, 2):
            if len(block) < 2:
                continue
            on_cls, on = np.empty(0, np.int64), []
            for at in range(0, len(block), rows):
                part = block.slice(at, rows)
                sets = on + _elements(part)
                cls = np.r_[on_cls, part.column("cls").to_numpy()]
                i, j = np.nonzero(linked(sets[len(on) :], sets, t))
                yield _stars(cls, i + len(on), j)
                root, links = roots(i + len(on), j, len(cls)), np.bincount(np.r_[i + len(on), j], minlength=len(cls))
                by = np.lexsort([-links, root])
                most = by[np.unique(root[by], return_index=True)[1]][:rows]
                on_cls, on = cls[most], [sets[k] for k in most.tolist()]

    return run


_FLAG = pa.schema([("tok", pa.int64()), ("block", pa.int32()), ("side", pa.int32()), ("cls", pa.int64()), ("comp", pa.int64())])
#: Blocks up to this size are gone through many at a time; pairs of rows looked at together.
_SMALL, _PAIRS = 32, 1 << 18
#: So many columns of its document, the first by hash, a row has with it.
FIRST = 16
#: Of a block with more pairs than so many a row, the rows go on without a look at where else the pairs meet.
DENSE = 16


def _flagged(t: tuple[int, int]):
    """Over blocks of (tok, block, side, cls, comp, n, sketch, first): the rows with a pair to be multiplied here.

    That is one across components whose sketches allow a link, and which none of the columns before this one has shown to share.
    """

    def judged(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        ends = np.r_[starts[1:], len(table)]
        side, comp, n = (table.column(c).to_numpy() for c in ("side", "comp", "n"))
        n = n.astype(np.int64)
        before = np.zeros((len(table), FIRST), np.int64)
        ok = np.arange(FIRST) < pc.list_value_length(table.column("first")).to_numpy()[:, None]
        before[ok] = pc.list_flatten(table.column("first")).to_numpy()
        ok &= ~np.logical_or.accumulate(ok & (before == table.column("tok").to_numpy()[:, None]), axis=1)  # those before the row's own
        sketches = Sketches([np.frombuffer(x, np.uint64) for x in table.column("sketch").to_pylist()])
        sizes = ends - starts
        two = np.repeat(np.minimum.reduceat(side, starts) != np.maximum.reduceat(side, starts), sizes)  # of two sides: those of one meet in its own block

        def look(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            ok = (comp[i] != comp[j]) & ~(two[i] & (side[i] == side[j])) & (np.minimum(n[i], n[j]) * t[1] >= np.maximum(n[i], n[j]) * t[0])
            i, j = i[ok], j[ok]
            ok = sketches.bits(i, j) * (t[0] + t[1]) <= (n[i] + n[j]) * (t[1] - t[0])
            return np.stack([i[ok], j[ok]])

        def new(pairs: np.ndarray) -> np.ndarray:
            """Those of the pairs that share no column before this one, as far as the rows tell."""
            met = np.zeros(pairs.shape[1], bool)
            for s in range(0, len(met), _PAIRS // FIRST**2):
                i, j = pairs[:, s : s + _PAIRS // FIRST**2]
                same = before[i][:, :, None] == before[j][:, None, :]
                met[s : s + len(i)] = (same & ok[i][:, :, None] & ok[j][:, None, :]).any(axis=(1, 2))
            return pairs[:, ~met]

        flag = np.zeros(len(table), bool)
        after = np.maximum(np.repeat(np.where(sizes <= _SMALL, ends, 0), sizes) - np.arange(len(table)) - 1, 0)
        step = _PAIRS // _SMALL
        for s in range(0, len(table), step):  # all pairs of the small blocks
            own = after[s : s + step]
            i = np.repeat(np.arange(s, s + len(own)), own)
            flag[new(look(i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own)))] = True
        for s, e in zip(starts[sizes > _SMALL].tolist(), ends[sizes > _SMALL].tolist()):
            _, of, counts = np.unique(comp[s:e], return_inverse=True, return_counts=True)
            few = np.flatnonzero(of != counts.argmax()) + s  # a pair across components has one of these
            step = max(1, _PAIRS // (e - s))
            pairs, some, many = [], np.zeros(e - s, bool), 0
            for at in range(0, len(few), step):
                own = few[at : at + step]
                x = look(np.repeat(own, e - s), np.tile(np.arange(s, e), len(own)))
                some[x.ravel() - s] = True
                many += x.shape[1]
                pairs = [*pairs, x] if many <= DENSE * (e - s) else []
            if many > DENSE * (e - s):
                flag[s:e] = some
            else:
                for x in pairs:
                    flag[new(x)] = True
        return pa.RecordBatch.from_arrays([pa.array(table.column(f.name).to_numpy()[flag], f.type) for f in _FLAG], schema=_FLAG)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if not len(table):
                continue
            tok, block = table.column("tok").to_numpy(), table.column("block").to_numpy()
            starts = np.flatnonzero(np.r_[True, (tok[1:] != tok[:-1]) | (block[1:] != block[:-1])])
            whole = int(starts[-1])
            rest = table.slice(whole)
            if whole:
                yield judged(table.slice(0, whole), starts[:-1])
        if rest is not None:
            yield judged(rest, np.array([0]))

    return run


def _across(t: tuple[int, int], rows: int = 256):
    """Over blocks of (tok, block, side, cls, comp, elements): links across components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _runs(batches, 2):
            cls, comp, side = (block.column(c).to_numpy() for c in ("cls", "comp", "side"))
            kinds, of, counts = np.unique(comp, return_inverse=True, return_counts=True)
            if len(kinds) < 2:
                continue
            sets, two = _elements(block), side.min() != side.max()
            few, hits = np.flatnonzero(of != counts.argmax()), []
            for at in range(0, len(few), rows):
                i = few[at : at + rows]
                for to in range(0, len(cls), 4 * rows):
                    j = np.arange(to, min(len(cls), to + 4 * rows))
                    ok = linked([sets[k] for k in i.tolist()], [sets[k] for k in j.tolist()], t)
                    ok &= of[i][:, None] != of[j][None, :]
                    if two:
                        ok &= side[i][:, None] != side[j][None, :]
                    a, b = np.nonzero(ok)
                    hits.append(np.stack([i[a], j[b]]))
            a, b = np.concatenate(hits, axis=1)
            yield _stars(cls, a, b)

    return run


def _frequent(own: DataFrame, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that one in HOT documents has, sorted, and their ranks by frequency from 1: MOST_HOT at most."""
    counts = own.where("tok is not null").groupBy("tok").agg(F.sum("n").alias("n")).where(F.col("n") >= max(8, n_docs // HOT))
    top = counts.orderBy(F.desc("n"), "tok").limit(MOST_HOT).collect()
    toks = np.array([r[0] for r in top], np.int64).view(np.uint64)
    order = np.argsort(toks)
    return toks[order], (len(top) - order).astype(np.int32)


def _salt(total_rows: Column, total_elements: Column) -> Column:
    """Into how many parts a block of so many rows and elements is split."""
    return F.ceil(F.greatest(total_rows / BLOCK_ROWS, total_elements / BLOCK_ELEMENTS)).cast("int")


def near_duplicates(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles long, component_id long): one row for each row of docs.

    A text's words are the runs without [\\x20\\x09-\\x0D], A-Z lower-cased; its set holds the distinct runs of `width` words.
    Two documents link when intersection / union >= threshold. component_id is the smallest doc_id reachable by links,
    the document itself included. Null and empty texts have no shingles and link with nothing. Rows of one id are one
    document as far as links go. Null ids take part, but are no component_id unless a component has no other, which is
    null then. Texts of any length are taken whole; other columns are not read. No rows give no rows.

    Sets and classes are compared by 64-bit hashes. A block is bounded: documents that share a column beyond it are dealt to
    blocks for each pair of parts.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n_blocks = partitions(docs.sparkSession)
    counted = cut(slim.mapInArrow(lean(_classes(width)), "doc_id long, n long, cls long, tok long"))
    own = counted.where("tok is null").select("doc_id", "n", "cls")
    hot, rank = _frequent(counted, own.count())
    classes = cut(own.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")))

    rows = slim.mapInArrow(lean(_columns(width, threshold, hot, rank)), "tok long, cls long, n int, hot int")
    dealt = rows.withColumn("salt", F.when(F.col("hot") > 0, F.pmod(F.xxhash64("cls"), F.lit(SALT))).otherwise(0)).repartition(n_blocks, "tok", "salt")
    once = dealt.groupBy("tok", "salt", "cls").agg(F.first("n").alias("n"), F.first("hot").alias("hot"))
    often = F.when(F.col("hot") > 0, F.lit(1 << 40) + F.col("hot")).otherwise(F.count("*").over(Window.partitionBy("tok", "salt")))
    shared = once.withColumn("df", often).where("df > 1")
    slack = F.floor(F.ceil(F.col("n") * threshold[0] / threshold[1]) / 5).cast("int")
    lists = shared.groupBy("cls").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("toks"))
    kept = lists.where(F.size("toks") > slack).select("cls", "n", F.explode(F.slice("toks", F.lit(1), F.size("toks") - slack)).alias("x"))
    cells = cut(kept.select(F.col("x.tok").alias("tok"), "cls", "n"))

    ids = cells.select("cls").distinct().join(classes.select("cls", "rep"), "cls")
    texts = slim.join(ids.select(F.col("rep").alias("__rep")).distinct(), F.col("doc_id").eqNullSafe(F.col("__rep")), "left_semi")
    sets = texts.mapInArrow(lean(_whole(width)), "cls long, sketch binary, elements binary").join(ids.select("cls"), "cls", "left_semi")
    sets = cut(sets.groupBy("cls").agg(F.first("sketch").alias("sketch"), F.first("elements").alias("elements")))

    edges = None
    for turn in (0, 1):
        pick = cells.groupBy("cls").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "tok").alias("h"), "tok")).alias("x"), F.first("n").alias("n")).select("cls", F.col("x.tok").alias("tok"), "n")
        sizes = pick.groupBy("tok").agg(F.count("*").alias("m"), F.sum("n").alias("size")).where("m > 1").select("tok", _salt(F.col("m"), F.col("size")).alias("parts"))
        placed = pick.join(sizes, "tok").select("tok", F.pmod(F.xxhash64(F.lit(turn), "cls"), F.col("parts")).cast("int").alias("salt"), "cls")
        blocks = placed.join(sets.select("cls", "elements"), "cls").select("tok", "salt", "cls", "elements").repartition(n_blocks, "tok", "salt").sortWithinPartitions("tok", "salt")
        links = blocks.mapInArrow(lean(_families(threshold)), "a long, b long")
        edges = links if edges is None else edges.unionAll(links)
    edges = cut(edges)

    found = components(edges)
    labels = cut(cells.join(found.select(F.col("node").alias("cls"), "component_id"), "cls", "left").select("tok", "cls", "n", F.coalesce("component_id", "cls").alias("comp")))
    apart = labels.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"), F.sum("n").alias("size")).where("lo <> hi")
    still = labels.join(apart.select("tok", _salt(F.col("m"), F.col("size")).alias("parts")), "tok").withColumn("side", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    block = (F.least("side", "other") * F.col("parts") + F.greatest("side", "other")).cast("int").alias("block")
    # a document's sketch and first columns go to all of its columns, in the order in which its pairs look for the first that they share
    order = F.sort_array(F.collect_list(F.struct(F.xxhash64("tok").alias("h"), "tok", "n", "comp", "parts", "side")))
    lists = still.groupBy("cls").agg(order.alias("cells")).join(sets.select("cls", "sketch"), "cls")
    cells = lists.select("cls", "sketch", F.slice("cells.tok", 1, FIRST).alias("first"), F.explode("cells").alias("x")).select("cls", "sketch", "first", "x.*")
    placed = cells.select("*", other).select("tok", block, "side", "cls", "comp", "n", "sketch", "first")
    wide = placed.repartition(n_blocks, "tok", "block").sortWithinPartitions("tok", "block")
    flagged = wide.mapInArrow(lean(_flagged(threshold)), "tok long, block int, side int, cls long, comp long")
    blocks = flagged.join(sets.select("cls", "elements"), "cls").select("tok", "block", "side", "cls", "comp", "elements").repartition(n_blocks, "tok", "block").sortWithinPartitions("tok", "block")
    edges = cut(edges.unionAll(blocks.mapInArrow(lean(_across(threshold)), "a long, b long")))

    found = components(edges)
    groups = classes.join(found.select(F.col("node").alias("cls"), "component_id"), "cls", "left").select("cls", "rep", F.coalesce("component_id", "cls").alias("comp"))
    smallest = groups.groupBy("comp").agg(F.min("rep").alias("smallest"))
    of_class = groups.join(smallest, "comp").select("cls", "smallest")
    return own.join(of_class, "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("smallest")).alias("component_id")
    )


def keep_one(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of near duplicates, that of the smallest id; same columns.

    Rows of one id stay or go together. A document without words (null or empty texts too), or without an id where the group
    has no other, stays; of equal texts under different ids one stays. Columns of any name pass. No rows give no rows.
    """
    groups = near_duplicates(docs, threshold, width, id_col, text_col)
    name = unused(docs, "stay")
    stay = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(stay, F.col(id_col).cast("long").eqNullSafe(F.col(name)), "left_semi")
