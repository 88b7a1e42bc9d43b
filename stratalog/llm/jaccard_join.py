"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

The matrix has a row for each distinct shingle set and a column for each shingle.
Its product with its transpose counts shared shingles. Only the cells that can
reach the threshold are computed:

* Copies (equal sets) are one row.
* Shingles are ordered, frequent ones last; two sets that reach the threshold share
  a shingle among the first n - ceil(0.75 n) + 1 of either, so only these columns are
  multiplied. Any order is right; frequency only makes the columns short.
* A block is a hash range of columns. In each column, a pair is discarded if its
  sizes, or the places of the shared shingle in both sets, bound the overlap below
  what the threshold needs.

The overlaps of the pairs left are counted in full on their sets. A column with many
rows is multiplied in steps: first only neighbours in the order of size are paired,
verified and joined into components; then pairs of different components, the
likeliest by their bounds first, until all that the bounds allow have been verified or
lie in one component. So a large group of near copies costs a few pairs for each
member, not all pairs, and no link between components is lost.

The number of links of each set is counted when the components are known, as linked
sets share a component: the overlaps of all sets of a component are products of its
matrix, a block of two chunks of sets in each task, and only the counts leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.components import components
from stratalog.llm.scratch import small_batches, written
from stratalog.llm.textkit import BASE, BLANK_IS_WORD, MIX_B, flat, mixed, pieces, pieces_of, words

U64 = np.uint64
WORDS = 5
#: Links: SHARED * intersection >= NEEDED * union.
SHARED, NEEDED = 100, 75
#: Frequent shingles whose order the tasks are told: at most so many, so the broadcast is bounded.
FREQUENT_ROWS = 200_000
FREQUENT_FROM = 16
FLUSH = 1_000_000
BLOCK_BYTES = 8 << 20
#: Candidates whose documents are picked by a broadcast of their ids; beyond, by a shuffled join.
BROADCAST_CANDIDATES = 500_000
POSTING = np.dtype([("shingle", "<u8"), ("node", "<i8"), ("size", "<u4"), ("place", "<u4")])
LEAST_SKETCH = 64
MOST_TWINS = 100_000
#: Partners of a row in other components, round by round; the last round takes all that are left.
CAPS = (2, 8, 64, None)
#: A chunk of a component's sets, whose links to another chunk are counted in one task: about so many shingles and sets.
CHUNK_SHINGLES, CHUNK_SETS = 1 << 19, 2048
#: Columns that more than a DENSE-th of the sets hold are multiplied as dense matrices, so many at a time.
DENSE, DENSE_COLUMNS = 16, 1024


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes, sorted and distinct in each document; document of each; set sizes)."""
    documents = len(offsets) - 1
    h, _, _, doc = words(raw, offsets, BLANK_IS_WORD)
    count = np.bincount(doc, minlength=documents)
    n = len(h)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(documents, np.int64)
    begin = np.cumsum(count) - count
    rolled, factor = np.zeros(n, U64), U64(1)
    padded = np.concatenate((h, np.zeros(WORDS, U64)))
    left = (begin + count)[doc] - np.arange(n)  # words from here to the document's end
    for k in range(WORDS):
        rolled += np.where(left > k, padded[k : k + n], U64(0)) * factor
        factor = U64((int(factor) * int(BASE)) % (1 << 64))
    at = np.flatnonzero((left >= WORDS) | ((count[doc] < WORDS) & (left == count[doc])))
    value = mixed(rolled[at] + np.minimum(count[doc[at]], WORDS).astype(U64) * MIX_B)
    owner = doc[at]
    order = np.argsort(value, kind="stable")
    order = order[np.argsort(owner[order].astype(np.uint16 if documents < 65536 else np.int64), kind="stable")]
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, owner, np.bincount(owner, minlength=documents)


def signatures(value: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit signatures of each set; 0 for an empty one."""
    a, b = np.zeros(len(sizes), U64), np.zeros(len(sizes), U64)
    full = np.flatnonzero(sizes)
    if len(full):
        start = (np.cumsum(sizes) - sizes)[full]
        a[full] = mixed(np.add.reduceat(value * U64(0x9E3779B97F4A7C15) ^ (value >> U64(32)), start))
        b[full] = mixed(np.add.reduceat(mixed(value ^ U64(0x5851F42D4C957F2D)), start))
    return a.view(np.int64), b.view(np.int64)


def _batches_of_sets(batches: Iterator[pa.RecordBatch], twins: np.ndarray):
    """(part, value, owner, sizes, node, second signature) of bounded pieces.

    The node of a set is its first signature, or, if its second one is among ``twins``, a mix of both.
    """
    for part in pieces_of(batches, "_text", 1 << 20):
        value, owner, sizes = shingle_sets(*flat(part.column("_text")))
        a, b = signatures(value, sizes)
        if len(twins):
            a = np.where(np.isin(b, twins) & (sizes > 0), mixed(a.view(U64) + b.view(U64) * MIX_B).view(np.int64), a)
        yield part, value, owner, sizes, a, b


def _once(node: np.ndarray, sizes: np.ndarray, owner: np.ndarray, known: set) -> np.ndarray:
    """Which shingles belong to a set that this task has not met before."""
    first = np.zeros(len(node), bool)
    kinds, at = np.unique(node, return_index=True)
    for k, i in zip(kinds.tolist(), at.tolist(), strict=True):
        if k not in known:
            known.add(k)
            first[i] = True
    return (first & (sizes > 0))[owner]


def sketches(value: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """A bitmap for each set, of a power of two of bits, twice its size at least; each shingle sets one bit."""
    width = np.maximum(LEAST_SKETCH, 1 << np.ceil(np.log2(2 * np.maximum(sizes, 1))).astype(np.int64))
    ends = np.cumsum(width)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, bool)
    out[(ends - width)[owner] + (value >> U64(20)).astype(np.int64) % width[owner]] = True
    packed = np.packbits(out, bitorder="little").tobytes()
    return [packed[(e - w) // 8 : e // 8] for e, w in zip(ends.tolist(), width.tolist(), strict=True)]


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows of bytes) as they would be with ``width`` bytes."""
    while bits.shape[-1] > width:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def most_overlap(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Bounds of the overlaps by bitmaps: a bit that only one set has stands for a shingle that the other lacks."""
    width = min(x.shape[-1], y.shape[-1])
    x, y = (folded(v, width).view(U64) for v in (x, y))
    return np.minimum(nx - np.bitwise_count(x & ~y).sum(-1, dtype=np.int64), ny - np.bitwise_count(y & ~x).sum(-1, dtype=np.int64))


def _profiles(rows: DataFrame, kind: str, twins: np.ndarray) -> DataFrame:
    def profile(batches):
        for part, value, owner, sizes, a, b in _batches_of_sets(batches, twins):
            yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(sizes), pa.array(a), pa.array(b), pa.array(sketches(value, owner, sizes), pa.binary())], ["_id", "_n", "_node", "_sign", "_sketch"])

    return rows.mapInArrow(profile, f"_id {kind}, _n long, _node long, _sign long, _sketch binary")


def _classes(rows: DataFrame, kind: str) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Profiles, the classes of equal sets, and the second signatures of sets that share their first with another.

    Such twins are a few in billions of sets; they are told apart by a node of their own.
    """
    twins = np.zeros(0, np.int64)
    while True:
        profiles = written(_profiles(rows, kind, twins), "jaccard-profiles")
        best = F.min("_id").alias("_rep"), F.max("_n").alias("_n"), F.first("_sketch").alias("_sketch"), F.min("_sign").alias("_low"), F.max("_sign").alias("_high")
        classes = written(profiles.where("_n > 0 and _id is not null").groupBy("_node").agg(*best), "jaccard-classes")
        met = classes.where("_low <> _high").select("_node")
        if met.isEmpty():
            return profiles, classes.drop("_low", "_high"), twins
        found = profiles.where("_n > 0").join(met, "_node").select("_sign").distinct().limit(MOST_TWINS + 1).collect()
        if len(found) > MOST_TWINS:
            raise ValueError("the signatures of too many sets collide")
        twins = np.union1d(twins, [r[0] for r in found]).astype(np.int64)


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that may link by their sketches."""
    for batch in batches:
        nx, ny = batch.column("_n_u").to_numpy(), batch.column("_n_v").to_numpy()
        x, y = flat(batch.column("_sketch_u")), flat(batch.column("_sketch_v"))
        wide = np.stack((np.diff(x[1]), np.diff(y[1])), 1)
        keep = np.zeros(batch.num_rows, bool)
        for a, b in np.unique(wide, axis=0):
            at = np.flatnonzero((wide == (a, b)).all(1))
            for k in range(0, len(at), max(1, BLOCK_BYTES // int(a + b))):
                some = at[k : k + max(1, BLOCK_BYTES // int(a + b))]
                bits = (raw[begin[some][:, None] + np.arange(w)] for (raw, begin), w in ((x, a), (y, b)))
                keep[some] = (SHARED + NEEDED) * most_overlap(*bits, nx[some], ny[some]) >= NEEDED * (nx[some] + ny[some])
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("u", "v")], ["u", "v"])


def _frequent(rows: DataFrame, twins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles and their ranks, by the counts of those that a task meets twice or more."""

    def counts(batches):
        kept, held, known = [], 0, set()

        def told():
            kinds, count = np.unique(np.concatenate(kept), return_counts=True)
            twice = count > 1
            return pa.RecordBatch.from_arrays([pa.array(kinds[twice].view(np.int64)), pa.array(count[twice])], ["s", "c"])

        for _, value, owner, sizes, a, _ in _batches_of_sets(batches, twins):
            kept.append(value[_once(a, sizes, owner, known)])
            held += len(kept[-1])
            if held > FLUSH:
                yield told()
                kept, held, known = [], 0, set()
        if kept:
            yield told()

    found = rows.mapInArrow(counts, "s long, c long").groupBy("s").agg(F.sum("c").alias("c")).where(F.col("c") >= FREQUENT_FROM)
    top = found.orderBy(F.desc("c"), "s").limit(FREQUENT_ROWS).collect()
    keys = np.array([r[0] for r in top], np.int64).view(U64)
    rank = np.arange(len(top), 0, -1)  # the most frequent has the highest rank
    order = np.argsort(keys)
    return keys[order], rank[order]


def _blocks(rows: DataFrame, frequent, blocks: int, twins: np.ndarray) -> DataFrame:
    """(block, data): the prefix columns' entries, packed, for each block of columns."""
    keys, ranks = frequent
    shared = rows.sparkSession.sparkContext.broadcast((keys, ranks))

    def emit(batches):
        keys, ranks = shared.value
        kept, held, known = [], 0, set()

        def told():
            data = np.concatenate(kept)
            block = (data["shingle"] >> U64(33)).astype(np.int64) % blocks
            order = np.argsort(block, kind="stable")
            data, block = data[order], block[order]
            at = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(block)]))
            return pa.RecordBatch.from_arrays([pa.array(block[at[:-1]]), pa.array([data[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["block", "data"])

        for _, value, owner, sizes, a, _ in _batches_of_sets(batches, twins):
            mine = _once(a, sizes, owner, known)
            value, owner = value[mine], owner[mine]
            if not len(value):
                continue
            rank = np.zeros(len(value), np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
                rank = np.where(keys[at] == value, ranks[at], 0)
            order = np.argsort((owner << 32) | rank, kind="stable")
            value, owner = value[order], owner[order]
            start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            place = np.arange(len(owner)) - np.repeat(start, np.diff(np.append(start, len(owner))))
            n = sizes[owner]
            prefix = place < n - -(-NEEDED * n // SHARED) + 1
            out = np.empty(int(prefix.sum()), POSTING)
            out["shingle"], out["node"], out["size"], out["place"] = value[prefix], a[owner[prefix]], n[prefix], place[prefix]
            kept.append(out)
            held += len(value)
            if held > FLUSH:
                yield told()
                kept, held, known = [], 0, set()
        if kept:
            yield told()

    return rows.mapInArrow(emit, "block long, data binary")


def _possible(size_a, size_b, place_a, place_b):
    """Whether the overlap can reach what the sizes need, the shared shingle being the first one."""
    low, high = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    most = 1 + np.minimum(size_a - place_a, size_b - place_b) - 1
    return (SHARED * low >= NEEDED * high) & ((SHARED + NEEDED) * most >= NEEDED * (size_a + size_b))


def _columns(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of columns with two rows or more, by (shingle, size, node), and where each column starts."""
    data = np.unique(data)  # by shingle, node: the same set may come from several tasks
    start = np.flatnonzero(np.concatenate(([True], data["shingle"][1:] != data["shingle"][:-1])))
    width = np.diff(np.append(start, len(data)))
    data = data[np.repeat(width > 1, width)]
    data = data[np.lexsort((data["node"], data["size"], data["shingle"]))]
    return data, np.flatnonzero(np.concatenate(([True], data["shingle"][1:] != data["shingle"][:-1]))) if len(data) else np.zeros(0, np.int64)


def _first_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block: neighbouring pairs of each column (kind 0), and the columns of three rows or more (kind 1)."""

    def product(parts):
        data, start = _columns(np.frombuffer(b"".join(parts), POSTING))
        if not len(data):
            return
        same = data["shingle"][1:] == data["shingle"][:-1]
        x, y = data[:-1][same], data[1:][same]
        able = _possible(x["size"].astype(np.int64), y["size"].astype(np.int64), x["place"].astype(np.int64), y["place"].astype(np.int64))
        pairs = np.unique(np.stack((np.minimum(x["node"], y["node"]), np.maximum(x["node"], y["node"])), 1)[able], axis=0)
        yield _rows(0, pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64))
        width = np.diff(np.append(start, len(data)))
        wide = width > 2
        if wide.any():
            # Columns with the same rows give the same pairs: one stands for all, each row at its lowest place.
            digest = np.repeat(np.add.reduceat(mixed(data["node"].view(U64) + U64(77)), start), width)
            mine = np.repeat(wide, width)
            data, digest = data[mine], mixed(digest[mine]).view(np.int64)
            order = np.lexsort((data["node"], digest))
            data, digest = data[order], digest[order]
            at = np.flatnonzero(np.concatenate(([True], (digest[1:] != digest[:-1]) | (data["node"][1:] != data["node"][:-1]))))
            yield _rows(1, digest[at], data["node"][at], data["size"][at].astype(np.int64), np.minimum.reduceat(data["place"].astype(np.int64), at))

    now, parts = None, []
    for batch in batches:
        for block, piece in zip(batch.column("block").to_pylist(), batch.column("data"), strict=True):
            if block != now and parts:
                yield from product(parts)
                parts = []
            now = block
            parts.append(piece.as_py())
    if parts:
        yield from product(parts)


def _rows(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *map(pa.array, columns)], ["kind", "u", "v", "size", "place"])


def _second_step(cap: int | None):
    """Of columns that hold several components (rows sorted by column): pairs across them that may link by places and sketches.

    Every row outside the column's largest component gets its ``cap`` likeliest partners in
    other components (None: all). A column where more were left adds a row with its key and ``more`` set.
    """

    def product(table: pa.Table) -> Iterator[pa.RecordBatch]:
        root, node = table["root"].to_numpy(), table["v"].to_numpy()
        size, place = table["size"].to_numpy(), table["place"].to_numpy()
        raw, begin = flat(table["_sketch"])
        width = np.diff(begin)
        rows_of = {int(w): np.flatnonzero(width == w) for w in np.unique(width)}
        bits = {w: raw[begin[at][:, None] + np.arange(w)] for w, at in rows_of.items()}
        slot = np.empty(len(node), np.int64)
        for at in rows_of.values():
            slot[at] = np.arange(len(at))
        kinds, group = np.unique(root, return_inverse=True)
        minor = np.flatnonzero(group != np.bincount(group).argmax())
        is_minor = np.zeros(len(node), bool)
        is_minor[minor] = True
        found, more = [], False
        for i in minor.tolist():
            j = np.flatnonzero((group != group[i]) & (~is_minor | (np.arange(len(node)) > i)))
            j = j[_possible(size[i], size[j], place[i], place[j])]
            own, most = bits[int(width[i])][slot[i]], np.zeros(len(j), np.int64)
            for w in np.unique(width[j]):
                at = np.flatnonzero(width[j] == w)
                most[at] = most_overlap(own, bits[int(w)][slot[j[at]]], size[i], size[j[at]])
            slack = (SHARED + NEEDED) * most - NEEDED * (size[i] + size[j])
            j, slack = j[slack >= 0], slack[slack >= 0]
            if cap is not None and len(j) > cap:
                j, more = j[np.lexsort((node[j], -slack))[:cap]], True
            found.append(np.stack((np.minimum(node[i], node[j]), np.maximum(node[i], node[j])), 1))
        pairs = np.concatenate([np.zeros((0, 2), np.int64), *found])
        left = np.zeros(len(pairs), bool)
        if more:
            pairs, left = np.concatenate((pairs, [[table["u"][0].as_py(), 0]])), np.append(left, True)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(left)], ["u", "v", "more"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            column = batch.column("u").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(column)) + 1, [len(column)])) if len(column) else [0]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if column[i] != now and held:
                    yield from product(pa.Table.from_batches(held))
                    held = []
                now = column[i]
                held.append(batch.slice(i, j - i))
        if held:
            yield from product(pa.Table.from_batches(held))

    return step


def _sets(rows: DataFrame, twins: np.ndarray) -> DataFrame:
    """(_node, _set): the packed shingles of each document."""

    def emit(batches):
        for _, value, _, sizes, a, _ in _batches_of_sets(batches, twins):
            at = np.concatenate(([0], np.cumsum(sizes)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array([value[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["_node", "_set"])

    return rows.mapInArrow(emit, "_node long, _set binary")


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with both sets, those that link."""
    for batch in batches:
        for part in pieces(batch, "_set_u", 1 << 20):
            (x, x_at), (y, y_at) = flat(part.column("_set_u")), flat(part.column("_set_v"))
            nx, ny = np.diff(x_at) // 8, np.diff(y_at) // 8
            n = part.num_rows
            value = np.concatenate((x.view(U64) if len(x) else np.zeros(0, U64), y.view(U64) if len(y) else np.zeros(0, U64)))
            pair = np.concatenate((np.repeat(np.arange(n), nx), np.repeat(np.arange(n), ny)))
            order = np.argsort(value, kind="stable")
            order = order[np.argsort(pair[order].astype(np.uint16 if n < 65536 else np.int64), kind="stable")]
            value, pair = value[order], pair[order]
            both = np.bincount(pair[1:][(value[1:] == value[:-1]) & (pair[1:] == pair[:-1])], minlength=n)
            linked = SHARED * both >= NEEDED * (nx + ny - both)
            yield pa.RecordBatch.from_arrays([part.column("u").filter(pa.array(linked)), part.column("v").filter(pa.array(linked)), pa.array(both[linked])], ["u", "v", "overlap"])


def _allowed(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that may link by their sketches."""
    side = lambda e: classes.select(F.col("_node").alias(e), F.col("_n").alias(f"_n_{e}"), F.col("_sketch").alias(f"_sketch_{e}"))
    return pairs.join(side("u"), "u").join(side("v"), "v").mapInArrow(_likely, "u long, v long")


def _links(rows: DataFrame, classes: DataFrame, twins: np.ndarray, pairs: DataFrame, name: str) -> DataFrame:
    """The pairs of nodes that link, with the overlap counted on their whole sets."""
    nodes = pairs.select(F.col("u").alias("_node")).union(pairs.select(F.col("v").alias("_node"))).distinct()
    wanted = written(classes.join(nodes, "_node").select("_node", F.col("_rep").alias("_id")), f"{name}-wanted")
    ids = wanted.select("_id").distinct()
    small = wanted.count() <= BROADCAST_CANDIDATES
    found = rows.join(F.broadcast(ids) if small else ids, "_id", "left_semi")
    sets = written(_sets(found, twins), f"{name}-sets")
    u = sets.select(F.col("_node").alias("u"), F.col("_set").alias("_set_u"))
    v = sets.select(F.col("_node").alias("v"), F.col("_set").alias("_set_v"))
    linked = pairs.join(u, "u").join(v, "v").select("u", "v", "_set_u", "_set_v").mapInArrow(_verified, "u long, v long, overlap long")
    return written(linked.distinct(), f"{name}-links")  # a repeated row brings its set twice


def _dealt(rows: DataFrame, classes: DataFrame, twins: np.ndarray, members: DataFrame) -> DataFrame:
    """(root, low, high, node, own, _set): each set of ``members`` (node, root, own, parts) once for every pair of chunks that its own is in."""
    wanted = written(members.join(classes.select(F.col("_node").alias("node"), F.col("_rep").alias("_id")), "node"), "jaccard-members")
    small = wanted.count() <= BROADCAST_CANDIDATES
    found = rows.join(F.broadcast(wanted) if small else wanted, "_id")

    def emit(batches):
        for part, value, _, sizes, a, _ in _batches_of_sets(batches, twins):
            at = np.concatenate(([0], np.cumsum(sizes)))
            node, root, own, parts = (part.column(c).to_numpy() for c in ("node", "root", "own", "parts"))
            mine = np.flatnonzero(a == node)  # another row of the same id may hold another set
            for i in mine.tolist():
                data, n = value[at[i] : at[i + 1]].tobytes(), int(parts[i])
                for k in range(0, n, 64):
                    other = np.arange(k, min(n, k + 64))
                    same = [np.full(len(other), x[i]) for x in (root, node, own)]
                    yield same[0], np.minimum(own[i], other), np.maximum(own[i], other), same[1], same[2], [data] * len(other)

    def batched(batches):
        held, size = [], 0
        for columns in emit(batches):
            held.append(columns)
            size += sum(map(len, columns[5]))
            if size > BLOCK_BYTES or len(held) >= 1000:
                yield _packed(held)
                held, size = [], 0
        if held:
            yield _packed(held)

    return found.mapInArrow(batched, "root long, low long, high long, node long, own long, _set binary")


def _packed(held: list) -> pa.RecordBatch:
    longs = [pa.array(np.concatenate([h[k] for h in held])) for k in range(5)]
    return pa.RecordBatch.from_arrays([*longs, pa.array([d for h in held for d in h[5]], pa.binary())], ["root", "low", "high", "node", "own", "_set"])


def link_counts(x: list[np.ndarray], y: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """How many sets of ``y`` each set of ``x`` links with, and the reverse; without ``y``, how many others of ``x``."""
    alone = y is None
    y = x if alone else y
    nx, ny = (np.array([len(s) for s in side], np.int64) for side in (x, y))
    row, other = np.repeat(np.arange(len(x)), nx), np.repeat(np.arange(len(y)), ny)
    kinds, column = np.unique(np.concatenate([*x] if alone else [*x, *y]), return_inverse=True)
    column, partner = (column, column) if alone else (column[: len(row)], column[len(row) :])
    width = np.bincount(partner, minlength=len(kinds))
    used = width > 1 if alone else (width > 0) & (np.bincount(column, minlength=len(kinds)) > 0)
    dense = used & (width * DENSE > len(y))
    both = np.zeros((len(x), len(y)))
    place = np.cumsum(dense) - 1
    here, there = np.flatnonzero(dense[column]), np.flatnonzero(dense[partner])
    for low in range(0, int(dense.sum()), DENSE_COLUMNS):
        a, b = np.zeros((len(x), DENSE_COLUMNS), np.float32), np.zeros((len(y), DENSE_COLUMNS), np.float32)
        for into, who, what, at in ((a, row, column, here), (b, other, partner, there)):
            at = at[(place[what[at]] >= low) & (place[what[at]] < low + DENSE_COLUMNS)]
            into[who[at], place[what[at]] - low] = 1
        both += a @ b.T
    rare = used & ~dense
    if rare.any():
        at = np.flatnonzero(rare[partner])
        order = at[np.argsort(partner[at], kind="stable")]
        holders, width = other[order], np.where(rare, width, 0)
        start = np.cumsum(width) - width
        cut = np.concatenate(([0], np.cumsum(nx)))
        for i in range(len(x)):
            mine = column[cut[i] : cut[i + 1]]
            mine = mine[rare[mine]]
            w = width[mine]
            places = np.repeat(start[mine] - (np.cumsum(w) - w), w) + np.arange(w.sum())
            both[i] += np.bincount(holders[places], minlength=len(y))
    linked = SHARED * both >= NEEDED * (nx[:, None] + ny[None, :] - both)
    if alone:
        np.fill_diagonal(linked, False)
    return linked.sum(1), linked.sum(0)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sets sorted by (root, low, high): the links of each set between the two chunks."""

    def counts(held: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        _, low, high = held[0][0]
        sets = {node: (own, np.frombuffer(data, U64)) for _, node, own, data in held}  # rows of one id may bring a set twice
        if low == high:
            return np.array(list(sets), np.int64), link_counts([s for _, s in sets.values()])[0]
        sides = [[(node, s) for node, (own, s) in sets.items() if own == side] for side in (low, high)]
        if not all(sides):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = link_counts(*([s for _, s in side] for side in sides))
        return np.array([node for side in sides for node, _ in side], np.int64), np.concatenate(found)

    def told(held):
        nodes, links = counts(held)
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(links.astype(np.int64))], ["_node", "_links"])

    held: list[tuple] = []
    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in ("root", "low", "high")), strict=True)
        rest = (batch.column(c).to_pylist() for c in ("node", "own", "_set"))
        for key, node, own, data in zip(keys, *rest, strict=True):
            if held and held[0][0] != key:
                yield told(held)
                held = []
            held.append((key, node, own, data))
    if held:
        yield told(held)


def _all_links(rows: DataFrame, classes: DataFrame, twins: np.ndarray, roots: DataFrame) -> DataFrame:
    """(_node, _links): with how many other sets each set links."""
    members = roots.join(classes.select(F.col("_node").alias("node"), "_n"), "node")
    parts = F.greatest(F.ceil(F.sum("_n") / CHUNK_SHINGLES), F.ceil(F.count(F.lit(1)) / CHUNK_SETS)).cast("long")
    shares = written(members.groupBy("root").agg(F.count(F.lit(1)).alias("sets"), parts.alias("parts")), "jaccard-shares")
    members = written(members.join(shares, "root").withColumn("own", F.pmod(F.xxhash64("node"), "parts")), "jaccard-shared")
    two = members.where("sets = 2").select(F.col("node").alias("_node"), F.lit(1).cast("long").alias("_links"))  # a component of two sets is a link
    dealt = _dealt(rows, classes, twins, members.where("sets > 2").select("node", "root", "own", "parts"))
    sorted_ = dealt.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high")
    counted = sorted_.mapInArrow(_counted, "_node long, _links long").groupBy("_node").agg(F.sum("_links").alias("_links"))
    return two.unionByName(counted)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_links: bool = True) -> DataFrame:
    """One row for each document: id, n_shingles, component_id, n_links.

    Words are runs of non-blanks after lower-casing A-Z. A document's set holds its
    distinct 5-word shingles, or its whole word sequence if that is shorter; null and
    blank texts have an empty set and link with nothing. Two documents link if
    100 * intersection >= 75 * union. component_id is the smallest id reachable by
    links, the own one included. n_links counts the different sets that the document's
    set links with; copies of one set count once, own copies not; without ``count_links`` it is null. Rows that repeat an id are
    judged one by one; a null id takes the component of its set but never names one.
    Words are told apart by 64-bit hashes over a prime field, sets by two 64-bit signatures. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    profiles, classes, twins = _classes(rows, kind)
    shingles = profiles.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    blocks = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), int(shingles * 0.27 * POSTING.itemsize) // BLOCK_BYTES)

    packed = _blocks(rows, _frequent(rows, twins), blocks, twins).repartition(blocks, "block").sortWithinPartitions("block")
    step = written(packed.mapInArrow(_first_step, "kind int, u long, v long, size long, place long"), "jaccard-columns")
    pairs = written(step.where("kind = 0").select("u", "v").distinct(), "jaccard-near")
    links = _links(rows, classes, twins, written(_allowed(classes, pairs), "jaccard-likely"), "jaccard-near")

    roots = components(links.select("u", "v"))
    columns = step.where("kind = 1").groupBy("u", "v").agg(F.max("size").alias("size"), F.min("place").alias("place"))
    columns = written(columns, "jaccard-wide")
    sketch = classes.select(F.col("_node").alias("v"), "_sketch")
    for cap in CAPS:
        rooted = columns.join(roots.withColumnRenamed("node", "v"), "v", "left").withColumn("root", F.coalesce("root", "v"))
        rooted = written(rooted.select("u", "v", "size", "place", "root"), "jaccard-rooted")
        several = rooted.groupBy("u").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("u")
        rooted = written(rooted.join(written(several, "jaccard-several"), "u"), "jaccard-rooted")
        across = rooted.join(sketch, "v").repartition("u").sortWithinPartitions("u").mapInArrow(_second_step(cap), "u long, v long, more boolean")
        across = written(across.distinct(), "jaccard-across")
        fresh = written(across.where("not more").select("u", "v").join(pairs, ["u", "v"], "left_anti"), "jaccard-fresh")
        if not fresh.isEmpty():
            pairs = pairs.unionByName(fresh)
            links = links.unionByName(_links(rows, classes, twins, fresh, "jaccard-across"))
            roots = components(links.select("u", "v"))
        left = across.where("more").select("u")
        if left.isEmpty():
            break
        columns = rooted.drop("root").join(left, "u", "left_semi")  # of other columns, all pairs are verified

    ends = _all_links(rows, classes, twins, roots) if count_links else classes.select("_node", F.lit(None).cast("long").alias("_links")).limit(0)
    named = classes.select("_node", "_rep").join(roots.withColumnRenamed("node", "_node"), "_node", "left").withColumn("_root", F.coalesce("root", "_node"))
    named = written(named.join(ends, "_node", "left").select("_node", "_rep", "_root", "_links"), "jaccard-named")
    lowest = written(named.groupBy("_root").agg(F.min("_rep").alias("_component")), "jaccard-components")
    named = written(named.join(lowest, "_root").select("_node", "_component", "_links"), "jaccard-labels")
    full = profiles.where("_n > 0").join(named, "_node", "left").select("_id", "_n", "_component", "_links")
    empty = profiles.where("_n = 0").select("_id", "_n", F.col("_id").alias("_component"), F.lit(None).cast("long").alias("_links"))
    return full.unionByName(empty).select(
        F.col("_id").alias(id_col),
        F.col("_n").alias("n_shingles"),
        F.col("_component").alias("component_id"),
        (F.coalesce("_links", F.lit(0)) if count_links else F.lit(None)).cast("long").alias("n_links"),
    )


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id names its component; rows without an id stay."""
    gone = near_duplicates(docs, id_col, text_col, count_links=False).where(f"component_id <> `{id_col}`").select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
