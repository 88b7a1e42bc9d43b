"""Benchmark decontamination with an FM-index for each training shard.

A shard is a slice of an Arrow batch. Its word sequence becomes a Burrows-Wheeler
transform under a wavelet tree; every test phrase (window of benchmark words) is
found by backward search on the tree's ranks, all phrases in step; occurrences
are located by walking to sampled suffix positions, and their spans merged.

Only runs of benchmark words can hold a phrase. So that the index stays small, the
sequence keeps the maximal runs of words that occur in the benchmark and are
at least as long as the shortest phrase, with a separator between them. No
occurrence is lost by that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.scratch import small_batches
from stratalog.llm.textkit import ALNUM_IS_WORD, flat, pieces, spans_of, words

WINDOW = 13
SAMPLE_STEP = 16
#: Benchmark text of one pass over the documents; a larger benchmark takes as many passes as it needs.
PASS_BYTES = 8 << 20


class WaveletTree:
    """Ranks over an integer sequence: at each level the sequence is stably parted by one bit, high bits first."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.counts = bits, []
        now = sequence
        for level in range(bits - 1, -1, -1):
            bit = (now >> level) & 1
            zeros = np.zeros(len(now) + 1, np.int32)
            np.cumsum(bit == 0, out=zeros[1:])
            self.counts.append(zeros)
            now = now[np.argsort(bit, kind="stable")]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbol before position ``at``, for arrays of both."""
        low, high = np.zeros(len(at), np.int64), at.astype(np.int64)
        for level, zeros in zip(range(self.bits - 1, -1, -1), self.counts, strict=True):
            one = ((symbol >> level) & 1).astype(bool)
            z = zeros[-1]
            low = np.where(one, z + low - zeros[low], zeros[low])
            high = np.where(one, z + high - zeros[high], zeros[high])
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        at, symbol = at.astype(np.int64), np.zeros(len(at), np.int64)
        for zeros in self.counts:
            one = zeros[at + 1] == zeros[at]
            symbol = symbol * 2 + one
            at = np.where(one, zeros[-1] + at - zeros[at], zeros[at])
        return symbol


def suffix_array(sequence: np.ndarray) -> np.ndarray:
    """By prefix doubling; the sequence ends in a unique smallest symbol."""
    rank = np.unique(sequence, return_inverse=True)[1].astype(np.int64)
    n, width = len(rank), 1
    while True:
        nxt = np.full(n, -1, np.int64)
        nxt[: n - width] = rank[width:] if width < n else 0
        key = rank * (n + 1) + nxt + 1
        order = np.argsort(key, kind="stable")
        step = np.zeros(n, np.int64)
        step[1:] = np.cumsum(key[order][1:] != key[order][:-1])
        rank[order] = step
        if step[-1] == n - 1:
            return order
        width *= 2


class FMIndex:
    """Symbols are 1 and up (1 separates runs); 0 ends the sequence."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        seq = np.concatenate((sequence, [0]))
        order = suffix_array(seq)
        self.n = len(seq)
        self.tree = WaveletTree(seq[order - 1], max(1, int(symbols).bit_length()))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=symbols + 1))))
        marked = order % SAMPLE_STEP == 0
        self.marked, self.marks = marked, np.concatenate(([0], np.cumsum(marked)))
        self.sample = order[marked]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of phrases, given as rows padded on the left."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            on = np.flatnonzero((lengths >= back) & (low < high))
            if not len(on):
                break
            symbol = phrases[on, phrases.shape[1] - back]
            low[on] = self.first[symbol] + self.tree.rank(symbol, low[on])
            high[on] = self.first[symbol] + self.tree.rank(symbol, high[on])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Sequence positions of rows, walking back to a sampled one."""
        at, steps, out = rows.astype(np.int64), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        live = np.arange(len(rows))
        while len(live):
            here = at[live]
            done = self.marked[here]
            ready = live[done]
            out[ready] = self.sample[self.marks[at[ready]]] + steps[ready]
            live = live[~done]
            symbol = self.tree.access(at[live])
            at[live] = self.first[symbol] + self.tree.rank(symbol, at[live])
            steps[live] += 1
        return out


class Phrases:
    """The windows of benchmark items over their own vocabulary."""

    def __init__(self, items: list[tuple[object, str]], window: int):
        texts = pa.array([t for _, t in items], pa.string())
        raw, offsets = flat(texts)
        h, _, _, item = words(raw, offsets, ALNUM_IS_WORD)
        self.vocabulary = np.unique(h)
        symbol = np.searchsorted(self.vocabulary, h) + 2
        rows, owner, lengths = [], [], []
        for i in range(len(items)):
            mine = symbol[item == i] if len(items) <= 64 else symbol[np.searchsorted(item, i) : np.searchsorted(item, i, "right")]
            if not len(mine):
                continue
            width = min(window, len(mine))
            for s in range(len(mine) - width + 1):
                row = np.zeros(window, np.int64)
                row[window - width :] = mine[s : s + width]
                rows.append(row)
                owner.append(i)
                lengths.append(width)
        every = np.array(rows, np.int64).reshape(-1, window)
        self.rows, self.kind = np.unique(every, axis=0, return_inverse=True) if len(every) else (every, np.zeros(0, np.int64))
        self.kind = self.kind.reshape(-1)
        self.lengths = (self.rows > 0).sum(1)
        self.shortest = int(self.lengths.min(initial=window))
        order = np.argsort(self.kind, kind="stable")
        self.owner = np.array(owner, np.int64)[order]
        self.owner_at = np.searchsorted(self.kind[order], np.arange(len(self.rows) + 1))


def shard_hits(raw: np.ndarray, offsets: np.ndarray, phrases: Phrases):
    """Words of each document, and its occurrences: (document, first word, length, phrase)."""
    h, start, end, doc = words(raw, offsets, ALNUM_IS_WORD)
    documents = len(offsets) - 1
    n_words = np.bincount(doc, minlength=documents)
    empty = np.zeros(0, np.int64)
    nothing = (n_words, start, end, empty, empty, empty)
    if not len(h) or not len(phrases.rows):
        return nothing
    place = np.searchsorted(phrases.vocabulary, h)
    place[place == len(phrases.vocabulary)] = 0
    known = phrases.vocabulary[place] == h
    # Maximal runs of benchmark words inside one document.
    head, tail = spans_of(known)
    cuts = np.flatnonzero(np.diff(doc)) + 1
    inner = cuts[known[cuts] & known[cuts - 1]]
    head, tail = np.sort(np.concatenate((head, inner))), np.sort(np.concatenate((tail, inner)))
    long = tail - head >= phrases.shortest
    head, tail = head[long], tail[long]
    if not len(head):
        return nothing
    sizes = tail - head + 1
    at = np.cumsum(sizes) - sizes
    word = np.repeat(head - at, sizes) + np.arange(sizes.sum())
    sequence = np.ones(len(word), np.int64)
    inside = np.ones(len(word), bool)
    inside[at + sizes - 1] = False
    sequence[inside] = place[word[inside]] + 2
    index = FMIndex(sequence, len(phrases.vocabulary) + 2)
    low, high = index.search(phrases.rows, phrases.lengths)
    found = np.maximum(high - low, 0)
    phrase = np.repeat(np.arange(len(found)), found)
    rows = np.repeat(low - (np.cumsum(found) - found), found) + np.arange(found.sum())
    return n_words, start, end, word[index.locate(rows)], phrases.lengths[phrase], phrase


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> list[list[tuple[object, str]]]:
    """Benchmark items in blocks of about PASS_BYTES; the driver holds one benchmark, never documents."""
    blocks, size = [[]], 0
    for item, text in benchmark.select(id_col, text_col).toLocalIterator():
        if text is not None:
            size += len(text)
            if size > PASS_BYTES and blocks[-1]:
                blocks.append([])
                size = len(text)
            blocks[-1].append((item, text))
    return blocks


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW) -> DataFrame:
    """One row for each document: id, n_words, n_hit, n_items, items, spans.

    Words are runs of digits, letters and non-ASCII after lower-casing A-Z. A phrase
    is ``window`` consecutive words of an item, or the whole of a shorter item; items
    without words have none. ``items`` are the ids, as sorted strings, of the items a
    phrase of which occurs (the phrases of an item without id hit words, but it is neither named nor counted); ``spans`` the merged byte ranges (start, end) of the words hit.
    Null text has no words, repeated rows are judged one by one, other columns
    are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, text string, n_words long, hits array<long>, items array<string>"
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<long>").alias("hits"), F.array().cast("array<string>").alias("items"))

    def one_pass(items, last: bool):
        names = [None if i is None else str(i) for i, _ in items]

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = Phrases(items, window)
            for batch in batches:
                for part in pieces(batch, "text"):
                    raw, offsets = flat(part.column("text"))
                    n_words, start, end, first, length, phrase = shard_hits(raw, offsets, phrases)
                    n = part.num_rows
                    hits, found = part.column("hits").to_pylist(), part.column("items").to_pylist()
                    if len(first):
                        base = np.concatenate(([0], np.cumsum(n_words)))
                        doc = np.searchsorted(base, first, "right") - 1
                        mark = np.zeros(len(start) + 1, np.int64)
                        np.add.at(mark, first, 1)
                        np.add.at(mark, first + length, -1)
                        hit = np.cumsum(mark[:-1]) > 0
                        for d in np.unique(doc):
                            own = np.flatnonzero(hit[base[d] : base[d + 1]])
                            hits[d] = np.union1d(hits[d], own).astype(np.int64).tolist()
                            mine = np.unique(phrase[doc == d])
                            owners = {names[o] for p in mine for o in phrases.owner[phrases.owner_at[p] : phrases.owner_at[p + 1]]} - {None}
                            found[d] = sorted({*found[d], *owners})
                    columns = [part.column(id_col), part.column("text"), pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))]
                    if last:
                        columns[1] = pa.nulls(n, pa.string())
                        columns += [pa.array(_byte_spans(hits, start, end, n_words, offsets), pa.list_(pa.list_(pa.int64())))]
                    yield pa.RecordBatch.from_arrays(columns, [id_col, "text", "n_words", "hits", "items", "spans"][: len(columns)])

        return scan

    blocks = item_blocks(benchmark, item_col, "text")
    for items in blocks[:-1]:
        rows = rows.mapInArrow(one_pass(items, False), schema)
    rows = rows.mapInArrow(one_pass(blocks[-1], True), schema + ", spans array<array<long>>")
    return rows.select(id_col, "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans")


def _byte_spans(hits: list, start: np.ndarray, end: np.ndarray, n_words: np.ndarray, offsets: np.ndarray) -> list:
    base = np.concatenate(([0], np.cumsum(n_words)))
    out = []
    for d, own in enumerate(hits):
        if not own:
            out.append([])
            continue
        own = np.array(own)
        new = np.flatnonzero(np.diff(own) > 1) + 1
        head, tail = own[np.concatenate(([0], new))], own[np.concatenate((new - 1, [len(own) - 1]))]
        out.append(np.stack((start[base[d] + head], end[base[d] + tail]), 1).__sub__(offsets[d]).tolist())
    return out


def digest_of_items(items):
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)


def is_contaminated(n_hit, n_words):
    """A twentieth of the words or more are hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def clean_text(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text of each document, without the bytes of its hit spans."""
    judged = contamination(docs, benchmark, id_col, text_col).select(F.col(id_col).alias("_hit_id"), "spans").where(F.size("spans") > 0).dropDuplicates(["_hit_id"])
    rows = docs.select(id_col, text_col).join(judged, docs[id_col].eqNullSafe(judged["_hit_id"]), "left")
    raw = F.col(text_col).cast("binary")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s[1]))
    ends = F.concat(F.transform("spans", lambda s: s[0]), F.array(F.octet_length(text_col).cast("long")))
    kept = F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda z: F.substring(raw, (z["s"] + 1).cast("int"), (z["e"] - z["s"]).cast("int")))
    joined = F.aggregate(kept, F.lit(b""), lambda a, b: F.concat(a, b))
    return rows.select(id_col, F.when(F.col("spans").isNull(), F.col(text_col)).otherwise(joined.cast("string")).alias(text_col))
