"""Repeated 400-byte strings by merging Burrows-Wheeler transforms of shards.

1. Each 400-byte window chooses an anchor: of the ANCHOR-byte grams in it the one of
   smallest hash, of equals the leftmost. Equal windows choose equal anchors, so a window
   repeats only if its anchor does. Neighbouring windows of one anchor form a segment.
2. Anchors are counted over all documents; those that occur twice or more set a bit
   of a filter of fixed size, and a second one if their segments differ. A collision
   there costs time, never a result.
3. Segments of repeated anchors go to the shard of their anchor, equal segments
   (by 128 bits of a BLAKE2b) of a task as one, with their bytes if the second bit is set. There equal segments are
   counted; segments that share an anchor but differ are merged: every suffix row carries the name of the STEP bytes before it (its
   Burrows-Wheeler symbol, STEP bytes wide), and the interleave of all rows is refined by
   stable passes over these symbols. A pass extends the common prefixes by STEP bytes,
   block boundaries mark where they end, and rows still in one block after 400 bytes
   are the repeated intervals. No pass compares suffixes.
4. The windows so found become spans of their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from stratalog.llm.scratch import small_batches, written
from stratalog.llm.textkit import BASE, GOLD, UNBASE, flat, mixed, pieces, powers, spans_of

U64 = np.uint64
LENGTH, ANCHOR, STEP = 400, 128, 50
FILTER_BITS, CHUNK_BITS = 27, 16
FLUSH_SEGMENTS = 1 << 16
SHARD_BYTES = 8 << 20
MERGE_BYTES = 2 << 20
SEGMENT = LENGTH + (LENGTH - ANCHOR) // 2  # usual bytes of a segment, for the number of shards
#: Documents with repeated strings whose spans are joined by a broadcast (some 100 bytes each); beyond, by a shuffle.
BROADCAST_DOCUMENTS = 300_000


def _prefix_sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    value = (raw.astype(U64) + U64(1)) * GOLD
    value ^= value >> U64(29)
    value *= powers(BASE, len(raw))
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum(value, out=total[1:])
    return total, powers(UNBASE, len(raw) + 1)


def _range_hashes(total: np.ndarray, inverse: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    h = total[end] - total[start]
    h *= inverse[start]
    return mixed(h)


def _window_min(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by block-wise running minima."""
    n = len(key)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, U64)
    padded[:n] = key
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def segments(raw: np.ndarray, offsets: np.ndarray):
    """(anchor hash, first window, last window) of all segments."""
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return np.zeros(0, U64), none, none
    total, inverse = _prefix_sums(raw)
    grams = np.subtract(total[ANCHOR:], total[:-ANCHOR])
    grams *= inverse[: len(grams)]
    grams = mixed(grams)
    bits = U64(int(n).bit_length())
    key = (grams >> bits << bits) | np.arange(len(grams), dtype=U64)
    anchor = (_window_min(key, LENGTH - ANCHOR + 1) & ((U64(1) << bits) - U64(1))).astype(np.int64)
    # A window belongs to a document if the document's end is at least LENGTH away.
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(anchor)]
    inside = np.flatnonzero(ends - np.arange(len(anchor)) >= LENGTH)
    if not len(inside):
        return np.zeros(0, U64), none, none
    own = anchor[inside]
    new = np.concatenate(([True], (own[1:] != own[:-1]) | (np.diff(inside) > 1)))
    first = inside[new]
    last = inside[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(inside) - 1]))]
    return grams[own[new]], first, last


def _digests(data: bytes, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """128 bits of the BLAKE2b of each segment's bytes, as two numbers; the bytes fix its windows and its anchor's place."""
    found = b"".join(blake2b(data[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), (last + LENGTH).tolist(), strict=True))
    return np.frombuffer(found, U64).reshape(-1, 2)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchor hashes with their counts and extreme digests, for a bounded number of segments at a time."""
    kept, held = [], 0

    def told():
        anchor, digest = (np.concatenate(x) for x in zip(*kept, strict=True))
        order = np.lexsort((digest, anchor))
        anchor, digest = anchor[order].view(np.int64), digest[order].view(np.int64)
        start = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))) if len(anchor) else np.zeros(0, np.int64)
        end = np.append(start[1:], len(anchor))
        columns = (anchor[start], end - start, np.minimum.reduceat(digest, start), np.maximum.reduceat(digest, start)) if len(start) else (anchor,) * 4
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "n", "low", "high"])

    for batch in batches:
        for part in pieces(batch, "_text", 1 << 20):
            raw, offsets = flat(part.column("_text"))
            gram, first, last = segments(raw, offsets)
            if len(gram):
                kept.append((gram, _digests(raw.tobytes(), first, last)[:, 0]))
                held += len(gram)
            if held > FLUSH_SEGMENTS * 4:
                yield told()
                kept, held = [], 0
    if kept:
        yield told()


def _filter_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed bits of the filter, chunk by chunk, from anchors or from such chunks."""
    bits: dict[int, np.ndarray] = {}
    for batch in batches:
        if "anchor" in batch.schema.names:
            bit = (batch.column("anchor").to_numpy().view(U64) >> U64(64 - FILTER_BITS)).astype(np.int64)
            bit = np.concatenate((bit, bit[batch.column("differ").to_numpy(zero_copy_only=False)] + (1 << FILTER_BITS)))
            order = np.argsort(bit, kind="stable")
            bit = bit[order]
            chunk = bit >> CHUNK_BITS
            for c in np.unique(chunk).tolist():
                own = bits.setdefault(c, np.zeros(1 << CHUNK_BITS, bool))
                own[bit[np.searchsorted(chunk, c) : np.searchsorted(chunk, c, "right")] & ((1 << CHUNK_BITS) - 1)] = True
        else:
            for c, packed in zip(batch.column("chunk").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                own = bits.setdefault(c, np.zeros(1 << CHUNK_BITS, bool))
                own |= np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
    if bits:
        yield pa.RecordBatch.from_arrays([pa.array(list(bits), pa.int64()), pa.array([np.packbits(b).tobytes() for b in bits.values()], pa.binary())], ["chunk", "bits"])


def _repeated_filters(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Bit filters of the repeated anchors and of those whose segments differ (FILTER_BITS bits each, whatever the input), and the bits set in the second."""
    counted = rows.select("_text").mapInArrow(_anchors, "anchor long, n long, low long, high long")
    counted = counted.groupBy("anchor").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).where("n > 1")
    parts = counted.select("anchor", F.expr("low <> high").alias("differ")).mapInArrow(_filter_chunks, "chunk long, bits binary")
    chunks = parts.repartition("chunk").mapInArrow(_filter_chunks, "chunk long, bits binary")
    found = np.zeros(2 << (FILTER_BITS - 3), np.uint8)
    total = 0
    for chunk, bits in chunks.collect():
        own = np.frombuffer(bits, np.uint8)
        found[chunk << (CHUNK_BITS - 3) : (chunk + 1) << (CHUNK_BITS - 3)] = own
        total += int(np.bitwise_count(own).sum()) if chunk >> (FILTER_BITS - CHUNK_BITS) else 0
    return found, total


def _candidates(shared, kind):
    """Segments of repeated anchors; equal ones of a task are one row with the list of their places.

    Their bytes come along only where segments of the anchor differ.
    """

    def emit(batches):
        wanted = shared.value
        held: dict[tuple, list] = {}

        def told():
            keys, items = list(held), list(held.values())
            flat_rows = [o for item in items for o in item[1]]
            sizes = np.array([len(item[1]) for item in items], np.int32)
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array([o[i] for o in flat_rows], t)) for i, t in enumerate((kind, pa.int64(), pa.int64()))]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.array([k[0] for k in keys], U64).view(np.int64)),
                    pa.array(np.array([k[1] for k in keys], U64).view(np.int64)),
                    pa.array(np.array([k[2] for k in keys], U64).view(np.int64)),
                    pa.array([k[3] for k in keys], pa.int64()),
                    pa.array([item[0] for item in items], pa.binary()),
                    *lists,
                ],
                ["anchor", "digest", "digest2", "windows", "bytes", "ids", "hashes", "starts"],
            )

        for batch in batches:
            for part in pieces(batch, "_text", 1 << 20):
                raw, offsets = flat(part.column("_text"))
                gram, first, last = segments(raw, offsets)
                bit = (gram >> U64(64 - FILTER_BITS)).astype(np.int64)
                hit = np.flatnonzero((wanted[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1)
                if not len(hit):
                    continue
                gram, first, last = gram[hit], first[hit], last[hit]
                data = raw.tobytes()
                digest = _digests(data, first, last)
                bit = bit[hit] + (1 << FILTER_BITS)
                differ = ((wanted[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1).tolist()
                doc = np.searchsorted(offsets, first, "right") - 1
                ids, hashes = part.column("_id").take(pa.array(doc)).to_pylist(), part.column("_hash").to_numpy()[doc].tolist()
                for i, key in enumerate(zip(gram.tolist(), digest[:, 0].tolist(), digest[:, 1].tolist(), (last - first + 1).tolist(), strict=True)):
                    if key not in held:
                        held[key] = (data[first[i] : last[i] + LENGTH] if differ[i] else None, [])
                    held[key][1].append((ids[i], hashes[i], int(first[i] - offsets[doc[i]])))
                if len(held) > FLUSH_SEGMENTS // 4:
                    yield told()
                    held = {}
        if held:
            yield told()

    return emit


def merged_repeats(texts: list[bytes]) -> list[np.ndarray]:
    """For each text, which 400-byte windows occur at two places or more in all of them.

    Every text is a shard with a transform of its own: the rows are its suffixes, their
    symbols the names of the STEP bytes before. The interleave starts with shard after
    shard and is refined LENGTH / STEP times.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(sizes)
    shard = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(raw)) - (ends - sizes)[shard]
    total, inverse = _prefix_sums(raw)
    # The symbol of a row: the name of the STEP bytes before it; a row with fewer has none and ends its chain.
    name = np.zeros(len(raw) + 1, U64)
    far = np.flatnonzero(np.arange(len(raw) + 1) >= STEP)
    name[far] = _range_hashes(total, inverse, far - STEP, far)
    rows = np.concatenate((np.arange(len(raw)), ends))  # suffixes, the empty one of each shard included
    before = np.concatenate((place, sizes))
    block = np.zeros(len(rows), np.int64)
    for _ in range(LENGTH // STEP):
        able = before >= STEP
        rows, before, block = rows[able], before[able], block[able]
        symbol = name[rows]
        order = np.argsort(symbol, kind="stable")
        rows, before, block, symbol = rows[order], before[order], block[order], symbol[order]
        new = np.zeros(len(rows), bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        block = np.cumsum(new)
        rows, before = rows - STEP, before - STEP
    out = np.zeros(len(raw) + 1, bool)
    if len(rows):
        width = np.bincount(block)
        out[rows[width[block] > 1]] = True
    return [out[e - s : max(e - s, e - LENGTH + 1)] for e, s in zip(ends, sizes, strict=True)]


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of repeated windows, from candidate segments sorted by anchor."""

    def judged(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        anchor, digest, digest2 = (table[c].to_numpy() for c in ("anchor", "digest", "digest2"))
        windows = table["windows"].to_numpy()
        lists = table["starts"].combine_chunks()
        count = np.diff(lists.offsets.to_numpy())
        group = np.unique(np.stack((anchor, digest, digest2), 1), axis=0, return_inverse=True)[1].reshape(-1)
        copies = np.bincount(group, count)[group]
        first = np.zeros(len(anchor), bool)
        first[np.unique(group, return_index=True)[1]] = True
        of_anchor = np.unique(anchor, return_inverse=True)[1].reshape(-1)
        kinds = np.bincount(of_anchor[first])[of_anchor]
        marks: dict[int, np.ndarray] = {}
        merge = np.flatnonzero(first & (kinds > 1))
        merge = merge[np.argsort(anchor[merge], kind="stable")]
        data = table["bytes"].combine_chunks()
        lengths = windows[merge] + LENGTH - 1
        start = 0
        while start < len(merge):
            stop = start + max(1, int(np.searchsorted(np.cumsum(lengths[start:]), MERGE_BYTES)))
            while stop < len(merge) and anchor[merge[stop]] == anchor[merge[stop - 1]]:
                stop += 1
            found = merged_repeats([data[int(i)].as_py() for i in merge[start:stop]])
            for i, mark in zip(merge[start:stop], found, strict=True):
                marks[int(group[i])] = mark
            start = stop
        ids, hashes, starts = lists_of(table, "ids"), lists_of(table, "hashes"), lists.flatten().to_numpy()
        at = np.concatenate(([0], np.cumsum(count)))
        take, begin, end = [], [], []
        for i in range(len(anchor)):
            if copies[i] > 1:
                spans = [(0, int(windows[i]) - 1 + LENGTH)]
            elif (mark := marks.get(int(group[i]))) is not None and mark.any():
                spans = [(int(a), int(b) - 1 + LENGTH) for a, b in zip(*spans_of(mark), strict=True)]
            else:
                continue
            for k in range(at[i], at[i + 1]):
                for a, b in spans:
                    take.append(k)
                    begin.append(int(starts[k]) + a)
                    end.append(int(starts[k]) + b)
        if take:
            picked = pa.array(take)
            yield pa.RecordBatch.from_arrays([ids.take(picked), hashes.take(picked), pa.array(begin), pa.array(end)], ["_id", "_hash", "begin", "end"])

    def lists_of(table, name):
        return table[name].combine_chunks().flatten()

    held, size, now = [], 0, None
    for batch in batches:
        column = batch.column("anchor").to_numpy()
        if not len(column):
            continue
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(column)) + 1, [len(column)]))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if column[i] != now and size > MERGE_BYTES:
                yield from judged(held)
                held, size = [], 0
            now = column[i]
            held.append(batch.slice(i, j - i))
            size += int(batch.column("windows").slice(i, j - i).to_numpy().sum()) // 4 + (j - i) * LENGTH // 4
    if held:
        yield from judged(held)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _hash, _spans): for each text with repeated strings the maximal (begin, end) runs of them."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_hash"))
    wanted, total = _repeated_filters(rows)
    shared = spark.sparkContext.broadcast(wanted)  # twice 2**FILTER_BITS bits
    found = rows.mapInArrow(_candidates(shared, to_arrow_type(docs.schema[id_col].dataType)), f"anchor long, digest long, digest2 long, windows long, bytes binary, ids array<{kind}>, hashes array<long>, starts array<long>")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * total * SEGMENT // SHARD_BYTES)
    found = found.repartition(int(shards), "anchor").sortWithinPartitions("anchor")
    spans = found.mapInArrow(_repeats, f"_id {kind}, _hash long, begin long, end long")
    runs = """aggregate(array_sort(collect_list(struct(begin, end))), cast(array() as array<struct<begin: bigint, end: bigint>>), (a, s) ->
        CASE WHEN size(a) > 0 AND s.begin <= element_at(a, -1).end
             THEN concat(slice(a, 1, size(a) - 1), array(named_struct('begin', element_at(a, -1).begin, 'end', greatest(element_at(a, -1).end, s.end))))
             ELSE concat(a, array(s)) END)"""
    return spans.groupBy("_id", "_hash").agg(F.expr(runs).alias("_spans"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "_text"):
            raw, offsets = flat(part.column("_text"))
            data = raw.tobytes()
            out = []
            for d, spans in enumerate(part.column("_spans").to_pylist()):
                text = data[offsets[d] : offsets[d + 1]]
                runs: list[list[int]] = []
                for s in sorted((s["begin"], s["end"]) for s in spans or ()):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1])
                    else:
                        runs.append([*s])
                kept, at = [], 0
                for a, b in runs:
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                out.append((len(text), sum(b - a for a, b in runs), len(runs), hashlib.sha256(b"".join(kept)).hexdigest(), runs))
            columns = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))))]
            yield pa.RecordBatch.from_arrays([part.column("_id"), *columns], ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    A byte is removed if it lies in a 400-byte string that starts at another place too, in
    this document or any other row; strings are judged on the input, as UTF-8 bytes,
    and never cross documents. Null text is empty; texts under 400 bytes lose nothing.
    A row that repeats another (same id or not) repeats all of its strings. ``spans`` are the
    maximal removed runs. Other columns are not read; an empty table gives no rows.
    """
    spans = written(repeated_spans(docs, id_col, text_col), "repeated-spans").withColumnsRenamed({"_id": "_span_id", "_hash": "_span_hash"})
    if spans.count() <= BROADCAST_DOCUMENTS:
        spans = F.broadcast(spans)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_hash"))
    rows = rows.join(spans, rows["_id"].eqNullSafe(spans["_span_id"]) & (rows["_hash"] == spans["_span_hash"]), "left")
    kind = docs.schema[id_col].dataType.simpleString()
    cut = rows.select("_id", "_text", "_spans").mapInArrow(_cut, f"_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>")
    return cut.withColumnRenamed("_id", id_col)
