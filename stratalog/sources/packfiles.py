"""Pack and index files: binary readers and writers.

``read_packs`` gives the objects of whole packs, ``read_indexes`` the columns of index
files; both read through Spark's ``binaryFile`` source, so any store that Spark
reads will do. ``build_pack`` and ``build_index`` are the sinks.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions import codec

#: Fixed values of the formats.
PACK_MAGIC, INDEX_MAGIC = b"PACK", bytes.fromhex("ff744f63")
TRAILER = 20


def build_pack(objects: list[tuple[str, bytes]]) -> bytes:
    """A pack of (type, payload) objects, in the given order, without deltas."""
    out = bytearray(PACK_MAGIC + struct.pack(">II", 2, len(objects)))
    for kind, payload in objects:
        out += codec.object_header(codec.TYPE_CODES[kind], len(payload)) + zlib.compress(payload)
    return bytes(out) + hashlib.sha1(out).digest()


def _inflated(data: bytes, at: int) -> tuple[bytes, int]:
    """The stream that begins at ``at``, and where it ends; read some 64 KB at a time."""
    engine, out, view = zlib.decompressobj(), [], memoryview(data)
    while not engine.eof and at < len(data):
        part = view[at : at + 65536]
        out.append(engine.decompress(part))
        at += len(part) - len(engine.unused_data)
    return b"".join(out), at


def read_pack(data: bytes) -> list[dict]:
    """oid, type, payload, offset, next_offset, delta (whether stored as one) of each object; deltas are applied.

    An object whose base is not in the pack has a null payload.
    """
    if data[:4] != PACK_MAGIC:
        return []
    count, at, raw, names = struct.unpack(">I", data[8:12])[0], 12, {}, {v: k for k, v in codec.TYPE_CODES.items()}
    for _ in range(count):
        head = codec.read_entry_header(data, at)
        payload, end = _inflated(data, at + head["header_len"])
        raw[at] = head | {"payload": payload, "next_offset": end}
        at = end
    done: dict[int, tuple[str, bytes]] = {}
    by_oid: dict[str, int] = {}
    pending = list(raw)
    while pending:
        later = []
        for offset in pending:
            entry = raw[offset]
            if entry["type"] in names:
                done[offset] = names[entry["type"]], entry["payload"]
            else:
                base = offset - entry["base_distance"] if entry["base_distance"] is not None else by_oid.get(entry["base_oid"])
                if base not in done:
                    later.append(offset)
                    continue
                done[offset] = done[base][0], codec.apply_delta(done[base][1], entry["payload"])
            by_oid[codec.oid_of(*done[offset])] = offset
        if len(later) == len(pending):
            break
        pending = later
    rows = []
    for offset, entry in raw.items():
        kind, payload = done.get(offset, (None, None))
        rows.append({"oid": codec.oid_of(kind, payload) if kind else None, "type": kind, "payload": payload, "offset": offset, "next_offset": entry["next_offset"], "delta": entry["type"] not in names})
    return rows


def build_index(rows: list[dict], pack: bytes) -> bytes:
    """An index (version 2) over rows with oid and offset."""
    rows = sorted(rows, key=lambda r: r["oid"])
    first = [int(r["oid"][:2], 16) for r in rows]
    fan = [bisect_right(first, b) for b in range(256)]
    large = [r["offset"] for r in rows if r["offset"] >= 1 << 31]
    place = {o: i for i, o in enumerate(large)}
    out = INDEX_MAGIC + struct.pack(">I", 2) + struct.pack(">256I", *fan)
    out += b"".join(bytes.fromhex(r["oid"]) for r in rows) + b"\0\0\0\0" * len(rows)
    out += b"".join(struct.pack(">I", (1 << 31) | place[r["offset"]] if r["offset"] >= 1 << 31 else r["offset"]) for r in rows)
    out += b"".join(struct.pack(">Q", o) for o in large) + pack[-TRAILER:]
    return out + hashlib.sha1(out).digest()


def read_index(data: bytes) -> list[tuple[str, int]]:
    """(oid, offset) in index order; nothing if it is not an index of version 2 or 3."""
    if data[:4] != INDEX_MAGIC or struct.unpack(">I", data[4:8])[0] not in (2, 3) or len(data) < 8 + 1024:
        return []
    n = struct.unpack(">I", data[8 + 1020 : 8 + 1024])[0]
    names = 8 + 1024
    small = names + 24 * n
    large = small + 4 * n
    if len(data) < large + 2 * TRAILER:
        return []
    out = []
    for i in range(n):
        offset = struct.unpack(">I", data[small + 4 * i : small + 4 * i + 4])[0]
        if offset >> 31:
            offset = struct.unpack(">Q", data[large + 8 * (offset & 0x7FFFFFFF) :][:8])[0]
        out.append((data[names + 20 * i : names + 20 * i + 20].hex(), offset))
    return out


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """pack, size of the pack files in a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pack").load(folder)
    return files.select(F.substring_index("path", "/", -1).alias("pack"), F.col("length").alias("size"))


def read_packs(spark: SparkSession, folder: str) -> DataFrame:
    """pack and the columns of :func:`read_pack` for every pack that has an index beside it."""
    load = lambda glob: spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    stem = F.regexp_extract("path", r"([^/]+)\.(pack|idx)$", 1)
    return decode_packs(load("*.pack").select(stem.alias("pack"), "content").join(load("*.idx").select(stem.alias("pack")), "pack", "left_semi"))


def decode_packs(files: DataFrame) -> DataFrame:
    """pack and the columns of :func:`read_pack` of files (pack, content); what is not a pack gives no rows."""

    def decode(parts):
        for part in parts:
            for pack, content in zip(part["pack"], part["content"], strict=True):
                rows = read_pack(bytes(content))
                if rows:
                    yield pd.DataFrame(rows).assign(pack=pack)[["pack", "oid", "type", "payload", "offset", "next_offset", "delta"]]

    return files.mapInPandas(decode, "pack string, oid string, type string, payload binary, offset long, next_offset long, delta boolean")


def read_indexes(spark: SparkSession, folder: str) -> DataFrame:
    """pack, position, oid, offset of every index file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.idx").load(folder)
    return decode_indexes(files.select(F.regexp_extract("path", r"([^/]+)\.idx$", 1).alias("pack"), "content"))


def decode_indexes(files: DataFrame) -> DataFrame:
    """pack, position, oid, offset of index files (pack, content)."""

    def decode(parts):
        for part in parts:
            for pack, content in zip(part["pack"], part["content"], strict=True):
                rows = read_index(bytes(content))
                yield pd.DataFrame({"pack": pack, "position": range(len(rows)), "oid": [r[0] for r in rows], "offset": [r[1] for r in rows]})

    return files.mapInPandas(decode, "pack string, position long, oid string, offset long")


def write_packs(objects: DataFrame) -> DataFrame:
    """pack, content, index for objects (pack, pos, type, payload): one pack for each key, objects by pos."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos", kind="stable")
        data = build_pack([(t, bytes(p)) for t, p in zip(rows["type"], rows["payload"], strict=True)])
        return pd.DataFrame({"pack": [rows["pack"].iloc[0]], "content": [data], "index": [build_index(read_pack(data), data)]})

    return objects.groupBy("pack").applyInPandas(build, "pack string, content binary, index binary")
