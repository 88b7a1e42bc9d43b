"""Object ids, object and commit parsing, varints, pkt-lines.

What columns can express is a column expression; the binary layouts are Arrow
functions over the pure functions here, which tests hold against golden values.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Type codes of stored objects; 6 and 7 are deltas by offset and by id.
TYPE_CODES = {"commit": 1, "tree": 2, "blob": 3, "tag": 4}
OFFSET_DELTA, ID_DELTA = 6, 7
SIDEBAND_BYTES = 65515


def object_id(kind: Column, payload: Column) -> Column:
    """SHA-1 of "<type> <length>", a zero byte and the payload."""
    payload = payload.cast("binary")
    head = F.concat(kind, F.lit(" "), F.octet_length(payload).cast("string")).cast("binary")
    return F.sha1(F.concat(head, F.unhex(F.lit("00")), payload))


def is_oid(text: Column) -> Column:
    return text.rlike("^[0-9a-fA-F]{40}$")


def signature(line: Column) -> Column:
    """struct(name, email, when, tz) of "name <email> epoch zone"; null if it is not of that form."""
    form = r"^(.*) <([^>]+)> (\d+) ([+-]\d{4})$"
    part = lambda i: F.regexp_extract(line, form, i)
    return F.when(line.rlike(form), F.struct(part(1).alias("name"), part(2).alias("email"), part(3).cast("long").alias("when"), part(4).alias("tz")))


def commit_fields(text: Column) -> Column:
    """struct(tree, parents, author, committer, message) of a commit's text. Only the header block is parsed."""
    cut = F.instr(text, "\n\n")
    head = F.when(cut > 0, F.substring(text, F.lit(1), cut)).otherwise(text)
    one = lambda key, form: F.nullif(F.regexp_extract(head, rf"(?m)^{key} {form}$", 1), F.lit(""))
    return F.struct(
        one("tree", "([0-9a-f]{40})").alias("tree"),
        F.regexp_extract_all(head, F.lit(r"(?m)^parent ([0-9a-f]{40})$"), 1).alias("parents"),
        signature(one("author", "(.*)")).alias("author"),
        signature(one("committer", "(.*)")).alias("committer"),
        F.when(cut > 0, F.substring(text, cut + 2, F.length(text))).otherwise(F.lit("")).alias("message"),
    )


def tag_target(text: Column) -> Column:
    """struct(oid, type) of an annotated tag; null unless both lines are there."""
    oid, kind = F.regexp_extract(text, r"(?m)^object ([0-9a-fA-F]{40})", 1), F.regexp_extract(text, r"(?m)^type (\w+)", 1)
    return F.when((oid != "") & (kind != ""), F.struct(F.lower(oid).alias("oid"), kind.alias("type")))


def pkt_line(payload: Column) -> Column:
    """Four hex digits of the length, themselves included, and the payload."""
    return F.concat(F.lower(F.lpad(F.hex(F.octet_length(payload) + 4), 4, "0")).cast("binary"), payload.cast("binary"))


def frames(payload: Column, channel: int = 1) -> Column:
    """array(struct(seq, frame)) of a payload: each frame is the channel byte and SIDEBAND_BYTES at most; none for nothing."""
    n = F.octet_length(payload)
    each = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(n / SIDEBAND_BYTES).cast("int") - 1, F.lit(0))),
        lambda i: F.struct(i.cast("long").alias("seq"), F.concat(F.lit(bytes([channel])), F.substring(payload, (i * SIDEBAND_BYTES + 1), F.lit(SIDEBAND_BYTES))).alias("frame")),
    )
    return F.when(n > 0, each).otherwise(F.array().cast("array<struct<seq: bigint, frame: binary>>"))


FLUSH, DELIM, END = b"0000", b"0001", b"0002"  # fixed values: packets without a payload


# Pure functions over bytes.


def encode_object(kind: str, payload: bytes) -> bytes:
    return b"%s %d\0" % (kind.encode(), len(payload)) + payload


def oid_of(kind: str, payload: bytes) -> str:
    return hashlib.sha1(encode_object(kind, payload)).hexdigest()


def decode_object(stored: bytes) -> tuple[str, bytes] | None:
    """(type, payload) of a deflated object; None for anything else."""
    try:
        raw = zlib.decompress(stored)
    except zlib.error:
        return None
    head, nul, payload = raw.partition(b"\0")
    kind = head.split(b" ")[0].decode("latin-1")
    return (kind, payload) if nul and kind in TYPE_CODES else None


def tree_entries(payload: bytes) -> list[tuple[str, str, str]]:
    """(mode, name, oid) of each entry; a truncated tail is ignored."""
    out, at = [], 0
    while (space := payload.find(b" ", at)) >= 0 and (nul := payload.find(b"\0", space)) >= 0 and nul + 21 <= len(payload):
        out.append((payload[at:space].decode(), payload[space + 1 : nul].decode("utf-8", "replace"), payload[nul + 1 : nul + 21].hex()))
        at = nul + 21
    return out


def object_header(code: int, size: int) -> bytes:
    """Type and size of a pack entry: four bits of size in the first byte, then seven a byte, low first."""
    out, rest = [(code << 4) | (size & 15)], size >> 4
    while rest:
        out[-1] |= 0x80
        out.append(rest & 0x7F)
        rest >>= 7
    return bytes(out)


def offset_distance(distance: int) -> bytes:
    """Distance to an offset-delta's base: seven bits a byte, high first, one less in every further byte."""
    out = [distance & 0x7F]
    while distance := distance >> 7:
        distance -= 1
        out.append(0x80 | (distance & 0x7F))
    return bytes(reversed(out))


def read_entry_header(data: bytes, at: int) -> dict:
    """type, size, header_len, and base_distance or base_oid of the pack entry at ``at``."""
    start, byte = at, data[at]
    kind, size, shift = (byte >> 4) & 7, byte & 15, 4
    while byte & 0x80:
        at += 1
        byte = data[at]
        size |= (byte & 0x7F) << shift
        shift += 7
    at += 1
    out = {"type": kind, "size": size, "base_distance": None, "base_oid": None}
    if kind == OFFSET_DELTA:
        byte = data[at]
        distance = byte & 0x7F
        while byte & 0x80:
            at += 1
            byte = data[at]
            distance = ((distance + 1) << 7) | (byte & 0x7F)
        at += 1
        out["base_distance"] = distance
    elif kind == ID_DELTA:
        out["base_oid"] = data[at : at + 20].hex()
        at += 20
    return out | {"header_len": at - start}


def apply_delta(base: bytes, delta: bytes) -> bytes:
    """The target that a delta's copy and insert instructions build from its base."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (delta[at] & 0x7F) << shift
            shift += 7
            at += 1
            if not delta[at - 1] & 0x80:
                return value, at

    _, at = number(0)
    wanted, at = number(at)
    out = bytearray()
    while at < len(delta):
        op = delta[at]
        at += 1
        if op & 0x80:
            place = length = 0
            for bit in range(7):
                if op & (1 << bit):
                    if bit < 4:
                        place |= delta[at] << (8 * bit)
                    else:
                        length |= delta[at] << (8 * (bit - 4))
                    at += 1
            length = length or 0x10000
            out += base[place : place + length]
        else:
            out += delta[at : at + op]
            at += op
    if len(out) != wanted:
        raise ValueError("a delta gives another length than it states")
    return bytes(out)


def parse_pkt_lines(stream: bytes) -> list[tuple[str, bytes]]:
    """(kind, payload): line, flush, delim or end; stops at what is malformed."""
    out, at = [], 0
    kinds = {0: "flush", 1: "delim", 2: "end"}
    while at + 4 <= len(stream):
        try:
            size = int(stream[at : at + 4], 16)
        except ValueError:
            break
        if size in kinds:
            out.append((kinds[size], b""))
            at += 4
            continue
        if size < 4 or at + size > len(stream):
            break
        out.append(("line", stream[at + 4 : at + size]))
        at += size
    return out


def hash_token(token: str, salt: bytes, rounds: int = 100_000) -> str:
    return f"{salt.hex()}:{rounds}:{hashlib.pbkdf2_hmac('sha256', token.encode(), salt, rounds).hex()}"


def verify_token(token: str, stored: str) -> bool:
    salt, rounds, _ = stored.split(":")
    return hash_token(token, bytes.fromhex(salt), int(rounds)) == stored


def encoded(kind: Column, payload: Column) -> Column:
    """"<type> <length>", a zero byte and the payload."""
    return F.concat(F.concat(kind, F.lit(" "), F.octet_length(payload).cast("string")).cast("binary"), F.unhex(F.lit("00")), payload)


def tree_payload(entries: Column) -> Column:
    """The bytes of a tree with entries array(struct(mode, name, oid)), in the given order."""
    one = lambda e: F.concat(F.concat(e["mode"], F.lit(" "), e["name"]).cast("binary"), F.unhex(F.lit("00")), F.unhex(e["oid"]))
    return joined(F.transform(entries, one))


def joined(parts: Column) -> Column:
    """One binary of an array of them, by way of hex digits, which join in linear time."""
    return F.unhex(F.array_join(F.transform(parts, F.hex), ""))


def object_header_of(code: Column, size: Column) -> Column:
    """:func:`object_header` as a column: up to 2**46."""
    more = lambda k: F.when(F.shiftright(size, 4 + 7 * k) > 0, _byte(F.shiftright(size, 4 + 7 * k).bitwiseAND(F.lit(127)) + F.when(F.shiftright(size, 11 + 7 * k) > 0, 128).otherwise(0))).otherwise(F.lit(b""))
    first = _byte(code * 16 + size.bitwiseAND(F.lit(15)) + F.when(size >= 16, 128).otherwise(0))
    return F.concat(first, *(more(k) for k in range(6)))


def offset_distance_of(distance: Column) -> Column:
    """:func:`offset_distance` as a column: up to five bytes. Each further byte stands for one less."""
    steps, rest = [F.lit(0).cast("long") + distance], distance
    for _ in range(4):
        rest = F.shiftright(rest, 7) - 1
        steps.append(rest)
    part = lambda k: F.when(steps[k] >= 0, _byte(steps[k].bitwiseAND(F.lit(127)) + (128 if k else 0))).otherwise(F.lit(b""))
    return F.concat(*(part(k) for k in range(4, -1, -1)))


def _byte(value: Column) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2, "0"))


@cache
def _binary_functions() -> dict:
    """Arrow functions over bytes; made when a session is there."""

    @F.arrow_udf("binary")
    def deflate(data: pa.Array) -> pa.Array:
        return pa.array([None if x is None else zlib.compress(x) for x in data.to_pylist()], pa.binary())

    @F.arrow_udf("struct<type: bigint, size: bigint, base_distance: bigint, base_oid: string, header_len: bigint>")
    def header(data: pa.Array) -> pa.Array:
        kind = pa.struct([("type", pa.int64()), ("size", pa.int64()), ("base_distance", pa.int64()), ("base_oid", pa.string()), ("header_len", pa.int64())])
        return pa.array([None if x is None else read_entry_header(x, 0) for x in data.to_pylist()], kind)

    @F.arrow_udf("boolean")
    def matches(token: pa.Array, stored: pa.Array) -> pa.Array:
        return pa.array([None if t is None or s is None else verify_token(t, s) for t, s in zip(token.to_pylist(), stored.to_pylist(), strict=True)], pa.bool_())

    @F.arrow_udf("array<struct<mode: string, name: string, oid: string>>")
    def entries(data: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("mode", pa.string()), ("name", pa.string()), ("oid", pa.string())]))
        return pa.array([None if x is None else [{"mode": m, "name": n, "oid": o} for m, n, o in tree_entries(x)] for x in data.to_pylist()], kind)

    @F.arrow_udf("struct<type: string, payload: binary>")
    def stored(data: pa.Array) -> pa.Array:
        found = [None if x is None else decode_object(x) for x in data.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([f and f[0] for f in found], pa.string()), pa.array([f and f[1] for f in found], pa.binary())], ["type", "payload"])

    @F.arrow_udf("array<struct<kind: string, payload: binary>>")
    def packets(data: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("payload", pa.binary())]))
        return pa.array([None if x is None else [{"kind": k, "payload": p} for k, p in parse_pkt_lines(x)] for x in data.to_pylist()], kind)

    return {"deflate": deflate, "header": header, "matches": matches, "entries": entries, "stored": stored, "packets": packets}


def deflated(data: Column) -> Column:
    return _binary_functions()["deflate"](data)


def entry_header_of(data: Column) -> Column:
    """struct(type, size, base_distance, base_oid, header_len) of a pack entry's first bytes."""
    return _binary_functions()["header"](data)


def token_hash(token: Column, salt_hex: Column, rounds: int = 100_000) -> Column:
    """salt:rounds:hash of a token, by PBKDF2 with SHA-256."""

    @F.arrow_udf("string")
    def stored(t: pa.Array, s: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else hash_token(x, bytes.fromhex(y), rounds) for x, y in zip(t.to_pylist(), s.to_pylist(), strict=True)], pa.string())

    return stored(token, salt_hex)


def token_matches(token: Column, stored: Column) -> Column:
    return _binary_functions()["matches"](token, stored)


def tree_entries_of(payload: Column) -> Column:
    """array(struct(mode, name, oid)) of a tree's payload."""
    return _binary_functions()["entries"](payload)


def stored_object(stored: Column) -> Column:
    """struct(type, payload) of a deflated object; nulls for anything else."""
    return _binary_functions()["stored"](stored)


def pkt_lines(stream: Column) -> Column:
    """array(struct(kind, payload)) of a stream of pkt-lines."""
    return _binary_functions()["packets"](stream)
