"""Golden values and round trips of the binary formats."""

import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from stratalog.functions import codec
from stratalog.sources import packfiles

#: Distances and their encodings.
DISTANCES = {0x1: "01", 0x7F: "7f", 0x80: "8000", 0x81: "8001", 0x100: "8100", 0x3FFF: "fe7f", 0x4000: "ff00", 0x1FFFF: "86fe7f", 0x20000: "86ff00"}


def test_object_ids():
    assert codec.oid_of("blob", b"abc") == "f2ba8f84ab5c1bce84a7b441cb1959cfc7093b7f"
    assert codec.oid_of("tree", b"") == "4b825dc642cb6eb9a060e54bf8d69288fbee4904"


@pytest.mark.parametrize("distance,wanted", DISTANCES.items())
def test_offset_distance(distance, wanted):
    assert codec.offset_distance(distance).hex() == wanted


@given(st.integers(1, 2**40), st.integers(0, 2**40))
def test_entry_header_round_trip(distance, size):
    data = codec.object_header(codec.OFFSET_DELTA, size) + codec.offset_distance(distance)
    head = codec.read_entry_header(data, 0)
    assert (head["type"], head["size"], head["base_distance"], head["header_len"]) == (codec.OFFSET_DELTA, size, distance, len(data))


@pytest.mark.parametrize("kind", codec.TYPE_CODES)
def test_object_round_trip(kind):
    assert codec.decode_object(zlib.compress(codec.encode_object(kind, b"x\0y"))) == (kind, b"x\0y")


def test_garbage_is_no_object():
    assert codec.decode_object(b"garbage") is None
    assert codec.decode_object(zlib.compress(b"nonsense")) is None


def test_tree_entries_ignore_a_truncated_tail():
    entry = b"100644 a.txt\0" + bytes(range(20))
    assert codec.tree_entries(entry + b"40000 dir\0" + b"\1" * 19) == [("100644", "a.txt", bytes(range(20)).hex())]


def test_pkt_lines():
    assert codec.parse_pkt_lines(b"0006a\n0001" + b"00000002") == [("line", b"a\n"), ("delim", b""), ("flush", b""), ("end", b"")]
    assert codec.parse_pkt_lines(b"0006a\nzzzz") == [("line", b"a\n")]


def test_tokens():
    stored = codec.hash_token("secret", b"0123456789abcdef", 1000)
    assert codec.verify_token("secret", stored) and not codec.verify_token("other", stored)


def test_pack_and_index_round_trip():
    objects = [("blob", b"one"), ("tree", b""), ("commit", b"tree x")]
    pack = packfiles.build_pack(objects)
    rows = packfiles.read_pack(pack)
    assert [(r["type"], r["payload"]) for r in rows] == objects
    assert rows[-1]["next_offset"] == len(pack) - packfiles.TRAILER
    index = packfiles.read_index(packfiles.build_index(rows, pack))
    assert index == sorted((r["oid"], r["offset"]) for r in rows)
    assert packfiles.read_index(b"nothing") == []


def test_deltas_are_applied():
    base, target = b"hello world", b"hello brave world"
    delta = bytes([len(base), len(target), 0x90, 6, 6]) + b"brave " + bytes([0x91, 6, 5])
    assert codec.apply_delta(base, delta) == target
    head = packfiles.PACK_MAGIC + (2).to_bytes(4, "big") + (2).to_bytes(4, "big")
    first = codec.object_header(3, len(base)) + zlib.compress(base)
    second = codec.object_header(codec.OFFSET_DELTA, len(delta)) + codec.offset_distance(len(first)) + zlib.compress(delta)
    rows = packfiles.read_pack(head + first + second + b"\0" * 20)
    assert rows[1]["payload"] == target and rows[1]["delta"] and rows[1]["oid"] == codec.oid_of("blob", target)


def test_packs_are_read_by_spark(spark, tmp_path):
    pack = packfiles.build_pack([("blob", b"one"), ("blob", b"two")])
    (tmp_path / "pack-1.pack").write_bytes(pack)
    (tmp_path / "pack-1.idx").write_bytes(packfiles.build_index(packfiles.read_pack(pack), pack))
    (tmp_path / "pack-2.pack").write_bytes(pack)  # without an index it is skipped
    assert packfiles.listing(spark, str(tmp_path)).count() == 2
    assert {bytes(r["payload"]) for r in packfiles.read_packs(spark, str(tmp_path)).collect()} == {b"one", b"two"}
    assert packfiles.read_indexes(spark, str(tmp_path)).count() == 2
    made = packfiles.write_packs(spark.createDataFrame([("p", 0, "blob", bytearray(b"z"))], "pack string, pos int, type string, payload binary")).first()
    assert packfiles.read_pack(bytes(made["content"]))[0]["payload"] == b"z"
