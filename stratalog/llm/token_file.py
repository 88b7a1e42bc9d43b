"""Token ids in a file of independent blocks, packed by an adaptive context-mixing range coder.

Three orders predict the next id and are mixed. Order 0 counts the block's ids so far. Order 1 and
order 2 remember, for the last id and the last two, the id that followed, and how sure it
is. Their confidences choose a mixing context, whose adaptive weights add up the three distributions and the
chance of an id that is new in the block. The sum drives one range coder with 64-bit ranges and 32-bit output. A
block also lists its distinct ids, in the order in which they are new.

Every block starts with empty models, and holds its number of ids and their CRC-32. So
blocks are coded side by side, one numpy lane each, and any of them can be read alone.

File format: rows (shard, block, data) in Parquet, read in the order of block. An index record names
documents (id and number of tokens) and stands before the blocks that hold their ids.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalog.llm.scratch import new_path, small_batches, written
from stratalog.llm.textkit import flat, pieces_of

U64 = np.uint64
BLOCK, LANES = 1024, 6144
SHARD_BYTES, MOST_SHARDS, SPAN = 14 << 20, 100_000, 1000
END_ID = 2
#: Ids from here on are refused.
ID_LIMIT = 1 << 24
#: Fixed values of the format.
BLOCK_MAGIC, INDEX_MAGIC, HEAD = b"SLTC", b"SLTI", "<4sIIIII"
HEAD_BYTES = struct.calcsize(HEAD)
RENEW = (96, 384)
HELD = 128  # steps whose places are looked up at once
TWO_BITS, CONTEXTS = 10, 128
PAIR_OLD, PAIR_NEW = np.uint32(60493), np.uint32(40503)
WIDTH_BITS = 13
LONGEST = 4096  # ids of a block at most: widths and numbers have so many bits
#: Mixing counts lie packed in 16-bit fields: order 2, order 1, order 0, new id.
FIRST_COUNTS = 4 | 2 << 16 | 6 << 32 | 6 << 48
CREDIT = 12  # LONGEST credits still fit a field
ONE = np.uint8(1)
#: What is added to the mixing counts if order 2 was right, else order 1, else order 0, else none of them.
CREDITS = np.left_shift(np.int64(CREDIT), np.arange(4) * 16)
#: By confidence, for predictions that were wrong and then for right ones: what is added to the confidence, and whether the prediction is replaced.
STEPS = np.array([-((sure + 1) >> 1) for sure in range(8)] + [sure < 7 for sure in range(8)]).astype(np.uint16)
FORGETS = np.where(np.arange(16) < 2, 0xFFFF, 0).astype(np.uint16)
LEAST = U64(1 << 32)


def picked(into: np.ndarray, other: np.ndarray, mask: np.ndarray) -> None:
    """``other`` goes into ``into`` where ``mask`` has all bits, not where it has none; without branches, unlike np.where."""
    other = into ^ other
    other &= mask
    into ^= other


class Models:
    """Order-0 to order-2 predictions of many lanes and the weights that mix them.

    Ids have numbers in each block, by first occurrence. Order 0 is a line of T places
    on which a number holds as many as it had occurrences at the last renewal, and one if
    it is newer. Order 1 and order 2 each predict one number, with a confidence of 0 to 7. The
    four weights of a mixing context, learned from what came true in it, give
    P(number) = (w0 * places / T + w1 * [order 1 says so] + w2 * [order 2 says so]) / all weights,
    and the rest to an id that is new in the block.
    """

    def __init__(self, lanes: int, steps: int, invert: bool):
        self.cap = steps + 1
        ahead = np.arange(self.cap, dtype=np.int32)
        self.cum = np.tile((ahead << WIDTH_BITS) + 1, lanes)  # start << WIDTH_BITS | width, on the line
        #: For each place on the line: number << 2 * WIDTH_BITS | start << WIDTH_BITS | width.
        self.inverse = np.tile(ahead.astype(np.int64) << 2 * WIDTH_BITS | (ahead << WIDTH_BITS) + 1, lanes) if invert else None
        self.one = np.zeros(lanes * self.cap, np.uint16)
        self.two = np.zeros(lanes << TWO_BITS, np.uint16)
        self.mix = np.full(lanes * CONTEXTS, FIRST_COUNTS, np.int64)
        lane = np.arange(lanes)
        self.base, self.base2, self.base_mix = lane * self.cap, lane << TWO_BITS, lane * CONTEXTS
        self.at_last = self.base  # where the last number of each lane stands in the tables of numbers
        self.line, self.met = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
        self.counts = np.zeros((lanes, self.cap), np.uint16)
        self.counted = 0

    def renew(self, numbers: np.ndarray, n: int, t: int) -> None:
        """Order 0 of the first ``n`` lanes from their first ``t`` numbers (a row for each place).

        Numbers to come get one place each, after those that have been.
        """
        top, cum = int(self.met[:n].max()) + 1, self.cum.reshape(-1, self.cap)
        for i in range(0, n, 64):
            j = min(n, i + 64)
            since = numbers[self.counted : t, i:j] + np.arange(j - i) * top
            counts = self.counts[i:j, :top]
            counts += np.bincount(since.ravel(), minlength=(j - i) * top).reshape(j - i, top).astype(np.uint16)
            whole = np.maximum(counts, 1).astype(np.int32)
            ends = np.cumsum(whole, 1, dtype=np.int32)
            cum[i:j, :top] = (ends - whole) << WIDTH_BITS | whole
            cum[i:j, top:] = ((ends[:, -1:] + np.arange(self.cap - top, dtype=np.int32)) << WIDTH_BITS) + 1
            if self.inverse is not None:
                inverse = self.inverse.reshape(-1, self.cap)[i:j]
                inverse[:, :t] = np.repeat((np.arange(top) << 2 * WIDTH_BITS | cum[i:j, :top]).ravel(), counts.ravel()).reshape(j - i, t)
                inverse[:, t:] = ((np.arange(self.cap - t) + self.met[i:j, None]) << 2 * WIDTH_BITS) + ((np.arange(t, self.cap) << WIDTH_BITS) + 1)
        self.counted = t
        self.line[:n] = t

    def look(self, n: int, pair: np.ndarray) -> None:
        """What the contexts of ``n`` lanes say: the last number and ``pair``, a hash of the last two."""
        self.at1 = self.at_last[:n]
        self.at2 = self.base2[:n] + (pair >> 6 & ((1 << TWO_BITS) - 1))
        self.said1, self.said2 = self.one.take(self.at1), self.two.take(self.at2)
        self.id1, self.id2 = self.said1 >> 3, self.said2 >> 3
        self.sure1, self.sure2 = self.said1 & 7, self.said2 & 7
        self.same = self.id1 == self.id2
        self.at_mix = self.base_mix[:n] + ((self.sure2 << 4) + (self.sure1 << 1) + self.same)
        self.packed = self.mix.take(self.at_mix)
        self.w2, self.w1, self.w0, self.w_new = (self.packed.view(np.uint16)[k::4].astype(np.int32) for k in range(4))
        self.t = self.line[:n]
        self.all_met = (self.w0 + self.w1 + self.w2) * self.t
        self.w_new *= self.t
        self.total = self.all_met + self.w_new

    def places(self, numbers: np.ndarray) -> np.ndarray:
        """start << WIDTH_BITS | width of the numbers of the first lanes (a row for each step), lane by lane, so that each one's line is in the cache."""
        out = np.empty(numbers.shape, np.int32)
        for i in range(0, numbers.shape[1], 64):
            own = numbers[:, i : i + 64].T
            out[:, i : i + 64] = self.cum.take(own + self.base[i : i + own.shape[0], None]).T
        return out

    def interval(self, x: np.ndarray, new: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, width) of each lane's number among ``total``; ``held`` is its place."""
        self.at_last = self.base[: len(x)] + x
        self.is1, self.is2 = self.id1 == x, self.id2 == x
        start = self.w0 * (held >> WIDTH_BITS) + self.t * (self.w2 * (self.id2 < x) + self.w1 * (self.id1 < x))
        width = self.w0 * (held & ((1 << WIDTH_BITS) - 1)) + self.t * (self.w2 * self.is2 + self.w1 * self.is1)
        is_new = -new.view(np.int8).astype(np.int32)
        picked(start, self.all_met, is_new)
        picked(width, self.w_new, is_new)
        return start, width

    def find(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number, whether the id is new, start, width) of the interval that holds ``value``."""
        n, bits = len(value), (1 << WIDTH_BITS) - 1
        swap = self.id1 < self.id2
        m1, m2 = self.w1 * self.t, self.w2 * self.t
        m2 += m1 * self.same
        m1 *= ~self.same
        low, high = np.minimum(self.id1, self.id2), np.maximum(self.id1, self.id2)
        m_both, m_low = m1 + m2, m2
        picked(m_low, m1, -swap.view(np.int8).astype(np.int32))
        m_high = m_both - m_low
        held_low, held_high = self.cum.take(self.base[:n] + low), self.cum.take(self.base[:n] + high)
        start_low = self.w0 * (held_low >> WIDTH_BITS)
        end_low = start_low + self.w0 * (held_low & bits) + m_low
        start_high = self.w0 * (held_high >> WIDTH_BITS) + m_low
        end_high = start_high + self.w0 * (held_high & bits) + m_high
        new = value >= self.all_met
        over_low, over_high = value >= end_low, value >= end_high
        passed = m_low * over_low + m_high * over_high
        place = ((value - passed) / self.w0).astype(np.int32)
        place *= ~new
        np.minimum(np.maximum(place, 0, out=place), self.cap - 1, out=place)
        found = self.inverse.take(self.base[:n] + place)
        x, held = (found >> 2 * WIDTH_BITS).astype(np.uint16), found.astype(np.int32) & ((1 << 2 * WIDTH_BITS) - 1)
        is_high, is_low = (value >= start_high) & ~over_high, (value >= start_low) & ~over_low
        for at, held_at, here in ((high, held_high, is_high), (low, held_low, is_low)):
            mask = -here.view(np.int8).astype(np.int32)
            picked(x, at, mask.astype(np.uint16))
            picked(held, held_at, mask)
        picked(x, self.met[:n].astype(np.uint16), -new.view(np.uint8).astype(np.uint16))
        self.at_last = self.base[:n] + x
        start = self.w0 * (held >> WIDTH_BITS) + passed
        width = self.w0 * (held & bits)
        width += m_low * is_low
        width += m_high * is_high
        is_new = -new.view(np.int8).astype(np.int32)
        picked(start, self.all_met, is_new)
        picked(width, self.w_new, is_new)
        self.is1, self.is2 = self.id1 == x, self.id2 == x
        return x, new, start, width

    def learn(self, x: np.ndarray, new: np.ndarray) -> None:
        field = new.view(np.uint8) + np.uint8(2)  # 0 if order 2 was right, else 1 if order 1 was, else 2 or 3
        picked(field, ONE, -self.is1.view(np.uint8))
        field *= ~self.is2
        packed = self.packed
        packed += CREDITS.take(field)
        self.mix[self.at_mix] = packed
        fresh = (x << 3) + ONE
        for table, at, said, sure, right in ((self.one, self.at1, self.said1, self.sure1, self.is1), (self.two, self.at2, self.said2, self.sure2, self.is2)):
            case = sure + (right.view(np.uint8) << np.uint8(3))
            now = said + STEPS.take(case)
            picked(now, fresh, FORGETS.take(case))
            table[at] = now

    def meet(self, new: np.ndarray) -> None:
        """These lanes have met a new id."""
        self.line[: len(new)] += new
        self.met[: len(new)] += new


def numbered(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers by first occurrence in the row, whether a place is a first occurrence)."""
    lanes, steps = ids.shape
    numbers, new = np.zeros((lanes, steps), np.uint16), np.zeros((lanes, steps), bool)
    top = int(ids.max(initial=0)) + 1
    together = max(1, min(8, (1 << 19) // top))
    place_of = np.empty(top * together, np.uint16)  # only places just written are read
    for i in range(0, lanes, together):
        own = ids[i : i + together]
        n = len(own)
        keys, places = (own + np.arange(n)[:, None] * top).ravel(), np.arange(own.size, dtype=np.uint16)
        place_of[keys[::-1]] = places[::-1]
        first = place_of.take(keys)
        is_first = first == places
        order = np.cumsum(is_first.reshape(n, steps), axis=1, dtype=np.uint16) - np.uint16(1)
        numbers[i : i + n] = order.ravel().take(first).reshape(n, steps)
        new[i : i + n] = is_first.reshape(n, steps)
    new &= np.arange(steps) < lengths[:, None]
    return numbers, new


def turned(rows: np.ndarray) -> np.ndarray:
    """A transposed copy, made in strips that stay in the cache."""
    out = np.empty(rows.shape[::-1], rows.dtype)
    for i in range(0, len(rows), 64):
        out[:, i : i + 64] = rows[i : i + 64].T
    return out


def _active(lengths: np.ndarray, steps: int) -> list[int]:
    """How many lanes (longest first) have an id at each step."""
    return (len(lengths) - np.cumsum(np.bincount(lengths, minlength=steps + 1)))[:steps].tolist()


def encode_blocks(ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """The coded form of each row of ids (longest first).

    The coder's low end is exact: a carry is added to the words written before.
    """
    if ids.size and int(ids.max()) >= ID_LIMIT:
        raise ValueError(f"ids of {ID_LIMIT} and more have no code in this format")
    if ids.shape[1] > LONGEST:
        raise ValueError(f"a block holds {LONGEST} ids at most")
    lanes, steps = len(lengths), int(lengths.max(initial=0))
    numbers, new_ids = numbered(ids, lengths)
    numbers, new = turned(numbers), turned(new_ids)
    models = Models(lanes, steps, False)
    low, wide = np.zeros(lanes, U64), np.full(lanes, np.iinfo(np.uint64).max, U64)
    room = steps + 4  # no id takes more than a word: weights times places are below 2**31
    words, used = np.zeros(lanes * room, np.uint32), np.arange(lanes) * room

    def put(n, total, start, width):
        r = wide[:n] // total
        start *= r
        low[:n] += start
        carried = np.flatnonzero(low[:n] < start)
        if len(carried):
            at = used[carried] - 1
            while len(at):  # a full word passes the carry on
                words[at] += np.uint32(1)
                at = at[words[at] == 0] - 1
        np.multiply(r, width, out=wide[:n])
        out = np.flatnonzero(wide[:n] < LEAST)
        if len(out):
            at, now = used[out], low[out]
            words[at] = now >> U64(32)
            used[out] = at + 1
            low[out] = now << U64(32)
            wide[out] <<= U64(32)

    last, pair, active = np.zeros(lanes, np.uint16), np.zeros(lanes, np.uint32), _active(lengths, steps)
    models.meet(lengths > 0)  # the first id is always new
    for t in range(1, steps):
        n = active[t]
        if t in RENEW:
            models.renew(numbers, n, t)
        if t == 1 or t in RENEW or t % HELD == 0:
            first, held = t, models.places(numbers[t : min([steps, (t // HELD + 1) * HELD, *(r for r in RENEW if r > t)]), :n])
        x, is_new = numbers[t, :n], new[t, :n]
        models.look(n, pair[:n])
        start, width = models.interval(x, is_new, held[t - first, :n])
        put(n, models.total.astype(U64), start.astype(U64), width.astype(U64))
        models.learn(x, is_new)
        models.meet(is_new)
        last, pair = x, last[:n] * PAIR_OLD + x * PAIR_NEW
    for _ in range(2):
        words[used] = low >> U64(32)
        used += 1
        low <<= U64(32)
    words, counts = words.reshape(lanes, room).astype("<u4", copy=False), used - np.arange(lanes) * room
    return _framed(ids, lengths, new_ids, words, counts)


def _framed(ids: np.ndarray, lengths: np.ndarray, new_ids: np.ndarray, words: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Blocks of their heads, coded words and distinct ids."""
    ids = np.ascontiguousarray(ids, "<u4")
    kinds = ids[new_ids]
    upto = np.concatenate(([0], np.cumsum(np.count_nonzero(new_ids, axis=1)))).tolist()
    sizes = np.where(ids.max(axis=1, where=new_ids, initial=0) < 1 << 16, 2, 4).tolist()
    lists = {size: kinds.astype(f"<u{size}").view(np.uint8) for size in set(sizes)}
    ids_bytes, words_bytes, row, room = ids.ravel().view(np.uint8), words.ravel().view(np.uint8), 4 * ids.shape[1], 4 * words.shape[1]
    out = []
    for i, (length, count, size) in enumerate(zip(lengths.tolist(), counts.tolist(), sizes, strict=True)):
        head = struct.pack(HEAD, BLOCK_MAGIC, length, count, upto[i + 1] - upto[i], size, zlib.crc32(ids_bytes[row * i : row * i + 4 * length]))
        out.append(b"".join((head, words_bytes[room * i : room * i + 4 * count], lists[size][size * upto[i] : size * upto[i + 1]])))
    return out


def decode_blocks(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; a block that is damaged raises ValueError."""
    with np.errstate(all="ignore"):  # what a damaged block leads to is found by its checksum
        return _decoded(blocks)


def _decoded(blocks: list[bytes]) -> list[np.ndarray]:
    heads = [struct.unpack_from(HEAD, b) if len(b) >= HEAD_BYTES else (b"", 0, 0, 0, 0, 0) for b in blocks]
    for b, (magic, length, used, kinds, size, _) in zip(blocks, heads, strict=True):
        if magic != BLOCK_MAGIC or size not in (2, 4) or len(b) != HEAD_BYTES + 4 * used + size * kinds or not kinds <= length <= LONGEST:
            raise ValueError("not a block of this format")
    order = sorted(range(len(blocks)), key=lambda i: -heads[i][1])
    lengths = np.array([heads[i][1] for i in order], np.int64)
    lanes, steps = len(order), int(lengths.max(initial=0))
    room = max((heads[i][2] for i in order), default=0) + 3
    words = np.zeros(lanes * room, np.uint32)
    for k, i in enumerate(order):
        words[k * room : k * room + heads[i][2]] = np.frombuffer(blocks[i], "<u4", heads[i][2], HEAD_BYTES)
    end = np.arange(1, lanes + 1) * room - 1  # a damaged block may ask for more than it has
    models = Models(lanes, steps, True)
    used = np.arange(lanes) * room + 2
    code = words[used - 2].astype(U64) << U64(32) | words[used - 1]
    wide = np.full(lanes, np.iinfo(np.uint64).max, U64)
    numbers = np.zeros((steps, lanes), np.uint16)

    def take(n, r, start, width):
        start *= r
        code[:n] -= start
        np.multiply(r, width, out=wide[:n])
        out = np.flatnonzero(wide[:n] < LEAST)
        if len(out):
            at = used[out]
            code[out] = code[out] << U64(32) | words[at]
            used[out] = np.minimum(at + 1, end[out])
            wide[out] <<= U64(32)

    last, pair, active = np.zeros(lanes, np.uint16), np.zeros(lanes, np.uint32), _active(lengths, steps)
    models.meet(lengths > 0)
    for t in range(1, steps):
        n = active[t]
        if t in RENEW:
            models.renew(numbers, n, t)
        models.look(n, pair[:n])
        r = wide[:n] // models.total.astype(U64)
        value = (code[:n] // r).astype(np.int32)
        x, is_new, start, width = models.find(value)
        take(n, r, start.astype(U64), width.astype(U64))
        models.learn(x, is_new)
        models.meet(is_new)
        numbers[t, :n] = x
        last, pair = x, last[:n] * PAIR_OLD + x * PAIR_NEW
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(blocks)
    numbers = turned(numbers)
    known = np.zeros(steps + 1, np.uint32)
    for k, i in enumerate(order):
        _, _, filled, kinds, size, _ = heads[i]
        known[:kinds] = np.frombuffer(blocks[i], f"<u{size}", kinds, HEAD_BYTES + 4 * filled)
        known[kinds:] = 0
        out[i] = known.take(numbers[k, : lengths[k]]).astype("<u4", copy=False)
        if zlib.crc32(out[i].tobytes()) != heads[i][5]:
            raise ValueError("a block does not match its checksum")
    return out


#: Bytes before which a single space or newline always starts a piece of text that is tokenized alone: graphic
#: ASCII, and first bytes of non-ASCII characters that cannot be white space.
_SAFE = np.zeros(256, bool)
_SAFE[33:127] = True
_SAFE[[*range(0xC3, 0xE0), *range(0xE4, 0xEF), *range(0xF0, 0xF5)]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Punctuation that never shares a piece with a letter before it; the apostrophe may begin one with letters after it.
_POINT = np.zeros(256, bool)
_POINT[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True
#: A bit for each of these: space, safe to cut before, newline, ASCII that is not blank, letter, point.
_CLASS = np.zeros(256, np.uint8)
for _bit, _of in enumerate((np.arange(256) == 32, _SAFE, np.arange(256) == 10, ~_BLANK & (np.arange(256) < 128), _LETTER, _POINT)):
    _CLASS |= _of.astype(np.uint8) << _bit
_CLASS_OF = _CLASS.tobytes()
#: Bytes of plain words: ASCII letters, and those of U+00C0 to U+023F, which are letters but for two.
_PLAIN = _LETTER.copy()
_PLAIN[[*range(0x80, 0xC0), *range(0xC3, 0xC9)]] = True
#: The character that stands for each byte in a byte-level vocabulary.
_SPELLED = np.arange(256, dtype="<u4")
_UNPRINTED = [b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or 174 <= b)]
_SPELLED[_UNPRINTED] = 256 + np.arange(len(_UNPRINTED))
JOINED = 1024
WORDS = 64
MOST_KNOWN = 1_200_000  # some 60 bytes each in every worker


class _Known:
    """Byte strings and their places: an open-addressed table that grows, so that a lookup does not hash all of them again."""

    def __init__(self, strings: list[bytes]):
        self.strings = pa.array([], pa.large_binary())
        self.hashes = np.zeros(0, np.int64)
        self.slots = np.full(1 << 16, -1, np.int32)
        strings = pa.array(strings, pa.large_binary())
        self.add(strings, hashes_of(strings))

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, strings: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The place of each string, -1 if it has none; exact, since the bytes found are compared."""
        places, at, left = np.full(len(hashes), -1, np.int64), hashes & (len(self.slots) - 1), np.arange(len(hashes))
        while len(left):
            here = self.slots[at[left]]
            held = here >= 0
            left, here = left[held], here[held]
            same = self.hashes[here] == hashes[left]
            places[left[same]] = here[same]
            left = left[~same]
            at[left] = (at[left] + 1) & (len(self.slots) - 1)
        hit = np.flatnonzero(places >= 0)
        equal = pc.equal(self.strings.take(pa.array(places[hit])), strings.take(pa.array(hit)))
        places[hit[~equal.to_numpy(zero_copy_only=False)]] = -1
        return places

    def add(self, strings: pa.Array, hashes: np.ndarray) -> None:
        """Gives these the next places; of several with one hash ``find`` knows one."""
        places = np.arange(len(self), len(self) + len(hashes))
        self.strings, self.hashes = pa.concat_arrays([self.strings, strings]), np.concatenate((self.hashes, hashes))
        if 2 * len(self) > len(self.slots):
            self.slots = np.full(1 << (2 * len(self)).bit_length(), -1, np.int32)
            places, hashes = np.arange(len(self)), self.hashes
        at = hashes & (len(self.slots) - 1)
        while len(places):
            free = self.slots[at] < 0
            self.slots[at[free]] = places[free]
            lost = self.slots[at] != places
            places, at = places[lost], (at[lost] + 1) & (len(self.slots) - 1)


def hashes_of(strings: pa.Array) -> np.ndarray:
    return np.fromiter(map(hash, strings.to_numpy(zero_copy_only=False)), np.int64, len(strings))


def _keeps_words(model: dict, vocabulary: dict[str, int]) -> bool:
    """Whether the ids of plain words, a space before each, are those of the words alone: no token holds parts of two."""
    space, letters = chr(_SPELLED[32]), {chr(c) for c in _SPELLED[_PLAIN]}
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")) or not letters | {space} <= vocabulary.keys():
        return False
    return not any(space in t[1:] and 2 * space not in t and letters.issuperset(t.replace(space, "")) for t in vocabulary)


class Encoder:
    """The tokenizer over distinct stretches of text.

    A byte-level pre-tokenizer never joins a word with what stands before a single space or
    newline, nor with the punctuation after it, so texts are cut there, and each distinct stretch is encoded
    once. Texts that hold an added token, and all texts if the tokenizer splits otherwise, are encoded whole.
    A space and plain letters are one word to the pre-tokenizer, so such stretches go to the tokenizer's model at once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        pre = parts["pre_tokenizer"] or {}
        self.cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True) and parts["normalizer"] is None and parts["model"]["type"] == "BPE"
        self.added = [t["content"].encode() for t in parts["added_tokens"]]
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)  # a byte-level token has one character for each byte
        self.words = Tokenizer(self.tokenizer.model)  # the same model, without what finds words in texts
        self.joins_words = self.cuts and _keeps_words(parts["model"], vocabulary)
        self._forget()

    def _forget(self) -> None:
        self.known = _Known([b""])  # no stretch is empty: this place is the end of a text
        self.ids, self.begin = np.array([END_ID], np.int32), np.array([0, 1], np.int64)
        self.marked = False  # whether an added token was met

    def _starts(self, raw: np.ndarray, offsets: np.ndarray, data: bytes) -> np.ndarray:
        """Where the stretches begin: every text's start, and the cuts inside of texts without added tokens."""
        n = len(raw)
        cut = np.zeros(n, bool)
        if self.cuts and n > 2:
            kind = np.frombuffer(data.translate(_CLASS_OF), np.uint8)
            before, here, after = kind[:-2], kind[1:-1], kind[2:]
            cut[1:-1] = (here & (after >> 1) & 1) | ((here >> 2) & (after >> 1) & (before >> 3) & 1)
            cut[1:] |= ((kind[:-1] >> 4) & (kind[1:] >> 5)).astype(bool)
            for token in self.added:
                at = data.find(token) if token else -1
                self.marked |= at >= 0
                while at >= 0:
                    text = int(np.searchsorted(offsets, at, "right"))
                    cut[offsets[text - 1] : offsets[text]] = False
                    at = data.find(token, max(at + 1, int(offsets[text]) - len(token) + 1))
        cut[offsets[:-1][offsets[:-1] < n]] = True
        return np.flatnonzero(cut)

    def _learn(self, fresh: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Encodes stretches not met before; those that begin with a single space, many in one call. Returns their places."""
        raw, at = flat(fresh)
        joins = (raw[at[:-1]] == 32) & (np.diff(at) > 1) & self.cuts
        joins[joins] = _SAFE[raw[at[:-1][joins] + 1]]
        if self.marked:
            joins &= np.array([not any(t in s for t in self.added) for s in fresh.to_pylist()], bool)
        plain = joins & self.joins_words
        if plain.any():
            other = ~_PLAIN[raw]
            other[:-1] |= (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))  # the signs of multiplication and division
            other[at[:-1]] = False
            plain &= ~np.logical_or.reduceat(other, at[:-1])
        joins &= ~plain
        kinds = (plain, joins, ~(plain | joins))
        order, parts = np.concatenate([np.flatnonzero(kind) for kind in kinds]), [fresh.filter(pa.array(kind)) for kind in kinds]
        ids, ends, upto = [], [], 0
        for kind, part in enumerate(parts):
            raw, at = flat(part)
            bounds = at[:: (WORDS, JOINED, 1)[kind]].tolist()
            bounds += [len(raw)] * (bounds[-1] < len(raw))
            text = _SPELLED[raw].tobytes().decode("utf-32-le") if kind == 0 else raw.tobytes()
            calls = [text[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            coder = self.words if kind == 0 else self.tokenizer
            coded = [e.ids for e in coder.encode_batch_fast(calls if kind == 0 else [c.decode("utf-8", "replace") for c in calls], add_special_tokens=False)]
            own = np.fromiter(chain.from_iterable(coded), np.int32)
            if kind < 2:
                sums = np.cumsum(self.bytes_of[own])
                if len(own) and sums[-1] != len(raw):
                    raise ValueError("the tokens of a text do not add up to its bytes")
                ends.append(upto + np.searchsorted(sums, at[1:], "right"))
            else:
                ends.append(upto + np.cumsum([len(c) for c in coded], dtype=np.int64))
            ids.append(own)
            upto += len(own)
        places = np.empty(len(fresh), np.int64)
        places[order] = np.arange(len(fresh)) + len(self.known)
        self.known.add(pa.concat_arrays(parts), hashes[order])
        self.begin = np.concatenate((self.begin, len(self.ids) + np.concatenate(ends)))
        self.ids = np.concatenate((self.ids, *ids))
        return places

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, END_ID after each, and the number of ids of each."""
        texts, n = len(offsets) - 1, len(raw)
        data = raw.tobytes()
        start = self._starts(raw, offsets, data)
        bounds = np.append(start, n).astype(np.int64)
        stretches = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        coded = stretches.dictionary_encode()  # exact: equal bytes, equal index
        if len(self.known) > MOST_KNOWN:
            self._forget()
        hashes = hashes_of(coded.dictionary)
        places = self.known.find(coded.dictionary, hashes)
        fresh = places < 0
        if fresh.any():
            places[fresh] = self._learn(coded.dictionary.filter(pa.array(fresh)), hashes[fresh])
        ends = np.searchsorted(start, offsets[1:]) + np.arange(texts)  # where the ends of texts stand among the stretches
        inside = np.ones(len(start) + texts, bool)
        inside[ends] = False
        slot = np.zeros(len(inside), np.int64)
        slot[inside] = places.take(coded.indices.to_numpy())
        begin = self.begin.take(slot)
        sizes = self.begin.take(slot + 1) - begin
        upto = np.cumsum(sizes)
        per = np.diff(upto[ends], prepend=0)
        begin -= upto
        begin += sizes
        take = np.repeat(begin, sizes)
        take += np.arange(len(take))
        out = self.ids.take(take)
        return out, per


@lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """One for each worker process, so that its tasks share what they have met."""
    return Encoder(path)


INDEX_ROW = np.dtype([("id", "<i8"), ("null", "<u1"), ("tokens", "<u8")])
FILE_SCHEMA = "shard int, block int, data binary"
INTEGERS = ("tinyint", "smallint", "int", "bigint")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> None:
    """Writes the ids of all documents, in ascending order of ``id_col`` (an integer; null first), to ``path``.

    A shard is a range of documents; it is coded as it streams by, LANES blocks at a time.
    """
    spark = docs.sparkSession
    small_batches(spark, 500)
    if dict(docs.dtypes)[id_col] not in INTEGERS:
        raise ValueError(f"{id_col} must be an integer")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    if shards is None:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("_text").cast("long")), F.lit(0))).first()[0]
        shards = max(spark.sparkContext.defaultParallelism, min(size // SHARD_BYTES, MOST_SHARDS))
    order = (F.col("_id").asc_nulls_first(), F.xxhash64("_text"))  # the hash parts rows that repeat an id
    ordered = rows.repartitionByRange(int(shards), *order).sortWithinPartitions(*order)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, number = encoder_of(tokenizer), TaskContext.get().partitionId(), 0
        index, kept, held = [], [], 0

        def told(final: bool):
            nonlocal kept, held, number, index
            if index:
                raw = np.concatenate(index).tobytes()
                yield rows_of(shard, number, [struct.pack(HEAD, INDEX_MAGIC, len(raw) // INDEX_ROW.itemsize, 0, 0, 0, zlib.crc32(raw)) + raw])
                index, number = [], number + 1
            ids = np.concatenate(kept) if kept else np.zeros(0, np.int32)
            kept = []
            pa.default_memory_pool().release_unused()
            whole = len(ids) if final else len(ids) // (BLOCK * LANES) * BLOCK * LANES
            groups = max(1, -(-whole // (BLOCK * LANES)))
            step = -(-whole // (BLOCK * groups)) * BLOCK  # groups of like numbers of lanes
            for at in range(0, whole, step or 1):
                part = ids[at : min(whole, at + step)]
                lanes = -(-len(part) // BLOCK)
                block = np.zeros(lanes * BLOCK, np.int32)
                block[: len(part)] = part
                lengths = np.full(lanes, BLOCK)
                lengths[-1] = len(part) - (lanes - 1) * BLOCK
                yield rows_of(shard, number, encode_blocks(block.reshape(lanes, BLOCK), lengths))
                number += lanes
            kept, held = [ids[whole:]], len(ids) - whole

        for part in pieces_of(batches, "_text", SHARD_BYTES // 2):
            ids, per = encoder.encode(*flat(part.column("_text")))
            row = np.zeros(part.num_rows, INDEX_ROW)
            row["id"] = part.column("_id").fill_null(0).to_numpy()
            row["null"] = part.column("_id").is_null().to_numpy(zero_copy_only=False)
            row["tokens"] = per
            index.append(row)
            kept.append(ids)
            held += len(ids)
            part = ids = None  # not held while blocks are coded
            if held >= BLOCK * LANES:
                yield from told(False)
        yield from told(True)

    ordered.mapInArrow(emit, FILE_SCHEMA).write.parquet(path)


def rows_of(shard: int, number: int, data: list[bytes]) -> pa.RecordBatch:
    n = len(data)
    return pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array(range(number, number + n), pa.int32()), pa.array(data, pa.binary())], ["shard", "block", "data"])


class _Reader:
    """Documents of one shard, from its records in order."""

    def __init__(self, shard: int, with_ids: bool):
        self.shard, self.with_ids = shard, with_ids
        self.blocks: list[bytes] = []
        self.index, self.tail = np.zeros(0, INDEX_ROW), np.zeros(0, np.uint32)
        self.position = self.start = 0

    def add(self, data: bytes) -> Iterator[pa.RecordBatch]:
        if data[:4] != INDEX_MAGIC:
            self.blocks.append(data)
            if len(self.blocks) >= LANES:
                yield from self.told()
            return
        if len(data) < HEAD_BYTES or zlib.crc32(data[HEAD_BYTES:]) != struct.unpack_from(HEAD, data)[5]:
            raise ValueError("a shard's index is damaged")
        self.index = np.concatenate((self.index, np.frombuffer(data, INDEX_ROW, offset=HEAD_BYTES)))

    def told(self) -> Iterator[pa.RecordBatch]:
        """The documents that are complete by now."""
        ids = np.concatenate((self.tail, *decode_blocks(self.blocks))).astype("<u4", copy=False)
        self.blocks = []
        ends = np.cumsum(self.index["tokens"].astype(np.int64))
        done = int(np.searchsorted(ends, len(ids), "right"))
        raw = memoryview(ids.tobytes())
        for i in range(0, done, 1000):
            own, stop = self.index[i : min(i + 1000, done)], ends[i : min(i + 1000, done)]
            begin = stop - own["tokens"].astype(np.int64)
            bounds = pa.array(np.append(begin, stop[-1]) - begin[0], pa.int32())
            lists = pa.ListArray.from_arrays(bounds, pa.array(ids[begin[0] : stop[-1]].astype(np.int32))) if self.with_ids else pa.nulls(len(own), pa.list_(pa.int32()))
            columns = [
                pa.array(np.full(len(own), self.shard, np.int32)),
                pa.array(np.arange(i, i + len(own)) + self.position),
                pa.array(own["id"], mask=own["null"].astype(bool)),
                pa.array(begin + self.start),
                pa.array(own["tokens"].astype(np.int64)),
                pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)], pa.int64()),
                lists,
            ]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "position", "doc_id", "start", "n_tokens", "ids_crc32", "ids"])
        used = int(ends[done - 1]) if done else 0
        self.index, self.tail = self.index[done:], ids[used:]
        self.position, self.start = self.position + done, self.start + used

    def finish(self) -> Iterator[pa.RecordBatch]:
        yield from self.told()
        if len(self.index) or len(self.tail):
            raise ValueError("the blocks of a shard do not hold the tokens of its index")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """shard, position, doc_id, start (in the shard), n_tokens, ids_crc32, ids of every document of a file; ids are null unless asked for."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    rows = rows.repartition("shard").sortWithinPartitions("shard", "block")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            for shard, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "data")), strict=True):
                if reader is None or shard != reader.shard:
                    if reader:
                        yield from reader.finish()
                    reader = _Reader(shard, with_ids)
                yield from reader.add(data)
        if reader:
            yield from reader.finish()

    return rows.mapInArrow(decode, "shard int, position long, doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")


def _shard_offsets(rows: DataFrame) -> DataFrame:
    """(shard, _before): the tokens of all shards before; sums of SPAN shards at a time, so no task holds more than MOST_SHARDS / SPAN or SPAN rows."""
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("_span", F.expr(f"shard div {SPAN}"))
    upto = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = totals.groupBy("_span").agg(F.sum("n").alias("_sum")).select("_span", F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_spans_before"))
    inside = Window.partitionBy("_span").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return totals.join(spans, "_span").select("shard", (F.col("_spans_before") + F.col("_inside")).alias("_before"))


def token_report(docs: DataFrame, tokenizer: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from a file written and read back.

    Null text is empty: its only id is END_ID. ``id_col`` must be an integer column; rows that repeat an id lie
    side by side in the file, in a fixed order, null ids first. Ids of ID_LIMIT and more are refused when
    they are written. Other columns are not read; an empty table gives no rows. A text is held whole by one task.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, id_col, text_col)
    rows = written(read_tokens(spark, path, with_ids=False).drop("ids"), "token-rows")
    return rows.join(_shard_offsets(rows), "shard").select(F.col("doc_id").alias(id_col), (F.col("start") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")
