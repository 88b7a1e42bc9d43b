"""URL filtering by a bit-parallel wildcard automaton.

Every rule is a glob; all globs are packed side by side into the bits of a few
64-bit words, and Shift-And steps them together over each canonical URL, one
byte position of a whole batch of URLs at a time.

A canonical URL is "." + host + NUL + path, so the glob ``*.example.org\\0/es/*``
fits a host, all of its subdomains, and no path that merely looks like it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.scratch import small_batches
from stratalog.llm.textkit import flat, pieces

U64 = np.uint64
STAR, ANY = -1, -2


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> list[int]:
        """Byte values, STAR for any run and ANY for one byte; ``*`` and ``?`` in host or path are wildcards."""
        wild = {ord("*"): STAR, ord("?"): ANY}
        part = lambda s: [wild.get(b, b) for b in s.encode()]
        return [STAR, ord("."), *part(self.host.lower()), 0, *part(self.path), STAR]


class Automaton:
    """Shift-And masks of many globs. State bit j of a rule: its first j symbols (stars apart) have been read."""

    def __init__(self, globs: list[list[int]]):
        first, final, loops, accepts, at = [], [], [], [], 0
        for glob in globs:
            first.append(at)
            place = at
            for s in glob:
                if s == STAR:
                    loops.append(place)
                else:
                    accepts.append((place, s))
                    place += 1
            final.append(place)
            at = place + 1
        self.words = max(1, -(-at // 64))
        self.start, self.loop = np.zeros(self.words, U64), np.zeros(self.words, U64)
        self.take = np.zeros((256, self.words), U64)
        for b in first:
            self.start[b >> 6] |= U64(1) << U64(b & 63)
        for b in loops:
            self.loop[b >> 6] |= U64(1) << U64(b & 63)
        for b, s in accepts:
            self.take[slice(None) if s == ANY else s, b >> 6] |= U64(1) << U64(b & 63)
        self.final = np.array(final, np.int64)

    def fits(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text and rule, whether the rule fits the whole text."""
        sizes = np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")
        begin, longest = offsets[:-1][order], int(sizes.max(initial=0))
        state = np.tile(self.start, (len(sizes), 1))
        live = np.searchsorted(-sizes[order], -np.arange(1, longest + 1), "right")  # texts with over i bytes
        for i in range(longest):
            n = live[i]
            now = state[:n]
            moved = now & self.take[raw[begin[:n] + i]]
            carry = moved >> U64(63)
            moved <<= U64(1)
            moved[:, 1:] |= carry[:, :-1]
            now &= self.loop
            now |= moved
        hit = (state[:, self.final >> 6] >> (self.final & 63).astype(U64)) & U64(1)
        out = np.empty((len(sizes), len(self.final)), bool)
        out[order] = hit.astype(bool)
        return out


def judged_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row for each page: id, host, path, rule, verdict.

    The host lies between the first ``://`` and the next ``/``, ``?``, ``#`` or the
    end, with A-Z lower-cased; the path runs from there to ``?``, ``#`` or the end. A null
    url, or one without ``://``, has neither. The longest fitting rule decides (of
    equally long ones the earliest); without one, ``rule`` is null and the verdict ``default``.
    Other columns are not read; repeated rows are judged one by one.
    """
    small_batches(pages.sparkSession)
    globs = [r.glob for r in rules]
    names, verdicts = [r.name for r in rules], [r.verdict for r in rules]
    rank = np.argsort([-len(n.encode()) for n in names], kind="stable")
    rest = F.when(F.instr(url_col, "://") > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise(F.lit(""))
    rows = pages.select(F.col(id_col), F.coalesce(rest, F.lit("")).alias("_rest"))
    rows = rows.select(id_col, F.regexp_extract("_rest", r"^([^/?#]*)", 1).alias("_host"), F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))
    host = F.translate("_host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = rows.select(id_col, host.alias("host"), "path")
    # A NUL inside a URL would pass for the separator: such bytes stand as \x01, which no rule holds.
    clean = lambda c: F.regexp_replace(c, "\x00", "\x01")
    rows = rows.withColumn("_url", F.concat(F.lit("."), clean("host"), F.lit("\x00"), clean("path")))
    kind = dict(rows.dtypes)[id_col]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(globs)
        for batch in batches:
            for part in pieces(batch, "_url", 1 << 20):
                fit = automaton.fits(*flat(part.column("_url")))[:, rank] if globs else np.zeros((part.num_rows, 1), bool)
                best = np.where(fit.any(1), fit.argmax(1), -1)
                rule = pa.array([names[rank[b]] if b >= 0 else None for b in best], pa.string())
                verdict = pa.array([verdicts[rank[b]] if b >= 0 else default for b in best], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(id_col), part.column("host"), part.column("path"), rule, verdict], [id_col, "host", "path", "rule", "verdict"])

    return rows.mapInArrow(judge, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
