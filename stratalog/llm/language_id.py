"""Language identification by interpolated Kneser-Ney character models.

Each language has, for each order up to ``ORDER``, a sorted array of n-gram hashes
with log probabilities and one of context hashes with log back-off weights. A
text goes to the language of lowest cross-entropy per character. Held-out labelled
texts calibrate two things: the temperature of the softmax that gives the score,
and for each language the cross-entropy beyond which a text is rejected.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.llm.scratch import small_batches
from stratalog.llm.textkit import GOLD, flat, mixed, pieces_of

U64 = np.uint64
ORDER = 5
GAP = 32
UNDETERMINED = "und"
#: Log probabilities that a task holds: with many languages it keeps fewer n-grams.
CACHED = 1 << 25


@dataclass(frozen=True)
class Settings:
    """``bytes_per_language`` (expected) and ``longest_text`` bound the labelled sample that the driver fits; nothing else is sampled.

    Beyond eight languages they share eight times ``bytes_per_language``; each has one text at least, if any is within ``longest_text``.
    """

    bytes_per_language: int = 1_500_000
    longest_text: int = 50_000
    calibration: float = 0.1
    reject_quantile: float = 0.995
    cache_bits: int = 20
    seed: int = 5


@cache
def letter_table() -> np.ndarray:
    """For each code point its lower case if it is a letter, else GAP."""
    table = np.full(0x110000, GAP, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(s := chr(c))[0] == "L":
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def code_points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts and the text of each."""
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    b = np.zeros((len(lead), 4), np.uint32)
    padded = np.concatenate((raw, np.zeros(3, np.uint8)))
    b[:, 0] = first = padded[lead]
    cp = first.astype(np.uint32)
    for size, mask in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
        at = np.flatnonzero((first >= (0xC0, 0xE0, 0xF0)[size - 2]) & (first < (0xE0, 0xF0, 0xF8)[size - 2]))
        value = cp[at] & mask
        for k in range(1, size):
            value = (value << 6) | (padded[lead[at] + k] & 0x3F)
        cp[at] = value
    return np.minimum(cp, 0x10FFFF), np.searchsorted(offsets, lead, "right") - 1


def symbols(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, text of each, whether it is to be scored): letters in lower case, one GAP for each run of others.

    Every text is led by ORDER - 1 gaps that give context and are not scored.
    """
    cp, owner = code_points(raw, offsets)
    sym = letter_table()[cp]
    gap = sym == GAP
    keep = np.ones(len(sym), bool)
    keep[1:] = ~(gap[1:] & gap[:-1] & (owner[1:] == owner[:-1]))
    keep[:1] = True
    sym, owner = sym[keep], owner[keep]
    texts, lead = len(offsets) - 1, ORDER - 1
    out = np.full(len(sym) + texts * lead, GAP, np.uint32)
    who = np.zeros(len(out), np.int64)
    real = np.zeros(len(out), bool)
    at = np.arange(len(sym)) + (owner + 1) * lead
    out[at], who[at], real[at] = sym, owner, True
    return out, who, real


def gram_hashes(sym: np.ndarray) -> list[np.ndarray]:
    """Entry n: the hash of the n symbols that end at each place (entry 0 is all zero)."""
    value = (sym.astype(U64) + U64(1)) * GOLD
    value ^= value >> U64(31)
    out = [np.zeros(len(sym), U64)]
    for _ in range(ORDER):
        last = np.zeros_like(value)
        last[1:] = out[-1][:-1]
        out.append(last * U64(0xD1342543DE82EF95) + value)
    return out


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted ``keys``, and whether each wanted key is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class CharModel:
    """Sorted hash arrays of one language."""

    grams: list[np.ndarray] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)
    unseen: float = 0.0

    def log_probability(self, hashes: list[np.ndarray], before: list[np.ndarray]) -> np.ndarray:
        """Of the last symbol given the ones before; hashes[n] of the n-gram, before[n] of its n - 1 context symbols."""
        out = np.full(len(hashes[1]), self.unseen)
        for n in range(1, ORDER + 1):
            if n > 1:
                at, known = find(self.contexts[n - 1], before[n])
                out[known] += self.backoff[n - 1][at[known]]
            at, known = find(self.grams[n - 1], hashes[n])
            out[known] = self.logp[n - 1][at[known]]
        return out


def fit_model(raw: np.ndarray, offsets: np.ndarray) -> CharModel:
    """Interpolated Kneser-Ney: raw counts at the highest order, continuation counts below, one discount per order."""
    sym, _, real = symbols(raw, offsets)
    hashes, places = gram_hashes(sym), np.flatnonzero(real)
    seen = []
    for n in range(1, ORDER + 1):
        grams, first, count = np.unique(hashes[n][places], return_index=True, return_counts=True)
        end = places[first]
        before = hashes[n - 1][np.maximum(end - 1, 0)] if n > 1 else np.zeros(len(grams), U64)
        seen.append([grams, count, before, hashes[n - 1][end]])
    for n in range(1, ORDER):  # lower orders count distinct left neighbours
        kinds, count = np.unique(seen[n][3], return_counts=True)
        seen[n - 1][1] = count[np.searchsorted(kinds, seen[n - 1][0])]
    model, lower = CharModel(), None
    vocabulary = len(seen[0][0]) + 1
    for n, (grams, count, before, suffix) in enumerate(seen, 1):
        ones, twos = int((count == 1).sum()), int((count == 2).sum())
        discount = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
        contexts, group = np.unique(before, return_inverse=True)
        total = np.bincount(group, count, len(contexts))
        kinds = np.bincount(group, minlength=len(contexts))
        rest = discount * kinds / total
        base = np.full(len(grams), 1.0 / vocabulary) if lower is None else lower[np.searchsorted(seen[n - 2][0], suffix)]
        p = np.maximum(count - discount, 0) / total[group] + rest[group] * base
        if n == 1:
            model.unseen = float(np.log(rest[0] / vocabulary))
        model.grams.append(grams)
        model.logp.append(np.log(p).astype(np.float32))
        model.contexts.append(contexts)
        model.backoff.append(np.log(rest).astype(np.float32))
        lower = p
    return model


@dataclass
class Identifier:
    settings: Settings
    languages: list[str]
    models: list[CharModel]
    temperature: float = 1.0
    limits: np.ndarray | None = None

    def entropies(self, raw: np.ndarray, offsets: np.ndarray, held: dict) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) cross-entropies per symbol, and the number of letters. ``held`` keeps n-grams already looked up."""
        texts = len(offsets) - 1
        bits = min(self.settings.cache_bits, max(10, CACHED.bit_length() - len(self.models).bit_length()))
        sym, owner, real = symbols(raw, offsets)
        letters = np.bincount(owner[real & (sym != GAP)], minlength=texts)
        hashes, places = gram_hashes(sym), np.flatnonzero(real)
        whole, owner = hashes[ORDER][places], owner[places]
        if "keys" not in held:
            held["keys"] = np.zeros(1 << bits, U64)
            held["logp"] = np.zeros((len(self.models), 1 << bits), np.float32)
        slot = (mixed(whole) >> U64(64 - bits)).astype(np.int64)
        hit = held["keys"][slot] == whole
        sums = np.zeros((texts, len(self.models)))
        for k, row in enumerate(held["logp"]):
            sums[:, k] += np.bincount(owner[hit], row[slot[hit]], texts)
        if not hit.all():
            lost = np.flatnonzero(~hit)
            kinds, first, group = np.unique(whole[lost], return_index=True, return_inverse=True)
            at = lost[first]
            own = [h[places[at]] for h in hashes]
            before = [own[0], own[0], *(h[places[at] - 1] for h in hashes[1:ORDER])]
            into, chosen = np.unique(slot[at], return_index=True)
            held["keys"][into] = kinds[chosen]
            for k, model in enumerate(self.models):
                logp = model.log_probability(own, before)
                sums[:, k] += np.bincount(owner[lost], logp[group], texts)
                held["logp"][k, into] = logp[chosen]
        return -sums / np.maximum(np.bincount(owner, minlength=texts), 1)[:, None], letters

    def calibrate(self, raw: np.ndarray, offsets: np.ndarray, label: np.ndarray) -> None:
        entropy, letters = self.entropies(raw, offsets, {})
        rows = np.flatnonzero(letters > 0)
        self.limits = np.full(len(self.models), np.inf)
        if not len(rows):
            return
        entropy, label = entropy[rows], label[rows]
        best = np.inf
        for t in 2.0 ** np.arange(-2, 8):
            z = -t * (entropy - entropy.min(1, keepdims=True))
            loss = float((np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), label]).mean())
            if loss < best:
                best, self.temperature = loss, float(t)
        for k in range(len(self.models)):
            own = entropy[label == k, k]
            if len(own):
                self.limits[k] = np.quantile(own, self.settings.reject_quantile)

    def predict(self, raw: np.ndarray, offsets: np.ndarray, held: dict) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, lowest cross-entropy, rejected) of each text."""
        texts = len(offsets) - 1
        if not self.models:
            return [UNDETERMINED] * texts, np.zeros(texts), np.zeros(texts), np.ones(texts, bool)
        entropy, letters = self.entropies(raw, offsets, held)
        k = entropy.argmin(1)
        low = entropy[np.arange(texts), k]
        score = 1 / np.exp(-self.temperature * (entropy - low[:, None])).sum(1)
        none = letters == 0
        names = [UNDETERMINED if n else self.languages[i] for i, n in zip(k, none, strict=True)]
        score[none], low[none] = 0.0, 0.0
        return names, score, low, none | (low > self.limits[k])


def in_fold(id_col: str, parts: int, rest: int) -> Column:
    """crc32 of the identifier as text, modulo ``parts``, is ``rest``; a null identifier is in no fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == rest, F.lit(False))


def fit(docs: DataFrame, fold: Column, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Identifier:
    """Learns every language of the rows in ``fold`` that have text and language, from a sample bounded for each; equal rows count once."""
    size = F.octet_length(text_col).cast("long")
    rows = docs.where(fold & F.col(lang_col).isNotNull() & (size > 0) & (size <= settings.longest_text))
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(settings.seed), F.col(text_col)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sizes = rows.groupBy(lang_col).agg(F.sum(size).alias("b")).collect()
    each = min(settings.bytes_per_language, 8 * settings.bytes_per_language // max(1, len(sizes)))
    shares = docs.sparkSession.createDataFrame([(r[0], each / r[1]) for r in sizes], "_lang string, _take double")
    of = lambda some: rows.join(F.broadcast(some), F.col(lang_col) == F.col("_lang"))
    found = of(shares).where(draw < F.col("_take")).select(id_col, lang_col, text_col).distinct().collect()
    met = {r[1] for r in found}
    if missed := [(r[0],) for r in sizes if r[0] not in met]:  # small shares: one text of each language left out
        one = F.min(F.struct(draw.alias("draw"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))).alias("one")
        found += of(docs.sparkSession.createDataFrame(missed, "_lang string")).groupBy(lang_col).agg(one).select("one.id", lang_col, "one.text").collect()
    found.sort(key=lambda r: (str(r[0]), r[1], r[2]))
    languages = sorted({r[1] for r in found})
    held = np.random.default_rng(settings.seed).random(len(found)) < settings.calibration
    models = []
    for lang in languages:
        own = [r[2] for r, h in zip(found, held, strict=True) if r[1] == lang and not h] or [r[2] for r in found if r[1] == lang]
        models.append(fit_model(*flat(pa.array(own, pa.string()))))
    identifier = Identifier(settings, languages, models)
    tests = [r for r, h in zip(found, held, strict=True) if h]
    identifier.calibrate(*flat(pa.array([r[2] for r in tests], pa.string())), np.array([languages.index(r[1]) for r in tests], np.int64))
    return identifier


def identified(docs: DataFrame, identifier: Identifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, cross_entropy and rejected of each row."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(identifier)  # bounded by the settings' sample
    kind = dict(docs.dtypes)[id_col]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = shared.value, {}
        for part in pieces_of(batches, "_text", 1 << 19):
            names, score, low, rejected = own.predict(*flat(part.column("_text")), held)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(low), pa.array(rejected)], [id_col, "lang_pred", "score", "cross_entropy", "rejected"])

    return docs.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(predict, f"`{id_col}` {kind}, lang_pred string, score double, cross_entropy double, rejected boolean")


def languages(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each document: id, held_out, lang_pred, score, cross_entropy, rejected.

    Learns outside the held-out fold (crc32 of the identifier modulo 4 is 2), from rows
    with text and language. ``lang_pred`` is a learned language, or ``und`` if the text
    is null or has no letter, or if there was nothing to learn from; ``rejected`` tells
    apart texts that no language explains as well as it explains its own. Repeated rows
    are judged one by one, other columns are not read.
    """
    held = in_fold(id_col, 4, 2)
    found = identified(docs, fit(docs, ~held, settings, id_col, text_col, lang_col), id_col, text_col)
    return found.select(id_col, held.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
