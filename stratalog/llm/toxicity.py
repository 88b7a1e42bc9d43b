"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is the bag of the character n-grams of its words (with word edges). Each
n-gram has a bucket of a hashed embedding table; the embeddings of a text are
averaged and go through one linear layer and a softmax. Embeddings and layer
are trained together by adaptive gradient steps, so a misspelling never seen shares
most of its n-gram vectors with the word it imitates.

For scoring, table and layer fold into one number for each bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.llm.scratch import small_batches
from stratalog.llm.textkit import GOLD, MIX_A, WORD_BYTES, flat, pieces_of

U64 = np.uint64
SIZES = (3, 4, 5, 6)
EDGE = 32


@dataclass(frozen=True)
class Settings:
    """``rows_per_class`` and ``longest_text`` bound the labelled sample that the driver fits; nothing else is sampled.

    Each bag has ``padding`` empty n-grams besides its own, so that a text of a few words is not judged by one odd n-gram.
    """

    bits: int = 18
    width: int = 4
    padding: int = 100
    rows_per_class: tuple[int, int] = (4500, 1500)
    longest_text: int = 200_000
    calibration: float = 0.25
    epochs: int = 8
    least_steps: int = 600
    batch: int = 64
    rate: float = 1.0
    seed: int = 11


#: Lower-cased bytes, EDGE where a byte is neither a letter, nor a digit, nor part of a non-ASCII character.
SUBWORD_BYTES = WORD_BYTES.copy()
SUBWORD_BYTES[[b for b in range(128) if not chr(b).isalnum()]] = EDGE


def subwords(raw: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all texts, n by n, and the text of each."""
    n, texts = len(raw), len(offsets) - 1
    # An edge before and after each text, and one instead of each run of separators.
    padded = np.full(n + texts + 1, EDGE, np.uint8)
    shift = np.repeat(np.arange(1, texts + 1), np.diff(offsets))
    padded[np.arange(n) + shift] = SUBWORD_BYTES[raw]
    owner = np.zeros(len(padded), np.int32)
    owner[np.arange(n) + shift] = shift - 1
    edge = padded == EDGE
    keep = np.ones(len(padded), bool)
    keep[1:] = ~(edge[1:] & edge[:-1])
    letters, owner, edge = padded[keep].astype(U64), owner[keep], edge[keep]
    edges = np.concatenate(([0], np.cumsum(edge)))
    buckets, owners = [], []
    for size in SIZES:
        count = len(letters) - size + 1
        if count <= 0:
            continue
        value = np.zeros(count, U64)
        for k in range(size):
            value = (value << U64(8)) | letters[k : k + count]
        whole = edges[size - 1 : size - 1 + count] == edges[1 : 1 + count]  # no edge but at the ends
        value = value[whole] * GOLD + U64(size)
        value ^= value >> U64(29)
        value *= MIX_A
        buckets.append((value >> U64(64 - bits)).astype(np.int32))
        owners.append(owner[1 : 1 + count][whole])  # the second letter is never an edge
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class Model:
    settings: Settings
    weight: np.ndarray  # a logit for each bucket: its embedding times the difference of the layer's columns
    bias: float = 0.0
    losses: list[float] = field(default_factory=list)

    def logits(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        bucket, owner = subwords(raw, offsets, self.settings.bits)
        texts = len(offsets) - 1
        count = np.bincount(owner, minlength=texts)
        return np.bincount(owner, self.weight[bucket], texts) / (count + self.settings.padding) + self.bias

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(raw, offsets), -50, 50)))


def fit(texts: list[str], toxic: np.ndarray, settings: Settings = Settings(), weight: np.ndarray | None = None) -> Model:
    """Fits table and layer on most of the sample; the rest sets the bias where F1 is best.

    There each row counts ``weight`` times: as many labelled rows as it stands for.
    With one class or none in the sample, the model says that class, or 0, of every text.
    """
    if len(set(toxic.tolist())) < 2:
        return Model(settings, np.zeros(1 << settings.bits, np.float32), 5.0 if len(toxic) and toxic[0] else -5.0)
    aside = np.random.default_rng(settings.seed).random(len(texts)) < settings.calibration
    if min(np.bincount(toxic[aside], minlength=2)) < 5 or len(set(toxic[~aside].tolist())) < 2:
        return _fitted(texts, toxic, settings)
    model = _fitted([t for t, a in zip(texts, aside, strict=True) if not a], toxic[~aside], settings)
    tests = [t for t, a in zip(texts, aside, strict=True) if a]
    logits = np.concatenate([model.logits(*flat(pa.array(tests[i : i + 100], pa.string()))) for i in range(0, len(tests), 100)])
    order = np.argsort(-logits, kind="stable")
    worth = (np.ones(len(toxic)) if weight is None else weight)[aside][order]
    hits = np.cumsum(toxic[aside][order] * worth)
    f1 = 2 * hits / (np.cumsum(worth) + hits[-1])
    best = int(f1.argmax())
    below = logits[order[min(best + 1, len(order) - 1)]]
    model.bias -= float((logits[order[best]] + below) / 2)
    return model


def _fitted(texts: list[str], toxic: np.ndarray, settings: Settings) -> Model:
    buckets = 1 << settings.bits
    bags, shares, at = bytearray(), bytearray(), [0]  # they grow in place; lists of arrays would be held twice
    for text in texts:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        bag, count = np.unique(subwords(raw, np.array([0, len(raw)]), settings.bits)[0], return_counts=True)
        bags += bag.astype(np.int32).tobytes()
        shares += (count / (settings.padding + count.sum())).astype(np.float32).tobytes()
        at.append(at[-1] + len(bag))
    bag, share, at = np.frombuffer(bags, np.int32), np.frombuffer(shares, np.float32), np.array(at)
    rng = np.random.default_rng(settings.seed)
    table = rng.normal(0, 0.1, (settings.width, buckets)).astype(np.float32)
    layer = rng.normal(0, 1, (settings.width, 2))
    bias, heat = np.zeros(2), np.full(buckets, 1e-8)
    model = Model(settings, table[0])
    want = np.eye(2)[toxic]
    batch = min(settings.batch, max(8, len(texts) // 16))
    for _ in range(max(settings.epochs, -(-settings.least_steps * batch // len(texts)))):
        order, loss = rng.permutation(len(texts)), 0.0
        for s in range(0, len(order), batch):
            some = order[s : s + batch]
            sizes = at[some + 1] - at[some]
            rows = np.repeat(np.arange(len(some)), sizes)
            cells = np.repeat(at[some] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            ids, part = bag[cells], share[cells]
            mean = np.stack([np.bincount(rows, v[ids] * part, len(some)) for v in table], 1)
            z = mean @ layer + bias
            q = np.exp(z - z.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            loss -= float(np.log((q * want[some]).sum(1) + 1e-12).sum())
            error = q - want[some]
            back = error @ layer.T
            step = np.stack([np.bincount(ids, back[rows, k] * part, buckets) for k in range(settings.width)])
            heat += (step**2).mean(0)
            table -= (settings.rate * step / np.sqrt(heat)).astype(np.float32)
            layer -= 0.02 * (mean.T @ error) / np.sqrt(len(some))
            bias -= 0.05 * error.mean(0)
        model.losses.append(loss / len(texts))
    model.weight = ((layer[:, 1] - layer[:, 0]) @ table).astype(np.float32)
    model.bias = float(bias[1] - bias[0])
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, fold: Callable[[str], Column], settings: Settings, id_col: str, text_col: str, label_col: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, labels and weights of the training fold, about ``rows_per_class`` of each class, drawn by a hash of the identifier.

    ``fold`` says of an identifier column which rows may be learned from; no other label is looked at. The weight is the
    inverse of the rate at which the class was drawn. An identifier with both labels has none; of rows that repeat
    an identifier the smallest text stands for all, so that the sample stays bounded.
    """
    named = labels.select(F.col(id_col).alias("_label_id"), F.col(label_col).cast("int").alias("_label"))
    named = named.where(F.col("_label").isin(0, 1) & F.col("_label_id").isNotNull() & fold("_label_id"))
    named = named.groupBy("_label_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_most")).where("_label = _most").drop("_most")
    counts = dict(named.groupBy("_label").count().collect())
    draw = F.pmod(F.xxhash64(F.col("_label_id"), F.lit(settings.seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    take = F.coalesce(*(F.when(F.col("_label") == k, F.lit(settings.rows_per_class[k] / n)) for k, n in counts.items()), F.lit(0.0))
    few = F.broadcast(named.where(draw < take))  # rows_per_class of either class
    found = docs.where(fold(id_col) & (F.octet_length(text_col) <= settings.longest_text)).join(few, docs[id_col] == few["_label_id"])
    rows = sorted(found.groupBy(F.col("_label_id"), "_label").agg(F.min(text_col).alias("_text")).select("_label_id", "_text", "_label").collect(), key=lambda r: (r[0], r[1], r[2]))
    weight = {k: max(1.0, n / settings.rows_per_class[k]) for k, n in counts.items()}
    return [r[1] for r in rows], np.array([r[2] for r in rows], np.int64), np.array([weight[r[2]] for r in rows])


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of each row; a text without words, or null, gets the score of the bias alone."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # four bytes for each of 2**bits buckets
    kind = dict(docs.dtypes)[id_col]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in pieces_of(batches, "_text", 1 << 19):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.scores(*flat(part.column("_text"))), pa.float64())], [id_col, "score"])

    return docs.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(score, f"`{id_col}` {kind}, score double")


def in_fold(id_col: str, parts: int, rest: int) -> Column:
    """crc32 of the identifier as text, modulo ``parts``, is ``rest``; a null identifier is in no fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == rest, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row for each document: id, held_out, score, predicted.

    Learns from labelled documents outside the held-out fold (crc32 of the identifier
    modulo 5 is 0). Labels other than 0 and 1, identifiers with both, and null texts, are not learned from.
    Repeated rows are scored one by one; an empty table gives no rows, and without
    labels every text is predicted 0. Other columns are not read.
    """
    held = in_fold(id_col, 5, 0)
    texts, toxic, weight = labelled_sample(docs, labels, lambda c: ~in_fold(c, 5, 0), settings, id_col, text_col, label_col)
    model = fit(texts, toxic, settings, weight)
    return scored(docs, model, id_col, text_col).select(id_col, held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))
