"""Toxicity by FTRL-proximal logistic regression over hashed words, word n-grams and skip-grams.

Features are binary: a word, a pair of neighbouring words, or two words with one between, hashed into 2^HASH_BITS
slots.  Training reads a bounded sample of the labelled documents outside the held-out fold (``MAX_TRAIN_ROWS``, by a hash
of the id) in one task; per-coordinate rates and the L1 term leave few weights, which are broadcast (at most
2^HASH_BITS pairs).  Every whole text is scored in one pass, without a shuffle.

Defined results: a null or empty text scores the intercept; labels other than 0 and 1, and null ones, do not train; if a
document is labelled twice, the larger label counts; with no labelled rows every score is 0.5 (predicted 1);
a null doc_id is scored like any other row and counts as the text ''; repeated rows are scored one by one; of rows with
equal doc_id and different texts the text with the smallest hash trains.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcraft.llm import words as W

HASH_BITS = 22
MAX_TRAIN_ROWS = 16_000
FOLDS = 5
ALPHA, BETA, L1, L2 = 2.0, 1.0, 2.0, 0.1
EPOCHS = 6
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def held_out(doc_id: Column) -> Column:
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS) == 0


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot, row) of every word, neighbouring pair and skip pair; not yet distinct."""
    data = W.LOWER[data]
    starts, ends, rows = W.word_spans(data, offsets)
    # words are compared without the punctuation around them
    letter = (data > 127) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57))
    inside = np.concatenate([[0], np.cumsum(letter)])
    has = inside[ends] > inside[starts]
    place = np.flatnonzero(letter)
    starts = np.where(has, place[np.minimum(inside[starts], len(place) - 1)] if len(place) else starts, starts)
    ends = np.where(has, place[inside[ends] - 1] + 1 if len(place) else ends, ends)
    h = W.span_hashes(data, starts, ends)
    slots, owner = [h], [rows]
    for reach, salt in ((1, 11), (2, 23)):
        same = rows[:-reach] == rows[reach:]
        pair = W.mix(h[:-reach] * np.uint64(0x9FB21C651E98DF25) + h[reach:] + np.uint64(salt))
        slots.append(pair[same])
        owner.append(rows[:-reach][same])
    return np.concatenate(slots) >> np.uint64(64 - HASH_BITS), np.concatenate(owner)


class Ftrl:
    def __init__(self):
        size = 1 << HASH_BITS
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)  # the last is the intercept

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where((np.abs(z) <= L1) & (at < len(self.z) - 1), 0.0, w)

    def step(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def fit(rows: list[tuple[np.ndarray, int]], seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    model, order = Ftrl(), np.random.default_rng(seed)
    for _ in range(EPOCHS if rows else 0):
        for i in order.permutation(len(rows)):
            model.step(*rows[i])
    at = np.append(np.flatnonzero(np.abs(model.z[:-1]) > L1), len(model.z) - 1)
    return at, model.weights(at)


def _fit_sample(table: pa.Table) -> pa.Table:
    table = table.sort_by([("rank", "ascending"), ("doc_id", "ascending")])
    rows = []
    for batch in table.combine_chunks().to_batches():
        labels = batch.column("toxic").to_pylist()
        at = 0
        for part, data, offsets in W.text_chunks(batch, "text"):
            slot, owner = features(data, offsets)
            pairs = np.unique(owner.astype(np.uint64) << np.uint64(HASH_BITS) | slot)
            owner, slot = (pairs >> np.uint64(HASH_BITS)).astype(np.int64), pairs & np.uint64((1 << HASH_BITS) - 1)
            edges = np.searchsorted(owner, np.arange(len(part) + 1))
            for i in range(len(part)):
                own = slot[edges[i]:edges[i + 1]].astype(np.int32)
                rows.append((np.append(own, np.int32(1 << HASH_BITS)), labels[at + i]))
            at += len(part)
    slot, weight = fit(rows)
    return pa.table({"slot": pa.array(slot, pa.int64()), "weight": pa.array(weight, pa.float64())})


def train(docs: DataFrame, labels: DataFrame) -> dict[int, float]:
    """Slot -> weight, from a bounded sample of the labelled documents outside the held-out fold."""
    known = (labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id"))
             .agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out(F.col("id")))
             .withColumn("rank", F.xxhash64("id")))
    sample = known.orderBy("rank", "id").limit(MAX_TRAIN_ROWS)  # the documented bound
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .join(F.broadcast(sample), F.col("doc_id") == F.col("id")).groupBy("doc_id", "toxic", "rank")
            .agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # rows with one id and different texts: always the same one
            .select("doc_id", "text", "toxic", "rank", F.lit(1).alias("one")))
    found = rows.groupBy("one").applyInArrow(_fit_sample, "slot long, weight double").collect()
    return {r["slot"]: r["weight"] for r in found}


def score(docs: DataFrame, weights: dict[int, float]) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    slots = np.array(sorted(weights), dtype=np.uint64)
    values = np.array([weights[int(s)] for s in slots])
    shared = docs.sparkSession.sparkContext.broadcast((slots, values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, values = shared.value
        intercept = float(values[-1]) if len(slots) else 0.0
        known = np.zeros((1 << HASH_BITS) + 1, dtype=bool)
        known[slots] = True
        known[-1] = False
        for batch in batches:
            for part, data, offsets in W.text_chunks(batch, "text"):
                slot, owner = features(data, offsets)
                hit = known[slot]
                pairs = np.unique(owner[hit].astype(np.uint64) << np.uint64(HASH_BITS) | slot[hit])
                owner, slot = (pairs >> np.uint64(HASH_BITS)).astype(np.int64), pairs & np.uint64((1 << HASH_BITS) - 1)
                total = intercept + np.bincount(owner, weights=values[np.searchsorted(slots, slot)] if len(slots) else None,
                                                minlength=len(part))
                p = 1.0 / (1.0 + np.exp(-np.clip(total, -700, 700)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
            .mapInArrow(run, SCHEMA))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
