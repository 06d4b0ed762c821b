"""Nearest neighbours by a block matrix join with int8 tiles.

Candidates and queries are dealt into blocks; every query block meets every candidate block once, as a plain
equi-join of (query block, candidate block) cells.  In a cell the int8 codes are multiplied as a matrix; the
quantisation error of each pair is bounded from the two scales, so a pair is dropped only if k others of the
cell are certainly nearer.  What survives is computed again in double precision from the original vectors, and
each cell's best k are merged by a heap per query.  The result is exact.

A query block keeps ``QUERY_ROWS`` and a candidate block ``CANDIDATE_ROWS`` vectors, so a task's memory is set by
parameters; blocks are dealt by a hash of the id, so equal vectors and hot ids spread.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows with a null vec_id, take
no part; only vectors of one length meet; rows with equal id and vector count once; rows with equal id and different
vectors are candidates each, and as queries they share one list, in which no row of their own id stands; a query with fewer than k
candidates gets all of them; ties go to the smaller vec_id; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcraft.llm.store import Scratch

K = 20
QUERY_EVERY = 20
QUERY_ROWS = 2048
CANDIDATE_ROWS = 16384
TILE = 1024                # candidates multiplied at once
SLACK = 1e-5               # relative, for the rounding of the bounds themselves
RESULT = "query_id long, rank int, vec_id long, score double"


def valid_vectors(table: DataFrame) -> DataFrame:
    """vec_id, embedding (array of double), dim: the vectors that take part, each once."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    good = (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists("embedding", lambda x: x != 0)
    return (table.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
            .where(F.coalesce(good & nonzero, F.lit(False)))
            .select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding"), F.size("embedding").alias("dim"))
            .dropDuplicates(["vec_id", "embedding"]))


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale of each vector, and the exact length of its error (original minus scale * code)."""
    scale = np.abs(vectors).max(axis=1) / 127.0
    codes = np.rint(vectors / scale[:, None]).astype(np.int8)
    error = np.sqrt(((vectors - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes, scale, error


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows, component after component, so that equal vectors give equal scores."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def nearest_in_cell(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """For each query its k best candidates of the cell: query row, candidate row, score; best first."""
    qc, qs, qe = quantise(q)
    q_codes, q_norm = qc.astype(np.float32), np.sqrt((q ** 2).sum(axis=1))
    tops = np.full((len(q), k), -np.inf)  # the k best lower bounds so far
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(c), TILE):
        tile = c[at:at + TILE]
        codes, scale, error = quantise(tile)
        # |q.c - s_q s_c (codes)| <= |q| e_c + e_q |s_c codes|; the integer products are exact in float32 up to 1040 components
        product = (q_codes @ codes.T.astype(np.float32)).astype(np.float64) if q.shape[1] <= 1040 else (
            qc.astype(np.float64) @ codes.T.astype(np.float64))
        about = product * qs[:, None] * scale
        length = np.sqrt((tile ** 2).sum(axis=1))
        bound = (q_norm[:, None] * error + qe[:, None] * (length + error)) * (1 + SLACK) + SLACK * q_norm[:, None] * length
        own = c_ids[None, at:at + TILE] == q_ids[:, None]
        low = np.where(own, -np.inf, about - bound)
        both = np.concatenate([tops, low], axis=1)
        tops = -np.partition(-both, k - 1, axis=1)[:, :k]
        i, j = np.nonzero((about + bound >= tops.min(axis=1)[:, None]) & ~own)
        kept.append((i, j + at, (about + bound)[i, j]))
    i, j, high = (np.concatenate(x) for x in zip(*kept))
    still = high >= tops.min(axis=1)[i]
    i, j = i[still], j[still]
    score = np.concatenate([np.zeros(0), *(exact(q[i[a:a + 65536]], c[j[a:a + 65536]]) for a in range(0, len(i), 65536))])
    order = np.lexsort((c_ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    top = place < k
    return i[top], j[top], score[top]


def _matrix(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return (np.concatenate([np.frombuffer(x, "<i8") for x in frame["ids"]]),
            np.concatenate([np.frombuffer(x, "<f8").reshape(-1, d) for x, d in zip(frame["vectors"], frame["dim"])]))


def _pack(keys, frame: pd.DataFrame) -> pd.DataFrame:
    order = np.argsort(frame["vec_id"].to_numpy(), kind="stable")
    vectors = np.stack(frame["embedding"].to_numpy())[order].astype("<f8")
    return pd.DataFrame({"dim": [vectors.shape[1]], "block": [int(keys[1])],
                         "ids": [frame["vec_id"].to_numpy()[order].astype("<i8").tobytes()], "vectors": [vectors.tobytes()]})


def blocks(vectors: DataFrame, rows: int, count: int) -> DataFrame:
    """``vectors`` packed into blocks of about ``rows``, a row each."""
    n = max(1, -(-count // rows))
    return (vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
            .groupBy("dim", "block").applyInPandas(_pack, "dim int, block int, ids binary, vectors binary"))


def _cells(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                d = row["dim"]
                ids, vec = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["vectors"], "<f8").reshape(-1, d)
                q_ids, q = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["q_vectors"], "<f8").reshape(-1, d)
                i, j, score = nearest_in_cell(q_ids, q, ids, vec, k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(ids[j]), pa.array(score)],
                                                 names=["query_id", "vec_id", "score"])
    return run


def _merge(k: int):
    def run(keys, frame: pd.DataFrame) -> pd.DataFrame:
        best = heapq.nsmallest(k, zip(-frame["score"].to_numpy(), frame["vec_id"].to_numpy()))
        return pd.DataFrame({"query_id": [keys[0]] * len(best), "rank": np.arange(1, len(best) + 1, dtype=np.int32),
                             "vec_id": [v for _, v in best], "score": [-s for s, _ in best]})
    return run


def block_join(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """The k nearest candidates by inner product of every query."""
    n_q, n_c = queries.count(), candidates.count()
    q = blocks(queries, QUERY_ROWS, n_q).select(
        "dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    c = blocks(candidates, CANDIDATE_ROWS, n_c)
    # the cells: every query block is sent to the number of every candidate block
    per_q = q.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-n_c // CANDIDATE_ROWS)) - 1))))
    cells = per_q.join(c, ["dim", "block"])
    found = cells.select("dim", "ids", "vectors", "q_ids", "q_vectors").mapInArrow(
        _cells(k), "query_id long, vec_id long, score double")
    return found.groupBy("query_id").applyInPandas(_merge(k), RESULT)


def search(table: DataFrame, k: int = K, every: int = QUERY_EVERY) -> DataFrame:
    # read four times: by the counts and by the blocks of both sides
    vectors = Scratch(table.sparkSession, "neighbours").save(valid_vectors(table), "vectors")
    return block_join(vectors.where(F.pmod("vec_id", F.lit(every)) == 0), vectors, k)


ORACLE_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
