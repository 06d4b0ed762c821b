"""N-gram Jaccard join of whole texts by prefix filters under several global token orders.

Two sets with Jaccard >= t overlap in at least ceil(t |x|) tokens, so under *any* global order of the tokens
they share a token among the first |x| - ceil(t |x|) + 1 of each, and l tokens among the first l - 1 more.

1. Order by hash.  Each set sends its first tokens; a token of two different sets is *live*.  A set with too few live
   tokens has no partner and leaves.  A token shared inside a chunk of texts is sent once, so a token of every
   document costs one entry a chunk.
2. Order by document frequency among the sets that are left, rarest first.  The live tokens of this prefix are the
   postings that make candidates; a passage that many documents share is at the end of everyone's order.
3. Candidates are proved by their whole sets; before that they must also share a token of their prefixes under the
   hash order and under its reverse.  First each set is held against one hub, the smallest document of the token
   groups it meets most; then only sets of *different* components meet, the smaller components of a token
   against the others.  So a group of n copies costs n proofs, and every link between different
   components has been looked at when the second step ends.

Sets with equal tokens are one class from the start.  Tokens travel packed, in a row per chunk and hash bucket; the
number of buckets follows the number of tokens.

Defined results: a text without words (or null) has an empty set, links with nothing and is its own component;
rows with equal doc_id and text get the same result; rows with equal doc_id and different texts are documents of
their own, each in the component of its own text; a null doc_id links with nothing and has a null
component; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcraft.llm import words as W
from panelcraft.llm.components import components
from panelcraft.llm.store import Scratch

SHINGLE = 5
THRESHOLD = Fraction(3, 4)
EXTRA = Fraction(1, 20)            # share of a set by which the first prefix is longer, for more live tokens
TOKENS_A_BUCKET = 400_000
MIN_BUCKETS = 256
REF = np.uint64((1 << 40) - 1)     # classes are told apart by 40 bits in the first filter: a filter only
MAX_BROADCAST_IDS = 2_000_000
MEMBERS = "doc_id long, h long, n long, d1 long, d2 long"


def need(n: np.ndarray) -> np.ndarray:
    """ceil(t n): the least overlap of a set of n with any partner."""
    return -(-n * THRESHOLD.numerator // THRESHOLD.denominator)


def prefix(n: np.ndarray) -> np.ndarray:
    return n - need(n) + 1


def extra(n: np.ndarray) -> np.ndarray:
    return n * EXTRA.numerator // EXTRA.denominator


def _sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted tokens, their rows, first token of each row, set sizes, and two order-free 64-bit digests."""
    tokens, rows = W.shingles(data, offsets, SHINGLE)
    n = np.bincount(rows, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(n)])
    sums = []
    for salt in (np.uint64(0x51ED270B7F4A7C15), np.uint64(0xA0761D6478BD642F)):
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(W.mix(tokens + salt), dtype=np.uint64)])
        sums.append(W.mix(total[first[1:]] - total[first[:-1]] + n.astype(np.uint64)))
    return tokens, rows, first, n, sums[0], sums[1]


def _bytes(values: np.ndarray, width: int) -> np.ndarray:
    """The low bytes of 64-bit integers, a row each."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])


def _wide(packed: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(packed) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(packed, dtype=np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u8")


def _by_bucket(tokens: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that groups tokens by bucket (a hash of the token, so that any part of the hash order spreads),
    the buckets that occur, and their edges in that order."""
    bucket = (W.mix(tokens) >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    own, start = np.unique(bucket[order], return_index=True)
    return order, own, np.append(start, len(order))


# ---------------------------------------------------------------------------------------------- filter 1

ASKS = "bucket long, kind int, tokens binary, refs binary, counts binary, doc_id long, h long, n long, d1 long, d2 long"


def _ask_first(bits: int):
    """Per chunk: the members, the prefix tokens by bucket, and what the chunk alone already settles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in W.text_chunks(batch, "text"):
                tokens, rows, first, n, d1, d2 = _sets(data, offsets)
                # one set of a class: later rows of the chunk with the same set send nothing
                keep = np.zeros(len(n), dtype=bool)
                keep[np.unique(d1, return_index=True)[1]] = True
                inside = np.arange(len(tokens)) - first[rows] < (prefix(n) + extra(n))[rows]
                inside &= keep[rows]
                tok, ref = tokens[inside], (d1 & REF)[rows[inside]]
                order = np.argsort(tok, kind="stable")
                tok, ref = tok[order], ref[order]
                head = np.ones(len(tok), dtype=bool)
                head[1:] = tok[1:] != tok[:-1]
                shared = np.zeros(len(tok), dtype=bool)
                shared[1:] = ~head[1:]
                shared[:-1] |= ~head[1:]
                live, times = np.unique(ref[shared], return_counts=True)
                # 0: a token of one set, with its ref; 1: a token that the chunk shares, sent once
                sent, sent_ref = tok[head], np.where(shared[head], REF, ref[head])
                out = {name.split()[0]: [] for name in ASKS.split(", ")}

                def row(bucket, kind, a=b"", b=b"", c=b""):
                    for key, value in zip(out, (bucket, kind, a, b, c, None, None, None, None, None)):
                        out[key].append(value)

                order, own, edges = _by_bucket(sent, bits)
                packed, refs = _bytes(sent[order], 7), _bytes(sent_ref[order], 5)
                for k, bucket in enumerate(own.tolist()):
                    a, b = edges[k], edges[k + 1]
                    row(bucket, 0, packed[a:b].tobytes(), refs[a:b].tobytes())
                # what only passes through is dealt evenly, copies of one text too
                deal = (W.mix(d1 + W.BASE * np.arange(len(n), dtype=np.uint64) + np.uint64(len(data)))
                        >> np.uint64(64 - bits)).astype(np.int64)
                if len(live):
                    row(int(deal[0]), 1, b"", _bytes(live, 5).tobytes(), times.astype("<u4").tobytes())
                ids, texts = part.column("doc_id").to_pylist(), part.column("h").to_pylist()
                for i in range(len(n)):
                    for key, value in zip(out, (int(deal[i]), 2, None, None, None, ids[i], texts[i], int(n[i]),
                                                int(d1[i].view(np.int64)), int(d2[i].view(np.int64)))):
                        out[key].append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["bucket"], pa.int64()), pa.array(out["kind"], pa.int32()),
                     *(pa.array(out[k], pa.binary()) for k in ("tokens", "refs", "counts")),
                     *(pa.array(out[k], pa.int64()) for k in ("doc_id", "h", "n", "d1", "d2"))], names=list(out))
    return run


def _settle_first(table: pa.Table) -> pa.Table:
    """One bucket: which entries' tokens belong to two classes; members pass through."""
    kind = table.column("kind").to_numpy()
    tokens, refs, counts = (table.column(c).to_pylist() for c in ("tokens", "refs", "counts"))
    asked = np.flatnonzero(kind == 0)
    tok = np.concatenate([np.zeros(0, "<u8"), *(_wide(tokens[i], 7) for i in asked)])
    ref = np.concatenate([np.zeros(0, "<u8"), *(_wide(refs[i], 5) for i in asked)])
    order = np.lexsort((ref, tok))
    tok, ref = tok[order], ref[order]
    fresh = np.ones(len(tok), dtype=bool)
    fresh[1:] = (tok[1:] != tok[:-1]) | (ref[1:] != ref[:-1])
    tok, ref = tok[fresh], ref[fresh]
    group = np.cumsum(np.concatenate([[True], tok[1:] != tok[:-1]])) - 1 if len(tok) else tok.astype(np.int64)
    size = np.bincount(group)
    marked = np.bincount(group, weights=ref == REF)
    live = ((size > 1) | (marked > 0))[group] & (ref != REF) if len(tok) else np.zeros(0, dtype=bool)
    found = [ref[live]] + [np.repeat(_wide(refs[i], 5), np.frombuffer(counts[i], "<u4")) for i in np.flatnonzero(kind == 1)]
    who, times = np.unique(np.concatenate(found), return_counts=True)
    members = table.filter(pa.array(kind == 2))
    empty = pa.nulls(len(who), pa.int64())
    return pa.table({
        "ref": pa.concat_arrays([pa.array(who.astype(np.int64)), pa.nulls(len(members), pa.int64())]),
        "live": pa.concat_arrays([pa.array(times.astype(np.int64)), pa.nulls(len(members), pa.int64())]),
        **{c: pa.concat_arrays([empty, *members.column(c).chunks]) for c in ("doc_id", "h", "n", "d1", "d2")}})


def _buckets(total: int) -> int:
    """Bits of the bucket number: so many buckets that each has about TOKENS_A_BUCKET tokens."""
    return max(MIN_BUCKETS, total // TOKENS_A_BUCKET).bit_length()


def first_filter(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(members: a row per row of ``docs``, with a hash h of its text; classes that may have a partner: n, d1, d2, the
    smallest doc_id of their members)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    chars = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = _buckets(chars // 20)
    settled = scratch.save(
        texts.mapInArrow(_ask_first(bits), ASKS).groupBy("bucket")
        .applyInArrow(_settle_first, "ref long, live long, " + MEMBERS), "first")
    members = settled.where("n IS NOT NULL").select("doc_id", "h", "n", "d1", "d2")
    live = settled.where("ref IS NOT NULL").groupBy("ref").agg(F.sum("live").alias("live"))
    t, e = THRESHOLD, EXTRA
    least = F.expr(f"1 + (-((-n * {t.numerator}) div {t.denominator}) * {e.numerator}) div {e.denominator}")
    classes = (members.where("doc_id IS NOT NULL AND n > 0").groupBy("n", "d1", "d2")
               .agg(F.min("doc_id").alias("doc_id"))
               .withColumn("ref", F.col("d1").bitwiseAND(F.lit(int(REF)))))
    return members, classes.join(live, "ref").where(F.col("live") >= least).select("doc_id", "n", "d1", "d2")


# ---------------------------------------------------------------------------------------------- filter 2

CHUNKS = "chunk long, doc_ids binary, sizes binary, tokens binary"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole sets of the classes, packed a chunk a row; from here on a class goes by its node number, as ``doc_id``."""
    from pyspark import TaskContext

    chunk = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part, data, offsets in W.text_chunks(batch, "text"):
            tokens, rows, first, n, d1, _ = _sets(data, offsets)
            ids = part.column("node").to_numpy()
            # a row of the class that was meant, once: other rows may have the same doc_id
            good = np.flatnonzero(d1.view(np.int64) == part.column("d1").to_numpy())
            keep = np.zeros(len(ids), dtype=bool)
            keep[good[np.unique(ids[good], return_index=True)[1]]] = True
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk]), pa.array([ids[keep].astype("<i8").tobytes()], pa.binary()),
                 pa.array([n[keep].astype("<i8").tobytes()], pa.binary()),
                 pa.array([tokens[keep[rows]].astype("<u8").tobytes()], pa.binary())],
                names=["chunk", "doc_ids", "sizes", "tokens"])
            chunk += 1


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(row[c], t) for c, t in (("doc_ids", "<i8"), ("sizes", "<i8"), ("tokens", "<u8")))


def _ask_second(bits: int):
    """Distinct tokens of a chunk by bucket, each with the number of its sets there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens, counts = np.unique(_unpack(row)[2], return_counts=True)
                order, own, edges = _by_bucket(tokens, bits)
                tokens, counts = tokens[order], counts[order].astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own), pa.array(np.full(len(own), row["chunk"])),
                     pa.array([tokens[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary()),
                     pa.array([counts[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())],
                    names=["bucket", "chunk", "tokens", "counts"])
    return run


def _settle_second(table: pa.Table) -> pa.Table:
    """One bucket: the frequencies of the tokens of two sets or more, back to every chunk that has them."""
    tokens = [np.frombuffer(t, "<u8") for t in table.column("tokens").to_pylist()]
    counts = [np.frombuffer(c, "<u4") for c in table.column("counts").to_pylist()]
    _, at = np.unique(np.concatenate(tokens), return_inverse=True)
    frequency = np.bincount(at, weights=np.concatenate(counts)).astype("<u4")[at]
    edges = np.cumsum([0, *map(len, tokens)])
    back = [frequency[a:b] for a, b in zip(edges[:-1], edges[1:])]
    return pa.table({"chunk": table.column("chunk"),
                     "tokens": pa.array([t[f > 1].tobytes() for t, f in zip(tokens, back)], pa.binary()),
                     "counts": pa.array([f[f > 1].tobytes() for f in back], pa.binary())})


def _postings(key, chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """The live tokens of each set's prefix under the order by frequency, rarest first."""
    empty = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("token", "doc_id", "n", "alone", "place")})
    if chunk.empty or answers.empty:
        return empty
    ids, n, tokens = _unpack(chunk.iloc[0])
    live = np.concatenate([np.frombuffer(t, "<u8") for t in answers["tokens"]])
    frequency = np.concatenate([np.frombuffer(c, "<u4") for c in answers["counts"]])
    if not len(live):
        return empty
    order = np.argsort(live)
    live, frequency = live[order], frequency[order]
    at = np.minimum(np.searchsorted(live, tokens), len(live) - 1)
    df = np.where(live[at] == tokens, frequency[at], 1)
    rows = np.repeat(np.arange(len(ids)), n)
    alone = np.bincount(rows[df == 1], minlength=len(ids))
    order = np.lexsort((tokens, df, rows))
    tokens, df, rows = tokens[order], df[order], rows[order]
    place = np.arange(len(tokens)) - np.concatenate([[0], np.cumsum(n)])[rows]
    take = (place < prefix(n)[rows]) & (df > 1)
    return pd.DataFrame({"token": tokens[take].view(np.int64), "doc_id": ids[rows[take]], "n": n[rows[take]],
                         "alone": alone[rows[take]], "place": place[take]})


# ---------------------------------------------------------------------------------------------- proofs

def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, n, tokens = _unpack(row)
            edges = np.concatenate([[0], np.cumsum(n)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array([tokens[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())],
                names=["doc_id", "tokens"])


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Exact, after the filters: the hash-order prefixes and the reverse ones must each share a token."""
    p, q = int(prefix(np.int64(len(x)))), int(prefix(np.int64(len(y))))
    for a, b in ((x[:p], y[:q]), (x[-p:], y[-q:])):
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        if not (b[at] == a).any():
            return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return THRESHOLD.denominator * both >= THRESHOLD.numerator * (len(x) + len(y) - both)


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = batch.column("x"), batch.column("y")
        good = [linked(np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8")) for a, b in zip(x, y)]
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def prove(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    x = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_prove, "a long, b long")


def _alike(n: str, place: str, m: str, other_place: str) -> str:
    """What a link needs at its first common token: the tokens from there on bound the overlap, and an overlap o
    with |x| + |y| = s is a link only if o (1 + t) >= t s."""
    t = THRESHOLD
    return (f"least({n} - {place}, {m} - {other_place}) * {t.numerator + t.denominator}"
            f" >= {t.numerator} * ({n} + {m})")


def hub_pairs(postings: DataFrame) -> DataFrame:
    """Each set with the hub of most of its tokens; a token's hub is the set with the fewest tokens of its own, the
    likely centre of a group of copies."""
    hubs = postings.groupBy("token").agg(F.min(F.struct("alone", "n", "doc_id", "place")).alias("hub"),
                                         F.min("doc_id").alias("least"), F.max("doc_id").alias("last"))
    hubs = hubs.where("least <> last").select("token", "hub")
    met = (postings.join(hubs, "token")
           .where("doc_id <> hub.doc_id AND " + _alike("n", "place", "hub.n", "hub.place"))
           .groupBy("doc_id", F.col("hub.doc_id").alias("hub")).count())
    return met.groupBy("doc_id").agg(F.max_by("hub", F.struct("count", -F.col("hub"))).alias("b")).select(
        F.col("doc_id").alias("a"), "b")


def cross_pairs(postings: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of sets of different components with a common prefix token: for each token, the sets outside its
    largest component against all others."""
    own = (postings.join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left")
           .withColumn("root", F.coalesce("root", "doc_id")))
    held = own.groupBy("token", "root").agg(F.count("*").alias("k"))
    largest = (held.groupBy("token").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.count("*").alias("roots"))
               .where("roots > 1").select("token", "main"))
    mixed = own.join(largest, "token")
    outer = mixed.where("root <> main").select(
        "token", *(F.col(c).alias(f"{c}_a") for c in ("doc_id", "n", "place", "root")))
    other = mixed.select("token", *(F.col(c).alias(f"{c}_b") for c in ("doc_id", "n", "place", "root")), "main")
    return (outer.join(other, "token")
            .where("root_a <> root_b AND (root_b = main OR doc_id_a < doc_id_b) AND "
                   + _alike("n_a", "place_a", "n_b", "place_b"))
            .select(F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b")).distinct())


def _components(docs: DataFrame) -> DataFrame:
    """Of every row of ``docs``: doc_id, h, n, d1, d2, root (of linked classes, else null) and component_id."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    members, classes = first_filter(docs, scratch)
    # classes are numbered as they are written: a doc_id may stand for several, where its rows differ
    classes = scratch.save(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    left = classes.agg(F.count("*").alias("k"), F.sum("n").alias("tokens")).first()
    bits = _buckets(left["tokens"] or 0)
    ids = classes.select(F.col("doc_id").alias("id"), "node", "d1")
    ids = F.broadcast(ids) if left["k"] <= MAX_BROADCAST_IDS else ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.join(ids, F.col("doc_id") == F.col("id")).select("node", "text", "d1")
    chunks = scratch.save(texts.mapInArrow(_chunks, CHUNKS), "chunks")
    answers = (chunks.mapInArrow(_ask_second(bits), "bucket long, chunk long, tokens binary, counts binary")
               .groupBy("bucket").applyInArrow(_settle_second, "chunk long, tokens binary, counts binary"))
    postings = scratch.save(chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(
        _postings, "token long, doc_id long, n long, alone long, place long"), "postings")
    sets = chunks.mapInArrow(_explode, "doc_id long, tokens binary")
    near = scratch.save(prove(scratch.save(hub_pairs(postings), "hub-pairs"), sets), "hub-links")
    roots = components(near, scratch, "hub")
    more = scratch.save(prove(scratch.save(cross_pairs(postings, roots), "cross-pairs"), sets), "cross-links")
    if not more.isEmpty():
        roots = components(near.union(more), scratch, "all")
    scratch.drop("chunks", "postings", "hub-pairs", "cross-pairs")
    linked_classes = classes.join(roots, "node")
    least = linked_classes.groupBy("root").agg(F.min("doc_id").alias("component"))
    named = linked_classes.join(least, "root").select("n", "d1", "d2", "root", "component")
    own = members.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("class_id"))
    named = (own.join(named, ["n", "d1", "d2"], "left")
             .select("n", "d1", "d2", "root", F.coalesce("component", "class_id").alias("component")))
    return (members.join(named, ["n", "d1", "d2"], "left")
            .select("doc_id", "h", "n", "d1", "d2", F.when(F.col("doc_id").isNotNull(), F.col("root")).alias("root"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")))


def ngram_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, of every row of ``docs``."""
    return _components(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of every component one of the documents with its smallest doc_id, with all columns; a repeated row stays once, rows
    without a doc_id stay, and unlinked rows with the same doc_id and different texts all stay."""
    found = Scratch(docs.sparkSession, "ngram-keep").save(_components(docs).where("doc_id = component_id"), "found")
    # a component is its root, an unlinked class its digests, an empty set its document
    group = ["doc_id", "root", *(F.when(F.col("root").isNull(), F.col(c)).alias(f"g_{c}") for c in ("n", "d1", "d2"))]
    keep = found.groupBy(*group).agg(F.min("h").alias("h"), F.count("*").alias("k"))
    keep = keep.groupBy(F.col("doc_id").alias("keep_id"), F.col("h").alias("keep_h")).agg(F.max("k").alias("k"))
    alone = keep.where("k > 1").isEmpty()
    with_h = docs.withColumn("__h", F.xxhash64("text"))
    staying = with_h.join(keep, (F.col("doc_id") == F.col("keep_id")) & (F.col("__h") == F.col("keep_h")), "left_semi")
    staying = staying if alone else staying.dropDuplicates(["doc_id", "__h"])
    return staying.select(*docs.columns).union(docs.where("doc_id IS NULL"))
