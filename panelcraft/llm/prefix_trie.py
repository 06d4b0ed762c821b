"""Prefix trie of conversations, built as a burst trie.

A turn is known by a 128-bit hash of (role, text); a conversation is the list of its turns' ids and text sizes.
Equal lists are one sequence with a number of members, so copies of a conversation cost one entry a task.

1. Trie heads.  At first all sequences are in the container of the root.  A container with more sequences or turns
   than one task should hold bursts: its common prefix becomes a path of nodes under the head, and every next turn
   id gets a container of its own.  Sequences that end at the head stay there.  Bursting goes on until all
   containers are small; a very common first turn only bursts once more.
2. Containers.  They are dealt into shards by head.  A task sorts the suffixes of its containers and sweeps over
   them with a stack: neighbours' common prefixes tell which nodes end and which begin.
3. The sums of subtrees go from the containers up the paths of the heads, one join a level.

The ids of a node's members are hashed in order from blocks of at most 4096 ids, a batch at a time, so no list of
members is ever held whole.  One conversation's list of ids (24 bytes a turn) is a row; its texts are not collected.

Defined results: null role and text count as empty; rows without conv_id take no part; turns are ordered by turn
(null first), role and text, so repeated rows are turns of their own; further columns are ignored; a conversation
without turns is a member of the root only; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcraft.llm.store import Scratch

MAX_SEQUENCES = 20_000  # of a container that does not burst
MAX_TURNS = 200_000     # likewise; and the turns of a shard
BLOCK_BITS = 12         # member ids are packed by blocks of so many bits
TURN_BITS = 10          # turns are numbered by blocks of so many bits
MAX_BROADCAST_HEADS = 50_000
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NODE_SCHEMA = ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in NODE)
SWEPT_SCHEMA = NODE_SCHEMA + ", up1 long, up2 long, level int"


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """conv_id and seq, the ordered (a, b, size) of its turns: two hashes and the UTF-8 bytes of the text.
    A conversation's turns are numbered by blocks of turn, so a long one is sorted by many tasks."""
    turns = (conversations.where("conv_id IS NOT NULL")
             .select(F.col("conv_id").cast("long"), F.col("turn").cast("long"),
                     *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")))
             .withColumn("block", F.coalesce(F.shiftright("turn", TURN_BITS), F.lit(-(1 << 63)).cast("long"))))
    order = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    ids = turns.select("conv_id", "block", F.row_number().over(order).alias("at"),
                       F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(7), "text", "role").alias("b"),
                       F.octet_length("text").cast("long").alias("size"))
    rows = ids.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "at", "a", "b", "size"))).alias("rows"))
    return rows.select("conv_id", F.transform("rows", lambda x: F.struct(x["a"], x["b"], x["size"])).alias("seq"))


def branches(sequences: DataFrame, every: int = 5, heads: int = 9) -> DataFrame:
    """Each conversation c begins with the first crc32(c) % ``heads`` turns of conversation c - c % ``every`` and
    goes on with its own turns after as many."""
    first = sequences.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"), F.slice("seq", 1, heads - 1).alias("base_seq"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    own = F.slice("seq", h + 1, F.greatest(F.size("seq"), F.lit(1)))
    return (sequences.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(first, "base", "left")
            .select("conv_id", F.when(F.col("base_seq").isNull(), own)
                    .otherwise(F.concat(F.slice("base_seq", 1, h), own)).alias("seq")))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """d1, d2, ends of rows sorted by (d1, d2, block)."""
    key, digest = None, None
    for batch in batches:
        done = []
        for d1, d2, ids in zip(*(batch.column(c).to_pylist() for c in ("d1", "d2", "ids"))):
            if key != (d1, d2):
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = (d1, d2), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if done:
            yield _columns(done, ["d1", "d2", "ends"])
    if key is not None:
        yield _columns([(*key, digest.hexdigest())], ["d1", "d2", "ends"])


def _columns(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=names)


def distinct_sequences(sequences: DataFrame) -> DataFrame:
    """seq, n (members), conv (the smallest), ends (SHA-256 of the members' ids in order, comma-joined)."""
    def pair() -> list[Column]:
        return [F.xxhash64("seq").alias("d1"), F.xxhash64(F.lit(7), F.size("seq"), "seq").alias("d2")]
    ends = (sequences.select("conv_id", *pair()).groupBy("d1", "d2", F.shiftright("conv_id", BLOCK_BITS).alias("block"))
            .agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
            .repartition("d1", "d2").sortWithinPartitions("d1", "d2", "block")
            .mapInArrow(_digests, "d1 long, d2 long, ends string"))
    return (sequences.groupBy("seq").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv"))
            .select("*", *pair()).join(ends, ["d1", "d2"]).drop("d1", "d2"))


def _bounded(df: DataFrame) -> DataFrame:
    """Broadcast only a table whose size has been counted; beyond that Spark joins by a shuffle."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST_HEADS + 1).count() <= MAX_BROADCAST_HEADS else df


def _common(lo: Column, hi: Column) -> Column:
    """Length of the common prefix of two arrays."""
    differs = F.array_position(F.zip_with(lo, hi, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(lo)).cast("int")


def _burst(live: DataFrame, big: DataFrame) -> DataFrame:
    """One row for each of the ``big`` heads: its path of nodes (sizes of their last texts) and their members."""
    path = F.slice(F.transform("lo", lambda x: x["size"]), F.greatest("depth", F.lit(1)),
                   F.col("low") - F.greatest("depth", F.lit(1)) + 1)
    return (live.join(_bounded(big), ["h1", "h2"]).groupBy("h1", "h2")
            .agg(F.first("depth").alias("depth"), *(F.first(c).alias(c) for c in ("up1", "up2", "parent_conv", "level")),
                 F.sum("n").alias("n"), F.min("conv").alias("conv"), F.min("seq").alias("lo"), F.max("seq").alias("hi"))
            .withColumn("low", _common(F.col("lo"), F.col("hi")))
            .withColumn("path", F.when(F.col("low") == 0, F.array(F.lit(0).cast("long")))
                        .when(F.col("depth") == 0, F.concat(F.array(F.lit(0).cast("long")), path)).otherwise(path))
            .drop("lo", "hi"))


def _sweep(table: pa.Table) -> pa.Table:
    """The nodes of all containers of a shard."""
    seq = table.column("seq").combine_chunks()
    if isinstance(seq, pa.ChunkedArray):
        seq = seq.chunk(0) if seq.num_chunks else pa.array([], seq.type)
    offsets = seq.offsets.to_numpy()
    turns = seq.values
    a, b = (pd.factorize(turns.field(c).to_numpy())[0].astype(np.int64) for c in ("a", "b"))
    ids = pd.factorize(a * (int(b.max(initial=0)) + 1) + b)[0].tolist()
    sizes = turns.field("size").to_numpy().tolist()
    col = {c: table.column(c).to_pylist() for c in ("h1", "h2", "depth", "up1", "up2", "parent_conv", "level", "n", "conv", "ends")}
    suffix = [ids[offsets[i] + d:offsets[i + 1]] for i, d in enumerate(col["depth"])]
    order = sorted(range(len(suffix)), key=lambda i: (col["h1"][i], col["h2"][i], suffix[i]))

    depth, parent, size, n, conv, kids, leaves, saved, ends, heads = ([] for _ in range(10))

    def begin(at: int, up: int, text: int) -> int:
        for values, x in ((depth, at), (parent, up), (size, text), (n, 0), (conv, None), (kids, 0), (leaves, 0), (saved, 0),
                          (ends, NO_ENDS)):
            values.append(x)
        return len(depth) - 1

    def end(x: int) -> None:
        leaves[x] = leaves[x] or 1
        saved[x] += (n[x] - 1) * size[x]
        up = parent[x]
        if up >= 0:
            n[up] += n[x]
            conv[up] = conv[x] if conv[up] is None else min(conv[up], conv[x])
            kids[up] += 1
            leaves[up] += leaves[x]
            saved[up] += saved[x]

    stack, head, last = [], None, []
    for i in order:
        at = col["depth"][i]
        if head != (col["h1"][i], col["h2"][i]):
            while stack:
                end(stack.pop())
            head, last = (col["h1"][i], col["h2"][i]), []
            stack.append(begin(at, -1, sizes[offsets[i] + at - 1] if at else 0))
            heads.append((stack[0], i))
        mine = suffix[i]
        shared = next((k for k, (x, y) in enumerate(zip(last, mine)) if x != y), min(len(last), len(mine)))
        while len(stack) > shared + 1:
            end(stack.pop())
        for k in range(shared, len(mine)):
            stack.append(begin(at + k + 1, stack[-1], sizes[offsets[i] + at + k]))
        top = stack[-1]
        n[top] += col["n"][i]
        conv[top] = col["conv"][i] if conv[top] is None else min(conv[top], col["conv"][i])
        ends[top] = col["ends"][i]
        last = mine
    while stack:
        end(stack.pop())

    above = [conv[p] if p >= 0 else None for p in parent]
    up1, up2, level = ([None] * len(depth) for _ in range(3))
    for node, i in heads:
        above[node], up1[node], up2[node], level[node] = (col[c][i] for c in ("parent_conv", "up1", "up2", "level"))
    long = pa.int64()
    return pa.table([pa.array(conv, long), pa.array(depth, long), pa.array(above, long), pa.array(n, long), pa.array(kids, long),
                     pa.array(leaves, long), pa.array(saved, long), pa.array(ends, pa.string()), pa.array(up1, long),
                     pa.array(up2, long), pa.array(level, pa.int32())], names=[*NODE, "up1", "up2", "level"])


def _unroll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of the heads' paths."""
    for batch in batches:
        for r in batch.to_pylist():
            path = np.array(r["path"], dtype=np.int64)
            k = len(path)
            saved = r["saved"] + (r["n"] - 1) * np.cumsum(path[::-1])[::-1]
            low = np.arange(k) == k - 1
            fill = np.full(k, r["conv"], dtype=np.int64)
            above = [r["parent_conv"], *[r["conv"]] * (k - 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(fill), pa.array(r["depth"] + np.arange(k)), pa.array(above, pa.int64()),
                 pa.array(np.full(k, r["n"])), pa.array(np.where(low, r["kids"], 1)), pa.array(np.full(k, r["leaves"])),
                 pa.array(saved), pa.array([NO_ENDS] * (k - 1) + [r["ends"] or NO_ENDS])], names=NODE)


def prefix_trie(sequences: DataFrame, max_sequences: int = MAX_SEQUENCES, max_turns: int = MAX_TURNS) -> DataFrame:
    """One row per node of the trie of ``sequences`` (conv_id, seq), the textless root included."""
    scratch = Scratch(sequences.sparkSession, "prefix-trie")
    null = F.lit(None).cast("long")
    live = scratch.save(distinct_sequences(sequences).select(
        F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), F.lit(0).alias("depth"), null.alias("up1"),
        null.alias("up2"), null.alias("parent_conv"), F.lit(0).alias("level"), "seq", "n", "conv", "ends"), "live-0")
    columns = live.columns
    settled, heads = [], []
    while True:
        r = len(heads)
        left = F.size("seq") - F.col("depth")
        big = (live.groupBy("h1", "h2").agg(F.count("*").alias("k"), F.sum(left).alias("t"))
               .where((F.col("k") > 1) & ((F.col("k") > max_sequences) | (F.col("t") > max_turns))).select("h1", "h2"))
        big = scratch.save(big, f"big-{r}")
        if big.isEmpty():
            settled.append(live)
            break
        top = scratch.save(_burst(live, big), f"paths-{r}")
        marks = _bounded(top.select("h1", "h2", "low", F.col("conv").alias("top_conv")))
        marked = live.join(marks, ["h1", "h2"], "left")
        settled.append(marked.where("low IS NULL").select(*columns))
        ended = marked.where(F.size("seq") == F.col("low")).select("h1", "h2", "ends")
        heads.append(scratch.save(top.join(ended, ["h1", "h2"], "left"), f"heads-{r}"))
        turn = F.element_at("seq", F.col("low") + 1)
        live = scratch.save(marked.where(F.size("seq") > F.col("low")).select(
            F.xxhash64("h1", "h2", "low", turn["a"], turn["b"]).alias("h1"),
            F.xxhash64(F.lit(7), "h2", "h1", "low", turn["b"], turn["a"]).alias("h2"), (F.col("low") + 1).alias("depth"),
            F.col("h1").alias("up1"), F.col("h2").alias("up2"), F.col("top_conv").alias("parent_conv"),
            (F.col("level") + 1).alias("level"), "seq", "n", "conv", "ends"), f"live-{r + 1}")

    containers = settled[0]
    for more in settled[1:]:
        containers = containers.unionByName(more)
    turns = containers.agg(F.sum(F.size("seq") - F.col("depth") + 1)).first()[0] or 0
    shard = F.pmod(F.xxhash64("h1", "h2"), F.lit(turns // max_turns + 1)).alias("shard")
    swept = scratch.save(containers.select("*", shard).groupBy("shard").applyInArrow(_sweep, SWEPT_SCHEMA), "swept")
    scratch.drop(*(f"{name}-{r}" for r in range(len(heads) + 1) for name in ("live", "big", "paths")))

    nodes = swept.select(*NODE)
    tops = swept.where("up1 IS NOT NULL").select("up1", "up2", "level", "n_leaves", "saved_tokens")
    below = tops
    for r in reversed(range(len(heads))):
        sums = below.where(F.col("level") == r + 1).groupBy(F.col("up1").alias("h1"), F.col("up2").alias("h2")).agg(
            F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        filled = scratch.save(heads[r].join(sums, ["h1", "h2"]), f"filled-{r}")
        nodes = nodes.unionByName(filled.mapInArrow(_unroll, NODE_SCHEMA))
        whole = F.aggregate("path", F.lit(0).cast("long"), lambda x, y: x + y)
        below = tops.unionByName(filled.select("up1", "up2", "level", F.col("leaves").alias("n_leaves"), (
            F.col("saved") + (F.col("n") - 1) * whole).alias("saved_tokens")))
    return nodes


ORACLE_SQL = r"""
WITH numbered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT conv_id AS c, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
    lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda v, x: CASE WHEN x >= 0 THEN xor(v, x) ELSE xor(v >> 1, (v & 1) * 3988292384) END), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM numbered)),
turns AS (
  SELECT c, pos, role, text FROM crc JOIN numbered ON conv_id = c - c % 5 AND pos <= h
  UNION ALL SELECT c, pos + 1000000000, role, text FROM crc JOIN numbered ON conv_id = c AND pos > h),
convs AS (
  SELECT crc.c, coalesce(list({'r': role, 't': text} ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS seq
  FROM crc LEFT JOIN turns USING (c) GROUP BY crc.c),
member_rows AS (
  SELECT c, unnest(range(len(seq) + 1)) AS depth, seq FROM convs),
prefixes AS (
  SELECT c, depth, md5(list_slice(seq, 1, depth)::VARCHAR || depth) AS node,
    CASE WHEN depth > 0 THEN md5(list_slice(seq, 1, depth - 1)::VARCHAR || (depth - 1)) END AS up,
    CASE WHEN depth > 0 THEN strlen(seq[depth].t) ELSE 0 END AS size, depth = len(seq) AS is_end FROM member_rows),
nodes AS (
  SELECT node, any_value(up) AS up, min(c) AS conv_id, any_value(depth) AS depth, count(*) AS n, any_value(size) AS size,
    coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE is_end), '') AS ends FROM prefixes GROUP BY node),
kids AS (SELECT up, count(*) AS n FROM nodes GROUP BY up),
above AS (
  SELECT DISTINCT a.node AS top, b.node FROM prefixes a JOIN prefixes b ON a.c = b.c AND a.depth <= b.depth),
sums AS (
  SELECT top, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((m.n - 1) * m.size) AS saved
  FROM above JOIN nodes m ON above.node = m.node LEFT JOIN kids k ON k.up = m.node GROUP BY top)
SELECT m.conv_id, m.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, m.n::BIGINT AS n_convs, coalesce(k.n, 0)::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM nodes m LEFT JOIN nodes p ON m.up = p.node LEFT JOIN kids k ON k.up = m.node JOIN sums s ON s.top = m.node
"""
