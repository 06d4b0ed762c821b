"""Audit of how far the sources of a language differ in their vocabulary.

1. Arrow compute inside ``mapInArrow``: ``ascii_lower``, ``split_pattern_regex``, ``dictionary_encode`` and a hash
   ``group_by`` turn the texts of a task into partial counts by (lang, source, term): occurrences and documents.
   They are combined map-side and merged by one shuffle, so a hot source costs a row a task and term.
2. A language keeps the terms that enough of its documents hold.  p of a term in a group is an integer, one plus
   10^9 (count + 5) / (N + 5 V) rounded down; decimals carry the products, so nothing is rounded otherwise.
3. The kept counts are dealt into columnar shards by term.  A shard holds its terms' counts as a (source, term)
   array beside the N of every source of the language, and gives the sums of abs(p - q) of each pair of sources
   over its terms; the sums of the shards are added.

Defined results: null text, lang and source count as ''; repeated rows count as documents of their own; a source
without kept terms has N = 0 and takes part; a language without kept terms has V = 0, pairs of value 0 and no
term rows; equal values rank by item, byte by byte; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcraft.llm import words as W
from panelcraft.llm.store import Scratch

SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS = 30
TOP_TERMS = 50
ADDED = 5             # to every count
SCALE = 1_000_000_000
CHUNK_BYTES = 4 << 20    # of text that is split at once
HELD_ROWS = 400_000      # partial counts that a task merges before it sends them on
SHARD_TERMS = 8192
BLOCK_CELLS = 1 << 20    # of a shard's array that is held at once
MAX_BROADCAST_GROUPS = 50_000
COUNTS = "lang string, source string, term string, n long, docs long"
NAMES = ["lang", "source", "term", "n", "docs"]


def chunk_counts(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.Table:
    """lang, source, term, n, docs of some documents; each group also has a row with a null term and no counts."""
    words = pc.split_pattern_regex(pc.ascii_lower(text), SEPARATORS)
    rows, terms = pc.list_parent_indices(words), pc.list_flatten(words)
    filled = pc.greater(pc.binary_length(terms), 0)
    rows, terms = rows.filter(filled), terms.filter(filled).dictionary_encode()
    per_doc = (pa.table({"row": rows, "code": terms.indices}).group_by(["row", "code"], use_threads=False)
               .aggregate([([], "count_all")]))
    groups = pa.table({"lang": lang, "source": source})
    lang, source = lang.dictionary_encode(), source.dictionary_encode()
    counts = (pa.table({"l": lang.indices.take(per_doc["row"]), "s": source.indices.take(per_doc["row"]),
                        "code": per_doc["code"], "k": per_doc["count_all"]})
              .group_by(["l", "s", "code"], use_threads=False).aggregate([("k", "sum"), ([], "count_all")]))
    found = pa.table([lang.dictionary.take(counts["l"]), source.dictionary.take(counts["s"]),
                      terms.dictionary.take(counts["code"]).cast(pa.string()), counts["k_sum"], counts["count_all"]], NAMES)
    groups = groups.group_by(["lang", "source"], use_threads=False).aggregate([])
    zero = pa.array(np.zeros(groups.num_rows, dtype=np.int64))
    return pa.concat_tables([found, pa.table([groups["lang"], groups["source"],
                                              pa.nulls(groups.num_rows, pa.string()), zero, zero], NAMES)])


def _merge(tables: list[pa.Table]) -> pa.Table:
    merged = (pa.concat_tables(tables).group_by(["lang", "source", "term"], use_threads=False)
              .aggregate([("n", "sum"), ("docs", "sum")]))
    return merged.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(NAMES)


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for batch in batches:
        for part, data, offsets in W.text_chunks(batch, "text", CHUNK_BYTES):
            # arrays of their own: ``ascii_lower`` of a slice of a large_string array garbles its texts
            every = pa.array(np.arange(part.num_rows))
            text = pa.Array.from_buffers(pa.large_string(), part.num_rows,
                                         [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(data)])
            held.append(chunk_counts(part.column("lang").take(every), part.column("source").take(every), text))
            rows += held[-1].num_rows
            if rows > HELD_ROWS:
                held = [_merge(held)]
                rows = held[0].num_rows
                if rows > HELD_ROWS // 2:  # merging no longer shrinks them: send them on
                    yield from held.pop().combine_chunks().to_batches(max_chunksize=100_000)
                    rows = 0
    if held:
        yield from _merge(held).combine_chunks().to_batches(max_chunksize=100_000)


def kept_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, term, n (occurrences), n_lang (in the whole language) of the terms that at least ``min_docs`` documents
    of a language hold, and a row with a null term for every group.  One shuffle, of the tasks' merged counts."""
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = (texts.mapInArrow(_partial_counts, COUNTS).repartition("lang", "term").groupBy("lang", "source", "term")
              .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    term = Window.partitionBy("lang", "term")
    return (counts.withColumns({"n_lang": F.sum("n").over(term), "docs": F.sum("docs").over(term)})
            .where((F.col("docs") >= min_docs) | F.col("term").isNull()).drop("docs"))


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (n + 5 v)), exactly."""
    wide = [x.cast("decimal(20,0)") for x in (count + ADDED, n + v * ADDED)]
    return F.call_function("div", wide[0] * F.lit(SCALE).cast("decimal(10,0)"), wide[1]) + 1


def _bounded(df: DataFrame) -> DataFrame:
    """Broadcast only a table whose size has been counted; beyond that Spark joins by a shuffle."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST_GROUPS + 1).count() <= MAX_BROADCAST_GROUPS else df


def _shares(counts: np.ndarray, n: np.ndarray, v: int) -> np.ndarray:
    """``share`` of a (source, term) array: whole numbers while they fit 64 bits, Python's own beyond."""
    below = n + ADDED * v
    if int(counts.max(initial=0)) + ADDED <= (2**63 - 1) // SCALE:
        return 1 + SCALE * (counts + ADDED) // below[:, None]
    return np.array([[1 + SCALE * (int(c) + ADDED) // int(b) for c in row] for row, b in zip(counts, below)], dtype=np.int64)


def _shard_sums(frame: pd.DataFrame) -> pd.DataFrame:
    """Sums of abs(p - q) over a shard's terms, for each ordered pair of sources of its language."""
    heads = frame[frame["term"].isna()].sort_values("source")
    sources, n, v = heads["source"].to_numpy(), heads["n_all"].to_numpy(), int(heads["v"].iloc[0])
    cells = frame[frame["term"].notna()]
    column, terms = pd.factorize(cells["term"])
    row = pd.Index(sources).get_indexer(cells["source"])
    sums = np.zeros((len(sources), len(sources)), dtype=np.int64)
    order = np.argsort(column, kind="stable")
    column, row, count = column[order], row[order], cells["n"].to_numpy()[order]
    width = max(1, BLOCK_CELLS // len(sources))
    for at in range(0, len(terms), width):
        lo, hi = np.searchsorted(column, [at, at + width])
        block = np.zeros((len(sources), min(width, len(terms) - at)), dtype=np.int64)
        block[row[lo:hi], column[lo:hi] - at] = count[lo:hi]
        p = _shares(block, n, v)
        for i in range(len(sources)):
            sums[i] += np.abs(p - p[i]).sum(axis=1)
    a, b = np.nonzero(~np.eye(len(sources), dtype=bool))
    return pd.DataFrame({"lang": heads["lang"].iloc[0], "source": sources[a], "item": sources[b], "value": sums[a, b]})


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS,
               shard_terms: int = SHARD_TERMS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    scratch = Scratch(docs.sparkSession, "divergence")
    counts = scratch.save(kept_counts(docs, min_docs), "counts")
    cells = counts.where("term IS NOT NULL")
    langs = (cells.groupBy("lang", "term").agg(F.max("n_lang").alias("n_lang"))
             .groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("n_all_lang")))
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("n_all"))
    groups = scratch.save(sizes.join(langs, "lang", "left").select(
        "lang", "source", "n_all", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("v", "n_all_lang"))), "groups")

    sized = cells.join(_bounded(groups), ["lang", "source"])
    shards = F.ceil(F.col("v") / shard_terms).cast("long")
    dealt = sized.select("lang", "source", "term", "n", "n_all", "v", F.pmod(F.xxhash64("term"), shards).alias("shard"))
    heads = groups.where("v > 0").select(
        "lang", "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), "n_all", "v",
        F.explode(F.sequence(F.lit(0).cast("long"), shards - 1)).alias("shard"))
    sums = (dealt.unionByName(heads).groupBy("lang", "shard")
            .applyInPandas(_shard_sums, "lang string, source string, item string, value long"))
    # sources of a language without kept terms differ by nothing
    none = groups.where("v = 0").select("lang", "source")
    none = none.join(none.withColumnRenamed("source", "item"), "lang").where("source <> item")
    pairs = (sums.unionByName(none.withColumn("value", F.lit(0).cast("long")).select(*sums.columns))
             .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))

    over = share(F.col("n"), F.col("n_all"), F.col("v")) - share(F.col("n_lang"), F.col("n_all_lang"), F.col("v"))
    terms = (sized.where("n > 0").select("lang", "source", F.col("term").alias("item"), over.alias("value"))
             .where("value > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (pairs.withColumn("part", F.lit("pair")).select(*columns)
            .unionByName(terms.withColumn("part", F.lit("term")).select(*columns)))


ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
found AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
per_lang AS (
  SELECT lang, term, count(*) AS n FROM found GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(n) AS n_all FROM per_lang GROUP BY lang),
all_groups AS (SELECT DISTINCT lang, source FROM docs),
cells AS (
  SELECT g.lang, g.source, l.term, l.n AS n_lang, (
    SELECT count(*) FROM found f WHERE f.lang = g.lang AND f.source = g.source AND f.term = l.term) AS n
  FROM all_groups g JOIN per_lang l ON g.lang = l.lang),
sizes AS (SELECT lang, source, sum(n) AS n_all FROM cells GROUP BY lang, source),
shares AS (
  SELECT c.lang, c.source, c.term, c.n,
    1 + (1000000000::HUGEINT * (c.n + 5)) // (s.n_all::HUGEINT + 5 * l.v) AS p,
    1 + (1000000000::HUGEINT * (c.n_lang + 5)) // (l.n_all::HUGEINT + 5 * l.v) AS q
  FROM cells c JOIN sizes s ON c.lang = s.lang AND c.source = s.source JOIN langs l ON c.lang = l.lang),
pair_rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce((
    SELECT sum(abs(x.p - y.p)) FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term
    WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
  FROM all_groups a JOIN all_groups b ON a.lang = b.lang AND a.source <> b.source),
term_rows AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pair_rows UNION ALL SELECT * FROM term_rows))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
