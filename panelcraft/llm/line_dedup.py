"""Line dedup by overlapping three-line windows.

Every three consecutive lines with text (trimmed; lines without text do not count) are hashed.  A window that
occurs again, in the same or another document, is a repeat; its first occurrence, by doc_id and position, stays,
and every line covered by a later occurrence goes.  A line that goes has an equal line at an earlier place, so
nothing is lost.  Windows are grouped by their hash with a minimum, which combines before the shuffle; the join
back to the occurrences is a plain equi-join that adaptive execution can split where a window is very frequent.

Defined results: a null text counts as empty; documents of fewer than three lines with text have no window and
stay as they are; rows with equal doc_id and text are one document, each getting the same result; a null doc_id
sorts first; further columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcraft.llm import words as W

WINDOW = 3
OTHER_BASE = np.uint64(0xC2B2AE3D27D4EB4F)


def text_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trimmed byte span and row of every line that has text."""
    starts, ends, rows = W.word_spans(data, offsets)
    line = np.cumsum(data == 10)[starts] if len(starts) else starts
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (line[1:] != line[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return starts[first], ends[last], rows[first]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in W.text_chunks(batch, "text"):
            starts, ends, rows = text_lines(data, offsets)
            h1 = W.sequence_hashes(W.span_hashes(data, starts, ends), WINDOW)
            h2 = W.sequence_hashes(W.span_hashes(data, starts, ends, OTHER_BASE), WINDOW)
            inside = np.flatnonzero(rows[:len(h1)] == rows[WINDOW - 1:]) if len(h1) else h1.astype(np.int64)
            own = rows[inside]
            ordinal = inside - np.searchsorted(rows, own)
            take = pa.array(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1[inside].view(np.int64)), pa.array(h2[inside].view(np.int64)),
                 *(part.column(c).take(take) for c in ("doc_id", "k1", "k2")), pa.array(ordinal)],
                names=["h1", "h2", "doc_id", "k1", "k2", "pos"])


def with_key(docs: DataFrame) -> DataFrame:
    """Two 64-bit hashes of doc_id and text identify a row's document (a null id has one too)."""
    return docs.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64(F.lit(7), "text", "doc_id")})


def later_windows(docs: DataFrame) -> DataFrame:
    """k1, k2, cut: the ordinals of the windows that repeat an earlier one, for the documents with any."""
    keyed = with_key(docs.select(F.col("doc_id").cast("long"), "text"))
    windows = keyed.mapInArrow(_windows, "h1 long, h2 long, doc_id long, k1 long, k2 long, pos long")
    place = F.struct("doc_id", "k1", "k2", "pos")
    repeated = (windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
                .where("first <> last").select("h1", "h2", "first"))
    return (windows.join(repeated, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
            .groupBy("k1", "k2").agg(F.sort_array(F.collect_set("pos")).alias("cut")))


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, lines, removed = [], [], []
        for text, cut in zip(batch.column("text").to_pylist(), batch.column("cut").to_pylist()):
            every = (text or "").split("\n")
            full = [i for i, line in enumerate(every) if line.strip(" \t\n\v\f\r")]
            gone = {full[p + j] for p in cut or () for j in range(WINDOW)}
            texts.append("\n".join(line for i, line in enumerate(every) if i not in gone) if gone else text)
            lines.append(len(full))
            removed.append(len(gone))
        keep = [c for c in batch.schema.names if c not in ("text", "cut")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in keep), pa.array(texts, pa.string()), pa.array(lines, pa.int64()),
             pa.array(removed, pa.int64())], names=[*keep, "text", "n_lines", "n_removed"])


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with its text cleaned, and n_lines (with text) and n_removed."""
    names = docs.columns
    cuts = later_windows(docs).select(F.col("k1").alias("cut_k1"), F.col("k2").alias("cut_k2"), "cut")
    packed = with_key(docs.select("doc_id", "text", F.struct(*names).alias("row")))
    rest = [c for c in names if c != "text"]
    joined = (packed.withColumn("row", F.struct(*(F.col(f"row.`{c}`").alias(c) for c in rest)))
              .join(cuts, (F.col("k1") == F.col("cut_k1")) & (F.col("k2") == F.col("cut_k2")), "left")
              .select("row", "text", "cut"))
    row_type = joined.schema["row"].dataType.simpleString()
    cleaned = joined.mapInArrow(_clean, f"row {row_type}, text string, n_lines long, n_removed long")
    return cleaned.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names),
                          "n_lines", "n_removed")


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {'no': i, 'line': x})) AS l FROM documents),
full_lines AS (
  SELECT doc_id, l.no AS line_no, trim(l.line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS line FROM lines),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS pos FROM full_lines WHERE line <> ''),
windows AS (
  SELECT doc_id, pos, line AS a, lead(line) OVER w AS b, lead(line, 2) OVER w AS c FROM numbered
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
later AS (
  SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS n FROM windows WHERE c IS NOT NULL)
  WHERE n > 1),
gone AS (
  SELECT DISTINCT n.doc_id, n.line_no FROM numbered n JOIN later w ON n.doc_id = w.doc_id AND n.pos BETWEEN w.pos AND w.pos + 2),
kept AS (
  SELECT l.doc_id, string_agg(l.l.line, chr(10) ORDER BY l.l.no) AS text
  FROM lines l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.l.no = g.line_no GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.text, '') AS text,
  (SELECT count(*) FROM numbered n WHERE n.doc_id = d.doc_id)::BIGINT AS n_lines,
  (SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id)::BIGINT AS n_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
