"""Quality rules: repetition coverage of a text, measured with rolling hashes of words.

For several n the hashes of all n-word windows of a text are compared inside the text; a character is covered
when it lies in a word of a window that occurs twice or more.  Lines are compared by their hashes too.  Every
measure is a per-text sum over numpy arrays of a chunk of texts, so there is no shuffle and no group.

Defined results: a null or empty text has no words and fails the base rule (fewer than ``MIN_WORDS`` words);
repeated rows are scored one by one; further columns of the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelcraft.llm import words as W

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, dup_line_chars double, top_gram_chars array<double>, "
          "dup_gram_chars array<double>, symbol_share double")
MIN_WORDS = 50
MAX_REPEAT_WORDS = 0.5           # share of the words in repeated 3-word windows
MAX_DUP_LINE_CHARS = 0.3         # share of the characters in lines equal to an earlier line
TOP_GRAMS = {2: 0.20, 3: 0.18, 4: 0.16}   # share of the characters in the most frequent n-gram
DUP_GRAMS = {5: 0.50, 7: 0.48, 10: 0.45}  # share of the characters in repeated n-grams
MAX_SYMBOLS = 0.1                # symbols per word
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def _per_row(rows: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=weights, minlength=n)


def repeated(key: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The elements whose (row, key) occurs twice or more, grouped, in order inside each group: their places,
    their group's size, and whether an equal one came earlier."""
    key = W.mix(key + rows.astype(np.uint64) * W.BASE)
    bits = np.uint64(max(1, len(key)).bit_length())
    packed = (key >> bits << bits) | np.arange(len(key), dtype=np.uint64)
    packed.sort()  # one plain sort: high bits of the key, then the place
    place = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    near = np.flatnonzero((packed[1:] >> bits) == (packed[:-1] >> bits))
    if (key[place[near]] != key[place[near + 1]]).any():  # equal only in the high bits: sort by the whole key
        place = np.argsort(key, kind="stable")
        near = np.flatnonzero(key[place[1:]] == key[place[:-1]])
    member = np.zeros(len(key) + 1, dtype=bool)
    member[near] = member[near + 1] = True
    later = np.zeros(len(key), dtype=bool)
    later[near + 1] = True
    at = np.flatnonzero(member[:-1])
    later = later[at]
    group = np.cumsum(~later) - 1
    return place[at], (np.bincount(group)[group] if len(group) else group), later


def _covered(first: np.ndarray, n: int, n_words: int) -> np.ndarray:
    """Words inside at least one of the windows that begin at ``first``."""
    edge = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    starts, ends, rows = W.word_spans(data, offsets)
    hashes = W.span_hashes(data, starts, ends)
    # code points: bytes that do not continue a UTF-8 sequence
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = points[ends] - points[starts]
    out = {"n_words": np.bincount(rows, minlength=n), "word_chars": _per_row(rows, chars, n)}
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    out["n_symbols"] = symbols[offsets[1:]] - symbols[offsets[:-1]]

    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_start = line_start[line_start < len(data)]
    line_end = np.concatenate([line_start[1:], [len(data)]]).astype(np.int64) if len(line_start) else line_start
    line_row = np.searchsorted(offsets, line_start, side="right") - 1
    # a line runs up to its \n; the last line of a text has none
    closed = np.zeros(len(line_end), dtype=bool)
    if len(line_end):
        closed = data[line_end - 1] == 10
    line_end = line_end - closed
    has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_row = line_start[has_word], line_end[has_word], line_row[has_word]
    at, _, later = repeated(W.span_hashes(data, line_start, line_end), line_row)
    later = at[later]
    out["n_dup_lines"] = np.bincount(line_row[later], minlength=n)
    in_lines = np.concatenate([[0], np.cumsum(chars)])
    line_chars = in_lines[np.searchsorted(starts, line_end)] - in_lines[np.searchsorted(starts, line_start)]
    total = np.maximum(out["word_chars"], 1)
    out["dup_line_chars"] = _per_row(line_row[later], line_chars[later], n) / total

    top, dup = [], []
    run = np.concatenate([[0], np.cumsum(chars)])
    values, reach = hashes, 1  # the window hashes roll on from one length to the next
    for size in sorted({3, *TOP_GRAMS, *DUP_GRAMS}):
        values, reach = W.longer(values, reach, hashes, size), size
        first = np.flatnonzero(rows[:len(values)] == rows[size - 1:]) if len(values) else values.astype(np.int64)
        at, count, _ = repeated(values[first], rows[first])
        first = first[at]
        if size in TOP_GRAMS:
            best = np.zeros(n)
            np.maximum.at(best, rows[first], count * (run[first + size] - run[first]))
            top.append(best / total)
        covered = _covered(first, size, len(rows))
        if size == 3:
            out["n_repeat_words"] = np.bincount(rows[covered], minlength=n)
        if size in DUP_GRAMS:
            dup.append(_per_row(rows[covered], chars[covered], n) / total)
    out["top"], out["dup"] = np.stack(top, axis=1), np.stack(dup, axis=1)
    return out


def verdict(m: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    words = m["n_words"]
    base = (words < MIN_WORDS) | (m["n_repeat_words"] > MAX_REPEAT_WORDS * words)
    share = m["n_symbols"] / np.maximum(words, 1)
    bad = (m["dup_line_chars"] > MAX_DUP_LINE_CHARS) | (share > MAX_SYMBOLS)
    bad |= (m["top"] > np.array(list(TOP_GRAMS.values()))).any(axis=1)
    bad |= (m["dup"] > np.array(list(DUP_GRAMS.values()))).any(axis=1)
    return m | {"base_failed": base, "kept": ~base & ~bad, "symbol_share": share}


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in W.text_chunks(batch, "text"):
            m = verdict(measure(data, offsets))
            whole = [pa.array(m[k].astype(np.int64)) for k in
                     ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").cast(pa.int64()), *whole, pa.array(m["base_failed"]), pa.array(m["kept"]),
                 pa.array(m["dup_line_chars"]), pa.array(list(m["top"])), pa.array(list(m["dup"])),
                 pa.array(m["symbol_share"])],
                names=[c.split()[0] for c in SCHEMA.split(", ")])


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: the measures, the base rule and the verdict (``kept``)."""
    return docs.select("doc_id", "text").mapInArrow(_score, SCHEMA)


def _filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in W.text_chunks(batch, "text"):
            yield rows.filter(pa.array(verdict(measure(data, offsets))["kept"]))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass the rules, with all their columns; no shuffle."""
    return docs.mapInArrow(_filter, docs.schema)
