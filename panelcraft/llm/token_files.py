"""Token-id files: Parquet with one list column of ids per document.

The ids are dictionary-encoded (a vocabulary fits one dictionary page), doc_id and running counts are
delta-encoded, row groups and pages have a set size, and every column has page indexes, so ids and metadata
can be read on their own.  Documents are range-partitioned by doc_id, which needs no global sort in one task;
``start`` is the file's offset (one row per file is summed) plus the running count inside the file.

Every word (a run without ASCII white space) is encoded by the tokenizers library on its own: the tokenizer drops
white space, so its ids are those of the words, one after the other; ids of frequent words are kept.

Defined results: null and empty texts hold the end id alone; a null doc_id sorts first; repeated doc_ids follow each
other in the order of their texts' hashes; the strings of special tokens in a text have these tokens' ids with ``special_ids``,
as with an unchanged tokenizer, and are ordinary text without; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcraft.llm import words as W

FILE_SCHEMA = "part int, doc_id long, before long, n_tokens long, ids array<int>"
WRITE_OPTIONS = {
    "compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10), "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "true", "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#before": "false",
}
MEMO_BYTES = 72 << 20  # of the words whose ids are kept, in each of two generations
ENTRY_BYTES = 200      # that a word and its ids take beside their own bytes
GROUP_ROWS = 512
WORD_END = "</w>"     # fixed value: the mark of the vocabulary's word ends
#: Letters whose lower case is one letter, and marks after them (no apostrophe, which may start a piece).
LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
STEM_AND_MARKS = f"^(?P<stem>[{LETTERS}]+)(?P<marks>[.,!?;:#$%&*|<>]*)$"
STEM = re.compile(f"[{LETTERS}]+").fullmatch


class WordTokenizer:
    def __init__(self, path: str, special_ids: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # the library's own default is special_ids; else the strings of special tokens in a text are ordinary text
        self.tokenizer.encode_special_tokens = not special_ids
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        ids, edges = self.encode_array(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the edges of each text's ids."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = words.flatten().dictionary_encode()
        # letters and the marks after them are two pieces of the tokenizer, and letters lose their case
        parts = pc.extract_regex(coded.dictionary, STEM_AND_MARKS)
        stems = pc.coalesce(pc.utf8_lower(pc.struct_field(parts, "stem")), coded.dictionary)
        marks = pc.fill_null(pc.struct_field(parts, "marks"), "")
        unique = pc.binary_join_element_wise(self._packed(stems), self._packed(marks), pa.scalar(b"", pa.large_binary()))
        # taken from the dictionary, the packed ids of the words stand in one buffer
        packed = unique.take(coded.indices)
        edges = np.concatenate([[0], np.cumsum(pc.binary_length(packed).to_numpy(zero_copy_only=False) // 4, dtype=np.int64)])
        ids = np.frombuffer(packed.buffers()[2] or b"", dtype="<i4", count=int(edges[-1]))
        return ids, edges[words.offsets.to_numpy() - words.offsets[0].as_py()]

    def _packed(self, words: pa.Array) -> pa.Array:
        """The ids of each word, packed."""
        coded = words.dictionary_encode()
        unique = coded.dictionary.to_pylist()
        found = list(map(self.memo.get, unique))
        joined, single, size, older = [], [], 0, self.older.get
        new: dict[str, bytes] = {}
        for i, packed in enumerate(found):
            if packed is None:
                word = unique[i]
                size += ENTRY_BYTES + 2 * len(word)
                packed = older(word)
                if packed is not None:
                    found[i] = new[word] = packed
                elif STEM(word) is not None:
                    joined.append(i)
                else:
                    single.append(i)
        for how, own in ((self._joined, joined), (self._single, single)):
            words = [unique[i] for i in own]
            learnt = how(words)
            new.update(zip(words, learnt))
            for i, packed in zip(own, learnt):
                found[i] = packed
        if self.held + size > MEMO_BYTES:
            self.older, self.memo, self.held = self.memo, {}, 0
        self.memo.update(new)
        self.held += size
        return pa.array(found, pa.large_binary()).take(coded.indices)

    def _single(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<i4").tobytes()
                for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _joined(self, words: list[str]) -> list[bytes]:
        """Words of letters, many to a text: each ends with the one id that ends a word."""
        groups = [words[i:i + 256] for i in range(0, len(words), 256)]
        out = []
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<i4")
            cut = np.flatnonzero(self.ends_word[ids]) + 1
            if len(cut) != len(group):
                out += self._single(group)
                continue
            packed, edges = ids.tobytes(), [0, *(4 * cut).tolist()]
            out += [packed[a:b] for a, b in zip(edges, edges[1:])]
        return out


def word_tokenizer(path: str, special_ids: bool) -> WordTokenizer:
    return W.keep(("words", path, special_ids), lambda: WordTokenizer(path, special_ids))


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, special_ids: bool = False) -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, before = word_tokenizer(tokenizer_path, special_ids), TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, len(whole), GROUP_ROWS):
                batch = whole.slice(at, GROUP_ROWS)
                values, edges = own.encode_array(batch.column("text"))
                values = np.insert(values, edges[1:], end_id)
                ends = edges + np.arange(len(edges))
                n = np.diff(ends)
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, dtype=np.int32)), batch.column("doc_id"),
                     pa.array(before + ends[:-1]), pa.array(n), ids],
                    names=[c.split()[0] for c in FILE_SCHEMA.split(", ")])
                before += int(ends[-1])

    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
     .repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
     .mapInArrow(run, FILE_SCHEMA).write.mode("overwrite").options(**WRITE_OPTIONS).parquet(path))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids."""
    table = spark.read.schema(FILE_SCHEMA).parquet(path)
    files = table.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"))
    # one row per file
    return (table.join(F.broadcast(offsets), "part")
            .select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids"))


def with_crc(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the ids that were read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            values = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            edges = ids.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), pa.array(np.diff(edges).astype(np.int64)),
                 pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "ids").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")
