import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from panelcraft.llm import bpe, token_files, words
from panelcraft.llm.store import Scratch

PATH = P.path("byte_bpe_50k.tiktoken")
ALPHABET = [" ", "  ", "\n", "\t", "a", "b", "'", "'s", "'re", "'ll", "r", "e", "1", "2", "²", "é", "ß", "中", "\U0001f642", "\x1c",
            "\x85", "　", "!", "--", "_", "Ⅷ", "don't", "́"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(packed):
    return np.frombuffer(packed, dtype="<u4").tolist()


@pytest.mark.parametrize("leaf", [1, 2, 3, 7, 2048])
def test_tree_equals_the_library(library, monkeypatch, leaf):
    monkeypatch.setattr(bpe, "LEAF_CHARS", leaf)
    monkeypatch.setattr(bpe, "LEAF_BYTES", max(2, leaf % 11))
    monkeypatch.setattr(bpe, "SPAN_CHARS", leaf + 9)
    own, rng = bpe.Tokenizer(PATH, P.PATTERN), random.Random(leaf)
    for _ in range(300):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60)))
        assert ids(own.encode(text)) == library.encode_ordinary(text), repr(text)
        assert own.decode(own.encode(text)) == text.encode()


def test_long_pieces(library):
    own, rng = bpe.Tokenizer(PATH, P.PATTERN), random.Random(1)
    for text in ["a" * 3000, "ab" * 2000, " " * 999, "中" * 700, "".join(rng.choice("abcdehtion") for _ in range(20000))]:
        assert ids(own.encode(text)) == library.encode_ordinary(text)


def test_round_trip_over_a_table(library, docs, none, rows):
    got = sorted(map(tuple, bpe.round_trip(docs, PATH, P.PATTERN).collect()), key=str)
    want = []
    for r in rows:
        packed = np.array(library.encode_ordinary(r[1] or ""), dtype="<u4").tobytes()
        want.append((r[0], len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.round_trip(none, PATH, P.PATTERN).count() == 0
    for r in bpe.with_ids(docs, PATH, P.PATTERN).collect():
        assert len(r["ids"]) == r["n_tokens"]


def test_token_files(spark, docs, none, rows):
    path = Scratch(spark, "test-token-files").path("ids")
    own = P.path("word_bpe_49k.json")
    token_files.write_token_files(docs, path, own, 2)
    got = sorted(map(tuple, token_files.with_crc(token_files.read_token_files(spark, path)).collect()), key=lambda r: r[1])
    library = Tokenizer.from_file(own)
    library.encode_special_tokens = True
    want, start = {}, 0
    for r in rows:
        x = np.array(library.encode(r[1] or "", add_special_tokens=False).ids + [2], dtype="<u4")
        want.setdefault(r[0], []).append((len(x), zlib.crc32(x.tobytes())))
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda i: -1 if i is None else i)
    for doc_id, at, n, crc in got:
        assert at == start and (n, crc) in want[doc_id]
        start += n
    empty = Scratch(spark, "test-token-files").path("none")
    token_files.write_token_files(none, empty, own, 2)
    assert token_files.with_crc(token_files.read_token_files(spark, empty)).count() == 0


def test_words_equal_whole_texts():
    own, library = token_files.WordTokenizer(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    rng, texts = random.Random(8), []
    for _ in range(400):
        texts.append("".join(rng.choice([*ALPHABET, "Straße,", "ÀÉ.", "don't.", "abc!", "thE", "x:"]) for _ in range(rng.randint(0, 30))))
    assert [ids(p) for p in own.encode_many(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_query_equals_the_unchanged_library(spark, tmp_path):
    from panelcraft.llm.queries import op7_token_files

    library, rng = Tokenizer.from_file(P.path("word_bpe_49k.json")), random.Random(4)
    assert library.encode("a <|endoftext|> b", add_special_tokens=False).ids == [320, 49407, 321]
    parts = [*ALPHABET, "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", "abc!", "x<|endoftext|>", "don't."]
    texts = ["a <|endoftext|> b", "a<|endoftext|>b", None, ""]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(300)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    start = 0
    for r in op7_token_files(spark, str(tmp_path)).orderBy("doc_id").collect():
        x = np.array(library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [2], dtype="<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)


@pytest.mark.parametrize("text", ["=" * 5001, "a" * 9000, "abc" * 3001, "的一是不了" * 1700, "hello" * 1801 + "!" * 4000 + "x"])
def test_long_runs_without_a_space_equal_the_library(text, library):
    own = bpe.tokenizer(PATH, P.PATTERN)
    packed = own.encode(text)
    assert ids(packed) == library.encode_ordinary(text) and own.decode(packed).decode() == text


def test_memos_are_bounded_and_change_nothing(monkeypatch, library):
    monkeypatch.setattr(bpe, "MEMO_BYTES", 4000)
    own = bpe.Tokenizer(PATH, P.PATTERN)
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(60)) for _ in range(40)]
    for text in texts:
        assert ids(own.encode(text)) == library.encode_ordinary(text)
        assert len(own.memo) < 100


def test_one_operators_memos_go_when_another_begins():
    kept = bpe.tokenizer(PATH, P.PATTERN)
    assert bpe.tokenizer(PATH, P.PATTERN) is kept
    list(words.text_chunks(pa.RecordBatch.from_arrays([pa.array(["x"])], names=["text"]), "text"))
    assert bpe.tokenizer(PATH, P.PATTERN) is not kept


def test_span_hashes_go_on_from_block_to_block(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    cuts = np.sort(rng.choice(5001, 60, replace=False))
    starts, ends = cuts[:-1], cuts[1:]
    whole = words.span_hashes(data, starts, ends)
    for block in (7, 64, 999):
        monkeypatch.setattr(words, "HASH_BYTES", block)
        monkeypatch.setattr(words, "_POWERS", {})
        assert np.array_equal(words.span_hashes(data, starts, ends), whole)
