"""Byte-level BPE as a monoid: a text is encoded half by half, and halves are joined at their seam.

Two levels use the same idea.  *Pieces*: the pre-tokenisation of two neighbouring spans differs from that of
their concatenation only near the seam, because the pattern matches from left to right and looks ahead a few
characters; a window around the seam is split anew and grows until its piece ends meet those of the right
span.  *Tokens*: a token sequence is the encoding of its bytes exactly if every neighbouring pair is the
encoding of its own bytes (a merge across a seam would also happen in the pair alone); so it is enough to
encode a window around the seam anew and to grow it until its outermost tokens equal the old ones.
Decoding concatenates up the same kind of tree.

Every document is its own tree inside one task: no shuffle, and memory is bound by the largest text.
Defined results: null and empty texts encode to no ids; repeated rows are encoded one by one; further columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from panelcraft.llm import words as W

LEAF_CHARS = 2048   # a span of text that is split in one go
SHORT_BYTES = 32    # pieces up to this are merged many at once
LEAF_BYTES = 256    # a span of a piece that is merged in one go
SCAN_BYTES = 64     # a window whose best pair is looked for by a scan
LEAF_IDS = 8192     # ids that are decoded in one go
LOOKAHEAD = 3       # characters after a piece that can have had a say in its end
GROUP_ROWS = 1024     # texts whose ids are held at once
SPAN_CHARS = 1 << 21  # characters of a text whose pieces are held at once
MEMO_BYTES = 12 << 20  # of the pieces whose ids are kept, in each of two generations
ENTRY_BYTES = 200      # that a piece and its ids take beside their own bytes
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Unicode White_Space, as the tokenizer's pattern language has it.
WHITE = "\t-\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Letters below U+02C2; a text with no other characters beyond ASCII needs no Unicode tables.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-" + chr(0x2C1)
_NONE = 1 << 62


def _explicit_white(pattern: str) -> str:
    return pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")


class Splitter:
    """Pre-tokenisation of any span, and the join of two neighbouring spans' pieces."""

    def __init__(self, pattern: str):
        self.general = regex.compile(_explicit_white(pattern)).findall
        plain = pattern.replace(r"\p{L}\p{N}]", LETTERS + "0-9]")
        plain = plain.replace(r"\p{L}", f"[{LETTERS}]").replace(r"\p{N}", "[0-9]")
        self.plain = re.compile(_explicit_white(plain)).findall
        self.special = re.compile(f"[^\x00-\x7f{LETTERS}]").search

    def split(self, text: str) -> list[str]:
        find = self.general if self.special(text) else self.plain
        return self._tree(text, 0, len(text), find)

    def _tree(self, text: str, lo: int, hi: int, find) -> list[str]:
        if hi - lo <= LEAF_CHARS:
            return find(text[lo:hi])
        mid = (lo + hi) // 2
        return self.join(self._tree(text, lo, mid, find), self._tree(text, mid, hi, find), find)

    def join(self, left: list[str], right: list[str], find) -> list[str]:
        """Pieces of the concatenation; the window grows to the right until both splits share a piece end."""
        if not left or not right:
            return left or right
        popped, chars = [], 0
        while left and chars < LOOKAHEAD:
            popped.append(left.pop())
            chars += len(popped[-1])
        tail = "".join(reversed(popped))
        size = 4
        while True:
            head = right[:size]
            window = tail + "".join(head)
            ends, at = {len(tail): 0}, len(tail)
            for i, piece in enumerate(head, 1):
                at += len(piece)
                ends[at] = i
            sure = len(window) - (LOOKAHEAD if size < len(right) else 0)
            at = 0
            for i, piece in enumerate(pieces := find(window), 1):
                at += len(piece)
                if at > sure:
                    break
                if at in ends:  # from here on both splits are the same
                    left += pieces[:i]
                    left += right[ends[at]:]
                    return left
            size *= 2


class Vocabulary:
    """Ranks of byte strings, the encoder of one piece, and the decoder."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        pairs = [(self.ranks[t[:i]] << 32 | self.ranks[t[i:]], rank) for t, rank in self.ranks.items()
                 for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        pairs.sort()
        self.pair_keys, self.pair_ranks = np.array(pairs, dtype=np.int64).reshape(-1, 2).T.copy()
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)

    def merge_all(self, spans: list[bytes]) -> list[bytes]:
        """``merge`` of many short spans at once, packed: those of one length step together, a merge a round."""
        out: list[bytes] = [b""] * len(spans)
        lengths = np.array([len(x) for x in spans])
        for length in np.unique(lengths):
            place = np.flatnonzero(lengths == length)
            flat = np.frombuffer(b"".join([spans[i] for i in place]), dtype=np.uint8)
            ids = self.byte_ids[flat].reshape(len(place), length)
            rank = self._pair_ranks(ids[:, :-1], ids[:, 1:])
            while len(place):
                best = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(place), dtype=np.int64)
                low = rank[np.arange(len(place)), best] if rank.shape[1] else np.full(len(place), _NONE)
                done = low == _NONE
                packed, step = ids[done].astype("<u4").tobytes(), 4 * ids.shape[1]
                for at, i in enumerate(place[done].tolist()):
                    out[i] = packed[at * step:(at + 1) * step]
                go = ~done
                place, best, low, ids, rank = place[go], best[go], low[go], ids[go], rank[go]
                n, width = ids.shape
                if not n:
                    break
                row = np.arange(n)
                ids[row, best] = low
                ids = ids[np.arange(width) != best[:, None] + 1].reshape(n, width - 1)
                rank = rank[np.arange(width - 1) != best[:, None]].reshape(n, width - 2)
                left = np.flatnonzero(best > 0)
                rank[left, best[left] - 1] = self._pair_ranks(ids[left, best[left] - 1], ids[left, best[left]])
                right = np.flatnonzero(best < width - 2)
                rank[right, best[right]] = self._pair_ranks(ids[right, best[right]], ids[right, best[right] + 1])
        return out

    def merge(self, data: bytes) -> list[int]:
        """Lowest rank first, leftmost of equals; a heap of the pairs and linked neighbours keep long windows n log n."""
        get = self.ranks.get
        parts: list = [data[i:i + 1] for i in range(len(data))]
        if len(parts) > SCAN_BYTES:
            return self._merge_long(parts)
        pair = [get(a + b, _NONE) for a, b in zip(parts, parts[1:])]
        while pair:
            best = min(pair)
            if best == _NONE:
                break
            i = pair.index(best)
            parts[i] += parts.pop(i + 1)
            del pair[i]
            if i:
                pair[i - 1] = get(parts[i - 1] + parts[i], _NONE)
            if i < len(pair):
                pair[i] = get(parts[i] + parts[i + 1], _NONE)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, parts: list) -> list[int]:
        get, n = self.ranks.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [get(a + b, _NONE) for a, b in zip(parts, parts[1:])] + [_NONE]
        heap = [r * n + i for i, r in enumerate(pair) if r != _NONE]  # lowest rank, then leftmost
        heapq.heapify(heap)
        while heap:
            best, i = divmod(heapq.heappop(heap), n)
            if pair[i] != best:  # has changed since
                continue
            j = after[i]
            parts[i] += parts[j]
            parts[j], pair[j] = None, _NONE
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = pair[i] = get(parts[i] + parts[k], _NONE)
                if rank != _NONE:
                    heapq.heappush(heap, rank * n + i)
            else:
                pair[i] = _NONE
            if (h := before[i]) >= 0:
                rank = pair[h] = get(parts[h] + parts[i], _NONE)
                if rank != _NONE:
                    heapq.heappush(heap, rank * n + h)
        return [self.ranks[p] for p in parts if p is not None]

    def encode(self, data: bytes) -> list[int]:
        """Halves, joined at the seam.  The first is as long as a power of two, like many tokens of repeated characters:
        their seams settle at once."""
        if len(data) <= LEAF_BYTES:
            return self.merge(data)
        mid = 1 << ((len(data) - 1).bit_length() - 1)
        return self.join(self.encode(data[:mid]), self.encode(data[mid:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The window around the seam grows until its outermost tokens are those from before."""
        size = 1
        while True:
            a, b = left[-size:], right[:size]
            window = self.merge(b"".join(map(self.bytes_of.__getitem__, a + b)))
            steady = size >= len(left) or window[0] == a[0]
            if steady and (size >= len(right) or window[-1] == b[-1]):
                return left[:-size] + window + right[size:]
            size *= 2

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


class Tokenizer:
    """Pieces are encoded once for as long as the memo keeps them."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary = Vocabulary(path)
        self.splitter = Splitter(pattern)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def _learn(self, new: set[str]) -> None:
        ranks = self.vocabulary.ranks
        size = sum(map(len, new)) * 2 + ENTRY_BYTES * len(new)
        if self.held + size > MEMO_BYTES:
            self.older, self.memo, self.held = self.memo, {}, 0
        self.held += size
        short = []
        for piece in new:
            if (packed := self.older.get(piece)) is not None:
                self.memo[piece] = packed
                continue
            data = piece.encode()
            if data in ranks:  # a whole piece that is a token is that token
                self.memo[piece] = struct.pack("<I", ranks[data])
            elif len(data) <= SHORT_BYTES:
                short.append((piece, data))
            else:
                ids = self.vocabulary.encode(data)
                self.memo[piece] = struct.pack(f"<{len(ids)}I", *ids)
        self.memo.update(zip([p for p, _ in short], self.vocabulary.merge_all([d for _, d in short])))

    def _pack(self, group: list[list[str]]) -> list[bytes]:
        """The ids of each list of pieces; what the memo lacks is learnt for all of them at once."""
        found = [list(map(self.memo.get, pieces)) for pieces in group]
        gaps = [[i for i, packed in enumerate(row) if packed is None] for row in found]
        self._learn({pieces[i] for pieces, gap in zip(group, gaps) for i in gap})
        for row, pieces, gap in zip(found, group, gaps):
            for i in gap:
                row[i] = self.memo[pieces[i]]
        return [b"".join(row) for row in found]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        group: list[list[str]] = []

        def flush() -> None:
            out.extend(self._pack(group))
            group.clear()

        held = 0
        for text in texts:
            if len(text) > SPAN_CHARS:
                flush()
                out.append(self._encode_long(text))
                continue
            if (held := held + len(text)) > SPAN_CHARS:
                flush()
                held = len(text)
            group.append(self.splitter.split(text))
        flush()
        return out

    def _encode_long(self, text: str) -> bytes:
        """Span after span; the pieces before the open seam are final and leave as ids."""
        find = self.splitter.general
        packed, open_pieces = [], []
        for at in range(0, len(text), SPAN_CHARS):
            pieces = self.splitter.join(open_pieces, self.splitter.split(text[at:at + SPAN_CHARS]), find)
            keep, chars = len(pieces), 0
            while keep and chars < LOOKAHEAD:
                keep -= 1
                chars += len(pieces[keep])
            packed += self._pack([pieces[:keep]])
            open_pieces = pieces[keep:]
        return b"".join(packed + self._pack([open_pieces]))

    def decode(self, packed: bytes) -> bytes:
        return self.vocabulary.decode(np.frombuffer(packed, dtype="<u4").tolist())


def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One per Python worker: its memos serve all tasks of this operator in the worker."""
    return W.keep(("bpe", path, pattern), lambda: Tokenizer(path, pattern))


def with_ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (array of int), decoded (the text that the ids give) of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, pattern)
        for whole in batches:
            for at in range(0, len(whole), GROUP_ROWS):
                batch = whole.slice(at, GROUP_ROWS)
                packed = own.encode_many([t or "" for t in batch.column("text").to_pylist()])
                n = np.array([len(p) // 4 for p in packed], dtype=np.int64)
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), dtype="<i4")))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n), ids, pa.array([own.decode(p).decode() for p in packed], pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded"])

    return (docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
            .mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded string"))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode every whole text, decode the ids again, and return digests of both."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, pattern)
        for batch in batches:
            rows = []
            for at in range(0, len(batch), GROUP_ROWS):  # the ids of a few texts at a time
                texts = [t or "" for t in batch.column("text").slice(at, GROUP_ROWS).to_pylist()]
                for packed in own.encode_many(texts):
                    rows.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(),
                                 hashlib.sha256(own.decode(packed)).hexdigest()))
            n, ids, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()),
                 pa.array(decoded, pa.string())], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
