import hashlib
import random
from collections import Counter

import numpy as np

from panelcraft.llm import suffix_dedup as S


def brute(rows):
    """Every row's result by a dictionary of all windows."""
    texts = [(t or "").encode() for _, t in rows]
    places = Counter(t[i:i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for (doc_id, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if places[t[i:i + 200]] > 1:
                gone[i:i + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in df.collect()), key=str)


def made(seed=3):
    rng = random.Random(seed)

    def text(n):
        return "".join(rng.choice("abcdefgh é") for _ in range(n))

    passage, edge = text(420), text(200)
    rows = [(i, text(rng.randint(0, 900))) for i in range(20)]
    rows += [(100 + i, text(rng.randint(0, 300)) + passage + text(rng.randint(0, 300))) for i in range(30)]
    rows += [(200 + i, text(i) + edge + text(50)) for i in range(8)]                       # exactly one window
    rows += [(300 + i, text(40) + edge[:199] + text(40)) for i in range(4)]                 # one byte too few
    base = text(1500)
    for i in range(25):                                                                     # near copies
        base = base[:(k := rng.randrange(len(base)))] + rng.choice("XYZ") + base[k + 1:]
        rows.append((400 + i, base))
    rows += [(500, "a" * 1000), (501, "ab" * 300), (502, text(250) * 3), (503, "\0" * 260), (504, "x" + "\0" * 230),
             (505, "q r s t " * 26), (506, text(70) + "unusual period of some length, " * 8 + text(70)), (507, text(9) + text(130) * 3)]
    rows += [(600, rows[0][1] * 2), (600, rows[0][1] * 2), (None, passage), (700, passage), (700, text(400))]
    return rows


def test_equals_brute_force(spark):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    assert result(S.remove_repeats(docs)) == want
    # anchors over many shards, tiny slices: the same result
    assert result(S.remove_repeats(docs, part_runs=3, shard_bytes=2000, slice_windows=500)) == want


def test_long_texts_block_by_block(spark, monkeypatch):
    rng = random.Random(5)
    long = bytes(rng.choices(b"abcdefghijkl \n", k=60_000)).decode()
    rows = [(1, long), (2, long[20_000:31_000]), (3, "q" * 9000 + long[-500:]), (4, None), (5, "")]
    got = {}
    for block in (1 << 19, 4096):
        for data, offsets in [(np.frombuffer(t.encode(), dtype=np.uint8), np.array([0, len(t)])) for _, t in rows[:3]]:
            monkeypatch.setattr(S, "BLOCK", block)
            starts = [(f + np.arange(n)) for _, first, count, *_ in S._blocks(data, offsets) for f, n in zip(first, count)]
            # every window is in exactly one run
            assert np.array_equal(np.sort(np.concatenate(starts)), np.arange(len(data) - 199))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = result(S.remove_repeats(docs))
    assert got == brute(rows)


def test_suffix_array_and_common_prefixes():
    rng = random.Random(7)
    for alphabet in (b"ab", b"\0a", b"abcdefg"):
        strings = [bytes(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(40)] + [b"", b"aaaaaaaaaaaaaaaaaaaaaaaaa", b"ab" * 20]
        data = np.frombuffer(b"\0".join(strings) + b"\0", dtype=np.uint8)
        sizes = np.array([len(s) for s in strings])
        owner = np.repeat(np.arange(len(strings)), sizes + 1)
        begin = np.cumsum(sizes + 1) - sizes - 1
        length = (begin + sizes)[owner] - np.arange(len(data))
        order = S.suffix_array(data, length)
        suffixes = [bytes(data[p:p + length[p]]) for p in order]
        assert suffixes == sorted(suffixes) and sorted(order) == list(range(len(data)))
        got = S.common_prefixes(data, length, order)
        for i in range(1, len(order)):
            a, b = suffixes[i - 1], suffixes[i]
            k = 0
            while k < min(len(a), len(b)) and a[k] == b[k]:
                k += 1
            assert got[i] == k


def test_edge_cases(docs, none, rows):
    assert result(S.remove_repeats(docs)) == brute([(r[0], r[1]) for r in rows])
    assert S.remove_repeats(none).count() == 0
