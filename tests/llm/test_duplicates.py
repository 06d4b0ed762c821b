import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from panelcraft.llm import line_dedup, ngram_join, quality, words
from panelcraft.llm.components import components
from panelcraft.llm.store import Scratch

WORD = rb"[^\x20\x09-\x0D]+"


def shingle_set(text):
    w = re.findall(WORD, (text or "").translate({i: i + 32 for i in range(65, 91)}).encode())
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def made(seed=2):
    """Chains of edits, copies, and passages that many texts share."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(40)]
    rows = []
    for g in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(4, 90))]
        for _ in range(rng.randint(1, 7)):
            rows.append((len(rows) * 3 + 1, " ".join(base)))
            for _ in range(rng.randint(0, 3)):
                base[rng.randrange(len(base))] = rng.choice(vocab)
            if rng.random() < 0.3:
                base = base + [rng.choice(vocab) for _ in range(5)]
    for _ in range(25):
        rows.append((len(rows) * 3 + 1, " ".join(passage + [rng.choice(vocab) for _ in range(rng.randint(0, 25))]).upper()))
    rng.shuffle(rows)
    return rows


def test_components_of_links_equal_brute_force(spark):
    rows = made()
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(map(tuple, got.collect()), key=str) == brute_components(rows)


def test_repeated_ids_with_different_texts_lose_no_link(spark):
    rng = random.Random(12)
    vocab = [f"v{i}" for i in range(500)]

    def text(like=None):
        words = like.split() if like else rng.choices(vocab, k=60)
        if like:
            words[3] = "changed"
        return " ".join(words)

    a, b, c, far = text(), text(), text(), text()
    rows = [(1, a), (1, b), (2, text(a)), (3, text(b)), (4, c), (4, text(c)), (5, far), (5, "short one"), (5, far), (9, text(far)), (6, "")]
    want = {(1, a): 1, (1, b): 1, (2, text(a)): 1, (3, text(b)): 1, (4, c): 4, (4, text(c)): 4, (5, far): 5, (5, "short one"): 5,
            (9, text(far)): 5, (6, ""): 6}
    for order in (rows, rows[::-1], [rows[1], rows[0], *rows[2:]]):
        for parts in (1, 4):
            df = spark.createDataFrame(order, "doc_id long, text string").repartition(parts)
            got = [(r["doc_id"], r["component_id"]) for r in ngram_join.ngram_components(df).collect()]
            assert Counter(got) == Counter((i, want[i, t]) for i, t in order)
            kept = Counter(map(tuple, ngram_join.one_of_each(df).collect()))
            one_c = [r for r in kept if r[0] == 4]
            assert len(one_c) == 1 and kept == Counter([(1, a), (1, b), one_c[0], (5, far), (5, "short one"), (6, "")])


def test_join_on_edge_cases(docs, none, rows):
    got = sorted(map(tuple, ngram_join.ngram_components(docs).collect()), key=str)
    assert got == brute_components([(r[0], r[1]) for r in rows])
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    # 6 equals 5 but for case, 100 equals 14; the repeated rows 5 and 8 stay once; the row without an id stays
    assert Counter(ids) == Counter([None] + [i for i in range(15) if i != 6])
    assert ngram_join.ngram_components(none).count() == 0 and ngram_join.one_of_each(none).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (200, 150)], "a long, b long")
    got = dict(components(edges, Scratch(spark, "test-components"), "path").collect())
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 150: 100, 200: 100}


def test_shingles_equal_sets(rows):
    texts = [r[1] for r in rows] + [t for _, t in made(5)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    sizes, seen = [], {}
    for _, data, offsets in words.text_chunks(batch, "text", max_bytes=5000):
        tokens, own = words.shingles(data, offsets, 5)
        sizes += np.bincount(own, minlength=len(offsets) - 1).tolist()
    assert sizes == [len(shingle_set(t)) for t in texts]


def brute_lines(rows):
    lines = {i: (t or "").split("\n") for i, t in rows}
    full = {i: [k for k, x in enumerate(ls) if x.strip(" \t\n\v\f\r")] for i, ls in lines.items()}
    seen, gone = set(), {i: set() for i in lines}
    for i in sorted(lines):
        for p in range(len(full[i]) - 2):
            window = tuple(lines[i][k].strip(" \t\n\v\f\r") for k in full[i][p:p + 3])
            if window in seen:
                gone[i].update(full[i][p:p + 3])
            seen.add(window)
    return {i: ("\n".join(x for k, x in enumerate(lines[i]) if k not in gone[i]), len(full[i]), len(gone[i])) for i in lines}


def test_line_dedup(spark, docs, none, rows):
    rng = random.Random(4)
    made_rows = [(i * 7, "\n".join(rng.choice(["a", "b ", " c", "d", "", "e f"]) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    got = line_dedup.dedup_lines(spark.createDataFrame(made_rows, "doc_id long, text string").repartition(5))
    assert {r[0]: (r[1], r[2], r[3]) for r in got.collect()} == brute_lines(made_rows)
    cleaned = line_dedup.dedup_lines(docs)
    assert cleaned.columns == [*docs.columns, "n_lines", "n_removed"]
    out = cleaned.collect()
    assert len(out) == len(rows) and {r["k1"] for r in out} == {"own", None}
    assert {r["text"] for r in out if r["doc_id"] == 8} == {"same line"}
    assert line_dedup.dedup_lines(none).count() == 0


def brute_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    count = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if count[tuple(w[i:i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_measures(spark, docs, none, rows):
    got = sorted(((r[0], *r[1:6]) for r in quality.quality_rules(docs).collect()), key=str)
    assert got == sorted(((r[0], *brute_quality(r[1])) for r in rows), key=str)
    for r in quality.quality_rules(docs).collect():
        base = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == base and not (r["kept"] and base)
    assert quality.keep_good(docs).columns == docs.columns and quality.quality_rules(none).count() == 0
    rng = random.Random(1)
    clean = " ".join(f"w{rng.randrange(5000)}" for _ in range(300))
    texts = [(1, clean), (2, "\n".join([clean[:400]] * 4)), (3, clean.replace(" ", "%%% ")), (4, (clean[:60] + " ") * 30)]
    kept = quality.keep_good(spark.createDataFrame(texts, "doc_id long, text string"))
    assert [r["doc_id"] for r in kept.collect()] == [1]
    assert kept.agg(F.max("text")).first()[0] == clean


def test_collision_of_high_bits_is_sorted_out(monkeypatch):
    """Keys that agree in their high bits only are not taken for equal."""
    monkeypatch.setattr(words, "mix", lambda x: x)
    key = np.array([1, 2, 1, 3, 2, 1], dtype=np.uint64)
    place, size, later = quality.repeated(key, np.zeros(6, dtype=np.int64))
    assert sorted(zip(place.tolist(), size.tolist(), later.tolist())) == [
        (0, 3, False), (1, 2, False), (2, 3, True), (4, 2, True), (5, 3, True)]
