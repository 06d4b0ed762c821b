import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from panelcraft.llm import divergence as D

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, min_docs=30, top=50):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall((text or "").translate(LOWER))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, k in docs[lang].items() if k >= min_docs]
        whole = Counter()
        for g in groups:
            if g[0] == lang:
                whole.update({t: counts[g][t] for t in kept})

        def p(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (n + 5 * len(kept)) for t in kept}

        q, own = p(whole), {g[1]: p(counts[g]) for g in groups if g[0] == lang}
        for source in own:
            pairs = [(o, sum(abs(own[source][t] - own[o][t]) for t in kept)) for o in own if o != source]
            terms = [(t, own[source][t] - q[t]) for t in kept if counts[lang, source][t] and own[source][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, source, part, t, v, i + 1) for i, (t, v) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


def made(seed=4):
    rng = random.Random(seed)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}é" for i in range(90)] + ["Don't", "ÀB", "日本", "x1y", "TIE", "eit"]
    rows = []
    for i in range(700):
        lang = rng.choice(["en", "en", "en", "de", None, "rare"]) if i else "rare"
        source = rng.choice(["s0", "s0", "s1", "ß", None])
        some = vocab[:50] if source == "s0" else vocab[30:]
        rows.append((lang, source, " \n,".join(rng.choices(some, k=rng.randint(0, 25)))))
    rows += [("en", "empty", None), ("en", "dots", "... 12 __"), ("xx", "a", "only few"), ("xx", "b", ""), ("xx", None, None),
             ("en", "s0", "long " * 30_000), ("", "", "q")]
    return rows


def test_equals_brute_force(spark):
    rows = made()
    docs = spark.createDataFrame([(*r, "own", 1) for r in rows], "lang string, source string, text string, term string, n long").repartition(4)
    want = brute(rows)
    assert {r[2] for r in want} == {"pair", "term"}
    assert sorted(map(tuple, D.divergence(docs).collect())) == want
    assert sorted(map(tuple, D.divergence(docs, min_docs=5, top_terms=7, shard_terms=11).collect())) == brute(rows, 5, 7)


def test_partial_counts_of_many_chunks(monkeypatch):
    rows = [tuple(x or "" for x in r) for r in made()]
    batch = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=["lang", "source", "text"])

    def total():
        out = defaultdict(lambda: np.zeros(2, dtype=int))
        for part in D._partial_counts(iter([batch.slice(0, 300), batch.slice(300)])):
            for r in part.to_pylist():
                out[r["lang"], r["source"], r["term"]] += (r["n"], r["docs"])
        return {k: tuple(v) for k, v in out.items()}

    whole = total()
    monkeypatch.setattr(D, "CHUNK_BYTES", 300)
    monkeypatch.setattr(D, "HELD_ROWS", 40)
    assert total() == whole


def test_shares_beyond_64_bits():
    counts, n = np.array([[10**10, 0, 3]]), np.array([10**11])
    assert D._shares(counts, n, 3).tolist() == [[1 + 10**9 * (c + 5) // (10**11 + 15) for c in (10**10, 0, 3)]]


def test_edge_cases(docs, none, rows):
    got = sorted(map(tuple, D.divergence(docs, min_docs=1).collect()))
    assert got == brute([(r[2], r[3], r[1]) for r in rows], 1)
    assert D.divergence(none).count() == 0
