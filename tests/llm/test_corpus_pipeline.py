"""The five stages one after the other equal a plain version of each, on documents that meet several of them."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import public_tokenizers as P
import tiktoken

import corpus_pipeline

from .test_duplicates import brute_components, brute_lines, brute_quality


def brute_kept(text):
    n_words, chars, symbols, _, covered = brute_quality(text)
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, later = set(), 0
    for line in text.split("\n"):
        later += len(re.sub(r"[\x20\x09-\x0D]", "", line)) * (line in seen)
        seen.add(line)
    if n_words < 50 or covered > 0.5 * n_words or symbols > 0.1 * n_words or later > 0.3 * chars:
        return False
    for n, top, dup in ((2, 0.2, None), (3, 0.18, None), (4, 0.16, None), (5, None, 0.5), (7, None, 0.48), (10, None, 0.45)):
        grams = [tuple(w[i:i + n]) for i in range(len(w) - n + 1)]
        count = Counter(grams)
        inside = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(n)}
        if top and max([c * len("".join(g)) for g, c in count.items() if c > 1], default=0) > top * chars:
            return False
        if dup and sum(len(w[i]) for i in inside) > dup * chars:
            return False
    return True


def brute_copies(docs):
    size = Counter()
    for _, source, text in docs:
        size[source] += len(text.split())
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size))}
    left, weights, target = sum(size.values()), sum(weight.values()), {}
    for s in sorted(size, key=lambda s: (3 * size[s] / weight[s], s)):  # a source stops at three times its size
        target[s] = min(3 * size[s], left / weights * weight[s])
        left, weights = left - target[s], weights - weight[s]
    out = {}
    for i, source, _ in docs:
        rate = target[source] / size[source]
        draw = int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:8], 16) / 2 ** 32
        out[i] = math.floor(rate) + (draw < rate - math.floor(rate))
    return out


def made():
    rng = random.Random(12)
    lines = lambda n: [" ".join(f"w{rng.randrange(9000)}" for _ in range(14)) for _ in range(n)]
    plain = [lines(6) for _ in range(14)]
    two = [" ".join(lines(4)), " ".join(lines(3))]
    long_line = " ".join(lines(8))
    rejected = lines(3)
    texts = plain + [
        plain[0],                                     # loses every line
        plain[1][:4] + lines(5),                      # loses four lines
        two, plain[2][:3] + two,                      # without its passage equal to the one before
        [long_line], [long_line + " tail of words"],  # near copies without a window
        rejected, rejected + lines(4),                # the first is too short and goes, so the second keeps its lines
        ["%%% " * 30 + long_line], ["again and again"] * 40, ["few words"]]
    return [(3 * i + 1, f"s{i % 4}", "\n".join(t)) for i, t in enumerate(texts)]


def test_run_equals_plain_stages(spark, tmp_path):
    rows = made()
    rest = [r for r in rows if brute_kept(r[2])]
    cleaned = brute_lines([(i, t) for i, _, t in rest])
    lined = [(i, s, cleaned[i][0]) for i, s, _ in rest if cleaned[i][1] > cleaned[i][2] or not cleaned[i][1]]
    first = {i for i, _, c in brute_components([(i, t) for i, _, t in lined]) if i == c}
    single = [r for r in lined if r[0] in first]
    copies = brute_copies(single)
    # every stage has something to do
    assert len(rows) > len(rest) > len(lined) > len(single) and set(copies.values()) - {1}
    assert any(cleaned[i][2] and cleaned[i][1] > cleaned[i][2] for i, _, _ in rest)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = [(i, len(ids := library.encode_ordinary(t)), ids, t) for i, _, t in single for _ in range(copies[i])]
    spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r["doc_id"], r["n_tokens"], list(r["ids"]), r["decoded"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
