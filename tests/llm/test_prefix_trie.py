import hashlib
import random
import zlib
from collections import defaultdict

from panelcraft.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, n long, seq string"


def brute_sequences(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    return out


def brute_trie(sequences):
    members = defaultdict(list)
    for c, seq in sequences.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, who in members.items():
        worth = (len(who) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += worth
            leaves[node[:d]] += node not in kids
    rows = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(sequences[c]) == len(node))
        rows.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), kids.get(node, 0), leaves[node],
                     saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def made(seed=1):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-12, 70), 10**15, 4095, 4096, 9000]:
        common = rng.random() < 0.6
        for t in range(rng.choice([1, 2, 5, 12, 40])):
            text = "é system" if common and t < rng.randint(1, 30) else rng.choice(["yes", "no", "ü"])
            rows.append((c, t, "system" if t == 0 else "user", text, 1, "own"))
    rows += [(200 + c, t, "user", f"line {t}", None, None) for c in range(0, 60, 5) for t in range(25)]  # copies of one
    rows += [(300, None, None, None, 1, "x"), (300, 0, "a", "b", 1, "x"), (300, 0, "a", "b", 1, "x"), (300, 0, "a", "a", 1, "x"),
             (None, 1, "user", "lost", 1, "x"), (305, 2000, "u", "late", 1, "x"), (305, -1, "u", "early", 1, "x")]
    rng.shuffle(rows)
    return rows


def result(sequences, **limits):
    nodes = T.prefix_trie(sequences, **limits)
    assert nodes.columns == T.NODE
    return sorted(map(tuple, nodes.collect()), key=str)


def test_trie_equals_brute_force(spark):
    rows = made()
    sequences = T.branches(T.turn_sequences(spark.createDataFrame(rows, SCHEMA).repartition(4))).persist()
    want = brute_trie(brute_sequences(rows))
    assert result(sequences) == want
    # containers burst down to few sequences and turns: the same nodes
    assert result(sequences, max_sequences=5, max_turns=60) == want
    assert result(sequences, max_sequences=1, max_turns=10) == want


def test_no_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert T.prefix_trie(T.branches(T.turn_sequences(none))).count() == 0
    lost = spark.createDataFrame([(None, 1, "user", "x", 1, "y")], SCHEMA)
    assert T.prefix_trie(T.turn_sequences(lost)).count() == 0


def test_only_turnless_members(spark):
    # crc32('7') % 9 turns are taken from conversation 5, which is not there
    h = zlib.crc32(b"7") % 9
    rows = [(7, t, "user", "x", 1, "y") for t in range(h)] or [(7, 0, "user", "x", 1, "y")]
    got = result(T.branches(T.turn_sequences(spark.createDataFrame(rows, SCHEMA))))
    assert got == brute_trie(brute_sequences(rows))


def test_a_very_long_text_is_only_measured(spark):
    rows = [(c, 0, "user", "wörd " * 200_000, 1, "y") for c in (5, 10)]
    got = result(T.turn_sequences(spark.createDataFrame(rows, SCHEMA)))
    assert [r[6] for r in got] == [1_200_000, 1_200_000]
