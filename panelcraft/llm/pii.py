"""Personal data: base patterns, and identifiers found from the contexts of those.

Base matches (email, ip, card, phone) are the seeds.  Every identifier-like token of a text (it holds a digit or an
@; neighbouring groups of capitals and digits are one token) is an instance; the words around it, each with the token's
shape, are its patterns.  On the graph of distinct
(pattern, instance) edges Spark scores patterns by the share of their instances that are known, and instances by their
patterns, for ``ROUNDS`` rounds; a pattern counts only with ``MIN_SEEDS`` known instances and ``MIN_PATTERN`` of its
instances known.  Instances that reach ``MIN_INSTANCE`` become spans wherever they stand outside the base spans.

The text is read once; what the graph needs of a document is written to the shared folder.  Frequent patterns are
summed before the shuffle.

Defined results: no length of a token, a word or a context is left out; words of digits only are tokens too; null and
empty texts have no spans; repeated rows are handled one by one; further columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcraft.llm.store import Scratch

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
MIN_SEEDS = 3
MIN_PATTERN = 0.8
MIN_INSTANCE = 0.75
# Each begins where the run of its characters begins, so a failed run is looked at once.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]++")
HINT = re.compile(r"[0-9@]")
#: A piece of an identifier that is written in groups: capitals and digits, no more than a group of an account number.
GROUP = re.compile(r"[A-Z]{0,4}[0-9][0-9A-Z]{0,7}")
EDGE = "()[]{}<>\"',;:!?."
LONG_WORD = 64  # longer words stand in patterns and in the graph as a hash of the whole word
CANDIDATE = "struct<instance: string, kind: string, start: int, stop: int, patterns: array<string>>"
BASE = ("row long, doc_id long, spans array<struct<kind: string, start: int, stop: int>>, "
        f"candidates array<{CANDIDATE}>")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost, non-overlapping matches of each kind that hold, by kind and start."""
    out = []
    if "@" in text:
        free = 0  # no local part begins before it
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                out.append(("email", start, m.end()))
                free = m.end()
            else:  # what stands before this @ is no local part of it, nor of a later one
                free = m.start()
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(DIGIT.findall(m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


def shape(token: str) -> str:
    """Runs of letters, digits and other characters."""
    kinds = ["9" if c.isdigit() else "a" if c.isalpha() else c for c in token]
    return "".join(c for i, c in enumerate(kinds) if i == 0 or c != kinds[i - 1])


def known_by(word: str) -> str:
    """A word as it stands in patterns and in the graph: long ones by a hash, so that a row of the graph stays small."""
    return word if len(word) <= LONG_WORD else "#" + hashlib.sha256(word.encode()).hexdigest()


def candidates(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    """Identifier-like tokens with their patterns; a base span is a candidate as a whole.

    A token is a word with a digit or an @, without the marks at its edges; neighbouring words that are groups of capitals
    and digits, one blank apart, are one token together (account numbers, numbers in blocks).  Words without a digit or @
    and words that overlap a base span are never candidates."""
    if "@" not in text and not DIGIT.search(text):
        return []
    words = [m.span() for m in WORD.finditer(text)]
    found = []  # start, stop, kind, first word, last word
    at = 0
    for kind, a, b in spans:
        found.append((a, b, kind, bisect.bisect_right(words, (a, len(text))) - 1, bisect.bisect_left(words, (b, 0)) - 1))
    taken = sorted((a, b) for _, a, b in spans)
    i = 0
    while i < len(words):
        first, (a, b) = i, words[i]
        i += 1
        if not HINT.search(text, a, b):
            continue
        last = first
        if GROUP.fullmatch(text, a, b):
            while i < len(words) and words[i][0] == b + 1 and text[b] == " " and GROUP.fullmatch(text, *words[i]):
                b, last, i = words[i][1], i, i + 1
        token = text[a:b]
        a += len(token) - len(token.lstrip(EDGE))
        b = a + len(token.strip(EDGE))
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if a < b and not (at < len(taken) and taken[at][0] < b):
            found.append((a, b, None, first, last))
    out = []
    word = lambda k: known_by(text[words[k][0]:words[k][1]].lower())
    for a, b, kind, first, last in found:
        own = known_by(shape(text[a:b]))
        patterns = []
        if first:
            patterns.append(f"< {word(first - 1)} {own}")
            if first > 1:
                patterns.append(f"<< {word(first - 2)} {word(first - 1)}")
        if last + 1 < len(words):
            patterns.append(f"> {word(last + 1)} {own}")
        out.append({"instance": known_by(text[a:b]), "kind": kind, "start": a, "stop": b, "patterns": patterns})
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 33
    types = {"spans": pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])),
             "candidates": pa.list_(pa.struct([("instance", pa.string()), ("kind", pa.string()), ("start", pa.int32()),
                                               ("stop", pa.int32()), ("patterns", pa.list_(pa.string()))]))}
    for batch in batches:
        spans, found = [], []
        for text in batch.column("text").to_pylist():
            own = base_spans(text or "")
            spans.append([{"kind": k, "start": a, "stop": b} for k, a, b in own])
            found.append(candidates(text or "", own))
        rows = pa.array(range(row, row + len(batch)), pa.int64())
        row += len(batch)
        yield pa.RecordBatch.from_arrays(
            [rows, batch.column("doc_id"), pa.array(spans, types["spans"]), pa.array(found, types["candidates"])],
            names=["row", "doc_id", "spans", "candidates"])


def grow(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """instance, kind: unknown instances that confident patterns reach.  edges: pattern, instance, kind (of a seed)."""
    known = (edges.where("kind IS NOT NULL").groupBy("instance").agg(F.min("kind").alias("known"))
             .withColumn("trust", F.lit(1.0)))
    pairs = scratch.save(edges.select("pattern", "instance").distinct(), "edges")
    seeds = known = scratch.save(known, "known-0")
    for i in range(1, ROUNDS + 1):
        held = pairs.join(known, "instance", "left")
        patterns = (held.groupBy("pattern").agg(F.count("*").alias("all"), *(
            F.sum(F.when(F.col("known") == k, F.col("trust")).otherwise(0.0)).alias(k) for k in KINDS)))
        best = F.greatest(*KINDS)
        kind = F.coalesce(*(F.when(F.col(k) == best, F.lit(k)) for k in KINDS))
        patterns = (patterns.where((best >= MIN_SEEDS) & (best >= MIN_PATTERN * F.col("all")))
                    .select("pattern", kind.alias("kind"), (best / F.col("all")).alias("score")))
        reached = (pairs.join(patterns, "pattern").groupBy("instance", "kind")
                   .agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("score") * 0.95))))).alias("trust"))
                   .groupBy("instance").agg(F.max_by("kind", "trust").alias("known"), F.max("trust").alias("trust"))
                   .where(F.col("trust") >= MIN_INSTANCE).join(seeds.select("instance"), "instance", "left_anti"))
        known = scratch.save(seeds.unionByName(reached), f"known-{i}")
    found = scratch.save(known.join(seeds.select("instance"), "instance", "left_anti")
                         .select("instance", F.col("known").alias("kind")), "found")
    scratch.drop("edges", *(f"known-{i}" for i in range(ROUNDS + 1)))
    return found


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    order = {k: i for i, k in enumerate(KINDS)}
    for batch in batches:
        out = {c: [] for c in (*KINDS, "base_sha256", "spans")}
        for spans, added in zip(batch.column("spans").to_pylist(), batch.column("added").to_pylist()):
            base = sorted(((s["kind"], s["start"], s["stop"]) for s in spans), key=lambda s: (order[s[0]], s[1]))
            every = sorted(base + [(s["kind"], s["start"], s["stop"]) for s in added or ()], key=lambda s: (order[s[0]], s[1]))
            for k in KINDS:
                out[k].append(sum(s[0] == k for s in base))
            written = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
            out["base_sha256"].append(hashlib.sha256(written.encode()).hexdigest())
            out["spans"].append(",".join(f"{k}:{a}:{b}" for k, a, b in every))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(out[k], pa.int64()) for k in KINDS),
             pa.array(out["base_sha256"], pa.string()), pa.array(out["spans"], pa.string())],
            names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, their digest, and all spans."""
    scratch = Scratch(docs.sparkSession, "personal-data")
    read = scratch.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_read, BASE), "read")
    each = read.select("row", F.explode("candidates").alias("c")).select("row", "c.*")
    new = grow(each.select(F.explode("patterns").alias("pattern"), "instance", "kind"), scratch)
    added = (each.where("kind IS NULL").drop("kind").join(new, "instance")
             .groupBy("row").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("added")))
    return (read.select("row", "doc_id", "spans").join(added, "row", "left").select("doc_id", "spans", "added")
            .mapInArrow(_finish, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
                                 "base_sha256 string, spans string"))
