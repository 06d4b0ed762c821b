"""Removal of every byte that a repeated 200-byte string covers, by suffix arrays over shards.

1. Runs.  The smallest hash of a 64-byte gram inside a 200-byte window is the same wherever the window occurs.
   Neighbouring windows with the same smallest gram form a run, about one for 69 bytes; a run is sent as that hash,
   the anchor, and a digest of its bytes.  Windows whose anchor occurs in one run only occur once, unless the run
   repeats itself: then its anchor also begins before its last window, which is marked.
2. A run whose (anchor, digest) occurs again is repeated as a whole.  Only the other runs of anchors that
   several *different* runs share are looked at as text, with one holder of each digest: the edges of repeated passages.
3. Suffix arrays.  These texts are dealt into shards by anchor.  A shard is sorted by Larsson-Sadakane refinement
   (groups of equal prefixes are refined by the ranks of what follows them, twice as far a round), and Kasai's rule gives
   the common prefixes: only where the byte before differs are bytes compared, all others follow by one less.
   Neighbours that share 200 bytes are repeats.
4. Cross-shard merging.  An anchor with very many different runs is dealt into several shards.  Each of these sends its
   distinct windows as sorted 128-bit fingerprints, cut into slices by binary search; a slice's task searches every
   shard's list in the merged one.

So equal windows always meet, whatever the size of a group of copies, and no task holds more than a shard, a slice or one
text.  Fingerprints (128 bits) stand for equal bytes in steps 2 and 4.

Defined results: a null text counts as empty; texts under 200 bytes stay as they are; rows with equal doc_id and text
are two documents, so each is a copy of the other; a null doc_id is a document too; further columns are ignored; a
text's own overlapping repeats count; all occurrences go, the first included; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcraft.llm import words as W
from panelcraft.llm.store import Scratch

WINDOW = 200
GRAM = 64                     # bytes; a power of two
REACH = WINDOW - GRAM + 1     # grams in a window, and the most windows of a run
BLOCK = 1 << 19               # bytes of text that are hashed at once
PART_RUNS = 4096              # different runs of one anchor in one shard
SHARD_BYTES = 2 << 20
HELD_BYTES = 4 << 20          # of judged documents that are sent on at once
SLICE_WINDOWS = 1 << 20       # fingerprints that meet in one task
MAX_BROADCAST_ANCHORS = 50_000
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                              0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
HALF = np.uint64(32)
RUNS = "k1 long, k2 long, at long, n int, a long, d long, again boolean"
SEGMENT = "struct<at:long,a:long,single:boolean,part:int,parts:int,bytes:binary>"
JUDGED = ("doc_id long, k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text binary, "
          f"spans array<struct<lo:long,hi:long>>, segments array<{SEGMENT}>")
FOUND = ("k1 long, k2 long, lo long, hi long, slice int, f1 array<long>, f2 array<long>, o1 array<long>, o2 array<long>, "
         "at array<long>")


def packed(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position as one integer, first byte lowest."""
    x = data.astype(np.uint64)
    for step in (1, 2, 4):
        x = x[:-step] | (x[step:] << np.uint64(8 * step)) if len(x) > step else x[:0]
    return x


def _grams(eight: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from every position, by doubling."""
    x, step, i = eight, 8, 0
    while step < GRAM:
        if len(x) <= step:
            return x[:0]
        y = x[:-step] * ODD[i]
        y += x[step:] * ODD[i + 1]
        y ^= y >> HALF
        x, step, i = y, 2 * step, i + 2
    return x * ODD[6]


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    count = len(x) - width + 1
    if count <= 0:
        return x[:0]
    blocks = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks[:len(x)] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1:width - 1 + count])


def fingerprints(eight: np.ndarray, at: np.ndarray, odd: np.uint64, value: np.ndarray | None = None) -> np.ndarray:
    """A hash of the windows from ``at``, going on from ``value``."""
    value = np.full(len(at), odd) if value is None else value
    for k in range(0, WINDOW, 8):
        value = (value ^ eight[at + k]) * odd
        value ^= value >> HALF
    return value


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """row, first window, windows, anchor and digest of every run of some texts, and whether it may repeat itself."""
    eight = packed(data)
    grams = _grams(eight)
    smallest = _smallest(grams, REACH)
    if not len(smallest):
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    inside = np.zeros(len(data) + 1, dtype=np.int32)
    long = np.flatnonzero(np.diff(offsets) >= WINDOW)
    np.add.at(inside, offsets[long], 1)
    np.add.at(inside, offsets[long + 1] - WINDOW + 1, -1)
    inside = np.cumsum(inside[:len(smallest)]) > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (smallest[1:] != smallest[:-1])
    last = inside.copy()
    last[:-1] &= ~inside[1:] | (smallest[1:] != smallest[:-1])
    start, stop = np.flatnonzero(first), np.flatnonzero(last)
    pieces = (stop - start) // REACH + 1  # a period shorter than a gram makes long runs
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start, stop = np.repeat(start, pieces) + nth * REACH, np.repeat(stop, pieces)
    stop = np.minimum(stop, start + REACH - 1)
    digest = fingerprints(eight, stop, ODD[3], fingerprints(eight, start, ODD[3])) ^ ((stop - start).astype(np.uint64) * ODD[1])
    begun = np.concatenate([[0], np.cumsum(grams[:len(smallest)] == smallest)])
    row = np.searchsorted(offsets, start, side="right") - 1
    return row, start - offsets[row], stop - start + 1, smallest[start], digest, begun[stop] > begun[start]


def _blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """``runs``, a long text block by block; blocks share the bytes that the last windows of one reach into."""
    if len(offsets) > 2 or len(data) <= BLOCK + WINDOW:
        yield runs(data, offsets)
        return
    for at in range(0, len(data) - WINDOW + 1, BLOCK):
        part = data[at:at + BLOCK + WINDOW - 1]
        row, first, *rest = runs(part, np.array([0, len(part)]))
        yield (row, first + at, *rest)


def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in W.text_chunks(batch, "text", BLOCK):
            for row, first, n, anchor, digest, again in _blocks(data, offsets):
                if len(row):
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("k1").take(take), rows.column("k2").take(take), pa.array(first),
                         pa.array(n.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(again)],
                        names=["k1", "k2", "at", "n", "a", "d", "again"])


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint spans of what the spans cover; touching ones are one."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order]) if len(hi) else hi
    new = np.ones(len(lo), dtype=bool)
    new[1:] = lo[1:] > hi[:-1]
    return lo[new], hi[np.append(new[1:], True)] if len(hi) else hi


def _kept(text: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[int, int, str]:
    """n_removed, n_spans, SHA-256 of what stays."""
    digest, at, view = hashlib.sha256(), 0, memoryview(text)
    for x, y in zip(lo.tolist(), hi.tolist()):
        digest.update(view[at:x])
        at = y
    digest.update(view[at:])
    return int((hi - lo).sum()), len(lo), digest.hexdigest()


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents whose runs are all decided get their result; the others keep their text and send their segments."""
    schema = _judged_schema()
    for batch in batches:
        rows, held = [], 0
        columns = [batch.column(c) for c in ("doc_id", "k1", "k2", "text", "marks")]
        ids = [c.to_pylist() for c in columns[:3]]
        edges, marks = columns[4].offsets.to_numpy(), columns[4].values
        fields = {c: marks.field(c).to_numpy(zero_copy_only=False) for c in ("at", "n", "a", "copies", "rep", "part", "parts")}
        for r in range(batch.num_rows):
            text = columns[3][r].as_py() or b""
            out = {"doc_id": ids[0][r], "k1": ids[1][r], "k2": ids[2][r], "n_bytes": len(text)}
            own = slice(edges[r], edges[r + 1])
            at, n, whole = fields["at"][own], fields["n"][own], fields["copies"][own] > 1
            lo, hi = merged(at[whole], at[whole] + n[whole] + WINDOW - 1)
            if whole.all():  # a document without marks too
                out["n_removed"], out["n_spans"], out["kept_sha256"] = _kept(text, lo, hi)
            else:
                out |= {"text": text, "spans": [{"lo": x, "hi": y} for x, y in zip(lo.tolist(), hi.tolist())]}
            reps = np.flatnonzero(fields["rep"][own])
            if len(reps):
                out["segments"] = [{"at": int(at[i]), "a": int(a), "single": not whole[i], "part": int(p), "parts": int(m),
                                    "bytes": text[at[i]:at[i] + n[i] + WINDOW - 1]}
                                   for i, a, p, m in zip(reps.tolist(), *(fields[c][own][reps] for c in ("a", "part", "parts")))]
            rows.append(out)
            held += len(text)
            if held > HELD_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _judged_schema() -> pa.Schema:
    long = pa.int64()
    segment = pa.struct([("at", long), ("a", long), ("single", pa.bool_()), ("part", pa.int32()), ("parts", pa.int32()),
                         ("bytes", pa.binary())])
    return pa.schema([("doc_id", long), ("k1", long), ("k2", long), ("n_bytes", long), ("n_removed", long), ("n_spans", long),
                      ("kept_sha256", pa.string()), ("text", pa.binary()),
                      ("spans", pa.list_(pa.struct([("lo", long), ("hi", long)]))), ("segments", pa.list_(segment))])


def suffix_array(data: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Order of the suffixes of some strings laid end to end, each followed by one byte for its end; ``length`` is what
    is left of its string from each position.  An end sorts before every byte and differs from every other end."""
    n = len(data)
    big = np.zeros(n + 8, dtype=np.uint8)
    big[:n] = data
    value = packed(big)[:n].byteswap()
    left = np.minimum(length, 8)
    value &= ~np.uint64(0) << ((8 - np.maximum(left, 1)) * 8).astype(np.uint64)
    value[left == 0] = 0
    # ended ones first and by length: a stable sort by value then puts "ab" before "ab\0"
    order = np.argsort(left.astype(np.int16), kind="stable")
    order = order[np.argsort(value[order], kind="stable")]
    value = value[order]
    new = np.ones(n, dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (left[order[1:]] < 8) | (left[order[:-1]] < 8)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    slot = np.flatnonzero(~(new & np.append(new[1:], True)))
    reach = 8
    while len(slot):
        active = order[slot]
        key = rank[active] * (n + 1) + rank[active + reach]
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        order[slot] = active
        new = np.ones(len(slot), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        rank[active] = slot[np.maximum.accumulate(np.where(new, np.arange(len(slot)), 0))]
        slot = slot[~(new & np.append(new[1:], True))]
        reach *= 2
    return order


def common_prefixes(data: np.ndarray, length: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each suffix of ``order`` shares with the one before it, inside their strings."""
    n = len(data)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    big = np.zeros(n + 8, dtype=np.uint8)
    big[:n] = data
    eight = packed(big)[:n]
    # one less than at the position before, unless the bytes before differ or a string begins
    begins = np.ones(n, dtype=bool)
    begins[1:] = length[:-1] == 0
    fresh = begins | (before < 1)
    rest = np.flatnonzero(~fresh)
    fresh[rest] = begins[before[rest]] | (data[rest - 1] != data[before[rest] - 1])
    at = np.flatnonzero(fresh & (before >= 0))
    with_ = before[at]
    limit = np.minimum(length[at], length[with_])
    shared = np.zeros(len(at), dtype=np.int64)
    going = np.flatnonzero(limit > 0)
    while len(going):
        x = eight[at[going] + shared[going]] ^ eight[with_[going] + shared[going]]
        same = np.where(x == 0, 8, 0)
        for k in range(7, 0, -1):
            same = np.where((same == 0) & (x << np.uint64(64 - 8 * k) == 0), k, same)
        shared[going] += same
        going = going[(same == 8) & (shared[going] < limit[going])]
    shared = np.minimum(shared, limit)
    reach = np.full(n, -1, dtype=np.int64)
    reach[fresh] = np.flatnonzero(fresh)
    reach[at] = at + shared
    return (np.maximum.accumulate(reach) - np.arange(n))[order]


def _sort_shard(table: pa.Table, bits: int) -> pa.Table:
    """Spans of the repeated windows of a shard, and the distinct windows of the anchors that other shards hold too."""
    col = {c: table.column(c).to_numpy() for c in ("k1", "k2", "at", "part", "parts")}
    single = table.column("single").to_numpy()
    texts = table.column("bytes").to_pylist()
    data = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
    sizes = np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    begin = np.cumsum(sizes + 1) - sizes - 1
    length = (begin + sizes)[owner] - np.arange(len(data))
    order = suffix_array(data, length)
    shared = common_prefixes(data, length, order)
    with_last = shared >= WINDOW
    repeated = np.zeros(len(data), dtype=bool)
    repeated[order] = with_last | np.append(with_last[1:], False)

    window = repeated & single[owner]
    lo, hi = _spans(window, owner)
    who = owner[lo]
    base = col["at"][who] - begin[who]
    out = [_found(k1=col["k1"][who], k2=col["k2"][who], lo=lo + base, hi=hi + base + WINDOW)]

    hot = (col["parts"] > 1)[owner[order]] & (length[order] >= WINDOW) & ~with_last
    at = order[hot]  # the first of each class of equal windows
    if len(at):
        big = np.zeros(len(data) + 8, dtype=np.uint8)
        big[:len(data)] = data
        eight = packed(big)
        f1, f2 = fingerprints(eight, at, ODD[4]), fingerprints(eight, at, ODD[5])
        # only a window that stands alone in this shard, in a run that occurs once, still needs an answer
        asks = ~repeated[at] & single[owner[at]]
        by = np.lexsort((f2, f1))
        f1, f2, at, asks = f1[by], f2[by], at[by], asks[by]
        cuts = np.searchsorted(f1 >> np.uint64(64 - bits) if bits else np.zeros(len(f1), dtype=np.uint64),
                               np.arange((1 << bits) + 1, dtype=np.uint64))
        who = owner[at]
        ask_at = np.where(asks, at - begin[who] + col["at"][who], -1)
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            x, y = cuts[s], cuts[s + 1]
            out.append(_lists(s, f1[x:y].view(np.int64), f2[x:y].view(np.int64), col["k1"][who[x:y]], col["k2"][who[x:y]], ask_at[x:y]))
    return pa.concat_tables(out)


def _spans(window: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each stretch of marked windows of one owner."""
    first, last = window.copy(), window.copy()
    apart = owner[1:] != owner[:-1]
    first[1:] &= ~window[:-1] | apart
    last[:-1] &= ~window[1:] | apart
    return np.flatnonzero(first), np.flatnonzero(last)


def _found_schema() -> pa.Schema:
    long = pa.int64()
    return pa.schema([("k1", long), ("k2", long), ("lo", long), ("hi", long), ("slice", pa.int32()),
                      *((c, pa.list_(long)) for c in ("f1", "f2", "o1", "o2", "at"))])


def _found(**columns: np.ndarray) -> pa.Table:
    n = len(columns["k1"])
    return pa.table([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _found_schema()],
                    schema=_found_schema())


def _lists(s: int, *lists: np.ndarray) -> pa.Table:
    return pa.table([*(pa.nulls(1, pa.int64()) for _ in range(4)), pa.array([s], pa.int32()),
                     *(pa.ListArray.from_arrays([0, len(x)], pa.array(x, pa.int64())) for x in lists)], schema=_found_schema())


def _merge_slice(table: pa.Table) -> pa.Table:
    """Windows of one shard's list that stand in another shard's list too."""
    lists = [[x.values.to_numpy() for x in table.column(c)] for c in ("f1", "f2", "o1", "o2", "at")]
    f1, f2 = (np.concatenate(x).view(np.uint64) for x in lists[:2])
    by = np.lexsort((f2, f1))
    f1, f2 = f1[by], f2[by]
    new = np.ones(len(f1), dtype=bool)
    new[1:] = (f1[1:] != f1[:-1]) | (f2[1:] != f2[:-1])
    first = np.flatnonzero(new)
    holders = np.diff(np.append(first, len(f1)))
    f1, f2 = f1[first], f2[first]
    out = [_found(**{c: np.zeros(0, dtype=np.int64) for c in ("k1", "k2", "lo", "hi")})]
    for x1, x2, k1, k2, at in zip(*lists):
        asks = at >= 0
        x1, x2, k1, k2, at = x1.view(np.uint64)[asks], x2.view(np.uint64)[asks], k1[asks], k2[asks], at[asks]
        place = np.searchsorted(f1, x1)
        while (other := f2[place] != x2).any():  # equal first halves of different windows
            place[other] += 1
        more = holders[place] > 1
        out.append(_found(k1=k1[more], k2=k2[more], lo=at[more], hi=at[more] + WINDOW))
    return pa.concat_tables(out)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            spans = (r["spans"] or []) + (r["more"] or [])
            lo, hi = merged(*(np.array([x[c] for x in spans], dtype=np.int64) for c in ("lo", "hi")))
            rows.append((r["doc_id"], r["n_bytes"], *_kept(r["text"], lo, hi)))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string() if i == 4 else pa.int64()) for i, c in enumerate(zip(*rows))],
                                         names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _bounded(df: DataFrame) -> DataFrame:
    """Broadcast only a table whose size has been counted; beyond that Spark joins by a shuffle."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST_ANCHORS + 1).count() <= MAX_BROADCAST_ANCHORS else df


def remove_repeats(docs: DataFrame, part_runs: int = PART_RUNS, shard_bytes: int = SHARD_BYTES,
                   slice_windows: int = SLICE_WINDOWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    keyed = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64(F.lit(7), "text", "doc_id")})
    found = scratch.save(keyed.select("k1", "k2", "text").mapInArrow(_find_runs, RUNS), "runs")

    # 2: anchors of several runs, and among these the ones whose runs differ
    # written first: both sides of the join are then plain shuffles, and a hot anchor's runs can be split over tasks
    shared = (found.groupBy("a").agg(F.count("*").alias("k"), F.min("d").alias("d1"), F.max("d").alias("d2"),
                                      F.max("again").alias("again"))
              .where("k > 1 OR again").select("a", ((F.col("d1") != F.col("d2")) | F.col("again")).alias("mixed")))
    live = scratch.save(found.drop("again").join(scratch.save(shared, "shared"), "a"), "live")
    place = F.struct("k1", "k2", "at")
    kinds = scratch.save(live.where("mixed").groupBy("a", "d").agg(F.count("*").alias("copies"), F.min(place).alias("first")), "kinds")
    many = (kinds.groupBy("a").agg(F.count("*").alias("k")).where(F.col("k") > part_runs)
            .select("a", F.ceil(F.col("k") / part_runs).cast("int").alias("parts")))
    many = scratch.save(many, "many")
    kinds = kinds.join(_bounded(many), "a", "left").select(
        "a", "d", "copies", "first", F.coalesce("parts", F.lit(1)).alias("parts"))
    kinds = kinds.withColumn("part", F.pmod(F.xxhash64("d"), F.col("parts")).cast("int"))
    plain = live.where("NOT mixed").select("k1", "k2", "at", "n", "a", F.lit(2).cast("long").alias("copies"), F.lit(False).alias("rep"),
                                           F.lit(0).alias("part"), F.lit(1).alias("parts"))
    mixed = (live.where("mixed").join(kinds, ["a", "d"])
             .select("k1", "k2", "at", "n", "a", "copies", (place == F.col("first")).alias("rep"), "part", "parts"))
    marks = (plain.unionByName(mixed).groupBy("k1", "k2")
             .agg(F.collect_set(F.struct("at", "n", "a", "copies", "rep", "part", "parts")).alias("marks")))
    judged = scratch.save(keyed.withColumn("text", F.col("text").cast("binary")).join(marks, ["k1", "k2"], "left")
                          .mapInArrow(_judge, JUDGED), "judged")
    scratch.drop("runs", "shared", "live", "kinds", "many")

    # 3: suffix arrays over the shards
    segments = judged.select("k1", "k2", F.explode("segments").alias("s")).select("k1", "k2", "s.*")
    size, hot = segments.agg(F.sum(F.octet_length("bytes")), F.sum(F.when(F.col("parts") > 1, F.octet_length("bytes")))).first()
    shard = F.pmod(F.xxhash64("a", "part"), F.lit((size or 0) // shard_bytes + 1))
    bits = max(0, ((hot or 0) // slice_windows).bit_length())
    swept = scratch.save(segments.withColumn("shard", shard).groupBy("shard")
                         .applyInArrow(lambda table: _sort_shard(table, bits), FOUND), "swept")
    spans = swept.where("slice IS NULL").select("k1", "k2", "lo", "hi")
    if hot:  # 4
        lists = swept.where("slice IS NOT NULL")
        spans = spans.unionByName(lists.groupBy("slice").applyInArrow(_merge_slice, FOUND).select("k1", "k2", "lo", "hi"))

    more = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("more"))
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    done = judged.where("text IS NULL").select(*columns)
    left = judged.where("text IS NOT NULL").select("k1", "k2", "doc_id", "n_bytes", "text", "spans").join(more, ["k1", "k2"], "left")
    return done.unionByName(left.mapInArrow(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
places AS (
  SELECT row, unnest(range(len(h) // 2 - 199)) AS p, h FROM docs),
windows AS (
  SELECT row, p, md5_number(substr(h, 2 * p + 1, 400)) AS w FROM places),
found AS (
  SELECT row, p FROM windows WHERE w IN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1)),
marked AS (
  SELECT row, p, CASE WHEN p <= lag(p) OVER (PARTITION BY row ORDER BY p) + 200 THEN 0 ELSE 1 END AS new FROM found),
spans AS (
  SELECT row, min(p) AS lo, max(p) + 200 AS hi FROM (SELECT *, sum(new) OVER (PARTITION BY row ORDER BY p) AS span FROM marked)
  GROUP BY row, span),
gaps AS (
  SELECT row, coalesce(lag(hi) OVER (PARTITION BY row ORDER BY lo), 0) AS lo, lo AS hi FROM spans
  UNION ALL SELECT d.row, coalesce((SELECT max(hi) FROM spans s WHERE s.row = d.row), 0), len(h) // 2 FROM docs d),
kept AS (
  SELECT row, string_agg(substr(h, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo) AS h FROM gaps JOIN docs USING (row) GROUP BY row)
SELECT d.doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce((SELECT sum(hi - lo) FROM spans s WHERE s.row = d.row), 0)::BIGINT AS n_removed,
  (SELECT count(*) FROM spans s WHERE s.row = d.row)::BIGINT AS n_spans, sha256(unhex(k.h)) AS kept_sha256
FROM docs d JOIN kept k ON d.row = k.row
"""
