"""Suffix-array deduplication: bytes covered by a long string that starts twice, found by deep-shallow suffix sorting.

Suffixes meet in one place by anchors: the smallest hash of the K-byte strings in a window of `length` bytes depends on
the window alone, so equal windows have equal anchors at equal offsets. The windows of one anchor are neighbours; they
make up a segment. Only segments whose anchor string occurs again are looked at further, and only those that are not
copies of each other as a whole have their suffixes sorted. Suffixes of a very frequent anchor are parted first by the
bytes on either side of it, further and further, as a radix sort would do, until a group is small enough for one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_names, lanes, read_table, released, written

LENGTH = 200
#: Bytes of an anchor string.
K = 32
#: Window starts that are hashed at a time; a longer text takes several rounds that overlap by a window.
ROUND = 1 << 19
#: Bytes up to which suffixes are sorted by multikey quicksort, eight bytes a key; beyond, blind tries order the rest.
SHALLOW = 32
#: Different segments that are sorted together; an anchor with more is split by the bytes beside it (see `split`).
GROUP_SEGMENTS = 2000
#: Bytes of segments that a sorting task holds, about.
TASK_BYTES = 2 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and its inverse powers modulo 2^64."""
    up = np.cumprod(np.append(np.uint64(1), np.full(n, BASE, np.uint64)))
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    return up, np.cumprod(np.append(np.uint64(1), np.full(n, inverse, np.uint64)))


_UP, _DOWN = _powers(ROUND + 4096)


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the `width` bytes at each place (an equal string has an equal hash anywhere)."""
    if len(data) < width:
        return np.empty(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[: len(data)], out=sums[1:])
    return _scrambled((sums[width:] - sums[:-width]) * _DOWN[: len(data) - width + 1])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` neighbours, by running minima from both sides of blocks of that size."""
    n = len(x)
    if width == 1:
        return x
    full = -(-n // width) * width
    padded = np.full(full, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def segments(data: bytes, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """(anchor hash, hash of the whole segment, first window, number of windows) of each segment of a text.

    A round's windows end where the next round's begin, so a segment may be cut there; it then counts as two.
    """
    every = np.frombuffer(data, np.uint8)
    out: list[list[np.ndarray]] = []
    place_bits = np.uint64(20)
    low = np.uint64((1 << 20) - 1)
    for at in range(0, max(0, len(every) - length + 1), ROUND):
        part = every[at : at + ROUND + length - 1]
        hashes = rolling(part, k)
        keyed = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        anchor = (sliding_min(keyed, length - k + 1) & low).astype(np.int64)
        first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        count = np.diff(np.append(first, len(anchor)))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _UP[: len(part)], out=sums[1:])
        end = first + count + length - 1
        whole = (sums[end] - sums[first]) * _DOWN[first]
        offset = (anchor[first] - first).astype(np.uint64)
        whole = _scrambled(whole + (offset << place_bits) + count.astype(np.uint64))
        out.append([hashes[anchor[first]].view(np.int64), whole.view(np.int64), first + at, count])
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number; beyond the end there are zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for j in range(8):
        out |= padded[j : j + len(data)] << np.uint64(56 - 8 * j)
    return out


def _split(group: np.ndarray, key: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Order by group, then key; number the groups of equal pairs; leave out those of one member."""
    order = np.lexsort((key, group))
    group, key = group[order], key[order]
    new = np.append(True, (group[1:] != group[:-1]) | (key[1:] != key[:-1])) if len(group) else np.empty(0, bool)
    number = np.cumsum(new) - 1
    several = np.bincount(number)[number] > 1 if len(number) else np.empty(0, bool)
    return number[several], *(m[order][several] for m in more)


def equal_suffixes(
    data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW
) -> tuple[np.ndarray, np.ndarray]:
    """Deep-shallow sorting of the suffixes at starts within each group, as far as `length` bytes.

    Returns the numbers of suffixes that share `length` bytes with another of their group, and for each the number of
    the suffix that stands for its class. Suffixes must have `length` bytes.

    Shallow: multikey quicksort takes eight bytes as one key and drops suffixes that are alone, up to `shallow`
    bytes. Deep: what is left forms groups with a long common prefix, each of which becomes a blind trie: its first
    suffix is a leaf, every other is compared with that leaf once, and hangs where it leaves it, by depth and first
    differing byte; those that leave at one place by one byte are a smaller trie with a longer common prefix.
    """
    word = _words_at(data)
    number = np.arange(len(starts))
    group, number = _split(group, np.zeros(len(group), np.int64), number)
    for depth in range(0, min(shallow, length - 8), 8):
        group, number = _split(group, word[starts[number] + depth], number)
    found, stands = [], []
    known = np.full(len(number), min(shallow, (length - 1) // 8 * 8), np.int64)  # bytes that a trie's members share
    while len(number):
        lead = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        leaf = number[np.repeat(lead, np.diff(np.append(lead, len(group))))]
        rest = np.ones(len(number), bool)
        rest[lead] = False
        one, other, at = number[rest], leaf[rest], known[rest]
        trie = group[rest]
        common = np.full(len(one), length, np.int64)
        open_ = np.flatnonzero(at < length)  # a trie may have branched at the last byte
        while len(open_):
            a, b = word[starts[one[open_]] + at[open_]], word[starts[other[open_]] + at[open_]]
            differ = a ^ b
            hit = differ != 0
            zeros = sum((differ[hit] < np.uint64(1 << 8 * j)).astype(np.int64) for j in range(1, 8))
            common[open_[hit]] = np.minimum(length, at[open_[hit]] + zeros)
            open_ = open_[~hit]
            at[open_] += 8
            open_ = open_[at[open_] < length]
        same = common >= length
        found.append(one[same])
        stands.append(other[same])
        one, common, trie = one[~same], common[~same], trie[~same]
        branch = common << 8 | data[starts[one] + common]
        group, number, known = _split(trie, branch, one, common + 1)
    found_ = np.concatenate(found) if found else np.empty(0, np.int64)
    stands_ = np.concatenate(stands) if stands else np.empty(0, np.int64)
    leaders = np.unique(stands_)
    return np.concatenate([found_, leaders]), np.concatenate([stands_, leaders])


def runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching intervals."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return starts[first], reach[np.append(first[1:] - 1, len(reach) - 1)]


def kept_bytes(data: bytes, starts, ends) -> bytes:
    out, at = [], 0
    for a, b in zip(starts, ends, strict=True):
        out.append(data[at:a])
        at = b
    out.append(data[at:])
    return b"".join(out)


ANCHORS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("text_hash", pa.int64()),
        ("anchor", pa.int64()),
        ("segment", pa.int64()),
        ("start", pa.int64()),
        ("n", pa.int64()),
    ]
)
ANCHORS_DDL = "doc_id long, text_hash long, anchor long, segment long, start long, n long"
PIECES = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])
PIECES_DDL = "doc_id long, text_hash long, start long, n long"
ROW_KEY = ["doc_id", "text_hash"]


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)


def _segment_rows(batches, length: int):
    for batch in batches:
        for doc_id, text_hash, text in zip(*(batch.column(c) for c in range(3)), strict=True):
            data = (text.as_py() or "").encode()
            anchor, whole, start, n = segments(data, length)
            if len(anchor):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([doc_id.as_py()] * len(anchor), pa.int64()),
                        pa.array(np.full(len(anchor), text_hash.as_py(), np.int64)),
                        *(pa.array(c.astype(np.int64)) for c in (anchor, whole, start, n)),
                    ],
                    schema=ANCHORS,
                )


def _together(batches, rows: int = 200_000):
    """Many small record batches as few larger ones."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _same_row(left: DataFrame, right: DataFrame):
    return (left["text_hash"] == right["text_hash"]) & left["doc_id"].eqNullSafe(right["doc_id"])


#: A segment, or a part of one, to be sorted under a key: the hash of the bytes from `left` before its anchor to `right`
#: behind it, which all of its windows hold.
CUTS = pa.schema(
    [("key", pa.binary()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int64())]
    + [("at", pa.int64()), ("left", pa.int64()), ("right", pa.int64()), ("single", pa.bool_()), ("bytes", pa.binary())]
)
CUTS_DDL = (
    "key binary, doc_id long, text_hash long, start long, at long, left long, right long, single boolean, bytes binary"
)


def split(left: int, right: int, length: int) -> list[tuple[int, int]]:
    """The two longer keys that part the windows of a key: each window holds one of them and not the other.

    A window has `length` - K bytes beside its anchor, so those that the key doesn't fix lie either by half and more
    behind it or by more than half before it.
    """
    spare = length - K - left - right
    return [(left, right + (spare + 1) // 2), (left + spare // 2 + 1, right)] if spare > 0 else []


def windows_with(at: int, left: int, right: int, size: int, length: int) -> tuple[int, int]:
    """First window and the one behind the last that hold a key, in `size` bytes with the anchor `at`."""
    return max(0, at - (length - K - right)), min(size - length, at - left) + 1


def _split_cuts(batches, length: int):
    """The parts of every segment under the longer keys that windows of it hold, and a hash of each part as a whole."""
    import xxhash

    schema = pa.schema([*CUTS, ("whole", pa.binary())])
    for batch in batches:
        rows, held = [], 0
        for row in batch.select(CUTS.names[1:]).to_pylist():
            data = row["bytes"]
            for left, right in split(row["left"], row["right"], length):
                at = row["at"]
                low, high = windows_with(at, left, right, len(data), length)
                if low >= high:
                    continue
                key = xxhash.xxh3_128_digest(b"%d %d " % (left, right) + data[at - left : at + K + right])
                part, at = data[low : high - 1 + length], at - low
                whole = xxhash.xxh3_128_digest(b"%d " % at + part)
                place = (row["doc_id"], row["text_hash"], row["start"] + low)
                rows.append((key, *place, at, left, right, row["single"], part, whole))
                held += len(part)
            if held > 4 << 20:
                yield _batch(rows, schema)
                rows, held = [], 0
        yield _batch(rows, schema)


def _sorted_windows(table: pa.Table, length: int) -> list[tuple]:
    """Rows (doc_id, text_hash, start, n) of windows that occur again, for the single segments of a task's keys."""
    ids, hashes = table["doc_id"].to_pylist(), table["text_hash"].to_numpy()
    first, at, single = (table[c].to_numpy(zero_copy_only=False) for c in ("start", "at", "single"))
    texts = [x.as_py() for x in table["bytes"].combine_chunks()]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = sizes - length + 1
    owner = np.repeat(np.arange(len(texts)), n)
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    starts = np.repeat(np.cumsum(sizes) - sizes, n) + within
    # Equal windows have the anchor at the same place, so that place and the key are the first key.
    number = np.array(table["key"].combine_chunks().dictionary_encode().indices, np.int64)
    group = number[owner] * (length + 1) + (at[owner] - within)
    found, _ = equal_suffixes(data, starts, group, length)
    found = found[single[owner[found]]]
    found = found[np.lexsort((within[found], owner[found]))]
    own, at = owner[found], within[found]
    new = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1))) if len(found) else []
    count = np.diff(np.append(new, len(found)))
    return [
        (ids[own[i]], int(hashes[own[i]]), int(first[own[i]] + at[i]), int(c)) for i, c in zip(new, count, strict=True)
    ]


def _sorted(cuts: DataFrame, length: int) -> DataFrame:
    """The rows of _sorted_windows, where equal keys meet in one task; the number of tasks follows the bytes."""
    size = cuts.agg(F.sum(F.octet_length("bytes").cast("long"))).first()[0] or 0
    task = F.pmod(F.xxhash64("key"), F.lit(lanes(size, TASK_BYTES)))
    return (
        cuts.groupBy(task.alias("task"))
        .applyInArrow(lambda t: pa.Table.from_batches([_batch(_sorted_windows(t, length), PIECES)]), PIECES_DDL)
    )


def _frequent(cuts: DataFrame, length: int) -> DataFrame:
    """Repeated windows (PIECES) of the segments of anchors that are too frequent for one task.

    Segments go on in parts, under longer keys. As at first, parts with an equal whole are repeated altogether and
    only one of them goes on; a key with one different part is done, up to GROUP_SEGMENTS are sorted, and more are
    split again. Each split halves the bytes that a key leaves open, and a key as long as a window leaves one part, so
    there are at most eight rounds for 200 bytes.
    """
    level = written(cuts.mapInArrow(lambda b: _split_cuts(b, length), CUTS_DDL + ", whole binary"), "suffix-level")
    found = []
    n = (F.octet_length("bytes") - length + 1).cast("long").alias("n")
    places = [c for c in CUTS.names if c != "key"]
    while True:
        kinds = level.groupBy("key", "whole").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(*places)).alias("one"))
        kinds = written(kinds, "suffix-kinds")
        copied = kinds.where("copies > 1").select("key", "whole")
        found.append(
            written(level.where("single").join(copied, ["key", "whole"]).select(*ROW_KEY, "start", n), "suffix-copies")
        )
        different = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("different")).where("different > 1")
        different = written(different, "suffix-different")
        # Alone, so that a frequent key can be split over tasks.
        open_ = kinds.join(different, "key").select("key", "copies", "one.*", "different")
        open_ = written(open_.withColumn("single", F.col("single") & (F.col("copies") == 1)), "suffix-open")
        released(level, kinds, different)
        many = F.col("different") > GROUP_SEGMENTS
        found.append(written(_sorted(open_.where(~many).select(CUTS.names), length), "suffix-sorted"))
        rest = open_.where(many).select(CUTS.names)
        if not rest.limit(1).count():
            released(open_)
            break
        level = written(rest.mapInArrow(lambda b: _split_cuts(b, length), CUTS_DDL + ", whole binary"), "suffix-level")
        released(open_)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def repeated_spans(docs: DataFrame, length: int = LENGTH, into: tuple[str, str] = ("span_starts", "span_ends")) -> DataFrame:
    """Adds to each row of docs the spans of its text that a string of `length` bytes covers which starts elsewhere too.

    Returns all columns of docs, untouched, with two more, named by `into` (array<long>, maximal runs, byte offsets in
    the UTF-8 text, empty where nothing repeats); a column of docs that has one of these names gives way to it. Strings
    are judged on the input; a text's own repeats count; matches never cross rows; repeated rows match each other. A
    null text is empty; an empty table gives an empty table.

    1. Every segment's anchor, content hash and place are written. 2. Anchors that occur once are dropped (a count,
    then a join that the optimiser may split by key). 3. Segments with an equal whole are repeated altogether. 4. Of
    the rest, each different segment is fetched once from its text, and its suffixes are sorted with those of the same
    anchor. An anchor with more than GROUP_SEGMENTS different segments is parted by the bytes beside it first. 5. The
    spans are joined to the texts. Only texts with unsorted segments pass twice. Nothing is collected.
    """
    names = [n for n in docs.columns if n.lower() not in {x.lower() for x in into}]
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_hash.alias("text_hash"), F.col("text").cast("string").alias("text")
    )
    anchors = written(
        keyed.mapInArrow(lambda b: _together(_segment_rows(b, length)), ANCHORS_DDL), "suffix-anchors"
    )
    again = written(
        anchors.groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("c"), F.min("segment").alias("least"), F.max("segment").alias("most"))
        .where("c > 1")
        .select("anchor", (F.col("least") != F.col("most")).alias("mixed")),
        "suffix-again",
    )
    shared = written(anchors.join(again, "anchor"), "suffix-shared")
    released(anchors, again)
    place = F.struct("doc_id", "text_hash", "start", "n")
    kinds = written(
        shared.where("mixed").groupBy("anchor", "segment").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("one")),
        "suffix-kinds",
    )
    # Both joins stand alone, so that a frequent anchor or segment can be split over tasks.
    different = written(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("different")), "suffix-different")
    copied = kinds.where("copies > 1").select("anchor", "segment")
    # 3. What is known without sorting: rows of segments with copies.
    of_copies = written(
        shared.where("mixed").join(copied, ["anchor", "segment"]).select(*ROW_KEY, "start", "n"), "suffix-copies"
    )
    known = shared.where("not mixed").select(*ROW_KEY, "start", "n").unionByName(of_copies)
    # 4. One of each kind to be fetched.
    fetch = written(
        kinds.join(different, "anchor").select(
            "one.*", "anchor", (F.col("copies") == 1).alias("single"), (F.col("different") > GROUP_SEGMENTS).alias("hot")
        ),
        "suffix-fetch",
    )
    released(kinds, different)
    wanted = written(
        known.select(
            "*",
            F.lit(None).cast("long").alias("anchor"),
            F.lit(False).alias("single"),
            F.lit(False).alias("hot"),
        )
        .unionByName(fetch)
        .distinct()
        .groupBy(*ROW_KEY)
        .agg(
            F.collect_list(F.when(F.col("anchor").isNull(), F.struct("start", "n"))).alias("known"),
            F.collect_list(
                F.when(F.col("anchor").isNotNull(), F.struct("start", "n", "anchor", "single", "hot"))
            ).alias("fetch"),
        ),
        "suffix-wanted",
    )
    released(shared, of_copies, fetch)
    fetching = wanted.where(F.size("fetch") > 0).select(*ROW_KEY, "fetch")
    texts = keyed.join(fetching, _same_row(keyed, fetching)).select(
        keyed["doc_id"], keyed["text_hash"], "text", "fetch"
    )
    cut_schema = pa.schema([*CUTS, ("hot", pa.bool_())])

    def cut_out(batches):
        for batch in batches:
            rows = []
            held = 0
            for doc_id, h, text, fetch in zip(*(batch.column(c) for c in range(4)), strict=True):
                data, row = text.as_py().encode(), (doc_id.as_py(), h.as_py())
                for f in fetch.as_py():
                    part = data[f["start"] : f["start"] + f["n"] + length - 1]
                    # The anchor is the one string of its hash in the segment's first window.
                    anchor = np.int64(f["anchor"])
                    at = int(np.flatnonzero(rolling(np.frombuffer(part[:length], np.uint8), K).view(np.int64) == anchor)[0])
                    rows.append((anchor.tobytes(), *row, f["start"], at, 0, 0, f["single"], part, f["hot"]))
                    held += len(part)
                    if held > 4 << 20:
                        yield _batch(rows, cut_schema)
                        rows, held = [], 0
            if rows:
                yield _batch(rows, cut_schema)

    # A repeated row would fetch its segment twice, which would then match itself.
    cuts = written(
        texts.mapInArrow(cut_out, CUTS_DDL + ", hot boolean").dropDuplicates(["doc_id", "text_hash", "start", "key"]),
        "suffix-cuts",
    )
    sorted_ = _sorted(cuts.where("not hot").drop("hot"), length)
    hot = cuts.where("hot").drop("hot")
    if hot.limit(1).count():
        sorted_ = sorted_.unionByName(_frequent(hot, length))
    found = sorted_.groupBy(*ROW_KEY).agg(F.collect_list(F.struct("start", "n")).alias("more"))
    ranges = wanted.select(*ROW_KEY, "known")
    spans = written(
        ranges.join(found, _same_row(ranges, found), "left")
        .select(ranges["doc_id"], ranges["text_hash"], F.concat("known", F.coalesce("more", F.array())).alias("r"))
        .select(*ROW_KEY, F.col("r.start").alias("starts"), F.col("r.n").alias("counts"))
        .mapInArrow(lambda b: _merged(b, length), "doc_id long, text_hash long, span_starts array<long>, span_ends array<long>"),
        "suffix-spans",
    )
    released(cuts, wanted)
    row_hash, row_id, of_hash, of_id, starts, ends = free_names(docs, "row_hash", "row_id", "of_hash", "of_id", "starts", "ends")
    plain = [F.col(f"`{n}`") for n in names]
    out = docs.select(*plain, text_hash.alias(row_hash), F.col("doc_id").cast("long").alias(row_id))
    spans = spans.toDF(of_id, of_hash, starts, ends)
    none = F.array().cast("array<long>")
    return out.join(spans, (F.col(row_hash) == F.col(of_hash)) & F.col(row_id).eqNullSafe(F.col(of_id)), "left").select(
        *plain, F.coalesce(starts, none).alias(into[0]), F.coalesce(ends, none).alias(into[1])
    )


def _merged(batches, length: int):
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("text_hash", pa.int64()),
            ("span_starts", pa.list_(pa.int64())),
            ("span_ends", pa.list_(pa.int64())),
        ]
    )
    for batch in batches:
        rows = []
        for doc_id, h, starts, counts in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            a = np.array(starts, np.int64)
            a, b = runs(a, a + np.array(counts, np.int64) + length - 1)
            rows.append((doc_id, h, a.tolist(), b.tolist()))
        yield _batch(rows, schema)


def whole_characters(data: bytes, starts: list[int], ends: list[int]) -> tuple[list[int], list[int]]:
    """The spans without the bytes of characters that they cut, so that what is kept is valid UTF-8."""
    out: list[tuple[int, int]] = []
    for a, b in zip(starts, ends, strict=True):
        while a < len(data) and data[a] & 0xC0 == 0x80:
            a += 1
        while b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return [a for a, _ in out], [b for _, b in out]


def kept_text(text: str | None, starts: list[int], ends: list[int]) -> str | None:
    if text is None or not starts:
        return text
    data = text.encode()
    return kept_bytes(data, *whole_characters(data, starts, ends)).decode()


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with its repeated spans cut out of text and n_chars set anew; other columns stay, null texts stay null.

    Characters that a span cuts are kept whole, so that the text stays valid. Columns of any other name are kept.
    """
    names = docs.columns
    spans = free_names(docs, "span_starts", "span_ends")
    spanned = repeated_spans(docs, length, spans)

    def run(batches):
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            texts = [
                kept_text(t.as_py(), a.as_py(), b.as_py())
                for t, a, b in zip(*(batch.column(at[c]) for c in ("text", *spans)), strict=True)
            ]
            cols = {n: batch.column(at[n]) for n in names}
            cols["text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=names)

    out = spanned.mapInArrow(run, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def op2_suffix_dedup(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_bytes", pa.int64()),
            ("n_removed", pa.int64()),
            ("n_spans", pa.int64()),
            ("kept_sha256", pa.string()),
        ]
    )

    def digest(batches):
        for batch in batches:
            rows = []
            for doc_id, text, starts, ends in zip(*(batch.column(c) for c in range(4)), strict=True):
                data, a, b = (text.as_py() or "").encode(), starts.as_py(), ends.as_py()
                kept = kept_bytes(data, a, b)
                rows.append((doc_id.as_py(), len(data), len(data) - len(kept), len(a), hashlib.sha256(kept).hexdigest()))
            yield _batch(rows, schema)

    return repeated_spans(docs).mapInArrow(
        digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
