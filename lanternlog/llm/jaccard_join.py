"""N-gram Jaccard join with signature trees, and near-duplicate components.

Documents whose shingle sets may reach the threshold meet through set parts: two sets that differ in at most d shingles
agree on one of d + 1 parts (or more), so an equal part hash is a necessary condition for a link, and one that chance
rarely meets. What parts connect is a neighbourhood; its sets are dealt into blocks. In a block, a signature tree (nodes
with OR-combined bitmaps and size ranges) is traversed against itself, and node pairs whose largest possible overlap is
too small are left out; what remains is verified on the whole sets. Neighbourhoods of several blocks go on with links
between blocks until every pair of different components has been compared or left out by the tree.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, stars
from .shared import doc_batches, documents, lanes, read_table, released, text_bytes, written

BLOCK_BYTES = 4 << 20
#: Sets in one block of a neighbourhood, and the bytes of their shingles; the larger number of blocks holds.
BLOCK_SETS = 1024
BLOCK_SHINGLES = 4 << 20
#: The bytes of shingles that a task of several groups holds, about.
TASK_SHINGLES = 8 << 20
FANOUT = 16
BITS = 1024
#: Sizes of a band reach from its start to this many times it.
BAND = 1.5
#: Bands of one set are told apart by their number modulo this: no set has as many at 10 percent and above.
TAGS = 8
#: Bytes of text whose parts are met in one task, about.
TASK_TEXT = 4 << 20
#: Rows of three kinds: a text (its row key, set size and set hash), what a set needs in a band (tag, n parts), parts.
TEXT, NEED, PART = 0, 1, 2
SETS = pa.schema(
    [("task", pa.int64()), ("kind", pa.int8()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("set_hash", pa.int64())]
    + [("tag", pa.int64()), ("n", pa.int64()), ("part", pa.binary()), ("at", pa.binary()), ("own", pa.binary())]
)
SETS_DDL = (
    "task long, kind byte, doc_id long, text_hash long, set_hash long, tag long, n long, part binary, at binary, own binary"
)
U = np.uint64


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


class Limits:
    """What a threshold of percent / 100 asks of sizes and overlaps, in whole numbers."""

    def __init__(self, percent: int):
        if not 10 <= percent <= 100:
            raise ValueError("a threshold lies between 10 and 100 percent")
        self.percent = percent
        self.bands = [1]
        while self.bands[-1] < 1 << 40:
            self.bands.append(max(self.bands[-1] + 1, int(self.bands[-1] * BAND)))

    def linked(self, common: int, a: int, b: int) -> bool:
        return 100 * common >= self.percent * (a + b - common)

    def least_common(self, a, b):
        """The smallest overlap with which sets of these sizes link."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def band(self, n: int) -> int:
        """The band of a size: the last that starts at it or below."""
        import bisect

        return bisect.bisect_right(self.bands, n) - 1

    def differing(self, band: int) -> int:
        """How many shingles two linked sets can differ in, if the larger one lies in the band."""
        top = self.bands[band + 1] - 1
        # |A xor B| = |A| + |B| - 2 common, and common >= p (|A| + |B|) / (100 + p); both sizes are at most top.
        return (100 - self.percent) * 2 * top // (100 + self.percent)

    def differing_from(self, n: int, band: int) -> int:
        """How many shingles a set of size n and a linked one can differ in, if the larger one lies in the band."""
        largest = min(self.bands[band + 1] - 1, 100 * n // self.percent)
        return (100 - self.percent) * (n + largest) // (100 + self.percent)

    def bands_of(self, n: int) -> list[int]:
        """The bands in which the larger of a linked pair with a set of this size can lie."""
        first = self.band(n)
        return list(range(first, self.band(100 * n // self.percent) + 1))


@cache
def limits(percent: int) -> Limits:
    return Limits(percent)


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; a text of fewer words has its whole sequence as one."""
    import xxhash

    place: defaultdict = defaultdict()
    place.default_factory = place.__len__
    rows = []
    for text in texts:
        found = text.encode().lower().split()
        rows.append(np.fromiter(map(place.__getitem__, found), np.int64, len(found)))
    place.default_factory = None  # it refers to place itself, which would wait for the cyclic collector
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, place), np.uint64, len(place))
    out = []
    for row in rows:
        if not len(row):
            out.append(np.empty(0, np.uint64))
            continue
        h = hashes[row]
        width = min(words, len(h))
        code = np.full(len(h) - width + 1, width, np.uint64)
        for j in range(width):
            code = _scrambled(code * U(0x9E3779B97F4A7C15) + h[j : j + len(code)])
        out.append(np.unique(code))
    return out


def text_hash(text: Column) -> Column:
    """A text's 64-bit hash, which with the doc_id tells rows apart; a null text counts as an empty one."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _text_hashes(texts: list[str]) -> np.ndarray:
    """The same hashes as text_hash gives: Spark's seed is 42."""
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in texts), np.uint64, len(texts)).view(np.int64)


def _set_hash(shingles: np.ndarray) -> np.int64:
    return _scrambled(shingles.sum(keepdims=True) + U(len(shingles))).view(np.int64)[0]


def part_hashes(shingles: np.ndarray, percent: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The set's part hashes in each band where a partner could be, and for each band (its tag, the parts to be met).

    A band with d possible differences has d + 1 parts and some more; a shingle's hash says in which part it lies.
    Of two linked sets at least one part that holds anything is equal, if more than d parts hold anything. A set
    that has no more than d such parts gives one hash for empty parts too, which then is equal instead. As a differing
    shingle spoils one part, a set shares all its filled parts but as many as it can differ in with any partner. The
    lowest bits of a part hash are its band's tag.
    """
    lim = limits(percent)
    out, needs = [], []
    n = len(shingles)
    spread = _scrambled(shingles + U(0x632BE59BD9B4E019))
    for band in lim.bands_of(n):
        d = lim.differing(band)
        if d == 0:
            continue  # only equal sets could link, and those are one class already
        parts = d + 2 + d // 4  # a quarter more, so that more than d hold something even for a band's small sets
        own = (spread % U(parts)).astype(np.int64)
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, own, _scrambled(shingles ^ U(0xD6E8FEB86659FD93)))
        filled = np.flatnonzero(np.bincount(own, minlength=parts))
        mark = U((band << 40) & (2**64 - 1))
        code = _scrambled(sums[filled] + _scrambled(filled.astype(np.uint64) + mark))
        if len(filled) <= d:
            code = np.append(code, _scrambled(np.array([band], np.uint64) + U(0xA0761D6478BD642F)))
        tag = band % TAGS
        out.append(code & ~U(TAGS - 1) | U(tag))
        needs.append((tag, max(1, len(filled) - lim.differing_from(n, band))))
    return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64), needs


def bitmaps(sets: list[np.ndarray], bits: int = BITS) -> np.ndarray:
    out = np.zeros((len(sets), bits), bool)
    for i, s in enumerate(sets):
        out[i, (s >> U(20)).astype(np.int64) % bits] = True
    return np.packbits(out, axis=1).view(np.uint64)


class SignatureTree:
    """Sets in order of size under nodes of FANOUT; a node has the OR and the AND of its bitmaps and its size range."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        maps = bitmaps(sets)
        # Alike sets should be neighbours: by size, then by the smallest hash, which near copies mostly share.
        least = np.array([s[0] if len(s) else U(0) for s in sets], np.uint64)
        self.leaves = np.lexsort((sizes, least, np.floor(np.log2(np.maximum(sizes, 1)) * 4)))
        some = [maps[self.leaves]]
        both = [maps[self.leaves]]
        low, high = [sizes[self.leaves]], [sizes[self.leaves]]
        while len(low[-1]) > 1:
            cuts = np.arange(0, len(low[-1]), FANOUT)
            some.append(np.bitwise_or.reduceat(some[-1], cuts, axis=0))
            both.append(np.bitwise_and.reduceat(both[-1], cuts, axis=0))
            low.append(np.minimum.reduceat(low[-1], cuts))
            high.append(np.maximum.reduceat(high[-1], cuts))
        self.some, self.both, self.low, self.high = some, both, low, high
        self.height = len(low) - 1


def may_link(x: SignatureTree, i: np.ndarray, y: SignatureTree, j: np.ndarray, at: int, lim: Limits) -> np.ndarray:
    """Which of the node pairs (i of x, j of y) at a level could hold a link, by size range and largest overlap.

    A bit that all sets under a node have and none under the other stands for a shingle that they cannot share.
    """
    lost = np.bitwise_count(x.both[at][i] & ~y.some[at][j]).sum(axis=1, dtype=np.int64)
    gained = np.bitwise_count(y.both[at][j] & ~x.some[at][i]).sum(axis=1, dtype=np.int64)
    most = np.minimum(x.high[at][i] - lost, y.high[at][j] - gained)
    return most >= lim.least_common(x.low[at][i], y.low[at][j])


def joined(left: list, right: list | None, same: dict, percent: int) -> list[tuple[int, int]]:
    """Links between (key, set) entries of left and right (None: within left) that join different components.

    same: the component of each key so far, by any label. Both trees are traversed together from their roots, level
    by level; leaf pairs that may link are verified on the whole sets, unless a link found before joins them already.
    Only links that join two components are returned: they say as much about components as all links would.
    """
    lim = limits(percent)
    parent: dict = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    x = SignatureTree([s for _, s in left])
    y = x if right is None else SignatureTree([s for _, s in right])
    others = left if right is None else right
    # The flatter tree waits at its root until the other has come down to its height.
    levels = max(x.height, y.height)
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for at in range(levels, -1, -1):
        if at < levels:
            nodes = []
            for tree, node in ((x, i), (y, j)):
                if at < tree.height:
                    first = node * FANOUT
                    nodes.append((first, np.minimum(first + FANOUT, len(tree.low[at]))))
                else:
                    nodes.append((node, node + 1))
            (a, a_end), (b, b_end) = nodes
            wide, deep = a_end - a, b_end - b
            each = wide * deep
            pair = np.repeat(np.arange(len(i)), each)
            k = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
            i, j = a[pair] + k // deep[pair], b[pair] + k % deep[pair]
        if x is y:
            upper = i <= j if at else i < j
            i, j = i[upper], j[upper]
        keep = _may(x, i, y, j, at, lim)
        i, j = i[keep], j[keep]
        if not len(i):
            return []
    out = []
    if x is y and x.height == 0:
        return out
    for p, q in zip(x.leaves[i].tolist(), y.leaves[j].tolist(), strict=True):
        (key, mine), (other, theirs) = left[p], others[q]
        a, b = find(same.get(key, key)), find(same.get(other, other))
        if a == b:
            continue
        common = len(np.intersect1d(mine, theirs, assume_unique=True))
        if lim.linked(common, len(mine), len(theirs)):
            parent[max(a, b)] = min(a, b)
            out.append((key, other))
    return out


def _may(x: SignatureTree, i: np.ndarray, y: SignatureTree, j: np.ndarray, at: int, lim: Limits) -> np.ndarray:
    if x.height == y.height or at <= min(x.height, y.height):
        return np.concatenate(
            [may_link(x, i[k : k + 4096], y, j[k : k + 4096], at, lim) for k in range(0, len(i), 4096)]
        ) if len(i) else np.empty(0, bool)
    return np.ones(len(i), bool)


def _rows(length: int, schema: pa.Schema, /, **cols) -> pa.RecordBatch:
    """Rows with these columns, the others null."""
    every = [pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(length, f.type) for f in schema]
    return pa.RecordBatch.from_arrays(every, schema=schema)


def _part_rows(once: dict, percent: int, tasks: int):
    """For each task the parts of these sets (by hash) that it meets, in order of the sets that have them; and needs."""
    own = np.fromiter(once, np.int64, len(once))
    codes, needs = [], []
    for h, shingles in once.items():
        code, need = part_hashes(shingles, percent)
        codes.append(code)
        needs += [(h, *x) for x in need]
    if not needs:
        return
    h, tag, n = zip(*needs, strict=True)
    turns = np.arange(len(needs)) % tasks
    yield _rows(len(needs), SETS, task=turns, kind=np.full(len(needs), NEED, np.int8), set_hash=h, tag=tag, n=n)
    which = np.repeat(np.arange(len(codes), dtype=np.uint32), [len(x) for x in codes])
    code = np.concatenate(codes)
    task = (_scrambled(code.view(np.uint64)) % U(tasks)).astype(np.int64)
    order = np.argsort(task, kind="stable")
    code, which, task = code[order], which[order], task[order]
    starts = np.flatnonzero(np.diff(task, prepend=-1))
    rows = []
    for lo, hi in zip(starts, [*starts[1:], len(task)], strict=True):
        sets, at = np.unique(which[lo:hi], return_inverse=True)
        rows.append((int(task[lo]), code[lo:hi].tobytes(), at.astype(np.uint32).tobytes(), own[sets].tobytes()))
    for k in range(0, len(rows), 1024):
        task, part, at, of = zip(*rows[k : k + 1024], strict=True)
        yield _rows(len(task), SETS, task=task, kind=np.full(len(task), PART, np.int8), part=part, at=at, own=of)


def _set_rows(batches, words: int, percent: int, tasks: int):
    """A row for each text, and the parts of the texts' sets."""
    turn = 0
    for ids, texts in doc_batches(batches, BLOCK_BYTES):
        found = shingle_sets(texts, words)
        hashes = [int(_set_hash(s)) if len(s) else None for s in found]
        turns = np.arange(turn, turn + len(ids)) % tasks
        turn += len(ids)
        yield _rows(
            len(ids),
            SETS,
            task=turns,
            kind=np.full(len(ids), TEXT, np.int8),
            doc_id=ids,
            text_hash=_text_hashes(texts),
            set_hash=hashes,
            n=[len(s) for s in found],
        )
        # Equal sets of a block give their parts once, so that copies do not gather where their parts are met.
        yield from _part_rows({h: found[i] for i, h in enumerate(hashes) if h is not None}, percent, tasks)


def _held_rows(batches, percent: int, tasks: int):
    """The parts of sets whose shingles are at hand."""
    for batch in batches:
        once, held = {}, 0
        for h, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            once[h] = np.frombuffer(data.as_py(), np.uint64)
            held += len(once[h])
            if held >= KEYED_BLOCK:
                yield from _part_rows(once, percent, tasks)
                once, held = {}, 0
        yield from _part_rows(once, percent, tasks)


#: Rows of texts and needs as they are (a: the set's hash), and of PART: set a shares n parts of the band with others,
#: of which b is the one with the smallest hash, the same for all that have the part.
MET = pa.schema(
    [("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64())]
    + [("tag", pa.int64()), ("n", pa.int64())]
)
MET_DDL = "kind byte, a long, b long, doc_id long, text_hash long, tag long, n long"


def _met(table: pa.Table) -> pa.Table:
    """A task's rows of texts and needs, and who shares parts with whom: equal parts lie in one task."""
    import pyarrow.compute as pc

    packed = pc.equal(table["kind"], PART)
    others = table.filter(pc.invert(packed))
    codes, owns = [], []
    some = table.filter(packed)
    for code, at, own in zip(some["part"], some["at"], some["own"], strict=True):
        codes.append(np.frombuffer(code.as_py(), np.int64))
        owns.append(np.frombuffer(own.as_py(), np.int64)[np.frombuffer(at.as_py(), np.uint32)])
    code = np.concatenate(codes) if codes else np.empty(0, np.int64)
    own = np.concatenate(owns) if owns else np.empty(0, np.int64)
    del codes, owns
    order = np.lexsort((own, code))
    code, own = code[order], own[order]
    del order
    if len(code):
        new = np.append(True, (code[1:] != code[:-1]) | (own[1:] != own[:-1]))  # a set may come from several blocks
        code, own = code[new], own[new]
    starts = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.empty(0, np.int64)
    size = np.diff(np.append(starts, len(code)))
    several = np.repeat(size > 1, size)
    hub = np.repeat(own[starts], size)[several]
    own, tag = own[several], code[several] & (TAGS - 1)
    order = np.lexsort((tag, hub, own))
    own, hub, tag = own[order], hub[order], tag[order]
    new = np.append(True, (own[1:] != own[:-1]) | (hub[1:] != hub[:-1]) | (tag[1:] != tag[:-1]))[: len(own)]
    starts = np.flatnonzero(new)
    n = len(starts)
    shared = _rows(
        n,
        MET,
        kind=np.full(n, PART, np.int8),
        a=own[starts],
        b=hub[starts],
        tag=tag[starts],
        n=np.diff(np.append(starts, len(own))),
    )
    rows = pa.Table.from_arrays(
        [
            others["kind"],
            others["set_hash"],
            pa.nulls(len(others), pa.int64()),
            *(others[c] for c in ("doc_id", "text_hash", "tag", "n")),
        ],
        schema=MET,
    )
    return pa.concat_tables([rows, pa.Table.from_batches([shared])])


def _hopeful(met: DataFrame) -> DataFrame:
    """The sets that share as many parts with other sets, all together, as a link needs in one of their bands."""
    c = F.sum(F.when(F.col("kind") == PART, F.col("n")))
    need = F.max(F.when(F.col("kind") == NEED, F.col("n")))
    bands = met.where(F.col("kind") != TEXT).groupBy("a", "tag").agg(c.alias("c"), need.alias("need"))
    return bands.where("c >= need").select(F.col("a").alias("set_hash")).distinct()


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges(rows: list) -> pa.Table:
    """Links as stars around the smallest hash that they connect."""
    links = np.array(rows, np.int64).reshape(-1, 2)
    return pa.Table.from_arrays([pa.array(c) for c in stars(links[:, 0], links[:, 1])], schema=LINKS)


def _entries(table: pa.Table) -> list[tuple]:
    return [
        (key, np.frombuffer(data.as_py(), np.uint64))
        for key, data in zip(table["set_hash"].to_pylist(), table["shingles"].combine_chunks(), strict=True)
    ]


def near_duplicates(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_hash, root, component_id of every row; a link is 100 * intersection >= percent * union.

    root is the component's smallest set_hash. It tells components apart; component_id does not where ids are null or
    repeated. component_id is the smallest doc_id reachable by links, its own included; equal non-empty sets are linked. Null,
    empty and wordless texts have an empty set (set_hash null) and link with nothing: their component_id is their
    doc_id. Repeated rows: a row each, in one component. Rows without a doc_id are compared as all others, but never name
    a component. Empty table: no rows.
    Shingles and sets are told apart by 64-bit hashes. Whole texts count; there is no cap on partners or candidates.
    """
    base = documents(docs)
    tasks = lanes(text_bytes(base), TASK_TEXT)
    sets = base.mapInArrow(lambda b: _set_rows(b, words, percent, tasks), SETS_DDL)
    met = written(sets.groupBy("task").applyInArrow(_met, MET_DDL), "join-met")
    released()
    slim = written(
        met.where(F.col("kind") == TEXT).select(
            "doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("a").alias("set_hash")
        ),
        "join-texts",
    )
    # Equal sets are one class. Its text comes from its first row, one with a doc_id if there is any.
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first")
    classes = slim.where("n_shingles > 0").groupBy("set_hash").agg(first)
    classes = written(classes.select("set_hash", "first.doc_id", "first.text_hash"), "join-classes")
    hopeful = written(_hopeful(met), "join-hopeful")
    released(met)
    chosen = (F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_text"))
    candidates = written(classes.join(hopeful, "set_hash").select("set_hash", *chosen), "join-candidates")

    set_schema = pa.schema([("set_hash", pa.int64()), ("shingles", pa.binary())])

    def again(batches):
        seen = set()  # repeated rows of a document lie in one partition
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = shingle_sets([t.as_py() or "" for t in part.column(0)], words)
                rows = []
                for s, h in zip(found, part.column(1).to_pylist(), strict=True):
                    if len(s) and h not in seen and int(_set_hash(s)) == h:
                        seen.add(h)
                        rows.append((h, s.tobytes()))
                cols = list(zip(*rows, strict=True)) if rows else [[], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, set_schema.types, strict=True)], schema=set_schema
                )

    # Candidates grow with the documents, so they are dealt by row key at every size; texts need no sorting.
    # Copies without a doc_id have one key, so only one of them goes there.
    numbered, others = base.where("doc_id is not null"), base.where("doc_id is null").distinct()
    texts = numbered.union(others).withColumn("text_hash", text_hash(F.col("text")))
    same_row = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_text"))
    alone = written(
        texts.join(candidates.hint("shuffle_hash"), same_row)
        .select("text", "set_hash")
        .mapInArrow(again, "set_hash long, shingles binary"),
        "join-sets",
    )
    released(hopeful, candidates)
    held, star = _routed(alone, percent)
    of = written(held.groupBy("route").agg(_blocks(F.count(F.lit(1)), _size()).alias("blocks")), "join-members")
    block = F.pmod(F.xxhash64("set_hash"), "blocks")
    blocks = held.join(of, "route").select("set_hash", "route", "shingles", block.alias("block"))

    def inside(table: pa.Table) -> pa.Table:
        groups: dict = {}
        for r, b, entry in zip(table["route"].to_pylist(), table["block"].to_pylist(), _entries(table), strict=True):
            groups.setdefault((r, b), {})[entry[0]] = entry[1]
        return _edges([e for g in groups.values() for e in joined(list(g.items()), None, {}, percent)])

    held_bytes = held.agg(_size()).first()[0] or 0
    task = F.pmod(F.xxhash64("route", "block"), F.lit(lanes(held_bytes, TASK_SHINGLES)))
    links = written(
        blocks.withColumn("task", task).groupBy("task").applyInArrow(inside, "a long, b long"), "join-links"
    )
    several = of.where("blocks > 1")
    some = several.limit(1).count()
    released()
    if some:
        links = _across_blocks(held, held_bytes, several, star, links, percent)
    comp = written(components(links), "join-components")
    named = classes.select("set_hash", "doc_id").join(
        comp.select(F.col("node").alias("set_hash"), "component"), "set_hash", "left"
    )
    root = F.coalesce("component", "set_hash")
    least = written(named.groupBy(root.alias("root")).agg(F.min("doc_id").alias("component_id")), "join-names")
    names = written(
        named.select("set_hash", root.alias("root")).join(least, "root").select("set_hash", "root", "component_id"), "join-named"
    )
    return (
        slim.join(names, "set_hash", "left")
        .select(
            "doc_id",
            "text_hash",
            "n_shingles",
            "set_hash",
            "root",
            F.when(F.col("set_hash").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
    )


def _routed(alone: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Sets with their neighbourhood (route), and the links (a, b) of a set with the smallest that has the same part.

    Sets that could only link with sets that are no longer there go, as long as that takes many away.
    """
    count, size = alone.agg(F.count(F.lit(1)), _size()).first()
    while True:
        tasks = lanes(size or 0, TASK_SHINGLES // 2)
        sets = alone.mapInArrow(lambda b: _held_rows(b, percent, tasks), SETS_DDL)  # noqa: B023
        met = written(sets.groupBy("task").applyInArrow(_met, MET_DDL), "join-met")
        hopeful = written(_hopeful(met), "join-hopeful")
        before, count = count, hopeful.count()
        if not count or count > 0.8 * before:
            break
        released(met)
        fewer = written(alone.join(hopeful, "set_hash"), "join-sets")
        released(alone, hopeful)
        alone = fewer
        size = alone.agg(_size()).first()[0]
    star = written(met.where((F.col("kind") == PART) & (F.col("a") != F.col("b"))).select("a", "b").distinct(), "join-star")
    routes = components(star).select(F.col("node").alias("set_hash"), F.col("component").alias("route"))
    held = written(alone.join(hopeful, "set_hash").join(routes, "set_hash").select("set_hash", "route", "shingles"), "join-held")
    released(met, hopeful, alone)
    return held, star


def _size():
    """The bytes of shingles of a group's sets."""
    return F.sum(F.octet_length("shingles").cast("long"))


def _blocks(sets, size):
    """The number of blocks for so many sets of so many bytes."""
    return F.greatest(F.ceil(sets / BLOCK_SETS), F.ceil(size / BLOCK_SHINGLES)).cast("long")


def _labelled(held: DataFrame, several: DataFrame, links: DataFrame) -> DataFrame:
    """The sets of neighbourhoods of several blocks that still have several components, with those."""
    comp = components(links).select(F.col("node").alias("set_hash"), "component")
    mine = held.join(several.select("route"), "route").join(comp, "set_hash", "left")
    mine = mine.withColumn("component", F.coalesce("component", "set_hash"))
    names = written(mine.drop("shingles"), "join-labelled")
    open_ = names.groupBy("route").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y")
    still = names.join(open_.select("route"), "route").select("set_hash", "component")
    return written(held.join(still, "set_hash"), "join-open")


#: A set's shingles in one size band, by task: their keys, and for each the place of its set in sets (see _keyed).
KEYED = pa.schema([("task", pa.int64()), ("key", pa.binary()), ("at", pa.binary()), ("sets", pa.binary())])
KEYED_BLOCK = 1 << 19


def _keyed(batches, percent: int, tasks: int):
    """Shingles under their neighbourhood and size band, by task. sets has rows of (set_hash, band, component, size)."""
    lim = limits(percent)

    def given(keys: list, sets: list):
        key = np.concatenate(keys)
        at = np.repeat(np.arange(len(keys), dtype=np.uint32), [len(k) for k in keys])
        of = np.array(sets, np.int64)
        task = (key % U(tasks)).astype(np.int64)
        order = np.argsort(task, kind="stable")
        key, at, task = key[order], at[order], task[order]
        starts = np.flatnonzero(np.diff(task, prepend=-1))
        rows = []
        for lo, hi in zip(starts, [*starts[1:], len(task)], strict=True):
            own, place = np.unique(at[lo:hi], return_inverse=True)
            rows.append((int(task[lo]), key[lo:hi].tobytes(), place.astype(np.uint32).tobytes(), of[own].tobytes()))
        for k in range(0, len(rows), 1024):
            cols = zip(*rows[k : k + 1024], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, KEYED.types, strict=True)], schema=KEYED)

    keys, sets, held = [], [], 0
    for batch in batches:
        cols = [batch.column(k) for k in ("set_hash", "route", "component", "band", "shingles")]
        for h, route, component, band, data in zip(*cols, strict=True):
            shingles = np.frombuffer(data.as_py(), np.uint64)
            for one in lim.bands_of(len(shingles)) if band.as_py() is None else [band.as_py()]:
                tag = _scrambled(np.array([route.as_py()], np.int64).view(np.uint64) + U(one + 1))
                keys.append(_scrambled(shingles + tag))
                sets.append((h.as_py(), one, component.as_py(), len(shingles)))
                held += len(shingles)
                if held >= KEYED_BLOCK:
                    yield from given(keys, sets)
                    keys, sets, held = [], [], 0
    if keys:
        yield from given(keys, sets)


MATCHED = pa.schema([("set_hash", pa.int64()), ("band", pa.int64()), ("n", pa.int64()), ("c", pa.int64())])


def _meeting(table: pa.Table) -> tuple[np.ndarray, ...]:
    """A task's keys in order, the place of each one's set, all sets, how many have the key, and if of several components."""
    keys, owners, sets, first = [], [], [], 0
    for key, at, own in zip(table["key"], table["at"], table["sets"], strict=True):
        rows = np.frombuffer(own.as_py(), np.int64).reshape(-1, 4)
        keys.append(np.frombuffer(key.as_py(), np.uint64))
        owners.append(np.frombuffer(at.as_py(), np.uint32).astype(np.int64) + first)
        sets.append(rows)
        first += len(rows)
    key, owner, of = np.concatenate(keys), np.concatenate(owners), np.concatenate(sets)
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    component = of[owner, 2]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    several = np.minimum.reduceat(component, starts) != np.maximum.reduceat(component, starts)
    count = np.diff(np.append(starts, len(key)))
    return key, owner, of, np.repeat(count, count), np.repeat(several, count)


def _matched(table: pa.Table) -> pa.Table:
    """For each set and band, how many of the task's shingles a set of another component has too."""
    _, owner, of, _, several = _meeting(table)
    count = np.bincount(owner[several], minlength=len(of))
    some = count > 0
    cols = (of[some, 0], of[some, 1], of[some, 3], count[some])
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=MATCHED)


#: Shingles that sets of several components have, by the task of the set: their keys, how many sets have each, and for
#: each the place of its set in sets, which has rows of (set_hash, band, component, size).
COUNTED = pa.schema([("task", pa.int64()), *((c, pa.binary()) for c in ("key", "n", "at", "sets"))])


def _counted(table: pa.Table, tasks: int) -> pa.Table:
    """The task's shingles that sets of several components have, for the tasks where each set's shingles come together."""
    key, owner, of, count, several = _meeting(table)
    key, owner, count = key[several], owner[several], count[several].astype(np.uint32)
    task = (_scrambled(of[:, 0].view(np.uint64) + of[:, 1].astype(np.uint64)) % U(tasks)).astype(np.int64)[owner]
    order = np.argsort(task, kind="stable")
    key, owner, count, task = key[order], owner[order], count[order], task[order]
    starts = np.flatnonzero(np.diff(task, prepend=-1))
    rows = []
    for lo, hi in zip(starts, [*starts[1:], len(task)], strict=True):
        own, place = np.unique(owner[lo:hi], return_inverse=True)
        place = place.astype(np.uint32)
        rows.append((int(task[lo]), *(x.tobytes() for x in (key[lo:hi], count[lo:hi], place, of[own]))))
    cols = zip(*rows, strict=True) if rows else [[] for _ in COUNTED]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, COUNTED.types, strict=True)], schema=COUNTED)


PREFIX = pa.schema([("key", pa.int64()), ("set_hash", pa.int64()), ("band", pa.int64())])


def _prefixes(table: pa.Table, percent: int) -> pa.Table:
    """The rarest shingles of each set, as many as it can't do without all of them in a link.

    Shingles are ordered by the number of sets that have them, those that no other component has first. Two sets that
    link have percent / 100 of either in common, so the rarest common one is not among the last that either needs less one.
    """
    keys, counts, owners, sets, first = [], [], [], [], 0
    for key, n, at, own in zip(*(table[c] for c in ("key", "n", "at", "sets")), strict=True):
        rows = np.frombuffer(own.as_py(), np.int64).reshape(-1, 4)
        keys.append(np.frombuffer(key.as_py(), np.uint64))
        counts.append(np.frombuffer(n.as_py(), np.uint32))
        owners.append(np.frombuffer(at.as_py(), np.uint32).astype(np.int64) + first)
        sets.append(rows)
        first += len(rows)
    of, same = np.unique(np.concatenate(sets), axis=0, return_inverse=True)
    owner, key = same.reshape(-1)[np.concatenate(owners)], np.concatenate(keys)
    order = np.lexsort((key, np.concatenate(counts), owner))
    owner, key = owner[order], key[order]
    matched = np.bincount(owner, minlength=len(of))
    most = matched + 1 + -percent * of[:, 3] // 100
    take = np.arange(len(owner)) - (np.cumsum(matched) - matched)[owner] < most[owner]
    owner, key = owner[take], key[take]
    return pa.Table.from_arrays([pa.array(c) for c in (key.view(np.int64), of[owner, 0], of[owner, 1])], schema=PREFIX)


def _parted(rows: DataFrame, percent: int) -> DataFrame:
    """rows, one for each set and size band, in narrower neighbourhoods (route), without those that can't have a link.

    Sets of different components that link have one of their rarest shingles in common (see _prefixes), so what these
    connect is a neighbourhood. Passages that many sets have are among a set's rarest shingles only if it has little
    else; they no longer hold unrelated sets together. Cost grows with the shingles and not with the pairs.
    """
    size = rows.agg(_size()).first()[0] or 0
    tasks = lanes(size, TASK_SHINGLES // 2)
    keyed = rows.mapInArrow(lambda b: _keyed(b, percent, tasks), "task long, key binary, at binary, sets binary")
    counted = keyed.groupBy("task").applyInArrow(
        lambda t: _counted(t, tasks), "task long, key binary, n binary, at binary, sets binary"
    )
    prefixes = counted.groupBy("task").applyInArrow(
        lambda t: _prefixes(t, percent), "key long, set_hash long, band long"
    )
    node = F.xxhash64("set_hash", "band")
    prefixes = written(prefixes.select("key", node.alias("node")), "join-prefixes")
    hubs = prefixes.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1")
    edges = written(
        prefixes.join(hubs, "key").where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(),
        "join-edges",
    )
    routes = components(edges).select("node", F.col("component").alias("route"))
    out = rows.drop("route").withColumn("node", node).join(routes, "node").drop("node")
    out = written(out, "join-parted")
    released(prefixes, edges)
    return out


def _coverable(open_: DataFrame, percent: int) -> DataFrame:
    """The rows of open_, one for each size band (or those it names), whose set could still link with a set of another component.

    A link needs a common part of percent / 100 of either set at least, so a set of which a smaller part is found in
    all other components of its neighbourhood and band together has no link. Sets that only share passages go here, at
    a cost that grows with the shingles and not with the pairs. What goes may leave others uncovered, so it is repeated
    while it takes many away.
    """
    names = ("set_hash", "route", "component", "band", "shingles")
    by = ["set_hash", "band"] if "band" in open_.columns else ["set_hash"]
    now = (open_ if "band" in by else open_.withColumn("band", F.lit(None).cast("long"))).select(*names)
    count, size = now.agg(F.count(F.lit(1)), _size()).first()
    # A set lies in one or two bands.
    tasks = lanes(size or 0, TASK_SHINGLES // 2)
    while True:
        keyed = now.mapInArrow(lambda b: _keyed(b, percent, tasks), "task long, key binary, at binary, sets binary")
        matched = keyed.groupBy("task").applyInArrow(_matched, "set_hash long, band long, n long, c long")
        stays = matched.groupBy("set_hash", "band").agg(F.sum("c").alias("c"), F.max("n").alias("n"))
        stays = stays.where(F.col("c") * 100 >= F.col("n") * percent).select("set_hash", "band")
        stays = written(stays, "join-coverable")
        before, count = count, stays.count()
        now = written(open_.join(stays, by).select(*names), "join-covered")
        released()
        if not count or count > 0.8 * before:
            return now


#: Bytes of shingles that are dealt at once to be compared across blocks, about; or as many as all candidates have.
ROUND_SHINGLES = 256 << 20


def _rounds(amount: int, held: int) -> int:
    """How many rounds deal so many bytes, so that what lies on disk at once follows the sets and not their pairs."""
    return max(1, -(-amount // max(ROUND_SHINGLES, held)))


def _across_blocks(held, held_bytes: int, several, star, links, percent: int) -> DataFrame:
    """Links between blocks of one neighbourhood.

    Sets that the other components of their neighbourhood can't cover go first, and the others' neighbourhoods are made
    narrower (see _parted). Then the pairs that a part hash joins to the part's first set are verified, which takes one
    row a pair and mostly joins a large group of near copies. Then, in each neighbourhood and size band with several
    components left, sets outside its largest component are compared with all, block by block, by the trees. Where sets
    would be copied for more pairs than one round takes, the pairs are dealt to several rounds, one after another.
    """
    lim = limits(percent)
    group = ["route", "band"]
    open_ = _labelled(held, several, links)
    covered = _coverable(open_, percent)
    released(open_)
    first = _parted(covered, percent)
    released(covered)
    alone = written(first.select("set_hash", "shingles").dropDuplicates(["set_hash"]), "join-alone")
    sized = first.select("set_hash", *group, "component", (F.octet_length("shingles") / 8).cast("long").alias("n"))
    one = sized.select(F.col("set_hash").alias("a"), *group, F.col("component").alias("ca"), F.col("n").alias("na"))
    two = sized.select(F.col("set_hash").alias("b"), *group, F.col("component").alias("cb"), F.col("n").alias("nb"))
    near = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    apart = star.join(one, "a").join(two, ["b", *group]).where(near & (F.col("ca") != F.col("cb")))
    apart = written(apart.groupBy("a", "b").agg(F.max(F.col("na") + F.col("nb")).alias("n")), "join-apart")
    mine = alone.select(F.col("set_hash").alias("a"), F.col("shingles").alias("mine"))
    theirs = alone.select(F.col("set_hash").alias("b"), F.col("shingles").alias("theirs"))

    def verify(batches):
        for batch in batches:
            rows = []
            for a, b, mine, theirs in zip(*(batch.column(c) for c in range(4)), strict=True):
                x, y = (np.frombuffer(s.as_py(), np.uint64) for s in (mine, theirs))
                if lim.linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)):
                    rows.append((a.as_py(), b.as_py()))
            yield from _edges(rows).to_batches()

    rounds = _rounds(8 * (apart.agg(F.sum("n")).first()[0] or 0), held_bytes)
    for k in range(rounds):
        now = apart.where(F.pmod(F.xxhash64("a", "b"), F.lit(rounds)) == k)
        pairs = now.join(mine, "a").join(theirs, "b").select("a", "b", "mine", "theirs")
        links = links.union(written(pairs.mapInArrow(verify, "a long, b long"), "join-verified"))
        released()
    links = written(links, "join-links")
    comp = components(links).select(F.col("node").alias("set_hash"), "component")
    again = first.drop("component").join(comp, "set_hash", "left")
    again = written(again.withColumn("component", F.coalesce("component", "set_hash")), "join-labelled")
    ends = again.groupBy(*group).agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y")
    open_ = written(again.join(ends.select(*group), group), "join-open")
    released(first, alone, apart, again)
    covered = _coverable(open_, percent)
    released(open_)
    left_open = _parted(covered, percent)
    released(covered)
    sizes = left_open.groupBy(*group, "component").agg(F.count(F.lit(1)).alias("c"), _size().alias("size"))
    largest = sizes.groupBy(*group).agg(
        F.sum("c").alias("members"), F.sum("size").alias("size"), F.max(F.struct("c", "component", "size")).alias("top")
    )
    left_size = F.col("size") - F.col("top.size")
    largest = written(
        largest.select(
            *group,
            F.col("top.component").alias("top"),
            _blocks(F.col("members") - F.col("top.c"), left_size).alias("a_blocks"),
            _blocks(F.col("members"), F.col("size")).alias("b_blocks"),
            left_size.alias("a_size"),
            F.col("size").alias("b_size"),
        ).where("a_blocks > 0"),
        "join-largest",
    )
    a_blocks, b_blocks = F.col("a_blocks"), F.col("b_blocks")
    pairs_of_blocks, copied = largest.agg(
        F.sum(a_blocks * b_blocks), F.sum(F.col("a_size") * b_blocks + F.col("b_size") * a_blocks)
    ).first()
    rounds = _rounds(copied or 0, held_bytes)
    placed = left_open.join(largest, group)
    h = F.xxhash64("set_hash")
    cols = ["set_hash", *group, "shingles", "component"]
    of_round = lambda i, j: F.pmod(F.xxhash64(*group, i, j), F.lit(rounds))
    every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)

    def across(table: pa.Table) -> pa.Table:
        groups: dict = {}
        same = dict(zip(table["set_hash"].to_pylist(), table["component"].to_pylist(), strict=True))
        where = zip(*(table[c].to_pylist() for c in (*group, "i", "j", "left")), strict=True)
        for (r, band, i, j, side), entry in zip(where, _entries(table), strict=True):
            groups.setdefault((r, band, i, j), ({}, {}))[0 if side else 1][entry[0]] = entry[1]
        return _edges(
            [e for a, b in groups.values() if a and b for e in joined(list(a.items()), list(b.items()), same, percent)]
        )

    task = F.pmod(F.xxhash64(*group, "i", "j"), F.lit(lanes(pairs_of_blocks or 0, 2)))
    for k in range(rounds):
        left = placed.where("component != top").withColumn("i", F.pmod(h, a_blocks)).withColumn("left", F.lit(True))
        left = left.withColumn("j", F.explode(F.filter(every(b_blocks), lambda j: of_round(F.col("i"), j) == k)))  # noqa: B023
        right = placed.withColumn("j", F.pmod(h, b_blocks)).withColumn("left", F.lit(False))
        right = right.withColumn("i", F.explode(F.filter(every(a_blocks), lambda i: of_round(i, F.col("j")) == k)))  # noqa: B023
        both = left.select(*cols, "i", "j", "left").union(right.select(*cols, "i", "j", "left"))
        found = both.withColumn("task", task).groupBy("task").applyInArrow(across, "a long, b long")
        links = links.union(written(found, "join-found"))
        released()
    return written(links, "join-links")


def op7_jaccard_join(spark, sf_dir):
    return near_duplicates(read_table(spark, sf_dir, "documents"), 3, 90).select(
        "doc_id", "n_shingles", "component_id"
    )
