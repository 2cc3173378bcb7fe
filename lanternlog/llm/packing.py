"""Best-fit packing by a grouping genetic algorithm, on islands that pass on their elites."""

from __future__ import annotations

import random
import re
import zlib
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import LETTERS, chunk_starts, common_mark, spaced
from .shared import byte_blocks, documents, read_table, shuffle_partitions, tokenizer_path, written

VOCABULARY = "byte_bpe_50k.json"
END = 2
CAPACITY = 1024
BLOCK_BYTES = 4 << 20
#: A worker holds the ids of as many chunks besides those of one block; the library encodes so many words in one call.
TABLE_ENTRIES = 600_000
CALL_WORDS = 100
#: About as many pieces share one group of islands; groups are drawn by hash, so they look alike.
GROUP_PIECES = 4096
ISLANDS = 4
#: The most islands in a task, on average.
TASK_ISLANDS = 1000
EPOCHS = 2
POPULATION = 4
GENERATIONS = 4
PIECES = pa.schema(
    [
        ("uid", pa.int64()),
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
    ]
)
PIECES_DDL = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
ONE_WORD = re.compile(f" ?[{LETTERS}]+").fullmatch
_loaded: dict = {}


class WordIds:
    """The ids of each chunk of text, which the library encodes once for each of its pre-tokens.

    A table of all ids, and for each chunk its slot: where its ids start there, how many they are, and in how many
    blocks it was. Slot 0 is the end of a document, the next ones are the special strings.
    """

    def __init__(self, path: str, end: int):
        import os

        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.alone = Tokenizer.from_file(path)
        added = self.alone.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        parts = sorted(self.special, key=len, reverse=True)
        self.find = re.compile(b"|".join(re.escape(p.encode()) for p in parts)) if parts else None
        self.mark = common_mark(parts)
        whole = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.alone.pre_tokenizer = whole
        # Words joined by line feeds, which is faster than a call's many words each by itself.
        self.joined = Tokenizer(self.alone.model)
        if self.alone.normalizer is not None:
            self.joined.normalizer = self.alone.normalizer
        self.joined.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "removed"), whole])
        self.end = end
        self.clear()

    def clear(self) -> None:
        self.slots: dict[str, int] = {s: k for k, s in enumerate(self.special, 1)}
        self.used = self.held = 0
        self.starts, self.lens, self.seen = (np.zeros(1024, t) for t in (np.int64, np.int32, np.int32))
        self.ids = np.zeros(4096, "<u4")
        first = [self.end, *self.special.values()]
        self.append(np.array(first, "<u4"), np.ones(len(first), np.int32))

    def append(self, ids: np.ndarray, lens: np.ndarray) -> None:
        """Slots for as many chunks as lens has, with their ids one after another."""
        used, held = self.used + len(lens), self.held + len(ids)
        if used > len(self.lens):
            self.starts, self.lens, self.seen = (np.resize(x, 2 * used) for x in (self.starts, self.lens, self.seen))
        if held > len(self.ids):
            self.ids = np.resize(self.ids, 2 * held)
        self.lens[self.used : used] = lens
        self.seen[self.used : used] = 0
        self.starts[self.used : used] = self.held + np.cumsum(lens, dtype=np.int64) - lens
        self.ids[self.held : held] = ids
        self.used, self.held = used, held

    def gathered(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these slots one after another, and where those of each end."""
        lens = self.lens[slots]
        ends = np.cumsum(lens, dtype=np.int64)
        if not len(ends):
            return np.zeros(0, "<u4"), ends
        at = np.repeat(self.starts[slots] - ends + lens, lens)
        at += np.arange(len(at))
        return self.ids[at], ends

    def add_words(self, words: list[str]) -> None:
        """Slots for new pre-tokens, by the library."""
        split = [w for w in words if "\n" in w]
        if split:
            found = [e.ids for e in self.alone.encode_batch_fast(split, add_special_tokens=False)]
            self.slots.update(zip(split, range(self.used, self.used + len(split)), strict=True))
            self.append(np.array([i for f in found for i in f], "<u4"), np.array(list(map(len, found)), np.int32))
            words = [w for w in words if "\n" not in w]
        for at in range(0, len(words), CALL_WORDS):
            some = words[at : at + CALL_WORDS]
            e = self.joined.encode("\n".join(some), add_special_tokens=False)
            self.slots.update(zip(some, range(self.used, self.used + len(some)), strict=True))
            self.append(np.array(e.ids, "<u4"), np.bincount(np.array(e.word_ids, np.int64), minlength=len(some)))

    def add_chunks(self, chunks: list[str]) -> None:
        """Slots for new chunks: those of their pre-tokens, or one for several together."""
        single = [c for c in chunks if ONE_WORD(c)]
        self.add_words(single)
        several = []
        if len(single) < len(chunks):
            parts = [(c, spaced(c)) for c in chunks if c not in self.slots]
            self.add_words([w for w in dict.fromkeys(w for _, p in parts for w in p) if w not in self.slots])
            several = [(c, p) for c, p in parts if len(p) > 1]
        if several:
            ids, ends = self.gathered(np.array([self.slots[w] for _, p in several for w in p]))
            ends = ends[np.cumsum([len(p) for _, p in several]) - 1]
            self.slots.update(zip([c for c, _ in several], range(self.used, self.used + len(several)), strict=True))
            self.append(ids, np.diff(ends, prepend=0))

    def shrink(self) -> None:
        """Start the table anew with the chunks of the most blocks, of two at least; at most half as many as it may hold."""
        seen, least = self.seen[: self.used], 2
        while np.count_nonzero(seen >= least) > TABLE_ENTRIES // 2:
            least += 1
        slots = np.fromiter(self.slots.values(), np.int64, len(self.slots))
        kept = (seen[slots] >= least) & (slots > len(self.special))
        names, slots = list(compress(self.slots, kept.tolist())), slots[kept]
        ids, lens, seen = self.gathered(slots)[0], self.lens[slots], seen[slots]
        self.clear()
        first = self.used
        self.slots.update(zip(names, range(first, first + len(names)), strict=True))
        self.append(ids, lens)
        self.seen[first : self.used] = seen // 2

    def specials(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """Where special strings stand in the texts, from and to."""
        out = []
        if self.find is None or self.mark.encode() not in (whole := data.tobytes()):
            return out
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            out += [(a + m.start(), a + m.end()) for m in self.find.finditer(whole[a:b])]
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id after it, and where they end. Text i starts at offsets[i]."""
        if len(self.slots) > TABLE_ENTRIES:
            self.shrink()
        bounds, inside = offsets, []
        if special := self.specials(data, offsets):
            bounds = np.union1d(offsets, np.array(special).ravel())
            inside = np.concatenate([np.arange(a + 1, b) for a, b in special])
        starts = chunk_starts(data, bounds)
        if len(inside):
            starts = starts[~np.isin(starts, inside)]
        places = np.append(starts, len(data)).astype(np.int32)
        chunks = pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(data)).dictionary_encode()
        names = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        slots = np.fromiter(map(self.slots.get, names, repeat(-1)), np.int64, len(names))
        missing = np.flatnonzero(slots < 0).tolist()
        if missing:
            new = [names[k] for k in missing]
            self.add_chunks(new)
            slots[missing] = [self.slots[c] for c in new]
        self.seen[slots] += 1
        after = np.searchsorted(starts, offsets[1:])
        every = np.insert(slots[chunks.indices.to_numpy()], after, 0)
        ids, ends = self.gathered(every)
        return ids, ends[after + np.arange(len(after))]


def word_ids(path: str, end: int) -> WordIds:
    if (path, end) not in _loaded:
        _loaded[path, end] = WordIds(path, end)
    return _loaded[path, end]


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of a document's pieces: whole if it fits, else the first piece takes what is over."""
    full, over = divmod(n, capacity)
    return ([over] if over else []) + [capacity] * full


def tokenised_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """uid, doc_id, piece, start, length, ids_crc32: the pieces of every whole text's ids with the end id after them.

    A null text is empty and gives the end id alone. uid numbers pieces by partition and place there; write the
    rows before they are read twice.
    """

    def run(batches):
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        table = word_ids(path, end)
        for doc_ids, texts, offsets in byte_blocks(batches, BLOCK_BYTES):
            rows = []
            ids, ends = table.encode(texts, offsets)
            data, at = memoryview(ids).cast("B"), 0
            for doc_id, stop in zip(doc_ids, ends.tolist(), strict=True):
                start = 0
                for k, n in enumerate(cut(stop - at, capacity)):
                    rows.append((uid, doc_id, k, start, n, zlib.crc32(data[4 * (at + start) : 4 * (at + start + n)])))
                    start += n
                    uid += 1
                at = stop
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PIECES.types, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, schema=PIECES)

    return documents(docs).mapInArrow(run, PIECES_DDL)


class Bins:
    """Open bins by free space: a bit mask of the free sizes that occur, and the bins of each."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.bins: list[list[int]] = []
        self.free: list[int] = []
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def add_bin(self, items: list[int], used: int) -> None:
        self._open(len(self.bins), self.capacity - used)
        self.bins.append(items)
        self.free.append(self.capacity - used)

    def _open(self, b: int, free: int) -> None:
        self.by_free[free].append(b)
        self.mask |= 1 << free

    def best_fit(self, item: int, size: int) -> None:
        """Into the fullest bin that has room, else into a new one."""
        fits = self.mask >> size
        if not fits:
            self.add_bin([item], size)
            return
        free = size + (fits & -fits).bit_length() - 1
        b = self.by_free[free].pop()
        if not self.by_free[free]:
            self.mask ^= 1 << free
        self.bins[b].append(item)
        self.free[b] = free - size
        self._open(b, free - size)


def fitness(free: list[int], capacity: int) -> float:
    """Mean of squared fill: with equally many bins, few nearly empty ones beat many half full ones."""
    return sum((capacity - f) ** 2 for f in free) / (capacity * capacity * max(1, len(free)))


def rank_of(solution: Bins) -> tuple:
    return len(solution.bins), -fitness(solution.free, solution.capacity)


def from_labels(labels, sizes: list[int], capacity: int) -> Bins:
    groups: dict[int, list[int]] = {}
    for i, b in enumerate(labels):
        groups.setdefault(b, []).append(i)
    out = Bins(capacity)
    for items in groups.values():
        out.add_bin(items, sum(sizes[i] for i in items))
    return out


def crossover(a: Bins, b: Bins, sizes: list[int], rng: random.Random) -> Bins:
    """a's bins with some of b's best filled ones injected whole; a's bins that share an item with those go, and
    what they hold besides is best-fitted again, largest first."""
    order = sorted(range(len(b.bins)), key=b.free.__getitem__)
    most = max(1, len(order) // 2)
    injected = [x for x in order[:most] if rng.random() < 0.5] or order[:1]
    taken = {i for x in injected for i in b.bins[x]}
    child, displaced = Bins(a.capacity), []
    for x in injected:
        child.add_bin(list(b.bins[x]), b.capacity - b.free[x])
    worst = max(a.free, default=0)
    for items, free in zip(a.bins, a.free, strict=True):
        if not taken.isdisjoint(items):
            displaced += [i for i in items if i not in taken]
        elif free and free * 2 > worst and rng.random() < 0.5:  # mutation: badly filled bins are broken up too
            displaced += items
        else:
            child.add_bin(list(items), a.capacity - free)
    for i in sorted(displaced, key=lambda i: (-sizes[i], i)):
        child.best_fit(i, sizes[i])
    return child


def evolve(sizes: list[int], capacity: int, seed: int, elites: list) -> list[int]:
    """The best packing found, as a bin number for each item. elites: packings from elsewhere that join in."""
    rng = random.Random(seed)
    everyone = [from_labels(e, sizes, capacity) for e in elites]
    lowest = -(-sum(sizes) // capacity)  # a packing of so many bins can't be improved
    spread = 0.0
    while len(everyone) < POPULATION and not any(len(e.bins) <= lowest for e in everyone):
        one = Bins(capacity)
        key = [-s * (1 + spread * rng.random()) for s in sizes]
        for i in sorted(range(len(sizes)), key=lambda i: (key[i], i)):
            one.best_fit(i, sizes[i])
        everyone.append(one)
        spread += 0.15 + 0.1 * (seed % 3)
    for _ in range(GENERATIONS):
        everyone.sort(key=rank_of)
        if len(everyone[0].bins) <= lowest or len(everyone) < 2:
            break
        del everyone[POPULATION:]
        for _ in range(POPULATION // 2):
            a, b = rng.sample(everyone[: max(2, POPULATION)], 2)
            everyone.append(crossover(a, b, sizes, rng))
    best = min(everyone, key=rank_of)
    labels = [0] * len(sizes)
    for k, items in enumerate(best.bins):
        for i in items:
            labels[i] = k
    return labels


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to written pieces (uid, doc_id, piece, start, length, ids_crc32).

    Pieces that fill a sequence get one of their own. The others are dealt by hash into groups of about
    GROUP_PIECES, as many groups as their number asks for. Every group is packed on ISLANDS islands, each a row
    that evolves by itself, a few in a task; after an epoch an island's elite goes on to the next island of its ring,
    where it joins the population. The best island's packing counts. A group's rows are bounded, whatever the input.
    """
    full = F.col("length") == capacity
    rest = pieces.where(~full)
    groups = max(1, -(-rest.count() // GROUP_PIECES))
    packed_rows = F.array_sort(F.collect_list(F.struct("uid", "doc_id", "piece", "start", "length", "ids_crc32")))
    held = written(
        rest.groupBy(F.pmod(F.xxhash64("uid"), F.lit(groups)).alias("group")).agg(packed_rows.alias("rows")), "pack-groups"
    )
    shared_out = min(groups * ISLANDS, shuffle_partitions(pieces.sparkSession))
    tasks = max(shared_out, -(-groups * ISLANDS // TASK_ISLANDS))

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                group, island, epoch = (batch.column(c)[r].as_py() for c in range(3))
                sizes = batch.column(3)[r].as_py()
                elites = batch.column(4)[r].as_py() or []
                labels = evolve(sizes, capacity, (group * ISLANDS + island) * EPOCHS + epoch, elites)
                one = from_labels(labels, sizes, capacity)
                out = [[group], [island], [len(one.bins)], [fitness(one.free, capacity)], [labels]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, state.types, strict=True)], schema=state
                )

    state = pa.schema(
        [
            ("group", pa.int64()),
            ("island", pa.int64()),
            ("bins", pa.int64()),
            ("fit", pa.float64()),
            ("labels", pa.list_(pa.int32())),
        ]
    )
    islands = held.select(
        "group",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ISLANDS - 1).cast("long"))).alias("island"),
        F.col("rows.length").alias("sizes"),
    )
    none = F.lit(None).cast("array<array<int>>")
    at = islands.withColumn("elites", none)
    best = None
    for epoch in range(EPOCHS):
        dealt = at.select("group", "island", F.lit(epoch).alias("epoch"), "sizes", "elites").repartition(
            tasks, "group", "island"
        )
        found = written(
            dealt.mapInArrow(run, "group long, island long, bins long, fit double, labels array<int>"), "pack-epoch"
        )
        best = found
        if epoch + 1 < EPOCHS:
            sent = found.select(
                "group", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("labels").alias("guest")
            )
            own = found.select("group", "island", "labels")
            at = (
                islands.join(own, ["group", "island"])
                .join(sent, ["group", "island"])
                .select("group", "island", "sizes", F.array("labels", "guest").alias("elites"))
            )
    chosen = best.groupBy("group").agg(
        F.min(F.struct(F.col("bins"), (-F.col("fit")).alias("fit"), F.col("island"), F.col("labels"))).alias("b")
    )

    out = pa.schema([*PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                group, rows, labels = (batch.column(c)[r].as_py() for c in range(3))
                filled: dict[int, int] = {}
                cols: list[list] = [[] for _ in out]
                for row, b in zip(rows, labels, strict=True):
                    at = filled.get(b, 0)
                    filled[b] = at + row["length"]
                    for c, v in zip(cols, [*row.values(), 2 * (group << 20 | b), at], strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, out.types, strict=True)], schema=out
                )

    rows = held.join(chosen, "group").select("group", "rows", F.col("b.labels").alias("labels"))
    filled = rows.mapInArrow(place, PIECES_DDL + ", sequence_id long, offset long")
    alone = pieces.where(full).select(
        "*", (F.lit(2) * F.col("uid") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return filled.unionByName(alone)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """All documents in as few sequences of at most `capacity` tokens as the search finds: a row for each piece.

    Returns uid, doc_id, piece, start, length, ids_crc32, sequence_id, offset. Only texts longer than a sequence are
    cut. Null and empty texts are one end id. Repeated rows are packed each; equal lengths are interchangeable, ties
    go by uid. An empty table gives no rows. Other columns of the input are not read.
    """
    return pack(written(tokenised_pieces(docs, path, capacity, end), "pack-pieces"), capacity)


def op5_sequence_packing(spark, sf_dir):
    return pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
