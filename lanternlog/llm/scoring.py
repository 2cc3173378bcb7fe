"""LM scoring by deleted interpolation: bigram and unigram maximum-likelihood estimates and a uniform one, mixed by the
frequency of the context, with weights that expectation-maximisation learns on held-out counts.

Documents are coded in blocks. A block asks for the counts of its distinct words and word pairs, which are dealt by
hash and summed over all blocks, and gets back the totals in the order in which it asked. So each word or pair is sent
once per block, however often it occurs, and no word is hot.
"""

from __future__ import annotations

import io
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import doc_batches, documents, lanes, read_table, released, remainder, text_bytes, written

BLOCK_BYTES = 8 << 20
#: Documents with this remainder of crc32(doc_id) mod FOLDS are not learned from.
FOLDS, HELD_OUT = 7, 2
#: One in so many of the others is set aside for learning the weights.
DEVELOPMENT = 16
#: Bytes of text whose words and pairs are counted in one task, about.
PART_TEXT = 4 << 20
BUCKETS = 32
ROUNDS = 40
#: Steps of the grid on which held-out events are counted, for each doubling of a ratio of estimates.
GRID = 8
CODED = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("data", pa.binary())])
CODED_DDL = "block long, part int, data binary"
SCORES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("held_out", pa.bool_()),
        ("n_tokens", pa.int64()),
        ("n_known", pa.int64()),
        ("base_score", pa.float64()),
        ("score", pa.float64()),
    ]
)
SCORES_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _pack(**arrays: np.ndarray) -> bytes:
    """Arrays as planes, all first bytes before all second ones: sorted keys and small counts then compress well."""
    out = io.BytesIO()
    planes = {}
    for name, x in arrays.items():
        x = np.ascontiguousarray(x)
        planes[f"{name}|{x.dtype.str}"] = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T)
    np.savez(out, **planes)
    return out.getvalue()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    out = {}
    with np.load(io.BytesIO(data)) as f:
        for name in f.files:
            key, kind = name.split("|", 1)
            out[key] = np.ascontiguousarray(f[name].T).view(kind).reshape(-1)
    return out


def tokens(text: str) -> list[bytes]:
    """Words of a text with A-Z lower-cased; bytes.split parts at exactly blank and 9 to 13."""
    return text.encode().lower().split()


def is_development(doc_id: int | None) -> bool:
    return remainder(doc_id, FOLDS) != HELD_OUT and remainder(doc_id, FOLDS * DEVELOPMENT) // FOLDS == 0


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_keys(hashes: np.ndarray) -> np.ndarray:
    """Even keys stand for words."""
    return _mixed(hashes) & ~np.uint64(1)


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Odd keys stand for pairs."""
    return _mixed(_mixed(left) * np.uint64(3) + right) | np.uint64(1)


class Block:
    """Coded documents: local word numbers with the end as 0, and each token's predecessor (an end at first)."""

    def __init__(self, ids: list, bounds: np.ndarray, codes: np.ndarray, hashes: np.ndarray):
        self.ids, self.bounds, self.codes, self.hashes = ids, bounds, codes, hashes
        before = np.empty_like(codes)
        before[1:] = codes[:-1]
        before[bounds[:-1]] = 0  # each document ends with 0, so that is what precedes it too
        self.before = before
        pairs = before.astype(np.int64) << 32 | codes
        self.pairs, self.pair_of = np.unique(pairs, return_inverse=True)
        keys = np.concatenate(
            [word_keys(hashes), pair_keys(hashes[self.pairs >> 32], hashes[self.pairs & 0xFFFFFFFF])]
        )
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def sums(self, wanted: np.ndarray) -> np.ndarray:
        """Counts of the keys, in their order, over the documents marked in wanted."""
        weight = np.repeat(wanted, np.diff(self.bounds)).astype(np.float64)
        words = np.bincount(self.codes, weight, len(self.hashes))
        pairs = np.bincount(self.pair_of, weight, len(self.pairs))
        return np.concatenate([words, pairs])[self.order].astype(np.uint32)

    def of(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token the counts of the pair, of the context and of the word, from counts in the keys' order."""
        own = np.empty(len(counts), np.int64)
        own[self.order] = counts
        words, pairs = own[: len(self.hashes)], own[len(self.hashes) :]
        return pairs[self.pair_of], words[self.before], words[self.codes]

    def packed(self) -> bytes:
        ids = np.array([-1 if i is None else i for i in self.ids], np.int64)
        missing = np.array([i is None for i in self.ids])
        return _pack(ids=ids, missing=missing, bounds=self.bounds, codes=self.codes, hashes=self.hashes)

    @classmethod
    def unpacked(cls, data: bytes) -> Block:
        x = _unpack(data)
        ids = [None if m else i for i, m in zip(x["ids"].tolist(), x["missing"].tolist(), strict=True)]
        return cls(ids, x["bounds"], x["codes"], x["hashes"])

    @classmethod
    def coded(cls, ids: list, texts: list[str]) -> Block:
        import xxhash

        place: defaultdict = defaultdict()
        place.default_factory = place.__len__
        place[b""]
        rows, ends = [], [0]
        for text in texts:
            found = tokens(text)
            found.append(b"")
            rows.append(np.fromiter(map(place.__getitem__, found), np.int32, len(found)))
            ends.append(ends[-1] + len(found))
        place.default_factory = None  # it refers to place itself, which would wait for the cyclic collector
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, place), np.uint64, len(place))
        return cls(ids, np.array(ends, np.int64), np.concatenate(rows), hashes)


def _requests(block: Block, number: int, bits: int, **counts: np.ndarray):
    """The block's keys by their first bits, with what they count."""
    part = (block.keys >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.searchsorted(part, np.arange((1 << bits) + 1))
    for p in np.unique(part).tolist():
        span = slice(cuts[p], cuts[p + 1])
        yield number, p, _pack(keys=block.keys[span], **{k: v[span] for k, v in counts.items()})


def _batches(rows: list):
    for at in range(0, len(rows), 64):
        cols = zip(*rows[at : at + 64], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, CODED.types, strict=True)], schema=CODED)


def _coded(docs: DataFrame) -> DataFrame:
    """Blocks of coded documents: all of them under even numbers, the development ones also under odd numbers."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for ids, texts in doc_batches(batches, BLOCK_BYTES):
            rows = [(2 * number, -1, Block.coded(ids, texts).packed())]
            some = [i for i, doc_id in enumerate(ids) if is_development(doc_id)]
            if some:
                small = Block.coded([ids[i] for i in some], [texts[i] for i in some])
                rows.append((2 * number + 1, -1, small.packed()))
            number += 1
            yield from _batches(rows)

    return documents(docs).mapInArrow(run, CODED_DDL)


def _asked(coded: DataFrame, bits: int) -> DataFrame:
    """Each block's requests, by part; those of all documents bring along what they count."""

    def run(batches):
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                block = Block.unpacked(data.as_py())
                counts = {}
                if not number & 1:
                    learned = np.array([remainder(i, FOLDS) != HELD_OUT for i in block.ids])
                    aside = np.array([is_development(i) for i in block.ids])
                    counts = {"all": block.sums(learned), "fit": block.sums(learned & ~aside)}
                yield from _batches(list(_requests(block, number, bits, **counts)))

    return coded.mapInArrow(run, CODED_DDL)


def _answers(requests: DataFrame) -> DataFrame:
    """For each request its keys' totals; block -1 has each part's distinct words, and tokens learned from and fitted."""

    def run(table: pa.Table) -> pa.Table:
        asked = [(b, _unpack(d)) for b, d in zip(table["block"].to_pylist(), table["data"].to_pylist(), strict=True)]
        part = table["part"][0].as_py()
        keys, place = np.unique(np.concatenate([x["keys"] for _, x in asked]), return_inverse=True)
        every, fit = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at = 0
        spans = []
        for _, x in asked:
            mine = place[at : at + len(x["keys"])]
            at += len(mine)
            spans.append(mine)
            if "all" in x:  # a request's keys are distinct
                every[mine] += x["all"]
                fit[mine] += x["fit"]
        words = (keys & np.uint64(1)) == 0
        totals = np.array([(every[words] > 0).sum(), every[words].sum(), fit[words].sum()], np.int64)
        rows = [(-1, part, totals.astype("<i8").tobytes())]
        for (block, _), mine in zip(asked, spans, strict=True):
            n = (fit if block & 1 else every)[mine]
            rows.append((block, part, _pack(n=n.astype(np.uint32) if n.max(initial=0) < 1 << 32 else n)))
        return pa.Table.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), CODED.types, strict=True)], schema=CODED
        )

    return requests.groupBy("part").applyInArrow(run, CODED_DDL)


def _answered(table: pa.Table) -> tuple[Block, np.ndarray]:
    """The block of a group of its documents and answers, and the totals of its keys."""
    rows = sorted(zip(table["part"].to_pylist(), table["data"].to_pylist(), strict=True))
    block = Block.unpacked(rows[0][1])
    return block, np.concatenate([_unpack(d)["n"] for _, d in rows[1:]])


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 for each doubling."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))).astype(np.int64) + 1, 0).clip(0, BUCKETS - 1)


def _events(blocks: DataFrame, n_fit: int, distinct: int) -> DataFrame:
    """Held-out events on a grid: bucket, and how many times the uniform estimate the other two are (0: estimate 0)."""
    out = pa.schema([("bucket", pa.int64()), ("pair", pa.int64()), ("word", pa.int64()), ("n", pa.int64())])

    def step(ratio: np.ndarray) -> np.ndarray:
        # Ratios below 2^-64 or above 2^64 do not occur with counts of 64 bits.
        return np.where(ratio > 0, np.rint(np.log2(np.maximum(ratio, 1e-30)) * GRID).astype(np.int64) + 64 * GRID, 0)

    def run(table: pa.Table) -> pa.Table:
        block, counts = _answered(table)
        pair, context, word = block.of(counts)
        uniform = 1 / (distinct + 1)
        code = bucket(context) << 40
        code |= step(pair / np.maximum(context, 1) / uniform) << 20
        code |= step(word / max(1, n_fit) / uniform)
        codes, n = np.unique(code, return_counts=True)
        return pa.Table.from_arrays(
            [pa.array(codes >> 40), pa.array(codes >> 20 & 0xFFFFF), pa.array(codes & 0xFFFFF), pa.array(n)], schema=out
        )

    return (
        blocks.groupBy("block")
        .applyInArrow(run, "bucket long, pair long, word long, n long")
        .groupBy("bucket", "pair", "word")
        .agg(F.sum("n").alias("n"))
    )


def learn_weights(events: list, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of pair, word and uniform estimate in each bucket, by expectation-maximisation.

    A bucket without events takes the weights of the nearest filled bucket below it (bucket 0: of all events).
    """
    weights = np.full((BUCKETS, 3), 1 / 3)
    if not events:
        return weights
    rows = np.array([[e["bucket"], e["pair"], e["word"], e["n"]] for e in events], np.int64)

    def ratio(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, np.exp2((x - 64 * GRID) / GRID), 0.0)

    estimates = np.stack([ratio(rows[:, 1]), ratio(rows[:, 2]), np.ones(len(rows))], axis=1)
    n = rows[:, 3].astype(np.float64)
    overall = np.full(3, 1 / 3)
    for _ in range(rounds):
        share = estimates * overall
        share /= share.sum(axis=1, keepdims=True)
        overall = (share * n[:, None]).sum(axis=0) / n.sum()
    last = overall
    for b in range(BUCKETS):
        mine = rows[:, 0] == b
        if mine.any():
            w = last
            for _ in range(rounds):
                share = estimates[mine] * np.maximum(w, 1e-9)
                share /= share.sum(axis=1, keepdims=True)
                w = (share * n[mine, None]).sum(axis=0) / n[mine].sum()
            # No text may become impossible, and where the context was never seen there is no pair estimate.
            w = np.maximum(w, 1e-6)
            last = w / w.sum()
        weights[b] = last
    return weights


def _scores(blocks: DataFrame, weights: np.ndarray, n: int, distinct: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        block, counts = _answered(table)
        pair, context, word = block.of(counts)
        w = weights[bucket(context)]
        # Where the context has no count its weight goes to the word estimate, so that all still sums to 1.
        known = context > 0
        p = np.where(known, w[:, 0], 0) * pair / np.maximum(context, 1)
        p += (w[:, 1] + np.where(known, 0, w[:, 0])) * word / max(1, n) + w[:, 2] / (distinct + 1)
        if n == 0:
            p = np.full(len(pair), 1 / (distinct + 1))
        starts = block.bounds[:-1]
        base = np.log10((word + 1) / (n + 1 * (distinct + 1)))
        cols = [
            block.ids,
            [remainder(i, FOLDS) == HELD_OUT for i in block.ids],
            np.diff(block.bounds),
            np.add.reduceat((word > 0).astype(np.int64), starts),
            np.add.reduceat(base, starts),
            np.add.reduceat(np.log10(p), starts),
        ]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, SCORES.types, strict=True)], schema=SCORES)

    return blocks.groupBy("block").applyInArrow(run, SCORES_DDL)


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, score, train_tokens for every whole text.

    The model learns from all rows whose crc32(doc_id) mod 7 is not 2: P(w | v) mixes count(vw) / count(v),
    count(w) / N and 1 / (V + 1) by the frequency bucket of v; a text's first word follows an end. The weights are
    learned on one in sixteen of those rows with counts of the others; then the counts of all of them are used.
    base_score is the unigram model with one added to each count. Words and pairs are told apart by 64-bit hashes.

    Null and empty texts have one token, the end. Repeated rows: each learned from and scored. Empty table: no rows.
    With nothing to learn from, every word has the uniform probability.
    """
    bits = (lanes(text_bytes(docs), PART_TEXT) - 1).bit_length()
    # The requests are shuffled as they are made; only the coded documents and the answers are written.
    coded = written(_coded(docs), "lm-coded")
    answers = written(_answers(_asked(coded, bits)), "lm-answers")
    totals = np.zeros(3, np.int64)
    for r in answers.where("block = -1").select("data").collect():  # one row for each part
        totals += np.frombuffer(r["data"], "<i8")
    distinct, n, n_fit = totals.tolist()
    released()  # the requests' shuffle files; the scheduler lets go of a job only after the next one
    both = coded.unionByName(answers.where("block >= 0"))
    # The grid bounds this table: at most BUCKETS x (128 x GRID)^2 cells, of which a corpus fills a small part.
    events = _events(both.where("block % 2 = 1"), n_fit, distinct).collect()
    weights = learn_weights(events)
    released()
    scored = _scores(both.where("block % 2 = 0"), weights, n, distinct)
    return scored.withColumn("train_tokens", F.lit(n).cast("long"))


def op3_lm_scores(spark, sf_dir):
    return score_documents(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
