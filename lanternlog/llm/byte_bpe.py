"""Byte-level BPE by corpus-level merge replay: merges are applied in rank order to a whole block's words at once."""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pretokens import spaced
from .shared import doc_batches, documents, read_table, tokenizer_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
BLOCK_BYTES = 12 << 20
#: Words whose ids a Python worker keeps between blocks; it starts anew beyond them.
KEPT_WORDS = 250_000
ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
DIGEST = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)
_loaded: dict = {}


class MergeReplay:
    """A rank file as tables: bytes of each id, and the merged id of each pair of ids."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 1
        self.bytes = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.decimal = [str(i) for i in range(self.size)]
        self.single = np.full(256, -1, np.int64)
        for b in range(256):
            self.single[b] = ranks[bytes([b])]
        keys, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    merged.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.merged = np.append(np.array(merged, np.int64)[order], -1)
        # A merge can open a pair of lower rank than its own; such merges go one place per word at a time.
        self.opens_lower = np.zeros(self.size, bool)
        real = self.keys[:-1]
        for part in (real // self.size, real % self.size):
            self.opens_lower[part[self.merged[:-1] < part]] = True
        self.kept: dict[str, np.ndarray] = {}

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged id of each pair, -1 where there is none."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def replay(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word, by merging over all words in rank order through an index from rank to places."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(words) else 0
        if not total:
            return [np.empty(0, np.int32) for _ in words]
        ids = self.single[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lens)
        after = np.arange(1, total + 1)
        last = ends[lens > 0] - 1
        after[last] = -1
        before = np.arange(-1, total - 1)
        before[(ends - lens)[lens > 0]] = -1
        pair = np.full(total, -1, np.int64)  # the rank of the pair that starts at each place
        has = np.flatnonzero(after >= 0)
        pair[has] = self.ranks_of(ids[has], ids[after[has]])
        has = has[pair[has] >= 0]
        order = has[np.argsort(pair[has], kind="stable")]
        ranks, starts = np.unique(pair[order], return_index=True)
        index: dict[int, list[np.ndarray]] = {
            int(r): [x] for r, x in zip(ranks, np.split(order, starts[1:]), strict=True)
        }
        heap = list(index)
        heapify(heap)
        alive = np.ones(total, bool)
        while heap:
            rank = heappop(heap)
            places = index.pop(rank, None)
            if places is None:
                continue
            at = places[0] if len(places) == 1 else np.concatenate(places)
            if len(at) > 1:
                at = np.unique(at)
            at = at[alive[at] & (pair[at] == rank)]
            if not len(at):
                continue
            if len(at) > 1:
                later = None
                if self.opens_lower[rank]:
                    first = np.append(True, word[at[1:]] != word[at[:-1]])
                    at, later = at[first], at[~first]
                else:
                    # In a run of overlapping places (one's right half is the next one's left) take every other.
                    linked = np.append(False, after[at[:-1]] == at[1:])
                    if linked.any():
                        run = np.maximum.accumulate(np.where(linked, 0, np.arange(len(at))))
                        odd = ((np.arange(len(at)) - run) & 1) == 1
                        at = at[~odd]
                if later is not None and len(later):
                    index.setdefault(rank, []).append(later)
                    heappush(heap, rank)
            right = after[at]
            beyond = after[right]
            ids[at] = rank
            alive[right] = False
            pair[right] = -1
            after[at] = beyond
            inner = beyond >= 0
            before[beyond[inner]] = at[inner]
            pair[at] = -1
            pair[at[inner]] = self.ranks_of(ids[at[inner]], ids[beyond[inner]])
            prior = before[at]
            prior = prior[prior >= 0]
            pair[prior] = self.ranks_of(ids[prior], ids[after[prior]])
            touched = np.concatenate([at[inner], prior])
            fresh = pair[touched]
            touched, fresh = touched[fresh >= 0], fresh[fresh >= 0]
            if len(touched) == 1:
                groups = [(int(fresh[0]), touched)]
            elif len(touched):
                o = np.lexsort((touched, fresh))
                touched, fresh = touched[o], fresh[o]
                cut = np.flatnonzero(fresh[1:] != fresh[:-1]) + 1
                groups = zip(fresh[np.append(0, cut)].tolist(), np.split(touched, cut), strict=True)
            else:
                groups = ()
            for r, x in groups:
                if r in index:
                    index[r].append(x)
                else:
                    index[r] = [x]
                    heappush(heap, r)
        left = np.flatnonzero(alive)
        counts = np.bincount(word[left], minlength=len(words))
        return np.split(ids[left].astype(np.int32), np.cumsum(counts)[:-1])

    def encode_block(self, texts: list[str]) -> list[np.ndarray]:
        place: defaultdict = defaultdict()
        place.default_factory = place.__len__
        rows = []
        for text in texts:
            found = spaced(text)
            rows.append(np.fromiter(map(place.__getitem__, found), np.int32, len(found)))
        place.default_factory = None  # it refers to place itself, which would wait for the cyclic collector
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        new = [w for w in place if w not in self.kept]
        self.kept.update(zip(new, self.replay([w.encode() for w in new]), strict=True))
        ids = [self.kept[w] for w in place]
        empty = np.empty(0, np.int32)
        return [np.concatenate([ids[i] for i in row.tolist()]) if len(row) else empty for row in rows]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def replayer(path: str) -> MergeReplay:
    if path not in _loaded:
        _loaded[path] = MergeReplay(path)
    return _loaded[path]


def encoded_batches(path: str, batches):
    coder = replayer(path)
    for ids, texts in doc_batches(batches, BLOCK_BYTES):
        rows = coder.encode_block(texts)
        offsets = np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int32)
        flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists], schema=ENCODED)


def digest_batches(path: str, batches):
    """From encoded batches: the number of ids, the hash of their decimal text, and the hash of what they decode to."""
    coder = replayer(path)
    for batch in batches:
        lists = batch.column(1)
        flat = lists.values.to_numpy()
        bounds = lists.offsets.to_numpy()
        n, ids_sha, decoded_sha = [], [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            ids = flat[a:b].tolist()
            n.append(b - a)
            ids_sha.append(hashlib.sha256(",".join(map(coder.decimal.__getitem__, ids)).encode()).hexdigest())
            decoded_sha.append(hashlib.sha256(coder.decode(ids)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)], schema=DIGEST
        )


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>: the ids of every whole text under the rank file at path, without special tokens.

    A block's distinct pre-tokens are laid out as linked symbols with an inverted index from pair to places; ranks
    are taken in order and each merge updates only the neighbours it touches. Blocks are local: nothing is shuffled.
    Null text: empty, no ids. Repeated rows: a row each. Empty table: no rows. Long texts are taken whole.
    """
    return documents(docs).mapInArrow(lambda batches: encoded_batches(path, batches), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, data binary: the bytes that each row's ids stand for; null or empty ids give empty bytes."""
    out = pa.schema([("doc_id", pa.int64()), ("data", pa.binary())])

    def run(batches):
        coder = replayer(path)
        for batch in batches:
            data = [coder.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], schema=out)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def op8_byte_bpe(spark, sf_dir):
    """Encodes, decodes what was encoded, and returns the digests; both steps run in one Python pass."""
    path = tokenizer_path(VOCABULARY)
    return documents(read_table(spark, sf_dir, "documents")).mapInArrow(
        lambda batches: digest_batches(path, encoded_batches(path, batches)),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
