"""Token counts: pieces are counted once per distinct pre-token and joined to each document's pre-token frequencies."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .pretokens import common_mark, is_narrow, words
from .shared import doc_batches, documents, read_table, tokenizer_path

VOCABULARY = "word_bpe_49k.json"
BLOCK_BYTES = 8 << 20
#: Entries of the piece table that a Python worker keeps between blocks; it starts anew beyond them.
TABLE_ENTRIES = 400_000
OUT = "doc_id long, n_bytes long, n_tokens long, n_pretokens long, n_distinct long, over_limit boolean"
ARROW_OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("n_tokens", pa.int64()),
        ("n_pretokens", pa.int64()),
        ("n_distinct", pa.int64()),
        ("over_limit", pa.bool_()),
    ]
)
_loaded: dict = {}


class PieceTable:
    """Pieces per distinct pre-token, filled by the library; ids are only counted."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # Pre-tokens are normalised and split already when they are encoded alone.
        self.alone = Tokenizer.from_file(path)
        self.alone.normalizer = normalizers.Sequence([])
        self.alone.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.normalise = self.tokenizer.normalizer.normalize_str
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.mark = common_mark(special)
        self.pieces: dict[str, int] = {}

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """The text's pre-tokens, and how many special strings stand in it (one token each)."""
        parts, found = [text], 0
        if self.special and self.mark in text:
            parts = self.special.split(text)
            found = len(parts) - 1
        out: list[str] = []
        for part in parts:
            # In Latin-1 the composed form of a text is itself, and lower-casing goes character by character.
            out += words(part.lower() if is_narrow(part) else self.normalise(part))
        return out, found

    def learn(self, distinct: set[str]) -> None:
        if len(self.pieces) > TABLE_ENTRIES:
            self.pieces.clear()
        new = [w for w in distinct if w not in self.pieces]
        for at in range(0, len(new), 50_000):
            some = new[at : at + 50_000]
            for w, e in zip(some, self.alone.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.pieces[w] = len(e)


def piece_table(path: str) -> PieceTable:
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _loaded[path] = PieceTable(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """Tokens of every whole text as the library counts them, without begin, end or added special tokens.

    Each block of documents is split into pre-tokens and counted into per-document frequencies; the block's
    distinct pre-tokens are looked up in the worker's piece table (missing ones are encoded once, alone); a
    document's count is the sum of frequency times pieces. The join is local to a block: nothing is shuffled, so
    no pre-token or source is hot, and a lost task is simply run again.

    Returns doc_id, n_bytes (UTF-8), n_tokens, n_pretokens, n_distinct, over_limit (n_tokens > limit), one row per
    input row. Null text: empty, 0 tokens. Repeated rows: a row each. Empty table: no rows. Very long texts are
    taken whole. Special strings inside a text count as one token each, as by default.
    """

    def run(batches):
        table = piece_table(path)
        for ids, texts in doc_batches(batches, BLOCK_BYTES):
            freqs: list[tuple[Counter, int]] = []
            distinct: set[str] = set()
            for text in texts:
                found, special = table.pretokens(text)
                freq = Counter(found)
                distinct.update(freq)
                freqs.append((freq, special))
            table.learn(distinct)
            pieces = table.pieces
            counts = [sum(n * pieces[w] for w, n in freq.items()) + special for freq, special in freqs]
            cols = [
                ids,
                [len(t) if t.isascii() else len(t.encode()) for t in texts],
                counts,
                [f.total() for f, _ in freqs],
                [len(f) for f, _ in freqs],
                [c > limit for c in counts],
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, ARROW_OUT.types, strict=True)], schema=ARROW_OUT
            )

    return documents(docs).mapInArrow(run, OUT)


def op6_token_counts(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return count_tokens(docs, tokenizer_path(VOCABULARY)).select("doc_id", "n_bytes", "n_tokens", "over_limit")
