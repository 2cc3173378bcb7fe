"""The operators against brute force, the public libraries, exact round trips and held-out accuracy, on small fixtures
that hold nulls, empty and long texts, ties, repeated rows and columns with clashing names."""

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternlog.llm import (
    byte_bpe,
    exact_search,
    gif,
    jaccard_join,
    language_id,
    packing,
    scoring,
    sharding,
    suffix_dedup,
    token_counts,
)
from lanternlog.llm.components import components
from lanternlog.llm.shared import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_tokens long, size string"


def text_of(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    texts = [text_of(rng, rng.randint(0, 120)) for _ in range(60)]
    passage = text_of(rng, 90)
    long = text_of(rng, 20_000)
    texts += [t + " " + passage + " " + text_of(rng, 30) for t in texts[:8]]
    texts += [texts[3], texts[3], texts[4] + " end", long, long[:-7], "", None, "  \n", "<|endoftext|> A<|startoftext|>", "Ünï ¿ 日本 x", "a" * 3000]
    out = [(i, t, ["en", "fr", None][i % 3], "s", 1, 0.5, 2, "z") for i, t in enumerate(texts)]
    return out + [out[5], (None, texts[6], "en", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_suffix_dedup(docs, rows, empty, monkeypatch):
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    count = collections.Counter(t[i : i + 200] for _, t in data for i in range(len(t) - 199))
    wanted = []
    for doc_id, t in data:
        starts = np.array([i for i in range(len(t) - 199) if count[t[i : i + 200]] > 1], np.int64)
        a, b = suffix_dedup.runs(starts, starts + 200)
        wanted.append((doc_id, a.tolist(), b.tolist()))
    for most in (2000, 1):  # the second way splits the keys of crowded anchors
        monkeypatch.setattr(suffix_dedup, "GROUP_SEGMENTS", most)
        found = suffix_dedup.repeated_spans(docs)
        assert found.columns == [*docs.columns, "span_starts", "span_ends"]
        got = [(r.doc_id, r.span_starts, r.span_ends) for r in found.collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, wanted))
    assert suffix_dedup.repeated_spans(empty).count() == 0
    cut = {r.doc_id: r for r in suffix_dedup.without_repeats(docs.where("doc_id is not null")).collect()}
    assert cut[3].text == "" or cut[3].text in rows[3][1]
    assert all(r.n_chars == len(r.text) for r in cut.values() if r.text is not None)


def test_equal_suffixes_orders_deep_groups():
    rng = random.Random(1)
    common = bytes(rng.randrange(4) for _ in range(150))
    parts = [common + bytes(rng.randrange(2) for _ in range(60)) for _ in range(50)] * 2 + [bytes(210)] * 3
    data = np.frombuffer(b"".join(parts), np.uint8)
    starts = np.arange(len(parts)) * 210
    found, stands = suffix_dedup.equal_suffixes(data, starts, np.zeros(len(parts), np.int64))
    same = collections.Counter(p[:200] for p in parts)
    assert sorted(found.tolist()) == [i for i, p in enumerate(parts) if same[p[:200]] > 1]
    assert all(parts[i][:200] == parts[j][:200] for i, j in zip(found, stands))


def brute_components(rows, words, percent):
    sets = {}
    for k, r in enumerate(rows):
        w = (r[1] or "").encode().lower().split()
        n = min(words, len(w))
        sets[k] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()
    parent = {k: k for k in sets}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for k in sets:
        groups[find(k)].append(k)
    least = {f: min((rows[k][0] for k in g if rows[k][0] is not None), default=None) for f, g in groups.items()}
    return [(rows[k][0], len(sets[k]), least[find(k)] if sets[k] else rows[k][0]) for k in sets]


@pytest.mark.parametrize("words,percent,block", [(3, 90, 256), (1, 60, 2)])
def test_jaccard_join(spark, docs, rows, empty, monkeypatch, words, percent, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
    found = jaccard_join.near_duplicates(docs, words, percent)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in found.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_components(rows, words, percent)))
    if block > 2:
        assert jaccard_join.near_duplicates(empty, words, percent).count() == 0


@pytest.mark.parametrize("words,percent,block", [(3, 90, 1024), (5, 80, 2)])
def test_jaccard_join_compares_texts_without_id(spark, monkeypatch, words, percent, block):
    """Components that hang together through texts that only rows without a doc_id have, and repeated ids."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
    rng = random.Random(5)
    a, b, c = (text_of(rng, 150).split() for _ in range(3))
    chain = lambda w, k: " ".join(w[k:] + [f"z{i}" for i in range(k)])
    rows = [(1, chain(a, 0)), (None, chain(a, 6)), (9, chain(a, 12)), (None, chain(a, 6)), (None, chain(a, 18)), (3, chain(b, 0))]
    rows += [(None, chain(b, 5)), (None, chain(b, 5).upper()), (None, chain(c, 0)), (None, chain(c, 4)), (3, chain(c, 8)), (None, ""), (None, None)]
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words, percent)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in found.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_components(rows, words, percent)))


@pytest.mark.parametrize("rounds", [1, 3])
def test_jaccard_join_across_blocks(spark, monkeypatch, rounds):
    """Families of copies of all degrees that one passage holds together, compared over several blocks and rounds."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 2)
    monkeypatch.setattr(jaccard_join, "_rounds", lambda amount, held: rounds)
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for family in range(8):
        base = [f"f{family}w{i}" for i in range(90)]
        for _ in range(7):
            text = list(base)
            for at in rng.sample(range(90), rng.randint(0, 5)):
                text[at] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(text + passage)))
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in found.collect()]
    wanted = brute_components(rows, 5, 80)
    assert 8 < len({c for _, _, c in wanted}) < len(rows) - 8
    assert sorted(got) == sorted(wanted)


def test_jaccard_join_compares_only_sets_with_rare_shingles_in_common(spark, monkeypatch):
    """A passage makes one neighbourhood of texts that each nearly link with one other; not all their blocks are compared."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 2)
    compared = []
    write = jaccard_join.written

    def seen(df, name):
        out = write(df, name)
        if name == "join-largest":
            compared.extend(r.a_blocks * r.b_blocks for r in out.collect())
        return out

    monkeypatch.setattr(jaccard_join, "written", seen)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for pair in range(20):
        text = [f"t{pair}w{i}" for i in range(90)]
        other = [*text[:30], "other", *text[31:60], "other", *text[61:80], "other", *text[81:]]
        rows += [(2 * pair, " ".join(text + passage)), (2 * pair + 1, " ".join(other + passage))]
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == sorted(brute_components(rows, 5, 80))
    assert 0 < sum(compared) <= len(rows)


def test_signature_tree_loses_no_link():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    sets = []
    for k in range(70):
        s = base.copy() if k % 2 else np.unique(rng.integers(0, 2**63, rng.integers(5, 300)).astype(np.uint64))
        s[: rng.integers(1, 25)] = rng.integers(0, 2**63, 1).astype(np.uint64)
        sets.append((k, np.unique(s)))
    links = jaccard_join.joined(sets[:50], sets[50:], {}, 80)
    for a in range(50):
        for b in range(50, 70):
            common = len(np.intersect1d(sets[a][1], sets[b][1]))
            if 100 * common >= 80 * (len(sets[a][1]) + len(sets[b][1]) - common):
                assert any(a in e for e in links) and any(b in e for e in links)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (200, 201), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 90, 90: 90, 95: 90, 200: 200, 201: 200}


def test_gif(docs, rows, empty):
    got = {(r.doc_id, r.n_bytes): r for r in gif.read_back(gif.store(docs)).collect()}
    for r in rows:
        payload, n = gif.padded(r[1] or "")
        f = got[r[0], n]
        assert f.payload_sha256 == hashlib.sha256(payload).hexdigest() and f.tail_crc32 == zlib.crc32(payload[-16:])
        assert f.payload_bytes == len(payload) and len(payload) % 192 == 0 and payload
    assert gif.store(empty).count() == 0
    media = gif.store(docs.where("doc_id < 3"))
    assert gif.timed_frames(media).select(F.max(F.size("histogram"))).first()[0] == 48


def test_gif_rules():
    """Interlacing, a local palette, transparency and disposal, in a file made by hand."""

    def image(left, top, w, h, samples, palette=None, interlaced=False, control=None):
        out = b""
        if control:
            out += b"\x21\xf9\x04" + bytes([control[0] << 2 | (control[1] is not None), 7, 0, control[1] or 0]) + b"\0"
        flags = (0x80 | 1 if palette else 0) | (0x40 if interlaced else 0)
        out += b"\x2c" + b"".join(x.to_bytes(2, "little") for x in (left, top, w, h)) + bytes([flags])
        stream = gif.lzw_pack(np.array(samples, np.int32), 2)
        return out + (bytes(palette) if palette else b"") + b"\x02" + gif._sub_blocks(stream)

    head = b"GIF89a" + bytes([2, 0, 2, 0, 0x81, 0, 0]) + bytes([0, 0, 0, 10, 10, 10, 20, 20, 20, 30, 30, 30])
    data = head + image(0, 0, 2, 2, [1, 2, 3, 1], interlaced=True, control=(1, None))
    data += image(0, 0, 1, 2, [1, 0], control=(2, 0)) + image(1, 1, 1, 1, [2], [9] * 12, control=(3, None))
    data += image(0, 1, 1, 1, [3]) + b";"
    frames = gif.read_gif(data)
    reds = [f.canvas[..., 0].tolist() for f in frames]
    assert reds[0] == [[10, 20], [30, 10]]
    assert reds[1] == [[10, 20], [30, 10]]  # sample 0 is see-through
    assert reds[2] == [[0, 20], [0, 9]]  # the second frame's column was cleared
    assert reds[3] == [[0, 20], [30, 10]]  # the third frame was taken back
    assert frames[1].delay == 7 and frames[2].canvas[0, 0, 3] == 0
    for broken in (b"", data[:40], data[:-8]):
        with pytest.raises(ValueError):
            gif.read_gif(broken)


def test_lzw_with_greedy_codes_and_clears():
    """A greedy encoder's stream, with codes that stand for the entry being made, and clear codes within."""
    samples = b"aaaaaaaabababab" * 900 + bytes(range(256)) * 4
    out, table, held, free = [], {}, b"", 258
    bits = lambda v, w: [(v >> i) & 1 for i in range(w)]
    width, stream = 9, bits(256, 9)
    for b in samples:
        one = held + bytes([b])
        if len(one) == 1 or one in table:
            held = one
            continue
        stream += bits(table[held] if len(held) > 1 else held[0], width)
        table[one] = free
        free += 1
        if free == 4096:
            stream += bits(256, 12)
            table, free, width = {}, 258, 9
        elif free - 1 == 1 << width:
            width += 1
        held = bytes([b])
    stream += bits(table[held] if len(held) > 1 else held[0], width)
    if free + 1 > 1 << width and width < 12:
        width += 1
    stream += bits(257, width)
    del out
    assert gif.lzw_decode(np.packbits(np.array(stream, np.uint8), bitorder="little").tobytes(), 8) == samples


def rank_encoding():
    import public_tokenizers
    import tiktoken

    with open(tokenizer_path(byte_bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(docs, rows, empty):
    path, library = tokenizer_path(byte_bpe.VOCABULARY), rank_encoding()
    encoded = byte_bpe.encode(docs, path)
    got = collections.Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect())
    assert got == collections.Counter((r[0], tuple(library.encode_ordinary(r[1] or ""))) for r in rows)
    back = collections.Counter((r.doc_id, bytes(r.data)) for r in byte_bpe.decode(encoded, path).collect())
    assert back == collections.Counter((r[0], (r[1] or "").encode()) for r in rows)
    assert byte_bpe.encode(empty, path).count() == 0


def test_splitting_follows_the_libraries():
    from tokenizers import Tokenizer

    rng, library = random.Random(3), rank_encoding()
    coder = byte_bpe.replayer(tokenizer_path(byte_bpe.VOCABULARY))
    path = tokenizer_path(token_counts.VOCABULARY)
    table, other = token_counts.piece_table(path), Tokenizer.from_file(path)
    texts = ["".join(chr(rng.randrange(32, top)) for _ in range(12)) for top in (127, 256, 1500, 0xD000) for _ in range(300)]
    texts += ["\x1c\x1d x\x85y\xa0 z", " 　 a", "don't 'S we'LL", "² ³¼Ⅷ١٢", "--- ===   \n\n\t x ", "ΑΣ İ ẞ"]
    assert [r.tolist() for r in coder.encode_block(texts)] == library.encode_ordinary_batch(texts)
    for t, e in zip(texts, other.encode_batch_fast(texts, add_special_tokens=False)):
        found, special = table.pretokens(t)
        table.learn(set(found))
        assert special + sum(table.pieces[w] for w in found) == len(e.ids), ascii(t)


def test_token_counts(docs, rows, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path(token_counts.VOCABULARY)
    library = Tokenizer.from_file(path)
    got = collections.Counter((r.doc_id, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, path).collect())
    n = [len(library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]
    assert got == collections.Counter((r[0], k, k > 2048) for r, k in zip(rows, n))
    assert token_counts.count_tokens(empty, path).count() == 0


def test_sharding(docs, rows, empty):
    got = sharding.shard_by_bytes(docs).collect()
    assert sorted((r.size, r.text_crc32) for r in got) == sorted(
        (len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows
    )
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    for shard in by.values():
        assert sorted(r.slot for r in shard) == list(range(len(shard)))
    order = sorted(got, key=lambda r: r.byte_offset)
    assert [r.shard for r in order] == sorted(r.shard for r in got)
    assert [r.byte_offset for r in order] == np.cumsum([0] + [r.size for r in order])[:-1].tolist()
    assert [(r.doc_id is not None, r.doc_id or 0) for r in order] == sorted((r.doc_id is not None, r.doc_id or 0) for r in got)
    assert sharding.shard_by_bytes(empty).count() == 0


def test_exact_search(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.5, 0.25, 0.001, 2.0]) for _ in range(6)], 1) for i in range(700)]
    rows += [(700, None, 1), (701, [1.0, None], 1), (702, [float("nan")] * 6, 1), (703, [float("inf")], 1), (300, rows[5][1], 1), (None, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = exact_search.top_k(df, df.where("vec_id % 100 = 0"), 10).collect()
    ints = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v, _ in rows[:700]] + [(300, None)]
    ints[-1] = (300, ints[5][1])
    wanted = []
    for q, v in ints:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ints if i != q)[:10]
            wanted += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(wanted)
    assert exact_search.top_k(df.where("false"), df.where("false")).count() == 0


def test_language_id(spark, docs, empty):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = language_id.predict_languages(table, language_id.fit(table)).alias("p")
    joined = found.join(table.select("doc_id", "lang"), "doc_id").where(language_id.id_remainder(F.col("doc_id"), 4) == 2)
    assert joined.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95
    got = language_id.predict_languages(docs, language_id.fit(docs)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == "und" for r in got) >= 3
    assert language_id.predict_languages(empty, language_id.fit(empty)).count() == 0
    assert language_id.with_language(docs, language_id.fit(docs)).columns == [*docs.columns, "_lang_pred"]


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path(packing.VOCABULARY)
    library = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path).collect()
    wanted = []
    for r in rows:
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]
        start = 0
        for k, n in enumerate(packing.cut(len(ids))):
            wanted.append((r[0], k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())))
            start += n
    assert sorted(map(repr, ((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got))) == sorted(map(repr, wanted))
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0] + [n for _, n in parts])[:-1].tolist() and sum(n for _, n in parts) <= 1024
    assert len(by) <= -(-sum(r.length for r in got) // 1024) + 2
    assert packing.pack_documents(empty, path).count() == 0


#: What pre-tokens and chunks may end at, and white space, signs and letters of which some look like others in UTF-8.
ODD = ["a", "Z", "s", "ll", "re", "1", "²", "Ⅷ", " ", " ", " ", "  ", "\n", "\n", "\t", "\r", "\x1c", "\0", "\x7f", "\x85", "\xa0", "\u1680", "\u180e"]
ODD += ["\u2009", "\u200b", "\u3000", "\u0301", "'", "'", "'s", "'ll", ".", ",", "!", "<", "é", "ñ", "×", "Ж", "٣", "ᠠ", "中", "😀", "<|endoftext|>", "<|endof", "text|>"]


def odd_blocks(blocks=60):
    rng = random.Random(11)
    for _ in range(blocks):
        some = rng.choice([ODD, rng.sample(ODD, 5)])
        texts = ["".join(rng.choice(some) for _ in range(rng.choice([0, 1, 2, 3, 6, 30]))) for _ in range(100)]
        data = [t.encode() for t in texts]
        yield texts, np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


def test_chunks_have_the_matches_of_their_text():
    from lanternlog.llm.pretokens import chunk_starts, spaced

    for texts, data, offsets in odd_blocks():
        starts = chunk_starts(data, offsets)
        for t, a, b in zip(texts, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            at = [*starts[(starts >= a) & (starts < b)].tolist(), b]
            assert [w for i, j in zip(at, at[1:]) for w in spaced(bytes(data[i:j]).decode())] == spaced(t)


@pytest.mark.parametrize("entries", [600_000, 200])  # a small table starts anew every few blocks
def test_ids_of_odd_texts(monkeypatch, entries):
    from tokenizers import Tokenizer

    path = tokenizer_path(packing.VOCABULARY)
    library, table = Tokenizer.from_file(path), packing.WordIds(path, 2)
    monkeypatch.setattr(packing, "TABLE_ENTRIES", entries)
    for texts, data, offsets in odd_blocks():
        ids, ends = table.encode(data, offsets)
        wanted = [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]
        assert [x.tolist() for x in np.split(ids, ends)[:-1]] == wanted and ends[-1] == len(ids)


def test_known_words_are_not_split_again(monkeypatch):
    calls = []
    monkeypatch.setattr(packing, "spaced", lambda t, was=packing.spaced: calls.append(t) or was(t))
    table = packing.WordIds(tokenizer_path(packing.VOCABULARY), 2)
    text = b"One line, don't say it's two.\nOr so: " * 50
    ids, ends = table.encode(np.frombuffer(text * 200, np.uint8), np.arange(201) * len(text))
    assert len(calls) < 20 and len(np.unique(np.diff(ends))) == 1 and (np.split(ids, 200)[0] == np.split(ids, 200)[-1]).all()


def test_blocks_of_bytes():
    import pyarrow as pa
    from lanternlog.llm.shared import byte_blocks

    texts = ["ab", None, "", "é" * 9, "c", None, "xyz", "q" * 40, "r"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], ["doc_id", "text"])
    none = pa.RecordBatch.from_arrays([pa.array([4, 5]), pa.array([None, None], pa.string())], ["doc_id", "text"])
    for size in (1, 8, 1000):
        got = []
        for ids, data, offsets in byte_blocks([batch.slice(0, 4), batch.slice(4), none, none.slice(0, 0)], size):
            assert len(offsets) == len(ids) + 1 and offsets[0] == 0 and offsets[-1] == len(data)
            assert len(data) <= size or sum(np.diff(offsets) > 0) == 1
            got += [(i, bytes(data[a:b]).decode()) for i, a, b in zip(ids, offsets, offsets[1:])]
        assert got == [*((i, t or "") for i, t in enumerate(texts)), (4, ""), (5, "")]


def test_scoring(docs, rows, empty):
    got = scoring.score_documents(docs).collect()
    assert len(got) == len(rows)
    train = collections.Counter(
        w for r in rows if scoring.remainder(r[0], 7) != 2 for w in [*(r[1] or "").encode().lower().split(), b""]
    )
    n, v = sum(train.values()), len(train)
    wanted = []
    for r in rows:
        words = [*(r[1] or "").encode().lower().split(), b""]
        base = sum(np.log10((train[w] + 1) / (n + v + 1)) for w in words)
        wanted.append((r[0], scoring.remainder(r[0], 7) == 2, len(words), sum(train[w] > 0 for w in words), n, round(float(base), 6)))
    assert sorted(map(repr, wanted)) == sorted(
        repr((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))) for r in got
    )
    assert sum(r.score for r in got) > sum(r.base_score for r in got) and all(r.score < 0 for r in got)
    assert scoring.score_documents(empty).count() == 0


def test_weights_find_the_mixture():
    """Held-out events that only the word estimate explains give it nearly all weight."""
    up = 64 * scoring.GRID + 10 * scoring.GRID
    weights = scoring.learn_weights([{"bucket": 3, "pair": 0, "word": up, "n": 1000}, {"bucket": 0, "pair": 0, "word": 0, "n": 10}])
    assert weights[3][1] > 0.98 and weights[0][2] > 0.98 and np.allclose(weights.sum(axis=1), 1)


def test_pipeline(spark, docs, empty, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert kept.columns == docs.columns and kept.where("text is null or trim(text) = ''").count() == 0
    single = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert single.columns == docs.columns and single.where("doc_id in (68, 69)").count() == 0
    assert single.where("doc_id = 3").count() == 1
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_pipeline_keeps_texts_of_null_and_repeated_ids(spark):
    """One row of each near-duplicate group stays, whatever ids its rows have."""
    import corpus_pipeline

    rng = random.Random(11)
    a, b, c, d, e, f = (text_of(rng, 60) for _ in range(6))
    rows = [(1, a), (None, a), (None, b), (None, b), (None, c), (2, d), (2, e), (2, e), (3, e + " x"), (4, f), (4, d + " x")]
    rows += [(5, ""), (6, None), (None, " "), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 0.5, 2, "z") for i, t in rows], SCHEMA)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    wanted = [(1, a), (None, b), (None, c), (2, d), (2, e), (4, f), (5, ""), (6, None), (None, " ")]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(repr, wanted))


def as_rows(df):
    return collections.Counter(map(repr, map(tuple, df.collect())))


def has_letter(text):
    return any(c.isalpha() for c in text or "")


def test_language_stage_rejects_letterless_texts_only(spark, docs, rows):
    import corpus_pipeline

    odd = [(900, "xq zzqx wvk", "en", "s", 1, 0.5, 2, "z"), (901, "日本語", None, "s", 1, 0.5, 2, "z"), (902, "1 + 1 = 2", "en", "s", 1, 0.5, 2, "z")]
    found = corpus_pipeline.identify_language(spark, docs.union(spark.createDataFrame(odd, SCHEMA)), "")
    assert as_rows(found) == collections.Counter(repr(r) for r in [*rows, *odd] if has_letter(r[1]))


def brute_language(rows):
    """(doc_id, lang, score) of each row: profiles of the rows that are not held out, by strings and Counters."""

    def grams(text):
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        line = " " + " ".join(words) + " "
        found = collections.Counter()
        for n in (1, 2, 3) if words else ():
            found.update(g for i in range(len(line) - n + 1) if (g := line[i : i + n]) != " ")
        return found

    def ranked(found):
        code = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
        return sorted(found, key=lambda g: (-found[g], code(g)))[:300]

    counts = collections.defaultdict(collections.Counter)
    for r in rows:
        if r[1] is not None and r[2] is not None and scoring.remainder(r[0], 4) != 2:
            counts[r[2]].update(grams(r[1]))
    profiles = {lang: {g: k for k, g in enumerate(ranked(c))} for lang, c in sorted(counts.items()) if c}
    out = []
    for r in rows:
        top = ranked(grams(r[1]))
        if not top:
            out.append((r[0], "und", 0.0))
            continue
        away = {lang: sum(abs(p[g] - k) if g in p else 300 for k, g in enumerate(top)) for lang, p in profiles.items()}
        best = min(away, key=away.get)
        out.append((r[0], best, 1.0 - away[best] / (300 * len(top))))
    return out


def test_language_predictions_against_brute_force(docs, rows):
    got = [(r.doc_id, r.lang_pred, r.score) for r in language_id.predict_languages(docs, language_id.fit(docs)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_language(rows)))


def brute_groups(rows, words, percent):
    """Lists of rows: those of each near-duplicate group; and the rows without a word."""
    groups, wordless = [], []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        n = min(words, len(w))
        mine = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else None
        if mine is None:
            wordless.append(r)
            continue
        near = [g for g in groups if any(100 * len(mine & s) >= percent * len(mine | s) for _, s in g)]
        groups = [g for g in groups if not any(g is x for x in near)] + [sum(near, []) + [(r, mine)]]
    return [[r for r, _ in g] for g in groups], wordless


@pytest.fixture(scope="module")
def mixed(rows):
    """The rows with several null and repeated ids, near copies at 5 words and 80 %, and chains through null ids."""
    rng = random.Random(17)
    tail = ("fr", "s", 1, 0.5, 2, "z")
    texts = [text_of(rng, 120).split() for _ in range(5)]
    more = []
    for k, w in enumerate(texts):
        for j, doc_id in enumerate([None, 200 + k, None, 200, None]):
            more.append((doc_id, " ".join(w[4 * j :] + [f"q{j}"] * (j + 1)), *tail))
    more += [more[0], more[1], (None, text_of(rng, 50), *tail), (200, text_of(rng, 50), *tail), (None, None, *tail), (200, "", *tail)]
    return rows + more


@pytest.mark.parametrize("block", [1024, 2])
def test_near_duplicate_stage_against_brute_force(spark, mixed, monkeypatch, block):
    import corpus_pipeline

    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
    kept = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(mixed, SCHEMA), "").collect()]
    groups, wordless = brute_groups(mixed, 5, 80)
    assert any(len(g) > 2 for g in groups) and any(all(r[0] is None for r in g) for g in groups)
    left = collections.Counter(map(repr, kept))
    for g in groups:
        least = min((r[0] is None, r[0] or 0) for r in g)
        found = [r for r in kept if r in g]
        assert len(found) == 1 and (found[0][0] is None, found[0][0] or 0) == least
        left.subtract([repr(found[0])])
    # A wordless text stays, once for each doc_id.
    once = {(r[0], r[1] or "") for r in wordless}
    left = +left
    assert sum(left.values()) == len(once)
    assert {(r[0], r[1] or "") for r in kept if repr(r) in left} == once


def test_passage_stage_against_brute_force(spark, mixed):
    import corpus_pipeline

    count = collections.Counter(t[i : i + 200] for r in mixed for t in [(r[1] or "").encode()] for i in range(len(t) - 199))
    wanted = collections.Counter()
    for r in mixed:
        data = (r[1] or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 199):
            if count[data[i : i + 200]] > 1:
                gone[i : i + 200] = True
        # A run of bytes that cuts a character leaves it whole.
        at, text = 0, ""
        for c in r[1] or "":
            n = len(c.encode())
            text += "" if gone[at : at + n].all() else c
            at += n
        if text:
            wanted[repr((r[0], text, r[2], r[3], len(text), *r[5:]))] += 1
    assert as_rows(corpus_pipeline.cut_repeated_passages(spark, spark.createDataFrame(mixed, SCHEMA), "")) == wanted


def test_packing_stage_against_brute_force(spark, mixed):
    import corpus_pipeline
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(packing.VOCABULARY))
    got = corpus_pipeline.pack_sequences(spark, spark.createDataFrame(mixed, SCHEMA), "").collect()
    wanted = []
    for r in mixed:
        ids, start = [*library.encode(r[1] or "", add_special_tokens=False).ids, 2], 0
        for k, n in enumerate(packing.cut(len(ids))):
            wanted.append((r[0], k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())))
            start += n
    assert sorted(map(repr, ((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got))) == sorted(map(repr, wanted))
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0] + [n for _, n in parts])[:-1].tolist() and sum(n for _, n in parts) <= 1024


def brute_scores(rows):
    """(doc_id, score) of each row, by Counters and sums over single events."""

    def counted(chosen):
        word, pair = collections.Counter(), collections.Counter()
        for r in chosen:
            seen = [b"", *(r[1] or "").encode().lower().split(), b""]
            word.update(seen[1:])
            pair.update(zip(seen, seen[1:]))
        return word, pair

    learned = [r for r in rows if zlib.crc32(str(r[0]).encode() if r[0] is not None else b"") % 7 != 2]
    aside = [r for r in learned if zlib.crc32(str(r[0]).encode() if r[0] is not None else b"") % 112 // 7 == 0]
    assert aside
    word, pair = counted([r for r in learned if not any(r is x for x in aside)])
    distinct = len(counted(learned)[0])
    events = []
    for r in aside:
        seen = [b"", *(r[1] or "").encode().lower().split(), b""]
        for v, w in zip(seen, seen[1:]):
            ratios = [pair[v, w] / max(1, word[v]) * (distinct + 1), word[w] / word.total() * (distinct + 1)]
            events.append((word[v].bit_length(), [2 ** (round(8 * np.log2(x)) / 8) if x else 0.0 for x in ratios] + [1.0]))

    def learn(some, w):
        e = np.array([x for _, x in some])
        for _ in range(40):
            share = e * np.maximum(w, 1e-9)
            w = (share / share.sum(axis=1, keepdims=True)).mean(axis=0)
        return w

    last = learn(events, np.full(3, 1 / 3))
    weights = []
    for b in range(32):
        some = [x for x in events if x[0] == b]
        if some:
            last = np.maximum(learn(some, last), 1e-6)
            last = last / last.sum()
        weights.append(last)
    word, pair = counted(learned)
    out = []
    for r in rows:
        seen, total = [b"", *(r[1] or "").encode().lower().split(), b""], 0.0
        for v, w in zip(seen, seen[1:]):
            a, b, c = weights[word[v].bit_length()]
            first, rest = (a * pair[v, w] / word[v], b) if word[v] else (0.0, a + b)
            total += np.log10(first + rest * word[w] / word.total() + c / (distinct + 1))
        out.append((r[0], total))
    return out


def test_scores_against_brute_force(spark, mixed):
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    found = scoring.score_documents(spark.createDataFrame(mixed, SCHEMA)).collect()
    got, wanted = sorted(((r.doc_id, r.score) for r in found), key=order), sorted(brute_scores(mixed), key=order)
    assert [g[0] for g in got] == [w[0] for w in wanted]
    assert np.allclose([g[1] for g in got], [w[1] for w in wanted], rtol=1e-6, atol=0)


def test_suffixes_that_differ_from_the_last_byte_on(spark):
    """A trie that branches at the last byte, at the very end of the data."""
    common = "".join(random.Random(3).choice("abcdefgh") for _ in range(199))
    data = np.frombuffer((common + "A" + common + "B" + common + "B").encode(), np.uint8)
    found, _ = suffix_dedup.equal_suffixes(data, np.array([0, 200, 400]), np.zeros(3, np.int64))
    assert sorted(found.tolist()) == [1, 2]
    docs = spark.createDataFrame([(1, common + "A"), (2, common + "B"), (3, common + "B")], "doc_id long, text string")
    got = {r.doc_id: (r.span_starts, r.span_ends) for r in suffix_dedup.repeated_spans(docs).collect()}
    assert got == {1: ([], []), 2: ([0], [200]), 3: ([0], [200])}


@pytest.mark.parametrize("length", [200, 33, 40, 47])
def test_longer_keys_part_the_windows(length):
    """Every window holds exactly one of the two longer keys, down to keys that are a whole window."""
    spare = length - suffix_dedup.K
    keys, rounds = [(0, 0)], 0
    while keys:
        longer = []
        for left, right in keys:
            windows = [a for a in range(spare + 1) if a >= left and spare - a >= right]  # by bytes before the anchor
            two = suffix_dedup.split(left, right, length)
            for a in windows if two else []:
                assert sum(a >= x and spare - a >= y for x, y in two) == 1
            assert two or len(windows) == 1
            longer += two
        keys, rounds = longer, rounds + 1
    assert rounds <= 9


def test_frequent_anchor(spark, monkeypatch):
    """Hundreds of texts around one passage: its anchors are split to the end, and nothing is lost or added."""
    monkeypatch.setattr(suffix_dedup, "GROUP_SEGMENTS", 3)
    rng = random.Random(11)
    passage = text_of(rng, 120)
    rows = []
    for i in range(80):
        cut = rng.randrange(len(passage) - 150)
        rows.append((i, text_of(rng, 40) + passage[cut : cut + rng.randint(60, 400)] + text_of(rng, 40)))
    data = [(i, t.encode()) for i, t in rows]
    count = collections.Counter(t[i : i + 200] for _, t in data for i in range(len(t) - 199))
    wanted = {}
    for doc_id, t in data:
        starts = np.array([i for i in range(len(t) - 199) if count[t[i : i + 200]] > 1], np.int64)
        wanted[doc_id] = tuple(x.tolist() for x in suffix_dedup.runs(starts, starts + 200))
    found = suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.span_starts, r.span_ends) for r in found.collect()} == wanted
    assert any(a for a, _ in wanted.values())


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80)])
@pytest.mark.parametrize("texts", [["a b"], ["a b c d", "a b c e", "a b c d", "", None], ["x"] * 4 + ["A b C d e f g"]])
def test_jaccard_join_of_short_texts(spark, words, percent, texts):
    """Sets too small to differ in anything have no parts at all."""
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs, words, percent).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_components(rows, words, percent)))


def test_linked_sets_share_the_parts_they_need():
    """The bound by which sets are left out: a linked pair has, in the larger one's band, at least the parts needed."""
    rng = np.random.default_rng(2)
    tried = 0
    for percent in (60, 80, 90):
        lim = jaccard_join.limits(percent)
        for _ in range(400):
            n = int(rng.integers(3, 400))
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            lost = int(rng.integers(0, max(1, n * (100 - percent) // 100) + 1))
            more = rng.integers(0, 2**63, int(rng.integers(0, max(1, n * (100 - percent) // 100) + 1))).astype(np.uint64)
            b = np.unique(np.concatenate([rng.permutation(a)[lost:], more]))
            if not len(b) or np.array_equal(a, b) or not lim.linked(len(np.intersect1d(a, b)), len(a), len(b)):
                continue
            tried += 1
            tag = lim.band(max(len(a), len(b))) % jaccard_join.TAGS
            (x, x_needs), (y, y_needs) = (jaccard_join.part_hashes(s, percent) for s in (a, b))
            shared = np.intersect1d(x, y)
            met = int(((shared & (jaccard_join.TAGS - 1)) == tag).sum())
            assert met >= dict(x_needs)[tag] and met >= dict(y_needs)[tag]
    assert tried > 300


def test_stages_keep_columns_of_any_name(spark, rows):
    """Documents that have the names used inside the stages and operators, in any case."""
    import corpus_pipeline

    names = ["lang_pred", "_lang_pred", "near_text", "_near_id", "span_starts", "Span_Ends", "row_hash", "uid", "_kept", "part"]
    docs = spark.createDataFrame([(r[0], r[1], r[2], "s", 1, *names) for r in rows], ["doc_id", "text", "lang", "source", "n_chars", *names])
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, None)
        assert out.columns == docs.columns
    kept = out.select(*names).distinct().collect()
    assert [tuple(r) for r in kept] == [tuple(names)]
    assert corpus_pipeline.STAGES[-1][1](spark, out, None).count() > 0


def test_shards_against_brute_force(docs, rows):
    """A row's shard is the equal share of all bytes in which its middle lies; slots count up in each shard."""
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    keys = sorted((i is not None, i or 0, len(t) + 1, zlib.crc32(t)) for i, t in texts)
    total, at, slots, wanted = sum(k[2] for k in keys), 0, collections.Counter(), []
    for some, doc_id, size, crc in keys:
        shard = min(7, (2 * at + size) * 8 // (2 * total))
        wanted.append((doc_id if some else None, size, crc, "bytes", shard, slots[shard], None))
        at += size
        slots[shard] += 1
    columns = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    got = [tuple(r) for r in sharding.shard_by_bytes(docs).select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, wanted))


def test_gif_feature_against_brute_force(docs, rows):
    """Samples are grey, so each channel has the payload's bytes in sixteen classes."""
    wanted = []
    for r in rows:
        counts = np.bincount(np.frombuffer(gif.padded(r[1] or "")[0], np.uint8) >> 4, minlength=16)
        wanted.append((r[0], ";".join(f"{c}:" + ",".join(map(str, counts.tolist())) for c in "rgb")))
    got = [(r.doc_id, r.feature) for r in gif.read_back(gif.store(docs)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, wanted))


def test_common_mark():
    from lanternlog.llm.pretokens import common_mark

    assert common_mark(["<|a|>", "<b>"]) == "<" and common_mark(["ab", "b"]) == "b" and common_mark(["a", "b"]) == common_mark([]) == ""
