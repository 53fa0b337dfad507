"""Wavelet shards, tokenizer alignment and vector codes against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from noticelake.llm import align, codebooks, wavelet

WORD_BPE, A_PATH, B_PATH = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
LONG = "the quick brown fox, 12 jumps! " * 700
HARD = [
    (3, "Hello world", "a"), (1, None, "a"), (2, "", "a"), (5, "  lead\n\nand  trail \n", None), (4, "same text here", "a"), (4, "same text here", "a"), (4, "other text", "b"),
    (None, "no id, one", "b"), (None, "no id, one", "b"), (7, "<|endoftext|> </s> [INST] <s>", "a"), (6, LONG, "a"), (8, "l'été où ça   　x 日本語テキスト", "a"), (9, "a▁b marks", "a"),
]
HARD += [(20 + i, f"shared words and number {i % 3} again", "a") for i in range(12)]


# ---- wavelet shards


def word_ids(text):
    from tokenizers import Tokenizer

    t = word_ids.__dict__.setdefault("t", Tokenizer.from_file(WORD_BPE))
    return [*t.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("n, top", [(0, 5), (1, 5), (7, 1), (100, 3), (70_000, 40), (70_000, 5000), (5000, 1 << 22)])
def test_shard_reads_as_written(n, top):
    rng = np.random.default_rng(n + top)
    ids = np.minimum(rng.zipf(1.3, n), top).astype(np.uint32) if n % 2 == 0 else rng.integers(0, top, n).astype(np.uint32)
    cuts = np.sort(rng.integers(0, n + 1, 4))
    lengths = np.diff(np.concatenate([[0], cuts, [n]]))
    data = wavelet.shard_bytes(ids, lengths, np.array([5, 6, wavelet.NULL, 6, 9]))
    shard = wavelet.Shard(data)
    assert (shard.ids() == ids).all() and shard.lengths.tolist() == lengths.tolist()
    for t in {*ids[:20].tolist(), top + 1}:
        places = np.flatnonzero(ids == t)
        assert shard.places(t).tolist() == places.tolist() and shard.count(t) == len(places)
        assert shard.count(t, n // 3, n // 2) == ((places >= n // 3) & (places < n // 2)).sum()
        assert shard.places(t, n // 3, 2 * n).tolist() == places[places >= n // 3].tolist()
    assert all(shard.access(i) == ids[i] for i in range(0, n, max(1, n // 40)))
    with pytest.raises(ValueError):
        wavelet.Shard(data[:-1] + bytes([data[-1] ^ 1]))
    if n > 50_000 and top < 100:
        assert len(data) < n  # below a byte for each id


@pytest.mark.parametrize("shard_ids", [40, 1000, 1 << 20])
def test_wavelet_documents_and_lookups(spark, documents, shard_ids):
    shards = wavelet.write_shards(documents(HARD).repartition(5, "text"), WORD_BPE, shard_ids=shard_ids)
    got = [tuple(r) for r in wavelet.read_documents(shards).collect()]
    rows = sorted(((i, word_ids(t)) for i, t, _ in HARD), key=lambda r: (r[0] is None, r[0] or 0))
    got.sort(key=lambda r: (r[1], r[0] is None))
    assert [r[0] for r in got] == [i for i, _ in rows]  # starts ascend with doc_id, nulls last
    at = 0
    for doc, start, n, _ in got:
        assert start == at
        at += n
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in rows)
    kept = sorted(wavelet.read_documents(shards, keep_ids=True).collect(), key=lambda r: r["start"])
    flat = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in kept])
    asked = [2, *sorted(set(flat.tolist()))[:4], 48_000]
    counts = {r["token"]: (r["occurrences"], r["n_docs"]) for r in wavelet.token_counts(shards, asked).collect()}
    assert counts == {t: (int((flat == t).sum()), sum(t in np.frombuffer(r["ids"], "<u4") for r in kept)) for t in asked}
    places = defaultdict(set)
    for r in wavelet.occurrences(shards, asked).collect():
        places[r["token"]].add((r["doc_id"], r["at"], r["place"]))
    for t in asked:
        assert places[t] == {(r["doc_id"], k, r["start"] + k) for r in kept for k, x in enumerate(np.frombuffer(r["ids"], "<u4").tolist()) if x == t}
    sought = [0, 1, len(flat) - 1, len(flat) // 2, len(flat) + 7]
    found = {r["place"]: r["token"] for r in wavelet.tokens_at(shards, spark.createDataFrame([(p,) for p in sought], "place bigint")).collect()}
    assert found == {p: int(flat[p]) for p in sought if p < len(flat)}


def test_wavelet_of_an_empty_table(documents):
    shards = wavelet.write_shards(documents([]), WORD_BPE)
    assert wavelet.read_documents(shards).count() == 0 and [tuple(r) for r in wavelet.token_counts(shards, [2]).collect()] == [(2, 0, 0)]


# ---- alignment


def plain_alignment(rows):
    both = align.pair(A_PATH, B_PATH)
    a_bytes, b_bytes = (x.to_pylist() for x in both.bytes)
    found, pairs = [], Counter()
    for doc, text, _ in rows:
        groups = []
        if text:
            source = f" {text}".encode()
            a, b = both.a.encode(f" {text}", add_special_tokens=False).ids, both.b.encode(text)
            if b"".join(a_bytes[i] for i in a) == source == b"".join(b_bytes[i] for i in b):
                ends = [np.cumsum([len(x[i]) for i in ids]).tolist() for x, ids in ((a_bytes, a), (b_bytes, b))]
                last = [0, 0]
                for cut in sorted(set(ends[0]) & set(ends[1])):
                    stop = [ends[0].index(cut) + 1, ends[1].index(cut) + 1]
                    groups.append((a[last[0] : stop[0]], b[last[1] : stop[1]]))
                    last = stop
        links = Counter((x, y) for p, q in groups for x in p for y in q)
        pairs.update(links.keys())
        found.append((doc, groups, links))
    most = defaultdict(int)
    for (x, _), n in pairs.items():
        most[x] = max(most[x], n)
    out = []
    for doc, groups, links in found:
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        best = sum(n for k, n in links.items() if pairs[k] == most[k[0]])
        out.append((doc, sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), sum(links.values()), best, sum(n * pairs[k] for k, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out, pairs, found


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def texts_of(seed, n):
    rng = random.Random(seed)
    parts = ["the", "été", " ", "  ", "\n", "\t", "12345", "...", "don't", "œuvre", "日本", "antidisestablishment", "x" * 40, " ", "<s>", "\x00", "!?", "ＡＢ", "é", "🙂", " a", "\r\n", "foo_bar", " "]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [200, 8 << 20])
def test_alignment_equals_the_plain_one(documents, monkeypatch, chunk):
    monkeypatch.setattr(align, "CHUNK", chunk)
    rows = HARD + [(100 + k, t, "a") for k, t in enumerate(texts_of(1, 40))]
    expected, pairs, found = plain_alignment(rows)
    assert sum(1 for r in expected if not r[1]) >= 3 and any(r[4] > r[1] for r in expected)
    got = [tuple(r) for r in align.align_documents(documents(rows).repartition(3), A_PATH, B_PATH).collect()]
    assert sorted(got, key=key) == sorted(expected, key=key)


def test_units_are_encoded_as_whole_texts_are():
    import pyarrow as pa

    both, texts = align.pair(A_PATH, B_PATH), texts_of(2, 1500)
    assert both.by_unit and both.plain_letters
    flat, bounds, raw, offsets = both.ids(pa.array(texts))
    assert bytes(raw) == "".join(f" {t}" for t in texts).encode()
    for k, t in enumerate(texts):
        assert flat[0][bounds[0][k] : bounds[0][k + 1]].tolist() == both.a.encode(f" {t}", add_special_tokens=False).ids
        if "▁" not in t:
            assert flat[1][bounds[1][k] : bounds[1][k + 1]].tolist() == both.b.encode(t)


def test_wide_groups_and_pair_counts(documents, monkeypatch):
    monkeypatch.setattr(align, "WIDE", 1)
    rows = HARD + [(300, "x" * 37 + "日本語" * 9 + "🙂🙂", "a")]
    expected, pairs, found = plain_alignment(rows)
    import pyarrow as pa

    alone = align.Aligned(align.pair(A_PATH, B_PATH), pa.array([t for _, t, _ in rows]))
    n, keys, times = alone.pairs()
    size, at = align.pair(A_PATH, B_PATH).b_size, 0
    for count, (_, _, links) in zip(n.tolist(), found):
        assert {(k // size, k % size): t for k, t in zip(keys[at : at + count].tolist(), times[at : at + count].tolist())} == dict(links)
        at += count
    got = {(r["a_id"], r["b_id"]): (r["docs"], r["best"]) for r in align.pair_counts(documents(rows), A_PATH, B_PATH).collect()}
    assert {k: v[0] for k, v in got.items()} == dict(pairs)
    assert all(best == (n == max(m for (x, _), m in pairs.items() if x == k[0])) for k, (n, best) in got.items())


def test_token_groups(documents):
    expected, _, found = plain_alignment(HARD[:8])
    got = align.token_groups(documents(HARD[:8]), A_PATH, B_PATH).collect()
    lists = Counter()
    for r in got:
        starts = zip([0, *r["a_stops"]], r["a_stops"], [0, *r["b_stops"]], r["b_stops"])
        lists[(r["doc_id"], str([(r["a_ids"][a:b], r["b_ids"][c:d]) for a, b, c, d in starts]))] += 1
    assert lists == Counter((doc, str(groups)) for doc, groups, _ in found)


def test_alignment_of_an_empty_table(documents):
    assert align.align_documents(documents([]), A_PATH, B_PATH).count() == 0


# ---- vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = []
    for i, x, label in rows:
        if x and all(v is not None and math.isfinite(v) for v in x):
            kept.append((i, [int(v) * scale if abs(v) >= 2.0**52 else math.floor(scale * v) for v in x], label, x))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    n = len(kept[0][1])
    spans = [(p * n // parts, (p + 1) * n // parts) for p in range(parts)]
    books = [[r[1][lo:hi] for r in kept[:entries]] for lo, hi in spans]

    def nearest(p, v):
        return min(range(len(books[p])), key=lambda e: (sum((a - b) ** 2 for a, b in zip(v[spans[p][0] : spans[p][1]], books[p][e])), e))

    for _ in range(rounds):
        codes = [[nearest(p, r[1]) for p in range(parts)] for r in kept]
        for p, (lo, hi) in enumerate(spans):
            for e in range(len(books[p])):
                mine = [r[1][lo:hi] for r, c in zip(kept, codes) if c[p] == e]
                if mine:
                    books[p][e] = [sum(col) // len(mine) for col in zip(*mine)]
    out, by_label = [], defaultdict(int)
    for i, v, label, _ in kept:
        code = [nearest(p, v) for p in range(parts)]
        error = sum((a - b) ** 2 for p, (lo, hi) in enumerate(spans) for a, b in zip(v[lo:hi], books[p][code[p]]))
        by_label[label] += error
        out.append((i, label, "".join(f"{c:02x}" for c in code), error))
    digest = hashlib.sha256(",".join(str(v) for b in books for row in b for v in row).encode()).hexdigest()
    fits = lambda x: x if x < 1 << 63 else None
    return sorted([(i, label, code, fits(error), fits(by_label[label]), digest) for i, label, code, error in out], key=key)


def vectors(spark, rows):
    return spark.createDataFrame([(i, x, label, "clash", "clash") for i, x, label in rows], "vec_id bigint, embedding array<double>, label int, codes string, x string")


def random_vectors(n, dim, seed, grid=None):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, dim))
    x = centres[rng.integers(0, 7, n)] + 0.2 * rng.normal(size=(n, dim))
    if grid:
        x = np.round(x * grid) / grid
    return [(k, x[k].tolist(), None if k % 11 == 0 else k % 3) for k in range(n)]


BAD = [(900, None, 1), (901, [], 1), (902, [1.0, None] * 8, 1), (903, [float("nan")] * 16, 1), (904, [float("inf")] + [0.0] * 15, None), (905, [1.0] * 7, 2)]


@pytest.mark.parametrize("rows", [
    random_vectors(400, 16, 1),
    random_vectors(400, 16, 2, grid=2) + BAD,  # many ties
    random_vectors(300, 21, 3, grid=4),  # parts that differ by one
    [(None, [0.5] * 16, 1), (None, [0.25] * 16, 1), (3, [0.5] * 16, None), (3, [0.5] * 16, None), (2, [-0.25] * 16, 1)],  # fewer rows than entries, shared ids
    [(k, [(-1.0) ** k * 10.0 ** (k % 30)] * 16, 0) for k in range(60)],  # numbers beyond 64 bits
    [(k, [1.0] * 16, None) for k in range(40)],  # all equal
], ids=["plain", "ties", "uneven", "few", "huge", "equal"])
def test_vector_codes_equal_the_plain_ones(spark, rows):
    got = codebooks.encode_vectors(vectors(spark, rows).repartition(3)).collect()
    assert sorted([tuple(r) for r in got], key=key) == plain_codes(rows)


def test_bounds_spare_distances_and_stay_bounds(spark):
    rows = random_vectors(2000, 32, 5)
    state, books, moved, spans = codebooks.train(vectors(spark, rows))
    measured = state.agg(F.sum("measured")).first()[0]
    assert measured < 0.35 * len(rows) * 8 * 16
    for r in state.limit(300).collect():
        v = codebooks.whole_numbers(np.array(r["x"]), 4096)
        upper, lower = np.frombuffer(r["upper"], "<f4"), np.frombuffer(r["lower"], "<f4").reshape(8, 16)
        for p, (lo, hi) in enumerate(spans):  # bounds of the entries before they moved, so they hold with the movement added
            d = np.sqrt(((books[p].c - v[lo:hi]) ** 2).sum(axis=1))
            assert d[r["codes"][p]] <= upper[p] + moved[p][r["codes"][p]] + 1e-3 and (lower[p] - moved[p] <= d + 1e-3).all()


def test_only_the_last_state_stays(spark, tmp_path):
    import os

    from noticelake.llm.common import shared_dir

    def states():
        folder = shared_dir(spark).removeprefix("file://")
        return {d for d in os.listdir(folder) if d.startswith("bounds-")} if os.path.isdir(folder) else set()

    before = states()
    codebooks.encode_vectors(vectors(spark, random_vectors(50, 16, 7))).collect()
    assert states() == before


def test_vector_codes_of_an_empty_table(spark):
    assert codebooks.encode_vectors(vectors(spark, [])).count() == 0
    assert codebooks.encode_vectors(vectors(spark, BAD[:5])).count() == 0
