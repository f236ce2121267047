"""BPE codec, whitening and periodic runs: odd rows and random cases, against the library, exact arithmetic and brute force."""

import collections
import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tests.llm.test_operators import docs, empty, texts  # noqa: F401  (fixtures)
from vetra.llm import bpecodec, periodic, queries, whitening

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    pool = ["a", "b", "the ", "ing", "'", "'s", "'LL", "!", "…", "é", "É", "İ", "ı", "Σ", "ς", "ß", "́", "​", "\x00", "﻿", "漢", "字", "ｶﾞ", "한국", "किताब", "عربي"]
    pool += ["<|endoftext|>", "<|startoftext|>", "<", "|>", "½", "²", "①", "Ⅷ", "😀", "👩‍👧", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", " ", "\xa0", "  ", " ", "123", "４", "ǅ", "ﬁ", "᠎", "antidis", "zzqx", "\x7f", "ª", "\xad"]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_codec_is_the_library():
    codec, tok = bpecodec.Codec(VOCABULARY, memo=500), library()
    long = ["a" * 5000, "ab" * 3000, "!" * 5000, "".join(random.Random(2).choice("abcdefghij") for _ in range(20_000)), "word " * 6000]
    for text in odd_texts(3000) + [t or "" for _, t in texts()] + long:
        ids = tok.encode(text, add_special_tokens=False).ids
        own = codec.encode(text)
        assert np.frombuffer(own, "<u4").tolist() == ids, text
        assert codec.decode(own) == tok.decode(ids, skip_special_tokens=False), text
    assert codec.decode(np.array([320, 49_408, 1_000_000, 5], "<u4").tobytes()) == tok.decode([320, 49_408, 1_000_000, 5], skip_special_tokens=False)


def test_cuts_are_certain():
    """Nothing is ever joined across a cut, and fragments by themselves give what the whole word gives."""
    codec, rng = bpecodec.Codec(VOCABULARY), random.Random(4)
    cut = 0
    for _ in range(2000):
        word = bytes(rng.choice(b"etaoinshrdluxqz'!\xc3\xa9\xe6") for _ in range(rng.randint(1, 60)))
        pieces = codec.fragments([word])
        cut += len(pieces) > 1
        whole = [codec.first_ids[b] for b in word[:-1]] + [codec.first_ids[256 + word[-1]]]
        want = bpecodec.merge_many(whole, codec.joins)
        assert bpecodec.merge_few(whole, codec.joins) == want
        assert np.frombuffer(b"".join(map(codec.piece, pieces)), "<u4").tolist() == want
    assert cut > 1000


def test_codec_query(spark, docs, empty):  # noqa: F811
    tok = library()
    want = collections.Counter()
    for i, t in texts():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[i, tuple(ids), tok.decode(ids, skip_special_tokens=False)] += 1
    rows = bpecodec.decode_documents(bpecodec.encode_documents(docs, VOCABULARY), VOCABULARY).collect()
    assert collections.Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.decoded) for r in rows) == want
    assert bpecodec.encode_documents(empty, VOCABULARY).count() == 0
    null = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert bpecodec.decode_documents(null, VOCABULARY).first().decoded == ""


def test_codec_on_the_table(spark, sf_dir):
    tok, rows = library(), {r.doc_id: r for r in queries.op11_bpe_codec(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        own = rows.pop(r.doc_id)
        assert own.n_tokens == len(ids) and own.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert own.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert not rows


# whitening


def exact_covariance(grid):
    n, d = len(grid), len(grid[0])
    total = [sum(r[j] for r in grid) for j in range(d)]
    centred = [[n * r[j] - total[j] for j in range(d)] for r in grid]
    return n, total, [[Fraction(sum(r[i] * r[j] for r in centred), n**3) for j in range(d)] for i in range(d)]


@pytest.mark.parametrize("scale", [1.0, 1e12, 1e300])
def test_whitening_is_exact(spark, scale):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(60, 5)) * [5, 3, 2, 1, 0.5] * min(scale, 1e12) + 100).tolist()
    if scale == 1e300:
        x += [[1e300, -1e300, 0.0, 1.0, 2.0]]  # beyond long: the range's ends
    rows = [(i, v, 1, "k", 2.0) for i, v in enumerate(x + x[:7])] + [(None, x[0], 1, "k", 2.0), (500, None, 1, "k", 2.0), (501, [1.0, None, 1.0, 1.0, 1.0], 1, "k", 2.0)]
    rows += [(502, [float("nan")] + x[0][1:], 1, "k", 2.0), (503, [float("inf")] + x[0][1:], 1, "k", 2.0), (504, [], 1, "k", 2.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x int, n string, whitened double").repartition(3)
    got = whitening.whitened(df, most=4).collect()
    on_grid = lambda v: [max(-(2**63), min(2**63 - 1, int(np.floor(256 * c)))) for c in v]
    grid = sorted({tuple(on_grid(v)) for v in x})
    n, total, v = exact_covariance(grid)
    trace = float(sum(v[i][i] for i in range(5)))
    values, vectors = np.linalg.eigh(np.array([[float(c) for c in r] for r in v]))
    k = min(4, int((values > trace * 5 * np.finfo(float).eps).sum()))
    assert collections.Counter(r.vec_id for r in got) == {**{i: k for i in range(len(x) + 7)}, None: k}
    for r in got:
        own = on_grid(x[(r.vec_id or 0) % len(x)])
        y = [n * c - s for c, s in zip(own, total)]
        deviation = sum(c * c for c in y)
        assert r.n == n and r.deviation == (deviation if deviation < 2**63 else None) and r.deviation_exact == (deviation if deviation < 10**38 else None)
        e = values[-r.component]
        assert abs(r.explained - e / trace) <= 1e-12 and r.identity_error < 1e-6
        want = float(sum(Fraction(c, n) * Fraction(float(u)) for c, u in zip(y, vectors[:, -r.component]))) / np.sqrt(e)
        assert abs(abs(r.whitened) - abs(want)) < 1e-6 * max(1, abs(want))


def test_residues_give_the_scatter_back():
    p = whitening.primes(2 * 10**60)
    rng = random.Random(1)
    want = [rng.randint(-(10**60), 10**60) for _ in range(200)] + [0, 1, -1, 10**60, -(10**60)]
    got = whitening.chinese_remainder([np.array([v % q for v in want], np.int64) for q in p], p)
    assert [int(v) for v in got] == want and len(set(p)) == len(p)


def test_whitening_of_few_or_equal_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], schema)).count() == 0
    two = whitening.whitened(spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [1.0]), (4, [2.0]), (5, [4.0])], schema)).collect()
    assert sorted((r.vec_id, r.component, r.n) for r in two) == [(1, 1, 2), (2, 1, 2), (3, 1, 3), (4, 1, 3), (5, 1, 3)]
    assert all(abs(abs(r.whitened) - 1) < 1e-12 for r in two if r.n == 2)


def test_whitening_of_wide_vectors(spark):
    """More entries than one row of cells; covariance against numpy."""
    x = np.random.default_rng(9).normal(size=(300, 70)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    grid = np.floor(256 * x.astype(float))
    values, vectors = np.linalg.eigh(np.cov(grid.T, bias=True))
    got = whitening.whitened(df).collect()
    assert len(got) == 1200
    for r in got[::7]:
        want = (grid[r.vec_id] - grid.mean(axis=0)) @ vectors[:, -r.component] / np.sqrt(values[-r.component])
        assert abs(abs(r.whitened) - abs(want)) < 1e-9 and abs(r.explained - values[-r.component] / values.sum()) < 1e-12


# periodic runs


def brute_runs(w, min_length=24, min_exponent=3):
    n, out = len(w), set()
    for q in range(1, n + 1):
        for i in range(n - q + 1):
            if i and i - 1 + q < n and w[i - 1] == w[i - 1 + q]:
                continue
            e = i + q
            while e < n and w[e] == w[e - q]:
                e += 1
            s = w[i:e]
            if len(s) >= max(min_length, min_exponent * q) and next(p for p in range(1, len(s) + 1) if s[p:] == s[: len(s) - p]) == q:
                out.add((i, len(s), q))
    return out


def brute_words(doc_id, text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def brute_row(doc_id, text):
    words = brute_words(doc_id, text)
    runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept)]
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *sha)


@pytest.mark.parametrize(("min_length", "min_exponent"), [(24, 3), (6, 2), (1, 2), (10, 4)])
def test_scan_is_brute_force(min_length, min_exponent):
    rng, seen = random.Random(3), 0
    for _ in range(300):
        letters = rng.choice([1, 2, 3, 30])
        w = [rng.randrange(letters) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            u, r, at = [rng.randrange(letters) for _ in range(rng.randint(1, 12))], rng.randint(2, 9), rng.randint(0, len(w))
            w[at:at] = (u * r)[: rng.randint(1, len(u) * r)]
        want, parts = brute_runs(w, min_length, min_exponent), rng.randint(1, 5)
        ranges = [periodic.lag_range(len(w), i, parts, min_exponent) for i in range(parts)]
        got = [r for lags in ranges for r in periodic.scan(np.array(w, np.int32), lags, min_length, min_exponent)]
        assert len(got) == len(want) and set(got) == want
        seen += len(want)
    assert seen > 100


def test_scan_of_long_rows():
    one = np.zeros(100_000, np.int32)
    assert periodic.scan(one, periodic.lag_range(len(one), 0, 1)) == [(0, 100_000, 1)]
    block = np.random.default_rng(1).integers(0, 50, 999).astype(np.int32)
    rows = np.concatenate([[99], np.tile(block, 100), [98]]).astype(np.int32)
    found = {r for i in range(7) for r in periodic.scan(rows, periodic.lag_range(len(rows), i, 7))}
    assert found == {(1, 99_900, 999)}


def run_rows():
    rng = random.Random(8)
    rows = texts() + [(i, " ".join(rng.choice(["x", "y", "zé", "漢"]) for _ in range(rng.randint(0, 90)))) for i in range(400, 460)]
    rows += [(470, "a b c\u0085 " * 12), (471, "go " * 23), (472, "go " * 24), (473, "a b c " * 8 + "\x1f"), (None, "u v " * 30)]
    return [(i, t) for i, t in rows if not t or len(t) < 4000] + [(480, "one two three " * 200)]


@pytest.mark.parametrize("part_bytes", [1 << 20, 100])
def test_runs_query(spark, part_bytes):
    """Whole texts, and texts dealt as ranges of lags."""
    rows = run_rows()
    frame = spark.createDataFrame([(i, t, 3, "x", "y") for i, t in rows], "doc_id long, text string, start int, runs string, sha string").repartition(3)
    got = periodic.run_digests(periodic.periodic_runs(frame, edit=periodic.planted, part_bytes=part_bytes)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(brute_row(i, t) for i, t in rows)


def test_runs_of_nothing(empty):  # noqa: F811
    assert periodic.periodic_runs(empty).count() == 0
    with pytest.raises(ValueError, match="min_exponent"):
        periodic.periodic_runs(empty, min_exponent=1)


def test_runs_on_the_table(spark, sf_dir):
    got = {r.doc_id: tuple(r) for r in queries.op13_periodic_runs(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows) and sum(r[1] for r in got.values()) > 0
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 10 == 0 and len(r.text or "") < 3000:
            assert got[r.doc_id] == brute_row(r.doc_id, r.text)
