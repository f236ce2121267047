"""Operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns, against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vetra.llm import components, exactdedup, langid, licenses, mixing, neighbours, ngramlm, packing, simhash, substring, tokencount

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, digest string, count long, mix_kept string, leaf int, bucket int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rng = random.Random(5)
    some = ["the", "of", "Unter", "licencia", "mit", "été", "x", "zu", "house", "é b", "漢字"] + [f"w{i}" for i in range(40)]
    passage = " ".join(rng.choice(some) for _ in range(30))
    rows = [(i, " ".join(rng.choice(some) for _ in range(rng.randint(1, 60)))) for i in range(60)]
    rows += [(100 + i, f"start {i} {passage} end {i}") for i in range(12)] + [(200 + i, passage) for i in range(6)]
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "The  the\n\nTHE"), (304, "the  the\n\nthe"), (305, "!!!"), (306, "<s> </s> <|endoftext|> <unk>")]
    rows += [(307, "word " * 6000), (308, "a" * 5000), (309, "Released under the MIT License. CC BY-NC cc by nc"), (None, passage), (None, "lone null id"), (200, passage), (5, "same id, other text " * 3)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if (i or 0) % 3 else None, "src1", 1, True, "d", 7, "k", 1, 2) for i, t in texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    want = collections.Counter()
    for i, t in texts():
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        first = (len(ids) - 1) % 512 + 1
        cuts = [0, *range(first, len(ids) + 1, 512)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(i, p, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    rows = packing.pack_documents(docs, path, capacity=512, per_partition=40).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 512
    sizes = collections.Counter(k[3] for k in want.elements())
    assert packing.lower_bound([*sizes], [*sizes.values()], 512) <= len(by) <= packing.lower_bound([*sizes], [*sizes.values()], 512) + 1
    # every partition's or pool's certificate is that of the sequences it packed
    parts = collections.defaultdict(set)
    for r in rows:
        parts[r.sequence_id >> 32].add((r.sequence_id, r.part_bins, r.part_bound))
    assert len(parts) > 1
    for own in parts.values():
        assert len({x[1:] for x in own}) == 1 and len(own) == (some := next(iter(own)))[1] >= some[2] > 0
    assert {(r.all_bins, r.all_bound) for r in rows} == {(len(by), packing.lower_bound([*sizes], [*sizes.values()], 512))}
    assert packing.pack_documents(empty, path).count() == 0


def test_partitions_exchange_until_the_bound(spark):
    """Partitions of their own leave many bins too many; what they offer fills up."""
    rng = np.random.default_rng(7)
    rows = [(i, 0, 0, int(n), i) for i, n in enumerate(rng.integers(1, 1000, 3000))]
    pieces = spark.createDataFrame(rows, packing.PIECES).cache()
    alone = packing.pack_pieces(pieces, 1000, per_partition=60, rounds=0)[1]
    packed, sure = packing.pack_pieces(pieces, 1000, per_partition=60)
    assert alone["bins"] > sure["bins"] + 40 and sure["rounds"] > 0 and sure["bins"] <= 1.03 * sure["bound"]
    assert packed.select("sequence_id").distinct().count() == sure["bins"] and packed.count() == 3000


@pytest.mark.parametrize("text", [" " * 1_200_000, " \n" * 300_000, ("x" + " " * 3_000) * 40, "word " * 400_000])
def test_packing_of_very_long_texts(text):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing._encoder(path)(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_lower_bound_is_reached_and_tight():
    assert packing.lower_bound([51], [10], 100) == 10 and packing.lower_bound([34, 66], [4, 4], 100) == 4
    assert packing.lower_bound([34], [9], 100) == 5  # two to a bin
    rng = np.random.default_rng(1)
    for _ in range(30):
        own = np.sort(rng.integers(1, 101, 60))[::-1]
        assert packing.lower_bound(*np.unique(own, return_counts=True), 100) <= len(packing.best_fit_decreasing(own, 100)[2])


def test_exact_dedup(docs, empty):
    low = [(i, (t or "").translate(LOWER)) for i, t in texts()]
    keep, size = {}, collections.Counter(t for _, t in low)
    for i, t in low:
        keep[t] = max((x for x in (keep.get(t), i) if x is not None), default=None)
    want = sorted(((i, keep[t], size[t], i == keep[t] if keep[t] is not None else True, hashlib.sha256(t.encode()).hexdigest()) for i, t in low), key=str)
    got = sorted((tuple(bool(x) if k == 3 else x for k, x in enumerate(r)) for r in exactdedup.dedup_classes(docs).collect()), key=str)
    assert got == [tuple(False if k == 3 and r[0] is None and r[1] is not None else x for k, x in enumerate(r)) for r in want]
    assert exactdedup.dedup_classes(empty).count() == 0


def test_exact_dedup_tells_clashing_digests_apart(docs):
    weak = exactdedup.exact_dedup(docs.select("doc_id", "text"), lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, 1))
    sure = exactdedup.exact_dedup(docs.select("doc_id", "text"))
    pick = lambda df: sorted(map(str, df.select("doc_id", "text", "keep_id", "group_size").collect()))
    assert pick(weak) == pick(sure)


def test_stream_goes_on_from_kept_state(spark, tmp_path):
    at, state = str(tmp_path / "in"), str(tmp_path / "state")
    for part in ([("a", 1), ("b", 2)], [("a", 3)]):
        spark.createDataFrame([(d, i, "f") for d, i in part], "digest string, doc_id long, locator string").write.mode("append").parquet(at)
        stream = spark.readStream.schema("digest string, doc_id long, locator string").parquet(at)
        out = exactdedup.stream_state(spark, stream, state)
    assert {(r.digest, r.keep_id, r.group_size) for r in out.collect()} == {("a", 3, 2), ("b", 2, 1)}


def test_batches_are_held_against_the_store(spark, tmp_path):
    """A second batch meets the first through the kept state, and its bytes through the locator."""
    store = "file://" + str(tmp_path / "store")
    batches = [[(1, "Same text"), (2, "other"), (3, "gone")], [(7, "same TEXT"), (8, "new"), (2, "Other")], [(4, "SAME text")]]
    got = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/in{k}")
        out = exactdedup.exact_dedup(spark.read.parquet(f"{tmp_path}/in{k}"), store=store)
        got.append({(r.doc_id, r.keep_id, r.group_size, r.kept) for r in out.collect()})
    assert got == [{(1, 1, 1, True), (2, 2, 1, True), (3, 3, 1, True)}, {(7, 7, 2, True), (8, 8, 1, True), (2, 2, 2, True)}, {(4, 7, 3, False)}]


@pytest.mark.parametrize("ids", [(1, 2, 3, 4, 5, 6), (6, 5, 4, 3, 2, 1), (2, 6, 1, 5, 3, 4)])
def test_texts_of_one_digest_are_told_apart_over_batches(spark, tmp_path, ids):
    """Every text has the same digest here: only the bytes behind the locators tell them apart, whichever id is the larger."""
    one = lambda t: F.lit("d")
    store, texts_of, so_far = "file://" + str(tmp_path / "store"), ["alpha", "beta", "Alpha", "gamma", "beta", "alpha"], []
    for k, rows in enumerate([[(i, t)] for i, t in zip(ids, texts_of)] + [[(7, "BETA"), (8, "delta"), (9, "delta")]]):
        so_far += rows
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/in{k}")
        out = exactdedup.exact_dedup(spark.read.parquet(f"{tmp_path}/in{k}"), one, store).collect()
        for i, t in rows:
            group = [j for j, u in so_far if u.lower() == t.lower()]
            assert (i, max(group), len(group), i == max(group)) in {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in out}
        assert len(out) == len(rows)


@pytest.mark.parametrize("most", [500_000, 0])
def test_a_hot_digest_is_salted(spark, monkeypatch, most):
    """Digests met again are broadcast up to a number, and shuffled with salts beyond it."""
    monkeypatch.setattr(exactdedup, "MOST_BROADCAST", most)
    rows = [(i, "copy" if i % 3 else f"own {i}") for i in range(1500)]
    rows += [(None, "copy"), (None, "alone"), (5000, "x" * 2_000_000), (5001, "X" * 2_000_000)]
    got = exactdedup.dedup_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    size, keep = collections.Counter(t.lower() for _, t in rows), {}
    for i, t in rows:
        keep[t.lower()] = max((x for x in (keep.get(t.lower()), i) if x is not None), default=None)
    sha = lambda t: hashlib.sha256(t.lower().encode()).hexdigest()
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == collections.Counter((i, keep[t.lower()], size[t.lower()], sha(t)) for i, t in rows)


def test_token_counts(docs, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted(((i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t in texts()), key=str)
    assert sorted(map(tuple, tokencount.token_counts(docs, path).collect()), key=str) == want
    counter = tokencount.Counter(path)
    for t in ("\t\t a\n b   c", "a\r\n\tb", "😀 x😀", "   ", "▁x ▁", "a__b_", "x²y", "\x00"):
        assert counter.count(t) == len(sp.encode(t))
    assert tokencount.token_counts(empty, path).count() == 0


@pytest.mark.parametrize("text", ["a" * 300_000, "word " * 100_000, "漢字" * 60_000, " " * 200_000])
def test_token_counts_of_very_long_texts(text):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    assert tokencount.Counter(path).count(text) == len(sentencepiece.SentencePieceProcessor(model_file=path).encode(text))


def test_merge_count_takes_the_leftmost_of_equal_ranks():
    assert tokencount.merge_count("aaa", {"aa": 1}) == 1 and tokencount.merge_count("abab", {"ab": 2, "abab": 5, "ba": 1}) == 1


def test_language_id(spark, docs, empty, sf_dir):
    own = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.predicted_languages(own, 60).join(own.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) < 0.02 * len(rows)
    signs = langid.predicted_languages(own.select("doc_id", "text", "lang").limit(500).unionByName(spark.createDataFrame([(9001, "½ ²", None), (9002, "① Ⅷ ٣ 12", None), (9003, "_", None)], "doc_id long, text string, lang string")), 60)
    assert {(r.lang_pred, r.score) for r in signs.filter("doc_id > 9000").collect()} == {("und", 0.0)}
    odd = {r.doc_id: r for r in langid.predicted_languages(docs).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (300, 301, 302, 305)) and odd[1].lang_pred == "en"
    assert langid.predicted_languages(empty).count() == 0


@pytest.mark.parametrize("order", [2, 3, 4])
def test_kneser_ney_against_dictionaries(order):
    """Interpolated Kneser-Ney written out over strings: raw counts at the top and at word starts, continuation counts below."""
    rng = random.Random(order)
    samples = {k: [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(120))] for k, letters in {"a": "abcde", "b": "bcdefxyz"}.items()}
    models = langid.Models(samples, order)
    queries = ["abc", "xyz", "eeee", "q", "bad", "zq", *samples["a"][0].split()[:20]]
    loss, starts = models.losses(queries)
    for k, language in enumerate(models.languages):
        times = collections.Counter(samples[language][0].split())
        raw = [collections.Counter() for _ in range(order + 1)]  # n-grams as strings; the opening edge is never predicted
        for word, n in times.items():
            marked = f" {word} "
            for i in range(1, len(marked)):
                for size in range(1, min(order, i + 1) + 1):
                    raw[size][marked[i - size + 1 : i + 1]] += n
        count = [None] * (order + 1)
        for size in range(1, order + 1):
            if size == order:
                count[size] = dict(raw[size])
            else:
                before = collections.Counter(g[1:] for g in raw[size + 1])
                count[size] = {g: before[g] if not g.startswith(" ") or size == 1 else n for g, n in raw[size].items()}
        total, types, discount = [collections.Counter() for _ in count], [collections.Counter() for _ in count], [0.0] * (order + 1)
        for size in range(1, order + 1):
            for g, n in count[size].items():
                total[size][g[:-1]] += n
                types[size][g[:-1]] += 1
            n1, n2 = (sum(v == x for v in count[size].values()) for x in (1, 2))
            discount[size] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        alphabet = len(count[1]) + 1
        spread = discount[1] * types[1][""] / total[1][""] / alphabet

        def p(context, c):
            if not context:
                seen = count[1].get(c)
                return spread / 64 if seen is None else max(seen - discount[1], 0) / total[1][""] + spread
            size = len(context) + 1
            low = p(context[1:], c)
            if not total[size][context]:
                return low
            return max(count[size].get(context + c, 0) - discount[size], 0) / total[size][context] + discount[size] * types[size][context] / total[size][context] * low

        want = [-math.log2(p(f" {w} "[max(0, i - order + 1) : i], f" {w} "[i])) for w in queries for i in range(1, len(w) + 2)]
        assert np.allclose(loss[:, k], want, rtol=1e-4, atol=1e-4), language


def test_other_languages_are_rejected(spark):
    own = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    models = langid.fit(own)
    odd = ["Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему. " * 3, "幸福的家庭都是相似的,不幸的家庭各有各的不幸。" * 5, "xkqz wvvq zzxj qpwk bnmq xxcv " * 10, "kaikki onnelliset perheet ovat toistensa kaltaisia jokainen onneton perhe on onneton omalla tavallaan " * 3]
    rows = spark.createDataFrame(list(enumerate(odd + ["A" * 2_000_000])), "doc_id long, text string")
    got = sorted(langid.identify(rows, models).collect())
    assert all(r.rejected for r in got) and len(got) == 5
    assert langid.keep_identified(rows, models).count() == 0


def test_kneser_ney_sums_to_one():
    models = langid.Models({"a": ["abc abd bcd cab dab", "acb bad"], "b": ["xyz"]}, 3)
    for start in ("a", "ab", "q"):
        after = [np.exp2(-models.losses([start + c])[0][len(start)]) for c in "abcdxyz"]
        end = np.exp2(-models.losses([start])[0][len(start)])
        assert np.all(sum(after) + end <= 1.00001) and (sum(after) + end)[0] > 0.5


def test_mixing(docs, empty):
    targets = {"s": {"src1": 1.0}, "l": {"en": 0.5, "other": 0.5}}
    dims = {"s": F.col("source"), "l": F.col("lang")}
    rows = mixing.mix(docs, dims, targets, share=0.4, rounds=10).collect()
    assert len(rows) == len(texts()) and all(0 <= r.mix_probability <= 1 for r in rows)
    taken = collections.Counter()
    for r in rows:
        taken[r.mix_l] += r.mix_probability * r.mix_tokens
    assert sum(r.mix_tokens for r in rows) == sum(len(WORDS.findall(t or "")) for _, t in texts())
    assert taken["en"] + taken["other"] <= 0.41 * sum(r.mix_tokens for r in rows)
    assert mixing.mix(empty, dims, targets).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(1200)] + [(i, [1.0] * 16) for i in range(2000, 2300)]
    rows += [(400_000, None), (400_100, [0.0] * 16), (400_200, [1.0, None] * 8), (400_300, [float("nan")] * 16), (None, [1.0] * 16)]
    got = collections.defaultdict(list)
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    ids = np.array([i for i, v in rows[:1500]])
    x = np.array([v for _, v in rows[:1500]], np.float32).astype(float)
    assert set(got) == {i for i in ids.tolist() if i % 100 == 0}
    hits = []
    for q, own in got.items():
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        order = [ids[j] for j in np.lexsort((ids, d)) if ids[j] != q][:10]
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, 11)) and all(abs(s - d[ids == v][0]) < 1e-12 for _, v, s in own)
        hits.append(len({v for _, v, _ in own} & set(order)) / 10)
    assert np.mean(hits) >= 0.9
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_license_scan(docs, empty):
    by = sorted(licenses.license_scan(docs).collect(), key=str)
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = []
    for i, t in texts():
        w = pattern.findall((t or "").translate(LOWER))
        found = [(k, label) for p, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in found]
        want.append((i, len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))))
    assert sorted(map(str, ((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in by))) == sorted(map(str, want))
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels for r in by)
    assert licenses.license_scan(empty).count() == 0


def test_license_templates(spark):
    lines = ["noise " * 9 + "This work is licensed under the GNU General Public License, version 3. more", "gnu public version 3 general", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"]
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert [r.labels for r in sorted(licenses.license_scan(rows).collect())] == ["gpl-3", "", "mit"]


def test_license_labels_against_every_start():
    """The index finds what trying every template at every start finds."""
    vocabulary = {w for _, text, _ in licenses.TEMPLATES for w in text.encode().split()}
    rng, total = random.Random(4), 5000
    index = licenses.Index(licenses.TEMPLATES, {w: rng.randrange(1, 3000) if len(w) < 5 else rng.randrange(0, 60) for w in vocabulary}, total)

    def brute(words, slack=2, enough=0.6):
        found = {}
        for t, (label, own, phrases) in enumerate(index.templates):
            for start in range(-len(own) - slack, len(words) + slack):
                near = lambda i: words[max(0, start + i - slack) : max(0, start + i + slack + 1)]
                votes = sum(index.idf[w] for w, at in index.own_rare[t].items() if any(w in near(i) for i in at))
                if votes < enough * index.weight[t] - 1e-9:
                    continue
                region = words[max(0, start - slack) : start + len(own) + slack]
                if all(any(region[i : i + len(p)] == p for i in range(len(region))) for p in phrases):
                    share = sum(w in near(i) for i, w in enumerate(own)) / len(own)
                    if share >= enough:
                        found[label] = max(share, found.get(label, 0))
        return found

    some = sorted(vocabulary)
    seen = set()
    for k in range(120):
        words = rng.choices(some, k=rng.randrange(0, 30))
        for _ in range(rng.randrange(1, 3)):
            text = rng.choice(licenses.TEMPLATES)[1].encode().split()
            text = [rng.choice(some) if rng.random() < k / 400 else w for w in text if rng.random() > k / 1500]
            words += text + rng.choices(some, k=rng.randrange(0, 20))
        want = brute(words)
        assert index.match(words) == pytest.approx(want) and index.match(words, chunk=40) == pytest.approx(want)
        seen |= want.keys()
    assert len(seen) > 8


def test_license_scan_of_very_long_texts():
    index = licenses.Index(licenses.TEMPLATES, {w: 1 for _, text, _ in licenses.TEMPLATES for w in text.encode().split()}, 100)
    words = licenses.words_of(b"under the MIT license. " * 200_000)
    places = licenses.base_places(words, licenses.BASE)
    assert [p for p, _ in places] == list(range(0, 800_000, 4)) and index.match(words) == {"mit": 0.8}
    assert index.match(words + licenses.words_of(b"Released under the MIT License")) == {"mit": 1.0}
    assert index.match([b"unencumbered"] * 1_000_000) == {}


def test_substring(docs, empty):
    seen = {}
    split = [(2**63 - 1 if i is None else i, i, WORDS.findall(t or "")) for i, t in texts()]
    for key, _, w in split:
        for k in range(len(w) - 12):
            x = tuple(w[k : k + 13])
            seen[x] = min(seen.get(x, key), key)
    want = []
    for key, i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if seen[tuple(w[k : k + 13])] < key:
                gone[k : k + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert sorted(map(tuple, substring.substring_dedup(docs).collect()), key=str) == sorted(want, key=str)
    pieces = substring.frequent_pieces(substring._keyed(docs), 13, 2, 200)
    assert len(pieces) > 3 and (np.diff(pieces.astype(float)) > 0).all()
    assert substring.substring_dedup(empty).count() == 0


def test_frequent_pieces_come_last():
    rng = random.Random(2)
    words = [b"of", b"the"] * 50 + [b"w%d" % rng.randrange(40) for _ in range(400)]
    first, count, least = substring.super_kmers(words, np.array([len(words)]), 13, 2)
    assert count.sum() == len(words) - 12
    common = np.sort(np.unique(least)[:5])
    again, counts, later = substring.super_kmers(words, np.array([len(words)]), 13, 2, common)
    assert counts.sum() == count.sum() and np.isin(later, common).sum() == 0
    # windows of equal words have equal minimisers whatever is frequent
    by = {}
    for f, c, q in zip(again.tolist(), counts.tolist(), later.tolist()):
        for i in range(f, f + c):
            assert by.setdefault(tuple(words[i : i + 13]), q) == q


def test_substring_of_a_very_long_text(spark):
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(60))
    long = " ".join(rng.choice(("of the", "in a", "x%d" % rng.randrange(10**6))) for _ in range(300_000))
    rows = [(1, passage), (2, f"{long} {passage} end"), (3, None), (4, "")]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (60, 0), 2: (len(long.split()) + 61, 60), 3: (0, 0), 4: (0, 0)}


def test_lm_scores(docs, empty):
    out = ngramlm.lm_scores(docs, block_bytes=3000, shard_bytes=6000).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    split = [(i, WORDS.findall((t or "").translate(LOWER)) + [""]) for i, t in texts()]
    c, pair, triple, total, types = (collections.Counter() for _ in range(5))
    histories = lambda w: zip([None, "", *w[:-2]], ["", *w[:-1]], w)  # noqa: E731 - a first token has no longer context
    for i, w in split:
        if not held(i):
            c.update(w)
            pair.update((h, x) for _, h, x in histories(w))
            triple.update(((g, h), x) for g, h, x in histories(w) if g is not None)
    for counted in (pair, triple):
        for (h, _), n in counted.items():
            total[h] += n
            types[h] += 1
    n, v = sum(c.values()), len(c)
    uni = lambda x: (c[x] + 1) / (n + v + 1)
    over = lambda counted, h, x, low: (max(counted[h, x] - 0.75, 0) + 0.75 * types[h] * low) / total[h] if h in total else low
    p = lambda g, h, x: over(triple, (g, h), x, over(pair, h, x, uni(x)))
    want = [(i, held(i), len(w), sum(x in c for x in w), n, sum(math.log10(uni(x)) for x in w), sum(math.log10(p(*x)) for x in histories(w))) for i, w in split]
    assert len(out) == len(want)
    for a, b in zip(sorted(map(tuple, out), key=lambda r: (str(r[0]), r[2], r[5])), sorted(want, key=lambda r: (str(r[0]), r[2], r[5]))):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6], abs=2e-4 * b[2] + 1e-9)
    assert ngramlm.lm_scores(empty).count() == 0


@pytest.mark.parametrize("top,n", [(10, 300), (1000, 300), (10**12, 300), (50, 20_000), (2**40, 20_000), (1, 5), (7, 1)])
def test_elias_fano(top, n):
    rng = np.random.default_rng(2)
    values = np.sort(rng.integers(0, top, n))
    level = ngramlm.EliasFano(values, lambda a: a)
    assert (level.get(np.arange(n)) == values).all()
    wanted = np.concatenate([values, rng.integers(0, top + 5, 500)])
    place, found = level.successor(wanted)
    assert (place == np.searchsorted(values, wanted)).all() and (found == np.isin(wanted, values)).all()
    # bits are packed: about 2 + log2(top / n) a value, and samples of 64 bits each 512
    assert level.low.nbytes + level.high.nbytes <= n * (2 + max(0, math.log2(top / n)) + 1) / 8 + 160
    assert ngramlm.EliasFano(values[:0], lambda a: a).successor(wanted)[1].sum() == 0


def test_trie_levels():
    """Pointers enclose the successors of their context; unknown contexts and words give nothing."""
    first, second, count = np.array([2, 2, 5, 9]), np.array([1, 7, 7, 0]), np.array([3, 1, 2, 4])
    context, third, times = np.array([0, 0, 2]), np.array([4, 6, 6]), np.array([1, 2, 2])
    trie = ngramlm.Trie(first, second, count, context, third, times, 0.75)
    pointers = [trie.second[1].get(np.arange(4)).tolist(), trie.third[1].get(np.arange(5)).tolist()]
    assert pointers == [[0, 2, 3, 4], [0, 2, 2, 3, 3]]
    near, far, near3, far3 = (ngramlm._decode(x) for x in trie.query(np.array([2, 2, 3, 5, 9]), np.array([1, 8, 7, 7, 0]), np.array([0, 0, 1, 2, 3, 4]), np.array([6, 5, 6, 6, 6, 6])))
    close = lambda got, want: np.allclose(got, want, rtol=3e-4)
    assert close(near, [2.25 / 4, 0, 0, 1.25 / 2, 3.25 / 4]) and close(far, [1.5 / 4, 1.5 / 4, 0, 0.75 / 2, 0.75 / 4])
    assert close(near3, [1.25 / 3, 0, 0, 0, 1.25 / 2, 0]) and close(far3, [1.5 / 3, 1.5 / 3, 0, 0, 0.75 / 2, 0])


def components_of(fps, radius):
    ids, a = [*fps], np.array([*fps.values()], np.uint64)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a) <= radius).tolist():
            x, y = find(ids[i]), find(ids[j])
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(spark, docs, empty):
    import xxhash

    def brute(t):
        w = WORDS.findall((t or "").translate(LOWER))
        grams = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    # every row is a node of its own; null and repeated ids take part like any other
    fps = [(i, brute(t)) for i, t in texts()]
    root = components_of({k: f for k, (_, f) in enumerate(fps)}, 4)
    least = {}
    for k, (i, _) in enumerate(fps):
        least[root[k]] = min((x for x in (least.get(root[k]), i) if x is not None), default=None)
    want = collections.Counter((i, f"{f:016x}", least[root[k]]) for k, (i, f) in enumerate(fps))
    assert collections.Counter(map(tuple, simhash.simhash_components(docs).collect())) == want
    assert simhash.simhash_components(empty).count() == 0


def test_simhash_of_a_very_long_text():
    import xxhash

    words = [f"w{i % 977}" for i in range(400_000)]
    h = np.array([xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(len(words) - 3)], np.uint64)
    want = sum(1 << b for b in range(64) if int((h >> np.uint64(b) & np.uint64(1)).sum()) * 2 > len(h))
    assert simhash.fingerprint(" ".join(words).encode(), 4) == want


@pytest.mark.parametrize("radius,groups,per_shard,most", [(4, 3, 4_096, 50_000), (4, 3, 100, 50_000), (4, 3, 100, 60), (13, 7, 200, 50_000), (4, 5, 50, 60), (4, 2, 60, 10_000)])
def test_every_link_is_spanned(spark, radius, groups, per_shard, most):
    rng, found = random.Random(radius), set()
    for _ in range(250):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 3, 25])):
            x = base
            for _ in range(rng.randint(0, radius + 2)):
                x ^= 1 << rng.randrange(64)
            found.add(x)
    signed = np.array(sorted(found), np.uint64).view(np.int64).tolist()
    fps = spark.createDataFrame([(v, v) for v in signed], "w0 long, node long")
    links = simhash.near_links(fps, simhash.bit_groups(groups), radius // groups, radius, per_shard=per_shard, task_rows=500, most=most)
    roots = {r.node: r.root for r in components.connected_components(links).collect()}
    want = components_of({v: v & (2**64 - 1) for v in signed}, radius)
    assert {v: roots.get(v, v) for v in signed} == want


def test_vantage_point_tree():
    """Radii are medians of distances to a point of the data, and what lies within reach shares a leaf."""
    rng = np.random.default_rng(4)
    points = rng.integers(0, 2**21, 4_000, np.uint64)
    vantage, radius = tree = simhash.grow(points, 1, 5)
    assert set(vantage.tolist()) <= set(points.tolist()) and len(vantage) == 31 and (radius < simhash.WHOLE).all()
    leaf, who = simhash.visit(points, 1, tree)
    assert set(who.tolist()) == set(range(4_000)) and len(leaf) < 4 * len(points)
    assert np.bincount(leaf, minlength=32).max() < 0.25 * len(points)
    of = [set() for _ in points]
    for a, b in zip(leaf.tolist(), who.tolist()):
        of[b].add(a)
    for i in range(200):
        for j in np.flatnonzero(np.bitwise_count(points ^ points[i]) <= 1).tolist():
            assert of[i] & of[j]


def test_stars_have_the_components_of_the_links():
    rng = np.random.default_rng(1)
    for n, m in ((1, 0), (50, 30), (300, 290), (2000, 1999)):
        u, v = rng.integers(0, n, m), rng.integers(0, n, m)
        if m == 1999:  # a long chain in a random order
            order = rng.permutation(n)
            u, v = order[:-1], order[1:]
        root = list(range(n))
        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x
        for x, y in zip(u.tolist(), v.tolist()):
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
        got = dict(zip(*(x.tolist() for x in simhash.stars(u, v))))
        assert {i: got.get(i, i) for i in range(n)} == {i: find(i) for i in range(n)}


def test_a_crowd_of_equal_keys_is_walked():
    rng = np.random.default_rng(6)
    fp = rng.integers(0, 2**64, (900, 1), np.uint64)
    fp[300:] = fp[0] ^ (np.uint64(1) << rng.integers(0, 64, (600, 1)).astype(np.uint64))
    u, v = simhash.shard_links(fp, np.zeros(900, np.uint64), 1, 4)
    assert len(u) == len(v) >= len(np.unique(fp[300:])) and (np.bitwise_count(fp[u] ^ fp[v]) <= 4).all()


def test_lm_requests_are_dealt_by_one_sort():
    """Places by shard come from one sort; before, each shard scanned all places of a block, so a block's cost grew with the table."""
    where = np.random.default_rng(2).integers(0, 7, 500)
    places = ngramlm._by_shard(where, 9)
    assert all(places(s).tolist() == np.flatnonzero(where == s).tolist() for s in range(9))
    first, second, count = np.array([3, 1, 3, 1, 2]), np.array([0, 5, 0, 4, 9]), np.array([2, 1, 3, 0, 1])
    assert [x.tolist() for x in ngramlm._summed(first, second, count)] == [[1, 2, 3], [5, 9, 0], [1, 1, 5]]
    big = 1 << 40  # codes that don't fit 63 bits
    assert [x.tolist() for x in ngramlm._summed(first * big, second * big, count)] == [[big, 2 * big, 3 * big], [5 * big, 9 * big, 0], [1, 1, 5]]
