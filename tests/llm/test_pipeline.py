"""The corpus pipeline against brute force, stage by stage."""

import collections

import corpus_pipeline
from tests.llm.test_nearcopies import brute
from vetra.llm import mixing

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def run_stages(spark, sf_dir, path):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{name}")
        out.append((docs, docs := spark.read.parquet(f"{path}/{name}")))
    return out


def test_stages(spark, sf_dir, tmp_path):
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    first, exact, near, mix, packed = run_stages(spark, sf_dir, str(tmp_path))
    assert all(b.columns == columns for _, b in (first, exact, near, mix))
    assert first[1].count() >= 0.97 * first[0].count()

    by_text = collections.defaultdict(list)
    for r in exact[0].collect():
        by_text[r.text.lower()].append(r.doc_id)
    assert {r.doc_id for r in exact[1].collect()} == {max(v) for v in by_text.values()}

    want, _ = brute([(r.doc_id, r.text) for r in near[0].collect()])
    assert {r.doc_id for r in near[1].collect()} == {i for i, c in want.items() if i == c}

    decided = {r.doc_id for r in mixing.mixed_documents(mix[0], corpus_pipeline.SHARE).filter("kept").collect()}
    assert {r.doc_id for r in mix[1].collect()} == decided
    assert_packed(*packed)


def assert_packed(before, after):
    """Every token of every document once, gapless in sequences of at most 2048, and no more sequences than the bound asks for by much."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = after.collect()
    tokens, sequences = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        tokens[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    want = collections.Counter()
    for r in before.collect():
        want[r.doc_id] += len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1
    assert tokens == want
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 2048
    assert not rows or len(sequences) == rows[0].all_bins <= rows[0].all_bound + 1


def test_run_is_its_stages(spark, sf_dir, tmp_path):
    *_, (_, last) = run_stages(spark, sf_dir, str(tmp_path))
    assert collections.Counter(corpus_pipeline.run(spark, sf_dir).collect()) == collections.Counter(last.collect())


def odd_rows(spark, sf_dir):
    """``documents`` with nulls in every column, texts empty and without letters, repeated rows and ids, and a very long text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120)
    some = [r.text for r in docs.orderBy("doc_id").limit(30).collect()]
    rows = [(None, some[0], "en", "src1", 1), (None, some[1] + " more", None, None, None), (9001, None, "en", "src1", 0), (9002, "", "en", None, 0), (9003, " \t\n", None, "src2", 3), (9004, "12 !! 34", "fr", "src2", 8)]
    rows += [(9005, some[2], None, None, None), (9005, some[2], None, None, None), (9006, some[2].upper(), "en", "src9", 5), (9007, some[3] + " tail", "de", "elsewhere", 5), (9007, some[4], "it", "src3", 5)]
    rows += [(9008, " ".join(some) * 12, "en", "src4", 5)]
    return docs.unionByName(spark.createDataFrame(rows, docs.schema))


def test_stages_on_odd_rows(spark, sf_dir, tmp_path):
    from vetra.llm import langid

    odd_rows(spark, sf_dir).write.parquet(f"{tmp_path}/in/documents.parquet")
    first, exact, near, mix, packed = run_stages(spark, f"{tmp_path}/in", str(tmp_path))
    plain = lambda df: collections.Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect())

    models = langid.fit(first[0].filter(~langid.held_out(3, 1)))
    rejected = {t for t, r in zip((r.text for r in first[0].collect()), langid.identify(first[0], models).collect()) if r.rejected}
    assert {None, "", " \t\n", "12 !! 34"} <= rejected
    assert plain(first[1]) == collections.Counter({k: n for k, n in plain(first[0]).items() if k[1] not in rejected})

    low, keep = {k: k[1].translate(LOWER) for k in plain(exact[0])}, {}
    for k, t in low.items():
        keep[t] = max((x for x in (keep.get(t), k[0]) if x is not None), default=None)
    assert plain(exact[1]) == collections.Counter({k: n for k, n in plain(exact[0]).items() if k[0] == keep[low[k]]})

    rows = list(plain(near[0]))
    roots, _ = brute([(i, k[1]) for i, k in enumerate(rows)])
    least = {}
    for i, r in roots.items():
        least[r] = min((x for x in (least.get(r), rows[i][0]) if x is not None), default=None)
    gone = {rows[i][0] for i, r in roots.items() if rows[i][0] != least[r]} - {None}
    assert plain(near[1]) == collections.Counter({k: n for k, n in plain(near[0]).items() if k[0] not in gone})

    cells = mixing.mix(mix[0], mixing.document_dimensions(), mixing.TARGETS, corpus_pipeline.SHARE, whole=True)
    assert plain(mix[1]) == plain(cells.filter("mix_kept")) and cells.count() == mix[0].count()
    assert_packed(*packed)


def test_an_empty_table(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_other_columns_of_clashing_names(spark, sf_dir):
    """Each stage gives back the columns it got, whatever they are called."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    names = ["kept", "keep_id", "digest", "group_size", "salt", "component_id", "node", "mix_kept", "mix_tokens", "bucket", "leaf", "key", "rejected", "w0", "whole", "is_hot"]
    wide = docs.withColumns({n: F.lit(n) for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, sf_dir)
        assert out.columns == wide.columns, name
        assert all(r[n] == n for r in out.collect() for n in names), name
    assert corpus_pipeline.pack(spark, wide, sf_dir).select("doc_id").distinct().count() == 40


def test_oracles(spark, sf_dir):
    from tests.oracle import same
    from vetra.llm.queries import ORACLES, QUERIES

    for name, sql in ORACLES.items():
        same(spark, QUERIES[name], sql, sf_dir)


def test_classes_without_a_target_are_mixed_too(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") % 3 == 1, "it").otherwise(F.col("lang")))
    odd = odd.withColumn("source", F.when(F.col("doc_id") % 2 == 0, "new").otherwise(F.col("source")))
    kept = corpus_pipeline.mix_to_targets(spark, odd, sf_dir)
    assert {(r.doc_id % 3, r.doc_id % 2) for r in kept.collect()} == {(a, b) for a in range(3) for b in range(2)}
    rows = mixing.mix(odd, mixing.document_dimensions(), mixing.TARGETS, corpus_pipeline.SHARE, whole=True)
    assert rows.agg(F.min("mix_probability")).first()[0] > 0
