"""Driver-side artifacts, the step runner and streaming screening."""

import zipfile

import pytest

from vetra.operators import artifacts as A
from vetra.plans.runner import run_steps


def test_settings():
    s = A.EncoderSettings("e", "r1", 588, 4, "cls_last4")
    assert s.width(384) == 1536 and s.fingerprint == "e@r1/588px/4v/cls_last4"
    for bad in ({"views": 9}, {"input_size": 100}, {"pooling": "x"}):
        with pytest.raises(ValueError):
            A.EncoderSettings(**{"name": "e", "revision": "r", "input_size": 224} | bad)
    with pytest.raises(ValueError):
        A.SplitRatios(0.7, 0.2, 0.2)


def test_cache_serves_fewer_views():
    own = A.CacheKey(["a"], "r", 8, True)
    assert own.serves(A.CacheKey(["a"], "r", 4)) and not own.serves(A.CacheKey(["b"], "r", 4)) and not A.CacheKey(["a"], "r", 4).serves(own)
    assert A.encode_cost_ms(0.5, 4) == 2000


def test_archive_and_receipt(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("top/x/y.txt", "1")
    (made,) = A.extract(tmp_path / "a.zip", tmp_path / "out")
    assert made.endswith("out/x/y.txt")
    sha = A.sha256_file(made)
    assert not A.needs_download(made, sha, sha) and A.needs_download(tmp_path / "no", sha, None)
    with pytest.raises(ValueError):
        A.needs_download(made, "0", None)
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("top/../../../evil", "1")
    with pytest.raises(ValueError):
        A.extract(tmp_path / "b.zip", tmp_path / "out")


def test_steps_resume_and_stop():
    seen = []
    steps = {"a": lambda: seen.append("a"), "b": lambda: seen.append("b"), "c": lambda: 3}
    with pytest.raises(RuntimeError):
        run_steps(steps, "b")
    assert seen == ["b"]
    with pytest.raises(ValueError):
        run_steps(steps, "z")


def test_markdown():
    assert A.markdown_table([{"a": None, "b": 0.5}], ["a", "b"]).endswith("| – | 0.5 |")


def test_history_table(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS hist LOCATION '" + str(tmp_path / "db") + "'")
    A.create_history(spark, "hist.analyses")
    A.create_history(spark, "hist.analyses")
    rows = spark.createDataFrame([("1", "2024-05-01T10:00:00", "f", "PASS", "a", 0.5, "{}")], A.HISTORY)
    A.insert_analyses(rows, "hist.analyses")
    assert spark.table("hist.analyses").select("id", "day").first() == ("1", "2024-05-01")
    spark.sql("DROP DATABASE hist CASCADE")


def test_stream_decides_as_batch(spark, sf_dir, tmp_path):
    from vetra.queries import screening as Q
    from vetra.streaming.screening import screen_stream, write_decisions

    at = str(tmp_path / "in")
    Q.samples(spark, sf_dir).limit(60).write.parquet(at)
    stream = spark.readStream.schema(spark.read.parquet(at).schema).parquet(at)
    chain = screen_stream(stream, Q.references(spark, sf_dir), Q.weights(spark, sf_dir), Q.CAL, Q.POL)
    write_decisions(chain, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r.vec_id: r.decision for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == 60 and got == {r.vec_id: r.decision for r in Q.screened(spark, sf_dir).collect() if r.vec_id in got}
