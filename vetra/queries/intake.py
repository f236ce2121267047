"""Image files, releases and history: what comes in and what is kept."""

from __future__ import annotations

from pyspark.sql import functions as F

from vetra.functions import rasters as R
from vetra.operators import publishing as P
from vetra.plans.session import shared_path
from vetra.queries.base import E_SQL, P_SQL, canvases, embeddings, query
from vetra.sources import images as I
from vetra.sources import store
from vetra.sources.tables import read
from vetra.streaming import history as H


def _pgm(cells, height: int, width: int):
    """Cells as the bytes of a PGM file."""
    body = F.array_join(F.transform(cells, lambda x: F.lpad(F.hex(x.cast("int")), 2, "0")), "")
    return F.concat(F.lit(f"P5\n{width} {height}\n255\n").cast("binary"), F.unhex(body))


_BYTES = "unhex(array_to_string([printf('%02x', x::INT) FOR x IN c], ''))"


@query(f"""WITH {P_SQL}, k AS (SELECT vec_id, {_BYTES} AS pixels, CASE vec_id % 11 WHEN 3 THEN 'truncated or corrupted' WHEN 5 THEN 'unsupported format GIF'
        WHEN 7 THEN 'not a readable image' WHEN 9 THEN 'empty' WHEN 10 THEN 'no reader for JPEG' END AS error FROM p)
    SELECT vec_id, CASE WHEN error IS NULL THEN 'PGM' END AS format, CASE WHEN error IS NULL THEN 8 END AS height, CASE WHEN error IS NULL THEN 8 END AS width,
        CASE WHEN error IS NULL THEN sha256(pixels) END AS pixels_sha256, error FROM k""")
def image_decode(spark, sf_dir):
    """Every canvas as a file; some are cut short, of other formats, of none, or empty, and give rows with errors."""
    whole, kind = _pgm(F.col("c"), 8, 8), F.col("vec_id") % 11
    content = F.when(kind == 3, F.expr("substring(b, 1, 40)")).when(kind == 5, F.concat(F.lit("GIF89a").cast("binary"), "b")).when(kind == 7, F.concat(F.lit("%PDF").cast("binary"), "b"))
    content = content.when(kind == 9, F.lit(None)).when(kind == 10, F.concat(F.unhex(F.lit("FFD8FF")), "b")).otherwise(F.col("b"))
    files = canvases(spark, sf_dir).select("vec_id", whole.alias("b")).select("vec_id", content.alias("content"))
    return I.decode_images(files).select("vec_id", "format", "height", "width", F.sha2("pixels", 256).alias("pixels_sha256"), "error")


def _matrix_sql(n: int, m: int) -> str:
    places, weight = R.cubic_taps(n, m)
    rows = [[sum(float(w) for p, w in zip(ps, ws) if p == k) for k in range(n)] for ps, ws in zip(places, weight)]
    return "[" + ", ".join("[" + ", ".join(f"{v!r}::DOUBLE" for v in row) + "]" for row in rows) + "]"


def _bytes_sql(x: str) -> str:
    return f"least(greatest(floor(round({x}, 6) + 0.5), 0), 255)"


@query(f"""WITH {P_SQL}, a AS (SELECT vec_id, [{_bytes_sql(f"list_sum([c[8 * (s // 12) + k + 1] * ({_matrix_sql(8, 12)})[s % 12 + 1][k + 1] FOR k IN range(8)])")} FOR s IN range(48)] AS t FROM p),
    b AS (SELECT vec_id, [{_bytes_sql(f"list_sum([t[12 * k + s % 12 + 1] * ({_matrix_sql(4, 6)})[s // 12 + 1][k + 1] FOR k IN range(4)])")} FOR s IN range(72)] AS w FROM a)
    SELECT vec_id, 6 AS height, 12 AS width, list_sum(w)::DOUBLE AS total, w[1]::DOUBLE AS first, w[72]::DOUBLE AS last FROM b""")
def image_canvas(spark, sf_dir):
    """The upper half of each canvas, 4 x 8, as a file, decoded and resized to a short side of 6."""
    files = canvases(spark, sf_dir).select("vec_id", _pgm(F.slice("c", 1, 32), 4, 8).alias("content"))
    made = I.analysis_canvas(I.decode_images(files), 6)
    total = F.aggregate("canvas", F.lit(0.0), lambda a, x: a + x)
    return made.select("vec_id", F.col("canvas_height").alias("height"), F.col("canvas_width").alias("width"), total.alias("total"), F.get("canvas", F.lit(0)).alias("first"), F.get("canvas", F.lit(71)).alias("last"))


@query(f"WITH {E_SQL} SELECT label, count(*) AS rows, round(sum(v[1]), 6) AS first, '2' AS version FROM e GROUP BY label")
def published_library(spark, sf_dir):
    """The library published twice, read through the pointer: what the second release holds."""
    root = shared_path(spark, "library")
    rows = embeddings(spark, sf_dir)
    for version, kept in (("1", rows.filter("label < 3")), ("2", rows)):
        write = lambda path, kept=kept, version=version: store.save_artifact(kept, path, version, "canvas")
        P.publish(spark, root, version, {"index": write}, lambda at: store.load_artifact(spark, f"{at}/index", "canvas"))
    found, document = store.load_artifact(spark, f"{P.current(spark, root)}/artifacts/index", "canvas")
    return found.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum(F.col("v")[0]), 6).alias("first")).withColumn("version", F.lit(document["version"]))


@query("""SELECT '2024-02-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') AS day, lang AS decision_status, count(*) AS analyses, count(DISTINCT doc_id) AS ids FROM documents GROUP BY ALL""")
def history_append(spark, sf_dir):
    """Analyses appended in two batches, each of them twice, as after a crash."""
    path = shared_path(spark, "history")
    day = F.concat(F.lit("2024-02-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"))
    rows = read(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.concat(day, F.lit("T00:00:00Z")).alias("created_at"), F.col("source").alias("filename"), F.col("lang").alias("decision_status"),
        F.lit(None).cast("string").alias("predicted_class"), F.lit(None).cast("double").alias("confidence"), F.lit("{}").alias("result_json"), "doc_id",
    )
    for batch in (0, 1, 0, 1):
        H.append_batch(rows.filter(F.col("doc_id") % 2 == batch), batch, path)
    return H.read_history(spark, path).groupBy("day", "decision_status").agg(F.count(F.lit(1)).alias("analyses"), F.count_distinct("id").alias("ids"))
