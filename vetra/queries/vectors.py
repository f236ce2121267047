"""Vector and pixel operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from vetra.functions import canvas as C
from vetra.functions import vectors as V
from vetra.queries.base import E_SQL, P_SQL, canvases, embeddings, query


def _spread(df, value, *keys):
    """One row an element: keys, pos, value."""
    return df.select(*keys, F.posexplode(value).alias("pos", "x")).select(*keys, "pos", F.round("x", 8).alias("value"))


def _spread_sql(source: str, value: str, keys: str = "vec_id") -> str:
    return f"SELECT {keys}, (i - 1)::INT AS pos, round(x[i], 8) AS value FROM (SELECT {keys}, {value} AS x FROM {source}), unnest(range(1, len(x) + 1)) AS u(i)"


def _unit(x: str) -> str:
    return f"[y / greatest(sqrt(list_inner_product({x}, {x})), 1e-12::DOUBLE) FOR y IN {x}]"


@query(f"WITH {E_SQL} {_spread_sql('e', _unit('v'))}")
def l2_normalize(spark, sf_dir):
    return _spread(embeddings(spark, sf_dir), V.l2_normalize(F.col("v")), "vec_id")


_A, _B = "v[1:16]", "v[17:32]"
_CAT = f"WITH {E_SQL}, c AS (SELECT vec_id, list_concat({{}}) AS w FROM e) {_spread_sql('c', _unit('w'))}"


@query(_CAT.format(f"{_unit(_A)}, {_unit(_B)}"))
def concat_normalised(spark, sf_dir):
    return _spread(embeddings(spark, sf_dir), V.concat_normalised(F.slice("v", 1, 16), F.slice("v", 17, 16)), "vec_id")


def _tokens(spark, sf_dir):
    """The 64 components as tokens of width 16: the class token, the patch mean, and four layers."""
    block = lambda k: F.slice("v", 16 * k + 1, 16)
    return embeddings(spark, sf_dir).select("vec_id", block(3).alias("cls"), block(0).alias("patch_mean"), F.array(*[block(k) for k in range(4)]).alias("cls_layers"))


def _pooling(strategy):
    def run(spark, sf_dir):
        return _spread(_tokens(spark, sf_dir), V.pool(strategy, F.col("cls"), F.col("patch_mean"), F.col("cls_layers")), "vec_id")

    run.__name__ = f"pooling_{strategy}"
    return run


_BLOCK = [f"v[{16 * k + 1}:{16 * k + 16}]" for k in range(4)]
for _name, _parts in {"cls": [3], "cls_patchmean": [3, 0], "cls_last4": [0, 1, 2, 3], "cls_last4_patchmean": [0, 1, 2, 3, 0]}.items():
    _joined = _unit(_BLOCK[_parts[0]])
    for _p in _parts[1:]:
        _joined = f"list_concat({_joined}, {_unit(_BLOCK[_p])})"
    query(f"WITH {E_SQL}, c AS (SELECT vec_id, {_joined} AS w FROM e) {_spread_sql('c', _unit('w'))}")(_pooling(_name))


@query(f"""WITH {E_SQL}, m AS (SELECT vec_id, [(v[i] + v[i + 16] + v[i + 32] + v[i + 48]) / 4 FOR i IN range(1, 17)] AS w FROM e)
    {_spread_sql('m', _unit('w'))}""")
def view_average(spark, sf_dir):
    """Four views of width 16 for each vector, averaged and normalised."""
    views = embeddings(spark, sf_dir).select("vec_id", F.array(*[F.slice("v", 16 * k + 1, 16) for k in range(4)]).alias("views"))
    width = F.size(F.col("views")[0])
    average = F.transform(F.sequence(F.lit(0), width - 1), lambda i: V.total(F.transform("views", lambda w: F.get(w, i))) / F.size("views"))
    return _spread(views, V.l2_normalize(average), "vec_id")


@query(f"""WITH {E_SQL} SELECT k::INT AS view, vec_id, label, round(v[16 * k + 1], 8) AS first, 'v' || k || '-' || vec_id AS row_key
    FROM e, range(4) AS r(k) WHERE label < 6""")
def training_rows(spark, sf_dir):
    """Views as rows, each with its image's label."""
    views = F.posexplode(F.array(*[F.slice("v", 16 * k + 1, 16) for k in range(4)])).alias("view", "w")
    rows = embeddings(spark, sf_dir).filter("label < 6").select("vec_id", "label", views)
    return rows.select("view", "vec_id", "label", F.round(F.col("w")[0], 8).alias("first"), F.concat(F.lit("v"), F.col("view").cast("string"), F.lit("-"), F.col("vec_id").cast("string")).alias("row_key"))


@query(f"WITH {P_SQL} SELECT vec_id, view::INT AS view, c[place + 1] AS corner, c[place2 + 1] AS near FROM p JOIN (VALUES "
       + ", ".join(f"({k}, {places[0]}, {places[10]})" for k, places in enumerate(C.dihedral_places(8))) + ") AS d(view, place, place2) ON true")
def dihedral_views(spark, sf_dir):
    views = F.array(*[C.take(F.col("c"), places) for places in C.dihedral_places(8)])
    return canvases(spark, sf_dir).select("vec_id", F.posexplode(views).alias("view", "w")).select("vec_id", "view", F.col("w")[0].alias("corner"), F.col("w")[10].alias("near"))


def _laplacian_sql(canvas: str, rows: int, cols: int) -> str:
    up, down, left, right = ([f"[{', '.join(str(v + 1) for v in p)}]" for p in C.laplacian_places(rows, cols)])
    return f"[{canvas}[({up})[i]] + {canvas}[({down})[i]] + {canvas}[({left})[i]] + {canvas}[({right})[i]] - 4 * {canvas}[i] FOR i IN range(1, {rows * cols + 1})]"


@query(f"WITH {P_SQL}, l AS (SELECT vec_id, {_laplacian_sql('c', 8, 8)} AS w FROM p) SELECT vec_id, round(list_var_pop(w), 6) AS sharpness FROM l")
def laplacian_variance(spark, sf_dir):
    return canvases(spark, sf_dir).select("vec_id", F.round(C.laplacian_variance(F.col("c"), 8, 8), 6).alias("sharpness"))


def _tile_sql(k: int) -> str:
    places, h, w = C.tiles(8, 8, 3)[k]
    cut = f"[c[q] FOR q IN [{', '.join(str(v + 1) for v in places)}]]"
    return f"SELECT vec_id, {k} AS tile, {_laplacian_sql('t', h, w)} AS w FROM (SELECT vec_id, {cut} AS t FROM p)"


@query(f"WITH {P_SQL}, l AS ({' UNION ALL '.join(_tile_sql(k) for k in range(9))}) SELECT vec_id, tile, round(list_var_pop(w), 6) AS sharpness FROM l")
def tile_sharpness(spark, sf_dir):
    """Three by three tiles of 3, 3 and 2 cells a side."""
    tiles = canvases(spark, sf_dir).select("vec_id", F.posexplode(C.tile_sharpness(F.col("c"), 8, 8, 3)).alias("tile", "s"))
    return tiles.select("vec_id", "tile", F.round("s", 6).alias("sharpness"))


@query(f"WITH {P_SQL} SELECT vec_id, round(list_sum(c) / 64 / 255, 8) AS brightness, len([x FOR x IN c IF x = 0 OR x = 255])::DOUBLE / 64 AS clipped_fraction FROM p")
def brightness_clipped(spark, sf_dir):
    return canvases(spark, sf_dir).select("vec_id", F.round(C.brightness(F.col("c")), 8).alias("brightness"), C.clipped_fraction(F.col("c")).alias("clipped_fraction"))


@query(f"""WITH {P_SQL}, l AS ({' UNION ALL '.join(_tile_sql(k) for k in range(9))})
    SELECT vec_id, count(*) FILTER (round(list_var_pop(w), 6) >= 9000)::DOUBLE / count(*) AS detail_coverage FROM l GROUP BY vec_id""")
def detail_coverage(spark, sf_dir):
    sharp = F.transform(C.tile_sharpness(F.col("c"), 8, 8, 3), lambda x: F.round(x, 6))
    return canvases(spark, sf_dir).select("vec_id", C.coverage(sharp, F.lit(9000.0)).alias("detail_coverage"))


@query(f"""WITH {P_SQL}, s AS (SELECT vec_id, [[list_sum(c[1:32]) / 32, c[greatest(q, 0) + 1]][(q >= 0)::INT + 1]
        FOR q IN [{', '.join(map(str, C.pad_places(4, 8)))}]] AS w FROM p)
    SELECT vec_id, len(w)::INT AS cells, round(w[1], 8) AS corner, round(w[17], 8) AS first_inside, round(list_sum(w), 6) AS total FROM s""")
def pad_to_square(spark, sf_dir):
    """The upper half of the canvas, 4 x 8, centred in a square of its mean."""
    w = C.pad_to_square(F.slice("c", 1, 32), 4, 8)
    rows = canvases(spark, sf_dir).select("vec_id", w.alias("w"))
    return rows.select("vec_id", F.size("w").alias("cells"), F.round(F.col("w")[0], 8).alias("corner"), F.round(F.col("w")[16], 8).alias("first_inside"), F.round(V.total(F.col("w")), 6).alias("total"))


def _phash_sql() -> str:
    rows = [", ".join(f"{v!r}::DOUBLE" for v in C.dct_row(8, k)) for k in range(4)]
    m = "[" + ", ".join(f"[{r}]" for r in rows) + "]"
    coefficient = f"list_sum([c[j + 1] * ({m})[s // 4 + 1][j // 8 + 1] * ({m})[s % 4 + 1][j % 8 + 1] FOR j IN range(64)])"
    return f"""WITH {P_SQL}, f AS (SELECT vec_id, [round({coefficient}, 6) FOR s IN range(16)] AS w FROM p)
        SELECT vec_id, list_sum([(w[s + 1] > list_median(w[2:16]))::BIGINT << (15 - s) FOR s IN range(16)])::BIGINT AS phash FROM f"""


def phash(canvas):
    """16-bit hash of an 8 x 8 canvas."""
    low = F.transform(C.phash_bits(canvas, 8, 4), lambda x: F.round(x, 6))
    middle = lambda w: F.element_at(F.array_sort(F.slice(w, 2, 15)), 8)
    return V.let(low, lambda w: V.let(middle(w), lambda m: C.bits_to_long(F.transform(w, lambda x: x > m))))


@query(_phash_sql())
def phash_embeddings(spark, sf_dir):
    return canvases(spark, sf_dir).select("vec_id", phash(F.col("c")).alias("phash"))


@query("""SELECT doc_id, CASE WHEN n_chars = 0 THEN 'empty' WHEN lang NOT IN ('en', 'fr', 'de') THEN 'unsupported format'
    WHEN n_chars > 5000 THEN 'too large' ELSE 'ok' END AS verdict,
    CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN 415 WHEN n_chars > 5000 THEN 413 WHEN n_chars = 0 THEN 422 ELSE 200 END AS code FROM documents""")
def upload_validation(spark, sf_dir):
    """Format, then size, then content; the language stands for a format, the length for a size."""
    from vetra.operators.release import upload_code
    from vetra.sources.tables import read

    docs = read(spark, sf_dir, "documents")
    verdict = F.when(F.col("n_chars") == 0, "empty").when(~F.col("lang").isin("en", "fr", "de"), "unsupported format").when(F.col("n_chars") > 5000, "too large").otherwise("ok")
    return docs.select("doc_id", verdict.alias("verdict"), upload_code(F.col("lang"), F.col("n_chars"), ["en", "fr", "de"], 5000).alias("code"))
