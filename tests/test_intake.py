"""Image bytes, their errors, encoders; publishing with a crash between its phases; history from a stream."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vetra.functions import canvas as C
from vetra.functions import rasters as R
from vetra.operators import publishing as P
from vetra.sources import images as I
from vetra.sources import store
from vetra.sources.store import ArtifactMismatch
from vetra.streaming import history as H


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(pixels, kinds=None, palette=None, depth=8, colour=None, head=None):
    """``pixels`` (height, width, channels) filtered by the given kinds, one after the other."""
    height, width, channels = pixels.shape
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[channels] if colour is None else colour
    rows, lines = pixels.reshape(height, -1).astype(int), []
    for y in range(height):
        kind = (kinds or [0])[y % len(kinds or [0])]
        row, up = rows[y], rows[y - 1] if y else np.zeros_like(rows[0])
        left = np.concatenate([np.zeros(channels, int), row[:-channels]])
        corner = np.concatenate([np.zeros(channels, int), up[:-channels]])
        p = left + up - corner
        near = [abs(p - left), abs(p - up), abs(p - corner)]
        paeth = np.where((near[0] <= near[1]) & (near[0] <= near[2]), left, np.where(near[1] <= near[2], up, corner))
        guess = [0, left, up, (left + up) // 2, paeth][kind]
        lines.append(bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes())
    head = head or struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)
    out = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head)
    if palette is not None:
        out += chunk(b"PLTE", palette.astype(np.uint8).tobytes())
    packed = zlib.compress(b"".join(lines))
    return out + chunk(b"IDAT", packed[:20]) + chunk(b"IDAT", packed[20:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_png_of_every_filter(channels):
    pixels = np.random.default_rng(channels).integers(0, 256, (11, 7, channels), dtype=np.uint8)
    assert np.array_equal(R.read_png(png(pixels, [0, 1, 2, 3, 4]), 1000), pixels)


def test_png_with_palette_and_few_bits():
    palette = np.array([[1, 2, 3], [9, 8, 7], [0, 0, 0]])
    places = np.array([[[0], [1]], [[2], [1]]], dtype=np.uint8)
    assert np.array_equal(R.read_png(png(places, palette=palette, colour=3), 100), palette[places[:, :, 0]])
    bits = png(np.array([[[0b10110000]]], dtype=np.uint8), head=struct.pack(">IIBBBBB", 5, 1, 1, 0, 0, 0, 0))
    assert R.read_png(bits, 100)[0, :, 0].tolist() == [255, 0, 255, 255, 0]


def test_bmp_and_pnm():
    pixels = np.random.default_rng(1).integers(0, 256, (3, 5, 3), dtype=np.uint8)
    lines = b"".join(row[:, ::-1].tobytes() + b"\0" for row in pixels[::-1])
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + len(lines), 0, 54, 40, 5, 3, 1, 24, 0, len(lines), 0, 0, 0, 0) + lines
    assert np.array_equal(R.read_bmp(bmp, 100), pixels)
    assert np.array_equal(R.read_pnm(b"P6 # note\n5 3\n# more\n255\n" + pixels.tobytes(), 100), pixels)
    assert R.decode(b"P5 2 1 15 \x0f\x01")[1].tolist() == [[255, 17]]


def whole():
    return png(np.full((4, 6, 3), 200, dtype=np.uint8))


BAD = {
    "empty": b"",
    "not a readable image": b"%PDF-1.7 no image",
    "unsupported format GIF": b"GIF89a....",
    "truncated or corrupted": whole()[: len(whole()) // 2],
    "no reader for JPEG": b"\xff\xd8\xff\xe0rest",
    "over 50000000 pixels": png(np.zeros((1, 1, 1), dtype=np.uint8), head=struct.pack(">IIBBBBB", 10_000, 5_001, 8, 0, 0, 0, 0)),
    "no pixels": b"P5 0 3 255 ",
}


@pytest.mark.parametrize("error", BAD)
def test_bad_images_say_why(error):
    with pytest.raises(R.BadImage) as e:
        R.decode(BAD[error])
    assert str(e.value) == error


def test_flipped_bytes_are_found():
    data = bytearray(whole())
    data[-20] ^= 1
    with pytest.raises(R.BadImage):
        R.decode(bytes(data))


def test_grey_keeps_luminance_and_the_input_ignores_colour():
    assert R.decode(whole())[1].tolist() == [[200] * 6] * 4
    plain = np.random.default_rng(2).integers(0, 256, (30, 40), dtype=np.uint8)
    assert np.array_equal(R.grey(np.repeat(plain[:, :, None], 3, axis=2)), plain)
    a = R.model_input(plain, 224)
    assert a.shape == (3, 224, 224) and a.dtype == np.float32
    assert np.allclose(a[0] * 0.229 + 0.485, a[1] * 0.224 + 0.456, atol=1e-5)
    with pytest.raises(ValueError, match="multiple"):
        R.model_input(plain, 300)


def test_padding_keeps_all():
    square = R.pad_to_square(np.full((10, 30), 90, dtype=np.uint8))
    assert square.shape == (30, 30) and (square == 90).all()
    tall = np.arange(6, dtype=np.uint8).reshape(3, 2)
    assert np.array_equal(R.pad_to_square(tall)[:, :2], tall)


@pytest.mark.parametrize(("n", "m"), [(5, 5), (4, 9), (31, 7), (1, 3), (3, 1)])
def test_resizing_is_the_filter_cell_by_cell(n, m):
    def kernel(x):
        x = abs(x)
        return 1.5 * x**3 - 2.5 * x**2 + 1 if x < 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0

    places, weight = R.cubic_taps(n, m)
    got = np.zeros((m, n))
    np.add.at(got, (np.arange(m)[:, None], places), weight)
    wide = max(n / m, 1)
    want = np.array([[kernel((k + 0.5 - (i + 0.5) * n / m) / wide) for k in range(n)] for i in range(m)])
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True))
    flat = np.full((n, n), 77, dtype=np.uint8)
    assert (R.resize(flat, m, m) == 77).all()


def test_canvas_size_rounds_half_to_even():
    assert R.analysis_size(448, 1000) == (224, 500) and R.analysis_size(2, 5, 1) == (1, 2) and R.analysis_size(7, 2, 1) == (4, 1)


def test_files_become_rows_and_vectors(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / ".hidden").mkdir()
    good = np.arange(16, dtype=np.uint8).reshape(4, 4, 1) * 16
    for name, data in {"a/good.png": png(good), "a/bad.png": whole()[:30], "a/empty.png": b"", ".hidden/x.png": whole(), "a/.y.png": whole(), "a/photo.jpg": b"\xff\xd8\xff..."}.items():
        (tmp_path / name).write_bytes(data)
    files = I.image_files(spark, str(tmp_path))
    decoded = I.decode_images(files, readers={"JPEG": lambda data, most: np.full((2, 4, 3), 8, dtype=np.uint8)})
    rows = {r.path.rsplit("/", 1)[1]: r for r in decoded.collect()}
    assert {k: (r.format, r.height, r.width, r.error) for k, r in rows.items()} == {
        "good.png": ("PNG", 4, 4, None), "bad.png": (None, None, None, "truncated or corrupted"), "photo.jpg": ("JPEG", 2, 4, None),
    }  # fmt: skip; a file of no bytes isn't scanned
    uploads = spark.createDataFrame([(1, None), (2, bytearray()), (3, bytearray(whole()))], "id int, content binary")
    assert {r.id: r.error for r in I.decode_images(uploads).collect()} == {1: "empty", 2: "empty", 3: None}

    def load():
        return lambda x: x[0, ::7, ::7].ravel()

    out = {r.path.rsplit("/", 1)[1]: r for r in I.encode_images(decoded, load, 28, "e@1", views=8).collect()}
    assert out["bad.png"].v is None and out["bad.png"].fingerprint is None and out["bad.png"].error
    seen = np.array(out["good.png"].views)
    assert len({tuple(v) for v in seen}) == 8 and np.allclose(seen.mean(axis=0), out["good.png"].v) and out["good.png"].fingerprint == "e@1"
    with pytest.raises(ValueError):
        I.decode_images(files.withColumn("error", F.lit(1)))
    assert I.decode_images(files.limit(0)).count() == 0


def test_views_are_in_the_order_of_canvases(spark):
    side = 14
    pixels = np.random.default_rng(5).integers(0, 256, (side, side), dtype=np.uint8)
    rows = spark.createDataFrame([(side, side, bytearray(pixels.tobytes()))], "height int, width int, pixels binary")
    seen = I.encode_images(rows, lambda: lambda x: x[0].ravel(), side, "e", views=8).first().views
    flat = R.model_input(pixels, side)[0].ravel()
    assert np.array_equal(np.array(seen), np.array([flat[p] for p in C.dihedral_places(side)], dtype=np.float64))


def release(spark, n):
    return {"index": lambda path: store.save_artifact(spark.range(n), path, str(n), "f"), "notes": lambda path: spark.createDataFrame([(str(n),)], "value string").write.text(path)}


def held(spark, root):
    return store.load_artifact(spark, f"{P.current(spark, root)}/artifacts/index", "f")[0].count()


def test_a_crash_leaves_the_old_release(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}"
    with pytest.raises(ArtifactMismatch, match="nothing is published"):
        P.current(spark, root)
    load = lambda at: store.load_artifact(spark, f"{at}/index", "f")
    P.publish(spark, root, "1", release(spark, 3), load)
    assert held(spark, root) == 3

    def broken(path):
        raise OSError("lost")

    with pytest.raises(OSError):  # while staging
        P.publish(spark, root, "2", release(spark, 5) | {"late": broken}, load)
    with pytest.raises(ArtifactMismatch):  # artifacts that don't load
        P.publish(spark, root, "2", release(spark, 5), lambda at: store.load_artifact(spark, f"{at}/index", "other"))
    with monkeypatch.context() as m:  # between the phases
        m.setattr(P, "swap", broken_swap)
        with pytest.raises(OSError):
            P.publish(spark, root, "2", release(spark, 5), load)
    with monkeypatch.context() as m:  # within the swap
        m.setattr(P.os, "replace", lambda a, b: broken(a))
        with pytest.raises(OSError):
            P.publish(spark, root, "2", release(spark, 5), load)
    assert held(spark, root) == 3
    P.publish(spark, root, "2", release(spark, 5), load)
    assert held(spark, root) == 5


def broken_swap(*_):
    raise OSError("lost")


def test_files_that_change_are_refused(spark, tmp_path):
    root = f"file://{tmp_path}"
    path = P.publish(spark, root, "1", release(spark, 3), lambda at: None).removeprefix("file://")
    from pathlib import Path

    notes = next(f for f in (Path(path) / "artifacts/notes").glob("*.txt") if f.stat().st_size)
    spare = notes.read_bytes()
    for crc in notes.parent.glob(".*.crc"):
        crc.unlink()
    notes.write_bytes(b"other\n")
    with pytest.raises(ArtifactMismatch, match="changed"):
        P.current(spark, root)
    notes.unlink()
    with pytest.raises(ArtifactMismatch, match="missing"):
        P.current(spark, root)
    notes.write_bytes(spare)
    (notes.parent / "more.txt").write_bytes(b"x")
    with pytest.raises(ArtifactMismatch, match="added"):
        P.current(spark, root)
    assert P.current(spark, root, checked=False)
    with pytest.raises(ValueError):
        P.publish(spark, root, "a/b", release(spark, 1), lambda at: None)


def test_a_batch_that_comes_again_adds_nothing(spark, tmp_path):
    path, source = str(tmp_path / "history"), str(tmp_path / "in")
    columns = "id string, created_at string, filename string, decision_status string, predicted_class string, confidence double, result_json string, extra int"
    rows = lambda a, b: spark.createDataFrame([(str(i), None if i == 2 else f"2024-01-0{i % 3 + 1}T00:00:00Z", "f", "PASS", "c", 0.5, "{}", 1) for i in range(a, b)], columns)
    rows(0, 6).coalesce(1).write.parquet(source)
    run = lambda checkpoint: H.append_stream(spark.readStream.schema(columns).parquet(source), path, str(tmp_path / checkpoint)).awaitTermination()
    run("one")
    assert H.read_history(spark, path).count() == 6
    run("one")  # nothing new
    run("two")  # a lost checkpoint: the batch comes again under its number
    got = H.read_history(spark, path).collect()
    assert sorted(r.id for r in got) == [str(i) for i in range(6)] and [r.day for r in got if r.id == "2"] == [None]
    rows(6, 9).coalesce(1).write.mode("append").parquet(source)
    run("one")
    assert H.read_history(spark, path).count() == 9
