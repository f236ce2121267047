"""Image files as a table: decoded, resized and encoded in Arrow batches; a bad file is a row with an error, never a failed job."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vetra.functions import rasters as R

_DECODED = [("format", T.StringType()), ("height", T.IntegerType()), ("width", T.IntegerType()), ("pixels", T.BinaryType()), ("error", T.StringType())]


def image_files(spark: SparkSession, root: str) -> DataFrame:
    """path, content of every file below ``root``; files and folders that begin with a dot are no images.

    Spark's scans leave out files of no bytes, so these have no row here; an upload's empty bytes, in a table, have one with an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", "content").filter(~F.col("path").rlike(r"/\.[^/]*"))


def decode_images(files: DataFrame, readers: dict[str, Callable] | None = None, most: int = R.MOST_PIXELS, content: str = "content") -> DataFrame:
    """``files`` without its bytes, with format, height, width, pixels (grey, a byte each, by rows) and error.

    Where error isn't null the others of these are; null bytes count as empty. Columns of ``files`` with those names are
    an error. Rows go one by one through a batch and leave it in turn, so a task holds one decoded image beside its batch of files;
    ``spark.sql.execution.arrow.maxRecordsPerBatch`` bounds that batch.
    """
    kept = [f for f in files.schema.fields if f.name != content]
    if clash := {f.name for f in kept} & {n for n, _ in _DECODED}:
        raise ValueError(f"columns {sorted(clash)} are given by decoding")
    schema = T.StructType(kept + [T.StructField(n, t) for n, t in _DECODED])

    def one(data: bytes | None) -> list:
        try:
            kind, pixels = R.decode(data or b"", readers, most)
            return [kind, *pixels.shape, pixels.tobytes(), None]
        except R.BadImage as e:
            return [None, None, None, None, str(e)]

    def run(batches):
        for batch in batches:
            rest = batch.select([f.name for f in kept])
            for i in range(len(batch)):
                made = one(batch.column(content)[i].as_py())
                arrays = [pa.array([v], t) for v, t in zip(made, (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*rest.slice(i, 1).columns, *arrays], [f.name for f in schema.fields])

    return files.mapInArrow(run, schema)


def _map_pixels(images: DataFrame, added: list[T.StructField], begin: Callable, kinds: list[pa.DataType]) -> DataFrame:
    """``images`` without pixels, with columns from ``begin()``(pixels), which is called once a task; null where there are no pixels."""
    kept = [f for f in images.schema.fields if f.name != "pixels"]
    schema = T.StructType(kept + added)

    def run(batches):
        make = begin()
        for batch in batches:
            rest = batch.select([f.name for f in kept])
            for i in range(len(batch)):
                data = batch.column("pixels")[i].as_py()
                made = [None] * len(added)
                if data is not None:
                    made = make(np.frombuffer(data, dtype=np.uint8).reshape(batch.column("height")[i].as_py(), batch.column("width")[i].as_py()))
                yield pa.RecordBatch.from_arrays([*rest.slice(i, 1).columns, *[pa.array([v], t) for v, t in zip(made, kinds)]], [f.name for f in schema.fields])

    return images.mapInArrow(run, schema)


def resized(images: DataFrame, size_of: Callable[[int, int], tuple[int, int]]) -> DataFrame:
    """``images`` with canvas (array<double>), canvas_height, canvas_width: the pixels resized to size_of(height, width)."""

    def begin():
        def make(pixels):
            height, width = size_of(*pixels.shape)
            return R.resize(pixels, height, width).astype(float).ravel().tolist(), height, width

        return make

    added = [T.StructField("canvas", T.ArrayType(T.DoubleType())), T.StructField("canvas_height", T.IntegerType()), T.StructField("canvas_width", T.IntegerType())]
    return _map_pixels(images, added, begin, [pa.list_(pa.float64()), pa.int32(), pa.int32()])


def analysis_canvas(images: DataFrame, short: int = 224) -> DataFrame:
    """Canvases for quality signals: the short side at ``short``."""
    return resized(images, lambda h, w: R.analysis_size(h, w, short))


def encode_images(images: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], size: int, fingerprint: str, views: int = 1) -> DataFrame:
    """``images`` with views (array of ``views`` vectors), v (their mean) and fingerprint, null where there was an error.

    ``load`` is called once a task and gives the encoder: (3, size, size) float32 to a vector. Views are the quarter
    turns and mirrored turns of the padded square, one at a time.
    """
    if not 1 <= views <= 8:
        raise ValueError("views must be from 1 to 8")
    if size < R.PATCH or size % R.PATCH:
        raise ValueError(f"the input size must be a multiple of {R.PATCH}")

    def begin():
        encode = load()

        def make(pixels):
            whole = R.model_input(pixels, size)
            seen = []
            for k in range(views):
                view = np.rot90(whole[:, :, ::-1] if k >= 4 else whole, k % 4, axes=(1, 2))
                seen.append(np.asarray(encode(np.ascontiguousarray(view)), dtype=np.float64))
            return [w.tolist() for w in seen], np.mean(seen, axis=0).tolist(), fingerprint

        return make

    vector = T.ArrayType(T.DoubleType())
    added = [T.StructField("views", T.ArrayType(vector)), T.StructField("v", vector), T.StructField("fingerprint", T.StringType())]
    return _map_pixels(images, added, begin, [pa.list_(pa.list_(pa.float64())), pa.list_(pa.float64()), pa.string()])
