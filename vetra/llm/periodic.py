"""Periodic runs of words: every lag of a document is compared, vectorised, and true stretches are measured.

With words as numbers, a stretch of period q is where the row of numbers and the row shifted by q agree.
``scan`` goes through a range of lags up to n / min_exponent. A stretch that is long enough agrees in at least
``need`` places in a row, so the lags are first compared, a block of them at once, at every s-th place, of
which ``need // s`` in a row must agree; only around such places are all words compared. What has a smaller
period than the lag is left to that lag. Documents over ``part_bytes`` are dealt to Spark tasks as (document, range of lags).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetra.llm.common import cut, small_batches, trimmed

#: Places that are compared, at least, of a stretch that is just long enough (``_promising`` doubles up to it); words compared at a time.
SAMPLES, CELLS = 8, 1 << 18
RUN = "struct<start:long,length:long,period:long>"
FOUND = f"doc_id long, n_words long, runs array<{RUN}>, best {RUN}, collapsed string"
Edit = Callable[[int | None, list[bytes]], list[bytes]]


def numbered(words: list[bytes]) -> np.ndarray:
    """Each word as the number of its first place among the distinct words."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int32, len(words))


def _stretches(same: np.ndarray, least: int) -> list[tuple[int, int]]:
    """[from, to) of each stretch of at least ``least`` true values."""
    ends = np.flatnonzero(~same)
    edges = np.concatenate([[-1], ends, [len(same)]])
    at = np.flatnonzero(np.diff(edges) > least)
    return [(int(edges[i]) + 1, int(edges[i + 1])) for i in at]


def smallest_period(w: np.ndarray, q: int) -> int:
    """The smallest divisor of ``q`` that is a period of the first ``q`` numbers of ``w``."""
    rest, r = q, 2
    while rest > 1:
        if r * r > rest:
            r = rest
        if rest % r:
            r += 1
            continue
        rest //= r
        d = q // r
        if np.array_equal(w[d:q], w[: q - d]):
            q = d
    return q


def _promising(w: np.ndarray, n: int, lags: range, need: int) -> list[int]:
    """Those of neighbouring ``lags`` at which SAMPLES sampled places in a row agree; after its ``n`` numbers ``w`` is padded with -1."""
    if need < SAMPLES:
        return list(lags)
    step = need // SAMPLES
    m = -(-(n - lags[0]) // step)
    if m < SAMPLES:
        return []
    shifted = np.lib.stride_tricks.as_strided(w[lags[0] :], (len(lags), m), (w.itemsize, w.itemsize * step))
    same = shifted == w[: m * step : step]
    for hop in (1, 2, 4):
        same = same[:, :-hop] & same[:, hop:]
    return [lags[i] for i in np.flatnonzero(same.any(axis=1)).tolist()]


def scan(w: np.ndarray, lags: range, min_length: int = 24, min_exponent: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run whose smallest period is one of ``lags``."""
    n, found, q0 = len(w), [], lags.start
    known = np.empty((0, 3), np.int64)  # stretches seen, by their smallest period: its multiples say nothing new
    if n < min_length:
        return found
    stop = min(lags.stop, n // min_exponent + 1)
    padded = np.concatenate([w, np.full(n, -1, w.dtype)])
    while q0 < stop:
        block = range(q0, min(stop, q0 + max(32, min(q0 // 4, CELLS // n))))
        least = min(max(min_length, min_exponent * q) - q for q in {block[0], block[-1], min_length // min_exponent} if q in block)
        for q in _promising(padded, n, block, least):
            need = max(min_length, min_exponent * q) - q
            step = max(1, need // SAMPLES)
            done = -1
            for a, b in _stretches(w[q::step] == w[: n - q : step], need // step):
                a, b = a * step, (b - 1) * step  # first and last place known to agree
                if b < done or ((q % known[:, 2] == 0) & (known[:, 0] <= a) & (b < known[:, 1] - q)).any():
                    continue
                lo, hi = max(a - step + 1, 0), min(b + step, n - q)
                for s, e in _stretches(w[lo + q : hi + q] == w[lo:hi], need):
                    done, s, e = lo + e, lo + s, lo + e + q
                    p = smallest_period(w[s:e], q)
                    known = np.concatenate([known, [(s, e, p)]])
                    if p == q:
                        found.append((s, e - s, q))
        q0 = block.stop
    return found


def lag_range(n: int, part: int, parts: int, min_exponent: int = 3) -> range:
    """The ``part``-th of ``parts`` ranges of the lags of ``n`` words."""
    last = n // min_exponent
    return range(1 + last * part // parts, 1 + last * (part + 1) // parts)


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest exact length / period; of equals that of smallest start, then period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """``words`` with one space between each two, without what follows the first period of a run."""
    if not runs:
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(edges.cumsum()[:-1] == 0).tolist()])


def _run_array(lists: list) -> pa.Array:
    names = ["start", "length", "period"]
    return pa.array([None if own is None else [dict(zip(names, r)) for r in own] for own in lists], pa.list_(pa.struct([(k, pa.int64()) for k in names])))


def _batch(ids: pa.Array, n: list[int], runs: list, collapsed: list[bytes]) -> pa.RecordBatch:
    best = [b and dict(zip(("start", "length", "period"), b)) for b in map(best_run, runs)]
    columns = [ids, pa.array(n, pa.int64()), _run_array(runs), pa.array(best, pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])), pa.array(collapsed, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "best", "collapsed"])


def periodic_runs(docs: DataFrame, min_length: int = 24, min_exponent: int = 3, edit: Edit | None = None, part_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), best and collapsed for every whole text.

    Words stand between blanks (space, tab to carriage return); ``edit`` gives other words for a document's id and
    words. A run is a stretch of at least ``min_length`` words and ``min_exponent`` (2 or more) times its smallest
    period that can't be extended. ``best`` is that of greatest length / period, null without a run. ``collapsed``
    joins the words that no run covers after its first period. Null and empty texts have no word, null ids stay
    null, repeated rows are repeated, an empty table gives no row, other columns are ignored. A text over
    ``part_bytes`` is scanned in as many ranges of lags as it holds ``part_bytes``, each by a task of its own.
    """
    if min_exponent < 2:
        raise ValueError("min_exponent: 2 or more, else a run's period needn't be its own")

    def words_of(doc_id, text) -> list[bytes]:
        words = (text or "").encode().split()
        return words if edit is None else edit(doc_id, words)

    def whole(batches):
        for batch in batches:
            n, runs, kept = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(doc_id, text.as_py())
                own = sorted(scan(numbered(words), lag_range(len(words), 0, 1, min_exponent), min_length, min_exponent), key=lambda r: (r[0], r[2]))
                n.append(len(words))
                runs.append(own)
                kept.append(collapse(words, own))
            yield _batch(batch.column(0), n, runs, kept)

    def ranges(batches):
        for batch in batches:
            runs = []
            for doc_id, text, part, parts in zip(*(batch.column(i) for i in (0, 2, 3, 4))):
                w = numbered(words_of(doc_id.as_py(), text.as_py()))
                runs.append(scan(w, lag_range(len(w), part.as_py(), parts.as_py(), min_exponent), min_length, min_exponent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _run_array(runs)], names=["doc_id", "sha", "found"])

    def gathered(batches):
        for batch in batches:
            words = [words_of(i.as_py(), t.as_py()) for i, t in zip(batch.column(0), batch.column(1))]
            runs = [[(r["start"], r["length"], r["period"]) for r in own or []] for own in batch.column(2).to_pylist()]
            yield _batch(batch.column(0), [len(x) for x in words], runs, [collapse(w, r) for w, r in zip(words, runs)])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    found = rows.filter(size <= part_bytes).mapInArrow(trimmed(whole), FOUND)
    long = cut(rows.filter(size > part_bytes).withColumn("sha", F.sha2("text", 256)))
    if long.isEmpty():
        return found
    parts = F.ceil(F.octet_length("text") / part_bytes).cast("int")
    dealt = long.distinct().select("doc_id", "sha", "text", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), parts.alias("parts"))
    runs = (
        dealt.repartition("doc_id", "sha", "part").mapInArrow(trimmed(ranges), f"doc_id long, sha string, found array<{RUN}>")
        .select(F.col("doc_id").alias("of"), F.col("sha").alias("of_sha"), F.inline("found")).groupBy("of", "of_sha")
        .agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
        .withColumn("runs", F.expr("transform(runs, x -> struct(x.start, x.length, x.period))"))
    )
    joined = long.join(runs, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("sha") == F.col("of_sha")), "left").select("doc_id", "text", "runs")
    return found.unionByName(joined.mapInArrow(trimmed(gathered), FOUND))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the query: every tenth document, by the crc32 of its id, becomes periodic from a place of its own on; a null id stays as it is."""
    h = zlib.crc32(str(doc_id).encode())
    n = len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def run_digests(found: DataFrame) -> DataFrame:
    """What ``periodic_runs`` found, as numbers and digests."""
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
