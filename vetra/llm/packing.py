"""Best-fit packing with certified bin counts.

Documents are cut into pieces of at most ``capacity`` tokens and the pieces are packed into as few
sequences as possible:

1. ``token_pieces`` tokenises whole texts (Arrow batches) and keeps five numbers per piece.
2. ``pack_pieces`` deals the pieces to partitions by a hash and runs best-fit decreasing in each. Dual-feasible
   functions give a lower bound for each partition, which certifies its bin count, and one for all
   pieces together (from the histogram of lengths, which has at most ``capacity`` rows).
3. While there are more bins than the overall bound says, partitions exchange documents: each offers its
   loosest bins, enough to make up its own gap between bins and bound several times over (a partition
   without a gap offers the room of one bin). What is offered is dealt anew, whole bins to a pool, packed again by best-fit
   decreasing and certified again. A pool's new packing replaces the old one only if it needs fewer bins.

A task holds about ``per_partition`` pieces: there are as many partitions or pools as the number of
pieces asks for.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetra.llm.common import cut, small_batches, trimmed

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", bin_part long, bin_no long, offset long, loose boolean, part_bins long, part_bound long, kept_bins long, kept_bound long"
#: Characters for which the two tokenizer libraries split alike whatever their Unicode tables.
_UNUSUAL = re.compile("[^\t\n\r\x20-\x7e¡-ɏ]")
#: Runs of blanks on which the faster library is slow, and in the end out of stack.
_LONG_BLANK = re.compile(r"\s{200}")
_ENCODERS: dict[str, object] = {}


def _encoder(vocabulary: str):
    """text -> uint32 ids, as the ``tokenizers`` library gives them for ``vocabulary`` (.json).

    Where a rank file of the same name lies beside it, plain texts go through the faster library
    for the same ranks; texts with unusual characters always go through ``tokenizers``.
    """
    if vocabulary not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(vocabulary)
        ranks = vocabulary.removesuffix(".json") + ".tiktoken"

        def by_library(text: str) -> np.ndarray:
            return np.array(slow.encode(text, add_special_tokens=False).ids, dtype="<u4")

        encode = by_library
        if os.path.exists(ranks):
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                merge = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            special = {t.content: i for i, t in slow.get_added_tokens_decoder().items()}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merge, special_tokens=special)

            def encode(text: str) -> np.ndarray:
                if _UNUSUAL.search(text) or _LONG_BLANK.search(text):
                    return by_library(text)
                return fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)

        _ENCODERS[vocabulary] = encode
    return _ENCODERS[vocabulary]


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece of every document's ids plus ``end_id``; a null text counts as empty.

    A document longer than ``capacity`` is cut so that its first piece takes the remainder.
    Null ``doc_id`` stays null; repeated ids are kept as separate documents.
    """

    def run(batches):
        encode = _encoder(vocabulary)
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), {k: [] for k in ("doc_id", "piece", "start", "length", "crc")}
            for doc_id, text in zip(ids, batch.column(1)):
                own = encode(text.as_py() or "")
                own = np.append(own, np.uint32(end_id)).astype("<u4", copy=False)
                raw, n = own.tobytes(), len(own)
                first = n - (n - 1) // capacity * capacity
                start, piece = 0, 0
                while start < n:
                    length = first if not start else capacity
                    for k, v in zip(out, (doc_id, piece, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]))):
                        out[k].append(v)
                    start, piece = start + length, piece + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()), *(pa.array(out[k], pa.int64()) for k in ("start", "length", "crc"))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), PIECES)


def lower_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """The best of three families of dual-feasible functions over a histogram of piece lengths."""
    lengths, counts = np.asarray(lengths, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    if not counts.sum():
        return 0
    weight = np.zeros(capacity + 1, dtype=np.int64)
    np.add.at(weight, lengths, counts)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((weight * size).sum()) // capacity)
    number, total = np.concatenate([[0], weight.cumsum()]), np.concatenate([[0], (weight * size).cumsum()])
    half = capacity // 2
    for a in range(half + 1):  # big items round up, those under a to nothing
        huge = number[-1] - number[capacity - a + 1]
        large, large_sum = number[capacity - a + 1] - number[half + 1], total[capacity - a + 1] - total[half + 1]
        small = total[half + 1] - total[a]
        best = max(best, int(huge + large + max(0, -(-(small - (large * capacity - large_sum)) // capacity))))
    for k in range(1, 25):  # staircase functions
        step = (k + 1) * size
        value = np.where(step % capacity == 0, size * k, step // capacity * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((weight * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset of each item (given longest first), and each bin's free space."""
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    free: list[int] = []
    open_sizes = 0  # bit s is set while some bin has s free
    for i, n in enumerate(lengths.tolist()):
        fits = open_sizes >> n
        if fits:
            s = n + (fits & -fits).bit_length() - 1
            b = stacks[s].pop()
            if not stacks[s]:
                open_sizes &= ~(1 << s)
        else:
            s, b = capacity, len(free)
            free.append(capacity)
        bins[i], offsets[i], rest = b, capacity - s, s - n
        free[b] = rest
        if rest:
            stacks[rest].append(b)
            open_sizes |= 1 << rest
    return bins, offsets, np.array(free, dtype=np.int64)


def offered(free: np.ndarray, want: int, capacity: int) -> np.ndarray:
    """Which bins a partition offers: the loosest, until their free space is that of eight times ``want`` bins."""
    order = np.argsort(-free, kind="stable")
    before = np.concatenate([[0], free[order].cumsum()[:-1]])
    out = np.zeros(len(free), bool)
    out[order[(before < 8 * want * capacity) & (free[order] > 0)]] = True
    return out


def _pack_group(capacity: int, stamp: int):
    """For groupBy(part).applyInArrow: best-fit decreasing and bound of the group; keeps the old packing unless bins are saved."""

    def run(key, tab):
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        tab = tab.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = tab.column("length").to_numpy()
        bins, offsets, free = best_fit_decreasing(lengths, capacity)
        if "bin_no" in tab.column_names:
            old = np.stack([tab.column("bin_part").to_numpy(), tab.column("bin_no").to_numpy()])
            _, own = np.unique(old, axis=1, return_inverse=True)
            if len(free) >= own.max() + 1:
                bins, offsets = own.reshape(-1), tab.column("offset").to_numpy()
                free = capacity - np.bincount(bins, lengths).astype(np.int64)
        bound = lower_bound(*np.unique(lengths, return_counts=True), capacity)
        loose = offered(free, max(1, len(free) - bound), capacity)
        kept = lengths[~loose[bins]]
        certificate = (len(free), bound, int((~loose).sum()), lower_bound(*np.unique(kept, return_counts=True), capacity))
        part = np.full(len(lengths), stamp << 24 | key[0].as_py(), dtype=np.int64)
        columns = {"bin_part": part, "bin_no": bins, "offset": offsets, "loose": loose[bins]}
        columns |= {k: np.full(len(lengths), v, np.int64) for k, v in zip(("part_bins", "part_bound", "kept_bins", "kept_bound"), certificate)}
        return pa.table({**{n: tab.column(n) for n in names}, **columns})

    return run


def pack_pieces(pieces: DataFrame, capacity: int = 2048, per_partition: int = 131_072, rounds: int = 20) -> tuple[DataFrame, dict]:
    """Packed pieces with ``sequence_id``, ``offset``, part_bins and part_bound; and the certificate {pieces, bins, bound, rounds}.

    part_bins and part_bound are the bins of the partition or pool that last packed the piece, and the
    lower bound for them. ``pieces`` is read several times: give a checkpointed frame. Rounds of exchange
    end once the bins meet the bound for all pieces, after a round over a single pool, or when two in turn save none. Ties are broken
    by doc_id, piece and checksum, so equal input gives an equal packing whatever the order of rows.
    """
    histogram = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    n = sum(r["count"] for r in histogram)
    bound = lower_bound([r["length"] for r in histogram], [r["count"] for r in histogram], capacity)
    parts = max(1, -(-n // per_partition))
    deal = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("long")
    packed = cut(pieces.withColumn("part", deal).groupBy("part").applyInArrow(_pack_group(capacity, 0), PACKED))
    size = lambda: packed.agg(F.coalesce(F.count_if(F.col("offset") == 0), F.lit(0)), F.coalesce(F.count_if("loose"), F.lit(0))).first()
    bins, loose = size()  # every bin has one piece at offset 0
    done = idle = 0
    while parts > 1 and bins > bound and done < rounds and idle < 2:
        before, done, parts = bins, done + 1, max(1, -(-loose // per_partition))
        deal = F.pmod(F.xxhash64("bin_part", "bin_no", F.lit(done)), F.lit(parts)).cast("long")
        again = packed.filter("loose").withColumn("part", deal).groupBy("part").applyInArrow(_pack_group(capacity, done), PACKED)
        rest = packed.filter("NOT loose").withColumns({"part_bins": F.col("kept_bins"), "part_bound": F.col("kept_bound")})
        packed = cut(rest.unionByName(again))
        bins, loose = size()
        idle = idle + 1 if bins == before else 0
    out = packed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.shiftleft("bin_part", 32) + F.col("bin_no")).alias("sequence_id"), "offset", "part_bins", "part_bound",
    )
    return out, {"pieces": n, "bins": bins, "bound": bound, "rounds": done}


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, per_partition: int = 131_072) -> DataFrame:
    """Tokenise and pack ``docs`` (doc_id, text); one row per piece, with the certificate in part_bins, part_bound, all_bins and all_bound.

    Nulls: a null text is an empty document (one piece that holds only ``end_id``). A text of any length
    is tokenised whole, also one long run of blanks. Repeated rows are packed as often as they occur, an
    empty table gives an empty result, other columns are ignored.
    """
    pieces = cut(token_pieces(docs, vocabulary, capacity, end_id))
    packed, certificate = pack_pieces(pieces, capacity, per_partition)
    return packed.withColumns({f"all_{k}": F.lit(certificate[k]).cast("long") for k in ("bins", "bound")})
