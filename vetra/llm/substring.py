"""Removal of repeated passages by super-k-mer partitioning.

A window is ``k`` consecutive words of one document. Its minimiser is the first of its ``m``-word pieces in
a fixed order: by hash, with the pieces last that are frequent minimisers in a bounded sample of documents
(``SAMPLE`` of them), so no bucket gets a large part of all windows for one common piece. Consecutive windows that share one form a super-k-mer, which travels as one packed
string to the bucket of that minimiser, so all windows of equal words meet in one bucket. Equal
super-k-mers of one map task meet before the shuffle: only that of the smallest document travels, the
others' words are already known to be repeated. In a bucket, windows are sorted by a hash of their
words and equal hashes are compared word by word, so what is removed is exact. The runs of removed
words are gathered per document and applied to its text.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetra.llm.common import cut

#: Stands for a null doc_id: never smaller than another.
NO_ID = 2**63 - 1
#: Documents sampled for frequent pieces, and how many pieces are put last at most (8 bytes each).
SAMPLE, MOST_FREQUENT = 20_000, 4_096
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.uint64(1 << 63)
_ROUTED = "bucket int, data binary, id long, mark long, a int, b int"


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def super_kmers(words: list[bytes], sizes: np.ndarray, k: int, m: int, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents laid end to end (``sizes`` words each): first word, number of windows and minimiser of each super-k-mer.

    Pieces in ``frequent`` (sorted) come after all others.
    """
    n = len(words)
    nothing = np.empty(0, np.int64)
    if n < k:
        return nothing, nothing, np.empty(0, np.uint64)
    word = np.fromiter(map(zlib.crc32, words), np.uint64, n) * _MIX
    piece = word[: n - m + 1].copy()
    for j in range(1, m):
        piece = (piece + np.uint64(j)) * _MIX ^ (piece >> np.uint64(32))
        piece += word[j : n - m + 1 + j]
    piece = _scramble(piece) >> np.uint64(1)
    if frequent is not None and len(frequent):
        piece[frequent[np.minimum(np.searchsorted(frequent, piece), len(frequent) - 1)] == piece] |= _LAST
    span, width, least = k - m + 1, 1, piece
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    ends = sizes.cumsum()
    owner = np.repeat(np.arange(len(sizes)), sizes)
    whole = np.flatnonzero(owner[: n - k + 1] == owner[k - 1 :])  # windows within one document
    if not len(whole):
        return nothing, nothing, np.empty(0, np.uint64)
    mins = least[whole]
    fresh = np.flatnonzero((mins[1:] != mins[:-1]) | (whole[1:] != whole[:-1] + 1)) + 1
    first = np.concatenate([[0], fresh])
    count = np.diff([*first, len(whole)])
    return whole[first], count, mins[first]


class _Routes:
    """Super-k-mers of one map task, by packed string; the smallest document's of each, and what falls to the others."""

    def __init__(self, buckets: int, k: int) -> None:
        self.buckets, self.k = buckets, k
        self.clear()

    def clear(self) -> None:
        self.kept, self.again, self.gone, self.bytes = {}, [], [], 0

    def add(self, packed: bytes, bucket: int, owner: tuple, a: int, count: int) -> None:
        old = self.kept.get(packed)
        if old is None:
            self.kept[packed] = (owner, a, count, bucket)
            self.bytes += len(packed) + 250
        elif owner[0] > old[0][0]:
            self.gone.append((*owner, a, a + count + self.k - 1))
        elif owner[0] == old[0][0]:  # once more in the same document
            self.again.append((packed, (owner, a, count, bucket)))
            self.bytes += len(packed) + 250
        else:
            self.kept[packed] = (owner, a, count, bucket)
            self.gone.append((*old[0], old[1], old[1] + count + self.k - 1))

    def batches(self):
        import zstandard

        smallest = {p: v[0][0] for p, v in self.kept.items()} if self.again else {}
        per: dict[int, list] = {}
        for packed, entry in self.kept.items():
            per.setdefault(entry[3], []).append((packed, entry))
        for packed, entry in self.again:
            if entry[0][0] > smallest[packed]:
                self.gone.append((*entry[0], entry[1], entry[1] + entry[2] + self.k - 1))
            else:
                per.setdefault(entry[3], []).append((packed, entry))
        press = zstandard.ZstdCompressor(level=3)
        keys, blobs = [], []
        for bucket, items in per.items():
            head = np.array([(e[0][0], e[0][1], e[1], e[2]) for _, e in items], np.int64).T.copy()
            head[0, 1:] -= head[0, :-1].copy()  # ids mostly rise, so their steps pack better; bytes lie in planes
            keys.append(bucket)
            blobs.append(press.compress(np.int64(len(items)).tobytes() + head.view(np.uint8).reshape(4, -1, 8).transpose(0, 2, 1).tobytes() + b"\n".join(p for p, _ in items)))
        for i in range(0, len(keys), 64):
            part = keys[i : i + 64]
            none = [pa.nulls(len(part), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(blobs[i : i + 64], pa.binary()), *none], names=["bucket", "data", "id", "mark", "a", "b"])
        if self.gone:
            gone = np.array(self.gone, np.int64)
            # dealt evenly over the buckets, through which these rows only pass
            where = (np.arange(len(gone)) + int(gone[0, 0] % self.buckets)) % self.buckets
            yield pa.RecordBatch.from_arrays(
                [pa.array(where.astype(np.int32)), pa.nulls(len(gone), pa.binary()), pa.array(gone[:, 0]), pa.array(gone[:, 1]), pa.array(gone[:, 2].astype(np.int32)), pa.array(gone[:, 3].astype(np.int32))],
                names=["bucket", "data", "id", "mark", "a", "b"],
            )
        self.clear()


def _route(buckets: int, k: int, m: int, frequent: np.ndarray, chunk: int, flush: int):
    def run(batches):
        routes = _Routes(buckets, k)

        def take(docs):
            words, sizes = [], []
            for _, raw in docs:
                own = raw.split()
                words += own
                sizes.append(len(own))
            sizes = np.array(sizes, np.int64)
            first, count, least = super_kmers(words, sizes, k, m, frequent)
            if not len(first):
                return
            joined = b" ".join(words)
            ends = np.fromiter(map(len, words), np.int64, len(words)).cumsum() + np.arange(len(words))
            begins = np.concatenate([[0], ends[:-1] + 1])
            starts = sizes.cumsum() - sizes
            doc = np.searchsorted(starts + sizes, first, side="right")
            add = routes.add
            bucket = (least % np.uint64(buckets)).astype(np.int64)
            for d, a, c, q, x, y in zip(doc.tolist(), (first - starts[doc]).tolist(), count.tolist(), bucket.tolist(), begins[first].tolist(), ends[first + count + k - 2].tolist()):
                add(joined[x:y], q, docs[d][0], a, c)

        held, size = [], 0
        for batch in batches:
            for i, mark, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                held.append(((i, mark), raw := raw.as_py()))
                size += len(raw)
                if size > chunk:
                    take(held)
                    held, size = [], 0
                    if routes.bytes > flush:
                        yield from routes.batches()
        take(held)
        yield from routes.batches()

    return run


def repeated_windows(words: list[bytes], counts: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """For super-k-mers laid end to end (``counts`` windows each, of documents ``ids``): which windows a smaller id has too."""
    lengths = counts + k - 1
    begins = lengths.cumsum() - lengths
    n = int(counts.sum())
    at = np.repeat(begins - (counts.cumsum() - counts), counts) + np.arange(n)  # first word of each window
    owner = np.repeat(ids, counts)
    word = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    total = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        total = total * np.uint64(0xD1B54A32D192ED03) + word[j : len(words) - k + 1 + j]
    key = _scramble(total[at])
    order = np.lexsort((owner, key))
    key, owner_sorted, at_sorted = key[order], owner[order], at[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    group = np.flatnonzero(new)
    head = group[new.cumsum() - 1]
    out = np.zeros(n, bool)
    for i in np.flatnonzero(~new).tolist():
        h = head[i]
        x, y = at_sorted[i], at_sorted[h]
        if words[x : x + k] == words[y : y + k]:
            out[order[i]] = owner_sorted[i] > owner_sorted[h]
        else:  # two texts under one hash: held against every window before it
            mine = words[x : x + k]
            out[order[i]] = any(owner_sorted[g] < owner_sorted[i] and words[at_sorted[g] : at_sorted[g] + k] == mine for g in range(h, i))
    return out


def _bucket(k: int):
    def run(key, tab):
        import zstandard

        passed = tab.filter(pa.compute.is_null(tab.column("data"))).select(["id", "mark", "a", "b"])
        heads, words = [], []
        for data in tab.column("data").drop_null():
            raw = zstandard.ZstdDecompressor().decompress(data.as_py())
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            head = np.frombuffer(raw, np.uint8, 32 * n, 8).reshape(4, 8, n).transpose(0, 2, 1).copy().view(np.int64)[:, :, 0]
            head[0] = head[0].cumsum()
            heads.append(head)
            words += raw[8 + 32 * n :].split()
        if not heads:
            return passed
        ids, marks, first, counts = np.concatenate(heads, axis=1)
        gone = np.flatnonzero(repeated_windows(words, counts, ids, k))
        if not len(gone):
            return passed
        skm = np.repeat(np.arange(len(counts)), counts)[gone]
        place = gone - (counts.cumsum() - counts)[skm] + first[skm]
        cut = np.flatnonzero((skm[1:] != skm[:-1]) | (place[1:] != place[:-1] + 1))
        lo, hi = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(gone) - 1]])
        found = pa.table({"id": ids[skm[lo]], "mark": marks[skm[lo]], "a": place[lo].astype(np.int32), "b": (place[hi] + k).astype(np.int32)})
        return pa.concat_tables([passed, found])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """id, mark, raw, doc_id. The mark tells rows that share an id apart; it is 0 where no id repeats."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    once = docs.groupBy("doc_id").count().filter("count > 1").isEmpty()
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), (F.lit(0).cast("long") if once else F.xxhash64(text)).alias("mark"), text.cast("binary").alias("raw"), F.col("doc_id").cast("long").alias("doc_id"))


def frequent_pieces(keyed: DataFrame, k: int, m: int, part: int) -> np.ndarray:
    """Sorted: the minimisers of over 1 / ``part`` of the windows of about ``SAMPLE`` documents, at most ``MOST_FREQUENT``."""

    def run(batches):
        for batch in (b.slice(i, 250) for b in batches for i in range(0, b.num_rows, 250)):
            rows = [x.as_py().split() for x in batch.column(0)]
            _, count, least = super_kmers([w for r in rows for w in r], np.fromiter(map(len, rows), np.int64, len(rows)), k, m)
            piece, at = np.unique(least, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(piece.view(np.int64)), pa.array(np.bincount(at, count, len(piece)).astype(np.int64))], names=["piece", "n"])

    step = max(1, keyed.count() // SAMPLE)
    some = keyed.filter(F.pmod(F.xxhash64("id", "mark"), F.lit(step)) == 0).select("raw")
    counted = cut(some.mapInArrow(run, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")))
    top = counted.orderBy(F.desc("n"), "piece").limit(MOST_FREQUENT + 1).collect()  # a bounded number of pieces
    least = (counted.agg(F.sum("n")).first()[0] or 0) / part
    return np.sort(np.array([r["piece"] for r in top[:MOST_FREQUENT] if r["n"] > least], np.int64).view(np.uint64))


def repeated_spans(keyed: DataFrame, k: int = 13, m: int = 2, bucket_bytes: int = 6_000_000, chunk: int = 1_500_000, flush: int = 60_000_000) -> DataFrame:
    """Of ``keyed`` (id, mark, raw) id, mark, spans: the runs (a, b) of words, a included and b not, that windows repeated from smaller ids cover."""
    size = keyed.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    buckets = max(8, int(size * 3 // bucket_bytes))
    routed = keyed.select("id", "mark", "raw").mapInArrow(_route(buckets, k, m, frequent_pieces(keyed, k, m, 8 * buckets), chunk, flush), _ROUTED)
    spans = routed.groupBy("bucket").applyInArrow(_bucket(k), "id long, mark long, a int, b int")
    return spans.groupBy("id", "mark").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def substring_dedup(docs: DataFrame, k: int = 13, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document (and kept_text ``with_text``).

    Words are runs of characters other than space and \\\\t-\\\\r, unchanged. Removed is each word that a
    window of ``k`` words covers whose words also stand in a document with a smaller doc_id, judged on
    the input. A null text has no words; a text of any length is taken whole. Rows that repeat a doc_id aren't smaller than one another; a
    null doc_id is larger than any. An empty table gives an empty result; other columns are ignored.
    """
    keyed = _keyed(docs)
    spans = repeated_spans(keyed, k).hint("shuffle_hash")
    joined = keyed.join(spans, ["id", "mark"], "left").select("doc_id", "raw", "spans")

    def run(batches):
        for batch in batches:
            n_words, n_removed, digests, texts = [], [], [], []
            for raw, spans in zip(batch.column(1), batch.column(2)):
                words = raw.as_py().split()
                n_words.append(len(words))
                removed = 0
                if spans.is_valid:
                    edge = np.zeros(len(words) + 1, np.int32)
                    flat = spans.values.flatten()
                    np.add.at(edge, flat[0].to_numpy(), 1)
                    np.add.at(edge, flat[1].to_numpy(), -1)
                    keep = edge.cumsum()[:-1] == 0
                    removed = len(words) - int(keep.sum())
                    words = compress(words, keep.tolist())
                n_removed.append(removed)
                text = b" ".join(words)
                digests.append(hashlib.sha256(text).hexdigest())
                if with_text:
                    texts.append(text.decode())
            out = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(texts, pa.string())] * with_text, names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text)

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
