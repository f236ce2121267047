"""Language-model scoring with sharded Elias-Fano n-gram tries.

The model is an interpolated trigram over all training tokens, on a bigram, on an add-one unigram:
p(w|h) = max(c(hw) - D, 0) / c(h.) + D t(h) / c(h.) p(w|shorter h), t(h) being h's distinct successors. A
document's first token has the start as its context and no longer one.

Neither vocabulary nor trie has to fit one machine, and no text is read twice or joined:

1. Map tasks encode blocks of documents: a stream of local word numbers, and for each shard of words
   the block's distinct words with their training counts. Blocks lie in a table bucketed by block, so later steps bring
   answers to them and never move them again.
2. Word shards sum the counts, number the words (frequent first) and answer each block: number, count.
3. Blocks ask the shards of first words about their distinct bigrams and trigrams, with the training counts they
   have. A trigram names its context by the place of its bigram in the same request.
4. A shard sums the counts, lays the trie out in memory-mapped levels and answers each block. A level is an
   Elias-Fano sequence of (place of the context, word), with pointers from each context to its successors; an entry
   names its context, so a search that finds it needs no pointer; bits are packed to their exact width. It is searched as it lies: samples of ranks find a word of bits,
   population counts the bit in it, and a successor search among a context's few candidates the entry.
   Probabilities and back-off weights are quantised.
5. Blocks add up their documents' scores.

Requests are distinct within a block, so hot words and contexts send one entry a block.
"""

from __future__ import annotations

import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetra.llm.common import cut, give_back, shared_path, trimmed
from vetra.llm.langid import held_out

_ROW = "kind string, block long, shard int, n long, v long, data binary"
_NAMES = ["kind", "block", "shard", "n", "v", "data"]
STEP = 5000.0  # codes a factor of ten
#: Buckets of the table of blocks at most; beyond it a bucket has several blocks.
MOST_BUCKETS = 50_000
_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: each in the narrowest type, planes of bytes apart, compressed."""
    import zstandard

    out = []
    for a in arrays:
        top = int(a.max()) if len(a) else 0
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(k).max)
        a = a.astype(kind)
        out += [np.array([len(a), a.itemsize], np.int64).tobytes(), np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def _unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        n, width = np.frombuffer(raw, np.int64, 2, at).tolist()
        planes = np.frombuffer(raw, np.uint8, n * width, at + 16).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1).astype(np.int64))
        at += 16 + n * width
    return out


def _table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=_NAMES)


def _or_into(words: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """``words`` 64-bit words with ``values`` set into those at the non-decreasing places ``at``."""
    out = np.zeros(words, np.uint64)
    if len(at):
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        out[at[first]] = np.bitwise_or.reduceat(values, first)
    return out


class EliasFano:
    """A non-decreasing sequence in a mapped file: low bits packed to their width, high bits in unary, ranks sampled.

    Nothing is unpacked: a search touches the words of bits that it needs.
    """

    BLOCK = 4  # words of 64 bits between two samples
    CHUNK = 1 << 18  # searched at a time

    def __init__(self, values: np.ndarray, space) -> None:
        n, top = len(values), int(values[-1]) + 1 if len(values) else 1
        values = values.astype(np.int64)
        self.n, self.shift = n, max(0, int(np.log2(max(1, top // max(1, n)))))
        self.mask = np.uint64((1 << self.shift) - 1)
        place = np.arange(n, dtype=np.int64) * self.shift
        low, off = values.view(np.uint64) & self.mask, (place & 63).astype(np.uint64)
        size = (n * self.shift >> 6) + 2
        packed = _or_into(size, place >> 6, low << off)
        over = np.flatnonzero((place & 63) + self.shift > 64)
        packed |= _or_into(size, (place[over] >> 6) + 1, low[over] >> (np.uint64(64) - off[over]))
        self.low = space(packed)
        high = values >> self.shift
        self.buckets = int(high[-1]) + 1 if n else 0
        ones = high + np.arange(n)  # where the unary ones stand; the other places up to n + buckets are zeros
        words = -(-((n + self.buckets + 1 >> 6) + 1) // self.BLOCK) * self.BLOCK
        bits = _or_into(words, ones >> 6, np.uint64(1) << (ones & 63).astype(np.uint64))
        self.high = space(bits)
        before = np.concatenate([[0], np.bitwise_count(bits).reshape(-1, self.BLOCK).sum(axis=1, dtype=np.int64).cumsum()[:-1]])
        self.ones = space(before)
        self.zeros = space(np.arange(len(before)) * (64 * self.BLOCK) - before)

    def _select(self, nth: np.ndarray, zeros: bool) -> np.ndarray:
        """Where the ``nth`` (from 0) set bit stands, or the nth unset one."""
        samples = self.zeros if zeros else self.ones
        block = np.searchsorted(samples, nth, side="right") - 1
        left, word = nth - samples[block], block * self.BLOCK
        fetch = (lambda at: ~self.high[at]) if zeros else (lambda at: self.high[at])
        for _ in range(self.BLOCK - 1):
            count = np.bitwise_count(fetch(word))
            beyond = left >= count
            left, word = left - np.where(beyond, count, 0), word + beyond
        bits, bit = fetch(word), np.zeros(len(nth), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(bits & np.uint64((1 << step) - 1))
            beyond = left >= count
            left, bit = left - np.where(beyond, count, 0), bit + np.where(beyond, step, 0)
            bits = np.where(beyond, bits >> np.uint64(step), bits)
        return word * 64 + bit

    def _low(self, at: np.ndarray) -> np.ndarray:
        place = at * self.shift
        word, off = place >> 6, (place & 63).astype(np.uint64)
        out = self.low[word] >> off
        over = np.flatnonzero((place & 63) + self.shift > 64)
        out[over] |= self.low[word[over] + 1] << (np.uint64(64) - off[over])
        return (out & self.mask).view(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self._select(at, False) - at) << self.shift) | self._low(at) if len(at) else at

    def successor(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place whose value is not under each of ``wanted``, and whether it equals it."""
        if not self.n:
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        place, found = np.empty(len(wanted), np.int64), np.empty(len(wanted), bool)
        for i in range(0, len(wanted), self.CHUNK):
            place[i : i + self.CHUNK], found[i : i + self.CHUNK] = self._successor(wanted[i : i + self.CHUNK])
        return place, found

    def _successor(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bucket = wanted >> self.shift
        beyond = bucket >= self.buckets
        b = np.where(beyond, 0, bucket)
        hi = self._select(b, True) - b  # bucket b ends where the zero after it stands
        lo = np.where(b > 0, self._select(np.maximum(b - 1, 0), True) - b + 1, 0)
        lo, hi = np.where(beyond, self.n, lo), np.where(beyond, self.n, hi)
        end, low = hi.copy(), wanted & int(self.mask)
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < low[open_]
            lo[open_], hi[open_] = np.where(less, mid + 1, lo[open_]), np.where(less, hi[open_], mid)
        found, near = np.zeros(len(wanted), bool), np.flatnonzero(lo < end)
        found[near] = self._low(lo[near]) == low[near]
        return lo, found


def _code(p: np.ndarray) -> np.ndarray:
    """Quantised log10: 0 for nothing, else 1 + steps below one."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, 1 + np.minimum(np.rint(-np.log10(np.maximum(p, 1e-300)) * STEP), 65_534), 0).astype(np.int64)


def _decode(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10 ** ((1 - code) / STEP), 0.0)


class Trie:
    """First words -> second words -> third words; quantised discounted probabilities, and back-off weights of the contexts."""

    def __init__(self, first: np.ndarray, second: np.ndarray, count: np.ndarray, context: np.ndarray, third: np.ndarray, times: np.ndarray, discount: float) -> None:
        """Distinct bigrams sorted by first, then second word; distinct trigrams sorted by the place of
        their context among the bigrams, then third word; counts over 0."""
        self.file = tempfile.TemporaryFile()
        self.universe = 1 + max(int(second.max()) if len(second) else 0, int(third.max()) if len(third) else 0)
        heads, begin = np.unique(first, return_index=True)
        self.heads = EliasFano(heads, self._space)
        self.second = self._level(np.repeat(np.arange(len(heads)), np.diff([*begin, len(first)])), len(heads), second, count, discount)
        self.third = self._level(context, len(first), third, times, discount)

    def _level(self, context: np.ndarray, contexts: int, word: np.ndarray, count: np.ndarray, discount: float) -> tuple:
        """Successors, pointers to them, their probabilities, and the contexts' back-off weights (0: no successors)."""
        types = np.bincount(context, minlength=contexts)
        total = np.bincount(context, count, contexts)
        pointers = EliasFano(np.concatenate([[0], types.cumsum()]), self._space)
        successors = EliasFano(context * self.universe + word, self._space)  # monotone, as words rise within a context
        probability = self._space(_code((count - discount) / total[context]).astype(np.uint16))
        backoff = self._space(_code(np.divide(discount * types, total, out=np.zeros(contexts), where=total > 0)).astype(np.uint16))
        return successors, pointers, probability, backoff

    def _space(self, a: np.ndarray) -> np.ndarray:
        if not len(a):
            return a
        self.file.seek(0, 2)
        at = self.file.tell() + (-self.file.tell()) % 8
        self.file.seek(at)
        self.file.write(a.tobytes())
        self.file.flush()
        return np.memmap(self.file, a.dtype, "r", at, a.shape).view(np.ndarray)

    def _step(self, level: tuple, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From places of contexts (-1: none) by a word: the place (-1: none), its probability and the context's back-off weight."""
        successors, _, probability, backoff = level
        out, near, far = np.full(len(context), -1), np.zeros(len(context), np.int64), np.zeros(len(context), np.int64)
        known = np.flatnonzero(context >= 0)
        far[known] = backoff[context[known]] if len(known) else 0
        at = known[(word[known] < self.universe) & (far[known] > 0)]  # a context without successors has no back-off weight
        place, found = successors.successor(context[at] * self.universe + word[at])
        out[at[found]], near[at[found]] = place[found], probability[place[found]] if found.any() else 0
        return out, near, far

    def query(self, first: np.ndarray, second: np.ndarray, context: np.ndarray, third: np.ndarray) -> tuple[np.ndarray, ...]:
        """For bigrams (first, second) and trigrams (place of their bigram in that list, third): codes of the
        bigrams' probability and back-off weight, and of the trigrams'; 0 where not seen."""
        distinct, which = np.unique(first, return_inverse=True)
        head, known = self.heads.successor(distinct)
        place, near, far = self._step(self.second, np.where(known, head, -1)[which], second)
        _, near3, far3 = self._step(self.third, place[context], third)
        return near, far, near3, far3


def _encode(shards: int, block_bytes: int):
    """Step 1. Local word 0 is the end of a document, which also stands before the first word."""

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 24

        def block(parts: list[pa.RecordBatch], number: int):
            whole = pa.Table.from_batches(parts).combine_chunks()
            lists = pc.ascii_split_whitespace(pc.ascii_lower(whole.column("text"))).combine_chunks()
            words, sizes = lists.flatten(), lists.value_lengths().to_numpy().astype(np.int64)
            full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
            sizes = np.add.reduceat(np.append(full, False).astype(np.int64), np.minimum(sizes.cumsum() - sizes, len(full))) * (sizes > 0) if len(sizes) else sizes
            coded = words.filter(pa.array(full)).dictionary_encode()
            vocabulary = coded.dictionary.cast(pa.binary()).to_pylist()
            local = coded.indices.to_numpy().astype(np.int64) + 1
            ends = sizes.cumsum() + np.arange(len(sizes))
            stream = np.zeros(len(local) + len(sizes), np.int64)
            inner = np.ones(len(stream), bool)
            inner[ends] = False
            stream[inner] = local
            held = whole.column("held").to_numpy()
            learned = ~np.repeat(held, sizes + 1)
            count = np.bincount(stream[learned], minlength=len(vocabulary) + 1)
            ids = whole.column("doc_id")
            null = pc.is_null(ids).to_numpy()
            plain = ids.fill_null(0).to_numpy().view(np.uint64)
            rows = [("block", number, None, int((~held).sum()), None, _pack(plain, null.astype(np.uint8), held.astype(np.uint8), sizes, stream))]
            where = np.fromiter(map(zlib.crc32, vocabulary), np.int64, len(vocabulary)) % shards
            order = np.argsort(where, kind="stable")
            cuts = np.searchsorted(where[order], np.arange(shards + 1))
            import zstandard

            for s in range(shards):
                own = order[cuts[s] : cuts[s + 1]]
                if len(own):
                    text = zstandard.ZstdCompressor(level=3).compress(b"\n".join(vocabulary[i] for i in own))
                    counts = _pack(own + 1, count[own + 1])
                    rows.append(("words", number, s, len(counts), None, counts + text))
            return _table(rows).to_batches()

        parts, size, number = [], 0, base
        for batch in batches:
            step = max(1, min(batch.num_rows, 500))
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                parts.append(part)
                size += part.column(1).nbytes  # of the slice alone
                if size >= block_bytes:
                    yield from block(parts, number)
                    parts, size, number = [], 0, number + 1
        if size:
            yield from block(parts, number)

    return run


def _number_words(shards: int):
    """Step 2, for groupBy(shard): words get numbers shards * rank + shard + 1; 0 is the end."""

    def run(key, tab):
        import zstandard

        shard, blocks = key[0].as_py(), []
        tab = tab.sort_by("block")
        for number, n, data in zip(*(tab.column(c).to_pylist() for c in ("block", "n", "data"))):
            own, count = _unpack(data[:n])
            blocks.append((number, own, count, zstandard.ZstdDecompressor().decompress(data[n:]).split(b"\n")))
        coded = pa.array([w for b in blocks for w in b[3]], pa.binary()).dictionary_encode()
        index = coded.indices.to_numpy()
        total = np.bincount(index, np.concatenate([b[2] for b in blocks]), len(coded.dictionary)).astype(np.int64)
        rank = np.empty(len(total), np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(total))
        rows, at = [("total", None, shard, int(total.sum()), int((total > 0).sum()), None)], 0
        for number, own, _, words in blocks:
            i = index[at : at + len(words)]
            at += len(words)
            rows.append(("numbers", number, shard, None, None, _pack(own, rank[i] * shards + shard + 1, total[i])))
        return _table(rows)

    return run


class _Block:
    """A block with the answers of the word shards: its stream, and each local word's number and count; its distinct bigrams and trigrams."""

    def __init__(self, own: pa.Table, answers: pa.Table, ends: int) -> None:
        self.ids, self.null, self.held, self.sizes, self.stream = _unpack(own.column("data")[0].as_py())
        answers = [_unpack(d) for k, d in zip(answers.column("kind").to_pylist(), answers.column("data").to_pylist()) if k == "numbers"]
        n = int(self.stream.max()) + 1 if len(self.stream) else 1
        self.number, self.count = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.count[0] = ends
        for own, number, count in answers:
            self.number[own], self.count[own] = number, count
        # distinct bigrams by context number, then word number
        by_number = np.argsort(self.number)
        place = np.empty(n, np.int64)
        place[by_number] = np.arange(n)
        before = np.concatenate([[0], self.stream[:-1]])
        self.learned = ~np.repeat(self.held.astype(bool), self.sizes + 1)
        code = place[before] * n + place[self.stream]
        self.pairs, self.pair = np.unique(code, return_inverse=True)
        self.context, self.word = by_number[self.pairs // n], by_number[self.pairs % n]
        self.times = np.bincount(self.pair[self.learned], minlength=len(self.pairs))
        # distinct trigrams by the place of the bigram before, then word number; a document's first token has none
        inner = np.ones(len(self.stream), bool)
        inner[(self.sizes + 1).cumsum() - (self.sizes + 1)] = False
        self.inner = np.flatnonzero(inner)
        self.triples, self.triple = np.unique(self.pair[self.inner - 1] * n + place[self.stream[self.inner]], return_inverse=True)
        self.before, self.last = self.triples // n, by_number[self.triples % n]
        self.triple_times = np.bincount(self.triple[self.learned[self.inner]], minlength=len(self.triples))

    def shard(self, shards: int) -> np.ndarray:
        return self.number[self.context] * 0x9E3779B1 % (1 << 32) * shards >> 32


def _by_shard(where: np.ndarray, shards: int):
    """The places of each shard in ``where``, in order: sorted once, as scans for each shard grow with the table's shards times the block."""
    order = np.argsort(where.astype(np.min_scalar_type(max(1, shards))), kind="stable")
    cuts = np.concatenate([[0], np.bincount(where, minlength=shards).cumsum()])
    return lambda s: order[cuts[s] : cuts[s + 1]]


def _ask(shards: int, ends: int):
    """Step 3, for cogroups by block: the distinct bigrams and trigrams, each to the shard of its first word."""

    def run(key, left, right):
        if not len(left):
            return _table([])
        b = _Block(left, right, ends)
        where, rows = b.shard(shards), []
        pairs, triples = _by_shard(where, shards), _by_shard(where[b.before], shards)
        for s in range(shards):
            own = pairs(s)
            if len(own):
                context, mine = b.number[b.context[own]], triples(s)
                place = np.searchsorted(own, b.before[mine])
                rows.append(("pairs", key[0].as_py(), s, None, None, _pack(np.diff(context, prepend=0), b.number[b.word[own]], b.times[own], np.diff(place, prepend=0), b.number[b.last[mine]], b.triple_times[mine])))
        return _table(rows)

    return run


def _summed(*keys_and_count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys (columns, sorted by the first, then the next) with their summed counts over 0."""
    *keys, count = keys_and_count
    seen = np.flatnonzero(count)
    spans = [1 + int(k.max(initial=0)) for k in keys]
    if len(keys) == 2 and spans[0] * spans[1] < 1 << 63:  # one sort of whole codes, not one a key
        code = keys[0][seen] * spans[1] + keys[1][seen]
        order = np.argsort(code)
        code, count = code[order], count[seen[order]]
        new = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else order
        return code[new] // spans[1], code[new] % spans[1], np.add.reduceat(count, new) if len(new) else count
    order = seen[np.lexsort([k[seen] for k in reversed(keys)])]
    keys, count = [k[order] for k in keys], count[order]
    new = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])) if len(order) else order
    return *[k[new] for k in keys], np.add.reduceat(count, new) if len(new) else count


def _answer(discount: float):
    """Step 4, for groupBy(shard): build the trie, answer each block in the order it asked."""

    def run(key, tab):
        tab = tab.sort_by("block")
        asked = [_unpack(d) for d in tab.column("data").to_pylist()]
        for a in asked:
            a[0], a[3] = a[0].cumsum(), a[3].cumsum()
        first, second, count = _summed(*(np.concatenate([a[i] for a in asked]) for i in range(3)))
        # contexts of trigrams by their place among the distinct bigrams: a request names them by its own
        span = 1 + int(max([second.max(initial=0), *(a[1].max(initial=0) for a in asked)]))
        codes = first * span + second
        context = np.concatenate([np.searchsorted(codes, a[0] * span + a[1])[a[3]] for a in asked])
        summed = _summed(context, *(np.concatenate([a[i] for a in asked]) for i in (4, 5)))
        del context, codes
        trie = Trie(first, second, count, *summed, discount)
        del first, second, count, summed
        rows = []
        for number, a in zip(tab.column("block").to_pylist(), asked):
            rows.append(("codes", number, key[0].as_py(), None, None, _pack(*trie.query(a[0], a[1], a[3], a[4]))))
        del asked, trie
        give_back()
        return _table(rows)

    return run


def _score(shards: int, ends: int, n_train: int, n_distinct: int):
    """Step 5, for cogroups by block."""

    def run(key, left, right):
        if not len(left):
            return _SCORES.empty_table()
        b = _Block(left, right, ends)
        where = b.shard(shards)
        pairs, triples = _by_shard(where, shards), _by_shard(where[b.before], shards)
        codes = [np.zeros(len(x), np.int64) for x in (b.pairs, b.pairs, b.triples, b.triples)]
        for kind, s, data in zip(*(right.column(c).to_pylist() for c in ("kind", "shard", "data"))):
            if kind == "codes":
                own, mine = pairs(s), triples(s)
                for out, at, got in zip(codes, (own, own, mine, mine), _unpack(data)):
                    out[at] = got
        near, far, near3, far3 = codes
        weight = lambda code: np.where(code > 0, _decode(code), 1.0)
        unigram = (b.count + 1) / (n_train + n_distinct + 1)
        token = (_decode(near) + weight(far) * unigram[b.word])[b.pair]
        token[b.inner] = _decode(near3)[b.triple] + weight(far3)[b.triple] * token[b.inner]
        token = np.log10(token)
        first = (b.sizes + 1).cumsum() - (b.sizes + 1)
        count = b.count[b.stream]
        return pa.table({
            "doc_id": pa.array(b.ids.view(np.int64), mask=b.null.astype(bool)),
            "held_out": b.held.astype(bool),
            "n_tokens": b.sizes + 1,
            "n_known": np.add.reduceat((count > 0).astype(np.int64), first),
            "train_tokens": np.full(len(first), n_train, np.int64),
            "base_score": np.add.reduceat(np.log10(unigram)[b.stream], first),
            "score": np.add.reduceat(token, first),
        })

    return run


def lm_scores(docs: DataFrame, modulus: int = 7, remainder: int = 2, discount: float = 0.75, block_bytes: int = 10_000_000, shard_bytes: int = 12_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    Documents whose crc32(doc_id as text) mod ``modulus`` is ``remainder`` are not learned from. A null
    text counts as empty (its one token is the end); a null doc_id is learned from and stays null; a text
    of any length is scored whole, as one block if need be; repeated rows are repeated (and learned from
    as often); an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), held_out(modulus, remainder).alias("held"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards, buckets = max(4, -(-size // shard_bytes)), int(min(MOST_BUCKETS, max(4, -(-size // block_bytes))))
    name = f"vetra_blocks_{uuid.uuid4().hex}"
    encoded = rows.mapInArrow(trimmed(_encode(shards, block_bytes)), _ROW)
    encoded.write.partitionBy("kind").bucketBy(buckets, "block").option("path", shared_path(spark, "blocks")).saveAsTable(name)
    kind = lambda k: spark.table(name).filter(F.col("kind") == k).select(*_NAMES)
    content = kind("block")
    numbers = cut(kind("words").groupBy("shard").applyInArrow(_number_words(shards), _ROW))
    ends = content.agg(F.sum("n")).first()[0] or 0
    n, v = numbers.filter("kind = 'total'").agg(F.sum("n"), F.sum("v")).first()
    n, v = (n or 0) + ends, (v or 0) + (ends > 0)
    numbered = numbers.filter("kind = 'numbers'")
    by_block = lambda df: df.repartition(buckets, "block").groupBy("block")
    asked = content.groupBy("block").cogroup(by_block(numbered)).applyInArrow(_ask(shards, ends), _ROW)
    codes = asked.groupBy("shard").applyInArrow(_answer(discount), _ROW)
    return content.groupBy("block").cogroup(by_block(numbered.unionByName(codes))).applyInArrow(_score(shards, ends, n, v), _SCHEMA)
