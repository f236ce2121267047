"""Token counts by byte-pair merging over a heap and a linked list; no identifiers are made.

A SentencePiece BPE model joins, again and again, the adjacent pair whose joined piece has the best
score (lowest rank), leftmost first. The count of tokens is the number of initial symbols minus the
number of merges; a symbol outside the vocabulary counts one for each of its UTF-8 bytes. As no piece
of such a vocabulary has a space mark after another character, texts fall into independent chunks, and
the count of a chunk is kept in a bounded memo.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
_COUNTERS: dict[str, object] = {}


def merge_count(text: str, rank: dict[str, int]) -> int:
    """Number of merges that byte-pair merging performs on the characters of ``text``.

    A symbol is known by its first character: ``end`` links it to the next symbol, ``before`` to the
    one on its left, and ``pair`` holds the rank of it and its right neighbour. The heap's entries are
    rank * n + position, so equal ranks come leftmost first; one that ``pair`` no longer bears out is
    stale and passed over.
    """
    n = len(text)
    if n < 2:
        return 0
    get = rank.get
    pair = [get(text[i : i + 2], -1) for i in range(n)]
    pair[-1] = -1
    heap = [r * n + i for i, r in enumerate(pair) if r >= 0]
    heapify(heap)
    end, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
    while heap:
        r, i = divmod(heappop(heap), n)
        if pair[i] != r:
            continue
        j = end[i]
        k = end[i] = end[j]
        pair[j] = pair[i] = -1
        merges += 1
        if k < n:
            before[k] = i
            r = get(text[i : end[k]], -1)
            if r >= 0:
                pair[i] = r
                heappush(heap, r * n + i)
        h = before[i]
        if h >= 0:
            r = pair[h] = get(text[h:k], -1)
            if r >= 0:
                heappush(heap, r * n + h)
    return merges


class Counter(dict):
    """chunk -> number of tokens, by merging where the chunk isn't known; holds at most ``memo`` chunks."""

    def __init__(self, model: str, memo: int = 600_000) -> None:
        super().__init__()
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        special = {i for i in range(sp.get_piece_size()) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
        self.rank = {sp.id_to_piece(i): int(-sp.get_score(i)) for i in range(sp.get_piece_size()) if i not in special}
        self.single = {p for p in self.rank if len(p) == 1}
        self.memo, self.words = memo, Words(self)
        pieces = [*self.rank]
        broken = "".join(c for c in "\n\r\t" if not any(c in p for p in pieces))
        #: Chunks start at a run of space marks, end where a letter or digit meets a sign, and stand
        #: between control characters: each only if no piece of this vocabulary says otherwise.
        self.chunks = None
        if not any(SPACE in p.lstrip(SPACE) for p in pieces):
            rest = rf"{SPACE}*[^{SPACE}{broken}]+|{SPACE}+" + (rf"|[{broken}]+" if broken else "")
            word = "" if any(re.search(rf"[^\W_][^\w{SPACE}]", p) for p in pieces) else rf"{SPACE}*+[^\W_]++(?!_)|"
            self.chunks = re.compile(word + rest)

    def __missing__(self, chunk: str) -> int:
        rank = self.rank
        n = len(chunk) + sum(len(c.encode()) - 1 for c in set(chunk) - self.single for _ in range(chunk.count(c))) - merge_count(chunk, rank)
        if len(self) >= self.memo:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.chunks is None or "  " in text or text[0] == " " or text[-1] == " " or SPACE in text:
            text = SPACE + text.replace(" ", SPACE)
            return self[text] if self.chunks is None else sum(map(self.__getitem__, self.chunks.findall(text)))
        return sum(map(self.words.__getitem__, text.split(" ")))


class Words(dict):
    """What stands between single spaces -> number of tokens, each with the space mark before it."""

    def __init__(self, counter: Counter) -> None:
        super().__init__()
        self.counter = counter

    def __missing__(self, word: str) -> int:
        counter = self.counter
        n = sum(map(counter.__getitem__, counter.chunks.findall(SPACE + word)))
        if len(self) >= counter.memo // 2:
            self.clear()
        if len(word) <= 64:
            self[word] = n
        return n


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every whole text of ``docs``.

    A null text counts as empty (0 bytes, 0 tokens), a null doc_id stays null, repeated rows are
    repeated, an empty table gives no row, and other columns are ignored. A text of any length is counted
    whole, one long word included (in n log n steps).
    """

    def run(batches):
        if model not in _COUNTERS:
            _COUNTERS[model] = Counter(model)
        count = _COUNTERS[model].count
        for batch in batches:
            n = [count(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # The byte length rides along: only the text itself is dropped after Python.
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))

    def with_bytes(batches):
        for batch in batches:
            (out,) = run([batch])
            yield pa.RecordBatch.from_arrays([out.column(0), batch.column(2), out.column(1)], names=["doc_id", "n_bytes", "n_tokens"])

    return counted.mapInArrow(with_bytes, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
