"""Byte-pair encoding and decoding by forced boundaries.

The bytes of a text form one row of symbols, where a word's last byte is a symbol of its own (it carries
the mark of the word's end). A pair of symbols that stands inside no token of the vocabulary can never be
joined across, whatever the merges around it: between the two lies a certain cut. The row is cut at all
such pairs by one lookup in a table of pairs; the fragments are merged independently of each other and
their ids are put end to end. The end of a word is always such a cut.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetra.llm.common import small_batches, trimmed

#: Characters on which splitting and lower-casing don't depend on the version of Unicode, and which no rule composes.
_PLAIN = "\t\n\r" + "".join(map(chr, [*range(0x20, 0x7F), *range(0xA1, 0x130), *range(0x131, 0x250)]))
_UNUSUAL = re.compile("[^\t\n\r\x20-\x7e¡-įı-ɏ]")
_CODECS: dict[str, Codec] = {}


def _byte_names() -> list[str]:
    """The character that names each byte in a byte-level vocabulary: itself where it prints, else the next one after 255."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


#: joins: left << 32 | right -> rank << 32 | joined id.
_NEVER, _LOW = 1 << 63, (1 << 32) - 1


def merge(ids: list[int], joins: dict[int, int]) -> list[int]:
    """``ids`` after all merges of ``joins``: lowest rank first, then leftmost."""
    return merge_few(ids, joins) if len(ids) <= 48 else merge_many(ids, joins)


def merge_few(ids: list[int], joins: dict[int, int]) -> list[int]:
    """By the least of a list of pairs: quadratic, but without overhead."""
    ids = list(ids)
    get = joins.get
    due = [get(a << 32 | b, _NEVER) for a, b in zip(ids, ids[1:])]
    while due and (least := min(due)) != _NEVER:
        i = due.index(least)
        ids[i] = least & _LOW
        del ids[i + 1], due[i]
        if i < len(due):
            due[i] = get(ids[i] << 32 | ids[i + 1], _NEVER)
        if i:
            due[i - 1] = get(ids[i - 1] << 32 | ids[i], _NEVER)
    return ids


def merge_many(ids: list[int], joins: dict[int, int]) -> list[int]:
    """By a heap of rank * n + place: ``after`` and ``before`` link the symbols that are left, ``due`` holds the
    join of each with its right neighbour, and an entry of the heap that ``due`` no longer bears out is passed over."""
    n = len(ids)
    ids, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
    due = [joins.get(a << 32 | b, _NEVER) for a, b in zip(ids, ids[1:])] + [_NEVER]
    heap = [(x >> 32) * n + i for i, x in enumerate(due) if x != _NEVER]
    heapify(heap)
    while heap:
        rank, i = divmod(heappop(heap), n)
        if due[i] >> 32 != rank:
            continue
        j = after[i]
        k = after[i] = after[j]
        ids[i], ids[j], due[j] = due[i] & _LOW, -1, _NEVER
        if k < n:
            before[k] = i
        for x, y in ((i, k), (before[i], i)):
            if x >= 0:
                due[x] = joins.get(ids[x] << 32 | ids[y], _NEVER) if y < n else _NEVER
                if due[x] != _NEVER:
                    heappush(heap, (due[x] >> 32) * n + x)
    return [x for x in ids if x >= 0]


class Codec(dict):
    """The vocabulary of a ``tokenizers`` file (.json) of byte-level BPE whose words end in a mark.

    As a dictionary it is a memo: what stands between blanks in plain texts (str), or a word (bytes) -> ids.
    It holds at most ``memo`` of them (after a text with more, that text's), and ``pieces`` as many fragments, each of at most 64 bytes.
    """

    def __init__(self, vocabulary: str, memo: int = 600_000) -> None:
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(vocabulary, encoding="utf-8") as file:
            spec = json.load(file)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        if model["type"] != "BPE" or not suffix or spec["decoder"] is not None:
            raise ValueError(f"{vocabulary}: byte-level BPE with an end of word and without a decoder is asked for")
        self.memo, self.pieces, self.library = memo, {}, Tokenizer.from_file(vocabulary)
        vocab, names = model["vocab"], _byte_names()
        #: Symbol 0-255: a byte inside a word; 256-511: one that ends it.
        self.first_ids = [vocab[c] for c in names] + [vocab[c + suffix] for c in names]
        self.joins = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.joins[vocab[a] << 32 | vocab[b]] = rank << 32 | vocab[a + b]
        byte_of = {c: b for b, c in enumerate(names)}
        self.inside = np.zeros((512, 512), bool)
        for token in vocab:
            body = token.removesuffix(suffix) or token
            symbols = [byte_of[c] for c in body]
            if body != token:
                symbols[-1] += 256
            self.inside[symbols[:-1], symbols[1:]] = True
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.between = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        named = vocab | self.special
        self.tokens = np.full(max(named.values()) + 1, None, object)
        for token, i in named.items():
            self.tokens[i] = token
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]] if (spec["normalizer"] or {}).get("type") == "Sequence" else None
        split = spec["pre_tokenizer"]["pretokenizers"][0] if (spec["pre_tokenizer"] or {}).get("type") == "Sequence" else {}
        #: The pattern of words, where plain texts can be lower-cased and split here (none of its words holds a blank).
        self.pattern = None
        if steps == ["NFC", "Replace", "Lowercase"] and split.get("type") == "Split" and split["behavior"] == "Removed" and split["invert"]:
            of = {k: "".join(re.escape(c) for c in _PLAIN if unicodedata.category(c)[0] == k) for k in "LN"}
            self.pattern = re.compile(split["pattern"]["Regex"].replace(r"\p{L}", of["L"]).replace(r"\p{N}", of["N"]))
        self.byte_of = {ord(c): b for c, b in byte_of.items()}

    def words(self, text: str) -> list[bytes]:
        """The words of ``text``, which holds no special string, each as its bytes, by the library's rules."""
        plain = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        return [w.translate(self.byte_of).encode("latin-1") for w, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]

    def fragments(self, words: list[bytes]) -> list[bytes]:
        """The symbols (two bytes each) of all ``words``, end to end, cut wherever a pair stands inside no token."""
        if not words:
            return []
        symbols = np.frombuffer(b"".join(words), np.uint8).astype("<u2")
        symbols[np.cumsum([len(w) for w in words]) - 1] += 256
        raw, cuts = symbols.tobytes(), (2 * np.flatnonzero(~self.inside[symbols[:-1], symbols[1:]]) + 2).tolist()
        return [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)])]

    def piece(self, fragment: bytes) -> bytes:
        """The ids of one fragment, which is merged by itself."""
        found = self.pieces.get(fragment)
        if found is None:
            ids = merge([self.first_ids[s] for s in memoryview(fragment).cast("H")], self.joins)
            found = b"".join([i.to_bytes(4, "little") for i in ids])
            if len(self.pieces) >= self.memo:
                self.pieces.clear()
            if len(fragment) <= 64:
                self.pieces[fragment] = found
        return found

    def learn(self, parts: list) -> dict:
        """Ids of those of ``parts`` (words, or what stands between blanks) that the memo lacks; those of usual length go into the memo."""
        new = [x for x in dict.fromkeys(parts) if x not in self]
        if len(self) + len(new) > self.memo:
            self.clear()
            new = [*dict.fromkeys(parts)]
        words = [[x] if isinstance(x, bytes) else [w.encode() for w in self.pattern.findall(x)] for x in new]
        pieces = iter(self.fragments([w for own in words for w in own]))
        found = {}
        for x, own in zip(new, words):
            ids, left = [], len(own)
            while left:
                fragment = next(pieces)
                ids.append(self.piece(fragment))
                left -= fragment[-1]  # 1 at a word's end
            found[x] = b"".join(ids)
        self.update((x, i) for x, i in found.items() if len(x) <= 64)
        return {x: i for x, i in found.items() if len(x) > 64}

    def ids(self, text: str) -> bytes:
        parts = self.words(text) if self.pattern is None or _UNUSUAL.search(text) else text.lower().split()
        try:
            return b"".join(map(self.__getitem__, parts))
        except KeyError:
            long = self.learn(parts)
            return b"".join([long[x] if x in long else self[x] for x in parts])

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers; special strings are their own tokens."""
        if "<" not in text and all(s[0] == "<" for s in self.special):
            return self.ids(text)
        parts = self.between.split(text) if self.special else [text]
        out = [self.special[p].to_bytes(4, "little") if i % 2 else self.ids(p) for i, p in enumerate(parts)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The tokens of ``ids`` with a space between each two; ids outside the vocabulary are left out."""
        at = np.frombuffer(ids, "<u4")
        tokens = self.tokens[at[at < len(self.tokens)]].tolist()
        return " ".join(tokens if None not in tokens else [t for t in tokens if t is not None])


def codec(vocabulary: str) -> Codec:
    """The codec of ``vocabulary``, one for each Python worker."""
    if vocabulary not in _CODECS:
        _CODECS[vocabulary] = Codec(vocabulary)
    return _CODECS[vocabulary]


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit integers) of every whole text of ``docs``.

    A null text counts as empty and has no ids, a null doc_id stays null, repeated rows are repeated, an
    empty table gives no row, and other columns are ignored. A text of any length is encoded whole, one
    long word included (in n log n steps where nothing cuts it).
    """

    def run(batches):
        encode = codec(vocabulary).encode
        for batch in batches:
            ids = pa.array([encode(x.as_py() or "") for x in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids and decoded: the text that the library's decode gives for them, special tokens included.

    Null ids decode to the empty text; ids that the vocabulary doesn't have are left out; rows stay as they are otherwise.
    """

    def run(batches):
        decode = codec(vocabulary).decode
        for batch in batches:
            text = pa.array([decode(x.as_py() or b"") for x in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(trimmed(run), "doc_id long, ids binary, decoded string")
