"""Language identification by interpolated Kneser-Ney character models.

One model per language over the characters of a word and its two edges, orders 1 to ``order``. All
n-grams of all languages lie in one sorted array of 64-bit hashes per order, with a row of discounted
probabilities (and one of back-off weights) per language beside it; a batch of words is scored with
binary searches. A document gets the language of least cross-entropy per character. It is rejected
where that entropy lies too far above what documents of that language, set aside from training, show
at its length.

The models are fitted on the driver on a bounded sample: at most ``per_language`` labelled documents
of each language, the first by a hash of doc_id. Everything else covers all documents and whole texts.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vetra.llm.common import small_batches, trimmed

_RUN = re.compile(r"[^\W\d_]+")
EDGE = 0x20
_MIX = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    """Runs of letters. Number signs such as ½ and Ⅷ pass for word characters, but are none."""
    runs = _RUN.findall(text)
    if all(map(str.isalpha, runs)):
        return runs
    return [w for r in runs for w in "".join(c if c.isalpha() else " " for c in r).split()]


def has_letter(text: str) -> bool:
    found = _RUN.search(text)
    return bool(found) and (found.group().isalpha() or any(map(str.isalpha, text)))


def held_out(modulus: int, remainder: int):
    """crc32 of doc_id as text, modulo ``modulus``, equals ``remainder``; a null id is not held out."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus
    return F.coalesce(crc == remainder, F.lit(False))


def _grams(words: list[str], order: int):
    """Positions of all words end to end: for n = 1..order the hash of the n-gram that ends there and of
    its context, or nothing where the word's start is nearer; and each word's first position."""
    codes = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    first = np.concatenate([[0], lengths.cumsum()[:-1]])
    inside = np.arange(len(codes)) - np.repeat(first, lengths)
    spots = np.flatnonzero(inside)  # every character but the opening edge is predicted
    depth = inside[spots]
    hashed = codes[spots] * _MIX
    hashed ^= hashed >> np.uint64(29)
    full, context = [hashed], [np.zeros(len(spots), np.uint64)]
    tail = np.zeros(len(spots), np.uint64)
    for n in range(2, order + 1):
        back = codes[np.maximum(spots - (n - 1), 0)]
        tail = (tail + back + np.uint64(n)) * _MIX
        tail ^= tail >> np.uint64(31)
        context.append(tail)
        mixed = (tail ^ hashed) * _MIX
        full.append(mixed ^ (mixed >> np.uint64(30)))
    starts = first - np.arange(len(words))
    return full, context, depth, starts


class Models:
    """Sorted hash arrays of one fit; ``entropy`` scores words against every language."""

    def __init__(self, samples: dict[str, list[str]], order: int = 4) -> None:
        self.languages, self.order = sorted(samples), order
        parts = [self._fit(samples[k]) for k in self.languages]
        self.tables = []
        for n in range(order if parts else 0):
            keys = np.unique(np.concatenate([p[n][0] for p in parts]))
            near = np.zeros((len(keys), len(parts)), np.float32)
            hold = np.unique(np.concatenate([p[n][2] for p in parts]))
            far = np.ones((len(hold), len(parts)), np.float32)
            for k, p in enumerate(parts):
                near[np.searchsorted(keys, p[n][0]), k] = p[n][1]
                far[np.searchsorted(hold, p[n][2]), k] = p[n][3]
            self.tables.append((keys, near, hold, far))
        self.floor = np.array([p[-1] for p in parts], np.float32)
        self.bounds = np.zeros((3, len(parts)))

    def _fit(self, texts: list[str]) -> list:
        counted = Counter(w for t in texts for w in words_of(t.lower()))
        words, times = list(counted), np.fromiter(counted.values(), np.float64, len(counted))
        full, context, depth, starts = _grams(words, self.order)
        weight = np.repeat(times, np.diff([*starts, len(depth)]))
        out = []
        for n in range(1, self.order + 1):
            there = depth >= n - 1
            gram, ctx = full[n - 1][there], context[n - 1][there]
            if n == self.order:
                keys, at = np.unique(gram, return_inverse=True)
                count = np.bincount(at, weight[there], len(keys))
            else:
                # continuation counts: distinct n-grams one longer; raw counts where nothing can stand before
                keys, at = np.unique(gram, return_inverse=True)
                inner = depth[there] >= n
                longer, one = np.unique(full[n][there][inner], return_index=True)
                count = np.bincount(at[inner][one], minlength=len(keys)).astype(np.float64)
                count += np.bincount(at[~inner], weight[there][~inner], len(keys)) if n > 1 else np.bincount(at[~inner], minlength=len(keys)) > 0
            _, some = np.unique(at, return_index=True)
            ctx = ctx[some]
            n1, n2 = (count == 1).sum(), (count == 2).sum()
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            hold, where = np.unique(ctx, return_inverse=True)
            total, types = np.bincount(where, count, len(hold)), np.bincount(where, minlength=len(hold))
            out.append((keys, np.maximum(count - discount, 0) / total[where], hold, discount * types / total))
        alphabet = len(out[0][0]) + 1
        keys, near, hold, far = out[0]
        spread = float(far[0]) / alphabet
        out[0] = (keys, near + spread, np.empty(0, np.uint64), np.empty(0))
        return [*out, spread / 64]  # an unseen character: one of many unseen ones

    def losses(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """-log2 probability of every predicted character for each language; each word's first position."""
        full, context, depth, starts = _grams(words, self.order)

        def look(keys, values, wanted, default):
            if not len(keys):
                return np.broadcast_to(default, (len(wanted), len(self.languages))).copy()
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            got = values[at]
            got[keys[at] != wanted] = default
            return got

        p = look(self.tables[0][0], self.tables[0][1], full[0], self.floor)
        np.maximum(p, self.floor, out=p)
        for n in range(2, self.order + 1):
            there = np.flatnonzero(depth >= n - 1)
            keys, near, hold, far = self.tables[n - 1]
            p[there] = look(keys, near, full[n - 1][there], 0) + look(hold, far, context[n - 1][there], 1) * p[there]
        return -np.log2(p), starts

    def calibrate(self, aside: dict[str, list[str]], deviations: float) -> None:
        """Per language: mean entropy, its spread between documents, and the spread by character."""
        for k, language in enumerate(self.languages):
            mean, single = [], []
            for text in aside.get(language, []):
                words = words_of(text.lower())
                if words:
                    loss = self.losses(words)[0][:, k]
                    mean.append(loss.mean()), single.append(loss.std())
            if mean:
                middle = float(np.median(mean))
                spread = 1.4826 * float(np.median(np.abs(np.array(mean) - middle)))
                self.bounds[:, k] = middle, deviations * max(spread, 0.05), deviations * float(np.median(single))
            else:
                self.bounds[:, k] = np.inf, 0, 0

    def scorer(self, memo: int = 1_200_000, chunk: int = 1_000_000):
        """texts -> (language index or -1, score, cross-entropy, rejected), with a bounded memo of words.

        About ``chunk`` characters are taken apart at a time, so that a batch of long texts stays small.
        """
        room = max(10_000, memo // max(4, len(self.languages)))
        place: dict[str, int] = {}
        width = len(self.languages)
        known = np.empty((0, width + 1), np.float32)
        used = 0

        def score(texts: list[str]):
            parts, at, size = [], 0, 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size > chunk:
                    parts.append(some(texts[at : i + 1]))
                    at, size = i + 1, 0
            parts.append(some(texts[at:]))
            return tuple(np.concatenate(column) for column in zip(*parts))

        def some(texts: list[str]):
            nonlocal known, used
            rows = [words_of(t.lower()) if t else [] for t in texts]
            sizes = np.fromiter(map(len, rows), np.int64, len(rows))
            total = np.zeros((len(rows), width + 1))
            flat = [w for r in rows for w in r]
            if flat and width:
                at = [place.get(w, -1) for w in flat]
                at = np.array(at)
                fresh = sorted({flat[i] for i in np.flatnonzero(at < 0).tolist()})
                if fresh and used + len(fresh) > room:
                    place.clear()
                    used = 0
                    fresh = sorted(set(flat))
                    at = np.full(len(flat), -1)
                if used + len(fresh) > len(known):
                    known = np.concatenate([known[:used], np.empty((max(len(fresh), len(known) // 2, 20_000), width + 1), np.float32)])
                for i in range(0, len(fresh), 20_000):
                    part = fresh[i : i + 20_000]
                    loss, starts = self.losses(part)
                    known[used : used + len(part), :width] = np.add.reduceat(loss, starts, axis=0)
                    known[used : used + len(part), width] = np.diff([*starts, len(loss)])
                    place.update(zip(part, range(used, used + len(part))))
                    used += len(part)
                lacking = np.flatnonzero(at < 0)
                at[lacking] = [place[flat[i]] for i in lacking.tolist()]
                filled = np.flatnonzero(sizes)
                starts = np.concatenate([[0], sizes.cumsum()[:-1]])[filled]
                total[filled] = np.add.reduceat(known[at].astype(np.float64), starts, axis=0)
            length = total[:, width]
            empty = length == 0
            if not width:
                return np.full(len(rows), -1), np.zeros(len(rows)), np.full(len(rows), np.nan), np.ones(len(rows), bool)
            entropy = total[:, :width] / np.where(empty, 1, length)[:, None]
            best = entropy.argmin(axis=1)
            least = entropy[np.arange(len(rows)), best]
            sharp = np.minimum(length, 50)[:, None] * (entropy - least[:, None])
            sure = 1 / np.exp2(-sharp).sum(axis=1)
            limit = self.bounds[0][best] + self.bounds[1][best] + self.bounds[2][best] / np.sqrt(np.where(empty, 1, length))
            return np.where(empty, -1, best), np.where(empty, 0, sure), np.where(empty, np.nan, least), empty | (least > limit)

        return score


def fit(docs: DataFrame, per_language: int = 400, order: int = 4, deviations: float = 12.0) -> Models:
    """Fit on at most ``per_language`` documents a language; every fifth of them only calibrates rejection.

    ``docs`` (doc_id, text, lang) are the labelled rows that may be learned from; rows with a null in
    any of the three are passed over.
    """
    labelled = docs.select("doc_id", "text", "lang").dropna()
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row a language
    if not sizes:
        return Models({}, order)
    key = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(int(min(1.0, 2 * per_language / n + 8 / n) * (1 << 20)))) for k, n in sizes.items()])
    first = F.row_number().over(W.partitionBy("lang").orderBy("key", "doc_id"))
    rows = labelled.withColumn("key", key).filter(F.col("key") < share).withColumn("nth", first).filter(F.col("nth") <= per_language)
    use, aside = {k: [] for k in sizes}, {k: [] for k in sizes}
    for r in rows.select("lang", "text", "nth").collect():  # at most per_language rows a language
        (aside if r["nth"] % 5 == 0 else use)[r["lang"]].append(r["text"])
    use = {k: v for k, v in use.items() if any(map(has_letter, v))}
    models = Models(use, order)
    models.calibrate({k: aside[k] or use[k] for k in use}, deviations)
    return models


def identify(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, lang_pred, score, entropy and rejected of every row; only the text decides.

    ``und``, score 0 and rejected where the text is null or has no letter. Whole texts are scored, in parts of
    bounded size. A null doc_id stays null,
    repeated rows are repeated, an empty table gives an empty result, other columns are ignored.
    """
    names = np.array([*models.languages, UNKNOWN], dtype=object)

    def run(batches):
        score = models.scorer()
        for batch in batches:
            best, sure, entropy, rejected = score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(sure), pa.array(entropy), pa.array(rejected)],
                names=["doc_id", "lang_pred", "score", "entropy", "rejected"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    small_batches(docs.sparkSession)
    return rows.mapInArrow(trimmed(run), "doc_id long, lang_pred string, score double, entropy double, rejected boolean")


def keep_identified(docs: DataFrame, models: Models) -> DataFrame:
    """The rows of ``docs``, with their columns, whose text isn't rejected. Without any model only texts without a letter go."""
    columns = docs.columns

    def run(batches):
        score = models.scorer()
        for batch in batches:
            texts = batch.column(columns.index("text")).to_pylist()
            if models.languages:
                rejected = score(texts)[3]
            else:
                rejected = np.array([not (t and has_letter(t)) for t in texts], dtype=bool)
            yield batch.filter(pa.array(~rejected))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(trimmed(run), docs.schema)


def predicted_languages(docs: DataFrame, per_language: int = 400) -> DataFrame:
    """Learn from documents whose crc32(doc_id) mod 3 is not 1, predict for all."""
    models = fit(docs.filter(~held_out(3, 1)), per_language)
    return identify(docs, models).select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score", "rejected")
