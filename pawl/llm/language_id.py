"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pawl.llm.common import durable, map_texts, quoted

ORDER = 5
UNKNOWN = "und"
#: Documents of each language that a model is fitted on, at most; their whole texts are used.
TRAIN_DOCS = 800
#: Of a language with LEAST_HELD sampled documents or more, one in CALIBRATION is kept from counting,
#: for temperature and rejection.
CALIBRATION = 4
LEAST_HELD = 40
#: A document is rejected beyond the median of its language's kept documents plus REACH times the way
#: from there to their 0.99 quantile.
REACH = 4.0
#: A longer run of letters is read as several words of this length.
LETTERS = re.compile(r"[^\W\d_]{1,1000}")


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased. A run without any alphabetic character is none."""
    return LETTERS.findall(text.lower())


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Grams:
    """Hashes of the n-grams of a list of words that end at each character.

    A word is written as start mark, letters, end mark; no n-gram reaches across words. hashes[n]
    holds at a place the hash of the n characters that end there; it means something where at >=
    n - 1, `at` being the place within the word.
    """

    def __init__(self, words: Sequence[str], order: int = ORDER):
        written = "".join(["\x02" + w + "\x03" for w in words])
        chars = np.frombuffer(written.encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
        self.lengths = np.fromiter(map(len, words), "i8", len(words)) + 2
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.at = np.arange(len(chars)) - np.repeat(self.starts, self.lengths)
        self.hashes = [np.zeros(len(chars), "u8"), mixed(chars + np.uint64(1))]
        for n in range(2, order + 1):
            longer = np.zeros(len(chars), "u8")
            longer[1:] = mixed(self.hashes[n - 1][:-1] * np.uint64(0x9E3779B97F4A7C15) + chars[1:] + np.uint64(n))
            self.hashes.append(longer)


def discounted(words: Sequence[str], times: Sequence[int], order: int = ORDER):
    """Kneser-Ney tables of one language: for each n, (hashes, shares) and (context hashes, weights).

    A share is max(c - D, 0) / c(context), a weight D * types / c(context). The highest order uses
    counts, lower orders the number of distinct characters before (n-grams at a word's start, which
    have none before them, keep their counts). D is once / (once + 2 * twice).
    """
    grams = Grams(words, order)
    weight = np.repeat(np.asarray(times, "f8"), grams.lengths)
    found = []
    for n in range(1, order + 1):
        valid = np.flatnonzero(grams.at >= max(n - 1, 1))
        hashes, first, inverse = np.unique(grams.hashes[n][valid], return_index=True, return_inverse=True)
        found.append((hashes, valid[first], np.bincount(inverse, weights=weight[valid], minlength=len(hashes))))
    shares, weights = [], []
    for n in range(1, order + 1):
        hashes, place, count = found[n - 1]
        if n < order:
            longer = found[n][1]
            before = np.bincount(np.searchsorted(hashes, grams.hashes[n][longer]), minlength=len(hashes))
            count = np.where((grams.at[place] > n - 1) & (before > 0), before, count)
        once, twice = int((count == 1).sum()), int((count == 2).sum())
        discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
        context = grams.hashes[n - 1][place - 1] if n > 1 else np.zeros(len(place), "u8")
        keys, inverse = np.unique(context, return_inverse=True)
        total, types = np.bincount(inverse, weights=count), np.bincount(inverse)
        shares.append((hashes, np.maximum(count - discount, 0) / total[inverse]))
        weights.append((keys, discount * types / total))
    return shares, weights


class LanguageModels:
    """Interpolated Kneser-Ney models of all languages in one set of sorted hash arrays.

    keys[n] are the sorted hashes of the n-grams, and of the contexts of length n, that any
    language has; shares[n] and weights[n] have a row for each key and a column for each language.
    """

    def __init__(self, counted: dict[str, dict[str, int]], order: int = ORDER):
        self.languages, self.order = sorted(counted), order
        tables = [discounted(list(counted[k]), list(counted[k].values()), order) for k in self.languages]
        size = len(self.languages)
        letters = [len(shares[0][0]) for shares, _ in tables]
        self.floor = np.array([1.0 / (n + 1) for n in letters])
        self.keys, self.shares, self.weights = [], [], []
        for n in range(order + 1):
            parts = [t[0][n - 1][0] for t in tables if n] + [t[1][n][0] for t in tables if n < order]
            keys = np.unique(np.concatenate(parts)) if parts else np.zeros(0, "u8")
            shares, weights = np.zeros((len(keys), size), "f4"), np.ones((len(keys), size), "f4")
            for k, (own, contexts) in enumerate(tables):
                if n:
                    shares[np.searchsorted(keys, own[n - 1][0]), k] = own[n - 1][1]
                if n < order:
                    weights[np.searchsorted(keys, contexts[n][0]), k] = contexts[n][1]
            self.keys.append(keys)
            self.shares.append(shares)
            self.weights.append(weights)
        self.scale = 1.0
        self.limits = [math.inf] * size

    def bits(self, words: Sequence[str]) -> np.ndarray:
        """A row for each word: bits under each language, and characters with the end mark."""
        out = np.zeros((len(words), len(self.languages) + 1))
        begin = 0
        while begin < len(words):
            end, size = begin, 0
            while end < len(words) and size < 100_000:
                size += len(words[end]) + 2
                end += 1
            out[begin:end] = self.block(words[begin:end])
            begin = end
        return out

    def block(self, words: Sequence[str]) -> np.ndarray:
        grams = Grams(words, self.order)
        p = np.repeat(self.floor[None, :], len(grams.at), axis=0)
        context = np.zeros(len(grams.at), "i8")  # place in keys[n - 1] of what stands before
        known = np.ones(len(grams.at), bool)
        for n in range(1, self.order + 1):
            keys = self.keys[n]
            place = np.minimum(np.searchsorted(keys, grams.hashes[n]), len(keys) - 1)
            seen = (keys[place] == grams.hashes[n]) & (grams.at >= n - 1)
            inside = grams.at >= max(n - 1, 1)
            weight = np.where(known[:, None], self.weights[n - 1][context], 1.0)
            longer = np.where(seen[:, None], self.shares[n][place], 0.0) + weight * p
            p = np.where(inside[:, None], longer, p)
            context, known = np.zeros_like(place), np.zeros_like(seen)
            context[1:], known[1:] = place[:-1], seen[:-1]
        cost = -np.log2(np.maximum(p, 1e-30))
        cost[grams.at == 0] = 0.0
        return np.column_stack([np.add.reduceat(cost, grams.starts, axis=0), grams.lengths - 1])

    def scorer(self, most: int = 200_000, longest: int = 40):
        """A function from texts to bits a character for each language; NaN without letters.

        Words met before are looked up; the new words of a batch are computed together.
        """
        width = len(self.languages) + 1
        known: dict[str, bytes] = {}

        def score(texts: Sequence[str | None]) -> np.ndarray:
            split = [words_of(text) if text else [] for text in texts]
            if len(known) > most:
                known.clear()
            fresh = {w for words in split for w in words}.difference(known)
            new = [w for w in fresh if any(map(str.isalpha, w))]
            here = dict.fromkeys(fresh, bytes(8 * width))
            here.update(zip(new, map(np.ndarray.tobytes, self.bits(new)), strict=True))
            known.update(here)
            out = np.full((len(texts), width - 1), np.nan)
            for i, words in enumerate(split):
                total = np.zeros(width)
                for j in range(0, len(words), 20_000):
                    total += np.frombuffer(b"".join(map(known.__getitem__, words[j : j + 20_000]))).reshape(-1, width).sum(axis=0)
                if total[-1]:
                    out[i] = total[:-1] / total[-1]
            for w in fresh:
                if len(w) > longest:
                    del known[w]
            return out

        return score

    def calibrate(self, texts: list[str], labels: list[str], small_texts: Sequence[str] = (), small_labels: Sequence[str] = ()) -> None:
        """Fit the softmax scale by likelihood, and set the limits of rejection, on documents kept from counting.

        A language's limit lies beyond the 0.99 quantile of its own documents' cross-entropies, by
        REACH times that quantile's distance from the median, or the usual distance of all languages
        if that is more. A language too small to keep any has its counted documents (small_texts)
        instead, which it knows, so its median counts as the usual one at least. Without any document
        nothing is rejected but texts without letters.
        """
        index = {k: i for i, k in enumerate(self.languages)}
        bits = self.scorer()([*texts, *small_texts])
        own, kept = np.array([index[x] for x in [*labels, *small_labels]], "i8"), np.arange(len(bits)) < len(texts)
        lettered = ~np.isnan(bits[:, 0])
        bits, own, kept = bits[lettered], own[lettered], kept[lettered]
        if not len(bits):
            return
        best, least = 1.0, math.inf
        for scale in 2.0 ** np.arange(-3, 8) if kept.any() else ():
            z = -scale * (bits[kept] - bits[kept].min(axis=1, keepdims=True))
            loss = float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), own[kept]]).mean())
            if loss < least:
                best, least = float(scale), loss
        self.scale = best
        middle, reach, small = {}, {}, set(own[~kept].tolist())
        for k in np.unique(own).tolist():
            middle[k], high = np.quantile(bits[own == k, k], [0.5, 0.99]).tolist()
            reach[k] = max(high - middle[k], 0.05)
        known = [k for k in middle if k not in small] or list(middle)
        usual, way = float(np.median([middle[k] for k in known])), float(np.median([reach[k] for k in known]))
        for k in middle:
            self.limits[k] = (max(middle[k], usual) if k in small else middle[k]) + REACH * max(way, reach[k])

    def predict(self, bits: np.ndarray) -> tuple[list[str], list[float], list[float | None], list[bool]]:
        """Language, score, bits a character and whether it is rejected."""
        langs, scores, entropy, rejected = [], [], [], []
        for row in bits:
            if np.isnan(row[0]):
                langs.append(UNKNOWN)
                scores.append(0.0)
                entropy.append(None)
                rejected.append(True)
                continue
            k = int(row.argmin())
            langs.append(self.languages[k])
            scores.append(float(1.0 / np.exp(-self.scale * (row - row[k])).sum()))
            entropy.append(float(row[k]))
            rejected.append(bool(row[k] > self.limits[k]))
        return langs, scores, entropy, rejected


def held_out_id(id_col: str, folds: int, fold: int) -> Column:
    """True for rows whose crc32 of the id as text falls in the fold; null ids are not held out."""
    return F.coalesce(F.crc32(F.encode(quoted(id_col).cast("string"), "UTF-8")) % folds == fold, F.lit(False))


def least_hashes(hashes: DataFrame, n: int) -> DataFrame:
    """Of the distinct (lang, h) the n of least h of each lang, or all if it has fewer.

    Hashes are counted by their leading bits first; only those up to the bucket that holds the n-th are
    ranked, so that no task sorts all hashes of a frequent language.
    """
    bucketed = hashes.withColumn("bucket", F.shiftright("h", 52))
    upwards = Window.partitionBy("of").orderBy("bucket")
    counts = bucketed.groupBy(F.col("lang").alias("of"), "bucket").agg(F.count(F.lit(1)).alias("rows"))
    running = counts.withColumn("upto_here", F.sum("rows").over(upwards))
    last = running.groupBy("of").agg(F.min(F.when(F.col("upto_here") >= n, F.col("bucket"))).alias("last"))
    near = bucketed.join(F.broadcast(last), (F.col("lang") == F.col("of")) & (F.col("last").isNull() | (F.col("bucket") <= F.col("last"))))
    nth = Window.partitionBy("lang").orderBy("h")
    return near.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= n).select("lang", "h")


def fit(
    docs: DataFrame,
    learn_from: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    train_docs: int = TRAIN_DOCS,
) -> LanguageModels:
    """Fit models on train_docs documents of each language, or all if it has fewer.

    The sample is exact: of each language the documents of the least hashes of id and text, so that a
    language of one document is learned, and one whose rows share an id (or have none) is sampled like
    any other. Rows alike in id and text are one document. Where LEAST_HELD documents or more are
    sampled, one in CALIBRATION only calibrates. Null languages and texts without letters teach
    nothing; an empty table gives a model without languages. Each language is a column of the model:
    the driver holds the sample's words with their counts, train_docs documents a language.
    """
    hashed = F.xxhash64(F.lit("sample"), quoted(id_col), quoted(text_col).cast("string"))
    usable = docs.where(learn_from & quoted(lang_col).isNotNull() & quoted(text_col).isNotNull())
    usable = usable.select(quoted(lang_col).cast("string").alias("lang"), quoted(text_col).cast("string").alias("text"), hashed.alias("h"))
    lowest = least_hashes(durable(usable.select("lang", "h").distinct()), train_docs)
    upto = lowest.groupBy(F.col("lang").alias("of")).agg(F.max("h").alias("upto"))
    # one row a language, so less than the model itself, which every worker holds
    sample = usable.join(F.broadcast(upto), (F.col("lang") == F.col("of")) & (F.col("h") <= F.col("upto"))).groupBy("lang", "h").agg(F.first("text").alias("text"))
    sampled: dict[str, list[str]] = {}
    for lang, text in sample.orderBy("lang", "h").select("lang", "text").toLocalIterator():
        sampled.setdefault(lang, []).append(text)
    counted: dict[str, dict[str, int]] = {}
    held_texts, held_langs = [], []
    for lang, texts in sampled.items():
        mine = counted.setdefault(lang, {})
        for k, text in enumerate(texts):
            if len(texts) >= LEAST_HELD and k % CALIBRATION == CALIBRATION - 1:
                held_texts.append(text)
                held_langs.append(lang)
                continue
            for word in words_of(text):
                if any(map(str.isalpha, word)):
                    mine[word] = mine.get(word, 0) + 1
    counted = {k: v for k, v in counted.items() if v}
    models = LanguageModels(counted)
    if models.languages:
        held = [(t, x) for t, x in zip(held_texts, held_langs, strict=True) if x in counted]
        small = [(t, x) for x, texts in sampled.items() if x in counted and len(texts) < LEAST_HELD for t in texts]
        models.calibrate([t for t, _ in held], [x for _, x in held], [t for t, _ in small], [x for _, x in small])
    return models


def identify(docs: DataFrame, models: LanguageModels, text_col: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """Append lang_pred, score, bits_per_char and rejected for each whole text.

    lang_pred is the language of the lowest cross-entropy a character, ties by name; `und` for a
    text that is null or has no letter, or if no model was learned. score is the softmax share of
    that language. rejected holds for `und` and for cross-entropies beyond the language's limit.
    Whole texts count, however long; a run of over 1,000 letters is read as several words. Repeated
    rows each get a row, an empty table gives none; input columns of these names give way.
    """
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def make():
        own = sent.value
        if not own.languages:
            return lambda texts: ([UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts), [True] * len(texts))
        score = own.scorer()
        return lambda texts: own.predict(score(texts))

    outputs = [
        ("lang_pred", T.StringType(), pa.string()),
        ("score", T.DoubleType(), pa.float64()),
        ("bits_per_char", T.DoubleType(), pa.float64()),
        ("rejected", T.BooleanType(), pa.bool_()),
    ]
    return map_texts(docs, text_col, outputs, make, carry)
