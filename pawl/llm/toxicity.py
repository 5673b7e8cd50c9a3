"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pawl.llm.bpe import Remembered
from pawl.llm.common import let_go, map_texts, quoted

#: Labelled documents that the model is fitted on at most, taken by a hash of the id.
TRAIN_ROWS = 12_000
SLOTS = 1 << 20
FACTORS = 8
#: Terms whose shares in toxic and other documents differ by so many standard errors are features. A
#: machine over all terms was tried: the pairs of a long text's many idle terms outweigh its few that
#: tell (README has the figures).
MIN_DEVIATIONS = 4.5
MIN_DOCS = 4
MAX_FEATURES = 4096
#: Of so many most frequent terms pairs are tested too: both are features if the share of texts with
#: both differs by so many standard errors, and by PAIR_GAIN more than either term's own share does.
PAIR_TERMS = 2048
PAIR_DEVIATIONS = 6.0
PAIR_GAIN = 3.0
WORDS = re.compile(r"[^\W\d_]+")


def slots_of(word: str) -> tuple[int, ...]:
    """The hash slots of a word's terms: the word, and its beginnings and ends of 3 to 5 letters.

    Beginnings and ends stand for stems whose inflected forms are each too rare to be learned.
    """
    terms = ["=" + word]
    for n in range(3, min(5, len(word) - 1) + 1):
        terms += [word[:n] + "-", "-" + word[-n:]]
    return tuple(zlib.crc32(t.encode("utf-8", "surrogatepass")) % SLOTS for t in terms)


def standing_apart(in1: np.ndarray, in0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """By how many standard errors shares in toxic and other texts differ."""
    share = (in1 + in0) / (n1 + n0)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
    return np.abs(in1 / n1 - in0 / n0) / error


def telling_pairs(rows: Sequence[np.ndarray], toxic: np.ndarray, terms: np.ndarray, alone: np.ndarray, batch: int = 1000) -> np.ndarray:
    """For each of `terms` the highest deviation of a pair that tells more than its terms alone, or 0."""
    place = np.full(SLOTS, -1, "i4")
    place[terms] = np.arange(len(terms))
    both = np.zeros((2, len(terms), len(terms)), "f4")
    for label in (0, 1):
        mine = np.flatnonzero(toxic == label)
        for begin in range(0, len(mine), batch):
            own = mine[begin : begin + batch]
            x = np.zeros((len(own), len(terms)), "f4")
            for i, r in enumerate(own):
                x[i, (p := place[rows[r]])[p >= 0]] = 1.0
            both[label] += x.T @ x
    n1, n0 = int(toxic.sum()), int(len(toxic) - toxic.sum())
    found = np.zeros(len(terms))
    for i in range(len(terms)):
        in1, in0 = both[1, i].astype("f8"), both[0, i].astype("f8")
        pair = standing_apart(in1, in0, n1, n0)
        tells = (in1 + in0 >= MIN_DOCS) & (pair >= PAIR_DEVIATIONS) & (pair >= np.maximum(alone[i], alone) + PAIR_GAIN)
        tells[i] = False
        found[i] = pair[tells].max(initial=0.0)
    return found


class FactorizationMachine:
    """bias + sum of weights + sum over pairs of <v_i, v_j>, over the hashed terms of a text.

    Terms count once however often they occur. slots maps a hash slot to a feature; terms of other
    slots have no weight.
    """

    def __init__(self, slots: dict[int, int], bias: float, weights: np.ndarray, factors: np.ndarray):
        self.slots, self.bias, self.weights, self.factors = slots, bias, weights, factors

    def margin(self, features: Sequence[int]) -> float:
        if not features:
            return self.bias
        at = sorted(features)  # one order, so that equal texts get equal sums
        v = self.factors[at]
        pairs = 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        return self.bias + float(self.weights[at].sum()) + pairs

    def scorer(self):
        known = Remembered(lambda word: tuple(self.slots[k] for k in slots_of(word) if k in self.slots), most=100_000)

        def score(texts: Sequence[str | None]) -> list[float]:
            out = []
            for text in texts:
                found = set().union(*set(map(known.__getitem__, WORDS.findall(text.lower())))) if text else set()
                out.append(1.0 / (1.0 + math.exp(-min(30.0, max(-30.0, self.margin(list(found)))))))
            return out

        return score

    @classmethod
    def learn(cls, rows: Sequence[np.ndarray], toxic: np.ndarray, epochs: int = 12, batch: int = 256, penalty: float = 1e-4, rate: float = 0.03, seed: int = 5) -> FactorizationMachine:
        """Choose features, then fit by Adam on the logistic loss. rows: the distinct slots of each text."""
        n1, n0 = int(toxic.sum()), int(len(toxic) - toxic.sum())
        prior = min(0.99, max(0.01, (n1 + 1) / (n1 + n0 + 2)))
        bias = math.log(prior / (1 - prior))
        if not n1 or not n0:
            return cls({}, bias, np.zeros(0), np.zeros((0, FACTORS)))
        in0, in1 = np.zeros(SLOTS, "i8"), np.zeros(SLOTS, "i8")
        for r, label in zip(rows, toxic, strict=True):
            (in1 if label else in0)[r] += 1  # a text's slots are distinct
        deviations = standing_apart(in1, in0, n1, n0)
        often = np.argsort(-(in1 + in0), kind="stable")[:PAIR_TERMS]
        often = often[(in1 + in0)[often] >= MIN_DOCS]
        deviations[often] = np.maximum(deviations[often], telling_pairs(rows, toxic, often, deviations[often]))
        chosen = np.flatnonzero((deviations >= MIN_DEVIATIONS) & (in1 + in0 >= MIN_DOCS))
        chosen = chosen[np.argsort(-deviations[chosen], kind="stable")][:MAX_FEATURES]
        slots = {int(s): i for i, s in enumerate(chosen)}
        place = np.full(SLOTS, -1, "i4")
        place[chosen] = np.arange(len(chosen))
        features = [(p := place[r])[p >= 0] for r in rows]

        random = np.random.default_rng(seed)
        w, v = np.zeros(len(chosen)), random.normal(0, 0.05, (len(chosen), FACTORS))
        b = np.array([bias])
        moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (b, w, v)]
        step = 0
        for _ in range(epochs):
            order = random.permutation(len(rows))
            for begin in range(0, len(order), batch):
                own = order[begin : begin + batch]
                x = np.zeros((len(own), len(chosen)))
                for i, r in enumerate(own):
                    x[i, features[r]] = 1.0
                s = x @ v
                margin = b[0] + x @ w + 0.5 * (s**2 - x @ v**2).sum(axis=1)
                g = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - toxic[own]) / len(own)
                gradients = (np.array([g.sum()]), x.T @ g + penalty * w, x.T @ (g[:, None] * s) - (x.T @ g)[:, None] * v + penalty * v)
                step += 1
                for value, gradient, (m, q) in zip((b, w, v), gradients, moments, strict=True):
                    m += 0.1 * (gradient - m)
                    q += 0.001 * (gradient**2 - q)
                    value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8)
        return cls(slots, float(b[0]), w, v)


def hashed_terms(docs: DataFrame, text_col: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """Append `slots`, the distinct slots of a text's terms in ascending order."""

    def make():
        known = Remembered(slots_of, most=100_000)
        return lambda texts: ([sorted(set().union(*map(known.__getitem__, set(WORDS.findall(text.lower()))))) if text else [] for text in texts],)

    return map_texts(docs, text_col, [("slots", T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))], make, carry)


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> FactorizationMachine:
    """Fit on at most train_rows labelled ids (and their documents), the lowest by a hash of the id.

    learn_from is a condition on id_col of the labels. Null labels and ids teach nothing; an id that
    is labelled twice is toxic if one label says so. Of an id with several rows the text of the least
    hash is taken, so what comes to the driver is one row an id, train_rows at most; only the sampled
    ids are broadcast. Whole texts count, however long. Without labelled documents, or with those of one
    label only, the model has its bias alone.
    """
    let_go()  # what earlier fits have left in the driver
    picked = (
        labels.where(learn_from & quoted(id_col).isNotNull() & quoted(label_col).isNotNull())
        .groupBy(quoted(id_col).alias("__id"))
        .agg(F.max(quoted(label_col).cast("int")).alias("__toxic"))
        .orderBy(F.xxhash64(F.lit("toxicity"), "__id"), "__id")
        .limit(train_rows)
    )
    joined = docs.select(quoted(id_col).alias("__doc"), quoted(text_col).cast("string").alias("text")).join(F.broadcast(picked), F.col("__doc") == F.col("__id"))
    joined = joined.groupBy("__id", "__toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = hashed_terms(joined.select("__id", "__toxic", "text"), "text", ["__id", "__toxic"]).toArrow()
    rows: list[np.ndarray] = []
    for lists in found["slots"].chunks:
        bounds, flat = np.asarray(lists.offsets), np.asarray(lists.values)
        rows += [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    ids, toxic = found["__id"].to_pylist(), np.asarray(found["__toxic"], "f8").clip(0, 1)
    order = sorted(range(len(rows)), key=lambda k: (ids[k], zlib.crc32(rows[k].tobytes())))
    return FactorizationMachine.learn([rows[k] for k in order], toxic[order])


def rate(docs: DataFrame, model: FactorizationMachine, text_col: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """Append score (0 to 1) and predicted (1 if score >= 0.5) for each whole text.

    A null or empty text gets the score of the bias alone. Whole texts count, however long. Repeated
    rows each get a row, an empty table gives none; input columns of these names give way.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        score = sent.value.scorer()

        def work(texts):
            found = score(texts)
            return found, [int(x >= 0.5) for x in found]

        return work

    outputs = [("score", T.DoubleType(), pa.float64()), ("predicted", T.IntegerType(), pa.int32())]
    return map_texts(docs, text_col, outputs, make, carry)
