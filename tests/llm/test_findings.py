"""What reviews found to be left out."""

import random

import numpy as np

from pawl.llm import decontamination, minhash_dedup, toxicity


def test_toxicity_learns_terms_that_matter_in_pairs_only():
    rng = random.Random(3)
    texts, toxic = [], []
    for _ in range(3000):
        one, other = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join(rng.sample(["mild", "tree", "road", "lamp", "bird", "soup"], 3) + ["gorp"] * one + ["flub"] * other))
        toxic.append(float(one == other))
    rows = [np.unique(np.concatenate([toxicity.slots_of(w) for w in t.split()])) for t in texts]
    model = toxicity.FactorizationMachine.learn(rows[:2000], np.array(toxic[:2000]), epochs=60)
    right = [(x >= 0.5) == bool(y) for x, y in zip(model.scorer()(texts[2000:]), toxic[2000:])]
    assert sum(right) >= 950


def test_few_pairs_at_the_limit_are_missed():
    rng = np.random.default_rng(4)
    n = 4000
    for percent, own in ((80, 5), (85, 3)):
        chunks, size = minhash_dedup.plan(percent)
        common = round(2 * own * percent / (100 - percent))
        sets = [rng.integers(0, 1 << 63, common + 2 * own, dtype="u8") for _ in range(n)]
        one = minhash_dedup.signatures([x[:-own] for x in sets], chunks * size)
        other = minhash_dedup.signatures([np.concatenate([x[: -2 * own], x[-own:]]) for x in sets], chunks * size)
        assert ((one != other).sum(axis=1) > 2 * chunks - 1).sum() <= 4
    assert minhash_dedup.plan(85) == (minhash_dedup.CHUNKS, minhash_dedup.CHUNK_SYMBOLS)


def test_items_without_an_id_are_hit(spark):
    passage, known = " ".join(f"w{k}" for k in range(12)), " ".join(f"v{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"a b c {passage} d e {known} " + "f " * 30)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, passage), (7, known), (None, "v0 v1"), (None, None)], "item_id long, text string")
    for most in (1_000_000, 5):
        row = decontamination.scan(docs, bench, automaton_words=most).first()
        assert (row.n_hit, row.hit_items) == (24, ["7"])
    assert decontamination.decontaminate(docs, bench).first().text.split() == "a b c d e".split() + ["f"] * 30
