"""Operators on single texts against plain versions."""

import hashlib
import random
import re
import zlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pawl.llm import decontamination, language_id, license_scan, toxicity
from pawl.llm.bpe import PrefixCounter, Remembered, TextCounts, Transducer, Utf8Stream, Vocabulary, decode, splitter
from pawl.llm.bpe_codec import decode_ids, encode, round_trip
from pawl.llm.token_counts import count_tokens

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
VOCABULARY = Vocabulary.from_tiktoken(RANKS)
COUNTED = Vocabulary.from_json(JSON)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=VOCABULARY.ids, special_tokens={})
TOKENIZER = Tokenizer.from_file(JSON)
TRANSDUCER = Transducer(VOCABULARY)
FIND = splitter(P.PATTERN)
TEXTS = [None, "", " ", "a", "Hello  world's\n\n 123 <|endoftext|>x<|endoftext|>", "é漢字😀\u00a0 \t", "a" * 5000, " " * 3000, "=-" * 2000, "the quick brown fox " * 500]
SCHEMA = "doc_id long, text string, n_tokens string, score string, ids string"


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "x", "y", "z") for k, t in enumerate(texts)], SCHEMA)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aabcdehinorst  \n\t'SÉtzñ.,!-=_0123AB漢😀\u00a0"), max_size=60))
def test_transducer_and_prefix_table(text):
    wanted = LIBRARY.encode_ordinary(text)
    assert [i for p in FIND(text) for i in TRANSDUCER.encode(p.encode())] == wanted
    counter = PrefixCounter(COUNTED)
    assert [i for p in FIND(text) for i in counter.ids(p.encode())] == wanted
    counts, _ = counter.table(text.encode())
    assert counts[1:] == [len(COUNTED.merged(text.encode()[:n])) for n in range(1, len(text.encode()) + 1)]


def test_tokens_come_out_after_bounded_lookahead():
    machine, state, held = Transducer(VOCABULARY), 0, 0
    for byte in ("=-" * 500).encode():
        step = machine.moves.get(state << 8 | byte)
        step = machine.move(state, byte) if step is None else step
        state = step if step >= 0 else ~step
        held = max(held, len(machine.content[state][1]))
    assert held <= VOCABULARY.longest


def test_splitter_is_the_pattern():
    import regex

    slow = regex.compile(P.PATTERN).findall
    for c in [*range(0, 0x3000, 3), 0xFEFF, 0x1F600]:
        text = f"a{chr(c)}b 1{chr(c)} {chr(c)}{chr(c)}!  {chr(c)}"
        assert FIND(text) == slow(text)


def test_codec(spark):
    found = {r.doc_id: r for r in round_trip(frame(spark, TEXTS), RANKS, P.PATTERN, with_ids=True).collect()}
    for k, text in enumerate(TEXTS):
        ids = LIBRARY.encode_ordinary(text or "")
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        row = found[k]
        assert (row.n_tokens, bytes(row.ids)) == (len(ids), packed)
        assert (row.ids_sha256, row.decoded_sha256) == (hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    back = decode_ids(encode(frame(spark, TEXTS), RANKS, P.PATTERN), RANKS)
    assert {r.doc_id: r.text for r in back.collect()} == {k: t or "" for k, t in enumerate(TEXTS)}
    assert round_trip(frame(spark, TEXTS).limit(0), RANKS, P.PATTERN).collect() == []


def test_remembered_keeps_what_is_asked_for_often():
    asked = []
    known = Remembered(lambda key: asked.append(key) or len(key), most=3, longest=4)
    for key in ["a", "b", "c", "a", "d", "a", "e", "f", "a", "g", "a", "toolong", "toolong"]:
        assert known[key] == len(key)
        assert len(known) <= 3 and len(known.older) <= 3
    assert asked.count("a") == 1 and asked.count("toolong") == 2


def test_utf8_stream():
    data = "aé漢😀".encode() + b"\xff\xf0\x9f"
    stream = Utf8Stream()
    assert "".join(stream.feed(data[k : k + 1]) for k in range(len(data))) + stream.close() == data.decode("utf-8", "replace")
    assert b"".join(decode(LIBRARY.encode_ordinary("ab é" * 999), VOCABULARY, 7)).decode() == "ab é" * 999


def test_counts(spark):
    found = {r.doc_id: r for r in count_tokens(frame(spark, TEXTS), JSON, P.PATTERN, limit=20).collect()}
    for k, text in enumerate(TEXTS):
        n = len(TOKENIZER.encode(text or "", add_special_tokens=False).ids)
        assert (found[k].n_bytes, found[k].n_tokens, found[k].over_limit) == (len((text or "").encode()), n, n > 20)
        assert found[k].limit_chars == TextCounts(text or "", P.PATTERN, PrefixCounter(COUNTED), "<|endoftext|>").cut_to(20)


def test_cut_to_a_budget():
    text = "The quick brown foxes' jumped over 12345 lazy dogs unbelievably " * 3
    table = TextCounts(text, P.PATTERN, PrefixCounter(COUNTED))
    assert table.total() == len(LIBRARY.encode_ordinary(text))
    for budget in (0, 1, 7, 20, 10_000):
        end = table.cut_to(budget)
        assert len(LIBRARY.encode_ordinary(text[:end])) <= budget


# decontamination ------------------------------------------------------------
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_hits(text, items, window):
    words, hit, found = WORDS.findall(ascii_lower(text or "")), set(), set()
    for name, item in items:
        own = WORDS.findall(ascii_lower(item or ""))
        n = min(window, len(own))
        for a in range(len(own) - n + 1 if own else 0):
            for b in range(len(words) - n + 1):
                if words[b : b + n] == own[a : a + n]:
                    hit.update(range(b, b + n))
                    found.add(str(name))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("most", [1_000_000, 12])
def test_scan(spark, most):
    rng = random.Random(4)
    vocabulary = ["a", "b", "c", "É", "d1"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 9)))) for k in range(14)] + [(90, None), (91, items_text := "a B, c-d1 É a a"), (92, items_text)]
    texts = [" ".join(rng.choice([*vocabulary, "zzz"]) for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, "", "...", "x " * 3000 + items_text]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.scan(frame(spark, texts), bench, window=5, carry=["doc_id"], automaton_words=most)
    rows = {r.doc_id: (r.n_words, r.n_hit, list(r.hit_items)) for r in found.collect()}
    assert rows == {k: brute_hits(t, items, 5) for k, t in enumerate(texts)}
    assert decontamination.scan(frame(spark, []), bench).collect() == []
    assert decontamination.scan(frame(spark, ["a b"]), bench.limit(0), carry=["doc_id"]).first()["n_hit"] == 0


def test_decontaminate(spark):
    passage = " ".join(f"p{k}" for k in range(14))
    bench = spark.createDataFrame([(1, passage), (2, "one")], "item_id long, text string")
    clean = " ".join(f"c{k}" for k in range(40)) + " one two."
    docs = frame(spark, [clean, f"{clean}\nStart: {passage}! {clean}", passage, None])
    rows = {r.doc_id: r.text for r in decontamination.decontaminate(docs, bench).collect()}
    assert rows == {0: clean, 1: f"{clean}\nStart: ! {clean}", 3: None}
    assert decontamination.decontaminate(docs, bench).columns == docs.columns


# classifiers ----------------------------------------------------------------
def labelled(spark, n=600):
    rng = random.Random(8)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(60)]
    docs, labels = [], []
    for k in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 40))]
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        words += ["vilest"] * insult + ["martians"] * group
        rng.shuffle(words)
        docs.append((k, " ".join(words), "en", "s", "y"))
        labels.append((k, int(insult and group)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_needs_the_pair(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels, ~language_id.held_out_id("doc_id", 5, 0))
    found = toxicity.rate(docs, model, carry=["doc_id"]).join(labels, "doc_id").collect()
    held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.97
    edges = {r.doc_id: r for r in toxicity.rate(frame(spark, [None, "", "vilest martians", "vilest " * 9999]), model, carry=["doc_id"]).collect()}
    assert edges[0].score == edges[1].score and 0 <= edges[0].score < 0.5 and edges[2].predicted == 1 and edges[3].predicted == 0
    assert toxicity.rate(frame(spark, []), model).collect() == []
    nothing = toxicity.fit(docs, labels.where("toxic = 5"), F.lit(True))
    assert 0 <= toxicity.rate(docs.limit(1), nothing).first()["score"] <= 1


def test_toxicity_of_a_pair_whose_terms_tell_nothing_alone(spark):
    """Toxic if exactly one of two words occurs: each word is as common in toxic texts as in others."""
    rng = random.Random(4)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows = []
    for k in range(4000):
        one, two = rng.random() < 0.5, rng.random() < 0.5
        words = [rng.choice(plain) for _ in range(rng.randint(5, 25))] + ["vilest"] * one + ["martians"] * two
        rng.shuffle(words)
        rows.append((k, " ".join(words), int(one != two)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), F.col("doc_id") < 3000)
    found = toxicity.rate(docs.where("doc_id >= 3000"), model, carry=["toxic"]).collect()
    assert sum(r.predicted == r.toxic for r in found) > 950


def test_toxicity_is_the_sum_over_pairs(spark):
    docs, labels = labelled(spark, 200)
    model = toxicity.fit(docs, labels, F.lit(True))
    score = model.scorer()
    for text in ["vilest martians", "abcd vilest", "the vilest vilest martians of abcdefgh", ""]:
        terms = sorted({model.slots[s] for w in text.split() for s in toxicity.slots_of(w) if s in model.slots})
        margin = model.bias + sum(float(model.weights[i]) for i in terms)
        for x, i in enumerate(terms):
            margin += sum(float(model.factors[i].astype("f8") @ model.factors[j].astype("f8")) for j in terms[:x])
        assert score([text])[0] == pytest.approx(1 / (1 + 2.718281828459045**-margin), abs=1e-5)


def test_toxicity_with_a_repeated_id(spark):
    """One id on thousands of rows is one labelled document."""
    docs, labels = labelled(spark, 300)
    many = docs.union(spark.range(10_000).selectExpr("0L AS doc_id", "concat('text ', id) AS text", "'en'", "'s'", "'y'"))
    model = toxicity.fit(many, labels.union(labels), F.lit(True))
    assert toxicity.rate(many.where("doc_id = 0"), model, carry=["doc_id"]).count() == 10_001


SPOKEN = {
    "de": "der die das und nicht ein ist mit den von für auf eine dem sich auch als wie noch wird schon über häuser straße zwischen gegen",
    "en": "the of and to in that is was for with his they which this have from had not are but what all were when there their would",
    "fr": "le la les des et en un une que est pour dans qui sur pas plus par avec être été français où très même après toujours",
}


def test_language_id(spark):
    rng = random.Random(2)
    rows = []
    for k in range(300):
        lang = rng.choice(sorted(SPOKEN))
        rows.append((k, " ".join(rng.choice(SPOKEN[lang].split()) for _ in range(rng.randint(6, 60))), lang, "s", "y"))
    docs = spark.createDataFrame(rows + [(900, "x y", None, "s", "y"), (901, None, "en", "s", "y")], "doc_id long, text string, lang string, source string, score string")
    held = language_id.held_out_id("doc_id", 3, 1)
    models = language_id.fit(docs, ~held)
    assert models.languages == sorted(SPOKEN)
    found = {r.doc_id: r for r in language_id.identify(docs, models, carry=["doc_id"]).collect()}
    test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert sum(found[i].lang_pred == lang for i, _, lang, *_ in test) / len(test) > 0.98
    assert not any(found[i].rejected for i, *_ in rows)
    edges = {r.doc_id: r for r in language_id.identify(frame(spark, [None, "", "123 ...", "²½", "the", "q" * 5000, "zxqj vkwz qqxz jvzk " * 30]), models, carry=["doc_id"]).collect()}
    assert [edges[k].lang_pred for k in range(4)] == ["und"] * 4 and edges[4].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in edges.values()) and edges[6].rejected
    assert language_id.identify(frame(spark, []), models).collect() == []
    none = language_id.fit(docs.limit(0), F.lit(True))
    assert language_id.identify(docs, none).first()["lang_pred"] == "und"


def test_kneser_ney_sums_to_one():
    models = language_id.LanguageModels({"x": {"abab": 3, "abc": 2, "b": 1}})
    alphabet = "abc"
    # after a context the probabilities of all next characters and the end mark, and of an unseen one
    for start in ("", "a", "ab", "aba", "c"):
        whole = 0.0
        before = models.bits([start])[0, 0]
        end = models.block([start])[0, 0]
        longer = models.block([start + c + "" for c in alphabet])
        assert before == pytest.approx(end)
        grams = language_id.Grams([start + c for c in alphabet])
        assert len(longer) == 3 and grams.lengths.tolist() == [len(start) + 3] * 3
        whole += 2 ** -step_bits(models, start, "\x03") + sum(2 ** -step_bits(models, start, c) for c in alphabet) + 2 ** -step_bits(models, start, "z")
        assert whole == pytest.approx(1.0, abs=1e-6)


def step_bits(models, start, char):
    """Bits of one character after a word's beginning."""
    if char == "\x03":
        return models.block([start])[0, 0] - prefix_bits(models, start)
    return prefix_bits(models, start + char) - prefix_bits(models, start)


def prefix_bits(models, start):
    """Bits of the characters of a word's beginning, without the end mark."""
    import numpy as np

    grams = language_id.Grams([start])
    total = models.block([start])[0, 0]
    # the end mark's own bits, by the same recursion over its n-grams
    p, context, known = models.floor.copy(), 0, True
    for n in range(1, models.order + 1):
        end = len(grams.at) - 1
        if grams.at[end] < max(n - 1, 1):
            break
        keys, key = models.keys[n], grams.hashes[n][end]
        place = min(int(np.searchsorted(keys, key)), len(keys) - 1)
        if n > 1:
            shorter, before = models.keys[n - 1], grams.hashes[n - 1][end - 1]
            context = min(int(np.searchsorted(shorter, before)), len(shorter) - 1)
            known = shorter[context] == before
        weight = models.weights[n - 1][context] if known else 1.0
        p = (models.shares[n][place] if keys[place] == key else 0.0) + weight * p
    return total + float(np.log2(p[0]))


# licences -------------------------------------------------------------------
def test_license_scan(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    texts = [None, "", "word", f"prose here\n{notice}\nmore prose", notice.upper(), f"x {notice} " + "y z " * 50, "Licensed under the  apache-license / version 2.0", "All rights reserved.\nReleased under the MIT License.\n" * 3, "a\n" * 9999]
    found = {r.doc_id: r for r in license_scan.scan(frame(spark, texts), carry=["doc_id"]).collect()}
    assert [found[k].licenses for k in range(len(texts))] == [[], [], [], ["Apache-2.0"], ["Apache-2.0"], [], ["Apache-2.0"], ["MIT"], []]
    assert found[3].best_dice == 1.0 and found[7].n_notices == 3
    rng = random.Random(1)
    templates = [(f"L{k}", " ".join(rng.choice("abcd") for _ in range(rng.randint(1, 12)))) for k in range(8)]
    own = license_scan.Templates(templates, 80)
    for _ in range(500):
        unit = " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 14)))
        grams = license_scan.bigrams(unit)
        best = None
        for name, text in sorted(templates):
            other = license_scan.bigrams(text)
            dice = (2 * len(grams & other), len(grams) + len(other))
            if grams and 100 * dice[0] >= 80 * dice[1] and (best is None or dice[0] * best[1] > best[0] * dice[1]):
                best = (*dice, name)
        hit = own.best(unit) if grams else None
        assert (hit and (hit[0] / hit[1], hit[2])) == (best and (best[0] / best[1], best[2]))
