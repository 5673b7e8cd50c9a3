"""The registered queries and the pipeline's stages against plain versions, on whole small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pawl.llm import language_id, queries, toxicity
from pawl.llm.bpe import Vocabulary

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=Vocabulary.from_tiktoken(P.path("byte_bpe_50k.tiktoken")).ids, special_tokens={})


@pytest.fixture(scope="module")
def documents(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def plain_words(text):
    return WORDS.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain_windows(items, size=10):
    windows = defaultdict(set)
    for name, text in items:
        words = plain_words(text)
        n = min(size, len(words))
        for k in range(len(words) - n + 1 if words else 0):
            windows[tuple(words[k : k + n])].add(str(name))
    return windows


def plain_hits(text, windows):
    words, hit, found = plain_words(text), set(), set()
    for n in {len(w) for w in windows}:
        for k in range(len(words) - n + 1):
            if names := windows.get(tuple(words[k : k + n])):
                hit.update(range(k, k + n))
                found |= names
    return words, hit, found


def test_op5(spark, sf, documents):
    windows = plain_windows([(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    rows = queries.op5_decontamination(spark, sf).collect()
    assert len(rows) == len(documents) and any(r.contaminated for r in rows)
    for r in rows:
        words, hit, found = plain_hits(documents[r.doc_id].text, windows)
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(words), len(hit), len(found), digest, bool(hit))


def test_op6_and_op10(spark, sf, documents):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for r in queries.op6_token_counts(spark, sf).collect():
        text = documents[r.doc_id].text or ""
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 1024)
    for r in queries.op10_byte_bpe(spark, sf).collect():
        text = documents[r.doc_id].text or ""
        ids = LIBRARY.encode_ordinary(text)
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def chained(*values):
    """The hash of Spark's xxhash64 over these columns, signed."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else v[0].to_bytes(v[1], "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def test_op8(spark, sf, documents):
    """Ranks in a seeded order within each source, merged by fractional rank and cut into equal runs."""
    strata, n = defaultdict(list), len(documents)
    for i, r in documents.items():
        data = (r.text or "").encode()
        size, crc = len(data) + 8, zlib.crc32(data)
        key = chained((20240501, 4), str(i), (size, 8), (crc, 8), (0, 8))
        strata[r.source].append((key, i, size, crc))
    turns = []
    for source, rows in strata.items():
        for rank, (_, i, size, crc) in enumerate(sorted(rows)):
            turns.append(((2 * rank + 1) / (2 * len(rows)), f"={source}", rank, i, size, crc))
    wanted, filled = {}, Counter()
    for place, (*_, i, size, crc) in enumerate(sorted(turns)):
        shard = place * 24 // n
        wanted[i] = (size, crc, "rows", shard, filled[shard], None)
        filled[shard] += 1
    assert n <= 1024, "one bucket, so that the order is that of the hashes"
    found = {r.doc_id: (r.size, r.text_crc32, r.law, r.shard, r.slot, r.grown_shard) for r in queries.op8_sharding(spark, sf).collect()}
    assert found == wanted


def test_sharding_of_a_repeated_row(spark):
    """Rows alike, null ids and ids with many texts are spread over shards like others, whatever the partitions."""
    from pawl.llm.sharding import interleave

    alike = spark.range(10_000).selectExpr("5L AS doc_id", "'same' AS text", "'a' AS source")
    nulls = spark.range(4000).selectExpr("CAST(NULL AS LONG) AS doc_id", "concat('t', id) AS text", "'b' AS source")
    rows = alike.union(nulls)
    found = interleave(rows.repartition(7), rows_per_bucket=256)
    per = found.groupBy("shard", "source").count().collect()
    assert {(r.source, round(r["count"] / 14_000 * 24 * 7)) for r in per} == {("a", 120), ("b", 48)} or max(abs(r["count"] - {"a": 10_000, "b": 4000}[r.source] / 24) for r in per) <= 2
    assert found.select("shard", "slot").distinct().count() == 14_000
    again = interleave(rows.repartition(3), rows_per_bucket=256)
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, again.collect()))


def test_op2(spark, sf, documents):
    """Scores are the bias, the weights of a text's terms and the products of the factors of all their pairs."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels, ~language_id.held_out_id("doc_id", 5, 0))
    rows = queries.op2_toxicity(spark, sf).collect()
    assert len(rows) == len(documents)
    for r in rows:
        words = re.findall(r"[^\W\d_]+", (documents[r.doc_id].text or "").lower())
        terms = sorted({model.slots[s] for w in set(words) for s in toxicity.slots_of(w) if s in model.slots})
        margin = model.bias + sum(float(model.weights[i]) for i in terms)
        margin += sum(float(model.factors[i] @ model.factors[j]) for x, i in enumerate(terms) for j in terms[:x])
        score = 1 / (1 + math.exp(-min(30.0, max(-30.0, margin))))
        assert r.score == pytest.approx(score, abs=1e-9) and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def plain_kneser_ney(words, order):
    """A function from a word to its bits, by the definition over strings."""
    count = [Counter() for _ in range(order + 1)]
    for word, times in words.items():
        s = "\x02" + word + "\x03"
        for at in range(1, len(s)):
            for n in range(1, order + 1):
                if at >= n - 1:
                    count[n][s[at - n + 1 : at + 1]] += times
    tables = [None]
    for n in range(1, order + 1):
        own = dict(count[n])
        if n < order:
            before = Counter(g[1:] for g in count[n + 1])
            own = {g: before[g] if before[g] and not g.startswith("\x02") else c for g, c in own.items()}
        once, twice = sum(c == 1 for c in own.values()), sum(c == 2 for c in own.values())
        discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
        total, types = Counter(), Counter()
        for g, c in own.items():
            total[g[:-1]] += c
            types[g[:-1]] += 1
        tables.append((own, discount, total, types))

    def bits(word):
        s, out = "\x02" + word + "\x03", 0.0
        for at in range(1, len(s)):
            p = 1 / (len(count[1]) + 1)
            for n in range(1, order + 1):
                if at >= n - 1:
                    own, discount, total, types = tables[n]
                    gram, context = s[at - n + 1 : at + 1], s[at - n + 1 : at]
                    if context in total:
                        p = max(own.get(gram, 0) - discount, 0) / total[context] + discount * types[context] / total[context] * p
            out -= math.log2(p)
        return out

    return bits


def test_kneser_ney_of_two_languages():
    rng = random.Random(6)
    words = {lang: Counter("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(300)) for lang, letters in (("a", "abcdé"), ("b", "cdefß"))}
    models = language_id.LanguageModels({k: dict(v) for k, v in words.items()})
    new = ["abc", "", "ß", "cdcdcd", "zzz", "aßéfff", *list(words["a"])[:40]]
    found = models.bits(new)
    for k, lang in enumerate(models.languages):
        plain = plain_kneser_ney(words[lang], models.order)
        assert found[:, k] == pytest.approx([plain(w) for w in new], rel=1e-5)


def test_op9(spark, sf, documents):
    """The registered query takes the language of the fewest bits under plain models of the same words."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    taught = [r for i, r in sorted(documents.items()) if zlib.crc32(str(i).encode()) % 3 != 1 and r.lang and r.text]
    assert max(Counter(r.lang for r in taught).values()) <= language_id.TRAIN_DOCS
    models = language_id.fit(docs, ~language_id.held_out_id("doc_id", 3, 1))
    assert models.languages == sorted({r.lang for r in taught})
    rows = queries.op9_language_id(spark, sf).collect()
    assert len(rows) == len(documents)
    right = [r.lang_pred == documents[r.doc_id].lang for r in rows if r.held_out and r.lang_pred != "und" and documents[r.doc_id].lang]
    assert sum(right) / len(right) > 0.9
    for r in rows[:40]:
        words = [w for w in language_id.words_of(documents[r.doc_id].text or "") if any(map(str.isalpha, w))]
        if words:
            bits = sum(models.bits([w])[0] for w in words)
            assert r.lang_pred == models.languages[int((bits[:-1] / bits[-1]).argmin())]


def test_least_hashes(spark):
    """Exactly the n least of each language, whether it has fewer, as many, or one bucket holds them all."""
    rng = random.Random(9)
    hashes = {"many": [rng.randrange(-(1 << 63), 1 << 63) for _ in range(5000)], "few": [-5, 7, 1 << 62], "alike": list(range(300)), "just": list(range(-50, 50))}
    rows = [(lang, h) for lang, hs in hashes.items() for h in set(hs)]
    found = defaultdict(list)
    for lang, h in language_id.least_hashes(spark.createDataFrame(rows, "lang string, h long"), 100).collect():
        found[lang].append(h)
    assert {lang: sorted(hs) for lang, hs in found.items()} == {lang: sorted(set(hs))[:100] for lang, hs in hashes.items()}
    assert not language_id.least_hashes(spark.createDataFrame([], "lang string, h long"), 100).collect()


def test_a_language_of_one_document(spark):
    """It is learned; so are languages whose rows share an id, or have none."""
    rows = [(k, "der die das und nicht mit", "de") for k in range(60)] + [(900, "xylo zyx qwax", "xx")]
    rows += [(7, f"les des une est {k}", "fr") for k in range(50)] + [(None, f"los las una es {k}", "es") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = language_id.fit(docs, F.lit(True))
    assert models.languages == ["de", "es", "fr", "xx"]
    assert not any(math.isinf(x) for x in models.limits)
    found = language_id.identify(docs, models).where("lang = 'xx'").first()
    assert found["lang_pred"] == "xx" and not found["rejected"]


def test_stages(spark, sf, documents):
    """Each stage on all documents: who stays, and with which text."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    models = language_id.fit(docs, F.lit(True))
    judged = {r.doc_id: r.rejected for r in language_id.identify(docs, models, carry=["doc_id"]).collect()}
    assert {r.doc_id for r in stage["language"](spark, docs, sf).collect()} == {i for i, x in judged.items() if not x}

    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), F.lit(True)).scorer()
    assert {r.doc_id for r in stage["toxicity"](spark, docs, sf).collect()} == {i for i, r in documents.items() if model([r.text])[0] < 0.5}

    sets = {}
    for i, r in documents.items():
        words = (r.text or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    up = {i: i for i in sets}

    def top(i):
        return i if up[i] == i else top(up[i])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                up[max(top(a), top(b))] = min(top(a), top(b))
    assert {r.doc_id for r in stage["near_duplicates"](spark, docs, sf).collect()} == {i for i in sets if top(i) == i}

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = plain_windows([x for x in items if len(plain_words(x[1])) >= 5])
    left = {r.doc_id: r for r in stage["benchmark"](spark, docs, sf).collect()}
    for i, r in documents.items():
        words, hit, _ = plain_hits(r.text, windows)
        assert (i in left) == (len(hit) <= len(words) / 2)
        if i in left:
            rest = [w for k, w in enumerate(words) if k not in hit]
            assert plain_words(left[i].text) == rest and (hit or left[i].text == r.text) and left[i].n_chars == len(left[i].text)

    for r in stage["tokens"](spark, docs, sf).collect():
        assert bytes(r.ids) == b"".join(x.to_bytes(4, "little") for x in LIBRARY.encode_ordinary(documents[r.doc_id].text or ""))
