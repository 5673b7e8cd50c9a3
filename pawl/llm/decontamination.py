"""Benchmark passages in documents, found by a suffix automaton of all benchmark items."""

from __future__ import annotations

import pickle
import re
from array import array
from bisect import bisect_left
from collections.abc import Sequence

import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pawl.llm.common import map_texts, quoted

#: Words of benchmark items in one automaton, about, which bounds the memory of building one; more
#: items make more automata.
AUTOMATON_WORDS = 250_000

#: Byte to lower-cased byte of a word (0-9, a-z and all bytes of other than ASCII characters) or space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


class Builder:
    """States of a generalised suffix automaton, while words are added one by one."""

    def __init__(self) -> None:
        self.length, self.link = [0], [-1]
        self.next: list[dict[int, int]] = [{}]

    def extend(self, last: int, w: int) -> int:
        length, link, after = self.length, self.link, self.next
        if w in after[last]:
            known = after[last][w]
            return known if length[known] == length[last] + 1 else self.split(last, w, known)
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        after.append({})
        while last >= 0 and w not in after[last]:
            after[last][w] = new
            last = link[last]
        if last >= 0:
            known = after[last][w]
            link[new] = known if length[known] == length[last] + 1 else self.split(last, w, known)
        return new

    def split(self, last: int, w: int, known: int) -> int:
        length, link, after = self.length, self.link, self.next
        copy = len(length)
        length.append(length[last] + 1)
        link.append(link[known])
        after.append(dict(after[known]))
        link[known] = copy
        while last >= 0 and after[last].get(w) == known:
            after[last][w] = copy
            last = link[last]
        return copy


def grouped(size: int, pairs: set[tuple[int, int]]) -> tuple[array, array]:
    """Numbers by state: those of state s stand from first[s] to first[s + 1] - 1, ascending."""
    first, values = array("i", bytes(4 * (size + 1))), array("i")
    for s, v in sorted(pairs):
        first[s + 1] += 1
        values.append(v)
    for s in range(size):
        first[s + 1] += first[s]
    return first, values


class Automaton:
    """A generalised suffix automaton of items, each a list of words, in flat arrays.

    A walk keeps the state and the length of the longest suffix of the words read that occurs in
    some item. A window is `window` words in a row of an item, or a whole shorter item. All that a
    step asks for is stored with the state, so a scan takes time in proportion to its words.
    It takes about 50 bytes a word of the items, beside the vocabulary of distinct words.
    """

    def __init__(self, items: Sequence[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        coded = [(name, [number(w, len(self.vocabulary)) for w in words]) for name, words in items if words]
        self.names = [name for name, _ in coded]
        made = Builder()
        for _, ids in coded:
            last = 0
            for w in ids:
                last = made.extend(last, w)
        size = len(made.length)
        self.length, self.link = array("i", made.length), array("i", made.link)
        #: transitions of state s: words from first[s] to first[s + 1] - 1, ascending, and where they lead
        self.first, self.words, self.to = array("i", [0]), array("i"), array("i")
        for after in made.next:
            for w in sorted(after):
                self.words.append(w)
                self.to.append(after[w])
            self.first.append(len(self.words))
        del made
        by_length = sorted(range(size), key=self.length.__getitem__)
        #: the state of the last `window` words of a match in a state, worked out from the shorter ones
        self.last_window = array("i", range(size))
        for s in by_length[1:]:
            if self.length[self.link[s]] >= window:
                self.last_window[s] = self.last_window[self.link[s]]
        full, short = set(), set()
        for k, (_, ids) in enumerate(coded):
            state = 0
            for n, w in enumerate(ids, 1):
                state = self.step(state, w)
                if n >= window:
                    full.add((self.last_window[state], k))
            if len(ids) < window:
                short.add((state, len(ids) << 32 | k))
        #: items by the state of each full window that they hold
        self.item_first, self.items = grouped(size, full)
        #: shorter items by (state, length), and the nearest state with any, up the links from a state
        self.short: dict[int, list[tuple[int, list[int]]]] = {}
        for s, v in sorted(short, reverse=True):
            own = self.short.setdefault(s, [])
            if not own or own[-1][0] != v >> 32:
                own.append((v >> 32, []))
            own[-1][1].append(v & 0xFFFFFFFF)
        self.short_at = array("i", [-1]) * size
        #: the least length of a match in a state that is a hit
        self.need = array("i", [window]) * size
        for s in by_length:
            above = self.link[s]
            self.short_at[s] = s if s in self.short else self.short_at[above] if s else -1
            least = self.need[above] if s else window
            self.need[s] = min(least, self.short[s][-1][0]) if s in self.short else least

    def step(self, state: int, w: int) -> int:
        """The next state, or -1."""
        lo, hi = self.first[state], self.first[state + 1]
        at = bisect_left(self.words, w, lo, hi)
        return self.to[at] if at < hi and self.words[at] == w else -1

    def scan(self, words: Sequence[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Spans of hit words, disjoint and ascending, and the items whose windows occur."""
        length_of, link, need, window, known = self.length, self.link, self.need, self.window, self.words
        first, to, last_window, short_at = self.first, self.to, self.last_window, self.short_at
        state = length = 0
        spans: list[tuple[int, int]] = []
        windows: set[int] = set()
        shorter: set[tuple[int, int]] = set()
        for at, w in enumerate(map(self.vocabulary.get, words)):
            if w is None:
                state = length = 0
                continue
            while True:
                lo = first[state]
                if state == 0:
                    step = to[w]  # every word of the vocabulary leads away from the start
                    break
                if lo < first[state + 1] and known[lo] == w:
                    step = to[lo]
                    break
                step = self.step(state, w)
                if step >= 0:
                    break
                state = link[state]
                length = length_of[state]
            state, length = step, length + 1
            if length >= need[state]:
                begin = at + 1
                if length >= window:
                    begin -= length
                    windows.add(last_window[state])
                s = short_at[state]
                while s >= 0:
                    for n, _ in self.short[s]:
                        if n <= length:
                            shorter.add((s, n))
                            begin = min(begin, at + 1 - n)
                    s = short_at[link[s]]
                if begin <= at:
                    while spans and spans[-1][1] >= begin:
                        begin = min(begin, spans.pop()[0])
                    spans.append((begin, at + 1))
        found = {k for s in windows for k in self.items[self.item_first[s] : self.item_first[s + 1]]}
        for s, n in shorter:
            found.update(*(ks for m, ks in self.short[s] if m == n))
        return spans, {self.names[k] for k in found}


def automata(benchmark: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text", most: int = AUTOMATON_WORDS) -> list[Broadcast]:
    """Broadcast automata of about `most` words each (or one item), over all items.

    Items are dealt by a hash of id and text; equal rows are one. Each automaton is built by a task,
    and passes the driver as packed arrays, one at a time.
    """
    spark = benchmark.sparkSession
    rows = benchmark.select(quoted(id_col).cast("string").alias("id"), quoted(text_col).cast("string").alias("text")).where("text IS NOT NULL").distinct()
    total = rows.agg(F.sum(n_words(F.col("text")))).first()[0] or 0
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(max(1, -(-total // most)))))

    def built(found: pa.Table) -> pa.Table:
        found = found.sort_by([("id", "ascending"), ("text", "ascending")])
        items = [(name, words_of(text)) for name, text in zip(found["id"].to_pylist(), found["text"].to_pylist(), strict=True)]
        return pa.table({"automaton": pa.array([pickle.dumps(Automaton(items, window), pickle.HIGHEST_PROTOCOL)], pa.binary())})

    packed = dealt.groupBy("chunk").applyInArrow(built, "automaton binary")
    return [spark.sparkContext.broadcast(bytes(r[0])) for r in packed.toLocalIterator()]


def n_words(text: Column) -> Column:
    """How many words a text has."""
    return F.regexp_count(text, F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"))


#: Words begin to end - 1, characters start to stop - 1.
SPANS = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("begin", "end", "start", "stop")]))
ARROW_SPANS = pa.list_(pa.struct([(n, pa.int32()) for n in ("begin", "end", "start", "stop")]))


def located(text: str | None, hit: Sequence[tuple[int, int]]) -> list[dict[str, int]]:
    """Spans of words with the characters from their first word's start to their last one's end."""
    if not hit:
        return []
    data = text.encode()
    places = [m.span() for m in WORD.finditer(data)]
    out, chars, at = [], 0, 0
    for begin, end in hit:
        start, stop = places[begin][0], places[end - 1][1]
        chars += len(data[at:start].decode())
        first, chars, at = chars, chars + len(data[start:stop].decode()), stop
        out.append({"begin": begin, "end": end, "start": first, "stop": chars})
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ascending spans that cover the same words."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: Sequence[str] | None = None, automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """Append n_words, n_hit, hit_items (sorted) and hit_spans for each whole text.

    Words are runs of 0-9, A-Z (lower-cased), a-z and characters beyond ASCII. A word is hit if it
    lies in an occurrence of a window of an item: `window` words in a row, or a whole shorter item.
    Null or empty texts and items have no words; items with a null id hit without being listed. Equal
    items all count. Texts are scanned whole, in time in proportion to their length, by one automaton
    after another in one narrow pass. Repeated rows each get a row; an empty table gives none, an
    empty benchmark no hit. Input columns of these names give way.
    """
    sent = automata(benchmark, window, item_col, item_text_col, automaton_words)

    def make():
        own = [pickle.loads(x.value) for x in sent]

        def work(texts):
            counts, hits, spans, items = [], [], [], []
            for text in texts:
                words = words_of(text)
                found = [a.scan(words) for a in own] if words else []
                hit = found[0][0] if len(found) == 1 else merged([x for f, _ in found for x in f])
                counts.append(len(words))
                hits.append(sum(b - a for a, b in hit))
                spans.append(located(text, hit))
                items.append(sorted(set().union(*(names for _, names in found)) - {None}))
            return counts, hits, items, spans

        return work

    outputs = [
        ("n_words", T.LongType(), pa.int64()),
        ("n_hit", T.LongType(), pa.int64()),
        ("hit_items", T.ArrayType(T.StringType()), pa.list_(pa.string())),
        ("hit_spans", SPANS, ARROW_SPANS),
    ]
    return map_texts(docs, text_col, outputs, make, carry)


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the characters of ascending spans."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def add(acc: Column, x: Column) -> Column:
        kept = F.substring(text, acc["at"] + F.lit(1), F.greatest(F.lit(0), x["start"] - acc["at"]))
        return F.struct(F.concat(acc["out"], kept).alias("out"), F.greatest(acc["at"], x["stop"]).alias("at"))

    left = F.aggregate(spans, zero, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + F.lit(1), F.length(text))))
    return F.when(F.size(spans) > 0, left).otherwise(text)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, least_item_words: int = 5, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Cut benchmark spans out of texts and drop documents that are mostly benchmark.

    Spans are made of windows of `window` words; of shorter items those of least_item_words or more
    count (1 for all), as one word in common is no leak. A document is dropped if more than
    max_coverage of its words are hit; else the spans are removed. All other documents, those without
    a text too, and all columns stay as they are; repeated rows are judged alike.
    """
    long_enough = n_words(quoted(item_text_col)) >= least_item_words
    # numbered names, so that no column of the documents gives way to one of scan()
    numbered = docs.select(*[quoted(c).alias(f"column_{k}") for k, c in enumerate(docs.columns)])
    found = scan(numbered, benchmark.where(long_enough), window, f"column_{docs.columns.index(text_col)}", item_col, item_text_col)
    kept = found.where((F.col("n_hit") == 0) | (F.col("n_hit") <= F.col("n_words") * max_coverage))
    place = docs.columns.index(text_col)
    columns = [F.col(f"column_{k}").alias(c) for k, c in enumerate(docs.columns)]
    columns[place] = without_spans(F.col(f"column_{place}"), F.col("hit_spans")).alias(text_col)
    return kept.select(*columns)
