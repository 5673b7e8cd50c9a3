"""Token counts of texts, and where a budget of tokens ends, from prefix tables."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pawl.llm.bpe import PrefixCounter, Remembered, TextCounts, loaded, splitter, vocabulary_file
from pawl.llm.common import hold, holding, map_texts

def piece_counts(content: bytes, is_json: bool) -> tuple[PrefixCounter, Remembered]:
    """The prefix counter of this worker process, and piece to its number of tokens."""

    def build():
        counter = PrefixCounter(loaded(content, is_json))
        return counter, Remembered(lambda piece: counter.count(piece.encode()))

    return hold("token counts " + hashlib.sha256(content).hexdigest(), build)


def count_tokens(
    docs: DataFrame,
    vocabulary_path: str,
    pattern: str,
    special: str | None = "<|endoftext|>",
    limit: int = 1024,
    text_col: str = "text",
    carry: Sequence[str] | None = ("doc_id",),
) -> DataFrame:
    """Exact token counts of whole texts, and the prefix that a limit of tokens leaves.

    Each distinct piece of text between two cuts of the pattern goes through the prefix table
    once in a worker (as long as it is remembered); a text's counts are sums of those. `special`
    inside a text is one token, as the tokenizers library has it by default.

    Appends n_bytes, n_tokens, over_limit (n_tokens > limit) and limit_chars (characters of the
    longest prefix, in the sense of TextCounts.cut_to, of at most `limit` tokens). A null or empty
    text has 0 of all. Repeated rows each get a row; an empty table gives none. Columns of these
    names in the input give way; carry names those that are kept.
    """
    context = docs.sparkSession.sparkContext
    file = context.broadcast(vocabulary_file(vocabulary_path))

    def make():
        counter, known = piece_counts(*file.value)
        find, get = splitter(pattern), known.__getitem__

        def work(texts: list[str | None]):
            sizes, totals, chars = [], [], []
            for text in texts:
                text = text or ""
                sizes.append(len(text.encode()))
                if special and special in text:
                    runs = text.split(special)
                    n = len(runs) - 1 + sum(sum(map(get, find(run))) for run in runs)
                    within = TextCounts(text, pattern, counter, special).cut_to(limit) if n > limit else len(text)
                else:
                    pieces = find(text)
                    counts = list(map(get, pieces))
                    n = sum(counts)
                    within = len(text) if n <= limit else fitting(pieces, counts)
                totals.append(n)
                chars.append(within)
            return sizes, totals, [n > limit for n in totals], chars

        def fitting(pieces: list[str], counts: list[int]) -> int:
            sums = list(accumulate(counts))
            whole = bisect.bisect_right(sums, limit)
            left = limit - (sums[whole - 1] if whole else 0)
            inside = TextCounts(pieces[whole], pattern, counter).cut_to(left) if left else 0
            return sum(map(len, pieces[:whole])) + inside

        return holding(work)

    outputs = [
        ("n_bytes", T.LongType(), pa.int64()),
        ("n_tokens", T.LongType(), pa.int64()),
        ("over_limit", T.BooleanType(), pa.bool_()),
        ("limit_chars", T.LongType(), pa.int64()),
    ]
    return map_texts(docs, text_col, outputs, make, carry)
