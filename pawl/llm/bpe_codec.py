"""Encoding of texts by the transducer, and decoding of ids by the UTF-8 state machine."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pawl.llm.bpe import Remembered, Transducer, Utf8Stream, Vocabulary, decode, loaded, splitter, vocabulary_file
from pawl.llm.common import hold, holding, map_texts, quoted

def little_endian(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def piece_ids(content: bytes, is_json: bool) -> tuple[Remembered, Vocabulary]:
    """Piece to the bytes of its ids, by the transducer of this worker process; and the vocabulary."""

    def build():
        vocabulary = loaded(content, is_json)
        transducer = Transducer(vocabulary)
        return Remembered(lambda piece: little_endian(transducer.encode(piece.encode()))), vocabulary

    return hold("bpe ids " + hashlib.sha256(content).hexdigest(), build)


def encode(
    docs: DataFrame,
    vocabulary_path: str,
    pattern: str,
    text_col: str = "text",
    carry: Sequence[str] | None = ("doc_id",),
) -> DataFrame:
    """Append `ids`, the token ids of each whole text as little-endian unsigned 32-bit integers.

    No special tokens: their strings are ordinary text. A null or empty text has no ids, repeated
    rows each get a row, an empty table gives none. A column named ids in the input gives way.
    """
    file = docs.sparkSession.sparkContext.broadcast(vocabulary_file(vocabulary_path))

    def make():
        known, _ = piece_ids(*file.value)
        find, get = splitter(pattern), known.__getitem__
        return holding(lambda texts: ([b"".join(map(get, find(text))) if text else b"" for text in texts],))

    return map_texts(docs, text_col, [("ids", T.BinaryType(), pa.binary())], make, carry)


def decode_ids(encoded: DataFrame, vocabulary_path: str, ids_col: str = "ids", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Append `text`: the ids of `encode` turned back. Bytes that are not UTF-8 become U+FFFD.

    Null ids give a null text. An id that the vocabulary lacks is an error.
    """
    file = encoded.sparkSession.sparkContext.broadcast(vocabulary_file(vocabulary_path))
    kept = [c for c in carry if c != "text"]
    source = encoded.select(*[quoted(c) for c in kept], quoted(ids_col).alias("__ids"))
    schema = T.StructType([source.schema[c] for c in kept] + [T.StructField("text", T.StringType(), True)])

    def run(batches):
        vocabulary = loaded(*file.value)
        for batch in batches:
            texts = []
            for ids in batch.column(len(kept)).to_pylist():
                if ids is None:
                    texts.append(None)
                    continue
                stream = Utf8Stream()
                texts.append("".join(stream.feed(run) for run in decode(array("I", ids), vocabulary)) + stream.close())
            columns = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=[*kept, "text"])

    return source.mapInArrow(run, schema)


def round_trip(
    docs: DataFrame,
    vocabulary_path: str,
    pattern: str,
    text_col: str = "text",
    carry: Sequence[str] | None = ("doc_id",),
    with_ids: bool = False,
) -> DataFrame:
    """Encode and decode in one pass. Appends n_tokens, ids_sha256, decoded_sha256, decoded_chars.

    Texts are handled as in encode; the digests are of the ids' bytes and of the decoded bytes.
    with_ids appends the ids themselves too, as encode gives them.
    """
    file = docs.sparkSession.sparkContext.broadcast(vocabulary_file(vocabulary_path))

    def make():
        known, vocabulary = piece_ids(*file.value)
        find, get = splitter(pattern), known.__getitem__

        def work(texts: list[str | None]):
            counts, hashes, decoded, chars, encoded = [], [], [], [], []
            for text in texts:
                ids = b"".join(map(get, find(text))) if text else b""
                counts.append(len(ids) // 4)
                encoded.append(ids)
                hashes.append(hashlib.sha256(ids).hexdigest())
                back, stream, n = hashlib.sha256(), Utf8Stream(), 0
                for run in decode(np.frombuffer(ids, "<u4").tolist(), vocabulary):
                    back.update(run)
                    n += len(stream.feed(run))
                decoded.append(back.hexdigest())
                chars.append(n + len(stream.close()))
            return (counts, hashes, decoded, chars, encoded)[: 4 + with_ids]

        return holding(work)

    outputs = [
        ("n_tokens", T.LongType(), pa.int64()),
        ("ids_sha256", T.StringType(), pa.string()),
        ("decoded_sha256", T.StringType(), pa.string()),
        ("decoded_chars", T.LongType(), pa.int64()),
        ("ids", T.BinaryType(), pa.binary()),
    ][: 4 + with_ids]
    return map_texts(docs, text_col, outputs, make, carry)
