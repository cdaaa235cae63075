"""Tokenizers by one protocol: ids for a text with an end mark, text for ids, and a size."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORDS = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


class Tokenizer(Protocol):
    """ids never exceed two bytes; `size` counts the end mark, and ids from `size` on are for the sentinels."""

    size: int

    def tokenize(self, text: Column) -> Column: ...
    def detokenize(self, ids: Column) -> Column: ...


class ByteTokenizer:
    """UTF-8 bytes as they are, and 256 at the end."""

    size, end = 257, 256

    def tokenize(self, text: Column) -> Column:
        @F.arrow_udf(T.ArrayType(T.IntegerType()))
        def ids(batch):
            import numpy as np
            import pyarrow as pa

            batch = batch.cast(pa.large_string())
            at = np.frombuffer(batch.buffers()[1], np.int64)[batch.offset : batch.offset + len(batch) + 1]
            held = batch.buffers()[2]
            body = np.frombuffer(held, np.uint8)[at[0] : at[-1]] if held is not None else np.empty(0, np.uint8)
            ends = at[1:] - at[0]
            out = np.insert(body.astype(np.int32), ends, 256)
            found = pa.ListArray.from_arrays(pa.array(np.r_[0, ends + np.arange(1, len(ends) + 1)].astype(np.int32)), pa.array(out))
            return found

        return ids(F.coalesce(text, F.lit("")))

    def detokenize(self, ids: Column) -> Column:
        @F.arrow_udf(T.StringType())
        def text(batch):
            import pyarrow as pa

            return pa.array([None if x is None else bytes(i for i in x if i < 256).decode("utf-8", "replace") for x in batch.to_pylist()], pa.string())

        return text(ids)


class WordTokenizer:
    """Runs of letters and digits, and other signs one by one; ids by frequency, 0 for unknown and 1 for the end."""

    unknown, end, first = 0, 1, 2

    def __init__(self, words: list[str]):
        if len(words) + self.first > 1 << 16:
            raise ValueError("ids have two bytes")
        self.words, self.size = words, len(words) + self.first

    @classmethod
    def fit(cls, docs: DataFrame, most: int = 30_000) -> WordTokenizer:
        """The most frequent words of docs (text), ties in the order of their letters."""
        pieces = docs.select(F.explode(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))).alias("w"))
        top = pieces.groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(min(most, (1 << 16) - cls.first))
        return cls([r["w"] for r in top.collect()])

    def tokenize(self, text: Column) -> Column:
        held = SparkSession.active().sparkContext.broadcast(self.words)  # as many as two bytes count

        @F.arrow_udf(T.ArrayType(T.IntegerType()))
        def ids(pieces):
            import numpy as np
            import pyarrow as pa
            import pyarrow.compute as pc

            at = pieces.offsets.to_numpy().astype(np.int64)
            flat = pieces.values.slice(at[0], at[-1] - at[0])
            found = pc.fill_null(pc.index_in(flat, value_set=pa.array(held.value, flat.type)), -first).to_numpy() + first
            ends = at[1:] - at[0]
            out = np.insert(found.astype(np.int32), ends, end)
            return pa.ListArray.from_arrays(pa.array(np.r_[0, ends + np.arange(1, len(ends) + 1)].astype(np.int32)), pa.array(out))

        first, end = self.first, self.end
        return ids(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORDS), F.lit(0)))

    def detokenize(self, ids: Column) -> Column:
        words = ["?", "", *self.words]

        @F.arrow_udf(T.StringType())
        def text(batch):
            import pyarrow as pa

            return pa.array([None if x is None else " ".join(words[i] if i < len(words) else "?" for i in x if i != 1) for x in batch.to_pylist()], pa.string())

        return text(ids)


_models: dict[bytes, object] = {}


def _model(body: bytes):
    """The SentencePiece model in body, loaded once for each worker process."""
    import hashlib

    import sentencepiece

    key = hashlib.sha256(body).digest()
    if key not in _models:
        _models.clear()
        _models[key] = sentencepiece.SentencePieceProcessor(model_proto=body)
    return _models[key]


class SentencePieceTokenizer:
    """A SentencePiece model file: its ids without a begin mark, with the end mark. Workers get the model's bytes."""

    def __init__(self, path: str):
        spark = SparkSession.active()
        # one file of a vocabulary's size, by any path that Spark can read
        body = bytes(spark.read.format("binaryFile").load(path).first()["content"])
        self.size = _model(body).vocab_size()
        if self.size > 1 << 16:
            raise ValueError("ids have two bytes")
        self.body = spark.sparkContext.broadcast(body)

    def tokenize(self, text: Column) -> Column:
        body = self.body

        @F.arrow_udf(T.ArrayType(T.IntegerType()))
        def ids(batch):
            import pyarrow as pa

            model = _model(body.value)
            return pa.array([x + [model.eos_id()] for x in model.encode([t or "" for t in batch.to_pylist()])], pa.list_(pa.int32()))

        return ids(text)

    def detokenize(self, ids: Column) -> Column:
        body = self.body

        @F.arrow_udf(T.StringType())
        def text(batch):
            import pyarrow as pa

            model = _model(body.value)
            return pa.array([None if x is None else model.decode([i for i in x if i != model.eos_id()]) for x in batch.to_pylist()], pa.string())

        return text(ids)
