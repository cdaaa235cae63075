"""Binary token records: size as 8 bytes, category as one, then tokens of two bytes each, all little-endian."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuswright.schemas import MAX_RECORD

DECODED = T.StructType(
    [T.StructField("category_id", T.IntegerType()), T.StructField("token_count", T.IntegerType()), T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("error", T.StringType())]
)


def encoded(category: int, tokens) -> bytes:
    """One record. Ids beyond 65535, categories beyond 255 and bodies beyond MAX_RECORD are errors, not wrapped."""
    ids = np.asarray(tokens)
    if len(ids) and (ids.min() < 0 or ids.max() > 0xFFFF):
        raise ValueError(f"token id {ids.min() if ids.min() < 0 else ids.max()} needs more than two bytes")
    size = 1 + 2 * len(ids)
    if size > MAX_RECORD:
        raise ValueError(f"a record of {size} bytes is over the limit of {MAX_RECORD}")
    return struct.pack("<QB", size, category) + ids.astype("<u2").tobytes()


@F.arrow_udf(T.BinaryType())
def encode_record(category, tokens):
    """Records by batches; null tokens give null."""
    import pyarrow as pa

    flat, at = tokens.values.to_numpy(zero_copy_only=False), tokens.offsets.to_numpy()
    out = [None if t is False else encoded(c, flat[a:b]) for c, t, a, b in zip(category.to_pylist(), tokens.is_valid().to_pylist(), at[:-1], at[1:], strict=True)]
    return pa.array(out, pa.binary())


def _read(body: bytes | None) -> tuple[int | None, np.ndarray | None, str | None]:
    """Category and tokens of the record at the beginning of body, or what is wrong with it; bytes after it are ignored."""
    if body is None:
        return None, None, "no record"
    if len(body) < 9:
        return None, None, "short header"
    size, category = struct.unpack_from("<QB", body)
    if not 1 <= size <= MAX_RECORD:
        return None, None, "bad size"
    if len(body) < 8 + size:
        return None, None, "truncated"
    return category, np.frombuffer(body, "<u2", (size - 1) // 2, 9), None


def decoded(body: bytes | None) -> dict:
    """The record at the beginning of body by the fields of DECODED."""
    category, tokens, error = _read(body)
    return {"category_id": category, "token_count": None if error else len(tokens), "tokens": None if error else tokens.tolist(), "error": error}


@F.arrow_udf(DECODED)
def decode_record(body):
    """`decoded` by batches; tokens stay in arrays."""
    import pyarrow as pa

    found = [_read(None if b is None else memoryview(b)) for b in (x.as_buffer() if x.is_valid else None for x in body)]
    bad = np.array([x[2] is not None for x in found], bool)
    counts = np.array([0 if x[2] else len(x[1]) for x in found], np.int32)
    flat = np.concatenate([x[1] for x in found if not x[2]] or [np.empty(0, "<u2")]).astype(np.int32)
    tokens = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(flat), mask=pa.array(bad))
    fields = [pa.array([x[0] for x in found], pa.int32()), pa.array(counts, mask=bad), tokens, pa.array([x[2] for x in found], pa.string())]
    return pa.StructArray.from_arrays(fields, ["category_id", "token_count", "tokens", "error"])


def record_bytes(token_count: Column) -> Column:
    """Bytes of a record of so many tokens."""
    return F.lit(9).cast("long") + 2 * token_count.cast("long")


def to_base64(body: Column) -> Column:
    """Base64 without line breaks."""
    return F.replace(F.base64(body), F.lit("\r\n"), F.lit(""))
