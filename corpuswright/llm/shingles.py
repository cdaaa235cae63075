"""Word shingles of whole texts as 64-bit hashes, in arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_S33 = np.uint64(33)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Words whose hashes a worker remembers, and their longest; others are hashed each time.
REMEMBER, SHORT = 200_000, 32
#: Bytes of a text that are cut into words at once.
SEGMENT = 1 << 20
#: Sets of up to so many shingles are named by the shingles' words, larger ones by their hashes.
SMALL_SET = 8


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all (the public MurmurHash3 finaliser)."""
    x = x ^ (x >> _S33)
    x *= _MIX[0]
    x ^= x >> _S33
    x *= _MIX[1]
    x ^= x >> _S33
    return x


class _Words(dict):
    """64-bit XXH3 hashes of words; short ones are remembered as long as there is room."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= SHORT and len(self) < REMEMBER:
            self[word] = found
        return found


_words = _Words()


def _segments(body: bytes) -> Iterator[bytes]:
    """body in segments of about SEGMENT bytes that end between words."""
    at = 0
    while len(body) - at > SEGMENT:
        to = at + SEGMENT
        while to < len(body) and not body[to : to + 1].isspace():
            blank = min((p for p in (body.find(c, to, to + SEGMENT) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")) if p >= 0), default=to + SEGMENT)
            to = min(blank, len(body))
        yield body[at:to]
        at = to
    yield body[at:] if at else body


def words_of(body: bytes) -> list[bytes]:
    """The words of a UTF-8 text: runs of bytes other than space and tab to carriage return, A-Z lower-cased."""
    return body.lower().split()


def word_hashes(body: bytes) -> np.ndarray:
    """A 64-bit hash for each word of a text."""
    parts = []
    for some in _segments(body):
        words = words_of(some)
        parts.append(np.fromiter(map(_words.__getitem__, words), np.uint64, len(words)))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def sets(bodies: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of UTF-8 texts: their hashes, ascending within each text, and where each text's begin (one more
    place than texts).

    A text's shingles are its runs of k words (see `words_of`); fewer words make one shingle, none make none. Words are
    hashed by their bytes, and a shingle's hash folds those of its words one after another through a bijection that no
    sum or product passes, so that texts made to collide under polynomial hashes are told apart.
    """
    by_text = [word_hashes(b) for b in bodies]
    counts = np.fromiter(map(len, by_text), np.int64, len(by_text))
    first = np.r_[0, np.cumsum(counts)]
    made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    at = np.r_[0, np.cumsum(made)]
    if not at[-1]:
        return np.empty(0, np.uint64), at
    words = np.concatenate([*by_text, np.zeros(k, np.uint64)])
    # the first word of each shingle, and how many words of k are there
    head = np.arange(at[-1]) - np.repeat(at[:-1] - first[:-1], made)
    short = np.repeat(counts < k, made)
    have = np.repeat(np.minimum(counts, k), made)
    total = mix(have.astype(np.uint64) * _STEP)
    some_short = bool(short.any())
    for j in range(k):
        folded = mix(total ^ words[head + j]) + _STEP
        total = np.where(have > j, folded, total) if some_short else folded
    hashes = mix(total)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[at[:-1][made > 0]] = True
    kept = np.r_[0, np.cumsum(new)]
    return hashes[new], kept[at]


def names(bodies: list[bytes], hashes: np.ndarray, at: np.ndarray, k: int) -> list[bytes]:
    """A 128-bit XXH3 digest of each text's set: of its sorted hashes, or of the shingles' own words where they are few,
    as two small sets could collide in 64 bits on a large corpus. Empty sets have one name."""
    raw = memoryview(np.ascontiguousarray(hashes)).cast("B")
    out = []
    for body, a, b in zip(bodies, at[:-1].tolist(), at[1:].tolist(), strict=True):
        if 0 < b - a <= SMALL_SET and len(body) <= SEGMENT:
            words = words_of(body)
            shingles = {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}
            out.append(xxhash.xxh3_128_digest(b"\n".join(sorted(shingles))))
        else:
            out.append(xxhash.xxh3_128_digest(raw[8 * a : 8 * b]))
    return out


def batches(column, size: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Pieces of an Arrow string column of about so many bytes: the first row, and the texts' bytes."""
    import pyarrow as pa

    column = column.cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1].tolist()
    body = memoryview(column.buffers()[2] or b"")
    first, held = 0, []
    for i, (a, b) in enumerate(zip(ends, ends[1:])):
        held.append(bytes(body[a:b]))
        if b - ends[first] >= size:
            yield first, held
            first, held = i + 1, []
    if held:
        yield first, held
