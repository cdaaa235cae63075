"""Token counts under a unigram model, with forward scores shared along a trie of pre-tokens."""

from __future__ import annotations

import base64
import math
import os
import re
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, text_of
from .token_ids import chunks, default_vocabulary

#: What a worker remembers, at most: nodes of its trie (some 60 MB) and bytes of pre-tokens with their counts, each taken with
#: ENTRY bytes besides its characters; then both start anew. Pre-tokens have no nodes beyond their first LONG bytes.
NODES, REMEMBER, ENTRY, LONG = 400_000, 48 << 20, 160, 64
SCHEMA = "doc_id long, n_tokens long, n_pretokens long, n_bytes long"
#: A pre-token is a run of letters, of digits, of other signs, each with a space before it if there is one, or of white space.
_PRETOKEN = re.compile(r" ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+|.", re.S)


class Unigram:
    """Byte strings with log-scores; a text's tokens are the pieces of its best-scoring cut, fewest on a tie.

    Pre-tokens are inserted in a trie of bytes. A node has the forward score of the prefix that leads to it, which is worked
    out once, when the node is made, however many pre-tokens share the prefix; a terminal node has its pre-token's count.
    """

    def __init__(self, folder: str):
        with open(os.path.join(folder, "byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # the file has ranks and no frequencies; ranks stand for them by Zipf's law
        total = math.log(sum(1 / (r + 10) for r in ranks.values()))
        self.score = {piece: -math.log(r + 10) - total for piece, r in ranks.items()}
        self.longest = max(map(len, self.score))
        # ends[xy]: the sizes of pieces that end in the bytes x and y, and begin anywhere
        self.ends: dict[bytes, list[int]] = {}
        for piece in self.score:
            self.ends.setdefault(piece[-2:], []).append(len(piece))
        self.ends = {k: sorted(set(v)) for k, v in self.ends.items()}
        self.forget()

    def forget(self) -> None:
        """Begins with an empty trie."""
        self.known: dict[str, int] = {}
        self.held = 0
        self.child: dict[int, int] = {}  # node * 256 + byte: the node below
        self.best = array("d", [0.0])  # by node: the forward score
        self.pieces = array("q", [0])  # by node: its pieces
        self.terminal = array("q", [0])  # by node: the count of the pre-token that ends there, or -1

    def _forward(self, body: bytes, stop: int, best: list[float], pieces: list[int]) -> tuple[float, int]:
        """Forward score and pieces of the first `stop` bytes, from those of all shorter prefixes."""
        high, few = -math.inf, 0
        tail = body[max(0, stop - 2) : stop]
        for size in (1, *(self.ends.get(tail, ()) if len(tail) == 2 else ())):
            if size > stop:
                break
            if (s := self.score.get(body[stop - size : stop])) is not None:
                here, n = best[stop - size] + s, pieces[stop - size] + 1
                if here > high or (here == high and n < few):
                    high, few = here, n
        return high, few

    def insert(self, body: bytes) -> int:
        """The tokens of a pre-token; its nodes are in the trie from then on."""
        child, best, pieces = self.child, [0.0], [0]
        node = 0
        for stop, byte in enumerate(body, 1):
            below = child.get(node << 8 | byte) if node >= 0 else None
            if below is not None:
                node = below
                best.append(self.best[node])
                pieces.append(self.pieces[node])
                continue
            high, few = self._forward(body, stop, best, pieces)
            best.append(high)
            pieces.append(few)
            if node < 0 or stop > LONG or len(self.best) >= NODES:
                node = -1  # beyond the trie: scored, but not kept
                continue
            below = child[node << 8 | byte] = len(self.best)
            self.best.append(high)
            self.pieces.append(few)
            self.terminal.append(-1)
            node = below
        if node >= 0:
            self.terminal[node] = pieces[-1]
        return pieces[-1]

    def learn(self, words: set[str]) -> None:
        """Counts new pre-tokens."""
        for word in words:
            self.known[word] = self.insert(word.encode("utf-8", "surrogatepass"))
            self.held += ENTRY + len(word)

    def counts(self, texts: list[str]) -> list[tuple[int, int]]:
        """Tokens and pre-tokens of each text."""
        split = [_PRETOKEN.findall(t) for t in texts]
        if self.held > REMEMBER or len(self.best) >= NODES:
            self.forget()
        self.learn(set().union(*split).difference(self.known))
        known = self.known.__getitem__
        return [(sum(map(known, parts)), len(parts)) for parts in split]


_loaded: dict[str, Unigram] = {}


def load(folder: str) -> Unigram:
    """The model, loaded once for each worker process."""
    if folder not in _loaded:
        _loaded[folder] = Unigram(folder)
    return _loaded[folder]


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_tokens, n_pretokens, n_bytes (of the text in UTF-8).

    A text is cut into pre-tokens, and each into the pieces of the byte vocabulary whose scores add up to most; single
    bytes are pieces, so every text has a cut. A long run without a break is one pre-token. Null or empty text has no
    tokens. Rows are counted one by one in whole, nothing moves between tasks; extra columns are ignored. A worker's trie is
    bounded in bytes (NODES, REMEMBER); an empty table gives none.
    """
    folder = vocabulary or default_vocabulary()

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = load(folder)
        for batch in batches:
            found = [x for some in chunks(batch.column(1).to_pylist()) for x in model.counts(some)]
            tokens, parts = (pa.array([x[i] for x in found], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), tokens, parts, batch.column(2)], ["doc_id", "n_tokens", "n_pretokens", "n_bytes"])

    rows = columns_of(docs, ["doc_id", "text"], "token counts").select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    return rows.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(count, SCHEMA)
