"""Token ids of whole texts under the byte-level BPE vocabulary, at scan speed."""

from __future__ import annotations

import base64
import os
import re
import struct
from collections.abc import Iterator

import numpy as np

#: Bytes of words and ids that are remembered, each word with ENTRY bytes besides; then the memory starts anew.
REMEMBER, ENTRY = 48 << 20, 160
#: Beyond these letters the splitting pattern's Unicode tables may differ between libraries, so the tokenizer itself splits.
_PLAIN_END = "ɏ"


def default_vocabulary() -> str:
    """Folder of the public vocabulary files."""
    import public_tokenizers

    return os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))


class ByteBpe:
    """Ids as the `tokenizers` library gives for byte_bpe_50k.json without special tokens, as packed little-endian uint32.

    A single space between two other non-space characters always begins a new pre-token. So texts are cut there, and
    the ids of a piece (a word with its punctuation) don't depend on what stands around it: they are remembered. Texts
    with other white space next to a space are encoded whole by the rank-file library, which has the same vocabulary
    and pattern; texts beyond the Latin letters by the tokenizer itself.
    """

    def __init__(self, folder: str):
        import tiktoken

        from public_tokenizers import PATTERN

        with open(os.path.join(folder, "byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.folder, self.own = folder, None
        self.strange = re.compile(f"[^\0-{_PLAIN_END}]").search
        self.words: dict[str, bytes | None] = {}
        self.held = 0
        self.opens = np.zeros(max(ranks.values()) + 1, bool)  # ids whose bytes begin with a space
        for token, rank in ranks.items():
            self.opens[rank] = token[:1] == b" "

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _whole(self, text: str) -> bytes:
        try:
            return self._packed(self.ranks.encode_ordinary(text))
        except Exception:  # a text of one long run of characters can exceed the pattern library's limits
            return self._own(text)

    def _own(self, text: str) -> bytes:
        if self.own is None:
            from tokenizers import Tokenizer

            self.own = Tokenizer.from_file(os.path.join(self.folder, "byte_bpe_50k.json"))
            self.own.encode_special_tokens = True
        return self._packed(self.own.encode(text, add_special_tokens=False).ids)

    def _learn(self, words: set[str]) -> None:
        """Encodes new words in one call: each begins with a space, and no id inside a word does."""
        edged = {w for w in words if not w or w[0].isspace() or w[-1].isspace()}
        self.words.update(dict.fromkeys(edged))
        self.held += ENTRY * len(words) + sum(map(len, words))
        plain = list(words - edged)
        if not plain:
            return
        ids = np.frombuffer(self._whole(" " + " ".join(plain)), "<u4")
        cuts = (np.flatnonzero(self.opens[ids]) * 4).tolist() + [4 * len(ids)]
        packed = ids.tobytes()
        self.held += len(packed)
        self.words.update(zip(plain, [packed[a:b] for a, b in zip(cuts, cuts[1:])], strict=True))

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed; all the texts' words are in memory at once."""
        cut = [t.split(" ") if t.isascii() or not self.strange(t) else None for t in texts]
        if self.held > REMEMBER:
            self.words.clear()
            self.held = 0
        self._learn(set().union(*[p[1:] for p in cut if p]).difference(self.words))
        known, out = self.words.__getitem__, []
        for text, parts in zip(texts, cut, strict=True):
            if parts is None:
                out.append(self._own(text))
                continue
            head = parts[0]
            if len(parts) == 1 or not head or head[-1].isspace():
                out.append(self._whole(text))
                continue
            try:
                out.append(self._whole(head) + b"".join(map(known, parts[1:])))
            except TypeError:  # white space beside a space
                out.append(self._whole(text))
        return out


def chunks(texts: list[str], chars: int = 1_000_000) -> Iterator[list[str]]:
    """texts in order, in lists of about so many characters."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= chars:
            yield held
            held, n = [], 0
    if held:
        yield held


_loaded: dict[str, ByteBpe] = {}


def load(folder: str) -> ByteBpe:
    """The tokenizer, loaded once for each worker process."""
    if folder not in _loaded:
        _loaded[folder] = ByteBpe(folder)
    return _loaded[folder]
