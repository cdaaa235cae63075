import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpuswright.llm import packing as P
from corpuswright.llm.token_ids import chunks, default_vocabulary, load

ODD = ["", " ", "  ", "a  b", "a \n b", "\n\n x", "x ", " x", "<|endoftext|> a", "日本語 テキスト", "a b c　d", "don't we're it's", "x" * 5000, "é" * 300 + " " * 50 + "z", "1 2  3\t4", "naïve café", "a\x1c b", "ſ ŒŁ", "🙂 🙂"]


def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_tokenizers():
    r = random.Random(1)
    texts = ODD + ["".join(r.choices("ab cdé.,\n \t!1'", k=r.randint(0, 60))) for _ in range(2000)]
    wanted = [struct.pack(f"<{len(x.ids)}I", *x.ids) for x in reference().encode_batch(texts, add_special_tokens=False)]
    bpe = load(default_vocabulary())
    assert [p for some in chunks(texts, 1000) for p in bpe.packed(some)] == wanted


@pytest.mark.parametrize("seed", range(8))
def test_bounds_hold_and_bins_fit(seed):
    r = random.Random(seed)
    lengths = [r.choice([r.randint(1, 100), r.randint(30, 70), 51, 34]) for _ in range(r.randint(0, 300))]
    bins, places, first = P.best_fit(lengths, 100)
    n = P.tighten(lengths, bins, places, first, 100, P.bins_needed(lengths, 100))
    assert n <= first
    held = defaultdict(list)
    for b, p, x in zip(bins, places, lengths, strict=True):
        held[b].append((p, x))
    assert len(held) == n
    for pieces in held.values():
        at = 0
        for p, x in sorted(pieces):
            assert p == at
            at += x
        assert at <= 100
    assert -(-sum(lengths) // 100) <= P.bins_needed(lengths, 100) <= n
    assert P.bins_needed([51] * 7, 100) == 7 and P.bins_needed([34] * 7, 100) == 4


@pytest.mark.parametrize("group", [10, 20_000])
def test_every_document_is_packed_whole(spark, group):
    r = random.Random(3)
    texts = [*ODD, None, *[" ".join("word" + str(r.randrange(99)) for _ in range(r.choice([3, 30, 400, 2500]))) for _ in range(80)]]
    rows = [(i, t, 1, 2) for i, t in enumerate(texts)] + [(None, "no id", 1, 2), (5, "again", 1, 2), (5, "again", 1, 2)]
    found = P.pack(spark.createDataFrame(rows, "doc_id long, text string, sequence_id int, _g int").repartition(5), group=group).collect()
    ids = [x.ids + [2] for x in reference().encode_batch([t or "" for t in texts], add_special_tokens=False)]
    sequences, got = defaultdict(list), defaultdict(list)
    for x in found:
        sequences[x.sequence_id].append((x.offset, x.length))
        got[x.doc_id].append(x)
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(got[None]) == 1 and len(got[5]) == 3
    for i, whole in enumerate(ids):
        if i == 5:
            continue
        parts = sorted(got[i], key=lambda x: x.piece)
        assert [p.piece for p in parts] == list(range(-(-len(whole) // 1024)))
        at = 0
        for k, p in enumerate(parts):
            body = whole[p.start : p.start + p.length]
            assert p.start == at and (k == 0 or p.length == 1024) and p.ids_crc32 == zlib.crc32(struct.pack(f"<{len(body)}I", *body))
            at += p.length
        assert at == len(whole)
    short = [x.length for x in found if x.length < 1024]
    assert len(sequences) <= len(found) - len(short) + P.bins_needed(short, 1024) + (1 if group > 100 else 4)


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
