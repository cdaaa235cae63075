import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from corpuswright.llm import exact_dedup as E
from corpuswright.llm import near_dedup as N
from corpuswright.llm import shingles

A_TO_Z = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_groups(spark, keep):
    texts = ["A b", "a B", "É", "é", "", None, "x" * 200_000, "X" * 200_000, "alone", "a b"]
    rows = [(i, t, 1, "k", b"s") for i, t in enumerate(texts)] + [(None, "alone", 1, "", b""), (None, "no id", 1, "", b"")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int, _salt string, h binary")
    found = {(r.doc_id, r.text_sha256): r for r in E.exact_groups(df, keep).collect()}
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[(t or "").translate(A_TO_Z)].append(i)
    assert len(found) == len(rows)
    for body, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (min if keep == "min" else max)(known) if known else None
        for i in ids:
            r = found[i, hashlib.sha256(body.encode()).hexdigest()]
            assert (r.keep_id, r.group_size, r.kept) == (best, len(ids), i == best)
    left = E.exact_dedup(df, keep)
    assert left.columns == df.columns and left.count() == len(groups)


def test_exact_empty_and_repeated(spark):
    assert E.exact_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a")], "doc_id long, text string")
    assert [r.kept for r in E.exact_groups(twice, "min").orderBy("doc_id").collect()] == [True, True, False]
    assert E.exact_dedup(twice, "min").count() == 1
    with pytest.raises(ValueError):
        E.exact_groups(twice, "any")
    with pytest.raises(ValueError):
        E.exact_groups(twice.drop("text"))


def brute_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(A_TO_Z))
    return frozenset([tuple(words)] if 0 < len(words) < k else [tuple(words[i : i + k]) for i in range(len(words) - k + 1)])


def corpus(seed=4, groups=25):
    r = random.Random(seed)
    texts = ["", None, " \n\t", "one", "One", "one two", "One\ntwo", "a b c d", "a b c d e", "\x1c", "x" * 50_000, "a b c", "A  B  C"]
    for _ in range(groups):
        base = [f"w{r.randrange(500)}" for _ in range(r.choice([4, 8, 12, 40, 200]))]
        for _ in range(r.choice([1, 2, 3, 25])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                copy[r.randrange(len(copy))] = f"v{r.randrange(10**6)}"
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("k", [4, 5])
def test_shingle_sets_equal_brute_force(k):
    texts = [t or "" for t in corpus()]
    hashes, at = shingles.sets([t.encode() for t in texts], k)
    names = {}
    for i, t in enumerate(texts):
        wanted = brute_set(t, k)
        assert at[i + 1] - at[i] == len(wanted)
        key = hashes[at[i] : at[i + 1]].tobytes()
        assert names.setdefault(key, wanted) == wanted
    assert len(names) == len(set(names.values()))


def thue_morse(n, swap=False):
    """Two words of 2^n letters of which polynomial hashes modulo a power of two are equal for every odd base."""
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(2**n))


def test_words_that_collide_under_polynomials_are_told_apart(spark):
    one, two = thue_morse(10), thue_morse(10, True)
    texts = [one, two, f"{one} b c d e f g h", f"{two} b c d e f g h", one.upper(), "a\tb c d e", "b a c d e"]
    found = {r.doc_id: r.component_id for r in N.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4, 80).collect()}
    assert found == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0, 5: 5, 6: 6}


@pytest.mark.parametrize("segment", [1, 7, 64])
def test_long_texts_are_cut_between_words(segment, monkeypatch):
    r = random.Random(segment)
    texts = ["".join(r.choice("aB \n\té" + "c" * 9) for _ in range(r.randint(0, 400))).encode() for _ in range(60)] + [b" " * 300, b"x" * 300]
    wanted = [shingles.word_hashes(t).tolist() for t in texts]
    monkeypatch.setattr(shingles, "SEGMENT", segment)
    assert [b"".join(shingles._segments(t)) for t in texts] == texts
    assert [shingles.word_hashes(t).tolist() for t in texts] == wanted


def test_names_tell_sets(spark):
    texts = [t.encode() for t in ("a b c d", "A b  c\nd", "a b c d a b c d", "d a b c d a b c d a", "x", "", " ")]
    hashes, at = shingles.sets(texts, 4)
    found = shingles.names(texts, hashes, at, 4)
    assert found[0] == found[1] and found[2] == found[3] and found[5] == found[6] and len(set(found)) == 4


@pytest.mark.parametrize(("block", "held"), [(3, 1 << 20), (1000, 2000)])
def test_buckets_of_unlike_members_and_large_groups(spark, block, held, monkeypatch):
    """Texts that share one long passage and little else, near copies of one text at all distances, and their copies."""
    monkeypatch.setattr(N, "SMALL", 4)
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "BYTES", held)
    r = random.Random(5)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    passage, base, texts = words(30), words(60), []
    for _ in range(60):
        texts.append(" ".join(passage + words(r.choice([2, 5, 9, 20]))))
    for _ in range(140):
        copy = list(base)
        for _ in range(r.randrange(7)):
            copy[r.randrange(60)] = f"v{r.randrange(10**6)}"
        texts += [" ".join(copy)] * r.choice([1, 1, 3])
    rows = list(enumerate(texts))
    r.shuffle(rows)
    found = {x.doc_id: x.component_id for x in N.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()}
    assert found == brute_components(rows, 4)[0]


def brute_components(rows, k):
    sets = {i: brute_set(t, k) for i, t in rows}
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}, sets


@pytest.mark.parametrize("small", [16, 2])
def test_components_equal_brute_force(spark, small, monkeypatch):
    monkeypatch.setattr(N, "SMALL", small)
    monkeypatch.setattr(N, "BLOCK", 10)
    rows = [(i * 3 + 1, t) for i, t in enumerate(corpus())]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame([(*r, 0, b"") for r in [*rows, (None, "a b c d")]], "doc_id long, text string, rep int, registers binary")
    found = {r.doc_id: r for r in N.near_groups(df, 4, 80).collect()}
    wanted, sets = brute_components(rows, 4)
    assert len(found) == len(rows) + 1
    assert {i: found[i].component_id for i in wanted} == wanted
    assert all(found[i].n_shingles == len(sets[i]) and found[i].kept == (wanted[i] == i) for i in wanted)
    assert found[None].component_id is None and found[None].kept


def test_near_dedup_keeps_columns(spark):
    rows = [(1, "a b c d e f g h", "x"), (2, "A b c d e f g h", "y"), (3, None, "z"), (4, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    left = N.near_dedup(df)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [1, 3, 4]
    assert N.near_groups(df.limit(0)).count() == 0


def test_estimates_are_corrected_for_chance():
    r = np.random.default_rng(1)
    a, b = (np.sort(r.integers(0, 2**63, 600).astype(np.uint64)) for _ in range(2))
    half = np.sort(np.r_[a[:400], b[:200]])
    rows = N.registers(np.r_[a, b, half], np.array([0, 600, 1200, 1800]))
    n = np.array([600])
    assert abs(N.estimate(rows[:1], rows[1:2], n, n)[0]) < 0.06
    assert abs(N.estimate(rows[:1], rows[2:], n, n)[0] - 0.5) < 0.15
    assert N.estimate(rows[:1], rows[:1], n, n)[0] == 1
