import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import DATA

from corpuswright.llm import language_id as L
from corpuswright.llm import mixing as M
from corpuswright.llm import pii
from corpuswright.llm import quality_rules as Q
from corpuswright.llm import token_counts as T
from corpuswright.llm.token_ids import default_vocabulary


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    places = {p for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(places)


def test_quality_measures_equal_brute_force(spark):
    r = random.Random(2)
    texts = ["", None, " ", "a", "a b c", "a b c a b c", "a a a a", "#*$%&|<>", "x\nx\n\n \n \nx", "é\x0b日 \x1c 😀", "a " * 30_000]
    texts += [" ".join(r.choices(["a", "b", "c", "d", "#", "\n", "long\n"], k=r.randint(0, 90))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, source string, host_ok int")
    for row in Q.measures(df).collect():
        n = brute_measures(texts[row.doc_id])
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == n
        assert row.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])


def test_hosts_are_judged_by_shrunken_rates(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [("bad", "x")] * 95 + [("bad", good)] * 5 + [("good", good)] * 180 + [("good", "x")] * 20 + [("few", "x")] * 3 + [("few", good)] + [(None, good)] * 30
    df = spark.createDataFrame([(i, t, s, 0) for i, (s, t) in enumerate(rows)], "doc_id long, text string, source string, kept int")
    found = Q.quality_rules(df).collect()
    assert len(found) == len(rows)
    assert all(r.kept == (not r.base_failed and r.source != "bad") for r in found)
    rate = {r.source: r.host_rate for r in found}
    assert 0.5 < rate["bad"] < 0.95 and 0.1 < rate["good"] < 0.3 and rate["few"] < 0.75
    assert Q.quality_rules(df.limit(0)).count() == 0
    assert Q._prior(None, None, None, None, 0) == (0.0, 1.0)


def brute_spans(text):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def right(kind, s):
        d = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            return 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    return [f"{k}:{m.start()}:{m.end()}" for k, p in patterns.items() for m in re.finditer(p, text) if right(k, m.group())]


def test_base_spans_equal_brute_force(spark):
    r = random.Random(6)
    texts = ["", None, "a@b.c_d@e.f", "x@y z@w", "1.2.3.4.5.6.7.8 999.1.1.1 000255.0.0.1", "5 4111 1111 1111 1111", "+1 (692) 555-7565 +44+1 222 333 4444", "é😀 a@b.co 😀 +1 2345678901 x", "a@b@c.de", "....@@@a.b@c.d"]
    texts += ["1" * 20_000, "a" * 100_000, "a.b@" + "c." * 10_000 + "d", "+1 " + "(" * 3000 + "2 34567890"]
    texts += ["".join(r.choices(["a", "1", "4111", ".", "@", "+", " ", "-", "(", ")", "25", "é", "x.y"], k=r.randint(1, 40))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, base int")
    found = pii.digests(pii.spans(df)).collect()
    assert len(found) == len(texts)
    for row in found:
        wanted = brute_spans(texts[row.doc_id] or "")
        kinds = Counter(s.split(":")[0] for s in wanted)
        assert row.base_sha256 == hashlib.sha256(",".join(wanted).encode()).hexdigest()
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(kinds[k] for k in pii.KINDS)
        assert set(wanted) <= set(filter(None, row.spans.split(","))) | ({""} if not wanted else set())


def test_candidates_are_added_with_care(spark):
    texts = ["call 555-123-4567 now", "joe (at) mail [dot] com", "order 123-45-6789 came", "in 2020-10-12 it was", "no numbers", "tel: 4111 and mail a@b.co"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.digests(pii.spans(df)).collect()}
    assert found == {0: "phone:5:17", 1: "email:0:23", 2: "", 3: "", 4: "", 5: "email:19:25"}
    assert {r.doc_id: r.text for r in pii.redact(df).collect()}[0] == "call <PHONE> now"
    assert pii.spans(df.limit(0)).count() == 0


def brute_kneser_ney(grams, alphabet):
    """p(last | before) for one language, straight from the definition."""
    orders = {L.ORDER: Counter(grams)}
    for k in range(L.ORDER - 1, 0, -1):
        orders[k] = Counter(g[1:] for g in orders[k + 1])

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / alphabet
        c = orders[k]
        ones, twos = (sum(v == n for v in c.values()) for n in (1, 2))
        d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
        total = sum(v for g, v in c.items() if g[:-1] == gram[:-1])
        if not total:
            return p(gram[1:])
        kinds = sum(1 for g in c if g[:-1] == gram[:-1])
        return max(c[gram] - d, 0) / total + d * kinds / total * p(gram[1:])

    return p


def test_model_equals_the_definition():
    texts = {"aa": "the theatre then tethered", "bb": "der die das dort dann"}
    counts = {}
    for name, text in texts.items():
        points, _, _ = L.characters([text])
        held = "".join(map(chr, points))
        counts[name] = dict(Counter(held[i : i + L.ORDER] for i in range(len(held) - L.ORDER + 1)))
    model = L.build(counts)
    alphabet = len({g[-1] for c in counts.values() for g in c}) + 1
    probe = "there das zz theé"
    points, starts, _ = L.characters([probe])
    held = "".join(map(chr, points))
    for i, name in enumerate(model.languages):
        p = brute_kneser_ney(Counter(counts[name]), alphabet)
        wanted = -sum(math.log(p(held[k - L.ORDER + 1 : k + 1])) for k in range(L.ORDER - 1, len(held))) / (len(held) - L.ORDER + 1)
        assert abs(model.entropies([probe])[0][0][i] - wanted) < 1e-4
    for k in range(1, L.ORDER + 1):
        assert (np.diff(model.grams[k].astype(object)) > 0).all()


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(str(DATA / "sf0.01" / "documents.parquet"))
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    found = L.language_id(docs).collect()
    aside = [r for r in found if r.held_out]
    assert len(found) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert sum(r.lang_pred == truth[r.doc_id] for r in aside) / len(aside) > 0.98
    assert all(0 <= r.score <= 1 for r in found)


def test_language_edge_cases(spark):
    rows = [(i, f"{w} " * 30, lang, None) for i, (w, lang) in enumerate([("hello there", "en"), ("guten tag", "de")] * 20)]
    rows += [(100, None, "en", None), (101, "", None, None), (102, "123 !?", "de", None), (None, "hello", "en", None), (103, "hello there " * 20_000, None, None), (104, "²½", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    found = {r.doc_id: r for r in L.language_id(df).collect()}
    assert len(found) == len(rows)
    assert all(found[i].lang_pred == "und" and found[i].score == 0 and found[i].rejected for i in (100, 101, 102, 104))
    assert found[103].lang_pred == "en" and not found[None].held_out
    assert not any(r.doc_id in (100, 101, 102, 104) for r in L.keep_identified(df).collect())
    assert L.keep_identified(df).columns == df.columns
    assert all(r.lang_pred == "und" for r in L.language_id(df.withColumn("lang", df["score"])).collect())
    assert L.language_id(df.limit(0)).count() == 0


@pytest.mark.parametrize("weights", [[1], [1, 1], [5, 3, 2], [0.9, 0.05, 0.03, 0.02], [1.0] * 64, list(range(1, 40))])
def test_timetable_deviates_less_than_a_block(weights):
    slots = M.shares(weights, 64)
    assert sum(slots) == 64 and min(slots) >= 1
    times = M.timetable(slots)
    assert sorted(t for lane in times for t in lane) == list(range(64))
    owner = {t: lane for lane, ts in enumerate(times) for t in ts}
    done = [0] * len(slots)
    for t in range(64):
        done[owner[t]] += 1
        assert all(abs(n - a * (t + 1) / 64) < 1 for n, a in zip(done, slots, strict=True))
    with pytest.raises(ValueError):
        M.shares([1.0] * 65, 64)


@pytest.mark.parametrize("weights", [None, {"a": 3.0, "b": 1.0}])
def test_mixing_places_every_row(spark, weights, monkeypatch):
    monkeypatch.setattr(M, "STREAM", 50)
    r = random.Random(1)
    rows = [(i, r.choice(["a", "a", "a", "b", "c", None]), "t", 0, "x") for i in range(900)] + [(None, "b", "t", 0, "x"), (3, "a", "t", 0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, slot int, _lane string")
    found = M.scheduled(df, weights, block=8, period=16, prefix="m_").collect()
    assert len(found) == len(rows)
    lanes = defaultdict(list)
    for x in found:
        lanes[x.m_lane].append(x)
    taken = defaultdict(set)
    for lane, held in lanes.items():
        held.sort(key=lambda x: (int(hashlib.md5(("" if x.doc_id is None else str(x.doc_id)).encode()).hexdigest()[:8], 16), -1 if x.doc_id is None else x.doc_id, x.m_block, x.m_place))
        for rank, x in enumerate(held):
            assert (x.m_block, x.m_place) == (rank // 8, rank % 8) and x.m_release <= x.m_slot < x.m_deadline
            taken[x.m_slot].add((lane, x.m_block))
    assert all(len(v) == 1 for v in taken.values())
    assert len(lanes) == (3 if weights else 4)
    mixed = M.mixed(df, weights, block=8, period=16)
    assert mixed.columns == df.columns
    order = {(x.doc_id, x.source): (x.m_slot, x.m_place) for x in found if x.doc_id != 3}
    got = [order[x.doc_id, x.source] for x in mixed.collect() if x.doc_id != 3]
    assert got == sorted(got) and len(got) == len(rows) - 2
    assert M.scheduled(df.limit(0), weights, prefix="m_").count() == 0


def test_token_counts_equal_plain_dynamic_programming(spark):
    model = T.load(default_vocabulary())

    def brute(body):
        best = [(0.0, 0)] + [(-math.inf, 0)] * len(body)
        for e in range(1, len(body) + 1):
            for s in range(max(0, e - model.longest), e):
                if body[s:e] in model.score:
                    best[e] = max(best[e], (best[s][0] + model.score[body[s:e]], best[s][1] - 1))
        return -best[-1][1]

    r = random.Random(5)
    texts = ["", None, " ", "the theatre", "naïve 日本 😀", "a_b 12.5", "\n\n x\t", "y" * 3000, *["".join(r.choices("abcdehinrt é.,1\n", k=r.randint(1, 80))) for _ in range(100)]]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, "a", 0)], "doc_id long, text string, n_tokens int")
    found = {x.doc_id: x for x in T.token_counts(df).collect()}
    for i, t in enumerate(texts):
        parts = T._PRETOKEN.findall(t or "")
        assert "".join(parts) == (t or "")
        assert (found[i].n_tokens, found[i].n_pretokens, found[i].n_bytes) == (sum(brute(p.encode()) for p in parts), len(parts), len((t or "").encode()))
    assert found[None].n_tokens == 1 and T.token_counts(df.limit(0)).count() == 0


def test_mixing_gives_every_source_its_own_lane(spark):
    df = spark.createDataFrame([(i, f"s{i % 1500}" if i % 40 else None) for i in range(6000)], "doc_id long, source string")
    wanted = df.select("source").distinct().count()
    found = M.scheduled(df, block=2).collect()
    assert len({r.lane for r in found}) == wanted > M.PERIOD
    assert len({(r.source, r.lane) for r in found}) == wanted and len({(r.lane, r.block) for r in found}) == len({r.slot for r in found})
    assert all(r.release <= r.slot < r.deadline for r in found)
    assert {r.lane for r in M.scheduled(df, {f"s{i}": i + 1.0 for i in range(1500)}, block=2).collect()} == {r.lane for r in found}


@pytest.mark.parametrize("weights", [[0.9999, 0.0001], [0.7, 0.2, 0.0999, 0.0001], [math.sqrt(n) for n in range(1, 1200)], [math.pi, math.e, 1e-3]])
def test_mixing_keeps_to_the_given_weights_over_many_periods(weights):
    steps = 100 * M.PERIOD
    total = math.fsum(weights)
    done = [0] * len(weights)
    for t, lane, block, release, deadline in M.schedule(M.whole(weights), [steps] * len(weights)):
        if t == steps:
            break
        assert block == done[lane] and abs(block - weights[lane] / total * t) < 1 + 1e-6  # just before its turn
        assert release <= t < deadline
        done[lane] += 1
        assert abs(done[lane] - weights[lane] / total * (t + 1)) < 1 + 1e-6
        if t % 997 == 0:
            assert all(abs(n - w / total * (t + 1)) < 1 + 1e-6 for n, w in zip(done, weights, strict=True))
    assert sum(done) == steps


def test_every_made_positive_has_a_candidate_and_long_groups_are_found(spark):
    from pyspark.sql import functions as F

    made = [text for y, text in pii._made() if y]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    assert df.where(F.size(pii._all_candidates()) == 0).count() == 0
    texts = ["Praxis 089/1234567 Bonn", "0170 1234567", "tel: 030 12345678", "ping fe80::1 now", "2001:db8::1.", "std::add a::b", "order 089/1234567", "at 12:30:45"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.digests(pii.spans(df)).collect()}
    assert found == {0: "phone:7:18", 1: "phone:0:12", 2: "phone:5:17", 3: "ip:5:12", 4: "ip:0:11", 5: "", 6: "", 7: ""}


def test_small_hosts_are_judged_too(spark):
    rows = [("small", i < 17) for i in range(19)] + [("twenty", i < 18) for i in range(20)] + [("one", True)] + [(f"h{i % 30}", i // 30 % 10 == 0) for i in range(900)]
    found = {r.source: r for r in Q.host_verdicts(spark.createDataFrame(rows, "source string, base_failed boolean")).collect()}
    assert found["small"].host_rate > 0.5 and not found["small"].host_ok and not found["twenty"].host_ok
    assert found["one"].host_ok and all(r.host_ok for s, r in found.items() if s.startswith("h"))


def test_prefixes_and_ranks_of_arrays(spark):
    from pyspark.sql import functions as F

    from corpuswright.llm import arrays

    r = random.Random(8)
    rows = [(i, [r.randrange(50) for _ in range(n)], sorted(r.randrange(50) for _ in range(m))) for i, (n, m) in enumerate([(0, 0), (0, 3), (3, 0), (1, 1), (128, 5), (129, 300), (700, 257)])]
    df = spark.createDataFrame(rows, "i long, a array<int>, b array<int>")
    found = df.select("i", arrays.prefix(F.col("a"), lambda x, y: x + y).alias("s"), F.expr(arrays.prefix_sql("a", "{a} + {x}")).alias("q"), arrays.tops(F.col("a")).alias("t"), arrays.ranks(F.col("b"), F.col("a"), False).alias("l"), arrays.ranks(F.col("b"), F.col("a"), True).alias("e")).collect()
    for x in found:
        _, a, b = rows[x.i]
        assert x.s == x.q == [sum(a[:k]) for k in range(len(a))] and x.t == [max([0, *a[:k]]) for k in range(len(a) + 1)]
        assert x.l == [sum(v < q for v in b) for q in a] and x.e == [sum(v <= q for v in b) for q in a]


def test_spans_and_marks_of_long_texts(spark):
    """Texts of very many hits take time in proportion, and are placed and redacted as a plain loop does it."""
    import time

    r = random.Random(12)
    unit = ["tel 0170 1234567,", "call 555-123-4567;", "a@b.co", "joe (at) mail [dot] com", "fe80::1 x", "12 34 56 78 90", "+44 20 7946 0958", "word", "é😀", "4111 1111 1111 1111", "joe at mail dot org", "order 123-45-6789"]
    texts = [" ".join(r.choices(unit, k=k)) for k in (1, 5, 40, 200, 3000)] + [" ".join(f"x{i}" for i in range(64_000)), "0170 1234567 " * 16_000, "a@b.co " * 40_000, "é" * 9000 + " a@b.co " + "😀" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    t = time.time()
    found = {x.doc_id: x for x in pii.spans(df).collect()}
    marked = {x.doc_id: x.text for x in pii.redact(df).collect()}
    assert time.time() - t < 60
    for i, text in enumerate(texts):
        wanted = brute_spans(text)
        assert [f"{s.kind}:{s.start}:{s.stop}" for s in found[i].base] == wanted
        added = sorted((s.start, s.stop) for s in found[i].added)
        assert all(a[1] <= b[0] for a, b in zip(added, added[1:], strict=False))
        out, at = [], 0
        for start, stop, kind in sorted((s.start, s.stop, s.kind) for s in [*found[i].base, *found[i].added]):
            if start >= at:
                out += [text[at:start], f"<{kind.upper()}>"]
            at = max(at, stop)
        assert marked[i] == "".join(out) + text[at:]
    assert len(found[6].added) == 16_000 and len(found[7].base) == 40_000 and not found[5].added


def test_each_kind_has_its_bar(spark):
    import numpy as np

    margins = np.array([5.0, 4.0, 3.0, 2.0, 1.0, 9.0, 9.0])
    y, of = np.array([1, 1, 1, 1, 0, 0, 1.0]), np.array(["ip"] * 5 + ["card"] * 2)
    least, most = (np.log(p / (1 - p)) for p in (pii.LEAST, pii.MOST))
    assert pii.bars(margins, y, of) == dict.fromkeys(pii.KINDS, most)
    many = np.tile(margins[:4], 30)
    assert pii.bars(many, np.ones(120), np.array(["ip"] * 120))["ip"] == 2.0 and least < 2 < most
    _, bars = pii.fit(spark)
    assert set(bars) == set(pii.KINDS) and all(least <= b <= most for b in bars.values())


def test_hosts_are_judged_by_every_rule(spark):
    good = " ".join(f"word{i}" for i in range(60))
    texts = {"fine": good, "signs": good + " #" * 9, "lines": good + "\nthe same line\n" * 3 + "the same line\n" * 5, "glued": " ".join(f"{i:013d}" for i in range(60)), "one": " ".join("a" for _ in range(49)) + " b" * 2}
    rows = [(i, text, name) for name, text in texts.items() for i in range(40)] + [(i, good, f"h{i % 7}") for i in range(300)] + [(1, "#", "h1")]
    found = Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.source for r in found if r.kept} == {"fine"} | {f"h{i}" for i in range(7)}
    assert not any(r.base_failed for r in found if r.source in ("signs", "lines", "glued"))


def test_mixing_takes_clashing_names(spark):
    rows = [(i, f"s{i % 3}", i, i, i, i) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, source string, slot long, __mix_slot long, _row long, Lane long")
    found = M.scheduled(df, block=4)
    assert found.columns == ["doc_id", "source", "__mix_slot", "_row", "lane", "block", "place", "slot", "release", "deadline"] and found.count() == 40
    mixed = M.mixed(df, block=4)
    assert mixed.columns == df.columns and sorted(map(tuple, mixed.collect())) == rows


def test_trie_scores_each_prefix_once(monkeypatch):
    model = T.Unigram(default_vocabulary())
    made = []
    forward = model._forward
    monkeypatch.setattr(model, "_forward", lambda body, stop, *rest: made.append(body[:stop]) or forward(body, stop, *rest))
    words = ["the", "there", "them", "then", "he", "x" * 500]
    counts = {w: model.insert(w.encode()) for w in words}
    short = [p for p in made if len(p) <= T.LONG]
    assert len(short) == len(set(short)) == len({w[:k] for w in words for k in range(1, min(len(w), T.LONG) + 1)})
    assert len(model.best) == len(short) + 1 and sum(c >= 0 for c in model.terminal[1:]) == len(words) - 1
    before = len(made)
    assert {w: model.insert(w.encode()) for w in words[:-1]} == {w: counts[w] for w in words[:-1]} and len(made) == before
    model.forget()
    monkeypatch.setattr(T, "NODES", 4)
    assert {w: model.insert(w.encode()) for w in words} == counts and len(model.best) == 4


def test_memory_of_words_is_bounded_in_bytes(monkeypatch):
    from corpuswright.llm import token_ids

    monkeypatch.setattr(token_ids, "REMEMBER", 10_000)
    bpe, plain = token_ids.ByteBpe(default_vocabulary()), token_ids.ByteBpe(default_vocabulary())
    r = random.Random(1)
    for _ in range(20):
        text = " ".join("".join(r.choices("abcdefgh", k=300)) for _ in range(20))
        assert bpe.packed([text]) == [plain._whole(text)]
        assert sum(map(len, bpe.words)) <= 10_000 + len(text)


def test_without_labels_all_documents_stay(spark):
    df = spark.createDataFrame([(1, "hello", None), (2, None, None)], "doc_id long, text string, lang string")
    assert L.keep_identified(df).count() == 2
