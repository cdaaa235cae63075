import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from corpuswright.functions.codec import encoded
from corpuswright.functions.tokenizers import ByteTokenizer
from corpuswright.operators import batching as B
from corpuswright.operators import catalog, dedup, metrics, ranks, report, serve, stats, store
from corpuswright.operators.interleave import round_robin
from corpuswright.operators.state import ServingState
from corpuswright.sources import adapters as A
from corpuswright.sources import token_log


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_code_files_stop_at_a_file_without_language(spark):
    files = "files array<struct<language:string,content:string>>"
    raw = frame(spark, [([("Python", "a"), (None, "b"), ("Go", "c")],), ([("go", "d"), ("Golang", "e")],), (None,), ([],)], files)
    allowed = [(r.text, r.category) for r in A.code_files(raw, "Python, C, Go, Golang").collect()]
    assert sorted(allowed) == [("a", "Python"), ("d", "OtherLanguage"), ("e", "OtherLanguage")]
    assert sorted(r.text for r in A.code_files(raw).collect()) == ["a", "b", "c", "d", "e"]
    assert {r.category for r in A.code_files(raw).where("text = 'b'").collect()} == {"OtherLanguage"}


def test_adapters_without_their_columns_give_nothing(spark):
    for adapter in A.ADAPTERS.values():
        assert adapter(spark.range(3)).count() == 0


def test_scores_and_flags(spark):
    web = frame(spark, [("a", 0.75), ("b", 0.74), ("c", None), ("d", math.nan)], "text string, language_score double")
    assert sorted(r.text for r in A.web(web).collect()) == ["a", "d"]
    code = frame(spark, [("c1", True, "C", "c2"), ("c1", False, None, None), ("c1", None, "Go", None)], "code string, is_vulnerable boolean, language string, code_fixed string")
    texts = [r.text for r in A.code_security(code).collect()]
    assert "Fixed code:\nc2" in texts[0] and "The following None code is not vulnerable" in texts[1] and "not vulnerable" in texts[2]


def test_distilled_chats_keep_what_can_be_read(spark):
    rows = [('{"messages": [{"role": "user", "content": "q"}]}', "r"), ("{'messages': [{'role': 'user', 'content': 'q'}]}", " "), ("[]", "r"), ("{'messages': [None, {'from': 'h', 'value': 'v'}]}", "r"), (None, "r")]
    found = A.distilled_chat(frame(spark, rows, "instruction string, response string")).collect()
    assert sorted(r.text.split("\n")[0] for r in found) == ["<|im_start|>h", "<|im_start|>user"]


@pytest.mark.parametrize("sizes", [(3, 0, 5), (1, 1), (0,), (4, 7, 2, 7)])
def test_round_robin_equals_the_loop(spark, sizes):
    live = {i: iter(range(n)) for i, n in enumerate(sizes)}
    wanted = []
    while live:
        for i in list(live):
            try:
                wanted.append((i, next(live[i])))
            except StopIteration:
                del live[i]
    sources = [spark.range(n).select((F.col("id") * 3).alias("ordinal")) for n in sizes]
    found = round_robin(sources, span=4).orderBy("position").collect()
    assert [(r.source_idx, r.rn) for r in found] == wanted
    assert [r.position for r in found] == list(range(sum(sizes)))


def test_running_sums_over_ranges_with_keys_and_nulls(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), r.randrange(-50, 400), i, r.randrange(9)) for i in range(300)]
    df = frame(spark, rows, "k string, o long, t long, v long")
    found = {x.t: (x.s, x.n) for x in ranks.ranked(ranks.running(df, "o", F.col("v"), "s", ("k",), span=16, ties=("t",)), "o", "n", ("k",), span=16, ties=("t",)).collect()}
    assert len(found) == 300
    for key in ("a", "b", None):
        total = 0
        for n, (_, _, t, v) in enumerate(sorted((x for x in rows if x[0] == key), key=lambda x: (x[1], x[2]))):
            assert found[t] == (total, n)
            total += v


def test_first_arrival_wins_and_copies_add_no_category(spark):
    rows = frame(spark, [(3, "x", "late"), (1, "x", "a"), (2, "y", "b"), (4, None, "c"), (5, "", "d"), (6, "z", None)], "ordinal long, text string, category string")
    kept = dedup.first_arrivals(rows)
    assert sorted(r.ordinal for r in kept.collect()) == [1, 2, 4, 6]
    assert dedup.first_arrivals(kept).count() == kept.count()
    names = {r.category: r.category_id for r in catalog.dictionary(kept).collect()}
    assert names == {"a": 1, "b": 2, "c": 3, "": 4}
    records = store.ingest(rows, ByteTokenizer())
    answers = {r.ordinal: (r.token_count, r.duplicate) for r in dedup.ingest_response(rows, records, 257).collect()}
    assert answers == {1: (2, False), 2: (2, False), 3: (0, True), 4: (1, False), 5: (0, True), 6: (2, False)}


def test_too_many_categories_fail(spark):
    rows = spark.range(256).select(F.col("id").alias("ordinal"), F.col("id").cast("string").alias("category"))
    assert catalog.dictionary(rows.limit(255)).count() == 255
    with pytest.raises(Exception, match="more than 255 categories"):
        catalog.dictionary(rows).collect()


def test_offsets_follow_the_log(spark):
    tokens = [list(range(n)) for n in (0, 3, 1, 7, 2)]
    rows = frame(spark, [(i * 9, 4, len(t), t, bytearray(encoded(4, t))) for i, t in enumerate(tokens)], "ordinal long, category_id int, token_count int, tokens array<int>, record binary")
    offsets = [r.file_offset for r in store.with_offsets(rows, span=10).orderBy("ordinal").collect()]
    assert offsets == [0, *itertools.accumulate(9 + 2 * len(t) for t in tokens)][:-1]
    log = b"".join(encoded(4, t) for t in tokens)
    assert [x[0] for x in token_log.parse(log)] == offsets
    assert [x[3] for x in token_log.parse(log + b"\x05\0\0")] == tokens
    logs = token_log.log_segments(rows.withColumn("segment", F.lit(0).cast("long"))).select(F.lit("p").alias("path"), "body")
    assert [r.tokens for r in token_log.scan(logs).orderBy("file_offset").collect()] == tokens


def test_log_files_are_scanned(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(encoded(1, [5]) + encoded(2, [6, 7]))
    assert [r.category_id for r in token_log.scan_files(spark, str(tmp_path)).orderBy("file_offset").collect()] == [1, 2]


def records(spark, n):
    return spark.range(n).select((F.col("id") * 5).alias("ordinal"), (F.col("id") + 1).alias("record_id"), F.lit("c").alias("category"), F.lit(3).alias("token_count"))


def test_serving_wraps_around(spark):
    found, cursor = serve.next_samples(records(spark, 7), serve.Cursor(6), 16, span=8)
    assert [r.position for r in found.orderBy("slot").collect()] == [(6 + i) % 7 for i in range(16)]
    assert cursor == serve.Cursor(1) and cursor.reset() == serve.Cursor(0)
    empty, same = serve.next_samples(records(spark, 0), serve.Cursor(0), 3)
    assert empty.count() == 0 and same == serve.Cursor(0)
    assert serve.next_samples(records(spark, 3))[0].count() == 256
    served = serve.served_counts(serve.next_samples(records(spark, 7), serve.Cursor(), 14)[0]).first()
    assert (served.served_count, served.served_token_count) == (14, 42)


def test_random_draws_take_the_next_id(spark):
    ids = [4, 5, 40, 41, 90]
    rows = frame(spark, [(i,) for i in ids], "record_id long")
    found = serve.random_samples(rows, 500, seed=2, span=8).collect()
    assert sorted(r.slot for r in found) == list(range(500))
    assert all(r.record_id == min(i for i in ids if i >= r.drawn) for r in found)
    assert serve.random_samples(rows.limit(0), 5).count() == 0


def model_chunks(t, b):
    out = []
    while len(t) > b + 1:
        out.append(t[: b + 1])
        t = t[b:]
    return [c for c in [*out, t] if len(c) >= 4]


def test_chunks_equal_the_recursion(spark):
    rows = frame(spark, [(n, 1, list(range(n))) for n in range(60)], "ordinal long, category_id int, tokens array<int>")
    found = {}
    for r in B.chunks(rows, 8).orderBy("ordinal", "chunk").collect():
        found.setdefault(r.ordinal, []).append(r.ids)
    assert all(found.get(n, []) == model_chunks(list(range(n)), 8) for n in range(60))


def test_pairs_and_rearranged_rows(spark):
    block, size = 256, 1000
    rows = frame(spark, [(n, 0, list(range(n))) for n in (4, 63, 64, 67, 120, 253, 257, 258, 600)], "ordinal long, chunk int, tokens array<int>")
    chunked = B.chunks(rows.drop("chunk"), block, ("ordinal",))
    for r in B.lm_pairs(chunked, block).collect():
        n = min(len(r.ids) - 1, block)
        assert (r.x, r.y) == (r.ids[:n] + [0] * (block - n), r.ids[1 : n + 1] + [-100] * (block - n))
    fim = B.fim_pairs(B.fim_rows(chunked.withColumn("was", F.col("ids")), size, F.lit(True), block, rate=1.0), block).collect()
    assert all(r.is_fim == (len(r.was) >= 64) for r in fim) and any(r.is_fim for r in fim)
    for r in (r for r in fim if r.is_fim):
        t = r.was[: block - 3]
        suf, mid = r.ids.index(size + 1), r.ids.index(size + 2)
        prefix, suffix, middle = r.ids[1:suf], r.ids[suf + 1 : mid], r.ids[mid + 1 : -1]
        assert r.ids[0] == size and r.ids[-1] == size + 3 and r.mid_at == mid
        assert prefix + middle + suffix == t and len(middle) >= min(16, len(t) // 4) and len(suffix) >= 4
        assert [y for y in r.y if y != -100] == [*middle, size + 3]
        assert len(r.x) == len(r.y) == block
    none = B.fim_rows(chunked, size, F.lit(False), block, rate=1.0)
    assert none.where("is_fim").count() == 0


def test_eval_set_and_last_chunk(spark):
    rows = frame(spark, [(n, list(range(n))) for n in range(60, 80)], "ordinal long, tokens array<int>")
    assert [(r.ordinal, len(r.ids)) for r in B.eval_set(rows, 66).collect()] == [(n, min(n, 66)) for n in range(64, 72)]
    assert B.last_chunk(B.chunks(rows, 40, ("ordinal",))).first().ids == list(range(40, 79))


def test_moving_average_equals_the_fold(spark):
    r = random.Random(1)
    rows = [(r.choice("ab"), i, r.choice([r.random(), None, math.nan, math.inf]) if i % 3 == 0 else r.random()) for i in range(400)]
    rows.append(("none", 1, None))
    state = {}
    for k, _, v in rows:
        if v is not None and math.isfinite(v):
            state[k] = v if k not in state else 0.01 * v + 0.99 * state[k]
    found = {x.k: x.ema for x in metrics.moving_average(frame(spark, rows, "k string, o long, v double"), "k", "o", "v").collect()}
    assert found.keys() == state.keys() and all(abs(found[k] - state[k]) < 1e-9 for k in state)


def test_losses(spark):
    rows = frame(spark, [("lm", 1, 6.0, 3), ("lm", 1, 4.0, 1), ("fim", 2, 0.0, 0)], "mode string, category_id int, loss_sum double, n long")
    found = {r.mode: (r.tokens, r.loss) for r in metrics.weighted_loss(rows).collect()}
    assert found == {"lm": (4, 2.5), "fim": (0, None)}
    steps = metrics.step_metrics(frame(spark, [(1, 30.0, 2), (1, 9.0, 0), (2, None, 0)], "step long, loss double, n long")).orderBy("step").collect()
    assert [(r.tokens, r.loss) for r in steps] == [(2, 30.0), (0, 0.0)] and steps[0].ppl == math.exp(20)
    acc = metrics.masked_accuracy(frame(spark, [([1, -100, 3], [1, 2, 4]), ([-100], [1])], "y array<int>, predicted array<int>")).collect()
    assert [(r.correct, r.counted, r.accuracy) for r in acc] == [(1, 2, 0.5), (0, 0, None)]


def test_learning_rates(spark):
    def at(expression, *steps):
        df = spark.createDataFrame([(s,) for s in steps], "s long")
        return [r[0] for r in df.orderBy("s").select(expression(F.col("s")).cast("double")).collect()]

    assert at(metrics.learning_rate, 0, 99, 250_000) == pytest.approx([1.5e-6, 1.5e-4, 3e-5])
    assert at(lambda s: metrics.learning_rate_big(s, True), 2999) == pytest.approx([30 * 1e-4])
    assert at(lambda s: metrics.learning_rate_big(s, False), 0, 2998, 2999) == pytest.approx([5e-5 * -2999 / 100, 5e-5 * -1 / 100, 0.0])


@pytest.mark.parametrize(("n", "kept"), [(0, 3), (-1, 3), (-2, 0), (2, 2), (9, 3)])
def test_retention(spark, n, kept):
    files = frame(spark, [("step_5.pt",), ("step_40.pt",), ("step_300.pt",)], "name string")
    rows = metrics.keep_last(files, n).collect()
    assert sum(r.kept for r in rows) == kept and [r.name for r in rows if r.latest] == ["step_300.pt"]
    assert n != 2 or {r.name for r in rows if r.kept} == {"step_40.pt", "step_300.pt"}


def test_statistics_and_report(spark):
    names = frame(spark, [("a", 1), ("B</script>", 2), ("c", 3)], "category string, category_id int")
    held = frame(spark, [(1, 5), (1, 6), (2, 2000)], "category_id int, token_count int")
    out = stats.category_stats(names, held, held.where("category_id = 1"))
    assert [r.category for r in stats.top(out, "token_count").collect()] == ["B</script>", "a", "c"]
    assert [r.category for r in stats.listed(out, "category").collect()] == ["a", "B</script>", "c"]
    assert [r.category for r in stats.listed(out, holding="SCRIPT").collect()] == ["B</script>"]
    assert [r.category for r in stats.served_maps(out).collect()] == ["a"]
    total = stats.totals(out).first()
    assert (total.total_samples, total.total_tokens, total.current_file_index, total.total_served_tokens) == (3, 2011, 27 + 4022, 11)
    page = report.render(out, stats.totals(out))
    assert "B&lt;/script&gt;" in page and "B</script>" not in page and "2.0K" in page


def test_serving_state_outlives_a_session(spark, tmp_path):
    held = records(spark, 7)
    assert sorted(r.position for r in ServingState(spark, str(tmp_path)).serve(held, 5).collect()) == [0, 1, 2, 3, 4]
    state = ServingState(spark, str(tmp_path))
    assert state.cursor == serve.Cursor(5)
    assert sorted(r.position for r in state.serve(held, 4).collect()) == [0, 1, 5, 6]
    state.reset()
    assert state.cursor == serve.Cursor(0)
    done = state.served().first()
    assert (done.served_count, done.served_token_count) == (9, 27)


def test_prompt_is_the_end_of_the_last_chunk(spark):
    t = ByteTokenizer()
    rows = frame(spark, [(1, "first"), (2, "\n".join("abcdefghij"))], "ordinal long, text string").withColumn("tokens", t.tokenize(F.col("text")))
    row = B.prompt(B.chunks(rows, 64, ("ordinal",)), t, block=36, room=32).first()
    assert row.text == "\n".join("efghij") and bytes(row.ids).decode() == "\n".join("ij")[-4:].rjust(4, "\n")


def test_masked_accuracy_reads_whole_texts(spark, tmp_path):
    from corpuswright.plans.metric_queries import masked_accuracy

    texts = ["", None, "a", "é日😀\n" * 3000, "x" * 33, "\0b" * 40, "words and more " * 20_000]
    frame(spark, list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: (r.counted, r.correct, r.accuracy) for r in masked_accuracy(spark, str(tmp_path)).collect()}
    wanted = {}
    for i, text in enumerate(texts):
        y = [(-100 if k % 5 == 0 else ord(c), 0 if k % 3 == 0 else ord(c)) for k, c in enumerate(text or "")]
        kept = [a == b for a, b in y if a != -100]
        if text:
            wanted[i] = (len(kept), sum(kept), round(sum(kept) / len(kept), 6) if kept else None)
    assert found == wanted and found[6][0] == 240_000


def test_first_arrivals_without_or_with_equal_ordinals(spark):
    rows = [(None, "x", 1), (None, "x", 2), (1, "y", 3), (1, "z", 4), (0, "z", 5), (2, "w", 6), (2, "w", 7), (None, "y", 8), (None, None, 9), (7, "", 10)]
    kept = dedup.first_arrivals(frame(spark, rows, "ordinal long, text string, __hash int"))
    assert kept.columns == ["ordinal", "text", "__hash"]
    assert sorted((r.ordinal if r.ordinal is not None else -1, r.text) for r in kept.collect()) == [(-1, "x"), (0, "z"), (1, "y"), (2, "w"), (7, "")]


def test_known_texts_are_found_either_way(spark):
    rows = dedup.hashed(frame(spark, [(1, "a"), (2, "b"), (3, None)], "ordinal long, text string"))
    held = dedup.hashed(frame(spark, [(8, "b"), (9, "b"), (9, "c")], "ordinal long, text string"))
    for most in (None, 3, dedup.BROADCAST_ROWS + 1):
        assert sorted(r.ordinal for r in dedup.against_store(rows, held, most).collect()) == [1, 3]


@pytest.mark.parametrize("ids", [[1, 10**15], [3, 70_000, 10**10 + 5, 2**40, 10**15, 4 * 10**18], [5]])
def test_random_draws_over_wide_gaps(spark, ids):
    rows = frame(spark, [(i,) for i in [*ids, None, -4]], "record_id long")
    found = serve.random_samples(rows, 400, seed=3).collect()
    assert sorted(r.slot for r in found) == list(range(400))
    assert all(1 <= r.drawn <= max(ids) and r.record_id == min(i for i in ids if i >= r.drawn) for r in found)
    assert len(ids) < 2 or max(r.drawn for r in found) > max(ids) // 2


def test_the_next_id_is_found_at_any_span(spark):
    r = random.Random(9)
    ids = sorted(r.sample(range(3000), 60))
    points = [(k, r.randrange(ids[-1] + 1)) for k in range(300)] + [(300 + k, i) for k, i in enumerate(ids)]
    for span in (64, 1 << 16):
        found = serve.at_or_after(frame(spark, points, "slot long, at long"), frame(spark, [(i,) for i in ids], "id long"), ids[-1], span).collect()
        assert {x.slot: x.id for x in found} == {k: min(i for i in ids if i >= p) for k, p in points}


def test_a_written_store_is_served_by_its_positions(spark, tmp_path):
    held = records(spark, 23)
    store.write(held, f"{tmp_path}/store", span=8)
    read = spark.read.parquet(f"{tmp_path}/store")
    assert [(r.ordinal, r.position, r.file_offset) for r in read.orderBy("position").collect()] == [(5 * i, i, 15 * i) for i in range(23)]
    for position, wanted in ((0, 5), (20, 6), (22, 23), (3, 60)):
        stored, ranked = (serve.next_samples(x, serve.Cursor(position), wanted, span=8) for x in (read, held))
        key = lambda df: sorted((r.slot, r.position, r.ordinal) for r in df.collect())
        assert key(stored[0]) == key(ranked[0]) and len(key(stored[0])) == wanted and stored[1] == ranked[1]
    plan = serve.next_samples(read, serve.Cursor(2), 3)[0]._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(position,2)" in plan and "Window" not in plan


def test_older_stores_open(spark, tmp_path):
    like = spark.createDataFrame([], "ordinal long, category string")
    assert store.opened(spark, f"{tmp_path}/none", like).count() == 0
    frame(spark, [(1,)], "ordinal long").write.parquet(f"{tmp_path}/old")
    assert store.opened(spark, f"{tmp_path}/old", like).first().category is None
    frame(spark, [("1",)], "ordinal string").write.parquet(f"{tmp_path}/other")
    with pytest.raises(ValueError, match="ordinal"):
        store.opened(spark, f"{tmp_path}/other", like)


def test_distilled_chats_as_structs_and_by_expressions(spark):
    parts = "array<struct<role:string,content:string,`from`:string,value:string>>"
    rows = [(([("user", "q", None, None), ("", "c", "human", None), (None, None, None, "v"), ("user", "", None, "w")],), "r"), ((None,), "r"), (None, "r"), (([],), "r"), (([("a", "b", None, None)],), "  ")]
    found = A.distilled_chat(frame(spark, rows, f"instruction struct<messages:{parts}>, response string")).collect()
    turn = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>"
    assert [(r.text, r.category) for r in found] == [("\n".join([turn("user", "q"), turn("human", "c"), turn("user", "w"), turn("assistant", "r")]), "instruction")]
    assert A.distilled_chat(frame(spark, [(1, "r")], "instruction int, response string")).count() == 0
    assert A.distilled_chat(frame(spark, [((1,), "r")], "instruction struct<a:int>, response string")).count() == 0
    assert A.distilled_chat(frame(spark, [("{}", 1)], "instruction string, response int")).count() == 0


def test_messages_by_expressions_equal_the_reader(spark):
    from corpuswright.functions import text as X

    rows = ['{"messages": [{"role": "u", "content": "c"}, {"role": "", "from": "f", "value": "v"}]}', '{"messages": [{"role": 5, "from": "f", "content": "c"}]}', '{"messages": [{"role": 0, "from": "f", "content": "c"}]}',
            '{"messages": [null, "x", {"role": "u", "content": null, "value": "w"}]}', '{"messages": {"role": "u"}}', '{"messages": []}', "[1]", "{", "", None, '{"messages": [{"role": "u", "content": NaN}]}', "{'messages': ({'role': 'u'},)}",
            "{'messages': [{'role': 'u', 'content': 'it\\'s'}]}", '{"a": 1}', '"messages"', '{"messages": [{"role": "u", "content": "1"}], "messages": []}', '{"messages": null}', '{"messages": [{"content": "c", "role": "r", "x": {"y": [1]}}]}']
    df = frame(spark, [(i, x) for i, x in enumerate(rows)], "i long, raw string")
    found = {r.i: r.m for r in df.select("i", X.tolerant_messages(F.col("raw")).alias("m")).collect()}
    for i, x in enumerate(rows):
        assert [(m.role, m.content) for m in found[i] or []] == [(m["role"], m["content"]) for m in X.read_messages(x) or []], x


def test_superseded_checkpoints_go(spark):
    names = ["step_big_5.pt", "step_big_40.pt", "step_big_300.pt", "step_900.pt", "notes.txt"]
    files = frame(spark, [(n,) for n in names], "name string")
    kept = lambda n: {r.name for r in metrics.keep_last_big(files, n).collect() if r.kept}
    assert kept(0) == kept(-1) == set(names) and kept(-3) == {"notes.txt"}
    assert kept(2) == {"step_big_40.pt", "step_big_300.pt", "notes.txt"} and kept(9) == set(names) - {"step_900.pt"}


def test_loss_over_the_fixed_set(spark):
    row = metrics.eval_loss(frame(spark, [([1, -100], [2.0, 50.0]), ([3, 4], [1.0, 3.0]), ([-100], [9.0]), ([], [])], "y array<int>, nll array<double>")).first()
    assert (row.tokens, row.eval_loss, row.eval_ppl) == (3, 2.0, pytest.approx(math.exp(2)))
    none = metrics.eval_loss(frame(spark, [([-100], [9.0])], "y array<int>, nll array<double>")).first()
    assert (none.tokens, none.eval_loss, none.eval_ppl) == (0, None, None)


def test_sample_block(spark):
    row = frame(spark, [(250, "a" * 79 + "日b\nc  ", "out")], "s long, p string, g string").select(B.sample_block(F.col("s"), F.col("p"), F.col("g")).alias("b")).first()
    assert row.b == ["===== step 250 | checkpoint sample =====", "-- prompt (last 6 lines) --", "a" * 79, "日b", "c", "-- generated (32 tokens) --", "out", "=" * 76]


def test_dense_orders_are_cut_finer(spark):
    df = spark.range(4000).select((F.col("id") + 10**9).alias("o"), F.lit(None).cast("string").alias("k"))
    span = ranks.fitting_span(df, "o", ("k",), 1 << 30, rows=100)
    assert 50 <= span <= 100
    assert ranks.fitting_span(df, "o", (), 64, rows=100) == 64
    assert ranks.fitting_span(df.select(F.lit(5).alias("o")), "o", (), 1 << 20, rows=100) == 1
    assert ranks.fitting_span(df.limit(0), "o") == ranks.RANGE
