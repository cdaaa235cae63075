import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuswright.functions import codec, draws
from corpuswright.functions import text as X
from corpuswright.functions.tokenizers import ByteTokenizer, SentencePieceTokenizer, WordTokenizer


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def results(df, c):
    return [r[0] for r in df.orderBy("i").select(c).collect()]


def test_numbers_are_abbreviated_as_in_c():
    known = {0: "0", 999: "999", 1000: "1.0K", 1150: "1.1K", 1250: "1.2K", 999950: "1000.0K", 1005000: "1.00M", 2675000000: "2.67B", None: None, -5: "-5"}
    assert {n: X.abbreviated(n) for n in known} == known


def test_format_and_parse(spark):
    df = column(spark, [5, 1250, 1005000, 3 * 10**9, None], "long")
    assert results(df, X.format_num("v")) == ["5", "1.2K", "1.00M", "3.00B", None]
    assert results(column(spark, ["1,234", "1.5K", "2M", "x", "", None]), X.parse_num(F.col("v"))) == [1234.0, 1500.0, 2e6, 0.0, 0.0, 0.0]


def model_parse(text):
    out = []
    for part in text.split("<|im_start|>"):
        if part := part.strip():
            role, _, content = part.replace("<|im_end|>", "").strip().partition("\n")
            out.append((role.strip(), content.strip()))
    return out


def test_chat_markup_parses_like_the_model(spark):
    texts = ["", "plain", "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n a \n b <|im_end|>", "<|im_start|>user<|im_end|>", "x<|im_start|>r\n<|im_end|>y<|im_end|>", "<|im_start|> \n<|im_end|>", "<|im_start|> r \n　c　<|im_end|>"]
    found = results(column(spark, texts), X.parse_chatml(F.col("v")))
    assert [[(m["role"], m["content"]) for m in f] for f in found] == [model_parse(t) for t in texts]


def test_null_shows_as_none_in_chat(spark):
    df = spark.range(1).select(X.chatml_of(("user", F.lit(None)), ("assistant", F.lit("a"))).alias("t"))
    assert df.first()[0] == "<|im_start|>user\nNone<|im_end|>\n<|im_start|>assistant\na<|im_end|>"


@pytest.mark.parametrize(
    ("raw", "wanted"),
    [
        ('{"messages": [{"role": "user", "content": "a"}]}', [("user", "a")]),
        ("{'messages': [{'from': 'human', 'value': 'a'}, None, {'role': '', 'from': 'x', 'content': 'b'}]}", [("human", "a"), ("x", "b")]),
        ('{"messages": [{"role": "user", "content": ""}, {"role": 3, "content": "x"}]}', []),
        ("[1, 2]", None),
        ("not a literal (", None),
        ("", None),
        (None, None),
        ('{"messages": {"role": "user"}}', None),
    ],
)
def test_tolerant_reading(raw, wanted):
    found = X.read_messages(raw)
    assert (None if found is None else [(m["role"], m["content"]) for m in found]) == wanted


def test_wrapping_counts_wide_characters():
    assert X.wrapped("abcd  \nef", 3) == ["abc", "d", "ef"]
    assert X.wrapped("日本語", 4) == ["日本", "語"]
    assert X.wrapped("", 4) == [""]
    assert X.width("aé日") == 4


def test_small_expressions(spark):
    assert results(column(spark, ["1\n2\n3\n4\n5\n6\n7", "a", "", None]), X.last_lines(F.col("v"))) == ["2\n3\n4\n5\n6\n7", "a", "", None]
    assert results(column(spark, ["step_250.pt", "x12y34", "none", None]), X.step_of(F.col("v"))) == [250, 12, None, None]
    assert results(column(spark, ["<a href=\"x\">'&amp;'"]), X.html_escape(F.col("v"))) == ["&lt;a href=&quot;x&quot;&gt;&#39;&amp;amp;&#39;"]
    assert results(column(spark, ["  \tx y　\n"]), X.strip(F.col("v"))) == ["x y"]


@given(st.lists(st.integers(0, 65535), max_size=50), st.integers(0, 255), st.binary(max_size=5))
def test_codec_round_trip(tokens, category, extra):
    found = codec.decoded(codec.encoded(category, tokens) + extra)
    assert (found["category_id"], found["tokens"], found["error"]) == (category, tokens, None)


def test_damaged_records():
    good = codec.encoded(7, [1, 2, 3])
    assert codec.decoded(good[:8])["error"] == "short header"
    assert codec.decoded(good[:-1])["error"] == "truncated"
    assert codec.decoded(b"\0" * 9)["error"] == "bad size"
    assert codec.decoded((5 << 20).to_bytes(8, "little") + b"x" * 10)["error"] == "bad size"
    assert codec.decoded(None)["error"] == "no record"
    with pytest.raises(ValueError):
        codec.encoded(1, [70000])
    with pytest.raises(ValueError):
        codec.encoded(1, range(3 << 20))


def test_codec_columns(spark):
    df = spark.createDataFrame([(0, 3, [1, 65535]), (1, 4, []), (2, 5, None)], "i int, c int, t array<int>")
    assert results(df, codec.encode_record("c", "t")) == [bytearray(codec.encoded(3, [1, 65535])), bytearray(codec.encoded(4, [])), None]
    body = "x" * 300
    assert results(column(spark, [body]), codec.to_base64(F.col("v").cast("binary")))[0].count("\n") == 0


def test_draws_are_in_range_and_repeat(spark):
    df = spark.range(2000).withColumn("i", F.col("id").cast("int"))
    u = results(df, draws.uniform(F.col("id"), "a"))
    assert all(0 <= x < 1 for x in u) and abs(sum(u) / len(u) - 0.5) < 0.03
    assert set(results(df, draws.randint(F.col("id"), "b", F.lit(3), F.lit(5)))) == {3, 4, 5}
    assert u == results(df.repartition(7), draws.uniform(F.col("id"), "a"))


def test_byte_tokens_round_trip(spark):
    texts = ["", "abc", "é日😀", None, "x" * 100_000]
    t = ByteTokenizer()
    ids = results(column(spark, texts), t.tokenize(F.col("v")))
    assert ids == [[*(x or "").encode(), 256] for x in texts]
    back = results(column(spark, texts).select("i", t.tokenize(F.col("v")).alias("ids")), t.detokenize(F.col("ids")))
    assert back == [x or "" for x in texts]


def test_word_tokens(spark):
    t = WordTokenizer.fit(column(spark, ["b a, a", "a b c"]).withColumnRenamed("v", "text"), 3)
    assert t.words == ["a", "b", ","]
    assert results(column(spark, ["a z, b", "", None]), t.tokenize(F.col("v"))) == [[2, 0, 4, 3, 1], [1], [1]]
    with pytest.raises(ValueError):
        WordTokenizer(["x"] * 70_000)


def test_sentencepiece_round_trip(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    t = SentencePieceTokenizer(tokenizers.path("piece_bpe_32k.model"))
    df = column(spark, ["Hello there.", ""]).select("i", "v", t.tokenize(F.col("v")).alias("ids"))
    assert t.size == 32000
    assert all(x[-1] == 2 for x in results(df, F.col("ids")))
    assert results(df, t.detokenize(F.col("ids"))) == ["Hello there.", ""]
