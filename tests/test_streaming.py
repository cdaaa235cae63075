import json

from corpuswright.functions.tokenizers import ByteTokenizer
from corpuswright.operators import store
from corpuswright.streaming import ingest
from corpuswright.streaming.progress import Throughput


def put(folder, name, rows):
    (folder / name).write_text("".join(json.dumps(dict(zip(("ordinal", "text", "category"), r, strict=True))) + "\n" for r in rows))


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    rows = [(i, f"text {i % 7}", f"cat {i % 3}") for i in range(20)]
    put(source, "0.json", rows[:8])

    def run():
        ingest.start(spark, str(source), target, checkpoint, ByteTokenizer(), files_at_once=1).awaitTermination()
        return sorted((r.ordinal, r.category_id, r.token_count) for r in spark.read.parquet(f"{target}/records").collect())

    first = run()
    assert [r[0] for r in first] == list(range(7))
    assert run() == first
    put(source, "1.json", [*rows[8:], (20, "new", "cat 9"), (21, None, None)])
    df = spark.createDataFrame([*rows, (20, "new", "cat 9"), (21, "", "")], "ordinal long, text string, category string")
    batch = sorted((r.ordinal, r.category_id, r.token_count) for r in store.ingest(df, ByteTokenizer()).collect())
    assert run() == batch
    assert sorted(r.ordinal for r in ingest.resume(df, 18).collect()) == [19, 20, 21]


def test_throughput_over_the_last_batches():
    seen = Throughput(window=2)
    assert seen.rate("q") == 0
    for rows, seconds in ((1000, 1.0), (10, 1.0), (30, 3.0)):
        seen.add("q", rows, seconds)
    assert seen.rate("q") == 10 and seen.rows["q"] == 1040
