"""Queries over the record store: deduplication, dictionary, tokens, codec, offsets, serving, statistics, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswright.functions import codec
from corpuswright.functions.tokenizers import WORDS, ByteTokenizer, SentencePieceTokenizer, WordTokenizer
from corpuswright.operators import batching as B
from corpuswright.operators import catalog, dedup, metrics, ranks, report, serve, stats, store
from corpuswright.operators.state import ServingState
from corpuswright.sources import adapters, token_log
from corpuswright.streaming import ingest as ingest_stream
from corpuswright.streaming.ingest import resume

from . import shared
from .registry import query, read

#: Sources that stand in for code categories; blocks small enough for many chunks.
CODE = ("src0", "src3", "src7", "src11")
BLOCK, FIM_BLOCK, SEED, WANTED, CURSOR = 64, 256, 7, 256, 100
VOCABULARY = ByteTokenizer.size


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("ordinal"), "text", F.col("source").alias("category"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    return store.ingest(_rows(spark, d), ByteTokenizer())


def _light(spark: SparkSession, d: str) -> DataFrame:
    """Records without tokens, for what counts them only: a text has a token for each byte and one more."""
    kept = dedup.first_arrivals(_rows(spark, d).select("ordinal", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("category", F.lit("")).alias("category")))
    coded = catalog.encoded(kept, catalog.dictionary(kept))
    return coded.select("ordinal", "category", "category_id", (F.octet_length("text") + 1).alias("token_count"))


def _digest(ids: Column) -> Column:
    return F.md5(F.array_join(ids.cast("array<string>"), ","))


_KEPT = """
    k AS (SELECT min(doc_id) AS ordinal FROM documents GROUP BY sha256(coalesce(text, ''))),
    r AS (SELECT d.doc_id AS ordinal, coalesce(text, '') AS text, coalesce(source, '') AS category FROM documents d JOIN k ON d.doc_id = k.ordinal),
    c AS (SELECT category, row_number() OVER (ORDER BY min(ordinal), category)::INT AS category_id FROM r GROUP BY category),
    q AS (SELECT ordinal, category, category_id, text, sha256(text) AS content_hash, (strlen(text) + 1)::INT AS token_count FROM r JOIN c USING (category))"""
_TOKENS = (
    _KEPT
    + r""",
    t AS (SELECT * EXCLUDE (text), list_append(CASE WHEN text = '' THEN []::INT[] ELSE
              [('0x' || x)::INT FOR x IN string_split(rtrim(regexp_replace(hex(text), '(..)', '\1,', 'g'), ','), ',')] END, 256) AS tokens FROM q)"""
)
_SERVED = (
    _KEPT
    + f""",
    n AS (SELECT *, row_number() OVER (ORDER BY ordinal) - 1 AS position, count(*) OVER () AS n FROM q),
    s AS (SELECT i.range AS slot, n.* FROM range({WANTED}) i JOIN n ON n.position = (i.range + {CURSOR}) % n.n),
    st AS (SELECT c.category_id, c.category, coalesce(a.n, 0)::BIGINT AS sample_count, coalesce(a.t, 0)::BIGINT AS token_count,
                  coalesce(b.n, 0)::BIGINT AS served_count, coalesce(b.t, 0)::BIGINT AS served_token_count
           FROM c LEFT JOIN (SELECT category_id, count(*) AS n, sum(token_count) AS t FROM q GROUP BY 1) a USING (category_id)
                  LEFT JOIN (SELECT category_id, count(*) AS n, sum(token_count) AS t FROM s GROUP BY 1) b USING (category_id))"""
)


@query("SELECT doc_id AS ordinal, sha256(coalesce(text, '')) AS content_hash FROM documents")
def content_hash(spark, d):
    return dedup.hashed(_rows(spark, d)).select("ordinal", "content_hash")


@query(f"WITH {_KEPT} SELECT ordinal, category, content_hash FROM q")
def dedup_exact(spark, d):
    return dedup.hashed(dedup.first_arrivals(_rows(spark, d))).select("ordinal", "category", "content_hash")


@query("""
    SELECT doc_id AS ordinal, sha256(coalesce(text, '')) AS content_hash FROM documents
    WHERE sha256(coalesce(text, '')) NOT IN (SELECT sha256(coalesce(text, '')) FROM documents JOIN labels USING (doc_id))""")
def dedup_against_store(spark, d):
    """Documents that no labelled document equals: those are the store."""
    rows = dedup.hashed(_rows(spark, d))
    held = rows.join(read(spark, d, "labels").select(F.col("doc_id").alias("ordinal")), "ordinal", "left_semi")
    return dedup.against_store(rows, held).select("ordinal", "content_hash")


@query(f"""
    WITH {_KEPT} SELECT d.doc_id AS ordinal, 257::BIGINT AS tokenizer_vocab_size, coalesce(q.token_count, 0)::BIGINT AS token_count, q.ordinal IS NULL AS duplicate
    FROM documents d LEFT JOIN q ON d.doc_id = q.ordinal""")
def ingest_response(spark, d):
    return dedup.ingest_response(_rows(spark, d), _light(spark, d), VOCABULARY)


@query(f"WITH {_KEPT} SELECT category, category_id FROM c")
def category_dictionary(spark, d):
    return catalog.dictionary(dedup.first_arrivals(_rows(spark, d)))


@query(f"WITH {_KEPT} SELECT string_agg(category || '=' || category_id, ',' ORDER BY category) AS category_index FROM c")
def category_index(spark, d):
    """The map, shown as text so that its order is fixed."""
    one = catalog.index(catalog.dictionary(dedup.first_arrivals(_rows(spark, d))))
    return one.select(F.array_join(F.transform(F.array_sort(F.map_entries("category_index")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("category_index"))


@query(f"WITH {_KEPT} SELECT category_id FROM c WHERE category IN {CODE}")
def code_category_ids(spark, d):
    return catalog.code_ids(catalog.dictionary(dedup.first_arrivals(_rows(spark, d))), CODE)


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')"


@query(rf"""
    WITH p AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, {_WORDS} AS l FROM documents)),
         v AS (SELECT w, row_number() OVER (ORDER BY count(*) DESC, w) + 1 AS id FROM p GROUP BY w QUALIFY id <= 5001),
         g AS (SELECT doc_id, string_agg(coalesce(id, 0)::VARCHAR, ',' ORDER BY i) AS ids, count(*) AS n FROM p LEFT JOIN v USING (w) GROUP BY doc_id)
    SELECT d.doc_id, (coalesce(n, 0) + 1)::INT AS token_count, md5(coalesce(ids || ',', '') || '1') AS tokens_md5 FROM documents d LEFT JOIN g USING (doc_id)""")
def tokenize_documents(spark, d):
    docs = read(spark, d, "documents")
    ids = docs.select("doc_id", WordTokenizer.fit(docs, 5000).tokenize(F.col("text")).alias("ids"))
    return ids.select("doc_id", F.size("ids").alias("token_count"), _digest(F.col("ids")).alias("tokens_md5"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents")
def detokenize(spark, d):
    t = ByteTokenizer()
    ids = read(spark, d, "documents").select("doc_id", t.tokenize(F.col("text")).alias("ids"))
    return ids.select("doc_id", F.md5(t.detokenize(F.col("ids"))).alias("text_md5"))


_RECORD = r"""
    x AS (SELECT ordinal, category_id, token_count, printf('%016X', 1 + 2 * token_count::BIGINT) AS h, regexp_replace(hex(text), '(..)', '\100', 'g') AS b FROM q),
    e AS (SELECT ordinal, category_id, token_count, 9 + 2 * token_count::BIGINT AS n_bytes,
                 h[15:16] || h[13:14] || h[11:12] || h[9:10] || h[7:8] || h[5:6] || h[3:4] || h[1:2] || printf('%02X', category_id) || b || '0001' AS record FROM x)"""


def _encoded(spark, d):
    return _records(spark, d).withColumn("record", codec.encode_record("category_id", "tokens"))


@query(f"WITH {_KEPT}, {_RECORD} SELECT ordinal, n_bytes, md5(record) AS record_md5 FROM e")
def encode_record(spark, d):
    return _encoded(spark, d).select("ordinal", F.octet_length("record").cast("long").alias("n_bytes"), F.md5(F.hex("record")).alias("record_md5"))


@query(f"WITH {_TOKENS} SELECT ordinal, category_id, token_count, md5(array_to_string(tokens, ',')) AS tokens_md5, NULL::VARCHAR AS error FROM t")
def decode_record(spark, d):
    found = _encoded(spark, d).select("ordinal", codec.decode_record("record").alias("r"))
    return found.select("ordinal", "r.category_id", "r.token_count", _digest(F.col("r.tokens")).alias("tokens_md5"), "r.error")


@query(f"WITH {_KEPT}, {_RECORD} SELECT ordinal, category_id, token_count, md5(base64(unhex(record))) AS base64_md5 FROM e")
def samples_base64_roundtrip(spark, d):
    sent = _encoded(spark, d).select("ordinal", codec.to_base64(F.col("record")).alias("b"))
    got = sent.select("ordinal", "b", codec.decode_record(F.unbase64("b")).alias("r"))
    return got.select("ordinal", "r.category_id", "r.token_count", F.md5("b").alias("base64_md5"))


@query(f"WITH {_KEPT} SELECT ordinal, category_id, token_count, (sum(9 + 2 * token_count::BIGINT) OVER (ORDER BY ordinal) - 9 - 2 * token_count)::BIGINT AS file_offset FROM q")
def record_offsets(spark, d):
    return store.with_offsets(_light(spark, d), span=4096).select("ordinal", "category_id", "token_count", "file_offset")


@query(f"""
    WITH {_TOKENS} SELECT 'log-' || (ordinal // 512) AS path, (sum(9 + 2 * token_count::BIGINT) OVER (PARTITION BY ordinal // 512 ORDER BY ordinal) - 9 - 2 * token_count)::BIGINT AS file_offset,
           category_id, token_count, md5(array_to_string(tokens, ',')) AS tokens_md5 FROM t""")
def scan_token_log(spark, d):
    parts = _encoded(spark, d).withColumn("segment", F.floor(F.col("ordinal") / 512).cast("long"))
    logs = token_log.log_segments(parts).select(F.concat(F.lit("log-"), F.col("segment").cast("string")).alias("path"), "body")
    return token_log.scan(logs).select("path", "file_offset", "category_id", "token_count", _digest(F.col("tokens")).alias("tokens_md5"))


@query(f"WITH {_KEPT} SELECT ordinal, category, category_id, content_hash, token_count FROM q")
def store_records(spark, d):
    return _records(spark, d).select("ordinal", "category", "category_id", "content_hash", "token_count")


def _served(spark, d):
    return serve.next_samples(_light(spark, d), serve.Cursor(CURSOR), WANTED, span=4096)[0]


@query(f"WITH {_SERVED} SELECT slot, position, ordinal, category_id, token_count FROM s")
def next_samples(spark, d):
    return _served(spark, d).select("slot", "position", "ordinal", "category_id", "token_count")


@query(f"""
    WITH {_KEPT}, n AS (SELECT *, row_number() OVER (ORDER BY ordinal) AS record_id, count(*) OVER () AS n FROM q),
         p AS (SELECT range AS slot, ('0x' || left(md5(range || ':{SEED}'), 8))::BIGINT AS u FROM range({WANTED}))
    SELECT slot, record_id, ordinal, category_id, token_count FROM p JOIN n ON n.record_id = 1 + u % n.n""")
def random_samples(spark, d):
    numbered = ranks.ranked(_light(spark, d), "ordinal", "_rank", span=4096).withColumn("record_id", F.col("_rank") + 1)
    return serve.random_samples(numbered, WANTED, SEED, span=4096).select("slot", "record_id", "ordinal", "category_id", "token_count")


@query(f"WITH {_SERVED} SELECT category, count(*) AS served_count, sum(token_count)::BIGINT AS served_token_count FROM s GROUP BY category")
def served_counts(spark, d):
    return serve.served_counts(_served(spark, d))


def _stats(spark, d):
    records = _light(spark, d)
    return stats.category_stats(catalog.dictionary(dedup.first_arrivals(_rows(spark, d))), records, _served(spark, d))


@query(f"WITH {_SERVED} SELECT * FROM st")
def category_stats(spark, d):
    return _stats(spark, d)


@query(f"""
    WITH {_SERVED} SELECT sum(sample_count)::BIGINT AS total_samples, sum(token_count)::BIGINT AS total_tokens, count(*) AS n_categories,
           sum(served_token_count)::BIGINT AS total_served_tokens, (9 * sum(sample_count) + 2 * sum(token_count))::BIGINT AS current_file_index FROM st""")
def total_stats(spark, d):
    return stats.totals(_stats(spark, d))


@query(f"WITH {_SERVED} SELECT * FROM st ORDER BY token_count DESC, category LIMIT 25")
def top_categories_stored(spark, d):
    return stats.top(_stats(spark, d), "token_count")


@query(f"WITH {_SERVED} SELECT * FROM st ORDER BY served_token_count DESC, category LIMIT 25")
def top_categories_served(spark, d):
    return stats.top(_stats(spark, d), "served_token_count")


@query(f"WITH {_SERVED} SELECT * FROM st WHERE lower(category) LIKE '%rc1%' ORDER BY lower(category)")
def stats_table_sorted(spark, d):
    return stats.listed(_stats(spark, d), "category", holding="RC1")


@query()
def stats_report(spark, d):
    """The page as one row."""
    found = _stats(spark, d)
    return spark.createDataFrame([(report.render(found, stats.totals(found)),)], "html string")


@query(f"""
    WITH {_KEPT.replace("coalesce(source, '') AS category", "CASE WHEN lang IN ('en', 'de') THEN lang ELSE 'OtherLanguage' END AS category")},
         w AS (SELECT category, category_id, len({_WORDS}) + 1 AS n FROM q)
    SELECT category_id, category, count(*) AS sample_count, sum(n)::BIGINT AS token_count FROM w GROUP BY 1, 2 ORDER BY token_count DESC, category""")
def ingest_pipeline(spark, d):
    """Documents to categories, first arrivals, words with an end mark, and counts by category."""
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("ordinal"), "text", adapters.bucket(F.col("lang"), ("en", "de")).alias("category"))
    kept = dedup.first_arrivals(rows)
    coded = catalog.encoded(kept, catalog.dictionary(kept)).withColumn("n", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORDS)) + 1)
    sums = coded.groupBy("category_id", "category").agg(F.count(F.lit(1)).alias("sample_count"), F.sum("n").cast("long").alias("token_count"))
    return sums.orderBy(F.desc("token_count"), "category")


@query("SELECT doc_id AS ordinal, source AS category FROM documents WHERE doc_id > 400")
def resume_skip(spark, d):
    """The rows that are left after a checkpoint at row 400."""
    return resume(_rows(spark, d).select("ordinal", "category"), 400)


def _chunk_sql(block: int) -> str:
    return f"""
    g AS (SELECT ordinal, category_id, k AS chunk, tokens[k * {block} + 1 : k * {block} + {block} + 1] AS ids
          FROM (SELECT *, unnest(range(greatest(1, ceil((len(tokens) - 1) / {block})::INT))) AS k FROM t)),
    h AS (SELECT ordinal, category_id, chunk::INT AS chunk, ids FROM g WHERE len(ids) >= 4)"""


@query(f"WITH {_TOKENS}, {_chunk_sql(BLOCK)} SELECT ordinal, category_id, chunk, len(ids)::INT AS n, md5(array_to_string(ids, ',')) AS ids_md5 FROM h")
def chunk_tokens(spark, d):
    return B.chunks(_records(spark, d), BLOCK).select("ordinal", "category_id", "chunk", F.size("ids").alias("n"), _digest(F.col("ids")).alias("ids_md5"))


@query(f"""
    WITH {_TOKENS}, {_chunk_sql(BLOCK)}, m AS (SELECT *, least(len(ids) - 1, {BLOCK}) AS n FROM h)
    SELECT ordinal, chunk, md5(array_to_string(ids[1:n] || [0 FOR i IN range({BLOCK} - n)], ',')) AS x_md5, md5(array_to_string(ids[2:n + 1] || [-100 FOR i IN range({BLOCK} - n)], ',')) AS y_md5 FROM m""")
def lm_batch(spark, d):
    return B.lm_pairs(B.chunks(_records(spark, d), BLOCK), BLOCK).select("ordinal", "chunk", _digest(F.col("x")).alias("x_md5"), _digest(F.col("y")).alias("y_md5"))


def _u(salt: str) -> str:
    return f"('0x' || left(md5(key || ':{salt}'), 8))::BIGINT"


_FIM = f"""
    f0 AS (SELECT *, ordinal || '-' || chunk AS key, ids[1:{FIM_BLOCK - 3}] AS p, least(len(ids), {FIM_BLOCK - 3}) AS l FROM h JOIN c USING (category_id)),
    f1 AS (SELECT *, l // 4 + {_u("pre")} % ((7 * l) // 10 - l // 4 + 1) AS pre FROM f0),
    f2 AS (SELECT *, least(l - pre - 4, l // 4) AS most FROM f1),
    f3 AS (SELECT *, category IN {CODE} AND {_u("fim")} / 4294967296.0 < 0.5 AND len(ids) >= 64 AND most >= 16 AS is_fim FROM f2),
    f4 AS (SELECT *, CASE WHEN is_fim THEN least(64, most) + {_u("mid")} % greatest(most - least(64, most) + 1, 1) END AS mid FROM f3),
    f5 AS (SELECT *, least(pre + mid, l - 4) AS fin FROM f4),
    f6 AS (SELECT ordinal, category_id, chunk, is_fim,
                  CASE WHEN is_fim THEN [257] || p[1:pre] || [258] || p[fin + 1:l] || [259] || p[pre + 1:fin] || [260] ELSE ids END AS ids,
                  CASE WHEN is_fim THEN (pre + l - fin + 2)::INT END AS mid_at FROM f5)"""


def _fim(spark, d):
    records = _records(spark, d)
    return B.fim_rows(B.chunks(records, FIM_BLOCK, ("ordinal", "category", "category_id")), VOCABULARY, F.col("category").isin(*CODE), FIM_BLOCK)


@query(f"WITH {_TOKENS}, {_chunk_sql(FIM_BLOCK)}, {_FIM} SELECT ordinal, chunk, is_fim, mid_at, len(ids)::INT AS n, md5(array_to_string(ids, ',')) AS ids_md5 FROM f6")
def fim_transform(spark, d):
    return _fim(spark, d).select("ordinal", "chunk", "is_fim", "mid_at", F.size("ids").alias("n"), _digest(F.col("ids")).alias("ids_md5"))


@query(f"""
    WITH {_TOKENS}, {_chunk_sql(FIM_BLOCK)}, {_FIM}, m AS (SELECT *, least(len(ids) - 1, {FIM_BLOCK}) AS n FROM f6)
    SELECT ordinal, category_id, chunk, is_fim, md5(array_to_string(ids[1:n] || [0 FOR i IN range({FIM_BLOCK} - n)], ',')) AS x_md5,
           md5(array_to_string([CASE WHEN is_fim AND i < mid_at THEN -100 ELSE ids[i + 2] END FOR i IN range(n)] || [-100 FOR i IN range({FIM_BLOCK} - n)], ',')) AS y_md5 FROM m""")
def fim_batch(spark, d):
    return B.fim_pairs(_fim(spark, d), FIM_BLOCK).select("ordinal", "category_id", "chunk", "is_fim", _digest(F.col("x")).alias("x_md5"), _digest(F.col("y")).alias("y_md5"))


@query(f"WITH {_TOKENS} SELECT ordinal, category_id, md5(array_to_string(tokens[1:{FIM_BLOCK}], ',')) AS ids_md5 FROM t WHERE len(tokens) >= 64 ORDER BY ordinal LIMIT 8")
def eval_set(spark, d):
    return B.eval_set(_records(spark, d), FIM_BLOCK).select("ordinal", "category_id", _digest(F.col("ids")).alias("ids_md5"))


@query(f"WITH {_TOKENS}, {_chunk_sql(BLOCK)} SELECT len(ids)::INT AS n, md5(array_to_string(ids, ',')) AS ids_md5 FROM h ORDER BY ordinal DESC, chunk DESC LIMIT 1")
def last_chunk(spark, d):
    return B.last_chunk(B.chunks(_records(spark, d), BLOCK)).select(F.size("ids").alias("n"), _digest(F.col("ids")).alias("ids_md5"))


@query(f"""
    WITH {_TOKENS}, e AS (SELECT tokens[1:{FIM_BLOCK}] AS ids FROM t WHERE len(tokens) >= 64 ORDER BY ordinal LIMIT 8),
         p AS (SELECT ids[i + 2] AS y FROM (SELECT ids, unnest(range(len(ids) - 1)) AS i FROM e))
    SELECT count(*) AS tokens, round(sum((y % 7) / 3.0) / count(*), 6) AS eval_loss, round(exp(least(sum((y % 7) / 3.0) / count(*), 20)), 4) AS eval_ppl FROM p""")
def eval_loss(spark, d):
    """Loss over the fixed set; a token's number stands for how unlikely a model finds it, and padding for anything."""
    rows = B.lm_pairs(B.eval_set(_records(spark, d), FIM_BLOCK), FIM_BLOCK).withColumn("nll", F.transform("y", lambda t: F.when(t < 0, 1e6).otherwise((t % 7) / 3.0)))
    return metrics.eval_loss(rows).select("tokens", F.round("eval_loss", 6).alias("eval_loss"), F.round("eval_ppl", 4).alias("eval_ppl"))


@query()
def prompt(spark, d):
    """The end of the last chunk, as text and ids."""
    return B.prompt(B.chunks(_records(spark, d), BLOCK), ByteTokenizer(), BLOCK)


@query(f"WITH {_SERVED} SELECT category, served_count, served_token_count FROM st WHERE served_count > 0 OR served_token_count > 0")
def served_maps(spark, d):
    return stats.served_maps(_stats(spark, d))


@query(f"""
    WITH {_KEPT}, {_RECORD}
    SELECT ordinal, CASE WHEN k IN (0, 5) THEN category_id END AS category_id, CASE WHEN k IN (0, 5) THEN token_count END AS token_count,
           CASE k WHEN 1 THEN 'no record' WHEN 2 THEN 'short header' WHEN 3 THEN 'truncated' WHEN 4 THEN 'bad size' END AS error
    FROM (SELECT *, ordinal % 6 AS k FROM e)""")
def damaged_records(spark, d):
    """Of six records one is whole, one missing, one cut in its header, one in its tokens, one of size 0, one has bytes after it."""
    k, record = F.col("ordinal") % 6, F.col("record")
    most = lambda n: F.substring(record, F.lit(1), n)
    bad = F.when(k == 0, record).when(k == 2, most(F.lit(8))).when(k == 3, most((F.octet_length(record) - 1).cast("int")))
    bad = bad.when(k == 4, F.concat(F.unhex(F.lit("00" * 8)), record)).when(k == 5, F.concat(record, F.unhex(F.lit("05FF"))))
    found = _encoded(spark, d).select("ordinal", codec.decode_record(bad).alias("r"))
    return found.select("ordinal", "r.category_id", "r.token_count", "r.error")


@query(f"""
    WITH {_KEPT} SELECT ordinal, category, category_id, content_hash, token_count, row_number() OVER (ORDER BY ordinal) - 1 AS position,
           (sum(9 + 2 * token_count::BIGINT) OVER (ORDER BY ordinal) - 9 - 2 * token_count)::BIGINT AS file_offset FROM q""")
def store_written(spark, d):
    """The store as it is read back from where it was written, in the shared folder."""
    path = f"{shared.folder(spark)}/store"
    store.write(_records(spark, d).drop("tokens"), path, span=4096)
    return spark.read.parquet(path)


@query(f"""
    WITH {_KEPT}, n AS (SELECT *, row_number() OVER (ORDER BY ordinal) - 1 AS position, count(*) OVER () AS n FROM q),
         s AS (SELECT n.* FROM (SELECT range AS slot FROM range(150) UNION ALL SELECT range FROM range(256)) i JOIN n ON n.position = i.slot % n.n)
    SELECT category, count(*) AS served_count, sum(token_count)::BIGINT AS served_token_count FROM s GROUP BY category""")
def serving_state(spark, d):
    """Counts after three steps of a served store: 100 records, 50 more, and, from the beginning again, the default number."""
    folder = shared.folder(spark)
    store.write(_light(spark, d), f"{folder}/store", span=4096)
    held, state = spark.read.parquet(f"{folder}/store"), ServingState(spark, f"{folder}/state")
    state.serve(held, 100)
    state.serve(held, 50)
    state.reset()
    state.serve(held)
    return state.served()


@query(f"WITH {_KEPT} SELECT ordinal, category, category_id, content_hash, token_count FROM q")
def stream_ingest(spark, d):
    """Documents as JSON files, ingested by a stream in two runs, the second after a restart with more files."""
    folder = shared.folder(spark)
    rows = _rows(spark, d)
    middle = rows.agg(F.expr("percentile_approx(ordinal, 0.5)")).first()[0] or 0
    for part in (F.col("ordinal") <= middle, F.col("ordinal") > middle):
        rows.where(part).write.mode("append").json(f"{folder}/in")
        ingest_stream.start(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", ByteTokenizer(), files_at_once=1 << 20).awaitTermination()
    return spark.read.parquet(f"{folder}/out/records").drop("tokens")


@query()
def tokenize_sentencepiece(spark, d):
    """Whole documents by a public SentencePiece model."""
    import public_tokenizers

    t = SentencePieceTokenizer(public_tokenizers.path("piece_bpe_32k.model"))
    ids = read(spark, d, "documents").select("doc_id", t.tokenize(F.col("text")).alias("ids"))
    return ids.select("doc_id", F.size("ids").alias("token_count"), _digest(F.col("ids")).alias("tokens_md5"))
