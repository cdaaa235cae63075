"""Queries over the source adapters and string functions; test tables stand in for the sources' shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuswright.functions import text as X
from corpuswright.operators.interleave import round_robin
from corpuswright.sources import adapters as A

from .registry import query, read

ALLOWED, KNOWN = "en, fr", ("en", "de")


def _talks(spark: SparkSession, d: str) -> DataFrame:
    """conv_id and conversations: each conversation's turns in order."""
    turns = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("t"))
    return turns.select("conv_id", F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("conversations"))


def _exchanges(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, turn, ask, reply: each user turn that an assistant turn follows."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = read(spark, d, "conversations").withColumns({"next": F.lead("role").over(w), "reply": F.lead("text").over(w)})
    return rows.where("role = 'user' AND next = 'assistant'").select("conv_id", "turn", F.col("text").alias("ask"), "reply")


_EXCHANGES = """
    e AS (SELECT conv_id, turn, text AS ask, reply FROM (
            SELECT *, lead(role) OVER w AS nx, lead(text) OVER w AS reply FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
          WHERE role = 'user' AND nx = 'assistant')"""


def _chat(ask: str, reply: str) -> str:
    return f"'<|im_start|>user' || chr(10) || {ask} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || {reply} || '<|im_end|>'"


@query("""
    SELECT doc_id, text, CASE WHEN lang IN ('en', 'de') THEN lang ELSE 'OtherLanguage' END AS category
    FROM documents WHERE lower(lang) IN ('en', 'fr')""")
def src_code_files(spark, d):
    """Documents as the files of one-file repositories; a repository's list is never gathered from rows."""
    files = read(spark, d, "documents").select("doc_id", F.array(F.struct(F.col("lang").alias("language"), F.col("text").alias("content"))).alias("files"))
    return A.code_files(files, ALLOWED, KNOWN, keep=["doc_id"]).drop("pos")


@query("SELECT doc_id, text, 'reasoning' AS category FROM documents")
def src_reasoning(spark, d):
    return A.reasoning(read(spark, d, "documents").select("doc_id", F.col("text").alias("ChatML")), keep=["doc_id"])


@query("SELECT doc_id, text, 'instruction_code' AS category FROM documents")
def src_code_instruction(spark, d):
    return A.code_instruction(read(spark, d, "documents"), keep=["doc_id"])


@query(f"WITH {_EXCHANGES} SELECT conv_id, turn, 'Problem: ' || ask || chr(10) || 'Solution: ' || reply AS text, 'math' AS category FROM e")
def src_math(spark, d):
    return A.math(_exchanges(spark, d).withColumnsRenamed({"ask": "problem", "reply": "generated_solution"}), keep=["conv_id", "turn"])


@query("""
    WITH l AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
    SELECT c.conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>', chr(10) ORDER BY turn) AS text, 'instruction' AS category
    FROM conversations c JOIN l ON c.conv_id = l.conv_id AND c.turn <= l.last GROUP BY c.conv_id HAVING count(*) > 1""")
def src_distill_chat(spark, d):
    """What comes before a conversation's last answer, as JSON, and that answer."""
    talks = _talks(spark, d)
    n = F.size("conversations") - F.array_position(F.reverse(F.transform("conversations", lambda m: m["role"])), "assistant").cast("int") + 1
    rows = talks.where(F.exists("conversations", lambda m: m["role"] == "assistant")).withColumn("_n", n)
    raw = rows.select("conv_id", F.to_json(F.struct(F.slice("conversations", F.lit(1), F.col("_n") - 1).alias("messages"))).alias("instruction"), F.get("conversations", F.col("_n") - 1)["content"].alias("response"))
    return A.distilled_chat(raw, keep=["conv_id"])


@query("SELECT d.doc_id, text, 'web' AS category FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality::DOUBLE >= 0.75")
def src_web(spark, d):
    scored = read(spark, d, "documents").join(read(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("language_score")), "doc_id")
    return A.web(scored, keep=["doc_id"])


@query(f"WITH {_EXCHANGES} SELECT conv_id, turn, {_chat('ask', 'reply')} AS text, 'sql_instruction_code' AS category FROM e")
def src_code_feedback(spark, d):
    return A.code_feedback(_exchanges(spark, d).withColumnsRenamed({"ask": "query", "reply": "answer"}).withColumn("lang", F.lit("sql")), keep=["conv_id", "turn"])


@query("""
    SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>', chr(10) ORDER BY turn) AS text, 'instruction_code_alpaca' AS category
    FROM conversations GROUP BY conv_id""")
def src_conversations(spark, d):
    return A.conversations(_talks(spark, d), keep=["conv_id"])


@query(f"WITH {_EXCHANGES} SELECT conv_id, turn, {_chat('ask', 'reply')} AS text, 'go_instruction_code' AS category FROM e")
def src_codegen(spark, d):
    return A.code_generation(_exchanges(spark, d).withColumnsRenamed({"ask": "problem", "reply": "output"}).withColumn("language", F.lit("go")), keep=["conv_id", "turn"])


@query(f"WITH {_EXCHANGES} SELECT conv_id, turn, {_chat('ask', 'reply')} AS text, 'None_instruction_code' AS category FROM e")
def src_tiny_codes(spark, d):
    return A.tiny_codes(_exchanges(spark, d).withColumnsRenamed({"ask": "prompt", "reply": "response"}).withColumn("programming_language", F.lit(None).cast("string")), keep=["conv_id", "turn"])


@query("""
    SELECT d.doc_id, '<|im_start|>user' || chr(10) || 'Fix the following ' || lang || ' code:' || chr(10) || text || chr(10) || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) ||
           CASE WHEN toxic = 1 THEN 'Fixed code:' || chr(10) || '# ' || text ELSE 'The following ' || lang || ' code is not vulnerable' END || '<|im_end|>' AS text,
           lang || '_instruction_code' AS category
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def src_code_security(spark, d):
    labels = read(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("is_vulnerable"))
    rows = read(spark, d, "documents").join(labels, "doc_id")
    return A.code_security(rows.select("doc_id", F.col("lang").alias("language"), F.col("text").alias("code"), "is_vulnerable", F.concat(F.lit("# "), "text").alias("code_fixed")), keep=["doc_id"])


@query("""
    WITH s AS (SELECT 0 AS source_idx, d.doc_id AS ordinal, 'web' AS category FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality >= 1
               UNION ALL SELECT 1, doc_id, 'reasoning' FROM documents
               UNION ALL SELECT 2, conv_id, 'instruction_code_alpaca' FROM (SELECT DISTINCT conv_id FROM conversations)),
         r AS (SELECT *, row_number() OVER (PARTITION BY source_idx ORDER BY ordinal) - 1 AS rn FROM s)
    SELECT source_idx, ordinal, category, rn, row_number() OVER (ORDER BY rn, source_idx) - 1 AS position FROM r""")
def interleave_sources(spark, d):
    docs = read(spark, d, "documents")
    scored = docs.join(read(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("language_score")), "doc_id")
    found = [A.web(scored, keep=["doc_id"]), A.reasoning(docs.select("doc_id", F.col("text").alias("ChatML")), keep=["doc_id"]), A.conversations(_talks(spark, d).withColumnRenamed("conv_id", "doc_id"), keep=["doc_id"])]
    return round_robin([f.select(F.col("doc_id").alias("ordinal"), "category") for f in found])


@query("""
    SELECT conv_id, md5(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>', chr(10) ORDER BY turn)) AS chatml_md5, count(*) AS turns
    FROM conversations GROUP BY conv_id""")
def chatml_render(spark, d):
    return _talks(spark, d).select("conv_id", F.md5(X.chatml(F.col("conversations"))).alias("chatml_md5"), F.size("conversations").cast("long").alias("turns"))


@query(r"""
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, regexp_replace(role, '^\s+|\s+$', '', 'g') AS role, regexp_replace(text, '^\s+|\s+$', '', 'g') AS content
    FROM conversations""")
def chatml_parse(spark, d):
    parsed = _talks(spark, d).select("conv_id", F.posexplode(X.parse_chatml(X.chatml(F.col("conversations")))).alias("pos", "m"))
    return parsed.select("conv_id", F.col("pos").cast("long").alias("pos"), F.col("m.role").alias("role"), F.col("m.content").alias("content"))


_N = "(l_orderkey * 7919 * l_linenumber)::BIGINT"
_SHORT = f"""CASE WHEN {_N} >= 1000000000 THEN printf('%.2f', {_N} / 1e9) || 'B' WHEN {_N} >= 1000000 THEN printf('%.2f', {_N} / 1e6) || 'M'
             WHEN {_N} >= 1000 THEN printf('%.1f', {_N} / 1e3) || 'K' ELSE {_N}::VARCHAR END"""


def _numbers(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 7919 * F.col("l_linenumber")).alias("n"))


@query(f"SELECT l_orderkey, l_linenumber, {_SHORT} AS short FROM lineitem")
def format_num(spark, d):
    return _numbers(spark, d).select("l_orderkey", "l_linenumber", X.format_num("n").alias("short"))


@query(f"""
    SELECT l_orderkey, l_linenumber, round(CASE right(s, 1) WHEN 'B' THEN 1e9 WHEN 'M' THEN 1e6 WHEN 'K' THEN 1e3 ELSE 1 END * rtrim(s, 'BMK')::DOUBLE, 2) AS value
    FROM (SELECT l_orderkey, l_linenumber, {_SHORT} AS s FROM lineitem)""")
def parse_num(spark, d):
    return _numbers(spark, d).select("l_orderkey", "l_linenumber", F.round(X.parse_num(X.format_num("n")), 2).alias("value"))


@query("""
    SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped_md5 FROM pages""")
def html_escape(spark, d):
    return read(spark, d, "pages").select("page_id", F.md5(X.html_escape(F.col("html"))).alias("escaped_md5"))


@query()
def wrap_text(spark, d):
    """Lines of at most 80 columns; tested against a model, as SQL has no table of character widths."""
    lines = read(spark, d, "documents").select("doc_id", X.wrap_text("text").alias("lines"))
    return lines.select("doc_id", F.size("lines").alias("n_lines"), F.md5(F.array_join("lines", "\n")).alias("wrapped_md5"))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[-6:], chr(10)) AS tail FROM documents")
def last_lines(spark, d):
    return read(spark, d, "documents").select("doc_id", X.last_lines(F.col("text")).alias("tail"))


@query("SELECT n_nationkey, ('step_' || (n_nationkey * 250) || '.pt') AS name, (n_nationkey * 250)::BIGINT AS step FROM nation")
def step_from_name(spark, d):
    names = read(spark, d, "nation").select("n_nationkey", F.concat(F.lit("step_"), (F.col("n_nationkey") * 250).cast("string"), F.lit(".pt")).alias("name"))
    return names.withColumn("step", X.step_of(F.col("name")))
