import pytest
from conftest import DATA
from oracle import check
from test_llm_dedup import A_TO_Z, brute_components

import corpus_pipeline
from corpuswright.llm import language_id as L
from corpuswright.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    check(spark, QUERIES[name], ORACLE[name], DATA / "sf0.001")


def test_pipeline_equals_brute_force(spark):
    """Rejected, equal and near-equal documents go, all others are packed whole."""
    folder = str(DATA / "sf0.001")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    judged = {r.doc_id for r in L.language_id(docs).where("NOT rejected").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in judged}
    first = {}
    for i in sorted(texts):
        first.setdefault((texts[i] or "").translate(A_TO_Z), i)
    parts, _ = brute_components([(i, texts[i]) for i in first.values()], 5)
    wanted = {i for i, c in parts.items() if i == c}
    found = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in found} == wanted
    assert sum(r.length for r in found) == sum({(r.doc_id, r.piece): r.length for r in found}.values())


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame([(i, f"these are some words of text number {i} " * 9, "en", "s", 3) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns, name


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, slot string, _row int, rep long, __mix_slot int"


def odd_documents():
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns with the operators' names."""
    words = lambda i: f"these are some quite usual words of the text number {i} and a few more of them "
    rows = [(i, words(i) * (i % 5 + 1), "en" if i % 2 else None, None if i % 7 == 0 else f"s{i % 3}", i) for i in range(60)]
    rows += [(100, None, "en", "s0", None), (101, "", "en", None, 0), (102, " \n", None, None, 0), (103, "12 !?", "en", "s1", 5), (None, None, None, None, None), (None, words(3) * 4, "en", "s1", 9), (None, words(999) * 3, "en", "s1", 1)]
    rows += [(104, words(104) * 20_000, "en", "s2", 1), (105, words(105) * 20_000 + "end", "en", "s2", 1), (5, words(5), "en", "s2", 5), (5, words(5), "en", "s2", 5), (106, words(5).upper(), "en", "s9", 5)]
    return [(*r, True, "x", 1, 2, 3) for r in rows]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_documents(spark, name):
    rows = odd_documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    found = dict(corpus_pipeline.STAGES)[name](spark, docs, "")
    if name == "packing":
        pieces = found.collect()
        assert {r.doc_id for r in pieces if r.piece == 0} == {r[0] for r in rows} and sum(r.piece == 0 for r in pieces) == len(rows)
        assert all(r.offset + r.length <= 1024 for r in pieces)
        return
    assert found.columns == docs.columns
    left = [tuple(r) for r in found.collect()]
    by = lambda xs: sorted(map(repr, xs))
    if name == "language_id":
        gone = [r for r in rows if not any(c.isalpha() for c in r[1] or "")]
        assert by(left) == by([r for r in rows if r not in gone]) and len(gone) == 5
    if name == "exact_dedup":
        best = {}
        for r in rows:
            key = (r[1] or "").translate(A_TO_Z)
            best[key] = min(best.get(key, (True, 0)), (r[0] is None, r[0] or 0))
        assert sorted((r[0] is None, r[0] or 0) for r in left) == sorted(best.values())
    if name == "near_dedup":
        parts, _ = brute_components([(r[0], r[1]) for r in {r[0]: r for r in rows if r[0] is not None}.values()], 5)
        assert by(left) == by([r for r in rows if r[0] is None or parts[r[0]] == r[0]])
    if name == "mixing":
        assert by(left) == by(rows)


def test_pipeline_of_empty_and_odd_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    spark.createDataFrame(odd_documents(), SCHEMA).write.parquet(f"{tmp_path}/odd/documents.parquet")
    found = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert {r.doc_id for r in found} and not {r.doc_id for r in found} & {100, 101, 102, 103, 106}
