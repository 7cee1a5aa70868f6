"""What the plans must look like, whatever the size of the input."""

import re
from pathlib import Path

import pytest

import spanmoor
from spanmoor.operators.align import align
from spanmoor.operators.text import chunks, sentences, tokens
from spanmoor.plans.run import extract


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "documents")
    spark.createDataFrame([(1, "One. Two.", "en", '{"extractions":[{"a":"One"}]}', "two")], "doc_id long, text string, lang string, raw string, ext_text string").write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("build", [tokens, sentences, chunks])
def test_text_operators_do_not_shuffle(docs, build):
    told = plan(build(docs.select("doc_id", "text")))
    assert "Exchange" not in told
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in told


def test_alignment_and_extraction_do_not_shuffle(docs):
    for df in (align(docs.select("doc_id", "text", "ext_text")), extract(docs.select("doc_id", "text", "raw"))):
        assert "Exchange" not in plan(df) and "lang" not in plan(df)


def test_filters_reach_the_scan(docs):
    told = plan(chunks(docs.select("doc_id", "text")).where("doc_id > 5"))
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThan(doc_id,5)]" in told


def test_windows_run_on_the_jvm(docs):
    told = plan(align(docs.select("doc_id", "text", "ext_text"), strategy="windows"))
    assert "fuzzy_by_counter" not in told


def test_a_source_comes_once_for_all_its_strings(docs):
    told = plan(extract(docs.select("doc_id", "text", "raw")))
    assert told.count("ArrowEvalPython [fuzzy_many") <= 1 and "fuzzy_by_counter" not in told
    below = told[told.index("Generate posexplode") :].splitlines()[0]
    assert "_source" not in below.split("[", 1)[-1]


def test_search_runs_once_a_row(docs):
    told = plan(align(docs.select("doc_id", "text", "ext_text")).where("status = 'exact'"))
    assert told.count("ArrowEvalPython [fuzzy_by_counter") <= 1


def test_nothing_else_imports_the_optional_part():
    root = Path(spanmoor.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"^\s*(?:from|import)\s.*\bllm\b", path.read_text(), re.M), path
