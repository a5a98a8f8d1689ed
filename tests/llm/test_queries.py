"""Registered queries on whole tables, against DuckDB or plain Python."""

import hashlib
import os
import struct
import zlib
from collections import Counter

import public_tokenizers as public
import pytest
import tiktoken
from compare import connect, difference, duckdb_rows, spark_rows
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from llm import test_decontaminate, test_near_dup, test_repetition
from offerlens.llm import bpe, html_text, oracle, queries

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")


@pytest.fixture(scope="module")
def tables():
    db = connect(SMALL)
    return {
        "documents": db.execute("SELECT doc_id, text FROM documents").fetchall(),
        "pages": db.execute("SELECT page_id, url, html FROM pages").fetchall(),
        "benchmark": db.execute("SELECT item_id, text FROM benchmark").fetchall(),
    }


def results(spark, name):
    return entry.queries()[name](spark, SMALL).collect()


def test_one_query_per_operator_and_the_pipeline():
    names = [name for name in entry.queries() if name.startswith("op") and name[2].isdigit()]
    assert sorted(int(name[2:].split("_")[0]) for name in names) == list(range(1, 14))
    assert set(names) == set(queries.QUERIES) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(oracle.STATEMENTS))
def test_query_equals_its_statement(spark, name):
    columns, rows = spark_rows(entry.queries()[name](spark, SMALL))
    expected_columns, expected = duckdb_rows(connect(SMALL), oracle.STATEMENTS[name])
    assert columns == expected_columns and rows
    assert difference(rows, expected) is None


def ids_of(library, text):
    found = library.encode_ordinary(text or "")
    return found, struct.pack(f"<{len(found)}I", *found)


@pytest.fixture(scope="module")
def library():
    ranks = bpe.read_ranks(public.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_pairs(spark, tables, library):
    expected = {}
    for i, text in tables["documents"]:
        found, packed = ids_of(library, text)
        expected[i] = (len(found), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in results(spark, "op4_byte_pairs")}
    assert got == expected


def test_token_budgets(spark, tables):
    words = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    expected = {}
    for i, text in tables["documents"]:
        n = len(words.encode(text or "", add_special_tokens=False).ids)
        expected[i] = (len((text or "").encode()), n, n > 2048)
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in results(spark, "op5_token_budgets")} == expected


def test_main_texts(spark, tables):
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in results(spark, "op6_main_text")}
    assert set(got) == {page[0] for page in tables["pages"]}
    for page_id, url, page in tables["pages"]:
        article = page[page.index("<article>") : page.rindex("</article>")]
        # every word of the article and no other word comes out
        assert got[page_id][1].split() == html_text.main_text(article + "</article>").split()
        assert (got[page_id][0], got[page_id][2]) == (url, len(got[page_id][1]))


def test_toxicity_columns_and_folds(spark, tables):
    got = results(spark, "op3_toxicity")
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in tables["documents"])
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_suffix_tree_beats_single_words(spark, tables):
    got = results(spark, "op8_suffix_tree")
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in tables["documents"])
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_pipeline_equals_its_plain_stages(spark, tables, library):
    """Each stage against a plain version on its own input; the classifier by the scores of its query."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = dict(tables["documents"])
    scores = {r.doc_id: r.predicted for r in results(spark, "op3_toxicity")}
    plain = {
        "toxicity": lambda rows: [i for i, _ in rows if not scores[i]],
        "quality": lambda rows: [i for i, t in rows if test_repetition.plain(t)[-1]],
        "near_duplicates": lambda rows: [i for i, _, _, kept in test_near_dup.plain(rows, 5, 80) if kept],
        "benchmark_leaks": lambda rows: [r[0] for r in test_decontaminate.plain(rows, tables["benchmark"]) if r[3]],
    }
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == [*plain, "token_ids"]
    ids = list(texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        own = docs.filter(docs["doc_id"].isin(ids))
        kept = stage(spark, own, SMALL)
        assert kept.schema == docs.schema
        expected = sorted(plain[name]([(i, texts[i]) for i in ids]))
        assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == expected
        assert len(expected) < len(ids) or name in ("toxicity", "benchmark_leaks")
        ids = expected
    rows = results(spark, "pipeline")
    assert sorted(r.doc_id for r in rows) == ids
    for r in rows:
        found, packed = ids_of(library, texts[r.doc_id])
        assert (r.n_tokens, bytes(r.ids), r.ids_sha256) == (len(found), packed, hashlib.sha256(packed).hexdigest())
