"""Properties of the splitter, and hand-made cases."""

import hypothesis.strategies as st
from hypothesis import given, settings
from pyspark.sql import functions as F

from shelfmark.operators.chunking import LADDERS, chunk_docs, chunk_spans

ALPHABET = "ab 。，！；\n"


def cut(text, kind="pdf", size=20, overlap=5):
    return [text[a:b] for a, b in chunk_spans(text, LADDERS[kind], size, overlap)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=300), st.integers(5, 40), st.integers(0, 4))
def test_chunks_fit_overlap_and_lose_nothing(text, size, overlap):
    spans = list(chunk_spans(text, LADDERS["pdf"], size, overlap))
    assert all(0 < b - a <= size for a, b in spans)
    reached = 0
    for a, b in spans:
        assert a <= reached <= b and reached - a <= overlap
        reached = b
    assert reached == len(text)


def test_short_text_is_one_chunk():
    assert cut("short one") == ["short one"] and cut("") == []


def test_paragraphs_come_first():
    assert cut("aaaa aaaa\n\nbbbb bbbb\n\ncccc") == ["aaaa aaaa\n\nbbbb bbbb", "\n\ncccc"]


def test_long_piece_descends_the_ladder():
    assert cut("x" * 12 + "。" + "y" * 12 + "。z") == ["x" * 12, "。" + "y" * 12 + "。z"]


def test_no_separator_cuts_characters_with_overlap():
    assert cut("abcdefghijklmnopqrstuvwxyz") == ["abcdefghijklmnopqrst", "pqrstuvwxyz"]


def test_code_and_markdown_ladders():
    assert cut("import os\nclass A:\n    pass\ndef f(): 1", "py") == ["import os", "\nclass A:\n    pass", "\ndef f(): 1"]
    assert cut("intro text here\n# Head one\nbody words", "md") == ["intro text here", "\n# Head one", "\nbody words"]


def test_blank_documents_give_nothing(spark):
    df = spark.createDataFrame([(1, " \n "), (2, None), (3, "word " * 300)], "doc_id long, text string")
    rows = chunk_docs(df).collect()
    assert {r.doc_id for r in rows} == {3} and all(len(r.content) <= 500 for r in rows)
    assert sorted(r.chunk_no for r in rows) == list(range(len(rows)))


def test_table_function_gives_the_same_rows(spark, tables):
    from shelfmark.operators.chunking import chunk_docs, chunk_docs_lateral, register_chunker

    docs = tables["documents"].select("doc_id", "text", F.element_at(F.array(F.lit("pdf"), F.lit("md"), F.lit("py")), (F.col("doc_id") % 3 + 1).cast("int")).alias("kind"))
    docs = docs.union(spark.createDataFrame([(-1, None, "pdf"), (-2, " \n ", "pdf"), (-3, "x", None)], "doc_id long, text string, kind string"))
    want, got = (cut(docs, kind=F.col("kind")).select("doc_id", "chunk_no", "content").collect() for cut in (chunk_docs, chunk_docs_lateral))
    assert sorted(want) == sorted(got) and len(got) > 500
    register_chunker(spark, "cut_small", size=40, overlap=5)
    docs.createOrReplaceTempView("texts_to_cut")
    small = spark.sql("SELECT doc_id, c.* FROM texts_to_cut, LATERAL cut_small(text, 'txt') c WHERE doc_id = 3")
    assert small.count() > 1 and small.agg(F.max(F.length("content"))).first()[0] <= 40
    spark.catalog.dropTempView("texts_to_cut")
