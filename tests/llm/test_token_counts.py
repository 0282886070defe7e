import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import queries, token_counts

PATH = queries.tokenizer_path()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


EDGES = [None, "", " ", "  ", "\n", "\n\n x", "a", " a", "a ", "a  b   c", "<s> </s> <unk> <0x0A>", "▁x ▁", "x▁y",
         "\t tab\x00nul　wide 😀 é", "word " * 3000, "x" * 5000, "\r\n\r\n a"]


def test_whole_table_equals_library(spark, library, docs_rows):
    got = {r.doc_id: r for r in queries.QUERIES["op1_token_counts"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs_rows)
    for i, text, _ in docs_rows:
        assert got[i].n_tokens == len(library.encode(text or "")), i
        assert got[i].n_bytes == len((text or "").encode())
        assert got[i].over_limit == (got[i].n_tokens > 4096)


def test_edges_and_repeated_rows(spark, library, make_docs):
    rows = [(None if k == 3 else k, t) for k, t in enumerate(EDGES)] + [(1, "again"), (1, "again")]
    df = make_docs(rows).withColumnRenamed("lang", "n_tokens").withColumnRenamed("source", "t")
    got = token_counts.count_documents(df, PATH).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), len((t or "").encode()), len(library.encode(t or ""))) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert token_counts.count_documents(df.limit(0), PATH).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n▁\tabcthe.é"), st.characters(codec="utf-8")), max_size=60))
def test_any_text_equals_library(text):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert token_counts.counter(PATH).count(text)[0] == len(library.encode(text))


def test_long_text_is_walked(library, monkeypatch):
    monkeypatch.setattr(token_counts, "LONG_TEXT", 10)
    monkeypatch.setattr(token_counts, "CACHE_PRETOKENS", 3)
    text = "some words\n in   a longer text, qzxj vvkq qzxj wwqk zzqq"
    assert token_counts.PieceCounter(PATH).count(text)[0] == len(library.encode(text))
