"""Registered queries against their check SQL or brute force on the smallest tables, and the pipeline's stages."""

import os
import re
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402
from codequarry.llm import registry, sentencepiece_fst  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("benchmark", "documents", "embeddings", "labels", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_check(spark, con, name):
    df = registry.QUERIES[name](spark, DATA)
    result = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, result.fetchall()))


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 14))


def test_encoding_equals_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.MODEL)
    texts = ["", " ", "  two  spaces ", "▁ mark", "漢字 \U0001f600 é", "a" * 400, "\n\t\x00", "the quick brown fox", "x" * 70000 + " end", "aaa aaaa    b"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, None, None), (3, "▁ mark", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids string").repartition(3)
    out = sentencepiece_fst.encode(docs, check=True)
    for r in out.collect():
        if r["doc_id"] is None:
            assert r["token_ids"] is None
        else:
            assert r["token_ids"] == library.encode(texts[r["doc_id"]]) and r["round_trip"]
    back = {r["doc_id"]: r["text"] for r in sentencepiece_fst.decode(out).collect()}
    assert back == {None: None, **{i: t.replace("▁", " ") for i, t in enumerate(texts)}}
    codec = sentencepiece_fst.Codec(sentencepiece_fst.load())
    strange = [[3 + 0xC3], [3 + 0xE6, 3 + 0xBC, 300], [0, 1, 2, 400], []]
    assert [codec.decode(x) for x in strange] == [library.decode(x) for x in strange]
    assert sentencepiece_fst.encode(docs.limit(0)).count() == 0


def test_all_texts_encode_like_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.MODEL)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in registry.QUERIES["op2_sentencepiece"](spark, DATA).collect():
        assert r["token_ids"] == library.encode(text[r["doc_id"]]) and r["round_trip"]


def test_unigram_models_take_the_least_path():
    tables = {"kind": sentencepiece_fst.UNIGRAM, "prefix": True, "unknown": 0, "never": frozenset()}
    tables["pieces"] = [("<unk>", 0.0, 2), ("▁a", -3.0, 1), ("b", -2.0, 1), ("▁ab", -4.0, 1), ("c", -2.0, 1), ("bc", -2.5, 1), ("▁", -5.0, 1)]
    codec = sentencepiece_fst.Codec(tables)
    ids, begin = codec.encode(["abc", "ab", "a?"])
    assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:], strict=False)] == [[1, 5], [3], [1, 0]]


def test_page_query_on_the_table(spark):
    rows = registry.QUERIES["op5_html_text"](spark, DATA).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in rows:
        first, last = pages[r["page_id"]].index("<article>"), pages[r["page_id"]].find("</article>")
        article = pages[r["page_id"]][first : last if last > 0 else None]
        words = re.sub(r"<[^>]*(>|$)", " ", article).replace("&amp;", "&").replace("&quot;", '"').split()
        assert r["text"].split() == words


def test_stages_keep_columns_and_pipeline_runs(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    first, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "MinHash near-dedup", "mixing", "SentencePiece"]
    result = corpus_pipeline.run(spark, DATA)
    assert {"doc_id", "token_ids"} <= set(result.columns)
    assert 0 < result.count() <= 2 * first


def test_arcs_are_read_from_the_tree(spark):
    """What can be read at a position equals brute force, and a place in the tree holds it ready (no new list per position)."""
    codec = sentencepiece_fst.Codec(sentencepiece_fst.load())
    never = sentencepiece_fst.load()["never"]
    for text in ("▁information", "▁the", "a", "xqz", "é日本▁", "\x00ab", "internationalisation"):
        for at in range(len(text)):
            ends = range(len(text), at, -1)
            want = [text[at:e] for e in ends if e == at + 1 or codec.number.get(text[at:e], -1) not in never | {-1}]
            assert list(codec.arcs(text, at)) == want
    assert codec.arcs("▁information", 0) is codec.arcs("▁information", 0)
