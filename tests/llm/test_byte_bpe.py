"""Encoding and decoding in one pass: the same rows as in two, by one Python worker for each task."""

import public_tokenizers

import corpus_pipeline
from echolith.llm import byte_bpe, queries

SF = "/root/testdata/sf0.001"


def most_workers(df) -> int:
    """How many Python workers a task of df holds at most: the longest chain of Python nodes without a shuffle between."""

    def most(node, above: int = 0) -> int:
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return most(node.initialPlan())
        here = 0 if "Exchange" in name else above + ("Arrow" in name or "Pandas" in name or "Python" in name)
        children = node.children()
        return max([here, *(most(children.apply(i), here) for i in range(children.size()))])

    return most(df._jdf.queryExecution().executedPlan())


def test_one_python_worker_for_each_task(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = public_tokenizers.path(corpus_pipeline.RANKS)
    assert most_workers(byte_bpe.decode(byte_bpe.encode(docs, path, public_tokenizers.PATTERN), path)) == 2, "else this test shows nothing"
    assert most_workers(corpus_pipeline.tokenise(spark, docs, SF)) == 1
    assert most_workers(queries.QUERIES["op10_byte_bpe"](spark, SF)) == 1


def test_round_trip_equals_encode_then_decode(spark):
    texts = [None, "", " ", "one  two\n\n three's ", "日本語 🙂 " * 40, "a" * 700, "word " * 300, "word " * 300]
    docs = spark.createDataFrame([(None if k == 3 else k // 2, t, "x") for k, t in enumerate(texts)], "doc_id int, text string, lang string")
    path, pattern = public_tokenizers.path(corpus_pipeline.RANKS), public_tokenizers.PATTERN
    rows = lambda df: sorted(((r.doc_id if r.doc_id is not None else -1), list(r.ids), bytes(r.bytes)) for r in df.collect())
    for chunk, overlap in ((64, 16), (byte_bpe.CHUNK, byte_bpe.OVERLAP)):
        got, want = byte_bpe.round_trip(docs, path, pattern, chunk, overlap), byte_bpe.decode(byte_bpe.encode(docs, path, pattern, chunk, overlap), path)
        assert got.dtypes == want.dtypes and rows(got) == rows(want)
        assert sorted(x[2] for x in rows(got)) == sorted((t or "").encode() for t in texts)
