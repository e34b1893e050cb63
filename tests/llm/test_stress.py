"""Odd inputs: very long texts, nulls everywhere, clashing column names."""

import random
import time

import pytest
from pyspark.sql import functions as F

from trellis.llm import align, bpe, funcdoc, fuzzy, history, leak, markup, neighbours, residue

LONG = {
    "one line": "word and more words of the text " * 12_000,
    "one word": "a" * 300_000,
    "signs": "*a _b `c [d](e '' == -- <f {{g $h \\i( " * 6_000,
    "lines": "= x\n- y\n# z\n> q\n|a|\n" * 12_000,
    "spaces": " " * 300_000 + "x",
    "quotes": "\"'\"\"\"''' " * 20_000,
    "marks": "​­﻿" * 60_000,
}


@pytest.mark.parametrize("name", LONG)
def test_long_texts_end(name):
    text = LONG[name]
    began = time.time()
    markup.strip_markup(text)
    residue.read_document(text)
    align.words_of(text)
    funcdoc.read_function("def f(a):\n    " + text[:60_000], None)
    funcdoc.read_function(text, text)
    funcdoc.says_something(text, "f")
    assert time.time() - began < 30


def test_long_piece_is_encoded_in_n_log_n():
    public = pytest.importorskip("public_tokenizers")
    e = bpe.Encoder(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    began = time.time()
    assert len(e.encode("ab" * 50_000)) < 100_000
    assert time.time() - began < 20


def test_clashing_columns_and_nulls(spark):
    rnd = random.Random(1)
    names = ("rec_table", "id", "class_id", "norm", "digest", "key", "keys", "f0", "ma", "salt", "words", "r", "block", "cid", "vec", "perm", "p", "size", "lines", "slot", "filler", "doc", "k", "n")
    text = " ".join(rnd.choice("alpha beta gamma delta node edge".split()) for _ in range(30))

    def wide(df):
        return df.select("*", *[F.lit(1).alias(c) for c in names if c not in df.columns])

    recs = wide(spark.createDataFrame([("t", 1, text), ("t", 2, text + " x"), (None, None, None), ("t", None, text), ("t", 3, None)], "rec_table string, id bigint, text string"))
    assert [tuple(r) for r in fuzzy.alike_pairs(recs).collect()] == [("t", 1, 2)]
    chunks = wide(spark.createDataFrame([(0, 1, text), (1, 2, text + " x"), (None, None, None), (1, None, text)], "batch_no int, chunk_id bigint, text string"))
    store = history.new_store(spark)
    history.begin(store, chunks.filter("batch_no = 0"))
    assert [tuple(r) for r in history.dedup_batches(store, chunks.filter("batch_no > 0")).collect()] == [(1, 2)]
    docs = wide(spark.createDataFrame([(1, "Please enable JavaScript to view this page."), (None, None), (2, None), (3, LONG["one word"])], "doc_id bigint, text string"))
    assert [r["doc_id"] for r in residue.residue(docs).collect()] == [1]
    qa = wide(spark.createDataFrame([(None, None, None, None), (1, "q", None, text)], "qa_id int, question string, answer string, source_text string"))
    assert [r["doc_id"] for r in leak.leaks(wide(spark.createDataFrame([(9, "so " + text), (None, text), (8, None)], "doc_id bigint, text string")), qa).collect()] == [9]
    rows = wide(spark.createDataFrame([("f", 1, "# a"), (None, None, None)], "rec_table string, rec_seq bigint, content string"))
    assert [r["markups"] for r in markup.clean_documents(rows).collect()] == [["markdown"]]
    t = wide(spark.createDataFrame([(None, None, None, None, None, None), (1, "i", "function", None, "def f():\n    # one two three four five six\n    pass", None)], "node_seq bigint, id string, kind string, label string, content string, metadata string").withColumn("seq", F.lit(1)))
    n = wide(spark.createDataFrame([(None, None, None)], "id string, kind string, seq bigint"))
    assert [r["node_seq"] for r in funcdoc.function_docs(t, n).collect()] == [1]
    v = wide(spark.createDataFrame([("a", [1.0] * 64, 1), ("b", [1.0] * 63 + [0.9], None), (None, None, None)], "node_id string, vec array<double>, append_seq bigint"))
    assert neighbours.nearest(neighbours.valid_vectors(v), 5, 0.8).count() == 2
