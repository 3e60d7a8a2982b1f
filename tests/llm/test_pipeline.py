"""The pipeline stage by stage against the operators' own decisions, and the registered queries against their SQL."""

import zlib

import numpy as np
import pytest
from compare import connect, differences

import corpus_pipeline
from oddsmith.llm import decontaminate, minhash, mixing, quality, queries
from oddsmith.llm.store import stored

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql(spark, name):
    got = queries.queries()[name](spark, FOLDER).toPandas()
    assert differences(got, connect(FOLDER).execute(queries.oracle_sql()[name]).df()) is None


def test_stages_follow_the_operators(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_copies", "benchmark", "mix", "tokens"]
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    labels, bench = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("labels", "benchmark"))

    one = stored(stages["quality"](spark, docs, FOLDER), "test")
    assert one.columns == docs.columns and ids(one) == ids(quality.classify(docs, labels).where("predicted = 1"))
    two = stored(stages["near_copies"](spark, one, FOLDER), "test")
    assert two.columns == docs.columns and ids(two) == ids(minhash.near_duplicates(one).where("kept"))
    three = stored(stages["benchmark"](spark, two, FOLDER), "test")
    leaked = {r[0] for r in decontaminate.contaminations(two, bench).select("doc_id").collect()}
    assert three.columns == docs.columns and ids(three) == [i for i in ids(two) if i not in leaked]
    four = stored(stages["mix"](spark, three, FOLDER), "test")
    repeats = {r["doc_id"]: r["repeats"] for r in mixing.mix(three).collect()}
    assert four.columns == docs.columns and ids(four) == sorted(i for i, n in repeats.items() for _ in range(n))
    five = stages["tokens"](spark, four, FOLDER).collect()

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    want = []
    for r in sorted(four.collect(), key=lambda r: r["doc_id"]):
        encoded = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 2]
        want.append((r["doc_id"], len(encoded), zlib.crc32(np.array(encoded, "<u4").tobytes())))
    assert [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in sorted(five, key=lambda r: r["start"])] == want


def test_pipeline_of_edge_rows(spark):
    """Nulls, empty and repeated rows and further columns with clashing names go through every stage; an empty table too."""
    rows = [(1, None, "en", "a", 0, "s"), (2, "", "en", "a", 0, "s"), (3, "some words of the house", None, None, 5, "s"), (3, "some words of the house", None, None, 5, "s"), (None, "text without id", "en", "b", 3, "s"), (5, "x " * 30_000, "en", "b", 9, "s")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            before = docs.columns
            docs = stored(stage(spark, docs, FOLDER), "test")
            assert name == "tokens" or docs.columns == before
        docs.count()
