"""Queries read their texts once a method; neighbours in large blocks keep ties and few rows in order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import similarity, text
from gaugeworks.plans.base import QUERIES


@pytest.mark.parametrize("name", ["u2_triple_set_operations", "c13_extraction_comparison"])
def test_extractions_run_once(spark, monkeypatch, name):
    seen = []
    once = text.extract_all

    def counted(df, id_col, column, method="cue", voc=text.Vocabulary(), extractor=None):
        calls = spark.sparkContext.accumulator(0)
        seen.append(calls)
        look = F.udf(lambda v: (calls.add(1), v)[1], "string").asNondeterministic()
        return once(df.withColumn(column, look(column)), id_col, column, method, voc, extractor)

    monkeypatch.setattr(text, "extract_all", counted)
    QUERIES[name].run(spark, "/root/testdata/sf0.001").collect()
    n = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert [c.value for c in seen] == [n, n]


@pytest.mark.parametrize("rows", [7, 8192])
def test_neighbours_with_ties(spark, rows):
    rng = np.random.default_rng(5)
    train, test = rng.integers(0, 3, (40, 2)).astype(float), rng.integers(0, 3, (300, 2)).astype(float)
    a, b = (spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>") for x in (train, test))
    got = similarity.knn(a, b, "id", "v", 5, rows).orderBy("query", "rank").toPandas()
    d = np.sqrt(((test[:, None] - train) ** 2).sum(2))
    assert got.neighbour.to_numpy().reshape(300, 5).tolist() == np.argsort(np.round(d, 8), axis=1, kind="stable")[:, :5].tolist()


def test_vectors_are_shuffled_seldom(spark):
    n = 9_000
    a = spark.range(n).select("id", F.array(F.rand(1), F.rand(2)).alias("v"))
    assert similarity.BLOCK_ROWS >= 8_192 and similarity.knn(a, a.limit(300), "id", "v", 3).count() == 900


def test_packing_encodes_small_parts(monkeypatch):
    pa = pytest.importorskip("pyarrow")
    pytest.importorskip("public_tokenizers")
    from gaugeworks.llm import packing, vocab
    seen = []
    whole = vocab.Encoder.with_end
    monkeypatch.setattr(vocab.Encoder, "with_end", lambda self, texts, end: (seen.append(texts.nbytes), whole(self, texts, end))[1])
    monkeypatch.setattr(packing, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 0)}))}))
    texts = [f"word {i} and some more of it " * 40 for i in range(5_000)]
    batch = pa.record_batch([pa.array(range(5_000), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    out = list(packing._pack_texts([batch], vocab.vocabulary("byte_bpe_50k.json"), True, False, 1, 2048, 256))
    assert max(seen) < 3 << 20 and len({i for b in out for i in b.column(0).to_pylist()}) == 5_000
