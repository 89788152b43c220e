"""Names and words of texts, read off in one pass."""

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import gates, text

TEXTS = ["Blue oak, blue oaks and oak moss; firé fir_ (FIR)", "été été oaksoaks oaks-oaks éoaks", "", None, "İ fir \U0001F332fir 2fir fir2", "blue oak moss"]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("aliases", [{"oaks": "blue oak", "été": "fir", "ash": "fir"}, {"moss": "fir", "oak": "blue oak"}])
def test_alias_spans_of_one_pass(spark, monkeypatch, aliases):
    voc = text.Vocabulary(terms=("blue oak", "moss oak grove", "fir"), relations=(), aliases=aliases, verbs={}, cues=())
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string")
    one = text.tag_terms(df, "t", voc, aliases=True)
    assert _plan(one.select("spans")).count("regexp_replace") == 2   # foreign marks, names
    got = {r["id"]: r["spans"] for r in one.collect()}
    monkeypatch.setattr(text, "_bounded_pattern", lambda voc: None)
    assert got == {r["id"]: r["spans"] for r in text.tag_terms(df, "t", voc, aliases=True).collect()}
    assert any(got.values())


def test_no_single_pass_where_names_touch():
    assert text._bounded_pattern(text.Vocabulary(terms=("oak", "-x"), aliases={})) is None


def test_words_are_counted_without_patterns(spark):
    df = spark.createDataFrame([(" a b\x1cc \u0085d\n\t e ",), ("",), (" 　\n",), (None,)], "t string")
    assert [r[0] for r in df.select(text.word_count(F.col("t"))).collect()] == [4, 0, 0, 0]
    names = ["diagnosis", "citations", "hypothesis", "prediction", "verdict", "learning"]
    got = gates.check_annotations(df.select(*[F.col("t").alias(n) for n in names]), True).select("violations")
    assert _plan(got).count("regexp_replace") == 2   # trimmed citations, their papers
