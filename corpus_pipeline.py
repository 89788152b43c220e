"""The training-data pipeline: each stage calls one operator of gaugeworks.llm."""

from __future__ import annotations

from gaugeworks.llm import mixing, packing, personal, quality, simhash
from gaugeworks.llm.common import shared_dir


def quality_rules(spark, docs, sf_dir):
    """Documents that fail the fixed or the adaptive rules go."""
    return quality.keep_good(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of linked fingerprints stays."""
    return simhash.keep_first(docs)


def redact_personal_data(spark, docs, sf_dir):
    """Personal data gives way to the tag of its kind."""
    return personal.redact(docs)


def mix_sources(spark, docs, sf_dir):
    """Each document as often as its source's rate says."""
    return mixing.mix_rows(docs)


def pack(spark, docs, sf_dir):
    """Pieces of documents in sequences."""
    return packing.pack_texts(docs)


STAGES = [("quality", quality_rules), ("near-dedup", near_dedup), ("personal-data", redact_personal_data), ("mix", mix_sources), ("pack", pack)]

#: SQL cannot express the fingerprints, the span classifier and the token pieces.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to ``documents``; each result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
