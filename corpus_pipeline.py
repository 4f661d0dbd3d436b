"""From documents to sampled token ids: five stages, each written and read again before the next.

Every stage takes and (but for the last) returns the columns of documents; further columns stay, whatever their
names. Null and empty texts are documents: the classifier judges them by the statistics of an empty text, and
what it keeps has no passages, no words to mix (the mix drops it) and the segmentation of an empty text. Rows without
doc_id are judged, deduplicated by passage, mixed and segmented, but never taken for near-duplicates, as they
cannot be named. Rows that repeat are one near-duplicate group; ties go to the smaller doc_id. An empty table gives
an empty result; without labels the classifier keeps all.

quality classifier -> SimHash near-dedup (BK-trees; links checked: Jaccard 0.8 of five-word shingles) -> substring dedup -> source mix -> SentencePiece segmentations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import mixing, near, quality, sampling, substring
from quern.llm.common import forget, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (all, if there are no labels)."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near-duplicates."""
    return near.first_of_group(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document, or place, has already."""
    return substring.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document of the mix, as token ids; copies of one get samples of their own."""
    return sampling.encode(docs, by_copies=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("mix", mix_sources),
    ("segmentations", segment),
]

#: Stages fit models, hash with XXH64 and search lattices: SQL cannot express them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written to the shared folder, those of the stage before go."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
