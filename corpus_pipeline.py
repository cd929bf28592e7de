"""The corpus pipeline: language ID, exact dedup, near-dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every stage's rows as Parquet
in the shared folder and rereads them as the next one's documents. All stages but the last return the
columns of documents, in their order; each is judged on its own input, and an empty input gives an empty output.
doc_id must be unique and not null; any other column may be null, and further columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from llm.bpe import bpe_encode_decode, digests
from llm.common import materialise, table
from llm.decontaminate import decontaminate
from llm.exact_dedup import exact_dedup
from llm.langid import language_id
from llm.near_dedup import near_dedup

VOCABULARY = "word_bpe_49k.json"


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``kept``, with the columns of ``docs``."""
    return docs.join(kept.select("doc_id"), "doc_id", "left_semi").select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language is found: null texts and texts without a letter.

    The model is learned from the stage's own labelled documents; without any, every document is undetermined and goes.
    Ties go to the smaller language name; repeated rows get the same language.
    """
    found = materialise(language_id(docs).where("lang_pred <> 'und'").select("doc_id"), "language")
    return _only(docs, found)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of texts that are equal but for white space: the longest, then the smallest doc_id.

    Null counts as empty; empty texts are one group.
    """
    return _only(docs, exact_dedup(docs).where("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group that links of a similarity of 0.8 join.

    That is the general threshold of near copies; op5_near_dedup's 0.85 is its own contract's. Texts without words
    (or null) link with nothing and stay.
    """
    return _only(docs, near_dedup(docs, percent=80, words=5).where("kept"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, exactly or as a paraphrase; null texts hold none."""
    clean = materialise(decontaminate(docs, table(spark, sf_dir, "benchmark")).where("NOT contaminated").select("doc_id"), "clean")
    return _only(docs, clean)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text; a null text counts as empty."""
    import public_tokenizers

    return digests(bpe_encode_decode(docs, public_tokenizers.path(VOCABULARY)))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", decontaminated),
    ("bpe", tokens),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
