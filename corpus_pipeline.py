"""The corpus pipeline: language, near-duplicates, benchmark, personal data, packing.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and gives
the documents that stay (the last one: the packed pieces). Each stage's rows
are written and read again before the next. All take empty tables, long texts
(which are read whole) and further columns of any name, which they hand on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm import decontamination, language, neardup, packing, pii
from lexarium.llm._shared import settle, spare, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows; `und` ones (null texts and
    texts without letters) go. Where no label teaches anything, none is rejected.
    Rows are judged one by one, whatever ids or rows repeat."""
    net = language.train(docs, ~language.held_out("doc_id", 5, 0) & F.col("doc_id").isNotNull())
    if net is None:
        return docs
    lang, score = spare(docs, "lang_pred", "score")
    found = language.predict(docs, net, names=(lang, score))
    return found.where(F.col(lang) != language.UND).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: one of the least doc_id (null ids last, ties by the
    text's digest). Rows without words stay, null texts too; rows of one id with
    texts of other classes stay apart."""
    return neardup.first_of_classes(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by a benchmark item. Null texts and
    texts without words are clean; rows are judged one by one."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by pseudonyms, and
    n_chars, if there, counted anew. Null texts stay as they are."""
    out = pii.pseudonymise(docs, pii.configured_key(spark), names=tuple(spare(docs, "pii_found", "pii_changed")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of token sequences that the documents are packed into; a null
    text is an empty one, and repeated rows are packed one by one."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("pii", pseudonymise),
    ("packing", pack),
]

#: No SQL can train a network or run a tokeniser.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs, name)
    return docs
