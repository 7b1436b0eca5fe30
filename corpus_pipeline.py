"""A training corpus from ``documents``: rules, near copies, secrets, mixture, sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.  All
but the last keep the columns of documents, and columns that documents have besides, whatever their names.  An empty table
gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm import mixing, ngram_join, packing, quality, secrets
from arbora.llm.common import staged, table
from arbora.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go.

    A null or empty text has too few words and goes, whatever else is null.  Rows that repeat are judged each by itself, and
    there are no ties.  A very long text is measured whole.
    """
    return quality.keep(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id.

    Texts without words and rows without doc_id are near nothing and stay; other nulls don't matter.  Of rows that share a
    doc_id, repeated ones among them, one stays, that with the smallest text; ties in all that are one row.  A very long text
    is compared by all its windows.
    """
    return ngram_join.deduplicate(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark in the texts; n_chars, where there is one, follows the text.

    A null text stays null.  Spans that overlap or touch are one mark.  Rows that repeat are scanned each by itself, and stay
    alike.  A very long text is scanned whole.
    """
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them.

    A null source is one like others; a null or empty text has no words, and may be taken or not without an effect on words.
    Rows alike in doc_id, source and text are taken together.  Ties in length are ordered by a hash of doc_id.  A document is
    never cut, however long.
    """
    return mixing.mix(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences with their token ids.

    A null text has the end id alone; doc_id may be null.  Rows that repeat are so many documents.  Ties in length are packed in
    order of doc_id and text.  A very long document is cut into whole sequences, and its rest is packed.
    """
    return packing.pack(docs, tokenizer_path())


def ablations(spark: SparkSession, sf_dir: str, policy: str = "v1") -> DataFrame:
    """A report of the first stage: for each rule of a policy the documents that it rejects, and those that it alone does.

    Each document is judged by all rules once, and counted by the set of those that it fails.  Of an empty table no rule rejects
    any, and none is listed.
    """
    return quality.ablations(quality.ledger(table(spark, sf_dir, "documents").select("text")), policy)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram jaccard join", near_copies),
    ("secret scans", secret_scan),
    ("mixing to target weights", mixture),
    ("packing", sequences),
]

#: SQL cannot express the later stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's result is not written here."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, name.replace(" ", "-"))
    return docs
