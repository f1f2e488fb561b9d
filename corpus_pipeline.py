"""Corpus pipeline: stages applied one after the other to the documents table.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of `documents`, in their order and whatever else they are called; the last returns the pieces of the packed
sequences with their token ids. `n_chars` follows the text where a stage changes it.

Every row is a document of its own. A null text is empty; an empty or very long text is a text like any other; ties are
broken by id, then by content; an empty table gives an empty table. What a stage does beyond that is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import common, decontaminate, language, line_dedup, minhash, packing

ORACLE_SQL = None  # SQL can express neither the language model nor the tokenizer; tests compare with plain Python


def _own(name: str) -> Column:
    return F.col(f"`{name}`")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts in no learned language: without a letter (null and empty ones too), or of a score below the model's
    limit, which nearly all labelled rows reach. Fills `lang` where it is null. Where no row is labelled, only texts
    without a letter could be told apart, so all go."""
    common.ship_package(spark)
    got = language.identify(docs, carry=docs.columns).where("accepted")
    own = lambda x: F.col("carry").getField(x)
    return got.select(*[(F.coalesce(own(x), "lang_pred") if x == "lang" else own(x)).alias(x) for x in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more stay in the first of them only; a document that loses all its content goes.

    Lines are compared without white space around them and A-Z case; blank lines stay; a document with a frequent line
    twice keeps both or neither; a null text becomes no line and stays null."""
    into = "line_dedup"
    while into in docs.columns:
        into += "_"
    got = line_dedup.dedup_lines(docs, keep_first=True, into=into)
    kept, lost = F.col(into).getField("kept"), F.col(into).getField("n_dropped") > 0
    emptied = lost & (F.btrim(kept, F.lit(line_dedup.BLANKS)) == "")
    return got.where(~emptied).select(*[
        F.when(lost, kept).otherwise(_own("text")).alias("text") if x == "text"
        else F.when(lost, F.length(kept)).otherwise(_own("n_chars")).cast("long").alias("n_chars") if x == "n_chars" else _own(x)
        for x in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id: shingles of five words,
    similarity of 0.8 or more, chained. Repeated rows are a group; texts without words are no one's near duplicates."""
    common.ship_package(spark)
    return minhash.distinct_documents(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten consecutive words with a benchmark item (all its words, if it has fewer) go. Items
    without a word reject nothing; a document without a word stays."""
    items = common.table(spark, sf_dir, "benchmark")
    _, found = decontaminate.contaminated_texts(docs, items, ["doc_id"])
    row = F.struct(*[_own(x) for x in docs.columns]).alias("__row")
    left = docs.select(row, *common.text_key("text")).join(found.select("tk1", "tk2"), ["tk1", "tk2"], "left_anti")
    return left.select(*[F.col("__row").getField(x).alias(x) for x in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 token ids; a text without tokens is its end id alone."""
    return packing.pack(docs)


STAGES = [
    ("language_identification", identify_language),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
