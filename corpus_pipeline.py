"""A training-corpus pipeline over the documents table; each stage calls one operator of the llm subpackage.

Every stage but the last returns the columns of documents. The mix holds a document once for each epoch that reaches
it, whole, so a source goes over its budget by less than a document. What a stage writes and its result doesn't read is
deleted when its decisions are written; run() deletes a stage's other tables when its result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm import decontaminate, mixing, near_duplicates, queries, tokens, toxicity
from lexigrid.llm.common import hot_salts, numbered, packed, salted_join, scratch, shared_folder, table, written


def _numbered(docs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The written documents with all their columns in one, `row`, and row_key, so that no column's name can clash; and of them row_key,
    doc_id, text and source alone."""
    rows = numbered(packed(docs), name)
    return rows, rows.select("row_key", *(F.col("row")[c].alias(c) for c in ("doc_id", "text", "source") if c in docs.columns))


def _without(rows: DataFrame, rejected: DataFrame) -> DataFrame:
    """The numbered rows but those rejected, as they were. The rejected are the smaller side, so that Spark can broadcast them
    as long as its own size limit allows, and else joins by a shuffle."""
    return rows.join(rejected, "row_key", "left_anti").select("row.*")


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; rows carry their columns through the scoring, with no join."""
    scored = toxicity.scored(docs, table(spark, sf_dir, "labels"), carry=True)
    return scored.filter("predicted = 0").select("row.*")


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class of texts stays, that with the smallest id (null ids last, and of equal ids the
    first written); rows without text stay. Rows are judged by their own text, whatever their ids."""
    whole, rows = _numbered(docs, "near-input")
    with scratch(spark):
        found = near_duplicates.classes(rows, id_col="row_key").filter("class_id IS NOT NULL").select(F.col("doc_id").alias("row_key"), "class_id")
        named = written(found.join(rows.select("row_key", "doc_id"), "row_key"), "classes")
        order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
        kept = written(named.groupBy("class_id").agg(F.min(order).alias("least"), F.count("*").alias("n")).filter("n > 1").select("class_id", F.col("least.row_key").alias("kept"), "n"), "kept")
        large, _ = hot_salts(kept, "class_id", "n")
        copies = salted_join(named.select("class_id", "row_key"), kept.drop("n"), large, "class_id", F.col("row_key"))
        rejected = written(copies.filter("row_key <> kept").select("row_key"), "rejected", keep=True)
    return _without(whole, rejected)


def contaminated_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text has a window of a benchmark item go."""
    whole, rows = _numbered(docs, "seen-input")
    with scratch(spark):
        found = decontaminate.report(decontaminate.contamination(rows, table(spark, sf_dir, "benchmark"), id_col="row_key"))
        seen = written(found.filter("contaminated").select(F.col("doc_id").alias("row_key")), "seen", keep=True)
    return _without(whole, seen)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, by DataFrame functions alone.

    In the order of hash keys, a source's documents get equal numbers of copies up to one place, and one copy less
    beyond it. So a row for each source, that place, decides for every document, and texts aren't shuffled. Keys are of the
    id and the row's number, so no two rows share a place, whatever their ids.
    """
    whole, rows = _numbered(docs, "mix-input")
    place = mixing.place(mixing.SEED, "row_key")
    with scratch(spark):
        mix = mixing.mix(rows, tie="row_key").select("source", place.alias("place"), mixing.epochs().alias("copies"))
        cuts = mix.groupBy("source").agg(F.max(F.struct("copies", "place")).alias("last"))
        cuts = written(cuts.select(F.col("source").alias("mixed_source"), F.col("last.copies").alias("most"), F.col("last.place").alias("last")), "cuts", keep=True)
    joined = whole.withColumn("doc_id", F.col("row.doc_id")).join(cuts, F.col("row.source").eqNullSafe(F.col("mixed_source")))
    copies = F.when(place <= F.col("last"), F.col("most")).otherwise(F.col("most") - 1)
    repeated = joined.withColumn("copies", copies).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select("row.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as Parquet in ascending doc_id order, and read back from the files."""
    path = shared_folder(spark, "pipeline-tokens")
    tokens.write_token_table(docs, path, queries.tokenizer_path(), queries.END_ID)
    return tokens.digests_of(spark, path)


STAGES = [
    ("toxicity", toxic_out),
    ("near duplicates", near_duplicates_out),
    ("decontamination", contaminated_out),
    ("mixing", mixed),
    ("token ids", token_ids),
]

#: The stages' models and signatures can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
