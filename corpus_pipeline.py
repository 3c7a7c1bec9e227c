"""The corpus pipeline: toxicity, near duplicates, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs.  All but the last return the
columns of documents.

* toxicity: documents that the grammar rejects go.
* near_duplicates: of each group of near copies (five words, Jaccard 0.8) the
  document with the smallest id stays, once; documents without words all stay,
  and so do documents of groups in which no document has an id.
* decontamination: documents that hold a window of a benchmark item go.
* secrets: values that the forest calls secrets are replaced in the texts.
* packing: the remaining documents are packed in sequences of 4096 tokens.

Defined cases: null and empty texts count as clean and stay; very long texts are
judged whole, and cut only by packing; of repeated rows of a document one stays;
extra columns pass through every stage but the last, whatever their names; an
empty table gives an empty table in every stage.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import op03_packing, op05_minhash, op06_secrets, op07_toxicity, op08_decontaminate
from framewright.llm.common import small_side, table, text_col, written

SHINGLE = 5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op07_toxicity.keep_clean(docs, op07_toxicity.learn_grammar(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = written(op05_minhash.near_components(docs, size=SHINGLE), "components")
    stays = F.col("kept") | F.col("component_id").isNull() | (F.col("n_shingles") == 0)
    gone = small_side(written(found.where(~stays).select("doc_id", "key").distinct(), "gone"))
    again = found.where(stays & (F.col("n_shingles") > 0)).groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1")
    again = small_side(written(again.select("doc_id", "key"), "again"))

    def same(table_: DataFrame) -> Column:
        """The rows of a table of ids and text keys that fit a document; no column is added, so none can clash."""
        return docs["doc_id"].cast("long").eqNullSafe(table_["doc_id"]) & (F.unhex(F.sha2(text_col(docs["text"]), 256)) == table_["key"])

    left = docs.join(gone, same(gone), "left_anti")
    # repeated rows of a document that stays: one of them does
    once = left.join(again, same(again), "left_semi").select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.sha2(text_col(), 256).alias("key"))
    once = once.groupBy("id", "key").agg(F.first("row").alias("row")).select("row.*")
    return left.join(again, same(again), "left_anti").unionByName(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op08_decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op06_secrets.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op03_packing.pack_documents(docs, op03_packing.default_tokenizer())


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: A trained grammar, a trained forest and a tokenizer: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
