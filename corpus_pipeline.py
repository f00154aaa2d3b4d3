"""The corpus pipeline: toxicity, near-duplicates, benchmark passages, personal data, then token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of ``documents``. ``run`` applies them in order, each result written to the shared folder and read again.

Defined cases, for every stage: null and empty texts are no copies and no leaks, are judged toxic by the share of toxic labels alone, and have no tokens;
texts are taken whole, of any length; repeated rows are judged one by one and only the near-duplicate stage takes them away; rows without
a doc_id stay; an empty table gives an empty one; further columns, whatever their names, keep their values (the last stage leaves them out).

Stages lower the session's limits of batches for Python workers, which the session keeps: five kinds of workers share an executor's memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelode.llm import bpe, common, decontaminate, near_dedup, pii, toxicity

#: A document goes if its score of class toxic is this or more: those that the operator calls toxic, no others.
REJECT = toxicity.THRESHOLD


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below ``REJECT``; the model is that of the operator, from the labels of ``sf_dir``. A column that is named as the
    score is put aside meanwhile. A text without features, a null or empty one too, has the intercept's score, or the share of class 1 among the usable labels where a class has none: where that is
    ``REJECT`` or more they all go."""
    common.light_batches(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    aside = {c: common.fresh(docs, "score") for c in docs.columns if c.lower() == "score"}
    kept = toxicity.scored(docs.withColumnsRenamed(aside), model).where(F.col("score") < REJECT).drop("score")
    return kept.withColumnsRenamed({own: c for c, own in aside.items()}).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that of the smallest doc_id; five-word shingles, similarity 0.8. Of rows equal in doc_id and text one stays."""
    common.light_batches(spark)
    return near_dedup.deduplicated(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, or less than 0.8 of its shingles."""
    common.light_batches(spark)
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, spans of personal data replaced by their kinds, and n_chars with them."""
    common.light_batches(spark)
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids of the whole text (none for null and empty ones), their number, and what they decode to."""
    common.light_batches(spark)
    return bpe.encoded(docs).select("doc_id", "lang", "source", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("pii", redact_personal_data),
    ("bpe", encode),
]

#: Learned scores and signatures have no SQL; tests hold the rows against a brute-force form of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
