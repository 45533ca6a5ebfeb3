"""A corpus pipeline: clean documents, then one of each group of near copies, without secrets, packed to batches.

Each stage takes (spark, docs, sf_dir), works on all rows that it gets and
returns a DataFrame; :func:`run` writes each stage's result as Parquet and reads it
for the next.  All but the last return the columns of ``docs``, whatever these are called.

Null and empty texts are texts without words; rows without an id, repeated rows and ties keep a
row each but where a stage says otherwise; texts may be of any length; an empty
table passes every stage as an empty table.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import jaccard_join, packing, quality_classifier, secret_scans, toxicity
from quarry.llm.common import stash

#: The models and the join can't be stated in SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents predicted toxic go.  Texts without words score 0 and stay; without labels all scores are the same."""
    network = toxicity.fit(docs, _labels(spark, sf_dir))
    return toxicity.chosen(docs, network, 0)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents not predicted of quality go.  Texts without words get the sample's share of label 1."""
    model = quality_classifier.fit(docs, _labels(spark, sf_dir))
    return quality_classifier.chosen(docs, model, 1)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each group of linked rows, the one of the least id stays (then of the least hash of its text).

    A row is named by its id and text, so rows of one id with different texts are
    grouped each by its own text; of rows that share both, the one that is least as JSON stays.  Rows without an
    id can't be named by a group and stay.
    """
    key = F.struct("doc_id", F.coalesce(F.unhex(F.sha2("text", 256)), F.lit(b"")).alias("hash"))
    keyed = docs.where("doc_id is not null").withColumn("__row_key", key)
    groups = jaccard_join.near_duplicates(keyed, id_col="__row_key")
    first = groups.where("__row_key = component_id").select("__row_key").distinct()
    kept = keyed.join(first, "__row_key", "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = kept.groupBy("__row_key").agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return one.unionByName(docs.where("doc_id is null"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: the spans of secrets are masked, and n_chars follows.  Null texts stay null."""
    masked = secret_scans.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: each document's bucket and batch, by its number of words; those without an id come last."""
    return packing.pack(packing.words(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_copies", drop_near_copies),
    ("secrets", mask_secrets),
    ("packing", pack_batches),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
