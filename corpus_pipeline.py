"""The corpus pipeline: stages over documents, each written as Parquet and read by the next.

Every stage works on all that its predecessor kept, and its decisions take effect:

1. toxicity: documents that the learned score rejects go;
2. n-gram Jaccard join: of each component of links (five-word shingles, similarity 0.8 or more)
   one row stays, of the least id;
3. benchmark decontamination: documents in which an item is found go;
4. secret scans: each secret is replaced by a mark, and n_chars follows;
5. mixing: sources are mixed to target weights; a row for each copy emitted.

All but the last return the columns of documents. Nulls, empty and very long texts, repeated rows,
empty tables and further columns are handled as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm import decontaminate, mixing, ngram_join, secrets, toxicity
from vellumine.llm.skew import join_hot, small
from vellumine.session import cut, scratch

#: SQL can't express the learned, sketched and verified stages; tests hold them against brute force.
ORACLE_SQL = None

#: A column for rows' hashes.
ROW = "__vellumine_row"
#: Texts of this score and more are rejected.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't rejected. Labels of every fold but the held-out one teach."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(toxicity.fold() != 0)
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model, prefix="__toxic_")
    return scored.where(F.col("__toxic_score") < TOXIC).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: its least doc_id's (null ids last; then by a hash of the row), one of repeated rows.

    Rows are told apart by a hash of all their columns, so those that share an id are judged by their texts.
    Rows without n-grams link with nothing and stay all.
    """
    whole = F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(k), *docs.columns)), 16, "0") for k in (1, 2)]))
    named = docs.withColumn(ROW, whole)
    joined = cut(ngram_join.join(named, k=5, percent=80, tag=ROW).where(F.col("root").isNotNull()).select("root", "doc_id", ROW))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(ROW).alias("row"))
    groups = joined.groupBy("root").agg(F.min(order)["row"].alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    held = cut(join_hot(joined, groups, "root", "n"))
    # a row's component is that of its text, so rows with one hash are all first or all not
    losers = cut(held.where(F.col(ROW) != F.col("first")).select(ROW).distinct())
    kept = named.join(small(losers), ROW, "left_anti")
    repeated = cut(held.where(F.col(ROW) == F.col("first")).groupBy(ROW).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(ROW))
    if not repeated.isEmpty():
        again = small(repeated)
        kept = kept.join(again, ROW, "left_anti").unionByName(kept.join(again, ROW, "left_semi").dropDuplicates([ROW]))
    return kept.select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    found = decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), into="__leaks")
    return found.where(F.size("__leaks") == 0).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy that systematic sampling emits."""
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "source", "size", "source_size", "target", "copies", "taken", "copy"))
    return mixing.emitted(mixing.mix(docs, carry=carry)).drop("copies", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each one's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where = scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{where}/{k}-{name.replace(' ', '_')}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
