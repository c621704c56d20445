"""Tables as notes, folders, titles, events and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, path: str) -> DataFrame:
    """df dealt over all cores if its table is too small to give each a partition (a row group is read by a single task); else as it is."""
    spark = df.sparkSession
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(file).getLength()
    cores = spark.sparkContext.defaultParallelism
    part = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(cores) if 1 < cores and size < cores * part else df


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """note_id, title, body, folder, tag of every document."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), f"{sf_dir}/documents.parquet")
    return d.select(F.concat(F.lit("d"), "doc_id").alias("note_id"), F.concat(F.lit("Document "), "doc_id").alias("title"), F.col("text").alias("body"), F.col("source").alias("folder"), F.col("lang").alias("tag"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk per document: chunk_id, note_id, content."""
    return notes(spark, sf_dir).select(F.concat("note_id", F.lit(":0")).alias("chunk_id"), "note_id", F.col("body").alias("content"))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id and query: every benchmark item."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, parent_id: regions are roots, nations their children."""
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"))
    return r.union(n)


#: Values that columns of the index may have (fixed values).
DOMAINS = {
    "layer": ["structural", "semantic"],
    "kind": ["note", "entity", "relation"],
    "type": ["link", "backlink", "tag", "mention", "relation"],
    "structural_status": ["pending", "success", "failed"],
    "semantic_status": ["pending", "success", "failed"],
    "status": ["running", "success", "failed", "cancelled"],
    "pipeline": ["structural", "semantic", "both"],
}


def out_of_domain(rows: DataFrame, domains: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows with a value that a column's domain doesn't hold; null is in every domain."""
    wrong = F.lit(False)
    for column, values in (domains or DOMAINS).items():
        if column in rows.columns:
            wrong = wrong | F.coalesce(~F.col(column).isin(values), F.lit(False))
    return rows.where(wrong)
