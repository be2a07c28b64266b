"""Table access, shared-folder tables, label folds and component search."""

from __future__ import annotations

import gc
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only by local masters whose session sets no ``spark.checkpoint.dir`` (tests, laptops).
FALLBACK_DIR = "file:///tmp/checkpoints/clausemill"


#: About so many links are joined by a task before links are joined across tasks.
EDGES_DEALT = 1 << 16


#: Spark's setting for the bytes of a batch that goes to Python, its default and ours.
BATCH_SETTING, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"


def bound_batches(spark: SparkSession) -> None:
    """Batches of texts are of 8 MB, unless the session says otherwise: a worker and the executor
    each hold several copies of one."""
    if spark.conf.get(BATCH_SETTING, None) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the one that all executors share."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = FALLBACK_DIR
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def save(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: the lineage
    ends there, and a lost executor loses nothing."""
    path = scratch_dir(df.sparkSession)
    bound_batches(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_saved(*tables: DataFrame) -> None:
    """Deletes tables that ``save`` wrote and that no later job reads."""
    for df in tables:
        files = df.inputFiles()
        if files:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of jobs whose results are saved: it does so once the
    driver's references are collected."""
    gc.collect()
    spark._jvm.System.gc()


def fold(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 3; rows with 1 are held out of training."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def training_labels(labels: DataFrame, label: str, most: int) -> DataFrame:
    """Labels of training rows: (doc_id, label double), at most ``most`` of them in the
    order of a hash of the id.  Null ids and labels other than 0 and 1 are left out; of
    repeated ids one row is kept (label 1 wins)."""
    return (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold(F.col("doc_id")) != 1))
        .groupBy("doc_id")
        .agg(F.max(label).cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )


def one_a_document(rows: DataFrame, *values: str) -> DataFrame:
    """Saved training rows (doc_id, label, values), one for each id, so that their number has the
    bound of ``training_labels`` however often a document is repeated: of different rows the least
    by a hash of the values.  Rows without repeated ids are returned as they are."""
    r = rows.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids")).first()
    if r.n == r.ids:
        return rows
    picked = F.min(F.struct(F.xxhash64(*values).alias("h"), *values)).alias("v")
    kept = save(rows.groupBy("doc_id", "label").agg(picked).select("doc_id", "label", *(F.col(f"v.{c}").alias(c) for c in values)))
    drop_saved(rows)
    return kept


def _share_stars(batches):
    """(u, v) of each node u that this share of links connects to a smaller one: v, the smallest."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            p, q = root(u), root(v)
            if p != q:
                parent[max(p, q)] = min(p, q)
    ends = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(ends, pa.int64()), pa.array([root(x) for x in ends], pa.int64())], ["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """Connected components of (a, b) links as (id, component), component being the
    smallest id.  Alternates large-star and small-star steps, each a grouped minimum, so
    that no group's rows meet in one task, until links are stars: no centre has a smaller
    neighbour and no other node two.  Every round is written to the shared folder.

    Links are first dealt at random, EDGES_DEALT a task or so, and each task's share is replaced
    by stars; where that is one share they are the result.

    Only ids that occur in ``links`` with a != b are returned.  Null ends are ignored.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    shares = links.count() // EDGES_DEALT + 1
    edges = edges.repartition(shares).mapInArrow(_share_stars, "u long, v long")
    edges = save(edges if shares == 1 else edges.distinct())
    while shares > 1 and not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: larger neighbours of u point to the smallest of u's neighbourhood
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours point to their smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        new = save(small)
        drop_saved(edges)
        edges = new
        free_shuffles(edges.sparkSession)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _stars(edges: DataFrame) -> bool:
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    ends = ends.unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    each = ends.groupBy("id").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return each.filter("below > 1 OR below = 1 AND above = 1").isEmpty()
