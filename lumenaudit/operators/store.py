"""Page and issue tables on disk, partitioned by task: a write changes the partitions of its own tasks only."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stored import stored


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table, or an empty one where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def replace_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Overwrites the partitions that `rows` has values for; the others stay as they are. Rows may be derived from the same table: they are
    worked out first, next to it."""
    stored(rows, "partitions").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def upsert_pages(incoming: DataFrame, path: str, mutable: list[str], keys: tuple[str, ...] = ("task_id", "url")) -> None:
    """Pages of incoming(keys, mutable) replace those fields of stored pages with their keys, or are added; of several rows of one page one is taken. A null field leaves the old value.

    A page is its task and URL, unless more keys tell pages of one URL apart; task_id is one of them."""
    columns = [*keys, *mutable]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in incoming.select(columns).schema)
    new = incoming.select(columns).dropDuplicates(list(keys))
    old = read(incoming.sparkSession, path, schema).join(new.select("task_id").distinct(), "task_id", "left_semi")
    n = new.select(*keys, *(F.col(c).alias(f"new_{c}") for c in mutable))
    merged = old.join(n, list(keys), "full_outer").select(*keys, *(F.coalesce(f"new_{c}", c).alias(c) for c in mutable))
    replace_partitions(merged, path, "task_id")


PAGES = "url string, page_id string, task_id long"


def write_issues(issues: DataFrame, path: str) -> None:
    """Stores issues(task_id, url, …) under `path`/issues with the page_id that `path`/pages has for their task and URL; a page that isn't there yet is added.

    The issues of each task in `issues` are replaced as a whole, other tasks keep theirs. One join finds
    pages and tells which are new; a new page's id is a hash of its key, so a write that is repeated finds or makes the same page.
    """
    spark = issues.sparkSession
    known = read(spark, f"{path}/pages", PAGES).groupBy("task_id", "url").agg(F.min("page_id").alias("known_id"))
    made = F.md5(F.concat_ws("|", F.col("task_id").cast("string"), "url"))
    joined = stored(issues.join(known, ["task_id", "url"], "left").withColumn("page_id", F.coalesce("known_id", made)), "issues")
    fresh = joined.where("known_id IS NULL").select("url", "page_id", "task_id").distinct()
    fresh.write.mode("append").partitionBy("task_id").parquet(f"{path}/pages")
    joined.drop("known_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("task_id").parquet(f"{path}/issues")
