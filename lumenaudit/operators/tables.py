"""Queries and updates over the entity tables: lists, lookups, patches, cascades, annotations, memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def listing(rows: DataFrame, filters: dict[str, object], newest: str, limit: int, offset: int = 0, ascending: bool = False) -> DataFrame:
    """A page of a filtered list with the filtered total; ties by id. The total is one aggregate, not a window over all rows."""
    for column, value in filters.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    order = F.col(newest) if ascending else F.col(newest).desc()
    return rows.orderBy(order, "id").offset(offset).limit(limit).crossJoin(F.broadcast(total))


def patch(rows: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """rows(id, …) with the non-null fields of changes(id, columns)."""
    c = changes.select("id", *(F.col(x).alias(f"new_{x}") for x in columns))
    out = rows.join(c, "id", "left")
    for x in columns:
        out = out.withColumn(x, F.coalesce(f"new_{x}", x))
    return out.select(rows.columns)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], mutable: list[str]) -> DataFrame:
    """Incoming rows replace the mutable fields of rows with their keys, or are added."""
    i = incoming.select(*keys, *(F.col(x).alias(f"new_{x}") for x in mutable))
    out = existing.join(i, keys, "full_outer")
    return out.select(*keys, *(F.coalesce(f"new_{x}", x).alias(x) for x in mutable))


def cascade(parents: DataFrame, deleted: DataFrame, key: str, children: list[tuple[DataFrame, str]]) -> list[DataFrame]:
    """The parents and children that stay when the parents in deleted(key) go."""
    return [parents.join(deleted, key, "left_anti"), *(c.join(deleted.withColumnRenamed(key, k), k, "left_anti") for c, k in children)]


#: Annotation types that decide an issue's status, ticket priorities by severity.
STATUS_BY_ANNOTATION = {"confirm": "confirmed", "false_positive": "false_positive"}
PRIORITY = {"critical": "Highest", "major": "High", "minor": "Medium", "info": "Low"}


def reviewed(issues: DataFrame, annotations: DataFrame) -> DataFrame:
    """Issues with the status that their latest deciding annotation gives."""
    decided = annotations.where(F.col("annotation_type").isin(list(STATUS_BY_ANNOTATION)))
    last = decided.groupBy(F.col("issue_id").alias("id")).agg(F.max_by("annotation_type", F.struct("created_at", "annotation_id")).alias("kind"))
    status = F.when(F.col("kind") == "confirm", "confirmed").when(F.col("kind") == "false_positive", "false_positive").otherwise(F.col("status"))
    return issues.join(last, "id", "left").withColumn("status", status).drop("kind")


def recall(memories: DataFrame, k: int, domain: str | None = None, kind: str | None = None) -> DataFrame:
    """The k most relevant memories of each domain, optionally of one domain or type."""
    if domain is not None:
        memories = memories.where(F.col("domain") == domain)
    if kind is not None:
        memories = memories.where(F.col("memory_type") == kind)
    w = Window.partitionBy("domain").orderBy(F.desc("relevance_score"), "key")
    return memories.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)


def context_text(recalled: DataFrame, domains: DataFrame, default: str = "Nothing is known about this site yet.") -> DataFrame:
    """One text for each of domains(domain): a header and a line per recalled memory, in rank order; the default where there is none."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("nth", "content"))), lambda x: F.concat(F.lit("- "), x["content"]))  # as many as were recalled
    texts = recalled.groupBy("domain").agg(F.concat(F.lit("Known about this site:\n"), F.array_join(lines, "\n")).alias("context"))
    return domains.select("domain").distinct().join(texts, "domain", "left").withColumn("context", F.coalesce("context", F.lit(default)))


def last_entries(entries: DataFrame, n: int, key: str, order: str, kind: str | None = None) -> DataFrame:
    """The last n entries of each key, newest first, optionally of one `type` only."""
    entries = entries if kind is None else entries.where(F.col("type") == kind)
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return entries.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


def report_of(tasks: DataFrame, reports: DataFrame, key: str) -> DataFrame:
    """The score of each task's report, and whether it has just one."""
    return tasks.join(reports, key).groupBy(key).agg(F.any_value("score").alias("score"), (F.count("score") == 1).alias("is_unique"))


def experiences(found: DataFrame) -> DataFrame:
    """Episodic memories from found(domain, page_type, rule_id): key, content as JSON, and how many kinds of issues."""
    g = found.groupBy("domain", "page_type").agg(F.sort_array(F.collect_set("rule_id")).alias("issues_found"))
    content = F.to_json(F.struct("page_type", "issues_found"))
    return g.select("domain", F.concat(F.lit("detection_"), "page_type").alias("key"), "issues_found", F.size("issues_found").cast("long").alias("issue_count"), content.alias("content"))


def missing_parents(rows: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of rows that no parent has yet, once each: what a write of rows has to create first."""
    return rows.select(keys).distinct().join(parents, keys, "left_anti")
