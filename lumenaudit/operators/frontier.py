"""Link frontier: which URLs to skip, their priority, and breadth-first expansion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..sources.stored import stored


def path_of(url: Column) -> Column:
    """Lower-case path; by pattern, since it must also work where a URL can't be parsed."""
    return F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1))


def skipped(url: Column) -> Column:
    scheme = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    return ~scheme.isin("http", "https", "") | path_of(url).rlike(r"\.(" + "|".join(V.SKIPPED_SUFFIXES) + ")$")


def _first(path: Column, words: list[str]) -> Column:
    return F.coalesce(*(F.when(path.contains(w), F.lit(w)) for w in words))


def prioritise(urls: DataFrame, max_depth: int) -> DataFrame:
    """Adds score (0-100) and reason to urls(url, depth, parent_has_forms, parent_has_issues)."""
    path = path_of(F.col("url"))
    u = urls.withColumn("hi", _first(path, V.HIGH_PRIORITY)).withColumn("mid", _first(path, V.MEDIUM_PRIORITY)).withColumn("lo", _first(path, V.LOW_PRIORITY))
    u = u.withColumn("penalty", 10.0 * F.col("depth") / F.lit(float(max(max_depth, 1))))
    has = lambda c, x: F.when(F.col(c).isNotNull(), x).otherwise(0.0)
    score = 50.0 + has("hi", 30.0) + has("mid", 15.0) - has("lo", 20.0) - F.col("penalty") + F.when(F.col("parent_has_forms"), 15.0).otherwise(0.0) + F.when(F.col("parent_has_issues"), 10.0).otherwise(0.0) - F.greatest(F.lit(0.0), (F.length("url") - 100) * 0.1)
    reason = F.concat_ws(
        "; ",
        F.concat(F.lit("High-priority pattern: "), "hi"), F.concat(F.lit("Medium-priority pattern: "), "mid"), F.concat(F.lit("Low-priority pattern: "), "lo"),
        F.when(F.col("penalty") > 5, F.concat(F.lit("Depth penalty: -"), F.format_string("%.1f", "penalty"))), F.when(F.col("parent_has_forms"), "Parent has forms"), F.when(F.col("parent_has_issues"), "Parent had a11y issues"),
    )
    return u.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 6)).withColumn("reason", F.when(reason == "", "Default priority").otherwise(reason)).drop("hi", "mid", "lo", "penalty")


def rank(urls: DataFrame, max_depth: int) -> DataFrame:
    """prioritise() without skipped URLs, with their rank per page, best first, then by place."""
    w = Window.partitionBy("page_id").orderBy(F.desc("score"), "pos")
    return prioritise(urls.where(~skipped(F.col("url"))), max_depth).withColumn("rank", F.row_number().over(w))


def numbered(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Rows with `name`, their number from 1 within their key in an order without ties. A range partition of (key, order) is
    numbered by itself and shifted by what stands before it, so no task holds a whole key."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = stored(rows.repartitionByRange(tasks, key, *order).withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as a key has parts
    offsets = r.groupBy("part", key).agg(F.count(F.lit(1)).alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    local = F.row_number().over(Window.partitionBy("part", key).orderBy(*order))
    return r.withColumn("local", local).join(offsets, ["part", key]).withColumn(name, F.col("offset") + F.col("local")).drop("part", "local", "offset")


def expand(seeds: DataFrame, edges: DataFrame, max_depth: int, max_pages: int, duplicates: DataFrame | None = None) -> DataFrame:
    """(site, node, depth, parent, nth): breadth first from seeds(site, node, place) over edges(site, src, dst, score, place), all sites at once; max_pages a site.

    Within a depth nodes come in the order of their parent, then best score, then place, then name; the first to find a
    node is its parent. Nodes of duplicates(site, node) are found but lead nowhere. One pass a depth, written to the shared folder.
    """
    at = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0.0).alias("b"), F.col("place").cast("long").alias("c"))
    first = seeds.groupBy("site", "node").agg(F.min(at).alias("at"))
    first = numbered(first, "site", ["at", "node"], "nth").where(F.col("nth") <= max_pages)
    columns = ["site", "node", "depth", "parent", "nth"]
    last = stored(first.withColumn("depth", F.lit(0)).withColumn("parent", F.lit(None).cast("string")).select(columns), "level")
    levels, used = [last], last.groupBy("site").agg(F.count(F.lit(1)).alias("used"))
    for d in range(1, max_depth + 1):
        known = reduce(DataFrame.unionByName, levels)
        going = last if duplicates is None else last.join(duplicates, ["site", "node"], "left_anti")
        found = going.select("site", F.col("node").alias("src"), F.col("nth").alias("a")).join(edges, ["site", "src"])
        at = F.struct("a", (-F.col("score")).alias("b"), F.col("place").cast("long").alias("c"), F.col("src").alias("parent"))
        new = found.groupBy("site", F.col("dst").alias("node")).agg(F.min(at).alias("at")).join(known.select("site", "node"), ["site", "node"], "left_anti")
        new = numbered(new, "site", ["at", "node"], "local_nth").join(used, "site").withColumn("nth", F.col("used") + F.col("local_nth"))
        last = stored(new.where(F.col("nth") <= max_pages).select("site", "node", F.lit(d).alias("depth"), F.col("at.parent").alias("parent"), "nth"), "level")
        if last.isEmpty():
            break
        levels.append(last)
        used = reduce(DataFrame.unionByName, levels).groupBy("site").agg(F.count(F.lit(1)).alias("used"))
    return reduce(DataFrame.unionByName, levels)


def graph(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): edges(site, src, dst) once each; nodes(site, url, status) with those that only edges name, as discovered."""
    once = edges.select("site", "src", "dst").distinct()
    ends = once.select("site", F.col("src").alias("url")).union(once.select("site", "dst")).distinct()
    missing = ends.join(nodes, ["site", "url"], "left_anti").withColumn("status", F.lit("discovered"))
    return nodes.select("site", "url", "status").unionByName(missing), once


def graph_stats(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status").isin("explored", "tested")).alias("explored"), F.count_if(F.col("status") == "tested").alias("tested"))


def with_status(nodes: DataFrame, status: str) -> DataFrame:
    """Nodes of a status that aren't duplicates: what to explore or test next."""
    return nodes.where((F.col("status") == status) & ~F.col("is_duplicate"))


def export(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(site, kind, json) of each graph, a line a node, an edge and a site's statistics, so that no row grows with a site."""
    done = F.col("status").isin("explored", "tested")
    stats = nodes.groupBy("site").agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("explored"), F.count_if(F.col("status") == "tested").alias("tested"))
    line = lambda df, kind, *columns: df.select("site", F.lit(kind).alias("kind"), F.to_json(F.struct(*columns)).alias("json"))
    return line(nodes, "node", "url", "status").unionByName(line(edges, "edge", "src", "dst")).unionByName(line(stats, "stats", "total", "explored", "tested"))
