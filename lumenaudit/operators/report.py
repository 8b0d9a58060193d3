"""Scores, breakdowns and exports over the issue table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ["critical", "major", "minor", "info"]


def severity_counts(issues: DataFrame, *keys: str) -> DataFrame:
    """One column per severity, zeros included."""
    return issues.groupBy(*keys).agg(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))


def overall_score(critical: Column, major: Column, minor: Column, pages: Column) -> Column:
    return F.when(pages > 0, F.greatest(F.lit(0.0), F.round(100 - (10 * critical + 5 * major + 2 * minor) / pages, 1))).otherwise(0.0)


def scores(issues: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """Per key: counts by severity, pages, the overall score and the three level scores."""
    n = pages.groupBy(key).agg(F.count(F.lit(1)).alias("pages"))
    s = n.join(severity_counts(issues, key), key, "left").na.fill(0)
    s = s.withColumn("score", overall_score(F.col("critical"), F.col("major"), F.col("minor"), F.col("pages")))
    return s.withColumn("score_a", F.least(F.lit(100.0), F.round(F.col("score") * 1.1, 1))).withColumn("score_aa", F.round("score", 1)).withColumn("score_aaa", F.round(F.col("score") * 0.9, 1)).withColumn("band", band(F.col("score")))


def band(score: Column) -> Column:
    return F.when(score >= 80, "good").when(score >= 60, "fair").otherwise("poor")


def by_criterion(issues: DataFrame) -> DataFrame:
    return issues.groupBy(F.coalesce("wcag_criterion", F.lit("unknown")).alias("wcag_criterion")).agg(F.count(F.lit(1)).alias("n"))


def by_level(issues: DataFrame, key: str) -> DataFrame:
    return issues.groupBy(key, "wcag_level").agg(F.count(F.lit(1)).alias("n"))


def quality(found: DataFrame, labelled: DataFrame, runs: DataFrame) -> DataFrame:
    """Detection quality per rule and source, from found(page_id, rule_id, element_selector, detected_by), labelled true issues
    (page_id, rule_id, element_selector) and runs(pages_tested, pages_reachable, seconds), one row a task.

    An issue is its page, rule and selector, counted once. A labelled issue that no source found counts as missed for every source of its rule, or for
    source `none` where its rule found nothing at all; so does what only other sources found. A measure without a base is null.
    """
    key = ["page_id", "rule_id", "element_selector"]
    truth = labelled.select(key).distinct().withColumn("true", F.lit(1))
    hits = found.select(*key, "detected_by").distinct().join(truth, key, "left")
    per = hits.groupBy("rule_id", "detected_by").agg(F.count(F.lit(1)).alias("found"), F.count("true").alias("matched"))
    all_true = truth.groupBy("rule_id").agg(F.count(F.lit(1)).alias("labelled"))
    q = per.join(all_true, "rule_id", "full_outer").select("rule_id", F.coalesce("detected_by", F.lit("none")).alias("detected_by"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("found", "matched", "labelled")))
    total = runs.agg(F.try_divide(F.sum("pages_tested"), F.sum("pages_reachable")).alias("page_coverage"), F.try_divide(F.sum("seconds"), F.sum("pages_tested")).alias("seconds_per_page"))
    measures = {"precision": F.try_divide("matched", "found"), "recall": F.try_divide("matched", "labelled"), "false_positive_rate": F.try_divide(F.col("found") - F.col("matched"), F.col("found"))}
    return q.select("*", *(m.alias(name) for name, m in measures.items())).crossJoin(F.broadcast(total))  # one row


LEVELS = ["A", "AA", "AAA"]


def report_row(scores_: DataFrame, issues: DataFrame, key: str, summaries: DataFrame | None = None) -> DataFrame:
    """A report a key: scores, counts, breakdown by severity and level as JSON, summary and recommendations as lines; summaries(key, summary, recommendations array) may be absent."""
    by_level_ = issues.groupBy(key).agg(*(F.count_if(F.col("wcag_level") == x).alias(x) for x in LEVELS))
    scores_ = scores_.join(by_level_, key, "left").na.fill(0, LEVELS)
    total = sum((F.col(s) for s in SEVERITIES), F.lit(0))
    breakdown = F.to_json(F.struct(F.struct(*SEVERITIES).alias("by_severity"), F.struct(*LEVELS).alias("by_wcag_level")))
    r = scores_.select(key, F.col("score").alias("overall_score"), "score_a", "score_aa", "score_aaa", F.col("pages").alias("total_pages"), total.alias("total_issues"), "critical", "major", "minor", breakdown.alias("issue_breakdown"))
    if summaries is None:
        return r.withColumn("summary", F.lit(None).cast("string")).withColumn("recommendations", F.lit(None).cast("string"))
    lines = F.array_join(F.transform("recommendations", lambda x: F.concat(F.lit("- "), x)), "\n")
    return r.join(summaries.select(key, "summary", lines.alias("recommendations")), key, "left")


def export_rows(issues: DataFrame, pages: DataFrame) -> DataFrame:
    """Issues with their page's URL, recommendations never null."""
    return issues.join(pages.select("page_id", "url"), "page_id", "left").withColumn("recommendation", F.coalesce("recommendation", F.lit("")))


def export_lines(scores_: DataFrame, issues: DataFrame, key: str, path: str) -> None:
    """Writes reports as JSON lines, a folder a key: a line of the report's fields, and a line an issue, so that no row grows with a report."""
    head = scores_.select(key, F.to_json(F.struct(*scores_.columns)).alias("value"))
    lines = issues.select(key, F.to_json(F.struct("page_id", "rule_id", "pos", "severity")).alias("value"))
    head.unionByName(lines).write.partitionBy(key).text(path)


#: What severities and sources are called.
SEVERITY_LABEL = {"critical": "Critical", "major": "Major", "minor": "Minor"}
SOURCE_LABEL = {"rule": "Rule", "ai": "Model", "vision_ai": "Vision model"}
#: The colour that a report shows a score in, by its band.
BAND_COLOUR = {"good": "#52c41a", "fair": "#faad14", "poor": "#f5222d"}


def labelled(issues: DataFrame) -> DataFrame:
    """Adds severity_label (anything else: Notice) and source_label (anything else: as it is)."""
    named = lambda names: F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return issues.withColumn("severity_label", F.coalesce(F.try_element_at(named(SEVERITY_LABEL), F.col("severity")), F.lit("Notice"))).withColumn("source_label", F.coalesce(F.try_element_at(named(SOURCE_LABEL), F.col("detected_by")), F.col("detected_by")))


def colour(score: Column) -> Column:
    """The colour that stands for a score; null without one."""
    return F.when(score.isNotNull(), F.element_at(F.create_map(*(F.lit(x) for kv in BAND_COLOUR.items() for x in kv)), band(score)))


def dashboard(tasks: DataFrame) -> DataFrame:
    return tasks.agg(F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("status") == "completed").alias("completed"), F.sum("issues_found").alias("issues"), F.sum("pages_discovered").alias("pages"))


def progress(tasks: DataFrame, max_pages: int) -> DataFrame:
    """Adds the percentages discovered (of max_pages, 100 at most) and tested (of those discovered; null if none)."""
    return tasks.withColumn("discovered", F.least(F.lit(100.0), 100.0 * F.col("pages_discovered") / max_pages)).withColumn("tested", F.try_divide(100.0 * F.col("pages_tested"), F.col("pages_discovered")))


def boxed(pages: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pages that have a box."""
    return pages.join(boxes, "page_id", "left_semi")
