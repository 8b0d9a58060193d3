"""Findings of other detectors: parsing their replies, merging, normalising, locating on the page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINDING = "array<struct<rule_id:string,wcag_criterion:string,wcag_level:string,severity:string,title:string,description:string,recommendation:string,element_selector:string,element_html:string,confidence:double>>"
#: How detectors' severities are read; anything else is minor.
SEVERITY = {"critical": "critical", "major": "major", "minor": "minor", "info": "info", "serious": "major", "moderate": "minor", "high": "critical", "low": "minor", "medium": "major"}


def parse_reply(reply: Column) -> Column:
    """Findings in a model's reply: a fenced or bare JSON array, or one object; null if it can't be read."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.from_json(F.when(fenced != "", fenced).otherwise(reply), FINDING)


def parse(replies: DataFrame) -> DataFrame:
    """One row per finding of replies(page_id, source, reply)."""
    return replies.select("page_id", F.col("source").alias("detected_by"), F.inline(parse_reply(F.col("reply"))))


def drop_known(vision: DataFrame, known: DataFrame) -> DataFrame:
    """Vision findings whose selector no other finding of the page has; those without a selector stay."""
    return vision.join(known.where("element_selector IS NOT NULL").select("page_id", "element_selector").distinct(), ["page_id", "element_selector"], "left_anti").select(vision.columns)


#: What a finding that doesn't say it has.
DEFAULTS = {"wcag_criterion": "unknown", "rule_id": "ai-detection"}


def normalise(findings: DataFrame) -> DataFrame:
    """Severities and levels as the issue table knows them (else minor, A), and DEFAULTS for what is missing."""
    mapped = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))
    level = F.upper(F.col("wcag_level"))
    out = findings.withColumn("severity", F.coalesce(F.try_element_at(mapped, F.lower("severity")), F.lit("minor"))).withColumn("wcag_level", F.when(level.isin("A", "AA", "AAA"), level).otherwise("A"))
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in DEFAULTS.items() if c in out.columns})


ISSUE = ["page_id", "detected_by", "wcag_criterion", "wcag_level", "severity", "element_selector"]


def merge(rule_issues: DataFrame, found: DataFrame) -> DataFrame:
    """One table of ISSUE columns: rule issues, and normalised findings(detected_by: ai or vision_ai); vision findings go if a rule or ai issue of the page has their selector."""
    rules, ai = rule_issues.withColumn("detected_by", F.lit("rule")).select(ISSUE), found.where("detected_by = 'ai'").select(ISSUE)
    known = rules.where("element_selector <> ''").unionByName(ai)
    return rules.unionByName(ai).unionByName(drop_known(found.where("detected_by = 'vision_ai'").select(ISSUE), known))


def locate(issues: DataFrame, boxes: DataFrame) -> DataFrame:
    """Adds the bounding box with the issue's exact selector; of several the last counts."""
    last = boxes.groupBy("page_id", "selector").agg(F.max_by("bbox", "pos").alias("bbox"))
    return issues.join(last.withColumnRenamed("selector", "element_selector"), ["page_id", "element_selector"], "left")


def totals(findings: DataFrame) -> DataFrame:
    """(page_id, rule, ai, vision_ai): findings by source."""
    return findings.groupBy("page_id").pivot("detected_by", ["rule", "ai", "vision_ai"]).count().na.fill(0)


def with_default(replies: DataFrame, default: str) -> DataFrame:
    """replies(page_id, reply) with n_findings and summary; a reply that can't be read has none and the default summary."""
    found = parse_reply(F.col("reply"))
    return replies.select("page_id", F.coalesce(F.when(found.isNotNull(), F.size(found)), F.lit(0)).alias("n_findings"), F.when(found.isNull(), F.lit(default)).otherwise("findings read").alias("summary"))
