"""Column functions over single snippets of markup, selectors and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Roles that need a label.
LABEL_REQUIRED_ROLES = ["dialog", "alertdialog", "navigation", "region", "form", "complementary", "search"]


def normal_text(text: Column) -> Column:
    """Lower case, trimmed, white space collapsed; null is empty."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(F.lower(text), r"^\s+|\s+$", ""), r"\s+", " "), F.lit(""))


def selector_tag(selector: Column) -> Column:
    """The tag that a selector begins with; null if it begins with none."""
    return F.nullif(F.lower(F.regexp_extract(selector, "^([a-zA-Z][a-zA-Z0-9]*)", 1)), F.lit(""))


def markup_tag(html: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(html, r"^\s*<([a-zA-Z][a-zA-Z0-9]*)", 1)), F.lit(""))


def markup_attribute(html: Column, name: str) -> Column:
    """The first quoted value of an attribute; null if it has none."""
    rx = rf"(?i){name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
    return F.when(html.rlike(rx), F.concat(F.regexp_extract(html, rx, 1), F.regexp_extract(html, rx, 2)))


def aria_problems(html: Column) -> Column:
    """Array of the problems of a snippet's ARIA attributes: unlabelled role, bad aria-hidden, hidden yet focusable."""
    role = F.regexp_extract(html, "role=[\"']([^\"']+)[\"']", 1)
    hidden = F.regexp_extract(html, "aria-hidden=[\"']([^\"']+)[\"']", 1)
    tabindex = F.regexp_extract(html, "tabindex=[\"'](-?[0-9]+)[\"']", 1).try_cast("int")
    unlabelled = role.isin(LABEL_REQUIRED_ROLES) & ~html.contains("aria-label=") & ~html.contains("aria-labelledby=")
    return F.array_compact(
        F.array(
            F.when(unlabelled, F.concat(F.lit("label missing for role "), role)),
            F.when(~hidden.isin("", "true", "false"), F.concat(F.lit("aria-hidden can't be "), hidden)),
            F.when(html.contains('aria-hidden="true"') & (tabindex >= 0), F.lit("hidden element takes focus")),
        )
    )
