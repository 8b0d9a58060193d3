"""CSS colours, luminance and contrast as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RGB = r"rgba?\(\s*([0-9]+)\s*,\s*([0-9]+)\s*,\s*([0-9]+)\s*(?:,\s*([0-9.]+)\s*)?\)"


def rgb(css: Column) -> Column:
    """struct(r, g, b) of an rgb()/rgba() colour; null if it isn't one or is fully transparent."""
    part = lambda i: F.regexp_extract(css, _RGB, i).try_cast("int")
    alpha = F.regexp_extract(css, _RGB, 4).try_cast("double")
    return F.when(part(1).isNotNull() & F.coalesce(alpha != 0, F.lit(True)), F.struct(part(1).alias("r"), part(2).alias("g"), part(3).alias("b")))


def luminance(r: Column, g: Column, b: Column) -> Column:
    def linear(c: Column) -> Column:
        s = c / 255.0
        return F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * linear(r) + 0.7152 * linear(g) + 0.0722 * linear(b)


def ratio(a: Column, b: Column) -> Column:
    """Contrast of two luminances."""
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def hex_rgb(css: Column) -> Column:
    """struct(r, g, b) of a #rrggbb colour; null if it isn't one."""
    bare = F.regexp_replace(css, "^#+", "")
    part = lambda i: F.conv(F.substring(bare, i, 2), 16, 10).cast("int")
    return F.when(bare.rlike("^[0-9a-fA-F]{6}"), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def hex_contrast(a: Column, b: Column) -> Column:
    """struct(ratio, aa, aa_large, aaa, aaa_large) of two hex colours; null if one can't be read."""
    x, y = hex_rgb(a), hex_rgb(b)
    v = ratio(luminance(x["r"], x["g"], x["b"]), luminance(y["r"], y["g"], y["b"]))
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(F.round(v, 2).alias("ratio"), (v >= 4.5).alias("aa"), (v >= 3).alias("aa_large"), (v >= 7).alias("aaa"), (v >= 4.5).alias("aaa_large")))


def weak_focus(focus_styles: DataFrame) -> DataFrame:
    """Captured focus styles whose outline contrasts with white by less than 3: the focus rule's issues."""
    c = rgb(F.col("outline_color"))
    v = ratio(luminance(c["r"], c["g"], c["b"]), F.lit(1.0))
    return focus_styles.withColumn("contrast", F.round(v, 4)).where(~F.col("has_outline_none") & (F.col("contrast") < 3))


def text_contrast(samples: DataFrame) -> DataFrame:
    """Contrast of captured text samples with their background (white if transparent), with pass marks."""
    x, y = rgb(F.col("color")), rgb(F.col("background_color"))
    back = F.when(y.isNull(), F.lit(1.0)).otherwise(luminance(y["r"], y["g"], y["b"]))
    v = F.round(ratio(luminance(x["r"], x["g"], x["b"]), back), 4)
    return samples.withColumn("contrast", v).withColumn("aa", F.col("contrast") >= 4.5).withColumn("aaa", F.col("contrast") >= 7)
