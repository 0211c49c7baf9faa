"""Report lines in fixed widths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The widths of the row label and of a codec's column.
LABEL, COLUMN = 20, 15
#: The widths of a BD rate, of a mean BD rate, of a codec before the means, and the longest source name.
RATE, MEAN, CODEC, NAME = 6, 22, 16, 80


def wide(text: Column, width: int, right: bool = True) -> Column:
    """Padded to a width; longer text stays whole."""
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, " ") if right else F.rpad(text, width, " "))


def shortened(name: Column, width: int = NAME) -> Column:
    """A name cut to a width with ... at its end."""
    return F.when(F.length(name) > width, F.concat(F.substring(name, 1, width - 3), F.lit("..."))).otherwise(name)


def fixed(value: Column, places: int) -> Column:
    """A double with so many decimals, rounded by its exact binary value, half to even: format_string alone takes a number like 28.325, a little less in binary, for a tie and rounds it up."""
    v, scale = F.abs(value), 10.0 ** (places + 1)
    k = F.round(v * scale)
    high = v * 134217729.0 - (v * 134217729.0 - v)  # the upper half of the digits; its product with scale is exact, as that of the rest
    over = (high * scale - k) + (v - high) * scale
    low = (k - 5) / 10
    tie = (k % 10 == 5) & (v == k / scale)
    exact = (F.when((over < 0) | ((over == 0) & (low % 2 == 0)), low).otherwise(low + 1)) / 10.0**places
    return F.format_string(f"%.{places}f", F.when(tie, F.signum(value) * exact).otherwise(value))


def mean_metric_text(metric: Column, value: Column, vmaf: Column) -> Column:
    """Two decimals; SSIM has five and the mean VMAF beside it. Means are taken to nine decimals first: the last bits of a sum depend on the order of its rows, which must not decide a tie like 29.665."""
    value, vmaf = F.round(value, 9), F.round(vmaf, 9)
    return F.when(F.upper(metric) == "SSIM", F.concat(fixed(value, 5), F.lit(" (mean VMAF "), fixed(vmaf, 2), F.lit(")"))).otherwise(fixed(value, 2))


def report_lines(reductions: DataFrame) -> DataFrame:
    """One line per slice: label, percent, and the metric's text."""
    label = wide(F.concat(F.lit("T "), F.col("target_value").cast("string"), F.lit("("), F.col("images").cast("string"), F.lit(")")), LABEL, False)
    line = F.concat(label, F.lit(":"), wide(F.concat(fixed(F.col("reduction"), 2), F.lit("%")), COLUMN), F.lit(" "), mean_metric_text(F.col("target_metric"), F.col("mean_metric"), F.col("mean_vmaf")))
    return reductions.select("sub_sampling", "codec", "target_value", line.alias("line"))


def bd_lines(rates: DataFrame, width: int = NAME) -> DataFrame:
    """One line per curve: its source, cut and padded, and the BD rate or the failure."""
    value = F.when(F.col("status") == "exception", F.lit("BD_RATE_EXCEPTION")).otherwise(wide(fixed(F.col("bd_rate"), 2), RATE))
    line = F.concat(wide(shortened(F.col("source"), width), width, False), F.lit(" "), F.col("codec"), F.lit(" BDRate-"), F.upper("metric"), F.lit(" "), value)
    return rates.select("sub_sampling", "metric", "codec", "source", line.alias("line"))


def bd_mean_lines(means: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """(sub_sampling, codec, line, row) of each codec's means: the labelled line, and the row of a table with a column per metric; nan where no source is left."""
    wide_rows = means.groupBy("sub_sampling", "codec").pivot("metric", list(metrics)).agg(F.first("bd_rate"))
    value = {m: F.when(F.col(m).isNull(), F.lit("nan")).otherwise(fixed(F.col(m), 2)) for m in metrics}
    head = wide(F.col("codec"), CODEC, False)
    line = F.concat(head, *[F.concat(F.lit(f"   Mean BDRate-{m.upper()} "), value[m]) for m in metrics])
    return wide_rows.select("sub_sampling", "codec", line.alias("line"), F.concat(head, *[wide(value[m], MEAN) for m in metrics]).alias("row"))


def report(images: DataFrame, reductions: DataFrame, every_image: bool = True, quiet: bool = False) -> DataFrame:
    """(seq, line) of a report: lines of the images, if wanted, and of the slices, if not quiet."""
    slices = report_lines(reductions).select(F.lit(1).alias("seq"), "line")
    line = F.concat(wide(F.col("source"), LABEL, False), F.lit(":"), wide(F.concat(fixed(F.col("reduction"), 2), F.lit("%")), COLUMN))
    rows = images.select(F.lit(0).alias("seq"), line.alias("line")).where(F.lit(every_image))
    return rows.union(slices.where(F.lit(not quiet)))
