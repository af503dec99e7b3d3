"""Text handling of labels, names and marker lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def standard_label(c: Column) -> Column:
    """Null, blank and the names of rest give NOGESTURE; others in capitals without underscores and spaces."""
    rest = F.lower(c).isin("", "no_gesture", "nogesture", "none")
    return F.when(c.isNull() | rest, F.lit("NOGESTURE")).otherwise(F.translate(F.upper(c), "_ ", ""))


def has_digit(c: Column) -> Column:
    return c.rlike("[0-9]")


def lines_but_last(c: Column) -> Column:
    parts = F.split(c, "\n")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def position_values(c: Column) -> Column:
    """``key: value`` pairs of the lines that hold a digit, keys and values trimmed."""
    lines = F.filter(F.split(c, "\n"), lambda x: x.rlike("[0-9]"))
    return F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.substring_index(x, ":", -1)).alias("value")))


def before_underscore(c: Column) -> Column:
    """The part before the first underscore, all where there is none."""
    return F.substring_index(c, "_", 1)


def dataset_of_path(c: Column) -> Column:
    """The prefix of a file name up to its first underscore, else ``unknown``."""
    return F.when(c.contains("_"), F.substring_index(c, "_", 1)).otherwise(F.lit("unknown"))


def labels_of_path(c: Column) -> Column:
    """The labels a file name carries: none, one or two, whatever the case."""
    low = F.lower(c)
    no, move, manip = low.contains("nogesture"), low.contains("move"), low.contains("objman")
    each = F.array(F.when(no, F.lit("NoGesture")), F.when(~no & ~move & ~manip, F.lit("Gesture")), F.when(move, F.lit("Move")))
    return F.filter(each, lambda x: x.isNotNull())


def title(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def clip_name(video: Column, number: Column, label: Column, start: Column, end: Column) -> Column:
    return F.format_string("%s_segment_%d_%s_%.2f_%.2f.mp4", video, number, label, start, end)
