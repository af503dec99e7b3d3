"""Identifiers as people spell them: video ids and dataset names brought to one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def video_key(c: Column) -> Column:
    """``KV`` and seven digits from any spelling (case, paths, endings, separators, stray spaces).

    An id of another form keeps its letters and digits in capitals, without folder and file
    ending. Null and blank give null.
    """
    digits = F.regexp_extract(c, r"(?i)kv[^0-9a-zA-Z]{0,3}([0-9]{7})(?![0-9])", 1)
    base = F.regexp_replace(F.regexp_replace(c, r"^.*[/\\]", ""), r"\.[A-Za-z0-9]{2,4}\s*$", "")
    plain = F.upper(F.regexp_replace(base, r"[^A-Za-z0-9]", ""))
    return F.when(digits != "", F.concat(F.lit("KV"), digits)).when(plain != "", plain)


def video_key_sql(c: str) -> str:
    digits = f"regexp_extract({c}, '(?i)kv[^0-9a-zA-Z]{{0,3}}([0-9]{{7}})', 1)"
    plain = f"upper(regexp_replace(regexp_replace(regexp_replace({c}, '^.*[/\\\\]', ''), '\\.[A-Za-z0-9]{{2,4}}\\s*$', ''), '[^A-Za-z0-9]', '', 'g'))"
    return f"(CASE WHEN {digits} <> '' THEN 'KV' || {digits} WHEN {plain} <> '' THEN {plain} END)"


def dataset_key(c: Column) -> Column:
    """Letters, then five digits, in capitals; null where a name has no such form, as placeholders haven't."""
    plain = F.upper(F.regexp_replace(c, r"[^A-Za-z0-9]", ""))
    return F.when(plain.rlike(r"^[A-Z]+[0-9]{5}$"), plain)


def dataset_key_sql(c: str) -> str:
    plain = f"upper(regexp_replace({c}, '[^A-Za-z0-9]', '', 'g'))"
    return f"(CASE WHEN regexp_full_match({plain}, '[A-Z]+[0-9]{{5}}') THEN {plain} END)"
