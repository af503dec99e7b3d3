"""Label spelling: from what annotators and exports write to one of the classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLASSES = ("NoGesture", "Gesture", "Move")

# Letters of other scripts that look like Latin ones.
_LOOKALIKES = "аеорсухіјѕԁвнкмтгοαερυντκιıſɡ"
_LATIN = "aeopcyxijsdbhkmtgoaepuvtkiisg"


def translation() -> tuple[str, str]:
    """Source and target characters: full-width forms by rule, look-alikes by the list above, in both cases."""
    wide_upper = "".join(chr(0xFF21 + i) for i in range(26))
    wide_lower = "".join(chr(0xFF41 + i) for i in range(26))
    ascii_lower = "".join(chr(97 + i) for i in range(26))
    upper = [(a.upper(), b) for a, b in zip(_LOOKALIKES, _LATIN) if len(a.upper()) == 1 and a.upper() not in _LOOKALIKES and not a.upper().isascii()]
    src = wide_upper + wide_lower + _LOOKALIKES + "".join(a for a, _ in upper)
    dst = ascii_lower + ascii_lower + _LATIN + "".join(b for _, b in upper)
    keep: dict[str, str] = {}
    for a, b in zip(src, dst):
        keep.setdefault(a, b)
    return "".join(keep), "".join(keep.values())


def letters(label: Column) -> Column:
    """Lower-case Latin letters of a label, look-alikes resolved, all else removed."""
    src, dst = translation()
    return F.regexp_replace(F.lower(F.translate(label, src, dst)), "[^a-z]", "")


def _same_letters(s: Column, word: str) -> Column:
    return F.array_sort(F.split(s, "")) == F.array_sort(F.split(F.lit(word), ""))


def label_class(label: Column) -> Column:
    """The class a label names in any spelling, or null where it names none.

    Case, spacing, punctuation, invisible and full-width characters and look-alike
    letters do not matter; beyond that one wrong, missing, added or two swapped letters
    are forgiven (two wrong ones in the long names). Null, blank and placeholders give null.
    """
    s = letters(label)
    dn, dg, dm = (F.levenshtein(s, F.lit(w)) for w in ("nogesture", "gesture", "move"))
    long_name = F.length(s).between(5, 12)
    fuzzy = (
        F.when((dm <= 1) | ((dm == 2) & _same_letters(s, "move")), F.lit("Move"))
        .when(long_name & (F.least(dn, dg) <= 2), F.when((dn < dg) | ((dn == dg) & s.rlike("^[no]")), F.lit("NoGesture")).otherwise(F.lit("Gesture")))
    )
    return F.when(label.isin(*CLASSES), label).otherwise(fuzzy)


def label_class_sql(col: str) -> str:
    """The same rule as a DuckDB expression."""
    src, dst = translation()
    s = f"regexp_replace(lower(translate({col}, '{src}', '{dst}')), '[^a-z]', '', 'g')"
    return (
        f"(CASE WHEN {col} IN ('NoGesture','Gesture','Move') THEN {col} "
        f"WHEN levenshtein({s},'move') <= 1 OR (levenshtein({s},'move') = 2 AND list_sort(string_split({s},'')) = list_sort(string_split('move',''))) THEN 'Move' "
        f"WHEN length({s}) BETWEEN 5 AND 12 AND least(levenshtein({s},'nogesture'), levenshtein({s},'gesture')) <= 2 THEN "
        f"CASE WHEN levenshtein({s},'nogesture') < levenshtein({s},'gesture') OR (levenshtein({s},'nogesture') = levenshtein({s},'gesture') AND regexp_matches({s},'^[no]')) THEN 'NoGesture' ELSE 'Gesture' END END)"
    )
