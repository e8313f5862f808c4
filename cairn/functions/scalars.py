"""Scalar functions of the vault, as column expressions; Python only where Spark has no builtin."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Id prefixes and the kind each one names; the longer prefix is tried first.
KINDS = {"op_": "operation", "c_": "capture", "n_": "note", "x_": "relationship_assertion", "k_": "claim_assertion", "e_": "entity", "g_": "community", "u_": "text_unit"}


def strip(c: Column | str) -> Column:
    """Without white space at both ends (SQL's trim takes blanks only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def fold_accents(c: Column) -> Column:
    """Latin letters without their accents, in the JVM; the table follows from canonical decomposition."""
    pairs = [(ch, d[0]) for ch in map(chr, range(0xC0, 0x250)) if len(d := unicodedata.normalize("NFD", ch)) > 1 and d[0].isascii()]
    return F.when(c.rlike(r"^\p{ASCII}*$"), c).otherwise(F.translate(c, "".join(a for a, _ in pairs), "".join(b for _, b in pairs)))


def _slug_ascii(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


@F.pandas_udf(T.StringType())
def _slug_unicode(s: pd.Series) -> pd.Series:
    plain = s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode().lower())
    return plain.str.replace(r"[^a-z0-9]+", "-", regex=True).str.strip("-")


def slugify(c: Column | str) -> Column:
    """Compatibility decomposition, ASCII only, lower case, runs of anything else as one hyphen; "" where nothing is left.

    ASCII input stays in the JVM. A batch with other input goes through a pandas UDF, as Spark has no normalization.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(r"^\p{ASCII}*$"), _slug_ascii(c)).otherwise(_slug_unicode(c))


def aggregate_key(source: Column, kind: Column, target: Column, symmetric: Column) -> Column:
    left = F.when(symmetric, F.least(source, target)).otherwise(source)
    right = F.when(symmetric, F.greatest(source, target)).otherwise(target)
    return F.concat(F.lit("r:"), left, F.lit("|"), kind, F.lit("|"), right)


def id_kind(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for prefix, kind in reversed(list(KINDS.items())):
        out = F.when(F.startswith(c, F.lit(prefix)), kind).otherwise(out)
    return out


def unit_id(capture: Column, ordinal: Column) -> Column:
    return F.format_string("u_%s_%04d", F.regexp_replace(capture, "^c_", ""), ordinal)


def unit_parent(unit: Column) -> Column:
    """The capture of a unit id; null where the id has another form."""
    stem = F.regexp_extract(unit, r"^u_(.+)_\d{4,}$", 1)
    return F.when(stem != "", F.concat(F.lit("c_"), stem))


def content_hash(c: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


#: Python's white space and line ends; Java's have fewer characters.
SPACES = r"[\s\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LINE_ENDS = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def first_line(c: Column | str, limit: int = 200) -> Column:
    """The first non-blank line, stripped and capped, with Unicode's white space and line ends; "" where there is none."""
    ends = rf"^{SPACES}+|{SPACES}+\z"
    lines = F.filter(F.transform(F.split(c, LINE_ENDS), lambda x: F.regexp_replace(x, ends, "")), lambda x: x != "")
    return F.coalesce(F.substring(F.try_element_at(lines, F.lit(1)), 1, limit), F.lit(""))


def is_valid_date(c: Column | str) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD of an existing day; ``unknown`` is judged by the caller. Null gives null."""
    c = F.col(c) if isinstance(c, str) else c
    month = F.substring(c, 6, 2).between("01", "12")
    return F.when(c.rlike(r"^\d{4}$"), True).when(c.rlike(r"^\d{4}-\d{2}$"), month).when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date").isNotNull()).when(c.isNotNull(), False)


def precision(c: Column | str) -> Column:
    n = F.length(c)
    return F.when(n == 4, "year").when(n == 7, "month").when(n == 10, "day")


def _prefix_compare(a: Column, b: Column) -> tuple[Column, Column]:
    n = F.least(F.length(a), F.length(b))
    return F.substring(a, F.lit(1), n), F.substring(b, F.lit(1), n)


def holds_at(valid_from: Column, valid_to: Column, as_of: str) -> Column:
    """Whether an interval of partial dates holds: bounds compare on the common prefix; no or an unknown upper bound is open."""
    day = F.lit(as_of)
    a, b = _prefix_compare(valid_from, day)
    x, y = _prefix_compare(day, valid_to)
    lower = valid_from.isNull() | (a <= b)
    upper = valid_to.isNull() | (valid_to == "unknown") | (x <= y)
    return lower & upper


def validity_text(valid_from: Column, valid_to: Column) -> Column:
    """A reader's description of an interval."""
    upper = F.when(valid_to == "unknown", "an unknown date").otherwise(valid_to)
    return F.when(valid_from.isNull() & valid_to.isNull(), "").when(valid_to.isNull(), F.concat(F.lit("since "), valid_from)).when(valid_from.isNull(), F.concat(F.lit("until "), upper)).otherwise(F.concat(valid_from, F.lit(" to "), upper))


def digit_signature(c: Column | str) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1))


def snippet(c: Column | str, limit: int = 200) -> Column:
    return F.substring(c, 1, limit)


def cited_ids(c: Column | str) -> Column:
    """Ids inside ``[Data: ...]`` brackets, each once in the order first seen."""
    inside = F.regexp_extract_all(c, F.lit(r"\[Data:([^\]]*)\]"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(inside, lambda x: F.regexp_extract_all(x, F.lit(r"\b([exkncgu]_[A-Za-z0-9_-]*[A-Za-z0-9_])"), F.lit(1)))))


def radius(rank: Column) -> Column:
    return F.least(F.lit(18.0), F.lit(4.0) + F.lit(2.0) * F.sqrt(F.greatest(rank.cast("double"), F.lit(0.0))))
