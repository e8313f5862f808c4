"""Splitting oversized items at natural boundaries (problem 4): content-defined chunking.

A rolling hash over the last ``WINDOW`` characters marks landmarks, which depend on nothing but the text near them. A cut is
sought between the minimum and the maximum size of a piece: the first landmark there (without one, the maximum) snaps to the
nearest natural boundary: paragraph, sentence end, line or table row, or white space, where the distance to a stronger kind
weighs less. Without any boundary there the last one before the minimum is taken, and only a stretch longer than the maximum
is cut hard, at the maximum; ``forced`` tells whether that happened. As the landmarks fall into step again after an edit, an edit
alters only pieces near it.

The next piece of prose begins ``overlap`` characters before the cut, also after a hard one, or fewer where a stretch without
boundary would fit whole into the piece only so; table rows share nothing, so a row is not told twice. All positions count Unicode code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMIT, OVERLAP, MINIMUM = 1200, 150, 450
WINDOW, DIVISOR = 32, 192
#: kinds of boundary, from the strongest; a position is the number of characters before the cut
PARAGRAPH, SENTENCE, LINE, SPACE = 4, 3, 2, 1
BOUNDARIES = (
    (SPACE, re.compile(r"\s+")),
    (LINE, re.compile(r"[ \t]*(?:\r\n|\r|\n)")),
    (SENTENCE, re.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s)\s?|[。！？]+[」』”’]*")),
    (PARAGRAPH, re.compile(r"(?:\r\n|\r|\n)[ \t]*(?:(?:\r\n|\r|\n)[ \t]*)+")),
)
#: What a character of distance weighs by kind of boundary: a sentence end fifty characters away is as near as a blank at the landmark.
WEIGHT = np.array([np.inf, 100.0, 10.0, 2.0, 1.0])
ROW = re.compile(r"^[ \t]*\|", re.M)
SCHEMA = "piece int, start long, end long, text string, cut string, forced int"


def rolling_hash(text: str) -> np.ndarray:
    """For each position i the hash of the characters before it, as a sum of powers over the last WINDOW of them (mod 2**64)."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        mixed = (points + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        out = np.zeros(len(text) + 1, np.uint64)
        factor = np.uint64(1)
        for back in range(min(WINDOW, len(text))):
            out[back + 1 :] += mixed[: len(text) - back] * factor
            factor *= np.uint64(0x100000001B3)
        out ^= out >> np.uint64(31)
    return out


def boundaries(text: str) -> np.ndarray:
    """For each position 0..len the strongest natural boundary that lies there, 0 if none."""
    kind = np.zeros(len(text) + 1, np.int8)
    for strength, pattern in BOUNDARIES:
        for m in pattern.finditer(text):
            kind[m.end()] = strength
    return kind


def _run_end(places: np.ndarray, cut: int, n: int) -> int:
    """The next boundary after a cut, or the end of the text."""
    i = np.searchsorted(places, cut, "right")
    return int(places[i]) if i < len(places) else n


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP, minimum: int = MINIMUM) -> list[tuple[int, int, str]]:
    """Pieces (start, end, kind of the cut that ends it) of a text; one piece if it is within the limit.

    The pieces cover the text, each is at most ``limit`` long, and the end rises from piece to piece.
    """
    if not 0 <= overlap < minimum < limit:
        raise ValueError("0 <= overlap < minimum < limit")
    n = len(text)
    if n <= limit:
        return [(0, n, "end")]
    kind, marks = boundaries(text), np.flatnonzero(rolling_hash(text) % np.uint64(DIVISOR) == 0)
    names = {PARAGRAPH: "paragraph", SENTENCE: "sentence", LINE: "line", SPACE: "space"}
    places = np.flatnonzero(kind)
    pieces, start, last = [], 0, 0
    while n - start > limit:
        low, high = start + minimum, start + limit
        here = places[np.searchsorted(places, low) : np.searchsorted(places, high, "right")]
        cut, how = high, "hard"
        if len(here):
            inside = marks[np.searchsorted(marks, low) : np.searchsorted(marks, high, "right")]
            aim = int(inside[0]) if len(inside) else high
            cut = int(here[np.argmin((np.abs(here - aim) + 1) * WEIGHT[kind[here]])])  # the nearest, a stronger kind from further away
            how = names[int(kind[cut])]
        else:
            before = places[: np.searchsorted(places, low)]
            if len(before) and (at_run := int(before[-1])) > last:
                if at_run > start + overlap or _run_end(places, at_run, n) - at_run <= limit:
                    cut, how = at_run, names[int(kind[at_run])]
        if how == "hard" and re.match(r"[\s。！？]", text[cut]):  # the run ends right there
            how = "space" if text[cut].isspace() else "sentence"
        pieces.append((start, cut, how))
        row = how == "line" and ROW.match(text, cut) is not None
        start = cut if row else cut - overlap
        if start < cut and start + limit < (end := _run_end(places, cut, n)) <= cut + limit:
            start = end - limit
        last = cut
    pieces.append((start, n, "end"))
    return pieces


def _pieces(batches: Iterator, limit: int, overlap: int, minimum: int) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        names = batch.schema.names
        rows: list[int] = []
        out: list[tuple] = []
        for r, text in enumerate(batch.column(names.index("_text")).to_pylist()):
            if text is None:
                continue
            cuts = split(text, limit, overlap, minimum)
            is_forced = int(any(how == "hard" for _, _, how in cuts))
            for i, (a, b, how) in enumerate(cuts):
                rows.append(r)
                out.append((i, a, b, text[a:b], how, is_forced))
        kept = batch.select([c for c in names if c != "_text"]).take(pa.array(rows, pa.int64()))
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        types = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32())
        yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[*kept.schema.names, "piece", "start", "end", "text", "cut", "forced"])


def split_items(items: DataFrame, text: str, keep: list[str], limit: int = LIMIT, overlap: int = OVERLAP, minimum: int = MINIMUM) -> DataFrame:
    """The pieces of every item: ``keep``, then piece (0-based), start, end, text, cut, forced.

    An item within the limit is one piece (an empty text too), a null text has none, repeated rows give repeated pieces.
    ``cut`` says what ends the piece: paragraph, sentence, line, space, hard or end.
    """
    source = items.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "_text")
    return source.mapInArrow(lambda it: _pieces(it, limit, overlap, minimum), f"{schema}, {SCHEMA}")


def distinct_units(units: DataFrame) -> DataFrame:
    """One row for each unit id: its first delivery that has a text. Text and positions come from the same row."""
    first = F.struct(F.col("text").isNull(), "arrived_at", "start_pos", "end_pos", "locator", "text")
    return units.groupBy("id").agg(F.min(first).alias("u")).select("id", "u.locator", "u.start_pos", "u.end_pos", "u.text")


def oversized_pieces(units: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the units over ``limit`` characters: id, locator, piece, start, end, capture_start, capture_end, text, cut, forced.

    start and end are positions in the unit's text. Those in the capture are given only where the unit's own positions
    agree with the length of its text; stale and missing positions give nulls, as the text rules.
    """
    # a repeated unit is dropped before its text travels: only oversized texts are shuffled
    big = units.filter(F.length("text") > limit)
    big = distinct_units(big)
    sound = (F.col("end_pos") - F.col("start_pos")) == F.length("text")
    big = big.withColumn("_at", F.when(sound, F.col("start_pos").cast("long")))
    pieces = split_items(big, "text", ["id", "locator", "_at"], limit, overlap)
    return pieces.select("id", "locator", "piece", "start", "end", (F.col("_at") + F.col("start")).alias("capture_start"), (F.col("_at") + F.col("end")).alias("capture_end"), "text", "cut", "forced")


def shared_ends(pieces: DataFrame) -> DataFrame:
    """Pieces with ``shared``, the characters that a piece has in common with the one before it."""
    w = Window.partitionBy("id").orderBy("piece")
    return pieces.withColumn("shared", F.coalesce(F.lag("end").over(w) - F.col("start"), F.lit(0)))
