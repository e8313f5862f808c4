"""Text units of a document: stretches of at most 1,200 characters.

Two steps, both over spans of one document only, so documents are independent and travel one by one through an Arrow pass:

* ``sections``: a run of headings joins the block after it, as a heading belongs to what it introduces. A section above the
  budget is told apart from the others here.
* ``units``: neighbouring sections within the budget are merged greedily while the whole stretch, from the first one's start to the
  last one's end, stays within it; each section above the budget is cut by its block's kind.

Offsets are carried by the spans. For rendered blocks they are those of the rendering, for bare text those of the text itself, with
the budget measured on what a rendering of its paragraphs would have between them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.sources.parsers import from_row, rendering

BUDGET, OVERLAP = 1200, 150
SENTENCE_END = re.compile(r"[.!?](?=\s|$)|[。！？]")
UNIT = "ordinal int, start int, end int, locator struct<kind:string,label:string,index:int>"
BLANK_LINES = re.compile(r"(?:\r\n|\r(?!\n)|\n)\s*(?:\r\n|\r|\n)")
HEADING = r"(?m)^## ((?:Page|Slide|Sheet|Line) .+?)\s*$"


@dataclass(frozen=True)
class Span:
    """A stretch start..end of a text, what it holds, where that came from, and where it lies in the rendering (``at``)."""

    start: int
    end: int
    kind: str
    locator: dict | None
    at: int

    @property
    def size(self) -> int:
        return self.end - self.start


def sections(spans: list[Span]) -> Iterator[list[Span]]:
    """Blocks with the heading before them; of several headings in a row each but the last stands alone."""
    for i, span in enumerate(spans):
        if span.kind == "heading" and i + 1 < len(spans) and spans[i + 1].kind != "heading":
            continue
        yield spans[i - 1 : i + 1] if i and spans[i - 1].kind == "heading" and span.kind != "heading" else [span]


def places_to_cut(text: str, kind: str) -> Iterator[tuple[int, int]]:
    """(end, next start) of the pieces of a stretch above the budget but the last, one after another.

    Prose ends at its last sentence end that leaves more than the overlap, else at its last blank, else at the budget, and the next
    piece begins the overlap before. A table ends at a row's end; anything else at a line's end, else at a blank; what follows begins
    at its first character that isn't white space.
    """
    begin = 0
    while len(text) - begin > BUDGET:
        head = text[begin : begin + BUDGET]
        if kind == "paragraph":
            ends = (*(m.end() for m in SENTENCE_END.finditer(head, OVERLAP)), -1)
            size = max(e for e in ends if e > OVERLAP or e < 0)
            size = next(n for n in (size, head.rfind(" "), BUDGET) if n > OVERLAP)
            follows = begin + size - OVERLAP
        else:
            signs = ("\n",) if kind == "table" else ("\n", " ")
            size = next((n for n in map(head.rfind, signs) if n > 0), BUDGET)
            follows = begin + size
            follows += len(text) - follows - len(text[follows:].lstrip())
        yield begin + size, follows
        begin = follows


def units(text: str, spans: list[Span]) -> list[tuple[int, int, dict | None]]:
    """(start, end, locator of the first block) of the units of a text whose blocks are ``spans``; the last one ends with the text."""
    out: list[tuple[int, int, dict | None]] = []
    limit = None  # where in the rendering the open unit must end
    for section in sections(spans):
        first, last = section[0], section[-1]
        if last.at + last.size - first.at > BUDGET:
            cuts = list(places_to_cut(text[first.start : last.end], last.kind))
            begins, ends = [0, *(b for _, b in cuts)], [*(e for e, _ in cuts), last.end - first.start]
            out += [(first.start + b, first.start + e, first.locator) for b, e in zip(begins, ends, strict=True) if b < e]
            limit = None
        elif limit is not None and last.at + last.size <= limit:
            out[-1] = (out[-1][0], last.end, out[-1][2])
        else:
            out.append((first.start, last.end, first.locator))
            limit = first.at + BUDGET
    return [*out[:-1], (out[-1][0], len(text), out[-1][2])] if out else []


def of_blocks(blocks: list[dict]) -> list[tuple[int, int, dict | None]]:
    """Units of a document's rendering."""
    parts = rendering(blocks)
    starts = accumulate((len(p) + 2 for p in parts), initial=0)
    return units("\n\n".join(parts) + "\n", [Span(a, a + len(p), b["kind"], b["locator"], a) for a, p, b in zip(starts, parts, blocks, strict=False)])


def of_text(text: str) -> list[tuple[int, int]]:
    """Units of a bare text, as a document of its paragraphs would have them, in the text's own offsets (C4); an empty text is one unit."""
    found = paragraph_spans(text)
    at = accumulate((e - a + 2 for a, e in found), initial=0)
    got = units(text, [Span(a, e, "paragraph", None, r) for (a, e), r in zip(found, at, strict=False)])
    return [(a, e) for a, e, _ in got] if len(got) > 1 else [(0, len(text))]


def paragraph_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of each paragraph in the text as it stands, whatever its line ends, without line ends around it."""
    spans, at = [], 0
    for end, after in [*(m.span() for m in BLANK_LINES.finditer(text)), (len(text), len(text))]:
        p = text[at:end]
        if p.strip():
            spans.append((at + len(p) - len(p.lstrip("\r\n")), at + len(p.rstrip("\r\n"))))
        at = after
    return spans


def text_units(documents: DataFrame, key: str, text: str) -> DataFrame:
    """key, ordinal, start, end of the units of plain texts; null texts have none, an empty one has one empty unit."""
    kind = documents.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(k, i, a, z) for k, t in zip(pdf[key], pdf[text], strict=True) if t is not None for i, (a, z) in enumerate(of_text(t))]
            yield pd.DataFrame(rows, columns=[key, "ordinal", "start", "end"])

    return documents.select(key, text).mapInPandas(run, f"`{key}` {kind}, ordinal int, start int, end int")


def block_units(blocks: DataFrame) -> DataFrame:
    """doc_id, ordinal, start, end, locator of the units of documents given as rows of blocks (doc_id, ordinal, kind, text, level, locator).

    A document's blocks travel as one array; a document is bounded by its parser, not by the corpus.
    """
    docs = blocks.filter("doc_id is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "kind", "text", "level", "locator"))).alias("b"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for k, bs in zip(pdf["doc_id"], pdf["b"], strict=True):
                rows += [(k, i, a, z, at) for i, (a, z, at) in enumerate(of_blocks([from_row(x) for x in bs]))]
            yield pd.DataFrame(rows, columns=["doc_id", "ordinal", "start", "end", "locator"])

    return docs.mapInPandas(run, f"doc_id long, {UNIT}")


def unit_locator(text: Column, start: Column) -> Column:
    """The locator heading at the start of a unit, else the last one before it."""
    own = F.regexp_extract(F.substring(text, start + 1, F.lit(BUDGET)), r"^\s*## ((?:Page|Slide|Sheet|Line) [^\n]+?)[ \t]*(?:\n|$)", 1)
    before = F.regexp_extract_all(F.substring(text, F.lit(1), start), F.lit(HEADING), F.lit(1))
    return F.when(own != "", own).otherwise(F.try_element_at(before, F.lit(-1)))
