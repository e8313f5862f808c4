"""Markup residue in text (problem 3): find it and turn it into clean, structured text.

A block's text is read into a tree of nodes, nested by their spans: every stretch that is or might be a construct of HTML,
Markdown, wiki text or LaTeX. Candidates are taken generously: a price between two dollar signs, a comparison, an
underscore in a file name or a tag of any name are nodes like the rest. Gradient-boosted trees judge every node from its
features (delimiters and what stands around them, attribute tokens, depth, subtree density, siblings), and a decoding
over the tree takes the best consistent choice: what lies inside raw content (code, formulas, comments) that was chosen is
shadowed by it. Their verdict is final. The data has no labels for markup, so the trees are fitted here, in numpy, on blocks that
this module writes itself: it knows which characters it wrote as markup and which as words, and that alone labels the nodes.

Accepted nodes are then rendered: headings, list items, code, tables and formulas keep their kind and level, the rest of the
markup goes and its text stays.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.entities import html5

import numpy as np
from pyspark.sql import DataFrame

#: Element names of HTML, with the wiki extensions that are written as elements.
ELEMENTS = frozenset(
    "a abbr address area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup data dd del details dfn dialog div dl dt em embed fieldset figcaption figure font footer form frame frameset "
    "gallery h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark math menu meta nav noscript nowiki object ol option p param picture pre progress q ref references rp rt ruby s samp script section select "
    "small source span strike strong style sub summary sup svg syntaxhighlight table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr".split()
)
#: LaTeX commands that stand without an argument.
BARE = frozenset("item par noindent maketitle tableofcontents centering hline newline newpage clearpage LaTeX TeX ldots dots cdots quad qquad le ge leq geq neq sum int prod alpha beta gamma delta lambda mu pi sigma omega times cdot pm infty in to small large bf it em".split())
ATTR = r"""(?:\s+[A-Za-z_:][\w:.-]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>=]+))?)"""
TAG = re.compile(rf"""<(/?)([A-Za-z][A-Za-z0-9]*)((?:{ATTR})*)\s*(/?)>""")
CUT = re.compile(r"""<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s[^<>]*)?)\Z""")
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<![A-Za-z][^<>]*>|<\?.*?\?>", re.S)
CHARREF = re.compile(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
FENCE = re.compile(r"^ {0,3}(```+|~~~+)[ \t]*([\w+-]*)[ \t]*$\n?(.*?)(?:^ {0,3}\1[ \t]*$|\Z)", re.M | re.S)
SETEXT = re.compile(r"^([^\n]*\S[^\n]*)\n(=+|-{2,})[ \t]*$", re.M)
BOOLEAN = frozenset("disabled checked hidden selected required readonly open async defer multiple controls nowrap".split())

SUSPECT = re.compile(r"[<&*_$\[\\#|=~{`>]|''|'\d|^\s*(?:[-+;:!]|\d{1,3}[.)])[ \t]|^[ \t]*-[ \t-]*$", re.M)


@dataclass
class Node:
    """A stretch of text that is or resembles a construct. ``keep``: the spans of content inside it; ``put``: text in its place.

    ``mark``: (kind, level) of the part that its content becomes; "" ends a part. ``raw``: its content isn't read as markup."""

    family: str
    start: int
    end: int
    keep: tuple[tuple[int, int], ...] = ()
    put: str = ""
    mark: tuple[str, int | None] | None = None
    raw: bool = False
    sure: bool = True  # found by a narrow pattern; only decides which of two crossing candidates stays
    depth: int = 0
    parent: int = -1
    children: list[int] = field(default_factory=list)


FAMILIES = (
    "switch tag cut comment charref heading setext rule emphasis strike link image reference definition footnote marker task quote span fence row escape wikilink template wikiquote wikihead wikitable wikilist extlink command environment math texquote texescape accent lookalike_lt "
    "lookalike_amp lookalike_star lookalike_under lookalike_dollar lookalike_bracket lookalike_back lookalike_hash lookalike_pipe lookalike_eq lookalike_tilde lookalike_brace lookalike_tick"
).split()
#: What the trees see of a family is the sign it is written with, not the grammar's verdict.
SIGNS = {"<": 0, "&": 1, "*": 2, "_": 3, "$": 4, "[": 5, "\\": 6, "#": 7, "|": 8, "=": 9, "~": 10, "{": 11, "`": 12, "'": 13, "-": 14, ">": 15, "!": 16, ";": 17, ":": 18, "+": 19}

INLINE_RULES: list[tuple[str, re.Pattern, int | None, bool]] = [  # family, pattern, group kept, raw
    ("math", re.compile(r"\$\$(.+?)\$\$", re.S), 1, True),
    ("math", re.compile(r"(?<![A-Za-z0-9\u00c0-\u024f_\\$])\$(?![\s$])([^$\n]*?(?:[\\^_={}+<>][^$\n]*?)|[A-Za-z]{1,3})(?<!\s)\$(?![A-Za-z0-9\u00c0-\u024f_$])"), 1, True),
    ("math", re.compile(r"\\\((.+?)\\\)|\\\[(.+?)\\\]", re.S), 1, True),
    ("command", re.compile(r"\\verb\*?([^\w\s*])(.+?)\1"), 2, True),
    ("texquote", re.compile(r"``([^`'\n]+)''"), 1, False),
    ("span", re.compile(r"(?<!`)(`+)(?!`)([^`\n]+)(?<!`)\1(?!`)"), 2, True),
    ("template", re.compile(r"\{\{[^{}]+\}\}"), None, True),
    ("image", re.compile(r"!\[([^\]\n]*)\](?:\([^()\s]+(?:\s+\"[^\"]*\")?\)|\[[^\]\n]*\])"), 1, False),
    ("wikilink", re.compile(r"\[\[(?:[^\[\]|\n]*\|)*([^\[\]|\n]+)\]\]"), 1, False),
    ("extlink", re.compile(r"\[(?:https?|ftp|mailto):[^\s\]]+(?:\s+([^\]\n]+))?\]"), 1, False),
    ("footnote", re.compile(r"\[\^[^\]\s]+\]:?"), None, True),
    ("link", re.compile(r"\[([^\[\]\n]*)\]\([^()\s]*(?:\([^()\s]*\)[^()\s]*)*(?:\s+\"[^\"]*\")?\)"), 1, False),
    ("reference", re.compile(r"\[([^\[\]\n]*[^\W\d][^\[\]\n]*)\]\s?\[[^\[\]\n]*\]"), 1, False),
    ("link", re.compile(r"<((?:https?|ftp|mailto):[^<>\s]+|[\w.+-]+@[\w-]+\.[\w.-]+)>"), 1, False),
    ("emphasis", re.compile(r"(?<![A-Za-z0-9\u00c0-\u024f_*\\])(\*{1,3})(?![\s*])([^*\n]+?)(?<![\s*\\])\1(?![A-Za-z0-9\u00c0-\u024f_*])"), 2, False),
    ("emphasis", re.compile(r"(?<![A-Za-z0-9\u00c0-\u024f_\\])(_{1,3})(?![\s_])([^_\n]+?)(?<![\s_\\])\1(?![A-Za-z0-9\u00c0-\u024f_])"), 2, False),
    ("strike", re.compile(r"~~(?![\s~])([^~\n]+?)(?<!\s)~~"), 1, False),
    ("wikiquote", re.compile(r"(?<!')('{2,5})(?!')([^'\n]+(?:'[^'\n]+)*?)\1(?!')"), 2, False),
    ("switch", re.compile(r"__[A-Z]{2,}__|~{3,5}(?!\w)"), None, True),
    ("accent", re.compile(r"\\(['`^\"~=.])(?:\{([A-Za-z])\}|([A-Za-z]))"), None, True),
    ("texescape", re.compile(r"\\([%&$#{}])"), 1, True),
    ("escape", re.compile(r"(?<!\\)\\([*_\[\]()`~>+.!|#-])"), 1, True),
    ("escape", re.compile(r"(?<!\\)(?<!:)\\\\(?!\w)"), None, True),
]
ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307"}
LINE_RULES: list[tuple[str, re.Pattern, int | None, tuple | None]] = [
    ("heading", re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S.*?)(?:[ \t]+#+)?[ \t]*$", re.M), 2, ("heading", None)),
    ("wikihead", re.compile(r"^(={1,6})[ \t]*([^=\n]+?)[ \t]*\1[ \t]*$", re.M), 2, ("heading", None)),
    ("switch", re.compile(r"^#[A-Z]{4,}(?=\s)", re.M), None, None),
    ("rule", re.compile(r"^ {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$", re.M), None, None),
    ("quote", re.compile(r"^ {0,3}(>+[ \t]?)(?=\S)", re.M), None, None),
    ("definition", re.compile(r"^ {0,3}\[[^\]\n^][^\]\n]*\]:[ \t]*\S+.*$", re.M), None, None),
    ("task", re.compile(r"^[ \t]*[-+*][ \t]+\[[ xX]\](?=\s)", re.M), None, ("list_item", None)),
    ("marker", re.compile(r"^[ \t]*[-+*][ \t]+(?=[^\s|])", re.M), None, ("list_item", None)),
    ("marker", re.compile(r"^[ \t]*\d{1,3}[.)][ \t]+(?=\S)", re.M), None, ("list_item", None)),
    ("wikilist", re.compile(r"^(?:\*{2,}|[*#:;]*[;:])[ \t]+(?=\S)", re.M), None, ("list_item", None)),
    ("wikitable", re.compile(r"^(?:\{\|.*|\|\}.*|\|-(?!-).*)$", re.M), None, None),
    ("row", re.compile(r"^[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)+\|?[ \t]*$", re.M), None, None),
    ("row", re.compile(r"^[ \t]*\|(?![}-])(.*?)\|?[ \t]*$", re.M), 1, ("table", None)),
    ("row", re.compile(r"^!(?![\[!])[ \t]*(\S.*)$", re.M), 1, ("table", None)),
]
#: What might be a construct; a candidate of these gives way to one of the narrow patterns that it crosses.
GENEROUS: list[tuple[str, re.Pattern, int | None]] = [
    ("math", re.compile(r"\$([^$\n]{0,80})\$"), 1),
    ("emphasis", re.compile(r"(\*{1,3})([^*\n]{1,80})\1"), 2),
    ("emphasis", re.compile(r"(_{1,3})([^_\n]{1,80})\1"), 2),
    ("strike", re.compile(r"(~{1,2})([^~\n]{1,80})\1"), 2),
    ("span", re.compile(r"`([^`\n]{1,80})[`']"), 1),
    ("heading", re.compile(r"^[ \t]*#{1,6}(?=\w)(.*)$", re.M), 1),
    ("wikihead", re.compile(r"==+([^=\n]{1,80})==+"), 1),
    ("lookalike_lt", re.compile(r"<(?:[^<>\n]{0,40}>)?"), None),
    ("lookalike_amp", re.compile(r"&\w*;?"), None),
    ("lookalike_star", re.compile(r"\*+"), None),
    ("lookalike_under", re.compile(r"(?<=\w)_+\w*"), None),
    ("lookalike_dollar", re.compile(r"\$[^$\s]*"), None),
    ("lookalike_bracket", re.compile(r"\[[^\[\]\n]{0,60}\]"), None),
    ("lookalike_back", re.compile(r"\\\S*"), None),
    ("lookalike_hash", re.compile(r"#+\w*"), None),
    ("lookalike_pipe", re.compile(r"\|"), None),
    ("lookalike_eq", re.compile(r"={2,}"), None),
    ("lookalike_tilde", re.compile(r"~+[^\s~]*"), None),
    ("lookalike_brace", re.compile(r"\{[^{}\n]{0,60}\}?"), None),
    ("lookalike_tick", re.compile(r"`+|'(?=\d)"), None),
]


def _known_tag(m: re.Match) -> bool:
    name, attrs = m.group(2).lower(), m.group(3)
    bare = re.findall(r"(?<![=\w\"'])\s([A-Za-z_:][\w:.-]*)(?=\s|$)(?!\s*=)", re.sub(r"=\s*(\"[^\"]*\"|'[^']*'|\S+)", "=", attrs))
    return name in ELEMENTS and all(b.lower() in BOOLEAN for b in bare)


def _pairs(text: str) -> list[Node]:
    """Elements of HTML as nodes: an opening tag with its closing one, or a tag that stands alone."""
    nodes, open_ = [], []
    for m in TAG.finditer(text):
        name = m.group(2).lower()
        if not _known_tag(m):  # of an unknown name or with bare words: one candidate for itself
            nodes.append(Node("tag", m.start(), m.end(), sure=False))
            continue
        if m.group(1):
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    for inner, a, b in open_[k + 1 :]:  # left open: they end where the outer one does
                        nodes.append(_element(inner, a, b, m.start(), m.start()))
                    _, a, b = open_[k]
                    del open_[k:]
                    nodes.append(_element(name, a, b, m.start(), m.end()))
                    break
            else:
                nodes.append(_element(name, m.start(), m.end(), m.end(), m.end()))
        elif m.group(4) or name in ("br", "hr", "img", "input", "link", "meta", "wbr", "col"):
            nodes.append(Node("tag", m.start(), m.end(), put="\n" if name in ("br", "hr") else _alt(m.group(3)) if name == "img" else ""))
        else:
            if name in ("li", "dt", "dd", "tr", "td", "th", "option") and open_ and open_[-1][0] == name:  # the next one ends it
                _, a, b = open_.pop()
                nodes.append(_element(name, a, b, m.start(), m.start()))
            open_.append((name, m.start(), m.end()))
    for name, a, b in open_:  # never closed
        nodes.append(_element(name, a, b, b, b))
    return nodes


def _alt(attrs: str) -> str:
    m = re.search(r"alt\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", attrs)
    return (m.group(1) or m.group(2) or "") if m else ""


def _element(name: str, start: int, inner: int, stop: int, end: int) -> Node:
    """A node for an element whose content is inner..stop (empty for a tag alone)."""
    keep = ((inner, stop),) if stop > inner else ()
    if name in ("style", "script", "template"):
        return Node("tag", start, end, raw=True)
    mark: tuple | None = None
    put = ""
    if name in ("td", "th"):
        put = " | "
    if re.fullmatch("h[1-6]", name):
        mark = ("heading", int(name[1]))
    elif name in ("pre", "syntaxhighlight"):
        mark = ("code", None)
    elif name in ("li", "dt", "dd"):
        mark = ("list_item", None)
    elif name in ("tr", "caption"):
        mark = ("table", None)
    elif name in ("p", "div", "ul", "ol", "dl", "table", "blockquote", "section", "article", "center", "tbody", "thead"):
        mark = ("", None)
    return Node("tag", start, end, keep, put, mark, raw=name in ("nowiki", "math"))


def parse(text: str) -> list[Node]:
    """The nodes of a text as a tree (``parent`` and ``children`` are indices; parents come first). Crossing stretches: the earlier wins, of equal starts the longer."""
    nodes = _pairs(text) if "<" in text else []
    for m in COMMENT.finditer(text) if "<" in text else ():
        nodes.append(Node("comment", m.start(), m.end(), raw=True))
    if (cut := text.rfind("<")) >= 0 and (m := CUT.match(text, cut)) and m.group(2).lower() in ELEMENTS and ">" not in re.sub(r"\"[^\"]*\"|'[^']*'", "", m.group(3)):
        nodes.append(Node("cut", m.start(), m.end(), raw=True))
    for m in CHARREF.finditer(text) if "&" in text else ():
        name = m.group()[1:]
        nodes.append(Node("charref", m.start(), m.end(), put=html.unescape(m.group()), raw=True, sure=name[0] == "#" or name in html5))
    for m in FENCE.finditer(text) if "```" in text or "~~~" in text else ():
        nodes.append(Node("fence", m.start(), m.end(), ((m.start(3), m.end(3)),), "", ("code", None), raw=True))
    for m in SETEXT.finditer(text) if "\n=" in text or "\n--" in text else ():
        if not re.match(r"\s*[|>#-]", m.group(1)):
            nodes.append(Node("setext", m.start(), m.end(), ((m.start(1), m.end(1)),), "", ("heading", 1 if m.group(2)[0] == "=" else 2)))
    if "\\" in text:
        nodes += _latex(text)
    for (family, pattern, group, raw), sign in zip(INLINE_RULES, INLINE_SIGNS, strict=True):
        if sign not in text and not (sign == "__" and "~~~" in text):
            continue
        for m in pattern.finditer(text):
            keep, put = (), ""
            if group is not None and (g := next((i for i in range(group, m.re.groups + 1) if m.group(i) is not None), None)):
                keep = ((m.start(g), m.end(g)),)
            if family == "wikilink" and re.match(r"\[\[(?:Category|File|Image):", m.group()):
                keep = () if m.group()[2] == "C" else keep
            if family == "accent":
                import unicodedata

                put = unicodedata.normalize("NFC", (m.group(2) or m.group(3)) + ACCENTS[m.group(1)])
            nodes.append(Node(family, m.start(), m.end(), keep, put, raw=raw))
    wiki_table = re.search(r"^\{\|", text, re.M) is not None
    for (family, pattern, group, mark), sign in zip(LINE_RULES, LINE_SIGNS, strict=True):
        if sign not in text:
            continue
        for m in pattern.finditer(text):
            keep, level = (), None
            if family in ("heading", "wikihead"):
                level = min(6, len(m.group(1)))
            if group is not None:
                keep = ((m.start(group), m.end(group)),)
            if family == "row" and group and not wiki_table and (m.group()[0] == "!" or not m.group().rstrip().endswith("|")):
                continue
            nodes.append(Node(family, m.start(), m.end(), keep, "", (mark[0], level) if mark else None, raw=family in ("definition", "wikitable", "switch")))
    return _tree(text, nodes)


def _latex(text: str) -> list[Node]:
    nodes = []
    for m in re.finditer(r"(?<![A-Za-z0-9\u00c0-\u024f_:\\])\\([A-Za-z]+)\*?(?:\[[^\]\n]*\])?((?:\{[^{}]*\})*)", text):
        name, args = m.group(1), m.group(2)
        if name in ("begin", "end", "verb"):
            continue
        if not args:
            if name in BARE and not re.match(r"\\\w", text[m.end() : m.end() + 2]):
                nodes.append(Node("command", m.start(), m.end(), (), "", ("list_item", None) if name == "item" else None, raw=True))
            continue
        spans = [(m.start(2) + a.start() + 1, m.start(2) + a.end() - 1) for a in re.finditer(r"\{[^{}]*\}", args)]
        level = {"chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}.get(name)
        if name in ("cite", "ref", "label", "citep", "citet", "eqref", "pageref", "includegraphics", "usepackage", "documentclass", "input"):
            spans = []
        start = m.start() - 1 if m.start() and text[m.start() - 1] == "~" else m.start()
        nodes.append(Node("command", start, m.end(), tuple(spans[-1:]), "", ("heading", level) if level else None))
    for m in re.finditer(r"\\begin\{([A-Za-z]+\*?)\}(?:\[[^\]\n]*\]|\{[^{}\n]*\})*(.*?)(?:\\end\{\1\}|\Z)", text, re.S):
        kind = m.group(1).rstrip("*")
        mark = ("code", None) if kind in ("verbatim", "lstlisting") else ("formula", None) if kind in ("equation", "align", "math", "displaymath", "gather") else ("", None)
        nodes.append(Node("environment", m.start(), m.end(), ((m.start(2), m.end(2)),), "", mark, raw=mark[0] in ("code", "formula")))
    for m in re.finditer(r"\\end\{[A-Za-z]+\*?\}", text):
        nodes.append(Node("environment", m.start(), m.end(), raw=True))
    return nodes


def _tree(text: str, nodes: list[Node]) -> list[Node]:
    sure = sorted(((n.start, n.end) for n in nodes if n.sure))
    starts = [a for a, _ in sure]
    depth_end: list[int] = []  # the furthest end of the narrow candidates up to each
    for _, e in sure:
        depth_end.append(max(e, depth_end[-1]) if depth_end else e)

    def crosses(a: int, e: int) -> bool:
        """Whether a stretch begins or ends within a narrow candidate that it doesn't lie in."""
        if (i := bisect_left(starts, a)) and depth_end[i - 1] > a and any(x < a < y < e for x, y in sure[max(0, i - 40) : i]):
            return True
        return any(a <= x < e < y for x, y in sure[i : bisect_left(starts, e)])

    taken = np.zeros(len(text) + 1, bool)
    for n in nodes:
        taken[n.start] = True
    nodes = [n for n in nodes if n.sure or not crosses(n.start, n.end)]
    for (family, pattern, group), sign in zip(GENEROUS, GENEROUS_SIGNS, strict=True):
        if sign not in text:
            continue
        for m in pattern.finditer(text):
            if not taken[m.start()] and not crosses(m.start(), m.end()):
                taken[m.start()] = True
                keep = () if group is None or family.startswith("look") else ((m.start(group), m.end(group)),)
                nodes.append(Node(family, m.start(), m.end(), keep or ((m.start(), m.end()),), sure=False))
    nodes.sort(key=lambda n: (n.start, -n.end, not n.sure, FAMILIES.index(n.family)))
    out: list[Node] = []
    stack: list[int] = []
    for n in nodes:
        while stack and out[stack[-1]].end <= n.start:
            stack.pop()
        if stack:
            top = out[stack[-1]]
            if n.end > top.end or (n.start, n.end) == (top.start, top.end):
                continue  # crossing, or a second reading of the same stretch
            n.parent, n.depth = stack[-1], len(stack)
            top.children.append(len(out))
        stack.append(len(out))
        out.append(n)
    return out


def _class(c: str) -> int:
    return 0 if not c else 1 if c == "\n" else 2 if c.isspace() else 3 if c.isdigit() else 6 if c >= "\u2e80" else 4 if c.isalpha() else 5


#: A sign without which a rule cannot match; rules whose sign a text lacks are not tried.
INLINE_SIGNS = ("$$", "$", "\\", "\\verb", "``", "`", "{{", "![", "[[", "[", "[^", "](", "[", "<", "*", "_", "~~", "''", "__", "\\", "\\", "\\", "\\\\")
LINE_SIGNS = ("#", "=", "#", "", ">", "]:", "[", "", "", "", "|", "|", "|", "!")
GENEROUS_SIGNS = ("$", "*", "_", "~", "`", "#", "==", "<", "&", "*", "_", "$", "[", "\\", "#", "|", "==", "~", "{", "")

FEATURES = 26


def features(text: str, nodes: list[Node], kind: str | None) -> np.ndarray:
    """A row of small integers for each node."""
    out = np.zeros((len(nodes), FEATURES), np.int16)
    signs = [text[n.start : n.end].lstrip()[:1] for n in nodes]
    total = {s: signs.count(s) for s in set(signs)}
    kinds = ("paragraph", "heading", "list_item", "table", "code")
    roots = [j for j in range(len(nodes)) if nodes[j].parent < 0]
    for i, n in enumerate(nodes):
        s = text[n.start : n.end]
        t = s.strip()
        lead = re.match(r"[^\w\s]+", t)
        lead_s = lead.group() if lead else ""
        after_lead = t[len(lead_s) : len(lead_s) + 1]
        tail = re.search(r"[^\w\s]+$", t)
        tail_s = tail.group() if tail and len(t) > len(lead_s) else ""
        before_tail = t[: len(t) - len(tail_s)][-1:] if tail_s else ""
        inside = t[len(lead_s) : len(t) - len(tail_s)] if tail_s else t[len(lead_s) :]
        line_start = n.start == 0 or text[n.start - 1] == "\n"
        line_end = n.end >= len(text) or text[n.end] == "\n" or text[n.end - 1 : n.end] == "\n"
        sub = sum(nodes[c].end - nodes[c].start for c in n.children)
        siblings = nodes[n.parent].children if n.parent >= 0 else roots
        same = sum(signs[j] == signs[i] for j in siblings[:200])
        name = re.match(r"\w*", inside).group()
        out[i] = (
            SIGNS.get(signs[i], 20 + _class(signs[i])),
            SIGNS.get(lead_s[1:2], 20 + _class(lead_s[1:2])),
            min(len(lead_s), 7),
            _class(after_lead),
            SIGNS.get(tail_s[-1:], 20 + _class(tail_s[-1:])),
            min(len(tail_s), 7),
            _class(before_tail),
            _class(text[n.start - 1 : n.start]),
            _class(text[n.end : n.end + 1]),
            min(len(s), 120) // 2,
            line_start,
            line_end,
            min(total[signs[i]], 20),
            min(same, 20),
            min(n.depth, 6),
            SIGNS.get(signs[n.parent], 30) if n.parent >= 0 else 31,
            int(10 * (len(lead_s) + len(tail_s) + sub) / max(1, len(s))),
            min(len(re.findall(r"\w=", s)), 5),
            name.lower() in ELEMENTS,
            bool(re.search(r"[\\^{}]|_\{", inside)) + 2 * bool(re.search(r"\s", inside)),
            inside.isdigit(),
            name in BARE or name in ("REDIRECT", "TOC"),
            s.endswith(";"),
            kinds.index(kind) if kind in kinds else 5,
            n.end == len(text),
            bool(re.search(r"\]\(|\]\[|\]:|\}\}|\]\]|/>|\{", s)),
        )
    return out


class Boosted:
    """Gradient-boosted trees for two classes over features of at most 64 values, grown level by level from histograms."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.3, least: float = 2.0):
        self.rounds, self.depth, self.rate, self.least = rounds, depth, rate, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0
        self._stacked: tuple | None = None

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x = np.minimum(x, 63).astype(np.int64)
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        z = np.full(len(y), self.base)
        cells = x + 64 * np.arange(x.shape[1])
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            feature, cut, leaf = np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, 64), np.zeros(2**self.depth)
            node = np.zeros(len(y), int)
            for level in range(self.depth):
                first = 2**level - 1
                size = x.shape[1] * 64
                at = (node - first)[:, None] * size + cells
                gs = np.bincount(at.ravel(), np.repeat(g, x.shape[1]), 2**level * size).reshape(2**level, x.shape[1], 64).cumsum(2)
                hs = np.bincount(at.ravel(), np.repeat(h, x.shape[1]), 2**level * size).reshape(2**level, x.shape[1], 64).cumsum(2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < self.least) | (ht - hs < self.least)] = 0
                best = gain.reshape(2**level, -1).argmax(1)
                for k in range(2**level):
                    if gain[k].ravel()[best[k]] > 1e-9:
                        feature[first + k], cut[first + k] = divmod(int(best[k]), 64)
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
            last = node - (2**self.depth - 1)
            leaf = self.rate * np.bincount(last, g, 2**self.depth) / (np.bincount(last, h, 2**self.depth) + 1)
            self.trees.append((feature, cut, leaf))
            z += leaf[last]
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        """All trees go down together, one level at a time."""
        if not self.trees:
            return np.full(len(x), self.base)
        if len(x) > 20_000:  # room for rows times trees
            return np.concatenate([self.logits(x[i : i + 20_000]) for i in range(0, len(x), 20_000)])
        x = np.minimum(x, 63)
        feature, cut, leaf = (np.stack(part) for part in zip(*self.trees, strict=True)) if self._stacked is None else self._stacked
        self._stacked = feature, cut, leaf
        rows, tree = np.arange(len(x))[:, None], np.arange(len(feature))[None, :]
        node = np.zeros((len(x), len(feature)), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, feature[tree, node]] > cut[tree, node])
        return self.base + leaf[tree, node - (2**self.depth - 1)].sum(1)


def decode(nodes: list[Node], logit: np.ndarray) -> np.ndarray:
    """The choice of greatest joint likelihood: True for markup. Children are decided first; a raw node that is markup shadows what
    lies in it, all of which then counts as no markup."""
    yes, no = -np.logaddexp(0, -logit), -np.logaddexp(0, logit)
    free, none = np.zeros(len(nodes)), np.zeros(len(nodes))  # the best sum over the subtree, and that of no markup in it at all
    take = np.zeros(len(nodes), bool)
    for i in range(len(nodes) - 1, -1, -1):  # parents come first
        inside, empty = sum(free[c] for c in nodes[i].children), sum(none[c] for c in nodes[i].children)
        with_, without = yes[i] + (empty if nodes[i].raw else inside), no[i] + inside
        take[i], free[i], none[i] = with_ >= without, max(with_, without), no[i] + empty
    shadow = np.zeros(len(nodes), bool)
    for i, n in enumerate(nodes):
        if n.parent >= 0:
            shadow[i] = shadow[n.parent] or (take[n.parent] and nodes[n.parent].raw)
    return take & ~shadow


#: Words are written in a private alphabet, so what is markup in a written block can be told by its characters.
PRIVATE = 0xE000


def _hide(words: str) -> str:
    return "".join(chr(PRIVATE + ord(c)) if ord(c) < 0x1000 else chr(0xF0000 + ord(c)) for c in words)


def _show(text: str) -> tuple[str, np.ndarray]:
    """The text as it is read, and which of its characters aren't words."""
    points = np.array([ord(c) for c in text], np.int64)
    word = (points >= PRIVATE) & (points < PRIVATE + 0x1000) | (points >= 0xF0000)
    return "".join(chr(x - PRIVATE) if PRIVATE <= x < PRIVATE + 0x1000 else chr(x - 0xF0000) if x >= 0xF0000 else chr(x) for x in points.tolist()), ~word


def _written(seed: int = 5, blocks: int = 7000) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of nodes in blocks written here: fillers with constructs and look-alikes at known places.

    A node is markup if the first of its characters that aren't content was written as markup. In raw content nothing is. What lies
    in parts of a construct that vanish with it (addresses, names) has no label, nor have stretches that reach beyond their construct.
    """
    r = random.Random(seed)
    syllables = [c + v for c in ("b", "d", "gr", "k", "l", "m", "n", "pr", "s", "t", "v") for v in "aeiou"]
    w = lambda: _hide("".join(r.choice(syllables) for _ in range(r.randint(1, 4))))
    ph = lambda: _hide(" ").join(w() for _ in range(r.randint(1, 3)))
    n = lambda: _hide(str(r.randint(1, 2000)))
    sentence = lambda: r.choice([lambda: _hide(_show(" ".join(w() for _ in range(r.randint(3, 14))))[0].capitalize() + r.choice(".!?")), lambda: _hide("".join(chr(r.randint(0x4E00, 0x4FFF)) for _ in range(r.randint(5, 20))) + "。")])()
    han = lambda: _hide("".join(chr(r.randint(0x4E00, 0x4FFF)) for _ in range(r.randint(1, 6))))
    constructs = [
        lambda: f"<{(t := r.choice(['b', 'i', 'em', 'sup', 'sub', 'h2', 'h3', 'p', 'span', 'u', 'cite', 'code']))}>{ph()}</{t}>",
        lambda: f"<{(t := r.choice(['div', 'DIV', 'span', 'p', 'td', 'ref', 'font']))} {r.choice(['class', 'id', 'name', 'data-k'])}={(q := r.choice(['', '', chr(34)]))}{w()}{q}>{r.choice([sentence, ph])()}</{t}>",
        lambda: f"{sentence()}<ref name={w()}>{ph()}</ref>",
        lambda: f"{w()}~\\{r.choice(['cite', 'ref', 'pageref'])}{{{w()}}}",
        lambda: f"{w()}\\'e {w()}, see {w().capitalize()}~\\ref{{{w()[:3]}:{w()}}}.",
        lambda: f"see {w().capitalize()}~\\{r.choice(['ref', 'cite'])}{{{w()[:3]}:{w()}}}",
        lambda: f"<div class='{w()}'>{sentence()}</div>",
        lambda: f'<span data-k="{w()}"\n  title="x">{sentence()}</span>',
        lambda: f'<a href="https://{w()}.example/{w()}?p=1&q={n()}">{ph()}</a>',
        lambda: f'<img alt="{w()} > {w()}" src="{w()}.png">',
        lambda: r.choice(["<br/>", "<br>", "<hr />", "</p>", "<p>"]),
        lambda: f"<ul><li>{ph()}<li>{ph()}</ul>",
        lambda: f"<table><tr><td>{ph()}</td><td>{n()}</td></tr></table>",
        lambda: f"<pre><code>x = {w()}('{w()}')\nx.run()</code></pre>",
        lambda: f"<style>.{w()}{{color:red}}</style>",
        lambda: f"<!-- {ph()} -->",
        lambda: f"<ref name={w()}>{ph()}</ref>",
        lambda: f"{w()}&{r.choice(['amp', 'nbsp', 'lt', 'gt', 'eacute', 'ndash', 'times', '#8217', '#x2014', 'quot'])};{w()}",
        lambda: f"{(d := r.choice(['*', '**', '_', '__', '***']))}{ph()}{d}",
        lambda: f"{han()}{(d := r.choice(['**', '*', '__', '~~', '`']))}{han()}{d}{han()}",
        lambda: f"{han()}${w()[0]}^2${han()}",
        lambda: f"~~{ph()}~~",
        lambda: f"`{w()} --{w()}`",
        lambda: f"[{ph()}](https://{w()}.example/{w()}_{w()})",
        lambda: f"![{ph()}]({w()}.png)",
        lambda: f"[{ph()}][{r.randint(1, 9)}]\n\n[{r.randint(1, 9)}]: https://{w()}.example/",
        lambda: f"{w()}[^{r.randint(1, 9)}]",
        lambda: f"<https://{w()}.example>",
        lambda: f"\\*{w()}\\* {w()} \\_{ph()}\\_",
        lambda: f"\\#{n()} \\[{w()}\\]",
        lambda: f"[[{w()}]]",
        lambda: f"[[{w()}|{ph()}]]",
        lambda: f"[[{r.choice(['File', 'Image'])}:{w()}.jpg|thumb|{ph()}]]",
        lambda: f"[[Category:{w()}]]",
        lambda: f"{{{{{w()}|{w()}|page={n()}}}}}",
        lambda: f"''{ph()}''",
        lambda: f"'''{w()}'''",
        lambda: f"[https://{w()}.example {ph()}]",
        lambda: f"\\{r.choice(['textbf', 'emph', 'textit', 'footnote', 'section', 'texttt', 'url'])}{{{ph()}}}",
        lambda: f"{w()}~\\{r.choice(['cite', 'ref'])}{{{w()}:{w()}}}",
        lambda: f"\\verb|{w()}|",
        lambda: f"${w()[0]}_{{{w()[0]}}}^2 + y = {r.randint(1, 20)}$",
        lambda: f"${w()[0]}^2$",
        lambda: f"\\({w()[0]} \\le {w()[0]}\\)",
        lambda: f"\\[ f({w()[0]}) = \\frac{{1}}{{2}} \\]",
        lambda: "$$\\sum_i w_i = 1$$",
        lambda: f"``{ph()}'' {w()} {r.randint(1, 99)}\\% \\& {w()}",
        lambda: f"{w()[:2]}\\'e {w()}",
    ]
    lines = [
        lambda: f"{'#' * r.randint(1, 5)} {ph()}",
        lambda: f"{ph()}\n{r.choice('=-') * r.randint(4, 9)}",
        lambda: r.choice(["---", "***", "* * *", "___", "-----"]),
        lambda: f"> {sentence()}",
        lambda: "\n".join(f"{m} {ph()}" for m in [r.choice("-*+")] for _ in range(r.randint(1, 4))),
        lambda: "\n".join(f"{i + 1}{d} {ph()}" for d in [r.choice(".)")] for i in range(r.randint(2, 4))),
        lambda: f"- [{r.choice(' x')}] {ph()}",
        lambda: f"```{r.choice(['', 'py', 'sh'])}\n{w()}('{w()}')\n```",
        lambda: f"| {ph()} | {w()} |\n|---|---|\n| {w()} | {n()} |",
        lambda: f"{'=' * (k := r.randint(2, 4))} {ph()} {'=' * k}",
        lambda: f'{{| class="{w()}"\n! {ph()}\n|-\n| {w()} || {n()}\n|}}',
        lambda: f"** {w()}",
        lambda: f"; {w()}\n: {ph()}",
        lambda: f"#REDIRECT [[{w()}]]",
        lambda: "__TOC__",
        lambda: f"\\begin{{itemize}}\n\\item {ph()}\n\\item {w()}\n\\end{{itemize}}",
        lambda: f"\\begin{{equation}}\nE = m {w()[0]}^2\n\\end{{equation}}",
        lambda: f"\\{r.choice(['section', 'subsection', 'subsubsection'])}{{{ph()}}}",
        lambda: f"<h3>{ph()}</h3>\n<p>{sentence()}",
        lambda: f"[^{r.randint(1, 9)}]: {sentence()}",
    ]
    plain = [
        lambda: f"{w()} <{n()} {w()}",
        lambda: f"I <3 {w()}",
        lambda: f"{w()} a < b and c > {n()}, {w()}",
        lambda: f"{w()} {w()[0]}<{w()[0]} {w()}",
        lambda: f"the {w()[0].upper()}&{w()[0].upper()} {w()}; {w()[0].upper()}&{w()[0].upper()} {w()}",
        lambda: f"{w()} & {w()}",
        lambda: f"rated {r.randint(1, 5)}/5* by {w()}; * means {w()}",
        lambda: f"{r.randint(2, 9)} * {n()} * {n()}",
        lambda: f"{w()} {n()}*",
        lambda: f"{w()}_{w()}_ids",
        lambda: f"{w()}_a.txt or {w()}_b.txt",
        lambda: f"~/{w()}/{w()}",
        lambda: f"{w()} ~{n()} {w()} ({n()}%)",
        lambda: f"set {{{w()[0]}, {w()[0]}}}",
        lambda: f"${n()} in {w()} and ${n()} in {w()}",
        lambda: f"US${n()}.50 {w()}",
        lambda: f"{w()} #{n()} {w()}",
        lambda: f"#{w()} {w()}",
        lambda: f"C# and C++ {w()} -> {w()}",
        lambda: f"{w()} [{n()}]",
        lambda: f"{w()} [sic] {w()} [{w()}]",
        lambda: f"{w()[0].upper()}:\\{w()}\\{w()}\\{w()}",
        lambda: f"\\\\{w()}\\{w()}",
        lambda: f"{w()} == {n()} {w()}",
        lambda: f"{w()} desk | {ph()} | bell {n()}",
        lambda: f"the '{r.randint(10, 99)}s and '{r.randint(10, 99)}s {w()}",
        lambda: f"{w()} => {w()} <= {n()}",
        lambda: f"it's {w()}'s `{w()}",
        lambda: f"{w()} {r.choice('<&*_$[#|~{`=') * r.choice([1, 1, 2, 3, 6])} {w()}",
    ]
    xs, ys = [], []
    for _ in range(blocks):
        kind = r.choice(["paragraph", "paragraph", "heading", "list_item", "table"])
        pieces: list[tuple[str, int]] = []
        for _ in range(r.randint(1, 3)):
            if r.random() < 0.25:
                pieces.append((("\n" if pieces else "") + r.choice(lines)() + "\n", 1))
            else:
                pieces += [(sentence() + " ", 0)] * (r.random() < 0.8)
                pieces.append((r.choice(constructs)() + " ", 1) if r.random() < 0.6 else (r.choice(plain)() + r.choice([". ", ", "]), 0))
        if r.random() < 0.03:
            pieces.append((f"<div class={r.choice([chr(34), ''])}{w()}", 1))
        elif r.random() < 0.6:  # a block ends with its last construct as often as not
            pieces[-1] = (pieces[-1][0].rstrip(" \n"), pieces[-1][1])
        elif r.random() < 0.1:
            pieces.append((r.choice("<&*$[#|~{`=") * r.choice([1, 1, 2, 9]), 0))
        text, markup, piece_end = "", np.zeros(0, bool), np.zeros(0, np.int64)
        for piece, label in pieces:
            shown, syntax = _show(piece)
            text += shown
            markup = np.concatenate([markup, syntax & bool(label)])
            piece_end = np.concatenate([piece_end, np.full(len(shown), len(text) if label else 0)])
        nodes = parse(text)
        label = np.full(len(nodes), -1.0)
        raw = np.zeros(len(nodes), bool)
        for i, m in enumerate(nodes):
            own = [j for j in range(m.start, m.end) if not text[j].isspace() and not any(a <= j < e for a, e in m.keep)]
            lead = own[0] if own else min(m.start + len(text[m.start : m.end]) - len(text[m.start : m.end].lstrip()), m.end - 1)
            if (up := m.parent) >= 0:
                if raw[up]:
                    raw[i], label[i] = True, 0.0
                    continue
                if label[up] < 0 or label[up] == 1 and not any(a <= m.start and m.end <= e for a, e in nodes[up].keep):
                    continue  # it vanishes with what it lies in
            if piece_end[lead] and m.end > piece_end[lead]:
                continue
            label[i] = markup[lead]
            raw[i] = m.raw and bool(markup[lead])
        if (label >= 0).any():
            xs.append(features(text, nodes, kind)[label >= 0])
            ys.append(label[label >= 0])
    return np.concatenate(xs), np.concatenate(ys)


@lru_cache(maxsize=1)
def trees() -> Boosted:
    x, y = _written()
    return Boosted().fit(x, y)


Judged = tuple[list[Node], np.ndarray]


def judge_all(texts: list[tuple[str, str | None]], model: Boosted) -> list[Judged]:
    """The nodes of each text (with its block's kind) and which of them are markup; the trees see the nodes of all texts at once."""
    parsed = [parse(t) if SUSPECT.search(t) else [] for t, _ in texts]
    rows = [features(t, nodes, kind) for (t, kind), nodes in zip(texts, parsed, strict=True) if nodes]
    logit = model.logits(np.concatenate(rows)) if rows else np.empty(0)
    ends = np.cumsum([len(nodes) for nodes in parsed])
    return [(nodes, decode(nodes, logit[end - len(nodes) : end]) if nodes else np.zeros(0, bool)) for nodes, end in zip(parsed, ends.tolist(), strict=True)]


def judge(text: str, kind: str | None, model: Boosted) -> Judged:
    """The nodes of a text and which of them are markup."""
    return judge_all([(text, kind)], model)[0]


def render(text: str, nodes: list[Node], take: np.ndarray, kind: str | None, level: int | None) -> list[tuple[str | None, int | None, str]]:
    """The parts (kind, level, text) of a text without its markup."""
    parts: list[list] = [[kind, level, [], False]]  # the last: ends with the line

    def begin(k: str | None, lv: int | None, to_line_end: bool = False) -> None:
        parts.append([k, lv, [], to_line_end])

    def say(s: str) -> None:
        while parts[-1][3] and "\n" in s:
            head, s = s.split("\n", 1)
            parts[-1][2].append(head)
            begin(base, None)
        parts[-1][2].append(s)

    base = "paragraph" if kind in ("heading", "table") else kind

    def walk(a: int, b: int, inside: list[int]) -> None:
        at = a
        for i in inside:
            n = nodes[i]
            if n.start < at or n.end > b:
                continue
            say(text[at : n.start])
            at = n.end
            if not take[i]:
                walk(n.start, n.end, n.children)
                continue
            if n.mark is not None and not n.keep and n.mark[0]:
                begin(*n.mark, True)
                continue
            if n.mark is not None:
                begin(n.mark[0] or base, n.mark[1])
            if n.put:
                say(n.put)
            for x, y in n.keep:
                if n.raw:
                    parts[-1][2].append(text[x:y])
                else:
                    walk(x, y, n.children)
            if n.mark is not None:
                begin(base, None)
        say(text[at:b])

    walk(0, len(text), [i for i, n in enumerate(nodes) if n.parent < 0])
    out: list[tuple[str | None, int | None, str]] = []
    for k, lv, bits, _ in parts:
        t = "".join(bits)
        if k == "code":
            t = t.strip("\r\n")
        else:
            t = re.sub(r"[ \t\u00a0]+", " ", t)
            t = re.sub(r" ?(\r\n|\r|\n) ?", "\n", t)
            t = re.sub(r"\n{3,}", "\n\n", t).strip()
        if not t:
            continue
        if k == "table":
            t = "| " + " | ".join(c.strip() for c in re.split(r"\|+", t.strip("| "))) + " |"
            if out and out[-1][0] == "table":
                out[-1] = ("table", out[-1][1], out[-1][2] + "\n" + t)
                continue
        out.append((k, lv, t))
    return out or [(kind, level, "")]


def _names(nodes: list[Node], take: np.ndarray) -> list[str]:
    """The families of what was chosen; a sign that no family claims is ``other``, unless it lies in something chosen."""
    inside = np.zeros(len(nodes), bool)
    out = []
    for i, n in enumerate(nodes):
        inside[i] = n.parent >= 0 and (take[n.parent] or inside[n.parent])
        if take[i] and not (n.family.startswith("lookalike") and inside[i]):
            out.append("other" if n.family.startswith("lookalike") else n.family)
    return out


def _cells(line: str, model: Boosted) -> list[str]:
    """The cells of a table's row: pipes in a link, a template, a formula or code that the trees choose don't part cells."""
    line = line.strip().removeprefix("|").removesuffix("|")
    cuts = [m.start() for m in re.finditer(r"(?<!\\)\|", line)]
    if cuts and re.search(r"\[\[|\{\{|\$|\\|`", line):
        nodes, take = judge(line, "table", model)
        kept = [(n.start, n.end) for n, t in zip(nodes, take, strict=True) if t and n.family in ("wikilink", "template", "math", "span", "command")]
        cuts = [c for c in cuts if not any(a < c < b for a, b in kept)]
    return [line[a:b] for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(line)], strict=True)]


def clean_block(text: str | None, kind: str | None, level: int | None, model: Boosted, judged: Judged | None = None) -> tuple[list[tuple[str | None, int | None, str | None]], list[str]]:
    """Parts of a block and the families of the constructs in it.

    Code is left as it is. Of a table the pipes are its own and the cells are read one by one. Null text stays null. ``judged``: the
    text's nodes and verdicts, if they are known already.
    """
    if text is None or kind == "code":
        return [(kind, level, text)], []
    if kind == "table":
        found: list[str] = []
        rows = []
        for line in text.split("\n"):
            piped = "|" in line and not re.fullmatch(r"[\s|:-]*", line)
            done, cells = [], _cells(line, model) if piped else [line]
            judged = judge_all([(c.strip(), kind) for c in cells], model) if piped or "|" not in line else [([], np.zeros(0, bool))]
            for c, (nodes, take) in zip(cells, judged, strict=True):
                found += _names(nodes, take)
                done.append(" ".join(x for _, _, x in render(c.strip(), nodes, take, None, None)) if take.any() else c.strip())
            rows.append(f"| {' | '.join(done)} |" if piped else done[0])
        return [(kind, level, "\n".join(rows) if found else text)], found
    nodes, take = judged or judge(text, kind, model)
    if not take.any():
        return [(kind, level, text)], []
    return render(text, nodes, take, kind, level), _names(nodes, take)


SCHEMA = "block_id long, part int, kind string, level int, text string, residue boolean, constructs array<string>"


def clean(blocks: DataFrame) -> DataFrame:
    """block_id, part, kind, level, text, residue, constructs of every block: its text without markup, in one or more parts.

    A block without residue is one part with its text unchanged (null stays null); one of nothing but markup is one part
    with an empty text. Repeated rows give repeated parts, and other columns are left out.
    """
    shared = blocks.sparkSession.sparkContext.broadcast(trees())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.list_(pa.string()))
        for b in batches:
            out: list[tuple] = []
            rows = list(zip(*(b.column(c).to_pylist() for c in ("block_id", "text", "kind", "level")), strict=True))
            for a in range(0, len(rows), 500):
                part = rows[a : a + 500]
                plain = [n for n, (_, t, k, _) in enumerate(part) if t is not None and k not in ("code", "table")]
                judged = dict(zip(plain, judge_all([part[n][1:3] for n in plain], shared.value), strict=True))
                for n, (i, t, k, lv) in enumerate(part):
                    parts, found = clean_block(t, k, lv, shared.value, judged.get(n))
                    out += [(i, j, *p, bool(found), sorted(set(found))) for j, p in enumerate(parts)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["block_id", "part", "kind", "level", "text", "residue", "constructs"])

    return blocks.select("block_id", "text", "kind", "level").mapInArrow(run, SCHEMA)
