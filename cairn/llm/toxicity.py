"""Abusive, hateful or sexual content (problem 9): a convolutional text classifier trained here, in numpy.

Words are hashed to embeddings; filters of several widths run over each sentence, the greatest response of every filter in
the sentence is kept, and a linear layer gives the sentence's logit. A document's score is that of its worst sentence, so
one sentence of a long text counts, and whatever stands around it doesn't dilute it. Training is by multiple instances: a
document's label is held against its worst sentence under the present model, for a fixed number of steps, so the cost of
fitting doesn't grow with the labels. The labelled rows are a bounded sample (``MAX_LABELLED`` documents by hash of the id, ``MAX_TEXT`` bytes);
scoring covers every document and its whole text. Thresholds are calibrated by language on held-out scores of all labels
(cross-validation), weighted to the share of cases that the scores of all documents tell.

Spellings are folded before hashing: compatibility forms, case, zero-width characters, look-alike letters of other scripts,
digits and signs for letters inside a word, letters set apart by dots or blanks. Words seen in fewer than two of the labelled
documents share one unknown id, numbers another, and characters of scripts without blanks are words of their own.

Sentences that are the same after this folding are scored once in a batch.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import materialize

MAX_LABELLED, MAX_TEXT = 20_000, 64 << 20
EDGES = np.linspace(-6, 6, 49)  # of the bins of logits
BUCKETS, DIMENSIONS, FILTERS, WIDTHS = 1 << 16, 20, 28, (1, 2, 3, 4)
STEPS, BATCH, REFRESH, EVIDENCE, SUPPORT, MIXED, CROP = 420, (48, 96), 60, 2.5, 250, 0.2, 24
LONGEST = 60  # words of a sentence scored at once; longer ones are scored in overlapping stretches
END, UNKNOWN, NUMBER = 0, 1, 2
RESERVED = 3
LANGUAGES = ("en", "de", "fr", "es", "ja", "zh")

#: Letters of other scripts and signs that stand for Latin letters.
LOOKALIKE = str.maketrans("аеіїорсхуӏкмтвнԁɡѕјοαεικρτυνχ", "aeiiopcxylkmtbhdgsjoaeikptuvx")
LEET = str.maketrans("0134578@$!€", "oieastbasie")
INVISIBLE = re.compile("[\\u00ad\\u180e\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u2064\\ufeff\\ufe00-\\ufe0f]")
SPACED = re.compile(r"(?<![\w.])\w([ .\-_·])\w(?:\1\w)+(?!\w)(?!(?!\1)[.\-_·]\w)")
MASK = re.compile(r"(?<=\w)[*#•]+(?=\w)")
IDEOGRAPHIC = "\\u3040-\\u30ff\\u3400-\\u9fff\\uf900-\\ufaff\\uac00-\\ud7a3"
TOKEN = re.compile(rf"[{IDEOGRAPHIC}]|\d+(?:[.,:\-]\d+)*(?![^\W{IDEOGRAPHIC}])|(?:[^\W{IDEOGRAPHIC}]|['’*@$])*[^\W{IDEOGRAPHIC}]|[.!?。！？]+|[\"'“”‘’„«»「」『』‹›:;()\[\]]")
ENDS = re.compile(r"^[.!?。！？]+$")
LINES = re.compile(r"(?:\r\n|[\r\n])+")


def join_spaced(text: str) -> str:
    """``w o r d`` and ``w.o.r.d`` as ``word``: single letters set apart by one and the same sign, three at least (four by blanks)."""

    def joined(m: re.Match) -> str:
        word = m.group()[::2]
        return m.group() if word.isdigit() or (m.group(1) == " " and len(word) < 4) else word

    return SPACED.sub(joined, text)


def fold(word: str) -> str:
    """One spelling for the disguises of a word."""
    if word.isascii():
        w = word.lower()
        if w.isalpha():
            return w
    else:
        w = unicodedata.normalize("NFKC", word).casefold().replace("’", "'")
        if not w.isascii() and re.search("[a-z]", w):
            w = w.translate(LOOKALIKE)
    if re.search("[a-zß-ÿ]", w) and re.search(r"[0-9@$!€]", w.strip("!")):
        w = w.translate(LEET)
    return MASK.sub("*", w)


def words(chunk: str) -> list[str]:
    """The folded words and signs of a stretch of text; a line's or a sentence's end is an empty string."""
    if chunk.isascii():
        if chunk.isalpha():
            return [chunk.lower()]
    else:
        chunk = INVISIBLE.sub("", chunk)
    out: list[str] = []
    for line in LINES.split(chunk):
        for t in TOKEN.findall(line):
            out.append("" if ENDS.match(t) else "0" if t[0].isdigit() and not re.search(r"[^\W\d]", t) else fold(t))
            if t[:1] == "!":
                out[-1:] = ["!", ""]
        out.append("\n")
    return out[:-1]


class Vocabulary:
    """Maps words to ids by hash: words met in training keep their bucket, others are unknown. Without ``known`` all keep it."""

    def __init__(self, known: np.ndarray | None = None):
        self.known = known
        self._reset()

    def __getstate__(self) -> dict:
        return {"known": self.known}

    def __setstate__(self, state: dict) -> None:
        self.known = state["known"]
        self._reset()

    def _reset(self) -> None:
        self.chunk: dict[str, int] = {}
        self.flat, self.start, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    @staticmethod
    def bucket(word: str) -> int:
        from xxhash import xxh32_intdigest

        return RESERVED + xxh32_intdigest(word.encode()) % (BUCKETS - RESERVED)

    def id(self, word: str) -> int:
        if word in ("", "\n"):
            return END
        if word == "0":
            return NUMBER
        b = self.bucket(word)
        return b if self.known is None or self.known[b] else UNKNOWN

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of a batch of texts; each ends with END. Distinct stretches between blanks are looked at once."""
        if len(self.chunk) > 300_000:
            self._reset()
        split = [join_spaced(t).split(" ") if t else [] for t in texts]
        flat = list(chain.from_iterable(split))
        new = [c for c in dict.fromkeys(flat) if c not in self.chunk]
        if new:
            got = [[self.id(w) for w in words(c)] for c in new]
            size = np.fromiter(map(len, got), np.int64, len(got))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(got), np.int32, int(size.sum()))])
            self.chunk.update(zip(new, range(len(self.chunk), len(self.chunk) + len(new)), strict=True))
        codes = np.fromiter(map(self.chunk.__getitem__, flat), np.int64, len(flat))
        size = self.size[codes]
        before = np.cumsum(size) - size
        ids = self.flat[np.arange(int(size.sum())) - np.repeat(before - self.start[codes], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum([len(s) for s in split])] if texts else np.empty(0, np.int64)
        ids = np.insert(ids, ends, END)  # a text's end ends its sentence
        return np.concatenate([[0], ends + np.arange(1, len(texts) + 1)]), ids


def sentences(offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct sentences as rows of a matrix padded with END, the sentence of each occurrence, its text, and the distinct ones' hashes.

    Sentences longer than LONGEST words come in stretches that overlap by half.
    """
    end = np.flatnonzero(ids == END)
    begin = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    text = np.searchsorted(offsets, begin, "right") - 1
    length = end - begin
    keep = length > 0
    begin, length, text = begin[keep], length[keep], text[keep]
    long_ = length > LONGEST
    if long_.any():
        half = LONGEST // 2
        parts = np.where(long_, -(-(length - LONGEST) // half) + 1, 1)
        which = np.repeat(np.arange(len(begin)), parts)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin, length, text = begin[which] + nth * half, np.minimum(length[which] - nth * half, LONGEST), text[which]
    if not len(begin):
        return np.zeros((0, 1), np.int32), np.empty(0, np.int64), text, np.empty(0, np.uint64)
    with np.errstate(over="ignore"):  # two sentences are the same if their 64-bit sums of mixed (word, place) and their lengths are
        place = np.arange(LONGEST, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)
        place ^= place >> np.uint64(31)
        at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        w = ids[np.repeat(begin, length) + at].astype(np.uint64) + np.uint64(1)
        mixed = w * (place[at] | np.uint64(1))
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h = np.add.reduceat(mixed, np.cumsum(length) - length) + length.astype(np.uint64)
    kinds, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    matrix = np.zeros((len(first), int(length.max())), np.int32)
    l, b = length[first], begin[first]
    row, col = np.repeat(np.arange(len(first)), l), np.arange(int(l.sum())) - np.repeat(np.cumsum(l) - l, l)
    matrix[row, col] = ids[np.repeat(b, l) + col]
    return matrix, inverse, text, kinds


def all_sentences(slices: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct sentences of many texts (``slices``: offsets and ids of some texts each), and for each text which they are."""
    known: dict[int, int] = {}
    rows, members = [], []
    for offsets, ids in slices:
        matrix, which, text, kinds = sentences(offsets, ids)
        fresh = np.array([k for k, h in enumerate(kinds.tolist()) if h not in known], np.int64)
        known.update(zip(kinds[fresh].tolist(), range(len(known), len(known) + len(fresh)), strict=True))
        place = np.fromiter(map(known.__getitem__, kinds.tolist()), np.int64, len(kinds))
        padded = np.zeros((len(fresh), LONGEST), np.int32)
        padded[:, : matrix.shape[1]] = matrix[fresh]
        rows.append(padded)
        bounds = np.searchsorted(text, np.arange(len(offsets)))
        members += [np.unique(place[which[a:b]]) for a, b in zip(bounds, bounds[1:], strict=False)]
    matrix = np.concatenate(rows) if rows else np.zeros((0, LONGEST), np.int32)
    return matrix, members


@dataclass
class Network:
    """Embeddings, filters by width, and the linear layer. ``rows`` maps a bucket to its row of the embedding table."""

    rows: np.ndarray
    weights: dict[str, np.ndarray]

    def __post_init__(self) -> None:
        self._tables: dict | None = None

    def __getstate__(self) -> dict:
        return {"rows": self.rows, "weights": self.weights}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._tables = None

    def logits(self, matrix: np.ndarray) -> np.ndarray:
        """One logit for each sentence; responses of words to filter columns are looked up, not multiplied again."""
        if self._tables is None:
            e = self.weights["embed"]
            self._tables = {w: [e @ self.weights[f"f{w}"][j] for j in range(w)] for w in WIDTHS}
        out = np.empty(len(matrix), np.float32)
        length = (matrix != END).sum(1)
        order = np.argsort(length, kind="stable")
        for i in range(0, len(order), 2048):
            rows = order[i : i + 2048]
            longest = max(1, length[rows].max())
            m = np.pad(self.rows[matrix[rows, :longest]], ((0, 0), (0, max(WIDTHS) - 1)))
            beyond = None if length[rows[0]] == longest else np.arange(longest) >= length[rows, None]
            pooled = [self._pool(m, w, longest, beyond) for w in WIDTHS]
            out[rows] = np.concatenate(pooled, 1) @ self.weights["out"] + self.weights["bias"]
        return out

    def _pool(self, m: np.ndarray, w: int, n: int, beyond: np.ndarray | None) -> np.ndarray:
        """The greatest response among the windows that begin at a word; what pads a sentence takes no part beyond its last windows."""
        r = self._tables[w][0][m[:, :n]]
        for j in range(1, w):
            r += self._tables[w][j][m[:, j : j + n]]
        if beyond is not None:
            r[beyond] = -np.inf
        return np.maximum(r.max(1) + self.weights[f"b{w}"], 0)


def _forward(p: dict, m: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden values of sentences padded by ``max(WIDTHS) - 1`` at least, and what the way back needs."""
    n = m.shape[1] - max(WIDTHS) + 1
    beyond = m[:, :n] == END
    beyond[:, 0] = False
    e = p["embed"][m]
    pooled, saved = [], []
    for w in WIDTHS:
        win = np.concatenate([e[:, j : j + n] for j in range(w)], 2)
        r = win @ p[f"f{w}"].reshape(w * DIMENSIONS, FILTERS)
        r[beyond] = -np.inf
        at = r.argmax(1)
        best = np.take_along_axis(r, at[:, None, :], 1)[:, 0] + p[f"b{w}"]
        pooled.append(np.maximum(best, 0))
        saved.append((win, at, best > 0))
    h = np.concatenate(pooled, 1)
    return h, saved


def _grams(matrix: np.ndarray) -> np.ndarray:
    """Hashes of the runs of one to three words of each sentence (0 where there is none): sentence x place x length."""
    n, width = matrix.shape
    out = np.zeros((n, width, 3), np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros((n, width), np.uint64)
        whole = np.ones((n, width), bool)
        for k in range(3):
            word = np.zeros((n, width), np.int64)
            word[:, : width - k] = matrix[:, k:]
            whole &= word != END
            h = (h * np.uint64(0x100000001B3) + word.astype(np.uint64) + np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
            out[:, :, k] = np.where(whole, h | np.uint64(1), np.uint64(0))
    return out


@dataclass
class Runs:
    """The runs of one to three words in sentences: the kind, sentence, place and length of each occurrence, where each sentence begins, and how many kinds there are."""

    kind: np.ndarray
    sentence: np.ndarray
    place: np.ndarray
    size: np.ndarray
    bounds: np.ndarray
    kinds: int


def runs_of(matrix: np.ndarray) -> Runs:
    flat, sentence, place, size = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int8)], [np.empty(0, np.int8)]
    for i in range(0, len(matrix), 4096):
        part = matrix[i : i + 4096]
        g = _grams(part[:, : max(1, int((part != END).sum(1).max()))])
        at, where, k = there = np.nonzero(g)
        flat.append(g[there])
        sentence.append(at + i)
        place.append(where.astype(np.int8))
        size.append((k + 1).astype(np.int8))
    kinds, inverse = np.unique(np.concatenate(flat), return_inverse=True)
    sentence = np.concatenate(sentence)
    return Runs(inverse, sentence, np.concatenate(place), np.concatenate(size), np.searchsorted(sentence, np.arange(len(matrix) + 1)), len(kinds))


@dataclass
class Evidence:
    """For each sentence: the greatest log odds of its telling runs, that of all its runs, and the share of its words in telling runs."""

    strong: np.ndarray
    near: np.ndarray
    share: np.ndarray


def evidence(runs: Runs, members: list[np.ndarray], y: np.ndarray) -> Evidence:
    """Log odds, cases against others, of runs of words.

    Telling are runs that two cases and one in SUPPORT share, if no more than the share MIXED of their documents are others: what
    often stands beside an insult, a greeting or a closing word, stands in clean texts too, while an insult itself is in one
    only by a wrong verdict. They say which sentence of a case made it one, and which cases have none and are probably wrong verdicts.
    """
    counts = np.zeros((2, runs.kinds), np.float32)
    for m, label in zip(members, y, strict=True):
        counts[int(label), np.unique(np.concatenate([runs.kind[runs.bounds[k] : runs.bounds[k + 1]] for k in m]))] += 1
    totals = np.array([(y == 0).sum(), (y == 1).sum()]) + 1
    odds = np.log((counts[1] + 0.5) / totals[1]) - np.log((counts[0] + 0.5) / totals[0])
    n = len(runs.bounds) - 1
    near, strong = np.full(n, -np.inf), np.full(n, -np.inf)
    at = np.flatnonzero((odds > 0)[runs.kind])
    np.maximum.at(near, runs.sentence[at], odds[runs.kind[at]])
    odds[(counts[1] < max(2, (y == 1).sum() / SUPPORT)) | (counts[0] > MIXED * counts.sum(0))] = -np.inf
    at = np.flatnonzero((odds >= EVIDENCE)[runs.kind])
    np.maximum.at(strong, runs.sentence[at], odds[runs.kind[at]])
    covered = np.zeros((n, LONGEST), bool)
    for k in range(3):
        one = at[runs.size[at] > k]
        covered[runs.sentence[one], runs.place[one] + k] = True
    words_in = np.zeros(n)
    np.maximum.at(words_in, runs.sentence, runs.place + 1.0)
    return Evidence(strong, near, covered.sum(1) / np.maximum(words_in, 1))


def _train(matrix: np.ndarray, told: Evidence, members: list[np.ndarray], y: np.ndarray, n_rows: int, seed: int, steps: int = STEPS) -> dict[str, np.ndarray]:
    """Fit by Adam. ``members``: the sentences of each document; ``told``: the evidence of each sentence.

    Of a case, the candidates are its sentences with evidence; the one that the model takes for the worst is pushed up. Of the
    others all sentences are clean but those of wrong verdicts: most of their words are in telling runs, and they stand in no
    second clean document that cases don't outweigh. Those of the clean ones near to cases (any run that leans to them) that
    the model takes for the worst are chosen for half of the batch; which they are is looked up every REFRESH steps, in a third of them each time. Of a long
    clean sentence a stretch of CROP words is taken.
    """
    strong = told.strong
    rng = np.random.default_rng(seed)
    matrix = np.pad(matrix, ((0, 0), (0, max(WIDTHS) - 1)))
    p = {"embed": rng.normal(0, 0.3, (n_rows, DIMENSIONS)).astype(np.float32), "out": rng.normal(0, 0.15, FILTERS * len(WIDTHS)).astype(np.float32), "bias": np.array(-1.0, np.float32)}
    p["embed"][END] = 0
    for w in WIDTHS:
        p[f"f{w}"] = rng.normal(0, (1.0 / (w * DIMENSIONS)) ** 0.5, (w, DIMENSIONS, FILTERS)).astype(np.float32)
        p[f"b{w}"] = np.zeros(FILTERS, np.float32)
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    clean = [m for m, label in zip(members, y, strict=True) if not label]
    cases = [c for m, label in zip(members, y, strict=True) if label and len(c := m[strong[m] >= EVIDENCE])]
    clean_of = np.unique(np.concatenate(clean)) if clean else np.empty(0, np.int64)
    stands = np.zeros((2, len(matrix)))
    for m, label in zip(members, y, strict=True):
        stands[int(label), m] += 1
    clean_of = clean_of[(told.share[clean_of] < 0.6) | (stands[1, clean_of] < stands[0, clean_of] - 1)]
    if not cases or not len(clean_of):
        return p
    length = np.maximum((matrix != END).sum(1), 1)
    hard = worst = near = np.append(clean_of[1:][told.near[clean_of[1:]] > 1], clean_of[:1])
    chosen = np.array([c[np.argmax(strong[c])] for c in cases])
    several = np.unique(np.concatenate(cases))
    for step in range(1, steps + 1):
        if step % REFRESH == REFRESH // 2:
            net = Network(np.arange(n_rows), p)
            look = np.union1d(hard[: 4 * BATCH[1]], rng.choice(near, 1 + len(near) // 3, replace=False))
            order = look[np.argsort(-net.logits(matrix[look, :LONGEST]))]
            hard, worst = order[: 4 * BATCH[1]], order[: max(8 * BATCH[1], len(clean_of) // 50)]
            z = np.zeros(len(matrix), np.float32)
            z[several] = net.logits(matrix[several, :LONGEST])
            chosen = np.array([c[np.argmax(z[c])] for c in cases])
        quarter = BATCH[1] // 4
        pick = np.concatenate([chosen[rng.integers(len(cases), size=BATCH[0])], rng.choice(hard, quarter), rng.choice(worst, quarter), rng.choice(clean_of, 2 * quarter)])
        begin = (rng.random(len(pick)) * np.maximum(length[pick] - CROP + 1, 1)).astype(np.int64)
        begin[: BATCH[0]] = 0
        long_ = np.where(np.arange(len(pick)) < BATCH[0], length[pick], np.minimum(length[pick], CROP))
        span = np.arange(long_.max() + max(WIDTHS) - 1)
        m = np.where(span < long_[:, None], matrix[pick[:, None], np.minimum(begin[:, None] + span, matrix.shape[1] - 1)], END)
        t = np.full(len(pick), 0.01, np.float32)
        t[: BATCH[0]] = 0.98
        m = np.where((rng.random(m.shape) < 0.1) & (m > END), UNKNOWN, m)  # words in disguise are unknown ones
        h, saved = _forward(p, m)
        keep = (rng.random(h.shape) < 0.75).astype(np.float32) / 0.75
        z = (h * keep) @ p["out"] + p["bias"]
        g = (1 / (1 + np.exp(-z)) - t) / len(t)
        grad = {"out": (h * keep).T @ g, "bias": g.sum()}
        dh = np.outer(g, p["out"]) * keep
        de = np.zeros((*m.shape, DIMENSIONS), np.float32)
        which = np.arange(len(m))[:, None]
        for i, w in enumerate(WIDTHS):
            win, at, on = saved[i]
            dr = dh[:, i * FILTERS : (i + 1) * FILTERS] * on
            grad[f"f{w}"] = np.einsum("sf,sfk->kf", dr, win[which, at], optimize=False).reshape(w, DIMENSIONS, FILTERS)
            grad[f"b{w}"] = dr.sum(0)
            places = np.zeros((len(m), win.shape[1], FILTERS), np.float32)
            np.put_along_axis(places, at[:, None, :], dr[:, None, :], 1)
            back = places @ p[f"f{w}"].reshape(w * DIMENSIONS, FILTERS).T
            for j in range(w):
                de[:, j : j + back.shape[1]] += back[:, :, j * DIMENSIONS : (j + 1) * DIMENSIONS]
        rows, where = np.unique(m, return_inverse=True)
        order = np.argsort(where.ravel(), kind="stable")
        grad["embed"] = np.add.reduceat(de.reshape(-1, DIMENSIONS)[order], np.searchsorted(where.ravel()[order], np.arange(len(rows))))
        grad["embed"][rows == END] = 0
        rate = 0.012 * min(1, step / 20) * (1 - 0.85 * step / steps)
        for k in p:
            at = rows if k == "embed" else ...  # of the embeddings only those of the batch move
            gk = grad[k].astype(np.float32) + (1e-4 * p[k] if k[0] in "fo" else 0)
            m1[k][at] = 0.9 * m1[k][at] + 0.1 * gk
            m2[k][at] = 0.98 * m2[k][at] + 0.02 * gk * gk
            p[k][at] = (p[k][at] - rate * (m1[k][at] / (1 - 0.9**step)) / (np.sqrt(m2[k][at] / (1 - 0.98**step)) + 1e-7)).astype(np.float32)
    return p


def language(lang: str | None, text: str | None) -> str:
    """One of LANGUAGES or ``other``: by script where the script tells, else by the declared code."""
    t = text or ""
    if re.search("[぀-ヿ]", t):
        return "ja"
    if len(re.findall("[一-鿿]", t)) * 4 > len(t):
        return "zh"
    code = (lang or "").strip().lower()[:2]
    return code if code in LANGUAGES else "other"


@dataclass
class Model:
    vocabulary: Vocabulary
    network: Network
    held: Held | None = None

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """The worst sentence's logit for each text; minus infinity for texts without words."""
        offsets, ids = self.vocabulary.ids(texts)
        matrix, which, text, _ = sentences(offsets, ids)
        out = np.full(len(texts), -np.inf)
        if len(matrix):
            np.maximum.at(out, text, self.network.logits(matrix)[which])
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The same as a probability; 0 for texts without words."""
        return 1 / (1 + np.exp(-self.logits(texts)))

    def threshold(self, lang: str) -> float:
        """The threshold of a language when documents hold as many cases as the labelled ones."""
        limits = calibrate(self.held) if self.held is not None else {"*": 0.5}
        return limits.get(lang, limits["*"])


@dataclass
class Held:
    """Scores (logits) of labelled documents by networks that had not seen them, the verdicts, and the languages."""

    logit: np.ndarray
    y: np.ndarray
    lang: np.ndarray


def _prior(held: Held, counts: np.ndarray) -> float:
    """The share of cases among documents whose logits fall into the bins as ``counts``, by expectation maximisation."""
    place = np.digitize(held.logit, EDGES)
    f = [np.bincount(place[held.y == k], minlength=len(EDGES) + 1) + 0.2 for k in (0, 1)]
    f0, f1 = (x / x.sum() for x in f)
    p = float(held.y.mean())
    for _ in range(200):
        p = float((counts * p * f1 / (p * f1 + (1 - p) * f0)).sum() / counts.sum())
    return p


def _best_threshold(held: Held, prior: float) -> float:
    """The logit in the middle of those whose F1, were the share of cases ``prior``, is within a hundredth of the best."""
    order = np.argsort(-held.logit)
    z, y = held.logit[order], held.y[order]
    s1, s0 = np.cumsum(y) / max(1, y.sum()), np.cumsum(1 - y) / max(1, (1 - y).sum())
    f1 = 2 * prior * s1 / (prior * s1 + (1 - prior) * s0 + prior)
    good = np.flatnonzero(f1 >= 0.99 * f1.max())
    low = z[good[-1] + 1] if good[-1] + 1 < len(z) else z[good[-1]]
    return float(np.clip((z[good[0]] + low) / 2, EDGES[0], EDGES[-1]))


def calibrate(held: Held, population: dict[str, np.ndarray] | None = None, least: int = 12) -> dict[str, float]:
    """Thresholds by language and a common one (``*``) of greatest F1 on held-out labels.

    ``population``: how many of all documents of a language fall into each bin of EDGES. Reviewers are given more cases than there are, so the
    share of cases is estimated there, and the labels are weighted to it; without it their own share counts. A language of fewer than
    ``least`` labelled cases uses the common threshold; another's own one is shrunk towards it.
    """
    if held.y.sum() < least or held.y.all():
        return {"*": 0.5}
    sigmoid = lambda z: float(1 / (1 + np.exp(-z)))
    total = sum(population.values()) if population else None
    prior = _prior(held, total) if total is not None and total.sum() else float(held.y.mean())
    whole = _best_threshold(held, prior)
    out = {"*": sigmoid(whole)}
    for code in sorted(set(held.lang.tolist())):
        here = held.lang == code
        part = Held(held.logit[here], held.y[here], held.lang[here])
        n = int(part.y.sum())
        if n >= least and not part.y.all():
            counts = (population or {}).get(code)
            own = _best_threshold(part, _prior(held, counts) if counts is not None and counts.sum() >= 200 else prior)
            out[code] = sigmoid((n * own + 20 * whole) / (n + 20))
    return out


def fit(texts: list[str | None], langs: list[str], y: np.ndarray, seed: int = 7, folds: int = 3) -> Model:
    """Train on labelled texts. Each of ``folds`` parts is also scored by a network trained on the others, which calibrates the thresholds."""
    rng = np.random.default_rng(seed)
    raw = Vocabulary()
    slices = [raw.ids(texts[i : i + 500]) for i in range(0, len(texts), 500)]
    del raw
    seen = np.zeros(BUCKETS, np.int32)
    for offsets, ids in slices:
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        seen += np.bincount(np.unique(text * np.int64(BUCKETS) + ids) % BUCKETS, minlength=BUCKETS).astype(np.int32)
    seen[:RESERVED] = 0
    vocabulary = Vocabulary(seen >= 2)
    kept = np.where(vocabulary.known | (np.arange(BUCKETS) < RESERVED), np.arange(BUCKETS), UNKNOWN).astype(np.int32)
    rows = np.zeros(BUCKETS, np.int32)
    rows[:RESERVED] = np.arange(RESERVED)
    used = np.flatnonzero(vocabulary.known)
    rows[used] = RESERVED + np.arange(len(used))
    matrix, members = all_sentences([(offsets, kept[ids]) for offsets, ids in slices])
    del slices
    matrix = rows[matrix]
    usable = np.flatnonzero([len(m) > 0 for m in members])
    runs = runs_of(matrix)

    def train(at: np.ndarray, seed: int, steps: int = STEPS) -> Network:
        own = [members[i] for i in at]
        return Network(np.arange(RESERVED + len(used)), _train(matrix, evidence(runs, own, y[at]), own, y[at], RESERVED + len(used), seed, steps))

    fold = np.empty(len(texts), int)
    for label in (0, 1):  # cases and others spread evenly over the parts
        which = rng.permutation(np.flatnonzero(y == label))
        fold[which] = np.arange(len(which)) % folds
    logit = np.zeros(len(texts), np.float32)
    if y[usable].sum() >= 12:
        for k in range(folds):
            at = usable[fold[usable] == k]
            mine = np.unique(np.concatenate([members[i] for i in at])) if len(at) else at
            z = np.zeros(len(matrix), np.float32)
            z[mine] = train(usable[fold[usable] != k], seed + 1 + k, STEPS * 2 // 3).logits(matrix[mine])
            logit[at] = [z[members[i]].max() for i in at]
    network = train(usable, seed)
    network.rows = rows
    return Model(vocabulary, network, Held(logit[usable], y[usable], np.array([langs[i] for i in usable], object)))


def labelled(documents: DataFrame, labels: DataFrame, doc: str = "doc_id", bound: int = MAX_LABELLED, room: int = MAX_TEXT) -> DataFrame:
    """Labelled documents: text, lang and the reviewers' majority (drawn votes are left out).

    At most ``bound`` of them, chosen by hash, of which as many as have ``room`` bytes of text together.
    """
    votes = labels.filter(F.col("toxic").isNotNull()).groupBy(doc).agg(F.avg("toxic").alias("y")).filter("y <> 0.5")
    picked = votes.orderBy(F.xxhash64(doc), doc).limit(bound)
    texts = documents.join(F.broadcast(picked), doc).select(doc, "text", "lang", F.round("y").cast("int").alias("y"))  # ``picked`` is bounded
    before = Window.orderBy(F.xxhash64(doc), doc).rowsBetween(Window.unboundedPreceding, 0)  # at most ``bound`` rows
    return texts.withColumn("_size", F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(before)).filter(F.col("_size") <= room).drop("_size")


def fit_on(documents: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> Model:
    rows = sorted(labelled(documents, labels, bound=bound).collect(), key=lambda r: r["doc_id"])  # bounded in rows and bytes
    return fit([r["text"] for r in rows], [language(r["lang"], r["text"]) for r in rows], np.array([r["y"] for r in rows], int))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, source, score (0 to 1) and flagged of every document; null and empty texts score 0 and aren't flagged.

    The scores are written once; their histogram by language (at most one row for each bin and language) calibrates the thresholds.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(Model(model.vocabulary, model.network))  # bounded by the buckets

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            texts, langs = b.column("text").to_pylist(), b.column("lang").to_pylist()
            z = np.concatenate([shared.value.logits(texts[i : i + 1000]) for i in range(0, len(texts), 1000)]) if texts else np.empty(0)
            codes = [language(x, t) for x, t in zip(langs, texts, strict=True)]
            place = pa.array(np.digitize(z, EDGES).astype(np.int32), mask=np.isneginf(z))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(codes, pa.string()), pa.array(1 / (1 + np.exp(-z))), place], names=["doc_id", "source", "code", "score", "bin"])

    scored = documents.select("doc_id", "text", "lang", "source").mapInArrow(run, "doc_id long, source string, code string, score double, bin int")
    scored = materialize(scored, "toxicity-scores")
    population: dict[str, np.ndarray] = {}
    for r in scored.filter("bin is not null").groupBy("code", "bin").agg(F.count("*").alias("n")).collect():
        population.setdefault(r["code"], np.zeros(len(EDGES) + 1))[r["bin"]] = r["n"]
    limits = calibrate(model.held, population) if model.held is not None else {"*": 0.5}
    limit = F.lit(limits["*"])
    for code, value in limits.items():
        limit = F.when(F.col("code") == code, F.lit(value)).otherwise(limit)
    return scored.select("doc_id", "source", "score", (F.col("bin").isNotNull() & (F.col("score") >= limit)).alias("flagged"))


def rates(scored: DataFrame, by: Column | str = "source") -> DataFrame:
    """Documents, flagged ones and their rate per source; documents without a source are a group of their own."""
    return scored.groupBy(by).agg(F.count("*").alias("documents"), F.count_if("flagged").alias("flagged"), F.avg(F.col("flagged").cast("int")).alias("rate"))
