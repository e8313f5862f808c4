"""Encoding of a whole corpus with a public byte-level BPE (problem 7).

The text is split by the tokenizer's pattern, and each distinct pre-token is encoded once by a worker, in two tiers:

1. a minimal perfect hash over the vocabulary (hash and displace, one slot for each token, built from the rank file)
   resolves the pre-tokens that are tokens already, for a whole batch by array operations;
2. the misses are merged with a heap over linked bytes, in O(n log n) of the pre-token's length.

A batch costs one dictionary look-up for each chunk between spaces (pre-tokens never cross a space that a word follows);
ids are then gathered with numpy into an Arrow list. The rank
file's path is a parameter; the driver reads it and broadcasts the encoder, whose size is the vocabulary's.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the contractions and classes of the public pattern; L, N and s are Unicode letters, numbers and white space.
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{s}{L}{N}]+|[{s}]+(?![^{s}])|[{s}]+"
SLICE_CHARS = 1 << 20
ODD_SPACE = re.compile(r" (?:\s|$)|\x00")
MAX_CACHED = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


@lru_cache(maxsize=1)
def pre_token_pattern() -> str:
    """The public pattern with its classes spelled as ranges, for the standard library's faster engine."""
    import regex

    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))

    def ranges(what: str) -> str:
        spans = []
        for m in regex.finditer(f"{what}+", every):
            a, b = m.group()[0], m.group()[-1]
            for lo, hi in ((a, min(b, "퟿")), (max(a, ""), b)):  # no range across the surrogates
                if lo <= hi:
                    spans.append(f"\\U{ord(lo):08x}" + (f"-\\U{ord(hi):08x}" if hi > lo else ""))
        return "".join(spans)

    return PATTERN.format(L=ranges(r"\p{L}"), N=ranges(r"\p{N}"), s=ranges(r"\s"))


def _hashes(keys: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, keys), np.uint64, len(keys))


class PerfectHash:
    """A minimal perfect hash over byte strings: n keys in n slots, by hash and displace.

    A key's bucket has a displacement d; its slot is a mix of hash and d modulo n. Buckets are placed from the largest;
    those of one key take what slots are left, written as a negative displacement.
    """

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.buckets = max(1, n // 2)
        h = _hashes(keys)
        bucket = self._bucket(h)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(bounds)
        self.shift = np.zeros(self.buckets, np.int64)
        taken, slot_of = np.zeros(n, bool), np.empty(n, np.int64)
        singles = []
        for b in np.argsort(-sizes, kind="stable"):
            members = order[bounds[b] : bounds[b + 1]]
            if len(members) == 0:
                break
            if len(members) == 1:
                singles.append((b, members[0]))
                continue
            first = 1
            while True:  # a block of displacements at a time
                d = np.arange(first, first + 32)
                at = self._slot(h[members][None, :], d[:, None])
                free = np.flatnonzero(~taken[at].any(1))
                good = next((k for k in free if len(set(at[k].tolist())) == len(members)), None)
                if good is not None:
                    break
                first += 32
            taken[at[good]], slot_of[members], self.shift[b] = True, at[good], d[good]
        for (b, member), at in zip(singles, np.flatnonzero(~taken)[: len(singles)], strict=True):
            slot_of[member], self.shift[b] = at, -1 - at
        self.order = np.empty(n, np.int64)
        self.order[slot_of] = np.arange(n)

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)

    def _slot(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (h ^ (d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x >> np.uint64(29)) % np.uint64(self.n)).astype(np.int64)

    def index(self, keys: list[bytes]) -> np.ndarray:
        """For each key the index of the one vocabulary entry it can be; the caller compares them."""
        h = _hashes(keys)
        d = self.shift[self._bucket(h)]
        return self.order[np.where(d < 0, -1 - d, self._slot(h, np.maximum(d, 0)))]


def heap_merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of lowest rank is merged first, the leftmost of equal ones."""
    n = len(piece)
    end, left = list(range(1, n + 1)), list(range(-1, n - 1))  # a symbol is known by its first byte; end 0: merged away
    get = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            left[stop] = i
            if (r := get(piece[i : end[stop]])) is not None:
                heappush(heap, (r, i, end[stop]))
        p = left[i]
        if p >= 0 and (r := get(piece[p:stop])) is not None:
            heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """A byte-level BPE with a growing table of encoded pre-tokens; what ``encode`` gives does not depend on that table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.tokens = list(ranks)
        self.ids = np.fromiter(ranks.values(), np.int32, len(ranks))
        self.hash = PerfectHash(self.tokens)
        self._clear()

    def __getstate__(self) -> dict[str, Any]:
        return {k: getattr(self, k) for k in ("ranks", "pattern", "tokens", "ids", "hash")}

    def __setstate__(self, state: dict[str, Any]) -> None:
        self.__dict__.update(state)
        self._clear()

    def _clear(self) -> None:
        self.pieces: dict[str, list[int]] = {}
        self.known: dict[str, int] = {}
        self.flat = np.empty(0, np.int32)
        self.start, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.find = re.compile(self.pattern).findall

    def _resolve(self, pieces: list[str]) -> None:
        """Encode distinct, unknown pre-tokens: the perfect hash for all at once, the heap for its misses."""
        raw = [p.encode() for p in pieces]
        for p, key, i in zip(pieces, raw, self.hash.index(raw).tolist(), strict=True):
            self.pieces[p] = [int(self.ids[i])] if self.tokens[i] == key else heap_merge(key, self.ranks)

    def _learn(self, chunks: list[str]) -> None:
        """Add distinct, unknown chunks to the table."""
        split = [self.find(c) for c in chunks]
        new = [p for p in dict.fromkeys(chain.from_iterable(split)) if p not in self.pieces]
        if new:
            self._resolve(new)
        ids = [list(chain.from_iterable(map(self.pieces.__getitem__, s))) for s in split]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))])
        self.known.update(zip(chunks, range(len(self.known), len(self.known) + len(chunks)), strict=True))

    def _chunks(self, text: str | None) -> list[str]:
        """The text cut before every space that is followed by something else than white space.

        The pattern always begins a pre-token there, and what precedes it ends as it would at a text's end; so the chunks
        can be encoded one by one. Texts with other spaces are split into their pre-tokens.
        """
        if not text:
            return []
        if ODD_SPACE.search(text):
            return self.find(text)
        return text.replace(" ", "\x00 ").split("\x00")

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (one more than texts) and ids of a batch; null and empty texts have no ids."""
        offsets, parts = [np.zeros(1, np.int64)], []
        i = 0
        while i < len(texts):
            j, chars = i, 0
            while j < len(texts) and (j == i or chars + len(texts[j] or "") <= SLICE_CHARS):
                chars += len(texts[j] or "")
                j += 1
            off, ids = self._encode_slice(texts[i:j])
            offsets.append(off + offsets[-1][-1])
            parts.append(ids)
            i = j
        return np.concatenate(offsets), np.concatenate(parts) if parts else np.empty(0, np.int32)

    def _encode_slice(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > MAX_CACHED:
            self._clear()
        split = [self._chunks(t) for t in texts]
        chunks = list(chain.from_iterable(split))
        known = self.known
        new = [c for c in dict.fromkeys(chunks) if c not in known]
        if new:
            self._learn(new)
        codes = np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))
        size = self.size[codes]
        before = np.cumsum(size) - size
        ids = self.flat[np.arange(int(size.sum())) - np.repeat(before - self.start[codes], size)]
        ends = np.cumsum([len(s) for s in split])
        upto = np.concatenate([[0], np.cumsum(size)])
        return upto[ends], ids

    def decode(self, ids: list[int]) -> str:
        of = dict(zip(self.ids.tolist(), self.tokens, strict=True))
        return b"".join(of[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str = f"{TOKENIZERS}/{VOCABULARY}") -> Encoder:
    return Encoder(read_ranks(path), pre_token_pattern())


def _shared(spark: SparkSession, path: str) -> Any:
    return spark.sparkContext.broadcast(encoder(path))


def encode(df: DataFrame, key: str, text: str, path: str = f"{TOKENIZERS}/{VOCABULARY}", ids: str = "ids") -> DataFrame:
    """``key`` and ``ids`` of every row: the token ids of ``text``. Null and empty texts give an empty list; repeated rows stay repeated; other columns are left out."""
    shared = _shared(df.sparkSession, path)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            offsets, flat = shared.value.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))], names=[key, ids])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, `{ids}` array<int>")


def count_tokens(df: DataFrame, key: str, text: str, path: str = f"{TOKENIZERS}/{VOCABULARY}", size: str = "n_tokens") -> DataFrame:
    """``key`` and the number of tokens of ``text``; 0 for null and empty texts."""
    shared = _shared(df.sparkSession, path)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            offsets, _ = shared.value.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets), pa.int64())], names=[key, size])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, `{size}` long")
