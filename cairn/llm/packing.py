"""Filling fixed-capacity containers with items (problem 8): the configuration linear program.

Only the histogram of lengths matters to the program, and it has at most ``capacity`` rows, so it is solved on the driver:

* Items longer than a container fill whole containers of their own; what is left of them takes part like any item.
* The program (fewest containers whose patterns cover every length's count) is solved by multiplicative weights: the lengths
  are experts, one knapsack dynamic program gives the best pattern with each length in it under their weights, those that
  are nearly worth most are used in proportion to the weight of their lengths, and lengths that are covered more than others
  lose weight. The average of the answers is the fractional solution; the weights give a lower bound on the containers.
* It is rounded in turns: patterns are made as often as they are used, rounded down, then the knapsack's table is read for
  patterns of what is left that are nearly worth most, until half is packed, and the rest is a smaller program that begins with the
  last prices. Only the last hundredth is packed by best fit decreasing, whose
  count for the whole histogram is reported beside the program's but is never used.

The patterns say how many containers take how many items of which length. Items are then numbered within their length in
a distributed way (no length is gathered in one task) and look up their container in that table by binary search.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import global_index, materialize

CAPACITY = 2048


@dataclass
class Plan:
    """``runs``: (containers, {length: items in each}); ``bound``: containers that any packing needs, from the program's dual;
    ``greedy``: what best fit decreasing would need, for comparison only."""

    runs: list[tuple[int, dict[int, int]]]
    bound: int
    greedy: int

    @property
    def containers(self) -> int:
        return sum(n for n, _ in self.runs)


def knapsack(lengths: np.ndarray, worth: np.ndarray, most: np.ndarray, capacity: int) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """The greatest worth of a pattern within each room up to ``capacity``, at most ``most`` items of each length, and what tells the patterns:
    (index of length, items, the rooms where they were taken), to be read backwards.

    One pass over the lengths for each power of two, each an array operation over the capacities, so a length's bound is
    kept by the usual binary splitting. Lengths are thinned first: among those whose worth a shorter one exceeds none can
    be in a best pattern unless the shorter one runs out, so they are kept only where the shorter one's bound is small.
    Long lengths come first, so of equally good patterns the one of few long items is told, which leaves the short ones for later.
    """
    value = np.zeros(capacity + 1)
    taken: list[tuple[int, int, np.ndarray]] = []
    kept: list[int] = []
    best, room = 0.0, 0
    for k in range(len(lengths)):  # rising lengths
        if worth[k] <= best and room >= capacity // lengths[k]:
            continue
        kept.append(k)
        if worth[k] > best:
            best, room = worth[k], int(most[k])
        else:
            room += int(most[k])
    for k in reversed(kept):
        left, part = int(min(most[k], capacity // lengths[k])), 1
        while left > 0:
            part = min(part, left)
            size = part * int(lengths[k])
            other = value[: capacity + 1 - size] + part * worth[k]
            use = np.zeros(capacity + 1, bool)
            np.greater(other, value[size:] + 1e-12 * worth[k], out=use[size:])
            if use.any():
                np.maximum(value[size:], other, out=value[size:])
                taken.append((k, part, use))
            left -= part
            part *= 2
    return value, taken


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Pack a histogram; equal containers are told together, so the work follows the number of distinct contents."""
    spaces: list[int] = []  # distinct free spaces, sorted
    open_: dict[int, Counter] = {}  # free space -> contents (sorted tuple) -> containers

    def put(space: int, content: tuple, n: int) -> None:
        if space not in open_:
            open_[space] = Counter()
            insort(spaces, space)
        open_[space][content] += n

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            i = bisect_left(spaces, length)
            if i == len(spaces):
                per = capacity // length
                full, rest = divmod(n, per)
                if full:
                    put(capacity - per * length, ((length, per),), full)
                if rest:
                    put(capacity - rest * length, ((length, rest),), 1)
                break
            space = spaces[i]
            content, have = next(iter(open_[space].items()))
            per = space // length
            count = min(have, n // per)
            if not count:
                per, count = n, 1
            n -= per * count
            open_[space][content] -= count
            if not open_[space][content]:
                del open_[space][content]
                if not open_[space]:
                    del open_[space]
                    spaces.pop(i)
            put(space - per * length, (*content, (length, per)), count)
    return [(n, dict(content)) for contents in open_.values() for content, n in contents.items()]


def price(lengths: np.ndarray, need: np.ndarray, w: np.ndarray, capacity: int) -> tuple[float, list[tuple], np.ndarray]:
    """What the best pattern is worth if covering length k once is worth ``w[k]``, the best pattern with each length in it, and their worths.

    One dynamic program serves them all: a length takes its place, and the best that fits beside it is read off the table.
    """
    item = w / need
    value, taken = knapsack(lengths, item, need, capacity)
    room = capacity - lengths
    count = np.zeros((len(lengths), len(room)), np.int32)
    for k, part, use in reversed(taken):
        here = use[room]
        count[k, here] += part
        room[here] -= part * int(lengths[k])
    count[np.arange(len(lengths)), np.arange(len(room))] += 1
    count = np.minimum(count, np.minimum(need, capacity).astype(np.int32)[:, None])  # no pattern holds more than there are
    j, k = np.nonzero(count.T)
    n = count[k, j]
    ends = np.searchsorted(j, np.arange(1, len(room)))
    patterns = [tuple(zip(a.tolist(), c.tolist(), strict=True)) for a, c in zip(np.split(k, ends), np.split(n, ends), strict=True)]
    return float(value[capacity]), patterns, np.bincount(j, n * item[k], len(room))


@dataclass
class Solution:
    """A fractional solution: ``uses`` of patterns ((index of length, items), ...), and prices of each length at which the best pattern is
    worth 1: those of the best bound (``tight``) and the average."""

    uses: dict[tuple, float]
    tight: np.ndarray
    average: np.ndarray
    bound: float


def weigh(lengths: np.ndarray, need: np.ndarray, capacity: int, item: np.ndarray, rounds: int, step: float = 0.25, near: float = 0.03) -> Solution:
    """The program by multiplicative weights, beginning with the prices ``item``.

    Lengths are the experts, their weight is the price of all their items. In each round the knapsack gives the best pattern with each
    length in it; those within ``near`` of the best are used, each in proportion to the weight of its length, so the answer covers
    many lengths at once. A length loses weight as far as it is covered more than the others. The solution is the average of the
    answers of the later half; every round's prices, divided by what the best pattern is worth, bound the containers from below,.
    """
    w = item * need
    bound, tight, total, prices = 0.0, w, Counter(), np.zeros(len(need))
    for t in range(rounds):
        w = w / w.sum()
        best, patterns, worth = price(lengths, need, w, capacity)
        if 1 / best > bound:
            bound, tight = 1 / best, w / best
        used = np.flatnonzero(worth >= (1 - near) * best)
        share = w[used] / w[used].sum() / best  # containers
        row = np.array([k for j in used for k, _ in patterns[j]], np.int64)
        part = np.array([n for j in used for _, n in patterns[j]], float)
        cover = np.bincount(row, part * np.repeat(share, [len(patterns[j]) for j in used]), len(need)) / need
        if 2 * t >= rounds - 1:
            prices += w / best
            for j, x in zip(used.tolist(), share.tolist(), strict=True):
                total[patterns[j]] += x
        w = w * np.exp(-step / (1 + t / 15) * (np.minimum(cover, 3) - 1))
    later = rounds - rounds // 2
    w = prices / prices.sum()
    best = price(lengths, need, w, capacity)[0]
    if 1 / best > bound:
        bound, tight = 1 / best, w / best
    return Solution({p: x / later for p, x in total.items()}, tight / need, w / best / need, bound * (1 - 1e-9))


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = 50, again: int = 8, turns: int = 30) -> Plan:
    """A packing of ``histogram`` (length -> items, every length from 1 to ``capacity``).

    The program is solved and rounded in turns, each of which packs up to half of what is left; the rest is a smaller program, whose
    weights begin with the last prices. What remains in the end, a hundredth or less than eight containers, is packed by best fit decreasing.
    Rounding follows the prices of the best bound; if that needs more than 0.2 % above the bound, it is done again at the average
    prices, and the better of the two is taken.
    """
    if any(not 0 < x <= capacity for x in histogram):
        raise ValueError("lengths must lie between 1 and the capacity")
    histogram = {int(x): int(n) for x, n in sorted(histogram.items()) if n}
    total = sum(x * n for x, n in histogram.items())
    bound, best = total / capacity, None
    for tight in (True, False):
        left, runs, prices = dict(histogram), [], {x: x / capacity for x in histogram}
        for turn in range(turns):
            if sum(x * n for x, n in left.items()) <= max(total / 100, 8 * capacity):
                break
            lengths, need = np.array(list(left)), np.array(list(left.values()), float)
            more = min(2.0 if turn else 4.0, max(1.0, 600 / len(left)))  # a round takes less time with fewer lengths
            if turn or tight:
                got = weigh(lengths, need, capacity, np.array([prices[x] for x in left]), int((again if turn else rounds) * more))
            if not turn:
                got, first = (got, got) if tight else (first, first)
                bound = max(bound, got.bound)
            item = got.tight if tight else got.average
            prices = dict(zip(lengths.tolist(), np.maximum(item, 1e-9).tolist(), strict=True))
            for n, content in _round(lengths, need, got.uses, item, capacity):
                runs.append((n, content))
                for x, c in content.items():
                    left[x] -= n * c
            left = {x: n for x, n in left.items() if n}
        runs += best_fit_decreasing(left, capacity)
        if best is None or sum(n for n, _ in runs) < sum(n for n, _ in best):
            best = runs
        if sum(n for n, _ in best) <= 1.002 * bound + 1:
            break
    return Plan(best, int(np.ceil(bound - 1e-6)), sum(n for n, _ in best_fit_decreasing(histogram, capacity)))


def _round(lengths: np.ndarray, need: np.ndarray, used: dict[tuple, float], item: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Whole containers (containers, content) for about half of the items.

    Every pattern is made by the whole part of its use. If that packs less than half, the knapsack's table at the solution's prices is
    read once more, from the longest length on: each time the best pattern of what is still there, if it is worth nearly as much as
    the best of all; first those that miss it least.
    """
    left = need.astype(np.int64)
    size = lengths.tolist()
    quota, packed, made = float((lengths * need).sum()) / 2, 0, []

    def take(pattern: tuple, n: int) -> None:
        nonlocal packed
        n = min(n, *(int(left[k]) // c for k, c in pattern))
        if n > 0:
            for k, c in pattern:
                left[k] -= n * c
                packed += n * c * size[k]
            made.append((n, {size[k]: c for k, c in pattern}))

    for pattern, uses in sorted(used.items(), key=lambda x: -x[1]):
        if uses < 1:
            break
        take(pattern, int(uses + 1e-9))
    if packed >= quota:
        return made
    value, taken = knapsack(lengths, item, left.astype(float), capacity)
    steps = [(k, n, use.tolist()) for k, n, use in reversed(taken)]
    for short in (0.002, 0.01, 0.03, 0.1, 1.0):
        for i in range(len(size) - 1, -1, -1):
            while left[i] > 0 and packed < quota:
                room, worth, pattern = capacity - size[i], item[i], {i: 1}
                for k, n, use in steps:
                    if use[room] and left[k] >= pattern.get(k, 0) + n:
                        pattern[k] = pattern.get(k, 0) + n
                        worth += n * item[k]
                        room -= n * size[k]
                if worth < (1 - short) * value[capacity]:
                    break
                take(tuple(pattern.items()), max(1, min(int(left[k]) // c for k, c in pattern.items()) // 4))
        if packed >= quota or (made and short >= 0.03):
            break
    return made


def _slots(plan: Plan) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first item number, first container and items in each container of the runs that take it."""
    rows: dict[int, list[list[int]]] = {}
    container = 0
    for n, content in plan.runs:
        for length, per in content.items():
            rows.setdefault(length, []).append([n * per, container, per])
        container += n
    out = {}
    for length, r in rows.items():
        a = np.array(r, np.int64)
        out[length] = (np.cumsum(a[:, 0]) - a[:, 0], a[:, 1], a[:, 2])
    return out


def pack(items: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> tuple[DataFrame, Plan]:
    """Assign every item to containers: key, piece, size (of the piece), container; and the plan of the shared containers.

    Items of null or non-positive size take no room: they come out with size 0 and a null container. An item above the
    capacity is split: whole containers of its own (numbered after the shared ones), and a last piece that is packed like
    any item. ``key`` must be unique. Equal sizes are interchangeable; the key decides who goes where.
    """
    spark = items.sparkSession
    c = F.lit(capacity)
    items = materialize(items.select(F.col(key), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size")), "pack-sizes")
    kind = items.schema[key].dataType.simpleString()
    some = items.filter("size > 0").withColumn("whole", F.floor(F.col("size") / c)).withColumn("rest", F.col("size") % c)
    indexed = global_index(some, ["rest", key], "pack-items", ["rest"])  # written once; a rest of 0 has no shared piece
    histogram = {r["rest"]: r["n"] for r in indexed.filter("rest > 0").groupBy("rest").agg(F.count("*").alias("n")).collect()}  # under ``capacity`` rows
    plan = solve(histogram, capacity)
    slots = spark.sparkContext.broadcast(_slots(plan))  # bounded by the plan: patterns x lengths in them

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rest, at = b.column("rest").to_numpy(), b.column("row_index").to_numpy()
            out = np.zeros(len(rest), np.int64)
            for length in np.unique(rest):
                here = rest == length
                first, container, per = slots.value[int(length)]
                i = np.searchsorted(first, at[here], "right") - 1
                out[here] = container[i] + (at[here] - first[i]) // per[i]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column("whole").cast(pa.int32()), b.column("rest"), pa.array(out)], names=[key, "piece", "size", "container"])

    schema = f"`{key}` {kind}, piece int, size long, container long"
    shared = indexed.filter("rest > 0").select(key, "whole", "rest", "row_index").mapInArrow(place, schema)
    long_ = indexed.filter("whole > 0").select(key, "whole")
    long_ = global_index(long_.select(key, F.explode(F.sequence(F.lit(0), (F.col("whole") - 1).cast("int"))).alias("piece")), [key, "piece"], "pack-wholes")
    alone = long_.select(key, "piece", c.cast("long").alias("size"), (F.col("row_index") + plan.containers).alias("container"))
    empty = items.filter("size <= 0").select(key, F.lit(0).alias("piece"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("long").alias("container"))
    return shared.unionByName(alone).unionByName(empty), plan


def container_report(packed: DataFrame, plan: Plan, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, free room, the share of room that is filled, and of the shared containers how many the program
    needs, at least how many any packing does, and how many best fit decreasing would."""
    alone = F.count_if(F.col("container") >= plan.containers)  # whole containers of one item, a row each
    out = packed.agg((alone + plan.containers).alias("containers"), F.coalesce(F.sum("size"), F.lit(0)).alias("tokens"))
    out = out.withColumn("free", F.col("containers") * capacity - F.col("tokens")).withColumn("filled", F.round(F.try_divide("tokens", F.col("containers") * capacity), 6))
    return out.withColumn("program", F.lit(plan.containers)).withColumn("bound", F.lit(plan.bound)).withColumn("best_fit_decreasing", F.lit(plan.greedy))
