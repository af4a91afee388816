"""Packing items of varying length into containers of fixed capacity.

Only the histogram of lengths is planned, so the plan's size is bounded by the
capacity and not by the rows:

1. A container is divided into windows. Length combinations of depth two and
   three whose parts beyond whole windows fill a window exactly are enumerated;
   non-negative least squares (active sets) finds how often to repeat each so
   that together they use up the histogram; the counts are rounded.
2. Filled blocks of windows are put together into containers.
3. What is left is packed greedily, largest first, in bulk: one composition at a
   time, repeated while its lengths last.

Items are then numbered within their length and find their slot in the plan. The
numbering splits every length by a hash, so a third of all rows having one
length is no single task.

Items larger than the capacity are split into full containers and a rest; no
other item is split. Defined results: empty items have no container (null) and
stay in the result; capacities below 1 or null are ignored; equal rows are items
of their own as long as their keys differ.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.session import shipped, stored

#: Longest window.
WINDOW = 512

Composition = list[tuple[int, int]]  # (length, how many of it)


def combinations(parts: list[int], window: int) -> np.ndarray:
    """Pairs and triples (the third then is 0 in pairs) of lengths that fill a window."""
    present = set(parts)
    found = [(a, window - a, 0) for a in parts if a <= window - a and window - a in present]
    ordered = sorted(present)
    for i, a in enumerate(ordered):
        for b in ordered[i:]:
            c = window - a - b
            if c < b:
                break
            if c in present:
                found.append((a, b, c))
    return np.array(found, dtype=np.int64).reshape(-1, 3)


def nnls(columns: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Non-negative x minimising |A x - target|, by active sets; column j of A
    counts the lengths columns[j] (0 is no length)."""
    n = len(columns)
    x = np.zeros(n)
    if not n:
        return x
    residual = target.astype(float).copy()
    residual[0] = 0
    passive: list[int] = []
    member = np.zeros(n, bool)
    dense = np.zeros((len(target), 0))
    # The inverse of dense.T @ dense and dense.T @ target follow each column that comes or goes.
    inverse, right = np.zeros((0, 0)), np.zeros(0)
    goal = residual.copy()
    scale = max(residual.max(), 1.0)
    for _ in range(3 * len(target)):
        gain = residual[columns].sum(1)
        gain[member] = -np.inf
        j = int(gain.argmax())
        if gain[j] <= 1e-6 * scale or len(passive) >= np.count_nonzero(target[1:]):
            break
        passive.append(j)
        member[j] = True
        column = np.bincount(columns[j], minlength=len(target)).astype(float)
        column[0] = 0
        met = dense.T @ column
        inverse = _with_row(inverse, met, column @ column + 1e-9)
        right = np.append(right, column @ goal)
        dense = np.column_stack([dense, column])
        if dense.shape[1] % 64 == 0:  # rounding errors do not pile up
            inverse = np.linalg.inv(dense.T @ dense + 1e-9 * np.eye(dense.shape[1]))
        while True:
            best = inverse @ right
            if best.min() > 0:
                break
            own = x[passive]
            worse = best <= 0
            step = np.min(own[worse] / (own[worse] - best[worse] + 1e-12))
            own = own + step * (best - own)
            keep = own > 1e-10
            x[passive] = np.where(keep, own, 0)
            for k in np.flatnonzero(~keep)[::-1]:
                inverse = _without_row(inverse, k)
            dense, right = dense[:, keep], right[keep]
            member[[p for p, k in zip(passive, keep) if not k]] = False
            passive = [p for p, k in zip(passive, keep) if k]
            if not passive:
                best = np.zeros(0)
                break
        x[passive] = best
        residual = goal - dense @ best if passive else goal.copy()
        residual[0] = 0
    return x


def _with_row(inverse: np.ndarray, met: np.ndarray, own: float) -> np.ndarray:
    """The inverse of a symmetric matrix that gets one more row and column."""
    part = inverse @ met
    rest = 1 / max(own - met @ part, 1e-12)
    return np.block([[inverse + rest * np.outer(part, part), -rest * part[:, None]], [-rest * part[None, :], np.full((1, 1), rest)]])


def _without_row(inverse: np.ndarray, k: int) -> np.ndarray:
    """The inverse of a symmetric matrix that loses a row and its column."""
    kept = np.arange(len(inverse)) != k
    return inverse[np.ix_(kept, kept)] - np.outer(inverse[kept, k], inverse[k, kept]) / inverse[k, k]


class Stock:
    """Items left: by part beyond whole windows, by whole windows."""

    def __init__(self, lengths: dict[int, int], window: int):
        self.window = window
        self.by: dict[int, dict[int, int]] = defaultdict(dict)
        for length, n in lengths.items():
            if n:
                self.by[length % window][length // window] = n

    def left(self, part: int) -> int:
        return sum(self.by[part].values())

    def take(self, part: int, whole: int, n: int) -> None:
        self.by[part][whole] -= n
        if not self.by[part][whole]:
            del self.by[part][whole]

    def rest(self) -> dict[int, int]:
        return {part + whole * self.window: n for part, own in self.by.items() for whole, n in own.items()}


def _fill_windows(stock: Stock, patterns: np.ndarray, repeats: np.ndarray, most: int) -> dict[int, list[list]]:
    """Blocks of exactly filled windows: {windows: [[lengths], count]}."""
    blocks: dict[int, list[list]] = defaultdict(list)
    for j in np.argsort(-repeats, kind="stable"):
        n = int(round(repeats[j]))
        if n <= 0:
            break
        parts = [int(p) for p in patterns[j] if p]
        while n > 0:
            wholes, used = [], defaultdict(int)
            for i, part in enumerate(parts):
                own = {w: c for w, c in stock.by[part].items() if c > used.get((part, w), 0)}
                if not own:
                    break
                # At most one long item a block; the others are as short as can be.
                room = most - 1 - sum(wholes) - sum(min(stock.by[p], default=0) for p in parts[i + 1 :])
                fitting = [w for w in own if w <= room]
                if not fitting:
                    break
                w = max(fitting) if i == 0 else min(fitting)
                used[part, w] += 1
                wholes.append(w)
            if len(wholes) < len(parts):
                break
            m = min([n, *(stock.by[p][w] // k for (p, w), k in used.items())])
            for (p, w), k in used.items():
                stock.take(p, w, k * m)
            blocks[1 + sum(wholes)].append([[p + w * stock.window for p, w in zip(parts, wholes)], m])
            n -= m
    for whole, n in list(stock.by[0].items()):
        if whole <= most:
            blocks[whole].append([[whole * stock.window], n])
            stock.take(0, whole, n)
    return blocks


def _join_blocks(blocks: dict[int, list[list]], most: int) -> list[tuple[Composition, int]]:
    """Containers of ``most`` windows made of blocks, largest first."""
    out = []
    left = {w: list(own) for w, own in blocks.items() if own}
    while left:
        room, used = most, []
        for w in sorted(left, reverse=True):
            for n in range(len(left[w]) - 1, -1, -1):
                k = min(room // w, left[w][n][1])
                if not k:
                    break
                used.append((w, n, k))
                room -= k * w
        m = min(left[w][n][1] // k for w, n, k in used)
        content: dict[int, int] = defaultdict(int)
        for w, n, k in used:
            for length in left[w][n][0]:
                content[length] += k
            left[w][n][1] -= k * m
        out.append((sorted(content.items()), m))
        left = {w: kept for w, own in left.items() if (kept := [b for b in own if b[1]])}
    return out


def _greedy(lengths: dict[int, int], capacity: int) -> list[tuple[Composition, int]]:
    """Largest first, then again and again the largest that fits."""
    out = []
    left = dict(lengths)
    order = sorted(k for k, n in left.items() if n)
    while order:
        room, content = capacity, []
        at = len(order)
        while at and (at := bisect_right(order, room, 0, at)):
            length = order[at - 1]
            k = min(room // length, left[length])
            content.append((length, k))
            room -= k * length
            at -= 1
        m = min(left[length] // k for length, k in content)
        for length, k in content:
            left[length] -= k * m
        order = [k for k in order if left[k]]
        out.append((sorted(content), m))
    return out


def plan(lengths: dict[int, int], capacity: int) -> list[tuple[Composition, int]]:
    """(what a container holds, how many such containers) for items of 1..capacity."""
    window = capacity if capacity <= WINDOW else next((w for w in range(WINDOW, WINDOW // 4, -1) if capacity % w == 0), WINDOW)
    most = capacity // window
    stock = Stock(lengths, window)
    target = np.zeros(window + 1)
    for part in stock.by:
        if part:
            target[part] = stock.left(part)
    patterns = combinations([int(p) for p in np.flatnonzero(target)], window)
    blocks = _fill_windows(stock, patterns, nnls(patterns, target), most)
    whole = _join_blocks(blocks, most)
    # Containers that blocks do not fill go back to the greedy step.
    full = [(c, m) for c, m in whole if sum(length * k for length, k in c) >= most * window]
    rest = defaultdict(int, stock.rest())
    for c, m in whole:
        if sum(length * k for length, k in c) < most * window:
            for length, k in c:
                rest[length] += k * m
    return full + _greedy(rest, capacity)


def slots(made: list[tuple[Composition, int]]) -> dict[int, list[tuple[int, int, int]]]:
    """Of each length: (first number, first container, how many a container)."""
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    container = 0
    for content, m in made:
        for length, k in content:
            out[length].append((taken[length], container, k))
            taken[length] += k * m
        container += m
    return out


def pieces(sizes: DataFrame, budgets: DataFrame, key: str = "doc_id") -> DataFrame:
    """(budget_id, capacity, key, piece, token_start, n_tokens): every item of every
    capacity, those beyond it in pieces."""
    caps = budgets.where("capacity_tokens >= 1").select("budget_id", F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct()
    # A handful of capacities: each row is repeated once for each of them.
    rows = F.array(*[F.struct(F.lit(r[0]).cast(caps.schema["budget_id"].dataType).alias("budget_id"), F.lit(r[1]).cast("bigint").alias("capacity")) for r in caps.collect()])
    every = sizes.select(key, "n_tokens", F.explode(rows).alias("b")).select("b.*", key, F.col("n_tokens").alias("_all"))
    last = F.greatest(F.ceil(F.col("_all") / F.col("capacity")) - 1, F.lit(0))
    every = every.withColumn("piece", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    start = F.col("piece") * F.col("capacity")
    return every.select("budget_id", "capacity", key, "piece", start.alias("token_start"), F.least("capacity", F.col("_all") - start).alias("n_tokens"))


def plans(histogram: DataFrame) -> DataFrame:
    """(budget_id, n_tokens, first, container, per): the slots of each length in each
    capacity, from (budget_id, capacity, n_tokens, count). Each capacity is a task of its
    own; it has at most as many rows as tokens."""
    kind = histogram.schema["budget_id"].dataType.simpleString()

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        own = slots(plan(dict(zip(pdf["n_tokens"].tolist(), pdf["count"].tolist())), int(pdf["capacity"].iloc[0])))
        rows = [(pdf["budget_id"].iloc[0], length, *slot) for length, found in own.items() for slot in found]
        return pd.DataFrame(rows, columns=["budget_id", "n_tokens", "first", "container", "per"])

    return histogram.groupBy("budget_id", "capacity").applyInPandas(make, f"budget_id {kind}, n_tokens BIGINT, first BIGINT, container BIGINT, per BIGINT")


def pack(sizes: DataFrame, budgets: DataFrame, key: str = "doc_id", most: int = 1_000_000) -> DataFrame:
    """(budget_id, container_id, key, piece, token_start, n_tokens): each item of
    ``sizes`` (key, n_tokens) in a container of each of ``budgets``. A length is numbered
    in as many chunks as keep one below ``most`` items."""
    items = stored(pieces(sizes, budgets, key), "items")
    counted = stored(items.where("n_tokens > 0").groupBy("budget_id", "capacity", "n_tokens").count().repartition("budget_id"), "histogram")
    # At most as many rows as the capacities add up to, and the slots of a bounded plan.
    made: dict[tuple, list] = defaultdict(list)
    for budget, length, *slot in plans(counted).collect():
        made[budget, length].append(slot)
    held = shipped(sizes.sparkSession, {k: tuple(np.array(sorted(v)).T) for k, v in made.items()})
    chunks = max(64, (counted.agg(F.max("count")).first()[0] or 0) // most)

    chunk = F.pmod(F.xxhash64(key, "piece"), F.lit(chunks)).alias("_chunk")
    chunked = items.select("*", chunk)
    group = ["budget_id", "n_tokens"]
    counts = chunked.groupBy(*group, "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy(*group, "_chunk").orderBy(key, "piece")) - 1
    numbered = chunked.withColumn("_at", number).join(offsets, [*group, "_chunk"])
    numbered = numbered.select("budget_id", key, "piece", "token_start", "n_tokens", (F.col("_before") + F.col("_at")).alias("_number"))

    def run(batches):
        found = held()
        for batch in batches:
            budget, length, number = (np.array(batch.column(i).to_pylist()) for i in (0, 4, 5))
            out = np.full(len(number), -1, dtype=np.int64)
            order = np.lexsort((length, budget))
            edges = np.flatnonzero(np.r_[True, (np.diff(budget[order]) != 0) | (np.diff(length[order]) != 0)]) if len(order) else []
            for a, b in zip(edges, [*edges[1:], len(order)]):
                own = order[a:b]
                k = (budget[own[0]].item(), length[own[0]].item())
                if k in found:
                    first, container, per = found[k]
                    slot = np.searchsorted(first, number[own], "right") - 1
                    out[own] = container[slot] + (number[own] - first[slot]) // per[slot]
            ids = pa.array(out, mask=out < 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, *batch.columns[1:5]], names=["budget_id", "container_id", key, "piece", "token_start", "n_tokens"])

    kind = sizes.schema[key].dataType.simpleString()
    first = budgets.schema["budget_id"].dataType.simpleString()
    return numbered.mapInArrow(run, f"budget_id {first}, container_id BIGINT, {key} {kind}, piece INT, token_start BIGINT, n_tokens BIGINT")
