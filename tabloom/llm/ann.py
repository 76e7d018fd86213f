"""Approximate nearest neighbours (6) over balanced posting lists.

Equal vectors are one entry of the index. Largest inner product becomes smallest distance by one more component
(sqrt(M^2 - |x|^2); 0 for queries), so all entries have one length and centroids get the same. Centroids come from a bounded
sample; a list that is longer than the average is cut at medians of its own entries, so that lists are balanced and grow
in number and not in length. An entry near a boundary goes to several lists, but full lists take none but their own. A
query walks a neighbour graph of the centroids and visits all lists within a ratio of distances; the ratio is the smallest
under which a bounded number of trial queries find their true neighbours, taken from the whole table. A query that finds too few visits all lists. Lists are cut into blocks of bounded size;
each block meets the queries that visit it, and the best of all blocks are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import cut, join_hot

#: Entries that the first centroids are fitted on, at most (in expectation); first centroids, at most.
SAMPLE_ROWS, FIRST_LISTS = 20_000, 4096
#: Entries of a list on average, at least (with fewer than FIRST_LISTS lists) and at most; lists altogether, at most: beyond
#: LIST_ROWS_MOST * MOST_LISTS entries lists get longer.
LIST_ROWS_LEAST, LIST_ROWS_MOST, MOST_LISTS = 12, 1024, 65_536
#: A list this many times the average is cut, in up to 2^MOST_DEPTH parts, by so many sampled entries for each part.
SPLIT_OVER, SPLIT_SAMPLE, MOST_DEPTH = 2.0, 16, 10
#: Lists an entry may be in, how much further than the closest their centroids may be, and the multiple of the average
#: up to which a list takes entries that have a closer list; parts in which those of a full list are ranked first.
REPLICAS, REPLICA_RATIO, FULL, RANK_PARTS = 4, 1.2, 2.5, 64
#: Recall that the ratio is chosen for, the share of trial queries that must find half of theirs, and how many trial queries.
#: A query visits lists that hold ENOUGH * k entries at least.
WANTED_RECALL, WANTED_HALF, TRIALS, ENOUGH = 0.93, 0.995, 400, 16
#: Centroids that the first walk of a query holds, and the ratio of distances that is used without a trial.
WALK, PROBE_RATIO = 256, 1.25
BLOCK_ROWS = 2048
#: Neighbours of a centroid in the graph, the near ones they are picked from, and links back; centroids that a step of a walk
#: follows, and steps at most; queries that walk together; found entries that a task holds unmerged.
DEGREE, CANDIDATES, BACK, EXPAND, STEPS, TOGETHER, HELD = 24, 64, 12, 4, 200, 512, 250_000


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def _pack(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Usable vectors as bytes, with their squared length."""
    for batch in batches:
        rows, ids, lengths = [], [], []
        for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), strict=True):
            if i is None or v is None or len(v) != dim or None in v:
                continue
            x = np.array(v, np.float32)
            n = float((x.astype(np.float64) ** 2).sum())
            if np.isfinite(n) and n > 0:
                rows.append(x.tobytes())
                ids.append(i)
                lengths.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.binary()), pa.array(lengths, pa.float64())], ["vec_id", "v", "n2"])


def lifted(x: np.ndarray, n2: np.ndarray, most: float) -> np.ndarray:
    return np.hstack([x.astype(np.float64), np.sqrt(np.maximum(most - n2, 0))[:, None]]).astype(np.float32)


def as_queries(x: np.ndarray, n2: np.ndarray, most: float) -> np.ndarray:
    """Scaled to length sqrt(most), which changes no order."""
    return np.hstack([x * np.sqrt(most / n2)[:, None], np.zeros((len(x), 1))]).astype(np.float32)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared, in double precision: near copies differ by less than what single precision keeps of a large distance."""
    x, c = x.astype(np.float64), c.astype(np.float64)
    return np.maximum((x**2).sum(1)[:, None] + (c**2).sum(1)[None, :] - 2 * x @ c.T, 0)


def _on_sphere(c: np.ndarray, radius: float) -> np.ndarray:
    length = np.sqrt((c**2).sum(1, keepdims=True))
    return (c * (radius / np.maximum(length, 1e-12 * max(radius, 1e-30)))).astype(np.float32)


def centroids_of(x: np.ndarray, k: int, rounds: int = 6, seed: int = 5) -> np.ndarray:
    """k centres of lifted rows x, of the length of x's rows."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)  # copies of a vector must not pull several centres
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    radius = float(np.sqrt((x[:1].astype(np.float64) ** 2).sum()))
    for _ in range(rounds):
        own = np.concatenate([(x[lo : lo + 2048] @ c.T).argmax(1) for lo in range(0, len(x), 2048)])
        size = np.bincount(own, minlength=k)
        order, some = np.argsort(own, kind="stable"), np.flatnonzero(size)
        c[some] = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(size)])[some], axis=0)
        c = _on_sphere(c, radius)
    return c


@dataclass(frozen=True)
class Split:
    """A list cut in 2^depth parts at the medians of projections; parts[p] is the number of part p's list."""

    directions: np.ndarray
    at: np.ndarray
    parts: np.ndarray

    def part(self, x: np.ndarray) -> np.ndarray:
        node, levels = np.zeros(len(x), np.int64), int(np.log2(len(self.parts)))
        for _ in range(levels):
            right = np.einsum("nd,nd->n", x, self.directions[node]) > self.at[node]
            node = 2 * node + 1 + right
        return node - (len(self.parts) - 1)


def split_of(x: np.ndarray, depth: int, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(directions, cuts, centroids) that cut rows like x in 2^depth parts of about equal size."""
    inner = 2**depth - 1
    directions, at = np.zeros((inner, x.shape[1]), np.float32), np.zeros(inner, np.float32)
    rows = {0: np.arange(len(x))}
    for node in range(inner):
        own = rows.pop(node)
        if len(own) > 1:
            y = x[own] - x[own].mean(0)
            way = y[(y**2).sum(1).argmax()]
            for _ in range(4):  # towards the longest axis
                way = y.T @ (y @ way)
                way = way / max(float(np.sqrt((way**2).sum())), 1e-30)
            directions[node] = way
            value = np.einsum("nd,d->n", x[own], directions[node])
            at[node] = np.partition(value, (len(own) - 1) // 2)[(len(own) - 1) // 2]
            right = value > at[node]
        else:
            right = np.zeros(len(own), bool)
        rows[2 * node + 1], rows[2 * node + 2] = own[~right], own[right]
    centres = np.stack([x[r].mean(0) if len(r) else x.mean(0) for _, r in sorted(rows.items())])
    return directions, at, _on_sphere(centres, radius)


def graph_of(c: np.ndarray) -> np.ndarray:
    """Neighbours of each centroid: near ones in different directions, some that have it as such, and a ring that connects all.

    Of the CANDIDATES nearest, one is a neighbour if no neighbour before it is closer to it than the centroid is; so links leave
    a dense group instead of filling up with its members. Nearest ones fill what is left."""
    k = len(c)
    m = min(CANDIDATES, k - 1)
    ring = (np.arange(k)[:, None] + np.array([1, -1, k // 3, k // 2])) % k
    if not m:
        return ring
    near = np.zeros((k, min(DEGREE, m)), np.int64)
    for lo in range(0, k, 512):
        d = _distances(c[lo : lo + 512], c)
        rows = np.arange(len(d))
        d[rows, rows + lo] = np.inf
        some = np.argpartition(d, m - 1, axis=1)[:, :m]
        some = np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1), 1)
        own, x = np.take_along_axis(d, some, 1), c[some].astype(np.float64)
        length = np.einsum("nid,nid->ni", x, x)
        apart = length[:, :, None] + length[:, None] - 2 * np.einsum("nid,njd->nij", x, x)
        kept = np.zeros(some.shape, bool)
        for i in range(m):
            kept[:, i] = ~(kept[:, :i] & (apart[:, i, :i] < own[:, i, None])).any(axis=1)
        order = np.argsort(~kept, axis=1, kind="stable")[:, : near.shape[1]]
        near[lo : lo + 512] = np.take_along_axis(some, order, 1)
    to, place = np.divmod(np.argsort(near[:, :BACK].ravel(), kind="stable"), near[:, :BACK].shape[1])
    of = near[to, place]
    rank = np.arange(len(of)) - np.searchsorted(of, of)
    back = np.repeat(near[:, :1], BACK, axis=1)  # where fewer have it, its nearest again
    back[of[rank < BACK], rank[rank < BACK]] = to[rank < BACK]
    return np.hstack([near, back, ring])


def walk(q: np.ndarray, c: np.ndarray, graph: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the `width` closest centroids that a best-first walk over the graph finds: (which, distance^2).

    It starts at the closest of 4 * sqrt(k) centroids, follows the EXPAND closest ones that it has not followed yet, looks at a centroid
    once, and ends when all that it holds have been followed."""
    parts = [_walk(q[lo : lo + TOGETHER], c, graph, min(width, len(c))) for lo in range(0, len(q), TOGETHER)]
    which = np.concatenate([w for w, _ in parts] or [np.empty((0, min(width, len(c))), np.int64)])
    return which, np.concatenate([d for _, d in parts] or [np.empty(which.shape)])


def _walk(q: np.ndarray, c: np.ndarray, graph: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    n, k = len(q), len(c)
    starts = np.unique(np.linspace(0, k - 1, max(int(4 * np.sqrt(k)), width)).astype(int))
    d = _distances(q, c[starts])
    order = np.argsort(d, axis=1, kind="stable")[:, :width]
    ids, d = starts[order], np.take_along_axis(d, order, 1)
    q, c = q.astype(np.float64), c.astype(np.float64)
    q2, c2 = (q**2).sum(1), (c**2).sum(1)
    seen, rows = np.zeros((n, k), bool), np.arange(n)[:, None]
    seen[:, starts] = True
    followed = np.zeros(ids.shape, bool)
    for _ in range(STEPS):
        pick = np.argsort(np.where(followed, np.inf, d), axis=1, kind="stable")[:, :EXPAND]
        live = ~np.take_along_axis(followed, pick, 1)
        if not live.any():
            break
        followed[rows, pick] = True
        new = graph[np.take_along_axis(ids, pick, 1)].reshape(n, -1)
        fresh = ~seen[rows, new] & np.repeat(live, graph.shape[1], axis=1)
        key = np.where(fresh, new, k + np.arange(new.shape[1]))
        order = np.argsort(key, axis=1, kind="stable")  # a centroid that several lead to counts once
        same = np.take_along_axis(key, order, 1)
        again = np.zeros(new.shape, bool)
        again[rows, order[:, 1:]] = same[:, 1:] == same[:, :-1]
        far = np.full(new.shape, np.inf)
        r, w = np.nonzero(fresh & ~again)
        seen[r, new[r, w]] = True
        far[r, w] = np.maximum(q2[r] + c2[new[r, w]] - 2 * np.einsum("nd,nd->n", q[r], c[new[r, w]]), 0)
        ids, d = np.hstack([ids, new]), np.hstack([d, far])
        followed = np.hstack([followed, ~np.isfinite(far)])
        order = np.argsort(d, axis=1, kind="stable")[:, :width]
        ids, d, followed = (np.take_along_axis(x, order, 1) for x in (ids, d, followed))
    return ids, d


def closest(x: np.ndarray, c: np.ndarray, graph: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The m closest centroids of each row, nearest first: (which, distance^2). With very many centroids by the graph."""
    m = min(m, len(c))
    if len(c) > 2 * FIRST_LISTS:
        which, d = walk(x, c, graph, max(WALK, m))
        return which[:, :m], d[:, :m]
    d = _distances(x, c)
    which = np.argpartition(d, m - 1, axis=1)[:, :m]
    order = np.argsort(np.take_along_axis(d, which, 1), axis=1, kind="stable")
    which = np.take_along_axis(which, order, 1)
    return which, np.take_along_axis(d, which, 1)


@dataclass(frozen=True)
class Index:
    """Centroids, their graph, and the lists that were cut: number of the first list -> Split."""

    most: float
    first: np.ndarray
    splits: dict[int, Split]
    c: np.ndarray
    graph: np.ndarray

    def lists(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists of lifted rows, own list first: (which, distance^2, whether it is one)."""
        own = np.concatenate([(x[lo : lo + 1024] @ self.first.T).argmax(1) for lo in range(0, len(x), 1024)]) if len(x) else np.empty(0, int)
        number = self.numbers[own]
        for i in np.intersect1d(own, list(self.splits)):
            at = np.flatnonzero(own == i)
            number[at] = self.splits[i].parts[self.splits[i].part(x[at])]
        which, d = closest(x, self.c, self.graph, REPLICAS)
        which = np.hstack([number[:, None], which])
        mine = np.maximum(2 * self.most - 2 * np.einsum("nd,nd->n", x, self.c[number]), 0).astype(np.float32)
        d = np.hstack([mine[:, None], d])
        near = (d <= d[:, 1:2] * REPLICA_RATIO**2) & (which != number[:, None])
        near &= np.cumsum(near, axis=1) < REPLICAS
        near[:, 0] = True
        return which, d, near

    @property
    def numbers(self) -> np.ndarray:
        """The number of each first list that is not cut; those come first."""
        out = np.full(len(self.first), -1)
        whole = np.setdiff1d(np.arange(len(self.first)), list(self.splits))
        out[whole] = np.arange(len(whole))
        return out


def _first_list(batches: Iterator[pa.RecordBatch], dim: int, most: float, c: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            own = (lifted(_matrix(part.column("v"), dim), np.asarray(part.column("n2")), most) @ c.T).argmax(1)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), part.column("v"), part.column("n2")], ["list", "v", "n2"])


def _lists(batches: Iterator[pa.RecordBatch], dim: int, index: Index) -> Iterator[pa.RecordBatch]:
    """(list, rep, v, place, far): the own list (place 0) and those nearly as close; far: the distance^2."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            which, d, near = index.lists(lifted(_matrix(part.column("v"), dim), np.asarray(part.column("n2")), index.most))
            row, col = np.nonzero(near)
            arrays = [pa.array(which[row, col].astype(np.int32)), part.column("rep").take(pa.array(row)), part.column("v").take(pa.array(row)), pa.array(col.astype(np.int32)), pa.array(d[row, col].astype(np.float64))]
            yield pa.RecordBatch.from_arrays(arrays, ["list", "rep", "v", "place", "far"])


def _reach(d: np.ndarray, which: np.ndarray, rows: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray]:
    """For lists in order of distance: which are needed to hold `enough` rows, and the distance^2 of the last of them."""
    need = np.cumsum(rows[which], axis=1) - rows[which] < enough
    last = np.maximum(need.sum(1) - 1, 0)
    return need, d[np.arange(len(d)), last]


def visited(q: np.ndarray, c: np.ndarray, graph: np.ndarray, rows: np.ndarray, enough: int, ratio: float = PROBE_RATIO) -> tuple[np.ndarray, np.ndarray]:
    """(query, list) pairs: the closest lists that hold `enough` rows together, and all within ratio of the last of them.

    Unless half of what a walk holds is farther, it may have missed some and is repeated with four times the width. One of an eighth
    of all centroids would touch nearly all of them, so all distances are taken instead; up to 2 * FIRST_LISTS centroids
    these cost less than a walk and are taken at once."""
    out, todo, width = [], np.arange(len(q)), WALK
    while len(todo):
        every = width * 8 >= len(c) or len(c) <= 2 * FIRST_LISTS
        if every:
            d = _distances(q[todo], c)
            which = np.argsort(d, axis=1, kind="stable")
            d = np.take_along_axis(d, which, 1)
        else:
            which, d = walk(q[todo], c, graph, width)
        need, edge = _reach(d, which, rows, enough)
        keep = (d <= edge[:, None] * ratio**2) | need
        done = np.ones(len(todo), bool) if every else keep.sum(1) * 2 <= width
        row, col = np.nonzero(keep & done[:, None])
        out.append((todo[row], which[row, col]))
        todo, width = todo[~done], width * 4
    return np.concatenate([r for r, _ in out] or [np.empty(0, int)]), np.concatenate([w for _, w in out] or [np.empty(0, int)])


def ratio_for(q: np.ndarray, c: np.ndarray, rows: np.ndarray, enough: int, lists: list[list[np.ndarray]]) -> float:
    """The smallest ratio of `visited` under which trial queries q find their neighbours as wanted.

    lists: for each query, of each true neighbour the lists that hold it."""
    needed, half = [], []
    for i, neighbours in enumerate(lists):
        if not neighbours:
            continue
        d = _distances(q[i : i + 1], c)
        which = np.argsort(d, axis=1)
        _, edge = _reach(np.take_along_axis(d, which, 1), which, rows, enough)
        own = np.sqrt(np.array([d[0, x].min() if len(x) else np.inf for x in neighbours]) / max(float(edge[0]), 1e-30))
        needed.append(np.maximum(own, 1.0))
        half.append(np.sort(needed[-1])[(len(own) - 1) // 2])
    if not needed:
        return PROBE_RATIO
    found = np.sort(np.concatenate(needed))
    return float(max(found[int(np.ceil(WANTED_RECALL * len(found))) - 1], np.sort(half)[int(np.ceil(WANTED_HALF * len(half))) - 1]))


def _trial(batches: Iterator[pa.RecordBatch], dim: int, k: int, q: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The k nearest among a task's entries of each trial query."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for batch in batches:
        for lo in range(0, batch.num_rows, 2048):
            part = batch.slice(lo, 2048)
            row, rep, score = best_of(q, _matrix(part.column("v"), dim), np.asarray(part.column("rep")), k)
            own = ids[row] != rep
            found = _best([*found, (ids[row][own], rep[own], score[own])], k)
    columns = found[0] if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["query", "rep", "score"])


def _visits(batches: Iterator[pa.RecordBatch], dim: int, c: np.ndarray, graph: np.ndarray, most: float, rows: np.ndarray, enough: int, ratio: float) -> Iterator[pa.RecordBatch]:
    """(list, rep, v) of queries: the lists they visit."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            q = as_queries(_matrix(part.column("v"), dim), np.asarray(part.column("n2")), most)
            row, which = visited(q, c, graph, rows, enough, ratio)
            yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), part.column("rep").take(pa.array(row)), part.column("v").take(pa.array(row))], ["list", "rep", "v"])


def best_of(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of x (ids: distinct) for each query, and more where they tie nearly: (row of q, id, score).

    floor: scores under which nothing is wanted."""
    q, x = q.astype(np.float64), x.astype(np.float64)
    s = q @ x.T
    edge = np.full(len(q), -np.inf) if floor is None else floor
    if len(x) > k:
        edge = np.maximum(edge, np.partition(s, len(x) - k, axis=1)[:, len(x) - k])
    edge = np.where(np.isfinite(edge), edge - 1e-6 * (1 + np.abs(edge)), -np.inf)
    row, at = np.nonzero(s >= edge[:, None])
    # a product of matrices may differ in the last bits from row to row: the best are summed again, alike for all
    score = np.concatenate([(x[at[i : i + 100_000]] * q[row[i : i + 100_000]]).sum(axis=1) for i in range(0, len(at), 100_000)] or [np.empty(0)])
    return row, ids[at], score


def _best(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The k best of each query, each id once."""
    if not found:
        return []
    query, rep, score = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((rep, -score, query))
    query, rep, score = query[order], rep[order], score[order]
    pair = np.lexsort((rep, query))
    twice = np.zeros(len(query), bool)
    twice[pair[1:]] = (query[pair[1:]] == query[pair[:-1]]) & (rep[pair[1:]] == rep[pair[:-1]])
    query, rep, score = query[~twice], rep[~twice], score[~twice]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    return [(query[place < k], rep[place < k], score[place < k])]


def _search(batches: Iterator[pa.RecordBatch], dim: int, k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (list, block, is_query): a block's vectors are held until its queries have passed.

    What the blocks of a task find is merged before it is sent; what is worse than the k best so far isn't looked at."""
    key, ids, held = None, [], []
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = merged = 0
    known, floors = np.empty(0, np.int64), np.empty(0)

    def merge() -> None:
        nonlocal found, size, merged, known, floors
        found = _best(found, k)
        query, _, score = found[0]
        known, start, count = np.unique(query, return_index=True, return_counts=True)
        floors = np.where(count >= k, score[np.minimum(start + k, start + count) - 1], -np.inf)
        size = merged = len(query)

    def ask(reps: np.ndarray, q: np.ndarray) -> None:
        nonlocal size
        x, rows = np.concatenate(held), np.concatenate(ids)
        for lo in range(0, len(q), 1024):
            own = reps[lo : lo + 1024]
            floor = np.full(len(own), -np.inf)
            if len(known):
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                floor = np.where(known[at] == own, floors[at], -np.inf)
            row, rep, score = best_of(q[lo : lo + 1024], x, rows, k, floor)
            found.append((own[row], rep, score))
            size += len(row)
            if size - merged > HELD:
                merge()

    def batch_of(x: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        """A row for each query."""
        query, rep, score = x[0] if x else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        one, start = np.unique(query, return_index=True)
        ends = pa.array(np.append(start, len(query)).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(one), pa.ListArray.from_arrays(ends, pa.array(rep)), pa.ListArray.from_arrays(ends, pa.array(score))], ["query", "reps", "scores"])

    for batch in batches:
        if not batch.num_rows:
            continue
        parts = [np.asarray(batch.column(c).cast(pa.int64())) for c in ("list", "block", "is_query")]
        reps, v = np.asarray(batch.column("rep")), _matrix(batch.column("v"), dim)
        changes = np.flatnonzero(np.any([p[1:] != p[:-1] for p in parts], axis=0)) + 1
        for lo, hi in zip([0, *changes], [*changes, batch.num_rows], strict=True):
            at = parts[0][lo], parts[1][lo]
            if at != key:
                key, ids, held = at, [], []
            if not parts[2][lo]:
                ids.append(reps[lo:hi])
                held.append(v[lo:hi])
            elif held:
                ask(reps[lo:hi], v[lo:hi])
        if merged > 10 * HELD:  # more queries than a task can hold
            yield batch_of(_best(found, k))
            found, size, merged, known, floors = [], 0, 0, np.empty(0, np.int64), np.empty(0)
    yield batch_of(_best(found, k))


def _merge(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """What tasks found for the queries of this task, merged: (query, rep, score), the k best of each."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = merged = 0
    for batch in batches:
        reps, scores = batch.column("reps"), batch.column("scores")
        query = np.repeat(np.asarray(batch.column("query")), np.asarray(reps.value_lengths()))
        found.append((query, np.asarray(reps.flatten()), np.asarray(scores.flatten())))
        size += len(query)
        if size - merged > HELD:
            found = _best(found, k)
            size = merged = len(found[0][0])
    for query, rep, score in _best(found, k):
        for lo in range(0, len(query), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 100_000]) for c in (query, rep, score)], ["query", "rep", "score"])


def _split(rows: pd.DataFrame, dim: int, most: float) -> pd.DataFrame:
    """The cuts of one list, from its entries in the sample."""
    x = lifted(np.frombuffer(b"".join(rows["v"]), np.float32).reshape(-1, dim), rows["n2"].to_numpy(), most)
    x = x[np.lexsort(x.T)]
    made = split_of(x, int(rows["depth"].iloc[0]), most**0.5)
    return pd.DataFrame({"list": rows["list"].iloc[:1], "directions": [made[0].tobytes()], "at": [made[1].tobytes()], "c": [made[2].tobytes()]})


def index_of(reps: DataFrame, dim: int, n: int, most: float) -> Index:
    """The index of n distinct vectors reps (rep, v, n2)."""
    share = int(min(1.0, SAMPLE_ROWS / n) * 10**6)
    sample = reps.where(F.pmod(F.xxhash64("v", F.lit(11)), F.lit(10**6)) < share).select("v", "n2").toPandas()
    if sample.empty:
        sample = reps.select("v", "n2").limit(1).toPandas()
    x, n2 = np.frombuffer(b"".join(sample["v"]), np.float32).reshape(-1, dim), sample["n2"].to_numpy()
    order = np.lexsort(x.T)  # not that of the files
    first = centroids_of(lifted(x[order], n2[order], most), int(min(FIRST_LISTS, max(1, len(x) // 4), max(1, n // LIST_ROWS_LEAST))))
    # long lists are cut
    target = max(min(n / len(first), LIST_ROWS_MOST), n / MOST_LISTS)
    owned = reps.select("v", "n2").mapInArrow(partial(_first_list, dim=dim, most=most, c=first), "list int, v binary, n2 double")
    counts = {r["list"]: r["n"] for r in owned.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a number for each centroid
    depth = {i: int(min(MOST_DEPTH, np.ceil(np.log2(m / target)))) for i, m in counts.items() if m > SPLIT_OVER * target}
    splits, parts, at = {}, [np.delete(first, list(depth), axis=0)], len(first) - len(depth)
    if depth:
        table = reps.sparkSession.createDataFrame([(i, p, float(SPLIT_SAMPLE * 2**p / counts[i])) for i, p in depth.items()], "list int, depth int, share double")
        some = owned.join(F.broadcast(table), "list").where((F.pmod(F.xxhash64("v", F.lit(13)), F.lit(10**6)) < F.col("share") * 10**6))
        shape = "list int, directions binary, at binary, c binary"
        for r in sorted(some.groupBy("list").applyInPandas(partial(_split, dim=dim, most=most), shape).collect(), key=lambda r: r["list"]):  # as many rows as centroids
            c = np.frombuffer(r["c"], np.float32).reshape(-1, dim + 1)
            splits[r["list"]] = Split(np.frombuffer(r["directions"], np.float32).reshape(-1, dim + 1), np.frombuffer(r["at"], np.float32), np.arange(at, at + len(c)))
            parts.append(c)
            at += len(c)
        if len(splits) < len(depth):  # no entry of a list was in the sample
            parts[0], at = np.delete(first, list(splits), axis=0), len(first) - len(splits)
            for i, c in zip(splits, parts[1:], strict=True):
                splits[i] = Split(splits[i].directions, splits[i].at, np.arange(at, at + len(c)))
                at += len(c)
    c = np.concatenate(parts)
    return Index(most, first, splits, c, graph_of(c))


def within_room(entries: DataFrame) -> DataFrame:
    """Of each list the `room` entries with the smallest far, ties to the smaller rep.

    They are ranked in RANK_PARTS parts first, so no task ranks more entries of a list than RANK_PARTS times its room.
    """
    out = entries.withColumn("part", F.pmod(F.xxhash64("rep"), F.lit(RANK_PARTS)))
    for keys in (["list", "part"], ["list"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("far", "rep"))
        out = out.withColumn("rank", rank).where(F.col("rank") <= F.col("room"))
    return out.drop("part", "rank")


def search(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", dim: int | None = None) -> DataFrame:
    """The k nearest of each row whose id is divisible by `every`: query_id, rank (from 1), vec_id, score.

    Nearness: largest inner product in double precision; ties to the smaller vec_id; the query's own id is no candidate.
    Vectors that are null, zero or of another length than dim (None: the most frequent length; an inner product needs one
    length), or that hold null or non-finite components, take no part, nor do null ids. Of rows with one id all take part, as
    one candidate with its best score. With fewer than k candidates all that are found are returned. An empty table gives an
    empty table.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<float>").alias("v"))
    if dim is None:
        top = rows.where("v IS NOT NULL").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
        dim = top["n"] if top else 0
    packed = cut(rows.mapInArrow(partial(_pack, dim=dim), "vec_id long, v binary, n2 double"), "vectors")
    by_vector = packed.groupBy("v").agg(F.min("vec_id").alias("low"), F.max("vec_id").alias("high"), F.first("n2").alias("n2"), F.count("*").alias("copies"))
    reps = cut(cut(by_vector, "distinct").withColumn("rep", F.monotonically_increasing_id()), "reps")
    stats = reps.agg(F.count("*").alias("n"), F.max("n2").alias("most"), F.sum("copies").alias("rows"), F.count_if(F.col("low") < F.col("high")).alias("several")).first()
    if not stats["n"]:
        return packed.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.col("n2").alias("score")).where("false")
    n, most = stats["n"], stats["most"]
    index = index_of(reps, dim, n, most)
    c, graph = index.c, index.graph

    listed = cut(reps.mapInArrow(partial(_lists, dim=dim, index=index), "list int, rep long, v binary, place int, far double"), "lists")
    # full lists take no entry that has a closer one
    held = listed.groupBy("list").agg(F.count_if(F.col("place") == 0).alias("n"), F.count("*").alias("all")).collect()  # a number for each centroid
    full = FULL * sum(r["all"] for r in held) / len(c)
    over = [(r["list"], int(max(0, full - r["n"]))) for r in held if r["all"] > full]
    if over:
        bound = vectors.sparkSession.createDataFrame(over, "list int, room int")
        taken = within_room(listed.where("place > 0").join(F.broadcast(bound), "list")).select("list", "rep", "v")
        rest = listed.where("place > 0").join(F.broadcast(bound), "list", "left_anti").select("list", "rep", "v")
        listed = cut(listed.where("place = 0").select("list", "rep", "v").unionByName(rest).unionByName(taken), "lists")
    counts = {r["list"]: r["n"] for r in listed.groupBy("list").agg(F.count("*").alias("n")).collect()}
    sizes_of = np.array([counts.get(i, 0) for i in range(len(c))])
    enough = ENOUGH * k
    # the ratio, by the true neighbours of a bounded number of queries
    share = int(min(1.0, TRIALS / n) * 10**9)
    trial = reps.where(F.pmod(F.xxhash64("v", F.lit(17)), F.lit(10**9)) < share).select("rep", "v", "n2").toPandas().sort_values("v").iloc[: 2 * TRIALS]
    q, trial_ids = np.frombuffer(b"".join(trial["v"]), np.float32).reshape(-1, dim), trial["rep"].to_numpy()
    ratio = PROBE_RATIO
    if len(trial):
        near = reps.select("rep", "v").mapInArrow(partial(_trial, dim=dim, k=k, q=q, ids=trial_ids), "query long, rep long, score double")
        near = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))).where(F.col("rank") <= k).select("query", "rep")
        near = cut(near, "trial")  # 2 * k * TRIALS rows at most
        lists: dict[int, dict[int, list[int]]] = {}
        for r in near.join(listed.select("rep", "list").join(F.broadcast(near.select("rep").distinct()), "rep", "left_semi"), "rep").collect():
            lists.setdefault(r["query"], {}).setdefault(r["rep"], []).append(r["list"])
        ratio = ratio_for(as_queries(q, trial["n2"].to_numpy(), most), c, sizes_of, enough, [[np.array(x) for x in lists.get(int(i), {}).values()] for i in trial_ids])
    sizes = vectors.sparkSession.createDataFrame([(i, -(-x // BLOCK_ROWS)) for i, x in counts.items()], "list int, blocks int")
    posted = listed.join(F.broadcast(sizes), "list").select("list", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("is_query"), "rep", "v")

    # which entries are asked for: all queries with one vector are answered at once
    asked = packed.where(F.col("vec_id") % every == 0).select("vec_id", "v").distinct()
    asked = cut(join_hot(asked, reps.select("v", "rep", "copies"), "v", stats["rows"], "copies").select(F.col("vec_id").alias("query_id"), F.col("rep").alias("query")), "asked")
    queries = reps.join(asked.select(F.col("query").alias("rep")).distinct(), "rep", "left_semi")
    wanted = min(k + 1, n)

    def nearest(visits: DataFrame) -> DataFrame:
        met = visits.join(F.broadcast(sizes), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("is_query"), "rep", "v")
        met = posted.unionByName(met).repartition("list", "block").sortWithinPartitions("list", "block", "is_query")
        found = met.mapInArrow(partial(_search, dim=dim, k=k + 1), "query long, reps array<long>, scores array<double>")
        return found.repartition("query").mapInArrow(partial(_merge, k=k + 1), "query long, rep long, score double")

    visit = partial(_visits, dim=dim, c=c, graph=graph, most=most, rows=sizes_of, enough=enough, ratio=ratio)
    found = cut(nearest(queries.mapInArrow(visit, "list int, rep long, v binary")), "found")
    # a query that found too few visits every list
    full_queries = found.groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") >= wanted).select("query")
    short = cut(queries.join(full_queries, F.col("rep") == F.col("query"), "left_anti").select("rep", "v"), "short")
    if not short.isEmpty():
        every_list = nearest(short.crossJoin(F.broadcast(sizes.select("list"))).select("list", "rep", "v"))
        found = found.join(full_queries, "query", "left_semi").unionByName(every_list)

    # entries to ids: of equal vectors the k + 1 smallest ids suffice
    ids = reps.where("low = high").select("rep", F.col("low").alias("vec_id"))
    if stats["several"]:
        place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
        some = packed.select("v", "vec_id").distinct().withColumn("place", place).where(F.col("place") <= k + 1)
        ids = ids.unionByName(cut(some.join(reps.where("low < high").select("v", "rep"), "v").select("rep", "vec_id"), "ids"))
    each = found.join(ids, "rep").groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    best = each.withColumn("rank", rank).where(F.col("rank") <= k + 1).groupBy("query").agg(F.collect_list(F.struct("vec_id", "score")).alias("best"))
    # `asked` has at most as many rows of a vector as the table
    hot = cut(best.join(asked.groupBy("query").agg(F.count("*").alias("n")), "query"), "best")
    answers = join_hot(asked, hot, "query", asked.count()).select("query_id", F.inline("best")).where(F.col("vec_id") != F.col("query_id"))
    answers = answers.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
