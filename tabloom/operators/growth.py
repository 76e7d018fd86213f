"""How trees grow over packed rows: blocks that carry node numbers, a pass for each level, histograms, subtrees of small nodes.

A block holds the features and codes of some rows once, and entries (row, tree, weight, node): where each row stands in each
tree that drew it. Nodes are named by the key tree * 2^32 + node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.sources.tables import kept

#: Values (weight of a node times features) up to which a subtree is grown in one task.
LOCAL_VALUES = 1 << 22
#: Rows of a block; numbers of histograms that a task holds before it sends them; counts that a split search holds.
ROWS, HELD, CELLS = 8192, 1 << 22, 1 << 19
_STATE = "kind int, x binary, code binary, row binary, tree binary, weight binary, node binary, t int, n long, f int, hist binary"
_NAMES = [c.split()[0] for c in _STATE.split(", ")]
_TYPES = [pa.int32(), *[pa.binary()] * 6, pa.int32(), pa.int64(), pa.int32(), pa.binary()]


@dataclass(frozen=True)
class Rule:
    """What a split must obey. edges: the values of each feature's bins, or None for exact thresholds; subset: how many
    features a node looks at, or None for all."""

    classes: int
    features: int
    max_depth: int
    least_leaf: float
    least_split: float
    least_gain: float
    subset: int | None
    seed: int
    edges: list[np.ndarray] | None

    def looked_at(self, tree: int, node: int) -> np.ndarray:
        """The features of a node, in order: those with the smallest random numbers, as sampling.feature_subset draws them."""
        if self.subset is None:
            return np.arange(self.features)
        number = lambda f: hashlib.md5(f"{tree}/{node}:{f}:{self.seed}".encode()).hexdigest()[:8]
        return np.array(sorted(sorted((number(f), f) for f in range(self.features))[: self.subset], key=lambda x: x[1]))[:, 1].astype(int)


def keys_of(tree: np.ndarray, node: np.ndarray) -> np.ndarray:
    return tree.astype(np.int64) << 32 | node


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys, -1 where they aren't."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


@dataclass
class Level:
    """What a pass does: splits that move entries on; nodes whose entries stay, leave as pieces, or are counted."""

    splits: dict[int, tuple[int, float]] = field(default_factory=dict)
    large: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    local: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    counted: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    def split(self, node: tuple[int, int], feature: int, threshold: float) -> None:
        self.splits[node[0] << 32 | node[1]] = feature, threshold

    def aim(self, large: dict, local: set, open_: dict, histograms: bool) -> None:
        """open_: weights by class of all nodes of the level. Of two children, where either is large, the lighter is counted;
        the other is what the parent has more."""
        key = lambda k: k[0] << 32 | k[1]
        self.large, self.local = np.array(sorted(map(key, large)), np.int64), np.array(sorted(map(key, local)), np.int64)
        counted = set()
        for t, n in large if histograms else ():
            other = (t, n + 1 if n % 2 else n - 1)
            counted.add((t, n) if n == 0 else min((t, n), other, key=lambda k: (open_[k].sum(), k)))
        self.counted = np.array(sorted(map(key, counted)), np.int64)


def _pack(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            x = np.asarray(part.column("features").flatten().cast(pa.float64())).reshape(part.num_rows, -1).copy()
            for j, e in enumerate(rule.edges or ()):  # the upper edge of each value's bin
                x[:, j] = e[np.minimum(np.searchsorted(e, x[:, j]), len(e) - 1)]
            drawn = part.column("drawn")
            row = np.repeat(np.arange(part.num_rows), np.asarray(drawn.value_lengths()))
            tree, weight = (np.asarray(drawn.flatten().field(c)) for c in ("tree", "weight"))
            yield _state(x, np.asarray(part.column("code")), row, tree, weight, np.zeros(len(row), np.int64))


def _row(kind: int, **values: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind if n == "kind" else values.get(n)], t) for n, t in zip(_NAMES, _TYPES, strict=True)], _NAMES)


def _state(x: np.ndarray, code: np.ndarray, row: np.ndarray, tree: np.ndarray, weight: np.ndarray, node: np.ndarray, kind: int = 0, **more: int) -> pa.RecordBatch:
    parts = {"x": (x, np.float64), "code": (code, np.int32), "row": (row, np.int32), "tree": (tree, np.int32), "weight": (weight, np.float64), "node": (node, np.int64)}
    return _row(kind, **{n: np.ascontiguousarray(v, t).tobytes() for n, (v, t) in parts.items()}, **more)


def _blocks(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[tuple[np.ndarray, ...]]:
    """x, code, row, tree, weight, node of each block."""
    types = {"code": np.int32, "row": np.int32, "tree": np.int32, "weight": np.float64, "node": np.int64}
    for batch in batches:
        for i in range(batch.num_rows):
            x = np.frombuffer(batch.column("x")[i].as_py()).reshape(-1, features)
            yield x, *[np.frombuffer(batch.column(n)[i].as_py(), t) for n, t in types.items()]


def blocks_of(rows: DataFrame, weights: DataFrame | None, rule: Rule) -> DataFrame:
    """All entries at the roots. A row holds its trees, so its features are stored once."""
    one = F.struct(F.col("tree").cast("int").alias("tree"), F.col("weight").cast("double").alias("weight"))
    if weights is None:
        drawn = rows.withColumn("drawn", F.array(F.struct(F.lit(0).alias("tree"), F.lit(1.0).alias("weight"))))
    else:
        drawn = rows.join(weights.groupBy("id").agg(F.collect_list(one).alias("drawn")), "id")  # as many as there are trees
    packed = drawn.select("code", "features", "drawn").mapInArrow(partial(_pack, rule=rule), _STATE)
    return kept(packed, "grow")


def _root_counts(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for _, code, row, tree, weight, _ in _blocks(batches, rule.features):
        for t in np.unique(tree):
            own = tree == t
            total[int(t)] = total.get(int(t), 0) + np.bincount(code[row[own]], weight[own], minlength=rule.classes)
    for t, c in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([t] * len(c), pa.int32()), pa.array(range(len(c)), pa.int32()), pa.array(c)], ["tree", "code", "w"])


def root_counts(blocks: DataFrame, rule: Rule) -> dict[tuple[int, int], np.ndarray]:
    """Weights by class of each tree's root."""
    found = blocks.mapInArrow(partial(_root_counts, rule=rule), "tree int, code int, w double").groupBy("tree", "code").agg(F.sum("w").alias("w")).collect()  # trees * classes
    out: dict[tuple[int, int], np.ndarray] = {}
    for r in found:
        out.setdefault((r["tree"], 0), np.zeros(rule.classes))[r["code"]] = r["w"]
    return dict(sorted(out.items()))


def _pass(batches: Iterator[pa.RecordBatch], level: Level, rule: Rule) -> Iterator[pa.RecordBatch]:
    """Kinds of rows: 0 blocks of what stays, 1 histograms (t, n, f) of the nodes that are counted, 2 pieces of small nodes."""
    splits = np.array(sorted(level.splits), np.int64)
    feature, threshold = (np.array([level.splits[k][i] for k in splits.tolist()]) for i in (0, 1))
    bins = max(map(len, rule.edges)) if rule.edges else 0
    size = bins * rule.classes
    held: dict[int, np.ndarray] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for k, h in held.items():
            for f in range(rule.features):
                yield _row(1, t=k >> 32, n=k & (2**32 - 1), f=f, hist=h[f].tobytes())
        held.clear()

    for x, code, row, tree, weight, node in _blocks(batches, rule.features):
        if len(splits):
            at = _find(splits, keys_of(tree, node))
            row, tree, weight, node, at = (c[at >= 0] for c in (row, tree, weight, node, at))
            node = 2 * node + 2 - (x[row, feature[at]] <= threshold[at])
        keys = keys_of(tree, node)
        at = _find(level.counted, keys)
        if (at >= 0).any():
            some = at >= 0
            which, place = np.unique(at[some], return_inverse=True)
            for f, e in enumerate(rule.edges):
                cell = (place * bins + np.searchsorted(e, x[row[some], f])) * rule.classes + code[row[some]]
                own = np.bincount(cell, weight[some], minlength=len(which) * size).reshape(len(which), size)
                for i, k in enumerate(level.counted[which].tolist()):
                    held.setdefault(k, np.zeros((rule.features, size)))[f] += own[i]
            if len(held) * size * rule.features > HELD:
                yield from sent()
        local = _find(level.local, keys)
        for k in np.unique(keys[local >= 0]).tolist():
            own = keys == k
            yield _state(x[row[own]], code[row[own]], np.arange(own.sum()), tree[own], weight[own], node[own], kind=2, t=k >> 32, n=k & (2**32 - 1))
        stay = _find(level.large, keys) >= 0
        if stay.any():
            used, place = np.unique(row[stay], return_inverse=True)
            yield _state(x[used], code[used], place, tree[stay], weight[stay], node[stay])
    yield from sent()


def passed(blocks: DataFrame, level: Level, rule: Rule) -> DataFrame:
    """One pass over the blocks, written."""
    return kept(blocks.mapInArrow(partial(_pass, level=level, rule=rule), _STATE), "level")


def _entries(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[pa.RecordBatch]:
    for x, code, row, tree, weight, node in _blocks(batches, features):
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * features), pa.array(x[row].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(node), pa.array(weight), pa.array(code[row]), flat], ["tree", "node", "weight", "code", "features"])


def unpacked(blocks: DataFrame, rule: Rule) -> DataFrame:
    """(tree, node, weight, code, features) for each entry."""
    return blocks.mapInArrow(partial(_entries, features=rule.features), "tree int, node long, weight double, code int, features array<double>")


# --- splits -------------------------------------------------------------------------------------


def _entropy(counts: np.ndarray) -> np.ndarray:
    """Bits, over the last axis."""
    share = counts / np.maximum(counts.sum(axis=-1, keepdims=True), 1e-300)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(share > 0, -share * np.log2(share), 0.0).sum(axis=-1)


def gains(left: np.ndarray, total: np.ndarray, rule: Rule) -> np.ndarray:
    """Information gained by splits with these weights on the left; -1 where a side is too light."""
    right = total - left
    n, nl, nr = total.sum(), left.sum(axis=-1), right.sum(axis=-1)
    gain = np.round(_entropy(total) - nl / n * _entropy(left) - nr / n * _entropy(right), 12)
    return np.where((nl >= rule.least_leaf) & (nr >= rule.least_leaf), gain, -1.0)


def _histogram_split(hist: np.ndarray, values: np.ndarray, total: np.ndarray, rule: Rule) -> tuple[float, float, np.ndarray] | None:
    """(gain, threshold, left) of one feature's best split by its histogram (bins x classes)."""
    some = np.flatnonzero(hist.sum(axis=1) > 0)
    if len(some) < 2:
        return None
    there = hist[some] > 0
    one = there.sum(axis=1) == 1
    label = there.argmax(axis=1)
    left = hist[some].cumsum(axis=0)[:-1]
    g = np.where(one[:-1] & one[1:] & (label[:-1] == label[1:]), -1.0, gains(left, total, rule))
    i = int(g.argmax())
    return (float(g[i]), float(values[some[i]]), left[i]) if g[i] >= 0 else None


def _summed(batches: Iterator[pa.RecordBatch], rule: Rule, large: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (t, parent, f, kind, n, hist) in order: of each parent and feature its own histogram (kind 0; none for a root) and the
    parts of the lighter child (1). Rows (tree, node, feature, hist, gain, threshold, left) of each large child."""
    bins = max(map(len, rule.edges))
    shape = bins, rule.classes
    key = whole = part = child = None

    def made() -> Iterator[pa.RecordBatch]:
        if key is None or part is None:
            return
        tree, parent, f = key
        hists = {child: part} if whole is None else {child: part, (child + 1 if child % 2 else child - 1): np.where(whole - part > 1e-9, whole - part, 0.0)}
        for node, h in hists.items():
            if _find(large, keys_of(np.array([tree]), np.array([node])))[0] < 0:
                continue
            found = _histogram_split(h[: len(rule.edges[f])], rule.edges[f], h.sum(axis=0), rule) if f in rule.looked_at(tree, node) else None
            gain, threshold, left = found or (None, None, None)
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in ((tree, pa.int32()), (node, pa.int64()), (f, pa.int32()), (h.tobytes(), pa.binary()), (gain, pa.float64()), (threshold, pa.float64()), (left, pa.list_(pa.float64())))],
                ["tree", "node", "feature", "hist", "gain", "threshold", "left"],
            )

    for batch in batches:
        for r in batch.to_pylist():
            if (r["t"], r["parent"], r["f"]) != key:
                yield from made()
                key, whole, part, child = (r["t"], r["parent"], r["f"]), None, None, None
            h = np.frombuffer(r["hist"]).reshape(shape)
            if r["kind"] == 0:
                whole = h
            else:
                child, part = r["n"], h.copy() if part is None else part + h
    yield from made()


def summed(counted: DataFrame, parents: DataFrame | None, level: Level, rule: Rule) -> DataFrame:
    """Histograms and best splits by feature of the level's large nodes: (tree, node, feature, hist, gain, threshold, left)."""
    parent = F.when(F.col("n") == 0, F.lit(-1)).otherwise(F.floor((F.col("n") - 1) / 2)).cast("long")
    met = counted.select("t", parent.alias("parent"), "f", F.lit(1).alias("kind"), "n", "hist")
    if parents is not None:
        met = met.unionByName(parents.select(F.col("tree").alias("t"), F.col("node").alias("parent"), F.col("feature").alias("f"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("n"), "hist"))
    met = met.repartition("t", "parent", "f").sortWithinPartitions("t", "parent", "f", "kind")
    made = met.mapInArrow(partial(_summed, rule=rule, large=level.large), "tree int, node long, feature int, hist binary, gain double, threshold double, left array<double>")
    return kept(made, "histograms")


def best_of(hists: DataFrame) -> DataFrame:
    """(tree, node, feature, threshold, gain, left): the best feature's split, of equals the first feature's."""
    best = F.max(F.struct("gain", (-F.col("feature")).alias("f"), "threshold", "left")).alias("b")
    return hists.where("gain IS NOT NULL").groupBy("tree", "node").agg(best).select("tree", "node", (-F.col("b.f")).alias("feature"), "b.threshold", "b.gain", "b.left")


def _search(x: np.ndarray, rows: np.ndarray, code: np.ndarray, weight: np.ndarray, total: np.ndarray, looked_at: np.ndarray, rule: Rule) -> tuple[float, int, float] | None:
    """(gain, feature, threshold) of the best split of a small node, whose rows are in order of code. Features are taken together as
    far as their counts fit CELLS; where one alone doesn't, its values are counted a run after the other."""
    best = None
    step = max(1, CELLS // max(1, len(rows) * rule.classes))
    code, weight = code[rows], weight[rows]
    for lo in range(0, len(looked_at), step):
        some = looked_at[lo : lo + step]
        v = x[rows[:, None], some]
        order = v.argsort(axis=0, kind="stable")  # by value, then code
        v, c = np.take_along_axis(v, order, axis=0), code[order]
        edge = v[1:] != v[:-1]
        same = c[1:] == c[:-1]
        if rule.edges is not None:  # bins that both hold one label alone
            at = np.arange(len(v))[:, None]
            first = np.maximum.accumulate(np.where(np.vstack([np.ones((1, len(some)), bool), edge]), at, 0), axis=0)
            last = np.minimum.accumulate(np.where(np.vstack([edge, np.ones((1, len(some)), bool)]), at, len(v))[::-1], axis=0)[::-1]
            low, high = np.take_along_axis(c, first, axis=0), np.take_along_axis(c, last, axis=0)
            same &= low[:-1] == high[1:]
        open_, w, before = edge & ~same, weight[order], 0
        run = len(v) if step > 1 else max(1, CELLS // rule.classes)
        for start in range(0, len(open_), run):
            upto = np.zeros((*c[start : start + run].shape, rule.classes))
            np.put_along_axis(upto, c[start : start + run, :, None], w[start : start + run, :, None], axis=2)
            upto[0] += before
            np.cumsum(upto, axis=0, out=upto)
            before = upto[-1].copy()
            at, f = np.nonzero(open_[start : start + run].T)[::-1]  # feature by feature, ascending values
            if not len(at):
                continue
            g = gains(upto[at, f], total, rule)
            i = int(g.argmax())
            if g[i] >= 0 and (best is None or g[i] > best[0]):
                here, following = v[start + at[i], f[i]], v[start + at[i] + 1, f[i]]
                best = float(g[i]), int(some[f[i]]), float(here if rule.edges is not None else (here + following) / 2)
    return best


def subtree(x: np.ndarray, code: np.ndarray, weight: np.ndarray, tree: int, root: int, rule: Rule) -> Iterator[tuple[int, int, int, int, float | None]]:
    """(node, depth, prediction, feature, threshold) of a node and all below it."""
    todo = [(root, code.argsort(kind="stable"))]
    while todo:
        node, rows = todo.pop()
        depth = (node + 1).bit_length() - 1
        total = np.bincount(code[rows], weight[rows], minlength=rule.classes)
        found = None
        if (total > 0).sum() > 1 and depth < rule.max_depth and total.sum() >= rule.least_split:
            found = _search(x, rows, code, weight, total, rule.looked_at(tree, node), rule)
        if found and found[0] >= rule.least_gain:
            left = x[rows, found[1]] <= found[2]
            yield node, depth, int(total.argmax()), found[1], found[2]
            todo += [(2 * node + 1, rows[left]), (2 * node + 2, rows[~left])]
        else:
            yield node, depth, int(total.argmax()), -1, None


def _subtrees(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Pieces in order of node: all of a node are gathered, LOCAL_VALUES values at most."""
    key, parts = None, []

    def made() -> Iterator[pa.RecordBatch]:
        if key is None:
            return
        x, code, weight = (np.concatenate(c) for c in zip(*parts, strict=True))
        parts.clear()
        nodes = list(zip(*subtree(x, code, weight, *key, rule), strict=True))
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(nodes[0]), pa.int32()), *map(pa.array, nodes, types)], ["tree", "node", "depth", "prediction", "feature", "threshold"])

    for batch in batches:
        for i, (t, n) in enumerate(zip(batch.column("t").to_pylist(), batch.column("n").to_pylist(), strict=True)):
            if (t, n) != key:
                yield from made()
                key, parts = (t, n), []
            x, code, _, _, weight, _ = next(_blocks([batch.slice(i, 1)], rule.features))
            parts.append((x, code, weight))
    yield from made()


def subtrees(pieces: Sequence[DataFrame], rule: Rule) -> DataFrame:
    """(tree, node, depth, prediction, feature, threshold) of all small nodes and what is below them."""
    met = pieces[0]
    for more in pieces[1:]:
        met = met.unionByName(more)
    met = met.drop("kind", "f", "hist").repartition("t", "n").sortWithinPartitions("t", "n")
    return met.mapInArrow(partial(_subtrees, rule=rule), "tree int, node long, depth int, prediction int, feature int, threshold double")
