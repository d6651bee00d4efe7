"""Trees grown over binned rows: forests, class forests and boosting whose models depend on the rows alone.

Numbers are cut into at most 256 bins once, and rows are held in blocks, by column, so that a pass hands tasks few values. A pass over the held rows sums counts, weights and targets by node, feature and
bin in every task; the sums meet per node and group of features in a shuffle, where the best split is found, and the driver
receives one split per node. Targets are summed as whole numbers and bagging weights follow from a hash of the row and the
tree, so neither files, partitions nor cores change a model.

All trees of a forest grow together, level by level; a node whose rows fit ``SMALL_ROWS`` is dealt, with its rows, to one
task that finishes its subtree, so depth is not limited. A tree with a number of leaves grows best-first: a pass opens every
node that the queue of gains would split as far as it is known, and the queue is then run again.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortry.session import batch_rows, local_table, stored

#: Distinct rows that bin edges are taken from, by a hash, and values among them.
EDGE_ROWS, EDGE_VALUES = 200_000, 1 << 24
MAX_BINS = 256
#: Rows of a node that one task finishes; bytes of sums a task holds in one pass; cells of a group of features.
SMALL_ROWS = 1 << 15
SUM_BYTES = 32 << 20
_GROUP_CELLS = 512
#: Rows of a block, and blocks that are sent to Python at once.
_BATCH, _BLOCKS = 8192, 16
#: Binned rows that one task reads in a pass, at most about.
_TASK_ROWS = 1_000_000
#: Rows of all trees that are dealt at once to be finished.
_DEALT_ROWS = 30_000_000
#: Rounds of boosting between two written states.
_WRITE_EVERY = 10
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 16)]))


@dataclass(frozen=True)
class Rules:
    """When and how nodes split; 0 stands for no limit of ``max_depth`` and ``leaves``."""

    max_depth: int = 0
    leaves: int = 0
    min_split: int = 2
    min_leaf: int = 1
    l1: float = 0.0
    l2: float = 0.0
    features: object = None  # "sqrt", "log2", a share, a number, or all
    classes: int = 1

    def tried(self, p: int) -> int:
        """Features looked at in a node; where none of them splits it, more follow."""
        f = self.features
        if f in (None, "all", "None"):
            return p
        if isinstance(f, str) and f in ("sqrt", "log2"):
            return max(1, int(p**0.5 if f == "sqrt" else log2(p)))
        f = float(f)
        return max(1, min(p, int(f * p) if f <= 1.0 else int(f)))


@dataclass(frozen=True)
class Draw:
    """Weights of a tree's rows: Poisson(1) for ``bagging``, else 0 or 1 at ``rate``; 0 in the part that is left out."""

    bagging: bool = False
    rate: float = 1.0
    seed: int = 42
    leave: int = -1

    def weights(self, batch: pa.RecordBatch | Block, tree: int) -> np.ndarray:
        out = self._drawn(np.asarray(batch.column("key")), tree)
        return out if self.leave < 0 else np.where(np.asarray(batch.column("part")) == self.leave, 0, out)

    def _drawn(self, keys: np.ndarray, tree: int) -> np.ndarray:
        if not self.bagging and self.rate >= 1.0:
            return np.ones(len(keys), np.int64)
        own = mixed(np.array([self.seed * 1_000_003 + tree], np.int64).view(np.uint64))
        u = (mixed(keys.view(np.uint64) ^ own) >> np.uint64(11)).astype(np.float64) / 2**53
        return np.searchsorted(_POISSON, u, "right") if self.bagging else (u < self.rate).astype(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass(frozen=True)
class Cells:
    """The bins of all features in one row of cells, cut into groups of features."""

    edges: tuple
    begins: np.ndarray = field(init=False)
    feature: np.ndarray = field(init=False)
    bin: np.ndarray = field(init=False)
    groups: tuple = field(init=False)

    def __post_init__(self):
        sizes = [len(e) + 1 for e in self.edges]
        put = lambda name, value: object.__setattr__(self, name, value)
        put("begins", np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
        put("feature", np.repeat(np.arange(len(sizes)), sizes))
        put("bin", np.concatenate([np.arange(s) for s in sizes]) if sizes else np.empty(0, np.int64))
        cuts = [0]
        for f, end in enumerate(self.begins[1:], 1):
            if f == len(sizes) or self.begins[f + 1] - self.begins[cuts[-1]] > _GROUP_CELLS:
                cuts.append(f)
        put("groups", tuple(zip(cuts, cuts[1:])))

    def __len__(self) -> int:
        return int(self.begins[-1])


def row_key(df: DataFrame, features: str):
    """A hash of a row's own columns; of its features only where it has no others, as those may hold scaled digits.

    Columns that encoding has derived (``feature__z`` and the like) are left out for the same reason.
    """
    plain = [c for c, kind in df.dtypes if kind != "vector" and not kind.startswith(("array", "map", "struct")) and "__" not in c and c not in ("label", "fold", "prediction")]
    return F.xxhash64(*([F.col(f"`{c}`") for c in plain] or [vector_to_array(features)]), *([F.col("label")] if "label" in df.columns else []))


_RAW = "n int, x binary, y binary, key binary, part binary, draw binary"
_HELD = "n int, bins binary, y binary, key binary, part binary, f binary"
_KINDS = {"x": np.uint8, "bins": np.uint8, "y": np.float64, "key": np.int64, "part": np.int32, "draw": np.int32, "f": np.float64}


#: Values of a feature in a block that are written as codes of one byte.
_CODED = 256


def packed(x: np.ndarray) -> np.ndarray:
    """Rows of numbers as bytes by column: the distinct values and a code per row where they are few, else the numbers."""
    heads, parts = np.zeros(x.shape[1] + 1, np.int64), []
    heads[0] = x.shape[1]
    for f in range(x.shape[1]):
        column = np.ascontiguousarray(x[:, f])
        coded = pa.array(column).dictionary_encode()
        if len(coded.dictionary) <= min(_CODED, len(column) // 2):
            heads[f + 1] = len(coded.dictionary)
            parts += [coded.dictionary.to_numpy().view(np.uint8), coded.indices.to_numpy().astype(np.uint8)]
        else:
            parts.append(column.view(np.uint8))
    return np.concatenate([heads.view(np.uint8), *parts])


def unpacked(x: np.ndarray, rows: int) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """Per feature its numbers, or its distinct values and the codes of the rows."""
    p = int(x[:8].view(np.int64)[0])
    out, at = [], 8 * (p + 1)
    for n in x[8 : 8 * (p + 1)].view(np.int64).tolist():
        values = np.frombuffer(x, np.float64, n or rows, at)
        at += 8 * (n or rows)
        out.append((values, x[at : at + rows] if n else None))
        at += rows if n else 0
    return out


class Block:
    """The columns of a block's rows as arrays; ``bins`` has a line per row but lies by column, ``x`` is packed, one value stands for equal ones."""

    def __init__(self, rows: int, values: dict):
        self.rows, self.values = rows, values

    def column(self, name: str) -> np.ndarray:
        out = np.frombuffer(self.values[name], _KINDS[name])
        if name == "bins":
            return out.reshape(-1, self.rows).T
        return np.broadcast_to(out, self.rows) if len(out) == 1 and name != "x" else out

    def batch(self, **new: np.ndarray) -> pa.RecordBatch:
        """The block as one row, with columns that ``new`` brings in the place of those it names or of ``x`` and ``draw``."""
        new = {c: v[:1] if c in ("part", "f") and (v == v[0]).all() else v for c, v in new.items()}
        held = {c: v for c, v in self.values.items() if not new or c not in ("x", "draw")} | {c: pa.py_buffer(np.ascontiguousarray(v, _KINDS[c])) for c, v in new.items()}
        names = [c for c in _KINDS if c in held]
        one = [pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, held[c].size], np.int32)), held[c]]) for c in names]
        return pa.RecordBatch.from_arrays([pa.array([self.rows], pa.int32()), *one], ["n", *names])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        names = batch.schema.names[1:]
        for i, n in enumerate(batch.column("n").to_pylist()):
            yield Block(n, {c: batch.column(c)[i].as_buffer() for c in names})


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as blocks; a missing part is -1."""
    for batch in batches:
        for at in range(0, batch.num_rows, _BATCH):
            rows = batch.slice(at, _BATCH)
            x = np.asarray(rows.column("x").flatten(), dtype=np.float64).reshape(rows.num_rows, -1)
            new = {"x": packed(x), "part": np.asarray(rows.column("part").fill_null(-1))}
            yield Block(rows.num_rows, {}).batch(**new, **{c: np.asarray(rows.column(c)) for c in ("y", "key", "draw")})


def _extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, least and largest label and number of features of every task that has any rows."""
    found = [(b.rows, b.column("y").min(), b.column("y").max(), int(b.column("x")[:8].view(np.int64)[0])) for b in _blocks(batches)]
    if found:
        n, low, high, width = zip(*found)
        yield pa.RecordBatch.from_pylist([{"n": sum(n), "low": float(min(low)), "high": float(max(high)), "width": max(width)}])


def bin_edges(blocks: DataFrame, bins: int, n: int, width: int) -> tuple:
    """Per feature the upper ends of all bins but the last: midpoints of neighbours where values are few, else of quantiles."""
    want = max(1, min(EDGE_ROWS, EDGE_VALUES // max(1, width)))
    share = min(1 << 30, (want << 30) // max(n, 1) + 1)

    def drawn(batches):
        for block in _blocks(batches):
            own = np.flatnonzero(block.column("draw") < share)
            ends = np.arange(len(own) + 1, dtype=np.int32) * width
            x = [values[own] if codes is None else values[codes[own]] for values, codes in unpacked(block.column("x"), block.rows)]
            values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.stack(x, axis=1).ravel() if x else np.zeros(0)))
            yield pa.RecordBatch.from_arrays([pa.array(block.column("key")[own]), values], ["key", "x"])

    some = blocks.mapInArrow(drawn, "key long, x array<double>").dropDuplicates(["key"]).select("x").toArrow()
    x = np.asarray(some["x"].combine_chunks().flatten(), dtype=np.float64).reshape(-1, width)
    out = []
    for column in x.T:
        column = np.sort(column[~np.isnan(column)])
        values = np.unique(column)
        if len(values) > bins:
            values = np.unique(column[(np.arange(bins) * (len(column) / bins)).astype(int)])
        out.append((values[:-1] + values[1:]) / 2)
    return tuple(out)


def _binned(batches: Iterator[pa.RecordBatch], edges: tuple) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches):
        out = np.empty((len(edges), block.rows), np.uint8)
        for f, (e, (values, codes)) in enumerate(zip(edges, unpacked(block.column("x"), block.rows))):
            bins = np.searchsorted(e, values, "left").astype(np.uint8)
            out[f] = bins if codes is None else bins[codes]
        yield block.batch(bins=out, f=np.zeros(block.rows))


@dataclass(frozen=True)
class Scale:
    """Targets as whole numbers: round((y - middle) * factor)."""

    middle: float
    factor: float

    @staticmethod
    def of(low: float, high: float, n: int) -> Scale:
        bits = min(32, 58 - ceil(log2(max(n, 2))))
        span = (high - low) / 2
        return Scale((low + high) / 2 if span else low, 2.0 ** (bits - ceil(log2(span))) if span else 1.0)

    def __call__(self, y: np.ndarray) -> np.ndarray:
        return np.clip(np.rint((y - self.middle) * self.factor), -(2.0**35), 2.0**35)


# ---------------------------------------------------------------- splits


def _score(total: np.ndarray, mass: np.ndarray, rules: Rules, factor: float) -> np.ndarray:
    """Sum over the targets of the squared, shrunken total over the mass."""
    g = total / factor
    if rules.l1:
        g = np.sign(g) * np.maximum(np.abs(g) - rules.l1, 0.0)
    return (g * g).sum(axis=-1) / np.where(mass + rules.l2 > 0, mass + rules.l2, 1.0)


@dataclass
class Split:
    feature: int
    bin: int
    gain: float
    left: tuple  # count, mass, totals


def best_split(sums: np.ndarray, features: np.ndarray, bins: np.ndarray, rank: np.ndarray, rules: Rules, factor: float) -> tuple[int, Split] | None:
    """(rank of the feature, split) of a node from its cells: count, mass and totals in columns.

    Features of rank 0 go first; where they offer no split, the next rank does. Equal gains go by feature and bin.
    """
    last = np.append(features[1:] != features[:-1], True)
    first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    running = np.cumsum(sums, axis=0)
    before = np.repeat(running[first] - sums[first], np.diff(np.append(first, len(sums))), axis=0)
    left = running - before
    whole = np.repeat(left[last], np.diff(np.append(first, len(sums))), axis=0)
    right = whole - left
    fits = ~last & (left[:, 0] >= max(1, rules.min_leaf)) & (right[:, 0] >= max(1, rules.min_leaf))
    if not fits.any():
        return None
    if rules.l1 or rules.l2:
        before = _score(whole[:, 2:], whole[:, 1], rules, factor)
        gain = _score(left[:, 2:], left[:, 1], rules, factor) + _score(right[:, 2:], right[:, 1], rules, factor) - before
        fits &= gain > 1e-12 * before
    else:  # the same, from the difference of the means, which keeps small steps beside large values
        a, b = np.maximum(left[:, 1], 1).astype(float), np.maximum(right[:, 1], 1).astype(float)
        apart = (left[:, 2:] / a[:, None] - right[:, 2:] / b[:, None]) / factor
        gain = (apart * apart).sum(axis=1) * (a * b / (a + b))
        fits &= gain > (1e-9 if rules.classes == 1 else 1e-18) * (a + b) / factor**2
    if not fits.any():
        return None
    own = rank[features]
    least = own[fits].min()
    at = int(np.argmax(np.where(fits & (own == least), gain, -np.inf)))
    return int(least), Split(int(features[at]), int(bins[at]), float(gain[at]), tuple(left[at].tolist()))


def ranks(mark: int, p: int, tried: int) -> np.ndarray:
    """Rank 0 for the features a node tries, 1, 2, ... for those that follow, by the node's own draw."""
    if tried >= p:
        return np.zeros(p, np.int64)
    order = np.argsort(mixed(np.arange(p, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(mark)), kind="stable")
    out = np.empty(p, np.int64)
    out[order] = np.maximum(0, np.arange(p) - tried + 1)
    return out


def _marks(mark: int) -> tuple[int, int]:
    both = mixed(np.array([mark ^ 0x5851F42D4C957F2D, mark ^ 0x14057B7EF767814F], np.uint64))
    return int(both[0]), int(both[1])


class Tree:
    """A tree under way: parallel lists of nodes."""

    def __init__(self, sums: tuple, mark: int, depth: int = 0):
        self.feature, self.bin, self.left, self.right, self.gain = [], [], [], [], []
        self.sums, self.depth, self.mark, self.split = [], [], [], []
        self.add(sums, depth, mark)

    def add(self, sums: tuple, depth: int, mark: int) -> int:
        for held, value in ((self.feature, -1), (self.bin, 0), (self.left, -1), (self.right, -1), (self.gain, 0.0), (self.sums, sums), (self.depth, depth), (self.mark, mark), (self.split, "open")):
            held.append(value)
        return len(self.feature) - 1

    def open_children(self, node: int) -> tuple[int, int]:
        split = self.split[node]
        if self.left[node] < 0:
            marks = _marks(self.mark[node])
            rest = tuple(a - b for a, b in zip(self.sums[node], split.left))
            self.left[node] = self.add(split.left, self.depth[node] + 1, marks[0])
            self.right[node] = self.add(rest, self.depth[node] + 1, marks[1])
        return self.left[node], self.right[node]

    def may_split(self, node: int, rules: Rules) -> bool:
        count = self.sums[node][0]
        pure = rules.classes > 1 and max(self.sums[node][2:]) == self.sums[node][1]
        return count >= max(2, rules.min_split, 2 * rules.min_leaf) and not (rules.max_depth and self.depth[node] >= rules.max_depth) and not pure

    def settle(self, rules: Rules) -> list[int]:
        """Split the nodes that are due, best first; returns nodes whose best split has to be found before going on."""
        todo, heap, leaves, wanted = [0], [], 1, []
        chosen: list[int] = []
        while (todo or heap) and not (rules.leaves and leaves >= rules.leaves):
            for node in todo:
                if self.split[node] == "open":
                    if self.may_split(node, rules):
                        wanted.append(node)
                    else:
                        self.split[node] = None
                if isinstance(self.split[node], Split):
                    heapq.heappush(heap, (-self.split[node].gain, node))
            todo = []
            if not heap:
                break
            node = heapq.heappop(heap)[1]
            chosen.append(node)
            leaves += 1
            todo = list(self.open_children(node))
        self.chosen = chosen
        return wanted

    def close(self) -> None:
        for node in self.chosen:
            s = self.split[node]
            self.feature[node], self.bin[node], self.gain[node] = s.feature, s.bin, s.gain

    def arrays(self, chosen: Sequence[int]) -> dict:
        """The tree as far as it is split, for tasks that look up where rows are."""
        feature = np.full(len(self.feature), -1, np.int32)
        at = np.zeros(len(self.feature), np.int32)
        for node in chosen:
            feature[node], at[node] = self.split[node].feature, self.split[node].bin
        return {"feature": feature, "bin": at, "left": np.array(self.left, np.int32), "right": np.array(self.right, np.int32)}


def reached(bins: np.ndarray, tree: dict) -> np.ndarray:
    """The node at which each row ends. All rows step together; once most have ended, only the others do."""
    n, leaf, nodes = len(bins), tree["feature"] < 0, np.arange(len(tree["feature"]))
    begin = np.where(leaf, 0, tree["feature"]).astype(np.int64) * n
    cut = np.where(leaf, 255, tree["bin"]).astype(np.uint8)
    below = np.stack([np.where(leaf, nodes, tree["left"]), np.where(leaf, nodes, tree["right"])], axis=1).ravel()
    by_column, at, live = np.ascontiguousarray(bins.T).ravel(), np.zeros(n, np.int64), np.arange(n)
    now = at
    while True:
        ended = leaf.take(now)
        going = len(now) - int(ended.sum())
        if 2 * going < len(now):
            at[live] = now
            if not going:
                return at
            live, now = live[~ended], now[~ended]
        now = below.take(2 * now + (by_column.take(begin.take(now) + live) > cut.take(now)))


def _sums_of(bins: np.ndarray, target: np.ndarray, weight: np.ndarray, slot: np.ndarray, slots: int, cells: Cells, classes: int) -> np.ndarray:
    """(slots, cells, columns) of whole numbers: rows, weight, and weighted target or weight per class."""
    place = (slot[:, None] * len(cells) + cells.begins[:-1] + bins).ravel()
    size, p = slots * len(cells), bins.shape[1]
    out = np.empty((size, 2 + classes), np.int64)
    out[:, 0] = np.bincount(place, minlength=size)
    out[:, 1] = out[:, 0] if (weight == 1).all() else np.bincount(place, np.repeat(weight, p), size)
    if classes == 1:
        out[:, 2] = np.rint(np.bincount(place, np.repeat(target * weight, p), size))
    else:
        by_class = np.bincount(place * classes + np.repeat(target.astype(np.int64), p), np.repeat(weight, p), size * classes)
        out[:, 2:] = by_class.reshape(size, classes)
    return out.reshape(slots, len(cells), -1)


_PACK = float(1 << 32)


class _Sums:
    """Sums of a task's blocks by node and cell for some trees, as :func:`_sums_of` has them.

    Of every feature the bin that is most common in the first block is left out and follows from the node's total at the end, so
    a row costs as many entries as it has uncommon bins: one for a whole set of category flags. Rows and weight share a sum.
    All numbers are whole, so nothing depends on which bin is left out.
    """

    def __init__(self, cells: Cells, classes: int):
        self.cells, self.classes, self.common = cells, classes, None
        self.held: dict[int, np.ndarray] = {}

    def entries(self, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of every uncommon bin, and a cell of its own that every row is in."""
        if self.common is None:
            self.common = np.array([np.bincount(b).argmax() for b in bins.T], np.uint8)
        rows, cells = [np.arange(len(bins))], [np.full(len(bins), len(self.cells))]
        for f, begin in enumerate(self.cells.begins[:-1].tolist()):
            rows.append(np.flatnonzero(bins[:, f] != self.common[f]))
            cells.append(bins[rows[-1], f].astype(np.int64) + begin)
        return np.concatenate(rows), np.concatenate(cells)

    def add(self, number: int, bins: np.ndarray, entries: tuple, target: np.ndarray, weight: np.ndarray, slot: np.ndarray, slots: int) -> None:
        row, cell = entries
        own = (slot >= 0) & (weight > 0)
        live = int(own.sum())
        if not live:
            return
        width, k = len(self.cells) + 1, self.classes
        size = slots * width
        if live * len(self.common) < 0.8 * len(row):  # few rows: all of their bins
            some = np.flatnonzero(own)
            out = np.empty((slots, width, 2 + k), np.int64)
            out[:, :-1] = _sums_of(bins[some], target[some], weight[some], slot[some], slots, self.cells, k)
            out[:, -1] = out[:, : self.cells.begins[1]].sum(axis=1)
            out[:, self.cells.begins[:-1] + self.common] = 0
            self._put(number, out)
            return
        if live < len(own):  # the others go to a slot of their own that is cut off
            slot, slots = np.where(own, slot, slots), slots + 1
        plain = weight.max() == 1
        place, cells = (slot * width).take(row) + cell, slots * width
        both = None if plain else (weight + _PACK).take(row)
        out = np.empty((size, 2 + k), np.int64)
        if k == 1:
            out[:, 2] = np.rint(np.bincount(place, (target if plain else target * weight).take(row), cells)[:size])
            found = np.bincount(place, both, cells)[:size]
            out[:, 0] = found if plain else np.floor(found / _PACK)
            out[:, 1] = out[:, 0] if plain else found - out[:, 0] * _PACK
        else:
            found = np.bincount(place * k + target.astype(np.int64).take(row), both, cells * k)[: size * k].reshape(size, k)
            rows = found if plain else np.floor(found / _PACK)
            out[:, 2:] = found if plain else found - rows * _PACK
            out[:, 0], out[:, 1] = rows.sum(axis=1), out[:, 2:].sum(axis=1)
        self._put(number, out.reshape(-1, width, 2 + k))

    def _put(self, number: int, out: np.ndarray) -> None:
        if number in self.held:
            self.held[number] += out
        else:
            self.held[number] = out

    def of(self, number: int) -> np.ndarray:
        """(slots, cells, columns), the common bins filled in."""
        sums, begins = self.held[number], self.cells.begins
        total, out = sums[:, -1], sums[:, :-1]
        if len(self.common):
            out[:, begins[:-1] + self.common] = total[:, None] - np.add.reduceat(out, begins[:-1], axis=1)
        return out


def _target(block: Block, scale: Scale, classes: int) -> np.ndarray:
    return scale(block.column("y") - block.column("f")) if classes == 1 else block.column("y")


def _summed(batches: Iterator[pa.RecordBatch], trees: list, cells: Cells, draw: Draw, scale: Scale, classes: int) -> Iterator[pa.RecordBatch]:
    """trees: (number, arrays, slot of every node or -1, slots, first slot)."""
    sums = _Sums(cells, classes)
    for block in _blocks(batches):
        bins, target = block.column("bins"), _target(block, scale, classes)
        entries = sums.entries(bins)
        for number, arrays, slot_of, slots, _ in trees:
            sums.add(number, bins, entries, target, draw.weights(block, number), slot_of[reached(bins, arrays)].astype(np.int64), slots)
    for number, _, _, slots, first in trees:
        if number in sums.held:
            own = sums.of(number)
            for slot in range(slots):
                if own[slot, :, 0].any():
                    parts = [own[slot, cells.begins[a] : cells.begins[b]].tobytes() for a, b in cells.groups]
                    arrays = [pa.array([first + slot] * len(parts), pa.int32()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, ["slot", "grp", "sums"])
            del sums.held[number]


def _split_found(batches: Iterator[pa.RecordBatch], marks: np.ndarray, cells: Cells, rules: Rules, factor: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by slot and group: their sum, and its best split."""
    names, p = ["slot", "rank", "gain", "feature", "bin", "left"], len(cells.edges)
    tried, now, total, out = rules.tried(p), None, None, []

    def done():
        a, b = cells.begins[cells.groups[now[1]][0]], cells.begins[cells.groups[now[1]][1]]
        found = best_split(total, cells.feature[a:b], cells.bin[a:b], ranks(int(marks[now[0]]), p, tried), rules, factor)
        if found:
            out.append((now[0], found[0], found[1].gain, found[1].feature, found[1].bin, [int(v) for v in found[1].left]))

    for batch in batches:
        for slot, group, sums in zip(batch.column("slot").to_pylist(), batch.column("grp").to_pylist(), batch.column("sums").to_pylist()):
            part = np.frombuffer(sums, np.int64).reshape(-1, 2 + rules.classes)
            if now == (slot, group):
                total += part
            else:
                if now is not None:
                    done()
                now, total = (slot, group), part.copy()
    if now is not None:
        done()
    types = [pa.int32(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 6, types)], names)


def finish_subtree(bins: np.ndarray, target: np.ndarray, weight: np.ndarray, sums: tuple, depth: int, mark: int, cells: Cells, rules: Rules, factor: float) -> Tree:
    """The subtree of a node whose rows are all here, by the same rule as in the passes."""
    tree = Tree(sums, mark, depth)
    todo, p = [(0, np.arange(len(bins)))], len(cells.edges)
    tried, tree.chosen = rules.tried(p), []
    while todo:
        node, rows = todo.pop()
        found = None
        if tree.may_split(node, rules) and (rules.classes > 1 or target[rows].min() < target[rows].max()):
            held = _sums_of(bins[rows], target[rows], weight[rows], np.zeros(len(rows), np.int64), 1, cells, rules.classes)[0]
            found = best_split(held, cells.feature, cells.bin, ranks(tree.mark[node], p, tried), rules, factor)
        tree.split[node] = found[1] if found else None
        if found:
            tree.chosen.append(node)
            below = bins[rows, found[1].feature] <= found[1].bin
            a, b = tree.open_children(node)
            todo += [(a, rows[below]), (b, rows[~below])]
    tree.close()
    return tree


# ---------------------------------------------------------------- growing over the held rows


class Held:
    """Binned rows held for the passes of a fit, in blocks: (bins, y, key, part, f)."""

    def __init__(self, rows: DataFrame, bins: int = MAX_BINS, classes: int = 1):
        """``rows``: x (array of numbers), y, key, part (a fold, or null)."""
        self.spark, self.classes = rows.sparkSession, classes
        drawn = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(1 << 30)).cast("int").alias("draw")
        picked = rows.filter("y IS NOT NULL").select("x", "y", "key", "part", drawn).mapInArrow(_blocked, _RAW).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            with batch_rows(self.spark, _BATCH):
                picked.count()  # rows become blocks here; what follows reads blocks
            with batch_rows(self.spark, _BLOCKS):
                extent = picked.mapInArrow(_extent, "n long, low double, high double, width long")
                self.n, low, high, width = extent.agg(F.sum("n"), F.min("low"), F.max("high"), F.max("width")).first()
                if not self.n:
                    raise ValueError("no rows with a label")
                self.cells = Cells(bin_edges(picked, min(bins, MAX_BINS), self.n, width))
                edges = self.cells.edges
                binned = picked.mapInArrow(lambda b: _binned(b, edges), _HELD)
                # all cores take part in every pass
                least = max(self.spark.sparkContext.defaultParallelism, self.n // _TASK_ROWS)
                if binned.rdd.getNumPartitions() < least:
                    binned = binned.repartition(least)
                self.frame = self._binned = binned.persist(StorageLevel.MEMORY_AND_DISK)
                self.frame.count()
        finally:
            picked.unpersist()
        self.scale = Scale.of(low, high, self.n) if classes == 1 else Scale(0.0, 1.0)
        self._kept, self._written = [], 0

    def close(self) -> None:
        self.rewind()
        self._binned.unpersist()

    def rewind(self) -> None:
        """Back to the rows before any round of boosting."""
        for frame in self._kept:
            frame.unpersist()
        self._kept, self.frame, self._written = [], self._binned, 0

    def totals(self, draw: Draw, trees: Sequence[int], classes: int, scale: Scale) -> dict[int, tuple]:
        """Count, mass and totals of the rows each tree draws."""

        def summed(batches):
            held = {t: np.zeros(2 + classes, np.int64) for t in trees}
            for block in _blocks(batches):
                target = _target(block, scale, classes)
                for t in trees:
                    w = draw.weights(block, t)
                    most = [int(np.rint((target * w).sum()))] if classes == 1 else np.bincount(target.astype(np.int64), w, classes).astype(np.int64).tolist()
                    held[t] += np.array([(w > 0).sum(), w.sum(), *most], np.int64)
            yield pa.RecordBatch.from_pylist([{"tree": t, "s": v.tolist()} for t, v in held.items()], schema=pa.schema([("tree", pa.int32()), ("s", pa.list_(pa.int64()))]))

        with batch_rows(self.spark, _BLOCKS):
            parts = self.frame.mapInArrow(summed, "tree int, s array<long>").groupBy("tree").agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(2 + classes)]).collect()
        return {r["tree"]: tuple(r)[1:] for r in parts}

    def splits(self, open_: list[tuple[int, Tree, list[int]]], rules: Rules, draw: Draw, scale: Scale) -> None:
        """Find the best split of the given nodes: as many passes as their sums need room."""
        room = max(1, SUM_BYTES // max(1, len(self.cells) * (2 + rules.classes) * 8))
        wanted = [(number, tree, node) for number, tree, nodes in open_ for node in nodes]
        for begin in range(0, len(wanted), room):
            part, trees, marks = wanted[begin : begin + room], [], []
            by_tree: dict[int, list] = {}
            for number, tree, node in part:
                by_tree.setdefault(number, [tree]).append(node)
            for number, (tree, *nodes) in by_tree.items():
                slot_of = np.full(len(tree.feature), -1, np.int32)
                slot_of[nodes] = np.arange(len(nodes))
                trees.append((number, tree.arrays(tree.chosen), slot_of, len(nodes), len(marks)))
                marks += [tree.mark[n] for n in nodes]
            marked = np.array(marks, np.uint64)
            sent = self.spark.sparkContext.broadcast((trees, self.cells.edges))  # plain values: no class of this package
            sums = self.frame.mapInArrow(lambda b: _summed(b, sent.value[0], Cells(sent.value[1]), draw, scale, rules.classes), "slot int, grp int, sums binary")
            found = sums.repartition("slot", "grp").sortWithinPartitions("slot", "grp").mapInArrow(
                lambda b: _split_found(b, marked, Cells(sent.value[1]), rules, scale.factor), "slot int, rank long, gain double, feature int, bin int, left array<long>"
            )
            best = found.groupBy("slot").agg(F.max(F.struct(-F.col("rank"), "gain", -F.col("feature"), -F.col("bin"), "left")).alias("s"))
            with batch_rows(self.spark, _BLOCKS):
                rows = best.select("slot", "s.gain", (-F.col("s.col3")).alias("feature"), (-F.col("s.col4")).alias("bin"), "s.left").collect()
            by_slot = {r["slot"]: Split(r["feature"], r["bin"], r["gain"], tuple(r["left"])) for r in rows}
            order = [(tree, node) for tree, *nodes in by_tree.values() for node in nodes]
            for slot, (tree, node) in enumerate(order):
                tree.split[node] = by_slot.get(slot)
            sent.unpersist()

    def grow(self, numbers: Sequence[int], rules: Rules, draw: Draw, scale: Scale | None = None, passes_only: bool = False) -> tuple[dict[int, Tree], DataFrame | None]:
        """The trees of those numbers, and the subtrees that tasks finished (tree, node, arrays), if there are any."""
        scale = scale or self.scale
        totals = self.totals(draw, numbers, rules.classes, scale)
        trees = {t: Tree(totals[t], int(mixed(np.array([draw.seed * 7_368_787 + t], np.uint64))[0])) for t in numbers}
        small: dict[int, list[int]] = {t: [] for t in numbers}
        while True:
            open_ = []
            for t, tree in trees.items():
                wanted = tree.settle(rules)
                if not rules.leaves and not passes_only:
                    few = [n for n in wanted if tree.sums[n][0] <= SMALL_ROWS and not 0 < rules.max_depth - tree.depth[n] <= 2]
                    for n in few:
                        tree.split[n] = None
                    small[t] += few
                    wanted = [n for n in wanted if tree.split[n] == "open"]
                if wanted:
                    open_.append((t, tree, wanted))
            if not open_:
                break
            self.splits(open_, rules, draw, scale)
        for tree in trees.values():
            tree.close()
        return trees, self._finished(trees, small, rules, draw, scale)

    def _finished(self, trees: dict, small: dict, rules: Rules, draw: Draw, scale: Scale) -> DataFrame | None:
        """The subtrees of all small nodes, of as many trees at once as ``_DEALT_ROWS`` allows, at least one."""
        parts, now, held = [], {}, 0
        for t, nodes in [*((t, nodes) for t, nodes in small.items() if nodes), (None, [])]:
            rows = sum(trees[t].sums[n][0] for n in nodes) if nodes else _DEALT_ROWS
            if now and held + rows > _DEALT_ROWS:
                parts.append(self._subtrees(trees, now, rules, draw, scale))
                now, held = {}, 0
            now, held = now | {t: nodes}, held + rows
        return reduce(DataFrame.unionAll, parts) if parts else None

    def _subtrees(self, trees: dict, small: dict, rules: Rules, draw: Draw, scale: Scale) -> DataFrame:
        state = {}
        for t, nodes in small.items():
            if nodes:
                slot_of = np.zeros(len(trees[t].feature), bool)
                slot_of[nodes] = True
                state[t] = (trees[t].arrays(trees[t].chosen), slot_of, {n: (trees[t].sums[n], trees[t].depth[n], trees[t].mark[n]) for n in nodes})
        sent = self.spark.sparkContext.broadcast((state, self.cells.edges))

        def dealt(batches):
            """One row per block and small node met in it, with the node's rows of the block by column."""
            for block in _blocks(batches):
                bins, target, rows = block.column("bins"), _target(block, scale, rules.classes).astype(np.float64), []
                for t, (arrays, slot_of, _) in sent.value[0].items():
                    w = draw.weights(block, t)
                    node = reached(bins, arrays)
                    own = np.flatnonzero(slot_of[node] & (w > 0))
                    own = own[np.argsort(node[own], kind="stable")]
                    cuts = np.flatnonzero(np.diff(node[own])) + 1
                    for at in np.split(own, cuts) if len(own) else []:
                        rows.append((t, int(node[at[0]]), bins[at].tobytes(), target[at].tobytes(), w[at].astype(np.int64).tobytes()))
                columns = list(zip(*rows)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), *[pa.binary()] * 3))], ["tree", "node", "bins", "target", "weight"])

        def finished(key, group):
            t, node = key[0].as_py(), key[1].as_py()
            sums, depth, mark = sent.value[0][t][2][node]
            bins, target, weight = (np.frombuffer(b"".join(group[c].to_pylist()), kind) for c, kind in (("bins", np.uint8), ("target", np.float64), ("weight", np.int64)))
            sub = finish_subtree(bins.reshape(len(target), -1), target, weight, sums, depth, mark, Cells(sent.value[1]), rules, scale.factor)
            out = {"tree": t, "node": node} | _plain(sub, sent.value[1], rules, scale)
            return pa.Table.from_pylist([out], schema=_SUBTREE)

        with batch_rows(self.spark, _BLOCKS):
            rows = self.frame.mapInArrow(dealt, "tree int, node int, bins binary, target binary, weight binary")
            return stored(rows.groupBy("tree", "node").applyInArrow(finished, _SUBTREE_DDL), "subtrees")

    def advance(self, tree: Tree, rules: Rules, rate: float, scale: Scale) -> None:
        """Add the tree's values to every row's ``f``; every tenth state is written to the shared folder."""
        arrays = tree.arrays(tree.chosen)
        value = rate * np.array([leaf_value(s, rules, scale)[0] for s in tree.sums])

        def added(batches):
            for block in _blocks(batches):
                yield block.batch(f=block.column("f") + value[reached(block.column("bins"), arrays)])

        self._move(self.frame.mapInArrow(added, _HELD))

    def start(self, value: float) -> None:
        self._move(self.frame.mapInArrow(lambda batches: (b.batch(f=np.full(b.rows, float(value))) for b in _blocks(batches)), _HELD))

    def _move(self, frame: DataFrame) -> None:
        self._written += 1
        if self._written % _WRITE_EVERY == 0:
            with batch_rows(self.spark, _BLOCKS):
                frame = stored(frame, "boosting-state")
        self.frame = frame.persist(StorageLevel.MEMORY_AND_DISK)  # filled by the next pass, from the state before
        for old in self._kept[:-1]:
            old.unpersist()
        self._kept = [*self._kept[-1:], self.frame]


_SUBTREE = pa.schema(
    [("tree", pa.int32()), ("node", pa.int32()), ("slot", pa.list_(pa.int32())), ("threshold", pa.list_(pa.float64())), ("left", pa.list_(pa.int32())), ("right", pa.list_(pa.int32()))]
    + [(c, pa.list_(pa.float64())) for c in ("gain", "n", "value")]
)
_TREE_DDL = "slot array<int>, threshold array<double>, left array<int>, right array<int>, gain array<double>, n array<double>, value array<double>"
_SUBTREE_DDL = f"tree int, node int, {_TREE_DDL}"


def leaf_value(sums: tuple, rules: Rules, scale: Scale) -> list[float]:
    """The shrunken mean of a node's targets (without the middle), or the shares of its classes."""
    mass = sums[1] + rules.l2
    if rules.classes > 1:
        return [s / max(sums[1], 1) for s in sums[2:]]
    g = sums[2] / scale.factor
    g = np.sign(g) * max(abs(g) - rules.l1, 0.0) if rules.l1 else g
    return [float(g / mass) if mass > 0 else 0.0]


def _plain(tree: Tree, edges: tuple, rules: Rules, scale: Scale, chosen: set | None = None) -> dict:
    """Thresholds and values instead of bins and sums; nodes that were opened but not split into the tree are left out."""
    new, order = {}, [0]
    for node in order:
        new[node] = len(new)
        if tree.feature[node] >= 0:
            order += [tree.left[node], tree.right[node]]
    inner = [tree.feature[n] >= 0 for n in order]
    return {
        "slot": [int(tree.feature[n]) for n in order],
        "threshold": [float(edges[tree.feature[n]][tree.bin[n]]) if i else None for n, i in zip(order, inner)],
        "left": [new[tree.left[n]] if i else -1 for n, i in zip(order, inner)],
        "right": [new[tree.right[n]] if i else -1 for n, i in zip(order, inner)],
        "gain": [float(tree.gain[n]) for n in order],
        "n": [float(tree.sums[n][1]) for n in order],
        "value": [v for n in order for v in leaf_value(tree.sums[n], rules, scale)],
    } | ({"at": {n: new[n] for n in order}} if chosen is not None else {})


def tree_rows(spark: SparkSession, trees: dict[int, Tree], finished: DataFrame | None, edges: tuple, rules: Rules, scale: Scale, weights: dict[int, float]) -> DataFrame:
    """One row per tree: (tree, weight, nodes as arrays), the subtrees that tasks finished set in their places inside tasks."""
    kinds = {"tree": pa.int32(), "weight": pa.float64(), "at": pa.list_(pa.int32())} | {f.name: f.type for f in _SUBTREE if f.name not in ("tree", "node")}
    rows = []
    for t, tree in trees.items():
        cells = _plain(tree, edges, rules, scale, set())
        places = [cells["at"].get(n, -1) for n in range(len(tree.feature))]
        rows.append((t, weights[t], places, *[cells[c] for c in list(kinds)[3:]]))
    top = local_table(spark, kinds, rows)
    if finished is None:
        return stored(top.drop("at"), "trees")
    classes = rules.classes

    def joined(key, tops, subs):
        head, out = tops.to_pylist()[0], None
        out = {c: list(head[c]) for c in list(kinds)[3:]}
        for sub in subs.sort_by("node").to_pylist():
            root, shift = head["at"][sub["node"]], len(out["slot"]) - 1  # the subtree's root takes the leaf's place
            move = lambda i: root if i == 0 else i + shift if i > 0 else -1
            for c in ("slot", "threshold", "gain", "n"):
                out[c][root] = sub[c][0]
                out[c] += sub[c][1:]
            for c in ("left", "right"):
                out[c][root] = move(sub[c][0])
                out[c] += [move(i) for i in sub[c][1:]]
            out["value"] += sub["value"][classes:]
        return pa.Table.from_pylist([{"tree": head["tree"], "weight": head["weight"], **out}], schema=pa.schema([("tree", pa.int32()), ("weight", pa.float64()), *[(c, kinds[c]) for c in list(kinds)[3:]]]))

    pairs = top.groupBy("tree").cogroup(finished.groupBy("tree"))
    return stored(pairs.applyInArrow(joined, f"tree int, weight double, {_TREE_DDL}"), "trees")
