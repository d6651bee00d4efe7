"""Whole-number vectors in packed blocks, exact products, and lists of the best: shared by the vector operators and ranking.

A block is one row that holds up to ``BLOCK_ROWS`` vectors as a matrix. Blocks are small (``BLOCK_BYTES``), so a pair of
them can meet in a join and be scored at once by array code, and no task ever holds more than a few.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortry.llm.common import stored

BLOCK_ROWS = 2048
BLOCK_BYTES = 1 << 19
#: Stands for a null id inside blocks, behind all others; and for "no score yet".
LAST, LEAST = np.iinfo(np.int64).max, np.iinfo(np.int64).min
#: Pairs of blocks sent to Python at once.
PAIRS = 8


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside send at most so many rows to Python at once; the session's setting is put back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _scaled(batches: Iterator[pa.RecordBatch], factor: float, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("v")
        there = pc.is_valid(lists)
        batch, lists = batch.filter(there), lists.filter(there)
        values = np.asarray(pc.fill_null(lists.flatten().cast(pa.float64()), float("nan")))
        sizes = np.asarray(pc.list_value_length(lists), dtype=np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        sound = np.bincount(owner, weights=~np.isfinite(values), minlength=len(sizes)) == 0
        batch, values, owner, sizes = batch.filter(pa.array(sound)), values[sound[owner]], owner[sound[owner]], sizes[sound]
        whole = np.floor(factor * values)
        if len(whole) and np.abs(whole).max() >= 2**31:
            raise OverflowError("a scaled component has more than 32 bits")
        norm = np.sqrt(np.bincount(owner, weights=whole * whole, minlength=len(sound))[sound])
        ends = np.concatenate([[0], np.cumsum(sizes * 4)]).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(whole.astype(np.int32))])
        kept = [batch.column(c).cast(pa.int64()) for c in ["row", *names]]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(norm), packed], ["row", *names, "norm", "v"])


def whole_vectors(rows: DataFrame, vector: Column, factor: float, **numbers: Column) -> DataFrame:
    """row (a number of its own), the given whole numbers, norm and v: floor(factor * component) as 32-bit integers.

    Rows whose vector is null or holds a null or a component that is not finite are left out. The table is written to the
    shared folder, so the row numbers hold whatever is computed again later.
    """
    picked = rows.select(F.monotonically_increasing_id().alias("row"), *[c.cast("long").alias(n) for n, c in numbers.items()], vector.alias("v"))
    names = list(numbers)
    schema = f"row long, {''.join(f'{n} long, ' for n in names)}norm double, v binary"
    return stored(picked.mapInArrow(lambda b: _scaled(b, factor, names), schema), "vectors")


def matrix_of(column: pa.Array) -> np.ndarray:
    """The vectors of a binary column as rows, shorter ones filled up with zeros."""
    sizes = np.asarray(pc.binary_length(column), dtype=np.int64) // 4
    width = int(sizes.max(initial=0))
    data = np.frombuffer(b"".join(column.to_pylist()), np.int32)
    out = np.zeros((len(sizes), width), np.int32)
    out[np.arange(width) < sizes[:, None]] = data
    return out


class Block:
    """Vectors (rows of ``v``), their norms, and whole numbers by name."""

    def __init__(self, v: np.ndarray, norm: np.ndarray, numbers: dict[str, np.ndarray]):
        self.v, self.norm, self.numbers = v, norm, numbers
        self._as: dict = {}

    def __getitem__(self, name: str) -> np.ndarray:
        return self.numbers[name]

    def __len__(self) -> int:
        return len(self.norm)

    def cells(self) -> dict:
        out = {"n": len(self), "width": self.v.shape[1], "v": self.v.tobytes(), "norm": self.norm.tobytes()}
        return out | {k: x.tobytes() for k, x in self.numbers.items()}

    @staticmethod
    def read(cells: dict, names: list[str], prefix: str = "") -> Block:
        at = lambda name, kind: np.frombuffer(cells[prefix + name], kind)
        return Block(at("v", np.int32).reshape(cells[prefix + "n"], cells[prefix + "width"]), at("norm", np.float64), {k: at(k, np.int64) for k in names})

    def typed(self, kind, width: int) -> np.ndarray:
        if (kind, width) not in self._as:
            self._as[kind, width] = np.ascontiguousarray(self.v[:, :width], dtype=kind)
        return self._as[kind, width]

    def unit(self) -> np.ndarray:
        if "unit" not in self._as:
            self._as["unit"] = self.v / np.where(self.norm > 0, self.norm, 1.0)[:, None]
        return self._as["unit"]


def products(a: Block, b: Block, rows: np.ndarray | slice, columns: np.ndarray | slice) -> np.ndarray:
    """Exact inner products of some vectors of both blocks, in the smallest number format that holds all sums.

    A missing component counts as zero. Sums that need more than 64 bits are an error.
    """
    width, most = min(a.v.shape[1], b.v.shape[1]), float(a.norm.max(initial=0)) * float(b.norm.max(initial=0)) * 1.001
    if most >= 2**63:
        raise OverflowError("an inner product has more than 64 bits")
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    return (a.typed(kind, width)[rows] @ b.typed(kind, width)[columns].T).astype(np.int64)


def _packing(batches: Iterator[pa.RecordBatch], names: list[str], group: str | None, most: int) -> Iterator[Block]:
    held: list[pa.RecordBatch] = []
    count = longest = 0

    def done() -> Block:
        t = pa.Table.from_batches(held).combine_chunks()
        number = lambda c: np.asarray(pc.fill_null(t.column(c).cast(pa.int64()), LAST))
        return Block(matrix_of(t.column("v").combine_chunks()), np.asarray(t.column("norm"), dtype=np.float64), {c: number(c) for c in names})

    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = [0, batch.num_rows]
        if group:
            values = np.asarray(batch.column(group))
            cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:]):
            if held and group and held[-1].column(group)[0].as_py() != batch.column(group)[begin].as_py():
                yield done()
                held, count, longest = [], 0, 0
            while begin < end:
                longest = max(longest, pc.max(pc.binary_length(batch.column("v").slice(begin, end - begin))).as_py())
                room = max(1, min(most, BLOCK_BYTES // max(longest, 1))) - count
                if room <= 0:
                    yield done()
                    held, count, longest = [], 0, 0
                    continue
                piece = batch.slice(begin, min(room, end - begin))
                held, count, begin = [*held, piece], count + piece.num_rows, begin + piece.num_rows
    if held:
        yield done()


def packed(rows: DataFrame, numbers: list[str], extra: dict | None = None, group: str | None = None, most: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of the rows as they lie in each partition: key (the partition), n, width, v, norm and the numbers as bytes.

    ``extra`` maps names to (type, function of the block). A block ends where ``group`` changes.
    """
    extra, names = extra or {}, list(dict.fromkeys(numbers))
    schema = "key int, n int, width int, v binary, norm binary" + "".join(f", {c} binary" for c in names)
    schema += "".join(f", {c} {kind}" for c, (kind, _) in extra.items())

    def pack(batches):
        key = TaskContext.get().partitionId()
        for block in _packing(batches, names, group, most):
            cells = {"key": key, **block.cells(), **{c: f(block) for c, (_, f) in extra.items()}}
            yield pa.RecordBatch.from_pylist([cells], schema=arrow)

    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    arrow = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])
    return rows.select("row", "norm", "v", *[c for c in names if c != "row"], *([group] if group and group not in names else [])).mapInArrow(pack, schema)


class Best:
    """The k best entries of each owner: higher scores first, then smaller ids. ``score`` and ``id`` are what a new one must beat."""

    def __init__(self, owners: int, k: int, score: np.ndarray | None = None, id: np.ndarray | None = None):
        self.k = k
        self.score = np.full(owners, LEAST) if score is None else np.array(score)
        self.id = np.full(owners, LAST) if id is None else np.array(id)
        self.entries = [np.empty(0, np.int64)] * 4  # owner, score, id, row

    def beats(self, owner: np.ndarray, score: np.ndarray, id: np.ndarray) -> np.ndarray:
        least = self.score[owner]
        return (score > least) | (score == least) & (id < self.id[owner])

    def add(self, owner: np.ndarray, score: np.ndarray, id: np.ndarray, row: np.ndarray) -> None:
        new = self.beats(owner, score, id)
        if not new.any():
            return
        owner, score, id, row = (np.concatenate([a, b[new]]) for a, b in zip(self.entries, (owner, score, id, row)))
        order = np.lexsort((row, id, -score, owner))
        first = np.searchsorted(owner[order], owner[order])
        place = np.arange(len(order)) - first
        order, place = order[place < self.k], place[place < self.k]
        self.entries = [x[order] for x in (owner, score, id, row)]
        full = order[place == self.k - 1]
        self.score[owner[full]], self.id[owner[full]] = score[full], id[full]

    def lists(self, names: list[str], owners: np.ndarray, rows: np.ndarray | None = None) -> pa.RecordBatch:
        """The entries, of the given rows only if there are any, with each owner's number from ``owners``."""
        owner, score, id, row = self.entries
        own = np.isin(row, rows) if rows is not None else slice(None)
        return pa.RecordBatch.from_arrays([pa.array(x[own]) for x in (owners[owner], score, id, row)], names)


class Held(OrderedDict):
    """Lists of the blocks that a task met last: what one partner block has shown lets the next one stop sooner."""

    def of(self, key, make):
        if key in self:
            self.move_to_end(key)
        else:
            self[key] = make()
            if len(self) > 64:
                self.popitem(last=False)
        return self[key]


def unheld(id: str) -> Column:
    """An id of a block, null if it stood for one."""
    return F.when(F.col(id) != int(LAST), F.col(id))
