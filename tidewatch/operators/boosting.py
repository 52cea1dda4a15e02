"""Gradient-boosted trees that learn where missing numbers go.

Numbers are binned once by approximate quantiles; a missing one has a bin of its own. Each level of a tree is one
aggregate: gradient and hessian sums by (node, column, bin), added up as whole numbers, so that the result does not
depend on the order of rows or on repeated tasks. Each task adds up its own rows first, by Arrow batches. Running sums over a column's bins give the gain of every split,
once with the missing rows on the left and once on the right; the better side becomes the node's direction
for missing cells. A category column is split into one value against all others, a missing one being a value too.
Leaves take Newton steps with a penalty. The driver sees one row per open node and level.

While trees are fitted, rows stand in blocks: one table row holds some thousand of them, column by column, so a level
reads whole arrays and Spark takes no row apart. The blocks are written to the shared folder again every few trees, with
the rows' margins by then, so neither the plan nor the lineage grows with the number of trees.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.operators.ordered import cuts_below
from tidewatch.operators.performance import class_weight
from tidewatch.schema import DROP_COLUMNS, TAG_COLUMNS, TARGET, column_roles, require_columns
from tidewatch.session import run_folder

UNIT = 1 << 20  # one unit of gradient or hessian in whole numbers
NODE_SCHEMA = (
    "tree int, node int, column_name string, threshold double, category string, is_number boolean, "
    "missing_left boolean, value double, gain double, cover double"
)
_MISSING = -1
_CELLS = 1 << 20  # sums that a task holds before it sends them on
_DRAWN = (1 << 20) - 1  # bits of a row's hash that draw it for a tree
# Rows of one Arrow batch, each column one after the other: labels, margins, hashes, bins (0: missing) and categories as
# places in the block's own sorted list; and how many labels are 0 and 1, as the class weight counts them.
BLOCK_SCHEMA = (
    "n int, negatives long, positives long, y binary, margin binary, hash binary, bins binary, codes binary, categories array<string>"
)


@dataclass(frozen=True)
class BoostConfig:
    trees: int = 200
    depth: int = 4
    learning_rate: float = 0.05
    row_fraction: float = 0.9
    column_fraction: float = 0.9
    bins: int = 64
    penalty: float = 1.0  # added to every hessian sum
    least_weight: float = 1.0  # of hessian on either side of a split
    least_gain: float = 1e-6
    seed: int = 42
    written_every: int = 4  # trees between two writes of the margins


@dataclass(frozen=True)
class Node:
    """A split (``column_name`` set) or a leaf. The children of node i are 2i and 2i + 1; the root is 1."""

    tree: int
    node: int
    column_name: str | None
    threshold: float | None
    category: str | None
    is_number: bool
    missing_left: bool
    value: float
    gain: float
    cover: float


@dataclass(frozen=True)
class BoostedModel:
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    trees: tuple[tuple[Node, ...], ...]


def number(column: str | Column) -> Column:
    """A number as double; NaN is missing."""
    return F.nanvl((F.col(column) if isinstance(column, str) else column).cast("double"), F.lit(None).cast("double"))


def quantile_cuts(df: DataFrame, numeric: list[str], bins: int) -> dict[str, list[float]]:
    """Ascending cut points per column from one sketch pass; a column without numbers has none."""
    if not numeric:
        return {}
    shares = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(number(c), shares, 50 * bins).alias(f"_{i}") for i, c in enumerate(numeric)]).first()
    return {c: sorted(set(row[f"_{i}"] or [])) for i, c in enumerate(numeric)}


def width_cuts(df: DataFrame, numeric: list[str], bins: int) -> dict[str, list[float]]:
    """Cut points at equal distances between a column's least and largest number."""
    ends = df.agg(*[f(number(c)).alias(f"{k}_{i}") for i, c in enumerate(numeric) for k, f in (("low", F.min), ("high", F.max))]).first()
    cuts = {}
    for i, c in enumerate(numeric):
        low, high = ends[f"low_{i}"], ends[f"high_{i}"]
        cuts[c] = [] if low is None else sorted({low + (high - low) * k / bins for k in range(1, bins)})
    return cuts


def binned(df: DataFrame, cuts: dict[str, list[float]], categorical: list[str], label: str, weight: Column, seed: int) -> DataFrame:
    """One narrow row per labelled row: y, w, key (hash of its content), numbers as bins, categories as text."""
    def bin_of(column):
        own = F.array(*[F.lit(v) for v in cuts[column]])
        below = cuts_below(own, number(column), len(cuts[column]) + 1) if cuts[column] else F.lit(0)
        return F.when(number(column).isNull(), _MISSING).otherwise(below).cast("int")

    return df.where(F.col(label).isNotNull()).select(
        F.col(label).cast("double").alias("y"),
        weight.cast("double").alias("w"),
        F.xxhash64(F.lit(seed), *df.columns).alias("key"),
        (F.array(*[bin_of(c) for c in cuts]) if cuts else F.array().cast("array<int>")).alias("bins"),
        (F.array(*[F.col(c).cast("string") for c in categorical]) if categorical else F.array().cast("array<string>")).alias("categories"),
        F.lit(0.0).alias("margin"),
    )


def gradients(rows: DataFrame, margin: Column | None = None) -> DataFrame:
    """With ``g`` and ``h``: logistic gradient and hessian of each row as whole numbers."""
    chance = 1 / (1 + F.exp(-(F.col("margin") if margin is None else margin)))
    unit = lambda c: F.round(c * UNIT).cast("long")
    return rows.withColumn("_chance", chance).withColumns(
        {"g": unit(F.col("w") * (F.col("_chance") - F.col("y"))), "h": unit(F.col("w") * F.col("_chance") * (1 - F.col("_chance")))}
    )


def level_histogram(rows: DataFrame, columns: list[int], numbers: int) -> DataFrame:
    """Rows and sums of ``g`` and ``h`` by (node, column, bin or category); every row counts once per column."""
    def added(batches):
        of_bins = _Sums([i for i in columns if i < numbers], 0, pa.int32())
        of_categories = _Sums([i for i in columns if i >= numbers], numbers, pa.string())
        for batch in batches:
            if not batch.num_rows:
                continue
            node, g, h = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "g", "h"))
            of_bins.add(node, g, h, batch.column("bins").flatten())
            of_categories.add(node, g, h, batch.column("categories").flatten())
            for sums in (of_bins, of_categories):
                if sums.cells > _CELLS:
                    yield sums.emptied()
        yield of_bins.emptied()
        yield of_categories.emptied()

    return _summed(rows.select("node", "g", "h", "bins", "categories").mapInArrow(added, _CELL_SCHEMA))


_CELL_SCHEMA = "node int, feature int, bin int, category string, n long, g long, h long"


def _summed(cells: DataFrame) -> DataFrame:
    """The tasks' sums added up."""
    return cells.groupBy("node", "feature", "bin", "category").agg(*[F.sum(c).alias(c) for c in ("n", "g", "h")])


class _Sums:
    """One task's sums of some columns: cells by (node, column, value), the values being numbered as they are met."""

    def __init__(self, columns: list[int], first: int, kind: pa.DataType):
        self.columns, self.first, self.kind = columns, first, kind
        self._clear()

    def _clear(self) -> None:
        self.nodes: dict[int, int] = {}
        self.values: dict = {}
        self.sums = np.zeros((3, 0, len(self.columns), 0), dtype=np.int64)

    @property
    def cells(self) -> int:
        return self.sums[0].size

    def add(self, node: np.ndarray, g: np.ndarray, h: np.ndarray, cells: pa.Array) -> None:
        """Rows of a batch, with the cells of all columns of its kind one after the other."""
        if not self.columns:
            return
        met = cells.dictionary_encode(null_encoding="encode")
        codes = met.indices.to_numpy(zero_copy_only=False).reshape(len(node), -1).T
        self.add_coded(node, g, h, met.dictionary.to_pylist(), codes)

    def add_coded(self, node: np.ndarray, g: np.ndarray, h: np.ndarray, values: list, codes: np.ndarray) -> None:
        """The same, with a line of places in ``values`` for each column."""
        if not self.columns:
            return
        number_of = np.array([self.values.setdefault(v, len(self.values)) for v in values], dtype=np.intp)
        as_met = np.array_equal(number_of, np.arange(len(values)))
        own = np.flatnonzero(np.bincount(node))
        place_of = np.zeros(own[-1] + 1, dtype=np.intp)
        place_of[own] = [self.nodes.setdefault(int(v), len(self.nodes)) for v in own]
        shape = (3, _room(len(self.nodes)), len(self.columns), _room(len(self.values)))
        if shape != self.sums.shape:
            self.sums = np.pad(self.sums, [(0, b - a) for a, b in zip(self.sums.shape, shape)])
        start = place_of[node] * shape[3]
        weights = [_exact(g), _exact(h)]
        for k, column in enumerate(self.columns):
            code = codes[column - self.first]
            cell = start + (code if as_met else number_of[code])
            for sums, weight in zip(self.sums, (None, *weights)):
                sums[:, k] += _counted(cell, weight, shape[1] * shape[3]).reshape(shape[1], shape[3])

    def emptied(self) -> pa.RecordBatch:
        nodes, values = np.array([*self.nodes, 0], dtype=np.int32), [*self.values]
        node, column, value = np.nonzero(self.sums[0])
        found = self.sums[:, node, column, value]
        own = pa.array(values, self.kind).take(pa.array(value))
        if pa.types.is_string(self.kind):
            bins, category = pa.array(np.zeros(len(value), dtype=np.int32)), own
        else:
            bins, category = own, pa.nulls(len(value), pa.string())
        feature = np.array([*self.columns, 0], dtype=np.int32)[column]
        self._clear()
        fields = ["node", "feature", "bin", "category", "n", "g", "h"]
        return pa.RecordBatch.from_arrays([pa.array(nodes[node]), pa.array(feature), bins, category, *map(pa.array, found)], fields)


def _room(needed: int) -> int:
    """The next power of two, so that sums rarely move."""
    return 1 << max(0, needed - 1).bit_length()


def _exact(weight: np.ndarray) -> np.ndarray:
    """Whole numbers as doubles where these hold every sum of them, that is below 2^53."""
    return weight.astype(np.float64) if float(np.abs(weight).max()) * len(weight) < 2**53 else weight


def _counted(cell: np.ndarray, weight: np.ndarray | None, cells: int) -> np.ndarray:
    """Whole-number sums by cell."""
    if weight is None:
        return np.bincount(cell, minlength=cells)
    if weight.dtype == np.float64:
        return np.bincount(cell, weights=weight, minlength=cells).astype(np.int64)
    total = np.zeros(cells, dtype=np.int64)
    np.add.at(total, cell, weight)
    return total


def best_splits(histogram: DataFrame, numbers: int, config: BoostConfig) -> DataFrame:
    """The best split of each node, ``gain`` being null where none is allowed, and the node's own sums.

    Ties go to the first column, the lowest bin and the first category; where no row is missing, missing
    cells follow the heavier side.
    """
    column = Window.partitionBy("node", "feature")
    upto = column.orderBy("bin", "category").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of_missing = lambda c: F.coalesce(F.sum(F.when((F.col("feature") < numbers) & (F.col("bin") == _MISSING), F.col(c))).over(column), F.lit(0))
    sums = histogram.withColumns(
        {
            **{f"{c}_all": F.sum(c).over(column) for c in ("g", "h")},
            **{f"{c}_missing": of_missing(c) for c in ("g", "h")},
            **{f"{c}_upto": F.sum(c).over(upto) for c in ("g", "h")},
        }
    )
    is_number = F.col("feature") < numbers

    def side(missing_left: bool) -> Column:
        """Left sums: a number's bins so far, the missing ones (which stand first) in or out; all other categories."""
        away = 0 if missing_left else 1
        left = {c: F.when(is_number, F.col(f"{c}_upto") - away * F.col(f"{c}_missing")).otherwise(F.col(f"{c}_all") - F.col(c)) for c in ("g", "h")}
        return F.struct(left["g"].alias("g"), left["h"].alias("h"), F.lit(missing_left).alias("missing_left"))

    tried = sums.withColumn("left", F.explode(F.array(side(True), side(False))))
    tried = tried.where(is_number | ~F.col("left.missing_left"))
    part = lambda g, h: (g / UNIT) * (g / UNIT) / (h / UNIT + config.penalty)
    gl, hl = F.col("left.g"), F.col("left.h")
    gr, hr = F.col("g_all") - gl, F.col("h_all") - hl
    gain = part(gl, hl) + part(gr, hr) - part(F.col("g_all"), F.col("h_all"))
    least = config.least_weight * UNIT
    allowed = (hl >= least) & (hr >= least) & (~is_number | (F.col("bin") > _MISSING))
    heavier = F.col("left.missing_left") == (hl >= hr)
    fields = {"gain": F.when(allowed, gain), "left_g": gl, "left_h": hl, "missing_left": F.col("left.missing_left")}
    facts = tried.select("node", "feature", "bin", "category", "g_all", "h_all", *[c.alias(k) for k, c in fields.items()], heavier.alias("heavier"))
    # Of equal gains the smallest of the rest: min over what would be sorted.
    order = F.struct(-F.col("gain"), "feature", "bin", F.col("category").isNotNull(), "category", ~F.col("heavier"))
    found = F.min_by(F.struct("gain", "feature", "bin", "category", "left_g", "left_h", "missing_left"), F.when(F.col("gain").isNotNull(), order))
    return facts.groupBy("node").agg(found.alias("best"), F.first("g_all").alias("g"), F.first("h_all").alias("h"))


def went_left(node: Node, value: Column) -> Column:
    """Whether a row goes to node 2i; never NULL."""
    if node.is_number:
        return F.coalesce(value <= node.threshold, F.lit(node.missing_left))
    return ~value.eqNullSafe(F.lit(node.category))


def tree_value(nodes: dict[int, Node], value, at: int = 1) -> Column:
    """A tree as one expression; ``value`` gives the column that a split tests."""
    node = nodes[at]
    if node.column_name is None:
        return F.lit(node.value)
    return F.when(went_left(node, value(node)), tree_value(nodes, value, 2 * at)).otherwise(tree_value(nodes, value, 2 * at + 1))


@dataclass(frozen=True)
class _Layout:
    """What tasks need to read a block: its columns, the type of its bins, and the trees' settings."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    bins: str
    ratio: float = 1.0
    row_fraction: float = 1.0


def _code_type(most: int) -> str:
    return "u1" if most < 1 << 8 else "u2" if most < 1 << 16 else "u4"


def _blocks(df: DataFrame, cuts: dict[str, list[float]], label: str, seed: int, layout: _Layout) -> DataFrame:
    """The rows of ``binned`` as blocks, one per Arrow batch; their ``key`` is hashed as a tree's draw begins with it."""
    numeric, categorical = layout.numeric, layout.categorical
    own_cuts = [np.array(cuts[c], dtype=np.float64) for c in numeric]

    def packed(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cells = [batch.column(2 + i) for i in range(len(numeric) + len(categorical))]
            bins = np.zeros((len(numeric), n), dtype=layout.bins)
            for own, cell, upto in zip(bins, cells, own_cuts):
                known = cell.is_valid().to_numpy(zero_copy_only=False)
                own[:] = np.where(known, np.searchsorted(upto, cell.to_numpy(zero_copy_only=False)) - _MISSING, 0)
            found = [cell.dictionary_encode(null_encoding="encode") for cell in cells[len(numeric) :]]
            met = [f.dictionary.to_pylist() for f in found]
            values = sorted(set().union(*met), key=lambda v: (v is not None, v or ""))
            place = {v: i for i, v in enumerate(values)}
            codes = np.zeros((len(categorical), n), dtype=_code_type(len(values)))
            for own, f, texts in zip(codes, found, met):
                own[:] = np.array([place[v] for v in texts])[f.indices.to_numpy(zero_copy_only=False)]
            y, hashed = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "hash"))
            columns = [y, np.zeros(n), hashed, bins, codes]
            facts = [[n], [int((y == 0).sum())], [int((y == 1).sum())], *[[c.tobytes()] for c in columns], [values]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5, pa.list_(pa.string())]
            names = ["n", "negatives", "positives", "y", "margin", "hash", "bins", "codes", "categories"]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(facts, kinds)], names)

    # The columns that ``binned`` hashes to its key.
    rows = df.select(*numeric, *categorical, label).where(F.col(label).isNotNull())
    hashed = F.xxhash64(F.xxhash64(F.lit(seed), *rows.columns))
    numbers = [number(c).alias(f"number_{i}") for i, c in enumerate(numeric)]
    texts = [F.col(c).cast("string").alias(f"text_{i}") for i, c in enumerate(categorical)]
    return rows.select(F.col(label).cast("double").alias("y"), hashed.alias("hash"), *numbers, *texts).mapInArrow(packed, BLOCK_SCHEMA)


class _Block:
    """The rows of one block as arrays."""

    def __init__(self, batch: pa.RecordBatch, i: int, layout: _Layout):
        cell = lambda c: batch.column(c)[i].as_py()
        read = lambda c, kind: np.frombuffer(batch.column(c)[i].as_buffer(), dtype=kind)
        self.layout, self.n = layout, cell("n")
        self.y, self.margin, self.hash = read("y", "f8"), read("margin", "f8"), read("hash", "u8")
        self.bins = read("bins", layout.bins).reshape(len(layout.numeric), self.n)
        self.categories = cell("categories")
        self.codes = read("codes", _code_type(len(self.categories))).reshape(len(layout.categorical), self.n)

    def went_left(self, node: Node) -> np.ndarray:
        """As the function of this name, on bins."""
        if node.is_number:
            bins = self.bins[self.layout.numeric.index(node.column_name)]
            left = bins <= int(node.threshold) - _MISSING
            return left if node.missing_left else left & (bins > 0)
        codes = self.codes[self.layout.categorical.index(node.column_name)]
        if node.category not in self.categories:
            return np.ones(self.n, dtype=bool)
        return codes != self.categories.index(node.category)

    def placed(self, nodes: dict[int, Node]) -> np.ndarray:
        """The number of the node that each row is in."""
        kind = np.int16 if 2 * max(nodes, default=1) + 1 < 1 << 15 else np.int64
        at = np.ones(self.n, dtype=kind)
        for i in sorted(nodes):  # a node comes before its children
            if nodes[i].column_name is not None:
                step = np.subtract(kind(i + 1), self.went_left(nodes[i]), dtype=kind)  # to 2i or 2i + 1
                step *= at == i
                at += step
        return at

    def margins(self, trees: list[dict[int, Node]]) -> np.ndarray:
        """With the values of some trees, added one after the other."""
        margin = self.margin
        for nodes in trees:
            values = np.zeros(max(nodes) + 1)
            values[list(nodes)] = [n.value for n in nodes.values()]
            margin = margin + values[self.placed(nodes)]
        return margin

    def drawn(self, tree: int) -> np.ndarray:
        """Rows of a tree's sample: the last bits of ``xxhash64(key, tree)`` as Spark has it, continued from that of the key."""
        return (_hashed_int(tree, self.hash) & np.uint64(_DRAWN)) < np.uint64(int(self.layout.row_fraction * (_DRAWN + 1)))

    def gradients(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As the function of this name."""
        weight = np.where(self.y == 1, self.layout.ratio, 1.0)
        with np.errstate(over="ignore"):
            chance = 1 / (1 + np.exp(-margin))
        return _units(weight * (chance - self.y)), _units(weight * chance * (1 - chance))


def _units(value: np.ndarray) -> np.ndarray:
    """Whole numbers, halves away from zero as ``round`` has them."""
    value = value * UNIT
    whole = np.trunc(value)
    return (whole + np.copysign(np.abs(value - whole) >= 0.5, value)).astype(np.int64)


def _hashed_int(value: int, seed: np.ndarray) -> np.ndarray:
    """``xxhash64`` of one int column, for hashes of the columns before it."""
    p2, p3, p5 = (np.uint64(p) for p in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = (seed + p5 + np.uint64(4)) ^ np.uint64(value * 0x9E3779B185EBCA87 % (1 << 64))
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * p2 + p3
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def _unpacked(batches, layout: _Layout):
    for batch in batches:
        for i in range(batch.num_rows):
            yield _Block(batch, i, layout)


def _level(blocks: DataFrame, layout: _Layout, columns: list[int], tree: int, waiting: list[dict], nodes: dict) -> DataFrame:
    """``level_histogram`` of a tree's rows in its open nodes."""
    numbers = len(layout.numeric)

    def added(batches):
        of_bins = _Sums([i for i in columns if i < numbers], 0, pa.int32())
        of_categories = _Sums([i for i in columns if i >= numbers], numbers, pa.string())
        done = [i for i, n in nodes.items() if n.column_name is None]
        for block in _unpacked(batches, layout):
            node = block.placed(nodes)
            left_out = ~block.drawn(tree)
            if done:
                left_out |= np.isin(node, done)
            node[left_out] = 0
            g, h = block.gradients(block.margins(waiting))
            if numbers:
                of_bins.add_coded(node, g, h, list(range(_MISSING, int(block.bins.max()))), block.bins)
            of_categories.add_coded(node, g, h, block.categories, block.codes)
            for sums in (of_bins, of_categories):
                if sums.cells > _CELLS:
                    yield sums.emptied()
        yield of_bins.emptied()
        yield of_categories.emptied()

    return _summed(blocks.drop("negatives", "positives").mapInArrow(added, _CELL_SCHEMA).where("node > 0"))


def _moved_on(blocks: DataFrame, layout: _Layout, trees: list[dict]) -> DataFrame:
    """The blocks with these trees in their margins."""
    def moved(batches):
        for batch in batches:
            margins = [block.margins(trees).tobytes() for block in _unpacked([batch], layout)]
            yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(margins, pa.binary()))

    return blocks.mapInArrow(moved, BLOCK_SCHEMA)


def fit_boosted(
    df: DataFrame,
    numeric: list[str],
    categorical: list[str],
    label: str = TARGET,
    config: BoostConfig = BoostConfig(),
    cuts: dict[str, list[float]] | None = None,
) -> BoostedModel:
    """Trees on the labelled rows, positives weighted by negatives / positives.

    A column that holds no number, or one value, is never split by value, but may be by being missing.
    Without rows of both classes the trees are single leaves. ``cuts`` overrides the quantiles.
    """
    require_columns(df, [*numeric, *categorical, label])
    spark = df.sparkSession
    cuts = cuts if cuts is not None else quantile_cuts(df.where(F.col(label).isNotNull()), numeric, config.bins)
    layout = _Layout(tuple(numeric), tuple(categorical), _code_type(2 + max(map(len, cuts.values()), default=0)))
    rows = _written(_blocks(df, cuts, label, config.seed, layout), spark)
    # The class weight, from the labels' counts that the blocks carry, so that it takes no pass over the input.
    ratio = rows.agg(F.try_divide(F.sum("negatives"), F.sum("positives"))).first()[0] or 1.0
    layout = replace(layout, ratio=float(ratio), row_fraction=config.row_fraction)
    names = [*numeric, *categorical]
    draw = random.Random(config.seed)
    trees: list[tuple[Node, ...]] = []
    waiting: list[dict[int, Node]] = []

    for t in range(config.trees):
        columns = sorted(draw.sample(range(len(names)), max(1, round(config.column_fraction * len(names)))))
        nodes: dict[int, Node] = {}  # thresholds as bins while the trees are fitted
        sums: dict[int, tuple[int, int]] = {}
        for depth in range(config.depth):
            if depth and not any(n.column_name for n in nodes.values() if n.node >= 1 << (depth - 1)):
                break
            level = _level(rows, layout, columns, t, waiting, nodes)
            for r in best_splits(level, len(numeric), config).collect():
                best = r["best"]
                nodes[r["node"]] = _node(t, r["node"], best, r["g"], r["h"], names, len(numeric), config)
                if nodes[r["node"]].column_name:
                    sums[2 * r["node"]] = (best["left_g"], best["left_h"])
                    sums[2 * r["node"] + 1] = (r["g"] - best["left_g"], r["h"] - best["left_h"])
        if not nodes:  # no rows at all
            nodes[1] = _node(t, 1, None, 0, 0, names, len(numeric), config)
        for i, (g, h) in sums.items():
            if i not in nodes:
                nodes[i] = _node(t, i, None, g, h, names, len(numeric), config)
        waiting.append(nodes)
        trees.append(tuple(_real(n, cuts) for _, n in sorted(nodes.items())))
        if len(waiting) == config.written_every and t + 1 < config.trees:
            rows, waiting = _written(_moved_on(rows, layout, waiting), spark), []
    return BoostedModel(tuple(numeric), tuple(categorical), tuple(trees))


def _node(tree, number_, best, g, h, names, numbers, config: BoostConfig) -> Node:
    value = -config.learning_rate * (g / UNIT) / (h / UNIT + config.penalty)
    if best is None or best["gain"] is None or best["gain"] <= config.least_gain:
        return Node(tree, number_, None, None, None, False, False, value, 0.0, h / UNIT)
    is_number = best["feature"] < numbers
    threshold = float(best["bin"]) if is_number else None
    return Node(tree, number_, names[best["feature"]], threshold, best["category"], is_number, best["missing_left"], value, best["gain"], h / UNIT)


def _real(node: Node, cuts: dict[str, list[float]]) -> Node:
    """A bin as the value at its upper end; beyond the last cut only missing cells go right."""
    if not node.is_number or node.column_name is None:
        return node
    own = cuts[node.column_name]
    at = int(node.threshold)
    return Node(**{**node.__dict__, "threshold": own[at] if at < len(own) else float("inf")})


def _written(df: DataFrame, spark: SparkSession) -> DataFrame:
    """The blocks as a table, in row groups small enough for a task to hold some."""
    path = run_folder(spark, "boosting")
    df.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def train_boosted(df: DataFrame, config: BoostConfig = BoostConfig(), cuts: dict[str, list[float]] | None = None) -> BoostedModel:
    """As ``fit_boosted``, on the feature columns of the transaction schema."""
    require_columns(df, [*DROP_COLUMNS, TARGET])
    categorical, numeric = column_roles(df, (*DROP_COLUMNS, TARGET, *TAG_COLUMNS))
    return fit_boosted(df, numeric, categorical, config=config, cuts=cuts)


def first_level(df: DataFrame, numeric: list[str], categorical: list[str], label: str, cuts: dict[str, list[float]]) -> DataFrame:
    """The histogram behind the first split of all: (node, feature, bin, category, n, g, h), ``feature`` being a position."""
    ratio = class_weight(df, label).select(F.coalesce("scale_pos_weight", F.lit(1.0))).scalar()
    weight = F.when(F.col(label) == 1, ratio).otherwise(F.lit(1.0))
    rows = gradients(binned(df.select(*numeric, *categorical, label), cuts, categorical, label, weight, 0)).withColumn("node", F.lit(1))
    return level_histogram(rows, list(range(len(numeric) + len(categorical))), len(numeric))


def boosted_margin(model: BoostedModel) -> Column:
    """Log-odds. The trees stand in one array, which code generation takes apart into methods of their own."""
    value = lambda n: number(n.column_name) if n.is_number else F.col(n.column_name).cast("string")
    trees = [tree_value({n.node: n for n in nodes}, value) for nodes in model.trees]
    return F.aggregate(F.array(F.lit(0.0), *trees), F.lit(0.0), lambda a, v: a + v)


def score_boosted(model: BoostedModel, df: DataFrame, name: str = "score") -> DataFrame:
    """Probability of class 1 as a new column."""
    require_columns(df, [*model.numeric, *model.categorical])
    return df.withColumn(name, 1 / (1 + F.exp(-boosted_margin(model))))


def model_nodes(spark: SparkSession, model: BoostedModel) -> DataFrame:
    """The model as a table, one row per node."""
    return spark.createDataFrame([tuple(n.__dict__.values()) for nodes in model.trees for n in nodes], NODE_SCHEMA)


def save_boosted(spark: SparkSession, model: BoostedModel, path: str) -> None:
    columns = F.array(*[F.lit(c) for c in model.numeric]), F.array(*[F.lit(c) for c in model.categorical])
    named = model_nodes(spark, model).withColumns({"numeric": columns[0].cast("array<string>"), "categorical": columns[1].cast("array<string>")})
    named.coalesce(1).write.mode("overwrite").parquet(path)


def load_boosted(spark: SparkSession, path: str) -> BoostedModel:
    rows = spark.read.parquet(path).orderBy("tree", "node").collect()
    trees: dict[int, list[Node]] = {}
    for r in rows:
        trees.setdefault(r["tree"], []).append(Node(*[r[c] for c in Node.__dataclass_fields__]))
    return BoostedModel(tuple(rows[0]["numeric"]), tuple(rows[0]["categorical"]), tuple(map(tuple, trees.values())))
