"""Tree ensembles from histograms: second-order boosting with the pseudo-Huber loss, and random forests.

All windows and, in a forest, all trees grow together, level by level: one pass over the binned rows of `histograms` gives the
sums of slope and curvature by node, feature and bin, and the driver picks the splits. A window is the last year it trains on;
windows share their cut points, so that a year's bins are computed once.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.operators import histograms as hg
from panelloom.sources.shipping import ship
from panelloom.sources.storage import delete, scratch_path

#: Boosting stores the running score after so many trees.
STORE_EVERY = 10
#: A split has to gain more than this.
LEAST_GAIN = 1e-6
#: Gains that differ by less than this share are equal: the first feature and the lowest cut win.
SAME = 1e-9


@dataclass(frozen=True)
class BoostSettings:
    # The published model settings.
    trees: int = 100
    depth: int = 2
    rate: float = 0.03
    row_share: float = 0.7
    column_share: float = 0.7
    min_child_weight: float = 500
    shrinkage: float = 10.0
    bins: int = 32
    seed: int = 42


@dataclass(frozen=True)
class ForestSettings:
    # The published model settings. A node sees column_share * node_share of the columns.
    trees: int = 200
    depth: int = 3
    row_share: float = 0.7
    column_share: float = 0.7
    node_share: float = 0.2
    min_child_weight: float = 500
    bins: int = 32
    shrinkage: float = 10.0
    seed: int = 42


# -- a fitted tree as columns --------------------------------------------------------------

#: A leaf's number, or column, threshold, and the nodes for values up to it and above it.
Node = int | tuple[str, float, "Node", "Node"]


def choose(node: Node, values: list[float]) -> Column:
    """The value of the leaf that a row falls into."""
    if isinstance(node, int):
        return F.lit(values[node])
    column, threshold, left, right = node
    return F.when(F.col(f"`{column}`") <= threshold, choose(left, values)).otherwise(choose(right, values))


@dataclass
class Tree:
    """Nested nodes; leaves are numbered from left to right."""

    root: Node
    values: list[float]

    def score(self) -> Column:
        return choose(self.root, self.values)

    def lines(self) -> list[tuple[int, str | None, float | None, float | None]]:
        """(node, column, threshold, value) of every node; the children of node n are 2n and 2n + 1, the root is 1."""
        found = []

        def walk(node: Node, number: int) -> None:
            if isinstance(node, int):
                found.append((number, None, None, float(self.values[node])))
            else:
                found.append((number, node[0], float(node[1]), None))
                walk(node[2], 2 * number)
                walk(node[3], 2 * number + 1)

        walk(self.root, 1)
        return found


@dataclass
class BoostedTrees:
    base: float
    trees: list[Tree]


@dataclass
class Forest:
    """The mean of its trees over the base value; leaves are shrunk towards the base."""

    base: float
    trees: list[Tree]


def model_table(spark: SparkSession, models: dict[int, BoostedTrees | Forest]) -> DataFrame:
    """Fitted models by a number (the test year) as rows: model, tree, node, feature, threshold, value. Node 0 has the base value."""
    rows = [(int(n), -1, 0, None, None, float(m.base)) for n, m in models.items()]
    rows += [(int(n), k, *line) for n, m in models.items() for k, tree in enumerate(m.trees) for line in tree.lines()]
    return spark.createDataFrame(rows, "model bigint, tree bigint, node bigint, feature string, threshold double, value double")


def with_score(df: DataFrame, base: float | Column, trees: list[Tree], name: str, compiled: int = 10) -> DataFrame:
    """Adds `name`: the base plus a leaf of every tree. Up to `compiled` trees are column expressions; a sum over more
    is too large to be compiled with its stage and is taken in numpy, over Arrow batches of the columns that the trees split on."""
    start = base if isinstance(base, Column) else F.lit(float(base))
    columns = sorted({line[1] for tree in trees for line in tree.lines() if line[1] is not None})
    if len(trees) > compiled and columns:
        ship(df.sparkSession)
        values = F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
        return df.withColumn(name, start + F.arrow_udf(_adder(trees, columns), "double")(values))
    for tree in trees:
        start = start + tree.score()
    return df.withColumn(name, start)


def _adder(trees: list[Tree], columns: list[str]):
    """The sum of the trees' leaves for lists of the values of `columns`."""
    place = {c: i for i, c in enumerate(columns)}
    lines = [tree.lines() for tree in trees]
    size = 1 + max(number for own in lines for number, *_ in own)
    feature, threshold, value = (np.zeros((len(trees), size), t) for t in (np.int64, float, float))
    feature -= 1
    for k, own in enumerate(lines):
        for number, column, cut, leaf in own:
            feature[k, number], threshold[k, number], value[k, number] = (-1, 0, leaf) if column is None else (place[column], cut, 0)
    levels = size.bit_length() - 1

    def add(values: pa.Array) -> pa.Array:
        x = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), len(columns))
        total, row = np.zeros(len(x)), np.arange(len(x))
        for k in range(len(trees)):
            node = np.ones(len(x), np.int64)
            for _ in range(levels):
                at = feature[k][node]
                left = x[row, at] <= threshold[k][node]
                node = np.where(at >= 0, 2 * node + ~left, node)
            total += value[k][node]
        return pa.array(total)

    add.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return add


# -- a tree that grows ---------------------------------------------------------------------

@dataclass
class Growing:
    """Splits by node (the children of node n are 2n and 2n + 1): a feature's number, -1 for none, and the last bin that goes left."""

    depth: int
    feature: np.ndarray = field(init=False)
    last: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)
    sums: dict[int, tuple[float, float]] = field(default_factory=dict)

    def __post_init__(self):
        size = 2 << self.depth
        self.feature, self.last, self.value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)

    def node_of(self, x: np.ndarray, levels: int) -> np.ndarray:
        """Nodes of the rows of bins `x` (feature, row): a few comparisons of whole lines of bytes for each split."""
        node = np.ones(x.shape[1], np.uint8 if levels < 8 else np.int64)
        for parent in range(1, 1 << levels):
            c = self.feature[parent]
            if c >= 0:
                child = np.add(2 * parent, x[c] > int(self.last[parent]), dtype=node.dtype)
                node = child if parent == 1 else np.where(node == parent, child, node)
        return node

    def split(self, node: int, one: np.ndarray, two: np.ndarray, columns: list[int], cuts: list[np.ndarray], shrinkage: float, least: float) -> None:
        """Splits `node` where that gains most; its sums by feature and bin say what the children hold."""
        left, weight = one.cumsum(axis=1), two.cumsum(axis=1)
        total, whole = left[:, -1:], weight[:, -1:]
        self.sums.setdefault(node, (float(total[0, 0]), float(whole[0, 0])))
        right, rest = total - left, whole - weight
        usable = (weight >= least) & (rest >= least) & (np.arange(left.shape[1]) < np.array([len(cuts[c]) for c in columns])[:, None])
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left ** 2 / (weight + shrinkage) + right ** 2 / (rest + shrinkage) - total ** 2 / (whole + shrinkage)
        gain = np.where(usable, gain, -np.inf)
        most = gain.max(initial=-np.inf)
        if not most > LEAST_GAIN:
            return
        row, cut = np.argwhere(gain >= most * (1 - SAME))[0]
        self.feature[node], self.last[node] = columns[row], cut
        self.sums[2 * node] = (float(left[row, cut]), float(weight[row, cut]))
        self.sums[2 * node + 1] = (float(right[row, cut]), float(rest[row, cut]))

    def open(self, level: int) -> list[int]:
        """Nodes of a level that may be split: the root, and below it the children of split nodes."""
        return [1] if level == 0 else [n for n in range(1 << level, 2 << level) if self.feature[n // 2] >= 0]

    def tree(self, features: list[str], cuts: list[np.ndarray]) -> Tree:
        values: list[float] = []

        def read(node: int) -> Node:
            c = self.feature[node]
            if c < 0:
                values.append(float(self.value[node]))
                return len(values) - 1
            return (features[c], float(cuts[c][self.last[node]]), read(2 * node), read(2 * node + 1))

        return Tree(read(1), values)


def _cuts(table: DataFrame, features: list[str], bins: int, given: dict[str, np.ndarray] | None, year: Column, first: int) -> list[np.ndarray]:
    """Cut points common to all windows; those not given are sketched over the years that every window trains on."""
    given = given or {}
    others = [c for c in features if c not in given]
    found = hg.sketched_cuts(table.filter(year <= first), others, bins) if others else {}
    return [np.asarray(given[c] if c in given else found[c], float) for c in features]


def _yearly(rows: DataFrame, ends: list[int], *sums: Column) -> list[tuple]:
    """For each window the number of its rows and their sums, added up from those of the years."""
    lines = rows.groupBy("year").agg(F.count(F.lit(1)).alias("n"), *[s.alias(f"s{i}") for i, s in enumerate(sums)]).collect()
    found = []
    for end in ends:
        own = [r for r in lines if r["year"] <= end]
        if not own:
            raise ValueError(f"No usable training rows up to {end}")
        found.append((sum(r["n"] for r in own), *(sum(r[f"s{i}"] for r in own) for i in range(len(sums)))))
    return found


def _drawn_columns(seed: int, tree: int, count: int, share: float) -> list[int]:
    return sorted(random.Random(f"{seed} {tree}").sample(range(count), max(1, int(share * count))))


def node_columns(seed: int, tree: int, node: int, columns: list[int], share: float) -> list[int]:
    """The columns a node may split on, drawn from those of its tree."""
    return sorted(random.Random(f"{seed} {tree} {node}").sample(columns, max(1, int(share * len(columns)))))


# -- boosting ------------------------------------------------------------------------------

def fit_boosted_windows(table: DataFrame, features: list[str], ends: list[int], settings: BoostSettings = BoostSettings(), y: str = "y",
                        key: list[str] = ("permno", "month_id"), year: str | None = "target_year", cuts: dict[str, np.ndarray] | None = None) -> list[BoostedTrees]:
    """A model for each last training year in `ends`, all fitted in the same passes: one for each level of each tree.

    Split gain and leaves are those of second-order boosting: slope sums squared over curvature sums plus shrinkage, children of at least
    min_child_weight curvature. `cuts` gives bin ends by feature; others are sketched over the earliest window's rows.
    The bins are stored with each window's running score, which is stored anew every few trees; the copy before is deleted.
    """
    when = F.lit(0) if year is None else F.col(year)
    table = table.filter(when <= max(ends))
    ends_of = _cuts(table, features, settings.bins, cuts, when, min(ends))
    spark, path = table.sparkSession, scratch_path(table.sparkSession, "boosting")
    hg.binned(table, features, ends_of, y, key, when).write.parquet(path)
    rows = spark.read.parquet(path)
    root = F.sqrt(1 + F.col("y") * F.col("y"))
    sums = _yearly(rows, ends, F.sum(F.col("y") / root), F.sum(F.pow(root, F.lit(-3))))
    bases = [s / h for _, s, h in sums]
    rows = rows.withColumn("score", F.array(*[F.lit(float(b)) for b in bases]))
    models = [BoostedTrees(b, []) for b in bases]
    tasks = rows.rdd.getNumPartitions()
    since: list[list[Growing]] = [[] for _ in ends]
    for turn in range(settings.trees):
        if len(since[0]) >= STORE_EVERY:
            fresh = scratch_path(spark, "boosting")
            _rescored(rows, since, len(features)).write.parquet(fresh)
            delete(spark, path)
            path, rows, since = fresh, spark.read.parquet(fresh), [[] for _ in ends]
            tasks = rows.rdd.getNumPartitions()
        columns = _drawn_columns(settings.seed, turn, len(features), settings.column_share)
        growing = [Growing(settings.depth) for _ in ends]
        for level in range(settings.depth):
            if any(g.open(level) for g in growing):
                _boost_level(rows, tasks, since, growing, level, ends, columns, ends_of, settings, turn)
        for w, grown in enumerate(growing):
            for node, (slope, curvature) in grown.sums.items():
                grown.value[node] = -settings.rate * slope / (curvature + settings.shrinkage)
            since[w].append(grown)
            models[w].trees.append(grown.tree(features, ends_of))
    delete(spark, path)
    return models


def _scores(stored: np.ndarray, x: np.ndarray, since: list[Growing]) -> np.ndarray:
    """The stored score and the leaves of the trees since."""
    score = stored.copy()
    for grown in since:
        score += grown.value.take(grown.node_of(x, grown.depth))
    return score


def _stored(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _rescored(rows: DataFrame, since: list[list[Growing]], width: int) -> DataFrame:
    def each(batches):
        for batch in batches:
            x, stored = hg.matrix(batch.column(3), width), _stored(batch)
            scores = np.stack([_scores(stored[:, w], x, since[w]) for w in range(len(since))], axis=1)
            lists = pa.ListArray.from_arrays(np.arange(0, scores.size + 1, len(since), np.int32), scores.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], lists], batch.schema.names)

    return rows.select("year", "draw", "y", "x", "score").mapInArrow(each, rows.schema)


def _boost_level(rows, tasks, since, growing, level, ends, columns, cuts, settings, turn) -> None:
    """One pass: slope and curvature sums for the open nodes of all windows, and their splits."""
    width, size, nodes = len(cuts), len(columns) * settings.bins, 1 << level
    used = [sorted({*columns, *(int(c) for grown in [*since[w], growing[w]] for c in grown.feature if c >= 0)}) for w in range(len(ends))]

    def add(batch: pa.RecordBatch, sums: hg.Sums) -> None:
        year, draw, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        taken = np.flatnonzero(hg.drawn(draw, settings.seed + turn, settings.row_share))
        x, year, y, stored = hg.matrix(batch.column(3), width).take(taken, axis=1), year[taken], y[taken], _stored(batch)[taken]
        for w, end in enumerate(ends):
            own = np.flatnonzero(year <= end)
            if not len(own) or not growing[w].open(level):
                continue
            mine = np.empty((width, len(own)), np.uint8)
            for c in used[w]:
                mine[c] = x[c].take(own, mode="clip")
            error = _scores(stored[own, w], mine, since[w]) - y[own]
            square = 1 + error * error
            root = np.sqrt(square)
            slope, curvature = error / root, 1 / (square * root)
            node = growing[w].node_of(mine, level)
            mine = mine[columns]
            for n in growing[w].open(level):
                at = np.flatnonzero(node == n)
                part = (mine, slope, curvature) if len(at) == len(own) else (mine.take(at, axis=1), slope[at], curvature[at])
                sums.add((w * nodes + n - nodes) * size, *part)

    one, two = hg.gather(rows.select("year", "draw", "y", "x", "score"), len(ends) * nodes * size, settings.bins, add, tasks)
    one, two = (a.reshape(len(ends), nodes, len(columns), settings.bins) for a in (one, two))
    for w, grown in enumerate(growing):
        for n in grown.open(level):
            grown.split(n, one[w, n - nodes], two[w, n - nodes], columns, cuts, settings.shrinkage, settings.min_child_weight)


def fit_boosted_trees(train: DataFrame, features: list[str], settings: BoostSettings = BoostSettings(), y: str = "y",
                      key: list[str] = ("permno", "month_id"), cuts: dict[str, np.ndarray] | None = None) -> BoostedTrees:
    """One window: all rows of `train`."""
    return fit_boosted_windows(train, features, [0], settings, y, key, None, cuts)[0]


def predict_boosted(df: DataFrame, model: BoostedTrees, precision: str = "float") -> DataFrame:
    scored = with_score(df, model.base, model.trees, "_score")
    return scored.select(*df.columns, F.col("_score").cast(precision).alias("prediction"))


# -- forest --------------------------------------------------------------------------------

def fit_forest_windows(table: DataFrame, features: list[str], ends: list[int], settings: ForestSettings = ForestSettings(), y: str = "y",
                       key: list[str] = ("permno", "month_id"), year: str | None = "target_year", cuts: dict[str, np.ndarray] | None = None) -> list[Forest]:
    """A forest for each last training year in `ends`. Every tree draws its own rows and columns, every node its own of those.

    The sums are of targets and rows, so that the root's don't depend on the window: they are gathered by the stretch of years
    between two windows' ends and added up. A pass takes as many trees as its sums fit CELLS. Leaves are the base (the
    window's mean) plus the sampled rows' summed differences from it over their number plus shrinkage.
    """
    when = F.lit(0) if year is None else F.col(year)
    table = table.filter(when <= max(ends))
    ends_of = _cuts(table, features, settings.bins, cuts, when, min(ends))
    spark, path = table.sparkSession, scratch_path(table.sparkSession, "forest")
    hg.binned(table, features, ends_of, y, key, when).write.parquet(path)
    rows = spark.read.parquet(path)
    tasks = rows.rdd.getNumPartitions()
    bases = [s / n for n, s in _yearly(rows, ends, F.sum("y"))]
    columns = [_drawn_columns(settings.seed, k, len(features), settings.column_share) for k in range(settings.trees)]
    seen = max(1, int(settings.node_share * len(columns[0]))) if settings.trees else 1
    grown = [[Growing(settings.depth) for _ in ends] for _ in range(settings.trees)]
    for level in range(settings.depth):
        block = len(ends) * (1 << level) * seen * settings.bins
        step = max(1, hg.CELLS // block)
        for first in range(0, settings.trees, step):
            _forest_level(rows, tasks, grown, range(first, min(first + step, settings.trees)), level, ends, columns, ends_of, settings, seen, bases)
    delete(spark, path)
    forests = [Forest(b, []) for b in bases]
    for trees in grown:
        for w, tree in enumerate(trees):
            for node, (slope, count) in tree.sums.items():
                tree.value[node] = bases[w] - slope / (count + settings.shrinkage)
            forests[w].trees.append(tree.tree(features, ends_of))
    return forests


def _forest_level(rows, tasks, grown, group, level, ends, columns, cuts, settings, seen, bases) -> None:
    """One pass: target sums and counts for the open nodes of a group of trees in all windows, and their splits."""
    width, size, nodes, first = len(cuts), seen * settings.bins, 1 << level, group[0]
    drawn_for = {(k, n): node_columns(settings.seed, k, n, columns[k], settings.node_share) for k in group for n in range(nodes, 2 * nodes)}
    order = sorted(ends)

    def add(batch: pa.RecordBatch, sums: hg.Sums) -> None:
        year, draw, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        x = hg.matrix(batch.column(3), width)
        stretch = np.searchsorted(order, year)
        for k in group:
            taken = np.flatnonzero(hg.drawn(draw, settings.seed + k, settings.row_share))
            of, target = stretch[taken], y[taken]
            if level == 0:
                for s in range(len(order)):
                    at = np.flatnonzero(of == s)
                    here = taken[at]
                    bins = np.stack([x[c].take(here, mode="clip") for c in drawn_for[k, 1]])
                    sums.add(((k - first) * len(ends) + s) * size, bins, target[at], None)
                continue
            for w, end in enumerate(ends):
                tree = grown[k][w]
                node = tree.node_of(x, level)[taken]
                inside = of <= order.index(end)
                for n in tree.open(level):
                    at = np.flatnonzero((node == n) & inside)
                    here = taken[at]
                    bins = np.stack([x[c].take(here, mode="clip") for c in drawn_for[k, n]])
                    sums.add((((k - first) * len(ends) + w) * nodes + n - nodes) * size, bins, target[at], None)

    one, two = hg.gather(rows.select("year", "draw", "y", "x"), len(group) * len(ends) * nodes * size, settings.bins, add, tasks)
    one, two = (a.reshape(len(group), len(ends), nodes, seen, settings.bins) for a in (one, two))
    if level == 0:  # stretches of years add up to windows
        place = [order.index(end) for end in ends]
        one, two = (a.cumsum(axis=1)[:, place] for a in (one, two))
    for k in group:
        for w, base in enumerate(bases):
            for n in grown[k][w].open(level):
                total, count = one[k - first, w, n - nodes], two[k - first, w, n - nodes]
                grown[k][w].split(n, base * count - total, count, drawn_for[k, n], cuts, settings.shrinkage, settings.min_child_weight)


def fit_forest(train: DataFrame, features: list[str], settings: ForestSettings = ForestSettings(), y: str = "y",
               key: list[str] = ("permno", "month_id"), cuts: dict[str, np.ndarray] | None = None) -> Forest:
    """One window: all rows of `train`."""
    return fit_forest_windows(train, features, [0], settings, y, key, None, cuts)[0]


def predict_forest(df: DataFrame, model: Forest, features: list[str] | None = None, precision: str = "float") -> DataFrame:
    scored = with_score(df, 0.0, model.trees, "_score")
    return scored.select(*df.columns, (F.col("_score") / len(model.trees)).cast(precision).alias("prediction"))
