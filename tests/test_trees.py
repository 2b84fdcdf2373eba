"""The histogram learner against plain searches in numpy."""

import numpy as np
import pyarrow as pa
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelloom.operators import histograms as hg
from panelloom.operators import trees
from panelloom.plans import walkforward as wf
from panelloom.sources.storage import materialize

X = ["a_rank", "b_rank", "c", "d"]
ENDS = [1996, 1994, 1998]


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(5)
    n = 4000
    frame = pd.DataFrame({"permno": np.arange(n), "month_id": rng.integers(100, 200, n), "target_year": rng.integers(1990, 2001, n),
                          "a_rank": rng.uniform(-1, 1, n), "b_rank": np.round(rng.uniform(-1, 1, n), 1), "c": rng.integers(0, 2, n).astype(float), "d": rng.normal(size=n)})
    frame["y"] = 0.5 * frame.a_rank * (frame.c > 0) - 0.3 * (frame.d > 0.5) + 0.2 * rng.standard_t(3, n)
    frame.loc[::97, "y"] = np.nan
    return frame


@pytest.fixture(scope="module")
def table(spark, sample):
    return materialize(spark.createDataFrame(sample).repartition(5), "sample", ["target_year"])


@pytest.fixture(scope="module")
def cuts(sample):
    return {c: np.unique(np.quantile(sample[c], np.arange(1, 16) / 16)) for c in X}


def draw_of(frame):
    draw = np.zeros(len(frame), np.int64)
    for k in ("permno", "month_id"):
        draw = (draw * 1_000_003 + frame[k].to_numpy()) % hg.PRIME
    return draw


def best_split(x, one, two, columns, cuts, shrinkage, least):
    """Largest gain over every column and cut, the first of equal ones."""
    total, whole = one.sum(), two.sum()
    found = []
    for c in columns:
        for cut in cuts[X[c]]:
            left = x[:, c] <= cut
            a, b = one[left].sum(), two[left].sum()
            if b >= least and whole - b >= least:
                found.append((a * a / (b + shrinkage) + (total - a) ** 2 / (whole - b + shrinkage) - total ** 2 / (whole + shrinkage), c, cut))
    if not found or max(found)[0] <= 1e-6:
        return None
    top = max(f[0] for f in found)
    return next((c, cut) for gain, c, cut in found if gain >= top * (1 - 1e-9))


def grown(x, one, two, columns_of, depth, cuts, shrinkage, least, leaf, node=1):
    """{node: (column, cut)} and {node: leaf value} of a tree grown by plain search."""
    split = best_split(x, one, two, columns_of(node), cuts, shrinkage, least) if node < 1 << depth else None
    if split is None:
        return {node: leaf(one.sum(), two.sum())}
    left = x[:, split[0]] <= split[1]
    out = {node: (X[split[0]], split[1])}
    for side, child in ((left, 2 * node), (~left, 2 * node + 1)):
        out |= grown(x[side], one[side], two[side], columns_of, depth, cuts, shrinkage, least, leaf, child)
    return out


def of_tree(tree):
    return {n: (c, cut) if c else value for n, c, cut, value in tree.lines()}


def agree(got, want):
    assert got.keys() == want.keys()
    for n in want:
        assert got[n] == want[n] if isinstance(want[n], tuple) else got[n] == pytest.approx(want[n], abs=1e-12)


def apply(frame, tree):
    def at(node, row):
        while not isinstance(node, int):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return tree.values[node]
    return np.array([at(tree.root, row) for _, row in frame.iterrows()])


def test_boosting_equals_a_plain_search_in_every_window(sample, table, cuts):
    settings = trees.BoostSettings(trees=3, rate=0.5, min_child_weight=40)
    models = trees.fit_boosted_windows(table, X, ENDS, settings, cuts=cuts)
    for end, model in zip(ENDS, models):
        part = sample[(sample.target_year <= end) & sample.y.notna()]
        y = part.y.to_numpy()
        base = (y / np.sqrt(1 + y * y)).sum() / ((1 + y * y) ** -1.5).sum()
        assert model.base == pytest.approx(base)
        score = np.full(len(part), base)
        for k, tree in enumerate(model.trees):
            taken = hg.drawn(draw_of(part), 42 + k, 0.7)
            assert 0.65 < taken.mean() < 0.75
            error = score - y
            one, two = error / np.sqrt(1 + error ** 2), (1 + error ** 2) ** -1.5
            columns = trees._drawn_columns(42, k, 4, 0.7)
            want = grown(part[X].to_numpy()[taken], one[taken], two[taken], lambda n, c=columns: c, 2, cuts, 10, 40, lambda g, h: -0.5 * g / (h + 10))
            agree(of_tree(tree), want)
            score = score + apply(part, tree)


def test_forest_equals_a_plain_search_in_every_window(sample, table, cuts, monkeypatch):
    settings = trees.ForestSettings(trees=6, node_share=0.7, min_child_weight=60)
    models = trees.fit_forest_windows(table, X, ENDS, settings, cuts=cuts)
    monkeypatch.setattr(hg, "CELLS", 500)  # a tree at a time, and sums added up by the executors
    again = trees.fit_forest_windows(table, X, ENDS, settings, cuts=cuts)
    draws = set()
    for end, model, other in zip(ENDS, models, again):
        part = sample[(sample.target_year <= end) & sample.y.notna()]
        y = part.y.to_numpy()
        assert model.base == pytest.approx(y.mean())
        for k, (tree, twin) in enumerate(zip(model.trees, other.trees)):
            taken = hg.drawn(draw_of(part), 42 + k, 0.7)
            columns = trees._drawn_columns(42, k, 4, 0.7)
            draws.add(tuple(columns))
            own = lambda n, k=k, c=columns: trees.node_columns(42, k, n, c, 0.7)
            want = grown(part[X].to_numpy()[taken], (y.mean() - y)[taken], np.ones(taken.sum()), own, 3, cuts, 10, 60, lambda g, h: y.mean() - g / (h + 10))
            agree(of_tree(tree), want)
            agree(of_tree(twin), want)
    assert len(draws) > 1


def test_windows_together_equal_windows_alone_and_passes_are_shared(table, monkeypatch):
    settings = trees.BoostSettings(trees=4, min_child_weight=30)
    passes = []
    plain = hg.gather
    monkeypatch.setattr(hg, "gather", lambda *a: passes.append(a) or plain(*a))
    given = {c: hg.even_cuts(-1, 1, 32) for c in X}
    together = trees.fit_boosted_windows(table, X, ENDS, settings, cuts=given)
    assert len(passes) == settings.trees * settings.depth
    for end, model in zip(ENDS, together):
        alone, = trees.fit_boosted_windows(table, X, [end], settings, cuts=given)
        assert [t.root for t in alone.trees] == [t.root for t in model.trees]
        for one, two in zip(alone.trees, model.trees):
            assert one.values == pytest.approx(two.values)
    passes.clear()
    trees.fit_forest_windows(table, X, ENDS, trees.ForestSettings(trees=30, min_child_weight=30), cuts=given)
    assert len(passes) == 3  # one for each level of all trees in all windows


def test_sketched_cuts_come_from_years_that_all_windows_train_on(table, sample):
    found = trees._cuts(table, X, 8, None, F.col("target_year"), 1994)
    early = sample[sample.target_year <= 1994]
    for c, ends in zip(X, found):
        places = [(early[c] <= v).mean() for v in ends]
        assert len(ends) <= 7 and (c in ("b_rank", "c") or np.allclose(places, np.arange(1, 8) / 8, atol=0.01))


def test_missing_values_go_right_in_training_and_scoring(spark):
    rows = [(i, 1, 1990, None if i % 2 else float(i % 7), 1.0 if i % 2 else 0.0) for i in range(200)]
    frame = spark.createDataFrame(rows, "permno long, month_id long, target_year int, x double, y double")
    settings = trees.ForestSettings(trees=12, row_share=1.0, column_share=1.0, node_share=1.0, min_child_weight=5, depth=1)
    forest = trees.fit_forest(frame, ["x"], settings)
    got = trees.predict_forest(frame, forest, precision="double").groupBy("y").agg(F.min("prediction").alias("low"), F.max("prediction").alias("high")).collect()
    low, high = sorted(got, key=lambda r: r["y"])
    assert low["high"] < 0.1 and high["low"] > 0.9


def test_many_trees_are_scored_as_few_are(table, sample):
    model, = trees.fit_boosted_windows(table, X, [1996], trees.BoostSettings(trees=15, rate=0.3, min_child_weight=20), cuts={c: hg.even_cuts(-1, 1, 32) for c in X})
    scored = trees.with_score(trees.with_score(table, 0.5, model.trees, "fast"), 0.5, model.trees, "slow", compiled=99)
    assert scored.agg(F.max(F.abs(F.col("fast") - F.col("slow")))).first()[0] < 1e-12
    rows = trees.model_table(table.sparkSession, {1999: model})
    assert rows.filter("node = 0").first()["value"] == pytest.approx(model.base)
    assert rows.filter("feature IS NULL AND tree >= 0").count() == sum(len(t.values) for t in model.trees)


def test_no_usable_rows(table):
    for fit in (trees.fit_boosted_windows, trees.fit_forest_windows):
        with pytest.raises(ValueError, match="No usable training rows"):
            fit(table, X, [1980, 1996], cuts={c: hg.even_cuts(-1, 1, 4) for c in X})


def test_a_changed_panel_is_not_taken_for_the_stored_one(table):
    windows = [(1998, 1995), (2000, 1997)]
    first = wf.fingerprints(table, windows)
    assert first == wf.fingerprints(table.repartition(3), windows)
    late = table.withColumn("y", F.when(F.col("target_year") < 1999, F.col("y")).otherwise(F.col("y") * 2))
    swapped = table.withColumn("y", F.when((F.col("target_year") == 1990) & (F.col("permno") == table.filter("target_year = 1990").first()["permno"]), F.lit(None).cast("double")).otherwise(F.col("y")))
    changed, other = wf.fingerprints(late, windows), wf.fingerprints(swapped, windows)
    assert changed[1998] == first[1998] and changed[2000] != first[2000]
    assert other[1998] != first[1998] and other[2000] != first[2000]


def test_sums_of_two_features_at_a_time_are_those_of_each():
    rng = np.random.default_rng(5)
    for rows, bins in ((5000, 32), (500, 32), (300, 200)):
        x = rng.integers(0, bins, (5, rows)).astype(np.uint8)
        one, two = rng.normal(size=rows), rng.random(rows)
        for weights in (two, None):
            sums = hg.Sums(5 * bins + 7, bins)
            sums.add(7, x, one, weights)
            want = [[np.bincount(c, w, bins) for c in x] for w in (one, weights)]
            assert np.allclose(sums.one[7:].reshape(5, bins), want[0]) and np.allclose(sums.two[7:].reshape(5, bins), want[1])


def test_row_draws_without_a_division():
    draw = np.append(np.random.default_rng(6).integers(0, hg.PRIME, 10_000), [0, 1, hg.PRIME - 1])
    for seed in (0, 42, 241, -3, 10 ** 9):
        mixed = (draw + seed * 7_919_773) % hg.PRIME
        mixed = mixed * mixed % hg.PRIME
        assert np.array_equal(hg.drawn(draw, seed, 0.7), (mixed * 48_271 + 12_345) % hg.PRIME < int(0.7 * hg.PRIME))


def test_a_task_adds_up_many_rows_at_a_time():
    """Arrow hands over 10,000 rows at a time; a numpy call for each node, window and tree should see more."""
    batches = [pa.RecordBatch.from_pydict({"y": np.arange(k, k + 10_000)}) for k in range(0, 100_000, 10_000)]
    joined = list(hg.joined(iter(batches)))
    assert min(b.num_rows for b in joined[:-1]) >= hg.ROWS
    assert np.array_equal(np.concatenate([b.column(0).to_numpy() for b in joined]), np.arange(100_000))


def test_nodes_line_by_line_are_those_of_each_row():
    rng = np.random.default_rng(7)
    x = rng.integers(0, 32, (6, 1000)).astype(np.uint8)
    grown = trees.Growing(3)
    grown.feature[[1, 2, 3, 5, 6]], grown.last[[1, 2, 3, 5, 6]] = [4, 0, 5, 4, 1], [15, 3, 20, 7, 30]
    for levels in range(4):
        want = []
        for row in x.T:
            node = 1
            for _ in range(levels):
                if grown.feature[node] >= 0:
                    node = 2 * node + int(row[grown.feature[node]] > grown.last[node])
            want.append(node)
        assert list(grown.node_of(x, levels)) == want
