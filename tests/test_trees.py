"""Shapley values, interactions, boosting, the Parzen search, folds, Ward linkage and file tracking against plain reckoning."""

import itertools
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.ml import boosting
from chronolith.ml import models as M
from chronolith.ml import trees as TR
from chronolith.ml import tuning
from chronolith.ml.boosting import Params, fit_boosted
from chronolith.ml.trees import Tree, from_spark, interactions, predicted, shapley
from chronolith.operators import graph, splits
from chronolith.plans import catalog
from chronolith.schema import FULL_COMMIT
from chronolith.sources import tracking


@pytest.fixture(scope="module")
def numbers(spark):
    rnd = random.Random(1)
    rows = [(i, *[float(rnd.randrange(8)) for _ in range(6)]) for i in range(300)]
    rows = [(*r, r[1] * 2 + (r[2] > 3) * r[3] - abs(r[4] - 4) + rnd.random()) for r in rows]
    return spark.createDataFrame(rows, "ord long, a double, b double, c double, d double, e double, f double, label double").repartition(4).cache()


COLUMNS = list("abcdef")


def expected(tree: Tree, x: np.ndarray, known: frozenset, node: int = 0) -> float:
    """The prediction where only some columns are known: both children by cover elsewhere."""
    f = int(tree.feature[node])
    if f < 0:
        return float(tree.value[node])
    a, b = int(tree.left[node]), int(tree.right[node])
    if f in known:
        return expected(tree, x, known, a if x[f] <= tree.threshold[node] else b)
    return (tree.cover[a] * expected(tree, x, known, a) + tree.cover[b] * expected(tree, x, known, b)) / tree.cover[node]


def brute(trees, x):
    """Shapley and interaction values over all subsets of the columns."""
    n = len(x)
    v = {frozenset(s): sum(expected(t, x, frozenset(s)) for t in trees) for k in range(n + 1) for s in itertools.combinations(range(n), k)}
    phi, both = np.zeros(n), np.zeros((n, n))
    for i in range(n):
        for s in (s for s in v if i not in s):
            phi[i] += math.factorial(len(s)) * math.factorial(n - len(s) - 1) / math.factorial(n) * (v[s | {i}] - v[s])
        for j in range(n):
            if i != j:
                for s in (s for s in v if i not in s and j not in s):
                    both[i, j] += math.factorial(len(s)) * math.factorial(n - len(s) - 2) / (2 * math.factorial(n - 1)) * (v[s | {i, j}] - v[s | {i}] - v[s | {j}] + v[s])
    both[np.arange(n), np.arange(n)] = phi - both.sum(axis=1)
    return phi, both


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_shapley_values_equal_all_subsets(spark, numbers, kind):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    rows = VectorAssembler(inputCols=COLUMNS, outputCol="features").transform(numbers)
    model = (RandomForestRegressor(numTrees=4, maxDepth=5, seed=1) if kind == "forest" else GBTRegressor(maxIter=3, maxDepth=4, seed=1)).fit(rows)
    trees = from_spark(model)
    found = model.transform(rows).orderBy("ord").limit(12).collect()
    x = np.array([[r[c] for c in COLUMNS] for r in found])
    assert np.allclose(predicted(trees, x), [r.prediction for r in found])
    phi, both = shapley(trees, x), interactions(trees, x)
    base = sum(t.mean() for t in trees)
    assert np.allclose(phi.sum(axis=1) + base, predicted(trees, x))
    assert np.allclose(both.sum(axis=2), phi) and np.allclose(both, both.transpose(0, 2, 1))
    for k in range(4):
        a, b = brute(trees, x[k])
        assert np.allclose(phi[k], a) and np.allclose(both[k], b)


def best_by_hand(x, g, h, rows, p):
    best = None
    total = (g[rows].sum(), h[rows].sum())
    s = lambda a, b: a * a / (b + p.reg_lambda)
    for f in range(x.shape[1]):
        for cut in sorted(set(x[:, f]))[:-1]:
            left = rows[x[rows, f] <= cut]
            if len(left) and len(left) < len(rows) and min(h[left].sum(), total[1] - h[left].sum()) >= p.min_child_weight:
                gl, hl = g[left].sum(), h[left].sum()
                gain = round(0.5 * (s(gl, hl) + s(total[0] - gl, total[1] - hl) - s(*total)) - p.gamma, 9)
                if gain > 1e-9 and (best is None or gain > best[0]):
                    best = (gain, f, cut)
    return best


def boosted_by_hand(x, y, p):
    """Predictions of trees grown best split first over exact cuts."""
    out = np.full(len(y), np.median(y) if p.absolute else y.mean())
    for _ in range(p.n_estimators):
        g, h = (np.sign(out - y) if p.absolute else out - y), np.ones(len(y))
        leaves = [(np.arange(len(y)), 0)]
        while len(leaves) < (p.leaves or 1 << 30):
            found = [(best_by_hand(x, g, h, rows, p), k) for k, (rows, depth) in enumerate(leaves) if depth < p.max_depth]
            found = [(b, k) for b, k in found if b]
            if not found:
                break
            (_, f, cut), k = max(found, key=lambda t: (t[0][0], -t[1]))
            rows, depth = leaves.pop(k)
            leaves += [(rows[x[rows, f] <= cut], depth + 1), (rows[x[rows, f] > cut], depth + 1)]
        new = out.copy()
        for rows, _ in leaves:
            value = np.median((y - out)[rows]) if p.absolute else -g[rows].sum() / (h[rows].sum() + p.reg_lambda)
            new[rows] += p.learning_rate * value
        out = new
    return out


@pytest.mark.parametrize("params", [Params(n_estimators=10, max_depth=3, reg_lambda=2.0, gamma=0.1), Params(n_estimators=2, max_depth=9, leaves=7, absolute=True, learning_rate=0.5)])
def test_boosting_equals_plain_trees(spark, numbers, params):
    model = fit_boosted(numbers, COLUMNS, "label", params)
    got = {r.ord: r.pred_log for r in model.transform(numbers).select("ord", "pred_log").collect()}
    rows = numbers.orderBy("ord").collect()
    x, y = np.array([[r[c] for c in COLUMNS] for r in rows]), np.array([r.label for r in rows])
    want = boosted_by_hand(x, y, params)
    assert np.allclose([got[r.ord] for r in rows], want, atol=1e-6)
    assert abs(sum(model.featureImportances) - 1) < 1e-9
    assert np.allclose(shapley(model.trees, x[:20]).sum(axis=1) + model.base + sum(t.mean() for t in model.trees), [got[r.ord] for r in rows[:20]])


def test_boosting_takes_samples_and_odd_tables(spark, numbers):
    p = Params(n_estimators=3, max_depth=3, subsample=0.6, colsample_bytree=0.5, reg_alpha=0.5)
    one, two = (fit_boosted(numbers, COLUMNS, "label", p) for _ in range(2))
    assert [t.value.tolist() for t in one.trees] == [t.value.tolist() for t in two.trees]
    same = numbers.withColumn("label", F.lit(3.0))
    assert {r.pred_log for r in fit_boosted(same, COLUMNS, "label", p).transform(same).collect()} == {3.0}
    assert fit_boosted(numbers.limit(0), COLUMNS, "label", p).transform(numbers.limit(2)).count() == 2


def test_the_second_batch_comes_from_the_parzen_densities():
    space = {"x": tuning.Number(0.0, 10.0), "n": tuning.Number(1, 9, whole=True), "c": ("a", "b")}
    done = tuning.search(lambda p: (p["x"] - 7) ** 2 + (p["c"] == "b") * 5 + p["n"], space, trials=10, seed=3, startup=10)
    good, bad = tuning.split(done)
    assert len(good) == 1 and good[0][1] == min(e for _, e in done)
    # By hand: one good value and the prior, each a cut normal curve.
    v = good[0][0]["x"]
    centres, widths = tuning.kernels([v], 0.0, 10.0)
    assert centres.tolist() == [v, 5.0] and widths.tolist() == [max(v, 10 - v), 10.0]
    phi = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
    by_hand = sum(math.exp(-0.5 * ((2 - c) / w) ** 2) / (w * math.sqrt(2 * math.pi) * (phi((10 - c) / w) - phi(-c / w))) for c, w in zip(centres, widths, strict=True)) / 2
    assert abs(tuning.density(2.0, centres, widths, 0.0, 10.0) - by_hand) < 1e-12
    grid = np.linspace(0, 10, 20001)
    assert abs(np.mean([tuning.density(x, centres, widths, 0.0, 10.0) for x in grid[::20]]) * 10 - 1) < 1e-2
    # The choice drawn is, of 24 draws, the one of greatest ratio of good to bad density.
    rnd, again = random.Random(5), random.Random(5)
    got = tuning.suggested(done, {"x": space["x"]}, rnd)["x"]
    l, g = tuning.kernels([v], 0.0, 10.0), tuning.kernels([t[0]["x"] for t in bad], 0.0, 10.0)
    tried = [tuning.drawn(*l, 0.0, 10.0, again) for _ in range(24)]
    assert got == max(tried, key=lambda x: tuning.density(x, *l, 0.0, 10.0) / tuning.density(x, *g, 0.0, 10.0))
    assert tuning.chances(["a", "a"], ("a", "b")) == [0.75, 0.25]


def test_the_search_beats_random_draws_and_keeps_to_its_space():
    space = {"x": tuning.Number(1e-4, 1.0, log=True), "n": tuning.Number(2, 20, whole=True, step=3), "c": (1, 2, 3)}
    error = lambda p: abs(math.log10(p["x"]) + 2) + abs(p["n"] - 11) / 5 + p["c"]
    found = [tuning.best(tuning.search(error, space, 80, seed))[1] for seed in range(5)]
    plain = [tuning.best(tuning.search(error, space, 80, seed, startup=80))[1] for seed in range(5)]
    assert sum(found) < sum(plain)
    for p, _ in tuning.search(error, space, 40):
        assert 1e-4 <= p["x"] <= 1 and p["n"] in range(2, 21, 3) and p["c"] in (1, 2, 3)


def test_folds_are_later_than_what_trains_for_them(spark):
    rows = spark.createDataFrame([(i, f"p{i % 13}", f"2020-01-{1 + i % 28:02d}") for i in range(100)], "ord long, path string, date string")
    folds = sorted((r.date, r.ord, r.fold) for r in splits.time_folds(rows, 4).collect())
    assert [f for _, _, f in folds] == [0] * 20 + [1] * 20 + [2] * 20 + [3] * 20 + [4] * 20
    assert splits.group_windows(13) == [(s, s + 7, s + 9) for s in range(5)]
    places = {r.path: r.place for r in splits.group_places(rows).collect()}
    assert sorted(places.values()) == list(range(13)) and places["p0"] == 0
    for train, test in M.fold_pairs(rows, 3, True):
        a, b = ({places[r.path] for r in x.collect()} for x in (train, test))
        assert a and b and max(a) < min(b)
    levels = splits.curve_folds(rows, (0.5, 1.0), 5).groupBy("fold").count().collect()
    assert {r["count"] for r in levels} == {20}


def test_ward_linkage_equals_lance_williams(spark):
    rnd, n = random.Random(3), 24
    d, rows = np.ones((n, n)), []
    for i, j in itertools.combinations(range(n), 2):
        if rnd.random() < 0.2 or j == i + 1:
            d[i, j] = d[j, i] = rnd.random()
            rows.append((f"f{i:03d}", f"f{j:03d}", float(d[i, j])))
    size, near, want = dict.fromkeys(range(n), 1), {(i, j): d[i, j] ** 2 for i, j in itertools.combinations(range(n), 2)}, []
    while len(size) > 1:
        (i, j), v = min(near.items(), key=lambda x: (round(x[1], 12), x[0]))
        for k in size.keys() - {i, j}:
            x, y = near[min(i, k), max(i, k)], near[min(j, k), max(j, k)]
            near[min(i, k), max(i, k)] = ((size[k] + size[i]) * x + (size[k] + size[j]) * y - size[k] * v) / (size[k] + size[i] + size[j])
        size[i] += size.pop(j)
        near = {k: x for k, x in near.items() if j not in k}
        want.append((f"f{i:03d}", f"f{j:03d}", round(math.sqrt(v), 8), size[i]))
    got = graph.ward_linkage(spark.createDataFrame(rows, "file1 string, file2 string, distance double")).orderBy("step")
    assert [(r.a, r.b, round(r.height, 8), r["size"]) for r in got.collect()] == want
    assert graph.ward_linkage(spark.createDataFrame([], "file1 string, file2 string, distance double")).count() == 0


def test_tracking_follows_renames_reused_names_and_missing_content(spark):
    commit = lambda sha, day, files, login=None: {"sha": sha, "commit": {"author": {"date": f"2020-01-{day:02d}T00:00:00Z"}, "committer": {"name": "n"}}, "committer": {"login": login}, "files": files}
    file = lambda name, status="modified", before=None, n=1: {"filename": name, "status": status, "previous_filename": before, "additions": n, "deletions": None, "changes": n}
    commits = [
        commit("a", 1, [file("x"), file("dir"), file("link")]), commit("b", 2, [file("y", "renamed", "x", 5)], "log"), commit("c", 3, [file("x", "added")]),
        commit("d", 4, [file("z", "renamed", "y")]), commit("e", 5, [file("z", "removed"), file("x")]), commit("f", 6, []), commit("g", 7, None), commit("h", 8, [file(None), file("unknown")]),
    ]
    answers = [("a", "x", 200, 10), ("b", "y", 200, 11), ("c", "x", 200, 3), ("d", "z", 404, None), ("e", "z", 404, None), ("e", "x", 200, 4)]
    content = [(s, p, h, False, "file", n) for s, p, h, n in answers] + [("a", "dir", 200, True, "file", 1), ("a", "link", 200, False, "symlink", 1)]
    found = tracking.tracked(spark.createDataFrame(commits, FULL_COMMIT), spark.createDataFrame(content, tracking.CONTENT))
    got = {r.path: (r.previous_paths, [(e.sha, e.committer, e["size"], e.additions, e.deletions) for e in r.commit_history]) for r in found.collect()}
    assert got == {
        "z": (["x", "y"], [("a", "n", 10, 1, 0), ("b", "log", 11, 5, 0), ("e", "n", 0, 1, 0)]),
        "x": ([], [("c", "n", 3, 1, 0), ("e", "n", 4, 1, 0)]),
    }
    assert tracking.tracked(spark.createDataFrame([], FULL_COMMIT), spark.createDataFrame(content, tracking.CONTENT)).count() == 0


def test_means_are_summed_in_tasks_and_rows_explained_once(spark, numbers, monkeypatch):
    df = numbers.withColumns({"days_until_completion": F.col("label") + 20, "who": F.when(F.col("ord") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("w"), (F.col("ord") % 8 % 6).cast("string")))})
    model = M.fit(df, COLUMNS, "random_forest", numTrees=3, maxDepth=5)
    each = M.tree_contributions(model, df, COLUMNS, ("who",))
    close = lambda a, b: len(a) == len(b) > 0 and all(np.allclose(x[1:], y[1:]) and x[0] == y[0] for x, y in zip(a, b, strict=True))
    rows = lambda d: sorted(map(tuple, d.collect()), key=repr)
    by = M.tree_contributions_by(model, df, COLUMNS, "who", 3)
    assert by._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert close(rows(by), rows(M.contributions_by(each, "who", COLUMNS, 3)))
    assert close(rows(M.mean_tree_contributions(model, df, COLUMNS)), rows(M.mean_contributions(each, COLUMNS)))
    tables, full = M.node_tables(model), M.prepared(df, COLUMNS)
    some = {(r.feature, r.other): r for r in M.TR.mean_interactions(tables, full, COLUMNS, [("c", "a"), ("b", "d")]).collect()}
    every = {(r.feature, r.other): r for r in M.TR.mean_interactions(tables, full, COLUMNS).collect()}
    assert set(some) == {("a", "c"), ("b", "d")}
    assert all(np.isclose(some[k].mean_abs, every[k].mean_abs) and np.isclose(some[k]["mean"], every[k]["mean"]) for k in some)
    x = np.array(numbers.select(*COLUMNS).collect())
    want = shapley(tables, x)
    for tabled, bits in ((1, 62), (1, 2), (3, 62)):  # patterns of long paths are made as they come
        monkeypatch.setattr(M.TR, "TABLED", tabled)
        monkeypatch.setattr(M.TR, "BITS", bits)
        assert np.allclose(shapley(tables, x), want)


def test_medians_of_leaves_are_exact_and_bounded(spark, monkeypatch):
    from chronolith.ml import boosting as B

    rnd = random.Random(3)
    y = [rnd.choice((0.0, -0.0, 1.5, rnd.gauss(0, 1e-3), rnd.gauss(0, 50))) for _ in range(801)]
    rows = spark.createDataFrame([(float(i % 5), v) for i, v in enumerate(y)], "a double, label double").repartition(3)
    data = B.binned(rows, ["a"], "label", [np.array([0.0, 1.0, 2.0])], 0.25)
    assert data.count() <= 8 and sum(r.n for r in data.collect()) == len(y)  # blocks, not rows
    tree = Tree.of([(0, 1.0, 1, 2, 0.0, 1.0), (-1, 0, 0, 0, 1.0, 1.0), (-1, 0, 0, 0, 2.0, 1.0)])
    want = {1: np.median([v - 0.25 for i, v in enumerate(y) if i % 5 <= 1]), 2: np.median([v - 0.25 for i, v in enumerate(y) if i % 5 > 1])}
    for few in (1 << 16, 0):
        monkeypatch.setattr(B, "FEW", few)
        assert B.medians(data, tree, 1, []) == want
    for share in (0.3, 0.8):
        drawn = np.concatenate([B.drawn_rows(k, 10_000, share, 42) for k in range(4)])
        assert abs(drawn.mean() - share) < 0.02 and not (drawn[:10_000] == drawn[10_000:20_000]).all()


def test_tracking_query_gathers_no_history_in_one_row(spark, small):
    from chronolith.plans import catalog

    plan = catalog.queries()["file_tracking"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "total_changes" not in plan or "collect_list(entry" not in plan
    assert "commit_history" not in plan


def test_a_tree_counts_rows_of_the_smaller_children_only(spark, monkeypatch):
    rnd = np.random.default_rng(7)
    rows = [(float(a), float(b), float(a * b + 3 * (a > 5))) for a, b in rnd.integers(0, 12, (400, 2))]
    df, counted, sums = spark.createDataFrame(rows, "a double, b double, label double").repartition(3), [], boosting.histograms

    def kept(*args):
        found = sums(*args)
        counted.append(int(found[:, 0, :, 2].sum()))
        return found

    monkeypatch.setattr(boosting, "histograms", kept)
    model = boosting.fit_boosted(df, ["a", "b"], params=boosting.Params(n_estimators=1, max_depth=4, learning_rate=1.0, reg_lambda=0.0))
    assert counted[0] == 400 and len(counted) == 4 and all(n <= 200 for n in counted[1:])  # a pass less than levels of nodes
    x = np.array(rows)
    leaf = model.trees[0].leaves_of(x[:, :2])
    for k in np.unique(leaf):  # sums by subtraction give each leaf the mean of its rows, and their number
        assert abs(model.base + model.trees[0].value[k] - x[leaf == k, 2].mean()) < 1e-9 and model.trees[0].cover[k] == (leaf == k).sum()


def test_a_row_is_looked_up_by_subtrees_not_by_leaves(monkeypatch):
    rng, rows = np.random.default_rng(3), []

    def grow(depth: int, cover: float) -> int:
        at, share = len(rows), rng.uniform(0.2, 0.8)
        rows.append(None)
        if depth == 0:
            rows[at] = (-1, 0.0, 0, 0, float(rng.normal()), cover)
        else:  # columns come again on the way down
            rows[at] = (int(rng.integers(8)), float(rng.normal()), grow(depth - 1, cover * share), grow(depth - 1, cover * (1 - share)), 0.0, cover)
        return at

    grow(6, 1000.0)
    tree, x = TR.Tree.of(rows), rng.normal(size=(500, 8))
    of, pairs = TR.explainer([tree], 8), [(0, 1), (2, 5), (3, 4)]
    assert 1 <= len(of.trees[0][1]) <= 16  # before, a table for each of the 64 leaves
    both = TR.pair_explainer([tree], pairs)(x)
    monkeypatch.setattr(TR, "TABLED", -1)
    assert np.allclose(of(x), TR.explainer([tree], 8)(x), atol=1e-12)
    assert np.allclose(both, TR.pair_explainer([tree], pairs)(x), atol=1e-12)
    assert np.allclose(of(x).sum(axis=0) + tree.mean(), TR.predicted([tree], x))


def test_the_registered_search_is_whole(spark, small, monkeypatch):
    asked, folds, pairs = {}, [], M.fold_pairs
    monkeypatch.setattr(M, "fold_pairs", lambda train, k, grouped: folds.append((k, grouped)) or pairs(train, k, grouped))

    def search(objective, space, trials, *rest):
        asked[next(m for m, s in M.SPACES.items() if s is space)] = trials
        return [({}, 1.0)]

    monkeypatch.setattr(M, "search", search)
    assert catalog.queries()["tuning"](spark, small).count() == 4
    assert asked == dict.fromkeys(("random_forest", "gradient_boosting", "xgboost", "lightgbm"), 100) and set(folds) == {(5, True)}
    trees = {m: next((v.low, v.high) for k, v in s.items() if k in ("numTrees", "maxIter", "n_estimators")) for m, s in M.SPACES.items() if m in asked}
    assert trees == {"random_forest": (50, 500), "gradient_boosting": (100, 1000), "xgboost": (100, 1000), "lightgbm": (100, 1000)}


def test_trials_share_each_folds_binned_rows(spark, monkeypatch):
    rows = spark.range(300).select(F.col("id").alias("ord"), F.concat(F.lit("p"), F.col("id") % 30).alias("path"), F.timestamp_seconds(F.col("id") * 86400).alias("date"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"))
    rows = rows.withColumn("days_until_completion", (F.col("a") * 5 + F.col("b")).cast("long"))
    monkeypatch.setitem(M.SPACES, "xgboost", {"n_estimators": tuning.Number(1, 3, whole=True), "colsample_bytree": tuning.Number(0.5, 1.0)})
    times, binned = [], boosting.binned
    monkeypatch.setattr(boosting, "binned", lambda *a: times.append(1) or binned(*a))
    pairs = M.fold_pairs(rows, 2, True)
    found = M.tune(rows, ["a", "b"], "xgboost", trials=4, pairs=pairs, parallel=2)
    assert len(times) == 2 and len(found) == 4
    for params, error in found[:2]:
        assert M.cv_error(pairs, ["a", "b"], "xgboost", params) == pytest.approx(error)


def test_margins_that_were_brought_up_to_date_leave_no_files(spark, numbers, monkeypatch):
    kept, forgotten = [], []
    old, forget = boosting.checkpointed, boosting.forget
    monkeypatch.setattr(boosting, "checkpointed", lambda df: kept.append(old(df)) or kept[-1])
    monkeypatch.setattr(boosting, "forget", lambda df: forgotten.append(df) or forget(df))
    fit_boosted(numbers, COLUMNS, "label", Params(n_estimators=18, max_depth=2))
    files = [df._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:") for df in kept]
    assert len(kept) == 3 and forgotten == kept[1:]  # the binned rows may serve further fits
    assert [os.path.exists(f) for f in files] == [True, False, False]
