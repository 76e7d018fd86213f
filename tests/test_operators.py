"""Edge rows, properties and brute force for the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.functions import scalars
from tabloom.operators import cleaning, experiments, features, knn, metrics, mlp, sampling, trees
from tabloom.plans import cleaning as cleaning_plans
from tabloom.sources import tables
from tabloom.spec import SHAPES, TableSpec

EDGES = {
    "": (None, "missing_token"), "?": (None, "missing_token"), " na ": (None, "missing_token"), "NaN": (None, "missing_token"), "12cm": (12.0, "removed_unit_cm"),
    "1.5 KG": (1.5, "removed_unit_kg"), "-3": (-3.0, None), "inf": (None, "not_finite"), "-Infinity": (None, "not_finite"), "+nan": (None, "not_finite"),
    "abc": (None, "not_numeric"), "1_000": (1000.0, None), "1__0": (None, "not_numeric"), "1.0d": (1.0, "removed_unit_d"), "0x1p3": (None, "not_numeric"),
    "5.": (5.0, None), ".5": (0.5, None), "1e5": (100000.0, None), "1e": (1.0, "removed_unit_e"), "1e999": (None, "not_finite"), "5x3": (None, "not_numeric"),
    "+1e-3": (0.001, None), "1_0.5_0": (10.5, None), "  7 ": (7.0, None), None: (None, "missing_token"), "1e999cm": (None, "not_finite"),
}


def test_parse_numeric_edges(spark):
    df = spark.createDataFrame([(t,) for t in EDGES], "t string").select("t", scalars.parse_numeric(F.col("t")).alias("p"))
    assert {r["t"]: (r["p"]["value"], r["p"]["issue"]) for r in df.collect()} == EDGES


def test_class_and_rules_in_order(spark):
    spec = TableSpec(("a", "b", "r"), ("SEKER", "HOROZ"), "c", repair_sign=("a",), ratios=("r",), caps={"b": 1000.0}, at_most=(("a", "b"),))
    raw = [("train", 1, " s3k3r ", "-5", "4", "2"), ("train", 2, "H0R0Z", "0", "2000", "0.5"), ("val", 3, "x", "1", "2", "1"), ("val", 4, None, None, None, None)]
    rows = cleaning.clean_rows(spark.createDataFrame(raw, "split string, source_row long, c string, a string, b string, r string"), spec).orderBy("source_row").collect()
    assert (rows[0]["c"], rows[0]["a"], rows[0]["b"], rows[0]["r"]) == ("SEKER", None, 4.0, None)
    assert rows[0]["issues"] == ["class_normalized", "a:negative_to_abs", "r:outside_0_1_to_missing", "a:greater_than_b_to_missing"]
    assert (rows[1]["c"], rows[1]["a"], rows[1]["b"]) == ("HOROZ", None, None)
    assert rows[2]["c"] == "" and rows[2]["issues"] == ["invalid_class"]
    assert rows[3]["issues"][0] == "invalid_class" and len(rows[3]["issues"]) == 4


def test_medians_need_values(spark):
    df = spark.createDataFrame([("train", None), ("val", 1.0)], "split string, a double")
    with pytest.raises(ValueError, match="a"):
        cleaning.require_values(cleaning.train_medians(df, ["a"]))


def test_dedup_keeps_first_and_leaks_go(spark):
    rows = [("train", 3, 1.0, "x"), ("train", 2, 1.0, "x"), ("train", 5, 2.0, "x"), ("test", 9, 2.0, "x"), ("test", 10, 2.0, "x"), ("val", 11, 3.0, None), ("train", 12, 3.0, None)]
    df = spark.createDataFrame(rows, "split string, source_row long, a double, c string")
    once = cleaning.dedup_within_split(df, ["a", "c"])
    assert sorted(r["source_row"] for r in once.collect()) == [2, 5, 9, 11, 12]
    again = cleaning.dedup_within_split(once, ["a", "c"])
    assert again.count() == once.count()
    assert sorted(r["source_row"] for r in cleaning.leakage_anti_join(once, ["a", "c"]).collect()) == [2, 9, 11]


def test_contracts(spark, tmp_path):
    a, b = spark.createDataFrame([(1.0, 2.0, "x")], "p double, q double, y string"), spark.createDataFrame([(1.0, 2.0, "x")], "q double, p double, y string")
    with pytest.raises(ValueError):
        tables.same_features({"train": a, "val": b}, "y")
    with pytest.raises(ValueError):
        tables.typed_features(a, "z")
    with pytest.raises(ValueError):
        tables.write_rows(a.where("false"), str(tmp_path / "x"))
    with pytest.raises(ValueError):
        knn.topk(a, a, 0)
    with pytest.raises(ValueError):
        sampling.with_noise(a, "gaussian", -1.0, ["p"], "y", ["x"], "p", 1)
    with pytest.raises(ValueError):
        sampling.with_noise(a, "salt", 1.0, ["p"], "y", ["x"], "p", 1)
    with pytest.raises(ValueError):
        mlp.gradient(a, mlp.Net.he(2, 2, 2, 0), np.ones(2), dropout=1.0)
    with pytest.raises(Exception, match="(?i)path"):
        tables.read_text_split(spark, str(tmp_path / "absent"), "train", ["a"]).count()


def test_text_split_counts_lines_and_drops_the_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbfa,b\n1,x\n,y\n")
    rows = tables.read_text_split(spark, str(tmp_path / "a.csv"), "train", ["a", "b"]).orderBy("source_row").collect()
    assert [(r["a"], r["b"], r["source_row"], r["split"]) for r in rows] == [("1", "x", 2, "train"), (None, "y", 3, "train")]


def test_csv_and_spark_plans_push_down(spark, sf):
    plan = spark.read.parquet(f"{sf}/events.parquet").where("event_id > 5").select("event_id")._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "ReadSchema: struct<event_id:bigint>" in plan


@pytest.mark.parametrize("name", ["sign_repair", "range_rules", "cross_column_rule"])
def test_a_filter_on_issues_parses_nothing_again(spark, sf, name):
    plan = cleaning_plans.Q[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "RLIKE" in plan


def test_standard_scores(spark):
    df = spark.createDataFrame([("train", 1.0, 5.0), ("train", 3.0, 5.0), ("test", 5.0, 6.0)], "split string, a double, b double")
    z = features.standardize(df, features.standard_stats(df, ["a", "b"]), ["a", "b"]).orderBy("a").collect()
    assert [(r["a"], r["b"]) for r in z] == [(-1.0, 0.0), (1.0, 0.0), (3.0, 1.0)]


def test_correlation_forms_agree_and_constants_stay(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet").selectExpr("value AS a", "value * value AS b", "CAST(event_id AS DOUBLE) AS c", "CAST(1 AS DOUBLE) AS k")
    cols = ["a", "b", "c", "k"]
    pairs = {(r["a"], r["b"]): r["r"] for r in features.correlations(df, cols).collect()}
    m = features.correlation_matrix(df, cols)
    for (x, y), r in pairs.items():
        other = m[cols.index(x), cols.index(y)]
        assert (r is None and math.isnan(other)) or abs(r - other) < 1e-9
    kept, _ = features.greedy_selection(cols, pairs)
    assert "k" in kept


def test_greedy_takes_the_first_that_qualifies():
    kept, dropped = features.greedy_selection(["a", "b", "c"], {("a", "b"): 0.1, ("a", "c"): 0.96, ("b", "c"): -0.99})
    assert kept == ["a", "b"] and dropped == [("c", "a", 0.96)]


def _vectors(spark, x, labels=None, split=1):
    rows = [(i, labels[i] if labels else f"L{i % 3}", [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, label string, features array<double>").repartition(split)


def test_topk_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(300, 5)), 1)  # with ties
    df = _vectors(spark, x, split=7)
    got = {}
    for r in knn.topk(df, df.where("id < 40"), 9).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["train_id"]))
    for q in range(40):
        d = np.zeros(300)
        for j in range(5):
            d += (x[:, j] - x[q, j]) ** 2
        assert [t for _, t in sorted(got[q])] == np.lexsort((np.arange(300), d))[:9].tolist()


def test_topk_with_fewer_rows_and_vote_ties(spark):
    df = _vectors(spark, [[0], [1], [-1]], ["a", "b", "c"])
    near = knn.topk(df, _vectors(spark, [[0]]), 10)
    assert near.count() == 3
    tie = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (2, "a", 2.0), (2, "b", 1.0)], "query_id long, label string, distance double")
    assert {r["query_id"]: r["predicted_class"] for r in knn.votes(tie).collect()} == {1: "b", 2: "b"}
    acc = spark.createDataFrame([(11, 0.9), (15, 0.9), (3, 0.8)], "k int, accuracy double")
    assert knn.best_k(acc).first()["k"] == 11


def _brute_split(x, y, least):
    def h(v):
        p = np.bincount(v) / len(v)
        return -(p[p > 0] * np.log2(p[p > 0])).sum()

    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for a, b in zip(values, values[1:], strict=False):
            if y[x[:, f] == a].max() == y[x[:, f] == b].min():
                continue
            left = y[x[:, f] <= a]
            right = y[x[:, f] > a]
            if min(len(left), len(right)) < least:
                continue
            gain = round(h(y) - len(left) / len(y) * h(left) - len(right) / len(y) * h(right), 10)
            if best is None or gain > best[0]:
                best = (gain, f, (a + b) / 2)
    return best


def test_best_split_against_loops(spark):
    rng = np.random.default_rng(3)
    x, y = np.round(rng.normal(size=(80, 3)), 1), rng.integers(0, 3, 80)
    node = rng.integers(0, 4, 80)
    rows = [(0, int(n), 1, int(c), [float(v) for v in r]) for n, c, r in zip(node, y, x, strict=True)]
    df = spark.createDataFrame(rows, "tree int, node long, weight int, code int, features array<double>")
    for r in trees.best_splits(df, 3, 2).collect():
        own = node == r["node"]
        gain, f, t = _brute_split(x[own], y[own], 2)
        assert (r["feature"], round(r["threshold"], 9)) == (f, round(float(t), 9)) and abs(r["gain"] - gain) < 1e-9


def test_tree_fits_separable_rows_and_is_cut(spark):
    x = [[a, b] for a in range(6) for b in range(6)]
    y = [int(a >= 3) * 2 + int(b >= 3) for a, b in x]
    rows = spark.createDataFrame([(i, c, [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y, strict=True))], "id long, code int, features array<double>")
    names = ["a", "b", "c", "d"]
    model = trees.grow(rows, names, 5)
    assert metrics.accuracy(model.predict(rows)).first()["accuracy"] == 1.0
    stump = model.cut_at(1)
    assert stump.nodes["depth"].max() == 1 and (stump.nodes.loc[stump.nodes["depth"] == 1, "feature"] == -1).all()
    binned = trees.grow(rows, names, 5, bins=16)
    assert len(binned.nodes) >= 3


def test_forest_votes_prefer_the_smaller_label(spark):
    votes = spark.createDataFrame([(1, 2), (1, 1), (2, 3), (2, 3), (2, 1)], "id long, label int")
    assert {r["id"]: r["label"] for r in trees.forest_vote(votes, ["id"]).collect()} == {1: 1, 2: 3}


def test_gradient_against_differences(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(30, 4)), rng.integers(0, 3, 30)
    rows = spark.createDataFrame([(i, int(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y, strict=True))], "id long, code int, features array<double>").repartition(3)
    net, weights, l2 = mlp.Net.he(4, 5, 3, 2), np.array([1.0, 2.0, 0.5]), 0.01
    g, _ = mlp.gradient(rows, net, weights, l2)

    def loss(n):
        w = weights[y]
        return -(w * np.log(n.forward(x)[np.arange(30), y])).sum() / w.sum() + l2 / 2 * ((n.w1**2).sum() + (n.w2**2).sum())

    for name in ("w1", "b1", "w2", "b2"):
        for i in np.ndindex(getattr(net, name).shape):
            up, down = (mlp.Net(**{k: getattr(net, k).copy() for k in ("w1", "b1", "w2", "b2")}) for _ in range(2))
            getattr(up, name)[i] += 1e-6
            getattr(down, name)[i] -= 1e-6
            assert abs((loss(up) - loss(down)) / 2e-6 - getattr(g, name)[i]) < 1e-5
            if i[0] > 1:
                break


def test_net_forms_agree_and_training_learns(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 120)
    x = rng.normal(size=(120, 3)) + 2.5 * y[:, None]
    rows = spark.createDataFrame([(i, int(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y, strict=True))], "id long, code int, features array<double>").cache()
    net, history = mlp.train(rows, rows, 6, 2, 6, rate=0.5, patience=None)
    assert max(h["val_accuracy"] for h in history) > 0.9 and len(history) == 6
    both = rows.select(mlp.forward_columns(net, F.col("features")).alias("a"), mlp.forward_batches(net, F.col("features")).alias("b")).collect()
    assert all(np.allclose(r["a"], r["b"]) for r in both)


def test_metric_goldens(spark):
    """Hand-computed figures of a small confusion table with an absent class."""
    pairs = spark.createDataFrame([("a", "a", 90), ("a", "b", 10), ("b", "a", 5), ("b", "b", 45), ("c", "c", 0), ("a", "c", 0)], "true_class string, predicted_class string, n long")
    by = {r["class"]: r for r in metrics.per_class(pairs).collect()}
    assert abs(by["a"]["precision"] - 90 / 95) < 1e-12 and by["a"]["support"] == 100 and by["c"]["f1"] == 0.0
    avg = metrics.averages(metrics.per_class(pairs)).first()
    assert abs(avg["weighted_recall"] - 135 / 150) < 1e-12  # weighted recall is accuracy
    assert abs(avg["macro_recall"] - (0.9 + 0.9 + 0) / 3) < 1e-12


def test_stratified_limit_is_exact_and_stable(spark):
    df = spark.range(1000).selectExpr("id", "CASE WHEN id % 10 < 6 THEN 'a' WHEN id % 10 < 9 THEN 'b' ELSE 'c' END AS label")
    got = sampling.stratified_limit(df, "label", "id", 101, 3)
    ids = sorted(r["id"] for r in got.collect())
    assert len(ids) == 101 == len(set(ids))
    assert ids == sorted(r["id"] for r in sampling.stratified_limit(df.repartition(7), "label", "id", 101, 3).collect())
    assert sampling.stratified_limit(df, "label", "id", 0, 3).count() == 1000
    assert sampling.stratified_limit(df, "label", "id", 5000, 3).count() == 1000


def test_noise_statistics(spark):
    df = spark.range(4000).selectExpr("id", "CAST(1 AS DOUBLE) AS x", "'a' AS y")
    one = lambda kind, i: sampling.with_noise(df, kind, i, ["x"], "y", ["a", "b", "c"], "id", 5)
    s = one("gaussian", 0.5).agg(F.avg("x"), F.stddev("x")).first()
    assert abs(s[0] - 1) < 0.03 and abs(s[1] - 0.5) < 0.03
    s = one("uniform", 0.5).agg(F.min("x"), F.max("x")).first()
    assert 0.5 <= s[0] < 0.51 and 1.49 < s[1] <= 1.5
    assert abs(one("dropout", 0.3).where("x = 0").count() / 4000 - 0.3) < 0.03
    flips = {r["y"]: r["count"] for r in one("label_flip", 0.4).groupBy("y").count().collect()}
    assert abs(flips["b"] / 4000 - 0.2) < 0.03 and abs(flips["c"] / 4000 - 0.2) < 0.03
    assert sampling.with_noise(df, "label_flip", 1.0, ["x"], "y", ["a"], "id", 5).where("y = 'a'").count() == 4000


def test_bootstrap_counts(spark):
    w = sampling.bootstrap(spark.range(50).toDF("id"), "id", 3, 0.8, 1)
    assert {r["tree"]: r["n"] for r in w.groupBy("tree").agg(F.sum("weight").alias("n")).collect()} == {0: 40, 1: 40, 2: 40}


def test_latency_p95_of_three_is_the_median(spark):
    t = spark.createDataFrame([("m", 1.0), ("m", 5.0), ("m", 3.0)], "model string, seconds double")
    r = experiments.latency_summary(t, 10).first()
    assert r["p95"] == 3.0 and r["median"] == 3.0


def test_scoring_runs_on_a_stream(spark, tmp_path):
    from tabloom.streaming.scoring import clean_stream

    spec = TableSpec(("a",), ("X",), "c")
    src, schema = str(tmp_path / "in"), "split string, source_row long, c string, a string"
    spark.createDataFrame([("s", 1, "x", "5cm"), ("s", 2, "y", "?")], schema).write.parquet(src)
    medians = {"a": 2.0}
    q = clean_stream(spark.readStream.schema(schema).parquet(src), spec, medians).writeStream.format("memory").queryName("cleaned").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["source_row"], r["a"], r["c"]) for r in spark.table("cleaned").collect()) == [(1, 5.0, "X"), (2, 2.0, "")]


def test_preset_has_sixteen_columns():
    assert len(SHAPES.numeric) == 16 and len(features.derived_columns()) == 19


def test_lines_are_numbered_over_splits_of_files(spark, tmp_path):
    """Several files, cut into several parts: each line has its number, in the order of files and lines."""
    n = 0
    for name in ("a", "b", "c"):
        rows = 400 if name == "b" else 7
        (tmp_path / f"{name}.csv").write_text("x,y\n" + "".join(f"{n + i},{'p' * 40}\n" for i in range(rows)))
        n += rows
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        rows = tables.read_text_split(spark, str(tmp_path), "train", ["x", "y"]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((int(r["x"]), r["source_row"]) for r in rows) == [(i, i + 2) for i in range(n)]
    assert {r["split"] for r in rows} == {"train"}


def test_places_in_order(spark):
    ids = spark.range(0, 3000, 3, 7).selectExpr("(id * 7919) % 3000 AS id")
    got = tables.in_order(ids, "id", "place").collect()
    assert sorted((r["id"], r["place"]) for r in got) == [(v, i) for i, v in enumerate(sorted(r["id"] for r in ids.collect()))]
    assert tables.in_order(ids.where("false"), "id", "place").count() == 0


@pytest.mark.parametrize("group", [1, 2, 16])
def test_topk_over_a_grid_of_blocks(spark, monkeypatch, group):
    """Small blocks, many groups: as one comparison of all."""
    monkeypatch.setattr(knn, "BLOCK", 16)
    monkeypatch.setattr(knn, "GROUP", group)
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(230, 3)), 1)
    rows = [(i, f"L{i % 3}", [float(v) for v in x[i]]) for i in range(230)]
    df = spark.createDataFrame(rows, "id long, label string, features array<double>").repartition(5)
    got = {}
    for row in knn.topk(df.where("id < 150"), df.where("id >= 150"), 6).collect():
        got.setdefault(row["query_id"], []).append((row["rank"], row["train_id"]))
    for q in range(150, 230):
        d = np.zeros(150)
        for j in range(3):
            d += (x[q, j] - x[:150, j]) ** 2
        assert sorted(got[q]) == [(k + 1, int(i)) for k, i in enumerate(np.lexsort((np.arange(150), d))[:6])]


def test_models_are_saved_and_loaded(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 3, [float(i % 3), float(i % 5)]) for i in range(60)], "id long, code int, features array<double>")
    tree = trees.grow(rows, ["a", "b", "c"], 4)
    tree.save(spark, str(tmp_path / "tree"))
    again = trees.TreeModel.load(spark, str(tmp_path / "tree"))
    assert again.labels == tree.labels
    assert sorted(map(tuple, again.predict(rows).collect())) == sorted(map(tuple, tree.predict(rows).collect()))
    net = mlp.Net.he(2, 4, 3, 1)
    net.save(spark, str(tmp_path / "net"))
    back = mlp.Net.load(spark, str(tmp_path / "net"))
    assert all(np.array_equal(getattr(net, n), getattr(back, n)) for n in ("w1", "b1", "w2", "b2"))
    assert mlp.descend(rows, net, 2, 0.1).w1.shape == (4, 2)


def test_bins_are_quantiles(spark):
    """With bins splits are those of quantiles, near the exact ones."""
    r = np.random.default_rng(5)
    x = r.normal(size=(600, 2))
    rows = spark.createDataFrame([(i, int(x[i, 0] > 0.3), [float(v) for v in x[i]]) for i in range(600)], "id long, code int, features array<double>")
    exact = trees.grow(rows, ["a", "b"], 1).nodes
    binned = trees.grow(rows, ["a", "b"], 1, bins=64).nodes
    assert exact["feature"][0] == binned["feature"][0] == 0 and abs(exact["threshold"][0] - binned["threshold"][0]) < 0.1


def test_labels_are_counted_before_they_are_gathered(spark, monkeypatch):
    df = spark.range(20).selectExpr("id", "CAST(id AS string) AS label", "'train' AS split")
    monkeypatch.setattr(sampling, "MOST_CLASSES", 10)
    monkeypatch.setattr(features, "MOST_CLASSES", 10)
    monkeypatch.setattr(metrics, "MOST_LABELS", 10)
    for call in (lambda: sampling.quotas(df, "label", 5), lambda: features.label_codes(df, "label"), lambda: metrics.confusion(df.selectExpr("label AS true_class", "label AS predicted_class"), df)):
        with pytest.raises(ValueError, match="more than 10"):
            call()


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        get = staticmethod(lambda *_: None)

    class Cluster:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077", "getConf": staticmethod(lambda: Conf())})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.scratch(Cluster(), "x")
