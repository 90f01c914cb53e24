import collections
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lamina.operators import buckets, checks, clusters, index, kmeans, neighbours, semantic, series


def test_percentile_and_z(spark):
    rows = spark.createDataFrame([(c, 1, v) for c, v in enumerate([1.0, 2.0, 2.0, 5.0])] + [(9, 2, 3.0)], "cluster int, concept_id int, raw_cosine double")
    got = {(r.concept_id, r.cluster): r for r in semantic.standardized(rows, ["concept_id"]).collect()}
    assert [got[1, i].percentile_score for i in range(4)] == [0, 0.5, 0.5, 1] and got[2, 9].percentile_score == 0.5 and got[2, 9].z_score == 0


def tiles(spark, rows):
    return spark.createDataFrame(rows, "magnification int, fine_cluster_id int, slide_id int, patient_id int, primary_site string, tcga_project string")


def test_entropy_rarity_support(spark):
    t = tiles(spark, [(5, 1, i, i, "a" if i < 5 else "b", "p") for i in range(10)] + [(5, 2, i, i, "a", "p") for i in range(10)])
    got = {r.fine_cluster_id: r for r in clusters.statistics(t, min_tiles=5).collect()}
    assert got[1].tissue_entropy == pytest.approx(1.0) and got[2].tissue_entropy == 0.0 and got[1].project_entropy == 0.0
    assert got[1].tissue_coverage == 2 and got[2].tissue_coverage_norm == 0.5 and got[1].dominant_tissue == "a"
    n = spark.createDataFrame([(4,), (4,), (16,)], "n int")
    assert [r[0] for r in n.orderBy("n").select(clusters.rarity(F.col("n"), F.median("n").over(Window.partitionBy()))).collect()] == [1, 1, 0.5]
    s = spark.createDataFrame([(0,), (1,), (3,)], "n int").orderBy("n").select(clusters.support(F.col("n"), F.lit(3))).collect()
    assert [r[0] for r in s] == [0, 0.5, 1]


def test_thresholds_and_empty_bucket(spark):
    values = [0.1, 0.7, 0.35, 0.9, 0.2, 0.55, 0.61]
    rows = spark.createDataFrame([(5, True, v) for v in values] + [(10, False, 1.0)], "magnification int, sampling_eligible boolean, s double")
    for c in buckets.SCORES.values():
        rows = rows.withColumn(c, F.col("s"))
    got = {r.magnification: r.bridge_score_threshold for r in buckets.thresholds(rows).collect()}
    assert got[5] == pytest.approx(0.682) and got[10] is None
    rows = rows.join(buckets.thresholds(rows), "magnification")
    assert rows.where("magnification = 10").select(buckets.meets("bridge_score")).first()[0] is False


def test_representatives(spark):
    rows = spark.createDataFrame([(1, "s1", 0, -1.0), (1, "s1", 1, -2.0), (1, "s1", 2, -3.0), (1, "s2", 3, -4.0)], "cluster int, slide string, row int, score double")
    got = neighbours.representatives(rows, 2, 3).orderBy("rank").collect()
    assert [(r.score, r["rank"]) for r in got] == [(-1, 1), (-2, 2), (-4, 3)]


def test_top_k_blocks_agree(spark):
    r = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, r.normal(size=4).tolist()) for i in range(60)], "vec_id long, embedding array<float>")
    queries = rows.where("vec_id % 7 = 0")
    a = {tuple(x) for x in neighbours.top_k(queries, rows, 3, skip_self=True).collect()}
    b = {tuple(x) for x in neighbours.top_k(queries, rows, 3, skip_self=True, block_bytes=64).collect()}
    x = np.array([v.embedding for v in rows.orderBy("vec_id").collect()])
    assert a == b and len(a) == 27
    s = np.round(x @ x.T, 9)
    for q, n, _, k in a:
        order = [i for i in np.lexsort((np.arange(60), -s[q])) if i != q]
        assert order[k - 1] == n


def test_votes(spark):
    near = spark.createDataFrame([(1, 10, 1.0, 1), (1, 11, 1.0, 2), (1, 12, 0.5, 3)], "query long, neighbour long, similarity double, rank int")
    labels = spark.createDataFrame([(10, 0), (11, 1), (12, 1)], "vec_id long, label int")
    got = {(r.k, r.label): r.weight for r in neighbours.votes(near, labels, [2, 3], 0.5).collect()}
    total = 2 + np.exp(-1)
    assert got[2, 0] == pytest.approx(1 / total) and got[3, 1] == pytest.approx((1 + np.exp(-1)) / total)
    truth = spark.createDataFrame([(1, [1, 5]), (2, [])], "query long, true_labels array<int>")
    assert neighbours.multi_label_accuracy(neighbours.predictions(neighbours.votes(near, labels, [3])), truth, 1).first().accuracy == 1


def test_kmeans(spark):
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(c, 0.1, (30, 2)) for c in (0, 5, 9)])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    centers, costs = kmeans.fit(rows, 3, 10)
    assert all(b <= a + 1e-9 for a, b in zip(costs, costs[1:], strict=False)) and len(centers) == 3
    got = kmeans.assign(rows, centers, "vec_id").groupBy("cluster").count().collect()
    assert sorted(g["count"] for g in got) == [30, 30, 30]
    again, cost = kmeans.updated(rows, centers)
    assert np.allclose(again, centers) and cost == pytest.approx(costs[-1])
    levels = kmeans.hierarchy(centers, [2], 5)
    assert len(levels[0][0]) == 2 and len(levels[0][1]) == 3
    assert kmeans.floyd(5, 100, 47).tolist() == sorted(set(kmeans.floyd(5, 100, 47).tolist())) and len(kmeans.floyd(9, 4, 0)) == 4


def test_islands_and_meter(spark):
    rows = spark.createDataFrame([("a", i, b) for i, b in enumerate([1, 1, 0, 1, 1, 0, 1])], "g string, t int, bad int")
    got = series.run_summary(series.islands(rows, "g", ["t"], F.col("bad") == 1), "g").first()
    assert (got.n_bad, got.n_runs, got.longest, got.longest_first) == (5, 3, 2, 0)
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate([4.0, 1.0, float("nan"), 3.0])], "g string, t int, v double")
    assert [r.v for r in series.substituted(rows, "g", ["t"], "v").orderBy("t").collect()] == [4, 1, 1, 3]


def test_draws_are_reproducible(spark):
    rows = [(m, f, f % 2, s, s * 100 + f) for m in (5, 10) for f in range(4) for s in range(3)]
    t = spark.createDataFrame(rows, "magnification int, fine_cluster_id int, coarse_cluster_id int, slide_id int, packed_row_index int")
    r = index.fine_records(t)
    a = index.draws(spark, t, r, 50, {5: 0.5, 10: 0.5}, {"random": 1.0}).orderBy("draw").collect()
    b = index.draws(spark, t, r, 30, {5: 0.5, 10: 0.5}, {"random": 1.0}, start=20).orderBy("draw").collect()
    assert len(a) == 50 and a[20:] == b
    assert set(index.violations(r, index.slide_groups(t)).first()) == {0}


def test_checks(spark):
    a = spark.createDataFrame([(1, 2)], "k int, v int")
    b = spark.createDataFrame([(1, 2), (2, 3)], "k int, v int")
    got = checks.all_of([checks.same_keys("s", a, b, ["k"]), checks.unique("u", b, ["k"])]).collect()
    assert [(r.name, r.passed, r.violations) for r in got] == [("s", False, 1), ("u", True, 0)]
    assert tuple(buckets.unmatched(a, b, ["k"]).first()) == (0, 1, 0)


def test_samplers(spark):
    rows = spark.range(20).withColumnRenamed("id", "i")
    assert [r.i for r in index.sampler("sequential", rows, "i", rank=1, world=5).collect()] == [1, 6, 11, 16]
    parts = [r.i for k in range(3) for r in index.sampler("epoch", rows, "i", seed=3, epoch=2, rank=k, world=3).collect()]
    assert sorted(parts) == list(range(20))
    order = lambda **o: [r.i for r in index.sampler("epoch", rows, "i", **o).collect()]
    assert [len(order(rank=k, world=3, epoch=1)) for k in range(3)] == [7, 7, 6]
    whole = order(epoch=1)
    assert whole[1::3] == order(rank=1, world=3, epoch=1) and whole != order(epoch=2) and order(epoch=2, seed=3) == order(epoch=3, seed=2)
    more = collections.Counter(order(size=47, epoch=4))
    assert sum(more.values()) == 47 and all(more[i] == (3 if i < 7 else 2) for i in range(20))
    assert sorted(order(size=5)) == list(range(5)) and order(size=0) == []
    records = {"n": 5, "magnifications": {5: 1.0}, "buckets": {"random": 1.0}}
    cells = spark.createDataFrame([(5, f, f % 2, s, s * 100 + f) for f in range(4) for s in range(3)], "magnification int, fine_cluster_id int, coarse_cluster_id int, slide_id int, packed_row_index int")
    assert index.sampler("hierarchical", cells, "packed_row_index", records=index.fine_records(cells), **records).count() == 5
    a = {r.draw: r.i for r in index.sampler("infinite", rows, "i", seed=1, n=30).collect()}
    b = {r.draw: r.i for r in index.sampler("infinite", rows, "i", seed=1, start=10, n=20).collect()}
    assert all(a[k] == v for k, v in b.items())
    with pytest.raises(ValueError):
        index.sampler("sequential", rows, "i", seed=1)
    old = spark.createDataFrame([(1, 2, 3, 1)], "x int, y int, slide_id int, level int")
    assert index.entries_of(old).first().patch_size_level0 == 512
