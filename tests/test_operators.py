"""Operators that SQL can't express, against numpy and against what must hold of them; and edge cases of the others."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.frames import Dataset
from quillon.functions import special
from quillon.functions.checks import need_choice, need_column
from quillon.operators import annotate, cluster, compare, curate, decompose, doublets, graph, hierarchy, integrate, layout, markers, normalize, qc, select, subset
from quillon.plans import process
from quillon.plans.steps import Steps
from quillon.sources import store


def dataset(spark, counts: np.ndarray, labels=None) -> Dataset:
    i, j = np.nonzero(counts)
    x = spark.createDataFrame([(int(a), int(b), float(counts[a, b])) for a, b in zip(i, j)], "cell_id long, gene_id long, value double")
    cells = spark.createDataFrame([(c, f"c{c}", None if labels is None else labels[c]) for c in range(counts.shape[0])], "cell_id long, cell_name string, cluster string")
    genes = spark.createDataFrame([(g, f"{'MT-' if g < 2 else 'g'}{g}") for g in range(counts.shape[1])], "gene_id long, gene_name string")
    return Dataset(x, cells, genes)


@pytest.fixture(scope="module")
def counts():
    rng = np.random.default_rng(0)
    c = rng.poisson(1.0, (60, 30)).astype(float)
    c[:20, 5:8] += rng.poisson(8, (20, 3))
    c[20:40, 10:13] += rng.poisson(8, (20, 3))
    c[59] = 0  # a cell with no counts
    c[:, 29] = 0  # a gene no cell expresses
    return c


@pytest.fixture(scope="module")
def labels():
    return [["a", "b", "c"][c // 20] for c in range(58)] + ["lone", None]


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 6, (5, 8))
    v = np.concatenate([c + rng.normal(0, 1, (60, 8)) for c in centres])
    v[1] = v[0]  # a repeated point
    return v, spark.createDataFrame([(i, [float(a) for a in row], str(i // 60)) for i, row in enumerate(v)], "cell_id long, v array<double>, label string").cache()


@pytest.fixture(scope="module")
def weights(spark, points):
    return Steps(spark, "test").keep(graph.symmetrize(graph.smooth_weights(graph.exact_neighbors(points[1]))))


def test_qc_counts_empty_cells_and_genes(spark, counts):
    ds = qc.qc_metrics(dataset(spark, counts))
    cells = {r.cell_id: r for r in ds.cells.collect()}
    assert cells[59].n_counts == 0 and cells[59].pct_counts_mt == 0
    assert all(cells[c].n_counts == counts[c].sum() and cells[c].n_genes == (counts[c] > 0).sum() for c in range(60))
    genes = {r.gene_id: r for r in ds.genes.collect()}
    assert genes[29].n_cells == 0 and math.isclose(genes[7].mean_counts, counts[:, 7].mean())


def test_no_mitochondrial_genes_no_column(spark, counts):
    assert "pct_counts_mt" not in qc.qc_metrics(dataset(spark, counts), "none-").cells.columns
    with pytest.raises(ValueError, match="pct_counts_mt"):
        subset.filter_cells(dataset(spark, counts), max_pct_mt=5)


def test_moments_count_zeros(spark, counts):
    rows = {r.gene_id: r for r in qc.gene_moments(dataset(spark, counts)).collect()}
    for g in range(30):
        assert math.isclose(rows[g]["mean"], counts[:, g].mean(), abs_tol=1e-12) and math.isclose(rows[g]["var"], counts[:, g].var(ddof=1), abs_tol=1e-9)


def test_empty_tables(spark, counts):
    ds = dataset(spark, counts)
    empty = ds.with_frames(x=ds.x.limit(0), cells=ds.cells.limit(0), genes=ds.genes.limit(0))
    assert qc.qc_metrics(empty).cells.count() == 0 and qc.gene_moments(empty).count() == 0
    assert markers.against_rest(empty).count() == 0 and qc.cluster_means(empty).count() == 0
    assert select.variable_genes(empty, 5).count() == 0 and normalize.normalize_total(empty).x.count() == 0


def test_markers_skip_lone_groups_and_unlabelled_cells(spark, counts, labels):
    ds = normalize.log_transform(normalize.normalize_total(dataset(spark, counts, labels)))
    found = markers.against_rest(ds)
    assert {r[0] for r in found.select("cluster").distinct().collect()} == {"a", "b", "c"}
    best = {r.cluster: r.gene_id for r in found.where("rank = 1").collect()}
    assert best["a"] in (5, 6, 7) and best["b"] in (10, 11, 12)
    assert found.where("gene_id = 29").count() == 0  # no spread
    with pytest.raises(KeyError, match="did you mean"):
        markers.against_group(ds, "aa")


def test_adjusted_p_are_monotone(spark, counts, labels):
    rows = markers.against_rest(dataset(spark, counts, labels)).where("cluster = 'a'").orderBy("p").collect()
    p, q = np.array([r.p for r in rows]), np.array([r.padj for r in rows])
    assert (np.diff(q) >= -1e-12).all() and np.allclose(q, special.bh(p))


def test_special_functions():
    assert math.isclose(special.student_two_sided(2.0, 10), 0.07338803, rel_tol=1e-6)
    assert math.isclose(special.student_two_sided(1.0, 1), 0.5, rel_tol=1e-9)
    assert math.isclose(special.digamma(1), -0.5772156649, rel_tol=1e-7) and math.isclose(special.trigamma(1), math.pi**2 / 6, rel_tol=1e-7)
    assert all(math.isclose(special.trigamma(special.inverse_trigamma(y)), y, rel_tol=1e-6) for y in (1e-3, 0.1, 1.0, 30.0))


def test_components_equal_dense_decomposition(spark, counts):
    x = counts - counts.mean(axis=0)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    for limit in (4096, 0):
        emb, load, var = decompose.pca(dataset(spark, counts), 5, gram_genes=limit)
        assert np.allclose([r.variance for r in var.orderBy("component").collect()], s[:5] ** 2 / 59, rtol=1e-4)
        v = np.array([r.loading for r in load.orderBy("gene_id").collect()])
        assert np.abs(np.abs((v * vt[:5].T).sum(axis=0)) - 1).max() < 1e-3
        scores = np.array([r.v for r in emb.orderBy("cell_id").collect()])
        assert scores.shape == (60, 5) and np.allclose(scores, x @ v, atol=1e-6)


def test_scaled_components_with_clipping(spark, counts):
    sd = np.where(counts.std(axis=0, ddof=1) > 0, counts.std(axis=0, ddof=1), 1)
    z = np.clip((counts - counts.mean(axis=0)) / sd, -2, 2)
    emb, load, _ = decompose.pca(dataset(spark, counts), 3, scale=True, max_value=2.0)
    v = np.array([r.loading for r in load.orderBy("gene_id").collect()])
    assert np.allclose(np.array([r.v for r in emb.orderBy("cell_id").collect()]), z @ v, atol=1e-6)


def test_neighbors_exact_and_by_descent(spark, points):
    v, emb = points
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    exact = {}
    for r in graph.exact_neighbors(emb, 10).collect():
        exact.setdefault(r.src, set()).add(r.dst)
    assert all(len(exact[i]) == 9 and np.isclose(sorted(d[i, j] for j in exact[i]), np.sort(d[i])[:9]).all() for i in range(300))
    near = {}
    for r in graph.descent(emb, Steps(spark, "t"), 10).collect():
        near.setdefault(r.src, set()).add(r.dst)
    assert np.mean([len(exact[i] & near[i]) / 9 for i in range(300)]) >= 0.95


def test_descent_in_many_groups_keeps_every_cell(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([c + rng.normal(0, 1, (250, 8)) for c in rng.normal(0, 6, (8, 8))])
    v[:300] = v[0]  # copies, which no plane parts, in more than one group's bound
    emb = spark.createDataFrame([(i, [float(a) for a in row]) for i, row in enumerate(v)], "cell_id long, v array<double>")
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    far = np.sort(d, axis=1)[:, 8]
    # 128 groups a tree, as two million cells have by default
    rows = graph.descent(emb, Steps(spark, "t"), 10, most=16).collect()
    found = {}
    for r in rows:
        assert np.isclose(r.dist, d[r.src, r.dst], atol=1e-9)
        found.setdefault(r.src, set()).add(r.dst)
    assert all(len(found.get(i, ())) == 9 for i in range(2000))
    assert np.mean([r.dist <= far[r.src] + 1e-9 for r in rows]) >= 0.95


def test_smooth_weights_add_up(points):
    rows = graph.smooth_weights(graph.exact_neighbors(points[1], 15), 15).groupBy("src").agg(F.sum("w").alias("s")).collect()
    assert np.allclose([r.s for r in rows], np.log2(15), atol=1e-3)


def test_communities_find_the_groups(spark, points, weights):
    cells, truth = points[1].select("cell_id"), points[1].select("cell_id", "label")
    q = {}
    for method, limit in (("leiden", 10**9), ("fast", 10**9), ("leiden", 0)):
        found = cluster.communities(weights, cells, Steps(spark, "t"), method=method, one_task=limit)
        assert found.count() == 300
        got = curate.agreement(curate.contingency(found, truth)).first()
        assert got.ari > 0.9, (method, limit, got)
        q[method, limit] = graph.modularity(weights, found).first().quality
    assert q["leiden", 10**9] >= q["fast", 10**9] - 0.01


def test_leiden_communities_are_connected(weights):
    t = weights.toPandas()
    label = cluster.leiden_labels(t.src.to_numpy(), t.dst.to_numpy(), t.w.to_numpy(), 300)
    for c in np.unique(label):
        mine = set(np.flatnonzero(label == c).tolist())
        seen, stack = set(), [min(mine)]
        while stack:
            u = stack.pop()
            if u not in seen:
                seen.add(u)
                stack += [w for w in t.dst[t.src == u] if w in mine]
        assert seen == mine


def test_hierarchy_by_hand():
    # Two pairs joined weakly: the pairs merge first.
    src, dst = np.array([0, 1, 2, 3, 1, 2]), np.array([1, 0, 3, 2, 2, 1])
    w = np.array([4.0, 4, 4, 4, 1, 1])
    m = hierarchy.paris(src, dst, w, 4)
    assert m[:2, :2].tolist() == [[0, 1], [2, 3]] and m[2, 3] == 4
    assert hierarchy.cut_straight(m, 4, 2).tolist() == [0, 0, 1, 1]
    assert len(set(hierarchy.cut_balanced(m, 4, max_size=2))) == 2
    apart = hierarchy.paris(np.array([0, 1, 2, 3]), np.array([1, 0, 3, 2]), np.ones(4), 4)
    assert np.isinf(apart[2, 2])


def test_hierarchy_cut_finds_the_groups(points, weights):
    found = hierarchy.cut(weights, n_clusters=5)
    assert curate.agreement(curate.contingency(found, points[1].select("cell_id", "label"))).first().ari > 0.8
    assert hierarchy.dendrogram(weights).count() == 299


def test_pseudotime_equals_dijkstra(spark, points):
    import heapq

    knn = graph.exact_neighbors(points[1], 5)
    rows = knn.collect()
    near: dict = {}
    for r in rows:
        near.setdefault(r.src, {})[r.dst] = min(r.dist, near.get(r.src, {}).get(r.dst, 9e9))
        near.setdefault(r.dst, {})[r.src] = min(r.dist, near.get(r.dst, {}).get(r.src, 9e9))
    far, heap = {}, [(0.0, 0)]
    while heap:
        x, u = heapq.heappop(heap)
        if u not in far:
            far[u] = x
            for v, w in near[u].items():
                heapq.heappush(heap, (x + w, v))
    longest = max(far.values())
    for r in graph.pseudotime(knn, 0, Steps(spark, "t")).collect():
        assert (r.pseudotime is None) == (r.cell_id not in far)
        assert r.pseudotime is None or math.isclose(r.pseudotime, far[r.cell_id] / longest, abs_tol=1e-9)


def test_layout_keeps_groups_apart(points, weights):
    rows = layout.umap(weights, epochs=120).orderBy("cell_id").toPandas()
    xy, label = rows[["x", "y"]].to_numpy(), np.arange(300) // 60
    d = ((xy[:, None] - xy[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :10]
    assert (label[near] == label[:, None]).mean() > 0.85


def test_harmony_closes_the_gap_between_batches(spark):
    rng = np.random.default_rng(2)
    kind, batch = rng.integers(0, 3, 300), rng.integers(0, 2, 300)
    v = np.eye(6)[kind] * 8 + rng.normal(0, 0.5, (300, 6)) + batch[:, None] * np.array([0, 0, 0, 3, 0, 0])
    emb = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(v)], "cell_id long, v array<double>")
    frame = lambda x: spark.createDataFrame([(i, str(b)) for i, b in enumerate(x)], "cell_id long, label string")
    fixed = integrate.harmony(emb, frame(batch).withColumnRenamed("label", "batch"), Steps(spark, "t"), n_clusters=3, max_iter=4)
    assert fixed.count() == 300
    assert integrate.batch_gap(fixed, frame(batch)) < 0.4 * integrate.batch_gap(emb, frame(batch))
    assert integrate.batch_gap(fixed, frame(kind)) > 0.7 * integrate.batch_gap(emb, frame(kind))


def test_integration_chooses_shared_genes_only(spark, monkeypatch):
    rng = np.random.default_rng(3)
    c = rng.poisson(3.0, (60, 12)).astype(float) + 1
    c[:30, 0], c[30:, 0] = 0, rng.poisson(60, 30) * (rng.random(30) < 0.5)  # of one batch, and the most variable
    ds = dataset(spark, c, ["a"] * 30 + ["b"] * 30)
    assert select.variable_genes(ds, 4, min_cells=0).where("highly_variable and gene_id = 0").count() == 1
    seen = {}
    monkeypatch.setattr(integrate, "pca", lambda small, k: seen.update(genes=[r[0] for r in small.genes.select("gene_id").collect()], x={r[0] for r in small.x.select("gene_id").collect()}) or decompose.pca(small, k))
    assert integrate.integrate_datasets(ds, "cluster", Steps(spark, "t"), 4, 3).count() == 60
    assert len(seen["genes"]) == 4 and 0 not in seen["genes"] and seen["x"] == set(seen["genes"])


def test_doublets_outrank_singlets(spark):
    rng = np.random.default_rng(3)
    base = np.full((3, 90), 0.2)
    for k in range(3):
        base[k, 30 * k : 30 * k + 30] = 4
    single = np.concatenate([rng.poisson(base[k], (100, 90)) for k in range(3)])
    double = np.concatenate([rng.poisson(base[a] + base[b], (8, 90)) for a, b in ((0, 1), (0, 2), (1, 2))])
    ds = dataset(spark, np.concatenate([single, double]).astype(float))
    s = np.array([r.score for r in doublets.scrublet(ds).orderBy("cell_id").collect()])
    assert np.mean(s[300:, None] > s[None, :300]) > 0.9
    few = doublets.scrublet(dataset(spark, single[:5].astype(float))).collect()
    assert all(r.score is None for r in few)


def test_pseudobulk_model_orders_planted_changes(spark):
    """Four groups of unpaired samples with unlike depths; in one group three genes change by known folds, up and down, in another none does."""
    rng = np.random.default_rng(41)
    fold = {("g1", 3): 6.0, ("g1", 7): 3.0, ("g1", 11): 1 / 5}
    level = rng.lognormal(1.2, 0.8, 48)
    rows, cells, i = [], [], 0
    for sample in range(9):
        state = ("rest", "salt", "heat")[sample % 3]
        own = level * rng.lognormal(0, 0.12, 48) * (0.6 + 0.15 * sample)
        for group in ("g0", "g1"):
            for _ in range(11 + sample):
                change = np.array([fold.get((group, g), 1.0) if state == "heat" else 1.0 for g in range(48)])
                rows += [(i, g, float(x)) for g, x in enumerate(rng.poisson(own * change)) if x]
                cells.append((i, group, state, f"s{sample}"))
                i += 1
    ds = Dataset(spark.createDataFrame(rows, "cell_id long, gene_id long, value double"), spark.createDataFrame(cells, "cell_id long, cluster string, condition string, sample string"), spark.createDataFrame([(g, f"g{g}") for g in range(48)], "gene_id long, gene_name string"))
    found = {(r.cluster, r.condition, r.gene_id): r for r in compare.compare_pseudobulk(ds, "condition", "rest", "cluster", "sample").collect()}
    for (group, gene), times in fold.items():
        row = found[group, "heat", gene]
        assert abs(row.lfc - np.log2(times)) < 0.6 and row.padj < 0.02 and found[group, "salt", gene].padj > 0.02
    assert sum(r.padj < 0.02 for k, r in found.items() if (k[0], k[2]) not in fold) <= 2


def test_student_p_of_arrays_equals_one_by_one():
    rng = np.random.default_rng(0)
    t, df = np.concatenate([rng.normal(0, 4, 400), [0, 50, -50, np.nan, 1, 2]]), np.concatenate([rng.gamma(1, 30, 400) + 0.1, [3, 3, 900, 5, np.inf, 0]])
    plain = [special.student_two_sided(a, b) for a, b in zip(t, df)]
    assert np.allclose(special.student_two_sided_all(t, df), plain, rtol=1e-9, atol=1e-300)
    x = np.concatenate([rng.gamma(0.5, 1, 50) + 1e-3, rng.gamma(2, 200, 50)])
    assert np.allclose(special.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)


def test_v_scores_and_valleys():
    rng = np.random.default_rng(3)
    mean = rng.lognormal(0, 1.5, 3000)
    var = mean * 1.3 + 0.2 * mean**2
    noisy = var * rng.lognormal(0, 0.05, 3000)
    noisy[:30] *= 8
    v = doublets.v_scores(mean, noisy)
    assert (np.argsort(-v)[:30] < 30).sum() >= 28 and abs(np.median(v[30:]) - 1) < 0.35
    both = np.concatenate([rng.normal(0.2, 0.03, 4000), rng.normal(0.6, 0.05, 2000)])
    assert 0.3 < doublets.valley(both) < 0.5
    assert 0.3 < doublets.valley(np.concatenate([both, [3.0, 3.01, 3.02]])) < 0.5
    assert doublets.valley(np.full(10, 0.3)) == pytest.approx(0.3)
    assert abs(doublets.least_at(lambda b: abs(b - 0.37), 0.1) - 0.37) < 1e-4


def test_doublets_need_whole_counts(spark):
    ds = dataset(spark, np.random.default_rng(0).poisson(2.0, (40, 30)).astype(float))
    with pytest.raises(ValueError, match="raw counts"):
        doublets.scrublet(ds.with_frames(x=ds.x.withColumn("value", F.col("value") * 0.7)))


def two_rings(spark):
    """Two rings of forty cells, and vectors that tell them apart."""
    pairs = [(r * 40 + i, r * 40 + (i + k) % 40) for r in range(2) for i in range(40) for k in (1, 2)] + [(0, 40)]
    edges = spark.createDataFrame([(a, b, 1.0) for p in pairs for a, b in (p, p[::-1])], "src long, dst long, w double")
    emb = spark.createDataFrame([(i, [float(i >= 40) * 5, float(np.cos(i)), float(np.sin(i))]) for i in range(80)], "cell_id long, v array<double>")
    return edges, emb


@pytest.mark.parametrize("init", ["leiden", "kmeans", "pca", "array"])
def test_layout_starts(spark, init):
    edges, emb = two_rings(spark)
    given = spark.createDataFrame([(i, float(i // 40) * 9, float(i % 40)) for i in range(80)], "cell_id long, x double, y double")
    out = layout.umap(edges, epochs=60, init=init, emb=emb if init in ("kmeans", "pca") else None, places=given if init == "array" else None, clusters=6).orderBy("cell_id").toPandas()
    xy = out[["x", "y"]].to_numpy()
    assert len(out) == 80 and np.isfinite(xy).all()
    near = np.mean([np.linalg.norm(xy[i] - xy[(i + 1) % 40]) for i in range(39)])
    assert near < np.linalg.norm(xy[:40, None] - xy[None, 40:], axis=2).mean()
    if init != "leiden":
        with pytest.raises(ValueError, match="needs"):
            layout.umap(edges, init=init)


def test_graphs_too_large_for_one_task_are_refused(spark, monkeypatch):
    edges, _ = two_rings(spark)
    monkeypatch.setattr(hierarchy, "ONE_TASK_EDGES", 10)
    for make in (hierarchy.dendrogram, layout.umap, lambda e: hierarchy.cut(e, n_clusters=2)):
        with pytest.raises(ValueError, match="one task"):
            make(edges)


def test_marker_overlap_and_seed_noise(spark):
    matches = spark.createDataFrame([("a", "x", 0.5), ("b", "y", 0.2)], "la string, lb string, jaccard double")
    first = spark.createDataFrame([("a", g, g) for g in range(1, 5)] + [("b", 9, 1)], "cluster string, gene_id long, rank int")
    second = spark.createDataFrame([("x", g, g - 2) for g in range(3, 7)], "cluster string, gene_id long, rank int")
    got = {r.la: r.markers for r in curate.marker_overlap(matches, first, second).collect()}
    assert got == {"a": 2 / 6, "b": None}
    assert {r.la: r.markers for r in curate.marker_overlap(matches, first, second, 3).collect()}["a"] == 1 / 5
    labels = lambda s: spark.createDataFrame([(i, str((i + s) // 10 % 3)) for i in range(30)], "cell_id long, label string")
    assert curate.seed_noise(labels, [0, 30]) == 1.0 and curate.seed_noise(labels, [0, 5]) < 1


def test_formats_are_told_by_content(spark, tmp_path, counts, labels):
    ds = dataset(spark, counts, labels)
    from quillon.sources import h5, mtx

    h5.write_h5ad(ds, str(tmp_path / "matrix.dat"))
    mtx.write_mtx(ds.with_frames(cells=ds.cells.where("cell_id <> 59")), str(tmp_path / "folder"))
    store.save(ds, str(tmp_path / "saved.h5"), {})
    assert [store.sniff_content(spark, str(tmp_path / p)) for p in ("matrix.dat", "folder", "saved.h5")] == ["h5ad", "mtx", "folder"]
    want = sorted(map(tuple, ds.x.where("cell_id <> 59").select("cell_id", "gene_id", "value").collect()))
    for name in ("matrix.dat", "saved.h5"):
        assert sorted(map(tuple, store.open_any(spark, str(tmp_path / name)).x.select("cell_id", "gene_id", "value").collect())) == want
    with pytest.raises(FileNotFoundError):
        store.sniff_content(spark, str(tmp_path / "none"))


def test_tmm_and_filter():
    rng = np.random.default_rng(5)
    base = rng.poisson(50, (200, 1)) * np.array([[1, 2, 3, 1]])
    assert np.allclose(compare.tmm(base.astype(float)), 1, atol=0.05)
    assert compare.expressed(np.array([[100.0, 100], [0, 0], [100, 120]]), np.array(["a", "b"])).tolist() == [True, False, True]


def test_lowess_follows_a_line():
    x = np.linspace(0, 1, 80)
    y = 2 * x + 1
    y[40] += 5
    assert np.abs(select.lowess(x, y, 0.3, 5) - (2 * x + 1)).max() < 0.05


def test_curation_errors(spark):
    labels = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "cell_id long, label string")
    assert [r.label for r in curate.annotate(labels, {"x": ["a", "b"]}).orderBy("cell_id").collect()] == ["x", "x", "c", None]
    for groups in ([["a"]], [["a", "b"], ["b", "c"]]):
        with pytest.raises(ValueError):
            curate.merge_clusters(labels, groups)
    with pytest.raises(KeyError, match="did you mean"):
        curate.merge_clusters(labels, [["a", "bb"]])
    same = labels.where("label is not null")
    got = curate.agreement(curate.contingency(same, same)).first()
    assert got.ari == 1 and math.isclose(got.nmi, 1)


def test_annotation_with_an_ontology(spark):
    tree = spark.createDataFrame([("t", "lymph"), ("b", "lymph"), ("lymph", "cell"), ("mono", "cell")], "term string, parent string")
    got = {(r.a, r.b): r.ancestor for r in annotate.common_ancestors(tree).collect()}
    assert got["t", "b"] == "lymph" and got["t", "mono"] == "cell" and got["t", "t"] == "t" and got["t", "lymph"] == "lymph"


def test_subset_names_and_views(spark, counts, weights):
    ds = dataset(spark, counts)
    small = subset.subset(ds, cells=["c1", "c3"], genes=["g5", "g6"])
    assert small.cells.count() == 2 and small.genes.count() == 2
    with pytest.raises(KeyError, match="did you mean 'c5'"):
        subset.subset(ds, cells=["cc5"])
    kept = subset.keep_cells(ds.with_edges("knn", weights), "cell_id < 10")
    assert kept.edges["knn"].where("src >= 10 or dst >= 10").count() == 0


def test_save_load_and_moved_sources(spark, counts, tmp_path):
    ds = normalize.normalize_total(dataset(spark, counts))
    source = str(tmp_path / "source")
    ds.cells.write.parquet(source)
    store.save(ds, str(tmp_path / "saved"), {"cells": source})
    back = store.load(spark, str(tmp_path / "saved"))
    assert back.x.count() == ds.x.count() and back.raw.agg(F.sum("value")).first()[0] == counts.sum()
    spark.range(10).write.mode("append").parquet(source)
    with pytest.raises(store.SourceMovedError):
        store.load(spark, str(tmp_path / "saved"))


def test_merge_errors(spark):
    names = spark.createDataFrame([(0, 0, "a"), (1, 0, "b")], "file int, pos int, gene_name string")
    with pytest.raises(ValueError):
        store.merged_genes(names).count()
    twice = spark.createDataFrame([(0, 0, "a"), (0, 1, "a")], "file int, pos int, gene_name string")
    with pytest.raises(ValueError, match="twice"):
        store.merged_genes(twice)


def test_project_folder(spark, tmp_path):
    p = store.Project(spark, str(tmp_path))
    spark.range(3).write.parquet(p.run_dir("one"))
    assert p.status() == {"runs": 1, "results": 0}
    p.clean("runs")
    assert p.status()["runs"] == 0


def test_whole_process(spark, counts):
    ds = process.process(dataset(spark, counts), Steps(spark, "t"), n_top=15, floor=0, components=5)
    assert ds.cells.count() == 59 and ds.cells.where("leiden is null").count() == 0  # the empty cell went
    assert process.max_cells(8000, 20_000) > process.max_cells(1000, 20_000) > 0


def test_whole_queries_leave_nothing_out(spark, sf):
    from quillon import catalog

    table = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    n, labels = table("embeddings").agg(F.count("*"), F.count_distinct("label")).first()
    assert catalog.QUERIES["a10_distances_in_plan"](spark, sf).select("cell_id", "label").distinct().count() == n * labels
    assert catalog.QUERIES["c1_marker_weights"](spark, sf).select("cell_type").distinct().count() == table("part").select("p_type").distinct().count()
    assert catalog.QUERIES["d3_adjusted_p"](spark, sf).where("padj >= 0.5").count() > 0


def test_registered_queries_take_the_defaults(spark, sf, monkeypatch):
    from quillon import catalog

    seen = []
    monkeypatch.setattr(layout, "umap", lambda edges, epochs=None, **k: seen.append(epochs) or edges)
    monkeypatch.setattr(integrate, "harmony", lambda emb, *a, **k: seen.append(k.get("max_iter")) or emb)
    monkeypatch.setattr(select, "lowess", lambda m, v, frac, passes: seen.append(passes) or v)
    for name in ("g12_layout", "g13_multilevel_layout", "r4_harmony", "h3_lowess_genes"):
        catalog.QUERIES[name](spark, sf)
    assert seen == [None, None, None, 100]


def test_checks(spark):
    with pytest.raises(KeyError, match="did you mean 'id'"):
        need_column(spark.range(1), "idd")
    with pytest.raises(ValueError, match="did you mean"):
        need_choice("cosin", ("cosine",), "metric")


def test_plans_push_down_and_prune(spark, sf):
    """A two-column statistic reads the columns it needs, and filters reach the scan."""
    from quillon.adapters import cust_part

    ds = cust_part(spark, sf)
    plan = subset.keep_cells(ds, "cell_id < 10").x._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "o_totalprice" not in plan
    assert "LessThan" in plan


def test_diffusion_map_of_a_slowly_mixing_graph(spark):
    n = 600
    ring = [(i, (i + step) % n, 1.0) for i in range(n) for step in (1, -1)]
    emb, values = decompose.diffusion_map(spark.createDataFrame(ring, "src long, dst long, w double"), 3)
    assert np.allclose(values, np.cos(2 * np.pi * np.array([1, 1, 2]) / n), atol=1e-12)
    v = np.array([r.v for r in emb.orderBy("cell_id").collect()])
    assert np.allclose((np.roll(v, 1, axis=0) + np.roll(v, -1, axis=0)) / 2, v * values, atol=1e-7)


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_nearest_of_blocks_with_copies_and_far_points(metric):
    rng = np.random.default_rng(3)
    v = np.concatenate([np.repeat(rng.normal(size=(4, 5)), 9, axis=0), rng.normal(size=(60, 5)), 1e6 + rng.normal(size=(20, 5)), [[np.nan] * 5], [[1e200] * 5], [[0.0] * 5]])
    ids = rng.permutation(len(v))
    near = graph.Nearest(ids[:50], v[:50], 6, metric)
    for at in np.array_split(np.arange(len(v)), 5):
        near.meet(ids[at], v[at])
    found = near.found().to_pandas()
    for i in range(50):
        d = np.sqrt(((v - v[i]) ** 2).sum(axis=1)) if metric == "euclidean" else 1 - (v @ v[i]) / np.maximum(np.linalg.norm(v, axis=1) * np.linalg.norm(v[i]), 1e-300)
        ok = np.isfinite(d) & (ids != ids[i])
        order = np.lexsort((ids[ok], np.round(d[ok], 9)))[:6]
        mine = found[found.src == ids[i]]
        assert mine.dst.tolist() == ids[ok][order].tolist() and np.allclose(mine.dist, d[ok][order], atol=1e-9)


def test_louvain_rounds_are_nearly_as_modular_as_leiden(spark):
    v = np.random.default_rng(8).normal(size=(400, 6))  # without groups, where moves all at once go wrong most
    d = ((v[:, None] - v[None]) ** 2).sum(-1)
    pairs = {(int(min(i, j)), int(max(i, j))) for i in range(400) for j in np.argsort(d[i])[1:9]}
    edges = spark.createDataFrame([(a, b, 1.0) for i, j in pairs for a, b in ((i, j), (j, i))], "src long, dst long, w double").coalesce(1).cache()
    steps = Steps(spark, "louvain")
    quality = [graph.modularity(edges, steps.keep(cluster.communities(edges, spark.range(400).withColumnRenamed("id", "cell_id"), steps, one_task=at))).first().quality for at in (0, 1 << 20)]
    assert quality[0] > 0.97 * quality[1]


def test_doublets_of_many_genes_take_memory_by_entries():
    import tracemalloc

    rng = np.random.default_rng(2)
    n, m, per = 400, 400_000, 200
    row, col = np.repeat(np.arange(n), per), np.concatenate([np.sort(rng.choice(m // 100, per, replace=False)) for _ in range(n)]) * 100
    tracemalloc.start()
    score, fake, cut = doublets.score_batch(row, col, rng.integers(1, 9, len(row)).astype(float), n, m)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < n * m * 8 / 4 and len(score) == n and len(fake) == 2 * n and (score >= 0).all()


@pytest.mark.parametrize("n, m, small", [(90, 300, 2048), (300, 90, 2048), (300, 260, 0)])
def test_leading_vectors_of_entries_equal_dense_decomposition(n, m, small):
    rng = np.random.default_rng(4)
    x = rng.poisson(rng.gamma(0.5, 1, (n, 6)) @ rng.gamma(0.5, 1, (6, m))).astype(float)
    row, col = np.nonzero(x)
    shift, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    d = (x - shift) / scale
    q = doublets.leading(doublets.Sparse(row, col, x[row, col], n, m, shift, scale), 4, 0, small=small)
    _, s, v = np.linalg.svd(d, full_matrices=False)
    assert np.allclose(np.linalg.norm(d @ q, axis=0), s[:4], rtol=1e-6) and np.allclose(np.abs((q * v[:4].T).sum(axis=0)), 1, atol=1e-4)


def test_components_of_many_genes_take_no_product_of_all_columns(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.poisson(rng.gamma(0.3, 1, (50, 5)) @ rng.gamma(0.3, 0.3, (5, 5000))).astype(float)
    monkeypatch.setattr(decompose, "gram_partials", None)
    monkeypatch.setattr(decompose, "SLICE", 8 * 5000 * 6)  # thirteen columns in three slices
    emb, load, var = decompose.pca(dataset(spark, x), 3, seed=1, rounds=12)  # more vectors than the matrix has rank
    s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)
    assert np.allclose([r.variance for r in var.orderBy("component").collect()], s[:3] ** 2 / 49, rtol=1e-9)
    v = np.array([r.loading for r in load.orderBy("gene_id").collect()])
    assert v.shape == (5000, 3) and np.allclose(v.T @ v, np.eye(3), atol=1e-9)


def test_copies_are_searched_and_divided_once(spark):
    rng = np.random.default_rng(11)
    v = np.concatenate([c + rng.normal(0, 1, (40, 5)) for c in rng.normal(0, 5, (3, 5))])
    v = v[rng.permutation(np.concatenate([np.arange(120), np.full(150, 3), np.full(9, 50), np.full(14, 70)]))]
    emb = spark.createDataFrame([(i, [float(a) for a in row]) for i, row in enumerate(v)], "cell_id long, v array<double>")
    knn, fuzzy, labels = process.divide(emb, Steps(spark, "t"), 10)
    exact = graph.exact_neighbors(emb, 10)
    rows = lambda df: sorted((r.src, r.dst, r["rank"], round(r.dist, 9)) for r in df.collect())
    assert rows(knn) == rows(exact)
    edges = graph.symmetrize(graph.smooth_weights(exact, 10))
    weight = lambda df: {(r.src, r.dst): round(r.w, 6) for r in df.collect()}
    assert weight(fuzzy) == weight(edges)
    plain = cluster.communities(edges, emb.select("cell_id"), Steps(spark, "t"))
    quality = [graph.modularity(edges, x).first().quality for x in (labels, plain)]
    assert labels.count() == len(v) and quality[0] >= quality[1] - 0.01
    sizes = [r.n for r in labels.groupBy("label").agg(F.count("*").alias("n")).orderBy("label").collect()]
    assert sizes == sorted(sizes, reverse=True)


def test_many_cells_of_few_scores_need_no_descent(spark, monkeypatch):
    monkeypatch.setattr(graph, "descent", lambda *a, **k: pytest.fail("for 10,400 cells with few different scores"))
    rng = np.random.default_rng(3)
    entries = [(i, int(g), float(c)) for i in range(10_400) for g, c in ((100 + i % 2, 1), *(((rng.integers(20), rng.integers(1, 9)),) if i < 300 else ()))]
    x = spark.createDataFrame(entries, "cell_id long, gene_id long, value double")
    ds = Dataset(x, spark.range(10_401).withColumnRenamed("id", "cell_id"), spark.range(120).withColumnRenamed("id", "gene_id"))
    out = process.process(ds, Steps(spark, "t"), n_top=20, floor=0, components=5)
    assert out.cells.count() == 10_400 and out.cells.where("leiden is null").count() == 0
    assert out.edges["knn"].count() == 10_400 * 14
    assert out.x.columns == ["cell_id", "gene_id", "value"] and out.counts.agg(F.sum("value")).first()[0] == sum(c for *_, c in entries)


@pytest.mark.parametrize("copied", (0, 60))
def test_descent_goes_on_until_enough_is_found(spark, copied):
    v = np.random.default_rng(2).normal(size=(1500, 64))  # without structure, which few small trees find little of
    v[:copied] = v[0]
    emb = spark.createDataFrame([(i, [float(a) for a in row]) for i, row in enumerate(v)], "cell_id long, v array<double>")
    found, exact = ({(r.src, r.dst) for r in df.collect()} for df in (graph.descent(emb, Steps(spark, "t"), 15, seeds=1, leaf=62, rounds=1), graph.exact_neighbors(emb, 15)))
    assert len(found) == len(exact) == 1500 * 14 and len(found & exact) >= 0.95 * len(exact)
    if copied:
        assert {p for p in found if p[0] < copied} == {p for p in exact if p[0] < copied}


@pytest.mark.parametrize("k", (1, 40, 1099))
def test_marked_ones_near_equal_those_of_all_distances(k):
    from quillon.operators import balls

    rng = np.random.default_rng(8)
    p = np.concatenate([np.repeat(rng.normal(size=(2, 4)), 150, axis=0), rng.standard_cauchy(size=(400, 4)), rng.normal(size=(400, 4)) + 50]).astype(np.float32)
    marked, found = rng.random(len(p)) < 0.6, np.full(len(p), -1.0)
    leaf = balls.leaves(p)
    for part in range(3):
        at, counts = balls.marked_near(p, marked, leaf, k, part, 3)
        found[at] = counts
    d = ((p[:, None].astype(float) - p[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    kth = np.sort(d, axis=1)[:, k - 1 : k]
    nearer, tied = d < kth * (1 - 1e-10), np.abs(d - kth) <= 1e-10 * kth
    assert np.allclose(found, (nearer & marked).sum(axis=1) + (k - nearer.sum(axis=1)) * (tied & marked).sum(axis=1) / tied.sum(axis=1))


def test_batches_in_parts_have_the_scores_of_one_task(spark, monkeypatch):
    x = np.random.default_rng(5).poisson(2.0, (120, 60)).astype(float)
    monkeypatch.setattr(doublets, "SHARE", 50)  # eight tasks for 360 points
    monkeypatch.setattr(doublets, "PIECE", 37)
    found = doublets.scrublet(dataset(spark, x)).orderBy("cell_id").collect()
    row, col = np.nonzero(x)
    score, _, cut = doublets.score_batch(row, col, x[row, col], 120, 60)
    assert np.allclose([r.score for r in found], score) and {r.batch for r in found} == {"all"}
    assert np.allclose([r.threshold for r in found], cut) and [r.doublet for r in found] == [r.score > r.threshold for r in found]
