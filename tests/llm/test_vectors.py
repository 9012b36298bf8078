"""Operators on vectors against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from quillon.llm import lattice, multiindex


def write(spark, path, rows):
    spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 3, 7, 7) for i, v in rows], "vec_id long, embedding array<float>, label int, id int, v int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(700, 24))
    base[300:340] = base[0] + rng.normal(0, 0.12, (40, 24))  # a dense group
    base[340:380] = base[1]  # copies
    base[380] = 3 * base[2]
    out = [(i, base[i].astype(np.float32)) for i in range(700)]
    return out + [(1000, None), (1020, np.zeros(24)), (1040, [float("nan")] * 24), (1060, [1.0] * 23 + [float("inf")]), (1080, [None] * 24), (1100, [1.0] * 5), (1120, [])]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("vec"), rows)


def usable(rows):
    return [(i, np.array(v, np.float64)) for i, v in rows if i < 1000]


def plain_links(rows):
    """(links of each row, component of each row) by all pairs of one length, in extended precision; rows without an id have none."""
    good = [i for i, (k, v) in enumerate(rows) if k is not None and v is not None and len(v) and None not in list(v) and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    n_links, label = [0] * len(rows), [k for k, _ in rows]
    for size in {len(rows[i][1]) for i in good}:
        own = [i for i in good if len(rows[i][1]) == size]
        x = np.array([rows[i][1] for i in own], np.longdouble)
        u = x / np.sqrt((x * x).sum(axis=1))[:, None]
        near = (u @ u.T).astype(float) >= 0.9
        np.fill_diagonal(near, False)
        names = [rows[i][0] for i in own]
        while True:
            new = [min([names[i], *(names[j] for j in np.flatnonzero(near[i]))]) for i in range(len(own))]
            if new == names:
                break
            names = new
        for i, n, name in zip(own, near.sum(axis=1), names):
            n_links[i], label[i] = int(n), name
    return n_links, label


def summary(rows, n_links, label):
    return sorted((str(k), n, str(c), k is not None and k == c) for (k, _), n, c in zip(rows, n_links, label))


def linked(spark, folder):
    return sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in lattice.op3_lattice_hashing(spark, folder).collect())


@pytest.mark.parametrize("block", [2048, 16])
def test_lattice_links(spark, rows, folder, monkeypatch, block):
    monkeypatch.setattr(lattice, "BLOCK", block)
    got, plain = linked(spark, folder), summary(rows, *plain_links(rows))
    assert [g[2:] for g in got] == [p[2:] for p in plain] and [g[0] for g in got] == [p[0] for p in plain]
    assert all(g[1] <= p[1] for g, p in zip(got, plain)) and sum(g[1] for g in got) >= 0.99 * sum(p[1] for p in plain)


def test_lattice_links_of_odd_rows(spark, tmp_path):
    """Repeated ids with different vectors, magnitudes beyond the square root of what doubles hold, vectors of few lengths, no ids."""
    rng = np.random.default_rng(4)
    a, c, e, f = rng.normal(size=(4, 32))
    b = a + 0.05 * rng.normal(size=32)
    rows = [(5, a), (5, c), (7, b), (9, c), (20, 1e200 * e), (21, 1e200 * e + 1e199 * rng.normal(size=32) * 0.5), (22, 1e-200 * e), (23, 5e307 * e / np.abs(e).max()), (30, f[:5]), (31, 2 * f[:5]), (32, f[:1]), (33, -f[:1]), (34, 3 * f[:1]), (None, a), (None, None), (40, a), (40, a), (41, [])]
    spark.createDataFrame([(k, None if v is None else [float(x) for x in v], 3, 7) for k, v in rows], "vec_id long, embedding array<double>, row int, name int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert linked(spark, str(tmp_path)) == summary(rows, *plain_links(rows))


def test_a_cosine_on_the_threshold_links(spark, tmp_path):
    rows = [(1, [10.0, 0.0]), (2, [9.0, 19.0**0.5]), (3, [3.0, 4.0]), (4, [4.0, 3.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert linked(spark, str(tmp_path)) == summary(rows, *plain_links(rows))


def test_nearest_lattice_point():
    rng = np.random.default_rng(1)
    x, near = rng.normal(0, 2, (500, 8)), lattice.minimal_vectors()
    assert len(near) == 240 and np.allclose((near**2).sum(axis=1), 2)
    p = lattice.nearest_e8(x)
    d = ((x - p) ** 2).sum(axis=1)
    assert (d <= 1 + 1e-9).all()  # the covering radius is 1
    assert (((x[:, None] - p[:, None] - near[None]) ** 2).sum(-1).min(axis=1) >= d - 1e-9).all()


def test_pairs_at_the_threshold_meet():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.normal(size=(600, 64))
    y -= (x * y).sum(axis=1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    z = 0.9 * x + np.sqrt(1 - 0.81) * y
    for n in (100, 20_000, 1_000_000):
        tables = lattice.fitting(64, n)
        met = np.zeros(600, bool)
        for t in range(tables.tables):
            p, q = tables.cells(x, t), tables.cells(z, t)
            met |= (p == q[:, :1]).any(axis=1) | (q == p[:, :1]).any(axis=1)
        assert met.mean() > 0.96, n


def test_random_vectors_meet_few_others_whatever_the_size():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    cells = lattice.fitting(64, 1_000_000).every(x)
    pairs = 0
    for t in range(cells.shape[1]):
        _, home, count = np.unique(cells[:, t, 0], return_inverse=True, return_counts=True)
        pairs += int((count * (count - 1)).sum()) + int(np.isin(cells[:, t, 1:], cells[:, t, 0]).sum())
    assert pairs / 6000 / 6000 * 1_000_000 < 300


def plain_search(rows, k=20):
    """(query id, its neighbours' (score, id)) of every query row, over all rows of its length."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and None not in list(v) and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    out = []
    for n, (i, q) in enumerate(good):
        if i % 20 == 0:
            own = sorted((-float((v * q).sum()), j) for m, (j, v) in enumerate(good) if m != n and len(v) == len(q))[:k]
            out.append((i, [(-s, j) for s, j in own]))
    return out


def check_search(rows, found, least):
    """Ranks without gaps, best first; every query row answered in full; returns how many of the true (score, id) were found."""
    plain = plain_search(rows)
    by, wanted, truth = {}, {}, {}
    for r in found:
        by.setdefault(r.query_id, []).append(r)
    for q, near in plain:
        wanted[q] = wanted.get(q, 0) + len(near)
        truth.setdefault(q, []).extend(near)
    assert {q: len(own) for q, own in by.items()} == {q: n for q, n in wanted.items() if n}
    hit = 0
    for q, own in by.items():
        rest = [(round(s, 9), j) for s, j in truth[q]]
        for r in own:
            if (round(r.score, 9), r.vec_id) in rest:
                rest.remove((round(r.score, 9), r.vec_id))
                hit += 1
        per = sum(1 for r in own if r.rank == 1)
        assert sorted(r.rank for r in own) == sorted(list(range(1, len(own) // per + 1)) * per)
        if per == 1:
            own = sorted(own, key=lambda r: r.rank)
            keys = [(-r.score, r.vec_id) for r in own]
            assert keys == sorted(keys)
    assert hit >= least * sum(wanted.values())


@pytest.mark.parametrize("shard", [4096, 64])
def test_search_recall(spark, rows, folder, monkeypatch, shard):
    monkeypatch.setattr(multiindex, "SHARD", shard)
    monkeypatch.setattr(multiindex, "TOGETHER", shard)
    monkeypatch.setattr(multiindex, "CELL", shard // 8)
    check_search(rows, multiindex.op5_inverted_multi_index(spark, folder).collect(), 0.95)


def test_search_with_repeated_ids_and_lengths(spark, tmp_path):
    """Each row of a repeated id is a query with ranks of its own and a candidate, also of its twin; lengths are searched apart."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=12)) for i in range(1, 60)]
    rows += [(20, rng.normal(size=12)), (40, rows[39][1]), (100, rng.normal(size=3)), (101, rng.normal(size=3)), (120, [2.0]), (140, 1e200 * rng.normal(size=12)), (None, rng.normal(size=12))]
    found = multiindex.op5_inverted_multi_index(spark, write(spark, tmp_path, [(i, v if i != 140 else v / 1e200) for i, v in rows])).collect()
    rows = [(i, np.float32(v) if i != 140 else np.float32(v / 1e200)) for i, v in rows]
    check_search(rows, found, 1.0)
    twenty = [r for r in found if r.query_id == 20]
    assert len(twenty) == 40 and [r.vec_id for r in twenty if r.rank == 1].count(20) <= 2
    assert {(r.rank, r.vec_id) for r in found if r.query_id == 100} == {(1, 101)} and not [r for r in found if r.query_id == 120]


def test_traversal_goes_by_summed_distance():
    rng = np.random.default_rng(3)
    sample = rng.normal(size=(400, 10))
    index = multiindex.MultiIndex(sample, 8)
    index.counts = np.bincount(index.cell(sample), minlength=index.cells)
    q = rng.normal(size=10)
    order = index.traverse(q, 400)
    far = -(index.books[0] @ q[:5])[:, None] - (index.books[1] @ q[5:])[None]
    d = far.ravel()[order]
    assert (np.diff(d) >= -1e-12).all() and index.counts[order].sum() == 400
    assert set(order) == set(np.flatnonzero(index.counts).tolist())


def test_few_and_no_vectors(spark, tmp_path):
    few = write(spark, tmp_path / "few", [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, [2.0, 1.0]), (20, [2.0, 1.0])])
    found = multiindex.op5_inverted_multi_index(spark, few).collect()
    assert {(r.query_id, r.rank, r.vec_id) for r in found if r.query_id == 0} == {(0, 1, 1), (0, 2, 20), (0, 3, 20)}
    assert sorted((r.rank, r.vec_id) for r in found if r.query_id == 20) == [(1, 1), (1, 1), (2, 20), (2, 20), (3, 0), (3, 0)]
    linked = lattice.op3_lattice_hashing(spark, few).collect()
    assert len(linked) == 4 and {r.n_links for r in linked if r.vec_id == 20} == {2}
    none = write(spark, tmp_path / "none", [])
    assert multiindex.op5_inverted_multi_index(spark, none).collect() == [] and lattice.op3_lattice_hashing(spark, none).collect() == []
