"""HDF5 files: what is written comes back, whole or in ranges, and the matrix formats made of them."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from quillon.frames import Dataset
from quillon.sources import h5, hdf5, store


def test_round_trip(tmp_path):
    path, rng = str(tmp_path / "a.h5"), np.random.default_rng(0)
    values = {"i": np.arange(1000, dtype=np.int32), "f": rng.normal(size=1000), "g": rng.normal(size=(70, 5)).astype(np.float32), "u": np.arange(9, dtype=np.uint8), "s": np.array(["a", "bé", "long name"]), "none": np.zeros(0)}
    w = hdf5.Writer(path)
    members = {k: w.dataset(v, {"unit": k, "n": np.array([1, 2])}) for k, v in values.items()}
    members |= {f"{k}_chunked": w.dataset(values[k], chunk=64) for k in ("i", "f", "g")}
    inner = w.group({"x": members["i"]}, {"kind": "inner"})
    w.close(w.group({**members, "group": inner}))
    f = hdf5.File(path)
    for k, v in values.items():
        assert (f[k].read() == v).all() and f[k].shape == v.shape and f[k].attrs["unit"] == k and f[k].attrs["n"].tolist() == [1, 2]
    for k in ("i", "f", "g"):
        for low, high in ((0, 10), (60, 70), (63, 65), (0, 10_000), (5, 5)):
            assert (f[f"{k}_chunked"].read(low, high) == values[k][low:high]).all() and (f[k].read(low, high) == values[k][low:high]).all()
    assert (f["group/x"].read() == values["i"]).all() and f["group"].attrs["kind"] == "inner" and "y" not in f["group"]
    with pytest.raises(KeyError, match="there is no 'y'"):
        f["group/y"]


def test_filters_and_variable_strings(tmp_path):
    """Shuffle undone, and strings fetched from a heap, on bytes laid out by hand."""
    path = str(tmp_path / "b.h5")
    w = hdf5.Writer(path)
    x = np.arange(100, 140, dtype=np.int32)
    shuffled = zlib.compress(np.frombuffer(x.tobytes(), np.uint8).reshape(-1, 4).T.tobytes())
    chunk = w.put(shuffled)
    key = struct.pack("<II", len(shuffled), 0) + struct.pack("<QQ", 0, 0)
    tree = w.put(b"TREE" + struct.pack("<BBHQQ", 1, 0, 1, hdf5.NOWHERE, hdf5.NOWHERE) + key + struct.pack("<Q", chunk) + struct.pack("<IIQQ", 0, 0, 40, 0))
    filters = struct.pack("<BB6x", 1, 2) + struct.pack("<HHHHII", 2, 0, 1, 1, 4, 0) + struct.pack("<HHHHII", 1, 0, 1, 1, 4, 0)
    one = w.header([(1, w.space((40,))), (3, w.type(x.dtype)), (0x0B, filters), (8, struct.pack("<BBBQII", 3, 2, 2, tree, 40, 4))])
    texts = ["gene A", "", "é"]
    heap, body = b"", b""
    for i, t in enumerate(texts, 1):
        raw = t.encode()
        heap += struct.pack("<HH4xQ", i, 1, len(raw)) + raw + b"\0" * (-len(raw) % 8)
    at = w.put(b"GCOL" + struct.pack("<B3xQ", 1, 16 + len(heap) + 16) + heap + b"\0" * 16)
    for i, t in enumerate(texts, 1):
        body += struct.pack("<IQI", len(t.encode()), at, i)
    vlen = struct.pack("<BBBBI", 0x19, 1, 1, 0, 16) + struct.pack("<BBBBI", 0x13, 0, 0, 0, 1)
    two = w.header([(1, w.space((3,))), (3, vlen), (8, struct.pack("<BBQQ", 3, 1, w.put(body), len(body)))])
    w.close(w.group({"x": one, "names": two}))
    f = hdf5.File(path)
    assert (f["x"].read(3, 9) == x[3:9]).all() and f["names"].read().tolist() == texts


def matrix(spark):
    rng = np.random.default_rng(1)
    c = rng.poisson(0.3, (50, 20)).astype(float)
    c[49] = 0
    i, j = np.nonzero(c)
    ds = Dataset(
        spark.createDataFrame([(int(a), int(b), float(c[a, b])) for a, b in zip(i, j)], "cell_id long, gene_id long, value double"),
        spark.createDataFrame([(k, f"c{k}", float(k), f"t{k % 3}") for k in range(50)], "cell_id long, cell_name string, score double, kind string"),
        spark.createDataFrame([(k, f"g{k}") for k in range(20)], "gene_id long, gene_name string"),
    )
    return c, ds


def dense(ds, shape):
    out = np.zeros(shape)
    for r in ds.x.collect():
        out[r.cell_id, r.gene_id] = r.value
    return out


def test_annotated_matrix(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(h5, "PART", 40)
    c, ds = matrix(spark)
    h5.write_h5ad(ds, str(tmp_path / "m.h5ad"), chunk=32)
    back = store.open_any(spark, str(tmp_path / "m.h5ad"))
    assert (dense(back, c.shape) == c).all()
    cells = back.cells.orderBy("cell_id").collect()
    assert [r.cell_name for r in cells] == [f"c{k}" for k in range(50)] and cells[7].score == 7.0 and cells[7].kind == "t1"
    assert h5.scan_h5ad(str(tmp_path / "m.h5ad"))["nnz"] == (c > 0).sum()


def test_dense_categorical_and_10x(spark, tmp_path):
    c, _ = matrix(spark)
    w = hdf5.Writer(str(tmp_path / "d.h5ad"))
    kind = w.group({"categories": w.dataset(np.array(["B", "T"])), "codes": w.dataset(np.array([k % 3 - 1 for k in range(50)], np.int8))})
    nullable = w.group({"values": w.dataset(np.arange(50)), "mask": w.dataset(np.array([k == 4 for k in range(50)], np.uint8))})
    obs = w.group({"_index": w.dataset(np.array([f"c{k}" for k in range(50)])), "kind": kind, "count": nullable}, {"_index": "_index"})
    var = w.group({"_index": w.dataset(np.array([f"g{k}" for k in range(20)]))}, {"_index": "_index"})
    w.close(w.group({"X": w.dataset(c, chunk=16), "obs": obs, "var": var}))
    back = h5.read_h5ad(spark, str(tmp_path / "d.h5ad"))
    assert (dense(back, c.shape) == c).all()
    cells = back.cells.orderBy("cell_id").collect()
    assert [r.kind for r in cells[:4]] == [None, "B", "T", None]
    i, j = np.nonzero(c)
    w = hdf5.Writer(str(tmp_path / "t.h5"))
    features = w.group({"id": w.dataset(np.array([f"E{k}" for k in range(20)])), "name": w.dataset(np.array([f"g{k}" for k in range(20)]))})
    m = w.group({"data": w.dataset(c[i, j].astype(np.int32)), "indices": w.dataset(j), "indptr": w.dataset(np.concatenate([[0], np.cumsum((c > 0).sum(axis=1))])), "barcodes": w.dataset(np.array([f"b{k}" for k in range(50)])), "features": features})
    w.close(w.group({"matrix": m}))
    tenx = store.open_any(spark, str(tmp_path / "t.h5"))
    assert (dense(tenx, c.shape) == c).all() and tenx.genes.where("gene_key = 'E3' and gene_name = 'g3'").count() == 1
