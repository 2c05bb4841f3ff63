import numpy as np
import pytest

from panelwright.sources import arrays, readers


def test_row_ranges_of_one_file(spark, tmp_path):
    data = np.random.default_rng(1).normal(size=(5000, 3, 7)).astype("float32")
    np.save(tmp_path / "x.npy", data)
    df = arrays.read_array(spark, str(tmp_path / "x.npy"), split=10_000)
    assert df.rdd.getNumPartitions() > 40
    rows = sorted(df.select("row", "cells").collect())
    assert [r["row"] for r in rows] == list(range(5000))
    np.testing.assert_array_equal(np.array([r["cells"] for r in rows]), data.reshape(5000, -1).astype(float))
    tensor = arrays.read_tensor(spark, str(tmp_path / "x.npy")).where("row = 77").first()["tensor"]
    np.testing.assert_array_equal(np.array(tensor), data[77].astype(float))
    long = readers.tensor_to_long(arrays.read_tensor(spark, str(tmp_path)).where("row = 77"), "tensor", list("abcdefg"), ["row"]).collect()
    assert len(long) == 21 and {(r["lag"], r["feature"]): r["shap"] for r in long}[1, "g"] == data[77, 2, 6]


def test_a_task_reads_its_own_rows_only(tmp_path):
    wide = np.lib.format.open_memmap(tmp_path / "big.npy", "w+", "float64", (4_000_000, 25))  # 800 MB, mostly a hole
    wide[3_999_999] = np.arange(25)
    del wide
    reader = arrays.ArrayReader({"path": str(tmp_path / "big.npy")})
    parts = reader.partitions()
    assert len(parts) == 12 and parts[-1].last == 4_000_000
    tail = arrays.RowRange(parts[-1].header, 3_999_990, 4_000_000)
    (batch,) = reader.read(tail)
    assert batch.column("row").to_pylist()[-1] == 3_999_999 and batch.column("cells")[9].as_py() == list(map(float, range(25)))
    assert max(b.num_rows for b in reader.read(parts[0])) * 25 * 8 <= arrays.HELD


def test_members_kinds_and_refusals(spark, tmp_path):
    np.savez(tmp_path / "s.npz", ids=np.arange(6), flags=np.array([True, False]), empty=np.zeros((0, 4)), one=np.arange(4.0))
    assert sorted(r["cells"] for r in arrays.read_array(spark, str(tmp_path / "s.npz"), "ids", split=16).collect()) == [[float(i)] for i in range(6)]
    assert [r["cells"] for r in arrays.read_array(spark, str(tmp_path / "s.npz"), "flags").collect()] == [[1.0], [0.0]]
    assert arrays.read_array(spark, str(tmp_path / "s.npz"), "empty").count() == 0
    np.savez_compressed(tmp_path / "c.npz", ids=np.arange(6))
    np.save(tmp_path / "o.npy", np.array([{}, []], object), allow_pickle=True)
    np.save(tmp_path / "f.npy", np.asfortranarray(np.ones((3, 2))))
    np.save(tmp_path / "z.npy", np.array(1.0))
    np.save(tmp_path / "t.npy", np.array(["a"]))
    for name, member in (("c.npz", "ids"), ("o.npy", None), ("f.npy", None), ("z.npy", None), ("t.npy", None)):
        with pytest.raises(ValueError):
            arrays.read_header(str(tmp_path / name), member)


def test_round_trip_by_parts(spark, tmp_path):
    df = spark.createDataFrame([([float(i), i / 3],) for i in range(1000)], "v array<double>").repartition(7)
    path = "file:" + str(tmp_path / "out")
    written = arrays.write_array(df, path, "v").collect()
    assert sum(r["rows"] for r in written) == 1000 and len(written) == 7
    assert sorted(r["cells"] for r in arrays.read_array(spark, path).collect()) == sorted(r["v"] for r in df.collect())
    with pytest.raises(FileExistsError):
        arrays.write_array(df, path, "v")
