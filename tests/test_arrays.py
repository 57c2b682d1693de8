"""Binary arrays: round trips, ranges of rows, chosen components."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from liaison.sources import arrays as A


def read(df):
    rows = sorted((r["row"], r["vec"]) for r in df.collect())
    assert [n for n, _ in rows] == list(range(len(rows)))
    return np.array([v for _, v in rows])


@pytest.mark.parametrize("dtype", ["<f4", "<f8", ">f8", "<i2", "|b1", "<u4"])
@pytest.mark.parametrize("order", ["C", "F"])
def test_files_of_others_are_read_by_ranges(spark, tmp_path, dtype, order):
    want = np.asarray(np.random.default_rng(1).normal(size=(103, 5)) * 3).astype("<i8" if "f" not in dtype else "<f8").astype(dtype)
    np.save(tmp_path / "x.npy", np.asarray(want, order=order))
    df = A.read_arrays(spark, str(tmp_path / "x.npy"), task_bytes=17 * want.itemsize * 5)
    assert df.rdd.getNumPartitions() == 7  # 17 rows a task
    assert dict(df.dtypes)["vec"] == ("array<double>" if "f" in dtype else "array<bigint>")
    assert np.array_equal(read(df), want.astype("f8" if "f" in dtype else "i8"))
    assert np.array_equal(read(A.read_arrays(spark, str(tmp_path / "x.npy"), [3, 0])), want[:, [3, 0]].astype("f8"))


def test_folders_and_odd_files(spark, tmp_path):
    np.save(tmp_path / "b.npy", np.arange(4.0))
    np.save(tmp_path / "a.npy", np.zeros((0, 1)))
    np.save(tmp_path / "c.npy", np.array([9.0]))
    assert read(A.read_arrays(spark, str(tmp_path))).ravel().tolist() == [0, 1, 2, 3, 9]
    np.save(tmp_path / "a.npy", np.array([1 << 62]))
    with pytest.raises(Exception, match="whole numbers"):
        A.read_arrays(spark, str(tmp_path)).collect()
    np.save(tmp_path / "d.npy", np.zeros((2, 2, 2)))
    with pytest.raises(Exception, match="dimensions"):
        A.read_arrays(spark, str(tmp_path / "d.npy")).collect()


def test_round_trip(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    want = rng.normal(size=(500, 3))
    rows = [(i, v.tolist()) for i, v in enumerate(want)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in rows], "id long, v array<double>").repartition(4)
    A.write_arrays(df, str(tmp_path / "out"), "id", "v")
    np.save(tmp_path / "out" / "part-00000-left-by-a-lost-task.npy", np.zeros((7, 3)))
    assert np.array_equal(read(A.read_arrays(spark, str(tmp_path / "out"))), want)
    named = json.loads((tmp_path / "out" / A.MANIFEST).read_text())
    assert np.array_equal(np.concatenate([np.load(tmp_path / "out" / n) for n in named]), want)
    A.write_arrays(df, str(tmp_path / "out"), "id", "v", "<f4")  # written again: the earlier files are no longer named
    assert np.array_equal(read(A.read_arrays(spark, str(tmp_path / "out"))), want.astype("<f4").astype("f8"))
    A.write_arrays(df.limit(0), str(tmp_path / "none"), "id", "v")
    assert A.read_arrays(spark, str(tmp_path / "none")).count() == 0
    for bad in ("array(1.0d)", "array(null, 1.0d, 2.0d)", "null"):
        with pytest.raises(Exception, match="one length"):
            A.write_arrays(df.withColumn("v", F.expr(f"if(id = 5, {bad}, v)")), str(tmp_path / "bad"), "id", "v")


def test_files_are_bounded(monkeypatch, tmp_path):
    """A task's rows lie in files of BATCH_BYTES."""
    import pyarrow as pa

    monkeypatch.setattr(A, "BATCH_BYTES", 240)
    monkeypatch.setattr(A.TaskContext, "get", staticmethod(lambda: type("T", (), {"partitionId": lambda self: 3})()))
    vec = pa.array([[float(i), 1.0, 2.0] for i in range(45)])
    batches = [pa.RecordBatch.from_arrays([vec.slice(at, 9)], ["vec"]) for at in range(0, 45, 9)]
    got = A.ArrayWriter(str(tmp_path), "<f8").write(iter(batches))
    blocks = [np.load(tmp_path / n) for n in got.names]
    assert got.partition == 3 and max(len(b) for b in blocks) <= 20
    assert np.concatenate(blocks)[:, 0].tolist() == list(range(45))
