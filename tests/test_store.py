import glob
import os

from cairn.streaming import events as V


def rows(spark, keys):
    return spark.createDataFrame([(k, f"content of {k}", i) for i, k in enumerate(keys)], "key string, content string, n int")


def test_batches(spark, tmp_path):
    """Each key once, whatever comes again; a null key is one key."""
    path = str(tmp_path / "store")
    keys = [f"k{i}" for i in range(300)]
    V.store_new(rows(spark, keys[:200] + keys[:20]), path)
    V.store_new(rows(spark, keys[:200]), path)
    V.store_new(rows(spark, keys[150:] + [None, None]), path)
    V.store_new(rows(spark, [None, "k1"]), path)
    V.store_new(rows(spark, []), path)
    got = spark.read.parquet(path)
    assert sorted(r["key"] or "" for r in got.collect()) == sorted(["", *keys]) and {"content", "n", "bucket"} <= set(got.columns)


def test_reads_folders_of_its_keys(spark, tmp_path):
    """Of other folders the store's files may even be broken: a batch doesn't read them, nor any for keys that the filters don't have."""
    path = str(tmp_path / "store")
    V.store_new(rows(spark, [f"k{i}" for i in range(400)]), path)
    bucket = {r["key"]: r["bucket"] for r in spark.read.parquet(path).collect()}
    for file in glob.glob(f"{path}/bucket=*/*.parquet"):
        if f"bucket={bucket['k7']}/" not in file:
            with open(file, "r+b") as f:
                f.truncate(10)
            crc = os.path.join(os.path.dirname(file), f".{os.path.basename(file)}.crc")
            if os.path.exists(crc):
                os.remove(crc)
    V.store_new(rows(spark, ["k7"]), path)
    before = len(glob.glob(f"{path}/bucket=*/*.parquet"))
    V.store_new(rows(spark, ["never before", "k7"]), path)
    assert len(glob.glob(f"{path}/bucket=*/*.parquet")) == before + 1


def test_break_between_filter_and_keys(spark, tmp_path, monkeypatch):
    """Where a job breaks after the filter is written, the batch that is run again writes its keys."""
    path = str(tmp_path / "store")
    V.store_new(rows(spark, ["a"]), path)
    placed = V._placed(rows(spark, ["b"]))
    placed.select("word", "bits", "bucket").write.mode("append").partitionBy("bucket").parquet(path + "-bloom")
    V.store_new(rows(spark, ["a", "b"]), path)
    assert sorted(r["key"] for r in spark.read.parquet(path).collect()) == ["a", "b"]
