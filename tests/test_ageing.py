from itertools import product

from pyspark.sql import functions as F

from cairn.operators import maintain as M


def test_target_level_at_its_limits(spark):
    """A memory that is exactly as old as a limit has reached it, whatever its resistance."""
    rows, want = [], {}
    for importance, confidence, accesses in product((0.2, 0.9), (0.5, 0.9), (1, 11)):
        resistance = (2.0 if importance > 0.7 else 1.0) * (1.3 if confidence > 0.8 else 1.0) * (1.5 if accesses > 10 else 1.0)
        for limit, minutes in product((168, 720), (-1, 0, 1)):
            age = round(limit * resistance * 60) + minutes
            want[len(rows)] = 2 if age * 60 / 3600 >= 720 * resistance else 1 if age * 60 / 3600 >= 168 * resistance else 0
            rows.append((len(rows), importance, confidence, accesses, 0, age))
    mem = spark.createDataFrame(rows, "id long, importance double, confidence double, access_count int, compression_level int, age long")
    mem = mem.withColumn("created_at", F.timestamp_seconds(F.lit(1_713_139_200) - F.col("age") * 60))
    assert {r["id"]: r["target_level"] for r in M.compression_target(mem, F.timestamp_seconds(F.lit(1_713_139_200))).collect()} == want
