import hashlib

import pytest
from pyspark.sql import functions as F

from logmetrics.operators import positions as pos


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one timestamp; the id breaks the tie."""
    rows = [(k, 500 if k % 3 == 0 else k * 7 % 1000) for k in range(3000)]
    return spark.createDataFrame(rows, "id long, at long").repartition(5)


def expected_order(df):
    return [r["id"] for r in sorted(df.collect(), key=lambda r: (r["at"], r["id"]))]


def test_row_index_equals_sorted_order_on_a_hot_key(skewed):
    got = pos.row_index(skewed, "at", "id").orderBy("idx").collect()
    assert [r["idx"] for r in got] == list(range(3000))
    assert [r["id"] for r in got] == expected_order(skewed)


def test_row_index_spreads_the_hot_key(spark, skewed):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hot = pos.row_index(skewed, "at", "id").filter("at = 500")
        ordered = skewed.repartitionByRange("at", "id").filter("at = 500")
        assert ordered.select(F.spark_partition_id()).distinct().count() > 1
        assert hot.count() == skewed.filter("at = 500").count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_row_index_refuses_an_existing_name(skewed):
    with pytest.raises(ValueError):
        pos.row_index(skewed, "at", "id", name="id")


def test_row_index_of_nothing(skewed):
    assert pos.row_index(skewed.limit(0), "at", "id").count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_shuffled_index_is_the_md5_order(skewed, parts):
    ids = skewed.select("id").repartition(parts)
    got = pos.shuffled_index(ids, "id", seed=3, n=3000, rounds=2).collect()

    def order(round_):
        def key(i):
            return hashlib.md5(f"3:{round_}:{i}".encode()).hexdigest()

        return {i: p for p, i in enumerate(sorted(range(3000), key=lambda i: (key(i), i)))}

    want = {(r, i): p for r in (0, 1) for i, p in order(r).items()}
    assert {(r["round"], r["id"]): r["pos"] for r in got} == want


def test_sample_every_and_slices(skewed):
    order = expected_order(skewed)
    sampled = pos.sample_every(skewed, "at", "id").orderBy("idx").collect()
    assert [r["id"] for r in sampled] == order[5::6]
    part = pos.slice_rows(skewed, "at", "id", start=10, stop=20).orderBy("idx").collect()
    assert [r["id"] for r in part] == order[10:20]
    head = pos.head_rows(skewed, "at", "id", n=5).collect()
    assert [r["id"] for r in head] == order[:5]


def test_sample_every_of_fewer_than_six_rows(spark):
    assert pos.sample_every(spark.range(5), "id").count() == 0
    assert pos.sample_every(spark.range(6), "id").first()["id"] == 5


def test_take_record_bounds(skewed):
    order = expected_order(skewed)
    assert pos.take_record(skewed, "at", "id", index=1).first()["id"] == order[0]
    assert pos.take_record(skewed, "at", "id", index=3000).first()["id"] == order[-1]
    assert pos.take_record(skewed, "at", "id", index=0).count() == 0
    assert pos.take_record(skewed, "at", "id", index=3001).count() == 0


def test_take_entry_bounds(spark):
    df = spark.createDataFrame([(["a", "b"], i) for i in (-1, 0, 1, 2, 3)], "xs array<string>, i int")
    got = df.select("i", pos.take_entry(F.col("xs"), F.col("i")).alias("x")).collect()
    assert {r["i"]: r["x"] for r in got} == {-1: None, 0: None, 1: "a", 2: "b", 3: None}


def test_chrono_split_floors_in_double(spark):
    sizes = {r["split"]: r["count"] for r in
             pos.chrono_split(spark.range(90), "id").groupBy("split").count().collect()}
    assert sizes == {"train": int(90 * 0.7), "validation": int(90 * 0.9) - 62, "test": 9}
    assert sizes["train"] == 62


def test_tail_rows(spark):
    got = pos.tail_rows(spark.range(100), "id", 30).collect()
    assert sorted(r["id"] for r in got) == list(range(70, 100))


def test_halo_needs_room(spark):
    with pytest.raises(ValueError):
        pos.with_halo(spark.range(5).withColumnRenamed("id", "idx"), "idx", size=48, chunk=10)
