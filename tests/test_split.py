import pytest
from pyspark.sql import functions as F

from codeprep.operators import split as S


def sizes(df):
    return {r["split"]: r["n_rows"] for r in S.split_sizes(df).collect()}


def numbered(spark, n):
    return spark.range(1, n + 1).select(
        F.col("id").alias("row_id"), F.lit(n).cast("long").alias("n_rows")
    )


def test_ratios():
    assert S.normalised_ratios(8, 1, 1) == (0.8, 0.1, 0.1)
    assert S.checked_ratios(0.8, 0.1, 0.1) == (0.8, 0.1, 0.1)
    with pytest.raises(ValueError):
        S.checked_ratios(0.8, 0.1, 0.2)
    with pytest.raises(ValueError):
        S.normalised_ratios(0, 0, 0)


@pytest.mark.parametrize("n", [1, 7, 10, 27, 999])
@pytest.mark.parametrize("shares", [(0.8, 0.1, 0.1), (0.7, 0.2, 0.1), (1.0, 0.0, 0.0)])
def test_sequential_sizes_truncate(spark, n, shares):
    train, val, _ = S.normalised_ratios(*shares)
    want = {"train": int(n * train), "val": int(n * val)}
    want["test"] = n - sum(want.values())
    got = S.split_sequential(numbered(spark, n), *shares)
    assert sizes(got) == {k: v for k, v in want.items() if v}
    label = {r["row_id"]: r["split"] for r in got.collect()}
    order = [label[i] for i in range(1, n + 1)]
    assert order == ["train"] * want["train"] + ["val"] * want["val"] + ["test"] * want["test"]


def test_shuffled_sizes_and_stability(spark):
    df = numbered(spark, 530).drop("n_rows")
    got = S.split_shuffled(df)
    assert sizes(got) == {"train": 424, "val": 53, "test": 53}
    again = S.split_shuffled(df.repartition(9))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))
    train = {r["row_id"] for r in got.filter("split = 'train'").collect()}
    assert train != set(range(1, 425))


def test_rebuilt_splits_are_disjoint_and_complete(spark, rows):
    whole = S.split_sequential(numbered(spark, 100))
    parts = {k: S.rebuild_split(whole.drop("split"), v) for k, v in S.split_keys(whole).items()}
    assert rows(S.union_splits(parts)) == rows(whole)
