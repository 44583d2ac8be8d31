import numpy as np
import pyarrow as pa
import pytest

from graphs import frame
from tempograph.operators import spectral, tiles


def sparse(spark, x):
    i, j = np.nonzero(x)
    return frame(spark, "i long, j long, val double", i=i, j=j, val=x[i, j])


def cells(df, rows="i", inner="j"):
    return df.selectExpr(f"{rows} as x", f"{inner} as k", "val as v")


@pytest.mark.parametrize("share", [0.9, 0.08])
def test_products_by_tiles(spark, monkeypatch, share):
    """Many blocks, dense and expanded products: the numbers of numpy, a row wherever products meet, also if they cancel out."""
    monkeypatch.setattr(tiles, "BAND", 8)
    monkeypatch.setattr(tiles, "INNER", 16)
    monkeypatch.setattr(tiles, "EXPANDED", 7)
    draw = np.random.default_rng(2)
    x, y = (draw.integers(-2, 3, (60, 60)) * (draw.random((60, 60)) < share) for _ in range(2))
    x[:3], x[0, :2], x[1, :2] = 0, (1, 1), (1, -1)
    x, y = x.astype(float), y.astype(float)
    asked = []
    monkeypatch.setattr(tiles, "tiles", lambda c, rows, own=tiles.tiles: asked.append(rows) or own(c, rows))
    a, b = sparse(spark, x), sparse(spark, y)
    whole = tiles.product(cells(a), cells(b, "j", "i")).toPandas()
    gram = tiles.product(cells(a)).toPandas()
    for found, expected, met in ((whole, x @ y, (x != 0).astype(int) @ (y != 0) > 0), (gram, np.triu(x @ x.T), np.triu((x != 0).astype(int) @ (x != 0).T > 0))):
        assert len(found) == met.sum() and not found.duplicated(["i", "j"]).any()
        np.testing.assert_allclose(found["val"], expected[found["i"], found["j"]], atol=1e-12)
    assert bool(asked) == (share == 0.9)


def test_gram_of_a_hub_shuffles_cells_not_pairs(spark):
    """2,000 nodes share three columns: two million pairs, none of them in a shuffle; before, all pairs of each column were."""
    a = spark.range(2000).selectExpr("id as i", "explode(array(2000, 2001, 2002)) as j", "0L as t", "1.0D as val")
    found = spectral.gram(a)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Exchange" not in plan[: plan.index("FlatMapGroupsInArrow")]
    assert found.where("val <> 3").isEmpty() and found.count() == 2000 * 2001 // 2


def test_few_products_are_expanded(monkeypatch):
    """A hundred rows with a cell or two in each of 64 columns: expanded a few products at once, as the dense product has them."""
    draw = np.random.default_rng(3)
    monkeypatch.setattr(tiles, "EXPANDED", 7)
    x, y = np.zeros((100, 64)), np.zeros((90, 64))
    for m in (x, y):
        for k in range(64):
            m[draw.integers(0, len(m), 2), k] = draw.integers(1, 5, 2)
    calls = []
    monkeypatch.setattr(tiles, "expanded", lambda *a, own=tiles.expanded: calls.append(1) or own(*a))
    total, met = np.zeros((100, 90)), np.zeros((100, 90), bool)
    side = lambda m: (np.nonzero(m.T)[0], np.nonzero(m.T)[1], m.T[np.nonzero(m.T)])
    tiles.multiplied(side(x), side(y), total, met)
    np.testing.assert_allclose(total, x @ y.T)
    assert calls and (met == (x @ y.T > 0)).all()


@pytest.mark.parametrize("upper", [True, False])
def test_rows_of_a_product_come_few_columns_at_a_time(monkeypatch, upper):
    """40 rows that all meet: every place once, row by row within 8 columns, so that j comes again within few bytes of a file; before, whole rows of the block were given out."""
    monkeypatch.setattr(tiles, "BAND", 8)
    x, v = np.arange(40, dtype="int32"), np.arange(1.0, 41)
    tile = lambda right: pa.RecordBatch.from_pydict({"right": [right], "inner": [0], "k": [(x * 0).tobytes()], "x": [x.tobytes()], "v": [v.tobytes()]})
    found = [b.to_pandas() for b in tiles.summed(40, upper)((pa.scalar(0), pa.scalar(0)), iter([tile(0), tile(1)]))]
    assert all(b["j"].max() - b["j"].min() < 8 and b["i"].is_monotonic_increasing for b in found)
    places = [(i, j) for b in found for i, j, val in b.itertuples(index=False) if val == (i + 1) * (j + 1)]
    assert sorted(places) == [(i, j) for i in range(40) for j in range(40) if i <= j or not upper]


def test_rounded_as_spark_does(spark):
    draw = np.random.default_rng(4)
    x = np.concatenate([draw.normal(size=5000) * 10.0 ** draw.integers(-9, 18, 5000), (draw.integers(-(10**6), 10**6, 5000) + 0.5) / 1e6, np.arange(50.0), [0.0, -0.0, 5e-7, -5e-7, 1e300, np.inf, -np.inf]])
    found = frame(spark, "k long, x double", k=np.arange(len(x)), x=x).selectExpr("k", "round(x, 6) + 0.0D as y").toPandas().sort_values("k")["y"].to_numpy()
    own = tiles.rounded(x, 6)
    assert (found == own).all() and (np.signbit(found) == np.signbit(own)).all() and np.isnan(tiles.rounded(np.array([np.nan]), 6)).all()


@pytest.mark.parametrize("share", [0.9, 0.08])
def test_products_with_digits(spark, monkeypatch, share):
    monkeypatch.setattr(tiles, "BAND", 8)
    draw = np.random.default_rng(5)
    a = sparse(spark, draw.normal(size=(60, 60)) * (draw.random((60, 60)) < share))
    plain = tiles.product(cells(a)).selectExpr("i", "j", "round(val, 3) + 0.0D as val").toPandas().set_index(["i", "j"]).sort_index()
    found = tiles.product(cells(a), digits=3).toPandas().set_index(["i", "j"]).sort_index()
    assert plain.equals(found)


def test_a_gram_of_fractions_is_rounded_where_it_is_summed(spark):
    """2,000 nodes share three columns of weights of a third: Spark has no row to round, as it had in gram_ulse_n1 before."""
    a = spark.range(2000).selectExpr("id as i", "explode(array(2000, 2001, 2002)) as j", "0L as t", "1 / 3.0D as val")
    found = spectral.gram(a, 6)
    assert "round(" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.where("val <> 0.333333D").isEmpty() and found.count() == 2000 * 2001 // 2


@pytest.mark.parametrize("upper", [True, False])
def test_equal_rows_of_a_product_follow_each_other(monkeypatch, upper):
    """40 rows of ten kinds, in columns taken 16 at a time: every place once with its value, rows of a kind side by side; before, they came as they are numbered."""
    monkeypatch.setattr(tiles, "BAND", 8)
    monkeypatch.setattr(tiles, "WIDE", 16)
    x = np.arange(40, dtype="int32")
    v = 1.0 + x % 10
    tile = lambda right: pa.RecordBatch.from_pydict({"right": [right], "inner": [0], "k": [(x * 0).tobytes()], "x": [x.tobytes()], "v": [v.tobytes()]})
    found = [b.to_pandas() for b in tiles.summed(40, upper)((pa.scalar(0), pa.scalar(0)), iter([tile(0), tile(1)]))]
    places = [(i, j) for b in found for i, j, val in b.itertuples(index=False) if val == v[i] * v[j]]
    assert sorted(places) == [(i, j) for i in range(40) for j in range(40) if i <= j or not upper]
    last = [b for b in found if b["j"].min() >= 32]
    assert [list(b["i"].drop_duplicates()) for b in last][:2] == [[0, 10, 20, 30, 1, 11, 21, 31], [2, 12, 22, 32, 3, 13, 23, 33]]


def test_tiles_travel_compressed(spark):
    """2,000 rows share three columns of equal values: 16 bytes a cell before, and opened() gives the cells back."""
    a = cells(spark.range(2000).selectExpr("id as i", "explode(array(7, 8, 9)) as j", "1 / 3.0D as val"))
    found = tiles.tiles(a, 512)
    assert found.selectExpr("sum(length(k) + length(x) + length(v)) as s").first()["s"] < 6000

    def unpacked(key, batches):
        for b in batches:
            k, x, v = (np.frombuffer(b[c][0].as_py(), kind) for c, kind in (("k", "int32"), ("x", "int32"), ("v", "float64")))
            yield pa.RecordBatch.from_pydict({"block": np.full(len(k), key[0].as_py()), "k": k.astype("int64"), "x": x.astype("int64"), "v": v})

    back = found.groupBy("block", "inner").applyInArrow(tiles.opened(unpacked), "block long, k long, x long, v double").selectExpr("block * 512 + x as x", "k", "v")
    assert back.count() == 6000 and back.exceptAll(a.selectExpr("x", "cast(k as bigint) as k", "v")).isEmpty()
