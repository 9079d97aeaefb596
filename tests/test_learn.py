"""Order statistics, classifiers by moments, boosting, neighbours and batch normalization against direct versions."""

from __future__ import annotations

import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tessera.learn import attribution, moments, neighbours, stumps
from tessera.nn import convolution, normalized, train
from tessera.operators import clean, encode, profile, quantiles
from tessera.plans import models, q_models
from tessera.prep.folded import FoldedSetup
from tessera.sources import bundle, images, infer
from tessera.streaming import latency, scoring

VALUES = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.2250738585072009e-308, 1.0, math.nextafter(1.0, 0), math.nextafter(1.0, 2), 1e308, 1.7976931348623157e308,
          math.nextafter(1.7976931348623157e308, 0), math.inf, -math.inf, math.nan, 1e-300, -3.5, 8.0, math.nextafter(8.0, 0), 2.0**52, 2.0**53 + 2]


def test_images_keep_the_order(spark):
    rng = random.Random(1)
    values = VALUES + [rng.uniform(-1, 1) * 10.0 ** rng.randint(-320, 308) for _ in range(3000)]
    values += [f(2.0**e, x) for e in range(-1074, 1024, 7) for f, x in ((math.nextafter, 0), (math.nextafter, math.inf), (lambda a, b: a, 0))]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", quantiles.sortable(F.col("x")).alias("i")).collect()
    rows.sort(key=lambda r: (math.isnan(r.x), r.x))
    for a, b in zip(rows, rows[1:], strict=False):
        assert a.i <= b.i
        assert (a.i == b.i) == (a.x == b.x or (math.isnan(a.x) and math.isnan(b.x))), (a, b)


def direct(values, share):
    values = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
    if not values:
        return None
    at = share * (len(values) - 1)
    a, b = values[math.floor(at)], values[math.ceil(at)]
    return a if a == b or math.floor(at) == math.ceil(at) else (math.ceil(at) - at) * a + (at - math.floor(at)) * b


@pytest.mark.parametrize("few", [1, 7, 1 << 12])
def test_quantiles_by_selection(spark, few):
    rng = random.Random(2)
    rows = []
    for i in range(1500):
        g = rng.choice(["a", "b", None, "one"]) if i else "single"
        x = rng.choice([None, float(rng.randint(0, 9)), rng.gauss(0, 1) * 10.0 ** rng.randint(-200, 200), rng.uniform(5, 5.000001)])
        rows.append((g, 7.0 if g == "one" else x, rng.randint(-3, 3)))
    df = spark.createDataFrame(rows, "g string, x double, k long").repartition(5)
    shares = [0.0, 0.25, 0.5, 0.731, 1.0]
    found = {(r["g"], r["column_name"], r["share"]): r["value"] for r in quantiles.quantiles(df, ["x", "k"], shares, by=["g"], few=few).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for c, name in ((1, "x"), (2, "k")):
            values = [r[c] for r in rows if r[0] == g]
            if any(v is not None for v in values):
                want |= {(g, name, s): direct([None if v is None else float(v) for v in values], s) for s in shares}
    assert found.keys() == want.keys()
    assert all(found[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_no_task_holds_the_distinct_values(spark):
    """50,000 distinct values, 64 read out at most: the rows of every grouping after the first are bounded by bins, not by values."""
    df = spark.range(50_000).select((F.col("id") * 1.37 + 0.1).alias("x"))
    assert quantiles.medians(df, ["x"], few=64)["x"] == pytest.approx(24999.5 * 1.37 + 0.1)
    rows = df.select(F.lit("x").alias("column_name"), "x", quantiles.sortable(F.col("x")).alias("image"))
    ends = rows.agg(F.min("image"), F.max("image")).first()
    targets = spark.createDataFrame([("x", 25_000, ends[0], ends[1], 0, 50_000)], "column_name string, k long, lo long, hi long, below long, inside long")
    step = quantiles._narrowed(rows, targets, ["column_name"]).first()
    assert step["inside"] < 50_000 // 100
    plan = quantiles._narrowed(rows, targets, ["column_name"])._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect" not in plan and "HashAggregate" in plan
    assert "percentile" not in quantiles.quantiles(df, ["x"], [0.5], few=64)._jdf.queryExecution().optimizedPlan().toString()


def test_quantiles_of_nothing(spark):
    none = spark.createDataFrame([(None, "a")], "x double, g string")
    assert quantiles.quantiles(none, ["x"], [0.5], by=["g"]).count() == 0 and quantiles.medians(none, ["x"]) == {"x": None}
    assert clean.fill_median(none, ["x"]).first()["x"] is None
    assert profile.describe_numeric(none, ["x"]).first()["median"] is None
    fitted, total = encode.quantile(none, "g", "x")
    assert total is None and fitted.first()["qe"] is None


def two_classes(n=240, width=3, seed=4):
    rng = np.random.default_rng(seed)
    y = (np.arange(n) % 3 == 0).astype(int)
    x = rng.normal(0, 1, (n, width)) * (1 + y[:, None]) + 50 + 1.2 * y[:, None] * np.arange(width)
    return x, y


def labelled(spark, x, y, parts=3):
    return spark.createDataFrame([(i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y long").repartition(parts)


def test_moments_and_discriminants(spark):
    x, y = two_classes()
    df = labelled(spark, x, y)
    m = moments.Moments.of(df)
    for k in (0, 1):
        own = x[y == k]
        assert m.n[k] == len(own) and np.allclose(m.mean[k], own.mean(axis=0)) and np.allclose(m.scatter[k], np.cov(own.T) * (len(own) - 1))
    cov = [np.cov(x[y == k].T) for k in (0, 1)]
    mean = [x[y == k].mean(axis=0) for k in (0, 1)]
    prior = [np.mean(y == k) for k in (0, 1)]
    pooled = (cov[0] * ((y == 0).sum() - 1) + cov[1] * ((y == 1).sum() - 1)) / (len(y) - 2)

    def density(k, c):
        d = x - mean[k]
        return prior[k] * np.exp(-0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(c), d)) / np.sqrt(np.linalg.det(c))

    for model, covs in ((moments.linear_discriminant(m), [pooled, pooled]), (moments.quadratic_discriminant(m, 0.0), cov)):
        a, b = density(0, covs[0]), density(1, covs[1])
        found = {r.id: r.p for r in model.scored(df).collect()}
        assert np.allclose([found[i] for i in range(len(y))], b / (a + b), atol=1e-9)
    # ridge: the normal equations of the centred rows
    t, c = np.where(y == 1, 1.0, -1.0), x - x.mean(axis=0)
    w = np.linalg.solve(c.T @ c + 2.5 * np.eye(x.shape[1]), c.T @ (t - t.mean()))
    found = moments.ridge(m, 2.5)
    assert np.allclose(found.weights, w) and found.intercept == pytest.approx(t.mean() - w @ x.mean(axis=0))


def test_singular_features(spark):
    x, y = two_classes(60)
    m = moments.Moments.of(labelled(spark, np.hstack([x, x[:, :1], np.ones((60, 1))]), y))
    for model in (moments.linear_discriminant(m), moments.quadratic_discriminant(m), moments.ridge(m)):
        assert np.isfinite(model.weights if hasattr(model, "weights") else model.precision).all()


def test_boosted_stumps(spark):
    x, y = two_classes(150)
    model = stumps.boosted_stumps(labelled(spark, x, y), rounds=6, bins=8)
    edges = np.quantile(x, [i / 8 for i in range(1, 8)], axis=0).T
    t, w, want = np.where(y == 1, 1.0, -1.0), np.ones(len(y)), []
    for _ in range(6):
        options = []
        for side in (1.0, -1.0):
            for f in range(x.shape[1]):
                for cut in edges[f]:
                    options.append((round(float(w[np.where(x[:, f] > cut, side, -side) != t].sum() / w.sum()), 12), -side, f, cut))
        error, side, f, cut = min(options)
        alpha = 0.5 * math.log((1 - error) / error)
        want.append((f, cut, -side, alpha))
        w = w * np.exp(-alpha * t * np.where(x[:, f] > cut, -side, side))
    assert [(f, s) for f, _, s, _ in model.stumps] == [(f, s) for f, _, s, _ in want]
    assert np.allclose([[c, a] for _, c, _, a in model.stumps], [[c, a] for _, c, _, a in want])
    assert stumps.boosted_stumps(labelled(spark, np.ones((6, 2)), np.array([0, 1] * 3))).stumps == []


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 17)
    x, y = two_classes(90)
    x[40:50] = x[3]  # equal distances
    df = labelled(spark, x, y)
    found = neighbours.neighbours(df, df.where("id % 2 = 0"), 4)
    got = {(r.query, r.rank): r.id for r in found.collect()}
    for q in range(0, 90, 2):
        order = np.lexsort((np.arange(90), ((x - x[q]) ** 2).sum(axis=1)))[:4]
        assert [got[q, r] for r in range(1, 5)] == order.tolist()
    assert neighbours.neighbours(df, df.where("false"), 4).count() == 0


def nearest_of(x, known, own, k, size=700):
    """What one task returns, in the order of query, distance and id."""
    flat = pa.array(known.ravel())
    batches = []
    for i in range(0, len(known), size):
        at = pa.array(np.arange(i, min(i + size, len(known)) + 1, dtype=np.int32) * known.shape[1])
        batches.append(pa.RecordBatch.from_arrays([pa.array(own[i : i + size]), pa.ListArray.from_arrays(at, flat), pa.array(own[i : i + size] % 2)], names=["id", "x", "y"]))
    (found,) = neighbours._nearest(np.arange(len(x)), x, k)(iter(batches))
    q, i, y, d = (found.column(c).to_numpy() for c in range(4))
    assert (y == i % 2).all()
    order = np.lexsort((i, d, q))
    return q[order], i[order], d[order]


@pytest.mark.parametrize("kind", ["plain", "far away", "huge", "tiny", "ties", "copies", "odd", "scales", "few"])
def test_neighbours_passed_over_are_farther(monkeypatch, kind):
    """Pairs that the bound in single precision leaves out are none of the nearest, on any scale; distances are those of double precision."""
    monkeypatch.setattr(neighbours, "_TILE", 64)
    rng = np.random.default_rng(5)
    known, x, own = rng.normal(size=(2000, 9)), rng.normal(size=(150, 9)), rng.permutation(5000)[:2000]
    if kind == "far away":
        known, x = known + 1e10, x + 1e10
    elif kind in ("huge", "tiny"):
        known, x = (v * {"huge": 1e160, "tiny": 1e-170}[kind] for v in (known, x))
    elif kind == "ties":
        known, x = known.round(), x.round()
    elif kind == "copies":
        known[::3], known[1::7] = known[5], known[5] + 1e-9
        x[::2] = known[5]
    elif kind == "odd":
        known[3], known[9, 2], known[11, 5], x[4], x[6, 1] = np.nan, np.inf, 1e300, np.nan, -np.inf
    elif kind == "scales":
        known = known * 10.0 ** rng.uniform(-20, 20, (2000, 1))
        x = known[:150] * 1.01
    elif kind == "few":
        known, own = known[:3], own[:3]
    with np.errstate(all="ignore"):
        q, i, d = nearest_of(x, known, own, 15)
        for a in range(len(x)):
            far = ((x[a] - known) ** 2).sum(axis=1)
            order = np.lexsort((own, far))[:15]
            assert i[q == a].tolist() == own[order].tolist() and np.array_equal(d[q == a], far[order], equal_nan=True)


def test_most_pairs_are_passed_over():
    rng = np.random.default_rng(6)
    known, x = rng.normal(size=(20_000, 64)), rng.normal(size=(2048, 64))
    start = time.thread_time()
    assert len(nearest_of(x, known, np.arange(20_000), 15, 10_000)[0]) == 2048 * 15
    assert time.thread_time() - start < 5  # some 0.5 s; 9 s where each distance is worked out


def test_cuts_are_exact(spark):
    rng = np.random.default_rng(7)
    n = 900
    x = np.column_stack([rng.normal(size=n), rng.normal(size=n).round(1), np.full(n, -3.5), rng.normal(size=n) * 1e-310, rng.normal(size=n) * 10.0 ** rng.uniform(-300, 300, n), rng.normal(size=n), np.zeros(n)])
    x[::3, 5], x[::2, 6] = np.inf, -0.0
    rows = [([None if f == 0 and i % 4 == 0 else float(v) for f, v in enumerate(r)],) for i, r in enumerate(x)]
    found = stumps.cuts(spark.createDataFrame(rows, "x array<double>").repartition(3), 7, 16)
    for f in range(7):
        own = np.sort(np.delete(x[:, f], np.s_[::4]) if f == 0 else x[:, f])
        place = np.arange(1, 16) / 16 * (len(own) - 1)
        a, b = np.floor(place), np.ceil(place)
        low, high = own[a.astype(int)], own[b.astype(int)]
        with np.errstate(invalid="ignore"):
            assert found[f].tolist() == np.where((a == b) | (low == high), low, (b - place) * low + (place - a) * high).tolist()
    assert not stumps.cuts(spark.createDataFrame([], "x array<double>"), 2, 4).any()


def loss_of(net, x, y, positive_weight):
    """The mean loss on the batch's own moments, written down directly."""
    a = x
    for w, g, b in zip(net.weights, net.gamma, net.beta, strict=True):
        z = a @ w
        a = np.maximum(g * (z - z.mean(axis=0)) / np.sqrt(z.var(axis=0) + normalized.EPS) + b, 0)
    z = (a @ net.last.weights + net.last.bias)[:, 0]
    return float((np.where(y == 1, positive_weight, 1.0) * (np.logaddexp(0, z) - z * y)).mean())


@pytest.mark.parametrize("parts", [1, 4])
def test_gradients_through_batch_normalization(spark, parts):
    x, y = two_classes(80, 4)
    df = labelled(spark, x, y, parts).select("x", F.col("y").cast("double").alias("y"), F.col("id").alias("k"))
    net = normalized.Normalized.he_init([4, 5, 3, 1], seed=3)
    for p in net.parameters():
        p += np.random.default_rng(1).normal(0, 0.1, p.shape)
    loss, n, grads = net.step(df, positive_weight=2.0)
    assert n == 80 and loss / n == pytest.approx(loss_of(net, x, y, 2.0))
    for p, g in zip(net.parameters(), grads, strict=True):
        for at in list(np.ndindex(p.shape))[::3]:
            kept, h = p[at], 1e-5
            p[at] = kept + h
            up = loss_of(net, x, y, 2.0)
            p[at] = kept - h
            down = loss_of(net, x, y, 2.0)
            p[at] = kept
            assert g[at] == pytest.approx((up - down) / (2 * h), abs=2e-6, rel=1e-3)


def test_folded_equals_unfolded(spark):
    x, y = two_classes(60, 4)
    df = labelled(spark, x, y).select("x", F.col("y").cast("double").alias("y"), F.col("id").alias("k"))
    net = normalized.Normalized.he_init([4, 5, 3, 1])
    net.step(df, momentum=1.0)
    a = x
    for w, g, b, m, v in zip(net.weights, net.gamma, net.beta, net.mean, net.var, strict=True):
        a = np.maximum(g * (a @ w - m) / np.sqrt(v + normalized.EPS) + b, 0)
    assert np.allclose(net.folded().forward(x), a @ net.last.weights + net.last.bias)


def test_dropout_and_batches_do_not_depend_on_partitions(spark):
    x, y = two_classes(90, 3)
    fits = [train.fit_selected(*[labelled(spark, x, y, parts)] * 2, "x", "y", "id", [3, 4, 1], epochs=2, batches=2, normalize=True) for parts in (1, 5)]
    assert np.allclose([h[1:] for h in fits[0].history], [h[1:] for h in fits[1].history])


def test_models_score_after_an_observation(spark):
    """The summary of a logistic fit holds the session, which can't be serialized any more once an Observation was used."""
    seen = Observation()
    spark.range(3).observe(seen, F.count("*").alias("n")).collect()
    assert seen.get["n"] == 3
    x, y = two_classes(60)
    df = labelled(spark, x, y).select("id", array_to_vector("x").alias("x"), F.col("y").cast("double").alias("y"))
    assert models.fit(LogisticRegression(featuresCol="x", labelCol="y"), df).scored(df).count() == 60


def test_every_core_gets_rows_of_the_fits(spark, tmp_path):
    """Also where the vectors come in one file and one row group, and most are of one class."""
    rows = spark.range(0, 4000, numPartitions=1).select(F.col("id").alias("vec_id"), F.array(F.rand(1), F.rand(2)).alias("embedding"), F.when(F.col("id") % 50 == 0, 9).otherwise(0).alias("label"))
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    stored = q_models._fold_rows(spark, str(tmp_path))
    sizes = [r["count"] for r in stored.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 1.2 * 4000 / spark.sparkContext.defaultParallelism


def test_leaderboard_and_search_on_few_fits(spark):
    x, y = two_classes(90)
    df = labelled(spark, x, y).select("id", array_to_vector("x").alias("x"), F.col("y").cast("double").alias("y"), (F.col("id") % 2).cast("int").alias("fold"))
    board = {r.model: r.auc for r in models.leaderboard(df, 3, k=2).collect()}
    assert len(board) == 13 and all(0.5 < v <= 1 for n, v in board.items() if n not in ("factorization", "perceptron"))
    found = models.random_search(df.where("fold = 0"), df.where("fold = 1"), lambda p: LogisticRegression(featuresCol="x", labelCol="y", **p), {"regParam": [0.0, 1.0]}, n=2)
    assert sorted(r.trial for r in found.collect()) == [-1, 0, 1]


def test_inferred_types(spark, tmp_path):
    def kinds(text, **options):
        path = tmp_path / f"t{random.random()}"
        path.mkdir()
        for i, part in enumerate(text if isinstance(text, list) else [text]):
            (path / f"p{i}.csv").write_text(part)
        return infer.infer(spark, f"file://{path}", **options)

    assert kinds("a,b,c,d\n1,x,true,?\n-2,1.5,FALSE,\n9223372036854775807,3,true,NA\n") == ([("a", "bigint"), ("b", "string"), ("c", "boolean"), ("d", "string")], True)
    assert kinds("1,2.5\n3,.5e-3\n") == ([("_c0", "bigint"), ("_c1", "double")], False)
    assert kinds("x,y\nz,w\n")[1] is False and kinds("x,y\nz,w\n", header=True) == ([("x", "string"), ("y", "string")], True)
    # a whole number beyond 64 bits is a number; a Java suffix is none
    assert kinds("n,m\n99999999999999999999,1d\n1,2\n")[0] == [("n", "double"), ("m", "string")]
    assert kinds(["n;m\n1;2\n", "n;m\n1.5;2\n"], sep=";") == ([("n", "double"), ("m", "bigint")], True)
    assert kinds("") == ([], False)


def test_folded_setup_edges(spark):
    rows = [(i, i % 2, None if i < 6 else float(i), None if i % 3 else "ab"[i % 2]) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, fold int, x double, c string")
    coded = {r.id: r for r in FoldedSetup(["x"], ["c"], folds=2).fit(df).transform(df, "id").collect()}
    known = sorted(r[2] for r in rows if r[1] == 1 and r[2] is not None)
    mid = known[1]
    train = [mid if r[2] is None else r[2] for r in rows if r[1] == 1]
    assert coded[0].x == pytest.approx((mid - np.mean(train)) / np.std(train))
    # fold 0 is coded by what fold 1 has: only "b"
    assert coded[0].c_place is None and coded[2].c_place == 0
    assert FoldedSetup(["x"], ["c"], folds=2).fit(df.where("false")).transform(df, "id").where("x is not null").count() == 12


@pytest.mark.parametrize("parts", [1, 4])
def test_gradients_of_convolutions(spark, parts):
    rng = np.random.default_rng(8)
    net = convolution.Convolutional.he_init((9, 8, 2), [3, 4, 2], 3, seed=5)
    for p in net.parameters():
        p += rng.normal(0, 0.1, p.shape)
    x, y = rng.normal(0, 1, (12, 144)), rng.integers(0, 3, 12)
    df = spark.createDataFrame([(i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "k long, x array<double>, y int").repartition(parts)
    loss, n, grads = convolution.step(df.select("x", "y", "k"), net)

    def mean_loss():
        z = net.forward(x)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(12), y]).mean())

    assert n == 12 and loss / n == pytest.approx(mean_loss())
    for p, g in zip(net.parameters(), grads, strict=True):
        for at in list(np.ndindex(p.shape))[::7]:
            kept, h = p[at], 1e-6
            p[at] = kept + h
            up = mean_loss()
            p[at] = kept - h
            down = mean_loss()
            p[at] = kept
            assert g[at] == pytest.approx((up - down) / (2 * h), abs=1e-5, rel=1e-3)


def test_convolution_forward_by_loops():
    rng = np.random.default_rng(9)
    net = convolution.Convolutional.he_init((4, 6, 2), [3], 2)
    x = rng.normal(0, 1, (2, 48))
    image, (w, b) = x.reshape(2, 4, 6, 2), net.blocks[0]
    z = np.zeros((2, 4, 6, 3))
    for n, r, c, o in np.ndindex(z.shape):
        z[n, r, c, o] = b[o] + sum(
            image[n, r + i - 1, c + j - 1, k] * w[(i * 3 + j) * 2 + k, o] for i in range(3) for j in range(3) for k in range(2) if 0 <= r + i - 1 < 4 and 0 <= c + j - 1 < 6
        )
    want = np.maximum(z, 0).reshape(2, 2, 2, 3, 2, 3).max(axis=(2, 4))
    assert np.allclose(net.features(x), want.reshape(2, -1))
    with pytest.raises(ValueError, match="halved"):
        convolution.Convolutional.he_init((4, 4, 1), [1, 1, 1], 2)


def test_images_that_do_not_fit(spark):
    net = convolution.Convolutional.he_init((2, 2, 1), [1], 2)
    df = spark.createDataFrame([(1, [0.0] * 4), (2, [0.0] * 3), (3, None), (4, [None] * 4)], "id long, px array<float>")
    assert {r.id: r.z is None for r in convolution.outputs(df, "id", "px", net).collect()} == {1: False, 2: True, 3: True, 4: True}


def test_training_moves_the_loss(spark):
    rng = np.random.default_rng(1)
    y = np.arange(60) % 2
    x = rng.normal(0, 0.3, (60, 64)) + y[:, None]
    df = spark.createDataFrame([(i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "k long, x array<double>, y int").select("x", "y", "k")
    history = convolution.fit(df, convolution.Convolutional.he_init((8, 8, 1), [2, 3, 4], 2), epochs=6)
    assert history[-1] < 0.7 * history[0]


def test_bundle(spark, tmp_path):
    base = f"file://{tmp_path}/models"
    assert bundle.current(spark, base) is None
    assert bundle.save_if_better(spark, base, {"model.json": "[1]", "prep.json": "{}"}, 0.7, examples=[([1.0], 0.25)]) == ("v000001", True)
    assert bundle.save_if_better(spark, base, {"model.json": "[2]"}, 0.7) == ("v000001", False)
    assert bundle.save_if_better(spark, base, {"model.json": "[3]"}, 0.9, examples=[([1.0], 0.5)]) == ("v000002", True)
    assert bundle.amend(spark, base, 0.3) == "v000003"
    held = bundle.current(spark, base)
    assert (held.files, held.metric, held.threshold, held.examples) == ({"model.json": "[3]"}, 0.9, 0.3, [([1.0], 0.5)])
    assert bundle.open_version(spark, base, "v000001").files["prep.json"] == "{}"
    assert held.parity([0.50001]) < 1e-4
    with pytest.raises(ValueError, match="scores its examples otherwise"):
        held.parity([0.51])
    # an unfinished version is not opened, and a changed file is noticed
    (tmp_path / "models" / "v000009").mkdir()
    with pytest.raises(ValueError, match="no finished bundle"):
        bundle.open_version(spark, base, "v000009")
    assert bundle.save(spark, base, {"a": "b"}) == "v000010"
    bundle.Folder(spark, base).write("v000010/a", "c")
    with pytest.raises(ValueError, match="not the file"):
        bundle.current(spark, base)
    with pytest.raises(ValueError, match="no name"):
        bundle.save(spark, base, {"manifest.json": "x"})


def test_images(spark, tmp_path):
    rng = np.random.default_rng(3)
    grey, colour = rng.integers(0, 256, (5, 7)), rng.integers(0, 256, (4, 6, 3))
    (tmp_path / "g.png").write_bytes(images.png(grey))
    (tmp_path / "c.png").write_bytes(images.png(colour))
    (tmp_path / "bad.png").write_bytes(b"no image")
    path = f"file://{tmp_path}"
    rows = images.read_images(spark, path).withColumn("px", images.gray(F.col("data"), F.col("channels")))
    rows = rows.withColumn("small", images.resized(F.col("px"), F.col("width"), F.col("height"), 3))
    found = {r.path.rsplit("/", 1)[1]: r for r in rows.collect()}
    assert set(found) == {"g.png", "c.png"} and found["g.png"].px == grey.ravel().tolist()
    mixed = np.floor((colour @ np.array([299, 587, 114]) + 500) / 1000).astype(int)
    assert found["c.png"].px == mixed.ravel().tolist()
    for name, image in (("g.png", grey), ("c.png", mixed)):
        h, w = image.shape
        r, c = (np.clip((np.arange(3) + 0.5) * n / 3 - 0.5, 0, n - 1) for n in (h, w))
        r0, c0 = np.floor(r).astype(int), np.floor(c).astype(int)
        r1, c1 = np.minimum(r0 + 1, h - 1), np.minimum(c0 + 1, w - 1)
        fr, fc = (r - r0)[:, None], c - c0
        want = (image[r0][:, c0] * (1 - fc) + image[r0][:, c1] * fc) * (1 - fr) + (image[r1][:, c0] * (1 - fc) + image[r1][:, c1] * fc) * fr
        assert np.allclose(found[name].small, want.ravel())
    assert [r.path.rsplit("/", 1)[1] for r in images.unreadable(spark, path).collect()] == ["bad.png"]


def test_small_batches_equal_one_process(spark):
    x, y = two_classes(70)
    df = labelled(spark, (x - 50).round(3), y, 5)
    model, history = train.fit_local(df, "x", "y", "id", [3, 4, 1], epochs=3, dropout=0.2)
    keys = {r.id: r.k for r in df.select("id", F.xxhash64("id").alias("k")).collect()}
    orders = [[r.id for r in df.select("id", F.xxhash64(F.lit(e), F.xxhash64("id")).alias("h")).orderBy("h").collect()] for e in range(3)]
    net, adam, want = train.he_init([3, 4, 1]), train.Adam(5e-3, 1e-3), []
    params = [p for la in net.layers for p in (la.weights, la.bias)]
    for e, order in enumerate(orders):
        loss = 0.0
        for lo in range(0, 70, 16):
            own = order[lo : lo + 16]
            value, grads = train.gradients(net, (x - 50).round(3)[own], y[own].astype(float), 1.0, np.array([keys[i] for i in own]), 0.2, e)
            adam.step(params, [g / len(own) for g in grads])
            loss += value
        want.append(loss / 70)
    assert np.allclose(history, want) and all(np.allclose(a.weights, b.weights) for a, b in zip(model.layers, net.layers, strict=True))


def test_small_batches_on_workers(spark):
    x, y = two_classes(120)
    df = labelled(spark, (x - 50) / 3, y, 5)
    _, history = train.fit_local(df, "x", "y", "id", [3, 6, 1], epochs=6, workers=3, lr=0.02)
    again = train.fit_local(df.repartition(2), "x", "y", "id", [3, 6, 1], epochs=6, workers=3, lr=0.02)[1]
    assert np.allclose(history, again) and history[-1] < history[0]
    assert train.fit_local(df.where("false"), "x", "y", "id", [3, 6, 1], epochs=2)[1] == []


def test_late_requests_are_counted(spark, tmp_path):
    source, out, at = (f"file://{tmp_path}/{n}" for n in ("in", "out", "at"))

    def arrive(rows):
        df = spark.createDataFrame(rows, "t string, ms long").select(F.to_timestamp("t").alias("ts"), "ms")
        df.select("ts", F.timestamp_micros(F.unix_micros("ts") + F.col("ms") * 1000).alias("scored")).coalesce(1).write.mode("append").parquet(source)
        windows = latency.latency_windows(scoring.file_stream(spark, source, spark.read.parquet(source).schema), "ts", "scored")
        return latency.run_available(windows, out, at)

    day = "2024-01-01 "
    assert arrive([(day + "00:05:00", 10), (day + "00:10:00", 30), (day + "00:20:00", -5), (day + "02:30:00", 7)]) == latency.Run(4, 0)
    # the first window is closed: this row comes too late, the other one opens a new window
    assert arrive([(day + "00:15:00", 1000), (day + "05:00:00", 1)]).n_late == 1
    found = [(str(r.window_start), r.n, r.mean_ms, r.tail_ms, r.max_ms) for r in spark.read.parquet(out).orderBy("window_start").collect()]
    assert found == [("2024-01-01 00:00:00", 2, 20.0, 30.0, 30.0), ("2024-01-01 02:00:00", 1, 7.0, 7.0, 7.0)]


def test_tail_latency_of_large_windows_is_exact(spark):
    n, share = 30_000, 0.95
    ms = np.random.default_rng(3).permutation(3 * n)[:n]
    rows = spark.createDataFrame([(int(v),) for v in ms], "ms long").repartition(7)
    requests = rows.select(F.lit("2024-01-01 00:05:00").cast("timestamp").alias("ts"), "ms").withColumn("scored", F.timestamp_micros(F.unix_micros("ts") + F.col("ms") * 1000))
    found = latency.latency_windows(requests, "ts", "scored", tail=share).first()
    assert (found.n, found.tail_ms, found.max_ms) == (n, float(np.sort(ms)[n * 95 // 100 - 1]), float(ms.max()))


def test_attributions_equal_enumeration(spark):
    x, y = two_classes(200, 3)
    x = x.round(2)
    df = labelled(spark, x, y).select("id", array_to_vector("x").alias("x"), F.col("y").cast("double").alias("y"))
    forest = RandomForestClassifier(numTrees=3, maxDepth=3, featuresCol="x", labelCol="y", seed=1).fit(df)
    nodes = attribution.node_table(forest, spark)
    trees = {}
    for r in nodes.collect():
        trees.setdefault(r.tree, {})[r.id] = r

    def given(tree, at, row, known):
        """The tree's mean prediction where only the known features decide."""
        n = tree[at]
        if n.left < 0:
            return n.positive
        if n.feature in known:
            return given(tree, n.left if row[n.feature] <= n.threshold else n.right, row, known)
        return sum(tree[c].cover / n.cover * given(tree, c, row, known) for c in (n.left, n.right))

    def mean(row, known):
        return sum(given(t, 0, row, known) for t in trees.values()) / len(trees)

    found = {r.id: r for r in attribution.attributed(df.withColumn("x", vector_to_array("x")), attribution.paths_of(nodes), "id").collect()}
    p = {r.id: r.p for r in models.Fit(forest).scored(df).collect()}
    for i in range(0, 200, 23):
        want = [0.0] * 3
        for j in range(3):
            others = [f for f in range(3) if f != j]
            for s in ([], others[:1], others[1:], others):
                weight = math.factorial(len(s)) * math.factorial(2 - len(s)) / 6
                want[j] += weight * (mean(x[i], {*s, j}) - mean(x[i], set(s)))
        assert np.allclose(found[i].phi, want) and found[i].base == pytest.approx(mean(x[i], set()))
    assert all(r.base + sum(r.phi) == pytest.approx(p[i], abs=1e-9) for i, r in found.items())
    ranked = attribution.mean_magnitude(spark.createDataFrame([([0.1, -0.5],), ([0.2, 0.1],)], "phi array<double>")).collect()
    assert [r.feature for r in ranked] == [1, 0]
