"""Golden values, edges and properties of the operators outside the training-data subpackage."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.nn import layers, train
from tessera.operators import clean, encode, metrics, split, training
from tessera.prep import TabularPreprocessor, TabularState
from tessera.spec import TableSpec

SCORES = "id long, y long, p double"


def expand(spark, tn, fp, fn, tp):
    rows = [(0, 0.0)] * tn + [(0, 1.0)] * fp + [(1, 0.0)] * fn + [(1, 1.0)] * tp
    return spark.createDataFrame([(i, y, p) for i, (y, p) in enumerate(rows)], SCORES)


def test_golden_report(spark):
    rows = {r["class"]: r for r in metrics.imbalanced_report(expand(spark, 28, 5, 1, 27)).collect()}
    one = rows["1"]
    assert [round(one[c], 3) for c in ("pre", "rec", "spe", "geo", "iba")] == [0.844, 0.964, 0.848, 0.905, 0.828]
    assert round(rows["avg"]["iba"], 3) == 0.817 and round(rows["avg"]["f1"], 3) == 0.902
    assert one["sup"] == 28 and rows["avg"]["sup"] == 61


def test_golden_confusion(spark):
    r = metrics.confusion(expand(spark, 10645, 1790, 928, 2918)).select(*[c.alias(n) for n, c in metrics.rates().items()]).first()
    assert round(r["accuracy"], 4) == 0.8331
    assert [round(r[c], 3) for c in ("precision", "recall", "f1", "specificity")] == [0.620, 0.759, 0.682, 0.856]


@pytest.mark.parametrize(
    ("rows", "auc"),
    [
        ([(1, 0.9), (0, 0.1)], 1.0),
        ([(1, 0.5), (0, 0.5), (1, 0.5)], 0.5),
        ([(1, 0.5), (1, 0.7)], None),
        ([], None),
        ([(1, 0.8), (0, 0.8), (0, 0.2), (1, 0.2)], 0.5),
    ],
)
def test_auc_edges(spark, rows, auc):
    df = spark.createDataFrame([(i, y, p) for i, (y, p) in enumerate(rows)], SCORES)
    assert metrics.auc(df).first()["auc"] == auc


def test_auc_is_rank_based(spark):
    df = spark.range(200).select("id", (F.col("id") * 7919 % 3 == 0).cast("long").alias("y"), ((F.col("id") * 31 % 50) / 50).alias("p"))
    a, b = metrics.auc(df).first()["auc"], metrics.auc(df.withColumn("p", F.exp("p") * 3)).first()["auc"]
    assert math.isclose(a, b)


def test_sweep_equals_exploded(spark):
    df = spark.range(500).select("id", (F.col("id") % 4 == 0).cast("long").alias("y"), (F.col("id") * 37 % 101 / 100.0).alias("p"))
    sweep = {r["i"]: (r["tn"], r["fp"], r["fn"], r["tp"]) for r in metrics.threshold_sweep(df).collect()}
    rows = [(r["y"], r["p"]) for r in df.collect()]
    for i in range(91):
        t = 0.05 + i * 0.01
        want = tuple(sum(1 for y, p in rows if y == a and (p >= t) == b) for a, b in ((0, False), (0, True), (1, False), (1, True)))
        assert sweep[i] == want


def test_empty_scores(spark):
    empty = spark.createDataFrame([], SCORES)
    assert metrics.confusion(empty).first().asDict() == {"tn": 0, "fp": 0, "fn": 0, "tp": 0}
    assert metrics.average_precision(empty).first()[0] is None
    assert metrics.roc_curve(empty).count() == 1


def test_split_counts(spark):
    df = spark.range(1003).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"))
    got = {(r["y"], r["is_val"]): r["count"] for r in split.stratified_split(df, "id", "y", 0.2).groupBy("y", "is_val").count().collect()}
    for y, n in ((0, 668), (1, 335)):
        assert got[(y, True)] == int(n * 0.2) and got[(y, False)] == n - int(n * 0.2)
    again = split.stratified_split(df.repartition(7), "id", "y", 0.2)
    assert again.exceptAll(split.stratified_split(df, "id", "y", 0.2)).count() == 0


def test_clean_edges(spark):
    rows = [(1, None, "a"), (2, float("nan"), "b"), (3, float("inf"), None), (4, 2.0, "a")]
    df = spark.createDataFrame(rows, "id long, x double, c string")
    assert [r["id"] for r in clean.drop_any_null_or_nan(df).collect()] == [4]
    assert [r[0] for r in df.orderBy("id").select(clean.coerce_numeric("x")).collect()] == [None, None, None, 2.0]
    assert clean.mode_of(df, "c") == "a"
    assert clean.fill_mode(df.where("false"), "c").count() == 0
    text = spark.createDataFrame([(" >50K.",), (">50K",), ("<=50K.",), (None,)], "t string")
    assert [r[0] for r in text.select(clean.binarize_text("t", ">50K")).collect()] == [1, 1, 0, None]


def test_row_index_has_no_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = clean.row_index(df, ["k"])
    assert got.where("idx <> k").count() == 0 and got.count() == 1000


def test_woe_zero_cell(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 0), ("c", 1), ("c", 0)], "c string, y int")
    plain = {r["cat"]: r["woe"] for r in encode.weight_of_evidence(df, "c", "y").collect()}
    assert plain["a"] is None and plain["b"] is None and math.isclose(plain["c"], math.log((1 / 3) / (1 / 2)))
    smooth = {r["cat"]: r["woe"] for r in encode.weight_of_evidence(df, "c", "y", 0.5).collect()}
    assert all(math.isfinite(v) for v in smooth.values())


def test_contrasts_sum_to_zero(spark):
    fitted = spark.createDataFrame([(c, i) for i, c in enumerate("abcde", 1)], "cat string, code long")
    for f in (encode.sum_contrast, encode.backward_difference, encode.helmert, encode.polynomial):
        cols = [c for c in f(fitted, 5).columns if c != "cat"]
        sums = f(fitted, 5).agg(*[F.sum(c).alias(c) for c in cols]).first()
        assert all(abs(v) < 1e-9 for v in sums)
    v = np.array(encode.polynomial_values(5))
    assert np.allclose(v @ v.T, np.eye(4))


def test_ordered_statistic_first_takes_prior(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 0), (3, "b", 1)], "id long, c string, y int")
    got = {r["id"]: r["ots"] for r in encode.ordered_statistic(df, "c", "y", "id", 0.25).collect()}
    assert got == {1: 0.25, 2: (1 + 0.25) / 2, 3: 0.25}


def test_random_intercepts_shrink(spark):
    df = spark.range(400).select(F.when(F.col("id") < 200, "a").otherwise("b").alias("c"), ((F.col("id") < 200) & (F.col("id") % 4 > 0)).cast("int").alias("y"))
    got = {r["cat"]: r["glmm"] for r in encode.random_intercept(df, "c", "y").collect()}
    assert got["a"] > 0 > got["b"]


def spec():
    return TableSpec(numeric=("x", "flat"), log_numeric=("x",), categorical=("c",))


def frame(spark, n=100):
    return spark.range(n).select(
        "id", F.when(F.col("id") % 9 == 0, None).otherwise(F.col("id").cast("double")).alias("x"), F.lit(5.0).alias("flat"),
        F.when(F.col("id") % 7 == 0, "").otherwise(F.concat(F.lit("k"), (F.col("id") % 3).cast("string"))).alias("c"), (F.col("id") % 5 == 0).alias("val"),
    )


def test_preprocessor_properties(spark):
    df = frame(spark)
    prep = TabularPreprocessor(spec()).fit(df, ~F.col("val"))
    train_rows = prep.transform_wide(df.where("not val"))
    r = train_rows.agg(F.avg("x"), F.stddev_samp("x"), F.avg("flat")).first()
    assert abs(r[0]) < 1e-9 and abs(r[1] - 1) < 1e-9 and r[2] == 0.0  # a constant column has deviation 1
    assert prep.state.vocabularies["c"] == ["Unknown", "k0", "k1", "k2"]
    back = TabularPreprocessor(spec(), state=TabularState.from_json(prep.state.to_json()))
    assert prep.transform_wide(df, "id").exceptAll(back.transform_wide(df, "id")).count() == 0
    unseen = df.limit(1).withColumn("c", F.lit("new"))
    assert sum(prep.transform_wide(unseen).first()[2:]) == 0.0
    assert len(prep.transform(df).first()["features"]) == prep.state.n_features == 6


def test_preprocessor_learns_from_training_rows_only(spark):
    df = frame(spark)
    a = TabularPreprocessor(spec()).fit(df, ~F.col("val")).state
    b = TabularPreprocessor(spec()).fit(df.withColumn("x", F.when(F.col("val"), 1e9).otherwise(F.col("x"))), ~F.col("val")).state
    assert a == b


def test_preprocessor_pathological(spark):
    df = frame(spark)
    prep = TabularPreprocessor(spec()).fit(df)
    rows = [(1, None, None, None), (2, float("inf"), 5.0, "k1"), (3, float("nan"), -1e300, ""), (4, -5.0, 5.0, "zzz")]
    got = prep.transform(spark.createDataFrame(rows, "id long, x double, flat double, c string"), "id").collect()
    assert all(v is not None and not math.isnan(v) for r in got for v in r["features"])
    assert TabularPreprocessor(spec()).fit(df.where("false")).state.medians == {"x": 0.0, "flat": 0.0}


def test_parameter_counts():
    assert layers.parameter_count([95, 64, 32, 1]) == 8353
    assert layers.parameter_count([13, 16, 8, 1], batch_norm=False) == 369
    assert layers.convolution_parameters([1, 16, 32, 64]) + layers.parameter_count([576, 128, 10], batch_norm=False) == 98554


def test_batch_norm_folding():
    rng = np.random.default_rng(0)
    w, x = rng.normal(size=(5, 3)), rng.normal(size=(7, 5))
    g, b, m, v = rng.normal(size=3), rng.normal(size=3), rng.normal(size=3), rng.random(3) + 0.1
    want = np.maximum((x @ w - m) / np.sqrt(v + 1e-5) * g + b, 0)
    assert np.allclose(layers.fold_batch_norm(w, g, b, m, v).forward(x), want)


def test_gradients_numerically():
    rng = np.random.default_rng(1)
    model, x, y = train.he_init([4, 3, 1], 3), rng.normal(size=(6, 4)), rng.integers(0, 2, 6).astype(float)
    _, grads = train.gradients(model, x, y, 2.0)
    params = [p for la in model.layers for p in (la.weights, la.bias)]
    for p, g in zip(params, grads, strict=True):
        for i in range(p.size):
            old = p.flat[i]
            p.flat[i] = old + 1e-6
            up = train.gradients(model, x, y, 2.0)[0]
            p.flat[i] = old - 1e-6
            down = train.gradients(model, x, y, 2.0)[0]
            p.flat[i] = old
            assert abs((up - down) / 2e-6 - g.flat[i]) < 1e-4


def test_training_lowers_loss(spark):
    df = spark.range(400).select("id", F.array((F.col("id") % 2).cast("double"), F.lit(1.0)).alias("x"), (F.col("id") % 2).alias("y"))
    _, history = train.fit(df, "x", "y", "id", [2, 4, 1], epochs=6, batches=2, lr=0.05)
    assert history[-1] < history[0]


def test_convolution_and_pool():
    image = np.arange(64.0).reshape(1, 1, 8, 8)
    same = layers.conv2d(image, np.pad(np.ones((1, 1, 1, 1)), ((0, 0), (0, 0), (1, 1), (1, 1))), np.zeros(1))
    assert np.array_equal(same, image)
    assert layers.max_pool2(image)[0, 0].tolist() == [[9 + 16 * r + 2 * c for c in range(4)] for r in range(4)]


def test_plateau_and_stop(spark):
    losses = [1.0, 0.9, 0.95, 0.96, 0.97, 0.8]
    h = spark.createDataFrame(list(enumerate(losses)), "e long, m double")
    lr = {r["epoch"]: r["lr"] for r in training.reduce_on_plateau(h, "e", "m", 1.0).collect()}
    assert [lr[i] for i in range(6)] == [1.0, 1.0, 1.0, 1.0, 0.5, 0.5]
    assert training.stop_epoch(h, "e", "m", 3).first()[0] == 4
    assert training.stop_epoch(h, "e", "m", 9).first()[0] == 5


def test_scalar_functions(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "z array<double>")
    r = df.select(scalar.argmax("z").alias("a"), scalar.top_indexes("z", 2).alias("t"), scalar.softmax("z").alias("s")).first()
    assert r["a"] == 1 and list(r["t"]) == [1, 2] and abs(sum(r["s"]) - 1) < 1e-12
    big = spark.createDataFrame([(1000.0, 1), (-1000.0, 1)], "z double, y int")
    assert [x[0] for x in big.select(scalar.bce_with_logits("z", "y")).collect()] == [0.0, 1000.0]


def test_contract_and_reconcile(spark):
    df = spark.createDataFrame([(150.0, 3), (None, 99), (20.0, 5)], "age double, edu int")
    got = [r[0] for r in df.select(clean.contract_errors({"age": (0, 120), "edu": (1, 16)})).collect()]
    assert got == ["age", "edu", ""]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1


def test_cumulative_equals_running_sums(spark):
    import random

    from tessera.operators import clean

    rng = random.Random(1)
    rows = [(i, rng.randrange(20), rng.randrange(5), None if i % 9 == 0 else rng.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k int, a int, v double").repartition(7)
    got = {r["id"]: (r["sa"], r["sv"]) for r in clean.cumulative(df, [F.desc("k"), F.asc("id")], {"sa": "a", "sv": "v"}).collect()}
    sa, sv = 0, 0.0
    for i, _, a, v in sorted(rows, key=lambda r: (-r[1], r[0])):
        assert got[i][0] == sa and got[i][1] == pytest.approx(sv)
        sa, sv = sa + a, sv + (v or 0.0)
    assert clean.cumulative(df.where("false"), ["id"], {"s": "a"}).count() == 0


def test_rank_plans_have_no_window_over_the_whole_table(spark):
    from tessera.operators import encode, metrics, profile

    df = spark.createDataFrame([(i, i % 2, i / 7, str(i % 3)) for i in range(50)], "id long, y long, p double, c string")
    frames = [metrics.auc(df), metrics.average_precision(df), metrics.roc_curve(df), metrics.pr_curve(df), metrics.mid_ranks(df, "p"),
              metrics.roc_curve_grouped(df), encode.codes(df, "c", "id"), encode.ordered_statistic(df, "c", "y", "id", 0.5), profile.vocabulary(df, "c")]
    for f in frames:
        plan = f._jdf.queryExecution().optimizedPlan().toString()
        assert all(", [_part#" in line or "[_part#" in line for line in plan.split("\n") if line.strip(" :+-").startswith("Window"))


def test_encoders_for_new_rows(spark):
    from tessera.operators import encode

    df = spark.createDataFrame([("a", 1), ("a", 0), ("a", 1), ("b", 0)], "c string, y int")
    loo, prior = encode.leave_one_out_new(df, "c", "y")
    assert {r["cat"]: r["loo"] for r in loo.collect()} == pytest.approx({"a": 2 / 3, "b": 0.0}) and prior == 0.5
    ots, _ = encode.ordered_statistic_new(df, "c", "y", a=1.0)
    assert {r["cat"]: r["ots"] for r in ots.collect()} == pytest.approx({"a": 2.5 / 4, "b": 0.5 / 2})


def test_threshold_parameter_is_checked(spark):
    from tessera.streaming import scoring

    for t in (0.0, 1.0, -1.0, 2.0):
        with pytest.raises(ValueError, match="between 0 and 1"):
            scoring.score_stream(spark.range(1), F.lit(0.5), t)


def test_training_by_protocol(spark):
    import numpy as np

    from tessera.nn import train

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] + x[:, 1] > 0.5).astype(int)
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(300)], "id long, x array<double>, y int")
    chosen = train.fit_selected(df.where("id < 200"), df.where("id >= 200"), "x", "y", "id", [2, 8, 1], epochs=6, patience=2, batches=2, lr=0.05, dropout=0.1)
    best = max(v for *_, v in chosen.history)
    kept = train.probabilities(df.where("id >= 200"), "x", "y", "id", train.Selected.from_json(chosen.to_json()).model)
    from tessera.operators import metrics

    assert metrics.auc(kept).first()["auc"] == pytest.approx(best) and best > 0.9 and 0.05 <= chosen.threshold <= 0.95
    mask = train.dropout_mask(np.arange(20000), 4, 0.3, 5)
    assert abs((mask == 0).mean() - 0.3) < 0.01 and np.array_equal(mask, train.dropout_mask(np.arange(20000), 4, 0.3, 5))


def test_scores_of_odd_arrays(spark):
    import numpy as np

    from tessera.nn import layers, score

    net = layers.Mlp([layers.Dense(np.ones((2, 1)), np.zeros(1), relu=False)])
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [1.0, 2.0, 3.0])], "id long, x array<double>")
    assert {r["id"]: r["z"] for r in score.score_arrays(df, "id", "x", net.forward).collect()} == {1: [3.0], 2: None, 3: None, 4: None, 5: None}
