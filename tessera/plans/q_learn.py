"""Queries on classifiers from moments, boosting, neighbours, order statistics and normalized networks, with SQL where results are exact."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.learn import attribution, moments, neighbours, stumps
from tessera.nn import convolution, layers, normalized, score, train
from tessera.operators import metrics, quantiles, split
from tessera.plans import models, q_models
from tessera.plans.frames import HOLED_SQL, ORDERS_SQL, holed_customers, labelled_orders, read
from tessera.prep.folded import FoldedSetup
from tessera.sources import bundle, files, images, infer
from tessera.sources.scratch import stored
from tessera.streaming import latency, scoring

QUERIES: dict = {}
_D = "::DOUBLE"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


#: Two features of orders: price in 100,000, and a remainder of the customer's key.
_PAIR_SQL = f"SELECT o_orderkey AS id, y, o_totalprice / 100000{_D} AS a, (o_custkey % 97) / 10{_D} AS b FROM ({ORDERS_SQL})"


def _pairs(s, d):
    x = F.array(F.col("o_totalprice") / 100000.0, (F.col("o_custkey") % 97) / 10.0)
    return labelled_orders(s, d).select(F.col("o_orderkey").alias("id"), x.alias("x"), "y")


#: Per class: n, means, and centred sums of squares and products; then as one row.
_MOMENTS = f"""p AS ({_PAIR_SQL}), k AS (SELECT y, count(*) AS n, avg(a) AS ma, avg(b) AS mb FROM p GROUP BY y),
s AS (SELECT p.y, sum((a - ma) * (a - ma)) AS aa, sum((a - ma) * (b - mb)) AS ab, sum((b - mb) * (b - mb)) AS bb FROM p JOIN k ON p.y = k.y GROUP BY p.y),
m AS (SELECT k0.n AS n0, k1.n AS n1, k0.ma AS a0, k1.ma AS a1, k0.mb AS b0, k1.mb AS b1, s0.aa AS aa0, s0.ab AS ab0, s0.bb AS bb0, s1.aa AS aa1, s1.ab AS ab1, s1.bb AS bb1
FROM k k0, k k1, s s0, s s1 WHERE k0.y = 0 AND k1.y = 1 AND s0.y = 0 AND s1.y = 1)"""


def _named(s, weights, intercept):
    values = [("a", float(weights[0])), ("b", float(weights[1])), ("intercept", float(intercept))]
    return s.createDataFrame(values, "term string, value double").select("term", F.round("value", 9).alias("value"))


@query(f"""WITH {_MOMENTS}, c AS (SELECT *, (aa0 + aa1) / (n0 + n1 - 2) AS aa, (ab0 + ab1) / (n0 + n1 - 2) AS ab, (bb0 + bb1) / (n0 + n1 - 2) AS bb FROM m),
w AS (SELECT *, (bb * (a1 - a0) - ab * (b1 - b0)) / (aa * bb - ab * ab) AS wa, (aa * (b1 - b0) - ab * (a1 - a0)) / (aa * bb - ab * ab) AS wb FROM c)
SELECT t.term, round(CASE t.term WHEN 'a' THEN wa WHEN 'b' THEN wb ELSE -(wa * (a0 + a1) + wb * (b0 + b1)) / 2 + ln(n1 / CAST(n0 AS DOUBLE)) END, 9) AS value FROM w, (VALUES ('a'), ('b'), ('intercept')) t(term)""")
def discriminant_coefficients(s, d):
    """Linear discriminant of the orders' status by two features."""
    found = moments.linear_discriminant(moments.Moments.of(_pairs(s, d)))
    return _named(s, found.weights, found.intercept)


@query(f"""WITH {_MOMENTS}, t AS (SELECT *, (n0 * a0 + n1 * a1) / (n0 + n1) AS ma, (n0 * b0 + n1 * b1) / (n0 + n1) AS mb, (n1 - n0) / CAST(n0 + n1 AS DOUBLE) AS mt FROM m),
c AS (SELECT *, aa0 + aa1 + n0 * (a0 - ma) * (a0 - ma) + n1 * (a1 - ma) * (a1 - ma) + 5 AS aa, bb0 + bb1 + n0 * (b0 - mb) * (b0 - mb) + n1 * (b1 - mb) * (b1 - mb) + 5 AS bb,
ab0 + ab1 + n0 * (a0 - ma) * (b0 - mb) + n1 * (a1 - ma) * (b1 - mb) AS ab, n0 * (a0 - ma) * (-1 - mt) + n1 * (a1 - ma) * (1 - mt) AS ta, n0 * (b0 - mb) * (-1 - mt) + n1 * (b1 - mb) * (1 - mt) AS tb FROM t),
w AS (SELECT *, (bb * ta - ab * tb) / (aa * bb - ab * ab) AS wa, (aa * tb - ab * ta) / (aa * bb - ab * ab) AS wb FROM c)
SELECT u.term, round(CASE u.term WHEN 'a' THEN wa WHEN 'b' THEN wb ELSE mt - wa * ma - wb * mb END, 9) AS value FROM w, (VALUES ('a'), ('b'), ('intercept')) u(term)""")
def ridge_coefficients(s, d):
    """Ridge classifier (alpha 5) of the orders' status by two features."""
    found = moments.ridge(moments.Moments.of(_pairs(s, d)), 5.0)
    return _named(s, found.weights, found.intercept)


def _density(k: int) -> str:
    aa, ab, bb = (f"{v}{k} / (n{k} - 1)" for v in ("aa", "ab", "bb"))
    det = f"({aa} * ({bb}) - ({ab}) * ({ab}))"
    da, db = f"(a - a{k})", f"(b - b{k})"
    return f"ln(n{k} / CAST(n0 + n1 AS DOUBLE)) - 0.5{_D} * ln({det}) - 0.5{_D} * (({bb}) * {da} * {da} - 2 * ({ab}) * {da} * {db} + ({aa}) * {db} * {db}) / {det}"


@query(f"WITH {_MOMENTS} SELECT id, y, round(1 / (1 + exp(-(({_density(1)}) - ({_density(0)})))), 9) AS p FROM p, m")
def quadratic_discriminant_scores(s, d):
    """Every order scored by a quadratic discriminant of two features."""
    rows = _pairs(s, d)
    found = moments.quadratic_discriminant(moments.Moments.of(rows), 0.0)
    return found.scored(rows).select("id", "y", F.round("p", 9).alias("p"))


@query(f"""WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0), c AS (SELECT q.vec_id AS query, e.vec_id AS id, e.label AS y,
list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))) AS distance FROM q, embeddings e WHERE e.vec_id % 20 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(distance, 9), id) AS rank FROM c)
SELECT query, id, CAST(y AS BIGINT) AS y, CAST(rank AS INTEGER) AS rank, round(distance, 6) AS distance FROM r WHERE rank <= 5""")
def nearest_neighbours(s, d):
    """The five nearest vectors of every twentieth vector, among all others."""
    e = read(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), F.col("label").alias("y"))
    found = neighbours.neighbours(e.where("id % 20 <> 0"), e.where("id % 20 = 0"), 5)
    return found.select("query", "id", "y", "rank", F.round("distance", 6).alias("distance"))


def _cut_sql(column: str, feature: int) -> str:
    return " UNION ALL ".join(f"SELECT {feature} AS feature, {i} AS cut_no, quantile_cont({column}, {i / 8}) AS cut FROM p" for i in range(1, 8))


@query(f"""WITH p AS ({_PAIR_SQL}), c AS ({_cut_sql("a", 0)} UNION ALL {_cut_sql("b", 1)}),
e AS (SELECT feature, cut_no, cut, avg(CASE WHEN (CASE feature WHEN 0 THEN a ELSE b END > cut) <> (y = 1) THEN 1.0{_D} ELSE 0.0{_D} END) AS wrong FROM p, c GROUP BY 1, 2, 3),
o AS (SELECT feature, cut_no, cut, 1.0{_D} AS side, wrong AS error FROM e UNION ALL SELECT feature, cut_no, cut, -1.0{_D}, 1 - wrong FROM e)
SELECT feature, round(cut, 9) AS cut, side, round(0.5{_D} * ln((1 - error) / error), 9) AS weight FROM o ORDER BY round(error, 12), side DESC, feature, cut_no LIMIT 1""")
def first_stump(s, d):
    """The first stump of adaptive boosting: its cut at an exact quantile, its side and its weight."""
    found = stumps.boosted_stumps(_pairs(s, d), rounds=1, bins=8).stumps
    rows = [(f, round(c, 9), side, round(w, 9)) for f, c, side, w in found]
    return s.createDataFrame(rows, "feature int, cut double, side double, weight double")


@query()
def boosted_stump_scores(s, d):
    """Twenty-five rounds on four folds of vectors; AUC on the fifth and the number of stumps."""
    e = split.folds(read(s, d, "embeddings").select("vec_id", "embedding", (F.col("label") > 4).cast("long").alias("y")), "vec_id", "y", 5)
    rows = stored(e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "y", "fold"))
    model = stumps.boosted_stumps(rows.where("fold <> 0"))
    return metrics.auc(model.scored(rows.where("fold = 0"))).withColumn("n_stumps", F.lit(len(model.stumps)))


_SHARES = (0.01, 0.25, 0.5, 0.75, 0.999)


@query(" UNION ALL ".join(
    f"SELECT l_returnflag, '{c}' AS column_name, {q}{_D} AS share, round(quantile_cont(CAST({c} AS DOUBLE), {q}), 9) AS value, count({c}) AS n FROM lineitem GROUP BY 1"
    for c in ("l_extendedprice", "l_quantity", "l_partkey") for q in _SHARES
))
def grouped_quantiles(s, d):
    """Five exact quantiles of three columns per return flag, no task holding more than 1,024 values of a group."""
    found = quantiles.quantiles(read(s, d, "lineitem"), ["l_extendedprice", "l_quantity", "l_partkey"], _SHARES, by=["l_returnflag"], few=1024)
    return found.select("l_returnflag", "column_name", "share", F.round("value", 9).alias("value"), "n")


@query()
def normalized_training(s, d):
    """A network with batch normalization over the whole protocol's rows: loss of each step on all rows, and the parameters' number."""
    rows = stored(read(s, d, "embeddings").select(F.col("embedding").alias("x"), (F.col("label") > 4).cast("double").alias("y"), F.col("vec_id").alias("k")))
    net, adam, out = normalized.Normalized.he_init([64, 16, 8, 1]), train.Adam(0.01, 1e-4), []
    for step in range(6):
        loss, n, grads = net.step(rows, dropout=0.1, salt=step)
        adam.step(net.parameters(), grads)
        out.append((step, loss / n, sum(p.size for p in net.parameters())))
    return s.createDataFrame(out, "step int, loss double, n_parameters int")


@query()
def leaderboard_summary(s, d):
    """Best, worst and the gap of first and third of the algorithms that need few passes, on five folds."""
    rows = stored(models.as_vectors(split.folds(read(s, d, "embeddings").select("vec_id", "embedding", (F.col("label") > 4).cast("long").alias("y")), "vec_id", "y", 5), "embedding", "y", "vec_id", "fold"))
    board = models.leaderboard(rows, 64, names=("logistic", "linear_discriminant", "quadratic_discriminant", "ridge", "bayes"))
    return metrics.leaderboard_gap(board, "model", "auc")


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END AS o_custkey, CASE WHEN o_custkey % 5 <> 0 THEN o_totalprice END AS o_totalprice,
o_orderkey % 2 = 0 AS is_even, CASE WHEN o_orderkey % 9 = 0 THEN 'none' ELSE CAST(o_orderkey AS VARCHAR) END AS mixed, o_orderpriority, CAST(NULL AS VARCHAR) AS nothing FROM orders""")
def csv_inferred(s, d):
    """Orders written as text with names and three marks of missing values, read back with the types that all rows fit."""
    k = F.col("o_orderkey")
    rows = read(s, d, "orders").select(
        "o_orderkey",
        F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey").cast("string")).otherwise("?").alias("o_custkey"),
        F.when(F.col("o_custkey") % 5 != 0, F.col("o_totalprice").cast("string")).otherwise(F.when(k % 2 == 0, "NA").otherwise("")).alias("o_totalprice"),
        (k % 2 == 0).alias("is_even"),
        F.when(k % 9 == 0, "none").otherwise(k.cast("string")).alias("mixed"),
        "o_orderpriority",
        F.lit("?").alias("nothing"),
    )
    path = files.scratch_path(s, "orders")
    files.write_delimited(rows, path)
    return infer.read_inferred(s, path)


_FOLDED = f"""h AS (SELECT c_custkey, c_custkey % 5 AS fold, c_acctbal AS a, c_mktsegment AS v FROM ({HOLED_SQL})), f AS (SELECT i AS fold FROM range(5) t(i)),
m AS (SELECT f.fold, median(a) AS mid FROM h, f WHERE h.fold <> f.fold GROUP BY 1),
z AS (SELECT m.fold, any_value(mid) AS mid, avg(coalesce(a, mid)) AS mean, stddev_pop(coalesce(a, mid)) AS std FROM h, m WHERE h.fold <> m.fold GROUP BY 1),
c AS (SELECT f.fold, v, row_number() OVER (PARTITION BY f.fold ORDER BY count(*) DESC, v) - 1 AS place FROM h, f WHERE h.fold <> f.fold AND v IS NOT NULL GROUP BY 1, 2),
e AS (SELECT h.*, (coalesce(a, mid) - mean) / std AS z, coalesce(v, (SELECT v FROM c WHERE c.fold = h.fold AND place = 0)) AS w FROM h JOIN z ON z.fold = h.fold)"""


@query(f"""WITH {_FOLDED} SELECT e.c_custkey, e.fold, round(z, 9) AS c_acctbal, CAST(place = 0 AS INTEGER) AS s0, CAST(place = 1 AS INTEGER) AS s1, CAST(place = 2 AS INTEGER) AS s2, CAST(place > 2 AS INTEGER) AS others
FROM e JOIN c ON c.fold = e.fold AND c.v = e.w""")
def folded_setup(s, d):
    """Median, z-score, mode, and indicators of the three commonest segments with the others pooled: every row by the state of its own fold."""
    rows = holed_customers(s, d).withColumn("fold", F.col("c_custkey") % 5)
    setup = FoldedSetup(["c_acctbal"], ["c_mktsegment"], max_one_hot=3).fit(rows)
    coded = setup.one_hot(setup.transform(rows, "c_custkey", "fold"), "c_mktsegment")
    names = {f"c_mktsegment_{i}": n for i, n in enumerate(("s0", "s1", "s2", "others"))}
    return coded.select("c_custkey", "fold", F.round("c_acctbal", 9).alias("c_acctbal"), *[F.col(c).alias(n) for c, n in names.items()])


def _ruled(inputs: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of a 3 x 3 convolution to two channels by a rule: ((7 (3 i + j) + 5 c + 3 o + 1) mod 11 - 5) / 10; biases (o + 1) / 10."""
    i, j, c, o = np.meshgrid(range(3), range(3), range(inputs), range(2), indexing="ij")
    return (((7 * (3 * i + j) + 5 * c + 3 * o + 1) % 11 - 5) / 10.0).reshape(9 * inputs, 2), np.array([0.1, 0.2])


def _block_sql(source: str, size: int) -> str:
    """Rows (vec_id, r, c, ch, v) after a block."""
    return f"""SELECT vec_id, r // 2 AS r, c // 2 AS c, o AS ch, max(v) AS v FROM (
SELECT x.vec_id, x.r - i + 1 AS r, x.c - j + 1 AS c, o, greatest(0.0{_D}, (o + 1) / 10.0{_D} + sum(x.v * (((7 * (3 * i + j) + 5 * x.ch + 3 * o + 1) % 11 - 5) / 10.0{_D}))) AS v
FROM {source} x, range(3) a(i), range(3) b(j), range(2) w(o) WHERE x.r - i + 1 BETWEEN 0 AND {size - 1} AND x.c - j + 1 BETWEEN 0 AND {size - 1} GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3, 4"""


@query(f"""WITH p AS (SELECT vec_id, (i - 1) // 8 AS r, (i - 1) % 8 AS c, 0 AS ch, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(i)),
x1 AS ({_block_sql("p", 8)}), x2 AS ({_block_sql("x1", 4)}), x3 AS ({_block_sql("x2", 2)})
SELECT vec_id, CAST(2 AS INTEGER) AS blocks, CAST(r * 4 + c * 2 + ch AS INTEGER) AS place, round(v, 6) AS value FROM x2 UNION ALL SELECT vec_id, 3, CAST(ch AS INTEGER), round(v, 6) FROM x3""")
def convolution_blocks(s, d):
    """All values after two and three blocks of two channels on 8 x 8 images."""
    net = convolution.Convolutional((8, 8, 1), [_ruled(1), _ruled(2), _ruled(2)], np.zeros((2, 2)), np.zeros(2))
    e, out = read(s, d, "embeddings"), None
    for depth in (2, 3):
        part = convolution.outputs(e, "vec_id", "embedding", net, depth)
        part = part.select("vec_id", F.lit(depth).alias("blocks"), F.posexplode("z").alias("place", "v")).select("vec_id", "blocks", "place", F.round("v", 6).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


@query()
def convolution_training(s, d):
    """Three blocks on 8 x 8 images of ten classes: loss of each epoch, and at the end the share of held-out images that are classed right."""
    e = read(s, d, "embeddings").select(F.col("embedding").alias("x"), F.col("label").cast("int").alias("y"), F.col("vec_id").alias("k"))
    rows = stored(e.withColumn("held", F.pmod(F.xxhash64("k"), F.lit(5)) == 0))
    net = convolution.Convolutional.he_init((8, 8, 1), [4, 6, 8], 10)
    history = convolution.fit(rows.where("not held").select("x", "y", "k"), net, epochs=4)
    net = convolution.Convolutional.from_json(net.to_json())
    z = convolution.outputs(rows.where("held"), "k", "x", net).join(rows.select("k", "y"), "k")
    right = z.agg(F.avg((F.array_position("z", F.array_max("z")) - 1 == F.col("y")).cast("double"))).first()[0]
    return s.createDataFrame([*[(f"epoch {i}", v) for i, v in enumerate(history)], ("accuracy", right)], "step string, value double")


@query(f"SELECT vec_id, z, CAST(1 / (1 + exp(-z)) >= 0.4{_D} AS INTEGER) AS decision, 'v000002' AS version FROM ({q_models._mlp_sql()})")
def bundle_scores(s, d):
    """A network written as a bundle, not replaced by a worse one, amended with a threshold, opened again, and every vector scored by it."""
    base = files.scratch_path(s, "bundle")
    e = read(s, d, "embeddings")
    net = q_models._mlp()
    examples = [[float(v) for v in r["embedding"]] for r in e.orderBy("vec_id").limit(5).select("embedding").collect()]
    logits = net.forward(np.array(examples))[:, 0]
    bundle.save_if_better(s, base, {"model.json": net.to_json()}, 0.8, examples=list(zip(examples, logits, strict=True)))
    bundle.save_if_better(s, base, {"model.json": "{}"}, 0.7)
    bundle.amend(s, base, 0.4)
    held = bundle.current(s, base)
    again = layers.Mlp.from_json(held.files["model.json"])
    held.parity(again.forward(np.array([x for x, _ in held.examples]))[:, 0].tolist())
    z = F.col("z")[0]
    out = score.score_arrays(e, "vec_id", "embedding", again.forward)
    return out.select("vec_id", F.round(z, 9).alias("z"), (1 / (1 + F.exp(-z)) >= held.threshold).cast("int").alias("decision"), F.lit(held.version).alias("version"))


_GRAY = "CAST(floor(abs(CAST(embedding[r * 8 + c + 1] AS DOUBLE)) * 255) AS BIGINT) % 256"


@query(f"""WITH p AS (SELECT vec_id, r, c, 255 - {_GRAY} AS v FROM embeddings, range(8) a(r), range(8) b(c) WHERE vec_id % 10 = 0)
SELECT vec_id, 'inverted' AS form, CAST(r * 8 + c AS INTEGER) AS place, CAST(v AS DOUBLE) AS value FROM p
UNION ALL SELECT vec_id, 'half', CAST((r // 2) * 4 + c // 2 AS INTEGER), avg(CAST(v AS DOUBLE)) FROM p GROUP BY vec_id, r // 2, c // 2""")
def image_files(s, d):
    """Every tenth vector as a PNG, read by Spark's image source: all pixels inverted, and at half the size."""
    e = read(s, d, "embeddings").where("vec_id % 10 = 0")
    px = F.transform("embedding", lambda x: (F.floor(F.abs(x.cast("double")) * 255) % 256).cast("int"))
    path = files.scratch_path(s, "png")
    images.write_pngs(e.select("vec_id", px.alias("px")), path, "vec_id", "px", 8)
    found = images.read_images(s, path)
    found = found.select(
        F.regexp_extract("path", r"([0-9]+)\.png$", 1).cast("long").alias("vec_id"), images.inverted(images.gray(F.col("data"), F.col("channels"))).alias("px"), "width", "height"
    )
    found = stored(found)  # pixels once for both forms
    whole = found.select("vec_id", F.lit("inverted").alias("form"), F.posexplode("px").alias("place", "v"))
    half = found.select("vec_id", F.lit("half").alias("form"), F.posexplode(images.resized(F.col("px"), F.col("width"), F.col("height"), 4)).alias("place", "v"))
    return whole.select("vec_id", "form", "place", F.col("v").cast("double").alias("value")).unionByName(half.select("vec_id", "form", "place", F.col("v").alias("value")))


@query()
def small_batch_training(s, d):
    """Orders by two features in batches of 16 rows on four workers: the loss of each epoch."""
    rows = _pairs(s, d).select("id", "x", "y")
    _, history = train.fit_local(rows, "x", "y", "id", [2, 8, 1], epochs=4, workers=4)
    return s.createDataFrame(list(enumerate(history)), "epoch int, loss double")


@query(f"""WITH r AS (SELECT ts, floor(value * 7) AS ms FROM events), w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n, avg(ms) AS mean_ms, quantile_disc(ms, 0.95) AS tail_ms, max(ms) AS max_ms FROM r GROUP BY 1)
SELECT window_start, n, round(mean_ms, 6) AS mean_ms, CAST(tail_ms AS DOUBLE) AS tail_ms, CAST(max_ms AS DOUBLE) AS max_ms FROM w WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM r) - INTERVAL 10 MINUTE""")
def latency_stream(s, d):
    """Requests whose score comes some milliseconds after their arrival, as a file stream: the windows that are closed when all is read."""
    e = read(s, d, "events")
    scored = F.col("ts") + F.make_dt_interval(secs=(F.floor(F.col("value") * 7) / 1000).cast("decimal(18,6)"))
    copy, out, at = (files.scratch_path(s, n) for n in ("requests", "windows", "state"))
    e.select("ts", scored.alias("scored")).write.parquet(copy)
    stream = scoring.file_stream(s, copy, s.read.parquet(copy).schema, files_per_batch=10_000)
    windows = latency.latency_windows(stream, "ts", "scored")
    latency.run_available(windows, out, at)
    return s.read.schema(windows.schema).parquet(out).withColumns({"mean_ms": F.round("mean_ms", 6), "window_start": F.col("window_start").cast("timestamp_ntz")})


@query("SELECT o_orderkey AS id, true AS adds_up FROM orders")
def forest_attributions(s, d):
    """Attribution values of a forest on two features of orders: base and values add up to the forest's own probability in every row."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = stored(_pairs(s, d))
    vectors = rows.select("id", array_to_vector("x").alias("x"), F.col("y").cast("double").alias("y"))
    model = models.fit(RandomForestClassifier(numTrees=5, maxDepth=3, featuresCol="x", labelCol="y", seed=7), vectors)
    phi = attribution.attributed(rows, attribution.paths_of(attribution.node_table(model.model, s)), "id")
    total = F.aggregate("phi", F.col("base"), lambda a, v: a + v)
    p = model.scored(vectors).select("id", "p")
    return phi.select("id", total.alias("total")).join(p, "id").select("id", (F.abs(F.col("total") - F.col("p")) < 1e-9).alias("adds_up"))


@query()
def training_ablations(s, d):
    """The training protocol with one part left out at a time: validation AUC and loss of the best epoch of three."""
    e = split.folds(read(s, d, "embeddings").select("vec_id", F.col("embedding").alias("x"), (F.col("label") > 6).cast("long").alias("y")), "vec_id", "y", 5)
    rows = stored(e)
    known, validation = rows.where("fold > 1"), rows.where("fold = 1")
    whole = {"widths": [64, 16, 1], "epochs": 3, "batches": 2, "lr": 5e-3, "dropout": 0.2, "normalize": True}
    changes = {
        "whole": {}, "no normalization": {"normalize": False}, "no dropout": {"dropout": 0.0}, "no decay": {"decay": 0.0}, "a quarter of the units": {"widths": [64, 4, 1]}, "a tenth of the rate": {"lr": 5e-4},
    }
    out = []
    for name, change in changes.items():
        setting = {**whole, **change}
        history = train.fit_selected(known, validation, "x", "y", "vec_id", setting.pop("widths"), **setting).history
        _, loss, auc = max(history, key=lambda h: h[2])
        out.append((name, auc, loss))
    return s.createDataFrame(out, "variant string, auc double, loss double")
