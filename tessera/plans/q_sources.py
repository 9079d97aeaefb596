"""Queries that write files and read them back, each with SQL over the table that they started from."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.plans.frames import read
from tessera.sources import files, images
from tessera.streaming import scoring

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def csv_round_trip(s, d):
    path = files.scratch_path(s, "part_csv")
    files.write_delimited(read(s, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), path, ";")
    return files.read_delimited(s, path, "p_partkey long, p_name string, p_size int, p_retailprice double", sep=";", header=True)


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderpriority END AS priority, CAST(o_orderstatus = 'F' AS BIGINT) AS y FROM orders")
def headerless_csv(s, d):
    """Padded separators, a marker for missing values, comment lines, labels with a trailing dot."""
    path = files.scratch_path(s, "orders_txt")
    p = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "?").otherwise(F.col("o_orderpriority"))
    line = F.concat_ws(", ", F.col("o_orderkey").cast("string"), p, F.concat("o_orderstatus", F.lit(".")))
    lines = read(s, d, "orders").select(line.alias("value"))
    lines.unionByName(s.range(1).select(F.lit("|a comment").alias("value"))).write.text(path)
    back = files.read_delimited(s, path, "o_orderkey long, priority string, status string", comment="|")
    return back.select("o_orderkey", "priority", (F.rtrim("status", F.lit(".")) == "F").cast("long").alias("y"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def json_round_trip_file(s, d):
    path = files.scratch_path(s, "customer_json")
    read(s, d, "customer").select("c_custkey", "c_name", "c_acctbal").write.json(path)
    return s.read.schema("c_custkey long, c_name string, c_acctbal double").json(path)


@query("SELECT c_custkey, c_mktsegment FROM customer")
def zip_member(s, d):
    """Customers as lines of a member of zip archives, written and read by the tasks."""
    lines = read(s, d, "customer").select(F.concat_ws(", ", "c_custkey", "c_mktsegment").alias("line"))
    path = files.scratch_path(s, "zips")
    files.write_zips(lines, path, "train.data", "|comment\n")
    return files.parse_lines(files.read_zip_member(s, path, "train.data"), "c_custkey long, c_mktsegment string")


_PIX = "CAST(floor(abs(CAST(x AS DOUBLE)) * 255) AS BIGINT) % 256"


def _written(s, d, cut=None) -> str:
    """Vectors as grey PNG files."""
    px = F.transform("embedding", lambda x: (F.floor(F.abs(x.cast("double")) * 255) % 256).cast("int"))
    path = files.scratch_path(s, "png")
    images.write_pngs(read(s, d, "embeddings").where("vec_id % 5 = 1").select("vec_id", px.alias("px")), path, "vec_id", "px", 8, cut)
    return path


def _vec_id():
    return F.regexp_extract("path", r"([0-9]+)\.png$", 1).cast("long").alias("vec_id")


@query(f"SELECT vec_id, CAST(8 AS INTEGER) AS width, CAST(8 AS INTEGER) AS height, CAST(list_sum(list_transform(embedding, lambda x: {_PIX})) AS BIGINT) AS total FROM embeddings WHERE vec_id % 5 = 1")
def image_decode(s, d):
    """Every fifth vector as a PNG file, decoded by the image source."""
    pixels = images.gray(F.col("data"), F.col("channels"))
    total = F.aggregate(pixels, F.lit(0).cast("long"), lambda a, x: a + x)
    return images.read_images(s, _written(s, d)).select(_vec_id(), "width", "height", total.alias("total"))


@query("SELECT vec_id, vec_id % 10 = 6 AS broken FROM embeddings WHERE vec_id % 5 = 1")
def image_decode_failure(s, d):
    """Of such files every second is cut short: which decode and which don't."""
    path = _written(s, d, F.col("vec_id") % 10 == 6)
    good = images.read_images(s, path).select(_vec_id(), F.lit(False).alias("broken"))
    return good.unionByName(images.unreadable(s, path).select(_vec_id(), F.lit(True).alias("broken")))


@query("""SELECT vec_id, CAST(r * 4 + c AS INTEGER) AS place, round((CAST(embedding[r * 16 + c * 2 + 1] AS DOUBLE) + embedding[r * 16 + c * 2 + 2] + embedding[r * 16 + c * 2 + 9] + embedding[r * 16 + c * 2 + 10]) / 4, 6) AS value
FROM embeddings, range(4) a(r), range(4) b(c)""")
def image_resize(s, d):
    """8 x 8 images at half the size, bilinear: all pixels."""
    small = images.resized(F.col("embedding"), 8, 8, 4)
    return read(s, d, "embeddings").select("vec_id", F.posexplode(small).alias("place", "v")).select("vec_id", "place", F.round("v", 6).alias("value"))


@query("""SELECT vec_id, CAST(r * 8 + c AS INTEGER) AS place, CAST(CASE vec_id % 4 WHEN 0 THEN embedding[r * 8 + c + 1] WHEN 1 THEN embedding[(7 - c) * 8 + r + 1]
WHEN 2 THEN embedding[(7 - r) * 8 + 7 - c + 1] ELSE embedding[c * 8 + 7 - r + 1] END AS DOUBLE) AS value FROM embeddings, range(8) a(r), range(8) b(c)""")
def image_rotate(s, d):
    """8 x 8 images turned by none to three right angles: all pixels."""
    turned = scalar.rotated("embedding", 8, (F.col("vec_id") % 4) * 90.0)
    return read(s, d, "embeddings").select("vec_id", F.posexplode(turned).alias("place", "value"))


def _train(key: str = "vec_id"):
    return scalar.hash_fraction(0, key) < 0.9


def _flipped_and_moved(rows):
    flipped = F.when(scalar.hash_fraction(1, "vec_id") < 0.5, scalar.flip_horizontal("px", 8)).otherwise(F.col("px"))
    off = lambda seed: (F.floor(scalar.hash_fraction(seed, "vec_id") * 5) - 2).cast("int")
    return rows.withColumn("px", flipped).withColumn("px", scalar.crop_padded("px", 8, 8, off(2), off(3)))


def _fraction_sql(seed: int) -> str:
    return f"CAST('0x' || substr(md5('{seed}|' || vec_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


@query(f"""WITH e AS (SELECT vec_id, embedding, {_fraction_sql(0)} < 0.9 AS train, {_fraction_sql(1)} < 0.5 AS flip, CAST(floor({_fraction_sql(2)} * 5) - 2 AS BIGINT) AS dx, CAST(floor({_fraction_sql(3)} * 5) - 2 AS BIGINT) AS dy FROM embeddings),
p AS (SELECT *, CASE WHEN train THEN r + dy ELSE r END AS y, CASE WHEN train THEN c + dx ELSE c END AS x FROM e, range(8) a(r), range(8) b(c))
SELECT vec_id, CASE WHEN train THEN 'train' ELSE 'evaluation' END AS branch, CAST(r * 8 + c AS INTEGER) AS place,
CASE WHEN x BETWEEN 0 AND 7 AND y BETWEEN 0 AND 7 THEN CAST(embedding[y * 8 + CASE WHEN train AND flip THEN 7 - x ELSE x END + 1] AS DOUBLE) ELSE 0.0::DOUBLE END AS value FROM p""")
def image_branches(s, d):
    """Training images flipped and moved by a hash of their key, images for evaluation as they are: all pixels of both."""
    e = read(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("px"))
    train = _flipped_and_moved(e.where(_train())).select("vec_id", F.lit("train").alias("branch"), "px")
    both = train.unionByName(e.where(~_train()).select("vec_id", F.lit("evaluation").alias("branch"), "px"))
    return both.select("vec_id", "branch", F.posexplode("px").alias("place", "value"))


@query()
def image_augment(s, d):
    """Training rows only: flipped for half of the keys, shifted by up to 2, turned by up to 8 degrees; all by hash of the key."""
    e = read(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("px"))
    moved = _flipped_and_moved(e.where(_train()))
    return moved.select("vec_id", scalar.rotated("px", 8, scalar.hash_fraction(4, "vec_id") * 16 - 8).alias("pixels"))


@query("SELECT event_id, value / 200 AS p, CAST(value / 200 >= 0.25 AS INTEGER) AS decision, abs(value / 200 - 0.25) < 0.05 AS fragile FROM events")
def stream_scores(s, d):
    """The scoring expressions over a file stream, all that is there, into Parquet."""
    source = read(s, d, "events")
    copy = files.scratch_path(s, "events_in")
    source.select("event_id", "ts", "value").write.parquet(copy)
    stream = scoring.file_stream(s, copy, s.read.parquet(copy).schema)
    out, at = files.scratch_path(s, "scored"), files.scratch_path(s, "state")
    scored = scoring.score_stream(stream, F.col("value") / 200, 0.25, "event_id")
    run = scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start()
    run.awaitTermination(600)
    return s.read.schema(scored.schema).parquet(out)


#: A table of constants: the regions' codes (fixed values).
REGION_CODES = (("AFRICA", "AF"), ("AMERICA", "AM"), ("ASIA", "AS"), ("EUROPE", "EU"), ("MIDDLE EAST", "ME"))


@query(f"SELECT n_nationkey, code FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN (VALUES {', '.join(map(str, REGION_CODES))}) t(name, code) ON r_name = name")
def literal_table(s, d):
    """A table of constants joined to the nations by their region's name."""
    codes = s.createDataFrame(REGION_CODES, "name string, code string")
    regions = read(s, d, "region").join(codes, F.col("r_name") == F.col("name"), "left")
    return read(s, d, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "code")
