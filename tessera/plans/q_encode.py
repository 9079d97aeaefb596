"""Queries on categorical encoders, each with its SQL. Categories: event_type (5), in order of first appearance by event_id."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import encode as e
from tessera.plans.frames import ORDERS_SQL, labelled_orders, read

QUERIES: dict = {}
_D = "::DOUBLE"
K = 5


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _events(s, d):
    return read(s, d, "events").select("event_id", "event_type", (F.col("value") > 60).cast("long").alias("y"), "value")


_EV = "SELECT event_id, event_type, CAST(value > 60 AS BIGINT) AS y, value FROM events"
_CODES = "SELECT event_type AS cat, CAST(row_number() OVER (ORDER BY min(event_id), event_type) AS BIGINT) AS code FROM events GROUP BY 1"


def _codes(s, d):
    return e.codes(_events(s, d), "event_type", "event_id")


def _all(s, d, fitted):
    return e.apply(_events(s, d).select("event_id", "event_type"), fitted, "event_type").drop("event_type")


def _by_code(exprs: str) -> str:
    return f"SELECT event_id, {exprs} FROM events JOIN ({_CODES}) ON event_type = cat"


@query("SELECT event_id, " + ", ".join(f"""CAST(event_type = '{v}' AS INTEGER) AS "event_type={v}" """ for v in ("click", "view", "purchase", "signup", "error")) + " FROM events")
def encode_onehot(s, d):
    return e.one_hot(_events(s, d).select("event_id", "event_type"), "event_type", ["click", "view", "purchase", "signup", "error"]).drop("event_type")


@query(_by_code("code"))
def encode_ordinal(s, d):
    return _all(s, d, _codes(s, d))


@query("SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 WHEN '1-URGENT' THEN 4 ELSE -1 END AS BIGINT) AS code FROM orders")
def encode_ordinal_mapping(s, d):
    fitted = e.codes(read(s, d, "orders"), "o_orderpriority", mapping=["5-LOW", "3-MEDIUM", "2-HIGH", "1-URGENT"])
    return e.apply(read(s, d, "orders").select("o_orderkey", "o_orderpriority"), fitted, "o_orderpriority", {"code": -1}).drop("o_orderpriority")


@query(_by_code(", ".join(f"(code >> {2 - i}) & 1 AS d{i}" for i in range(3))))
def encode_binary(s, d):
    return _all(s, d, e.digits(_codes(s, d), 2, K))


@query(_by_code("CAST(floor(code / 3) AS BIGINT) % 3 AS d0, code % 3 AS d1"))
def encode_base3(s, d):
    return _all(s, d, e.digits(_codes(s, d), 3, K))


@query(_by_code(", ".join(f"(xor(code, code >> 1) >> {2 - i}) & 1 AS d{i}" for i in range(3))))
def encode_gray(s, d):
    return _all(s, d, e.digits(_codes(s, d), 2, K, gray=True))


@query(_by_code(", ".join(f"CAST(code >= {j} AS INTEGER) AS r{j}" for j in range(1, K + 1))))
def encode_rankhot(s, d):
    return _all(s, d, e.rank_hot(_codes(s, d), K))


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type) AS freq FROM events")
def encode_count(s, d):
    return _all(s, d, e.frequency(_events(s, d), "event_type"))


@query("SELECT p_partkey, " + ", ".join(f"CAST(CAST('0x' || substr(md5(p_brand), 1, 8) AS BIGINT) % 8 = {i} AS INTEGER) AS h{i}" for i in range(8)) + " FROM part")
def encode_hashing(s, d):
    return e.hashed(read(s, d, "part").select("p_partkey", "p_brand"), "p_brand", 8).drop("p_brand")


@query(_by_code(", ".join(f"CASE WHEN code = {K} THEN -1.0{_D} WHEN code = {j} THEN 1.0{_D} ELSE 0.0{_D} END AS c{j}" for j in range(1, K))))
def encode_sum_contrast(s, d):
    return _all(s, d, e.sum_contrast(_codes(s, d), K))


@query(_by_code(", ".join(f"CASE WHEN code > {j} THEN {j}{_D} / {K} ELSE -{K - j}{_D} / {K} END AS c{j}" for j in range(1, K))))
def encode_backward_difference(s, d):
    return _all(s, d, e.backward_difference(_codes(s, d), K))


@query(_by_code(", ".join(f"CASE WHEN code = {j} THEN {K - j}{_D} / {K - j + 1} WHEN code > {j} THEN -1.0{_D} / {K - j + 1} ELSE 0.0{_D} END AS c{j}" for j in range(1, K))))
def encode_helmert(s, d):
    return _all(s, d, e.helmert(_codes(s, d), K))


@query(_by_code(", ".join(f"CASE WHEN code = {j + 1} THEN {j}.0{_D} WHEN code <= {j} THEN -1.0{_D} ELSE 0.0{_D} END AS c{j}" for j in range(1, K))))
def encode_helmert_preceding(s, d):
    return _all(s, d, e.helmert(_codes(s, d), K, subsequent=False))


def _poly(values: list[int], norm: int) -> str:
    return "CASE code " + " ".join(f"WHEN {i} THEN {v}.0{_D} / sqrt({norm}.0{_D})" for i, v in enumerate(values, 1)) + " END"


@query(_by_code(f"{_poly([-2, -1, 0, 1, 2], 10)} AS p1, {_poly([2, -1, -2, -1, 2], 14)} AS p2, {_poly([-1, 2, 0, -2, 1], 10)} AS p3, {_poly([1, -4, 6, -4, 1], 70)} AS p4"))
def encode_polynomial(s, d):
    p = e.polynomial(_codes(s, d), K)
    # zeros of the polynomials are exact in the closed form
    p = p.select("cat", *[F.when(F.abs(c) < 1e-12, 0.0).otherwise(F.col(c)).alias(c) for c in ("p1", "p2", "p3", "p4")])
    return _all(s, d, p)


_STATS = f"SELECT event_type AS cat, count(*) AS n, CAST(sum(y) AS DOUBLE) AS s, (SELECT avg(CAST(y AS DOUBLE)) FROM ({_EV})) AS prior FROM ({_EV}) GROUP BY 1"


def _by_stat(expr: str, name: str) -> str:
    return f"SELECT event_id, {expr} AS {name} FROM events JOIN ({_STATS}) ON event_type = cat"


@query(_by_stat(f"(s + 10.0{_D} * prior) / (n + 10.0{_D})", "te"))
def encode_target(s, d):
    fitted, prior = e.target_mean(_events(s, d), "event_type", "y", 10.0)
    return e.apply(_events(s, d).select("event_id", "event_type"), fitted, "event_type", {"te": prior}).drop("event_type")


@query(_by_stat("(s + prior) / (n + 1)", "te"))
def encode_m_estimate(s, d):
    fitted, prior = e.m_estimate(_events(s, d), "event_type", "y", 1.0)
    return e.apply(_events(s, d).select("event_id", "event_type"), fitted, "event_type", {"te": prior}).drop("event_type")


def _prior(s, d) -> float:
    return _events(s, d).agg(F.avg(F.col("y").cast("double"))).first()[0]


@query(f"SELECT event_id, CASE WHEN n > 1 THEN (s - y) / (n - 1) ELSE prior END AS loo FROM ({_EV}) JOIN ({_STATS}) ON event_type = cat")
def encode_leave_one_out(s, d):
    return e.leave_one_out(_events(s, d), "event_type", "y", _prior(s, d)).select("event_id", "loo")


@query(f"""SELECT event_id, (coalesce(CAST(sum(y) OVER w AS DOUBLE), 0.0{_D}) + (SELECT avg(CAST(y AS DOUBLE)) FROM ({_EV}))) / (count(*) OVER w + 1) AS ots
FROM ({_EV}) WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def encode_ordered_statistic(s, d):
    return e.ordered_statistic(_events(s, d), "event_type", "y", "event_id", _prior(s, d)).select("event_id", "ots")


@query(f"""WITH t AS (SELECT event_type AS cat, avg(CAST(y AS DOUBLE)) AS m, var_samp(CAST(y AS DOUBLE)) / count(*) AS v FROM ({_EV}) GROUP BY 1),
b AS (SELECT var_pop(m) AS between_v FROM t)
SELECT event_id, (1 - v / (v + between_v)) * m + v / (v + between_v) * (SELECT avg(CAST(y AS DOUBLE)) FROM ({_EV})) AS js FROM events JOIN t ON event_type = cat, b""")
def encode_james_stein(s, d):
    fitted, prior = e.james_stein(_events(s, d), "event_type", "y")
    return e.apply(_events(s, d).select("event_id", "event_type"), fitted, "event_type", {"js": prior}).drop("event_type")


@query("SELECT event_id, qe FROM events JOIN (SELECT event_type AS cat, median(value) AS qe FROM events GROUP BY 1) ON event_type = cat")
def encode_quantile(s, d):
    fitted, total = e.quantile(_events(s, d), "event_type", "value")
    return e.apply(_events(s, d).select("event_id", "event_type"), fitted, "event_type", {"qe": total}).drop("event_type")


_WOE = f"""SELECT o_orderpriority AS cat, ln((CAST(sum(y) AS DOUBLE) / (SELECT sum(y) FROM ({ORDERS_SQL}))) / (CAST(sum(1 - y) AS DOUBLE) / (SELECT sum(1 - y) FROM ({ORDERS_SQL})))) AS woe FROM ({ORDERS_SQL}) GROUP BY 1"""


@query(f"SELECT o_orderkey, woe FROM orders JOIN ({_WOE}) ON o_orderpriority = cat")
def encode_woe(s, d):
    orders = labelled_orders(s, d)
    fitted = e.weight_of_evidence(orders, "o_orderpriority", "y")
    return e.apply(orders.select("o_orderkey", "o_orderpriority"), fitted, "o_orderpriority", {"woe": 0.0}).drop("o_orderpriority")


@query(f"SELECT 'o_orderpriority' AS column_name, cat, woe FROM ({_WOE})")
def woe_report(s, d):
    return e.woe_report(e.weight_of_evidence(labelled_orders(s, d), "o_orderpriority", "y"), "o_orderpriority")


@query(f"SELECT cat, code, CASE WHEN code > 1 THEN 0.2{_D} ELSE -0.8{_D} END AS c1 FROM ({_CODES})")
def contrast_report(s, d):
    c = _codes(s, d)
    return c.join(e.backward_difference(c, K).select("cat", "c1"), "cat")


@query("SELECT event_id, code, freq FROM events JOIN (" + _CODES + ") ON event_type = cat JOIN (SELECT event_type AS t, count(*) AS freq FROM events GROUP BY 1) ON event_type = t")
def encode_id_plus_frequency(s, d):
    rows = e.apply(_events(s, d).select("event_id", "event_type"), _codes(s, d), "event_type")
    return e.apply(rows, e.frequency(_events(s, d), "event_type"), "event_type").drop("event_type")


@query()
def encode_random_intercept(s, d):
    return e.random_intercept(labelled_orders(s, d), "o_orderpriority", "y")


@query("SELECT event_id, (\"event_type=click\" + \"event_type=view\") AS seen FROM (SELECT event_id, CAST(event_type = 'click' AS INTEGER) AS \"event_type=click\", CAST(event_type = 'view' AS INTEGER) AS \"event_type=view\" FROM events)")
def unseen_category_zero_block(s, d):
    rows = e.one_hot(_events(s, d).select("event_id", "event_type"), "event_type", ["click", "view"])
    return rows.select("event_id", (F.col("`event_type=click`") + F.col("`event_type=view`")).alias("seen"))
