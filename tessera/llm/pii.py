"""Personal data: exact patterns, and weak supervision for spans that no pattern settles.

Base spans (email, ip, card, phone) come from patterns and checks.  Further
candidates, long tokens with digits, may be secrets or plain identifiers.
Three kinds of labelers vote on each: a shape pattern, a gazetteer of words in
front of it, and its surroundings.  Expectation-maximisation over the counts of
vote patterns (at most ``3 ** labelers`` rows, whatever the corpus) estimates how
reliable each labeler is; the posterior of each candidate then trains a
logistic classifier on span features, again from counts per feature vector, which
is applied as one Spark expression.

Everything on the executors is built-in expressions.  Offsets are code points, ends exclusive.

Cases: null and empty texts have no spans; an empty table, or one without
candidates, adds none; rows with equal ids are judged one by one; further
columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bound, materialize, spread, table

KINDS = ("email", "ip", "card", "phone", "secret")

# The base patterns, written so that a long run costs linear time: quantifiers are possessive where
# nothing can be given back, and a match starts only where its run starts or the last match ended.
_LOCAL = "[A-Za-z0-9._%+-]"
_EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_TOKEN = "[A-Za-z0-9_+/=-]"
_CANDIDATE = rf"(?<!{_TOKEN})(?=[A-Za-z_+/=-]*+[0-9]){_TOKEN}{{16,}}+"
#: Words that announce a secret (fixed values).
GAZETTEER = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "key", "auth", "bearer", "credential")
#: Characters in front of a candidate that labelers look at.
_BEFORE = 24
#: Elements that running() and redacted() take at a time.
_BLOCK = 256
_PIECE = 1024


def _ints() -> Column:
    return F.array().cast("array<int>")


def _running(sizes: Column, base: Column, step: Callable[[Column, Column], Column]) -> Column:
    """``step`` folded over an array from ``base``: the value after each element. Appends, so for short arrays only."""
    return F.aggregate(
        sizes,
        F.struct(base.alias("at"), _ints().alias("out")),
        lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(step(acc["at"], x))).alias("out")),
        lambda acc: acc["out"],
    )


def running(sizes: Column, step: Callable[[Column, Column], Column]) -> Column:
    """``step`` (a sum, a maximum) folded over an array of numbers of 0 or more, block by block: the value after each element."""

    def of_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), step))
        ends = _running(totals, F.lit(0), step)
        before = bound(ends, lambda e: F.concat(F.array(F.lit(0)), F.slice(e, F.lit(1), F.greatest(F.size(e) - 1, F.lit(0)))))
        return F.flatten(F.zip_with(blocks, before, lambda b, base: _running(b, base, step)))

    def cut(v: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.greatest(F.ceil(F.size(v) / _BLOCK).cast("int") - 1, F.lit(0))),
            lambda b: F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK)),
        )

    return bound(sizes, lambda v: bound(cut(v), of_blocks))


def _before(values: Column, n: int, start: Column) -> Column:
    """An array moved on by ``n`` places, ``start`` in front."""
    return F.slice(F.concat(F.array_repeat(start, n), values), F.lit(1), F.size(values))


def find_all(text: Column, pattern: str, gate: Column, context: int = 0) -> Column:
    """Leftmost non-overlapping matches as structs ``s`` (start), ``e`` (end), ``m`` (text); texts without ``gate`` are skipped.

    The texts between matches give the offsets, since split and extract find the same matches. With ``context``
    there are also ``before``, so many characters in front, and ``after``, the next character; matches of at least half as many
    characters are taken for granted then.
    """
    kind = "s:int,e:int,m:string" + (",before:string,after:string" if context else "")
    pairs = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        F.split(text, pattern, -1),
        lambda m, gap: F.struct(m.alias("m"), gap.alias("gap")),
    )

    def placed(p: Column) -> Column:
        ends = running(F.transform(p, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["m"]), F.lit(0))), lambda a, x: a + x)
        if not context:
            whole = F.zip_with(p, ends, lambda x, e: F.struct((e - F.length(x["m"])).alias("s"), e.alias("e"), x["m"].alias("m")))
            return F.filter(whole, lambda x: x["m"].isNotNull())
        tails = F.transform(p, lambda x: F.right(F.concat(x["gap"], F.coalesce(x["m"], F.lit(""))), F.lit(context)))
        before = bound(tails, lambda t: F.zip_with(_before(t, 2, F.lit("")), _before(t, 1, F.lit("")), lambda a, b: F.concat(a, b)))
        # the gap behind a match: its neighbour's
        after = F.transform(F.concat(F.slice(p, F.lit(2), F.size(p)), F.slice(p, F.lit(1), F.lit(1))), lambda x: F.left(x["gap"], F.lit(1)))
        around = F.zip_with(before, after, lambda b, a: F.struct(b.alias("b"), a.alias("a")))
        placed = F.zip_with(p, ends, lambda x, e: F.struct(x.alias("x"), e.alias("e")))
        whole = F.zip_with(
            placed,
            around,
            lambda y, c: F.struct(
                (y["e"] - F.length(y["x"]["m"])).alias("s"),
                y["e"].alias("e"),
                y["x"]["m"].alias("m"),
                F.right(F.concat(c["b"], y["x"]["gap"]), F.lit(context)).alias("before"),
                c["a"].alias("after"),
            ),
        )
        return F.filter(whole, lambda x: x["m"].isNotNull())

    return F.when(gate, bound(pairs, placed)).otherwise(F.array().cast(f"array<struct<{kind}>>"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]++", "")


def _luhn(digits: Column) -> Column:
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            F.when(d.cast("int") * 2 > 9, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)
        ),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _checks(kind: str):
    def ip(x: Column) -> Column:
        parts = F.split(x["m"], r"\.")
        return F.forall(parts, lambda p: F.regexp_like(p, F.lit(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))

    def card(x: Column) -> Column:
        n = F.length(_digits(x["m"]))
        return F.when(n.between(12, 19), _luhn(_digits(x["m"]))).otherwise(False)

    def phone(x: Column) -> Column:
        return F.length(_digits(x["m"])).between(9, 15)

    return {"ip": ip, "card": card, "phone": phone}.get(kind)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *keep: str) -> DataFrame:
    """``id_col``, arrays of base spans (kind number, start, end) by kind, and ``cands`` with what labelers look at."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col), *keep, text.alias("_text"))
    text = F.col("_text")
    gates = {
        "email": (_EMAIL, F.contains(text, F.lit("@"))),
        "ip": (_IP, F.regexp_like(text, F.lit(r"[0-9]\.[0-9]"))),
        "card": (_CARD, F.regexp_like(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){11}"))),
        "phone": (_PHONE, F.contains(text, F.lit("+"))),
    }
    for kind, (pattern, gate) in gates.items():
        found = find_all(text, pattern, gate)
        df = df.withColumn(kind, F.filter(found, _checks(kind)) if _checks(kind) else found)
    cands = find_all(text, _CANDIDATE, F.regexp_like(text, F.lit(rf"(?<!{_TOKEN})(?=[A-Za-z_+/=-]*+[0-9]){_TOKEN}{{16}}")), _BEFORE)
    df = df.withColumn("_cands", cands)
    words = "|".join(GAZETTEER)

    def look(x: Column) -> Column:
        before, after = x["before"], x["after"]
        m, size = x["m"], F.length(x["m"])
        digits = F.length(_digits(m))
        return F.struct(
            x["s"].alias("s"),
            x["e"].alias("e"),
            F.regexp_like(m, F.lit("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$")).cast("int").alias("hexed"),
            F.regexp_like(before, F.lit(rf"(?i)(?:{words})[^A-Za-z]*$")).cast("int").alias("announced"),
            (F.regexp_like(before, F.lit("[=:]\\s*[\"']?$"))).cast("int").alias("assigned"),
            (F.regexp_like(before, F.lit("[\"']$")) & F.regexp_like(after, F.lit("^[\"']"))).cast("int").alias("quoted"),
            F.least(F.lit(4), F.floor(size / F.lit(12)).cast("int")).alias("size"),
            F.least(F.lit(3), F.floor(digits * 4 / size).cast("int")).alias("digits"),
            F.regexp_like(m, F.lit("[a-zA-Z].*[0-9].*[a-zA-Z]")).cast("int").alias("mixed"),
            (F.regexp_like(before, F.lit("[@/.]$")) | F.regexp_like(after, F.lit("^[@/.]"))).cast("int").alias("joined"),
        )

    return df.select(
        id_col,
        *keep,
        *[
            F.transform(kind, _as_span(k)).alias(kind)
            for k, kind in enumerate(KINDS[:4])
        ],
        F.transform("_cands", look).alias("cands"),
    )


def _as_span(k: int):
    return lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"))


def _votes() -> list[Column]:
    """The labelers' votes on a candidate ``c``: 1 for, -1 against, 0 none."""
    c = lambda n: F.col(f"c.{n}")
    shape = F.when(c("hexed") == 1, 1).when((c("mixed") == 1) & (c("digits") >= 1), 1).when(c("mixed") == 0, -1).otherwise(0)
    gazetteer = F.when(c("announced") == 1, 1).otherwise(0)
    context = F.when(c("joined") == 1, -1).when((c("quoted") == 1) | (c("assigned") == 1), 1).otherwise(-1)
    return [shape, gazetteer, context]


def expectation_maximisation(
    counts: list[tuple[tuple[int, ...], float]], rounds: int = 100
) -> tuple[float, list[dict[int, tuple[float, float]]], dict[tuple[int, ...], float]]:
    """Prior, per labeler the chance of each vote for (other, target) spans, and the posterior of each vote pattern.

    Starts from the majority of the votes; every estimate has one pseudo-count per vote.
    """
    if not counts:
        return 0.5, [], {}
    k = len(counts[0][0])
    post = {v: min(0.95, max(0.05, 0.5 + 0.45 * sum(v) / max(1, sum(map(abs, v))))) for v, _ in counts}
    prior, rates = 0.5, []
    for _ in range(rounds):
        total = sum(n for _, n in counts)
        yes = sum(n * post[v] for v, n in counts)
        prior = (yes + 1) / (total + 2)
        rates = []
        for j in range(k):
            rate = {}
            for vote in (-1, 0, 1):
                y = sum(n * post[v] for v, n in counts if v[j] == vote)
                o = sum(n * (1 - post[v]) for v, n in counts if v[j] == vote)
                rate[vote] = ((o + 1) / (total - yes + 3), (y + 1) / (yes + 3))
            rates.append(rate)
        moved = 0.0
        for v, _ in counts:
            a = math.log(prior) + sum(math.log(rates[j][v[j]][1]) for j in range(k))
            b = math.log(1 - prior) + sum(math.log(rates[j][v[j]][0]) for j in range(k))
            new = 1 / (1 + math.exp(max(-700, min(700, b - a))))
            moved, post[v] = max(moved, abs(new - post[v])), new
        if moved < 1e-9:
            break
    return prior, rates, post


FEATURES = ("hexed", "announced", "assigned", "quoted", "size", "digits", "mixed", "joined")


@dataclass(frozen=True)
class SpanClassifier:
    """Logistic weights over ``FEATURES``; without candidates to train on it accepts none."""

    weights: tuple[float, ...] = ()
    bias: float = -1.0

    def accepts(self, x: Column) -> Column:
        score = F.lit(self.bias)
        for f, w in zip(FEATURES, self.weights, strict=False):
            score = score + F.lit(w) * x[f]
        return score > 0


def train(cands: DataFrame, rounds: int = 300, rate: float = 0.5, ridge: float = 1e-3) -> SpanClassifier:
    """The span classifier from a table with one candidate ``c`` per row."""
    votes = cands.select(F.array(*_votes()).alias("v"), *[F.col(f"c.{f}").cast("double").alias(f) for f in FEATURES])
    # one row per vote pattern and feature vector: both are products of a few small ranges
    rows = votes.groupBy("v", *FEATURES).count().orderBy("v", *FEATURES).collect()
    if not rows:
        return SpanClassifier()
    patterns: dict[tuple[int, ...], float] = {}
    for r in rows:
        patterns[tuple(r["v"])] = patterns.get(tuple(r["v"]), 0) + r["count"]
    _, _, post = expectation_maximisation(sorted(patterns.items()))
    data = [([r[f] for f in FEATURES], post[tuple(r["v"])], r["count"]) for r in rows]
    total = sum(n for *_, n in data)
    mean = [sum(x[i] * n for x, _, n in data) / total for i in range(len(FEATURES))]
    dev = [math.sqrt(sum((x[i] - mean[i]) ** 2 * n for x, _, n in data) / total) or 1.0 for i in range(len(FEATURES))]
    scaled = [([(x[i] - mean[i]) / dev[i] for i in range(len(FEATURES))], y, n / total) for x, y, n in data]
    w, b = [0.0] * len(FEATURES), 0.0
    for _ in range(rounds):
        gw, gb = [ridge * a for a in w], 0.0
        for x, y, n in scaled:
            z = b + sum(a * c for a, c in zip(w, x, strict=True))
            err = n * (1 / (1 + math.exp(max(-700, min(700, -z)))) - y)
            gb += err
            for i, c in enumerate(x):
                gw[i] += err * c
        w, b = [a - rate * g for a, g in zip(w, gw, strict=True)], b - rate * gb
    raw = [a / d for a, d in zip(w, dev, strict=True)]
    return SpanClassifier(tuple(raw), b - sum(a * m for a, m in zip(raw, mean, strict=True)))


def _all_spans(classifier: SpanClassifier) -> Column:
    extra = F.transform(F.filter("cands", classifier.accepts), _as_span(4))
    return F.array_sort(F.concat(*KINDS[:4], extra))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *keep: str) -> DataFrame:
    """``id_col``, ``keep``, ``base`` and ``spans`` (arrays of structs start, kind number, end in order) and counts per base kind."""
    found = materialize(scan(docs, id_col, text_col, *keep), "spans")
    classifier = train(found.select(F.explode("cands").alias("c")))
    return found.select(
        id_col,
        *keep,
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]],
        F.array_sort(F.concat(*KINDS[:4])).alias("base"),
        _all_spans(classifier).alias("spans"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with every run of overlapping spans (in order of their starts) replaced by its first kind in brackets."""
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def piece(pieces: Column, a: Column, b: Column) -> Column:
        """Characters a to b, from the pieces of ``_PIECE`` characters that hold them."""
        lo, hi = F.floor(a / _PIECE).cast("int"), F.floor((b - 1) / _PIECE).cast("int")
        held = F.array_join(F.slice(pieces, lo + 1, hi - lo + 1), "")
        return F.when(b > a, F.substring(held, a - lo * _PIECE + 1, b - a)).otherwise("")

    def runs(v: Column) -> Column:
        """Starts and kinds of runs, each with where the last run ended; the last one of kind -1 stands for the text's end."""
        ends = running(F.transform(v, lambda x: x["e"]), lambda a, x: F.greatest(a, x))
        return bound(
            ends,
            lambda e: F.concat(
                F.filter(
                    F.zip_with(v, _before(e, 1, F.lit(0)), lambda x, b: F.struct(x["s"].alias("s"), x["k"].alias("k"), b.alias("b"))),
                    lambda x: x["s"] >= x["b"],
                ),
                F.array(F.struct(F.length(text).alias("s"), F.lit(-1).alias("k"), F.array_max(e).alias("b"))),
            ),
        )

    def written(pieces: Column, v: Column) -> Column:
        return F.array_join(
            F.transform(
                runs(v),
                lambda x: F.concat(
                    piece(pieces, x["b"], x["s"]), F.when(x["k"] >= 0, F.get(marks, x["k"])).otherwise("")
                ),
            ),
            "",
        )

    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_PIECE}}}"), F.lit(0))
    whole = bound(F.struct(pieces.alias("p"), spans.alias("v")), lambda x: written(x["p"], x["v"]))
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(spread(table(spark, sf_dir, "documents"))).select(
        "doc_id",
        *[f"n_{k}" for k in KINDS[:4]],
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
    )
