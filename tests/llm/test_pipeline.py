"""The pipeline's stages against brute-force versions on the smallest tables."""

from __future__ import annotations

import os
import re

import pytest
from tokenizers import Tokenizer

pipeline = pytest.importorskip("corpus_pipeline")
DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def test_stages(spark):
    from test_operators import base_counts, base_spans, components

    from tessera.llm import decontaminate, tokens
    from tessera.llm.common import materialize, table

    docs, seen = table(spark, DIR, "documents"), []
    for _, stage in pipeline.STAGES:
        seen.append({r["doc_id"]: r for r in docs.collect()})
        docs = materialize(stage(spark, docs, DIR), "stage")
        if stage is not pipeline.STAGES[-1][1]:
            assert docs.columns == list(pipeline.COLUMNS)
    raw, good, single, clean, redacted = seen
    labels = {r["doc_id"]: r["quality"] for r in table(spark, DIR, "labels").collect()}
    for i, r in raw.items():
        n, *_, again = base_counts(r["text"])
        if n < 50 or 100 * again > 50 * n:
            assert i not in good
        elif labels.get(i) == 1:
            assert i in good  # clean documents stay
    want, _ = components([(i, r["text"]) for i, r in good.items()], 5, 4, 5)
    assert set(single) == {i for i, c in want.items() if i == c}
    items = [decontaminate.normal(r["text"]) for r in table(spark, DIR, "benchmark").collect()]
    hit = {i for i, r in single.items() if any(t in decontaminate.normal(r["text"]) for t in items)}
    assert set(clean) == set(single) - hit
    assert set(redacted) == set(clean)
    for i, r in redacted.items():
        assert not base_spans(r["text"]) and not re.search(r'"[0-9a-f]{40}"', r["text"])
        if not base_spans(clean[i]["text"]) and "token" not in clean[i]["text"]:
            assert r["text"] == clean[i]["text"]
    library = Tokenizer.from_file(tokens.tokenizer_path(tokens.DEFAULT_TOKENIZER))
    total = {i: len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for i, r in redacted.items()}
    pieces = docs.groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in pieces} == total


def test_rows_with_odd_ids_and_texts(spark, tmp_path):
    """Null, equal and clashing: only copies, failing and contaminated rows go."""
    import random

    rng = random.Random(3)
    text = lambda n: " ".join("".join(rng.choice("abcdefghi") for _ in range(6)) for _ in range(n))
    one, two, three, item = text(80), text(90), text(100), text(40)
    rows = [(1, one), (1, two), (None, three), (None, one + " x"), (2, two), (3, None), (4, ""), (5, text(60) + " " + item), (None, text(60) + item + text(9)), (7, text(70) + " a.b@c.de")]
    docs = [(i, t, "en", "s", len(t or ""), "clash", 1) for i, t in rows]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, row string, component_id int"
    spark.createDataFrame(docs, kinds).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    got = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=repr)
    assert got == sorted([(1, one), (1, two), (None, three), (7, rows[-1][1].replace("a.b@c.de", "[EMAIL]"))], key=repr)
    pieces = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0) for r in pieces if r["start"] == 0) == [0, 1, 1, 7]


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{DIR}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_run_and_registration(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"].__wrapped__ is pipeline.run
    pieces = pipeline.run(spark, DIR).collect()
    by = {}
    for r in pieces:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert by and all(sum(n for _, n in sorted(p)) == max(a + n for a, n in p) <= 1024 for p in by.values())
