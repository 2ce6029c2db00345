"""Each stage of the pipeline against a plain version over its own input, then the whole run."""

import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairn.llm import langid, mixing
from cairn.llm.common import written

from .conftest import words
from .test_mixing import plain_targets
from .test_packing import check
from .test_pii import CARD, EMAIL, IP, PHONE, luhn
from .test_simhash import plain_copies

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def held(text):
    """Whether base entities are left."""
    digits = lambda m: re.sub("[^0-9]", "", m)
    found = lambda p: [m[0] for m in re.finditer(p, text or "")]
    return bool(found(EMAIL) or [m for m in found(IP) if all(int(x) < 256 for x in m.split("."))] or [m for m in found(CARD) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))] or [m for m in found(PHONE) if 9 <= len(digits(m)) <= 15])


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, rows = docs.columns, None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        rows = docs.collect()
        if k < 4:
            assert docs.columns == columns, name
        if k == 0:
            model = langid.identified(spark.createDataFrame(before)).collect()
            assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in model if r.kept)
            assert {r.doc_id for r in before if len(r.text or "") > 100} <= {r.doc_id for r in rows}  # clean documents stay
        elif k == 1:
            assert sorted(r.doc_id for r in rows) == sorted(set(plain_copies([(r.doc_id, r.text) for r in before])))
        elif k == 2:
            old = {r.doc_id: r for r in before}
            assert len(rows) == len(before) and not any(held(r.text) for r in rows)
            assert all(r.n_chars == len(r.text) for r in rows)
            assert all(r.text == old[r.doc_id].text or "[" in r.text for r in rows)
            assert any(held(r.text) for r in before)
        elif k == 3:
            sizes = Counter()
            for r in before:
                sizes[r.source] += size(r.text)
            goal, taken, copies = plain_targets(sizes), Counter(), Counter(r.doc_id for r in rows)
            for r in rows:
                taken[r.source] += size(r.text)
            assert max(copies.values()) <= mixing.MOST_COPIES
            assert all(abs(taken[s] - goal[s]) <= max(size(r.text) for r in before if r.source == s) for s in sizes)
        else:
            check([(r.doc_id, r.text) for r in before], rows)


def test_run(spark):
    pieces = corpus_pipeline.run(spark, DATA)
    assert set(pieces.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    lengths = [r["sum(length)"] for r in pieces.groupBy("sequence_id").sum("length").collect()]
    assert all(0 < n <= 2048 and n & (n - 1) == 0 for n in lengths)


def through(spark, docs):
    """docs through all five stages, each written and read again; rows after each."""
    counts = []
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, DATA), "stage")
        counts.append(docs.count())
    return docs, counts


def test_an_empty_table_goes_through(spark, docs):
    assert through(spark, docs([]))[1] == [0] * 5


def test_odd_rows_go_through(spark, docs, rng):
    """Nulls in every column, repeated rows, a very long text, and columns with the names that stages use themselves."""
    plain = [(i, words(rng, 80), "en", "ab"[i % 2]) for i in range(30)]
    odd = [(None, None, None, None), (40, None, "en", "a"), (41, "", None, None), (42, words(rng, 60), None, None), (42, plain[3][1], "en", "a"), plain[0], plain[0], (43, "alpha1 beta2 " * 120_000, "en", "b"), (None, words(rng, 70), "en", None)]
    table = docs([(*r, None) for r in plain + odd]).withColumns({"row": F.lit("x"), "scores": F.lit(1), "hits": F.lit(2), "took": F.lit(3), "fine": F.lit(4), "bits": F.lit(5)})
    pieces, counts = through(spark, table.repartition(3))
    assert counts[0] > 0 and counts[0] >= counts[1] == counts[2] > 0 and counts[4] > 0
    lengths = [r["sum(length)"] for r in pieces.groupBy("sequence_id").sum("length").collect()]
    assert all(0 < n <= 2048 and n & (n - 1) == 0 for n in lengths)
