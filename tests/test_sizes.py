"""Tasks hold a bounded part of the input: files, scans, shuffles and long lists."""

import __spark_entry__
from pyspark.sql import functions as F

from cairn.operators import answers, index
from cairn.operators.criteria import Item, Term
from cairn.sources import tables

DATA = "/root/testdata/sf0.001"


def rows_by_task(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_a_scan_of_a_written_table_has_as_many_tasks_as_its_rows_need(spark, tmp_path, monkeypatch):
    """Files of one row a byte or less: rows of a task don't grow with the table."""
    monkeypatch.setattr(tables, "FILE_ROWS", 1000)
    monkeypatch.setattr(tables, "SCAN_BYTES", 4 << 20)
    try:
        tables.fit(spark, DATA)
        for n in (8_000, 64_000):
            same = spark.range(n).select(F.lit("x").alias("a")).coalesce(1)
            assert max(rows_by_task(tables.written(same, "same"))) <= 1000
            assert max(rows_by_task(tables.stored(spark, str(tmp_path), f"same-{n}", lambda same=same: same))) <= 1000
    finally:
        tables.unfit(spark)


def test_shuffles_have_partitions_in_proportion_to_the_tables(spark, tmp_path, monkeypatch):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = {c: spark.conf.get(c, None) for c in (name, "spark.sql.files.maxPartitionBytes")}
    spark.range(1000).write.parquet(f"{tmp_path}/lineitem.parquet")
    try:
        tables.fit(spark, str(tmp_path))
        assert spark.conf.get(name) == spark.conf.get("spark.sql.shuffle.partitions")
        monkeypatch.setattr(tables, "SHUFFLE_BYTES", 50)
        tables.fit(spark, str(tmp_path))
        assert int(spark.conf.get(name)) > 20
    finally:
        tables.unfit(spark)
    assert before == {c: spark.conf.get(c, None) for c in before}


def test_catalog_queries_fit_their_tables_and_the_others_do_not(spark):
    try:
        found = __spark_entry__.queries()
        before = spark.conf.get("spark.sql.files.maxPartitionBytes", None)
        found["S18_backfilled"](spark, DATA)
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == str(tables.SCAN_BYTES)
        found["op7_url_filter"](spark, DATA)
        assert spark.conf.get("spark.sql.files.maxPartitionBytes", None) == before
    finally:
        tables.unfit(spark)


def test_a_long_list_is_dealt_to_many_tasks(spark):
    """Postings of one key, as of a kind that nearly every container holds."""
    one = spark.range(20_000).selectExpr("'v' as version", "'floor/item' as kind", "'potion' as a", "'haste' as b", "cast(id as string) as container_id", "1L as reach", "1L as count")
    name = "spark.sql.adaptive.coalescePartitions.enabled"  # so small a list would be one task's again
    try:
        spark.conf.set(name, False)
        assert max(rows_by_task(index.in_order(one.repartition(4)))) < 12_000
    finally:
        spark.conf.unset(name)


def test_walks_find_each_answer_once(spark, tmp_path, monkeypatch):
    rows = spark.range(40).selectExpr("'v' as version", "cast(id as string) as container_id", "'D:1' as place", "'potion' as base_type", "'haste' as sub_type", "1 as quantity", "cast(null as double) as cost", "cast(null as string) as name", "cast(null as string) as ego", "false as artefact", "cast(array() as array<struct<prop:string,value:int>>) as props", "cast(array() as array<string>) as spells")
    fills = rows.selectExpr("version", "container_id", "1L as depth", "'fill' as origin")
    answers.write_index(rows, fills, f"{tmp_path}/index")
    asked = []
    scan = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def seen(x):
        scan.add(1)
        return True

    monkeypatch.setattr(answers.search, "search", lambda e, terms, find=answers.search.search: asked.append(1) or find(e.where(seen("container_id")), terms))
    found = answers.audit_walks(rows, answers.read_index(spark, f"{tmp_path}/index"), {"item": [Term(Item("potion", "haste"))]}, limit=10, most_pages=3).collect()
    assert len(found) == 5 and all(r.ok for r in found)
    assert asked == [1] and scan.value == 40  # the scan's answer is asked for three times


def walked(spark, tmp_path, monkeypatch, change, **how):
    """Checks that fail where what the index finds of 60 containers, in pages of 7, is changed."""
    rows = spark.range(60).selectExpr("'v' as version", "cast(id as string) as container_id", "concat('D:', cast(id % 9 + 1 as string)) as place", "'potion' as base_type", "'haste' as sub_type", "1 as quantity", "cast(null as double) as cost", "cast(null as string) as name", "cast(null as string) as ego", "false as artefact", "cast(array() as array<struct<prop:string,value:int>>) as props", "cast(array() as array<string>) as spells")
    answers.write_index(rows, rows.selectExpr("version", "container_id", "1L as depth", "'fill' as origin"), f"{tmp_path}/index")
    monkeypatch.setattr(answers, "answer", lambda *a, find=answers.answer, **k: (change(find(*a, **k)[0]), "postings"))
    found = answers.audit_walks(rows, answers.read_index(spark, f"{tmp_path}/index"), {"item": [Term(Item("potion", "haste"))]}, limit=7, **how).collect()
    return [r.check for r in found if not r.ok]


def test_a_walk_is_held_against_the_scan_to_its_end(spark, tmp_path, monkeypatch):
    """What is lost on the eighth page is seen, however few pages are asked for one by one."""
    assert walked(spark, tmp_path, monkeypatch, lambda f: f.where("container_id <> '57'"), most_pages=2) == ["sets", "evidence", "reaches"]


def test_a_container_that_comes_twice_late_in_a_walk_is_seen(spark, tmp_path, monkeypatch):
    assert "repeats" in walked(spark, tmp_path, monkeypatch, lambda f: f.unionByName(f.where("container_id = '57'")), most_pages=1)


def test_a_whole_walk_of_several_pages_is_alike(spark, tmp_path, monkeypatch):
    assert walked(spark, tmp_path, monkeypatch, lambda f: f) == []
