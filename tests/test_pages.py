"""Pages by windows, samples by seeks, bitmaps with the rarest list first, audits by walks, and the store of deltas."""

import json
import re
import os

from pyspark.sql import functions as F

from cairn.operators import answers, bitmaps, index, ingest, pages, search
from cairn.operators.criteria import Item, Term
from cairn.streaming.store import CatalogStore, checkpoint_epoch, stream_lines
from tests.test_catalog import entry


def corpus(spark, n=400):
    return entry(spark, [{"container_id": str(i), "place": "D:1", "base_type": "potion", "sub_type": "x" if i % 3 else "y", "quantity": i % 5 + 1} for i in range(n)] + [{"container_id": str(i), "place": "D:2", "base_type": "wand", "sub_type": "dig"} for i in range(0, n, 50)])


def files_read(df):
    """Files that the scans of a plan have read."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        if node.nodeName().startswith("Scan parquet"):
            found += node.metrics().apply("numFiles").value()
        for attr in ("children",):
            kids = getattr(node, attr)()
            todo += [kids.apply(i) for i in range(kids.size())]
        if hasattr(node, "plan") and "QueryStage" in node.nodeName():
            todo.append(node.plan())
    return found


def test_a_first_page_reads_few_windows(spark, tmp_path):
    e = corpus(spark)
    pages.write_windows(e, str(tmp_path), 20)
    table = pages.read_windows(spark, str(tmp_path), e.schema)
    terms = [Term(Item("potion", "x"))]
    whole = sorted(r.container_id for r in search.search(e, terms).collect())
    found, read = pages.search_page(table, "v", terms, None, 5)
    assert [r.container_id for r in found.collect()] == whole[:6] and read <= 2
    assert table.windows.count() >= 15 and files_read(table.only([3])) == 1
    found, read = pages.search_page(table, "v", terms, whole[100], 50)
    assert [r.container_id for r in found.collect()] == whole[101:152]
    walked, cursor = [], None
    while True:
        got = [r.container_id for r in pages.search_page(table, "v", terms, cursor, 60)[0].collect()]
        walked += got[:60]
        if len(got) <= 60:
            break
        cursor = got[59]
    assert walked == whole
    assert pages.search_page(table, "v", [Term(Item("potion", "none"))], None, 5)[0].count() == 0
    assert pages.search_page(table, "no such version", terms, None, 5)[0].count() == 0


def test_sample_by_seeks(spark, tmp_path):
    e = corpus(spark)
    pages.write_windows(e, str(tmp_path), 20)
    table = pages.read_windows(spark, str(tmp_path), e.schema)
    found, read = pages.sample_by_seeks(table, "v", 6, 3)
    got = {r.container_id for r in found.collect()}
    assert 0 < len(got) <= 6 and read <= 6 and got <= {str(i) for i in range(400)}
    assert got == {r.container_id for r in pages.sample_by_seeks(table, "v", 6, 3)[0].collect()}
    assert pages.sample_by_seeks(table, "none", 6, 3)[0].count() == 0


def test_the_rarest_list_decides_which_buckets_are_read(spark, tmp_path, monkeypatch):
    many = spark.range(1, 200_001)
    postings = many.selectExpr("'v' as version", "'k' as kind", "'' as a", "'broad' as b", "cast(id as string) as container_id", "1L as reach", "id % 7 as count").where("count > 0")
    postings = postings.unionByName(many.where("id in (5, 9, 150000)").selectExpr("'v' as version", "'k' as kind", "'' as a", "'rare' as b", "cast(id as string) as container_id", "1L as reach", "3L as count"))
    ordinals = many.selectExpr("'v' as version", "cast(id as string) as container_id", "id as ord")
    built = bitmaps.build_bitmaps(postings, ordinals)
    bitmaps.write_bitmaps(built, str(tmp_path))
    stored, cards = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("bitmaps", "cards"))
    assert [k[2] for k in bitmaps.rarest_first(cards, [("k", "", "broad", 1), ("k", "", "rare", 1)])] == ["rare", "broad"]
    ask = lambda *keys: sorted(int(r.container_id) for r in bitmaps.holding_all(stored, cards, ordinals, postings, list(keys)).collect())
    assert ask(("k", "", "broad", 1), ("k", "", "rare", 1)) == [5, 9, 150000]
    assert ask(("k", "", "broad", 5), ("k", "", "rare", 1)) == [5]  # 5 lies between the counts that have bitmaps: 9 % 7 = 2, 150000 % 7 = 4
    assert ask(("k", "", "broad", 1), ("k", "", "broad", 6)) == [i for i in range(1, 200_001) if i % 7 == 6]
    assert ask(("k", "", "broad", 1), ("k", "", "absent", 1)) == []
    plan = bitmaps.holding_all(stored, cards, ordinals, postings, [("k", "", "broad", 1), ("k", "", "rare", 1)])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"bucket#\d+L IN \(1,5\)", plan)  # of seven buckets
    monkeypatch.setattr(bitmaps, "MOST_BUCKETS", 1)
    assert ask(("k", "", "broad", 1), ("k", "", "rare", 1)) == [5, 9, 150000]


def test_two_minima_of_one_key(spark):
    e = corpus(spark, 30)
    postings = index.build_postings(e)
    key = ("floor/item", "potion", "x")
    found = {r.container_id for r in index.search_indexed(postings, [(*key, 3), (*key, 5)]).collect()}
    assert found == {r.container_id for r in search.search(e, [Term(Item("potion", "x"), 5)]).collect()} and found


def test_walks_catch_a_corrupted_index(spark, tmp_path):
    e = corpus(spark, 120)
    fills = e.groupBy("version", "container_id").agg(F.lit(9).cast("long").alias("depth"), F.lit("fill").alias("origin"))
    answers.write_index(e, fills, str(tmp_path))
    good = answers.read_index(spark, str(tmp_path))
    ask = {"x": [Term(Item("potion", "x"))], "y and wand": [Term(Item("potion", "y")), Term(Item("wand", "dig"))]}
    assert all(r.ok for r in answers.audit_walks(e, good, ask, limit=25).collect())
    lost = answers.Index(good.postings.where("container_id <> '7'"), good.criteria, good.grams, good.ordinals, good.state)
    bad = {(r.query, r.check) for r in answers.audit_walks(e, lost, ask, limit=25).collect() if not r.ok}
    assert ("x", "sets") in bad and ("x", "evidence") in bad and ("y and wand", "sets") not in bad


def line(place, items, container="1", parent=None, **more):
    record = {"format": 4, "version": "v", "seed": container, "level": place, "parent_level": parent, "cats": {"items": [{"name": n, "quantity": q} for n, q in items]}}
    return ingest.PREFIX + json.dumps(record | more)


def send(path, name, lines):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/.{name}", "w") as f:
        f.write("\n".join(lines) + "\n")
    os.rename(f"{path}/.{name}", f"{path}/{name}")


def state(store):
    levels, entries = store.tables()
    held = {}
    for r in entries.collect():
        held.setdefault((r.container_id, r.place), []).append((r.name, r.quantity))
    return {(r.container_id, r.place): sorted(held.get((r.container_id, r.place), [])) for r in levels.collect()}


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs)


def test_lines_stream_into_deltas(spark, tmp_path):
    source, folder, first = (str(tmp_path / n) for n in ("in", "store", "ck1"))
    run = lambda ck: stream_lines(spark.readStream.text(source), CatalogStore(spark, folder), ck, f"{tmp_path}/rejects").awaitTermination()
    send(source, "a.txt", [line("D:1", [("axe", 1)]), "noise", line("D:2", [("hat", 2), ("hat", 2)]), line("D:1", [("later", 1)]), line("Sewer", []), line("D:3", [], version=7)])
    run(first)
    assert state(CatalogStore(spark, folder)) == {("1", "D:1"): [("later", 1)], ("1", "D:2"): [("hat", 2), ("hat", 2)]}
    assert sorted(r.reason for r in spark.read.parquet(f"{tmp_path}/rejects").collect()) == ["a portal without parent", "ill-typed version"]
    send(source, "b.txt", [line("D:2", []), line("Sewer", [("rat", 1)], parent="D:1")])
    run(first)
    now = {("1", "D:1"): [("later", 1)], ("1", "D:2"): [], ("1", "Sewer"): [("rat", 1)]}
    assert state(CatalogStore(spark, folder)) == now
    # a new checkpoint numbers its batches from 0 again: all lines come once more, in one batch, and then a new place
    send(source, "c.txt", [line("D:9", [("new", 1)])])
    run(str(tmp_path / "ck2"))
    store = CatalogStore(spark, folder)
    assert ("1", "D:9") in state(store) and len(store.log()) == 3
    epochs = {r.epoch for r in store.log()}
    assert len(epochs) == 2 and checkpoint_epoch(spark, first) in epochs


def test_a_batch_sent_again_or_broken_off(spark, tmp_path):
    store = CatalogStore(spark, str(tmp_path))
    place = lambda rows: spark.createDataFrame(rows, "version string, container_id string, place string, name string")
    assert store.tables() is None
    assert store.append(None, place([("v", "1", "D:1", "a"), ("v", "2", "D:1", "b")]), "e", 0)
    assert not store.append(None, place([("v", "1", "D:1", "never")]), "e", 0)
    place([("v", "9", "D:1", "broken off")]).write.parquet(f"{tmp_path}/delta-half/entries")  # no row in the log
    assert store.append(None, place([("v", "1", "D:1", "c")]), "other", 0)
    gone = spark.createDataFrame([("v", "2", "D:1", True)], "version string, container_id string, place string, gone boolean")
    assert store.append(gone, place([]), "other", 1)
    names = lambda: sorted(r.name for r in CatalogStore(spark, str(tmp_path)).tables()[1].collect())
    assert names() == ["c"] and store.tables()[0].count() == 1
    store.compact()
    assert names() == ["c"] and len(store.log()) == 1
    assert "delta-half" in store.vacuum() and names() == ["c"]
    assert store.append(None, place([("v", "3", "D:1", "d")]), "e", 1) and names() == ["c", "d"]
    assert not store.append(None, place([("v", "3", "D:1", "x")]), "other", 1)


def test_a_batch_writes_in_proportion_to_itself(spark, tmp_path):
    store = CatalogStore(spark, str(tmp_path))
    rows = lambda low, high, tag: spark.range(low, high).selectExpr("'v' as version", "cast(id as string) as container_id", "'D:1' as place", f"concat('{tag}', uuid()) as name")
    store.append(None, rows(0, 50_000, "a"), "e", 0)
    before = size(tmp_path)
    store.append(None, rows(0, 50, "b").coalesce(1), "e", 1)
    assert size(tmp_path) - before < before / 50
    levels, entries = store.tables()
    assert levels.count() == entries.count() == 50_000 and entries.where("startswith(name, 'b')").count() == 50


def test_streamed_lines_are_written_by_many_tasks(spark, monkeypatch):
    import __spark_entry__ as driver
    from cairn.plans import intake

    paths = []
    monkeypatch.setattr(intake, "fresh_path", lambda s, name, real=intake.fresh_path: paths.append((name, real(s, name))) or paths[-1][1])
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert driver.queries()["T1_streamed_lines"](spark, "/root/testdata/sf0.001").count() > 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sent, late = [path for name, path in paths if name == "lines"]
    parts = lambda path: sum(f.startswith("part-") for f in os.listdir(path))
    assert parts(sent) > 3 and parts(late) > 1


def exchanged(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def test_records_of_a_batch_stay_where_they_are_read(spark, tmp_path):
    """Places meet by key and arrival; their records do not."""
    lines = [(n, line(f"D:{n}", [("axe", n)])) for n in range(1, 9)] + [(9, line("D:1", [("hat", 9)])), (10, line("D:10", [], seed=None)), (11, line("Temple", []))]
    taken = ingest.intake(spark.createDataFrame(lines, "arrival long, value string").repartition(3), apart=True)
    assert exchanged(taken.entries) == 0
    assert sorted((r.place, r.name, r.quantity) for r in taken.entries.collect()) == [("D:1", "hat", 9)] + [(f"D:{n}", "axe", n) for n in range(2, 9)]
    assert sorted((r.place, r.altar_mask) for r in taken.levels.collect()) == [(f"D:{n}", None) for n in range(1, 9)] + [("Temple", 0)]
    assert [(r.reason, "D:10" in r.body) for r in taken.rejects.collect()] == [("no container", True)]
    assert os.path.isdir(taken.folder)
    taken.close()
    assert not os.path.exists(taken.folder)


def test_of_lines_that_arrived_together_the_greatest_text_counts(spark):
    """Among places too many to be sent around, too."""
    both = [line(f"D:{n}", [(name, 1)]) for n in range(20) for name in ("axe", "wand", "hat", "wand")]
    for most in ("10MB", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
        try:
            taken = ingest.intake(spark.createDataFrame([(x,) for x in both], "value string").repartition(4))
            assert sorted((r.place, r.name) for r in taken.entries.collect()) == sorted((f"D:{n}", "wand") for n in range(20))
            assert taken.levels.count() == 20
            taken.close()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_streamed_lines_are_sent_compressed(spark, monkeypatch):
    import __spark_entry__ as driver
    from cairn.plans import intake

    paths = []
    monkeypatch.setattr(intake, "fresh_path", lambda s, name, real=intake.fresh_path: paths.append((name, real(s, name))) or paths[-1][1])
    assert driver.queries()["T1_streamed_lines"](spark, "/root/testdata/sf0.001").count() > 0
    for path in [path for name, path in paths if name == "lines"]:
        text = spark.read.text(path).agg(F.sum(F.length("value"))).first()[0]
        assert size(path) < text / 4


def test_a_base_is_read_as_it_was_written(spark, tmp_path):
    """What is compacted has nothing to merge, so that neither levels nor entries meet again; later deltas are merged with it."""
    store = CatalogStore(spark, str(tmp_path))
    place = lambda rows: spark.createDataFrame(rows, "version string, container_id string, place string, name string")
    store.append(None, place([("v", "1", "D:1", "a"), ("v", "2", "D:1", "b"), ("v", "3", "D:1", "c")]), "e", 0)
    store.append(spark.createDataFrame([("v", "3", "D:1", True)], "version string, container_id string, place string, gone boolean"), place([("v", "1", "D:1", "d")]).limit(0), "e", 1)
    store.append(None, place([("v", "1", "D:1", "d"), ("v", "1", "D:1", "d")]), "e", 2)
    assert exchanged(store.tables()[0]) == 1
    store.compact()
    levels, entries = store.tables()
    assert exchanged(levels) == exchanged(entries) == 0
    names = lambda: sorted((r.container_id, r.name) for r in store.tables()[1].collect())
    assert names() == [("1", "d"), ("1", "d"), ("2", "b")] and levels.count() == 2 and "_seq" not in levels.columns
    store.append(None, place([("v", "2", "D:1", "e")]), "e", 3)
    assert names() == [("1", "d"), ("1", "d"), ("2", "e")]
    store.compact()
    assert names() == [("1", "d"), ("1", "d"), ("2", "e")] and store.tables()[0].count() == 2
