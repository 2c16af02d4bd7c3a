"""Store transforms and sources that have no query of their own."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import catalog as C
from tessera.operators import limits, store
from tessera.sources import detection


def test_defaults_and_lookups(spark):
    rows = spark.createDataFrame([(1, None, None, None, None), (2, "x", "metric_m", 0.0, 2.0)], "project_id bigint, name string, unit_system string, tax_rate double, labor_rate_per_sf double")
    got = {r["project_id"]: tuple(r)[1:] for r in store.with_defaults(rows).collect()}
    assert got == {1: ("Untitled Takeoff", "imperial_ft_in", 8.625, 0.0), 2: ("x", "metric_m", 0.0, 2.0)}
    assert C.tile_catalog(spark).count() == 32 == len(C.sizes())
    assert spark.range(1).select(F.expr(C.feet_per_paper_inch("'1:100'"))).first()[0] == pytest.approx(0.1 * 25.4 * 3.280839895)
    assert spark.range(1).select(F.expr(store.texture_repeat("12D"))).first()[0] == 3


def test_single_and_lists(spark):
    rows = spark.createDataFrame([(1, 7, "a", 1.0, 2.0, 5, False), (2, 7, "b", 1.0, 2.0, 9, False), (3, 8, "c", 1.0, 2.0, 7, True), (3, 8, "d", 1.0, 2.0, 7, True)], "project_id bigint, owner bigint, name string, floor_sf double, total_cost double, updated_at bigint, archived boolean")
    assert store.single(rows, "project_id", 1).first()["name"] == "a"
    for wrong in (3, 4):
        with pytest.raises(Exception, match="rows found"):
            store.single(rows, "project_id", wrong).collect()
    assert [r["name"] for r in store.listed(store.owned(rows, 7)).collect()] == ["b", "a"]
    patch = spark.createDataFrame([(1, "z", None)], "project_id bigint, name string, floor_sf double")
    got = {r["project_id"]: r for r in store.merged(rows.where("project_id < 3"), patch, ["project_id"], ["name", "floor_sf"]).collect()}
    assert got[1]["name"] == "z" and got[1]["floor_sf"] == 1.0 and got[2]["name"] == "b"


def test_sliding_limit_borders(spark):
    at = [(0, 1, 0), (1, 1, 299_999), (2, 1, 300_000), (3, 1, 300_000), (4, 2, 5)]
    rows = spark.createDataFrame(at, "event_id bigint, identity bigint, ts_ms bigint")
    got = {r["event_id"]: (r["hits"], r["limited"]) for r in limits.sliding_log(rows, 300_000, 2).collect()}
    assert got == {0: (1, False), 1: (2, False), 2: (2, False), 3: (3, True), 4: (1, False)}


def test_detection(spark, tmp_path):
    body = '{"rooms":[{"name":" ","x":"a","y":1,"w":5,"h":6,"confidence":-1},{"w":"NaN","h":3},{"w":1001,"h":3},{"name":"%s","x":1,"y":2,"w":0.5,"h":1e3,"confidence":7},{"x":1e6,"w":1,"h":1}]}' % ("n" * 100)
    many = '{"rooms":[' + ",".join('{"w":1,"h":1}' for _ in range(250)) + "]}"
    rows = spark.createDataFrame([(1, body), (2, many), (3, "no"), (4, None)], "request_id bigint, body string")
    got = detection.cleaned(rows).collect()
    first = sorted((r["ord"], r["name"], r["x"], r["y"], r["w"], r["h"], r["confidence"]) for r in got if r["request_id"] == 1)
    assert first == [(0, "Room", 0.0, 1.0, 5.0, 6.0, 0.5), (3, "n" * 80, 1.0, 2.0, 0.5, 1000.0, 1.0)]
    assert sum(r["request_id"] == 2 for r in got) == 200 and {r["request_id"] for r in got} == {1, 2}
    (tmp_path / "a.png").write_bytes(b"abc")
    file = detection.encoded(spark.read.format("binaryFile").load(str(tmp_path))).first()
    assert file["media_type"] == "image/png" and file["data"] == "YWJj"


def test_late_requests_in_a_stream(spark, tmp_path):
    """Three micro-batches with rows that come late, but not too late: the settled stream equals the stored form; state goes with the watermark."""
    import random

    from tessera.streaming import limits as streams

    r = random.Random(9)
    rows = [(i, r.choice([1, 1, 2, 3]), 1_000_000_000_000 + 40_000 * i + r.randint(-200_000, 200_000)) for i in range(400)]
    rows += [(1000 + i, 1, 1_000_000_000_000 + 40_000 * 120) for i in range(3)]  # ties
    ddl = "event_id bigint, identity bigint, ts_ms bigint"
    for k, part in enumerate((rows[:150] + rows[400:], rows[150:290], rows[290:400])):
        one = spark.createDataFrame(part, ddl).withColumn("ts", F.timestamp_millis("ts_ms")).coalesce(1)
        one.write.mode("append").parquet(str(tmp_path / "in" / f"b{k}"))
    source = spark.readStream.schema(f"{ddl}, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(str(tmp_path / "in"))
    streams.run_once(streams.sliding_log(source, 300_000, 4, "10 minutes"), str(tmp_path / "out"), str(tmp_path / "state"))
    out = spark.read.parquet(str(tmp_path / "out"))
    want = sorted(map(tuple, limits.sliding_log(spark.createDataFrame(rows, ddl), 300_000, 4).select("event_id", "hits", "limited").collect()))
    assert sorted(map(tuple, streams.settled(out).select("event_id", "hits", "limited").collect())) == want
    assert out.count() > len(rows)  # some were sent again
    assert len(list((tmp_path / "state" / "commits").glob("[0-9]*"))) >= 3


def test_a_batch_of_requests_is_one_value_of_the_state():
    import pandas as pd

    from tessera.streaming import limits as streams

    class State:
        def __init__(self):
            self.values = []

        def get(self):
            return iter(list(self.values))

        def appendValue(self, value):
            self.values.append(value)

        def appendList(self, values):
            self.values += values

        def put(self, values):
            self.values = list(values)

        def getListState(self, name, schema):
            return self

        def registerTimer(self, at):
            pass

        def getCurrentWatermarkInMs(self):
            return 0

    state, log = State(), streams.SlidingLog(100, 2)
    log.init(state)
    told = lambda *rows: [tuple(x) for b in log.handleInputRows((7,), iter([pd.DataFrame(rows, columns=["ts_ms", "event_id"])]), state) for x in b[["event_id", "hits", "limited"]].values.tolist()]
    assert told((1050, 2), (1000, 1), (1090, 3)) == [(1, 1, False), (2, 2, False), (3, 3, True)]
    assert len(state.values) == 1
    assert told((1020, 4)) == [(4, 2, False), (2, 3, True), (3, 4, True)]
    assert len(state.values) == 1


def test_patches_keep_what_they_do_not_name(spark):
    import json

    from tessera.sources import variants

    doc = {"name": "P", "mine": {"a": [1, None, "x"]}, "rooms": [{"id": "r", "new": 7, "layout": {"pattern": "grid", "origin": {"x": 1.5, "y": 2}, "angleDeg": 0}}, {"id": "s"}, "odd"]}
    docs = spark.createDataFrame([(1, json.dumps(doc)), (2, '{"rooms": null}'), (3, "{}")], "project_id bigint, doc string")
    patches = spark.createDataFrame([(1, "r", 2, '{"layout": {"angleDeg": 30}}'), (1, "r", 1, '{"layout": {"angleDeg": 45, "pattern": "brick_50"}, "name": "Hall"}'), (1, "s", 1, '{"layout": {"angleDeg": 5}, "new": null}'), (1, "gone", 1, "{}"), (2, "r", 1, '{"a": 1}')], "project_id bigint, id string, seq int, patch string")
    got = {r["project_id"]: json.loads(r["doc"]) for r in variants.patch_items(docs, patches).collect()}
    want = json.loads(json.dumps(doc))
    want["rooms"][0] |= {"name": "Hall", "layout": {"pattern": "brick_50", "origin": {"x": 1.5, "y": 2}, "angleDeg": 30}}
    want["rooms"][1] |= {"layout": {"angleDeg": 5}, "new": None}
    assert got == {1: want, 2: {"rooms": None}, 3: {}}
    flat = json.loads(variants.patch_items(docs, patches, deep=()).where("project_id = 1").first()["doc"])
    assert flat["rooms"][0]["layout"] == {"angleDeg": 30}
    loaded = {r["project_id"]: r["doc"] and json.loads(r["doc"]) for r in variants.load_snapshots(docs.unionByName(spark.createDataFrame([(4, "[1]"), (5, None)], "project_id bigint, doc string"))).collect()}
    assert loaded[1] == {**variants.BLANK, **doc} and loaded[3] == variants.BLANK and loaded[4] is None and loaded[5] is None


def test_changes_rewrite_what_they_touch(spark, tmp_path):
    from tessera.operators.stored import ProjectStore

    columns = "project_id bigint, owner bigint, name string, updated_at timestamp"
    table = ProjectStore(spark, str(tmp_path / "t"), columns, buckets=16).create()
    row = lambda df: df.selectExpr("project_id", "owner", "name", "timestamp_seconds(at) AS updated_at")
    made = lambda *rows: row(spark.createDataFrame(list(rows), "project_id bigint, owner bigint, name string, at bigint"))
    files = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    names = lambda: {r["project_id"]: r["name"] for r in table.read().collect()}
    assert table.upsert(made(*((i, i % 3, f"n{i}", 1) for i in range(200))), 0) == 16 and len(names()) == 200
    before = files()
    assert table.upsert(made((7, 1, "new", 3), (7, 1, "old", 2)), 1, "timestamp_seconds(99)") == 1
    kept = set(before) & set(files())
    assert len(kept) == len(before) - 1 and all(before[f] == files()[f] for f in kept) and names()[7] == "new"
    assert table.read().where("project_id = 7").first()["updated_at"].timestamp() == 99  # X23: the time of the change
    same = files()
    assert table.upsert(made((7, 1, "again", 9)), 1) == 0 and files() == same  # a batch that comes again
    assert table.upsert(made((7, 2, "stolen", 9)), 2) == 0 and names()[7] == "new"  # X24: another owner's
    assert table.delete(spark.createDataFrame([(7, 2), (8, 2), (999, 0)], "project_id bigint, owner bigint"), 3) == 1
    assert 7 in names() and 8 not in names() and len(names()) == 199
    assert table.delete(table.read().select("project_id", "owner"), 4) == 16 and not names()
    assert table.upsert(made(*()), 5) == 0


def test_a_stream_of_changes_applies_once(spark, tmp_path):
    from tessera.operators.stored import ProjectStore

    columns = "project_id bigint, owner bigint, name string, updated_at timestamp"
    table = ProjectStore(spark, str(tmp_path / "t"), columns, buckets=4).create()
    for k in range(3):
        spark.range(40).selectExpr("id AS project_id", "1L AS owner", f"concat('v{k}-', id) AS name", f"timestamp_seconds({k}) AS updated_at").where(f"project_id % 3 >= {k}").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    table.follow(stream, str(tmp_path / "state")).awaitTermination()
    want = {i: f"v{i % 3}-{i}" for i in range(40)}
    rows = lambda: {r["project_id"]: tuple(r) for r in table.read().collect()}
    first = rows()
    assert {i: r[2] for i, r in first.items()} == want
    last = max((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    last.unlink()  # as if the run had died before it could note the last batch: it runs again
    table.follow(stream, str(tmp_path / "state")).awaitTermination()
    assert rows() == first  # times of change included


def test_long_plan_images_stay_out(spark):
    """A document keeps a plan image of fewer than 600,000 characters."""
    import json

    from tessera import schema
    from tessera.sources import documents

    none = [spark.createDataFrame([], f"{ddl}, wall_height double" if "points" in ddl and "wall_height" not in ddl else ddl) for ddl in (schema.ROOM, schema.MATERIAL, schema.BRIDGE, schema.MARKUP)]
    projects = spark.createDataFrame([(1, "a", "x" * 599_999), (2, "b", "x" * 600_000), (3, "c", None)], "project_id bigint, name string, plan_image string").selectExpr("*", "'metric_m' AS unit_system", "1D AS scale", "0D AS tax_rate", "0D AS labor_rate_per_sf")
    got = {r["project_id"]: json.loads(r["doc"]) for r in documents.to_documents(projects, *none).collect()}
    assert len(got[1]["planImage"]) == 599_999 and "planImage" not in got[2] and "planImage" not in got[3]


def test_workbooks_in_columns_equal_those_cell_by_cell(spark):
    """report_xlsx: rows written in columns are the bytes of workbook(), which writes cell by cell, and are read back alike; texts need escaping, cells and lists are missing."""
    from tessera.sources import documents

    est = "array(named_struct('material', 'a & <b>', 'tiles', 3L, 'cost', 1.5D), named_struct('material', CAST(NULL AS STRING), 'tiles', CAST(NULL AS BIGINT), 'cost', 1e-7D))"
    room = "array(named_struct('name', '&lt;', 'area', 20D))"
    sums = ", ".join(f"{i}.25D AS sum_{k}" for i, k in enumerate(("materials", "labor", "subtotal", "tax")))
    cells = spark.sql(f"SELECT id AS project_id, {sums}, IF(id = 1, NULL, 9D) AS sum_total, concat('Tax ', id, '%') AS tax_label, IF(id = 2, NULL, {est}) AS est, IF(id = 3, slice({room}, 1, 0), {room}) AS room, {room} AS used FROM range(1, 5)").coalesce(1)
    made = documents._books(cells)
    expected = {}
    for x in cells.collect():
        below = lambda k: [list(e) for e in x[k] or ()]  # noqa: B023, E731
        last = [[""] * 10 + [label, x[f"sum_{k}"]] for label, k in (("Materials", "materials"), ("Labor", "labor"), ("Subtotal", "subtotal"), (x["tax_label"], "tax"), ("TOTAL", "total"))]
        expected[x["project_id"]] = documents.workbook({"Estimate": [documents.ESTIMATE_HEAD, *below("est"), [], *last], "Rooms": [documents.ROOMS_HEAD, *below("room")], "Materials": [documents.MATERIALS_HEAD, *below("used")]})
    assert {x["project_id"]: bytes(x["xlsx"]) for x in made.collect()} == expected
    first = {(x["project_id"], x["row"]): x["cells"] for x in documents.read_workbooks(made, 1).collect()}
    assert first[1, 1] == ["a & <b>", "3", "1.5"] and first[1, 2] == [None, None, "1e-07"] and first[1, 3] == [] and first[2, 2] == [""] * 10 + ["Materials", "0.25"] and first[1, 8] == [""] * 10 + ["TOTAL"]
    assert {k: v for k, v in ((x["project_id"], x["cells"]) for x in documents.read_workbooks(made, 2).where("row = 1").collect())} == {i: ["&lt;", "20.0"] for i in (1, 2, 4)}
    assert documents._rows(["2"], ["x"]).to_pylist() == [documents._row(1, ["x"])]  # a row is written by columns, and there alone


def test_workbooks_are_gathered_by_one_sort(spark):
    """report_xlsx, report_xlsx_rooms, report_xlsx_materials: a project's rows are sorted once to meet, not grouped again and again, each time with all of them spilled."""
    from tessera.plans import queries as Q
    from tessera.sources import documents

    sf = "/root/testdata/sf0.001"
    parts = documents.gathered(*(f(spark, sf) for f in (lambda s, d: Q.load(s, d, "projects"), Q._lines, lambda s, d: Q.load(s, d, "rooms"))))
    plan = parts._jdf.queryExecution().sparkPlan().toString()
    after = plan[: plan.index("MapInArrow")] + plan[plan.index("MapInArrow") :].split("Union")[0]
    assert "Aggregate" not in after and after.count("Sort [project_id") == 1 and after.count("Exchange") == 1


def test_patched_documents_are_read_once(spark):
    """layout_patches: the unknown field comes from the reading that gives the rooms."""
    from tessera.plans import queries as Q

    plan = Q.layout_patches(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "$.planNote" not in plan and plan.count("from_json(") == 1
