import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import ann, history, rollup, search, views
from tessera.plans import mutate, schema, sql
from tessera.plans.catalog import Catalog, Index, Relation
from tessera.plans.graphql import QueryError, parse
from tessera.plans.rest import Rest
from tessera.plans.select import Planner, query, respond
from tessera.sources import backup
from tessera.streaming.rollups import strict_rollup, subscription


@pytest.fixture
def store(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/store")
    mutate.stored(c, "User", "id long, name string, age long, hits long, tags array<string>", c.root, "id", {"age": {"default": 7}, "hits": {"counter": "p"}, "name": {"immutable": True}, "tags": {"size": 2}}, [Index("u", ("name",), "unique")])
    query(c, 'mutation { add_User(input: [{id: 1, name: "a", hits: 1}, {id: 2, name: "b", age: 3, tags: ["x", "y"]}]) { id } }')
    return c


def error(c, text):
    return respond(c, text)["errors"][0]["message"]


def test_mutations_as_text(store):
    data = lambda text: respond(store, text)["data"]
    assert data("{ User(order: {id: ASC}) { _docID name age hits tags } }")["User"] == [{"_docID": "1", "name": "a", "age": 7, "hits": 1, "tags": None}, {"_docID": "2", "name": "b", "age": 3, "hits": None, "tags": ["x", "y"]}]
    for text, why in (
        ('add_User(input: {id: 1, name: "z"})', "already"), ('add_User(input: [{id: 8}, {id: 8}])', "twice"), ('add_User(input: {id: 9, name: "b"})', "unique"), ("add_User(input: {name: \"n\"})", "key"), ('add_User(input: {id: "x"})', "can't be"),
        ('update_User(docID: "1", input: {hits: -5})', "grows"), ('update_User(docID: "1", input: {name: "q"})', "changed"), ('update_User(docID: "1", input: {tags: ["q"]})', "2 elements"), ("update_User(input: {nothing: 1})", "no field"),
        ("upsert_User(filter: {age: {_gt: 0}}, add: {id: 5}, update: {age: 1})", "more than one"), ("frob_User", "no such mutation"), ("upsert_User(filter: {})", "needs"),
    ):
        assert why in error(store, f"mutation {{ {text} {{ id }} }}")
    assert data("mutation { update_User(filter: {age: {_gt: 1}}, input: {hits: 5}) { id hits } }")["update_User"] == [{"id": 1, "hits": 6}, {"id": 2, "hits": 5}]
    up = 'mutation { upsert_User(filter: {id: 5}, add: {id: 5, name: "e"}, update: {age: 1}) { id age } }'
    assert [data(up)["upsert_User"] for _ in range(2)] == [[{"id": 5, "age": 7}], [{"id": 5, "age": 1}]]
    assert data('mutation { delete_User(docID: "2") { id _deleted } }')["delete_User"] == [{"id": 2, "_deleted": True}]
    assert [r["id"] for r in data("{ User(order: {id: ASC}) { id } }")["User"]] == [1, 5] and len(data("{ User(showDeleted: true) { id } }")["User"]) == 3
    assert "already" in error(store, "mutation { add_User(input: {id: 2}) { id } }")  # the key of a deleted document
    store["User"].table.compact()
    assert [r["hits"] for r in data("{ User(order: {id: ASC}) { hits } }")["User"]] == [6, None]
    assert data("mutation { n: truncate_User }")["n"][0]["n"] == 3 and data("{ User { id } }")["User"] == []


def test_commits_versions_and_time_travel(store):
    query(store, 'mutation { update_User(docID: "1", input: {hits: 5, age: 9}) { id } }')
    query(store, 'mutation { update_User(docID: "1", input: {hits: 2}) { id } }')
    query(store, 'mutation { delete_User(docID: "2") { id } }')
    data = lambda text: respond(store, text)["data"]
    got = data('{ _commits(docID: "1", fieldName: "hits") { height delta heads { fieldName } links { cid } } }')["_commits"]
    assert [(r["height"], r["delta"], len(r["heads"]), r["links"]) for r in got] == [(3, "2", 1, []), (2, "5", 1, []), (1, "1", 0, [])]
    names = [r["fieldName"] for r in data('{ _commits(docID: "1") { fieldName } }')["_commits"]]
    assert names == sorted(n for n in names if n != "_C") + ["_C"] * 3
    assert {r["height"] for r in data('{ _commits(docID: "1", fieldName: "_C", depth: 2) { height } }')["_commits"]} == {3, 2}
    assert [r["height"] for r in data('{ _commits(docID: "1", filter: {_and: [{height: {_gt: 1}}, {fieldName: "hits"}]}, order: {height: ASC}, limit: 1) { height } }')["_commits"]] == [2]
    assert data('{ n: COUNT(_commits: {docID: "1"}) s: SUM(_commits: {field: delta, filter: {fieldName: "hits"}}) }') == {"n": 10, "s": 8.0}
    groups = data("{ _commits(groupBy: [fieldName], order: {fieldName: ASC}) { fieldName n: COUNT(GROUP: {}) GROUP { height } } }")["_commits"]
    assert groups[0]["fieldName"] == "_C" and groups[0]["n"] == 5 and [g["height"] for g in groups[0]["GROUP"]] == [3, 2, 2, 1, 1]
    user = data('{ User(docID: "1") { hits _version { cid height n: COUNT(links: {}) } } }')["User"][0]
    assert user["hits"] == 8 and [(v["height"], v["n"]) for v in user["_version"]] == [(3, 1), (2, 2), (1, 4)]
    cids = [v["cid"] for v in user["_version"]]
    assert [data(f'{{ User(cid: "{c}") {{ hits age }} }}')["User"] for c in cids] == [[{"hits": 8, "age": 9}], [{"hits": 6, "age": 9}], [{"hits": 1, "age": 7}]]
    assert "_commits" not in str(respond(store, f'{{ _commits(cid: ["{cids[0]}", "{cids[0]}"]) {{ cid }} }}').get("errors")) and len(data(f'{{ _commits(cid: ["{cids[0]}", "{cids[0]}"]) {{ cid }} }}')["_commits"]) == 1


def test_a_replayed_counter_stops_at_its_bounds(spark):
    log = spark.createDataFrame([("d", "n", k, None, v, f"c{k}") for k, v in enumerate([(1 << 63) - 5, 10, -3])], "doc_id string, field string, priority long, value string, delta long, cid string")
    assert history.counters(log, saturate=True).first().value == (1 << 63) - 4
    assert history.counters(log).first().value == (1 << 63) - 5 + 7 - (1 << 64)


def test_transactions(store):
    with pytest.raises(RuntimeError), mutate.Transaction(store) as t:
        query(t, "mutation { add_User(input: {id: 20}) { id } }")
        raise RuntimeError
    with mutate.Transaction(store) as t:
        query(t, "mutation { add_User(input: {id: 21}) { id } }")
        assert query(store, "{ User { id } }").count() == 2 and query(t, "{ User { id } }").count() == 3
    assert query(store, "{ User { id } }").count() == 3
    with pytest.raises(mutate.WriteError), mutate.Transaction(store) as t:
        query(t, "mutation { add_User(input: {id: 22}) { id } }")
        query(store, "mutation { add_User(input: {id: 23}) { id } }")


def test_sql_statements(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}")
    run = lambda text: [tuple(r) for r in sql.execute(c, text).collect()]
    run("CREATE TABLE author (id INT PRIMARY KEY, name VARCHAR(20) NOT NULL, n INT DEFAULT 4, price NUMERIC(10, 2))")
    run("CREATE TABLE book (id INT PRIMARY KEY, title TEXT, author_id INT REFERENCES author(id))")
    assert run("INSERT INTO author (id, name) VALUES (1, 'A, (x)'), (2, 'it''s') RETURNING id, name AS nm, n + 1 AS m") == [(1, "A, (x)", 5), (2, "it's", 5)]
    assert run("INSERT INTO book VALUES (10, 't', 1), (11, 'u', 2)") == [(2,)]
    assert sorted(run("INSERT INTO author (id, name, n) VALUES (1, 'AA', 9), (3, 'C', 1) ON CONFLICT (id) DO UPDATE SET n = n + excluded.n, name = excluded.name RETURNING id, name, n")) == [(1, "AA", 13), (3, "C", 1)]
    assert run("INSERT INTO author (id, name) VALUES (1, 'AA') ON CONFLICT DO NOTHING") == [(0,)]
    assert run("UPDATE author SET n = n * 2 WHERE name LIKE 'A%' RETURNING id, n") == [(1, 26)]
    assert run("SELECT a.name, b.title FROM author a JOIN book b ON b.author_id = a.id ORDER BY 1") == [("AA", "t"), ("it's", "u")]
    assert run("DELETE FROM author WHERE id = 2 RETURNING id") == [(2,)] and run("SELECT id FROM book") == [(10,)]  # what refers to it goes, too
    run("CREATE UNIQUE INDEX IF NOT EXISTS nm ON author (name)")
    for bad in ("INSERT INTO author (id, name) VALUES (7, 'C')", "INSERT INTO author (id, n) VALUES (8, 1)", "INSERT INTO author (id) VALUES (1, 2)", "UPDATE nothing SET a = 1", "FROB x", "UPDATE author SET id = 4 WHERE id = 1"):
        with pytest.raises(QueryError):
            run(bad)
    assert [tuple(r)[:2] for r in sql.tables(c).where("is_key").collect()] == [("author", "id"), ("book", "id")] and sql.foreign_keys(c).count() == 1
    run("ALTER TABLE book ADD FOREIGN KEY (id) REFERENCES author (id)")
    assert sql.foreign_keys(c).count() == 1 and run("DROP TABLE book") == [("DROP",)] and run("TRUNCATE TABLE book") == [(2,)]  # the deleted one, too


def test_not_in_is_joined_by_key_and_minds_nulls(spark):
    import duckdb

    known = "(VALUES (1, 5), (2, NULL), (2, 6), (NULL, 7), (4, 8)) AS v(a, x)"
    for name, rows in (("kt", known), ("ks", "(VALUES (2, 1), (9, 1), (5, 2)) AS v(b, c)"), ("kn", "(VALUES (2, 1), (NULL, 2)) AS v(b, c)"), ("ke", "(SELECT 1 AS b, 1 AS c WHERE 1 = 0)")):
        duckdb.sql(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM {rows}")
        spark.sql(f"SELECT * FROM {rows}").createOrReplaceTempView(name)
    seen = 0
    for where in (
        "a NOT IN (SELECT b FROM {s})", "x > 5 AND a NOT IN (SELECT b FROM {s} WHERE c = 1)", "(x = 5 OR a + 1 NOT IN (SELECT b FROM {s})) AND x < 8", "a NOT IN (SELECT a FROM kt WHERE x NOT IN (SELECT b FROM {s}))", "x NOT IN (SELECT a FROM kt)",
        "CASE WHEN a = 1 THEN x ELSE a END NOT IN (SELECT b FROM {s} /* ) */ -- NOT IN (\n)", "a NOT IN (WITH w AS (SELECT b FROM {s} WHERE c = 2) SELECT b FROM w) AND 'NOT IN (SELECT' <> ')'", "a NOT IN (SELECT b FROM {s} WHERE c = a)", "a NOT IN (SELECT b FROM {s}) OR x NOT IN (SELECT b FROM {s})",
        "NOT a NOT IN (SELECT b FROM {s})", "NOT (x = 5 OR a NOT IN (SELECT b FROM {s}))", "(a, x) NOT IN (SELECT b, c FROM {s})", "a NOT IN (SELECT b FROM {s} ORDER BY b NULLS LAST LIMIT 1)", "a NOT IN (1, 5)",
    ):
        for s in ("ks", "kn", "ke"):
            text = f"SELECT a, x FROM kt WHERE {where.format(s=s)} ORDER BY a, x"
            seen += sql.keyed(text) != text
            assert sorted(map(str, (tuple(r) for r in sql.run(spark, text).collect()))) == sorted(map(str, duckdb.sql(text).fetchall())), text
    assert seen == 10 * 3  # several columns are tried, and taken as they were
    for text in ("SELECT count_if(a IS NOT NULL) FROM kt WHERE (a IN (SELECT b FROM kn)) IS NULL", "SELECT * FROM kt JOIN ks ON a NOT IN (SELECT b FROM kn)", "SELECT 1 WHERE (1 NOT IN (SELECT b FROM kn)) IS NULL", "SELECT 1 NOT IN (SELECT 2"):
        assert sql.keyed(text) == text
    plan = sql.run(spark, "SELECT id FROM range(9) WHERE id NOT IN (SELECT id + 1 FROM range(5))")._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "Broadcast" not in plan


def test_sql_deletes_by_not_in(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/sql")
    sql.execute(c, "CREATE TABLE item (id bigint PRIMARY KEY, kind text)")
    sql.execute(c, "INSERT INTO item (id, kind) VALUES (1, 'a'), (2, 'b'), (3, 'c')")
    spark.sql("SELECT * FROM VALUES (1), (3) AS v(k)").createOrReplaceTempView("kept")
    assert [r.id for r in sql.execute(c, "DELETE FROM item WHERE kind <> 'z' AND id NOT IN (SELECT k FROM kept) RETURNING id").collect()] == [2]


def test_schemas_patches_and_indexes(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}")
    assert schema.declare(c, 'type Pub { name: String! @index(unique: true)\n books: [Vol] } type Vol { title: String, pub: Pub, hits: Int @crdt(type: pcounter) at: DateTime @default(value: "UTC_NOW") xs: [Int!] @size(n: 1) }', c.root) == ["Pub", "Vol"]
    doc = query(c, 'mutation { add_Pub(input: {name: "P"}) { _docID } }').first()[0]
    query(c, f'mutation {{ add_Vol(input: [{{title: "x", pub: "{doc}", hits: 2}}, {{title: "y"}}]) {{ title }} }}')
    assert respond(c, "{ Pub { name books { title } } }")["data"]["Pub"] == [{"name": "P", "books": [{"title": "x"}]}]
    assert query(c, "{ Vol(filter: {at: null}) { title } }").count() == 0
    said = respond(c, '{ __type(name: "Vol") { name fields { name filters type { kind name ofType { name } } } } a: __type(name: "?") { name } __schema { types { name } } }')["data"]
    fields = {f["name"]: f for f in said["__type"]["fields"]}
    assert fields["pub"]["type"]["name"] == "Pub" and fields["xs"]["type"]["ofType"] == {"name": "Int"} and "_like" in fields["title"]["filters"] and "_like" not in fields["hits"]["filters"] and said["a"] is None
    before = mutate.schema_version(c["Vol"].table.schema)
    after = schema.patch_collection(c, "Vol", [{"op": "add", "path": "/fields/year", "value": "Int"}, {"op": "move", "from": "/fields/title", "path": "/fields/name"}, {"op": "remove", "path": "/fields/xs"}], lambda df: df.withColumn("year", F.lit(1999)))
    assert before != after and [tuple(r) for r in query(c, "{ Vol(order: {name: ASC}) { name year } }").collect()] == [("x", 1999), ("y", 1999)]
    with pytest.raises(QueryError):
        schema.patch_collection(c, "Vol", [{"op": "remove", "path": "/fields/none"}])
    schema.create_index(c, "Vol", ["name"], kind="fulltext", language="en")
    assert {r.kind for r in schema.indexes(c).collect()} == {"unique", "fulltext"} and "@fulltext" in schema.sdl(c["Vol"])
    schema.drop_index(c, "Vol", "Vol_name")
    for bad in ("type A { x: What }", "type A { x Int }", "nothing", "type A { x: Int @odd }"):
        with pytest.raises(QueryError):
            schema.parse_sdl(bad)
    backup.export(c, f"{tmp_path}/b", ["Pub", "Vol"])
    d = Catalog(spark, f"file://{tmp_path}/again")
    schema.declare(d, "type Pub { name: String books: [Vol] } type Vol { name: String, pub: Pub, hits: Int, at: DateTime, year: Int }", d.root)
    backup.restore_all(d, f"{tmp_path}/b", ["Vol", "Pub"])
    assert respond(d, "{ Pub { name books { name } } }")["data"]["Pub"] == [{"name": "P", "books": [{"name": "x"}]}]


def test_rest(store):
    rest = Rest(store)
    assert rest.create("User", {"id": 3, "name": "c"}) == (201, {"docIDs": ["3"]}) and rest.create("User", {"id": 3})[0] == 400
    assert rest.list("User", limit=2) == (200, {"docIDs": ["1", "2"], "next": "2"}) and rest.list("User", 2, "2") == (200, {"docIDs": ["3"], "next": None})
    assert rest.get("User", "2")[1]["name"] == "b" and rest.get("User", "9")[0] == 404 and rest.update("User", {"age": 1})[0] == 400
    assert rest.update("User", {"age": 1}, cond={"age": 7}) == (200, {"docIDs": ["1", "3"]}) and rest.delete("User", "1") == (200, {"docIDs": ["1"]}) and rest.delete("User", "1")[0] == 404


@pytest.fixture(scope="module")
def shop(spark):
    c = Catalog(spark)
    c.add("Shop", spark.createDataFrame([(1, "n"), (2, "s"), (3, None)], "id long, area string"), "id", goods=Relation("Good", "id", "shop", True))
    c.add("Good", spark.createDataFrame([(10, 1, "red", 2, "red fox"), (11, 1, "red", 5, "fox fox den"), (12, 1, "blue", 1, "sea"), (13, 2, "red", 7, "a red sea"), (14, None, "red", 3, None)], "gid long, shop long, color string, price long, text string"), "gid", seller=Relation("Shop", "shop", "id"), marks=Relation("Mark", "gid", "good", True))
    c.add("Mark", spark.createDataFrame([(1, 10, 3), (2, 10, 4), (3, 13, 5)], "mid long, good long, stars long"), "mid", good_of=Relation("Good", "good", "gid"))
    return c


def test_groups_in_groups_and_of_children(shop):
    data = lambda text: respond(shop, text)["data"]
    got = data("{ Good(groupBy: [color], order: {color: ASC}) { color top: MAX(GROUP: {field: n}) GROUP(groupBy: [shop]) { shop n: COUNT(GROUP: {}) GROUP(order: [{color: ASC}, {price: DESC}]) { gid } } } }")["Good"]
    assert [(g["color"], g["top"]) for g in got] == [("blue", 1), ("red", 2)]
    assert {i["shop"]: (i["n"], [x["gid"] for x in i["GROUP"]]) for i in got[1]["GROUP"]} == {None: (1, [14]), 1: (2, [11, 10]), 2: (1, [13])}
    three = data("{ Good(groupBy: [color]) { color GROUP(groupBy: [shop], order: {shop: DESC}, limit: 1) { shop GROUP(groupBy: [price]) { price GROUP { gid } } } } }")["Good"]
    assert {g["color"]: g["GROUP"] for g in three}["blue"] == [{"shop": 1, "GROUP": [{"price": 1, "GROUP": [{"gid": 12}]}]}] and [x["shop"] for x in {g["color"]: g["GROUP"] for g in three}["red"]] == [2]
    kids = data("{ Shop(order: {id: ASC}) { id goods(groupBy: [color], order: {color: DESC}) { color s: SUM(GROUP: {field: price}) } } }")["Shop"]
    assert [s["goods"] for s in kids] == [[{"color": "red", "s": 7}, {"color": "blue", "s": 1}], [{"color": "red", "s": 7}], []]
    two = data('{ Shop(order: {id: ASC}) { t: SUM(goods: {field: m}) goods { m: SUM(marks: {field: stars}) } } }')["Shop"]
    assert [s["t"] for s in two] == [7, 5, 0]
    limited = data("{ Good(groupBy: [color], order: {color: ASC}) { color s: SUM(GROUP: {field: price, limit: 2}) a: AVG(GROUP: {field: price, offset: 1}) GROUP(docIDs: [\"10\", \"13\"]) { gid } } }")["Good"]
    assert limited == [{"color": "blue", "s": 1, "a": 0.0, "GROUP": []}, {"color": "red", "s": 7, "a": 5.0, "GROUP": [{"gid": 10}, {"gid": 13}]}] and isinstance(limited[1]["s"], int)
    assert data("{ Good(groupBy: [color], order: {color: ASC}) { GROUP(order: [{shop: DESC}, {price: ASC}], limit: 3) { gid } } }")["Good"][1]["GROUP"] == [{"gid": 13}, {"gid": 10}, {"gid": 11}]


def test_order_along_paths_and_what_exhaustive_adds(shop):
    ids = lambda text: [r[0] for r in query(shop, text).collect()]
    assert ids("{ Mark(order: [{good_of: {seller: {area: DESC}}}, {mid: DESC}]) { mid } }") == [3, 2, 1]
    by_area = "Good(order: [{seller: {area: ASC}}, {gid: ASC}]) { gid } }"
    assert ids("{ " + by_area) == [14, 10, 11, 12, 13]
    shop["Shop"].indexes.append(Index("a", ("area",)))
    try:
        assert ids("{ " + by_area) == [10, 11, 12, 13] and ids("query @exhaustive { " + by_area) == [14, 10, 11, 12, 13]
    finally:
        shop["Shop"].indexes.clear()


def test_directives_merging_and_docids(shop):
    data = lambda text, **v: respond(shop, text, v)["data"]
    assert data("query($x: Boolean) { Good(docIDs: [\"12\"]) { gid @skip(if: $x) color @include(if: $x) ... @skip(if: $x) { price } } }", x=True)["Good"] == [{"color": "blue"}]
    assert data("{ Shop(docID: \"2\") { goods { gid } goods { color } } }")["Shop"] == [{"goods": [{"gid": 13, "color": "red"}]}]
    got = respond(shop, '{ Good(docIDs: ["13", "10", "99", "10"]) { gid } }')
    assert [r["gid"] for r in got["data"]["Good"]] == [13, 10] and got["extensions"]["warnings"] == ["Good has no document 99"]
    with pytest.raises(QueryError):
        parse("{ a { x: b x: c } }")
    with pytest.raises(QueryError):
        parse("{ a @skip { b } }")
    assert len(parse("{a" * 30 + "}" * 30, max_depth=0)) == 1
    assert data("{ n: COUNT(Good: {}) s: SUM(Good: {field: price}) m: MIN(Mark: {field: stars}) }") == {"n": 5, "s": 18, "m": 3}
    one = query(shop, "{ n: COUNT(Good: {}) s: SUM(Good: {field: price}) }")
    assert one.first().asDict() == {"n": 5, "s": 18}


def test_pages_know_their_neighbours(shop):
    page = lambda args: [tuple(r) for r in query(shop, f"{{ Good({args}) {{ gid }} }}").collect()]
    first = page("first: 2, order: {price: ASC}")
    assert [(r[0], r[2], r[3]) for r in first] == [(12, True, False), (10, True, False)]
    then = page(f'first: 9, after: "{first[-1][1]}", order: {{price: ASC}}')
    assert [r[0] for r in then] == [14, 11, 13] and all(not r[2] and r[3] for r in then)
    back = page(f'last: 1, before: "{then[0][1]}", order: {{price: ASC}}')
    assert [(r[0], r[2], r[3]) for r in back] == [(10, True, True)]
    with pytest.raises(QueryError):
        page(f'first: 2, after: "{first[0][1]}", order: {{color: ASC}}')
    from tessera.plans.cursor import encode

    gone = encode("404", ["2"], ["price"])
    assert page(f'first: 2, after: "{gone}", order: {{price: ASC}}') == [] and [r[0] for r in page(f'last: 2, before: "{gone}", order: {{price: ASC}}')] == [11, 13]
    for bad in ("first: 0", "first: 1, last: 1", "first: 1, after: \"a\", before: \"b\"", "first: 1, order: {nothing: ASC}"):
        with pytest.raises(QueryError):
            page(bad)


def test_full_text_along_relations_and_within_a_parent(shop, spark):
    goods = {r.gid: r.s for r in query(shop, '{ Good { gid s: BM25(fields: ["text"], query: "fox") } }').collect()}
    shops = {r.id: r.s for r in query(shop, '{ Shop { id s: BM25(fields: ["goods.text"], query: "fox") } }').collect()}
    assert shops[1] == pytest.approx(goods[10] + goods[11]) and shops[2] == shops[3] == 0
    got = respond(shop, '{ Shop(order: {id: ASC}) { goods(order: {_alias: {s: DESC}}, limit: 1) { gid s: BM25(fields: ["text"], query: "red") } } }')["data"]["Shop"]
    assert [[g["gid"] for g in s["goods"]] for s in got] == [[10], [13], []]
    alone = search.bm25(shop["Good"].load().where("shop = 1"), ["text"], "red", "s").where("gid = 10").first().s
    assert got[0]["goods"][0]["s"] == pytest.approx(alone)
    assert search.wanted("the red Fox", "english") == ["red", "fox"] and "the" in search.stop_words("no language")


def test_postings_give_the_scores_of_a_scan(shop, tmp_path, spark):
    goods = shop["Good"].load()
    search.build_postings(goods, "gid", "text", f"{tmp_path}/p", parts=4)
    want = {r.gid: r.s for r in search.bm25(goods, ["text"], "red fox fox", "s").collect() if r.s > 0}
    assert {r.key: r.score for r in search.bm25_indexed(spark, f"{tmp_path}/p", "red fox fox").collect()} == pytest.approx(want)
    assert search.bm25_indexed(spark, f"{tmp_path}/p", "!").count() == 0


def test_postings_are_counted_in_place_and_shuffled_once(spark, tmp_path):
    rows = [("a", "Red red, fox"), ("b", ""), ("c", None), ("d", "fox " * 5 + "hen"), ("e", "\u00c9t\u00e9 \u00e9t\u00e9 7 7")]
    df = spark.createDataFrame(rows, "id string, text string")
    plan = search.postings(df, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan
    search.build_postings(df, "id", "text", f"{tmp_path}/p", parts=4)
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/p/postings").where("term <> ''").select("term", "key", "tf", "dl").collect()}
    assert got == {("red", "a", 2, 3), ("fox", "a", 1, 3), ("fox", "d", 5, 6), ("hen", "d", 1, 6), ("\u00e9t\u00e9", "e", 2, 4), ("7", "e", 2, 4)}
    assert tuple(spark.read.parquet(f"{tmp_path}/p/totals").first()) == (4, 13 / 4, None, 4)
    assert {r.key: r.score for r in search.bm25_indexed(spark, f"{tmp_path}/p", "fox").collect()}.keys() == {"a", "d"}


def test_inverted_lists_and_their_recall(spark, tmp_path):
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((20, 16)) * 3
    x = np.concatenate([centers[rng.integers(0, 20, 3000)] + rng.standard_normal((3000, 16)), np.zeros((1, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [1.0])], "id long, v array<double>")
    for metric in ("cosine", "euclidean"):
        ann.build(df, "id", "v", f"{tmp_path}/{metric}", cells=16, metric=metric, sample=1000)
        ann.build(df, "id", "v", f"{tmp_path}/{metric}-pq", cells=16, metric=metric, sample=1000, parts=4)
        found = quantized = total = 0
        for q in range(0, 3000, 600):
            want = [r.id for r in df.where("size(v) = 16").withColumn("s", search.similarity(F.col("v"), x[q].tolist(), metric)).orderBy(F.desc("s"), "id").limit(10).collect()]
            got = [r.key for r in ann.search(spark, f"{tmp_path}/{metric}", x[q].tolist(), 10, probes=6).collect()]
            again = [r.key for r in ann.search(spark, f"{tmp_path}/{metric}-pq", x[q].tolist(), 10, probes=6).collect()]
            found, quantized, total = found + len(set(got) & set(want)), quantized + len(set(again) & set(want)), total + len(want)
        assert found / total >= 0.9 and quantized / total >= 0.9
        assert [r.key for r in ann.search(spark, f"{tmp_path}/{metric}", x[0].tolist(), 10, probes=16).collect()] == [r.id for r in df.where("size(v) = 16").withColumn("s", search.similarity(F.col("v"), x[0].tolist(), metric)).orderBy(F.desc("s"), "id").limit(10).collect()]


def test_vector_searches_say_why_no_index_serves(shop, spark):
    c = Catalog(spark)
    c.add("V", spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "id long, v array<double>"), "id").indexes.append(Index("iv", ("v",), "vector", {"metric": "dot", "dimensions": 2}))
    best = respond(c, "{ V(order: {_alias: {s: DESC}}, limit: 1) { id s: SIMILARITY(v: {vector: [1, 1]}) } }")
    assert best["data"]["V"] == [{"id": 2, "s": 2.0}] and "extensions" not in best
    assert "no limit" in respond(c, "{ V(order: {_alias: {s: DESC}}) { s: SIMILARITY(v: {vector: [1, 1]}) } }")["extensions"]["warnings"][0]
    got = search.hybrid(spark.createDataFrame([(1, [1.0, 0.0], "b"), (2, [0.0, 1.0], "a"), (3, [0.9, 0.1], "a")], "id long, v array<double>, t string"), "id", ("v", [1.0, 0.0]), (["t"], "a"), 2).collect()
    assert [r.id for r in got] == [2, 3]


def test_encrypted_search_and_policies(spark):
    c = Catalog(spark)
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "id long, secret string")
    people = c.add("P", lambda: views.tagged(rows, "secret", "k"), "id")
    people.indexes.append(Index("e", ("secret",), "encrypted", {"key": "k"}))
    assert query(c, '{ encrypted_P(filter: {secret: {_eq: "x"}}) { docIDs } }').first().docIDs == ["1", "3"]
    for cond in ("{id: 1}", '{secret: {_gt: "x"}}'):
        with pytest.raises(QueryError):
            query(c, f"{{ encrypted_P(filter: {cond}) {{ docIDs }} }}")
    people.grants = lambda: spark.createDataFrame([("1", "ann"), ("2", "bob")], "_docID string, identity string")
    c.identity = "bob"
    assert query(c, "{ n: COUNT(P: {}) }").first().n == 2 and [r.id for r in query(c, "{ P(order: {id: ASC}, limit: 1) { id } }").collect()] == [2]
    import hashlib
    import hmac

    own = hmac.new(b"k", b"secret", hashlib.sha256).digest()
    assert rows.select(search.tag(F.col("secret"), "secret", "k")).first()[0] == hmac.new(own, b"x", hashlib.sha256).hexdigest()


def test_rollup_rules(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    df = spark.createDataFrame([("a", at(1), 1, "d1", 1), ("a", at(5), 2, "d2", 9), ("a", at(12), 3, "d3", 3), ("a", at(31), 4, "d1", 2)], "s string, ts timestamp, v long, doc string, h long")
    first = rollup.tumbling(df, "ts", "v", "10s", ["s"], source=("doc", "h"))
    assert [(r.source_doc_id, r.source_height) for r in first.orderBy("window_start").collect()] == [("d2", 9), ("d3", 3), ("d1", 2)]
    assert [r["sum"] for r in rollup.chained(first, "20s", ["s"], whole=True).orderBy("window_start").collect()] == [6, 4]
    assert [r["count"] for r in rollup.latest(first, ["s"]).collect()] == [1]
    assert sorted(r.v for r in rollup.retained(df, "ts", at(40), "15s", head=(["doc"], "h")).collect()) == [2, 3, 4]
    assert rollup.check_chains({"b": ("a", "2m"), "a": ("raw", "1m")}) == ["a", "b"]
    for bad in ({"a": ("b", 1), "b": ("a", 1)}, {"b": ("a", "90s"), "a": ("raw", "1m")}, {str(k): (str(k - 1), 1) for k in range(1, 12)}):
        with pytest.raises(ValueError):
            rollup.check_chains(bad)
    emitted = spark.createDataFrame([("a", at(20))], "s string, window_end timestamp")
    assert rollup.strictly(df.where("v = 4"), emitted, "ts", "10s", ["s"]).count() == 1
    with pytest.raises(Exception, match="out-of-order"):
        rollup.strictly(df, emitted, "ts", "10s", ["s"]).collect()

    def feed(rows):
        spark.createDataFrame(rows, df.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = strict_rollup(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "ts", "v", "10s", ["s"], f"{tmp_path}/out")
        q.awaitTermination(120)
        return q

    feed([("a", at(1), 1, "", 0), ("a", at(12), 2, "", 0)])
    feed([("a", at(15), 3, "", 0), ("a", at(22), 4, "", 0)])
    assert sorted(r["sum"] for r in spark.read.parquet(f"{tmp_path}/out/windows/0", f"{tmp_path}/out/windows/1").collect()) == [1, 5]
    with pytest.raises(Exception, match="out-of-order"):
        feed([("a", at(3), 9, "", 0)])


def test_subscriptions_lenses_and_schedules(store, spark, tmp_path):
    spark.createDataFrame([("1",), ("2",), ("77",)], "doc_id string").coalesce(1).write.parquet(f"{tmp_path}/log")
    seen = []
    stream = lambda: spark.readStream.schema("doc_id string").parquet(f"{tmp_path}/log")
    subscription(store, "subscription { User(filter: {age: {_gt: 5}}) { id } }", stream(), lambda out: seen.extend(r.id for r in out.collect()), f"{tmp_path}/ck").awaitTermination(120)
    subscription(store, 'subscription { User(docID: "2") { id } }', stream(), lambda out: seen.extend(r.id for r in out.collect()), f"{tmp_path}/ck2").awaitTermination(120)
    assert seen == [1, 2]
    with pytest.raises(QueryError):
        subscription(store, "subscription { User { id } User2: User { id } }", stream(), print, f"{tmp_path}/ck3")
    lens = [views.Lens(lambda df: df.withColumnRenamed("a", "b"), lambda df: df.withColumnRenamed("b", "a")), views.Lens(lambda df: df.withColumn("c", F.lit(1)))]
    df = spark.createDataFrame([(5,)], "a long")
    assert views.migrated(df, lens, 0, 2).columns == ["b", "c"] and views.migrated(views.migrated(df, lens, 0, 1), lens, 1, 0).columns == ["a"]
    with pytest.raises(ValueError):
        views.migrated(df, lens, 2, 0)
    twice = views.by_rows(lambda rows: ({"n": r["a"] * k} for r in rows for k in (1, 2)), "n long")
    assert sorted(r.n for r in twice(df).collect()) == [5, 10]
    runs = []
    s = views.Schedule(0.02)
    s.add(lambda: runs.append(1), 0.0)
    thread = s.start()
    thread.join(0.3)
    s.stop()
    assert runs and s.tick() == 1


def test_plans_read_and_move_no_more_than_they_need(spark, tmp_path):
    c = Catalog(spark)
    spark.range(1000).selectExpr("id", "id % 10 as p", "'x' as wide").write.parquet(f"{tmp_path}/kids")
    spark.range(10).selectExpr("id as pid", "'n' as name", "'y' as other").write.parquet(f"{tmp_path}/tops")
    c.add("Kid", lambda: spark.read.parquet(f"{tmp_path}/kids"), None, top=Relation("Top", "p", "pid"))
    c.add("Top", lambda: spark.read.parquet(f"{tmp_path}/tops"), "pid", kids=Relation("Kid", "pid", "p", True))
    plan = lambda text: query(c, text)._jdf.queryExecution().executedPlan().toString()
    assert "wide" not in plan("{ Top { pid kids { id } } }") and "sha2" not in plan("{ Top { pid kids { id } } }")
    one = plan("{ Kid { id top { name } } }")
    assert one.count("hashpartitioning") == 0 and "BroadcastHashJoin" in one and "other" not in one
    few = plan("{ Kid(limit: 10) { id } }")
    assert "Sort" not in few and "TakeOrdered" not in few and "Limit" in few
    assert "PushedFilters: [EqualNullSafe(p,3)]" in plan("{ Kid(filter: {p: 3}) { id } }")
    assert isinstance(Planner(c).catalog, Catalog)
