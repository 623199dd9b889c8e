import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import filters
from tessera.functions.filters import FilterError
from tessera.operators import history, rollup, search, views
from tessera.plans import cursor
from tessera.plans.catalog import Catalog, Relation
from tessera.plans.graphql import QueryError, parse
from tessera.plans.select import explain, query, respond
from tessera.sources import backup
from tessera.streaming.rollups import stream_rollup, subscribe


@pytest.fixture(scope="module")
def books(spark):
    c = Catalog(spark)
    authors = [(1, "Ann", 40, True, [1, None, 3], '{"a": {"b": 1}}'), (2, "Bob", None, False, [], '{"a": {"b": "x"}}'), (3, "c_d%", 30, None, None, "{}"), (4, None, 20, True, [None], None)]
    c.add("Author", spark.createDataFrame(authors, "id long, name string, age long, ok boolean, xs array<long>, meta string"), "id", books=Relation("Book", "id", "author", True))
    c.add("Book", spark.createDataFrame([(10, "x", 1, 4.0), (11, "y", 1, 2.5), (12, "z", 3, None), (13, "w", 99, 1.0), (14, "v", None, 5.0)], "bid long, title string, author long, rating double"), "bid", writer=Relation("Author", "author", "id"))
    return c


@pytest.mark.parametrize(
    ("cond", "want"),
    [
        ('{name: {_neq: "Ann"}}', [2, 3, 4]), ("{age: {_gt: null}}", [1, 3, 4]), ("{age: {_geq: null}}", [1, 2, 3, 4]), ("{age: {_leq: null}}", [2]), ("{age: {_lt: null}}", []),
        ("{age: {_in: [40, null]}}", [1, 2]), ("{age: {_nin: [40]}}", [2, 3, 4]), ('{name: {_like: "c_d%"}}', [3]), ('{name: {_like: "_nn"}}', []), ('{name: {_nlike: "A%"}}', [2, 3, 4]), ('{name: {_ilike: "a%"}}', [1]),
        ("{age: null}", [2]), ("{_or: []}", []), ("{_or: null}", [1, 2, 3, 4]), ("{_and: []}", [1, 2, 3, 4]), ("{_not: {age: {_gt: 25}}}", [2, 4]),
        ("{xs: {_any: {_gt: 2}}}", [1]), ("{xs: {_all: {_gt: 0}}}", [2]), ("{xs: {_none: {_gt: 2}}}", [2, 4]), ("{xs: {_contains: null}}", [1, 4]), ("{xs: {_contained_in: [1, 3, null]}}", [1, 2, 4]),
        ("{meta: {a: {b: {_eq: 1}}}}", [1]), ('{meta: {a: {b: {_eq: "x"}}}}', [2]), ("{meta: {a: {b: {_neq: 1}}}}", [2]), ("{meta: {a: {b: null}}}", [3, 4]), ('{meta: {_has_key: "a"}}', [1, 2]),
        ("{books: {}}", [1, 3]), ("{books: {rating: {_gt: 3}}}", [1]), ("{_not: {books: {}}}", [2, 4]), ("{_or: [{age: {_lt: 25}}, {books: {rating: null}}]}", [3, 4]),
    ],
)
def test_filters(books, cond, want):
    assert sorted(r.id for r in query(books, f"{{ Author(filter: {cond}) {{ id }} }}").collect()) == want


def test_filter_errors(books):
    for cond in ("{age: {_gt: \"x\"}}", "{age: {_leq: true}}", "{nothing: 1}", "{age: {_what: 1}}"):
        with pytest.raises(FilterError):
            query(books, f"{{ Author(filter: {cond}) {{ id }} }}").collect()


def test_limits_can_be_switched_off_and_indexes_know_only_text(books, monkeypatch):
    deep = "{_not: " * 61 + "{id: 1}" + "}" * 61
    with pytest.raises(FilterError):
        query(books, f"{{ Author(filter: {deep}) {{ id }} }}")
    monkeypatch.setattr(filters, "MAX_DEPTH", 0)
    assert query(books, f"{{ Author(filter: {deep}) {{ id }} }}").count() == 3
    rows = books["Author"].load()
    count = lambda f, c, cond: rows.where(f(F.col(c), cond, rows.schema[c].dataType)).count()
    assert count(filters.predicate, "age", {"_nlike": "x"}) == 4 and count(filters.index_predicate, "age", {"_nlike": "x"}) == 0
    assert count(filters.predicate, "name", {"_nlike": "A%"}) == 3 and count(filters.index_predicate, "name", {"_nlike": "A%"}) == 2


def test_operands_of_another_kind(books):
    ids = lambda cond: sorted(r.id for r in query(books, f"{{ Author(filter: {cond}) {{ id }} }}").collect())
    assert ids("{name: {_gt: 3}}") == [] and ids("{name: {_eq: 3}}") == [] and ids("{ok: {_leq: 1}}") == [] and ids("{name: {_neq: 3}}") == [1, 2, 3, 4]
    assert ids('{age: {_eq: "40"}}') == [] and ids('{age: {_in: ["40", 30]}}') == [3]
    assert ids('{meta: {_eq: {a: {b: 1}}}}') == [1] and ids("{meta: {a: {_eq: {b: 1}}}}") == [1] and ids("{meta: {a: {_neq: {b: 1}}}}") == [2] and ids("{meta: {_eq: {}}}") == [3]
    assert ids("{xs: {_eq: [1, null, 3]}}") == [1] and ids("{xs: {_eq: []}}") == [2] and ids("{age: {_eq: {a: 1}}}") == []


def test_nested_children_and_aggregates(books):
    got = respond(books, '{ Author(order: {id: ASC}) { id n: COUNT(books: {}) s: SUM(books: {field: rating}) a: AVG(books: {field: rating}) m: MIN(books: {field: rating}) t: SUM(xs: {}) c: COUNT(xs: {}) books(order: {rating: DESC}, limit: 1) { title writer { name } } } }')["data"]["Author"]
    assert [(r["n"], r["s"], r["a"], r["m"], r["t"], r["c"]) for r in got] == [(2, 6.5, 3.25, 2.5, 4, 3), (0, 0, 0.0, None, 0, 0), (1, 0, 0.0, None, 0, 0), (0, 0, 0.0, None, 0, 1)]
    assert got[0]["books"] == [{"title": "x", "writer": {"name": "Ann"}}] and got[1]["books"] == [] and got[2]["books"][0]["title"] == "z"
    assert respond(books, "{ Book(filter: {bid: {_geq: 13}}, order: {bid: ASC}) { writer { id } _writerID } }")["data"]["Book"] == [{"writer": None, "_writerID": None}] * 2


def test_groups_and_top_level(books):
    rows = query(books, "{ Author(groupBy: [ok], order: {ok: ASC}) { ok n: COUNT(GROUP: {}) s: SUM(GROUP: {field: age, filter: {age: {_gt: 25}}}) GROUP(order: {age: DESC}, limit: 1) { id } } }").collect()
    assert [(r.ok, r.n, r.s, [x.id for x in r.GROUP]) for r in rows] == [(None, 1, 30, [3]), (False, 1, 0, [2]), (True, 2, 40, [1])]
    assert respond(books, '{ n: COUNT(Author: {filter: {name: "?"}}) s: SUM(Author: {field: age, filter: {name: "?"}}) m: MAX(Author: {field: age, filter: {name: "?"}}) }')["data"] == {"n": 0, "s": 0, "m": None}
    assert "errors" in respond(books, "{ Author(groupBy: [ok]) { name } }") and "errors" in respond(books, "{ Nobody { id } }")


def test_order_limits_and_cursors(books):
    ids = lambda args: [r.id for r in query(books, f"{{ Author({args}) {{ id }} }}").collect()]
    assert ids("order: {age: ASC}") == [2, 4, 3, 1] and ids("order: {age: DESC}") == [1, 3, 4, 2] and ids("order: {id: ASC}, limit: 2, offset: 1") == [2, 3] and len(ids("limit: 0")) == 4
    seen, token = [], None
    while rows := query(books, "{ Author(first: 1, order: {age: ASC}" + (f', after: "{token}"' if token else "") + ") { id } }").collect():
        seen.append(rows[0].id)
        token = rows[0]._cursor
    assert seen == [2, 4, 3, 1] and cursor.decode(token) == {"d": "1", "k": ["40"], "o": ["age"]}
    assert ids(f'last: 2, before: "{token}", order: {{age: ASC}}') == [4, 3]
    with pytest.raises(QueryError):
        query(books, "{ Author(first: 1, limit: 2) { id } }")


def test_parser():
    op = parse("query Q($n: Int = 3, $f: X!) { a: User(limit: $n, filter: $f) { ...F b: name ... on User { age } } } fragment F on User { id id }", {"f": {"x": 1}})[0]
    assert op.roots[0].args == {"limit": 3, "filter": {"x": 1}} and [k.alias for k in op.roots[0].kids] == ["id", "b", "age"]
    for bad in ("{ a ", "query($x: Int!) { a(b: $x) }", "{ ...F } fragment F on X { ...F }", "{ a(b: ~) }", "{a" * 30 + "}" * 30):
        with pytest.raises(QueryError):
            parse(bad)


def test_explain_and_pushdown(books):
    assert "Filter" in explain(books, "{ Author(filter: {id: 1}) { id } }")["plan"]


def test_search(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0], "red fox red"), (2, [1.0, 0.0], "blue fox"), (3, None, None), (4, [3.0, 4.0], "none")], "id long, v array<double>, t string")
    score = lambda m: [r[0] for r in df.orderBy("id").select(search.similarity(F.col("v"), [1, 0], m)).collect()]
    assert score("cosine") == [0.0, 1.0, None, pytest.approx(0.6)] and score("dot") == [0, 1, None, 3] and score("euclidean") == [-1, 0, None, -20]
    got = {r.id: r.s for r in search.bm25(df, ["t"], "red Fox", "s").collect()}
    assert got[1] > got[2] > 0 and got[3] == got[4] == 0 and got[1] == pytest.approx(sum(math.log((3 - n + 0.5) / (n + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * 3 / 2)) for n, tf in ((1, 2), (2, 1))))


LOG = "doc_id string, field string, priority long, value string, delta long, deleted boolean, cid string, parents array<string>"


def test_history(spark, tmp_path):
    log = spark.createDataFrame(
        [("d", "name", 1, "a", None, None, "c1", []), ("d", "name", 2, "b", None, None, "c2", ["c1"]), ("d", "name", 2, "c", None, None, "c3", ["c1"]), ("d", "hits", 1, None, 5, None, "c4", []), ("d", "hits", 2, None, (1 << 63) - 1, None, "c5", ["c4"]), ("d", "_C", 1, None, None, False, "c6", []), ("e", "name", 1, "", None, None, "c7", []), ("e", "_C", 2, None, None, True, "c8", [])],
        LOG,
    )
    rows = {r.doc_id: r for r in history.documents(log, ["name", "hits"], ["hits"]).collect()}
    assert rows["d"].name == "c" and rows["d"].hits == 5 + (1 << 63) - 1 - (1 << 64) and not rows["d"]._deleted and rows["e"].name is None and rows["e"]._deleted
    assert [r.value for r in history.last_writes(history.as_of(log, ["c2"], str(tmp_path))).collect()] == ["b"]
    shuffled = log.orderBy(F.rand(1)).union(log)
    assert history.last_writes(shuffled).exceptAll(history.last_writes(log)).isEmpty()


def test_mutations(spark):
    df = spark.createDataFrame([(1, 5, False), (2, 6, True)], "k long, n long, _deleted boolean")
    assert sorted((r.k, r.n) for r in history.updated(df, F.col("n") > 0, {"n": 2}, ("n",)).collect()) == [(1, 7), (2, 6)]
    new = spark.createDataFrame([(1, 0)], "k long, n long")
    with pytest.raises(ValueError):
        history.created(df, new, "k")
    assert history.upserted(df, F.col("k") == 2, spark.createDataFrame([(3, 0)], "k long, n long"), {}, "k").count() == 3
    with pytest.raises(ValueError):
        history.unique(df.withColumn("n", F.lit(1)).withColumn("_deleted", F.lit(False)), ["n"])


def test_rollups_batch_and_stream(spark, tmp_path):
    at = lambda s: dt.datetime(1969, 12, 31, 23, 59, 50) + dt.timedelta(seconds=s)
    df = spark.createDataFrame([("a", at(0), 1), ("a", at(9), None), ("a", at(10), 3), ("a", at(25), 4), ("a", None, 9)], "s string, ts timestamp, v long")
    got = [tuple(r) for r in rollup.tumbling(df, "ts", "v", "10s", ["s"]).orderBy("window_start").select("count", "sum", "avg").collect()]
    assert got == [(2, 1, 1.0), (1, 3, 3.0), (1, 4, 4.0)]
    assert [tuple(r) for r in rollup.chained(rollup.tumbling(df, "ts", "v", "10s"), "20s").orderBy("window_start").select("count", "sum", "avg").collect()] == [(2, 1, 0.5), (2, 7, 3.5)]
    assert rollup.seconds("1h30m") == 5400 and rollup.seconds(5) == 5
    later = df.where("ts is not null").withColumn("ts", F.expr("ts + interval 1 day"))  # a stream's first watermark is the epoch
    later.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = stream_rollup(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "ts", "v", "10s", ["s"])
    q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r[0] for r in spark.read.parquet(f"{tmp_path}/out").orderBy("window_start").select("sum").collect()] == [1, 3]
    seen = []
    subscribe(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "s", lambda keys: keys, lambda out: seen.extend(r.s for r in out.collect()), f"{tmp_path}/ck2").awaitTermination(120)
    assert seen == ["a"]


def test_views_policies_and_backups(spark, books, tmp_path):
    refresh = views.materialized(books, "Old", "{ Author(filter: {age: {_gt: 25}}) { id } }", f"{tmp_path}/old")
    refresh()
    assert query(books, "{ n: COUNT(Old: {}) }").first().n == 2
    frame, grants = books["Author"].frame(), spark.createDataFrame([("1", "x"), ("2", "y")], "_docID string, identity string")
    assert sorted(r.id for r in views.readable(frame, grants, "x").collect()) == [1, 3, 4]
    assert views.encrypted_search(views.tagged(frame, "name", "k"), "name", "Ann", "k").first().docIDs == ["1"]
    backup.export(books, f"{tmp_path}/b", ["Book"])
    back = backup.restore(spark, f"{tmp_path}/b", books["Book"].load().schema, "Book")
    assert sorted(map(repr, back.collect())) == sorted(map(repr, books["Book"].load().collect()))
