"""The engine's queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .operators import ann, history, rollup, search, views
from .plans import mutate, sql
from .plans.catalog import Index, Relation, shared, tables
from .plans.cursor import MARKS
from .plans.select import query

Query = Callable[[SparkSession, str], DataFrame]
#: A vector that stands for a search's, made by a rule.
VECTOR = [((7 * i) % 11 - 5) / 5 for i in range(64)]

#: Name: (query text, SQL).
TEXTS: dict[str, tuple[str, str]] = {}
#: Columns of a text's result that are compared, where it has lists beside them.
SHOWN: dict[str, tuple[str, ...]] = {}


def _filters() -> None:
    orders = "o_orderkey, o_orderstatus, o_totalprice"
    shown = "o_orderkey o_orderstatus o_totalprice"

    def put(name: str, cond: str, where: str) -> None:
        TEXTS[f"filter_{name}"] = (f"{{ Orders(filter: {cond}) {{ {shown} }} }}", f"SELECT {orders} FROM orders WHERE {where}")

    put("eq", '{o_orderstatus: {_eq: "F"}}', "o_orderstatus = 'F'")
    put("scalar", '{o_orderstatus: "O"}', "o_orderstatus = 'O'")
    put("neq", '{o_orderstatus: {_neq: "F"}}', "o_orderstatus IS DISTINCT FROM 'F'")
    put("gt", "{o_totalprice: {_gt: 100000}}", "o_totalprice > 100000")
    put("geq", "{o_orderkey: {_geq: 500}}", "o_orderkey >= 500")
    put("lt", "{o_totalprice: {_lt: 50000.5}}", "o_totalprice < 50000.5")
    put("leq", "{o_orderkey: {_leq: 500}}", "o_orderkey <= 500")
    put("gt_null", "{o_totalprice: {_gt: null}}", "o_totalprice IS NOT NULL")
    put("lt_null", "{_or: [{o_totalprice: {_lt: null}}, {o_orderkey: {_lt: 50}}]}", "o_orderkey < 50")
    put("in", '{o_orderpriority: {_in: ["1-URGENT", "2-HIGH", null]}}', "o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_orderpriority IS NULL")
    put("nin", '{o_orderpriority: {_nin: ["1-URGENT", "2-HIGH"]}}', "coalesce(o_orderpriority NOT IN ('1-URGENT', '2-HIGH'), true)")
    put("like", '{o_orderpriority: {_like: "%E%"}}', "o_orderpriority LIKE '%E%'")
    put("type_mismatch", "{_or: [{o_orderstatus: {_gt: 3}}, {o_orderstatus: {_eq: 3}}, {o_orderkey: {_lt: 100}}]}", "o_orderkey < 100")
    put("deep", '{_and: [{_or: [{o_orderstatus: "F"}, {_not: {o_totalprice: {_leq: 90000}}}]}, {o_orderpriority: {_in: ["1-URGENT", "5-LOW"]}}]}', "(o_orderstatus = 'F' OR o_totalprice > 90000) AND o_orderpriority IN ('1-URGENT', '5-LOW')")
    put("nlike", '{o_orderpriority: {_nlike: "%E%"}}', "coalesce(o_orderpriority NOT LIKE '%E%', true)")
    put("ilike", '{o_orderpriority: {_ilike: "%urgent"}}', "lower(o_orderpriority) LIKE '%urgent'")
    put("nilike", '{o_orderpriority: {_nilike: "%urgent"}}', "coalesce(lower(o_orderpriority) NOT LIKE '%urgent', true)")
    put("and", '{_and: [{o_orderstatus: {_eq: "F"}}, {o_totalprice: {_gt: 90000}}]}', "o_orderstatus = 'F' AND o_totalprice > 90000")
    put("or", '{_or: [{o_orderstatus: {_eq: "F"}}, {o_totalprice: {_gt: 150000}}]}', "o_orderstatus = 'F' OR o_totalprice > 150000")
    put("or_empty", "{_or: [{_or: []}, {o_orderkey: {_gt: 500}}]}", "o_orderkey > 500")
    put("not", '{_not: {o_orderstatus: {_eq: "F"}}}', "NOT coalesce(o_orderstatus = 'F', false)")
    put("between", "{o_totalprice: {_geq: 10000, _leq: 90000}}", "o_totalprice BETWEEN 10000 AND 90000")
    put("datetime", '{o_orderdate: {_gt: "1996-01-01T00:00:00"}}', "o_orderdate > TIMESTAMP '1996-01-01'")
    event = "SELECT event_id FROM events WHERE "
    TEXTS["filter_json_path"] = ("{ Event(filter: {props: {k: {_gt: 50}}}) { event_id } }", event + "CAST(json_extract(props, '$.k') AS DOUBLE) > 50")
    TEXTS["filter_json_missing"] = ("{ Event(filter: {props: {absent: {_eq: null}}}) { event_id } }", event + "json_extract(props, '$.absent') IS NULL")
    TEXTS["filter_has_key"] = ('{ Event(filter: {props: {_has_key: "k"}}) { event_id } }', event + "list_contains(json_keys(props), 'k')")
    vec = "SELECT vec_id FROM embeddings WHERE "
    TEXTS["filter_any"] = ("{ Embedding(filter: {embedding: {_any: {_gt: 0.3}}}) { vec_id } }", vec + "len(list_filter(embedding, lambda x: x > 0.3)) > 0")
    TEXTS["filter_all"] = ("{ Embedding(filter: {embedding: {_all: {_lt: 0.3}}}) { vec_id } }", vec + "len(list_filter(embedding, lambda x: NOT x < 0.3)) = 0")
    TEXTS["filter_none"] = ("{ Embedding(filter: {embedding: {_none: {_gt: 0.4}}}) { vec_id } }", vec + "len(list_filter(embedding, lambda x: x > 0.4)) = 0")
    TEXTS["doc_ids"] = ('{ Orders(docIDs: ["1", "7", "7", "999999999"]) { _docID o_totalprice } }', "SELECT CAST(o_orderkey AS VARCHAR) AS \"_docID\", o_totalprice FROM orders WHERE o_orderkey IN (1, 7, 999999999)")


def _relations() -> None:
    TEXTS["rel_filter_one"] = ('{ Orders(filter: {customer: {c_mktsegment: {_eq: "BUILDING"}}}) { o_orderkey } }', "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
    TEXTS["rel_filter_many"] = ("{ Orders(filter: {lineitems: {l_quantity: {_gt: 45}}}) { o_orderkey } }", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
    TEXTS["rel_filter_multi"] = ('{ Lineitem(filter: {order: {customer: {nation: {n_name: {_like: "%1"}}}}}) { l_orderkey l_partkey l_suppkey l_linenumber } }', "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name LIKE '%1'")
    TEXTS["rel_filter_anti"] = ("{ Orders(filter: {_not: {lineitems: {}}}) { o_orderkey } }", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
    TEXTS["rel_filter_or_mixed"] = ("{ Orders(filter: {_or: [{o_totalprice: {_gt: 150000}}, {lineitems: {l_discount: {_gt: 0.09}}}]}) { o_orderkey } }", "SELECT o_orderkey FROM orders WHERE o_totalprice > 150000 OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.09)")
    TEXTS["rel_order"] = ("{ Orders(order: [{customer: {c_acctbal: DESC}}, {o_orderkey: ASC}], limit: 20) { o_orderkey } }", "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY c_acctbal DESC NULLS LAST, o_orderkey LIMIT 20")
    TEXTS["join_secondary_id"] = ("{ Label { doc_id _documentID } }", "SELECT doc_id, CAST(doc_id AS VARCHAR) AS \"_documentID\" FROM labels")
    TEXTS["agg_relation_count"] = ("{ Orders { o_orderkey n: COUNT(lineitems: {}) } }", "SELECT o_orderkey, CAST(count(l_orderkey) AS BIGINT) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
    TEXTS["agg_relation_sum_filtered"] = ("{ Customer { c_custkey total: SUM(orders: {field: o_orderkey, filter: {o_orderstatus: {_eq: \"F\"}}}) } }", "SELECT c_custkey, CAST(coalesce(sum(o_orderkey) FILTER (WHERE o_orderstatus = 'F'), 0) AS BIGINT) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
    TEXTS["agg_relation_limited"] = ("{ Customer { c_custkey top: SUM(orders: {field: o_orderkey, order: {o_orderkey: DESC}, limit: 2}) } }", "SELECT c_custkey, CAST(coalesce(sum(o_orderkey) FILTER (WHERE r <= 2), 0) AS BIGINT) AS top FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) ON o_custkey = c_custkey GROUP BY 1")
    TEXTS["agg_multi_target"] = ("{ Nation { n_nationkey n: COUNT(customers: {}, suppliers: {}) } }", "SELECT n_nationkey, CAST((SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS BIGINT) AS n FROM nation")


def _more() -> None:
    TEXTS["rel_order_two_hops"] = ("{ Orders(order: [{customer: {nation: {n_name: DESC}}}, {o_totalprice: ASC}, {o_orderkey: ASC}], limit: 25) { o_orderkey } }", "SELECT o_orderkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey ORDER BY n_name DESC NULLS LAST, o_totalprice, o_orderkey LIMIT 25")
    TEXTS["agg_several"] = ("{ n: COUNT(Orders: {}) s: SUM(Orders: {field: o_orderkey}) a: AVG(Part: {field: p_size}) m: MAX(Part: {field: p_size}) }", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s, (SELECT avg(p_size) FROM part) AS a, (SELECT max(p_size) FROM part) AS m FROM orders")
    TEXTS["agg_avg"] = ("{ v: AVG(Lineitem: {field: l_linenumber}) }", "SELECT avg(l_linenumber) AS v FROM lineitem")
    SHOWN["agg_of_agg"], SHOWN["group_of_groups_agg"] = ("n_nationkey", "most"), ("o_orderstatus", "top")
    TEXTS["agg_of_agg"] = ("{ Nation { n_nationkey most: SUM(customers: {field: n}) customers { n: COUNT(orders: {}) } } }", "SELECT n_nationkey, CAST(count(o_orderkey) AS BIGINT) AS most FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
    TEXTS["group_limited_sum"] = ("{ Orders(groupBy: [o_custkey]) { o_custkey s: SUM(GROUP: {field: o_orderkey, limit: 3}) } }", "SELECT o_custkey, CAST(sum(o_orderkey) AS BIGINT) AS s FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderkey AS VARCHAR)) AS r FROM orders) WHERE r <= 3 GROUP BY 1")
    TEXTS["group_of_groups_agg"] = ("{ Orders(groupBy: [o_orderstatus]) { o_orderstatus top: MAX(GROUP: {field: n}) GROUP(groupBy: [o_orderpriority]) { o_orderpriority n: COUNT(GROUP: {}) } } }", "SELECT o_orderstatus, CAST(max(n) AS BIGINT) AS top FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
    TEXTS["agg_fields"] = ("{ Part { p_partkey s: SUM(p_size: {}, p_partkey: {}) a: AVG(p_size: {}, p_retailprice: {}) m: MAX(p_size: {}, p_retailprice: {}) } }", "SELECT p_partkey, CAST(p_size + p_partkey AS BIGINT) AS s, (p_size + p_retailprice) / 2 AS a, greatest(CAST(p_size AS DOUBLE), p_retailprice) AS m FROM part")
    TEXTS["agg_array_filtered"] = ("{ Embedding { vec_id n: COUNT(embedding: {filter: {_gt: 0.1}}) } }", "SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > 0.1)) AS BIGINT) AS n FROM embeddings")
    TEXTS["limit_after_aggregate"] = ("{ Orders(order: [{_alias: {n: DESC}}, {o_orderkey: ASC}], limit: 12) { o_orderkey n: COUNT(lineitems: {filter: {l_quantity: {_gt: 10}}}) } }", "SELECT o_orderkey, CAST(count(l_orderkey) AS BIGINT) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 10 GROUP BY 1 ORDER BY n DESC, o_orderkey LIMIT 12")
    TEXTS["directives"] = ("query($x: Boolean = true) { Region { r_regionkey r_name @skip(if: $x) ... @include(if: $x) { name: r_name } } }", "SELECT r_regionkey, r_name AS name FROM region")


def _grouping() -> None:
    for name, call, sql in (
        ("count", "COUNT(Orders: {})", "CAST(count(*) AS BIGINT) AS v FROM orders"),
        ("sum", "SUM(Orders: {field: o_orderkey})", "CAST(coalesce(sum(o_orderkey), 0) AS BIGINT) AS v FROM orders"),
        ("min", "MIN(Orders: {field: o_totalprice})", "min(o_totalprice) AS v FROM orders"),
        ("max", "MAX(Orders: {field: o_totalprice})", "max(o_totalprice) AS v FROM orders"),
        ("empty_sum", 'SUM(Orders: {field: o_orderkey, filter: {o_orderstatus: "?"}})', "CAST(0 AS BIGINT) AS v"),
        ("filtered", 'COUNT(Orders: {filter: {customer: {c_mktsegment: "BUILDING"}}})', "CAST(count(*) AS BIGINT) AS v FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"),
        ("count_groups", "COUNT(Orders: {groupBy: [o_orderstatus, o_orderpriority]})", "CAST(count(*) AS BIGINT) AS v FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders)"),
    ):
        TEXTS[f"agg_{name}"] = (f"{{ v: {call} }}", "SELECT " + sql)
    TEXTS["group_basic"] = ("{ Orders(groupBy: [o_orderstatus]) { o_orderstatus n: COUNT(GROUP: {}) top: MAX(GROUP: {field: o_totalprice}) } }", "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1")
    TEXTS["group_multi"] = ("{ Lineitem(groupBy: [l_returnflag, l_linestatus]) { l_returnflag l_linestatus n: COUNT(GROUP: {}) keys: SUM(GROUP: {field: l_orderkey}) } }", "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem GROUP BY 1, 2")
    TEXTS["group_rel_fk"] = ("{ Customer(groupBy: [nation]) { _nationID n: COUNT(GROUP: {}) } }", "SELECT c_nationkey AS \"_nationID\", CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1")
    TEXTS["group_having_alias"] = ("{ Orders(groupBy: [o_custkey], filter: {_alias: {n: {_gt: 12}}}) { o_custkey n: COUNT(GROUP: {}) } }", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
    TEXTS["group_filtered_agg"] = ("{ Orders(groupBy: [o_orderpriority]) { o_orderpriority n: COUNT(GROUP: {filter: {o_totalprice: {_gt: 100000}}}) } }", "SELECT o_orderpriority, CAST(count(*) FILTER (WHERE o_totalprice > 100000) AS BIGINT) AS n FROM orders GROUP BY 1")
    TEXTS["group_topk"] = ("{ Orders(groupBy: [o_custkey], order: [{_alias: {n: DESC}}, {o_custkey: ASC}], limit: 10) { o_custkey n: COUNT(GROUP: {}) } }", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10")
    TEXTS["order_multi"] = ("{ Orders(order: [{o_orderstatus: ASC}, {o_totalprice: DESC}, {o_orderkey: ASC}], limit: 50) { o_orderkey o_orderstatus } }", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus NULLS FIRST, o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50")
    TEXTS["limit_offset"] = ("{ Orders(order: {o_orderkey: ASC}, limit: 7, offset: 13) { o_orderkey } }", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 13")
    TEXTS["scan_all"] = ("{ Orders { o_orderkey o_custkey o_totalprice } }", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
    TEXTS["limit_zero"] = ("{ Region(limit: 0) { r_name } }", "SELECT r_name FROM region")
    TEXTS["flagship_orders"] = ('{ Orders(filter: {o_totalprice: {_gt: 1000}, o_orderstatus: {_eq: "F"}}, order: [{o_totalprice: DESC}, {o_orderkey: ASC}], limit: 20) { o_orderkey o_totalprice } }', "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
    TEXTS["cursor_first"] = ("{ Orders(first: 5, order: {o_orderkey: ASC}) { o_orderkey } }", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5")


_filters()
_relations()
_more()
_grouping()

#: Plain SQL is the same on both sides.
SQL = {
    "sql_inner_join": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000",
    "sql_left_join": "SELECT o_orderkey, l_partkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 40",
    "sql_join_group": "SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "sql_group_having": "SELECT l_suppkey, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 100",
    "sql_count_distinct": "SELECT o_orderstatus, CAST(count(DISTINCT o_custkey) AS BIGINT) AS n FROM orders GROUP BY o_orderstatus",
    "sql_distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "sql_union": "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region",
    "sql_union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "sql_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "sql_except": "SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem",
    "sql_in_subquery": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)",
    "sql_not_in_subquery": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "sql_between": "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 10 AND p_brand IS NOT NULL",
    "sql_order_limit": "SELECT o_orderkey, -o_totalprice AS negative FROM orders WHERE o_orderpriority LIKE '%H' OR o_orderstatus IN ('P') ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 5",
    "sql_having_or": "SELECT l_suppkey, CAST(count(*) AS BIGINT) AS n, max(l_quantity) AS most FROM lineitem GROUP BY l_suppkey HAVING count(*) > 620 OR max(l_quantity) < 50 AND NOT count(*) = 600",
    "sql_synthetic": "SELECT 1 AS one, CAST('2' AS INT) AS two",
}


def _text(text: str, shown: tuple[str, ...] = ()) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(tables(spark, sf_dir), text).drop(*MARKS)
        return df.select(*shown) if shown else df

    return run


def _sql(text: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
        return sql.run(spark, text)

    return run


def join_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = query(tables(spark, sf_dir), "{ Orders { o_orderkey customer { c_name nation { n_name } } } }")
    return df.select("o_orderkey", F.col("customer.c_name").alias("c_name"), F.col("customer.nation.n_name").alias("n_name"))


def join_to_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = query(tables(spark, sf_dir), "{ Orders { o_orderkey lineitems(filter: {l_quantity: {_gt: 25}}) { l_partkey } } }")
    return df.select("o_orderkey", F.size("lineitems").cast("long").alias("n"), F.array_join(F.array_sort(F.transform("lineitems", lambda x: x.l_partkey)), ",").alias("parts"))


def child_topk_per_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = query(tables(spark, sf_dir), "{ Customer { c_custkey orders(order: [{o_totalprice: DESC}, {o_orderkey: ASC}], limit: 3) { o_orderkey } } }")
    return df.select("c_custkey", F.array_join(F.transform("orders", lambda x: x.o_orderkey), ",").alias("top"))


def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = query(tables(spark, sf_dir), "{ Nation(groupBy: [region]) { _regionID GROUP(order: {n_nationkey: DESC}, limit: 2) { n_nationkey } } }")
    return df.select("_regionID", F.array_join(F.transform("GROUP", lambda x: x.n_nationkey), ",").alias("members"))


def _listed(column: str, of) -> F.Column:
    """An array as text, its elements in ascending order."""
    return F.array_join(F.array_sort(F.transform(column, of)), ",")


def join_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A to-one relation whose key the child has: of several children the first by key."""
    c = tables(spark, sf_dir)
    c["Customer"].relations["first_order"] = Relation("Orders", "c_custkey", "o_custkey")
    df = query(c, "{ Customer { c_custkey first_order { o_orderkey } } }")
    return df.select("c_custkey", F.col("first_order.o_orderkey").alias("o_orderkey"))


def group_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = query(tables(spark, sf_dir), "{ Orders(groupBy: [o_custkey]) { o_custkey GROUP(order: [{o_orderstatus: DESC}, {o_totalprice: ASC}], limit: 4) { o_orderkey } } }")
    return df.select("o_custkey", F.array_join(F.transform("GROUP", lambda x: x.o_orderkey), ",").alias("members"))


def group_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = query(tables(spark, sf_dir), "{ Orders(groupBy: [o_orderstatus]) { o_orderstatus GROUP(groupBy: [o_orderpriority]) { o_orderpriority n: COUNT(GROUP: {}) GROUP(groupBy: [o_custkey]) { o_custkey } } } }")
    return df.select("o_orderstatus", _listed("GROUP", lambda g: F.concat_ws(":", g.o_orderpriority, g.n.cast("string"), F.size(g.GROUP).cast("string"))).alias("parts"))


def group_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = query(tables(spark, sf_dir), "{ Customer { c_custkey orders(groupBy: [o_orderstatus]) { o_orderstatus n: COUNT(GROUP: {}) } } }")
    return df.select("c_custkey", _listed("orders", lambda g: F.concat_ws(":", g.o_orderstatus, g.n.cast("string"))).alias("parts"))


def cursor_page_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of two, by the first one's last token."""
    c = tables(spark, sf_dir)
    first = query(c, "{ Orders(first: 7, order: [{o_totalprice: DESC}]) { o_orderkey } }").collect()
    df = query(c, f'{{ Orders(first: 5, after: "{first[-1]._cursor}", order: [{{o_totalprice: DESC}}]) {{ o_orderkey }} }}')
    return df.select("o_orderkey", F.col("_hasNext").alias("has_next"), F.col("_hasPrevious").alias("has_previous"))


def cursor_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = query(tables(spark, sf_dir), "{ Orders(last: 6, order: [{o_totalprice: DESC}]) { o_orderkey } }")
    return df.select("o_orderkey", F.col("_hasNext").alias("has_next"), F.col("_hasPrevious").alias("has_previous"))


def _sparse(spark: SparkSession, sf_dir: str):
    c = tables(spark, sf_dir)
    c.add("Sparse", lambda: c["Orders"].load().withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'F')")), "o_orderkey")
    c.add("Place", lambda: c["Nation"].load().withColumn("n_name", F.expr("if(n_nationkey % 2 = 0, n_name, translate(n_name, '_', '-'))")), "n_nationkey")
    return c


def _of_sparse(text: str) -> Query:
    return lambda spark, sf_dir: query(_sparse(spark, sf_dir), text)


def order_exhaustive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by a field of their documents that has an index: those without such a document count only if the query is exhaustive."""
    c = tables(spark, sf_dir)
    c.add("Long", lambda: c["Document"].load().where("n_chars > 2000"), "doc_id").indexes.append(Index("n", ("n_chars",)))
    c["Label"].relations["long"] = Relation("Long", "doc_id", "doc_id")
    walked = query(c, "{ Label(order: {long: {n_chars: ASC}}) { doc_id } }").withColumn("exhaustive", F.lit(False))
    return walked.union(query(c, "query @exhaustive { Label(order: {long: {n_chars: ASC}}) { doc_id } }").withColumn("exhaustive", F.lit(True)))


def fts_relation_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = query(_talks(spark, sf_dir), '{ Talk { conv_id score: BM25(fields: ["turns.text"], query: "the of") } }')
    return df.select("conv_id", F.round("score", 5).alias("score"))


def fts_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = query(_talks(spark, sf_dir), '{ Talk { conv_id turns(order: {_alias: {s: DESC}}, limit: 1) { s: BM25(fields: ["text"], query: "the of") } } }')
    return df.select("conv_id", F.round(F.element_at("turns", 1).s, 5).alias("best"))


def _talks(spark: SparkSession, sf_dir: str):
    c = tables(spark, sf_dir)
    turns = lambda: spark.read.parquet(f"{sf_dir}/conversations.parquet")
    c.add("Turn", lambda: turns().withColumn("key", F.concat_ws("-", "conv_id", "turn")), "key")
    c.add("Talk", lambda: turns().select("conv_id").distinct(), "conv_id", turns=Relation("Turn", "conv_id", "conv_id", True))
    return c


def bm25_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared(spark)}/postings-{uuid.uuid4().hex[:12]}"
    search.build_postings(tables(spark, sf_dir)["Document"].load(), "doc_id", "text", path)
    best = search.bm25_indexed(spark, path, "license permission license").orderBy(F.desc("score"), "key").limit(10)
    return best.select(F.col("key").alias("doc_id"), F.round("score", 5).alias("score"))


def vec_inverted_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells of the index: exact. Recall with fewer is measured in the tests."""
    path = f"{shared(spark)}/vectors-{uuid.uuid4().hex[:12]}"
    ann.build(tables(spark, sf_dir)["Embedding"].load(), "vec_id", "embedding", path, cells=16)
    return ann.search(spark, path, VECTOR, 10, probes=16).select(F.col("key").alias("vec_id"), F.round("score", 5).alias("score"))


def _ranked(metric: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = "query($v: [Float]) { Embedding(order: [{_alias: {score: DESC}}, {vec_id: ASC}], limit: 10) { vec_id score: SIMILARITY(embedding: {vector: $v, metric: %s}) } }" % metric
        return query(tables(spark, sf_dir), text, {"v": VECTOR}).select("vec_id", F.round("score", 5).alias("score"))

    return run


def _vec_sql(score: str) -> str:
    v = "[" + ",".join(map(str, VECTOR)) + "]::DOUBLE[]"
    return f"SELECT vec_id, round({score}, 5) AS score FROM (SELECT vec_id, embedding::DOUBLE[] AS e, {v} AS v FROM embeddings) ORDER BY {score} DESC, vec_id LIMIT 10"


def vec_alias_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "query($v: [Float]) { Embedding(filter: {_alias: {score: {_gt: 0.1}}}) { vec_id score: SIMILARITY(embedding: {vector: $v, metric: COSINE}) } }"
    return query(tables(spark, sf_dir), text, {"v": VECTOR}).select("vec_id")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = '{ Document(order: [{_alias: {score: DESC}}, {doc_id: ASC}], limit: 10) { doc_id score: BM25(fields: ["text"], query: "license permission license") } }'
    return query(tables(spark, sf_dir), text).select("doc_id", F.round("score", 5).alias("score"))


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables(spark, sf_dir)
    docs, vecs = c["Document"].load(), c["Embedding"].load()
    dense = vecs.select(F.col("vec_id").alias("doc_id"), search.similarity(F.col("embedding"), VECTOR).alias("score"))
    sparse = search.bm25(docs, ["text"], "license permission", "score").where("score > 0").select("doc_id", "score")
    fused = search.reciprocal_ranks(dense, sparse, "doc_id", 50)
    return fused.orderBy(F.desc("rrf"), "best_rank", "doc_id").limit(20).select("doc_id", F.round("rrf", 9).alias("rrf"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)["Event"].load().withColumn("ts", F.col("ts").cast("timestamp"))


def _shown(rolled: DataFrame) -> DataFrame:
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return rolled.select(*[c for c in rolled.columns if c in ("user_id", "event_type")], at("window_start"), at("window_end"), "count", F.round("sum", 4).alias("sum"), F.round("avg", 9).alias("avg"), "min", "max")


def rollup_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(rollup.tumbling(_events(spark, sf_dir), "ts", "value", "1h"))


def rollup_by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(rollup.tumbling(_events(spark, sf_dir), "ts", "value", "1d", ["user_id"]))


def rollup_chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(rollup.chained(rollup.tumbling(_events(spark, sf_dir), "ts", "value", "1h", ["event_type"]), "1d", ["event_type"]))


def rollup_complete_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(rollup.complete(rollup.tumbling(_events(spark, sf_dir), "ts", "value", "1d"), "2024-01-15 12:00:00"))


def _roll_sql(unit: str, series: str = "", where: str = "") -> str:
    s, g = (f"{series}, ", f"GROUP BY {series}, w") if series else ("", "GROUP BY w")
    return f"SELECT {s}strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(w + INTERVAL 1 {unit}, '%Y-%m-%d %H:%M:%S') AS window_end, CAST(count(*) AS BIGINT) AS count, round(coalesce(sum(value), 0), 4) AS sum, round(coalesce(avg(value), 0), 9) AS avg, min(value) AS min, max(value) AS max FROM (SELECT *, date_trunc('{unit}', ts) AS w FROM events) {where} {g}"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes made of the events: a user is a document, its event types are fields, an event's time is the priority."""
    e = tables(spark, sf_dir)["Event"].load()
    return e.select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("field"), F.unix_micros(F.col("ts").cast("timestamp")).alias("priority"), F.col("event_id").cast("string").alias("value"), F.lit(None).cast("long").alias("delta"), F.col("event_id").cast("string").alias("cid"))


def crdt_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.last_writes(_log(spark, sf_dir))


def crdt_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.counters(_log(spark, sf_dir).withColumn("delta", F.col("value").cast("long")))


def time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return history.last_writes(history.at_height(log, 1705276800000000))


def mutation_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables(spark, sf_dir)["Customer"].frame()
    return history.updated(df, F.col("c_nationkey") == 3, {"c_mktsegment": "MOVED", "c_custkey": 1000000}, counted=("c_custkey",)).select("c_custkey", "c_mktsegment")


def mutation_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables(spark, sf_dir)["Customer"].frame()
    return history.deleted(df, F.col("c_nationkey") == 3).where("not _deleted").select("c_custkey")


def _stored(spark: SparkSession, sf_dir: str):
    """Customers as a stored collection."""
    c = tables(spark, sf_dir)
    rows = c["Customer"].load()
    mutate.stored(c, "Client", rows.schema, c.root, "c_custkey", {"c_acctbal": {"default": 1.5}}, rows=rows)
    return c


def mutation_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _stored(spark, sf_dir)
    query(c, 'mutation { add_Client(input: [{c_custkey: -1, c_name: "new"}, {c_custkey: -2, c_name: "other", c_acctbal: 9}]) { c_custkey } }')
    return query(c, "{ Client { c_custkey c_name c_acctbal } }")


def mutation_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _stored(spark, sf_dir)
    for key in (1, -5):
        query(c, f'mutation {{ upsert_Client(filter: {{c_custkey: {key}}}, add: {{c_custkey: {key}, c_name: "added"}}, update: {{c_name: "changed"}}) {{ c_custkey }} }}')
    return query(c, "{ Client { c_custkey c_name } }")


def mutation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update, delete and what the change returns."""
    c = _stored(spark, sf_dir)
    query(c, "mutation { delete_Client(filter: {c_nationkey: 4}) { c_custkey } }")
    return query(c, 'mutation { update_Client(filter: {c_nationkey: {_leq: 5}}, input: {c_mktsegment: "MOVED"}) { c_custkey c_nationkey c_mktsegment } }')


def sql_dml(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _stored(spark, sf_dir)
    sql.execute(c, "DELETE FROM client WHERE c_nationkey = 2")
    sql.execute(c, "INSERT INTO client (c_custkey, c_name, c_acctbal) VALUES (1, 'x', 0), (-7, 'y', 3) ON CONFLICT (c_custkey) DO UPDATE SET c_name = excluded.c_name, c_acctbal = c_acctbal + 1")
    sql.execute(c, "UPDATE client SET c_acctbal = c_acctbal * 2 WHERE c_nationkey BETWEEN 6 AND 8")
    return sql.execute(c, "SELECT c_custkey, c_name, round(c_acctbal, 2) AS bal FROM client")


def _activity(spark: SparkSession, sf_dir: str):
    """Users as documents whose events are commits, a field for each type; a document's own commits are numbered through."""
    c = tables(spark, sf_dir)

    def log() -> DataFrame:
        e = c["Event"].load().select(F.col("user_id").cast("string").alias("doc_id"), F.col("event_type").alias("field"), F.col("event_id").cast("string").alias("cid"), F.col("event_id"), "ts")

        def rows(df: DataFrame) -> DataFrame:
            w = Window.partitionBy("doc_id", "field").orderBy("ts", "event_id")
            df = df.withColumn("priority", F.row_number().over(w).cast("long")).withColumn("before", F.lag("cid").over(w))
            return df.withColumn("parents", F.array_compact(F.array("before"))).select("doc_id", "field", "priority", F.col("event_id").cast("string").alias("value"), F.lit(None).cast("long").alias("delta"), F.lit(False).alias("deleted"), "cid", "parents")

        return rows(e).union(rows(e.withColumn("field", F.lit("_C")).withColumn("cid", F.concat(F.lit("c"), "cid"))))

    c.add("Activity", lambda: c["Event"].load().select("user_id").distinct(), "user_id").log = log
    return c


def _of_activity(text: str) -> Query:
    return lambda spark, sf_dir: query(_activity(spark, sf_dir), text)


def version_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = query(_activity(spark, sf_dir), "{ Activity { user_id _version { height } } }")
    return df.select("user_id", F.size("_version").cast("long").alias("n"), F.element_at("_version", 1).height.alias("top"))


def _commits_sql(shown: str, where: str = "true") -> str:
    return f"WITH log AS (SELECT CAST(user_id AS VARCHAR) AS d, event_type AS f, CAST(event_id AS VARCHAR) AS cid, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS h, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events) SELECT {shown} FROM log WHERE {where}"


def rollup_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(rollup.chained(rollup.tumbling(_events(spark, sf_dir), "ts", "value", "1h", ["event_type"]), "1d", ["event_type"], whole=True))


def rollup_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(rollup.latest(rollup.tumbling(_events(spark, sf_dir), "ts", "value", "1d", ["user_id"]), ["user_id"]))


def rollup_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("height", F.unix_micros("ts"))
    rolled = rollup.tumbling(e, "ts", "value", "1d", ["event_type"], source=("event_id", "height"))
    return rolled.select("event_type", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "source_doc_id", "source_height")


def rollup_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("height", F.unix_micros("ts"))
    return rollup.retained(e, "ts", "2024-01-20 00:00:00", "2d", head=(["user_id"], "height")).select("event_id")


def policy_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read policy takes rows away before they are grouped and counted."""
    c = tables(spark, sf_dir)
    people = c["Customer"]
    load = people.load
    people.grants = lambda: load().where("c_nationkey < 5").select(F.col("c_custkey").cast("string").alias("_docID"), F.when(F.col("c_nationkey") < 2, "alice").otherwise("bob").alias("identity"))
    c.identity = "alice"
    return query(c, "{ Customer(groupBy: [c_nationkey]) { c_nationkey n: COUNT(GROUP: {}) } }")


def show_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted documents show only if they are asked for."""
    c = tables(spark, sf_dir)
    rows = c["Customer"].load
    c.add("Past", lambda: history.deleted(rows().withColumn("_deleted", F.lit(False)), F.col("c_nationkey") == 7), "c_custkey")
    return query(c, "{ Past(showDeleted: true, filter: {c_nationkey: {_leq: 7}}) { c_custkey _deleted } }").union(query(c, "{ Past(filter: {c_nationkey: {_geq: 7}}) { c_custkey _deleted } }"))


def counter_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters that stop at the bounds of 64 bits; these stay far from them."""
    return history.counters(_log(spark, sf_dir).withColumn("delta", F.col("value").cast("long")), saturate=True)


def encrypted_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables(spark, sf_dir)
    rows = c["Customer"].load
    c.add("Hidden", lambda: views.tagged(rows(), "c_mktsegment", "key"), "c_custkey").indexes.append(Index("e", ("c_mktsegment",), "encrypted", {"key": "key"}))
    return query(c, '{ encrypted_Hidden(filter: {c_mktsegment: {_eq: "MACHINERY"}}) { docIDs } }').select(F.array_join("docIDs", ",").alias("docIDs"))


def view_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables(spark, sf_dir)
    views.live(c, "Rich", "{ Customer(filter: {c_acctbal: {_gt: 5000}}) { c_custkey c_name } }", lambda df: df.withColumnRenamed("c_name", "name"))
    return query(c, "{ Rich { c_custkey name } }")


def policy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables(spark, sf_dir)
    grants = c["Customer"].frame().where("c_nationkey < 5").select("_docID", F.when(F.col("c_nationkey") < 2, "alice").otherwise("bob").alias("identity"))
    return views.readable(c["Customer"].frame(), grants, "alice").select("c_custkey")


def encrypted_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.tagged(tables(spark, sf_dir)["Customer"].frame(), "c_mktsegment", "key")
    return views.encrypted_search(df, "c_mktsegment", "BUILDING", "key").select(F.array_join("docIDs", ",").alias("docIDs"))


_BM = """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS n, avg(len(t)) AS a, count(*) FILTER (WHERE list_contains(t, 'license')) AS d0, count(*) FILTER (WHERE list_contains(t, 'permission')) AS d1 FROM w),
f AS (SELECT doc_id, len(t) AS dl, len(list_filter(t, lambda x: x = 'license')) AS f0, len(list_filter(t, lambda x: x = 'permission')) AS f1 FROM w),
b AS (SELECT doc_id, {x} * ln((n - d0 + 0.5) / (d0 + 0.5) + 1) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * dl / a)) + ln((n - d1 + 0.5) / (d1 + 0.5) + 1) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * dl / a)) AS score FROM f, s)
"""

def _talks_sql(shown: str, by: str) -> str:
    """BM25 of turns for "the of", with the statistics of all turns or of those of each ``by``."""
    over = f"OVER (PARTITION BY {by})" if by else "OVER ()"
    one = lambda t: f"ln((n - d{t} + 0.5) / (d{t} + 0.5) + 1) * f{t} * 2.2 / (f{t} + 1.2 * (0.25 + 0.75 * dl / a))"
    return rf"""WITH w AS (SELECT conv_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS t FROM conversations),
f AS (SELECT conv_id, len(t) AS dl, len(list_filter(t, lambda x: x = 'the')) AS f0, len(list_filter(t, lambda x: x = 'of')) AS f1 FROM w),
s AS (SELECT *, count(*) {over} AS n, avg(dl) {over} AS a, count(*) FILTER (WHERE f0 > 0) {over} AS d0, count(*) FILTER (WHERE f1 > 0) {over} AS d1 FROM f),
b AS (SELECT conv_id, CASE WHEN dl = 0 THEN 0 ELSE {one(0)} + {one(1)} END AS score FROM s) {shown}"""


FUNCTIONS: dict[str, tuple[Query, str]] = {
    "join_to_one": (join_to_one, "SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey"),
    "join_to_many": (join_to_many, "SELECT o_orderkey, CAST(count(l_partkey) AS BIGINT) AS n, coalesce(string_agg(l_partkey, ',' ORDER BY l_partkey), '') AS parts FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 25 GROUP BY 1"),
    "child_topk_per_parent": (child_topk_per_parent, "SELECT c_custkey, coalesce(string_agg(o_orderkey, ',' ORDER BY r), '') AS top FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) ON o_custkey = c_custkey AND r <= 3 GROUP BY 1"),
    "group_members": (group_members, "SELECT n_regionkey AS \"_regionID\", string_agg(n_nationkey, ',' ORDER BY n_nationkey DESC) AS members FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) AS r FROM nation) WHERE r <= 2 GROUP BY 1"),
    "vec_cosine_topk": (_ranked("COSINE"), _vec_sql("list_cosine_similarity(e, v)")),
    "vec_l2_topk": (_ranked("EUCLIDEAN"), _vec_sql("-(list_distance(e, v) ** 2)")),
    "vec_dot_topk": (_ranked("DOT"), _vec_sql("list_inner_product(e, v)")),
    "vec_alias_threshold": (vec_alias_threshold, "SELECT vec_id FROM embeddings WHERE list_cosine_similarity(embedding::DOUBLE[], [" + ",".join(map(str, VECTOR)) + "]::DOUBLE[]) > 0.1"),
    "bm25_topk": (bm25_topk, _BM.replace("{x}", "2") + "SELECT doc_id, round(score, 5) AS score FROM b ORDER BY b.score DESC, doc_id LIMIT 10"),
    "hybrid_rrf": (hybrid_rrf, _BM.replace("{x}", "1") + ", sp AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM b WHERE score > 0), de AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY list_cosine_similarity(embedding::DOUBLE[], [" + ",".join(map(str, VECTOR)) + "]::DOUBLE[]) DESC, vec_id) AS r FROM embeddings), fu AS (SELECT doc_id, coalesce(1.0::DOUBLE / (60 + d.r), 0) + coalesce(1.0::DOUBLE / (60 + s.r), 0) AS rrf, least(d.r, s.r) AS best FROM (SELECT * FROM de WHERE r <= 50) d FULL JOIN (SELECT * FROM sp WHERE r <= 50) s USING (doc_id)) SELECT doc_id, round(rrf, 9) AS rrf FROM fu ORDER BY fu.rrf DESC, best, doc_id LIMIT 20"),
    "join_inverted": (join_inverted, "SELECT c_custkey, (SELECT arg_min(o_orderkey, CAST(o_orderkey AS VARCHAR)) FROM orders WHERE o_custkey = c_custkey) AS o_orderkey FROM customer"),
    "group_two_keys": (group_two_keys, "SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY r) AS members FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus DESC, o_totalprice, CAST(o_orderkey AS VARCHAR)) AS r FROM orders) WHERE r <= 4 GROUP BY 1"),
    "group_nested": (group_nested, "SELECT o_orderstatus, string_agg(o_orderpriority || ':' || n || ':' || c, ',' ORDER BY o_orderpriority || ':' || n || ':' || c) AS parts FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS c FROM orders GROUP BY 1, 2) GROUP BY 1"),
    "group_children": (group_children, "SELECT c_custkey, coalesce(string_agg(o_orderstatus || ':' || n, ',' ORDER BY o_orderstatus || ':' || n), '') AS parts FROM customer LEFT JOIN (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) ON o_custkey = c_custkey GROUP BY 1"),
    "cursor_page_info": (cursor_page_info, "SELECT o_orderkey, true AS has_next, true AS has_previous FROM orders ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR) LIMIT 5 OFFSET 7"),
    "cursor_backward": (cursor_backward, "SELECT o_orderkey, false AS has_next, true AS has_previous FROM orders ORDER BY o_totalprice, CAST(o_orderkey AS VARCHAR) DESC LIMIT 6"),
    "filter_null": (_of_sparse("{ Sparse(filter: {o_orderstatus: null}) { o_orderkey } }"), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'"),
    "filter_neq_with_nulls": (_of_sparse('{ Sparse(filter: {o_orderstatus: {_neq: "O"}}) { o_orderkey } }'), "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O'"),
    "filter_like_literal": (_of_sparse('{ Place(filter: {n_name: {_like: "NATION_%"}}) { n_name } }'), "SELECT n_name FROM nation WHERE n_nationkey % 2 = 0"),
    "order_nulls": (_of_sparse("{ Sparse(order: [{o_orderstatus: ASC}, {o_totalprice: DESC}], limit: 20) { o_orderkey } }"), "SELECT o_orderkey FROM orders ORDER BY nullif(o_orderstatus, 'F') NULLS FIRST, o_totalprice DESC, CAST(o_orderkey AS VARCHAR) LIMIT 20"),
    "order_exhaustive": (order_exhaustive, "SELECT doc_id, false AS exhaustive FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE n_chars > 2000) UNION ALL SELECT doc_id, true FROM labels"),
    "fts_relation_path": (fts_relation_path, _talks_sql("SELECT conv_id, round(sum(score), 5) AS score FROM b GROUP BY 1", "")),
    "fts_scoped": (fts_scoped, _talks_sql("SELECT conv_id, round(max(score), 5) AS best FROM b GROUP BY 1", "conv_id")),
    "bm25_indexed": (bm25_indexed, _BM.replace("{x}", "2") + "SELECT doc_id, round(score, 5) AS score FROM b WHERE score > 0 ORDER BY b.score DESC, doc_id LIMIT 10"),
    "vec_inverted_lists": (vec_inverted_lists, _vec_sql("list_cosine_similarity(e, v)")),
    "mutation_add": (mutation_add, "SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT -1, 'new', 1.5::DOUBLE UNION ALL SELECT -2, 'other', 9.0::DOUBLE"),
    "mutation_upsert": (mutation_upsert, "SELECT c_custkey, CASE WHEN c_custkey = 1 THEN 'changed' ELSE c_name END AS c_name FROM customer UNION ALL SELECT -5, 'added'"),
    "mutation_text": (mutation_text, "SELECT c_custkey, c_nationkey, 'MOVED' AS c_mktsegment FROM customer WHERE c_nationkey <= 5 AND c_nationkey <> 4"),
    "sql_dml": (sql_dml, "SELECT c_custkey, CASE WHEN c_custkey = 1 THEN 'x' ELSE c_name END AS c_name, round((c_acctbal + CASE WHEN c_custkey = 1 THEN 1 ELSE 0 END) * CASE WHEN c_nationkey BETWEEN 6 AND 8 THEN 2 ELSE 1 END, 2) AS bal FROM customer WHERE c_nationkey <> 2 UNION ALL SELECT -7, 'y', 3.0 UNION ALL SELECT 1, 'x', 0.0 WHERE (SELECT c_nationkey FROM customer WHERE c_custkey = 1) = 2"),
    "commits_filter": (_of_activity('{ _commits(fieldName: "click", filter: {height: {_gt: 20}}) { cid docID height } }'), _commits_sql('cid, d AS "docID", h AS height', "f = 'click' AND h > 20")),
    "commits_height": (_of_activity('{ _commits(filter: {_and: [{height: {_geq: 5}}, {height: {_lt: 8}}], fieldName: {_neq: "_C"}}) { cid height fieldName delta } }'), _commits_sql('cid, h AS height, f AS "fieldName", CAST(event_id AS VARCHAR) AS delta', "h >= 5 AND h < 8")),
    "commits_depth": (_of_activity('{ _commits(fieldName: "view", depth: 3) { cid n: COUNT(heads: {}) } }'), _commits_sql("cid, CAST(CASE WHEN h > 1 THEN 1 ELSE 0 END AS BIGINT) AS n", "f = 'view' AND h > n - 3")),
    "commits_sum": (_of_activity('{ s: SUM(_commits: {field: delta, fieldName: "view"}) n: COUNT(_commits: {fieldName: "view"}) }'), _commits_sql("CAST(sum(event_id) AS DOUBLE) AS s, CAST(count(*) AS BIGINT) AS n", "f = 'view'")),
    "commits_group": (_of_activity('{ _commits(groupBy: [fieldName]) { fieldName n: COUNT(GROUP: {}) top: MAX(GROUP: {field: height}) } }'), _commits_sql("f AS \"fieldName\", CAST(count(*) AS BIGINT) AS n, CAST(max(h) AS BIGINT) AS top", "true GROUP BY f") + " UNION ALL SELECT '_C', CAST(count(*) AS BIGINT), (SELECT max(k) FROM (SELECT count(*) AS k FROM events GROUP BY user_id)) FROM events"),
    "version_of": (version_of, "SELECT user_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS top FROM events GROUP BY 1"),
    "show_deleted": (show_deleted, "SELECT c_custkey, c_nationkey = 7 AS _deleted FROM customer WHERE c_nationkey <= 7 UNION ALL SELECT c_custkey, false FROM customer WHERE c_nationkey > 7"),
    "counter_replay": (counter_replay, "SELECT user_id AS doc_id, event_type AS field, CAST(sum(event_id) AS BIGINT) AS value FROM events GROUP BY 1, 2"),
    "rollup_whole": (rollup_whole, _roll_sql("day", "event_type").replace(" GROUP BY event_type, w", " GROUP BY event_type, w HAVING max(date_trunc('hour', ts)) + INTERVAL 1 hour >= w + INTERVAL 1 day")),
    "rollup_latest": (rollup_latest, "SELECT * FROM (" + _roll_sql("day", "user_id") + ") QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY window_start DESC) = 1"),
    "rollup_sources": (rollup_sources, "SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, arg_max(event_id, (epoch_us(ts), event_id)) AS source_doc_id, max(epoch_us(ts)) AS source_height FROM events GROUP BY 1, 2"),
    "rollup_retained": (rollup_retained, "SELECT event_id FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS top FROM events) WHERE ts >= TIMESTAMP '2024-01-18' OR ts = top"),
    "policy_count": (policy_count, "SELECT c_nationkey, CAST(count(*) AS BIGINT) AS n FROM customer WHERE c_nationkey < 2 OR c_nationkey >= 5 GROUP BY 1"),
    "encrypted_root": (encrypted_root, "SELECT string_agg(k, ',' ORDER BY k) AS \"docIDs\" FROM (SELECT CAST(c_custkey AS VARCHAR) AS k FROM customer WHERE c_mktsegment = 'MACHINERY')"),
    "rollup_tumbling": (rollup_tumbling, _roll_sql("hour")),
    "rollup_by_series": (rollup_by_series, _roll_sql("day", "user_id")),
    "rollup_chained": (rollup_chained, _roll_sql("day", "event_type")),
    "rollup_complete_only": (rollup_complete_only, _roll_sql("day", where="WHERE w + INTERVAL 1 day <= TIMESTAMP '2024-01-15 12:00:00'")),
    "crdt_lww": (crdt_lww, "SELECT user_id AS doc_id, event_type AS field, CAST(arg_max(event_id, (ts, CAST(event_id AS VARCHAR))) AS VARCHAR) AS value FROM events GROUP BY 1, 2"),
    "crdt_counter": (crdt_counter, "SELECT user_id AS doc_id, event_type AS field, CAST(sum(event_id) AS BIGINT) AS value FROM events GROUP BY 1, 2"),
    "time_travel": (time_travel, "SELECT user_id AS doc_id, event_type AS field, CAST(arg_max(event_id, (ts, CAST(event_id AS VARCHAR))) AS VARCHAR) AS value FROM events WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY 1, 2"),
    "mutation_update": (mutation_update, "SELECT CASE WHEN c_nationkey = 3 THEN c_custkey + 1000000 ELSE c_custkey END AS c_custkey, CASE WHEN c_nationkey = 3 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer"),
    "mutation_delete": (mutation_delete, "SELECT c_custkey FROM customer WHERE c_nationkey IS DISTINCT FROM 3"),
    "view_live": (view_live, "SELECT c_custkey, c_name AS name FROM customer WHERE c_acctbal > 5000"),
    "policy_filter": (policy_filter, "SELECT c_custkey FROM customer WHERE c_nationkey < 2 OR c_nationkey >= 5"),
    "encrypted_eq": (encrypted_eq, "SELECT string_agg(k, ',' ORDER BY k) AS \"docIDs\" FROM (SELECT CAST(c_custkey AS VARCHAR) AS k FROM customer WHERE c_mktsegment = 'BUILDING')"),
}


def queries() -> dict[str, Query]:
    return {n: _text(t, SHOWN.get(n, ())) for n, (t, _) in TEXTS.items()} | {n: _sql(t) for n, t in SQL.items()} | {n: f for n, (f, _) in FUNCTIONS.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in TEXTS.items()} | SQL | {n: s for n, (_, s) in FUNCTIONS.items()}
