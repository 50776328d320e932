"""The named queries of the engine with their SQL equivalents.

The include_* queries follow relationships, a feature that the language describes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.engine import Engine
from docloom.functions.types import FieldDef
from docloom.operators import constraints, indexes, relationships
from docloom.operators.relationships import Relationship
from docloom.plans.syntax import CommandError
from docloom.sources.scratch import fresh

IDS = {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id", "labels": "doc_id", "conversations": "conv_id"}
CUSTOMER = Relationship("Customer", "orders", "customer", (("o_custkey", "c_custkey"),))
ORDERS = Relationship("Orders", "customer", "orders", (("c_custkey", "o_custkey"),))


def frame(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def engine(spark: SparkSession, sf_dir: str, *tables: str, semantics: str = "documented") -> Engine:
    """An engine with the tables registered as bundles where they lie."""
    found = Engine(spark, semantics=semantics)
    for t in tables:
        found.register_bundle(t, frame(spark, sf_dir, t), IDS[t])
    return found


def command(table: str, text: str, semantics: str = "documented", then: Callable | None = None) -> Callable:
    """A query that runs one command over one table."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = engine(spark, sf_dir, table, semantics=semantics).execute(text)
        return then(found) if then else found.result

    return query


def columns(*names: str) -> Callable:
    return lambda found: found.result.select(*names)


def over(table: str, fn: Callable[[DataFrame], DataFrame]) -> Callable:
    """A query that applies fn to one table."""
    return lambda spark, sf_dir: fn(frame(spark, sf_dir, table))


def _string_field_against_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = frame(spark, sf_dir, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    return Engine(spark).register_bundle("events", events, "event_id").sql('SELECT DOCUMENTS FROM "events" WHERE k > 90')


def _bool_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = frame(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("is_quality"))
    return Engine(spark).register_bundle("labels", labels, "doc_id").sql('SELECT DOCUMENTS FROM "labels" WHERE is_quality == TRUE')


def _variant_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same filter on an undeclared field, kept in an open VARIANT column."""
    events = frame(spark, sf_dir, "events").select("event_id", F.parse_json("props").alias("extra"))
    return Engine(spark).register_bundle("events", events, "event_id").sql('SELECT event_id FROM "events" WHERE k > 90')


def _fill_required(df: DataFrame) -> DataFrame:
    given = df.select("conv_id", "turn", F.nullif("role", F.lit("system")).alias("role"))
    return constraints.fill_required(given, [FieldDef("role", "STRING", True, False, "unknown")])


def _include(text: str, *names: str) -> Callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = engine(spark, sf_dir, "orders", "customer").relate("Customer", "orders", "customer", ("o_custkey", "c_custkey"))
        return found.sql(text).select(*names)

    return query


def _include_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relationships.child_counts(frame(spark, sf_dir, "customer"), frame(spark, sf_dir, "orders"), ORDERS).select("c_custkey", "n_children")


def _include_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relationships.include_nested(frame(spark, sf_dir, "customer"), frame(spark, sf_dir, "orders"), ORDERS, ["o_orderkey"])
    return found.select("c_custkey", F.size("Orders").cast("long").alias("n_orders"), F.array_min(F.transform("Orders", lambda x: x["o_orderkey"])).alias("first_order"))


def stored(spark: SparkSession, journal: bool = False) -> Engine:
    """An engine over a new database in the shared folder."""
    found = Engine(spark, fresh(spark, "databases"), journal=journal)
    found.execute("CREATE DATABASE bench")
    return found.connect("bench")


#: Declared fields of the tables that are stored as bundles.
STORED_FIELDS = {
    "orders": (
        '({"o_orderkey", INT, TRUE, TRUE}, {"o_custkey", INT, TRUE, FALSE}, '
        '{"o_orderstatus", STRING, FALSE, FALSE, "P"}, {"o_totalprice", FLOAT, FALSE, FALSE})'
    ),
    "customer": '({"c_custkey", INT, TRUE, TRUE}, {"c_name", STRING, TRUE, FALSE}, {"c_mktsegment", STRING, FALSE, FALSE})',
    "lineitem": (
        '({"l_orderkey", INT, TRUE, FALSE}, {"l_partkey", INT, TRUE, FALSE}, '
        '{"l_suppkey", INT, TRUE, FALSE}, {"l_linenumber", INT, TRUE, FALSE})'
    ),
}


def stored_table(spark: SparkSession, sf_dir: str, table: str, into: Engine | None = None, rows: DataFrame | None = None) -> Engine:
    """An engine with the table's declared fields as a stored bundle; customers are documents by their key."""
    found = into or stored(spark)
    found.execute(f'CREATE BUNDLE "{table}" WITH FIELDS {STORED_FIELDS[table]}')
    fields = [f.name for f in found.database.fields(table)]
    rows = (frame(spark, sf_dir, table) if rows is None else rows).select(*fields)
    if table == "customer":
        rows = rows.withColumn("DocumentID", F.col("c_custkey").cast("string"))
    found.add_documents(table, rows)
    return found


def indexed(table: str, index: str, look: Callable[[Engine], DataFrame]) -> Callable:
    """A query that stores the table, builds the index "i" and looks through it."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = stored_table(spark, sf_dir, table)
        kind, fields = index.split(" ", 1)
        found.execute(f'CREATE {kind}-INDEX "i" ON BUNDLE "{table}" WITH FIELDS {fields}')
        return look(found)

    return query


BY_PRICE = 'B ({"o_totalprice", FALSE}, {"o_orderkey", FALSE})'
BY_SUPPLIER = 'B ({"l_suppkey", FALSE}, {"l_linenumber", FALSE})'
BY_PART = 'B ({"l_partkey", FALSE}, {"l_suppkey", FALSE})'
BY_NAME = 'H ({"c_name", TRUE})'
BY_SEGMENT = 'H ({"c_mktsegment", FALSE}) IGNORE CASE'


def prices(low: float | None, high: float | None) -> Callable[[Engine], DataFrame]:
    ends = [None if x is None else [x] for x in (low, high)]
    return lambda found: found.lookup_between("orders", "i", *ends).select("o_orderkey")


def lines(df: DataFrame) -> DataFrame:
    return df.select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"))


def _stored_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk add, update, delete and alter of a stored bundle, then a select of its last version."""
    found = stored_table(spark, sf_dir, "orders")
    found.execute('UPDATE DOCUMENTS IN "orders" (o_orderstatus = "X", note = "hold") WHERE o_custkey < 100')
    found.execute('DELETE DOCUMENTS FROM "orders" WHERE o_totalprice > 400000')
    found.execute('UPDATE BUNDLE "orders" CHANGE FIELD "o_orderstatus" TO {"status", "STRING", FALSE, FALSE} ADD FIELD {"o_rank", "INT", TRUE, FALSE, 7}')
    return found.sql('SELECT o_orderkey, status, note, o_rank FROM "orders" WHERE status != "O"')


def _index_null_second_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A select that an index answers keeps documents that lack another of its keys."""
    status = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")).alias("o_orderstatus")
    rows = frame(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", status, "o_totalprice")
    found = stored_table(spark, sf_dir, "orders", rows=rows)
    found.execute('CREATE B-INDEX "i" ON BUNDLE "orders" WITH FIELDS ({"o_custkey", FALSE}, {"o_orderstatus", FALSE})')
    return found.sql('SELECT o_custkey, o_orderstatus FROM "orders" WHERE o_custkey < 100')


def _index_after_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that were added after an index was built are found beside those that it covers."""
    orders = frame(spark, sf_dir, "orders")
    found = stored_table(spark, sf_dir, "orders", rows=orders.where("o_orderkey % 2 = 0"))
    found.execute('CREATE B-INDEX "i" ON BUNDLE "orders" WITH FIELDS ({"o_custkey", FALSE})')
    found.add_documents("orders", orders.where("o_orderkey % 2 = 1").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"))
    return found.sql('SELECT o_orderkey, o_custkey FROM "orders" WHERE o_custkey == 42')


def _bulk_add_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text columns are cast to the declared types; a text that is none is refused with all rows."""
    rows = frame(spark, sf_dir, "orders").withColumn("o_custkey", F.col("o_custkey").cast("string"))
    found = stored_table(spark, sf_dir, "orders", rows=rows)
    try:
        found.add_documents("orders", rows.limit(1).select(F.lit(-1).cast("long").alias("o_orderkey"), F.lit("none").alias("o_custkey")))
    except CommandError:
        return found.sql('SELECT o_orderkey, o_custkey FROM "orders" WHERE o_custkey > 100')
    raise AssertionError("a mistyped row was added")


def _relationship_ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relationship is declared with field definitions, updated, and followed."""
    found = stored_table(spark, sf_dir, "customer", into=stored_table(spark, sf_dir, "orders"))
    ends = 'FROM BUNDLE "orders" TO BUNDLE "customer" WITH FIELDS'
    found.execute(f'UPDATE BUNDLE "orders" CREATE RELATIONSHIP "Customer" {ends} ({{"o_orderkey", INT, TRUE, TRUE}}, {{"c_custkey", INT, TRUE, TRUE}})')
    found.execute(f'UPDATE RELATIONSHIP "Customer" {ends} ({{"o_custkey", INT, TRUE, FALSE}}, {{"c_custkey", INT, TRUE, TRUE}})')
    return found.sql('SELECT o_orderkey, c_name FROM "orders" INCLUDE orders.Customer WHERE o_totalprice > 300000')


def _refused(*commands: str) -> Callable:
    """The message with which the last command is refused."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = stored(spark)
        for text in commands[:-1]:
            found.execute(text)
        try:
            found.execute(commands[-1])
        except CommandError as e:
            return spark.createDataFrame([(str(e),)], "message string")
        raise AssertionError(f"not refused: {commands[-1]}")

    return query


def _databases(*commands: str) -> Callable:
    """The databases, with their numbers of bundles, after the commands."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = stored(spark)
        for text in commands[:-1]:
            found.execute(text)
        return found.sql(commands[-1]).select("name", F.size("bundles").cast("long").alias("n_bundles"))

    return query


def _connection_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stored(spark).connect("doc://localhost:1776:BENCH:user:secret")
    found.execute(f'CREATE BUNDLE "orders" WITH FIELDS {STORED_FIELDS["orders"]}')
    return found.bundle_fields("orders").where("required and field like 'o_%'").select("field")


def _json_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine(spark, sf_dir, "customer").execute('SELECT DOCUMENTS FROM "customer" WHERE c_mktsegment == "BUILDING"').to_json()
    of = lambda name: F.get_json_object("document", f"$.{name}")
    return found.select(of("c_custkey").cast("long").alias("c_custkey"), of("c_name").alias("c_name"))


def _list_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark).sql("SELECT DATABASES FROM DEFAULT;").select("name")


def _bundle_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stored(spark)
    found.execute(f'CREATE BUNDLE "orders" WITH FIELDS {STORED_FIELDS["orders"]}')
    return found.bundle_fields("orders").where("field like 'o_%'")


def _list_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stored_table(spark, sf_dir, "orders")
    found.execute('CREATE B-INDEX "a" ON BUNDLE "orders" WITH FIELDS ({"o_custkey", FALSE})')
    found.execute('CREATE H-INDEX "b" ON BUNDLE "orders" WITH FIELDS ({"o_orderkey", FALSE, TRUE})')
    found.drop_index("orders", "a")
    return found.list_indexes("orders").select("name", "kind", "unique")


def _journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stored(spark, journal=True)
    found.execute(f'CREATE BUNDLE "orders" WITH FIELDS {STORED_FIELDS["orders"]}')
    return found.journal.read().select("bundle", "details")


def _export(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine(spark, sf_dir, "customer").export_documents("customer")
    return found.select("DocumentId", F.size("Fields").cast("long").alias("n_fields"), F.col("Fields")[0]["Value"].alias("first_value"))


#: key: (query, SQL).
CATALOGUE: dict[str, tuple[Callable, str]] = {
    "select_all": (command("customer", 'SELECT DOCUMENTS FROM "customer";'), "select * from customer"),
    "where_eq_str": (
        command("orders", 'SELECT DOCUMENTS FROM "orders" WHERE o_orderstatus == "F"'),
        "select * from orders where o_orderstatus = 'F'",
    ),
    "where_ne_str": (
        command("orders", 'SELECT DOCUMENTS FROM "orders" WHERE o_orderstatus != "F"'),
        "select * from orders where o_orderstatus <> 'F'",
    ),
    "where_ne_str_compat": (
        command("orders", 'SELECT DOCUMENTS FROM "orders" WHERE o_orderstatus != "F"', "compat"),
        "select * from orders where o_orderstatus = 'F'",
    ),
    "where_gt_num": (
        command("lineitem", 'SELECT DOCUMENTS FROM "lineitem" WHERE l_quantity > 45'),
        "select * from lineitem where l_quantity > 45",
    ),
    "where_lt_num": (
        command("orders", 'SELECT DOCUMENTS FROM "orders" WHERE o_totalprice < 50000'),
        "select * from orders where o_totalprice < 50000",
    ),
    "where_gt_str": (
        command("customer", 'SELECT DOCUMENTS FROM "customer" WHERE c_mktsegment > "HOUSEHOLD"'),
        "select * from customer where c_mktsegment > 'HOUSEHOLD'",
    ),
    "where_gt_str_compat": (
        command("customer", 'SELECT DOCUMENTS FROM "customer" WHERE c_mktsegment > "HOUSEHOLD"', "compat"),
        "select * from customer where c_mktsegment = 'HOUSEHOLD'",
    ),
    "where_and": (
        command("orders", 'SELECT DOCUMENTS FROM "orders" WHERE (o_orderstatus == "F" AND o_totalprice > 100000)'),
        "select * from orders where o_orderstatus = 'F' and o_totalprice > 100000",
    ),
    "where_or": (
        command("orders", 'SELECT DOCUMENTS FROM "orders" WHERE (o_orderstatus == "P" OR o_totalprice > 300000)'),
        "select * from orders where o_orderstatus = 'P' or o_totalprice > 300000",
    ),
    "where_or_compat": (
        command(
            "orders",
            'SELECT DOCUMENTS FROM "orders" WHERE (o_orderstatus == "P" OR o_totalprice > 300000)',
            "compat",
        ),
        "select * from orders where o_orderstatus = 'P' and o_totalprice > 300000",
    ),
    "where_nested": (
        command(
            "orders",
            'SELECT DOCUMENTS FROM "orders" WHERE ((o_orderstatus == "F" AND o_totalprice > 100000) OR (o_custkey < 10 '
            'AND o_orderstatus != "O"));',
        ),
        "select * from orders where (o_orderstatus = 'F' and o_totalprice > 100000) or (o_custkey < 10 and "
        "o_orderstatus <> 'O')",
    ),
    "where_mixed_prec": (
        command(
            "orders",
            'SELECT DOCUMENTS FROM "orders" WHERE o_orderstatus == "P" OR o_orderstatus == "F" AND o_totalprice > 400000',
        ),
        "select * from orders where o_orderstatus = 'P' or o_orderstatus = 'F' and o_totalprice > 400000",
    ),
    "where_docid": (
        command("orders", 'SELECT DOCUMENTS FROM "orders" WHERE DocumentID == 42'),
        "select * from orders where o_orderkey = 42",
    ),
    "where_missing_field": (
        command("orders", 'SELECT DOCUMENTS FROM "orders" WHERE o_absent != 1'),
        "select * from orders where false",
    ),
    "where_num_vs_quoted": (
        command("orders", 'SELECT DOCUMENTS FROM "orders" WHERE o_custkey == "42"'),
        "select * from orders where cast(o_custkey as double) = 42",
    ),
    "where_strfield_vs_num": (
        _string_field_against_number,
        "select event_id, event_type, json_extract_string(props, '$.k') as k from events where "
        "try_cast(json_extract_string(props, '$.k') as double) > 90",
    ),
    "where_variant_field": (
        _variant_field,
        "select event_id from events where try_cast(json_extract_string(props, '$.k') as double) > 90",
    ),
    "where_bool": (
        _bool_field,
        "select doc_id, quality = 1 as is_quality from labels where (quality = 1) = true",
    ),
    "result_count": (
        command(
            "orders",
            'SELECT DOCUMENTS FROM "orders" WHERE o_orderstatus == "F"',
            then=lambda found: found.count_frame(),
        ),
        "select count(*) as result_count from orders where o_orderstatus = 'F'",
    ),
    "project_fields": (
        command("orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey < 100"),
        "select o_orderkey, o_totalprice from orders where o_custkey < 100",
    ),
    "add_document": (
        command(
            "orders",
            'ADD DOCUMENT TO BUNDLE "orders" WITH ({"o_orderkey" = 999999999}, {"o_custkey" = 7}, {"o_orderstatus" = '
            '"F"})',
            then=columns("o_orderkey", "o_custkey", "o_orderstatus"),
        ),
        "select o_orderkey, o_custkey, o_orderstatus from orders union all select 999999999, 7, 'F'",
    ),
    "update_documents": (
        command(
            "orders",
            'UPDATE DOCUMENTS IN BUNDLE "orders" (o_orderstatus = "X") WHERE (o_custkey < 100)',
            then=columns("o_orderkey", "o_orderstatus"),
        ),
        "select o_orderkey, case when o_custkey < 100 then 'X' else o_orderstatus end as o_orderstatus from orders",
    ),
    "update_documents_compat": (
        command(
            "orders",
            'UPDATE DOCUMENTS IN BUNDLE "orders" (o_orderstatus = "X") WHERE (o_custkey < 100)',
            "compat",
            then=columns("o_orderkey", "o_orderstatus"),
        ),
        'select o_orderkey, case when o_custkey < 100 then \'"X"\' else o_orderstatus end as o_orderstatus from orders',
    ),
    "update_upserts_field": (
        command(
            "orders",
            'UPDATE DOCUMENTS IN BUNDLE "orders" (note = "hold") WHERE (o_orderstatus == "P")',
            then=columns("o_orderkey", "note"),
        ),
        "select o_orderkey, case when o_orderstatus = 'P' then 'hold' end as note from orders",
    ),
    "delete_documents": (
        command("orders", 'DELETE DOCUMENTS FROM BUNDLE "orders" WHERE (o_orderstatus == "F")'),
        "select * from orders where not (o_orderstatus = 'F')",
    ),
    "delete_gt": (
        command("orders", 'DELETE DOCUMENTS FROM BUNDLE "orders" WHERE (o_totalprice > 100000)'),
        "select * from orders where not (o_totalprice > 100000)",
    ),
    "alter_add_field": (
        command(
            "orders",
            'UPDATE BUNDLE "orders" ADD FIELD {"o_rank", "INT", TRUE, FALSE, 0}',
            then=lambda found: (
                found.result
                .select("o_orderkey", "o_orderstatus", F.col("o_rank").cast("int").alias("o_rank"))
            ),
        ),
        "select o_orderkey, o_orderstatus, cast(0 as integer) as o_rank from orders",
    ),
    "alter_remove_field": (
        command(
            "orders",
            'UPDATE BUNDLE "orders" REMOVE FIELD "o_orderpriority"',
            then=columns("o_orderkey", "o_custkey"),
        ),
        "select o_orderkey, o_custkey from orders",
    ),
    "alter_change_field": (
        command(
            "orders",
            'UPDATE BUNDLE "orders" CHANGE FIELD "o_orderstatus" TO {"status", "STRING", FALSE, FALSE}',
            then=columns("o_orderkey", "status"),
        ),
        "select o_orderkey, o_orderstatus as status from orders",
    ),
    "required_default_fill": (
        over("conversations", _fill_required),
        "select conv_id, turn, coalesce(nullif(role, 'system'), 'unknown') as role from conversations",
    ),
    "unique_violations": (
        over("orders", lambda df: constraints.unique_violations(df, "o_custkey")),
        "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 1",
    ),
    "btree_point": (
        indexed(
            "orders",
            'B ({"o_custkey", FALSE})',
            lambda found: found.lookup("orders", "i", 42).select("o_orderkey"),
        ),
        "select o_orderkey from orders where o_custkey = 42",
    ),
    "btree_range_closed": (
        indexed("orders", BY_PRICE, prices(100000.0, 110000.0)),
        "select o_orderkey from orders where o_totalprice >= 100000 and o_totalprice <= 110000",
    ),
    "btree_range_open_lo": (
        indexed("orders", BY_PRICE, prices(None, 10000.0)),
        "select o_orderkey from orders where o_totalprice <= 10000",
    ),
    "btree_range_open_hi": (
        indexed("orders", BY_PRICE, prices(400000.0, None)),
        "select o_orderkey from orders where o_totalprice >= 400000",
    ),
    "btree_composite_eq": (
        indexed("lineitem", BY_SUPPLIER, lambda found: lines(found.lookup("lineitem", "i", 5, 3))),
        "select l_orderkey, l_linenumber from lineitem where l_suppkey = 5 and l_linenumber = 3",
    ),
    "btree_composite_prefix": (
        indexed("lineitem", BY_PART, lambda found: lines(found.lookup("lineitem", "i", 5))),
        "select l_orderkey, l_linenumber from lineitem where l_partkey = 5",
    ),
    "btree_composite_range": (
        indexed("lineitem", BY_PART, lambda found: lines(found.lookup_between("lineitem", "i", [5, 3], [9, 2]))),
        "select l_orderkey, l_linenumber from lineitem where (l_partkey > 5 or (l_partkey = 5 and l_suppkey >= 3)) "
        "and (l_partkey < 9 or (l_partkey = 9 and l_suppkey <= 2))",
    ),
    "btree_composite_unique": (
        over("orders", lambda df: indexes.unique_keys(df, ["o_custkey", "o_orderstatus"], "o_orderkey")),
        "select o_custkey, o_orderstatus, min(o_orderkey) as doc_id from orders group by o_custkey, o_orderstatus",
    ),
    "index_build_sort": (
        over(
            "orders",
            lambda df: indexes.numbered(df, ["o_totalprice"], "o_orderkey").withColumnRenamed("o_totalprice", "key"),
        ),
        "select o_totalprice as key, o_orderkey as doc_id, row_number() over (order by o_totalprice, o_orderkey) as "
        "tid from orders",
    ),
    "hash_point": (
        indexed(
            "customer",
            BY_NAME,
            lambda found: found.lookup("customer", "i", "Customer#000000042").select("c_custkey"),
        ),
        "select c_custkey from customer where c_name = 'Customer#000000042'",
    ),
    "hash_ci": (
        indexed("customer", BY_SEGMENT, lambda found: found.lookup("customer", "i", "Building").select("c_custkey")),
        "select c_custkey from customer where lower(c_mktsegment) = lower('Building')",
    ),
    "hash_unique_violations": (
        over("customer", lambda df: indexes.hash_duplicates(df, "c_mktsegment")),
        "select c_mktsegment, count(*) as n from customer group by c_mktsegment having count(*) > 1",
    ),
    "hash_scan_all": (
        indexed(
            "customer",
            BY_NAME,
            lambda found: (
                found.index("customer", "i")
                .select(F.col("c_name").alias("key"), F.col("DocumentID").cast("long").alias("doc_id"))
            ),
        ),
        "select c_name as key, c_custkey as doc_id from customer",
    ),
    "include_one": (
        _include(
            'SELECT DOCUMENTS FROM "orders" INCLUDE orders.Customer WHERE o_totalprice > 300000',
            "o_orderkey",
            "o_totalprice",
            "c_name",
            "c_mktsegment",
        ),
        "select o.o_orderkey, o.o_totalprice, c.c_name, c.c_mktsegment from orders o left join customer c on "
        "o.o_custkey = c.c_custkey where o.o_totalprice > 300000",
    ),
    "include_child_filter": (
        _include(
            'SELECT DOCUMENTS FROM "orders" INCLUDE orders.Customer WHERE o_totalprice > 300000 AND '
            'orders.Customer.c_mktsegment == "BUILDING"',
            "o_orderkey",
            "c_name",
        ),
        "select o.o_orderkey, c.c_name from orders o join customer c on o.o_custkey = c.c_custkey where "
        "o.o_totalprice > 300000 and c.c_mktsegment = 'BUILDING'",
    ),
    "include_many_count": (
        _include_counts,
        "select c.c_custkey, count(o.o_orderkey) as n_children from customer c left join orders o on o.o_custkey = "
        "c.c_custkey group by c.c_custkey",
    ),
    "include_nested": (
        _include_nested,
        "select c.c_custkey, count(o.o_orderkey) as n_orders, min(o.o_orderkey) as first_order from customer c left "
        "join orders o on o.o_custkey = c.c_custkey group by c.c_custkey",
    ),
    "stored_lifecycle": (
        _stored_lifecycle,
        "select * from (select o_orderkey, case when o_custkey < 100 then 'X' else o_orderstatus end as status, case "
        "when o_custkey < 100 then 'hold' end as note, 7::bigint as o_rank from orders where not (o_totalprice > "
        "400000)) where status <> 'O'",
    ),
    "stored_sorted_index": (
        indexed(
            "orders",
            BY_PRICE,
            lambda found: (
                found
                .sql('SELECT o_orderkey FROM "orders" WHERE o_totalprice >= 100000 AND o_totalprice <= 110000')
            ),
        ),
        "select o_orderkey from orders where o_totalprice >= 100000 and o_totalprice <= 110000",
    ),
    "stored_hashed_index": (
        indexed(
            "customer",
            BY_NAME,
            lambda found: (
                found.sql('SELECT DocumentID FROM "customer" WHERE c_name == "Customer#000000042"')
                .select(F.col("DocumentID").cast("long").alias("c_custkey"))
            ),
        ),
        "select c_custkey from customer where c_name = 'Customer#000000042'",
    ),
    "list_databases": (_list_databases, "select 'bench' as name"),
    "bundle_fields": (
        _bundle_fields,
        "select * from (values ('o_orderkey', 'bigint', true, true, null), ('o_custkey', 'bigint', true, false, "
        "null), ('o_orderstatus', 'string', false, false, 'P'), ('o_totalprice', 'double', false, false, null)) "
        't(field, type, required, "unique", default_value)',
    ),
    "list_indexes": (_list_indexes, 'select \'b\' as name, \'hashed\' as kind, true as "unique"'),
    "journal": (
        _journal,
        "select 'bench' as bundle, 'Database ''bench'' created successfully.' as details union all select 'orders', "
        "'Bundle ''orders'' created successfully in database ''bench''.'",
    ),
    "export_documents": (
        _export,
        'select cast(c_custkey as varchar) as "DocumentId", 4::bigint as n_fields, c_name as first_value from '
        "customer",
    ),
    "kv_lookup": (
        over(
            "lineitem",
            lambda df: (
                indexes.key_value_lookup(df, {"l_returnflag": "R", "l_linestatus": "F"})
                .select("l_orderkey", "l_linenumber")
            ),
        ),
        "select l_orderkey, l_linenumber from lineitem where l_returnflag = 'R' and l_linestatus = 'F'",
    ),
    "where_datetime": (
        command(
            "orders",
            'SELECT DOCUMENTS FROM "orders" WHERE o_orderdate >= "1995-01-01" AND o_orderdate < "1996-06-01 12:00:00"',
        ),
        "select * from orders where o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1996-06-01 "
        "12:00:00'",
    ),
    "include_child_or": (
        _include(
            'SELECT DOCUMENTS FROM "orders" INCLUDE orders.Customer WHERE o_totalprice > 400000 OR '
            'orders.Customer.c_mktsegment == "BUILDING"',
            "o_orderkey",
            "c_name",
        ),
        "select o.o_orderkey, c.c_name from orders o left join customer c on o.o_custkey = c.c_custkey where "
        "o.o_totalprice > 400000 or c.c_mktsegment = 'BUILDING'",
    ),
    "relationship_ddl": (
        _relationship_ddl,
        "select o.o_orderkey, c.c_name from orders o left join customer c on o.o_custkey = c.c_custkey where "
        "o.o_totalprice > 300000",
    ),
    "select_documents_via_btree": (
        indexed(
            "orders",
            BY_PRICE,
            lambda found: (
                found.sql(
                    'SELECT DOCUMENTS FROM "orders" WHERE o_totalprice >= 100000 AND o_totalprice <= 101000 AND (o_orderstatus =='
                    ' "F" OR o_custkey < 500)'
                ).select("o_orderkey", "o_custkey", "o_orderstatus")
            ),
        ),
        "select o_orderkey, o_custkey, o_orderstatus from orders where o_totalprice >= 100000 and o_totalprice <= "
        "101000 and (o_orderstatus = 'F' or o_custkey < 500)",
    ),
    "select_via_hindex": (
        indexed(
            "customer",
            BY_NAME,
            lambda found: (
                found.sql('SELECT DOCUMENTS FROM "customer" WHERE c_name == "Customer#000000042"')
                .select("c_custkey", "c_mktsegment")
            ),
        ),
        "select c_custkey, c_mktsegment from customer where c_name = 'Customer#000000042'",
    ),
    "index_null_second_key": (
        _index_null_second_key,
        "select o_custkey, case when o_orderkey % 3 > 0 then o_orderstatus end as o_orderstatus from orders where "
        "o_custkey < 100",
    ),
    "index_after_add": (_index_after_add, "select o_orderkey, o_custkey from orders where o_custkey = 42"),
    "bulk_add_typed": (_bulk_add_typed, "select o_orderkey, o_custkey from orders where o_custkey > 100"),
    "select_database": (_databases('SELECT DATABASES "Bench"'), "select 'bench' as name, 0::bigint as n_bundles"),
    "update_database": (
        _databases("UPDATE DATABASE bench", "SELECT DATABASES FROM DEFAULT"),
        "select 'bench' as name, 0::bigint as n_bundles",
    ),
    "delete_database": (
        _databases("CREATE DATABASE other", "DELETE DATABASE bench", "SELECT DATABASES FROM DEFAULT"),
        "select 'other' as name, 0::bigint as n_bundles",
    ),
    "delete_bundle": (
        _databases(
            'CREATE BUNDLE "a" WITH FIELDS ({"x", INT, TRUE, FALSE})',
            'CREATE BUNDLE "b" WITH FIELDS ({"x", INT, TRUE, FALSE})',
            'DELETE BUNDLE "a"',
            "SELECT DATABASES bench",
        ),
        "select 'bench' as name, 1::bigint as n_bundles",
    ),
    "bundle_delete_guard": (
        _refused(
            'CREATE BUNDLE "a" WITH FIELDS ({"x", INT, TRUE, FALSE})',
            'UPDATE BUNDLE "a" CREATE RELATIONSHIP "r" FROM BUNDLE "a" TO BUNDLE "a" WITH FIELDS ({"x", "x"})',
            'DELETE BUNDLE "a"',
        ),
        "select 'bundle ''a'' has relationships: r' as message",
    ),
    "unknown_command": (_refused("FETCH everything"), "select 'unknown command format: FETCH' as message"),
    "connection_string": (_connection_string, "select unnest(['o_orderkey', 'o_custkey']) as field"),
    "json_results": (_json_results, "select c_custkey, c_name from customer where c_mktsegment = 'BUILDING'"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for k, (q, _) in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in CATALOGUE.items()}
