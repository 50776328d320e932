"""Commands end to end: stored databases, DML, DDL, rules, indexes and relationships."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.engine import Engine, parse_connection
from docloom.functions.types import FieldDef
from docloom.operators import constraints, indexes, relationships
from docloom.plans import syntax as S
from docloom.plans.syntax import CommandError

BUNDLE = 'CREATE BUNDLE "Products" WITH FIELDS ({"Name", "STRING", TRUE, TRUE}, {"Age", "INT", TRUE, FALSE, 3}, {"Price", "FLOAT", FALSE, FALSE, 0.0}, {"On", "BOOL", FALSE, FALSE})'


@pytest.fixture
def shop(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "dbs"), journal=True)
    assert engine.execute('CREATE DATABASE "Shop";').message == "Database 'Shop' created successfully."
    engine.connect("dl://localhost:1:shop:u:p")
    engine.execute(BUNDLE)
    for name, age in (("a", 1), ("b", 2), ("c", 2)):
        engine.execute(f'ADD DOCUMENT TO BUNDLE "Products" WITH ({{"Name" = "{name}"}}, {{"Age" = {age}}})')
    return engine


def values(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_databases(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "dbs"))
    engine.execute("CREATE DATABASE one")
    for bad in ("CREATE DATABASE one", "CREATE DATABASE ONE", 'CREATE DATABASE "9x"', "DELETE DATABASE two"):
        with pytest.raises(CommandError):
            engine.execute(bad)
    engine.execute("UPDATE DATABASE one")
    assert engine.execute("SELECT DATABASES FROM DEFAULT").result_count == 1
    assert engine.execute('SELECT DATABASES "One"').result_count == 1
    engine.execute("DELETE DATABASE one")
    assert engine.execute("SELECT DATABASES FROM DEFAULT").result_count == 0
    with pytest.raises(CommandError):
        parse_connection("nothing")


def test_add_select_update_delete(shop):
    assert values(shop.sql('SELECT Name, Age FROM "Products"'), "Name", "Age") == [("a", 1), ("b", 2), ("c", 2)]
    assert len({r.DocumentID for r in shop.sql('SELECT DOCUMENTS FROM "Products"').collect()}) == 3
    shop.execute('UPDATE DOCUMENTS IN "Products" (Age = 9, Note = "new") WHERE Name != "a"')
    assert values(shop.sql('SELECT Name, Age, Note FROM "Products"').fillna("-"), "Name", "Age", "Note") == [("a", 1, "-"), ("b", 9, "new"), ("c", 9, "new")]
    shop.execute('DELETE DOCUMENTS FROM "Products" WHERE Age > 5 AND Name == "b"')
    assert values(shop.sql('SELECT Name FROM "Products" WHERE Note == "new"'), "Name") == [("c",)]
    with pytest.raises(CommandError):
        shop.execute('UPDATE DOCUMENTS IN "Products" (Age = "old") WHERE Name == "a"')
    assert shop.journal.read().count() >= 5


def test_rules(shop):
    for bad in ('WITH ({"Name" = "a"})', 'WITH ({"Age" = 4})', 'WITH ({"Name" = 5})', 'WITH ({"Name" = "z"}, {"Age" = 1.5})'):
        with pytest.raises(CommandError):
            shop.execute(f'ADD DOCUMENT TO BUNDLE "Products" {bad}')
    shop.execute('ADD DOCUMENT TO BUNDLE "Products" WITH ({"Name" = "d"})')
    assert values(shop.sql('SELECT Age FROM "Products" WHERE Name == "d"'), "Age") == [(3,)]
    fields = {r.field: r for r in shop.bundle_fields("Products").collect()}
    assert fields["Name"].unique and fields["Age"].default_value == "3"


def test_alter(shop):
    shop.execute('UPDATE BUNDLE "Products" ADD FIELD {"Rank", "INT", TRUE, FALSE, 7} REMOVE FIELD "On" CHANGE FIELD "Age" TO {"Years", "FLOAT", FALSE, FALSE}')
    assert values(shop.sql('SELECT Years, Rank FROM "Products" WHERE Name == "b"'), "Years", "Rank") == [(2.0, 7)]
    for bad in ('ADD FIELD {"Rank", "INT", TRUE, FALSE, 7}', 'REMOVE FIELD "On"', 'CHANGE FIELD "Age" TO {"x", "INT", FALSE, FALSE}'):
        with pytest.raises(CommandError):
            shop.execute(f'UPDATE BUNDLE "Products" {bad}')


def test_relationships_and_delete_guard(shop):
    shop.execute('CREATE BUNDLE "Sales" WITH FIELDS ({"Product", "STRING", TRUE, FALSE}, {"N", "INT", TRUE, FALSE})')
    shop.execute('ADD DOCUMENT TO BUNDLE "Sales" WITH ({"Product" = "a"}, {"N" = 4})')
    shop.execute('UPDATE BUNDLE "Products" CREATE RELATIONSHIP "Sold" FROM BUNDLE "Products" TO BUNDLE "Sales" WITH FIELDS ({"Name", "Product"})')
    assert values(shop.sql('SELECT Name, N FROM "Products" INCLUDE Products.Sold').fillna(0), "Name", "N") == [("a", 4), ("b", 0), ("c", 0)]
    assert values(shop.sql('SELECT Name FROM "Products" INCLUDE Products.Sold WHERE Products.Sold.N > 3'), "Name") == [("a",)]
    with pytest.raises(CommandError):
        shop.execute('DELETE BUNDLE "Sales"')
    shop.execute('UPDATE BUNDLE "Products" DELETE RELATIONSHIP "Sold"')
    shop.execute('DELETE BUNDLE "Sales"')
    with pytest.raises(CommandError):
        shop.sql('SELECT DOCUMENTS FROM "Sales"')


def scanned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_indexes(shop):
    shop.execute('CREATE B-INDEX "by_age" ON BUNDLE "Products" WITH FIELDS ({"Age", FALSE}, {"Name", FALSE})')
    shop.execute('CREATE H-INDEX "by_name" ON BUNDLE "Products" WITH FIELDS ({"Name", TRUE})')
    assert shop.list_indexes("Products").count() == 2
    with pytest.raises(CommandError):
        shop.execute('CREATE H-INDEX "u" ON BUNDLE "Products" WITH FIELDS ({"Age", TRUE})')
    covered = shop.sql('SELECT Name FROM "Products" WHERE Age == 2')
    assert "/index-" in covered.inputFiles()[0] and values(covered, "Name") == [("b",), ("c",)]
    assert values(indexes.between(shop.index("Products", "by_age"), "Age", 2, None), "Name") == [("b",), ("c",)]
    shop.drop_index("Products", "by_name")
    shop.execute('DELETE DOCUMENTS FROM "Products" WHERE Name == "b"')  # a rewrite drops stale layouts
    assert shop.list_indexes("Products").count() == 0
    assert values(shop.sql('SELECT Name FROM "Products" WHERE Age == 2'), "Name") == [("c",)]


def test_an_index_changes_no_answer(spark, shop):
    """Selects of all fields and of some, before and after an index, with nulls in its second key and documents added later."""
    rows = [(f"n{i}", i % 7 if i % 5 else None, None if i % 3 else i / 2, i % 2 == 0) for i in range(80)]
    shop.execute('CREATE BUNDLE "Things" WITH FIELDS ({"Name", STRING, TRUE, FALSE}, {"Age", INT, FALSE, FALSE}, {"Price", FLOAT, FALSE, FALSE}, {"On", BOOL, FALSE, FALSE})')
    kind = "Name string, Age long, Price double, On boolean"
    shop.add_documents("Things", spark.createDataFrame(rows[:50], kind).repartition(3))
    asked = ["Age == 2", "Age == 2 AND Price > 3", "Age > 3 AND (On == TRUE OR Name == \"n7\")", 'Name == "n7"', 'Name == "n7" OR Age == 2', "Price == 6", 'Age == "2"', "On == TRUE", "Age != 3"]
    selects = [f'SELECT {what} FROM "Things" WHERE {where}' for where in asked for what in ("DOCUMENTS", "Age, Price", "Name", "Age")]

    def answers():
        return [sorted(repr(r) for r in shop.sql(text).drop("DocumentID", "CreatedAt", "UpdatedAt").collect()) for text in selects]

    plain = answers()
    for k, index in enumerate(('B-INDEX "i" ON BUNDLE "Things" WITH FIELDS ({"Age", FALSE}, {"Price", FALSE})', 'H-INDEX "h" ON BUNDLE "Things" WITH FIELDS ({"Name", FALSE})', 'H-INDEX "b" ON BUNDLE "Things" WITH FIELDS ({"On", FALSE})')):
        shop.execute("CREATE " + index)
        assert answers() == plain
    shop.add_documents("Things", spark.createDataFrame(rows[50:], kind))
    assert len(shop.list_indexes("Things").collect()) == 3
    grown = answers()
    assert grown != plain
    shop.refresh_index("Things", "i").refresh_index("Things", "h")
    assert answers() == grown
    shop.compact("Things")
    assert shop.list_indexes("Things").count() == 0 and answers() == grown
    assert shop.vacuum("Things") >= 5 and shop.vacuum("Things") == 0 and answers() == grown


def test_a_hashed_lookup_reads_one_bucket(spark, shop, monkeypatch):
    shop.execute('CREATE BUNDLE "Names" WITH FIELDS ({"Name", STRING, TRUE, FALSE}, {"N", INT, TRUE, FALSE})')
    rows = spark.range(2000).selectExpr("if(id % 3 = 0, 'Hot', concat('k', id)) as Name", "id as N")
    shop.add_documents("Names", rows.repartition(6))
    monkeypatch.setattr(indexes, "ROWS_PER_BUCKET", 100)
    shop.execute('CREATE H-INDEX "h" ON BUNDLE "Names" WITH FIELDS ({"Name", FALSE}) IGNORE CASE')
    assert shop._index_entry("Names", "h")["buckets"] == 20
    rows = shop._layout_rows("Names", shop._index_entry("Names", "h"), S.Compare("Name", "==", "k7"))
    assert "PartitionFilters: [isnotnull(_bucket" in scanned(rows) and rows.select("_bucket").distinct().count() == 1
    found = shop.sql('SELECT DOCUMENTS FROM "Names" WHERE Name == "k7"')
    assert len(found.inputFiles()) == 1 and values(found, "N") == [(7,)]  # one of six data files
    assert shop.sql('SELECT DOCUMENTS FROM "Names" WHERE Name == "K7"').count() == 0
    assert values(shop.lookup("Names", "h", "K7"), "N") == [(7,)] and shop.lookup("Names", "h", "hot").count() == 667
    shop.add_documents("Names", spark.createDataFrame([("K7", -1)], "Name string, N long"))
    assert values(shop.lookup("Names", "h", "k7"), "N") == [(-1,), (7,)]
    with pytest.raises(CommandError):
        shop.lookup_between("Names", "h", ["a"], ["b"])


def test_two_writers_lose_nothing(spark, shop):
    other = Engine(spark, shop.store.root).connect("Shop")
    shop.execute('CREATE BUNDLE "One" WITH FIELDS ({"x", INT, TRUE, FALSE})')
    other.execute('CREATE BUNDLE "Two" WITH FIELDS ({"x", INT, TRUE, FALSE})')
    shop.execute('ADD DOCUMENT TO BUNDLE "Two" WITH ({"x" = 1})')
    assert other.sql('SELECT DOCUMENTS FROM "Two"').count() == 1
    assert set(shop.database.manifest["bundles"]) == {"Products", "One", "Two"}
    held = shop.sql('SELECT DOCUMENTS FROM "Two"')
    stale = Engine(spark, shop.store.root).connect("Shop").database
    other.execute('ADD DOCUMENT TO BUNDLE "Two" (x = 2)')
    with pytest.raises(CommandError, match="another writer"):
        stale.create_bundle("Three", [])
    assert held.count() == 1 and shop.sql('SELECT DOCUMENTS FROM "Two"').count() == 2  # a reader keeps the state it began with


def test_ids_are_unique(spark, shop):
    shop.add_documents("Products", spark.createDataFrame([("x1", "d"), (None, "e")], "DocumentID string, Name string"))
    for rows in ([("x1", "f")], [("x2", "f"), ("x2", "g")]):
        with pytest.raises(CommandError, match="DocumentID"):
            shop.add_documents("Products", spark.createDataFrame(rows, "DocumentID string, Name string"))
    assert shop.sql('SELECT DOCUMENTS FROM "Products"').count() == 5


def test_field_changes_write_no_data_and_updates_only_files_with_matches(spark, shop):
    before = [p["path"] for p in shop.database.bundle("Products")["parts"]]
    shop.execute('UPDATE BUNDLE "Products" CHANGE FIELD "Name" TO {"Title", STRING, TRUE, FALSE} ADD FIELD {"Rank", INT, TRUE, FALSE, 7} REMOVE FIELD "Age"')
    shop.execute('UPDATE BUNDLE "Products" ADD FIELD {"Name", STRING, FALSE, FALSE, "none"} CHANGE FIELD "Rank" TO {"Place", INT, FALSE, FALSE}')
    shop.execute('UPDATE BUNDLE "Products" ADD FIELD {"Age", INT, FALSE, FALSE}')
    assert [p["path"] for p in shop.database.bundle("Products")["parts"]] == before
    rows = shop.sql('SELECT DOCUMENTS FROM "Products" WHERE Place == 7')
    assert values(rows, "Title", "Name", "Place", "Age") == [(x, "none", 7, None) for x in "abc"]
    shop.execute('ADD DOCUMENT TO BUNDLE "Products" (Title = "d", Name = "n", Age = 4)')
    shop.execute('UPDATE DOCUMENTS IN "Products" (Place = 1, Extra = "e") WHERE Title == "b"')
    parts = [p["path"] for p in shop.database.bundle("Products")["parts"]]
    assert len(parts) == 4 and len(set(parts) & set(before)) == 2
    assert values(shop.sql('SELECT Title, Name, Place, Extra FROM "Products"').fillna({"Place": 0, "Extra": "-"}), "Title", "Name", "Place", "Extra") == [("a", "none", 7, "-"), ("b", "none", 1, "e"), ("c", "none", 7, "-"), ("d", "n", 0, "-")]
    shop.execute('UPDATE BUNDLE "Products" REMOVE FIELD "Title"')
    shop.execute('UPDATE DOCUMENTS IN "Products" (Title = "new") WHERE Place == 1')  # the old texts do not come back
    assert values(shop.sql('SELECT Title, Place FROM "Products"').fillna({"Place": 0, "Title": "-"}), "Title", "Place") == [("-", 0), ("-", 7), ("-", 7), ("new", 1)]
    revision = shop.database.manifest["revision"]
    shop.execute('DELETE DOCUMENTS FROM "Products" WHERE Place == 99')  # no match, nothing written
    assert shop.database.manifest["revision"] == revision


def test_updates_rewrite_one_file_of_a_part(spark, shop):
    shop.execute('CREATE BUNDLE "Many" WITH FIELDS ({"x", INT, TRUE, FALSE})')
    shop.add_documents("Many", spark.range(100).selectExpr("id as x").repartitionByRange(5, "x"))
    shop.execute('UPDATE DOCUMENTS IN "Many" (x = 1000) WHERE x == 3')
    first, second = shop.database.bundle("Many")["parts"]
    assert len(first["files"]) == 4 and second["files"] is None
    shop.execute('DELETE DOCUMENTS FROM "Many" WHERE x < 30 OR x == 1000')
    assert sorted(r.x for r in shop.sql('SELECT x FROM "Many"').collect()) == list(range(30, 100))


def test_include_with_or_and_relationship_ddl(spark, shop):
    shop.execute('CREATE BUNDLE "Sales" WITH FIELDS ({"Product", STRING, TRUE, FALSE}, {"Age", INT, TRUE, FALSE})')
    for name, age in (("a", 50), ("b", 60)):
        shop.execute(f'ADD DOCUMENT TO BUNDLE "Sales" WITH ({{"Product" = "{name}"}}, {{"Age" = {age}}})')
    ends = 'FROM BUNDLE "Products" TO BUNDLE "Sales" WITH FIELDS'
    with pytest.raises(CommandError):
        shop.execute(f'UPDATE RELATIONSHIP "Sold" {ends} ({{"Name", "Product"}})')
    for bad in ('({"Name", INT, TRUE, TRUE}, {"Product", STRING, TRUE, FALSE})', '({"Name", STRING, TRUE, TRUE})', '({"Name", "Lacking"})'):
        with pytest.raises(CommandError):
            shop.execute(f'UPDATE BUNDLE "Products" CREATE RELATIONSHIP "Sold" {ends} {bad}')
    shop.execute(f'UPDATE BUNDLE "Products" CREATE RELATIONSHIP "Sold" {ends} ({{"Age", "Age"}})')
    shop.execute(f'UPDATE RELATIONSHIP "Sold" {ends} ({{"Name", STRING, TRUE, TRUE}}, {{"Product", STRING, TRUE, FALSE}})')
    select = 'SELECT Name FROM "Products" INCLUDE Products.Sold WHERE '
    assert values(shop.sql(select + "Age == 2 OR Products.Sold.Age == 50"), "Name") == [("a",), ("b",), ("c",)]
    assert values(shop.sql(select + 'Name == "c" OR (Products.Sold.Age > 55 && Age == 2)'), "Name") == [("b",), ("c",)]
    assert values(shop.sql(select + "Age == 2 AND (Products.Sold.Age == 50 || Products.Sold.Age == 60)"), "Name") == [("b",)]
    shop.semantics = "compat"  # OR acts as AND
    assert values(shop.sql(select + "Age == 2 OR Products.Sold.Age == 60"), "Name") == [("b",)]


def test_delete_keeps_nulls_and_laws_hold(spark):
    df = spark.createDataFrame([(1, "F"), (2, None), (3, "O")], "id long, s string")
    engine = Engine(spark).register_bundle("t", df, "id")
    kept = values(engine.sql('SELECT DOCUMENTS FROM "t" WHERE s == "F"'), "id")
    assert values(engine.sql('DELETE DOCUMENTS FROM "t" WHERE s == "F"'), "id") == [(2,), (3,)]
    assert kept == [(1,)] and engine.execute('SELECT DOCUMENTS FROM "t"').result_count == 2


def test_compat_updates_keep_the_written_text(spark):
    engine = Engine(spark, semantics="compat").register_bundle("t", spark.createDataFrame([(1, 5), (2, 6)], "id long, n long"), "id")
    assert values(engine.sql('UPDATE DOCUMENTS IN "t" (n = "x", m = 7) WHERE id == 2').fillna("-"), "n", "m") == [('"x"', "7"), ("5", "-")]


def test_compat_update_of_a_stored_bundle(shop):
    shop.semantics = "compat"
    shop.execute('UPDATE DOCUMENTS IN "Products" (Age = 40) WHERE Name == "a"')
    assert values(shop.sql('SELECT Age FROM "Products"'), "Age") == [("2",), ("2",), ("40",)]


def test_export_and_json(spark):
    engine = Engine(spark).register_bundle("t", spark.createDataFrame([(1, 5)], "id long, n long"), "id")
    row = engine.cache_bundle("t").export_documents("t").first()
    assert (row.DocumentId, row.Fields[0].Name, row.Fields[0].Value) == ("1", "n", "5")
    assert engine.uncache_bundle("t").execute('SELECT DOCUMENTS FROM "t"').to_json().first().document == '{"id":1,"n":5}'


def test_lookups(spark):
    df = spark.createDataFrame([(1, 1, "A"), (2, 1, "a"), (3, 2, "b"), (4, -5, "c"), (5, None, None)], "id long, k long, s string")
    assert [r.tid for r in indexes.numbered(df, ["k"], "id").orderBy("k", "doc_id").collect()] == [1, 2, 3, 4]
    assert values(indexes.hash_lookup(df, "s", "A", True), "id") == [(1,), (2,)]
    assert values(indexes.hash_duplicates(df, "k"), "k", "n") == [(1, 2)]
    assert values(indexes.unique_keys(df, ["k"], "id"), "k", "doc_id") == [(-5, 4), (1, 1), (2, 3)]
    assert values(indexes.composite_between(df, ["k", "id"], [1, 2], [2, 3]), "id") == [(2,), (3,)]
    assert values(indexes.hashed_copy(df, "s", ["id"], 4).where(indexes.bucket_of(F.lit("b"), T.StringType(), 4) == F.col("_bucket")).where("s = 'b'"), "id") == [(3,)]
    assert [indexes.bucket_count(n) for n in (0, 10**6, 10**7, 10**12)] == [8, 8, 40, 100_000]
    assert values(constraints.mistyped(spark.createDataFrame([("1",), ("x",)], "v string"), [FieldDef("v", "INT")]), "v") == [("x",)]


def test_nested_children(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id long")
    children = spark.createDataFrame([(10, 1), (11, 1), (12, 9)], "cid long, pid long")
    rel = relationships.Relationship("Kids", "p", "c", (("id", "pid"),))
    found = {r.id: sorted(k.cid for k in r.Kids) for r in relationships.include_nested(parents, children, rel, ["cid"]).collect()}
    assert found == {1: [10, 11], 2: []}
    assert values(relationships.child_counts(parents, children, rel), "id", "n_children") == [(1, 2), (2, 0)]


def test_stream_feeds_a_bundle(spark, shop, tmp_path):
    from docloom.streaming import append_stream

    spark.createDataFrame([("s1", 5), ("s2", 6)], "Name string, Age long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("Name string, Age long").parquet(str(tmp_path / "in"))
    query = append_stream(shop, "Products", stream, str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    assert values(shop.sql('SELECT Name FROM "Products" WHERE Age > 4'), "Name") == [("s1",), ("s2",)]


def test_rules_hold_on_updates_and_bulk_writes(spark, shop):
    for bad in ('UPDATE DOCUMENTS IN "Products" (Name = "z") WHERE Age == 2', 'UPDATE BUNDLE "Products" ADD FIELD {"Code", "STRING", TRUE, TRUE, "x"}', 'UPDATE BUNDLE "Products" CHANGE FIELD "Age" TO {"Age", "INT", TRUE, TRUE}'):
        with pytest.raises(CommandError):
            shop.execute(bad)
    with pytest.raises(CommandError):
        shop.add_documents("Products", spark.createDataFrame([("d", "old")], "Name string, Age string"))
    shop.add_documents("Products", spark.createDataFrame([("d", "4")], "Name string, Age string"))
    assert values(shop.sql('SELECT Name, Age FROM "Products"'), "Name", "Age") == [("a", 1), ("b", 2), ("c", 2), ("d", 4)]
