"""Lexer, parser and filter semantics."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.plans import syntax as S
from docloom.plans.parser import parse, parse_filter
from docloom.plans.predicates import compile_filter
from docloom.plans.syntax import CommandError

ACCEPTED = [
    'SELECT DOCUMENTS FROM "b";',
    "select documents from b",
    'SELECT DOCUMENTS FROM BUNDLE "b" WHERE ((a == 1) AND (b == 2 OR c == 3))',
    'SELECT DOCUMENTS FROM "b" WHERE (a == 1) AND (b == 2)',
    'SELECT DOCUMENTS FROM "b" WHERE a>5',
    'SELECT DOCUMENTS FROM "b" WHERE a >= 5 AND c <= 2 AND d = 1',
    'SELECT DOCUMENTS FROM "b" WHERE a == "x y (z)"',
    'DELETE DOCUMENTS FROM BUNDLE "b" WHERE (a > 5)',
    'DELETE DOCUMENTS FROM "b" WHERE a > 5',
    'UPDATE DOCUMENTS IN BUNDLE "b" (n = "bob") WHERE (a == 1)',
    'CREATE BUNDLE "Test-Bundle-1" WITH FIELDS ({"Name", "STRING", TRUE, FALSE, "Some Value"}, {"Age", INT, TRUE, FALSE, 0}, {"Price", float, FALSE, FALSE})',
    'ADD DOCUMENT TO BUNDLE "b" WITH ({"Name"="MY FIRST"}, {"Age" = 10}, {"Price" = 5.0}, {"On" = True})',
    'CREATE B-INDEX "i" ON BUNDLE "b" WITH FIELDS ({"a", TRUE}, {"c", "STRING", FALSE, TRUE})',
    'CREATE H-INDEX "i" ON BUNDLE "b" WITH FIELDS ({"a", FALSE, TRUE})',
    'UPDATE BUNDLE "b" CHANGE FIELD "a" TO {"c", "INT", TRUE, FALSE, 0} ADD FIELD {"d", "BOOL", FALSE, FALSE} REMOVE FIELD "e"',
    'UPDATE BUNDLE "b" CREATE RELATIONSHIP "r" FROM BUNDLE "b" TO BUNDLE "c" WITH FIELDS ({"x", "y"})',
    'UPDATE BUNDLE "b" CREATE RELATIONSHIP "r" FROM BUNDLE "b" TO BUNDLE "c" WITH FIELDS ({"x", INT, TRUE, FALSE}, {"y", "INT", TRUE, TRUE})',
    'UPDATE RELATIONSHIP "r" FROM BUNDLE "b" TO BUNDLE "c" WITH FIELDS ({"x", "y"}, {"z", "w"})',
    'CREATE H-INDEX "i" ON BUNDLE "b" WITH FIELDS ({"a", FALSE}) IGNORE CASE',
    'ADD DOCUMENT TO BUNDLE "b" (a = 1, c = "x")',
    'SELECT DOCUMENTS FROM "b" WHERE a == 1 && (b == 2 || c == 3)',
    "CREATE DATABASE plain",
    "SELECT DATABASES FROM DEFAULT;",
]
REJECTED = [
    'DELETE DOCUMENTS FROM BUNDLE "b"',
    'UPDATE DOCUMENTS IN "b" (a = 1)',
    'SELECT DOCUMENTS FROM "b" WHERE a ~ 5',
    'SELECT DOCUMENTS FROM "b" WHERE (a == 1',
    'SELECT DOCUMENTS FROM "b" WHERE a == 1 )',
    'CREATE BUNDLE "b" WITH FIELDS ({"a", "NUMBER", TRUE, FALSE})',
    "FETCH everything",
    "SELECT DOCUMENTS",
    'UPDATE RELATIONSHIP "r" FROM BUNDLE "b" TO BUNDLE "c" WITH FIELDS ({"x", INT, TRUE, FALSE}, {"y", "z"})',
    'CREATE B-INDEX "i" ON BUNDLE "b" WITH FIELDS ({"a", FALSE}) IGNORE CASE',
    "",
]


@pytest.mark.parametrize("text", ACCEPTED)
def test_accepted(text):
    assert parse(text) is not None


@pytest.mark.parametrize("text", REJECTED)
def test_rejected(text):
    with pytest.raises(CommandError):
        parse(text)


def test_tree_and_literals():
    found = parse_filter('a == 1 OR b != "x" AND c < 2.5 OR d == TRUE AND e == bare')
    assert found == S.Or((S.Compare("a", "==", 1), S.And((S.Compare("b", "!=", "x"), S.Compare("c", "<", 2.5))), S.And((S.Compare("d", "==", True), S.Compare("e", "==", "bare")))))
    assert parse_filter("  ") is None
    assert parse_filter(r'a == "say \"hi\""').value == 'say "hi"'


TRUTH = [
    # type of v, v, filter, documented, compat
    ("string", "O", 'v != "F"', True, False),
    ("string", "F", 'v != "F"', False, True),
    ("string", "O", 'v > "F"', True, False),
    ("string", "F", 'v < "F"', False, True),
    ("string", "10", "v > 9", True, True),
    ("string", "abc", "v > 9", False, False),
    ("string", "abc", "v != 9", False, False),
    ("string", " 5 ", "v == 5", False, False),
    ("string", "5d", "v == 5", False, False),
    ("bigint", 10, 'v == "10"', True, True),
    ("bigint", 10, "v == 10.0", True, True),
    ("bigint", 10, "v < 10.5", True, True),
    ("bigint", 10, 'v != "x"', False, False),
    ("double", float("nan"), "v > 1", True, False),
    ("boolean", True, "v != true", False, True),
    ("boolean", False, "v != true", True, False),
    ("boolean", True, "v == 1", False, False),
    ("string", None, 'v != "F"', False, False),
    ("bigint", None, "v != 1", False, False),
    ("bigint", 1, "w != 1", False, False),
]


@pytest.mark.parametrize("kind, value, text, documented, compat", TRUTH)
def test_truth_table(spark, kind, value, text, documented, compat):
    df = spark.createDataFrame([(1, value)], f"id long, v {kind}")
    for semantics, expected in (("documented", documented), ("compat", compat)):
        assert (df.where(compile_filter(parse_filter(text), df.schema, "id", semantics)).count() == 1) is expected, semantics


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp", "date"])
def test_times_against_quoted_dates(spark, kind):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["2020-01-01", "2020-01-01 12:00:00", "2021-06-05", None])], "id long, t string").select("id", F.col("t").cast(kind).alias("t"))
    ids = lambda text, semantics="documented": sorted(r.id for r in df.where(compile_filter(parse_filter(text), df.schema, "id", semantics)).collect())
    noon = [0, 1] if kind == "date" else [0]
    assert ids('t == "2020-01-01 00:00:00"') == noon == ids('t < "2020-01-01 06:00"')
    assert ids('t >= "2020-01-02" AND t != "2021-06-06"') == [2]
    assert ids('t != "no date"') == [] == ids("t > 5") == ids('t > "2000-01-01"', "compat")


def test_or_in_both_semantics(spark):
    df = spark.createDataFrame([(1, 1, 9)], "id long, a long, b long")
    expr = parse_filter("a == 1 OR b == 2")
    assert df.where(compile_filter(expr, df.schema, "id")).count() == 1
    assert df.where(compile_filter(expr, df.schema, "id", "compat")).count() == 0


def test_open_fields_by_their_own_type(spark):
    texts = ['{"v": 10}', '{"v": 10.5}', '{"v": "10"}', '{"v": "O"}', '{"v": true}', '{"v": null}', "{}", '{"v": {"x": 1}}']
    df = spark.createDataFrame([Row(id=i, t=t) for i, t in enumerate(texts)]).select("id", F.parse_json("t").alias("extra"))
    ids = lambda text: sorted(r.id for r in df.where(compile_filter(parse_filter(text), df.schema, "id")).collect())
    assert ids("v > 9") == [0, 1, 2]
    assert ids('v == "O"') == [3]
    assert ids("v == true") == [4]
    assert ids("v != 1") == [0, 1, 2]


def _evaluate(expr, row, compat):
    """The plain meaning of a filter, None for a comparison without an answer."""
    if isinstance(expr, (S.And, S.Or)):
        parts = [_evaluate(x, row, compat) for x in expr.items]
        return any(parts) if isinstance(expr, S.Or) and not compat else all(parts)
    left, right = row.get(expr.field), expr.value
    if left is None:
        return False
    plain = isinstance(left, (str, bool)) and type(left) is type(right)
    if not plain:
        if isinstance(left, bool) or isinstance(right, bool):
            return False
        try:
            left, right = float(left), float(right)
        except ValueError:
            return False
    op = "==" if plain and compat else expr.op
    return {"==": left == right, "!=": left != right, "<": left < right, ">": left > right}[op]


def test_random_filters(spark):
    rng = random.Random(5)
    rows = [{"id": i, "s": rng.choice(["a", "b", "7", "12", None]), "n": rng.choice([1, 7, 12, None]), "b": rng.choice([True, False, None])} for i in range(60)]
    df = spark.createDataFrame([Row(**r) for r in rows], "id long, s string, n long, b boolean").cache()

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            return S.Compare(rng.choice("snbx"), rng.choice(["==", "!=", "<", ">"]), rng.choice(["a", "7", 7, 12, 7.5, True]))
        return rng.choice([S.And, S.Or])(tuple(tree(depth - 1) for _ in range(rng.randint(2, 3))))

    for _ in range(25):
        expr = tree(3)
        for semantics in ("documented", "compat"):
            got = {r.id for r in df.where(compile_filter(expr, df.schema, "id", semantics)).select("id").collect()}
            assert got == {r["id"] for r in rows if _evaluate(expr, r, semantics == "compat")}, expr


def test_pushdown_keeps_plain_comparisons(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = df.where(compile_filter(parse_filter('id > 3 AND id < "8"'), T.StructType(df.schema.fields), "id"))._jdf.queryExecution().toString()
    assert "GreaterThan(id,3)" in plan and "LessThan(id,8)" in plan
