from pyspark.sql import functions as F

from corvane.operators.packed import Codes, Parser, name_pattern, unpack, value_codes

NAMES = name_pattern(["ui/ux design", "health, safety and environment", "java", "data structures and algorithms", None])


def parse(text, codes=None):
    return Parser(NAMES, codes).parse(text)


def test_separators_and_protection():
    assert parse("java, python;sql | c++ / rust\nscala\tgo • perl") == ["java", "python", "sql", "c++", "rust", "scala", "go", "perl"]
    assert parse("a and b & c, R&D planning, sand and") == ["a", "b", "c", "R&D planning", "sand and"]
    assert parse("UI/UX Design/java, Health, Safety and Environment") == ["UI/UX Design", "java", "Health, Safety and Environment"]
    assert parse("excel (incl. setup, support), x") == ["excel (incl. setup, support)", "x"]


def test_quotes_marks_and_brackets():
    assert parse('"a, b", "care ""planning""", """x"" y"') == ["a, b", 'care "planning"', '"x" y']
    assert parse('["one", "two; three"]') == ["one", "two; three"]
    assert parse("- one\n- two\n* three\n1. four\n• five") == ["one", "two", "three", "four", "five"]
    assert parse("node.js [core], (java)") == ["node.js [core]", "java"]
    assert parse('5" disk, driver\'s license') == ['5" disk', "driver's license"]


def test_nothing_and_repeats():
    assert parse(None) == [] and parse("") == [] and parse(" , ;") == []
    assert parse("java, java,, java ") == ["java"] * 3
    assert len(parse(", ".join(["java"] * 20_000))) == 20_000


def test_code_lengths_follow_the_column(spark):
    df = spark.createDataFrame([("a, b",), ("a",), ("A; c",), (None,), ("",)], "x string")
    codes = value_codes(df, {"x": ""})["x"]
    assert codes.values.keys() == {"a", "b", "c"} and abs(codes.values["a"] - 0.7369655941662062) < 1e-9
    assert codes.rare > 3 and codes.literal > 3


def test_the_code_table_decides():
    names = name_pattern(["data and structures"])
    frequent = {"data and structures": 5.0, "data": 20.0, "structures": 20.0}
    assert Parser(names, Codes(frequent)).parse("data and structures, x") == ["data and structures", "x"]
    assert Parser(names, Codes({"data and structures": 20.0, "data": 4.0, "structures": 4.0})).parse("data and structures, x") == ["data", "structures", "x"]
    assert Parser("", Codes({"a/b": 2.0}, 8, 4)).parse("a/b") == ["a/b"] and Parser("", Codes({"a": 2.0, "b": 2.0}, 8, 4)).parse("a/b") == ["a", "b"]
    quoted = '"ui/ux designer (12 months, hybrid)"'
    assert Parser("").parse(quoted) == [quoted[1:-1]]


def test_unpack_positions_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([("1", "a, b", "item"), ("2", None, "x"), ("3", "c", None)], "id string, f string, item string")
    rows = {(r.record_id, r.pos, r.item) for r in unpack(df, "id", {"f": ""}).collect()}
    assert rows == {("1", 1, "a"), ("1", 2, "b"), ("3", 1, "c")}
    assert unpack(df.where(F.lit(False)), "id", {"f": ""}).count() == 0
