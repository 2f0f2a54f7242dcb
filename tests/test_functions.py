import pytest
from pyspark.sql import functions as F

from corvane.functions import arrays as A
from corvane.functions import text as X


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "f, given, wanted",
    [
        (X.squash, " A \n b ", "A b"), (X.squash_lower, None, ""), (X.clean_scalar, "a\r\n\n\n\n b\t\tc ", "a\n\n b c"), (X.identifier, "12.0", "12"),
        (X.bullet, "- **Bold** _x_", "Bold x"), (X.section_type, "## Key Responsibilities:", "responsibilities"), (X.section_type, "hello", None),
        (X.truncate, "x" * 600, "x" * 497 + "..."), (X.unfence, "```json\n{}\n```", "{}"), (X.years, "3.7", 3), (X.years, "many", 0), (X.years, None, 0), (X.words, " a  b ", 2),
        (X.parse_bool, " Yes ", True), (X.parse_bool, None, None), (X.parse_bool, "0", False),
    ],
)
def test_text(spark, f, given, wanted):
    assert one(spark, given, f) == wanted


def test_tokens_and_locations(spark):
    assert one(spark, "C++/C# node.js Éa", X.tokens) == ["c++", "c#", "node.js", "a"]
    assert tuple(one(spark, " Pune , India, x", X.location)) == ("Pune", "India") and tuple(one(spark, "n/a", X.location)) == ("", "")
    assert one(spark, "must have:", X.is_sub_header) and not one(spark, "python and sql", X.is_sub_header)


def test_arrays(spark):
    assert one(spark, "Java, java ,,SQL", A.split_commas) == ["Java", "SQL"]
    assert one(spark, '["A","a","b"]', A.json_list) == ["A", "b"] and one(spark, "plain", A.json_list) == ["plain"] and one(spark, None, A.json_list) == []
    assert [tuple(r) for r in one(spark, "Python (Expert), SQL", A.skill_levels)] == [("python", "expert"), ("sql", "unknown")]
    assert one(spark, "x", lambda c: A.merge_unique(F.array(F.lit("A"), F.lit("A")), F.array(F.lit("a"), F.lit("b")))) == ["A", "A", "b"]
    pairs = lambda c: F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (("a", 1), ("b", 2), ("a", 3))])
    assert one(spark, "x", lambda c: A.first_wins(pairs(c))) == {"a": 1, "b": 2} and one(spark, "x", lambda c: A.last_wins(pairs(c))) == {"a": 3, "b": 2}


@pytest.mark.parametrize("item, kind", [("AWS Certified", "certification"), ("a degree", "education"), ("5 years", "experience"), ("Teamwork", "soft_skill"), ("trust", "technology"), ("r", "technology"), ("digital", "tool"), ("optional", "preferred_skill"), ("welding", "must_have_skill")])
def test_bullet_class(spark, item, kind):
    assert one(spark, item, A.bullet_class) == kind


@pytest.mark.parametrize("name, kind", [("Python", "ProgrammingLanguage"), ("scrum master", "Certification"), ("team leadership", "Role"), ("leadership", "SoftSkill"), ("master of arts", "Education"), ("", "Skill")])
def test_entity_class(spark, name, kind):
    assert one(spark, name, A.entity_class) == kind
