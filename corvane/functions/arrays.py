"""Array, map and JSON functions as Column expressions. Order is kept everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import vocab as V
from corvane.functions.text import empty, squash, squash_lower


def ci_dedup(xs: Column) -> Column:
    """Without blanks and repeats in any casing; the first casing stays."""
    clean = F.filter(F.transform(xs, squash), lambda x: x != "")
    lowered = F.transform(clean, F.lower)
    return F.filter(clean, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


def split_commas(x: Column) -> Column:
    return ci_dedup(F.split(empty(x), ","))


def split_lower(x: Column) -> Column:
    """Comma-separated values, lower-cased, without blanks and repeats."""
    return F.array_distinct(split_keep(x))


def split_keep(x: Column) -> Column:
    """Comma-separated values, lower-cased, without blanks; repeats stay."""
    return F.filter(F.transform(F.split(empty(x), ","), squash_lower), lambda v: v != "")


def json_list(x: Column) -> Column:
    """Items of a JSON list of strings; what is no list is one item; without repeats in any casing."""
    y = squash(x)
    return ci_dedup(F.when(y == "", F.array().cast("array<string>")).otherwise(F.coalesce(F.from_json(y, "array<string>"), F.array(y))))


def list_field(x: Column) -> Column:
    """Items of a list in JSON or quoted by single quotes, else of comma-separated values; lower-cased, without blanks; repeats stay."""
    y = squash(x)
    listed = F.filter(F.transform(F.from_json(y, "array<string>"), squash_lower), lambda v: v != "")
    return F.when(F.lower(y).isin("", "nan", "[]"), F.array().cast("array<string>")).otherwise(F.coalesce(listed, split_keep(x)))


def json_dict(x: Column) -> Column:
    """A JSON object as a map of texts; anything else is an empty map."""
    return F.coalesce(F.from_json(x, "map<string,string>"), F.create_map().cast("map<string,string>"))


def metadata_skills(x: Column) -> Column:
    """The list `skills` of a metadata object, lower-cased, without blanks; empty where there is none."""
    return F.coalesce(F.filter(F.transform(F.from_json(x, "skills array<string>")["skills"], squash_lower), lambda v: v != ""), F.array().cast("array<string>"))


def optional_float(x: Column) -> Column:
    return F.nullif(squash(x), F.lit("")).try_cast("double")


def first_number(*xs: Column) -> Column:
    """The first of the texts that is a number."""
    return F.coalesce(*[optional_float(x) for x in xs])


def merge_unique(base: Column, extra: Column) -> Column:
    """base as it is, then the items of extra that base does not hold in any casing."""
    return F.concat(base, F.filter(ci_dedup(extra), lambda x: ~F.array_contains(F.transform(base, F.lower), F.lower(x))))


def short(xs: Column, most: int = 80) -> Column:
    return F.filter(xs, lambda x: F.length(x) <= most)


def skill_levels(x: Column) -> Column:
    """array of struct(skill, level) from 'Skill (Level), ...'; level 'unknown' where none is given."""

    def one(item: Column) -> Column:
        pattern = r"^(.+?)\s*\((.+?)\)"
        skill = F.when(item.rlike(pattern), F.regexp_extract(item, pattern, 1)).otherwise(item)
        level = F.when(item.rlike(pattern), F.regexp_extract(item, pattern, 2)).otherwise(F.lit("unknown"))
        return F.struct(squash_lower(skill).alias("skill"), squash_lower(level).alias("level"))

    return F.transform(F.filter(F.transform(F.split(empty(x), ","), squash), lambda v: v != ""), one)


def first_wins(pairs: Column) -> Column:
    """Map of struct(key, value) pairs where the first pair of a key counts."""
    keys = F.transform(pairs, lambda p: p["key"])
    return F.map_from_entries(F.filter(pairs, lambda p, i: F.array_position(keys, p["key"]) == i + 1))


def last_wins(pairs: Column) -> Column:
    return first_wins(F.reverse(pairs))


def first_present(*xs: Column) -> Column:
    return F.coalesce(*[F.when(squash(x) != "", x) for x in xs])


def has_any(text: Column, words: list[str]) -> Column:
    """Whether any of the literal words stands in the text: one alternation, one pass."""
    import re

    return text.rlike("|".join(re.escape(w) for w in words))


def bullet_class(x: Column, section: str = "skills") -> Column:
    """Class of a bullet: the first of the keyword lists that hits, else by section."""
    y = F.lower(x)
    out = F.lit("preferred_skill" if section == "other" else "must_have_skill")
    for kind, words in reversed(V.BULLET_KEYWORDS.items()):
        hit = has_any(y, words)
        if kind == "technology":
            hit = hit | y.rlike(r"\b(?:" + "|".join(V.TECHNOLOGY_WORDS) + r")\b")
        out = F.when(hit, F.lit(kind)).otherwise(out)
    return out


def entity_class(name: Column, category: Column | None = None) -> Column:
    """Ontology type of an entity name."""
    cat = F.lit("") if category is None else squash_lower(category)
    # bound once in a lambda, so that the normalised name is not repeated in every branch of the plan
    return F.transform(F.array(squash_lower(name)), lambda x: _entity_class(x, cat))[0]


def _entity_class(x: Column, cat: Column) -> Column:
    T = V.TERMS
    return (
        F.when(x.isin(T["ProgrammingLanguage"]), "ProgrammingLanguage")
        .when(x.isin(T["Framework"]), "Framework")
        .when(x.isin(T["Database"]), "Database")
        .when(x.isin(T["CloudPlatform"]), "CloudPlatform")
        .when(x.isin(T["Tool"]), "Tool")
        .when(x.isin(T["Certification"]) | has_any(x, ["certification", "certified"]), "Certification")
        .when(x.isin(T["SoftSkill"]) | (cat == "soft"), "SoftSkill")
        .when(x.isin(T["Role"]) | has_any(x, V.ROLE_WORDS), "Role")
        .when(has_any(x, V.EDUCATION_WORDS), "Education")
        .when(cat == "tool", "Tool")
        .otherwise("Skill")
    )
