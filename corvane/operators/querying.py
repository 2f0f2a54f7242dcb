"""Typed queries: rule-based understanding, seeds, expanded text, and the generated benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.functions import vocab as V
from corvane.session import local_table


def benchmark(spark: SparkSession) -> DataFrame:
    """(query_id, query, intent, source, entities, keywords): seeds times modifiers, the first BENCHMARK_SIZE."""
    seeds = local_table(spark, [(i, a, b, c) for i, (a, b, c) in enumerate(V.BENCHMARK_SEEDS)], "s int, intent string, seed string, ents array<string>")
    mods = local_table(spark, list(enumerate(V.BENCHMARK_MODIFIERS)), "m int, modifier string")
    n = F.col("s") * len(V.BENCHMARK_MODIFIERS) + F.col("m") + 1
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    source = F.create_map(*[F.lit(x) for kv in V.INTENT_SOURCE.items() for x in kv])
    # a 15 x 10 product of two fixed lists
    return (
        seeds.join(mods)
        .where(n <= V.BENCHMARK_SIZE)
        .select(
            F.format_string("Q%03d", n.cast("int")).alias("query_id"),
            X.squash_lower(F.concat_ws(" ", "modifier", "seed")).alias("query"),
            "intent",
            source[F.col("intent")].alias("source"),
            F.array_distinct(F.concat("ents", words(F.col("modifier")))).alias("entities"),
            F.array_distinct(F.concat("ents", F.slice(words(F.col("seed")), 1, 3))).alias("keywords"),
        )
    )


def understand(queries: DataFrame) -> DataFrame:
    """Rule-based reading of `query`: skills (long ones first, then by name), partitions, role, city, country, intent.

    Skills are substrings, as typed queries need them; the earliest city counts, of several at one place the first by name.
    """
    q = F.lower(F.col("query"))
    ordered = sorted(V.QUERY_SKILLS, key=lambda s: (-len(s), s))
    skills = F.filter(F.array(*[F.lit(s) for s in ordered]), lambda s: F.contains(q, s))
    among = lambda xs: F.filter(F.col("skills"), lambda s: s.isin(xs))
    role = F.lit(None).cast("string")
    for word in reversed(V.QUERY_ROLES):
        hit = F.regexp_extract(q, rf"([a-z ]+\b{word})", 1)
        last = F.slice(F.filter(F.split(hit, " +"), lambda w: w != ""), -4, 4)
        few = F.filter(F.split(hit, " +"), lambda w: w != "")
        role = F.when(hit != "", F.array_join(F.when(F.size(few) > 4, last).otherwise(few), " ")).otherwise(role)
    city = F.regexp_extract(q, r"\b(" + "|".join(sorted(V.QUERY_CITIES)) + r")\b", 1)
    city = F.when(city == "", F.lit(None)).when(city == "bangalore", "bengaluru").otherwise(city)
    has = lambda words: q.rlike("|".join(words))
    intent = F.when(has(V.PROFILE_WORDS), "profile_search").when(has(V.JOB_WORDS), F.when(has(["jd", "description"]), "jd_search").otherwise("job_search")).otherwise("profile_search")
    out = queries.withColumn("skills", skills)
    out = out.withColumn("languages", among(V.QUERY_LANGUAGES)).withColumn("frameworks", among(V.QUERY_FRAMEWORKS)).withColumn("tools", among(V.QUERY_TOOLS))
    rest = F.array_except(F.array_except(F.array_except("skills", "languages"), "frameworks"), "tools")
    return (
        out.withColumn("technologies", rest)
        .withColumn("role", role)
        .withColumn("city", city)
        .withColumn("country", F.when(F.col("city").isNotNull(), "india"))
        .withColumn("predicted_intent", intent)
    )


def seeds(understood: DataFrame) -> DataFrame:
    """(query_id, entity, pos): role, then skills by the parts of the reading, without repeats."""
    every = F.array_distinct(F.array_compact(F.concat(F.array("role"), "skills", "technologies", "tools", "frameworks", "languages")))
    return understood.select("query_id", F.posexplode(every).alias("pos", "entity"))


def expanded_text(queries: DataFrame, expansion: DataFrame) -> DataFrame:
    """Queries with their expansions appended that are not a word of the query already (rank order)."""
    found = expansion.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "entity"))), lambda x: x["entity"]).alias("expansions"))
    q = queries.join(found, "query_id", "left").withColumn("expansions", F.coalesce("expansions", F.array().cast("array<string>")))
    new = F.filter(F.col("expansions"), lambda e: ~F.array_contains(F.split(F.lower("query"), " +"), F.lower(e)))
    return q.withColumn("expanded_query", F.trim(F.concat_ws(" ", "query", F.array_join(new, " "))))


#: Fields of a model's answer to a query, as JSON.
READING = (
    "intent string, original_query string, role string, skills array<string>, technologies array<string>, tools array<string>, frameworks array<string>, "
    "programming_languages array<string>, soft_skills array<string>, certifications array<string>, education array<string>, industry array<string>, "
    "location string, experience string, filters string"
)


def parse_answers(answers: DataFrame) -> DataFrame:
    """answers (query_id, query, answer) read into the structured form, with an `error` where that fails.

    Code fences are removed; missing lists are empty; location, experience and filters that are no objects
    are empty; years that are no numbers and filters that are neither yes nor no are null.
    """
    a = answers.withColumn("_x", F.from_json(X.unfence(F.col("answer")), READING))
    x = lambda n: F.col(f"_x.{n}")
    place = F.from_json(x("location"), "city string, state string, country string")
    work = F.from_json(x("experience"), "min_years string, max_years string")
    flags = F.from_json(x("filters"), "remote string, full_time string, internship string")
    flag = lambda c: F.when(F.lower(c).isin("true", "1", "yes"), True).when(F.lower(c).isin("false", "0", "no"), False)
    number = lambda c: F.nullif(F.trim(c), F.lit("")).try_cast("double")
    lists = ["skills", "technologies", "tools", "frameworks", "programming_languages", "soft_skills", "certifications", "education", "industry"]
    known = x("intent").isin(list(V.INTENT_SOURCE))
    return a.select(
        "query_id",
        F.when(F.col("_x").isNull(), "not a JSON object").when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("unknown intent: "), F.coalesce(x("intent"), F.lit("none")))).alias("error"),
        F.when(known, x("intent")).alias("intent"),
        F.coalesce(x("original_query"), "query").alias("original_query"),
        x("role").alias("role"),
        *[F.coalesce(x(n), F.array().cast("array<string>")).alias(n) for n in lists],
        place["city"].alias("city"), place["state"].alias("state"), place["country"].alias("country"),
        number(work["min_years"]).alias("min_years"), number(work["max_years"]).alias("max_years"),
        *[flag(flags[n]).alias(n) for n in ("remote", "full_time", "internship")],
    )
