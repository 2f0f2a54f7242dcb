"""Cleaning of profiles, postings and descriptions; markdown sections; retrieval chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import arrays as A
from corvane.functions import text as X
from corvane.functions import vocab as V
from corvane.session import written
from corvane.sources.tables import one_per_key

JD_LISTS = ["responsibilities", "must_have_skills", "preferred_skills", "soft_skills", "technologies", "tools", "education", "experience", "certifications"]


def clean_profiles(df: DataFrame) -> DataFrame:
    """One row per profile id: years, all_skills array, skill_metadata map, roles array, profile_text.

    A skill's last mention counts in skill_metadata (core, secondary, soft in this order). Null fields
    are empty; years that are no number are 0; rows without id are left out.
    """
    p = one_per_key(df, "id", "core_skills", "secondary_skills", "soft_skills", "potential_roles", "skill_summary", "years_of_experience")
    kinds = {"core": "core_skills", "secondary": "secondary_skills", "soft": "soft_skills"}
    entry = lambda kind, c: F.transform(A.skill_levels(F.col(c)), lambda s: F.struct(s["skill"].alias("key"), F.struct(s["level"].alias("level"), F.lit(kind).alias("category")).alias("value")))
    every = F.concat(*[entry(k, c) for k, c in kinds.items()])
    p = p.withColumn("entries", every).withColumn("all_skills", F.array_distinct(F.transform("entries", lambda e: e["key"])))
    return p.select(
        "id",
        X.years(F.col("years_of_experience")).alias("years_of_experience"),
        "all_skills",
        A.last_wins(F.col("entries")).alias("skill_metadata"),
        A.split_lower(F.col("potential_roles")).alias("roles"),
        X.squash(F.col("skill_summary")).alias("skill_summary"),
        X.sentence_fields(("roles", F.array_join(A.split_lower(F.col("potential_roles")), ", ")), ("skills", F.array_join("all_skills", ", ")), ("summary", F.col("skill_summary"))).alias("profile_text"),
    )


def clean_demands(df: DataFrame) -> DataFrame:
    """One row per posting id: title, location, experience bounds, skills arrays, skill_metadata, job_text.

    Primary skills win over secondary ones in skill_metadata; experience that is no number is 0.
    """
    d = one_per_key(df, "id", "job_title", "primary_skills", "secondary_skills", "city", "country", "experience_lower", "experience_upper")
    d = d.withColumn("p", A.split_lower(F.col("primary_skills"))).withColumn("s", A.split_lower(F.col("secondary_skills")))
    entry = lambda kind, c: F.transform(F.col(c), lambda v: F.struct(v.alias("key"), F.lit(kind).alias("value")))
    low, high = X.years(F.col("experience_lower")), X.years(F.col("experience_upper"))
    place = F.lower(X.compose_location(F.col("city"), F.col("country")))
    return d.select(
        "id",
        X.squash_lower(F.col("job_title")).alias("job_title"),
        place.alias("location"),
        low.alias("experience_lower"),
        high.alias("experience_upper"),
        F.array_distinct(F.concat("p", "s")).alias("all_skills"),
        A.first_wins(F.concat(entry("primary", "p"), entry("secondary", "s"))).alias("skill_metadata"),
        X.sentence_fields(
            ("job title", F.col("job_title")), ("location", place), ("primary skills", F.array_join("p", ", ")), ("secondary skills", F.array_join("s", ", ")),
            ("experience", F.concat_ws(" - ", low.cast("string"), high.cast("string"))),
        ).alias("job_text"),
    )


def clean_descriptions(df: DataFrame) -> DataFrame:
    """One row per description id: lists parsed, retrieval_context, metadata (first category of an item wins).

    Lists are lower-cased and without repeats; certifications stay out of retrieval_context.
    """
    j = one_per_key(df, "jd_id", "job_title", "industry", "city", "country", "job_location", *JD_LISTS)
    lists = {c: F.array_distinct(F.transform(A.json_list(F.col(c)), F.lower)) for c in JD_LISTS}
    j = j.select("jd_id", *[X.squash_lower(F.col(c)).alias(c) for c in ("job_title", "industry", "city", "country")], "job_location", *[v.alias(c) for c, v in lists.items()])
    order = ["must_have_skills", "technologies", "tools", "preferred_skills", "soft_skills", "certifications", "education", "experience", "responsibilities"]
    entry = lambda c: F.transform(F.col(c), lambda v: F.struct(v.alias("key"), F.lit(c).alias("value")))
    entries = F.concat(*[entry(c) for c in order])
    return j.withColumn("location", X.compose_location(F.col("city"), F.col("country"))).withColumn(
        "retrieval_context", F.array_distinct(F.concat(*[F.col(c) for c in JD_LISTS if c != "certifications"]))
    ).withColumn("metadata", A.first_wins(entries))


def markdown_of(descriptions: DataFrame) -> DataFrame:
    """(jd_id, text): cleaned descriptions as markdown documents, the inverse of `sections`."""
    item = lambda c: F.array_join(F.transform(F.col(c), lambda v: F.concat(F.lit("- "), v)), "\n")
    parts = [("Job Title", F.col("job_title")), ("Location", F.col("location")), ("Detailed Responsibilities", item("responsibilities")), ("Skill Requirements", item("must_have_skills")), ("Other Requirements", item("preferred_skills"))]
    return descriptions.select("jd_id", F.concat_ws("\n\n", *[F.when(v != "", F.concat(F.lit(f"## {k}\n"), v)) for k, v in parts]).alias("text"))


LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, heading, body): level-2 markdown sections.

    Text before the first heading and blank lines are dropped; of repeated headings the last counts;
    deeper headings are content. One pass with array functions: no shuffle, no row order needed.
    """
    parts = F.slice(F.split(F.concat(F.lit("\n"), X.empty(F.col(text))), "(?:" + LINE_BREAK + ")\\s*## (?!#)"), 2, 1 << 30)

    def one(p: Column) -> Column:
        lines = F.filter(F.transform(F.split(p, LINE_BREAK), X.strip), lambda x: x != "")
        heading = X.strip(F.element_at(F.split(p, LINE_BREAK), 1))
        skip = F.when(heading == "", 1).otherwise(2)
        return F.struct(heading.alias("key"), F.array_join(F.slice(lines, skip, F.greatest(F.size(lines), F.lit(1))), "\n").alias("value"))

    return docs.select(key, F.explode(A.last_wins(F.transform(parts, one))).alias("heading", "body"))


def section_kinds(sectioned: DataFrame, key: str) -> DataFrame:
    """(key, kind, body): of each kind the first section, by order of its aliases, that is not empty."""
    rank, kind = F.lit(None).cast("int"), F.lit(None).cast("string")
    for k, names in V.SECTION_ALIASES.items():
        for i, n in enumerate(names):
            rank = F.when(F.col("heading") == n, F.lit(i)).otherwise(rank)
            kind = F.when(F.col("heading") == n, F.lit(k)).otherwise(kind)
    rows = sectioned.withColumn("rank", rank).withColumn("kind", kind).where("kind IS NOT NULL AND trim(body) <> ''")
    return rows.groupBy(key, "kind").agg(F.min_by("body", "rank").alias("body"))


def running_sections(lines: DataFrame, key: str, pos: str, line: str) -> DataFrame:
    """Lines with the kind of section they stand in, for texts without markdown; lines before any heading are dropped."""
    own = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    kind = X.section_type(F.col(line))
    return lines.withColumn("_k", kind).withColumn("kind", F.last("_k", True).over(own)).where("_k IS NULL AND kind IS NOT NULL").drop("_k")


def bullets(sectioned: DataFrame, key: str, body: str = "body", kind: str = "kind") -> DataFrame:
    """(key, kind, pos, item, class): cleaned bullets of sections, without sub-headings and blanks."""
    items = F.filter(F.transform(F.split(F.col(body), "\n"), X.bullet), lambda x: (x != "") & ~X.is_sub_header(x))
    rows = sectioned.select(key, kind, F.posexplode(items).alias("pos", "item"))
    cls = F.when(F.col(kind) == "responsibilities", F.lit("responsibility")).when(F.col(kind) == "other", A.bullet_class(F.col("item"), "other")).otherwise(A.bullet_class(F.col("item")))
    return rows.withColumn("class", cls)


def _chunk(key: Column, parent: Column, source: str, kind: str, title: Column, place: Column, industry: Column, text: Column, skills: Column, more: dict[str, Column]) -> Column:
    """A chunk row. metadata is a JSON object with sorted keys: source, parent_id, chunk_type and `more`."""
    known = {"source": F.lit(source), "parent_id": parent, "chunk_type": F.lit(kind), **more}
    return F.struct(
        key.alias("chunk_id"), parent.alias("parent_id"), F.lit(source).alias("source"), F.lit(kind).alias("chunk_type"), title.alias("title"), place.alias("location"),
        industry.alias("industry"), text.alias("text"), F.to_json(F.struct(*[known[k].alias(k) for k in sorted(known)])).alias("metadata"), skills.alias("skills"),
    )


def _none() -> Column:
    return F.array().cast("array<string>")


def profile_chunks(profiles: DataFrame) -> DataFrame:
    c = F.col
    text = X.labelled(("Roles", F.array_join("roles", ", ")), ("Experience", F.concat(c("years_of_experience").cast("string"), F.lit(" years"))), ("Skills", F.array_join("all_skills", ", ")), ("Summary", c("skill_summary")))
    one = _chunk(F.concat(F.lit("profile_"), c("id")), c("id"), "profile", "profile", F.array_join("roles", ", "), F.lit(""), F.lit(""), text, c("all_skills"), {"candidate_id": c("id"), "experience": c("years_of_experience").cast("string"), "skills": c("all_skills"), "roles": c("roles")})
    return profiles.select(one.alias("x")).select("x.*")


def demand_chunks(demands: DataFrame) -> DataFrame:
    c = F.col
    text = X.labelled(("Job Title", c("job_title")), ("Location", c("location")), ("Skills", F.array_join("all_skills", ", ")), ("Experience", F.concat_ws(" - ", c("experience_lower").cast("string"), c("experience_upper").cast("string"))))
    one = _chunk(F.concat(F.lit("demand_"), c("id")), c("id"), "demand", "demand", c("job_title"), c("location"), F.lit(""), text, c("all_skills"), {"job_title": c("job_title"), "location": c("location"), "skills": c("all_skills")})
    return demands.select(one.alias("x")).select("x.*")


def description_chunks(descriptions: DataFrame) -> DataFrame:
    """Up to five chunks of each description in one pass; empty ones are skipped. Their skills stay empty, the lists stand in metadata."""
    c = F.col
    rest = c("other_requirements") if "other_requirements" in descriptions.columns else _none()
    head = {"job_title": c("job_title"), "industry": c("industry"), "location": c("location")}
    more = {
        "header": {}, "responsibilities": {"section": F.lit("responsibilities"), "item_count": F.size("responsibilities")},
        "skills": {n: c(n) for n in ("must_have_skills", "preferred_skills", "soft_skills", "technologies", "tools")},
        "qualification": {n: c(n) for n in ("education", "experience", "certifications")},
        "other": {"section": F.lit("other_requirements"), "item_count": F.size(rest)},
    }
    texts = {
        "header": X.labelled(("Job Title", c("job_title")), ("Industry", c("industry")), ("Location", c("location"))),
        "responsibilities": X.labelled_lists(("Responsibilities", c("responsibilities"))),
        "skills": X.labelled_lists(("Must Have Skills", c("must_have_skills")), ("Preferred Skills", c("preferred_skills")), ("Soft Skills", c("soft_skills")), ("Technologies", c("technologies")), ("Tools", c("tools"))),
        "qualification": X.labelled_lists(("Education", c("education")), ("Experience", c("experience")), ("Certifications", c("certifications"))),
        "other": X.labelled_lists(("Other Requirements", rest)),
    }
    slots = [F.when(t != "", _chunk(F.concat(F.lit("jd_"), c("jd_id"), F.lit(f"_{k}")), c("jd_id"), "jd", f"jd_{k}", c("job_title"), c("location"), c("industry"), t, _none(), head | more[k])) for k, t in texts.items()]
    return descriptions.select(F.explode(F.filter(F.array(*slots), lambda s: s.isNotNull())).alias("x")).select("x.*")


def all_chunks(profiles: DataFrame, demands: DataFrame, descriptions: DataFrame) -> DataFrame:
    return profile_chunks(profiles).unionByName(demand_chunks(demands)).unionByName(description_chunks(descriptions))


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that stand in more than one row; empty where the key is unique."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


BUCKETS = {
    "responsibility": "responsibilities", "must_have_skill": "must_have_skills", "preferred_skill": "preferred_skills", "soft_skill": "soft_skills", "certification": "certifications",
    "education": "education", "experience": "experience", "technology": "technologies", "tool": "tools",
}


def assembled(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, bucket, items): markdown or plain descriptions as lists of items by bucket.

    Sections are picked by their aliases. A text in which none of the three kinds has content is split by the
    headings it holds without markdown. Bullets are classified one by one; items keep their order, repeats in any
    casing are dropped (first casing stays). Null and blank texts give no row.
    """
    rows = docs.select(key, F.col(text).alias("_text")).where(F.col(text).isNotNull())
    picked = section_kinds(sections(rows, key, "_text"), key)
    plain = rows.join(picked.select(key).distinct(), key, "left_anti").select(key, F.posexplode(F.split("_text", LINE_BREAK)).alias("pos", "line")).where(X.strip(F.col("line")) != "")
    lines = running_sections(plain, key, "pos", "line").groupBy(key, "kind").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("x"))
    split = lines.select(key, "kind", F.array_join(F.transform("x", lambda v: v["line"]), "\n").alias("body"))
    items = bullets(picked.select(key, "kind", "body").unionByName(split), key)
    name = F.create_map(*[F.lit(x) for kv in BUCKETS.items() for x in kv])
    order = F.when(F.col("kind") == "responsibilities", 0).when(F.col("kind") == "skills", 1).otherwise(2)
    got = items.groupBy(key, name[F.col("class")].alias("bucket")).agg(F.array_sort(F.collect_list(F.struct(order.alias("k"), "pos", "item"))).alias("x"))
    return got.select(key, "bucket", A.ci_dedup(F.transform("x", lambda v: v["item"])).alias("items"))


def violations(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(check, rows) of a chunk table before it is embedded or indexed: what must be 0, in one pass and one count of keys."""
    c = F.col
    one = chunks.agg(F.count(F.lit(1)).alias("rows"), F.count_if(c(key).isNull() | (F.trim(c(key)) == "")).alias("no id"), F.count_if(c(text).isNull()).alias("null text"), F.count_if(F.trim(c(text)) == "").alias("blank text"))
    twice = repeated_keys(chunks.where(c(key).isNotNull()), key).agg(F.count(F.lit(1)).alias("repeated id"))
    one = one.join(twice)  # one row each
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), c(n).alias("rows")) for n in ("rows", "no id", "null text", "blank text", "repeated id")])).alias("x")).select("x.*")


def checked(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """The chunks, or ValueError: needed columns, at least one row, ids present and once, texts present and not blank."""
    require_columns(chunks, [key, text])
    found = {r.check: r.rows for r in violations(chunks, key, text).collect()}
    if not found["rows"]:
        raise ValueError("no chunks")
    bad = [f"{n}: {k}" for n, k in found.items() if n != "rows" and k]
    if bad:
        raise ValueError("; ".join(bad))
    return chunks


def dense_ids(df: DataFrame, key: str, name: str = "dense_id") -> DataFrame:
    """df with the numbers 0 .. n - 1 in the order of key (ties by no rule), without one task that sorts all.

    Range partitions are sorted on their own and shifted by the counts of those before, of which there are as many
    as shuffle partitions.
    """
    placed = written(df.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), "ranges")
    counts = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.min("_i").alias("_low"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = counts.select("_p", "_low", before.alias("_before"))  # a row a partition
    return placed.join(F.broadcast(shift), "_p").withColumn(name, F.col("_before") + F.col("_i") - F.col("_low")).drop("_p", "_i", "_low", "_before")


def require_columns(df: DataFrame, needed: list[str]) -> DataFrame:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
