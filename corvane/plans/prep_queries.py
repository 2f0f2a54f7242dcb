"""Queries of cleaning, sectioning and chunking, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import arrays as A
from corvane.functions import text as X
from corvane.functions import vocab as V
from corvane.operators import preparation as P
from corvane.sources.tables import one_per_key, table

# ---- SQL pieces -------------------------------------------------------------------------------

_WS = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def q_squash(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{_WS}+', ' ', 'g'))"


def q_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def q_scalar(x: str) -> str:
    y = f"regexp_replace(replace(coalesce({x}, ''), chr(13), chr(10)), '[ \\t]+', ' ', 'g')"
    return q_strip(f"regexp_replace({y}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def q_dedup(xs: str) -> str:
    """Ordered, casing-blind."""
    return f"list_filter({xs}, lambda x, i: list_position(list_transform({xs}, lambda y: lower(y)), lower(x)) = i)"


def q_split(x: str, lower: bool = False) -> str:
    one = q_squash("v")
    one = f"lower({one})" if lower else one
    return f"list_filter(list_transform(string_split(coalesce({x}, ''), ','), lambda v: {one}), lambda v: v <> '')"


def q_years(x: str) -> str:
    return f"coalesce(cast(trunc(try_cast(trim({x}) AS DOUBLE)) AS INT), 0)"


def q_any(x: str, words: list[str]) -> str:
    pattern = "|".join(re.sub(r"([.+*?()\[\]{}|\\^$])", r"\\\1", w) for w in words).replace("'", "''")
    return f"regexp_matches({x}, '{pattern}')"


def q_keys(name: str, key: str, *columns: str) -> str:
    """The latest delivery of every key."""
    order = ", ".join(f"{c} DESC NULLS LAST" for c in ("loaded_at", *columns))
    return f"(SELECT {', '.join((key, *columns))} FROM {name} WHERE {key} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order}) = 1)"


def q_place(city: str, country: str) -> str:
    return f"concat_ws(', ', nullif({q_squash(city)}, ''), nullif({q_squash(country)}, ''))"


def q_fields(*pairs: tuple[str, str]) -> str:
    inner = ", ".join(f"CASE WHEN {q_squash(v)} <> '' THEN '{k}: ' || {q_squash(v)} END" for k, v in pairs)
    return f"lower({q_squash(f'concat_ws(chr(32), {inner})')})"


def q_json(x: str) -> str:
    items = f"CASE WHEN trim(coalesce({x}, '')) = '' THEN CAST([] AS VARCHAR[]) ELSE coalesce(try_cast(try_cast(trim({x}) AS JSON) AS VARCHAR[]), [trim({x})]) END"
    clean = f"list_filter(list_transform({items}, lambda v: {q_squash('v')}), lambda v: v <> '')"
    return f"list_transform({q_dedup(clean)}, lambda v: lower(v))"


def q_bullet_class(x: str, other: str = "false") -> str:
    y, cases = f"lower({x})", []
    for kind, words in V.BULLET_KEYWORDS.items():
        hit = q_any(y, words)
        if kind == "technology":
            hit = f"({hit} OR regexp_matches({y}, '\\b(?:{'|'.join(V.TECHNOLOGY_WORDS)})\\b'))"
        cases.append(f"WHEN {hit} THEN '{kind}'")
    return f"CASE {' '.join(cases)} WHEN {other} THEN 'preferred_skill' ELSE 'must_have_skill' END"


def q_labelled(*pairs: tuple[str, str]) -> str:
    return "concat_ws(chr(10) || chr(10), " + ", ".join(f"CASE WHEN {q_scalar(v)} <> '' THEN '{k}:' || chr(10) || {q_scalar(v)} END" for k, v in pairs) + ")"


def q_lists(*pairs: tuple[str, str]) -> str:
    return "concat_ws(chr(10) || chr(10), " + ", ".join(f"CASE WHEN len({v}) > 0 THEN '{k}:' || chr(10) || list_aggregate(list_transform({v}, lambda z: '- ' || z), 'string_agg', chr(10)) END" for k, v in pairs) + ")"


Q_DEMANDS = f"""demand_rows AS (
  SELECT id, lower({q_squash('job_title')}) AS job_title, lower({q_place('city', 'country')}) AS location, {q_years('experience_lower')} AS experience_lower, {q_years('experience_upper')} AS experience_upper,
         list_filter(p, lambda x, i: list_position(p, x) = i) AS p, list_filter(s, lambda x, i: list_position(s, x) = i) AS s
  FROM (SELECT *, {q_split('primary_skills', True)} AS p, {q_split('secondary_skills', True)} AS s
        FROM {q_keys('demands', 'id', 'job_title', 'primary_skills', 'secondary_skills', 'city', 'country', 'experience_lower', 'experience_upper')})
), clean_demands AS (
  SELECT *, list_filter(a, lambda x, i: list_position(a, x) = i) AS all_skills FROM (SELECT *, list_concat(p, s) AS a FROM demand_rows)
)"""
_LEVEL = r"^(.+?)\s*\((.+?)\)"
Q_PROFILES = f"""profile_items AS (
  SELECT id, n, i, lower(trim(CASE WHEN regexp_matches(v, '{_LEVEL}') THEN regexp_extract(v, '{_LEVEL}', 1) ELSE v END)) AS skill,
         lower(trim(CASE WHEN regexp_matches(v, '{_LEVEL}') THEN regexp_extract(v, '{_LEVEL}', 2) ELSE 'unknown' END)) AS level, category
  FROM (SELECT id, n, category, unnest(xs) AS v, generate_subscripts(xs, 1) AS i FROM (
    SELECT id, 1 AS n, 'core' AS category, {q_split('core_skills')} AS xs FROM pk UNION ALL
    SELECT id, 2, 'secondary', {q_split('secondary_skills')} FROM pk UNION ALL
    SELECT id, 3, 'soft', {q_split('soft_skills')} FROM pk))
), profile_skills AS (
  SELECT id, skill, arg_max(level, n * 1000000 + i) AS level, arg_max(category, n * 1000000 + i) AS category, min(n * 1000000 + i) AS pos FROM profile_items GROUP BY id, skill
), clean_profiles AS (
  SELECT p.id, {q_years('years_of_experience')} AS years_of_experience, coalesce(s.all_skills, CAST([] AS VARCHAR[])) AS all_skills,
         list_filter(r, lambda x, i: list_position(r, x) = i) AS roles, {q_squash('skill_summary')} AS skill_summary
  FROM (SELECT *, {q_split('potential_roles', True)} AS r FROM pk) p LEFT JOIN (SELECT id, list(skill ORDER BY pos) AS all_skills FROM profile_skills GROUP BY id) s ON p.id = s.id
)"""
Q_PK = f"pk AS (SELECT * FROM {q_keys('profiles', 'id', 'core_skills', 'secondary_skills', 'soft_skills', 'potential_roles', 'skill_summary', 'years_of_experience')})"
_JD = "clean_jd AS (SELECT jd_id, lower({t}) AS job_title, lower({i}) AS industry, lower({c}) AS city, lower({n}) AS country, {lists} FROM {k}), jd AS (SELECT *, concat_ws(', ', nullif(city, ''), nullif(country, '')) AS location FROM clean_jd)"
Q_JD = _JD.format(
    t=q_squash("job_title"), i=q_squash("industry"), c=q_squash("city"), n=q_squash("country"), lists=", ".join(f"{q_json(c)} AS {c}" for c in P.JD_LISTS), k=q_keys("jd_cleaned", "jd_id", "job_title", "industry", "city", "country", "job_location", *P.JD_LISTS)
)

# ---- queries ----------------------------------------------------------------------------------


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def profiles(s: SparkSession, d: str) -> DataFrame:
    return P.clean_profiles(table(s, d, "profiles"))


def demands(s: SparkSession, d: str) -> DataFrame:
    return P.clean_demands(table(s, d, "demands"))


def descriptions(s: SparkSession, d: str) -> DataFrame:
    return P.clean_descriptions(table(s, d, "jd_cleaned"))


def chunks(s: SparkSession, d: str) -> DataFrame:
    return P.all_chunks(profiles(s, d), demands(s, d), descriptions(s, d))


def _join(c: str):
    return F.array_join(c, "|").alias(c)


QUERIES = {
    "normalize_text": lambda s, d: _docs(s, d).select("doc_id", X.squash_lower(F.col("text")).alias("norm")),
    "clean_scalar": lambda s, d: _docs(s, d).select("doc_id", X.clean_scalar(F.col("text")).alias("clean")),
    "tokenize_stats": lambda s, d: _docs(s, d).select("doc_id", F.size(X.tokens(F.col("text"))).cast("long").alias("n_tokens"), F.size(F.array_distinct(X.tokens(F.col("text")))).cast("long").alias("n_terms")),
    "truncate_text": lambda s, d: _docs(s, d).select("doc_id", X.truncate(F.col("text")).alias("short")),
    "bullet_clean": lambda s, d: _docs(s, d).select("doc_id", F.posexplode(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), X.bullet)).alias("line_no", "line")).where("line <> ''"),
    "subheader_lines": lambda s, d: _docs(s, d).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line")).where(X.is_sub_header(F.col("line"))),
    "experience_coerce": lambda s, d: one_per_key(table(s, d, "demands"), "id", "experience_lower", "experience_upper").select("id", X.years(F.col("experience_lower")).alias("low"), X.years(F.col("experience_upper")).alias("high")),
    "location_parse": lambda s, d: one_per_key(table(s, d, "jd_cleaned"), "jd_id", "job_location").select("jd_id", X.location(F.col("job_location")).alias("x")).select("jd_id", "x.city", "x.country"),
    "location_compose": lambda s, d: one_per_key(table(s, d, "demands"), "id", "city", "country").select("id", X.compose_location(F.col("city"), F.col("country")).alias("location")),
    "ordered_ci_dedup": lambda s, d: one_per_key(table(s, d, "demands"), "id", "all_skills").select("id", F.array_join(A.split_commas(F.col("all_skills")), "|").alias("items")),
    "merge_unique": lambda s, d: one_per_key(table(s, d, "profiles"), "id", "core_skills", "secondary_skills").select("id", F.array_join(A.merge_unique(A.split_commas(F.col("core_skills")), A.split_commas(F.col("secondary_skills"))), "|").alias("items")),
    "clean_demands": lambda s, d: demands(s, d).select("id", "job_title", "location", "experience_lower", "experience_upper", _join("all_skills"), "job_text"),
    "demand_skill_kinds": lambda s, d: demands(s, d).select("id", F.explode("skill_metadata").alias("skill", "kind")),
    "clean_profiles": lambda s, d: profiles(s, d).select("id", "years_of_experience", _join("all_skills"), _join("roles"), "skill_summary", "profile_text"),
    "profile_skill_levels": lambda s, d: profiles(s, d).select("id", F.explode("skill_metadata").alias("skill", "m")).select("id", "skill", "m.level", "m.category"),
    "description_items": lambda s, d: descriptions(s, d).select("jd_id", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("xs")) for c in P.JD_LISTS])).alias("f")).select("jd_id", "f.field", F.posexplode("f.xs").alias("pos", "item")),
    "retrieval_context": lambda s, d: descriptions(s, d).select("jd_id", _join("retrieval_context")),
    "description_metadata": lambda s, d: descriptions(s, d).select("jd_id", F.explode("metadata").alias("item", "category")),
    "section_split": lambda s, d: P.sections(P.markdown_of(descriptions(s, d)), "jd_id", "text"),
    "section_kinds": lambda s, d: P.section_kinds(P.sections(P.markdown_of(descriptions(s, d)), "jd_id", "text"), "jd_id"),
    "section_running": lambda s, d: P.running_sections(P.markdown_of(descriptions(s, d)).select("jd_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where("trim(line) <> ''"), "jd_id", "pos", "line"),
    "bullet_classify": lambda s, d: P.bullets(P.section_kinds(P.sections(P.markdown_of(descriptions(s, d)), "jd_id", "text"), "jd_id"), "jd_id"),
    "profile_chunks": lambda s, d: P.profile_chunks(profiles(s, d)).withColumn("skills", F.array_join("skills", "|")),
    "demand_chunks": lambda s, d: P.demand_chunks(demands(s, d)).withColumn("skills", F.array_join("skills", "|")),
    "description_chunks": lambda s, d: P.description_chunks(descriptions(s, d)).drop("skills"),
    "chunk_counts": lambda s, d: chunks(s, d).groupBy("source", "chunk_type").agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg(X.words(F.col("text"))), 4).alias("mean_words")),
    "chunk_repeats": lambda s, d: P.repeated_keys(chunks(s, d), "chunk_id"),
}

_ROLES, _SKILLS, _P, _S = (f"array_to_string({c}, ', ')" for c in ("roles", "all_skills", "p", "s"))
_YEARS = "years_of_experience || ' years'"
_RANGE = "experience_lower || ' - ' || experience_upper"
_WORDS = f"len(list_filter(string_split(regexp_replace(coalesce(text, ''), '{_WS}+', ' ', 'g'), ' '), lambda w: w <> ''))"



def _meta(source: str, kind: str, key: str, **more: str) -> str:
    known = {"source": f"'{source}'", "parent_id": key, "chunk_type": f"'{kind}'", **more}
    return "CAST(to_json({" + ", ".join(f"'{k}': {known[k]}" for k in sorted(known)) + "}) AS VARCHAR) AS metadata"


_PCH = f"SELECT 'profile_' || id AS chunk_id, id AS parent_id, 'profile' AS source, 'profile' AS chunk_type, array_to_string(roles, ', ') AS title, '' AS location, '' AS industry, {q_labelled(('Roles', _ROLES), ('Experience', _YEARS), ('Skills', _SKILLS), ('Summary', 'skill_summary'))} AS text, {_meta('profile', 'profile', 'id', candidate_id='id', experience='CAST(years_of_experience AS VARCHAR)', skills='all_skills', roles='roles')}, array_to_string(all_skills, '|') AS skills FROM clean_profiles"
_DCH = f"SELECT 'demand_' || id AS chunk_id, id AS parent_id, 'demand' AS source, 'demand' AS chunk_type, job_title AS title, location, '' AS industry, {q_labelled(('Job Title', 'job_title'), ('Location', 'location'), ('Skills', _SKILLS), ('Experience', _RANGE))} AS text, {_meta('demand', 'demand', 'id', job_title='job_title', location='location', skills='all_skills')}, array_to_string(all_skills, '|') AS skills FROM clean_demands"
_SLOTS = {
    "header": q_labelled(("Job Title", "job_title"), ("Industry", "industry"), ("Location", "location")),
    "responsibilities": q_lists(("Responsibilities", "responsibilities")),
    "skills": q_lists(("Must Have Skills", "must_have_skills"), ("Preferred Skills", "preferred_skills"), ("Soft Skills", "soft_skills"), ("Technologies", "technologies"), ("Tools", "tools")),
    "qualification": q_lists(("Education", "education"), ("Experience", "experience"), ("Certifications", "certifications")),
}
_HEADM = {"job_title": "job_title", "industry": "industry", "location": "location"}
_MORE = {
    "header": {}, "responsibilities": {"section": "'responsibilities'", "item_count": "len(responsibilities)"},
    "skills": {c: c for c in ("must_have_skills", "preferred_skills", "soft_skills", "technologies", "tools")}, "qualification": {c: c for c in ("education", "experience", "certifications")},
}
_JCH = " UNION ALL ".join(f"SELECT * FROM (SELECT 'jd_' || jd_id || '_{k}' AS chunk_id, jd_id AS parent_id, 'jd' AS source, 'jd_{k}' AS chunk_type, job_title AS title, location, industry, {t} AS text, {_meta('jd', f'jd_{k}', 'jd_id', **_HEADM, **_MORE[k])} FROM jd) WHERE text <> ''" for k, t in _SLOTS.items())
_ALL = f"WITH {Q_PK}, {Q_PROFILES}, {Q_DEMANDS}, {Q_JD}, chunks AS (SELECT * EXCLUDE (skills) FROM ({_PCH}) UNION ALL SELECT * EXCLUDE (skills) FROM ({_DCH}) UNION ALL {_JCH})"
_NONE = "upper(y) IN ('N/A', 'NA', '-', 'NONE', 'NULL', '')"
_BUL = r"regexp_replace(trim(v), '^[-•*+]\s*', '')"
_HEAD = "|".join(V.SUB_HEADERS)
_MD = [("Job Title", "job_title"), ("Location", "location"), ("Detailed Responsibilities", "responsibilities"), ("Skill Requirements", "must_have_skills"), ("Other Requirements", "preferred_skills")]
_JOINED = "list_aggregate(list_transform({c}, lambda z: '- ' || z), 'string_agg', chr(10))"
_MDROWS = " UNION ALL ".join(
    f"SELECT jd_id, '{h}' AS heading, {c} AS body FROM jd WHERE {c} <> ''" if k < 2 else f"SELECT jd_id, '{h}' AS heading, {_JOINED.format(c=c)} AS body FROM jd WHERE len({c}) > 0" for k, (h, c) in enumerate(_MD)
)
_PLAIN = "regexp_replace({x}, '[*_]', '', 'g')"
_OTHER = "(kind = 'other')"

SQL = {
    "normalize_text": f"SELECT doc_id, lower({q_squash('text')}) AS norm FROM documents",
    "clean_scalar": f"SELECT doc_id, {q_scalar('text')} AS clean FROM documents",
    "tokenize_stats": "SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_terms FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9+#.]+') AS t FROM documents)",
    "truncate_text": f"SELECT doc_id, CASE WHEN length(y) > 500 THEN rtrim(substring(y, 1, 497)) || '...' ELSE y END AS short FROM (SELECT doc_id, {q_squash('text')} AS y FROM documents)",
    "bullet_clean": f"SELECT * FROM (SELECT doc_id, CAST(line_no - 1 AS INT) AS line_no, {q_squash(_PLAIN.format(x=_BUL))} AS line FROM (SELECT doc_id, unnest(xs) AS v, generate_subscripts(xs, 1) AS line_no FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS xs FROM documents))) WHERE line <> ''",
    "subheader_lines": f"SELECT doc_id, CAST(line_no - 1 AS INT) AS line_no, line FROM (SELECT doc_id, unnest(xs) AS line, generate_subscripts(xs, 1) AS line_no FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS xs FROM documents)) WHERE regexp_matches(trim(regexp_replace(trim(lower(line)), ':+$', '')), '^(?:{_HEAD})$') OR regexp_matches(trim(lower(line)), '^{V.LABEL_LINE}$')",
    "experience_coerce": f"SELECT id, {q_years('experience_lower')} AS low, {q_years('experience_upper')} AS high FROM {q_keys('demands', 'id', 'experience_lower', 'experience_upper')}",
    "location_parse": f"SELECT jd_id, CASE WHEN {_NONE} THEN '' ELSE coalesce(p[1], '') END AS city, CASE WHEN {_NONE} THEN '' ELSE coalesce(p[2], '') END AS country FROM (SELECT jd_id, trim(coalesce(job_location, '')) AS y, list_filter(list_transform(string_split(trim(coalesce(job_location, '')), ','), lambda v: trim(v)), lambda v: v <> '') AS p FROM {q_keys('jd_cleaned', 'jd_id', 'job_location')})",
    "location_compose": f"SELECT id, {q_place('city', 'country')} AS location FROM {q_keys('demands', 'id', 'city', 'country')}",
    "ordered_ci_dedup": f"SELECT id, array_to_string({q_dedup('xs')}, '|') AS items FROM (SELECT id, {q_split('all_skills')} AS xs FROM {q_keys('demands', 'id', 'all_skills')})",
    "merge_unique": f"SELECT id, array_to_string(list_concat(a, list_filter(b, lambda x: NOT list_contains(list_transform(a, lambda y: lower(y)), lower(x)))), '|') AS items FROM (SELECT id, {q_dedup('a0')} AS a, {q_dedup('b0')} AS b FROM (SELECT id, {q_split('core_skills')} AS a0, {q_split('secondary_skills')} AS b0 FROM {q_keys('profiles', 'id', 'core_skills', 'secondary_skills')}))",
    "clean_demands": f"WITH {Q_DEMANDS} SELECT c.id, c.job_title, c.location, experience_lower, experience_upper, array_to_string(all_skills, '|') AS all_skills, {q_fields(('job title', 'k.job_title'), ('location', 'c.location'), ('primary skills', _P), ('secondary skills', _S), ('experience', _RANGE))} AS job_text FROM clean_demands c JOIN {q_keys('demands', 'id', 'job_title')} k ON c.id = k.id",
    "demand_skill_kinds": f"WITH {Q_DEMANDS} SELECT id, unnest(all_skills) AS skill, unnest(list_transform(all_skills, lambda x: CASE WHEN list_contains(p, x) THEN 'primary' ELSE 'secondary' END)) AS kind FROM clean_demands",
    "clean_profiles": f"WITH {Q_PK}, {Q_PROFILES} SELECT id, years_of_experience, array_to_string(all_skills, '|') AS all_skills, array_to_string(roles, '|') AS roles, skill_summary, {q_fields(('roles', _ROLES), ('skills', _SKILLS), ('summary', 'skill_summary'))} AS profile_text FROM clean_profiles",
    "profile_skill_levels": f"WITH {Q_PK}, {Q_PROFILES} SELECT id, skill, level, category FROM profile_skills",
    "description_items": f"WITH {Q_JD} " + " UNION ALL ".join(f"SELECT jd_id, '{c}' AS field, unnest({c}) AS item, CAST(generate_subscripts({c}, 1) - 1 AS INT) AS pos FROM jd" for c in P.JD_LISTS),
    "retrieval_context": f"WITH {Q_JD} SELECT jd_id, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), '|') AS retrieval_context FROM (SELECT jd_id, flatten([{', '.join(c for c in P.JD_LISTS if c != 'certifications')}]) AS a FROM jd)",
    "description_metadata": f"WITH {Q_JD} SELECT jd_id, item, arg_min(category, n) AS category FROM ("
    + " UNION ALL ".join(f"SELECT jd_id, unnest({c}) AS item, '{c}' AS category, {n} AS n FROM jd" for n, c in enumerate(["must_have_skills", "technologies", "tools", "preferred_skills", "soft_skills", "certifications", "education", "experience", "responsibilities"]))
    + ") GROUP BY jd_id, item",
    "section_split": f"WITH {Q_JD} {_MDROWS}",
    "section_kinds": f"WITH {Q_JD} SELECT jd_id, CASE heading WHEN 'Detailed Responsibilities' THEN 'responsibilities' WHEN 'Skill Requirements' THEN 'skills' ELSE 'other' END AS kind, body FROM ({_MDROWS}) WHERE heading NOT IN ('Job Title', 'Location')",
    "bullet_classify": f"WITH {Q_JD}, items AS ("
    + " UNION ALL ".join(
        f"SELECT jd_id, '{k}' AS kind, {q_squash(_PLAIN.format(x='v'))} AS item, i FROM (SELECT jd_id, unnest({c}) AS v, generate_subscripts({c}, 1) AS i FROM jd)" for k, c in (("responsibilities", "responsibilities"), ("skills", "must_have_skills"), ("other", "preferred_skills"))
    )
    + f"), kept AS (SELECT * FROM items WHERE item <> '' AND NOT (regexp_matches(trim(regexp_replace(trim(lower(item)), ':+$', '')), '^(?:{_HEAD})$') OR regexp_matches(trim(lower(item)), '^{V.LABEL_LINE}$'))) SELECT jd_id, kind, CAST(row_number() OVER (PARTITION BY jd_id, kind ORDER BY i) - 1 AS INT) AS pos, item, CASE WHEN kind = 'responsibilities' THEN 'responsibility' ELSE {q_bullet_class('item', _OTHER)} END AS class FROM kept",
    "profile_chunks": f"WITH {Q_PK}, {Q_PROFILES} {_PCH}",
    "demand_chunks": f"WITH {Q_DEMANDS} {_DCH}",
    "description_chunks": f"WITH {Q_JD} {_JCH}",
    "chunk_counts": f"{_ALL} SELECT source, chunk_type, count(*) AS chunks, round(avg({_WORDS}), 4) AS mean_words FROM chunks GROUP BY source, chunk_type",
    "chunk_repeats": f"{_ALL} SELECT chunk_id, count(*) AS rows FROM chunks GROUP BY chunk_id HAVING count(*) > 1",
}
_KINDS = "CASE " + " ".join("WHEN " + q_any("h", names) + f" THEN '{kind}'" for kind, names in V.SECTION_HEADERS.items()) + " END"
_BARE_HEAD = "regexp_replace(line, '[#*_`>]', '', 'g')"
_MDTEXT = "concat_ws(chr(10) || chr(10), " + ", ".join(f"CASE WHEN {c} <> '' THEN '## {h}' || chr(10) || {c} END" if k < 2 else f"CASE WHEN len({c}) > 0 THEN '## {h}' || chr(10) || {_JOINED.format(c=c)} END" for k, (h, c) in enumerate(_MD)) + ")"
SQL["section_running"] = f"""WITH {Q_JD}, lines AS (SELECT jd_id, CAST(i - 1 AS INT) AS pos, line FROM (SELECT jd_id, unnest(xs) AS line, generate_subscripts(xs, 1) AS i FROM (SELECT jd_id, string_split({_MDTEXT}, chr(10)) AS xs FROM jd)) WHERE trim(line) <> ''),
opened AS (SELECT *, {_KINDS} AS own FROM (SELECT *, lower({q_squash(_BARE_HEAD)}) AS h FROM lines)),
ran AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY jd_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kind FROM opened) SELECT jd_id, pos, line, kind FROM ran WHERE own IS NULL AND kind IS NOT NULL"""
