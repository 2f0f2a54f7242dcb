"""Entities, relations, ontology edges, two-hop expansion and graph statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import arrays as A
from corvane.functions import vocab as V
from corvane.session import local_table
from corvane.operators.components import components


def stack_members(spark: SparkSession) -> DataFrame:
    """(stack_no, stack, type, name) of the technology stacks."""
    rows = [(i, s, V.PARTS[part], n) for i, (s, parts) in enumerate(V.STACKS.items()) for part, names in parts.items() for n in ([names] if isinstance(names, str) else names)]
    return local_table(spark, rows, "stack_no int, stack string, type string, name string")


def rules(spark: SparkSession) -> DataFrame:
    return local_table(spark, V.RULES, "source_type string, target_type string, relation string, confidence double")


def ontology_edges(spark: SparkSession) -> DataFrame:
    """Typed edges between members of one stack for which a rule exists; the most confident, then the first stack, wins.

    Framework and concept are tied only in stacks that name a language. Weight is 100 * confidence.
    """
    m = stack_members(spark)
    spoken = m.where("type = 'ProgrammingLanguage'").select("stack").distinct().withColumn("spoken", F.lit(True))
    a = m.select("stack_no", "stack", F.col("type").alias("source_type"), F.col("name").alias("source"))
    b = m.select("stack", F.col("type").alias("target_type"), F.col("name").alias("target"))
    held = F.concat_ws(">", "source_type", "target_type").isin([f"{x}>{y}" for x, y in V.NEEDS_LANGUAGE])
    edges = a.join(b, "stack").join(rules(spark), ["source_type", "target_type"]).join(spoken, "stack", "left").where(~held | F.col("spoken").isNotNull())
    best = edges.groupBy("source", "target", "relation").agg(F.min(F.struct(-F.col("confidence"), "stack_no", "stack", "source_type", "target_type", "confidence")).alias("e"))
    return best.select("source", "target", "e.source_type", "e.target_type", "relation", "e.confidence", "e.stack", F.round(F.col("e.confidence") * 100).cast("long").alias("weight"))


def expand(seeds: DataFrame, edges: DataFrame, limit: int = V.EXPANSION_LIMIT, least: float = V.MIN_CONFIDENCE) -> DataFrame:
    """(query_id, entity, hop, path, path_confidence, rank): up to two hops from seeds (query_id, entity, pos).

    An entity is reached by its first discovery: hop, then seed order, then confidence, then name. Seeds,
    soft skills and edges below `least` are not followed. The best `limit` by path confidence stay.
    """
    firm = edges.where((F.col("confidence") >= least) & (F.col("target_type") != "SoftSkill"))
    # of several relations between two entities the most confident is the path
    firm = firm.groupBy("source", "target").agg(F.max("confidence").alias("confidence"))
    own = seeds.select("query_id", "entity").distinct()
    start = seeds.where(~F.col("entity").isin(V.TERMS["SoftSkill"])).groupBy("query_id", "entity").agg(F.min("pos").alias("pos"))

    def first(found: DataFrame, order: list) -> DataFrame:
        n = F.row_number().over(Window.partitionBy("query_id", "entity").orderBy(*order))
        return found.withColumn("n", n).where("n = 1").drop("n")

    one = start.join(firm, start.entity == firm.source).select("query_id", F.col("target").alias("entity"), F.col("confidence").alias("path_confidence"), F.array("source", "target").alias("path"), "pos")
    one = first(one.join(own, ["query_id", "entity"], "left_anti"), ["pos", F.desc("path_confidence"), "entity"])
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy("pos", F.desc("path_confidence"), "entity"))
    one = one.withColumn("turn", turn)
    two = one.join(firm, one.entity == firm.source).select(
        "query_id", F.col("target").alias("entity"), (F.col("path_confidence") * F.col("confidence")).alias("path_confidence"), F.concat("path", F.array("target")).alias("path"), "turn", F.col("confidence").alias("c")
    )
    two = first(two.join(own, ["query_id", "entity"], "left_anti").join(one.select("query_id", "entity"), ["query_id", "entity"], "left_anti"), ["turn", F.desc("c"), "entity"])
    both = one.select("query_id", "entity", F.lit(1).alias("hop"), "path", F.round("path_confidence", 6).alias("path_confidence"), "turn").unionByName(
        two.select("query_id", "entity", F.lit(2).alias("hop"), "path", F.round("path_confidence", 6).alias("path_confidence"), "turn")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("path_confidence"), "hop", "turn", "entity"))
    return both.withColumn("rank", rank).where(F.col("rank") <= limit).drop("turn")


def _typed(names) -> F.Column:
    """explode of names as struct(dst, dst_label): the type is computed once a name, before the explode."""
    return F.explode(F.transform(names, lambda n: F.struct(n.alias("dst"), A.entity_class(n).alias("dst_label")))).alias("t")


def candidate_edges(profiles: DataFrame) -> DataFrame:
    """(src_label, src, relation, dst_label, dst, confidence) of cleaned profiles: skills and roles."""
    other = F.lit("HAS_SKILL")
    skills = profiles.select(F.col("id").alias("src"), _typed("all_skills")).select("src", "t.*")
    rel = _relation(V.CANDIDATE_REL, other)
    skills = skills.select("src", rel.alias("relation"), "dst_label", "dst", F.when(F.col("dst_label") == "SoftSkill", 0.55).otherwise(0.85).alias("confidence"))
    roles = profiles.select(F.col("id").alias("src"), _typed("roles")).select("src", "t.*").where("dst_label = 'Role'")
    roles = roles.select("src", F.lit("WORKED_AS").alias("relation"), "dst_label", "dst", F.lit(0.70).alias("confidence"))
    return skills.unionByName(roles).select(F.lit("Candidate").alias("src_label"), "*").distinct()


def _relation(table: dict[str, str], other) -> F.Column:
    out = other
    for label, rel in table.items():
        out = F.when(F.col("dst_label") == label, F.lit(rel)).otherwise(out)
    return out


def demand_edges(demands: DataFrame) -> DataFrame:
    """Edges of cleaned postings: title, city and skills; the relation is chosen for each row."""
    title = demands.where("job_title <> ''").select(F.col("id").alias("src"), F.col("job_title").alias("dst")).withColumn("dst_label", A.entity_class(F.col("dst"))).where("dst_label = 'Role'")
    title = title.select("src", F.lit("MATCHES_ROLE").alias("relation"), "dst_label", "dst", F.lit(0.82).alias("confidence"))
    place = demands.where("location <> ''").select(F.col("id").alias("src"), F.lit("LOCATED_IN").alias("relation"), F.lit("Location").alias("dst_label"), F.element_at(F.split("location", ", "), 1).alias("dst"), F.lit(0.95).alias("confidence"))
    skills = demands.select(F.col("id").alias("src"), _typed("all_skills")).select("src", "t.*")
    skills = skills.select("src", _relation(V.DEMAND_REL, F.lit("REQUIRES_SKILL")).alias("relation"), "dst_label", "dst", F.lit(0.88).alias("confidence"))
    return title.unionByName(place).unionByName(skills).select(F.lit("Demand").alias("src_label"), "*").distinct()


def description_edges(descriptions: DataFrame) -> DataFrame:
    """Edges of cleaned descriptions: title, industry and short list items."""
    base = descriptions.select(F.col("jd_id").alias("src"), "job_title", "industry", *V.JD_CONFIDENCE)
    title = base.where("job_title <> ''").select("src", F.col("job_title").alias("dst")).withColumn("dst_label", A.entity_class(F.col("dst"))).where("dst_label = 'Role'")
    title = title.select("src", F.lit("MATCHES_ROLE").alias("relation"), "dst_label", "dst", F.lit(0.82).alias("confidence"))
    domain = base.where("industry <> ''").select("src", F.lit("BELONGS_TO_DOMAIN").alias("relation"), F.lit("Domain").alias("dst_label"), F.col("industry").alias("dst"), F.lit(0.90).alias("confidence"))
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("confidence"), A.short(F.col(f)).alias("items")) for f, c in V.JD_CONFIDENCE.items()])).alias("f")
    items = base.select("src", fields).select("src", "f.confidence", _typed("f.items")).select("src", "confidence", "t.*")
    items = items.select("src", _relation(V.DEMAND_REL, F.lit("REQUIRES_SKILL")).alias("relation"), "dst_label", "dst", "confidence")
    # one edge per pair and relation: the most confident field counts
    items = items.groupBy("src", "relation", "dst_label", "dst").agg(F.max("confidence").alias("confidence"))
    return title.unionByName(domain).unionByName(items).select(F.lit("JobDescription").alias("src_label"), "*")


def nodes(edges: DataFrame) -> DataFrame:
    """(label, name) of all end points, once each."""
    return edges.select(F.col("src_label").alias("label"), F.col("src").alias("name")).unionByName(edges.select(F.col("dst_label").alias("label"), F.col("dst").alias("name"))).distinct()


def degrees(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    return edges.select(source, target).distinct().groupBy(source).agg(F.count(F.lit(1)).alias("degree"))


def labels(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """(node, component): the smallest name of each weakly connected component. Null ends and loops are ignored."""
    return components(edges.select(F.col(source).alias("a"), F.col(target).alias("b"))).select("node", F.col("root").alias("component"))
