"""The posting graph as six node and six edge tables.

A posting keeps its record id; every other node has ``md5(kind|name)``.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillstrata.functions.ranking import top_per_group
from skillstrata.operators.relate import upsert

# The node and edge kinds of the graph model and the names of their tables.
NODE_TABLES = {
    "JobPosting": "nodes_job_posting",
    "JobRole": "nodes_job_role",
    "Skill": "nodes_skill",
    "City": "nodes_city",
    "Company": "nodes_company",
    "Major": "nodes_major",
}
EDGE_TABLES = {
    "BELONGS_TO_ROLE": "rel_belongs_to_role",
    "LOCATED_IN": "rel_located_in",
    "POSTED_BY": "rel_posted_by",
    "REQUIRES": "rel_requires",
    "RELATED_TO_MAJOR": "rel_related_to_major",
    "ROLE_REQUIRES_SKILL": "rel_role_requires_skill",
}
EDGE_ENDS = {
    "BELONGS_TO_ROLE": ("JobPosting", "JobRole"),
    "LOCATED_IN": ("JobPosting", "City"),
    "POSTED_BY": ("JobPosting", "Company"),
    "REQUIRES": ("JobPosting", "Skill"),
    "RELATED_TO_MAJOR": ("JobPosting", "Major"),
    "ROLE_REQUIRES_SKILL": ("JobRole", "Skill"),
}


def node_id(kind: str, name: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{kind}|"), name))


def _named_nodes(df: DataFrame, kind: str, col: str) -> DataFrame:
    names = df.select(F.col(col).alias("name")).filter(F.col("name").isNotNull()).distinct()
    return names.select(node_id(kind, F.col("name")).alias("id"), "name")


def _posting_edges(df: DataFrame, kind: str, col: str) -> DataFrame:
    known = df.filter(F.col(col).isNotNull())
    return known.select(F.col("record_id").alias("src_id"), node_id(kind, F.col(col)).alias("dst_id"))


def nodes_job_posting(p: DataFrame) -> DataFrame:
    return p.select(F.col("record_id").alias("id"), F.col("title").alias("name"), "role", "city", "posted_on")


def nodes_job_role(p: DataFrame) -> DataFrame:
    return _named_nodes(p, "JobRole", "role")


def nodes_skill(js: DataFrame) -> DataFrame:
    return _named_nodes(js, "Skill", "skill")


def nodes_city(p: DataFrame) -> DataFrame:
    return _named_nodes(p, "City", "city")


def nodes_company(p: DataFrame) -> DataFrame:
    return _named_nodes(p, "Company", "company")


def posting_majors(p: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """``(record_id, role, major)``, by way of ``mapping (posting_major, major)`` where given."""
    own = p.select("record_id", "role", "major").filter(F.col("major").isNotNull())
    if mapping is None:
        return own
    return own.withColumnRenamed("major", "posting_major").join(mapping, "posting_major").drop("posting_major")


def nodes_major(p: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    return _named_nodes(posting_majors(p, mapping), "Major", "major")


def rel_belongs_to_role(p: DataFrame) -> DataFrame:
    return _posting_edges(p, "JobRole", "role")


def rel_located_in(p: DataFrame) -> DataFrame:
    return _posting_edges(p, "City", "city")


def rel_posted_by(p: DataFrame) -> DataFrame:
    return _posting_edges(p, "Company", "company")


def rel_requires(js: DataFrame) -> DataFrame:
    """Distinct already: the relation holds each posting and skill once."""
    return _posting_edges(js, "Skill", "skill")


def rel_related_to_major(p: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    edges = _posting_edges(posting_majors(p, mapping), "Major", "major")
    return edges if mapping is None else edges.distinct()


def role_skill_counts(p: DataFrame) -> DataFrame:
    """Postings of each role that ask for each skill."""
    return p.select("role", F.explode("skills").alias("skill")).groupBy("role", "skill").agg(
        F.count("*").alias("postings")
    )


def rel_role_requires_skill(p: DataFrame, min_postings: int = 1, top_n: int | None = None) -> DataFrame:
    """Role-skill edges weighted by postings: those of ``min_postings`` up, the ``top_n`` of a role."""
    frequent = role_skill_counts(p).filter(F.col("postings") >= min_postings)
    kept = top_per_group(frequent, ["role"], [F.col("postings").desc(), F.col("skill")], top_n)
    return kept.select(
        node_id("JobRole", F.col("role")).alias("src_id"), node_id("Skill", F.col("skill")).alias("dst_id"), "postings"
    )


def build_nodes(p: DataFrame, js: DataFrame, mapping: DataFrame | None = None) -> dict[str, DataFrame]:
    """All node tables by kind."""
    return {
        "JobPosting": nodes_job_posting(p),
        "JobRole": nodes_job_role(p),
        "Skill": nodes_skill(js),
        "City": nodes_city(p),
        "Company": nodes_company(p),
        "Major": nodes_major(p, mapping),
    }


def build_edges(
    p: DataFrame, js: DataFrame, mapping: DataFrame | None = None, min_postings: int = 1, top_n: int | None = None
) -> dict[str, DataFrame]:
    """All edge tables by kind."""
    return {
        "BELONGS_TO_ROLE": rel_belongs_to_role(p),
        "LOCATED_IN": rel_located_in(p),
        "POSTED_BY": rel_posted_by(p),
        "REQUIRES": rel_requires(js),
        "RELATED_TO_MAJOR": rel_related_to_major(p, mapping),
        "ROLE_REQUIRES_SKILL": rel_role_requires_skill(p, min_postings, top_n),
    }


def _counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    counted = [t.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, t in tables.items()]
    return reduce(DataFrame.unionByName, counted).orderBy("kind")


def node_counts(nodes: Mapping[str, DataFrame]) -> DataFrame:
    """Nodes of each kind, in order of kind."""
    return _counts(nodes)


def edge_counts(edges: Mapping[str, DataFrame]) -> DataFrame:
    """Edges of each kind, in order of kind."""
    return _counts(edges)


def merge_graph(existing: Mapping[str, DataFrame], new: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Keyed load of node or edge tables: a second load of the same tables changes nothing."""
    merged = dict(existing)
    for kind, table in new.items():
        key = ["id"] if "id" in table.columns else ["src_id", "dst_id"]
        merged[kind] = upsert(existing[kind], table, key) if kind in existing else table
    return merged


def dangling_edges(nodes: Mapping[str, DataFrame], edges: Mapping[str, DataFrame]) -> DataFrame:
    """Edges with an end that is not in its node table."""
    lost = []
    for kind, table in edges.items():
        for end, node_kind in zip(("src_id", "dst_id"), EDGE_ENDS[kind], strict=True):
            known = nodes[node_kind].select(F.col("id").alias(end))
            loose = table.join(known, end, "left_anti")
            lost.append(loose.select(F.lit(kind).alias("kind"), F.lit(end).alias("missing_end"), "src_id", "dst_id"))
    return reduce(DataFrame.unionByName, lost)
