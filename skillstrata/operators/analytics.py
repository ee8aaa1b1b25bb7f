"""Skill co-occurrence, core skills, role similarity, recommendation, forecast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillstrata.functions.ranking import share_of_total
from skillstrata.operators.counts import Counts, counted
from skillstrata.operators.gold import posting_count
from skillstrata.operators.graph import role_skill_counts
from skillstrata.session import shared_root


def _skill_counts(p: DataFrame) -> DataFrame:
    return p.select(F.explode("skills").alias("skill")).groupBy("skill").agg(F.count("*").alias("postings"))


def skill_cooccurrence(p: DataFrame, min_count: int = 1) -> DataFrame:
    """Skill pairs with the postings that ask for both, Jaccard index and lift.

    Equal skill sets are counted first, so copies cost nothing, and ``skill_a < skill_b``
    pairs come from one set at a time, with no self join. The pair counts that leave a map
    task are at most the square of the dictionary.
    """
    sets = p.filter(F.size("skills") > 1).groupBy("skills").agg(F.count("*").alias("_n"))
    left = sets.select("skills", "_n", F.posexplode("skills").alias("_at", "skill_a"))
    later = F.slice("skills", F.col("_at") + 2, F.size("skills"))
    pairs = (
        left.select("skill_a", F.explode(later).alias("skill_b"), "_n")
        .groupBy("skill_a", "skill_b")
        .agg(F.sum("_n").alias("postings"))
        .filter(F.col("postings") >= min_count)
    )
    alone = _skill_counts(p)
    of_a = alone.select(F.col("skill").alias("skill_a"), F.col("postings").alias("_a"))
    of_b = alone.select(F.col("skill").alias("skill_b"), F.col("postings").alias("_b"))
    both = F.col("postings").cast("double")
    expected = F.col("_a").cast("double") * F.col("_b")
    return (
        pairs.join(of_a, "skill_a")
        .join(of_b, "skill_b")
        .select(
            "skill_a",
            "skill_b",
            "postings",
            (both / (F.col("_a") + F.col("_b") - F.col("postings"))).alias("jaccard"),
            (both * posting_count(p).scalar() / expected).alias("lift"),
        )
    )


def skill_rules(p: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """Association rules between skills by parallel FP-growth."""
    model = FPGrowth(itemsCol="skills", minSupport=min_support, minConfidence=min_confidence).fit(p.select("skills"))
    return model.associationRules


def _neighbours(cooc: DataFrame) -> DataFrame:
    forth = cooc.select(F.col("skill_a").alias("skill"), F.col("skill_b").alias("other"), "postings")
    back = cooc.select(F.col("skill_b").alias("skill"), F.col("skill_a").alias("other"), "postings")
    return forth.unionByName(back)


def core_skills(cooc: DataFrame) -> DataFrame:
    """Partners of each skill and postings shared with them."""
    return _neighbours(cooc).groupBy("skill").agg(
        F.count("*").alias("degree"), F.sum("postings").alias("weighted_degree")
    )


def skill_pagerank(cooc: DataFrame, iterations: int = 10, damping: float = 0.85, cut_every: int = 5) -> DataFrame:
    """PageRank over the weighted co-occurrence graph for a fixed number of steps.

    Edges are written to the checkpoint folder once; ranks every ``cut_every`` steps, which
    keeps the plan short and lets a lost executor resume from there.
    """
    shared_root(cooc.sparkSession)
    edges = _neighbours(cooc)
    strength = edges.groupBy("skill").agg(F.sum("postings").alias("_total"))
    links = (
        edges.join(strength, "skill")
        .select("skill", "other", (F.col("postings").cast("double") / F.col("_total")).alias("weight"))
        .checkpoint()
    )
    skills = links.select("skill").distinct()
    size = skills.agg(F.count("*").alias("n"))
    base = F.lit(1.0) / size.scalar()
    ranks = skills.select("skill", base.alias("rank")).checkpoint()
    for step in range(1, iterations + 1):
        received = (
            links.join(ranks, "skill")
            .groupBy(F.col("other").alias("skill"))
            .agg(F.sum(F.col("rank") * F.col("weight")).alias("_in"))
        )
        ranks = received.select("skill", (F.lit(1.0 - damping) / size.scalar() + F.lit(damping) * F.col("_in")).alias("rank"))
        if step % cut_every == 0:
            ranks = ranks.checkpoint()
    return ranks


def role_similarity(p: DataFrame) -> DataFrame:
    """Jaccard index of skill sets and cosine of skill counts for roles that share a skill.

    The join is over role-skill counts: roles and skills come from dictionaries, so its size
    does not depend on the number of postings.
    """
    counts = role_skill_counts(p)
    sizes = counts.groupBy("role").agg(
        F.count("*").alias("_skills"), F.sum(F.col("postings") * F.col("postings")).alias("_square")
    )
    left = counts.select(F.col("role").alias("role_a"), "skill", F.col("postings").alias("_pa"))
    right = counts.select(F.col("role").alias("role_b"), "skill", F.col("postings").alias("_pb"))
    shared = (
        left.join(right, "skill")
        .filter(F.col("role_a") < F.col("role_b"))
        .groupBy("role_a", "role_b")
        .agg(F.count("*").alias("shared_skills"), F.sum(F.col("_pa") * F.col("_pb")).alias("_dot"))
    )
    of_a = sizes.select(F.col("role").alias("role_a"), F.col("_skills").alias("_na"), F.col("_square").alias("_qa"))
    of_b = sizes.select(F.col("role").alias("role_b"), F.col("_skills").alias("_nb"), F.col("_square").alias("_qb"))
    union = F.col("_na") + F.col("_nb") - F.col("shared_skills")
    norms = F.sqrt(F.col("_qa").cast("double") * F.col("_qb").cast("double"))
    return (
        shared.join(of_a, "role_a")
        .join(of_b, "role_b")
        .select(
            "role_a",
            "role_b",
            "shared_skills",
            (F.col("shared_skills").cast("double") / union).alias("jaccard"),
            (F.col("_dot").cast("double") / norms).alias("cosine"),
        )
    )


def recommend_skills(p: DataFrame | Counts, role: str, known: Sequence[str] = (), top_n: int | None = None) -> DataFrame:
    """Skills to learn for a role, best first, without those already known; all or the ``top_n`` best.

    The score is the share of the role's postings that ask for the skill, times its lift over
    all postings: common in the role, and more so than elsewhere. ``p`` is Silver or the cube of counts.
    """
    in_role = counted(p, "role", "skill").where(F.col("role") == role).select("skill", F.col("postings").alias("role_postings"))
    if known:
        in_role = in_role.filter(~F.col("skill").isin(list(known)))
    size = counted(p, "role").where(F.col("role") == role).select("postings")
    share = share_of_total(F.col("role_postings"), size)
    overall = share_of_total(F.col("postings"), counted(p).select("postings"))
    ranked = (
        in_role.join(counted(p, "skill"), "skill")
        .select("skill", "role_postings", share.alias("share"), (share / overall).alias("lift"))
        .withColumn("score", F.col("share") * F.col("lift"))
        .orderBy(F.col("score").desc(), "skill")
    )
    return ranked if top_n is None else ranked.limit(top_n)


def forecast(counted: DataFrame, key: str, horizon: int = 3) -> DataFrame:
    """Demand of the next ``horizon`` months by least squares over month counts.

    ``counted`` is ``(key, _m, postings)`` with month indexes. Months without postings are
    zeros; as they add nothing to the sums of y and xy, they need not be put in.
    """
    span = counted.agg(F.struct(F.min("_m").alias("first"), F.max("_m").alias("last")).alias("span"))
    sums = counted.groupBy(key).agg(F.sum("postings").alias("_y"), F.sum(F.col("_m") * F.col("postings")).alias("_my"))
    n, x, y, xy = (F.col(c) for c in ("_n", "_x", "_y", "_xy"))
    xx = (n - 1) * n * (2 * n - 1) / 6
    fitted = (
        sums.withColumn("_span", span.scalar())
        .withColumn("_n", (F.col("_span.last") - F.col("_span.first") + 1).cast("double"))
        .withColumn("_x", n * (n - 1) / 2)
        .withColumn("_xy", F.col("_my") - F.col("_span.first") * y)
        .withColumn("_slope", F.coalesce((n * xy - x * y) / F.nullif(n * xx - x * x, F.lit(0.0)), F.lit(0.0)))
        .withColumn("_ahead", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    )
    expected = (y - F.col("_slope") * x) / n + F.col("_slope") * (n - 1 + F.col("_ahead"))
    return fitted.select(
        key,
        F.col("_ahead").cast("bigint").alias("months_ahead"),
        F.greatest(F.lit(0.0), expected).alias("expected_postings"),
    )
