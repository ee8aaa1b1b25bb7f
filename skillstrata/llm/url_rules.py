"""URL rules by a sort-merge range join (operator 8), with DataFrame functions only.

A host with its labels reversed (``com.example.www.``) makes every domain one interval of keys:
the host and all below it. Rules and URLs are sorted by such keys together, and a sweep over
the order keeps the stack of rules whose intervals are open. Two sweeps are made: one over
hosts finds the domains with rules that a URL lies in, the next over paths finds, within each
of them, the longest rule path that the URL's path begins with.

The order is cut into ranges that hold about equal numbers of keys; a rule enters a range by
its start, or, if it is open where the range begins, by the range's first key. Ranges are cut
by key and a hash, so a key with a large share of all rows spans several ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillstrata.llm.common import partitions, stored

OPENS, READS = 0, 1
COARSE = 32


def host_of(url: Column) -> Column:
    """From behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' if there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From behind the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    """Labels from the last to the first, each with a dot behind it: a domain's key begins its subdomains' keys."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _range_starts(keys: DataFrame) -> list[tuple[str, int]]:
    """First ``(key, tie)`` of each of the ranges that Spark's own range partitioning makes; at most one a partition."""
    n = partitions(keys.sparkSession)
    first = keys.repartitionByRange(n, "key", "tie").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("key", "tie")).alias("first"))
    return sorted((r.first.key, r.first.tie) for r in first.collect())[1:]


def _range_of(key: Column, tie: Column, starts: list[tuple[str, int]]) -> Column:
    """Number of range starts at or before the key: first among every COARSE-th, then in between."""
    if not starts:
        return F.lit(0)

    def pairs(some: list[tuple[str, int]]) -> Column:
        return F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("t")) for k, t in some])

    def passed(some: Column) -> Column:
        return F.size(F.filter(some, lambda s: (s["k"] < key) | ((s["k"] == key) & (s["t"] <= tie))))

    blocks = [starts[i : i + COARSE] for i in range(0, len(starts), COARSE)]
    block = passed(pairs([b[0] for b in blocks]))
    within = passed(F.element_at(F.array(*map(pairs, blocks)), F.greatest(block, F.lit(1))))
    return F.when(block == 0, 0).otherwise((block - 1) * COARSE + within)


def sweep(intervals: DataFrame, reads: DataFrame, depth: int) -> DataFrame:
    """``reads`` with ``stack``, the payloads of the intervals that hold the key, from the widest to the narrowest.

    ``intervals(key, payload)`` hold all keys that begin with ``key``; keys are distinct, so of
    two intervals one lies in the other or they are apart. ``depth`` is the most that nest.
    ``reads`` has a ``key`` and a ``tie``, a hash that spreads equal keys.
    """
    spark = reads.sparkSession
    starts = _range_starts(reads.select("key", "tie"))
    at = _range_of(F.col("key"), F.col("tie"), starts)
    least = F.lit(-(1 << 63))
    rules = intervals.select("key", least.alias("tie"), "payload")
    own = rules.withColumn("range", _range_of(F.col("key"), F.col("tie"), starts))
    # Intervals open where a range begins: their keys begin the range's first key.
    if starts:
        firsts = spark.createDataFrame([(i + 1, k) for i, (k, _) in enumerate(starts)], "range int, first string")
        sizes = F.sequence(F.lit(1), F.length("first"))
        heads = firsts.where("first <> ''").select("range", F.explode(F.transform(sizes, lambda n: F.col("first").substr(F.lit(1), n))).alias("head"))
        opened = rules.join(heads, F.col("key") == F.col("head")).select("key", "tie", "payload", "range")
        own = own.unionByName(opened).distinct()
    empty = F.lit(None).cast(reads.select(F.struct(*reads.columns)).schema[0].dataType)
    events = own.select("range", "key", "tie", F.lit(OPENS).alias("kind"), "payload", empty.alias("row"))
    read = reads.select(
        at.cast("int").alias("range"), "key", "tie", F.lit(READS).alias("kind"), F.lit(None).cast(dict(intervals.dtypes)["payload"]).alias("payload"), F.struct(*reads.columns).alias("row")
    )
    events = events.unionByName(read)
    # An interval closes at the first key that does not begin with its own. The stack has one
    # place for each depth: the last interval opened at that depth, if it still holds the key.
    order = Window.partitionBy("range").orderBy("key", "tie", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    places = [
        F.last(F.when((F.col("kind") == OPENS) & (F.col("payload.depth") == d), F.struct(F.col("key").alias("open"), "payload")), ignorenulls=True).over(order)
        for d in range(1, max(depth, 1) + 1)
    ]
    swept = events.select("kind", "row", "key", F.array(*places).alias("places"))
    held = F.filter("places", lambda p: p.isNotNull() & F.col("key").startswith(p["open"]))
    return swept.where(F.col("kind") == READS).select("row.*", F.transform(held, lambda p: p["payload"]).alias("stack"))


def _nested(keys: DataFrame, starts_of: Column) -> DataFrame:
    """Interval keys with ``depth``: how many of the keys begin each one, itself included."""
    heads = keys.select("key", F.explode(starts_of).alias("head"))
    held = heads.join(keys.select(F.col("key").alias("known")), F.col("head") == F.col("known"))
    return held.groupBy("key").agg(F.count("*").cast("int").alias("depth"))


def judge(df: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Each row's id, ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules(host, path, verdict)``: a rule fits its host and all hosts below it where the URL's
    path begins with the rule's path. The longest rule wins, by characters of host and path; of
    equally long ones that with the longer host; of verdicts for one host and path the last in
    the alphabet, so ``block``. Without a fitting rule the rule is NULL and the verdict
    ``default``. A NULL URL, or one without ``://``, has empty host and path and fits no rule.
    Rules with a NULL in host, path or verdict, or with an empty host, fit nothing. Repeated rows
    and ids stay. Only the two columns named are read.
    """
    rules = rules.where("host <> '' and path is not null and verdict is not null")
    rules = stored(rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")), "rules")
    url = F.col(url_col)
    pages = df.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))

    domains = rules.select(reversed_host(F.col("host")).alias("key"), "host").distinct()
    labels = F.split("key", r"\.")
    starts_of = F.transform(
        F.sequence(F.lit(1), F.size(labels) - 1), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit("."))
    )
    domains = stored(domains.join(_nested(domains.select("key"), starts_of), "key"), "domains")
    deep = domains.agg(F.max("depth")).head()[0] or 0
    tie = F.xxhash64("id", "host", "path")
    hosts = pages.withColumn("key", F.when(F.col("host") == "", "").otherwise(reversed_host(F.col("host")))).withColumn("tie", tie)
    inside = sweep(domains.select("key", F.struct("depth", "host").alias("payload")), hosts, deep)
    found = stored(inside.select("id", "host", "path", "tie", F.transform("stack", lambda p: p["host"]).alias("domains")), "inside")

    # Keys of the second sweep: domain and path, with a character between that no host holds.
    paths = rules.select(F.concat("host", F.lit("/"), "path").alias("key"), F.col("host").alias("domain"), F.col("path").alias("begins"), "verdict")
    cut = F.length("domain") + 1
    starts_of = F.transform(F.sequence(cut, F.length("key")), lambda n: F.substring("key", F.lit(1), n))
    paths = stored(paths.join(_nested(paths.select("key", "domain"), starts_of), "key"), "paths")
    deep = paths.agg(F.max("depth")).head()[0] or 0
    reads = found.select("id", "host", "path", "tie", F.posexplode_outer("domains").alias("at", "domain"))
    reads = reads.withColumn("key", F.coalesce(F.concat("domain", F.lit("/"), "path"), F.lit("")))
    ruled = sweep(paths.select("key", F.struct("depth", "domain", "begins", "verdict").alias("payload")), reads, deep)
    best = F.element_at("stack", -1)
    best = F.when(F.size("stack") > 0, F.struct((F.length(best["domain"]) + F.length(best["begins"])).alias("long"), F.length(best["domain"]).alias("wide"), F.concat(best["domain"], best["begins"]).alias("rule"), best["verdict"].alias("verdict")))
    # A row comes once for each domain it lies in, so equal rows are as many as those at the first.
    once = F.count(F.when(F.coalesce("at", F.lit(0)) == 0, 1))
    judged = ruled.withColumn("best", best).groupBy("id", "host", "path").agg(F.max("best").alias("best"), once.alias("n"))
    rows = judged.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return rows.select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
