"""Mixing sources to target weights by weighted fair queueing (operator 4), with DataFrame functions only.

Each source is a queue of its documents in shuffled order, passed through again up to ``most``
times. A document's virtual finish time is the words its source has then given, divided by
the source's target. Taken in that order over all sources, the queues advance in proportion
to their targets, and the order is cut where the budget is spent.

Prefix sums are taken in two steps, so that no source, however large, is one task: shuffled
documents fall into many bins of a source, bins are summed, and only the running sum inside a
bin is a window. The global order is cut into ranges of equal virtual time, which hold equal
shares of the words by design; all that precedes the range where the budget ends is taken as it
is, and only that range is sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skillstrata.llm.common import count_words, partitions, stored

KEYS = ("id", "source", "size", "digest")
BINS_PER_PARTITION, RANGES_PER_PARTITION = 4, 16


def targets(sizes: DataFrame, weights: DataFrame, share: float, most: float) -> DataFrame:
    """``(source, source_size, target)``: ``share`` of all words dealt by weight, ``most`` times a source's size at most.

    What a full source cannot take is dealt again to the others by weight. ``sizes`` and
    ``weights`` have one row a source, and so has each step here. A source without a positive
    weight has target 0.
    """
    known = sizes.alias("s").join(weights.alias("w"), F.col("s.source").eqNullSafe(F.col("w.source")), "left")
    known = known.select(
        "s.source", "source_size", F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("weight")
    )
    # By the weight's price at which a source is full: those before it are full, the rest share what is left.
    everything = Window.partitionBy()
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    known = known.withColumn("limit", F.lit(float(most)) * F.col("source_size"))
    known = known.withColumn("full_at", F.when(F.col("weight") > 0, F.col("limit") / F.col("weight")))
    total = known.agg(F.sum("source_size")).head()[0] or 0
    left = F.lit(float(share) * total) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    dealt = known.where("full_at is not null").withColumn("price", left / weight)
    dealt = dealt.withColumn("at", F.row_number().over(order))
    open_price = F.min(F.when(F.col("full_at") > F.col("price"), F.struct("at", "price"))).over(everything)["price"]
    dealt = dealt.withColumn("open_price", open_price).select(
        "source",
        "source_size",
        F.when(F.col("open_price").isNull() | (F.col("full_at") <= F.col("open_price")), F.col("limit"))
        .otherwise(F.col("open_price") * F.col("weight"))
        .alias("target"),
    )
    return dealt.unionByName(known.where("full_at is null").select("source", "source_size", F.lit(0.0).alias("target")))


def _in_order(groups: DataFrame, aims: DataFrame, seed: int) -> DataFrame:
    """Groups of equal rows with ``begin``, the words of their source before them in shuffled order."""
    bins = BINS_PER_PARTITION * partitions(groups.sparkSession)
    groups = groups.withColumn("h", F.xxhash64(F.lit(seed), *KEYS)).withColumn("bin", F.pmod("h", F.lit(bins)))
    groups = groups.withColumn("words", F.col("size") * F.col("n"))
    place = Window.partitionBy("source", "bin").orderBy("h", *KEYS)
    inside = F.coalesce(F.sum("words").over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    sums = groups.groupBy("source", "bin").agg(F.sum("words").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("source").alias("bin_source"), F.col("bin").alias("at"), F.coalesce(F.sum("words").over(earlier), F.lit(0).cast("long")).alias("bin_begin")
    )
    aims = aims.select(F.col("source").alias("aim_source"), "source_size", "target")
    placed = groups.withColumn("inside", inside)
    placed = placed.join(sums, (F.col("bin") == F.col("at")) & F.col("source").eqNullSafe(F.col("bin_source")))
    placed = placed.join(aims, F.col("source").eqNullSafe(F.col("aim_source")))
    return placed.select(*KEYS, "n", "h", "source_size", "target", (F.col("bin_begin") + F.col("inside")).alias("begin"))


def copies(df: DataFrame, weights: DataFrame, share: float = 1.5, most: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each group of equal ``(id, source, size, digest)``: its number of rows ``n``
    and ``taken_copies``, how often the mix takes one of them."""
    spark = df.sparkSession
    rows = df.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), count_words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("digest")
    )
    groups = stored(rows.groupBy(*KEYS).agg(F.count("*").alias("n")), "sizes")
    sizes = stored(groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), "sources")
    aims = stored(targets(sizes, weights, share, most), "targets")
    ordered = stored(_in_order(groups, aims, seed), "ordered")
    budget = int(aims.agg(F.sum("target")).head()[0] or 0)

    ranges = RANGES_PER_PARTITION * partitions(spark)
    passes = F.sequence(F.lit(0), F.lit(int(most) - 1))
    playable = (F.col("size") > 0) & (F.col("target") > 0)
    items = ordered.where(playable).withColumn("turn", F.explode(passes)).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    given = F.col("turn") * F.col("source_size") + F.col("begin") + F.col("copy") * F.col("size")
    items = items.withColumn("finish", given / F.col("target"))
    items = items.withColumn("range", F.least(F.floor(F.col("finish") * ranges), F.lit(2 * ranges)))
    # At most 2 * ranges + 1 rows.
    until = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = items.groupBy("range").agg(F.sum("size").alias("words")).withColumn("until", F.sum("words").over(until))
    cut = sums.where(F.col("until") > budget).orderBy("range").select("range", budget - (F.col("until") - F.col("words"))).head()
    at, left = (int(cut[0]), int(cut[1])) if cut else (2 * ranges + 1, 0)

    whole = items.withColumn("taken", (F.col("range") < at).cast("long"))
    order = Window.partitionBy("range").orderBy("finish", "h", *KEYS, "turn", "copy")
    edge = items.where(F.col("range") == at).withColumn("spent", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    edge = edge.withColumn("taken", (F.col("spent") <= left).cast("long"))
    columns = [*KEYS, "n", "source_size", "target", "taken"]
    rest = ordered.where(~playable).withColumn("taken", F.lit(0).cast("long"))
    parts = whole.where(F.col("range") != at).select(columns).unionByName(edge.select(columns)).unionByName(rest.select(columns))
    return parts.groupBy(*KEYS, "n", "source_size", "target").agg(F.sum("taken").alias("taken_copies"))


def mix(df: DataFrame, weights: DataFrame, share: float = 1.5, most: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Each row's id, source, ``size`` in words, ``source_size``, ``target`` and ``taken``, the words the mix takes of it.

    ``weights(source, weight)`` has one row a source; NULL is a source like any other. The mix
    holds ``share`` times all words, whole documents only and none more than ``most`` times.
    NULL and empty texts have size 0 and are taken for nothing. Equal rows share what is taken
    of them as evenly as whole copies allow. Runs with the same ``seed`` agree. An empty table
    gives an empty result.
    """
    groups = copies(df, weights, share, most, seed, id_col, text_col, source_col)
    rows = groups.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    taken = F.expr("taken_copies div n + if(row <= taken_copies % n, 1, 0)")
    return rows.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (taken * F.col("size")).cast("long").alias("taken")
    )


def mixed(df: DataFrame, weights: DataFrame, share: float = 1.5, most: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of the mix, all columns kept: a row as many times as the mix takes it."""
    groups = copies(df, weights, share, most, seed, id_col, text_col, source_col).where("taken_copies > 0")
    groups = groups.select(*[F.col(k).alias(f"_{k}") for k in KEYS], F.col("n").alias("_n"), F.col("taken_copies").alias("_copies"))
    rows = df.withColumns({"_row_size": count_words(F.col(text_col)), "_row_digest": F.xxhash64(text_col)})
    on = (
        F.col(id_col).eqNullSafe(F.col("_id"))
        & F.col(source_col).eqNullSafe(F.col("_source"))
        & (F.col("_row_size") == F.col("_size"))
        & (F.col("_row_digest") == F.col("_digest"))
    )
    rows = rows.join(groups, on)
    single = rows.where("_n = 1").withColumn("_times", F.col("_copies"))
    # Rows that are equal in id, source and text: numbered, so that the odd copies go to the first.
    place = Window.partitionBy("_id", "_source", "_size", "_digest").orderBy(F.monotonically_increasing_id())
    several = rows.where("_n > 1").withColumn("_times", F.expr("_copies div _n")).withColumn("_row", F.row_number().over(place))
    several = several.withColumn("_times", F.expr("_times + if(_row <= _copies % _n, 1, 0)")).drop("_row")
    out = single.unionByName(several).where("_times > 0")
    return out.withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), "_times"))).select([F.col(f"`{c}`") for c in df.columns])


def cycled_weights(df: DataFrame, cycle: tuple[float, ...], source_col: str = "source") -> DataFrame:
    """``(source, weight)``: the sources by code point, NULL last, with the weights of ``cycle`` over and over."""
    sources = df.select(F.col(source_col).alias("source")).distinct()  # one row a source
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (place % len(cycle) + 1).cast("int")))
