"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight that changes with training time t in [0, 1]. The
integral of the schedule up to t is the share of the source's words that are due
by then, so its inverse gives the time at which each document, in the source's
shuffled order, is read. Everything is DataFrame functions; prefix sums run over
a tree of hash ranges, so no window holds more than a bounded part of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltpoint.llm.common import n_words, staged

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: How steeply those weights change: w(t) = weight * (1 + slope * (2 t - 1)).
SLOPES = (-0.5, 0.0, 0.5)
#: Words of the mix per word of the input, and the most a source is repeated.
SHARE, MOST = 1.5, 2
#: Rows of a leaf and children of a node in the tree of hash ranges.
LEAF, COARSE = 64, 1024
#: Sources are configured one by one; more than this are refused.
MAX_SOURCES = 100_000


def order_key(doc_id: Column, text: Column) -> Column:
    """60 pseudo-random bits of the id and the text, so that texts without an id
    of their own are dealt out, too; the same on every run."""
    both = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("/"), F.coalesce(F.md5(text.cast("binary")), F.lit("")))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, 15), 16, 10).cast("bigint")


def _pick(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (index % len(values) + 1).cast("int"))


def source_targets(sized: DataFrame, weights=WEIGHTS, slopes=SLOPES, share=SHARE, most=MOST) -> DataFrame:
    """``i, src, rows, source_size, target, slope`` for every source.

    Targets are shares by weight; those above ``most`` times their source's size
    stop there and the rest is shared anew. That ends at one level per unit of
    weight, the highest that is reached when sources are closed in the order of
    size over weight."""
    stats = sized.groupBy("src").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("src").asc_nulls_last())
    index = F.row_number().over(by_name) - 1
    guard = F.when(index >= MAX_SOURCES, F.raise_error(F.lit("too many sources for a mixture"))).otherwise(index)
    named = stats.withColumn("i", guard.cast("bigint"))
    named = named.withColumn("w", _pick(weights, F.col("i"))).withColumn("slope", _pick(slopes, F.col("i")))
    named = named.withColumn("cap", F.col("source_size") * F.lit(most))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "i").rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(all_of) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0))
    weight = F.sum("w").over(all_of) - F.coalesce(F.sum("w").over(by_ratio), F.lit(0.0))
    levels = named.withColumn("level", left / weight)
    level = F.max("level").over(all_of)
    return levels.select(
        "i", "src", "rows", "source_size", F.least(F.col("cap").cast("double"), F.col("w") * level).alias("target"), "slope"
    )


def _before(total: str, window) -> Column:
    return F.coalesce(F.sum(total).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _sized(docs: DataFrame, source: str, carry: list[str]) -> DataFrame:
    return docs.select(
        F.struct(*carry).alias("doc"),
        F.col(source).alias("src"),
        order_key(F.col("doc_id"), F.col("text")).alias("h"),
        F.xxhash64("text").alias("tie"),
        n_words(F.col("text")).alias("size"),
    )


def mix_plan(docs: DataFrame, source: str = "source", carry: list[str] | None = None, **options) -> DataFrame:
    """``doc, size, source_size, target, taken, positions`` for every document;
    ``doc`` holds the columns named by ``carry``, by default all.

    A source's documents follow one another in the order of a hash of their id.
    The mix goes round in that order until the target is met, and takes a
    document once more if the middle of that copy lies below the target, so it
    misses by half a document at most and takes none more than ``most`` times.
    ``positions`` are the training times of the copies.

    Sizes are words; null and empty texts have none and are never read. A null
    source is a source; a null id sorts as the empty string. Equal rows are
    interchangeable. An empty table gives an empty plan."""
    sized = _sized(docs, source, docs.columns if carry is None else carry)
    if carry is None or "text" in carry:
        counted = staged(sized.select("src", "h", "size"), "sizes")
    else:
        counted = sized = staged(sized, "sizes")
    # A source's hash range is cut into `leaves` ranges below `nodes`.
    leaves = F.greatest(F.lit(1), F.ceil(F.col("rows") / LEAF)).cast("bigint")
    # At most MAX_SOURCES short rows, which source_targets checks.
    targets = F.broadcast(source_targets(counted, **options).withColumn("leaves", leaves).withColumnRenamed("src", "its"))

    def placed(frame: DataFrame) -> DataFrame:
        leaf = F.floor(F.col("h").cast("double") / float(1 << 60) * F.col("leaves"))
        return (
            frame.join(targets, F.col("src").eqNullSafe(F.col("its")))
            .drop("src", "its")
            .withColumn("leaf", F.least(leaf, F.col("leaves") - 1))
        )

    node = F.floor(F.col("leaf") / F.ceil(F.col("leaves") / COARSE))
    leaf_sizes = placed(counted).groupBy("i", "leaf", node.alias("node")).agg(F.sum("size").alias("leaf_size"))
    nodes = leaf_sizes.groupBy("i", "node").agg(F.sum("leaf_size").alias("node_size"))
    nodes = nodes.withColumn("node_before", _before("node_size", Window.partitionBy("i").orderBy("node")))
    in_node = leaf_sizes.withColumn("leaf_before", _before("leaf_size", Window.partitionBy("i", "node").orderBy("leaf")))
    starts = in_node.join(nodes, ["i", "node"]).select("i", "leaf", (F.col("leaf_before") + F.col("node_before")).alias("leaf_start"))
    in_leaf = Window.partitionBy("i", "leaf").orderBy("h", "size", "tie")
    full = placed(sized).withColumn("in_leaf", _before("size", in_leaf)).join(starts, ["i", "leaf"])
    full = full.withColumn("start", F.col("in_leaf") + F.col("leaf_start"))
    # Copy c covers the words [start + c * source_size, + size) of the demand.
    twice_middle = F.col("start") * 2 + F.col("size")
    copies = F.filter(
        F.array(*[F.lit(c).cast("bigint") for c in range(options.get("most", MOST))]),
        lambda c: (F.col("size") > 0) & (twice_middle + c * F.col("source_size") * 2 <= F.col("target") * 2),
    )

    def time(c: Column) -> Column:
        """Where the integral (1 - s) t + s t^2 reaches the copy's share."""
        due = F.least(F.lit(1.0), (twice_middle + c * F.col("source_size") * 2) / (F.col("target") * 2))
        flat = 1 - F.col("slope")
        return 2 * due / (flat + F.sqrt(flat * flat + 4 * F.col("slope") * due))

    planned = full.withColumn("copies", copies).withColumn("positions", F.transform("copies", time))
    taken = (F.size("copies") * F.col("size")).cast("bigint")
    return planned.select("doc", "size", "source_size", "target", taken.alias("taken"), "positions")


def training_order(docs: DataFrame, source: str = "source", **options) -> DataFrame:
    """The mix itself: every taken copy as a row with the input's columns, range
    partitioned and sorted by training position."""
    plan = mix_plan(docs, source, **options)
    copies = plan.select("doc", F.explode("positions").alias("position"))
    return copies.repartitionByRange("position").sortWithinPartitions("position").select("doc.*")


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken`` and
    ``first_position``, null where nothing is taken."""
    return mix_plan(docs, carry=["doc_id"]).select(
        F.col("doc.doc_id").alias("doc_id"), "size", "source_size", "target", "taken", F.array_min("positions").alias("first_position")
    )
