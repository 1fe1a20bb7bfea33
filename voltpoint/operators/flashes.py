"""Flash grouping: points that follow each other closely in time and space.

Two points are linked when they are at most ``max_gap_ns`` and ``max_km`` apart;
a flash is a connected component of links. Pairs of points are not listed.
Points fall into cells so small that all points of a cell are linked, and from
there on a cell is one node with the box of its points, however many it holds.
Two cells near each other are linked where their boxes say so, not linked where
the boxes are too far apart, and otherwise decided by their points: by comparing
them where they are few, by halving the boxes and asking again where they are
many. So a cell with most of the points costs no more than one with few.
"""

from __future__ import annotations

from functools import reduce
from itertools import product
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltpoint.functions.parse import floor_div
from voltpoint.operators.components import components
from voltpoint.sources.scratch import written

AXES = ("t", "x", "y", "z")
#: Pairs of points that two cells may have to be compared directly.
DIRECT_PAIRS = 4096
#: Cells on one side of the origin, and how much wider a cell is than half a link,
#: so that rounding a cell's number never puts linked points three cells apart.
MOST_CELLS, WIDER = float(1 << 20), 1 + 2.0**-20

BOX = [f"{side}_{axis}" for axis in AXES for side in ("low", "high")]


def _box() -> list[Column]:
    found = [F.count("*").alias("n"), F.min("id").alias("node")]
    for axis in AXES:
        found += [F.min(axis).alias(f"low_{axis}"), F.max(axis).alias(f"high_{axis}")]
    return found


def _nearest(axis: str) -> Column:
    """Distance of two boxes along an axis, 0 where they overlap."""
    a, b = F.col(f"a.low_{axis}") - F.col(f"b.high_{axis}"), F.col(f"b.low_{axis}") - F.col(f"a.high_{axis}")
    return F.greatest(a, b, F.lit(0).cast("bigint" if axis == "t" else "double"))


def _farthest(axis: str) -> Column:
    a, b = F.col(f"a.high_{axis}") - F.col(f"b.low_{axis}"), F.col(f"b.high_{axis}") - F.col(f"a.low_{axis}")
    return F.greatest(a, b)


def _within(distance, gap: int, reach: float) -> Column:
    """Whether the distances along the axes are those of a link."""
    x, y, z = distance("x"), distance("y"), distance("z")
    return (distance("t") <= F.lit(gap)) & (x * x + y * y + z * z <= F.lit(reach * reach))


def _judged(pairs: DataFrame, gap: int, reach: float) -> DataFrame:
    """Pairs of boxes ``a``, ``b`` that may be linked, and whether they surely are."""
    return pairs.where(_within(_nearest, gap, reach)).withColumn("sure", _within(_farthest, gap, reach))


def _half_offsets() -> list[tuple[int, ...]]:
    """A cell's neighbours, one of each opposite pair, and the cell itself."""
    return [o for o in product((-1, 0, 1), repeat=4) if o >= (0, 0, 0, 0)]


def _neighbours(cells: DataFrame) -> DataFrame:
    """Pairs of cells that are at most a link apart, by blocks of two cells along
    each axis of space and one in time; a block holds eight cells at most."""
    block = [F.col("ct"), *[F.shiftright(f"c{axis}", 1) for axis in "xyz"]]
    right = cells.select(F.struct(*cells.columns).alias("b"), *[c.alias(f"k{i}") for i, c in enumerate(block)])
    offsets = F.array(*[F.struct(*[F.lit(v).alias(f"o{i}") for i, v in enumerate(o)]) for o in _half_offsets()])
    left = cells.select(F.struct(*cells.columns).alias("a"), *[c.alias(f"g{i}") for i, c in enumerate(block)], F.explode(offsets).alias("o"))
    left = left.select("a", *[(F.col(f"g{i}") + F.col(f"o.o{i}")).alias(f"k{i}") for i in range(4)], (F.greatest(*[F.abs(f"o.o{i}") for i in range(4)]) == 0).alias("same"))
    pairs = left.join(right, [f"k{i}" for i in range(4)])
    return pairs.where(~F.col("same") | (F.col("a.node") < F.col("b.node"))).select("a", "b")


def _direct(points: DataFrame, pairs: DataFrame, gap: int, reach: float) -> DataFrame:
    """The roots of pairs of cells of which two points are linked."""
    side = lambda name: points.select(F.col("cell").alias(f"{name}_cell"), *[F.col(c).alias(f"{name}_{c}") for c in AXES])
    both = pairs.join(side("a"), F.col("a.node") == F.col("a_cell")).join(side("b"), F.col("b.node") == F.col("b_cell"))
    return both.where(_within(lambda c: F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")), gap, reach)).select("root").distinct()


def _middle(axis: str) -> Column:
    """A value that is less than the upper end of a box, unless that is all it has."""
    low, high = F.col(f"low_{axis}"), F.col(f"high_{axis}")
    if axis == "t":
        return low + floor_div(high - low, 2)
    middle = low + (high - low) / 2
    return F.when(middle < high, middle).otherwise(low)


def _halved(points: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The points of these pairs in cells halved along every axis, and the pairs
    of the new cells."""
    cells = pairs.select("a.*").unionByName(pairs.select("b.*")).select("node", *BOX).distinct()
    inside = points.join(cells, F.col("cell") == F.col("node"))
    upper = [(F.col(c) > _middle(c)).cast("int") for c in AXES]
    part = reduce(lambda x, y: x * 2 + y, upper)
    inside = written(inside.select("cell", "id", *AXES, part.alias("part")))
    boxes = written(inside.groupBy("cell", "part").agg(*_box()))
    smaller = boxes.select(F.col("cell").alias("whole"), F.struct("node", "n", *BOX).alias("box"))
    again = (
        pairs.select("root", F.col("a.node").alias("a_node"), F.col("b.node").alias("b_node"))
        .join(smaller.select(F.col("whole").alias("a_node"), F.col("box").alias("a")), "a_node")
        .join(smaller.select(F.col("whole").alias("b_node"), F.col("box").alias("b")), "b_node")
    )
    names = boxes.select(F.col("cell").alias("whole"), F.col("part").alias("of"), "node")
    moved = inside.join(names, (F.col("cell") == F.col("whole")) & (F.col("part") == F.col("of")))
    return moved.select(F.col("node").alias("cell"), "id", *AXES), again.select("root", "a", "b")


def _links(points: DataFrame, cells: DataFrame, gap: int, reach: float) -> DataFrame:
    """``(a, b)``: nodes of cells that are linked."""
    boxed = cells.select("node", "n", *BOX, *[f"c{axis}" for axis in AXES])
    slim = lambda side: F.struct(*[F.col(f"{side}.{c}").alias(c) for c in ("node", "n", *BOX)]).alias(side)
    pairs = _neighbours(boxed).select(F.struct(F.col("a.node").alias("a"), F.col("b.node").alias("b")).alias("root"), slim("a"), slim("b"))
    found = None
    while True:
        judged = written(_judged(pairs, gap, reach))
        sure = judged.where("sure").select("root").distinct()
        open_pairs = judged.where("not sure").join(sure, "root", "left_anti").select("root", "a", "b")
        few = F.col("a.n") * F.col("b.n") <= DIRECT_PAIRS
        linked = written(sure.unionByName(_direct(points, open_pairs.where(few), gap, reach)).distinct())
        found = linked if found is None else found.unionByName(linked)
        many = written(open_pairs.where(~few).join(linked, "root", "left_anti"))
        if many.isEmpty():
            return found.select("root.a", "root.b")
        points, pairs = _halved(points, many)


def flash_groups(
    points: DataFrame, id_column: str, *, max_gap_ns: int, max_km: float, km_per_lon: float, km_per_lat: float
) -> DataFrame:
    """``points`` with ``flash_id``, the smallest id of the point's flash.

    Ids are integers and differ; every threshold is the caller's. Points with no
    time or coordinate, or one beyond 2**20 cells, have no flash (NULL); a point
    near no other is a flash of its own."""
    side = float(max_km) / 2 * WIDER
    where = {"x": F.col("lon").cast("double") * F.lit(km_per_lon), "y": F.col("lat").cast("double") * F.lit(km_per_lat), "z": F.col("alt").cast("double")}
    placed = points.select(F.col(id_column).cast("bigint").alias("id"), F.col("epoch_ns").alias("t"), *[v.alias(c) for c, v in where.items()])
    outside = [F.col(c).isNull() | F.isnan(c) | (F.abs(c) >= F.lit(MOST_CELLS * side)) for c in "xyz"]
    placed = placed.where(F.col("id").isNotNull() & F.col("t").isNotNull() & ~reduce(or_, outside))
    numbers = {"ct": floor_div(F.col("t"), max_gap_ns)} | {f"c{c}": F.floor(F.col(c) / F.lit(side)) for c in "xyz"}
    placed = placed.select("*", *[v.alias(k) for k, v in numbers.items()])
    cells = written(placed.groupBy(*numbers).agg(*_box()))
    homes = cells.select(*[F.col(k).alias(f"_{k}") for k in numbers], F.col("node").alias("cell"))
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in numbers])
    at_home = written(placed.join(homes, same).select("cell", "id", *AXES))
    roots = components(_links(at_home, cells, max_gap_ns, float(max_km)))
    flashes = at_home.join(roots, F.col("cell") == F.col("node"), "left").select(F.col("id").alias("_id"), F.coalesce("root", "cell").alias("flash_id"))
    return points.join(flashes, F.col(id_column) == F.col("_id"), "left").select(*[points[c] for c in points.columns], "flash_id")


def flash_summary(groups: DataFrame) -> DataFrame:
    """``flash_id, sources, t_min_ns, t_max_ns`` and the centre of each flash."""
    centre = [F.avg(F.col(c).cast("double")).alias(f"{c}_mean") for c in ("lon", "lat", "alt")]
    some = groups.where(F.col("flash_id").isNotNull())
    return some.groupBy("flash_id").agg(F.count("*").alias("sources"), F.min("epoch_ns").alias("t_min_ns"), F.max("epoch_ns").alias("t_max_ns"), *centre)
