"""Layout and sampling: leaves, spacing, uniform samples, thinning, strides, budgets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.columns import cell

LEAF_POINTS = 400_000


def thin(cloud: DataFrame, spacing: float) -> DataFrame:
    """One point for each voxel: the least gid."""
    voxel = [cell(F.col(c), max(spacing, 1e-5)).alias(f"v{c}") for c in "xyz"]
    first = cloud.groupBy(*voxel).agg(F.min("gid").alias("gid")).select("gid")
    return cloud.join(first, "gid", "left_semi")


def stride(cloud: DataFrame, n: int) -> DataFrame:
    return cloud.where(F.pmod("gid", F.lit(n)) == 0)


def with_leaf(cloud: DataFrame, size: float) -> DataFrame:
    return cloud.withColumn("leaf", F.concat_ws("_", *[cell(F.col(c), size) for c in "xyz"]))


def octree(cloud: DataFrame, size: float, most: int = LEAF_POINTS, depth: int = 12) -> DataFrame:
    """Adds ``leaf``: a cube of ``size``, halved wherever it holds more than ``most`` points. Each level is one count by key."""
    out = cloud.withColumn("leaf", F.concat_ws("_", *[cell(F.col(c), size) for c in "xyz"]))
    for level in range(1, depth + 1):
        big = out.groupBy("leaf").count().where(F.col("count") > most).select("leaf")
        if big.isEmpty():
            break
        child = F.concat_ws(":", "leaf", F.concat_ws("_", *[F.pmod(cell(F.col(c), size / 2**level), F.lit(2)) for c in "xyz"]))
        marked = out.join(big.withColumn("_big", F.lit(True)), "leaf", "left")
        out = marked.withColumn("leaf", F.when(F.col("_big"), child).otherwise(F.col("leaf"))).drop("_big")
    return out


def prefix_sample(leaved: DataFrame, n: int) -> DataFrame:
    """The first n points of each leaf in a shuffled order: a uniform sample of each."""
    order = Window.partitionBy("leaf").orderBy(F.pmod(F.col("gid") * F.lit(2654435761), F.lit(1 << 32)), "gid")
    return leaved.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank")


def leaf_bounds(leaved: DataFrame, size: float) -> DataFrame:
    """(leaf, n, bounds, spacing): tight bounds, and the spacing its largest face would have."""
    ends = [f(c).alias(f"{c}{n}") for c in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))]
    out = leaved.groupBy("leaf").agg(F.count("*").alias("n"), *ends)
    w = {c: F.col(f"{c}max") - F.col(f"{c}min") for c in "xyz"}
    face = F.greatest(w["x"] * w["y"], w["y"] * w["z"], w["x"] * w["z"])
    return out.withColumn("spacing", F.least(F.greatest(F.sqrt(face / F.col("n")), F.lit(1e-4)), F.lit(size / 2)))


def median_spacing(bounds: DataFrame, least: int = 64) -> DataFrame:
    """(spacing): the upper median over leaves of more than ``least`` points, 0.05 where there are none. A row for each leaf is ranked."""
    rows = bounds.where(F.col("n") > least).withColumn("k", F.row_number().over(Window.orderBy("spacing")) - 1).withColumn("all", F.count("*").over(Window.partitionBy()))
    return rows.agg(F.coalesce(F.max(F.when(F.col("k") == F.floor(F.col("all") / 2), F.col("spacing"))), F.lit(0.05)).alias("spacing"))


def cloud_spacing(cloud: DataFrame) -> float:
    """The median spacing over a cloud's own octree leaves; 0.05 for clouds too small or too flat to tell."""
    ends = cloud.agg(*[f(c).alias(f"{c}{n}") for c in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
    if ends["xlo"] is None:
        return 0.05
    size = max(ends[f"{c}hi"] - ends[f"{c}lo"] for c in "xyz")
    if not 0 < size < math.inf:
        return 0.05
    return float(median_spacing(leaf_bounds(octree(cloud, size), size)).first()[0])


def budget(leaves: DataFrame, points: int) -> DataFrame:
    """(leaf, take): nearest leaves first, whole while the budget lasts. ``leaves``: (leaf, n, dist)."""
    before = F.coalesce(F.sum("n").over(Window.orderBy("dist", "leaf").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return leaves.withColumn("_before", before).select("leaf", F.greatest(F.least("n", F.lit(points) - F.col("_before")), F.lit(0)).alias("take"))


#: Fixed value: the share of its wish that a leaf keeps when room is short.
KEPT = 0.12


def allocate(leaves: DataFrame, points: int, density: float, floor: float = KEPT) -> DataFrame:
    """(leaf, take): what to draw of leaves (leaf, n, dist, pixels), where pixels is a leaf's radius on the screen.

    A leaf wants ``density`` points for each pixel of its disc, at most all it has. Room left over is shared out in
    proportion; where room is short every leaf keeps ``floor`` of its wish, then the nearest are filled first."""
    wish = F.least(F.col("n").cast("double"), F.ceil(F.col("pixels") * F.col("pixels") * float(density * math.pi)).cast("double"))
    rows = leaves.select("leaf", "n", "dist", wish.alias("want"))
    room = float(points)
    whole = rows.agg(F.sum("want").alias("all"))
    rows = rows.crossJoin(F.broadcast(whole)).withColumn("scale", F.when(F.col("all") > 0, F.lit(room) / F.col("all")).otherwise(1.0))
    full = F.col("want") * F.col("scale") >= F.col("n")
    shares = rows.agg(F.sum(F.when(full, F.col("n"))).alias("capped"), F.sum(F.when(~full, F.col("want"))).alias("open"))
    rows = rows.crossJoin(F.broadcast(shares))
    second = F.when(F.col("open") > 0, F.greatest(F.lit(1.0), (F.lit(room) - F.coalesce("capped", F.lit(0))) / F.col("open"))).otherwise(F.col("scale"))
    spread = F.least(F.col("n").cast("double"), F.floor(F.col("want") * F.when(full, F.col("scale")).otherwise(second)))
    least = F.least(F.col("n").cast("double"), F.ceil(F.col("want") * float(floor)))
    rows = rows.select("leaf", "dist", "all", spread.alias("spread"), least.alias("least"), (F.col("want") - least).alias("more"))
    nearest = Window.orderBy("dist", "leaf").rowsBetween(Window.unboundedPreceding, -1)  # a row for each leaf
    left = F.lit(room) - F.sum("least").over(Window.partitionBy()) - F.coalesce(F.sum("more").over(nearest), F.lit(0.0))
    filled = F.col("least") + F.greatest(F.least("more", left), F.lit(0.0))
    return rows.select("leaf", F.when(F.col("all") <= room, F.col("spread")).otherwise(filled).cast("long").alias("take"))


#: Fixed value: steps of a quantised coordinate along its leaf.
STEPS = 65536


def quantise(leaved: DataFrame, size: float) -> DataFrame:
    """Adds qx, qy, qz: whole steps from the low corner of the leaf's cube, held inside it."""
    step = lambda c: F.least(F.greatest(F.floor((F.col(c) - cell(F.col(c), size) * size) / size * float(STEPS)), F.lit(0)), F.lit(STEPS - 1))
    return leaved.withColumns({f"q{c}": step(c).cast("int") for c in "xyz"})


def preview(cloud: DataFrame, most: int = 1_200_000) -> DataFrame:
    """Every k-th point by id, so that about ``most`` stay."""
    return stride(cloud, max(1, cloud.count() // most))


def prune(leaves: DataFrame, reference: DataFrame, reach: float, size: float) -> DataFrame:
    """The ``reference`` leaves whose box, grown by ``reach``, meets that of a leaf: what a search needs to read.

    Boxes meet in cells of ``size``, so this is an equi-join on cells and then the exact test."""
    span = lambda c, grow: F.sequence(cell(F.col(f"{c}min") - grow, size), cell(F.col(f"{c}max") + grow, size))
    here, there = leaves.select(*[F.col(f"{c}{e}") for c in "xyz" for e in ("min", "max")]), reference
    for c in "xyz":
        here, there = here.withColumn(f"c{c}", F.explode(span(c, 0.0))), there.withColumn(f"d{c}", F.explode(span(c, reach)))
    here = here.select(*[F.col(f"{c}{e}").alias(f"_{c}{e}") for c in "xyz" for e in ("min", "max")], "cx", "cy", "cz")
    on = F.lit(True)
    for c in "xyz":
        on = on & (F.col(f"c{c}") == F.col(f"d{c}")) & (F.col(f"{c}min") - reach <= F.col(f"_{c}max")) & (F.col(f"{c}max") + reach >= F.col(f"_{c}min"))
    return there.join(here, on, "left_semi").select(reference.columns).distinct()


def class_field(cloud: DataFrame, column: str = "cls") -> DataFrame:
    """Adds the class as ``field`` where it tells points apart: with fewer than two values there is no field."""
    several = cloud.agg((F.count_distinct(column) >= 2).alias("_several"))
    return cloud.crossJoin(F.broadcast(several)).where("_several").withColumn("field", F.col(column).cast("double")).drop("_several")


def default_voxel(spacing: Column) -> Column:
    """The width of a surface's voxels in centimetres for a spacing in metres: two spacings to half a centimetre, 1 to 60."""
    return F.floor(F.least(F.greatest(spacing * 200.0, F.lit(1.0)), F.lit(60.0)) * 2.0 + 0.5) / 2.0


def merge(layers: list[DataFrame]) -> DataFrame:
    """All layers' points; ids go on from the layer before."""
    out, last = layers[0], layers[0].agg(F.max("gid")).first()[0]
    for layer in layers[1:]:
        start = (last + 1) if last is not None else 0
        out = out.unionByName(layer.withColumn("gid", F.col("gid") + F.lit(start)), allowMissingColumns=True)
        top = layer.agg(F.max("gid")).first()[0]
        last = start + top if top is not None else last
    return out
