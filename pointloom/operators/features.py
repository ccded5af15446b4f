"""What a neighbourhood says: covariance, fifteen features, normals, and the filters that clean by it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions.columns import eigenvalues, eigenvector, exact_sum
from pointloom.operators.neighbours import nearest, nearest_station, radius_join, radius_sums
from pointloom.plans.lineage import cut

TINY = 1e-18
#: Stations that go to every point as one list.
FEW_STATIONS = 64
#: The features by name.
FEATURES = ("roughness", "curvature", "planarity", "linearity", "sphericity", "anisotropy", "eig1", "eig2", "eig3", "omnivariance", "eigenentropy", "verticality", "volume_density", "surface_density", "neighbours")
MOMENTS = ("xx", "xy", "xz", "yy", "yz", "zz")


def covariance(hits: DataFrame) -> DataFrame:
    """(gid, m, far2, mx, my, mz, xx .. zz): count, squared reach, mean offset and population covariance of neighbours.

    Sums are over offsets from the point, so coordinates far from the origin lose nothing."""
    means = [F.avg(f"d{c}").alias(f"m{c}") for c in "xyz"]
    second = [F.avg(F.col(f"d{p[0]}") * F.col(f"d{p[1]}")).alias(f"_{p}") for p in MOMENTS]
    sums = hits.groupBy("gid").agg(F.count("*").alias("m"), F.max("d2").alias("far2"), *means, *second)
    return sums.select("gid", "m", "far2", "mx", "my", "mz", *[(F.col(f"_{p}") - F.col(f"m{p[0]}") * F.col(f"m{p[1]}")).alias(p) for p in MOMENTS])


def with_eigen(cov: DataFrame) -> DataFrame:
    """Adds l0 <= l1 <= l2, held at 0, and the unit vector v0 of l0."""
    low, mid, high = eigenvalues(*[F.col(p) for p in MOMENTS])
    out = cov.withColumn("_l0", low).withColumn("l1", F.greatest(mid, F.lit(0.0))).withColumn("l2", F.greatest(high, F.lit(0.0)))
    v = eigenvector(F.col("_l0"), *[F.col(p) for p in MOMENTS])
    return out.withColumns({"l0": F.greatest("_l0", F.lit(0.0)), **{f"v{c}": e for c, e in zip("xyz", v, strict=True)}}).drop("_l0")


def _formula(name: str) -> Column:
    l0, l1, l2 = F.col("l0"), F.col("l1"), F.col("l2")
    total, top = F.greatest(l0 + l1 + l2, F.lit(TINY)), F.greatest(l2, F.lit(TINY))
    share = [F.greatest(v / total, F.lit(TINY)) for v in (l0, l1, l2)]
    far = F.greatest(F.sqrt("far2"), F.lit(1e-6))
    return {
        "roughness": F.abs(F.col("mx") * F.col("vx") + F.col("my") * F.col("vy") + F.col("mz") * F.col("vz")),
        "curvature": l0 / total, "planarity": (l1 - l0) / top, "linearity": (l2 - l1) / top, "sphericity": l0 / top, "anisotropy": (l2 - l0) / top,
        "eig1": l2, "eig2": l1, "eig3": l0, "omnivariance": F.pow(l0 * l1 * l2, F.lit(1.0 / 3.0)),
        "eigenentropy": -(share[0] * F.log(share[0]) + share[1] * F.log(share[1]) + share[2] * F.log(share[2])),
        "verticality": F.lit(1.0) - F.abs("vz"),
        "volume_density": F.col("m") / (far * far * far * (4.0 / 3.0 * math.pi)), "surface_density": F.col("m") / (far * far * math.pi),
    }[name]


def feature(cloud: DataFrame, name: str, k: int = 16, radius: float = 0.1, cell: float = 0.1) -> DataFrame:
    """(gid, value): of the k nearest and the point itself, found within 16 cells; null where fewer than 4 are."""
    if name == "neighbours":
        return radius_join(cloud, radius).groupBy("gid").agg((F.count("*") - 1).cast("double").alias("value"))
    shape = with_eigen(covariance(nearest(cloud, k + 1, reach=16 * cell)))
    return shape.select("gid", F.when(F.col("m") >= 4, _formula(name)).alias("value"))


def features(cloud: DataFrame, names=FEATURES[:-1], k: int = 16, cell: float = 0.1) -> DataFrame:
    """Several features from one neighbour search."""
    shape = with_eigen(covariance(nearest(cloud, k + 1, reach=16 * cell)))
    return shape.select("gid", *[F.when(F.col("m") >= 4, _formula(n)).alias(n) for n in names])


def normals(cloud: DataFrame, k: int = 16, cell: float = 0.1) -> DataFrame:
    """(gid, nx, ny, nz): the direction of least spread of the k nearest and the point; null below 3."""
    shape = with_eigen(covariance(nearest(cloud, k + 1, reach=16 * cell)))
    return shape.select("gid", *[F.when(F.col("m") >= 3, F.col(f"v{c}")).alias(f"n{c}") for c in "xyz"])


def face_stations(cloud: DataFrame, stations: DataFrame) -> DataFrame:
    """The cloud with normals turned toward the nearest station, ties to the least sid. Few stations go to the points, which stay
    where they are."""
    if stations.count() <= FEW_STATIONS:
        few = stations.agg(F.collect_list(F.struct("sid", *[F.col(c).cast("double").alias(c) for c in "xyz"])).alias("_few")).where("size(_few) > 0")  # one row
        away = lambda s: [s[c] - F.col(c) for c in "xyz"]
        squared = lambda d: d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
        best = F.array_min(F.transform("_few", lambda s: F.struct(squared(away(s)).alias("d2"), s["sid"].alias("sid"), *[s[c].alias(c) for c in "xyz"])))
        placed = cloud.crossJoin(F.broadcast(few)).withColumn("_best", best)
        toward = sum(((F.col("_best")[c] - F.col(c)) * F.col(f"n{c}") for c in "yz"), (F.col("_best")["x"] - F.col("x")) * F.col("nx"))
        placed = placed.withColumn("_sign", F.when(toward < 0, -1.0).otherwise(1.0))
        return placed.withColumns({f"n{c}": F.col(f"n{c}") * F.col("_sign") for c in "xyz"}).select(cloud.columns)
    near = nearest_station(cloud, stations).join(stations.select("sid", *[F.col(c).alias(f"_{c}") for c in "xyz"]), "sid")
    toward = sum(((F.col(f"_{c}") - F.col(c)) * F.col(f"n{c}") for c in "yz"), (F.col("_x") - F.col("x")) * F.col("nx"))
    sign = F.when(toward < 0, -1.0).otherwise(1.0)
    joined = cloud.join(near.select("gid", "_x", "_y", "_z"), "gid").withColumn("_sign", sign)
    return joined.withColumns({f"n{c}": F.col(f"n{c}") * F.col("_sign") for c in "xyz"}).select(cloud.columns)


def invert_normals(cloud: DataFrame) -> DataFrame:
    return cloud.withColumns({f"n{c}": -F.col(f"n{c}") for c in "xyz"})


def mean_distances(cloud: DataFrame, knn: int, cell: float | None = None) -> DataFrame:
    """(gid, mean): mean distance to the knn - 1 nearest others; 0 where there are none."""
    near = nearest(cloud, knn)
    return near.groupBy("gid").agg(F.coalesce(F.sum(F.sqrt("d2")) / F.nullif(F.count("*") - 1, F.lit(0)), F.lit(0.0)).alias("mean"))


def sor(cloud: DataFrame, knn: int = 8, sigmas: float = 1.0, cell: float | None = None) -> DataFrame:
    """(gid, mean, keep): statistical outlier removal; points farther from their neighbours than the mean and ``sigmas`` spreads go."""
    means = cut(mean_distances(cloud, knn))
    # Shares of the largest add up exactly, whatever the order of rows and the size of the cloud, so the cut is always one.
    top = means.agg(F.coalesce(F.nullif(F.max("mean"), F.lit(0.0)), F.lit(1.0)).alias("top"))  # one row
    share = F.col("mean") / F.col("top")
    total = lambda v: exact_sum(v, 14) / F.nullif(F.count("*"), F.lit(0))
    whole = means.crossJoin(F.broadcast(top)).agg((total(share) * F.max("top")).alias("mu"), (total(share * share) * F.max("top") * F.max("top")).alias("sq"), F.count("*").alias("n"))  # one row
    limit = F.col("mu") + F.sqrt(F.abs(F.col("sq") - F.col("mu") * F.col("mu"))) * sigmas
    keep = (F.col("n") <= knn) | (F.col("mean") <= limit)
    return means.crossJoin(F.broadcast(whole)).select("gid", "mean", keep.cast("int").alias("keep"))


def noise(cloud: DataFrame, sigmas: float = 1.0, radius: float | None = 0.15, knn: int = 8, absolute: float | None = None, drop_isolated: bool = False, cell: float | None = None) -> DataFrame:
    """(gid, keep): a plane through a point's neighbours, itself left out; it stays if near that plane.

    ``radius`` None searches the ``knn`` nearest. Near is within ``absolute``, or within ``sigmas`` spreads of the
    neighbours about the plane, which is the root of the least eigenvalue. Up to three found, itself counted: isolated."""
    if radius is not None:
        sums = radius_sums(cloud, radius)
        means = sums.select("gid", "m", "far2", *[(F.col(f"s{c}") / F.nullif(F.col("m"), F.lit(0))).alias(f"m{c}") for c in "xyz"], *[(F.col(f"s{p}") / F.nullif(F.col("m"), F.lit(0))).alias(f"_{p}") for p in MOMENTS], "found")
        shape = with_eigen(means.select("gid", "m", "far2", "mx", "my", "mz", *[(F.col(f"_{p}") - F.col(f"m{p[0]}") * F.col(f"m{p[1]}")).alias(p) for p in MOMENTS], "found"))
    else:
        hits = nearest(cloud, knn)
        found = hits.groupBy("gid").agg(F.count("*").alias("found"))
        shape = with_eigen(covariance(hits.where("gid <> nb")))
    away = F.abs(F.col("mx") * F.col("vx") + F.col("my") * F.col("vy") + F.col("mz") * F.col("vz"))
    near = away <= (F.lit(absolute) if absolute is not None else F.sqrt("l0") * sigmas)
    keep = F.when(F.col("found") <= 3, F.lit(not drop_isolated)).otherwise(F.coalesce(near, F.lit(True)))
    if radius is not None:  # sums come with the number found; without others the means are null, and so is the plane
        return shape.select("gid", keep.cast("int").alias("keep"))
    return found.join(shape, "gid", "left").select("gid", keep.cast("int").alias("keep"))


def normal_share(cloud: DataFrame) -> float:
    """The share of points that have a normal."""
    return cloud.agg(F.avg(F.col("nx").isNotNull().cast("double"))).first()[0] or 0.0
