"""More of the engine's queries. Their SQL is written out by itself, or says the same in another way; it shares no table
or matrix with the code that it checks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions import columns as C
from pointloom.functions import matrix as M
from pointloom.operators import features as FE
from pointloom.operators import fitting as FI
from pointloom.operators import graph as G
from pointloom.operators import layout as L
from pointloom.operators import mesh as ME
from pointloom.operators import neighbours as N
from pointloom.operators import raster as R
from pointloom.operators import regions as RG
from pointloom.plans.catalogue import EMB, EV, ORD, PAIRS, _floor_and_ball, _shell_of_orders, blocks, cube, micros, mu, query
from pointloom.plans.catalogue import _bounds as BOUNDS
from pointloom.plans.catalogue import _knn_sql as knn_sql
from pointloom.plans.catalogue import _shape_sql as shape_sql
from pointloom.session import Session
from pointloom.sources.adapters import cloud_emb, cloud_ev, cloud_ord, table

XYZ = list("xyz")


def one_row(spark: SparkSession, **values) -> DataFrame:
    kinds = {bool: "boolean", int: "long", float: "double", str: "string"}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))


# ---- regions

RING = [(round(100 * math.cos(2 * math.pi * k / 48), 3), round(100 * math.sin(2 * math.pi * k / 48), 3)) for k in range(48)]
_CROSSED = "sum(case when (y1 > v) <> (y2 > v) and u < (v - y1) / (y2 - y1) * (x2 - x1) + x1 then 1 else 0 end) % 2 = 1"


def _edges(points) -> str:
    return "edge(x1, y1, x2, y2) as (values " + ", ".join(f"({a[0]}::double, {a[1]}::double, {b[0]}::double, {b[1]}::double)" for a, b in zip(points, [*points[1:], points[0]], strict=True)) + ")"


query("f1_prism_many", f"with {ORD}, {_edges(RING)}, p as (select gid, x - 250 u, y - 120 v from cloud where abs(z - 50) <= 20) select gid from p, edge group by gid having {_CROSSED}")(
    lambda spark, d: RG.crop(cloud_ord(spark, d), RG.Region("prism", (250.0, 120.0, 50.0), (1.0, 1.0, 20.0), polygon=tuple(RING))).select("gid")
)

DRAWN = [(100, 60), (520, 90), (600, 400), (330, 300), (120, 420)]
_half = "tan(radians(50.0) / 2) * 450.0"  # the eye stands 450 above what it looks at
query("f9_prism_from_screen", f"with {ORD}, {_edges(DRAWN)}, p as (select gid, ((x - 250.0) / ({_half} * 640 / 480) + 1) / 2 * 640 u, (1 - (y - 120.0) / ({_half})) / 2 * 480 v from cloud) select gid from p, edge group by gid having {_CROSSED}")(
    lambda spark, d: RG.crop(cloud_ord(spark, d), RG.prism_from_screen(DRAWN, 640, 480, (250, 120, 500), (250, 120, 50), (0, 1, 0), 50.0, ((0, 0, 0), (600, 300, 100)))).select("gid")
)


def _shaped(spark: SparkSession, d: str) -> DataFrame:
    return cloud_ev(spark, d).withColumn("shape", F.when(F.pmod("gid", F.lit(3)) == 0, F.col("x")).when(F.pmod("gid", F.lit(3)) == 1, F.lit(float("nan"))))


query("f7_shape_keep", f"with {EV} select gid from cloud where gid % 3 = 0")(lambda spark, d: RG.shape_mask(_shaped(spark, d)).select("gid"))
query("f7_shape_remove", f"with {EV} select gid from cloud where gid % 3 <> 0")(lambda spark, d: RG.shape_mask(_shaped(spark, d), keep=False).select("gid"))
_ball = "(" + " + ".join(f"greatest(abs({c}min - {o}), abs({c}max - {o})) ** 2" for c, o in zip("xyz", (260, 100, 40), strict=True)) + ") <= 90.0 * 90.0"
_miss = " or ".join(f"{c}min > {o} + 90 or {c}max < {o} - 90" for c, o in zip("xyz", (260, 100, 40), strict=True))
_in = " and ".join(f"{c}min >= {o} - 40 and {c}max <= {o} + 40" for c, o in zip("xyz", (250, 100, 50), strict=True))
_out = " or ".join(f"{c}min > {o} + 40 or {c}max < {o} - 40" for c, o in zip("xyz", (250, 100, 50), strict=True))
query("f11_estimate_kept", f"with {ORD}, {BOUNDS}, m as (select n, case when {_ball} then 1 when {_miss} then 0 else 0.5 end k, case when {_in} then 1 when {_out} then 0 else 0.5 end g from b) select cast(round(coalesce(sum(n * case when k = 0 or g = 1 then 0.0 when k = 1 and g = 0 then 1.0 else 0.5 end), 0)) as bigint) kept from m")(
    lambda spark, d: RG.estimate_kept(L.leaf_bounds(L.with_leaf(cloud_ord(spark, d), 50.0), 50.0), [RG.Region("sphere", (260.0, 100.0, 40.0), radius=90.0), RG.Region("box", (250.0, 100.0, 50.0), (40.0, 40.0, 40.0), role="delete")])
)
query("f15_start_size", f"with {ORD} select {mu('greatest(0.25, 0.3, 0.02 * greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)))')} size_u from cloud")(
    lambda spark, d: micros(cloud_ord(spark, d).agg(*[f(c).alias(f"{c}{n}") for c in "xyz" for f, n in ((F.min, 0), (F.max, 1))]).transform(lambda t: one_row(spark, size=RG.start_size(*[((r["x0"], r["y0"], r["z0"]), (r["x1"], r["y1"], r["z1"])) for r in [t.first()]]))), [], ["size"])
)


@query("f17_fit_contents", f"with {ORD} select " + ", ".join(f"{mu(f'(min({c}) + max({c})) / 2')} c{c}_u, {mu(f'(max({c}) - min({c})) / 2')} h{c}_u" for c in XYZ) + " from cloud where x between 100 and 300 and y between 50 and 200")
def fit_contents(spark: SparkSession, d: str) -> DataFrame:
    inner = cloud_ord(spark, d).where("x between 100 and 300 and y between 50 and 200")
    box = RG.fit_to_contents(inner, RG.Region("box", (200.0, 120.0, 50.0), (300.0, 300.0, 300.0)))
    return micros(one_row(spark, **{f"c{c}": v for c, v in zip(XYZ, box.center, strict=True)}, **{f"h{c}": v for c, v in zip(XYZ, box.half, strict=True)}), [], [f"{k}{c}" for k in "ch" for c in XYZ])


query("f19_finite", f"with {EV} select gid from cloud where gid % 5 <> 0 and gid % 7 <> 0 and gid % 11 <> 0")(
    lambda spark, d: RG.finite(cloud_ev(spark, d).withColumns({"x": F.when(F.pmod("gid", F.lit(5)) != 0, F.col("x")), "y": F.when(F.pmod("gid", F.lit(7)) == 0, F.lit(float("nan"))).otherwise(F.col("y")), "z": F.when(F.pmod("gid", F.lit(11)) == 0, F.lit(float("-inf"))).otherwise(F.col("z"))})).select("gid")
)

# ---- layout

_at = lambda size: ", ".join(f"cast(floor({c}/{size}) as bigint)" for c in XYZ)
_child = lambda size: ", ".join(f"((cast(floor({c}/{size}) as bigint) % 2) + 2) % 2" for c in XYZ)
query("l1_octree", f"with {ORD}, a as (select *, concat_ws('_', {_at('200.0')}) l0 from cloud), b as (select *, case when count(*) over (partition by l0) > 800 then l0 || ':' || concat_ws('_', {_child('100.0')}) else l0 end l1 from a), c as (select *, case when count(*) over (partition by l1) > 800 then l1 || ':' || concat_ws('_', {_child('50.0')}) else l1 end leaf from b) select leaf, count(*) n from c group by leaf")(
    lambda spark, d: L.octree(cloud_ord(spark, d), 200.0, 800, 2).groupBy("leaf").agg(F.count("*").alias("n"))
)
query("l2_quantise", f"with {ORD} select gid, " + ", ".join(f"cast(least(greatest(floor(({c} - floor({c}/50.0)*50.0)/50.0*65536.0), 0), 65535) as int) q{c}" for c in XYZ) + " from cloud")(lambda spark, d: L.quantise(cloud_ord(spark, d), 50.0).select("gid", "qx", "qy", "qz"))
_LEAVES = "lf as (select concat_ws('_', " + _at("50.0") + ") leaf, count(*)::double n, min(x) dist, sqrt(count(*)::double)/3.0 pixels from cloud group by 1)"


def _seen(spark: SparkSession, d: str) -> DataFrame:
    return L.with_leaf(cloud_ord(spark, d), 50.0).groupBy("leaf").agg(F.count("*").alias("n"), F.min("x").alias("dist"), (F.sqrt(F.count("*").cast("double")) / 3.0).alias("pixels"))


query("l11_floor", f"with {ORD}, {_LEAVES}, w as (select *, least(n, ceil(pixels*pixels*(2.6*pi()))) want from lf), f as (select *, least(n, ceil(want*0.12::double)) low from w), r as (select *, (select count(*) from cloud)/3.0::double - sum(low) over () - coalesce(sum(want - low) over (order by dist, leaf rows between unbounded preceding and 1 preceding), 0) room from f) select leaf, cast(low + greatest(least(want - low, room), 0) as bigint) take from r")(
    lambda spark, d: (lambda c: L.allocate(_seen(spark, d), c.count() / 3.0, 2.6))(cloud_ord(spark, d))
)
query("l11_headroom", f"with {ORD}, {_LEAVES}, w as (select *, least(n, ceil(pixels*pixels*(0.9*pi()))) want from lf), s as (select *, (select count(*) from cloud)*0.8::double room, (select count(*) from cloud)*0.8::double / sum(want) over () sc from w), k as (select *, sum(case when want*sc >= n then n else 0 end) over () capped, sum(case when want*sc < n then want else 0 end) over () open from s) select leaf, cast(least(n, floor(want * case when want*sc >= n then sc when open > 0 then greatest(1.0::double, (room - capped)/open) else sc end)) as bigint) take from k")(
    lambda spark, d: (lambda c: L.allocate(_seen(spark, d), c.count() * 0.8, 0.9))(cloud_ord(spark, d))
)
query("n12_prune", f"with {ORD}, {BOUNDS}, q as (select min(x) xmin, max(x) xmax, min(y) ymin, max(y) ymax, min(z) zmin, max(z) zmax from (select *, concat_ws('_', {_at('50.0')}) leaf from cloud where status = 'P') group by leaf) select leaf, n from b where exists (select 1 from q where " + " and ".join(f"b.{c}min - 3.0 <= q.{c}max and b.{c}max + 3.0 >= q.{c}min" for c in XYZ) + ")")(
    lambda spark, d: (lambda c: L.prune(L.leaf_bounds(L.with_leaf(c.where("status = 'P'"), 50.0), 50.0), L.leaf_bounds(L.with_leaf(c, 50.0), 50.0), 3.0, 50.0).select("leaf", "n"))(cloud_ord(spark, d))
)
query("s20_preview", f"with {ORD} select gid from cloud where gid % greatest(1, (select count(*) from cloud) // 4000) = 0")(lambda spark, d: L.preview(cloud_ord(spark, d), 4000).select("gid"))
query("s22_class_field", f"with {EMB} select gid, cls::double field from cloud where (select count(distinct cls) from cloud) >= 2")(lambda spark, d: L.class_field(cloud_emb(spark, d)).select("gid", "field"))
query("g16_default_voxel", f"with {ORD}, {BOUNDS}, r as (select spacing, row_number() over (order by spacing) - 1 k, count(*) over () al from b where n > 64) select {mu('floor(least(greatest(coalesce(max(case when k = al // 2 then spacing end), 0.05) * 200.0, 1.0), 60.0) * 2.0 + 0.5) / 2.0')} cm_u from r")(
    lambda spark, d: micros(L.median_spacing(L.leaf_bounds(L.with_leaf(cloud_ord(spark, d), 50.0), 50.0)).select(L.default_voxel(F.col("spacing")).alias("cm")), [], ["cm"])
)


def _clone(spark: SparkSession, d: str) -> DataFrame:
    s = Session(spark)
    s.add("a", cloud_ord(spark, d))
    s.run("transform", op="translate", translation=[0, 2, 0])
    s.run("entities", op="clone", name="a", to="b")
    s.run("transform", op="reset")
    return micros(s.layers["b"].placed(), ["gid"], XYZ)


query("u2_clone", f"with {ORD} select gid, {mu('x')} x_u, {mu('y + 2.0')} y_u, {mu('z')} z_u from cloud")(_clone)

# ---- normals, colour, numbers


def _normal(spark: SparkSession, d: str) -> DataFrame:
    length = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return cloud_emb(spark, d).withColumns({f"n{c}": F.when(F.col("gid") % 9 != 0, F.col(c) / length) for c in XYZ})


_NRM = f"{EMB}, nrm as (select *, case when gid % 9 <> 0 then x/sqrt(x*x+y*y+z*z) end nx, case when gid % 9 <> 0 then y/sqrt(x*x+y*y+z*z) end ny, case when gid % 9 <> 0 then z/sqrt(x*x+y*y+z*z) end nz from cloud)"
query("j2_rotate_normals", f"with {_NRM} select gid, {mu('nx*0.8660254037844387 - ny*0.5')} nx_u, {mu('nx*0.5 + ny*0.8660254037844387')} ny_u, {mu('nz')} nz_u from nrm where nx is not null")(
    lambda spark, d: micros(M.transform(_normal(spark, d).where("nx is not null"), M.translation(3.0, 1.0, 2.0) @ M.rotation("z", 30.0) @ M.scaling(1.25)), ["gid"], ["nx", "ny", "nz"])
)
query("g2_invert", f"with {_NRM} select gid, {mu('-nx')} nx_u, {mu('-nz')} nz_u from nrm")(lambda spark, d: micros(FE.invert_normals(_normal(spark, d)), ["gid"], ["nx", "nz"]))
query("a20_normal_share", f"with {_NRM} select {mu('avg(case when nx is null then 0.0 else 1.0 end)')} share_u from nrm")(lambda spark, d: micros(one_row(spark, share=float(FE.normal_share(_normal(spark, d)))), [], ["share"]))
query("j17_dip", f"with {_NRM}, t as (select gid, degrees(acos(least(abs(nz), 1.0))) dip, degrees(atan2(-nx, -ny)) way from nrm where nx is not null) select gid, {mu('dip')} dip_u, {mu('case when dip < 0.01 then 0.0 when way < 0 then way + 360.0 else way end')} way_u from t")(
    lambda spark, d: micros(_normal(spark, d).where("nx is not null").select("gid", *[c.alias(n) for n, c in zip(("dip", "way"), C.dip(F.col("nx"), F.col("ny"), F.col("nz")), strict=True)]), ["gid"], ["dip", "way"])
)
_st = "st(sid, sx, sy, sz) as (values (0, 0.0, 0.0, 0.3), (1, 0.2, -0.1, -0.2), (2, -0.2, 0.2, 0.0))"
query("n6_faced", f"with {_NRM}, {_st}, b as (select gid, arg_min(struct_pack(sx := sx, sy := sy, sz := sz), struct_pack(d2 := (sx-x)*(sx-x)+(sy-y)*(sy-y)+(sz-z)*(sz-z), s := sid)) s from nrm, st where nx is not null group by gid) select gid, {mu('case when (s.sx-x)*nx + (s.sy-y)*ny + (s.sz-z)*nz < 0 then -nx else nx end')} nx_u from nrm join b using (gid)")(
    lambda spark, d: micros(FE.face_stations(_normal(spark, d).where("nx is not null"), spark.createDataFrame([(0, 0.0, 0.0, 0.3), (1, 0.2, -0.1, -0.2), (2, -0.2, 0.2, 0.0)], "sid int, x double, y double, z double")), ["gid"], ["nx"])
)


def _painted(spark: SparkSession, d: str) -> DataFrame:
    return cloud_ev(spark, d).withColumns({"r": F.pmod("gid", F.lit(256)), "g": F.pmod(F.col("gid") * 7, F.lit(256)), "b": F.pmod(F.col("gid") * 13, F.lit(256)), "intensity": F.pmod(F.col("gid") * 3, F.lit(256)), "nx": F.lit(0.6), "ny": F.lit(0.0), "nz": F.when(F.col("gid") % 2 == 0, 0.8).otherwise(-0.8)})


_PAINT = f"{EV}, paint as (select *, gid % 256 r, gid * 7 % 256 g, gid * 13 % 256 b, gid * 3 % 256 i, case when gid % 2 = 0 then 0.8 else -0.8 end nz from cloud)"
_b = lambda e: f"cast(floor(least(greatest({e}, 0.0::double), 1.0::double)*255.0::double+0.5) as int)"
query("j4_more_modes", f"with {_PAINT} select gid, " + ", ".join([f"{_b(f'{c}/255.0::double')} rgb_{c}" for c in "rgb"] + [f"{_b('i/255.0::double')} intensity_r"] + [f"{_b(f'{c}/255.0::double*(0.35::double+i/255.0::double*0.9::double)')} shaded_{c}" for c in "rgb"] + [f"{_b('0.6::double*0.5+0.5')} normal_r", f"{_b('nz::double*0.5+0.5')} normal_b", f"{_b('0.72::double')} flat_r", f"{_b('0.76::double')} flat_b"]) + " from paint")(
    lambda spark, d: _painted(spark, d).select("gid", *[C.byte(C.colour(mode)["rgb".index(c)]).alias(f"{mode}_{c}") for mode, own in (("rgb", "rgb"), ("intensity", "r"), ("shaded", "rgb"), ("normal", "rb"), ("flat", "rb")) for c in own])
)
query("j6_tone", f"with {_PAINT} select gid, {mu('pow(r/255.0::double*(0.45::double+(nz::double*0.5+0.5)*0.8::double)*1.2::double, 1.0::double/1.8::double)')} r_u, {mu('g/255.0::double*0.25::double')} g_u from paint")(
    lambda spark, d: micros(_painted(spark, d).select("gid", C.toned(C.shaded(F.col("r") / 255.0, F.col("nz")), 1.2, 1.8).alias("r"), C.tinted([F.col("r") / 255.0, F.col("g") / 255.0], (1.0, 0.25))[1].alias("g")), ["gid"], ["r", "g"])
)


@query("j11_decompose", f"select s_suppkey gid, {mu('(1 + s_suppkey % 178)::double')} degrees_u, {mu('1 + s_nationkey / 8.0::double')} scale_u, {mu('s_suppkey::double')} x_u, 1000000::bigint z_u from supplier")
def decomposed(spark: SparkSession, d: str) -> DataFrame:
    """A matrix for each supplier comes apart into what it was put together from."""

    def run(batches):
        for pdf in batches:
            found = [M.decompose(M.translation(float(r.s_suppkey), 1.0, 2.0) @ M.rotation("z", 1.0 + r.s_suppkey % 178) @ M.scaling(1 + r.s_nationkey / 8.0)) for r in pdf.itertuples()]
            yield pd.DataFrame({"gid": pdf["s_suppkey"], "degrees": [f["degrees"] for f in found], "scale": [f["scale"] for f in found], "x": [f["translation"][0] for f in found], "z": [f["axis"][2] for f in found]})

    rows = table(spark, d, "supplier").select("s_suppkey", "s_nationkey").mapInPandas(run, "gid long, degrees double, scale double, x double, z double")
    return micros(rows, ["gid"], ["degrees", "scale", "x", "z"])


query("a6_exact_sum", f"with {EV} select kind, cast(sum(cast(round(y, 6) as decimal(28,6))) * 1000000 as bigint) total_u from cloud group by kind")(lambda spark, d: micros(cloud_ev(spark, d).groupBy(F.col("kind")).agg(C.exact_sum(F.col("y"), 6).alias("total")), ["kind"], ["total"]))

# ---- cleaning

_away = "select f.gid, cast(case when f.n <= 3 then {alone} else coalesce(abs(mx*vx+my*vy+mz*vz) <= {near}, true) end as int) keep from f left join s on f.gid = s.gid"
_hits = f"r as (select * from d where d2 <= {0.08 * 0.08!r}), f as (select gid, count(*) n from r group by gid), o as (select * from r where gid <> nb)"
query("a7_noise_absolute", f"with {EMB}, {PAIRS}, " + shape_sql(_hits, "o") + " " + _away.format(alone="true", near="0.02::double"))(lambda spark, d: FE.noise(cloud_emb(spark, d), 1.0, 0.08, absolute=0.02))
query("a7_noise_isolated", f"with {EMB}, {PAIRS}, " + shape_sql(_hits, "o") + " " + _away.format(alone="false", near="sqrt(l0)*1.5::double"))(lambda spark, d: FE.noise(cloud_emb(spark, d), 1.5, 0.08, drop_isolated=True))
for _k, _s in ((6, 2.0), (16, 2.0), (16, 1.0)):
    query(f"a4_sor_keep_{_k}_{int(_s)}", f"with {EMB}, {knn_sql(_k)}, m as (select gid, coalesce(sum(sqrt(d2))/nullif(count(*)-1,0),0) mean from k group by gid), w as (select avg(mean) mu, avg(mean*mean) sq from m) select gid, cast(mean <= mu + sqrt(abs(sq - mu*mu))*{_s}::double as int) keep from m, w")(
        lambda spark, d, k=_k, s=_s: FE.sor(cloud_emb(spark, d), k, s, 0.1).select("gid", "keep")
    )
query("a9_dedupe", f"with recursive {EMB}, p as (select *, row_number() over (order by gid) k from cloud), g(k, kept) as (select 0::bigint, []::struct(gid bigint, x double, y double, z double)[] union all select p.k, case when len(list_filter(kept, lambda q: (q.x-p.x)*(q.x-p.x)+(q.y-p.y)*(q.y-p.y)+(q.z-p.z)*(q.z-p.z) <= 0.02::double*0.02::double)) = 0 then list_append(kept, struct_pack(gid := p.gid, x := p.x, y := p.y, z := p.z)) else kept end from g join p on p.k = g.k + 1), l as (select unnest(list_transform(kept, lambda q: q.gid)) gid from g where k = (select count(*) from p)) select gid, cast(gid in (select gid from l) as int) keep from cloud")(
    lambda spark, d: G.duplicates(cloud_emb(spark, d), 0.02)
)

# ---- fits


def _round(spark: SparkSession, d: str, height: str) -> DataFrame:
    t = F.col("gid") * 0.1
    flat = cloud_ord(spark, d).select("gid", t.alias("t"), F.col("z").alias("h"))
    return flat.select("gid", (F.cos("t") * 3.0 + 1.0).alias("x"), (F.sin("t") * 3.0 - 2.0).alias("y"), F.expr(height).cast("double").alias("z"), F.cos("t").alias("nx"), F.sin("t").alias("ny"), F.lit(0.0).alias("nz"))


query("a24_cylinder", f"with {ORD} select count(*) points, 3000000::bigint radius_u, {mu('max(z) - min(z)')} length_u, 1000000::bigint x_u, -2000000::bigint y_u, {mu('(max(z) + min(z)) / 2')} z_u, 0::bigint rms_u from cloud")(
    lambda spark, d: (lambda f: micros(one_row(spark, points=f["points"], radius=f["radius"], length=f["length"], rms=f["rms"], x=f["center"][0], y=f["center"][1], z=f["center"][2]), ["points"], ["radius", "length", "x", "y", "z", "rms"]))(FI.fit_cylinder(_round(spark, d, "h")))
)
query("a25_circle", f"with {ORD} select count(*) points, 3000000::bigint radius_u, 1000000::bigint x_u, -2000000::bigint y_u, 7000000::bigint z_u, 1000000::bigint nz_u, 0::bigint rms_u from cloud")(
    lambda spark, d: (lambda f: micros(one_row(spark, points=f["points"], radius=f["radius"], rms=f["rms"], x=f["center"][0], y=f["center"][1], z=f["center"][2], nz=abs(f["normal"][2])), ["points"], ["radius", "x", "y", "z", "nz", "rms"]))(FI.fit_circle(_round(spark, d, "7.0")))
)
query("g8_level", f"with {ORD} select count(*) points, 1000000::bigint nz_u, 0::bigint rms_u from cloud")(
    lambda spark, d: (lambda c: (lambda f: micros(one_row(spark, points=f["points"], nz=f["normal"][2], rms=f["rms"]), ["points"], ["nz", "rms"]))(FI.fit_plane(M.transform(c, FI.level(c)))))(cloud_ord(spark, d).select("gid", "x", "y", (F.col("x") * 0.3 - F.col("y") * 0.2 + 5.0).alias("z")))
)

# ---- rasters, views, meshes

query("a11_raster_axis_x", f"with {ORD} select cast(floor(y/20.0) as bigint) u, cast(floor(z/20.0) as bigint) v, {mu('max(x)')} value_u from cloud group by 1, 2")(lambda spark, d: micros(R.raster(cloud_ord(spark, d), 20.0, "max", "x", box={"y": 0.0, "z": 0.0}), ["u", "v"], ["value"]))
for _c in "yz":
    query(f"a15_robust_{_c}", f"with {ORD}, e as (select min({_c}) lo, max({_c}) hi, count({_c}) total from cloud), h as (select least(floor(({_c}-lo)/(hi-lo)*1024.0), 1023) bin, count(*) n from cloud, e group by 1), r as (select *, sum(n) over (order by bin) upto from h, e) select {mu('min(case when upto > total*0.002::double then lo + bin*((hi-lo)/1024.0) end)')} lo_u, {mu('min(case when upto >= total*0.998::double then lo + (bin+1)*((hi-lo)/1024.0) end)')} hi_u from r")(
        lambda spark, d, c=_c: micros(R.trimmed_range(cloud_ord(spark, d), c, 0.002, 0.002, 1024), [], ["lo", "hi"])
    )
_RAST = "t as (select cast(floor(x/25.0) as bigint) u, cast(floor(y/25.0) as bigint) v, avg(z) value from cloud group by 1, 2)"


def _heights(spark: SparkSession, d: str) -> DataFrame:
    return R.raster(cloud_ord(spark, d), 25.0, "mean", box={"x": 0.0, "y": 0.0})


@query("g3_stitched_length", f"with {ORD}, {_RAST}, sq as (select t.u::double u, t.v::double v, t.value a, r.value b, x.value c, w.value d from t join t r on r.u=t.u+1 and r.v=t.v join t x on x.u=t.u+1 and x.v=t.v+1 join t w on w.u=t.u and w.v=t.v+1), lv(level) as (values (45.25::double), (50.25), (55.25)), e as (select level, u, v, a >= level pa, b >= level pb, c >= level pc, d >= level pd, u + coalesce((level-a)/nullif(b-a,0),0.5) bx, v + coalesce((level-b)/nullif(c-b,0),0.5) ry, u + coalesce((level-d)/nullif(c-d,0),0.5) tx, v + coalesce((level-a)/nullif(d-a,0),0.5) ly from sq, lv), n as (select *, (pa <> pb)::int + (pb <> pc)::int + (pc <> pd)::int + (pd <> pa)::int cuts from e) select cast(level*100 as bigint) level, count(*) squares from n where cuts > 0 group by level")
def stitched(spark: SparkSession, d: str) -> DataFrame:
    """Every crossed square lends its segments to some line: counted over the stitched lines by the square of each segment's middle."""
    lines = R.stitch(R.contour_segments(_heights(spark, d), [45.25, 50.25, 55.25]))
    pairs = F.arrays_zip(F.slice("points", 1, F.size("points") - 1).alias("p"), F.slice("points", 2, F.size("points") - 1).alias("q"))
    middle = lines.select("level", F.explode(pairs).alias("s")).select("level", F.floor((F.col("s.p.x") + F.col("s.q.x")) / 2).alias("u"), F.floor((F.col("s.p.y") + F.col("s.q.y")) / 2).alias("v"))
    return middle.distinct().groupBy((F.col("level") * 100).cast("long").alias("level")).agg(F.count("*").alias("squares"))


query("v3_probe", f"with {ORD}, p as (select *, cast(floor(x/4.0) as bigint) - 60 du, cast(floor(y/4.0) as bigint) - 30 dv from cloud) select gid from p where abs(du) <= 3 and abs(dv) <= 3 order by du*du+dv*dv, -z, gid limit 1")(lambda spark, d: R.probe(cloud_ord(spark, d), 60, 30, (1, 0, 0), (0, 1, 0), (0, 0, 1), 4.0, 3).select("gid"))

_far = "greatest(abs(px - 0.5) - 0.5, 0) ** 2 + greatest(abs(py - 0.5) - 0.5, 0) ** 2 + greatest(abs(pz - 0.5) - 0.5, 0) ** 2"
_deep = "least(0.5 - abs(px - 0.5), 0.5 - abs(py - 0.5), 0.5 - abs(pz - 0.5))"
query("n8_cube_distance", f"with {EMB}, p as (select gid, x*4 + 0.5 px, y*4 + 0.5 py, z*4 + 0.5 pz from cloud), f as (select gid, case when {_deep} >= 0 then {_deep} else sqrt({_far}) end d from p) select gid, {mu('d')} d_u from f where d <= 1.4")(
    lambda spark, d: micros(N.mesh_distance(cloud_emb(spark, d).select("gid", *[(F.col(c) * 4 + 0.5).alias(c) for c in XYZ]), *cube(spark), 1.5).where("d <= 1.4"), ["gid"], ["d"])
)
_walk = "w as (select x/5.0 + 0.6*t wx, y/5.0 wy, z/5.0 + 0.8*t wz, t from cloud, (values (-2.0::double), (-1.0), (0.0), (1.0), (2.0)) s(t)), cn as (select cast(floor(wx) as bigint) + i gx, cast(floor(wy) as bigint) + j gy, cast(floor(wz) as bigint) + k gz, t, (case i when 1 then wx-floor(wx) else 1-wx+floor(wx) end)*(case j when 1 then wy-floor(wy) else 1-wy+floor(wy) end)*(case k when 1 then wz-floor(wz) else 1-wz+floor(wz) end)*(1-abs(t)/2.0*0.75) wt from w, (values (0), (1)) a(i), (values (0), (1)) b(j), (values (0), (1)) c(k))"
query("a30_tsdf_table", f"with {ORD}, {_walk} select gx, gy, gz, {mu('sum(t*5.0*wt)/sum(wt) + 1.237e-7')} dist_u, {mu('sum(wt) + 1.237e-7')} weight_u from cn where wt > 0 group by 1, 2, 3 having sum(wt) > 1e-3")(
    lambda spark, d: micros(ME.tsdf(cloud_ord(spark, d).withColumns({"nx": F.lit(0.6), "ny": F.lit(0.0), "nz": F.lit(0.8)}), 5.0).where("weight > 1e-3").withColumns({c: F.col(c) + 1.237e-7 for c in ("dist", "weight")}), ["gx", "gy", "gz"], ["dist", "weight"])
)
_on = "least(abs(lx), abs(1.0 - lx), abs(y), abs(1.0 - y), abs(z), abs(h - z))"
query("g13_sample_count", "select 3 * count(*) points, 3 * count(*) ids, true inside from customer")(
    lambda spark, d: ME.sample(*blocks(spark, d), 3 * table(spark, d, "customer").count()).withColumn("k", F.floor((F.col("x") + 1.0) / 3.0)).selectExpr("gid", "x - 3.0 * k lx", "y", "z", "double(1 + k % 7) h")
    .agg(F.count("*").alias("points"), F.count_distinct("gid").alias("ids"), F.bool_and(F.expr(f"{_on} < 1e-9 and lx between -1e-9 and 1 + 1e-9 and y between 0 and 1 and z between 0 and h")).alias("inside"))
)

# ---- iterative operators on shapes whose answers are known


@query("g1_orient_known", "select count(*) points, true outward from orders")
def orient_known(spark: SparkSession, d: str) -> DataFrame:
    """Normals of a sphere, every other one turned in by a hash: all look out again."""
    mixed = _shell_of_orders(spark, d).withColumn("s", F.when(F.pmod(F.xxhash64("gid"), F.lit(2)) == 0, 1.0).otherwise(-1.0))
    out = G.orient(mixed.withColumns({f"n{c}": F.col(f"n{c}") * F.col("s") for c in "xyz"}).drop("s"), 6, 0.15)
    return out.agg(F.count("*").alias("points"), F.bool_and(F.col("nx") * F.col("x") + F.col("ny") * F.col("y") + F.col("nz") * F.col("z") > 0.99).alias("outward"))


@query("g5_icp_known", "select count(*) pairs, true close, true turned_back from orders")
def icp_known(spark: SparkSession, d: str) -> DataFrame:
    """A stretched sphere moved by two degrees and some centimetres: the fit undoes the move."""
    fixed = _shell_of_orders(spark, d).withColumns({"x": F.col("x") * 2.0, "z": F.col("z") * 0.5})
    away = M.translation(0.05, -0.03, 0.02) @ M.rotation("z", 2.0)
    found = FI.icp(M.transform(fixed.select("gid", "x", "y", "z"), away), FE.face_stations(fixed, spark.createDataFrame([(0, 9.0, 9.0, 9.0)], "sid int, x double, y double, z double")), 0.3)
    back = np.array(found["matrix"]).reshape(4, 4) @ away
    return one_row(spark, pairs=int(found["pairs"]), close=bool(found["rms"] < 1e-3), turned_back=bool(np.abs(back - np.eye(4)).max() < 5e-3))


@query("g6_detect_known", "select 2::bigint shapes, count(*) filter (where o_orderkey % 5 < 3) plane, count(*) filter (where o_orderkey % 5 >= 3) ball, 500000::bigint radius_u from orders")
def detect_known(spark: SparkSession, d: str) -> DataFrame:
    """The floor and the ball come apart whole."""
    cloud = _floor_and_ball(spark, d)
    shapes = {s["kind"]: s for s in FI.detect(cloud, least=max(4, cloud.count() // 4), kinds=("plane", "sphere"), trials=120, most=2)}
    return micros(one_row(spark, shapes=len(shapes), plane=shapes["plane"]["points"], ball=shapes["sphere"]["points"], radius=shapes["sphere"]["radius"]), ["shapes", "plane", "ball"], ["radius"])


@query("g9_surface_known", "select count(*) > 0 closed, count(*) > 0 area_ok, count(*) > 0 volume_ok from orders")
def surface_known(spark: SparkSession, d: str) -> DataFrame:
    """A unit sphere's surface closes, with its area and volume to a twentieth."""
    m = ME.measure(*ME.build_surface(_shell_of_orders(spark, d), 0.1)).first()
    return one_row(spark, closed=bool(m["closed"]), area_ok=abs(m["area"] / (4 * math.pi) - 1) < 0.05, volume_ok=abs(m["volume"] / (4 / 3 * math.pi) - 1) < 0.05)


@query("g10_density_known", "select count(*) > 0 closed, count(*) > 0 area_ok from orders")
def density_known(spark: SparkSession, d: str) -> DataFrame:
    """The same without normals: a shell as thick as a voxel, so two closed surfaces or one around it."""
    m = ME.measure(*ME.build_surface(_shell_of_orders(spark, d).select("gid", "x", "y", "z"), 0.1, 0)).first()
    return one_row(spark, closed=m["boundary_edges"] == 0, area_ok=4 * math.pi < m["area"] < 4 * 4 * math.pi)


# ---- perspective views

CAMERA = {"width": 320, "height": 200, "eye": (203.7, -310.3, 147.9), "target": (231.3, 102.1, 45.7), "up": (0.0, 0.0, 1.0), "fov": 37.0}
#: The same camera in SQL: its axes by cross products, then each point's place in its frame and its pixel.
_EYE = """
eye as (select 203.7::double ex, -310.3::double ey, 147.9::double ez, tan(radians(37.0) / 2) tall),
sight as (select *, 231.3 - ex sx, 102.1 - ey sy, 45.7 - ez sz, sqrt((231.3 - ex)^2 + (102.1 - ey)^2 + (45.7 - ez)^2) far from eye),
side as (select *, sy / sqrt(sx^2 + sy^2) rx, -sx / sqrt(sx^2 + sy^2) ry from sight),
cam as (select *, sx / far ax, sy / far ay, sz / far az, ry * sz / far ux, -rx * sz / far uy, (rx * sy - ry * sx) / far uz from side)
"""
_SEEN = f"""{ORD}, {_EYE},
framed as (select gid, (x-ex)*ax + (y-ey)*ay + (z-ez)*az depth, (x-ex)*rx + (y-ey)*ry u, (x-ex)*ux + (y-ey)*uy + (z-ez)*uz v, tall from cloud, cam),
seen as (select gid, depth, cast(floor(160 + 100 * u / (depth * tall)) as bigint) px, cast(199 - floor(100 + 100 * v / (depth * tall)) as bigint) py
  from framed where depth >= 0.01),
shown as (select * from seen where px between 0 and 319 and py between 0 and 199)
"""


@query("v1_perspective", f"with {_SEEN} select px, py, (min(struct_pack(d := depth, g := gid))).g gid from shown group by px, py")
def perspective_pixels(spark: SparkSession, d: str) -> DataFrame:
    return R.perspective_view(cloud_ord(spark, d), M.perspective(**CAMERA), 320, 200).drop("depth")


@query(
    "v3_pick",
    f"with {_SEEN} select gid, {mu('depth')} depth_u from shown where abs(px - 170) <= 9 and abs(py - 90) <= 9"
    " order by (px - 170)^2 + (py - 90)^2, depth, gid limit 1",
)
def picked(spark: SparkSession, d: str) -> DataFrame:
    return micros(R.pick(cloud_ord(spark, d), 170, 90, M.perspective(**CAMERA), 320, 200, 9), ["gid"], ["depth"])


_CORNER = "case when {k} > 0 then {c}max else {c}min end"


def _side_sql(a: str, b: str, c: str) -> str:
    """The most that a linear form may be in a leaf's box, from the eye."""
    ends = [f"({k}) * ({_CORNER.format(k=k, c=n)} - e{n})" for n, k in zip("xyz", (a, b, c), strict=True)]
    return " + ".join(ends)


_sides = [_side_sql("ax", "ay", "az") + " >= 0.01"]
for _sign in ("+", "-"):
    _sides.append(_side_sql(*[f"(a{c}*tall*1.6 {_sign} r{c})" for c in "xy"], "(az*tall*1.6)") + " >= 0")
    _sides.append(_side_sql(*[f"(a{c}*tall {_sign} u{c})" for c in "xyz"]) + " >= 0")


@query(
    "v1_leaves_seen",
    f"with {ORD}, {_EYE}, b as (select cast(floor(x/20.0) as bigint) || '_' || cast(floor(y/20.0) as bigint) || '_' || cast(floor(z/20.0) as bigint) leaf,"
    " count(*) n, min(x) xmin, max(x) xmax, min(y) ymin, max(y) ymax, min(z) zmin, max(z) zmax from cloud group by 1)"
    f" select leaf, n from b, cam where {' and '.join(_sides)}",
)
def leaves_in_view(spark: SparkSession, d: str) -> DataFrame:
    leaves = L.leaf_bounds(L.with_leaf(cloud_ord(spark, d), 20.0), 20.0)
    return R.leaves_seen(leaves, M.perspective(**CAMERA)).select("leaf", "n")
