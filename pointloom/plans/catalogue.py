"""The engine's queries over the adapter clouds, each with SQL that says the same. Doubles leave as millionths."""

from __future__ import annotations

import numpy as np
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
from pointloom.sources.adapters import cloud_emb, cloud_ev, cloud_li, cloud_ord, table

ORD = "cloud as (select o_orderkey gid, o_totalprice/1000 x, date_diff('day', date '1995-01-01', o_orderdate::date)/10.0 y, (o_custkey % 100)::double z, o_orderstatus status from orders)"
EMB = "cloud as (select vec_id gid, embedding[1]::double x, embedding[2]::double y, embedding[3]::double z, label::int cls from embeddings)"
EV = "cloud as (select event_id gid, user_id::double x, value y, (epoch_us(ts) - (select min(epoch_us(ts)) from events)) / 1e6 z, event_type kind from events)"
LI = "cloud as (select l_quantity x, l_discount*100 y, l_extendedprice z, l_returnflag flag from lineitem)"
PAIRS = "d as (select a.gid, b.gid nb, b.x-a.x dx, b.y-a.y dy, b.z-a.z dz, (b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)+(b.z-a.z)*(b.z-a.z) d2 from cloud a, cloud b)"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def mu(e: str) -> str:
    return f"cast(floor(({e})*1e6+0.5) as bigint)"


def true_sum(e: str, over: str = "") -> str:
    """The sum of a column to 60 binary places: of its floor and of two times thirty bits of what is left, which are whole
    numbers, so neither the order of rows nor the number of threads has a say in it."""
    bits = f"(({e}-floor({e}))*1073741824.0::double)"
    whole, high, low = (f"(sum(floor({x})::bigint) {over})::bigint::double" for x in (e, bits, f"({bits}-floor({bits}))*1073741824.0::double"))
    return f"({whole}+({high}+{low}/1073741824.0::double)/1073741824.0::double)"


def micros(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.select(*keys, *[C.micro(F.col(v)).alias(f"{v}_u") for v in values])


# ---- regions

BOX = RG.Region("box", (250.0, 120.0, 50.0), (120.0, 60.0, 30.0), quat=(0.9659258262890683, 0.0, 0.0, 0.25881904510252074))


def _local_sql(r: RG.Region) -> list[str]:
    t = M.quaternion(*r.quat).T
    return ["(" + " + ".join(f"({c}-({o!r}))*({float(k)!r})" for c, o, k in zip("xyz", r.center, row, strict=True)) + ")" for row in t]


def _inside_sql(r: RG.Region) -> str:
    u, v, w = _local_sql(r)
    if r.kind == "box":
        return f"abs({u})<={r.half[0]} and abs({v})<={r.half[1]} and abs({w})<={r.half[2]}"
    if r.kind == "sphere":
        return f"{u}*{u}+{v}*{v}+{w}*{w} <= {r.radius * r.radius!r}"
    if r.kind == "slab":
        return f"abs({w})<={r.half[2]}"
    terms = []
    p = list(r.polygon)
    for (x1, y1), (x2, y2) in zip(p, p[1:] + p[:1], strict=True):
        if y1 != y2:
            terms.append(f"case when (({y1}>{v}) <> ({y2}>{v})) and {u} < ({v}-({y1}))/({y2}-({y1}))*({x2}-({x1}))+({x1}) then 1 else 0 end")
    return f"abs({w})<={r.half[2]} and ({' + '.join(terms)}) % 2 = 1"


SPHERE = RG.Region("sphere", (260.0, 100.0, 40.0), radius=90.0, role="keep")
SLAB = RG.Region("slab", (250.0, 120.0, 50.0), (1.0, 1.0, 15.0), quat=(0.9238795325112867, 0.3826834323650898, 0.0, 0.0))
PRISM = RG.Region("prism", (250.0, 120.0, 50.0), (1.0, 1.0, 25.0), polygon=((-120.0, -60.0), (100.0, -70.0), (140.0, 50.0), (0.0, 10.0), (-100.0, 80.0)), quat=(0.9659258262890683, 0.0, 0.0, 0.25881904510252074))
HOLE = RG.Region("box", (250.0, 100.0, 50.0), (40.0, 40.0, 40.0), role="delete")


@query("f13_inside_box", f"with {ORD} select count(*) n, " + ", ".join(f"{mu(f'{f}({c})')} {c}{f}_u" for c in "xyz" for f in ("min", "max")) + f" from cloud where {_inside_sql(BOX)}")
def inside_box(spark: SparkSession, d: str) -> DataFrame:
    out = RG.inside(cloud_ord(spark, d), BOX)
    return micros(out, ["n"], [f"{c}{f}" for c in "xyz" for f in ("min", "max")])


for _name, _region in (("f1_sphere", SPHERE), ("f1_slab", SLAB), ("f1_prism", PRISM)):
    query(_name, f"with {ORD} select gid from cloud where {_inside_sql(_region)}")(lambda spark, d, r=_region: RG.crop(cloud_ord(spark, d), r).select("gid"))

query("f2_keep_delete", f"with {ORD} select gid from cloud where (({_inside_sql(BOX)}) or ({_inside_sql(SPHERE)})) and not ({_inside_sql(HOLE)})")(lambda spark, d: RG.apply_regions(cloud_ord(spark, d), [BOX, SPHERE, HOLE]).select("gid"))


@query("f20_crop_complement", f"with {ORD} select count(*) filter (where {_inside_sql(BOX)}) kept, count(*) filter (where not ({_inside_sql(BOX)})) removed, count(*) total from cloud")
def crop_complement(spark: SparkSession, d: str) -> DataFrame:
    test = BOX.inside()
    return cloud_ord(spark, d).agg(F.count(F.when(test, 1)).alias("kept"), F.count(F.when(~test, 1)).alias("removed"), F.count("*").alias("total"))


query("f5_field_range", f"with {EV} select gid from cloud where y between 20 and 60")(lambda spark, d: RG.field_range(cloud_ev(spark, d), "y", 20.0, 60.0).select("gid"))
query("f6_height_clip", f"with {EV} select gid from cloud where z between 100000 and 1500000")(lambda spark, d: RG.field_range(cloud_ev(spark, d), "z", 1e5, 1.5e6).select("gid"))
query("f18_section", f"with {ORD} select gid from cloud where abs(y - 100.0) <= 2.5")(lambda spark, d: RG.section(cloud_ord(spark, d), "y", 100.0, 5.0).select("gid"))

VIEW = np.array([[0.004, 0.001, 0.0, -1.0], [0.0, 0.008, 0.002, -1.0], [0.0, 0.0, 0.01, 0.0], [0.0005, 0.0, 0.001, 0.9]])
LOOP = [(150.0, 80.0), (520.0, 120.0), (460.0, 420.0), (300.0, 260.0), (180.0, 400.0)]


def _lasso_sql() -> str:
    row = [" + ".join([f"{c}*({float(k)!r})" for c, k in zip("xyz", r[:3], strict=True)] + [f"({float(r[3])!r})"]) for r in VIEW]
    u, v = f"((({row[0]})/w)*0.5+0.5)*640.0", f"((({row[1]})/w)*-0.5+0.5)*480.0"
    terms = [f"case when (({y1}>v) <> ({y2}>v)) and u < (v-({y1}))/({y2}-({y1}))*({x2}-({x1}))+({x1}) then 1 else 0 end" for (x1, y1), (x2, y2) in zip(LOOP, LOOP[1:] + LOOP[:1], strict=True)]
    return f"with {ORD}, e as (select *, {row[3]} w from cloud), p as (select gid, {u} u, {v} v from e where w > 0) select gid from p where ({' + '.join(terms)}) % 2 = 1"


query("f8_lasso", _lasso_sql())(lambda spark, d: RG.lasso(cloud_ord(spark, d), VIEW, LOOP, 640, 480).select("gid"))

# ---- transforms, colour, layout

TURN = M.translation(1.5, -2.0, 0.25) @ M.rotation("z", 30.0, (250.0, 120.0, 50.0)) @ M.scaling(1.25)


def _moved_sql(m: np.ndarray) -> list[str]:
    return [" + ".join([f"{c}*({float(k)!r})" for c, k in zip("xyz", r[:3], strict=True)] + [f"({float(r[3])!r})"]) for r in m[:3]]


query("j1_transform", f"with {ORD} select gid, " + ", ".join(f"{mu(e)} {c}_u" for c, e in zip("xyz", _moved_sql(TURN), strict=True)) + " from cloud")(lambda spark, d: micros(M.transform(cloud_ord(spark, d), TURN), ["gid"], list("xyz")))
query("j3_global", f"with {ORD} select gid, {mu('x + 4000.5')} x_u, {mu('y + -200.25')} y_u, {mu('z + 12.0')} z_u from cloud")(lambda spark, d: micros(M.transform(cloud_ord(spark, d), M.translation(4000.5, -200.25, 12.0)), ["gid"], list("xyz")))
query("j20_spherical", f"with {ORD} select gid, {mu('x*cos(z/100)*cos(y/50)')} x_u, {mu('x*cos(z/100)*sin(y/50)')} y_u, {mu('x*sin(z/100)')} z_u from cloud")(lambda spark, d: micros(cloud_ord(spark, d).select("gid", *[c.alias(n) for n, c in zip("xyz", M.spherical(F.col("x"), F.col("y") / 50, F.col("z") / 100), strict=True)]), ["gid"], list("xyz")))


def _ramp_sql(t: str) -> list[str]:
    s, out = f"(least(greatest({t}, 0.0::double), 1.0::double)*4.0::double)", []
    for ch in range(3):
        cases = " ".join(f"when least(floor({s}), 3) = {k} then {C.RAMP[k][ch]}::double + ({s}-{float(k)})*({C.RAMP[k + 1][ch] - C.RAMP[k][ch]}::double)" for k in range(4))
        out.append(f"case {cases} end")
    return out


query("j4_colour_modes", f"with {EV} select gid, " + ", ".join(f"cast(floor(least(greatest({e}, 0.0::double), 1.0::double)*255.0::double+0.5) as int) {c}" for c, e in zip("rgb", _ramp_sql("(y - 0.0::double)/100.0::double"), strict=True)) + " from cloud")(
    lambda spark, d: cloud_ev(spark, d).select("gid", *[C.byte(c).alias(n) for n, c in zip("rgb", C.colour("field", field="y", field_range=(0.0, 100.0)), strict=True)])
)
LEAF = 50.0
_leaf = "concat_ws('_', cast(floor(x/50.0) as bigint), cast(floor(y/50.0) as bigint), cast(floor(z/50.0) as bigint))"
query("l3_prefix_sample", f"with {ORD}, l as (select *, {_leaf} leaf from cloud), r as (select leaf, gid, row_number() over (partition by leaf order by (gid * 2654435761) % 4294967296, gid) k from l) select leaf, gid from r where k <= 5")(lambda spark, d: L.prefix_sample(L.with_leaf(cloud_ord(spark, d), LEAF), 5).select("leaf", "gid"))
_face = "greatest((max(x)-min(x))*(max(y)-min(y)), (max(y)-min(y))*(max(z)-min(z)), (max(x)-min(x))*(max(z)-min(z)))"
_bounds = f"b as (select leaf, count(*) n, least(greatest(sqrt({_face}/count(*)), 1e-4), 25.0) spacing, " + ", ".join(f"{f}({c}) {c}{f}" for c in "xyz" for f in ("min", "max")) + f" from (select *, {_leaf} leaf from cloud) group by leaf)"
query("l5_leaf_bounds", f"with {ORD}, {_bounds} select leaf, n, {mu('spacing')} spacing_u, " + ", ".join(f"{mu(f'{c}{f}')} {c}{f}_u" for c in "xyz" for f in ("min", "max")) + " from b")(lambda spark, d: micros(L.leaf_bounds(L.with_leaf(cloud_ord(spark, d), LEAF), LEAF), ["leaf", "n"], ["spacing", *[f"{c}{f}" for c in "xyz" for f in ("min", "max")]]))
query("l7_median_spacing", f"with {ORD}, {_bounds}, r as (select spacing, row_number() over (order by spacing) - 1 k, count(*) over () al from b where n > 64) select {mu('coalesce(max(case when k = al // 2 then spacing end), 0.05)')} spacing_u from r")(lambda spark, d: micros(L.median_spacing(L.leaf_bounds(L.with_leaf(cloud_ord(spark, d), LEAF), LEAF)), [], ["spacing"]))
query("l11_budget", f"with {ORD}, l as (select {_leaf} leaf, count(*) n, min(x) dist from cloud group by 1), r as (select *, coalesce(sum(n) over (order by dist, leaf rows between unbounded preceding and 1 preceding), 0) bf from l) select leaf, cast(greatest(least(n, 5000 - bf), 0) as bigint) take from r")(lambda spark, d: L.budget(L.with_leaf(cloud_ord(spark, d), LEAF).groupBy("leaf").agg(F.count("*").alias("n"), F.min("x").alias("dist")), 5000))
query("s7_stride_filter", f"with {ORD} select gid from cloud where gid % 7 = 0")(lambda spark, d: L.stride(cloud_ord(spark, d), 7).select("gid"))
query("s22_class_field", f"with {EMB} select cls::double field, count(*) n from cloud where (select count(distinct cls) from cloud) >= 2 group by 1")(lambda spark, d: (lambda c: c.groupBy(F.col("cls").cast("double").alias("field")).agg(F.count("*").alias("n")).join(F.broadcast(c.agg(F.count_distinct("cls").alias("k"))), F.col("k") >= 2).drop("k"))(cloud_emb(spark, d)))
query("a8_voxel_thin", f"with {ORD} select min(gid) gid from cloud group by floor(x/20.0), floor(y/20.0), floor(z/20.0)")(lambda spark, d: L.thin(cloud_ord(spark, d), 20.0).select("gid"))
query("u1_merge", f"with {ORD}, a as (select * from cloud where gid % 2 = 0), b as (select * from cloud where gid % 2 = 1) select gid, {mu('x')} x_u from a union all select gid + (select max(gid) + 1 from a), {mu('x')} from b")(lambda spark, d: (lambda c: micros(L.merge([c.where("gid % 2 = 0"), c.where("gid % 2 = 1")]), ["gid"], ["x"]))(cloud_ord(spark, d)))
query("u2_clone", f"with {ORD} select gid, {mu('x')} x_u, {mu('y')} y_u, {mu('z')} z_u from cloud")(lambda spark, d: micros(cloud_ord(spark, d), ["gid"], list("xyz")))
query("v1_ortho_view", f"with {ORD} select cast(floor(x/4.0) as bigint) px, cast(floor(y/4.0) as bigint) py, -max(struct_pack(dp := z, g := -gid)).g gid from cloud group by 1, 2")(lambda spark, d: R.ortho_view(cloud_ord(spark, d), (1, 0, 0), (0, 1, 0), (0, 0, 1), 4.0))

# ---- ranges and histograms

query("a15_bounds", f"with {ORD} select " + ", ".join(f"{mu(f'{f}({c})')} {c}{f}_u" for c in "xyz" for f in ("min", "max")) + " from cloud")(lambda spark, d: micros(cloud_ord(spark, d).agg(*[g(c).alias(f"{c}{f}") for c in "xyz" for f, g in (("min", F.min), ("max", F.max))]), [], [f"{c}{f}" for c in "xyz" for f in ("min", "max")]))


def _hist_sql(c: str, bins: int) -> str:
    return f"e as (select min({c}) lo, max({c}) hi, count({c}) total from cloud), h as (select cast(least(floor(({c}-lo)/(hi-lo)*{float(bins)}), {bins - 1}) as bigint) bin, count(*) n from cloud, e where {c} is not null group by 1)"


def _range_sql(c: str, bins: int, low: float, high: float) -> str:
    return f"{_hist_sql(c, bins)}, r as (select *, sum(n) over (order by bin) upto from h, e) select {mu(f'min(case when upto > total*{low}::double then lo + bin*((hi-lo)/{float(bins)}) end)')} lo_u, {mu(f'min(case when upto >= total*{1.0 - high}::double then lo + (bin+1)*((hi-lo)/{float(bins)}) end)')} hi_u from r"


query("a15_robust_bounds", f"with {ORD}, {_range_sql('x', 1024, 0.002, 0.002)}")(lambda spark, d: micros(R.trimmed_range(cloud_ord(spark, d), "x", 0.002, 0.002, 1024), [], ["lo", "hi"]))
query("a17_histogram", f"with {EV}, {_hist_sql('y', 128)} select bin, n from h")(lambda spark, d: R.histogram(cloud_ev(spark, d), "y"))
query("a18_auto_range", f"with {EV}, {_range_sql('y', 128, 0.02, 0.02)}")(lambda spark, d: micros(R.trimmed_range(cloud_ev(spark, d), "y"), [], ["lo", "hi"]))
query("a19_intensity", f"with {EV}, {_range_sql('y', 256, 0.01, 0.02)}")(lambda spark, d: micros(R.trimmed_range(cloud_ev(spark, d), "y", 0.01, 0.02, 256), [], ["lo", "hi"]))
query("a31_state", f"with {ORD} select count(*) n, {mu('min(x)')} xmin_u, {mu('max(z)')} zmax_u, count(distinct status) fields from cloud")(lambda spark, d: micros(cloud_ord(spark, d).agg(F.count("*").alias("n"), F.min("x").alias("xmin"), F.max("z").alias("zmax"), F.count_distinct("status").alias("fields")), ["n", "fields"], ["xmin", "zmax"]))

# ---- neighbours and what they say

query("n1_radius_count", f"with {EMB}, {PAIRS} select gid, count(*) n from d where d2 <= {0.06 * 0.06!r} group by gid")(lambda spark, d: N.radius_join(cloud_emb(spark, d), 0.06).groupBy("gid").agg(F.count("*").alias("n")))


def _knn_sql(m: int) -> str:
    return f"{PAIRS}, k as (select * from (select *, row_number() over (partition by gid order by d2, nb) rk from d) where rk <= {m})"


query("n2_knn", f"with {EMB}, {_knn_sql(6)} select gid, cast(rk as int) rank, nb from k")(lambda spark, d: N.nearest(cloud_emb(spark, d), 6, 0.1).select("gid", "rank", "nb"))


def _sor_sql(knn: int) -> str:
    return f"with {EMB}, {_knn_sql(knn)}, m as (select gid, coalesce(sum(sqrt(d2))/nullif(count(*)-1,0),0) mean from k group by gid), w as (select avg(mean) mu, avg(mean*mean) sq from m) "


query("a4_sor_mean", _sor_sql(6) + f"select gid, {mu('mean')} mean_u from m")(lambda spark, d: micros(FE.mean_distances(cloud_emb(spark, d), 6, 0.1), ["gid"], ["mean"]))
query("a4_sor_keep", _sor_sql(8) + "select gid, cast(mean <= mu + sqrt(abs(sq - mu*mu)) as int) keep from m, w")(lambda spark, d: FE.sor(cloud_emb(spark, d), 8, 1.0, 0.1).select("gid", "keep"))


def _shape_sql(hits: str, source: str = "k") -> str:
    """Covariance, eigenvalues and the least eigenvector of ``source`` rows, as CTEs up to s."""
    cov = ", ".join(f"avg(d{a}*d{b})-avg(d{a})*avg(d{b}) {a}{b}" for a, b in (p for p in FE.MOMENTS))
    return f"""{hits}, cv as (select gid, count(*) m, max(d2) far2, avg(dx) mx, avg(dy) my, avg(dz) mz, {cov} from {source} group by gid),
q1 as (select *, (xx+yy+zz)/3.0 q from cv),
q2 as (select *, sqrt(((xx-q)*(xx-q)+(yy-q)*(yy-q)+(zz-q)*(zz-q)+(xy*xy+xz*xz+yz*yz)*2.0)/6.0) p from q1),
q3 as (select *, (xx-q)/nullif(p,0) a, (yy-q)/nullif(p,0) b, (zz-q)/nullif(p,0) c, xy/nullif(p,0) dd, xz/nullif(p,0) e, yz/nullif(p,0) f from q2),
q4 as (select *, acos(least(greatest((a*(b*c-f*f)-dd*(dd*c-f*e)+e*(dd*f-b*e))/2.0, -1.0), 1.0))/3.0 ang from q3),
q5 as (select *, coalesce(q+p*2.0*cos(ang), q) hi, coalesce(q+p*2.0*cos(ang+2.0943951023931953), q) lo from q4),
q6 as (select *, greatest(q*3.0-hi-lo, 0) l1, greatest(hi, 0) l2, greatest(lo, 0) l0,
 xy*yz-xz*(yy-lo) ax, xz*xy-(xx-lo)*yz ay, (xx-lo)*(yy-lo)-xy*xy az,
 xy*(zz-lo)-xz*yz bx, xz*xz-(xx-lo)*(zz-lo) by_, (xx-lo)*yz-xy*xz bz,
 (yy-lo)*(zz-lo)-yz*yz cx, yz*xz-xy*(zz-lo) cy, xy*yz-(yy-lo)*xz cz from q5),
q7 as (select *, ax*ax+ay*ay+az*az an, bx*bx+by_*by_+bz*bz bn, cx*cx+cy*cy+cz*cz cn from q6),
q8 as (select *, nullif(sqrt(greatest(an,bn,cn)),0) len, case when an=greatest(an,bn,cn) then 1 when bn=greatest(an,bn,cn) then 2 else 3 end pick from q7),
s as (select *, case pick when 1 then ax when 2 then bx else cx end/len vx, case pick when 1 then ay when 2 then by_ else cy end/len vy, case pick when 1 then az when 2 then bz else cz end/len vz,
 greatest(l0+l1+l2, 1e-18) tot, greatest(l2, 1e-18) top, greatest(sqrt(far2), 1e-6) far from q8)"""


_share = [f"greatest(l{k}/tot, 1e-18)" for k in range(3)]
FEATURE_SQL = {
    "roughness": "abs(mx*vx+my*vy+mz*vz)", "curvature": "l0/tot", "planarity": "(l1-l0)/top", "linearity": "(l2-l1)/top", "sphericity": "l0/top", "anisotropy": "(l2-l0)/top",
    "eig1": "l2", "eig2": "l1", "eig3": "l0", "omnivariance": "pow(l0*l1*l2, 1.0::double/3.0)", "eigenentropy": "-(" + "+".join(f"{s}*ln({s})" for s in _share) + ")",
    "verticality": "1.0-abs(vz)", "volume_density": "m/(far*far*far*4.1887902047863905)", "surface_density": "m/(far*far*3.141592653589793)",
}
for _f, _e in FEATURE_SQL.items():
    query(f"a3_{_f}", f"with {EMB}, {_shape_sql(_knn_sql(9))} select gid, {mu(_e)} v_u from s")(lambda spark, d, f=_f: FE.feature(cloud_emb(spark, d), f, 8, cell=0.1).select("gid", C.micro(F.col("value")).alias("v_u")))
query("a3_neighbours", f"with {EMB}, {PAIRS} select gid, {mu('count(*)-1')} v_u from d where d2 <= {0.06 * 0.06!r} group by gid")(lambda spark, d: FE.feature(cloud_emb(spark, d), "neighbours", radius=0.06).select("gid", C.micro(F.col("value")).alias("v_u")))
query("a2_normals", f"with {EMB}, {_shape_sql(_knn_sql(9))} select gid, {mu('abs(vx)')} nx_u, {mu('abs(vy)')} ny_u, {mu('abs(vz)')} nz_u from s")(lambda spark, d: FE.normals(cloud_emb(spark, d), 8, 0.1).select("gid", *[C.micro(F.abs(f"n{c}")).alias(f"n{c}_u") for c in "xyz"]))
_near = "select f.gid, cast(case when f.n <= 3 then true else coalesce(abs(mx*vx+my*vy+mz*vz) <= sqrt(l0)*1.0, true) end as int) keep from f left join s on f.gid = s.gid"
query("a7_noise_radius", f"with {EMB}, {PAIRS}, " + _shape_sql(f"r as (select * from d where d2 <= {0.08 * 0.08!r}), f as (select gid, count(*) n from r group by gid), o as (select * from r where gid <> nb)", "o") + " " + _near)(lambda spark, d: FE.noise(cloud_emb(spark, d), 1.0, 0.08))
query("a7_noise_knn", f"with {EMB}, " + _shape_sql(f"{_knn_sql(8)}, f as (select gid, count(*) n from k group by gid), o as (select * from k where gid <> nb)", "o") + " " + _near)(lambda spark, d: FE.noise(cloud_emb(spark, d), 1.0, None, 8, cell=0.1))

STATIONS = [(0, 0.0, 0.0, 0.3), (1, 0.2, -0.1, -0.2), (2, -0.2, 0.2, 0.0)]
_stations = "st(sid, sx, sy, sz) as (values " + ", ".join(str(s) for s in STATIONS) + ")"
query("n6_viewpoints", f"with {EMB}, {_stations} select gid, arg_min(sid, struct_pack(d2 := (sx-x)*(sx-x)+(sy-y)*(sy-y)+(sz-z)*(sz-z), s := sid)) sid from cloud, st group by gid")(lambda spark, d: N.nearest_station(cloud_emb(spark, d), spark.createDataFrame(STATIONS, "sid int, x double, y double, z double")))
_halves = "a as (select * from cloud where gid % 2 = 0), b as (select * from cloud where gid % 2 = 1)"
query("n4_nearest", f"with {EMB}, {_halves}, d as (select a.gid, b.gid nb, (b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)+(b.z-a.z)*(b.z-a.z) d2 from a, b) select a.gid, r.nb from a left join (select gid, arg_min(nb, struct_pack(d2 := d2, nb := nb)) nb from d where d2 <= 0.01::double group by gid) r on a.gid = r.gid")(lambda spark, d: (lambda c: N.nearest_one(c.where("gid % 2 = 0"), c.where("gid % 2 = 1"), 0.1).select("gid", "nb"))(cloud_emb(spark, d)))
query("n5_distance", f"with {EMB}, {_halves}, d as (select a.gid, (b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)+(b.z-a.z)*(b.z-a.z) d2 from a, b) select gid, {mu('sqrt(min(d2))')} d_u from d group by gid")(lambda spark, d: (lambda c: micros(N.distance_to(c.where("gid % 2 = 0"), c.where("gid % 2 = 1"), 2.0), ["gid"], ["d"]))(cloud_emb(spark, d)))


@query("n5_signed", f"with {EMB}, {_halves}, d as (select a.gid, b.gid nb, b.x-a.x dx, b.y-a.y dy, b.z-a.z dz, (b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)+(b.z-a.z)*(b.z-a.z) d2 from a, b), n as (select gid, arg_min(struct_pack(dx := dx, dy := dy, dz := dz, d2 := d2, nb := nb), struct_pack(d2 := d2, nb := nb)) r from d group by gid) select gid, {mu('case when r.nb % 3 = 0 then sqrt(r.d2) else -(r.dx*0.6::double + r.dy*0.0 + r.dz*0.8::double) end')} d_u from n")
def signed_distance(spark: SparkSession, d: str) -> DataFrame:
    c, has = cloud_emb(spark, d), F.col("gid") % 3 != 0
    ref = c.where("gid % 2 = 1").withColumns({"nx": F.when(has, 0.6), "ny": F.when(has, 0.0), "nz": F.when(has, 0.8)})
    return micros(N.distance_to(c.where("gid % 2 = 0"), ref, 2.0, signed=True), ["gid"], ["d"])


query("a10_components", f"with recursive {EMB}, e as (select a.gid, b.gid nb from cloud a, cloud b where (b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)+(b.z-a.z)*(b.z-a.z) <= {0.04 * 0.04!r}), w(gid, nb) as (select gid, nb from e union select w.gid, e.nb from w join e on w.nb = e.gid), r as (select gid, min(nb) root from w group by gid), z as (select root, row_number() over (order by count(*) desc, root) - 1 label from r group by root having count(*) >= 3) select r.gid, cast(z.label as int) label from r left join z on r.root = z.root")(lambda spark, d: G.components(cloud_emb(spark, d), 0.04, 3))
query("a9_dedupe")(lambda spark, d: G.duplicates(cloud_emb(spark, d), 0.02))

# ---- fits and registration

query("g7_centres", f"with {ORD}, a as (select min(x)+max(x) x, min(y)+max(y) y, min(z)+max(z) z from cloud where gid % 2 = 0), b as (select min(x)+max(x) x, min(y)+max(y) y, min(z)+max(z) z from cloud where gid % 2 = 1) select {mu('b.x/2-a.x/2')} dx_u, {mu('b.y/2-a.y/2')} dy_u, {mu('b.z/2-a.z/2')} dz_u from a, b")(
    lambda spark, d: (lambda c: micros(spark.createDataFrame([tuple(map(float, FI.match_centres(c.where("gid % 2 = 0"), c.where("gid % 2 = 1"))[:3, 3]))], "dx double, dy double, dz double"), [], ["dx", "dy", "dz"]))(cloud_ord(spark, d))
)
query("g7_scales", f"with {ORD}, a as (select max(x)-min(x) x, max(y)-min(y) y, max(z)-min(z) z from cloud where gid % 2 = 0), b as (select max(x)-min(x) x, max(y)-min(y) y, max(z)-min(z) z from cloud where gid % 2 = 1) select {mu('(b.x/a.x+b.y/a.y+b.z/a.z)/3')} f_u from a, b")(lambda spark, d: (lambda c: micros(spark.createDataFrame([(FI.match_scales(c.where("gid % 2 = 0"), c.where("gid % 2 = 1")),)], "f double"), [], ["f"]))(cloud_ord(spark, d)))
query("a21_fitplane", f"with {EMB}, c0 as (select avg(x) ax, avg(y) ay, avg(z) az from cloud), k as (select 0 gid, x-ax dx, y-ay dy, z-az dz, 0.0 d2 from cloud, c0), {_shape_sql('z9 as (select 1)')} select count(*) points, {mu('sqrt(avg((dx*vx+dy*vy+dz*vz)*(dx*vx+dy*vy+dz*vz)))')} rms_u, {mu('max(abs(dx*vx+dy*vy+dz*vz))')} worst_u from k, s")(lambda spark, d: (lambda f: micros(spark.createDataFrame([(f["points"], f["rms"], f["worst"])], "points long, rms double, worst double"), ["points"], ["rms", "worst"]))(FI.fit_plane(cloud_emb(spark, d))))


query("a23_sphere", "select count(*) points, 3000000::bigint radius_u, 1000000::bigint x_u, -2000000::bigint y_u, 500000::bigint z_u from orders")(lambda spark, d: (lambda f: micros(spark.createDataFrame([(f["points"], f["radius"], *f["center"])], "points long, radius double, x double, y double, z double"), ["points"], ["radius", "x", "y", "z"]))(FI.fit_sphere(_shell_of_orders(spark, d, 3.0).select("gid", (F.col("x") + 1).alias("x"), (F.col("y") - 2).alias("y"), (F.col("z") + 0.5).alias("z")))))

# ---- rasters

for _stat, _agg in (("max", "max(z)"), ("min", "min(z)"), ("mean", "avg(z)"), ("density", "count(*)"), ("field", "avg(y)")):
    query(f"a11_raster_{_stat}", f"with {LI}, e as (select min(x) lx, min(y) ly from cloud) select cast(floor((x-lx)/2.0) as bigint) u, cast(floor((y-ly)/2.0) as bigint) v, {mu(_agg)} value_u from cloud, e group by 1, 2")(lambda spark, d, s=_stat: micros(R.raster(cloud_li(spark, d), 2.0, s, field="y", box={"x": 1.0, "y": 0.0}), ["u", "v"], ["value"]))
    SQL[f"a11_raster_{_stat}"] = SQL[f"a11_raster_{_stat}"].replace("select min(x) lx, min(y) ly from cloud", "select 1.0::double lx, 0.0::double ly")
_HOLES = "t as (select cast(floor((x-1.0)/2.0) as bigint) u, cast(floor(y/2.0) as bigint) v, max(z) value from cloud group by 1, 2 having (cast(floor((x-1.0)/2.0) as bigint) * 7 + cast(floor(y/2.0) as bigint) * 3) % 5 <> 0)"


def _holes(spark: SparkSession, d: str) -> DataFrame:
    return R.raster(cloud_li(spark, d), 2.0, "max", box={"x": 1.0, "y": 0.0}).where((F.col("u") * 7 + F.col("v") * 3) % 5 != 0)


_GRID = "g as (select a.u, b.v from (select unnest(generate_series((select min(u) from t), (select max(u) from t))) u) a, (select unnest(generate_series((select min(v) from t), (select max(v) from t))) v) b), hole as (select g.u, g.v from g anti join t on g.u = t.u and g.v = t.v), near as (select hole.u, hole.v, t.value, greatest(abs(t.u-hole.u), abs(t.v-hole.v)) ring, (t.u-hole.u)*(t.u-hole.u)+(t.v-hole.v)*(t.v-hole.v) d2, t.v-hole.v j, t.u-hole.u i from hole, t where greatest(abs(t.u-hole.u), abs(t.v-hole.v)) <= 12)"
query("a12_fill_nearest", f"with {LI}, {_HOLES}, {_GRID} select u, v, {mu('value')} value_u from t union all select u, v, {mu('arg_min(value, struct_pack(r := ring, d := d2, j := j, i := i))')} from near group by u, v")(lambda spark, d: micros(R.fill(_holes(spark, d)), ["u", "v"], ["value"]))
query("a12_fill_idw", f"with {LI}, {_HOLES}, {_GRID}, e as (select u, v, ring, count(*) n, sum(value/d2) s, sum(1.0::double/d2) w from near group by 1, 2, 3), o as (select *, coalesce(sum(n) over (partition by u, v order by ring rows between unbounded preceding and 1 preceding), 0) bf from e) select u, v, {mu('value')} value_u from t union all select u, v, {mu('sum(s)/sum(w)')} from o where bf < 8 group by u, v")(lambda spark, d: micros(R.fill(_holes(spark, d), "idw"), ["u", "v"], ["value"]))
query("a13_heightmap_grey", f"with {LI}, t as (select cast(floor((x-1.0)/2.0) as bigint) u, cast(floor(y/2.0) as bigint) v, max(z) value from cloud group by 1, 2), e as (select min(value) lo, max(value) hi from t) select u, v, cast(floor((value-lo)/(hi-lo)*254.0+0.5) as int)+1 grey from t, e")(lambda spark, d: R.grey(R.raster(cloud_li(spark, d), 2.0, "max", box={"x": 1.0, "y": 0.0})))
_VOL = f"{mu('coalesce(sum(case when d > 0 then d end), 0)')} added_u, {mu('coalesce(sum(case when d < 0 then -d end), 0)')} removed_u, {mu('sum(d)')} net_u, count(*) cells"
query("a14_volume_plane", f"with {ORD}, t as (select cast(floor(x/25.0) as bigint) u, cast(floor(y/25.0) as bigint) v, avg(z) value from cloud group by 1, 2), w as (select (value-50.0)*625.0 d from t) select {_VOL} from w")(lambda spark, d: micros(R.volume(R.raster(cloud_ord(spark, d), 25.0, "mean", box={"x": 0.0, "y": 0.0}), 25.0, plane=50.0), ["cells"], ["added", "removed", "net"]))
query("a14_volume_layer", f"with {ORD}, a as (select cast(floor(x/25.0) as bigint) u, cast(floor(y/25.0) as bigint) v, max(z) value from cloud group by 1, 2), b as (select cast(floor(x/25.0) as bigint) u, cast(floor(y/25.0) as bigint) v, min(z) value from cloud group by 1, 2), w as (select (a.value-b.value)*625.0 d from a join b using (u, v)) select {_VOL} from w")(
    lambda spark, d: (lambda c: micros(R.volume(R.raster(c, 25.0, "max", box={"x": 0.0, "y": 0.0}), 25.0, reference=R.raster(c, 25.0, "min", box={"x": 0.0, "y": 0.0})), ["cells"], ["added", "removed", "net"]))(cloud_ord(spark, d))
)


def _contour_sql(table: str, levels: str, mid: bool) -> str:
    at = (lambda p, q: "0.5::double") if mid else (lambda p, q: f"coalesce((level-{p})/nullif({q}-{p},0), 0.5)")
    ends = [(f"(u+{at('a', 'b')})", "(v+0.0)"), ("(u+1.0)", f"(v+{at('b', 'c')})"), (f"(u+{at('d', 'c')})", "(v+1.0)"), ("(u+0.0)", f"(v+{at('a', 'd')})")]
    rows = [f"select level, {mu(ends[s][0])} x1_u, {mu(ends[s][1])} y1_u, {mu(ends[e][0])} x2_u, {mu(ends[e][1])} y2_u from m where cs = {k}" for k, lines in R.SEGMENTS.items() for s, e in lines]
    return f"{table}, sq as (select t.u::double u, t.v::double v, t.value a, r.value b, x.value c, w.value d from t join t r on r.u=t.u+1 and r.v=t.v join t x on x.u=t.u+1 and x.v=t.v+1 join t w on w.u=t.u and w.v=t.v+1), lv(level) as (values {levels}), m as (select *, (a>=level)::int+2*(b>=level)::int+4*(c>=level)::int+8*(d>=level)::int cs from sq, lv), o as ({' union all '.join(rows)}) select {mu('level')} level_u, x1_u, y1_u, x2_u, y2_u from o"


query("g3_contour_segments", f"with {ORD}, " + _contour_sql("t as (select cast(floor(x/25.0) as bigint) u, cast(floor(y/25.0) as bigint) v, avg(z) value from cloud group by 1, 2)", "(45.0::double), (50.0), (55.0)", False))(lambda spark, d: micros(R.contour_segments(R.raster(cloud_ord(spark, d), 25.0, "mean", box={"x": 0.0, "y": 0.0}), [45.0, 50.0, 55.0]), [], ["level", "x1", "y1", "x2", "y2"]))
query("g4_footprint_segments", f"with {ORD}, f as (select distinct cast(floor(x/10.0+0.5) as bigint) u, cast(floor(y/10.0+0.5) as bigint) v from cloud where abs(z-50.0) <= 1.0), sp(i) as (values (-2),(-1),(0),(1),(2)), ar as (select distinct f.u+a.i u, f.v+b.i v from f, sp a, sp b), " + _contour_sql("t as (select ar.u, ar.v, case when f.u is null then 0.0::double else 1.0 end value from ar left join f on ar.u=f.u and ar.v=f.v)", "(0.5::double)", True))(
    lambda spark, d: micros(R.contour_segments(R.occupancy(cloud_ord(spark, d), 10.0, 50.0, 2.0, low={"x": 0.0, "y": 0.0}), [0.5], midpoints=True), [], ["level", "x1", "y1", "x2", "y2"])
)

# ---- meshes: blocks over the customers, and a strip over the orders

CUBE_V = [(k, float(k % 2), float(k // 2 % 2), float(k // 4)) for k in range(8)]
CUBE_T = [(0, 0, 2, 1), (1, 1, 2, 3), (2, 4, 5, 6), (3, 5, 7, 6), (4, 0, 1, 4), (5, 1, 5, 4), (6, 2, 6, 3), (7, 3, 6, 7), (8, 0, 4, 2), (9, 2, 4, 6), (10, 1, 3, 5), (11, 3, 7, 5)]


def cube(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(CUBE_V, "vid long, x double, y double, z double"), spark.createDataFrame(CUBE_T, "tid long, a long, b long, c long")


def grid(spark: SparkSession, n: int = 12) -> tuple[DataFrame, DataFrame]:
    """A grid lifted by a wave of whole numbers, for tests."""
    i, j = F.col("id") % (n + 1), F.floor(F.col("id") / (n + 1))
    v = spark.range((n + 1) ** 2).select(F.col("id").alias("vid"), i.cast("double").alias("x"), j.cast("double").alias("y"), ((i * i + 3 * j) % 5 / 4.0).alias("z"))
    p = F.floor(F.col("id") / n) * (n + 1) + F.col("id") % n
    t = spark.range(n * n).select((F.col("id") * 2).alias("tid"), p.alias("a"), (p + 1).alias("b"), (p + n + 2).alias("c"))
    return v, t.unionAll(spark.range(n * n).select((F.col("id") * 2 + 1).alias("tid"), p.alias("a"), (p + n + 2).alias("b"), (p + n + 1).alias("c")))


def grid_of_orders(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A strip of squares 64 wide whose vertices are the orders: a mesh that grows with its table."""
    v = table(spark, d, "orders").select(F.col("o_orderkey").alias("vid"), F.floor(F.col("o_orderkey") / 64).cast("double").alias("x"), (F.col("o_orderkey") % 64).cast("double").alias("y"), ((F.col("o_custkey") % 100) / 25.0).alias("z"))
    # The table's keys are all whole numbers from 0, so a square exists where its last corner does.
    p = v.where("vid >= 65 and vid % 64 > 0").select((F.col("vid") - 65).alias("p"))
    return v, p.select((F.col("p") * 2).alias("tid"), F.col("p").alias("a"), (F.col("p") + 64).alias("b"), (F.col("p") + 65).alias("c")).unionAll(
        p.select((F.col("p") * 2 + 1).alias("tid"), F.col("p").alias("a"), (F.col("p") + 65).alias("b"), (F.col("p") + 1).alias("c"))
    )


def blocks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A block for each customer, one beside the other, of a height of one to seven."""
    one = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    corners = F.explode(F.array(*[F.struct(*[F.lit(c).alias(n) for n, c in zip(("i", "x", "y", "z"), v, strict=True)]) for v in CUBE_V])).alias("v")
    sides = F.explode(F.array(*[F.struct(*[F.lit(c).alias(n) for n, c in zip(("t", "a", "b", "c"), t, strict=True)]) for t in CUBE_T])).alias("t")
    v = one.select("k", corners).select((F.col("k") * 8 + F.col("v.i")).alias("vid"), (F.col("v.x") + F.col("k") * 3.0).alias("x"), "v.y", (F.col("v.z") * (1 + F.col("k") % 7)).alias("z"))
    return v, one.select("k", sides).select((F.col("k") * 12 + F.col("t.t")).alias("tid"), *[(F.col("k") * 8 + F.col(f"t.{c}")).alias(c) for c in "abc"])


_CUBE = (
    "cv(i, x, y, z) as (values " + ", ".join(map(str, CUBE_V)) + "), ct(i, a, b, c) as (values " + ", ".join(map(str, CUBE_T)) + "), "
    "v as (select c_custkey * 8 + i vid, x + c_custkey * 3.0::double x, y, z * (1 + c_custkey % 7) z from customer, cv), t as (select c_custkey * 12 + i tid, c_custkey * 8 + a a, c_custkey * 8 + b b, c_custkey * 8 + c c from customer, ct)"
)
_GRIDM = (
    "v as (select o_orderkey vid, (o_orderkey // 64)::double x, (o_orderkey % 64)::double y, (o_custkey % 100) / 25.0::double z from orders), "
    "h as (select p.vid p from v p join v q on q.vid = p.vid + 65 where p.vid % 64 < 63), t as (select p * 2 tid, p a, p + 64 b, p + 65 c from h union all select p * 2 + 1, p, p + 65, p + 1 from h)"
)
_FULL = "w as (select tid, a, b, c, p.x ax, p.y ay, p.z az, (q.y-p.y)*(r.z-p.z)-(q.z-p.z)*(r.y-p.y) nx, (q.z-p.z)*(r.x-p.x)-(q.x-p.x)*(r.z-p.z) ny, (q.x-p.x)*(r.y-p.y)-(q.y-p.y)*(r.x-p.x) nz from t join v p on p.vid = a join v q on q.vid = b join v r on r.vid = c)"
_EDGES = "ed as (select least(s, e) p, greatest(s, e) q, count(*) uses from (select a s, b e from t union all select b, c from t union all select c, a from t) group by 1, 2)"
_MEASURE = f"select count(*) triangles, {mu(true_sum('twice') + '/2')} area_u, {mu('abs(' + true_sum('signed') + ')')} volume_u, (select count(*) from ed where uses = 1) boundary_edges, (select bool_and(uses = 2) from ed) closed from (select sqrt(nx*nx+ny*ny+nz*nz) twice, (ax*nx+ay*ny+az*nz)/6 signed from w)"
for _n, _cte, _mesh in (("cube", _CUBE, blocks), ("grid", _GRIDM, grid_of_orders)):
    query(f"a26_mesh_measure_{_n}", f"with {_cte}, {_FULL}, {_EDGES} {_MEASURE}")(lambda spark, d, m=_mesh: micros(ME.measure(*m(spark, d)), ["triangles", "boundary_edges", "closed"], ["area", "volume"]))
query("a27_boundary", f"with {_GRIDM}, {_EDGES} select p, q from ed where uses = 1")(lambda spark, d: ME.boundary(grid_of_orders(spark, d)[1]))
query("a28_normals", f"with {_GRIDM}, {_FULL}, e as (select a vid, nx, ny, nz from w union all select b, nx, ny, nz from w union all select c, nx, ny, nz from w), s as (select vid, sum(nx) x, sum(ny) y, sum(nz) z from e group by vid) select vid, {mu('x/sqrt(x*x+y*y+z*z)')} nx_u, {mu('y/sqrt(x*x+y*y+z*z)')} ny_u, {mu('z/sqrt(x*x+y*y+z*z)')} nz_u from s")(lambda spark, d: micros(ME.vertex_normals(*grid_of_orders(spark, d)), ["vid"], ["nx", "ny", "nz"]))
query("g12_flip", f"with {_GRIDM} select tid, a, c b, b c from t")(lambda spark, d: ME.flip(grid_of_orders(spark, d)[1]))
query("w3_cumulative_area", f"with {_GRIDM}, {_FULL} select tid, {mu(true_sum('area', 'over (order by tid rows unbounded preceding)') + ' / 1000')} total_u from (select tid, sqrt(nx*nx+ny*ny+nz*nz)/2 area from w)")(lambda spark, d: micros(ME.cumulative_area(*grid_of_orders(spark, d)).withColumn("total", F.col("total") / 1000), ["tid"], ["total"]))
query("g11_smooth", f"with {_GRIDM}, {_EDGES}, b as (select p, q from ed union all select q, p from ed), pin as (select p vid from ed where uses = 1 union select q from ed where uses = 1), m as (select b.p vid, avg(v.x) x, avg(v.y) y, avg(v.z) z from b join v on v.vid = b.q group by 1) select v.vid, " + ", ".join(mu(f"case when v.vid in (select vid from pin) then v.{c} else v.{c}+(m.{c}-v.{c})*0.5 end") + f" {c}_u" for c in "xyz") + " from v join m on m.vid = v.vid")(lambda spark, d: micros(ME.smooth(*grid_of_orders(spark, d), passes=1, taubin=False), ["vid"], list("xyz")))
query("a29_decimate", f"with {_GRIDM}, o as (select vid, min(vid) over (partition by floor(x/3.0), floor(y/3.0), floor(z/3.0)) cid from v), n as (select p.cid a, q.cid b, r.cid c from t join o p on p.vid = a join o q on q.vid = b join o r on r.vid = c where p.cid <> q.cid and q.cid <> r.cid and r.cid <> p.cid) select (select count(distinct cid) from o) vertices, count(distinct list_sort([a, b, c])) triangles from n")(lambda spark, d: (lambda m: m[0].agg(F.count("*").alias("vertices")).join(m[1].agg(F.count("*").alias("triangles"))))(ME.decimate(*grid_of_orders(spark, d), 3.0)))
query("g13_sample")(lambda spark, d: ME.sample(*grid_of_orders(spark, d), 5000).select("gid", "x", "y", "z"))

TRI = ((-0.1, -0.1, 0.0), (0.15, -0.05, 0.05), (0.0, 0.2, -0.05))


def _tri_sql() -> str:
    p, (a, b, c) = ("x", "y", "z"), TRI
    n = np.cross(np.subtract(b, a), np.subtract(c, a))

    def edge(s, e):
        dd = float(np.dot(np.subtract(e, s), np.subtract(e, s)))
        t = "least(greatest((" + "+".join(f"({q}-({o!r}))*({float(k)!r})" for q, o, k in zip(p, s, np.subtract(e, s), strict=True)) + f")/{dd!r}, 0.0::double), 1.0::double)"
        return "+".join(f"pow(({q}-({o!r}))-({float(k)!r})*{t}, 2)" for q, o, k in zip(p, s, np.subtract(e, s), strict=True))

    ab, ac = np.subtract(b, a), np.subtract(c, a)
    d00, d01, d11, nn = float(ab @ ab), float(ab @ ac), float(ac @ ac), float(n @ n)
    d20, d21 = ("(" + "+".join(f"({q}-({o!r}))*({float(k)!r})" for q, o, k in zip(p, a, e, strict=True)) + ")" for e in (ab, ac))
    v, w = f"(({d11!r}*{d20}-({d01!r})*{d21})/{nn!r})", f"(({d00!r}*{d21}-({d01!r})*{d20})/{nn!r})"
    h = "(" + "+".join(f"({q}-({o!r}))*({float(k)!r})" for q, o, k in zip(p, a, n, strict=True)) + ")"
    return f"with {EMB} select gid, {mu(f'sqrt(case when {v} >= 0 and {w} >= 0 and {v}+{w} <= 1 then {h}*{h}/{nn!r} else least({edge(a, b)}, {edge(b, c)}, {edge(c, a)}) end)')} d_u, sign({h})::int side from cloud"


@query("j15_point_triangle", _tri_sql())
def triangle_distance(spark: SparkSession, d: str) -> DataFrame:
    d2, side = C.point_triangle(tuple(F.col(c) for c in "xyz"), *[tuple(F.lit(v) for v in k) for k in TRI])
    return cloud_emb(spark, d).select("gid", C.micro(F.sqrt(d2)).alias("d_u"), side.cast("int").alias("side"))


@query("n8_mesh_distance", _tri_sql().rsplit(", sign(", 1)[0] + " from cloud")
def mesh_distance(spark: SparkSession, d: str) -> DataFrame:
    v = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(TRI)], "vid long, x double, y double, z double")
    return micros(N.mesh_distance(cloud_emb(spark, d), v, spark.createDataFrame([(0, 0, 1, 2)], "tid long, a long, b long, c long"), 2.0), ["gid"], ["d"])


def _shell(spark: SparkSession, n: int = 6000, radius: float = 1.0) -> DataFrame:
    """A sphere of so many points, for tests."""
    k = F.col("id").cast("double")
    z = F.lit(1.0) - (k * 2 + 1.0) / float(n)
    flat = F.sqrt(F.lit(1.0) - z * z)
    unit = spark.range(n).select(F.col("id").alias("gid"), (flat * F.cos(k * 2.399963229728653)).alias("nx"), (flat * F.sin(k * 2.399963229728653)).alias("ny"), z.alias("nz"))
    return unit.select("gid", *[(F.col(f"n{c}") * radius).alias(c) for c in "xyz"], "nx", "ny", "nz")


def _shell_of_orders(spark: SparkSession, d: str, radius: float = 1.0, rows: str = "true") -> DataFrame:
    """The orders spread evenly over a sphere, by multiples of two irrational steps, with the normals they stand on."""
    share = lambda step: F.col("o_orderkey") * step - F.floor(F.col("o_orderkey") * step)
    z, turn = share(0.7548776662466927) * 2.0 - 1.0, share(0.5698402909980532) * (2 * np.pi)
    flat = F.sqrt(F.greatest(F.lit(1.0) - z * z, F.lit(0.0)))
    unit = table(spark, d, "orders").where(rows).select(F.col("o_orderkey").alias("gid"), (flat * F.cos(turn)).alias("nx"), (flat * F.sin(turn)).alias("ny"), z.alias("nz"))
    return unit.select("gid", *[(F.col(f"n{c}") * radius).alias(c) for c in "xyz"], "nx", "ny", "nz")


def _floor_and_ball(spark: SparkSession, d: str) -> DataFrame:
    """Three of five orders on a floor, a strip a hundred wide; two of five on a ball above its beginning."""
    step = F.floor(F.col("o_orderkey") / 5) * 3 + F.col("o_orderkey") % 5
    flat = table(spark, d, "orders").where("o_orderkey % 5 < 3").select(
        F.col("o_orderkey").alias("gid"), ((step % 100) * 0.05).alias("x"), (F.floor(step / 100) * 0.05).alias("y"), *[F.lit(v).alias(c) for c, v in (("z", 0.0), ("nx", 0.0), ("ny", 0.0), ("nz", 1.0))]
    )
    ball = _shell_of_orders(spark, d, 0.5, "o_orderkey % 5 >= 3")
    return flat.unionAll(ball.select("gid", *[(F.col(c) + o).alias(c) for c, o in (("x", 2.0), ("y", 2.0), ("z", 1.5))], "nx", "ny", "nz"))


query("a30_tsdf")(lambda spark, d: micros(ME.tsdf(_shell_of_orders(spark, d), 0.1), ["gx", "gy", "gz"], ["dist", "weight"]))
query("g9_surface_nets")(lambda spark, d: micros(ME.measure(*ME.build_surface(_shell_of_orders(spark, d), 0.1)), ["triangles", "boundary_edges", "closed"], ["area", "volume"]))
query("g1_orient")(lambda spark, d: G.orient(_shell_of_orders(spark, d).withColumn("s", F.when(F.pmod(F.xxhash64("gid"), F.lit(2)) == 0, 1.0).otherwise(-1.0)).withColumns({f"n{c}": F.col(f"n{c}") * F.col("s") for c in "xyz"}).drop("s"), 6, 0.15).select("gid", C.micro(F.col("nx") * F.col("x") + F.col("ny") * F.col("y") + F.col("nz") * F.col("z")).alias("out_u")))


@query("g5_icp")
def icp(spark: SparkSession, d: str) -> DataFrame:
    fixed = _shell_of_orders(spark, d).withColumn("x", F.col("x") * 2).withColumn("z", F.col("z") * 0.5)
    moved = M.transform(fixed.select("gid", "x", "y", "z"), M.translation(0.05, -0.03, 0.02) @ M.rotation("z", 2.0))
    found = FI.icp(moved, FE.face_stations(fixed, spark.createDataFrame([(0, 9.0, 9.0, 9.0)], "sid int, x double, y double, z double")), 0.3)
    return micros(spark.createDataFrame([(found["pairs"], found["rms"])], "pairs long, rms double"), ["pairs"], ["rms"])


@query("g6_detect")
def detect(spark: SparkSession, d: str) -> DataFrame:
    cloud = _floor_and_ball(spark, d)
    shapes = FI.detect(cloud, least=max(4, cloud.count() // 4), kinds=("plane", "sphere"), trials=120, most=2)
    return spark.createDataFrame([(s["shape"], s["kind"], s["points"]) for s in shapes], "shape int, kind string, points long")
