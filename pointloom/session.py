"""Sessions: layers over DataFrames, a command table, history by lineage, scripts and a log.

A layer's versions are DataFrames; an edit appends one, undo steps back, and nothing is copied."""

from __future__ import annotations

import inspect
import re
import time
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions import matrix as M
from pointloom.operators import features as FE
from pointloom.operators import fitting as FI
from pointloom.operators import graph as G
from pointloom.operators import layout as L
from pointloom.operators import mesh as ME
from pointloom.operators import neighbours as N
from pointloom.operators import raster as R
from pointloom.operators import regions as RG
from pointloom.sources import files
from pointloom.sources.e57 import write_e57

LOG, STEPS = 500, 80
#: Commands that change data, each with the ops that only look; a script's steps are asked one by one.
EDITS = {
    "analysis": (), "regions": ("list",), "transform": ("get",), "entities": ("list",), "register": (), "distance_to": (),
    "mesh": ("list", "measure", "save"), "surface": ("export", "status"), "history": ("status", "save"), "cache": ("list", "write", "has"),
    "shapes": ("list",),
}

#: Default widths as multiples of the spacing (reach and gate: of the cell), and the least they may be, in metres.
SPACINGS = {"cell": 2.5, "section": 8, "contour": 10, "reach": 200, "gate": 7.2}
LEAST = {"cell": 0.01, "section": 0.1, "contour": 0.15, "reach": 2.0}
#: Cells along a footprint's longer side, and vertices of all its lines.
ACROSS, VERTICES = 400, 12_000


def edits(command: str, handler, args: dict) -> bool:
    """Whether the op that the command comes to, its default included, changes data."""
    if command not in EDITS:
        return False
    op = args.get("op", getattr(inspect.signature(handler).parameters.get("op"), "default", None))
    return op not in EDITS[command]


@dataclass
class Layer:
    name: str
    versions: list[DataFrame]
    model: list[np.ndarray] = field(default_factory=lambda: [np.eye(4)])
    at: int = 0
    visible: bool = True
    spacings: dict[int, float] = field(default_factory=dict)  # by version, as they are asked for

    @property
    def cloud(self) -> DataFrame:
        return self.versions[self.at]

    @property
    def matrix(self) -> np.ndarray:
        return self.model[self.at]

    def placed(self) -> DataFrame:
        return M.transform(self.cloud, self.matrix)

    def spacing(self) -> float:
        """How far apart neighbours are in the placed frame."""
        if self.at not in self.spacings:
            self.spacings[self.at] = L.cloud_spacing(self.cloud)
        return self.spacings[self.at] * abs(M.decompose(self.matrix)["scale"])

    def commit(self, cloud: DataFrame | None = None, matrix: np.ndarray | None = None) -> None:
        known = {k: v for k, v in self.spacings.items() if k <= self.at}
        self.spacings = known | ({self.at + 1: known[self.at]} if cloud is None and self.at in known else {})
        self.versions = [*self.versions[: self.at + 1], cloud if cloud is not None else self.cloud]
        self.model = [*self.model[: self.at + 1], matrix if matrix is not None else self.matrix]
        self.at += 1


class Session:
    def __init__(self, spark: SparkSession, allow_edits: bool = True) -> None:
        self.spark, self.allow_edits = spark, allow_edits
        self.layers: dict[str, Layer] = {}
        self.active: str | None = None
        self.regions: dict[str, RG.Region] = {}
        self.meshes: dict[str, tuple[DataFrame, DataFrame]] = {}
        self.shapes: list[dict] = []
        self.views: dict[str, DataFrame] = {}
        self.frame: tuple[float, float, float] | None = None  # the shift of the first layer that was opened near its own origin
        self.entries: list[dict] = []
        self.values: dict[str, Any] = {}

    def add(self, name: str, cloud: DataFrame) -> Layer:
        self.layers[name] = Layer(name, [cloud])
        self.active = self.active or name
        return self.layers[name]

    @property
    def layer(self) -> Layer:
        if self.active is None:
            raise ValueError("no layer is active")
        return self.layers[self.active]

    def _cell(self) -> float:
        """The width of search cells: two and a half spacings of the active layer, a centimetre at least."""
        return max(self.layer.spacing() * SPACINGS["cell"], LEAST["cell"])

    # -- the command surface

    def run(self, command: str, **args) -> dict:
        """Runs a command, logs it, and returns its reply."""
        began, handler = time.time(), getattr(self, f"do_{command}", None)
        entry = {"command": command, "args": args, "edit": handler is not None and edits(command, handler, args)}
        try:
            if handler is None:
                raise ValueError(f"no command {command!r}")
            if entry["edit"] and not self.allow_edits:
                raise PermissionError("edits are off")
            reply = handler(**args)
            self.values["last"] = reply
            entry |= {"state": "ok", "reply": reply}
            return reply
        except Exception as e:
            entry |= {"state": "error", "error": str(e)}
            raise
        finally:
            self.entries = [*self.entries, entry | {"at": began, "ms": (time.time() - began) * 1000}][-LOG:]

    def do_log(self, limit: int = 50) -> dict:
        return {"entries": self.entries[::-1][:limit]}

    def do_open(self, path: str, name: str | None = None, stride: int = 1, local: bool = False, cache: str | None = None) -> dict:
        """A file with faces opens as a mesh, any other as a layer.

        ``local``: coordinates less the file's own shift, and the layer placed by how its shift differs from the first
        one's. ``cache``: a folder of decoded clouds; a file of the same name, size, time and stride is read from there."""
        name = name or path.rstrip("/").rsplit("/", 1)[-1]
        if files.looks_like_mesh(path):
            self.meshes[name] = files.read_mesh(self.spark, path)
            return {"mesh": name}
        shift = files.shift_of(path) if local else (0.0, 0.0, 0.0)
        key = files.file_key(path, stride) + ("l" if local else "") if cache else None
        store = files.Cache(self.spark, cache) if cache else None
        hit = store is not None and store.has(key)
        if hit:
            cloud = store.read(key)
        else:
            cloud = files.read_las(self.spark, path, shift) if any(shift) else files.read(self.spark, path)
            cloud = L.stride(cloud, stride) if stride > 1 else cloud
            if store is not None:
                store.write(key, cloud)
                cloud = store.read(key)
        layer = self.add(name, cloud)
        if local:
            self.frame = self.frame or tuple(shift)
            layer.model = [M.placement(shift, self.frame)]
        return {"layer": name} | ({"cached": hit, "key": key} if cache else {})

    def do_export(self, path: str, format: str = "ply", stride: int = 1) -> dict:
        cloud = L.stride(self.layer.placed(), stride) if stride > 1 else self.layer.placed()
        {"ply": files.write_ply, "las": files.write_las, "e57": write_e57, "text": files.write_text, "parquet": lambda c, p: c.write.parquet(p)}[format](cloud, path)
        return {"path": path}

    def do_state(self) -> dict:
        ends = [f(c).alias(f"{c}{k}") for c in "xyz" for f, k in ((F.min, "min"), (F.max, "max"))]
        row = self.layer.placed().agg(F.count("*").alias("points"), *ends).first().asDict()
        return row | {"layers": list(self.layers), "active": self.active, "fields": [c for c in self.layer.cloud.columns if c not in ("gid", "x", "y", "z")]}

    def do_inside(self, region: dict) -> dict:
        return RG.inside(self.layer.placed(), _region(region)).first().asDict()

    def do_distance(self, a: list[float], b: list[float]) -> dict:
        d = np.subtract(b, a)
        return {"distance": float(np.linalg.norm(d)), "dz": float(d[2]), "horizontal": float(np.hypot(d[0], d[1]))}

    do_measure = do_distance

    def do_entities(self, op: str = "list", name: str | None = None, to: str | None = None) -> dict:
        if op == "list":
            return {"layers": [{"name": k, "visible": v.visible, "active": k == self.active} for k, v in self.layers.items()]}
        if op == "activate":
            self.active = self.layers[name].name
        elif op in ("show", "hide"):
            self.layers[name].visible = op == "show"
        elif op == "rename":
            layer = self.layers.pop(name)
            layer.name = to
            self.layers[to] = layer
            self.active = to if self.active == name else self.active
        elif op == "remove":
            del self.layers[name]
            self.active = next(iter(self.layers), None) if self.active == name else self.active
        elif op == "clone":
            source = self.layers[name or self.active]
            self.layers[to or f"{source.name} copy"] = Layer(to or f"{source.name} copy", [source.cloud], [source.matrix])
        elif op == "merge":
            back = np.linalg.inv(self.layer.matrix)
            others = {k: M.transform(v.cloud, back @ v.matrix) for k, v in self.layers.items() if k != self.active and v.visible}
            merged = L.merge([self.layer.cloud, *others.values()])
            matrix = self.layer.matrix
            self.layers = {k: Layer(k, [merged], [matrix]) if k == self.active else v for k, v in self.layers.items() if k not in others}
        else:
            raise ValueError(f"no entities op {op!r}")
        return {"ok": True}

    def _bounds(self) -> tuple[list[float], list[float]]:
        ends = self.layer.placed().agg(*[f(c).alias(f"{c}{n}") for c in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
        return [ends[f"{c}lo"] or 0.0 for c in "xyz"], [ends[f"{c}hi"] or 0.0 for c in "xyz"]

    def do_regions(self, op: str = "list", region: dict | None = None, id: str | None = None, factor: float = 1.0, at=None, kind: str = "box", size: float | str | None = None, polygon=None, camera: dict | None = None, depth: float | None = None) -> dict:
        new = id or (region or {}).get("id") or f"r{len(self.regions) + 1}"
        if op == "add" or (op == "place" and at is None):
            self.regions[new] = replace(_region(region), id=new)
            return {"region": new}
        if op == "place":
            # size: metres, or "spacing" for one that follows the cloud's own spacing
            first = RG.start_size(self._bounds(), self.layer.spacing()) if size == "spacing" else size or RG.start_size(self._bounds())
            self.regions[new] = RG.place(at, kind, first, new)
            return {"region": new}
        if op == "lasso":
            # camera: width, height, eye, target, up, fov of the view that the outline was drawn on
            self.regions[new] = RG.prism_from_screen([tuple(p) for p in polygon], bounds=self._bounds(), depth_half=depth, id=new, **camera)
            return {"region": new, "vertices": len(self.regions[new].polygon)}
        if op == "update":
            self.regions[id] = replace(_region(region), id=id)
        elif op == "remove":
            del self.regions[id]
        elif op == "clear":
            self.regions = {}
        elif op == "grow":
            self.regions[id] = self.regions[id].scaled(factor)
        elif op == "fit":
            self.regions[id] = RG.fit_to_contents(self.layer.placed(), self.regions[id])
        elif op == "mode":
            self.regions[id] = replace(self.regions[id], role=region["role"])
        elif op == "apply":
            # Regions are in the placed frame; the test goes through the model, the rows stay in theirs.
            m = self.layer.matrix
            moved = dict(zip("xyz", M.applied(m, F.col("x"), F.col("y"), F.col("z")), strict=True))
            tests = {role: [r.inside(moved["x"], moved["y"], moved["z"]) for r in self.regions.values() if r.role == role] for role in ("keep", "delete")}
            keep = F.lit(True) if not tests["keep"] else F.lit(False)
            for t in tests["keep"]:
                keep = keep | t
            for t in tests["delete"]:
                keep = keep & ~t
            self.layer.commit(self.layer.cloud.where(keep))
            self.regions = {k: r for k, r in self.regions.items() if r.role == "pending"}
        elif op != "list":
            raise ValueError(f"no regions op {op!r}")
        return {"regions": [{"id": r.id, "kind": r.kind, "role": r.role, "center": list(r.center)} for r in self.regions.values()]}

    def do_transform(self, op: str = "get", matrix=None, translation=(0, 0, 0), axis="z", degrees: float = 0.0, about=None, factor: float = 1.0) -> dict:
        now = self.layer.matrix
        if op == "get":
            return {"matrix": now.ravel().tolist(), **M.decompose(now)}
        centre = about
        if about is None and op in ("rotate", "scale"):
            centre = [float(v) for v in self.layer.placed().agg(*[(F.min(c) + F.max(c)) / 2 for c in "xyz"]).first()]
        new = {
            "set": lambda: np.array(matrix, float).reshape(4, 4), "reset": M.identity, "translate": lambda: M.translation(*translation) @ now,
            "rotate": lambda: M.rotation(axis, degrees, centre) @ now, "scale": lambda: M.scaling(factor, centre) @ now, "level": lambda: FI.level(self.layer.placed()) @ now,
        }[op]()
        self.layer.commit(matrix=new)
        return {"matrix": new.ravel().tolist()}

    def do_analysis(self, op: str, neighbours: int | None = None, nSigma: float = 1.0, cell: float | None = None, feature: str = "roughness", radius: float | None = None, minPoints: int = 16, tolerance: float = 0.001, spacing: float | None = None, neighbourhood: str = "sphere", absoluteError: float | None = None, removeIsolated: bool = False, orient: bool = True) -> dict:
        # Radii, spacings and tolerances are metres of the placed frame; what is found goes back to the layer's rows by id.
        # What isn't given follows from the cloud's own spacing, in whatever unit it is.
        cloud, placed, back = self.layer.cloud, self.layer.placed(), np.linalg.inv(self.layer.matrix)
        cell = cell or (None if op in ("invert", "duplicates") else self._cell())
        if op == "normals":
            new = placed.drop("nx", "ny", "nz").join(FE.normals(placed, neighbours or 16, cell), "gid")
            new = G.orient(new, neighbours or 16, cell) if orient else new
            turned = M.transform(new.select("gid", "x", "y", "z", "nx", "ny", "nz"), back).select("gid", "nx", "ny", "nz")
            new = cloud.drop("nx", "ny", "nz").join(turned, "gid")
        elif op == "invert":
            new = FE.invert_normals(cloud)
        elif op == "feature":
            new = cloud.drop(feature).join(FE.feature(placed, feature, neighbours or 16, radius or cell, cell).withColumnRenamed("value", feature), "gid")
        elif op == "components":
            new = cloud.drop("component").join(G.components(placed, radius or cell, minPoints).withColumnRenamed("label", "component"), "gid")
        elif op == "sor":
            new = _kept(cloud, FE.sor(placed, neighbours or 8, nSigma, cell))
        elif op == "noise":
            new = _kept(cloud, FE.noise(placed, nSigma, (radius or 1.2 * cell) if neighbourhood == "sphere" else None, neighbours or 8, absoluteError, removeIsolated, cell))
        elif op == "duplicates":
            new = _kept(cloud, G.duplicates(placed, tolerance))
        elif op == "subsample":
            new = cloud.join(L.thin(placed, spacing or cell).select("gid"), "gid", "left_semi")
        else:
            raise ValueError(f"no analysis op {op!r}")
        self.layer.commit(new)
        return {"points": new.count()}

    def do_register(self, op: str, reference: str, maxDistance: float | None = None, maxIterations: int = 30) -> dict:
        fixed, moving = self.layers[reference].placed(), self.layer.placed()
        reply: dict = {}
        if op == "centres":
            step = FI.match_centres(moving, fixed)
        elif op == "scales":
            factor = FI.match_scales(moving, fixed)
            step = M.scaling(factor, [float(v) for v in moving.agg(*[(F.min(c) + F.max(c)) / 2 for c in "xyz"]).first()])
            reply = {"factor": factor}
        else:
            maxDistance = maxDistance or self._cell() * SPACINGS["gate"]
            if "nx" not in fixed.columns or FE.normal_share(fixed) < 0.5:
                fixed = fixed.drop("nx", "ny", "nz").join(FE.normals(fixed, 16, maxDistance / 2), "gid")
            reply = FI.icp(moving, fixed, maxDistance, maxIterations)
            step = np.array(reply["matrix"])
        self.layer.commit(matrix=step @ self.layer.matrix)
        return reply | {"matrix": (step @ self.layer.matrix).ravel().tolist()}

    def do_distance_to(self, reference: str, reach: float | None = None, signed: bool = False) -> dict:
        cloud, reach = self.layer.cloud, reach or max(self._cell() * SPACINGS["reach"], LEAST["reach"])
        d = N.distance_to(self.layer.placed(), self.layers[reference].placed(), reach, signed).withColumnRenamed("d", "distance")
        self.layer.commit(cloud.drop("distance").join(d, "gid"))
        return self.layer.cloud.agg(F.count("distance").alias("points"), F.avg("distance").alias("mean"), F.max("distance").alias("max")).first().asDict()

    def do_volume(self, cell: float = 0.25, reference: str | None = None, plane: float | None = None) -> dict:
        here = self.layer.placed()
        low = here.agg(F.min("x").alias("x"), F.min("y").alias("y")).first().asDict()
        below = R.raster(self.layers[reference].placed(), cell, "mean", box=low) if reference else None
        return R.volume(R.raster(here, cell, "mean", box=low), cell, plane, below).first().asDict()

    def do_fit(self, shape: str, region: dict | None = None) -> dict:
        cloud = self.layer.placed()
        return FI.FITS[shape](cloud.where(_region(region).inside()) if region else cloud)

    def do_fitplane(self, region: dict | None = None) -> dict:
        return self.do_fit("plane", region)

    def do_detect(self, tolerance: float = 0.02, minPoints: int = 2000, shapes=("plane", "sphere", "cylinder")) -> dict:
        """Shapes of the active layer; normals that it lacks are made on the way."""
        placed = self.layer.placed()
        if "nx" not in placed.columns:
            placed = placed.join(FE.normals(placed, 16, self._cell()), "gid")
        self.shapes = [f | {"tolerance": tolerance} for f in FI.detect(placed, tolerance, minPoints, kinds=tuple(shapes))]
        return {"shapes": self.shapes}

    def do_shapes(self, op: str = "list") -> dict:
        """What ``detect`` found last: listed, put on the points as ``shape`` (label), or the only points that stay (keep) or go (remove)."""
        if op == "list":
            return {"shapes": self.shapes}
        if op not in ("label", "keep", "remove"):
            raise ValueError(f"no shapes op {op!r}")
        if not self.shapes:
            raise ValueError("no shapes were detected")
        cloud = self.layer.cloud.drop("shape").join(FI.label_shapes(self.layer.placed(), self.shapes, self.shapes[0]["tolerance"]), "gid")
        self.layer.commit(cloud if op == "label" else RG.shape_mask(cloud, keep=op == "keep"))
        return {"points": self.layer.cloud.count()}

    def do_contour(self, z: float | None = None, cell: float | None = None, thickness: float | None = None, dilate: bool = False, vertices: int = VERTICES, resolution: int = ACROSS) -> dict:
        """Outlines of a slab, by default about the middle of the height; at most ``vertices`` points reach the driver."""
        (x0, y0, z0), (x1, y1, z1) = self._bounds()
        spacing = self.layer.spacing() if cell is None or thickness is None else 0.0
        cell = cell or max(max(x1 - x0, y1 - y0) / max(16, min(1024, resolution)), spacing * SPACINGS["cell"], 1e-3)
        thickness = thickness or max(LEAST["contour"], spacing * SPACINGS["contour"])
        lines = R.footprint(self.layer.placed(), cell, (z0 + z1) / 2 if z is None else z, thickness, dilate, vertices)
        return {"cell": cell, "thickness": thickness, "lines": [[(p.x, p.y) for p in r.points] for r in lines.collect()]}

    def do_contours(self, interval: float, cell: float, axis: str = "z", path: str | None = None) -> dict:
        """Height lines of a raster of means; with ``path`` they are written as Parquet, else their number is told."""
        lines = R.contours(R.raster(self.layer.placed(), cell, "mean", axis), interval)
        if path:
            lines.write.mode("overwrite").parquet(path)
        row = lines.agg(F.count("*").alias("lines"), F.count_distinct("level").alias("levels"), F.coalesce(F.sum(F.size("points")), F.lit(0)).alias("vertices")).first()
        return row.asDict()

    def do_section(self, axis: str = "z", at: float | None = None, thickness: float | None = None) -> dict:
        lo, hi = self._bounds() if at is None else ((0.0,) * 3, (0.0,) * 3)
        at = sum((lo["xyz".index(axis)], hi["xyz".index(axis)])) / 2 if at is None else at
        thickness = thickness or max(LEAST["section"], self.layer.spacing() * SPACINGS["section"])
        found = RG.section(self.layer.placed(), axis, at, thickness).agg(F.count("*").alias("points")).first().asDict()
        return found | {"at": at, "thickness": thickness}

    def do_view(self, right=(1, 0, 0), up=(0, 1, 0), toward=(0, 0, 1), perPixel: float = 0.01, camera: dict | None = None, name: str = "view") -> dict:
        """A picture as a table (px, py, gid) in ``views``: orthographic, or with a ``camera`` (width, height, eye, target, up,
        fov, and near and far if need be) in perspective, with depths."""
        if camera:
            view, size = M.perspective(**camera), (camera["width"], camera["height"])
            table, mapping = R.perspective_view(self.layer.placed(), view, *size), {"viewProjection": view.ravel().tolist(), "width": size[0], "height": size[1]}
        else:
            table, mapping = R.ortho_view(self.layer.placed(), right, up, toward, perPixel), R.view_mapping(right, up, toward, perPixel)
        self.views[name] = table
        return {"view": name, "pixels": table.count(), **mapping}

    def do_pick(self, px: int, py: int, camera: dict, reach: int = 0) -> dict:
        """The point that a pixel of a perspective view shows, and how far it is along the sight."""
        found = R.pick(self.layer.placed(), px, py, M.perspective(**camera), camera["width"], camera["height"], reach).first()
        return {"hit": found is not None, **(found.asDict() if found is not None else {})}

    def do_probe(self, px: int, py: int, right=(1, 0, 0), up=(0, 1, 0), toward=(0, 0, 1), perPixel: float = 0.01, reach: int = 0) -> dict:
        found = R.probe(self.layer.placed(), px, py, right, up, toward, perPixel, reach).first()
        return {"hit": found is not None, **(found.asDict() if found is not None else {})}

    def do_surface(self, op: str = "build", name: str = "surface", voxel: float = 0.06, smoothing: int = 2, path: str | None = None) -> dict:
        if op == "build":
            placed = self.layer.placed()
            self.meshes[name] = ME.build_surface(placed, voxel, smoothing)
            measured = ME.measure(*self.meshes[name]).first().asDict()
            return measured | {"recommended": ME.recommended_source(measured, "nx" in placed.columns and FE.normal_share(placed) >= 0.2)}
        if op == "clear":
            del self.meshes[name]
        elif op == "export":
            files.write_mesh(*self.meshes[name], path)
        else:
            raise ValueError(f"no surface op {op!r}")
        return {"ok": True}

    def do_mesh(self, op: str = "list", name: str = "surface", path: str | None = None, iterations: int = 5, taubin: bool = True, cell: float = 0.1, count: int = 200_000, reach: float | None = None, signed: bool = False) -> dict:
        if op == "list":
            return {"meshes": list(self.meshes)}
        if op == "open":
            self.meshes[name] = files.read_mesh(self.spark, path)
            return {"mesh": name}
        vertices, triangles = self.meshes[name]
        if op == "flip":
            self.meshes[name] = vertices, ME.flip(triangles)
        elif op == "smooth":
            self.meshes[name] = ME.smooth(vertices, triangles, iterations, taubin), triangles
        elif op == "decimate":
            self.meshes[name] = ME.decimate(vertices, triangles, cell)
        elif op == "sample":
            self.add(f"{name} points", ME.sample(vertices, triangles, count))
            return {"layer": f"{name} points"}
        elif op == "distance":
            cloud, reach = self.layer.cloud, reach or max(self._cell() * SPACINGS["reach"], LEAST["reach"])
            d = N.mesh_distance(self.layer.placed(), vertices, triangles, reach, signed).withColumnRenamed("d", "distance")
            self.layer.commit(cloud.drop("distance").join(d, "gid"))
            return self.layer.cloud.agg(F.count("distance").alias("points"), F.avg("distance").alias("mean")).first().asDict()
        elif op == "save":
            files.write_mesh(vertices, triangles, path)
        elif op != "measure":
            raise ValueError(f"no mesh op {op!r}")
        return ME.measure(*self.meshes[name]).first().asDict()

    def do_heightmap(self, cell: float, axis: str = "z") -> dict:
        grey = R.grey(R.raster(self.layer.placed(), cell, "max", axis))
        return {"cells": grey.count()}

    def do_history(self, op: str = "status", path: str | None = None) -> dict:
        layer = self.layer
        if op == "undo" and layer.at > 0:
            layer.at -= 1
        elif op == "redo" and layer.at < len(layer.versions) - 1:
            layer.at += 1
        elif op == "save":
            layer.cloud.write.mode("overwrite").parquet(path)
        elif op not in ("status", "undo", "redo"):
            raise ValueError(f"no history op {op!r}")
        return {"at": layer.at, "versions": len(layer.versions)}

    def do_cache(self, op: str, path: str, key: str | None = None) -> dict:
        """Clouds kept under the folder ``path``: write, read, list, has, drop; the key is the layer's name if none is given."""
        cache, key = files.Cache(self.spark, path), key or self.active
        if op == "write":
            cache.write(key, self.layer.placed())
        elif op == "read":
            self.add(key, cache.read(key))
        elif op == "list":
            return {"keys": cache.keys()}
        elif op == "has":
            return {"has": cache.has(key)}
        elif op == "drop":
            return {"dropped": cache.drop(key)}
        else:
            raise ValueError(f"no cache op {op!r}")
        return {"key": key}

    def do_script(self, steps: list[dict], stopOnError: bool = True) -> dict:
        """Up to STEPS commands; $last, $layers, $active and named replies go into later arguments by dotted path."""
        if len(steps) > STEPS:
            raise ValueError(f"a script has at most {STEPS} steps")
        replies = []
        for step in steps:
            if step["command"] == "script":
                raise ValueError("scripts don't nest")
            try:
                reply = self.run(step["command"], **self._filled(step.get("args", {})))
                replies.append(reply)
                if "as" in step:
                    self.values[step["as"]] = reply
            except Exception as e:
                replies.append({"error": str(e)})
                if stopOnError:
                    break
        return {"replies": replies}

    def _look(self, path: str) -> Any:
        first, *rest = path.split(".")
        value: Any = {"layers": list(self.layers), "active": self.active}.get(first, self.values.get(first))
        for key in rest:
            value = value[int(key)] if isinstance(value, list) else value[key]
        return value

    def _filled(self, value: Any) -> Any:
        if isinstance(value, dict):
            return {k: self._filled(v) for k, v in value.items()}
        if isinstance(value, list):
            return [self._filled(v) for v in value]
        if isinstance(value, str):
            if re.fullmatch(r"\$[\w.]+", value):
                return self._look(value[1:])
            return re.sub(r"\$\{([\w.]+)\}", lambda m: str(self._look(m[1])), value)
        return value


def _region(r: dict) -> RG.Region:
    known = {k: tuple(map(tuple, v)) if k == "polygon" else tuple(v) if isinstance(v, list) else v for k, v in r.items() if k in RG.Region.__dataclass_fields__}
    return RG.Region(**known)


def _kept(cloud: DataFrame, mask: DataFrame) -> DataFrame:
    return cloud.join(mask.where("keep = 1").select("gid"), "gid", "left_semi")
