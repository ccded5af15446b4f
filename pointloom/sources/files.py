"""Point and mesh files. Fixed-stride formats are read by record ranges, so one large file is many tasks; text formats go
through Spark's text reader; meshes, which are small, are parsed where the query is planned."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Records of a task.
RANGE = 1_000_000
#: PLY types, and names that mean the same.
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
#: What files call the fields of a point.
ALIASES = {"red": "r", "green": "g", "blue": "b", "diffuse_red": "r", "diffuse_green": "g", "diffuse_blue": "b", "scalar_intensity": "intensity", "reflectance": "intensity", "normal_x": "nx", "normal_y": "ny", "normal_z": "nz", "northing": "y", "easting": "x", "height": "z", "elevation": "z", "classification": "cls"}
#: Bytes of a LAS record by point format, and where its colours start.
LAS_BYTES, LAS_COLOUR = {0: 20, 1: 28, 2: 26, 3: 34, 6: 30, 7: 36, 8: 38}, {2: 20, 3: 28, 7: 30, 8: 30}


def _open(path: str):
    """Any store that Arrow knows by the path's scheme; plain paths are local."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_file(name)


def sniff(path: str) -> str | None:
    """e57, ply, las, laz, obj, stl, ptx or text: the first bytes, then the extension."""
    with _open(path) as f:
        head = f.read(128)
    if head.startswith(b"ASTM-E57"):
        return "e57"
    if head.startswith(b"ply"):
        return "ply"
    if head.startswith(b"LASF"):
        return "laz" if len(head) > 104 and head[104] & 0x80 else "las"
    end = path.rsplit(".", 1)[-1].lower()
    return {"obj": "obj", "stl": "stl", "ptx": "ptx", "xyz": "text", "txt": "text", "csv": "text", "asc": "text", "pts": "text"}.get(end)


def looks_like_mesh(path: str) -> str | None:
    """ply, obj or stl where the file holds faces; a PLY without any is a cloud."""
    kind = sniff(path)
    if kind != "ply":
        return kind if kind in ("obj", "stl") else None
    return "ply" if any(e["name"] == "face" and e["count"] > 0 for e in ply_header(path)["elements"]) else None


def cache_key(name: str, size: int, modified: int, stride: int = 1) -> str:
    """A short name for what a file was decoded to: FNV-1a over name, size, time and stride, then the length of that text."""
    text, h = f"{name}|{size}|{modified}|{stride}", 0x811C9DC5
    for c in text:
        h = ((h ^ ord(c)) * 0x01000193) & 0xFFFFFFFF
    return f"{h:08x}{len(text):x}"


def file_key(path: str, stride: int = 1) -> str:
    """The cache key of one file of any store that Arrow knows, by what the store says of it."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = store.get_file_info(name)
    return cache_key(info.base_name, info.size, (info.mtime_ns or 0) // 1_000_000, stride)


def shift_of(path: str) -> tuple[float, float, float]:
    """What a file's coordinates are counted from: the offsets of a LAS header, the origin for other formats."""
    return tuple(las_header(path)["shift"]) if sniff(path) == "las" else (0.0, 0.0, 0.0)


class Cache:
    """Decoded clouds as Parquet tables under one folder of any store that Spark knows, each by its key."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._store = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def write(self, key: str, cloud: DataFrame) -> None:
        cloud.write.mode("overwrite").parquet(f"{self.folder}/{key}")

    def read(self, key: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{key}")

    def has(self, key: str) -> bool:
        """Only what was written to its end counts."""
        return self._store.exists(self._path(f"{self.folder}/{key}/_SUCCESS"))

    def keys(self) -> list[str]:
        if not self._store.exists(self._path(self.folder)):
            return []
        return sorted(k for k in (s.getPath().getName() for s in self._store.listStatus(self._path(self.folder))) if self.has(k))

    def drop(self, key: str) -> bool:
        return self.has(key) and self._store.delete(self._path(f"{self.folder}/{key}"), True)


def _ranges(spark: SparkSession, n: int, read, schema: str) -> DataFrame:
    """``read(first, stop)`` as Arrow batches, over ranges of ``n`` records."""
    tasks = max(1, -(-n // RANGE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                for first in range(k * RANGE, min(n, (k + 1) * RANGE), 100_000):
                    yield read(first, min(first + 100_000, n, (k + 1) * RANGE))

    return spark.range(0, tasks, 1, tasks).mapInArrow(run, schema)


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(n, value): the lines of one file by number. Lines are counted in each split; only a row for each split is summed."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("_id"))
    lines = lines.select("value", F.shiftright("_id", 33).alias("_split"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    before = Window.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = lines.groupBy("_split").agg(F.count("*").alias("_n")).select(F.col("_split").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return lines.join(F.broadcast(starts), F.col("_split") == F.col("_s")).select((F.col("_before") + F.col("_at")).alias("n"), "value")


def ply_header(path: str) -> dict:
    """format, offset of the data, and for each element its name, count and properties."""
    with _open(path) as f:
        head = f.read(65_536)
    end = head.index(b"end_header") + len(b"end_header")
    end += 2 if head[end : end + 2] == b"\r\n" else 1
    out: dict = {"offset": end, "elements": []}
    for line in head[:end].decode("ascii", "replace").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            out["format"] = w[1]
        elif w[:1] == ["element"]:
            out["elements"].append({"name": w[1], "count": int(w[2]), "properties": []})
        elif w[:1] == ["property"]:
            out["elements"][-1]["properties"].append((w[-1].lower(), w[1:-1]))
    return out


def _dtype(properties: list, big: bool) -> np.dtype:
    return np.dtype([(ALIASES.get(n, n), (">" if big else "<") + PLY_TYPES[t[0]]) for n, t in properties])


def _cloud(record: np.ndarray, first: int) -> pa.RecordBatch:
    """gid and what a record has of a cloud's columns: colours of 0 to 1 become bytes, 16-bit intensity is scaled."""
    names, columns = ["gid"], [pa.array(np.arange(first, first + len(record)))]
    for n in [c for c in ("x", "y", "z", "nx", "ny", "nz", "r", "g", "b", "intensity", "cls") if c in record.dtype.names]:
        v, kind = record[n], record.dtype[n]
        if n in "rgb" and kind.kind == "f":
            v = np.clip(np.round(v * 255), 0, 255)
        if n == "intensity":
            v = np.round(v * (255 / 65535)) if kind.itemsize == 2 else np.clip(np.round(v * 255), 0, 255) if kind.kind == "f" else v
        names.append(n)
        columns.append(pa.array(v.astype(np.float64 if n in ("x", "y", "z", "nx", "ny", "nz") else np.int32)))
    return pa.RecordBatch.from_arrays(columns, names=names)


def _schema(names) -> str:
    return "gid long" + "".join(f", {n} {'double' if n in ('x', 'y', 'z', 'nx', 'ny', 'nz') else 'int'}" for n in ("x", "y", "z", "nx", "ny", "nz", "r", "g", "b", "intensity", "cls") if n in names)


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    head = ply_header(path)
    element = next(e for e in head["elements"] if e["name"] == "vertex")
    kind, n = _dtype(element["properties"], head["format"] == "binary_big_endian"), element["count"]
    if head["format"] == "ascii":
        lines = _numbered(spark, path)
        start = lines.where("value = 'end_header'").agg(F.min("n").alias("_start"))  # one row
        body = lines.join(F.broadcast(start)).select("value", (F.col("n") - F.col("_start") - 1).alias("gid")).where((F.col("gid") >= 0) & (F.col("gid") < n))
        parts = F.split(F.trim("value"), r"\s+")
        columns = []
        for k, name in enumerate(kind.names):
            v = parts[k].cast("double")
            if name in ("x", "y", "z", "nx", "ny", "nz"):
                columns.append(v.alias(name))
            elif name in ("r", "g", "b", "intensity", "cls"):
                columns.append(F.round(v * 255 if kind[name].kind == "f" else v).cast("int").alias(name))
        return body.select(F.col("gid").cast("long"), *columns)

    def read(first: int, stop: int) -> pa.RecordBatch:
        with _open(path) as f:
            f.seek(head["offset"] + first * kind.itemsize)
            return _cloud(np.frombuffer(f.read((stop - first) * kind.itemsize), kind), first)

    return _ranges(spark, n, read, _schema(kind.names))


def las_header(path: str) -> dict:
    with _open(path) as f:
        h = f.read(375)
    version, size, offset = h[25], *struct.unpack_from("<HI", h, 94)
    out = {"version": version, "offset": offset, "format": h[104] & 0x3F, "compressed": bool(h[104] & 0x80), "bytes": struct.unpack_from("<H", h, 105)[0], "count": struct.unpack_from("<I", h, 107)[0]}
    out["scale"], out["shift"] = struct.unpack_from("<3d", h, 131), struct.unpack_from("<3d", h, 155)
    hx, lx, hy, ly, hz, lz = struct.unpack_from("<6d", h, 179)
    out["min"], out["max"] = (lx, ly, lz), (hx, hy, hz)
    if version >= 4 and size >= 375:
        out["count"] = struct.unpack_from("<Q", h, 247)[0] or out["count"]
    return out


def read_las(spark: SparkSession, path: str, shift=(0.0, 0.0, 0.0)) -> DataFrame:
    """Coordinates less ``shift``; intensity to a byte by the first records' range, colours to bytes."""
    h = las_header(path)
    if h["compressed"]:
        raise ValueError("LAZ needs a codec that is not installed; decompress to LAS first")
    if h["format"] not in LAS_BYTES:
        raise ValueError(f"no LAS point format {h['format']}")
    fields = [("X", "<i4", 0), ("Y", "<i4", 4), ("Z", "<i4", 8), ("I", "<u2", 12), ("C", "u1", 16 if h["format"] >= 6 else 15)]
    at = LAS_COLOUR.get(h["format"])
    fields += [(c, "<u2", at + 2 * k) for k, c in enumerate("RGB")] if at else []
    kind = np.dtype({"names": [n for n, _, _ in fields], "formats": [t for _, t, _ in fields], "offsets": [o for _, _, o in fields], "itemsize": h["bytes"]})

    def records(first: int, stop: int) -> np.ndarray:
        with _open(path) as f:
            f.seek(h["offset"] + first * h["bytes"])
            return np.frombuffer(f.read((stop - first) * h["bytes"]), kind)

    head = records(0, min(h["count"], 100_000))
    bits = 8 if head["I"].max(initial=0) > 4095 else 4 if head["I"].max(initial=0) > 255 else 0
    deep = bool(at) and max(head[c].max(initial=0) for c in "RGB") > 255

    def read(first: int, stop: int) -> pa.RecordBatch:
        r = records(first, stop)
        columns = [np.arange(first, stop)] + [r[c] * s + o - m for c, s, o, m in zip("XYZ", h["scale"], h["shift"], shift, strict=True)]
        columns += [(r[c] >> 8 if deep else r[c]).astype(np.int32) for c in "RGB"] if at else []
        columns += [(r["I"] >> bits).astype(np.int32), (r["C"] if h["format"] >= 6 else r["C"] & 31).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gid", "x", "y", "z", *("rgb" if at else ""), "intensity", "cls"])

    return _ranges(spark, h["count"], read, "gid long, x double, y double, z double, " + ("r int, g int, b int, " if at else "") + "intensity int, cls int")


def guess_text(lines: list[str]) -> dict:
    """Separator, whether there is a header, and what each column is."""
    lines = [x for x in lines if x.strip() and not x.startswith(("#", "//"))]
    sep = max([",", ";", "\t", " "], key=lambda s: len(lines[0].split(s)))
    cut = lambda x: x.split() if sep == " " else [c.strip() for c in x.split(sep)]

    def number(c: str) -> bool:
        try:
            return math.isfinite(float(c))
        except ValueError:
            return False

    first = cut(lines[0])
    if not all(map(number, first)):
        return {"sep": sep, "header": True, "columns": [ALIASES.get(c.lower(), c.lower()) for c in first]}
    n = len(first)
    names = ["x", "y", "z", "intensity", "r", "g", "b"] if n >= 7 else ["x", "y", "z", "r", "g", "b"] if n == 6 else ["x", "y", "z", "intensity"][:n]
    return {"sep": sep, "header": False, "columns": names + [f"c{k}" for k in range(len(names), n)]}


def read_text(spark: SparkSession, path: str, layout: dict | None = None) -> DataFrame:
    """Lines of numbers. Comments, blanks and lines without finite coordinates go; ids rise in file order."""
    raw = spark.read.text(path).where("length(trim(value)) > 0 and not value like '#%' and not value like '//%'")
    layout = layout or guess_text([r.value for r in raw.limit(50).collect()])
    parts = F.split(F.trim("value"), r"\s+" if layout["sep"] == " " else r"\s*" + layout["sep"] + r"\s*")
    rows = raw.select(F.monotonically_increasing_id().alias("gid"), *[F.get(parts, F.lit(k)).try_cast("double").alias(n) for k, n in enumerate(layout["columns"])])
    rows = rows.where(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('infinity')" for c in "xyz"))
    if {"r", "g", "b"} <= set(layout["columns"]):
        first = rows.select("r", "g", "b").first()
        scale = 255.0 if first is not None and max(v or 0 for v in first) <= 1.001 else 1.0
        rows = rows.withColumns({c: F.least(F.greatest(F.round(F.col(c) * scale), F.lit(0)), F.lit(255)).cast("int") for c in "rgb"})
    if {"nx", "ny", "nz"} <= set(layout["columns"]):
        length = F.nullif(F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz")), F.lit(0.0))
        rows = rows.select(*[(F.col(c) / length).alias(c) if c in ("nx", "ny", "nz") else F.col(c) for c in rows.columns])
    if "intensity" in layout["columns"]:
        v = F.col("intensity")
        ends = rows.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
        lo, hi = ends["lo"] or 0.0, ends["hi"] or 0.0
        scaled = v / 257.0 if hi > 255 else v if hi > 1 else (v + 1) * 127.0 if lo < 0 else v * 255.0
        rows = rows.withColumn("intensity", F.least(F.greatest(F.round(scaled), F.lit(0)), F.lit(255)).cast("int"))
    return rows


def read_ptx(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cloud, stations): scans behind headers of ten lines, each through its own matrix. A line's scan follows from its
    number; headers are found by two passes over the file, however many there are."""
    lines = _numbered(spark, path)
    # A scan begins with its columns and its rows, the only lines of one number: two for each scan come to the driver.
    alone = {r.n: r.value.strip() for r in lines.where(F.trim("value").rlike(r"^\d+$")).collect()}
    counts, at = [], 0
    while at in alone and at + 1 in alone:
        counts.append((len(counts), at, int(alone[at]) * int(alone[at + 1])))
        at += 10 + counts[-1][2]
    wanted = spark.createDataFrame([(sid, start + k, k) for sid, start, _ in counts for k in range(10)], "sid int, _n long, k int")
    found = lines.join(F.broadcast(wanted), F.col("n") == F.col("_n")).orderBy("sid", "k").collect()
    text = {sid: [r.value for r in found if r.sid == sid] for sid, *_ in counts}
    heads = [(sid, start + 10, start + 10 + n, [float(v) for x in text[sid][6:] for v in x.split()], *[float(v) for v in text[sid][2].split()[:3]]) for sid, start, n in counts if len(text[sid]) == 10]
    scans = spark.createDataFrame(heads, "sid int, start long, stop long, m array<double>, sx double, sy double, sz double")
    rows = lines.join(F.broadcast(scans), (F.col("n") >= F.col("start")) & (F.col("n") < F.col("stop")))
    p = F.split(F.trim("value"), r"\s+")
    v = [p[k].cast("double") for k in range(3)]
    world = [v[0] * F.col("m")[k] + v[1] * F.col("m")[4 + k] + v[2] * F.col("m")[8 + k] + F.col("m")[12 + k] for k in range(3)]
    cloud = rows.where(~((v[0] == 0) & (v[1] == 0) & (v[2] == 0))).select(F.col("n").alias("gid"), *[w.alias(c) for w, c in zip(world, "xyz", strict=True)], F.round(p[3].cast("double") * 255).cast("int").alias("intensity"), *[F.get(p, F.lit(4 + k)).cast("int").alias(c) for k, c in enumerate("rgb")])
    return cloud, scans.select("sid", F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("sz").alias("z"))


def read_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, triangles) of a PLY, OBJ or STL; polygons become fans, STL corners are welded, faces with bad corners go."""
    with _open(path) as f:
        raw = f.read()
    kind = sniff(path)
    if kind == "obj":
        points, faces = [], []
        for line in raw.decode("utf-8", "replace").splitlines():
            w = line.split()
            if w[:1] == ["v"]:
                points.append([float(x) for x in w[1:4]])
            elif w[:1] == ["f"]:
                ids = [int(x.split("/")[0]) for x in w[1:]]
                faces.append([i - 1 if i > 0 else len(points) + i for i in ids])
    elif kind == "ply":
        head = ply_header(path)
        points, faces, body = [], [], raw[head["offset"] :]
        words, at = (body.split(), 0) if head["format"] == "ascii" else (None, 0)
        order = ">" if head["format"] == "binary_big_endian" else "<"
        for e in head["elements"]:
            for _ in range(e["count"]):
                row = {}
                for name, t in e["properties"]:
                    if t[0] == "list":
                        if words is not None:
                            n, at = int(words[at]), at + 1
                            row[name], at = [int(float(x)) for x in words[at : at + n]], at + n
                        else:
                            size = np.dtype(PLY_TYPES[t[1]])
                            n = int(np.frombuffer(body, order + PLY_TYPES[t[1]], 1, at)[0])
                            at += size.itemsize
                            item = np.dtype(order + PLY_TYPES[t[2]])
                            row[name] = np.frombuffer(body, item, n, at).tolist()
                            at += n * item.itemsize
                    elif words is not None:
                        row[name], at = float(words[at]), at + 1
                    else:
                        item = np.dtype(order + PLY_TYPES[t[0]])
                        row[name] = float(np.frombuffer(body, item, 1, at)[0])
                        at += item.itemsize
                if e["name"] == "vertex":
                    points.append([row["x"], row["y"], row["z"]])
                elif e["name"] == "face":
                    faces.append(row.get("vertex_indices", row.get("vertex_index", [])))
    else:
        if raw[:5] == b"solid" and b"facet" in raw[:400]:
            corners = np.array([[float(x) for x in line.split()[1:4]] for line in raw.decode("ascii", "replace").splitlines() if line.split()[:1] == ["vertex"]])
        else:
            n = struct.unpack_from("<I", raw, 80)[0]
            records = np.frombuffer(raw, np.dtype([("v", "<f4", (4, 3)), ("a", "<u2")]), n, 84)
            corners = records["v"][:, 1:].reshape(-1, 3).astype(float)
        step = max(float(np.ptp(corners, axis=0).max()) * 1e-7, 1e-300)
        _, first, back = np.unique(np.round(corners / step), axis=0, return_index=True, return_inverse=True)
        rank = np.argsort(np.argsort(first))
        points, faces = corners[np.sort(first)].tolist(), rank[back.ravel()].reshape(-1, 3).tolist()
    triangles = [(f[0], f[k], f[k + 1]) for f in faces for k in range(1, len(f) - 1) if all(0 <= i < len(points) for i in f)]
    v = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(points)], "vid long, x double, y double, z double")
    return v, spark.createDataFrame([(k, *map(int, t)) for k, t in enumerate(triangles)], "tid long, a long, b long, c long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """A cloud by what the file is; folders and Parquet go to Spark's own reader."""
    if path.rstrip("/").endswith((".parquet", ".cloud")):
        return spark.read.parquet(path)
    kind = sniff(path)
    if kind == "ply":
        return read_ply(spark, path)
    if kind == "las":
        return read_las(spark, path)
    if kind == "e57":
        from pointloom.sources.e57 import read_e57

        return read_e57(spark, path)
    if kind == "ptx":
        return read_ptx(spark, path)[0]
    if kind == "text":
        return read_text(spark, path)
    raise ValueError(f"{path}: {kind or 'unknown format'} can't be read as a cloud")


def write_text(cloud: DataFrame, path: str, sep: str = " ") -> None:
    """One file for each task, in any order."""
    cloud.select(F.concat_ws(sep, *[F.col(c).cast("string") for c in cloud.columns if c != "gid"]).alias("value")).write.text(path)


def write_ply(cloud: DataFrame, path: str) -> None:
    """A single local binary file, streamed task by task: coordinates double, colours uchar, intensity of 0 to 1 and normals float."""
    has = lambda *c: set(c) <= set(cloud.columns)
    kind = [(c, "<f8", "double") for c in "xyz"] + ([(f"n{c}", "<f4", "float") for c in "xyz"] if has("nx", "ny", "nz") else [])
    kind += ([(c, "u1", "uchar") for c in ("r", "g", "b")] if has("r", "g", "b") else []) + ([("intensity", "<f4", "float")] if has("intensity") else [])
    names = {"r": "red", "g": "green", "b": "blue"}
    ordered = cloud.orderBy("gid").select(*[(F.coalesce(F.col(n), F.lit(128)) / 255.0 if n == "intensity" else F.coalesce(F.col(n), F.lit(180 if n in "rgb" else 0))).alias(n) for n, _, _ in kind])
    n = cloud.count()
    with open(path, "wb") as f:
        f.write(("ply\nformat binary_little_endian 1.0\n" + f"element vertex {n}\n" + "".join(f"property {t} {names.get(c, c)}\n" for c, _, t in kind) + "end_header\n").encode())
        for pdf in _batches(ordered):
            f.write(np.rec.fromarrays([pdf[c].to_numpy() for c, _, _ in kind], dtype=np.dtype([(c, t) for c, t, _ in kind])).tobytes())


def _batches(df: DataFrame, size: int = 100_000):
    import pandas as pd

    held: list = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(tuple(row))
        if len(held) == size:
            yield pd.DataFrame(held, columns=df.columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=df.columns)


def write_las(cloud: DataFrame, path: str, scale: float = 0.001) -> None:
    """A single local LAS 1.2 file, point format 2; intensity to 16 bits, colours to the high byte."""
    ends = cloud.agg(F.count("*").alias("n"), *[f(c).alias(f"{c}{k}") for c in "xyz" for f, k in ((F.min, "lo"), (F.max, "hi"))]).first()
    low, high = ([float(ends[f"{c}{k}"] or 0) for c in "xyz"] for k in ("lo", "hi"))
    head = bytearray(227)
    head[0:4], head[24], head[25], head[104] = b"LASF", 1, 2, 2
    struct.pack_into("<HI", head, 94, 227, 227)
    struct.pack_into("<HI", head, 105, 26, ends["n"])
    struct.pack_into("<3d", head, 131, scale, scale, scale)
    struct.pack_into("<3d", head, 155, *low)
    struct.pack_into("<6d", head, 179, *[v for pair in zip(high, low, strict=True) for v in pair])
    kind = np.dtype({"names": ["X", "Y", "Z", "I", "R", "G", "B"], "formats": ["<i4"] * 3 + ["<u2"] * 4, "offsets": [0, 4, 8, 12, 20, 22, 24], "itemsize": 26})
    colour = [F.coalesce(F.col(c), F.lit(180)).alias(c) if c in cloud.columns else F.lit(180).alias(c) for c in "rgb"]
    shine = F.coalesce(F.col("intensity"), F.lit(128)).alias("i") if "intensity" in cloud.columns else F.lit(128).alias("i")
    with open(path, "wb") as f:
        f.write(head)
        for pdf in _batches(cloud.orderBy("gid").select("x", "y", "z", shine, *colour)):
            out = np.zeros(len(pdf), kind)
            for c, o in zip("xyz", low, strict=True):
                out[c.upper()] = np.round((pdf[c].to_numpy() - o) / scale)
            out["I"] = pdf["i"].to_numpy() * 257
            for c in "rgb":
                out[c.upper()] = pdf[c].to_numpy() * 257
            f.write(out.tobytes())


def write_mesh(vertices: DataFrame, triangles: DataFrame, path: str) -> None:
    """OBJ, STL or ASCII PLY by extension. A mesh is collected: it is a product to look at, not a table that grows."""
    points = {r.vid: (r.x, r.y, r.z) for r in vertices.select("vid", "x", "y", "z").collect()}
    faces = [(r.a, r.b, r.c) for r in triangles.orderBy("tid").collect()]
    place = {v: k for k, v in enumerate(sorted(points))}
    kind = path.rsplit(".", 1)[-1].lower()
    with open(path, "wb") as f:
        if kind == "stl":
            f.write(b"\0" * 80 + struct.pack("<I", len(faces)))
            for t in faces:
                p = np.array([points[v] for v in t])
                n = np.cross(p[1] - p[0], p[2] - p[0])
                f.write(np.concatenate([n / (np.linalg.norm(n) or 1), p.ravel()]).astype("<f4").tobytes() + b"\0\0")
        elif kind == "obj":
            f.write("".join(f"v {x!r} {y!r} {z!r}\n" for x, y, z in (points[v] for v in sorted(points))).encode())
            f.write("".join("f " + " ".join(str(place[v] + 1) for v in t) + "\n" for t in faces).encode())
        else:
            f.write(f"ply\nformat ascii 1.0\nelement vertex {len(points)}\nproperty double x\nproperty double y\nproperty double z\nelement face {len(faces)}\nproperty list uchar int vertex_indices\nend_header\n".encode())
            f.write("".join(f"{x!r} {y!r} {z!r}\n" for x, y, z in (points[v] for v in sorted(points))).encode())
            f.write("".join("3 " + " ".join(str(place[v]) for v in t) + "\n" for t in faces).encode())


def contours_geojson(lines: DataFrame) -> DataFrame:
    """(value): a GeoJSON feature for each stitched contour line."""
    at = F.transform("points", lambda p: F.array(F.round(p["x"], 4), F.round(p["y"], 4)))
    return lines.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.col("level").alias("elevation")).alias("properties"), F.struct(F.lit("LineString").alias("type"), at.alias("coordinates")).alias("geometry"))).alias("value"))


def contours_dxf(lines: DataFrame) -> str:
    """LWPOLYLINE entities with their elevation in code 38."""
    out = ["0", "SECTION", "2", "ENTITIES"]
    for r in lines.orderBy("level", "line").toLocalIterator():
        out += ["0", "LWPOLYLINE", "8", "contours", "90", str(len(r.points)), "70", str(int(r.closed)), "38", f"{r.level:.4f}"]
        for p in r.points:
            out += ["10", f"{p.x:.4f}", "20", f"{p.y:.4f}"]
    return "\n".join([*out, "0", "ENDSEC", "0", "EOF", ""])


def raster_png(grey: DataFrame, path: str, cell: float, low: tuple[float, float]) -> None:
    """An 8-bit PNG, top row first, 0 where there is no data, with its world file."""
    import zlib

    rows = grey.toPandas()
    w, h = int(rows.u.max() - rows.u.min()) + 1, int(rows.v.max() - rows.v.min()) + 1
    image = np.zeros((h, w), np.uint8)
    image[int(rows.v.max()) - rows.v, rows.u - int(rows.u.min())] = rows.grey
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r.tobytes() for r in image))) + chunk(b"IEND", b""))
    with open(path.rsplit(".", 1)[0] + ".pgw", "w") as f:
        f.write("\n".join(map(repr, [cell, 0.0, 0.0, -cell, low[0] + (rows.u.min() + 0.5) * cell, low[1] + (rows.v.max() + 0.5) * cell])) + "\n")
