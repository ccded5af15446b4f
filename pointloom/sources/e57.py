"""E57 scans: 1024-byte pages with a checksum at the end of each, an XML tree, and binary sections of packets in which
each field is a stream of floats or of whole numbers in as few bits as their limits need. A scan is as many tasks as its
records fill ranges: packet heads alone say where in each stream a range begins."""

from __future__ import annotations

import struct
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions.matrix import quaternion
from pointloom.sources.files import _open

#: A page, what of it is data, and the names of fields.
PAGE, DATA = 1024, 1020
NAMES = {"cartesianX": "x", "cartesianY": "y", "cartesianZ": "z", "sphericalRange": "range", "sphericalAzimuth": "azimuth", "sphericalElevation": "elevation", "intensity": "intensity", "colorRed": "r", "colorGreen": "g", "colorBlue": "b", "nor:normalX": "nx", "nor:normalY": "ny", "nor:normalZ": "nz", "cartesianInvalidState": "invalid", "sphericalInvalidState": "invalid"}
BATCH = 200_000
#: Records of a range, and the most tasks that ranges are dealt to.
RANGE, MOST_TASKS = 2_000_000, 20_000


class _Pages:
    """The file without its checksums, by physical place."""

    def __init__(self, path: str) -> None:
        self.file = _open(path)

    def read(self, physical: int, length: int) -> bytes:
        first, skip = physical // PAGE, physical % PAGE
        pages = (skip + length) // DATA + 2
        self.file.seek(first * PAGE)
        raw = np.frombuffer(self.file.read(pages * PAGE), np.uint8)
        whole = raw[: len(raw) // PAGE * PAGE].reshape(-1, PAGE)[:, :DATA].tobytes()
        return whole[skip : skip + length]

    @staticmethod
    def after(physical: int, length: int) -> int:
        logical = physical // PAGE * DATA + physical % PAGE + length
        return logical // DATA * PAGE + logical % DATA


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _child(node, name: str):
    return next((c for c in node if _local(c.tag) == name), None) if node is not None else None


def _number(node, name: str, default: float = 0.0) -> float:
    found = _child(node, name)
    return float(found.text) if found is not None and found.text else default


def _tree(path: str, pages: _Pages) -> ET.Element:
    head = pages.read(0, 48)
    if head[:8] != b"ASTM-E57":
        raise ValueError(f"{path} is no E57 file")
    at, length = struct.unpack_from("<QQ", head, 24)
    return ET.fromstring(pages.read(at, length).rstrip(b"\0"))


def _pose(node) -> tuple[list[float], list[float]]:
    """(rotation as w, x, y, z; translation) of a scan or an image."""
    turn, move = _child(_child(node, "pose"), "rotation"), _child(_child(node, "pose"), "translation")
    return [_number(turn, c, float(c == "w")) for c in "wxyz"], [_number(move, c) for c in "xyz"]


def _text(node, name: str) -> str | None:
    found = _child(node, name)
    return found.text if found is not None else None


def scans(path: str) -> list[dict]:
    """What the XML says of each scan: name, count, place, fields, pose, limits and declared bounds."""
    root, out = _tree(path, _Pages(path)), []
    for scan in _child(root, "data3D") if _child(root, "data3D") is not None else []:
        points = _child(scan, "points")
        if points is None:
            continue
        fields: list[dict] = []
        for f in _child(points, "prototype"):
            name = _local(f.tag)
            name = f"nor:{name}" if name.startswith("normal") else name
            kind, a = f.get("type"), f.attrib
            low, high = int(a.get("minimum", -(2**63))), int(a.get("maximum", 2**63 - 1))
            fields.append({"name": NAMES.get(name, name), "kind": kind, "double": a.get("precision", "double") == "double", "low": low, "high": high, "scale": float(a.get("scale", 1)), "offset": float(a.get("offset", 0))})
        (rotation, translation), limits = _pose(scan), {}
        for group, pairs in (("intensityLimits", [("intensity", "intensityMinimum", "intensityMaximum")]), ("colorLimits", [("r", "colorRedMinimum", "colorRedMaximum"), ("g", "colorGreenMinimum", "colorGreenMaximum"), ("b", "colorBlueMinimum", "colorBlueMaximum")])):
            for field, lo, hi in pairs if _child(scan, group) is not None else []:
                limits[field] = (_number(_child(scan, group), lo), _number(_child(scan, group), hi))
        box = _child(scan, "cartesianBounds")
        ends = [[_text(box, f"{c}{e}") for c in "xyz"] for e in ("Minimum", "Maximum")] if box is not None else [[None]]
        bounds = [[float(v) for v in end] for end in ends] if all(v is not None for end in ends for v in end) else None
        out.append({"name": _text(scan, "name"), "count": int(points.get("recordCount")), "at": int(points.get("fileOffset")), "fields": fields, "limits": limits, "rotation": rotation, "translation": translation,
                    "bounds": bounds, "vendor": _text(scan, "sensorVendor"), "model": _text(scan, "sensorModel")})
    return out


def declared_bounds(scan: dict) -> list[float] | None:
    """The upright box around a scan's declared one, turned by its pose: low corner, then high; None where none is declared."""
    if not scan["bounds"]:
        return None
    corners = np.array(np.meshgrid(*zip(*scan["bounds"], strict=True))).reshape(3, -1).T @ quaternion(*scan["rotation"]).T
    return [*corners.min(axis=0).tolist(), *corners.max(axis=0).tolist()]


META = "scan int, name string, points long, bounds array<double>, translation array<double>, sensor_vendor string, sensor_model string, has_color boolean, has_intensity boolean, has_normals boolean, cartesian boolean, spherical boolean, fields int"


def meta(spark: SparkSession, path: str) -> DataFrame:
    """A row for each scan, from the file's XML alone."""
    rows = []
    for k, s in enumerate(scans(path)):
        has = {f["name"] for f in s["fields"]}
        rows.append((k, s["name"], s["count"], declared_bounds(s), [float(v) for v in s["translation"]], s["vendor"], s["model"], "r" in has, "intensity" in has, "nx" in has, "x" in has, "range" in has, len(s["fields"])))
    return spark.createDataFrame(rows, META)


#: The ways an image may be given.
VIEWS = ("sphericalRepresentation", "pinholeRepresentation", "cylindricalRepresentation", "visualReferenceRepresentation")
#: Bytes before the data of a binary section that holds an image.
BLOB_HEAD = 16


def images(spark: SparkSession, path: str, with_bytes: bool = False) -> DataFrame:
    """(image, name, view, w, h, t, q, size, at), a row for each image with a picture, and its JPEG or PNG bytes if asked
    for: those are read where the rows are, image by image."""
    rows, listed = [], _child(_tree(path, _Pages(path)), "images2D")
    for k, image in enumerate(listed if listed is not None else []):
        for view in VIEWS:
            form = _child(image, view)
            blob = next((b for b in (_child(form, n) for n in ("jpegImage", "pngImage")) if b is not None), None)
            if blob is not None:
                q, t = _pose(image)
                rows.append((k, _text(image, "name"), view.removesuffix("Representation"), int(_number(form, "imageWidth")), int(_number(form, "imageHeight")), t, q, int(blob.get("length")), int(blob.get("fileOffset"))))
                break
    schema = "image int, name string, view string, w int, h int, t array<double>, q array<double>, size long, at long"
    table = spark.createDataFrame(rows, schema)
    if not with_bytes:
        return table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages = _Pages(path)
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                data = pages.read(pages.after(one.column(8)[0].as_py(), BLOB_HEAD), one.column(7)[0].as_py())
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([data], pa.binary())], names=[*one.schema.names, "bytes"])

    return table.repartition(max(1, len(rows))).mapInArrow(run, schema + ", bytes binary")


def _bits(field: dict) -> int:
    if field["kind"] == "Float":
        return 64 if field["double"] else 32
    return (field["high"] - field["low"]).bit_length()


def _decode(field: dict, raw: bytes, skip: int, n: int) -> np.ndarray:
    """``n`` values of a stream, ``skip`` bits into ``raw``."""
    bits = _bits(field)
    if field["kind"] == "Float":
        return np.frombuffer(raw, "<f8" if field["double"] else "<f4", n, skip // 8).astype(float)
    if bits == 0:
        value = np.zeros(n)
    else:
        flat = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little", count=skip + bits * n)[skip:].reshape(n, bits)
        value = np.zeros(n, np.uint64)
        for k in range(bits):
            value |= flat[:, k].astype(np.uint64) << np.uint64(k)
        value = value.astype(float)
    value = value + field["low"]
    return value * field["scale"] + field["offset"] if field["kind"] == "ScaledInteger" else value


def _first_packet(pages: _Pages, scan: dict) -> int:
    return struct.unpack_from("<Q", pages.read(scan["at"], 32), 16)[0]


def _streams(packet: bytes, scan: dict) -> tuple[int, ...]:
    """Bytes that a data packet, of which the head is there, holds of each field's stream."""
    streams = struct.unpack_from("<H", packet, 4)[0]
    if streams != len(scan["fields"]):
        raise ValueError(f"a packet has {streams} streams, the scan {len(scan['fields'])} fields")
    return struct.unpack_from(f"<{streams}H", packet, 6)


def _ranges(path: str, scan: dict, size: int) -> Iterator[tuple[int, int, list[int]]]:
    """(first record, packet, bytes of each stream before that packet) of every range of ``size`` records: the first packet
    that holds any of the range's bits, as streams needn't keep step. Only heads are read."""
    pages, bits = _Pages(path), [_bits(f) for f in scan["fields"]]
    at, before, starts = _first_packet(pages, scan), [0] * len(bits), list(range(0, scan["count"], size))
    if len(starts) < 2 or not any(bits):
        yield from [(0, at, before)] * bool(starts)
        return
    while starts:
        head = pages.read(at, 6 + 2 * len(bits))
        kind, _, length = struct.unpack_from("<BBH", head)
        if kind == 1:
            after = [n + more for n, more in zip(before, _streams(head, scan), strict=True)]
            while starts and any(b and end > starts[0] * b // 8 for b, end in zip(bits, after, strict=True)):
                yield starts.pop(0), at, before
            before = after
        at = pages.after(at, length + 1)


def _records(path: str, scan: dict, first: int = 0, count: int | None = None, packet: int | None = None, before: list[int] | None = None) -> Iterator[dict[str, np.ndarray]]:
    """Batches of ``count`` records' decoded fields from the ``first``, read from a packet with so many bytes of each stream
    before it. Streams run on from packet to packet, so what is left over is kept."""
    pages, fields = _Pages(path), scan["fields"]
    at, bits = _first_packet(pages, scan) if packet is None else packet, [_bits(f) for f in fields]
    left = scan["count"] - first if count is None else count
    skips = [first * b - 8 * n for b, n in zip(bits, before or [0] * len(fields), strict=True)]
    held = [b""] * len(fields)
    if not any(bits):  # every field is a constant
        while left > 0:
            yield {f["name"]: _decode(f, b"", 0, min(BATCH, left)) for f in fields}
            left -= min(BATCH, left)
    while left > 0:
        kind, _, length = struct.unpack("<BBH", pages.read(at, 4))
        data = pages.read(at, length + 1)
        at = pages.after(at, length + 1)
        if kind != 1:
            continue
        sizes, place = _streams(data, scan), 6 + 2 * len(fields)
        for k, size in enumerate(sizes):
            held[k] += data[place : place + size]
            place += size
            gone = min(skips[k] // 8, len(held[k])) if bits[k] else 0
            held[k], skips[k] = held[k][gone:], skips[k] - 8 * gone
        ready = min([left, *[(len(h) * 8 - s) // b for h, s, b in zip(held, skips, bits, strict=True) if b]])
        if ready >= min(BATCH, left) or (ready > 0 and ready == left):
            yield {f["name"]: _decode(f, h, s, ready) for f, h, s in zip(fields, held, skips, strict=True)}
            for k, b in enumerate(bits):
                used = skips[k] + b * ready
                held[k], skips[k] = held[k][used // 8 :], used % 8
            left -= ready


def _byte(v: np.ndarray, field: str, scan: dict) -> np.ndarray:
    own = next(f for f in scan["fields"] if f["name"] == field)
    lo, hi = scan["limits"].get(field, (own["low"] * own["scale"] + own["offset"], own["high"] * own["scale"] + own["offset"]) if own["kind"] != "Float" else (0.0, 1.0))
    return np.clip(np.round((v - lo) / ((hi - lo) or 1) * 255), 0, 255).astype(np.int32)


SCHEMA = "gid long, x double, y double, z double, r int, g int, b int, intensity int, nx double, ny double, nz double, scan int"


def read_e57(spark: SparkSession, path: str, stride: int = 1, size: int = RANGE) -> DataFrame:
    """All scans in the file's frame, or one record in ``stride`` of each. Invalid and non-finite points go; ids count records over all scans; colours and
    intensity are bytes by their limits; what a scan lacks is null. A task reads ``size`` records of a scan; a scan of more
    has its packet heads walked by a task beforehand."""
    found = scans(path)
    starts = np.concatenate([[0], np.cumsum([s["count"] for s in found])]).tolist()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                for first, packet, before in _ranges(path, found[k], size):
                    yield pa.RecordBatch.from_pylist([{"scan": k, "first": first, "packet": packet, "before": before}])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.to_pylist():
                k, at = task["scan"], task["first"]
                scan = found[k]
                turn, move = quaternion(*scan["rotation"]), np.array(scan["translation"])
                for f in _records(path, scan, at, min(size, scan["count"] - at), task["packet"], task["before"]):
                    n = len(next(iter(f.values())))
                    if "range" in f:
                        flat = f["range"] * np.cos(f["elevation"])
                        p = np.column_stack([flat * np.cos(f["azimuth"]), flat * np.sin(f["azimuth"]), f["range"] * np.sin(f["elevation"])])
                    else:
                        p = np.column_stack([f["x"], f["y"], f["z"]])
                    ok = np.isfinite(p).all(1) & (f.get("invalid", np.zeros(n)) == 0) & ((at + np.arange(n)) % stride == 0)
                    p, ids, none = p[ok] @ turn.T + move, starts[k] + at + np.flatnonzero(ok), pa.nulls(int(ok.sum()))
                    columns = [pa.array(ids), *[pa.array(p[:, c]) for c in range(3)]]
                    columns += [pa.array(_byte(f[c][ok], c, scan)) if c in f else none.cast(pa.int32()) for c in ("r", "g", "b", "intensity")]
                    turned = np.column_stack([f[f"n{c}"][ok] for c in "xyz"]) @ turn.T if "nx" in f else None
                    columns += [pa.array(turned[:, c]) if turned is not None else none.cast(pa.float64()) for c in range(3)]
                    at += n
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(ids), k, np.int32))], names=[c.split()[0] for c in SCHEMA.split(", ")])

    tasks = spark.range(0, len(found), 1, max(1, len(found))).mapInArrow(walk, "scan long, first long, packet long, before array<long>")
    number = sum(-(-s["count"] // size) for s in found)
    if number > len(found):  # a long scan: its ranges are dealt to tasks of their own
        tasks = tasks.repartition(min(number, MOST_TASKS))
    return tasks.mapInArrow(run, SCHEMA)


def stations(spark: SparkSession, path: str) -> DataFrame:
    rows = [(k, *map(float, s["translation"]), *map(float, s["rotation"]), s["name"]) for k, s in enumerate(scans(path))]
    return spark.createDataFrame(rows, "sid int, x double, y double, z double, qw double, qx double, qy double, qz double, name string")


def _crc32c(pages: np.ndarray) -> np.ndarray:
    """Castagnoli's checksum of each row."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0x82F63B78), table >> 1)
    crc = np.full(len(pages), 0xFFFFFFFF, np.uint32)
    for k in range(pages.shape[1]):
        crc = table[(crc ^ pages[:, k]) & 255] ^ (crc >> 8)
    return crc ^ np.uint32(0xFFFFFFFF)


def write_e57(cloud: DataFrame, path: str, name: str = "scan") -> None:
    """One scan in one local file: coordinates double, normals float, colours a byte, intensity a float of 0 to 1.

    Rows come task by task and pages are written as they fill; only the first page, whose places are known last, is
    written again at the end. Null colours, intensities and normals take 180, a half and zero."""
    from pointloom.sources.files import _batches

    has = lambda *c: set(c) <= set(cloud.columns)
    double, single, byte = 'type="Float"', 'type="Float" precision="single"', 'type="Integer" minimum="0" maximum="255"'
    fields = [(c, f"cartesian{c.upper()}", "<f8", double) for c in "xyz"]
    fields += [(f"n{c}", f"nor:normal{c.upper()}", "<f4", single) for c in "xyz"] if has("nx", "ny", "nz") else []
    fields += [(c, f"color{n}", "u1", byte) for c, n in (("r", "Red"), ("g", "Green"), ("b", "Blue"))] if has("r", "g", "b") else []
    fields += [("intensity", "intensity", "<f4", single)] if has("intensity") else []
    value = {"r": F.coalesce("r", F.lit(180)), "g": F.coalesce("g", F.lit(180)), "b": F.coalesce("b", F.lit(180)), "intensity": F.coalesce(F.col("intensity"), F.lit(128)) / 255.0} if len(fields) > 3 else {}
    value |= {f"n{c}": F.coalesce(F.col(f"n{c}"), F.lit(0.0)) for c in "xyz"}
    rows = cloud.orderBy("gid").select(*[value.get(c, F.col(c)).alias(c) for c, *_ in fields])
    physical = lambda logical: logical // DATA * PAGE + logical % DATA
    with open(path, "wb") as f:
        held, done, n, step = bytearray(b"\0" * 80), 0, 0, 60_000 // sum(np.dtype(k).itemsize for _, _, k, _ in fields)

        def flush(every: bool = False) -> None:
            nonlocal held, done
            if every:
                held += b"\0" * (-len(held) % DATA)
            whole = len(held) // DATA * DATA
            pages = np.frombuffer(bytes(held[:whole]), np.uint8).reshape(-1, DATA)
            f.write(np.hstack([pages, _crc32c(pages).astype(">u4").view(np.uint8).reshape(-1, 4)]).tobytes())
            held, done = held[whole:], done + whole

        for pdf in _batches(rows):
            for at in range(0, len(pdf), step):
                part = [pdf[c].to_numpy()[at : at + step].astype(k).tobytes() for c, _, k, _ in fields]
                packet = struct.pack(f"<H{len(part)}H", len(part), *map(len, part)) + b"".join(part)
                packet += b"\0" * (-(len(packet) + 4) % 4)
                held += struct.pack("<BBH", 1, 0, len(packet) + 3) + packet
                if len(held) > 4 << 20:
                    flush()
            n += len(pdf)
        section = done + len(held) - 48
        xml = '<?xml version="1.0" encoding="UTF-8"?>\n<e57Root type="Structure" xmlns="http://www.astm.org/COMMIT/E57/2010-e57-v1.0" xmlns:nor="http://www.libe57.org/E57_NOR_surface_normals.txt"><formatName type="String">ASTM E57 3D Imaging Data File</formatName><versionMajor type="Integer">1</versionMajor><versionMinor type="Integer">0</versionMinor>'
        xml += f'<data3D type="Vector" allowHeterogeneousChildren="1"><vectorChild type="Structure"><name type="String">{escape(name)}</name>'
        xml += '<intensityLimits type="Structure"><intensityMinimum type="Float">0</intensityMinimum><intensityMaximum type="Float">1</intensityMaximum></intensityLimits>' if has("intensity") else ""
        xml += f'<points type="CompressedVector" fileOffset="{physical(48)}" recordCount="{n}"><prototype type="Structure">'
        xml += "".join(f"<{tag} {t}/>" for _, tag, _, t in fields) + '</prototype><codecs type="Vector" allowHeterogeneousChildren="1"/></points></vectorChild></data3D></e57Root>'
        text, start = xml.encode(), done + len(held)
        held += text
        flush(every=True)
        end = done
    # The head of the file and of its section share the first page.
    with open(path, "r+b") as f:
        first = bytearray(f.read(DATA))
        struct.pack_into("<8sIIQQQQ", first, 0, b"ASTM-E57", 1, 0, end // DATA * PAGE, physical(start), len(text), PAGE)
        struct.pack_into("<B7xQQQ", first, 48, 1, section, physical(80), 0)
        f.seek(0)
        f.write(bytes(first) + _crc32c(np.frombuffer(bytes(first), np.uint8)[None]).astype(">u4").tobytes())
