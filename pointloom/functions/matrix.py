"""Row-major 4x4 transforms: built with numpy where the query is planned, applied as column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = {"x": (1.0, 0.0, 0.0), "y": (0.0, 1.0, 0.0), "z": (0.0, 0.0, 1.0)}


def identity() -> np.ndarray:
    return np.eye(4)


def translation(x: float, y: float, z: float) -> np.ndarray:
    m = np.eye(4)
    m[:3, 3] = x, y, z
    return m


def rotation(axis, degrees: float, about=(0.0, 0.0, 0.0)) -> np.ndarray:
    """Turns by ``degrees`` round ``axis`` (a name or a vector) through ``about``."""
    k = np.asarray(AXES.get(axis, axis) if isinstance(axis, str) else axis, float)
    k = k / np.linalg.norm(k)
    cross, angle = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]]), math.radians(degrees)
    turn = np.eye(3) + math.sin(angle) * cross + (1 - math.cos(angle)) * cross @ cross
    return _about(turn, about)


def scaling(factor: float, about=(0.0, 0.0, 0.0)) -> np.ndarray:
    return _about(np.eye(3) * factor, about)


def _about(linear: np.ndarray, centre) -> np.ndarray:
    m, c = np.eye(4), np.asarray(centre, float)
    m[:3, :3], m[:3, 3] = linear, c - linear @ c
    return m


def quaternion(w: float, x: float, y: float, z: float) -> np.ndarray:
    """The rotation matrix of a quaternion, normalised first."""
    n = math.sqrt(w * w + x * x + y * y + z * z) or 1.0
    w, v = w / n, np.array([x, y, z]) / n
    cross = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    return (w * w - v @ v) * np.eye(3) + 2 * np.outer(v, v) + 2 * w * cross


def decompose(m: np.ndarray) -> dict:
    """Translation, scale, and the rotation as axis and degrees."""
    scale = float(np.cbrt(np.linalg.det(m[:3, :3])))
    r = m[:3, :3] / scale
    cosine = min(1.0, max(-1.0, (np.trace(r) - 1) / 2))
    v = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]])
    n = np.linalg.norm(v)
    return {"translation": m[:3, 3].tolist(), "scale": scale, "degrees": math.degrees(math.acos(cosine)), "axis": (v / n).tolist() if n > 1e-12 else [0.0, 0.0, 1.0]}


def applied(m: np.ndarray, x: Column, y: Column, z: Column) -> list[Column]:
    """The transformed coordinates as expressions over literals."""
    return [x * float(r[0]) + y * float(r[1]) + z * float(r[2]) + float(r[3]) for r in m[:3]]


def transform(cloud: DataFrame, m: np.ndarray) -> DataFrame:
    """Points through ``m``; normals, where there are any, through its rotation and back to length one."""
    new = dict(zip("xyz", applied(m, F.col("x"), F.col("y"), F.col("z")), strict=True))
    if {"nx", "ny", "nz"} <= set(cloud.columns):
        turned = [F.col("nx") * float(r[0]) + F.col("ny") * float(r[1]) + F.col("nz") * float(r[2]) for r in m[:3, :3]]
        length = F.sqrt(sum((t * t for t in turned[1:]), turned[0] * turned[0]))
        new |= {f"n{c}": t / F.nullif(length, F.lit(0.0)) for c, t in zip("xyz", turned, strict=True)}
    return cloud.withColumns(new)


def spherical(r: Column, azimuth: Column, elevation: Column) -> list[Column]:
    return [r * F.cos(elevation) * F.cos(azimuth), r * F.cos(elevation) * F.sin(azimuth), r * F.sin(elevation)]


def quaternion_of(turn: np.ndarray) -> tuple[float, float, float, float]:
    """(w, x, y, z) of a rotation matrix: the eigenvector of the largest eigenvalue of its symmetric 4x4 form."""
    (a, b, c), (d, e, f), (g, h, i) = turn
    form = np.array([[a + e + i, h - f, c - g, d - b], [h - f, a - e - i, b + d, c + g], [c - g, b + d, e - a - i, f + h], [d - b, c + g, f + h, i - a - e]])
    q = np.linalg.eigh(form)[1][:, -1]
    return tuple((q if q[0] >= 0 else -q).tolist())


def perspective(width: int, height: int, eye, target, up, fov: float, near: float = 0.01, far: float | None = None) -> np.ndarray:
    """World to clip space of a camera: its last row is the distance along the sight, ``fov`` the angle of the picture's
    height in degrees. Without ``far`` the view has no end."""
    ahead = np.subtract(target, eye).astype(float)
    right = np.cross(ahead, np.asarray(up, float))
    if not np.linalg.norm(right):
        raise ValueError("a camera looks somewhere, and not along its up")
    ahead, right = ahead / np.linalg.norm(ahead), right / np.linalg.norm(right)
    tall = math.tan(math.radians(fov) / 2)
    seen = np.eye(4)
    seen[:3, :3] = right * height / (width * tall), np.cross(right, ahead) / tall, ahead
    scale, offset = (1.0, -2 * near) if far is None else ((far + near) / (far - near), -2 * far * near / (far - near))
    lens = np.array([[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, scale, offset], [0, 0, 1, 0]])
    return lens @ seen @ translation(*np.negative(eye))


def placement(shift, first) -> np.ndarray:
    """Where a later layer stands in the frame of the first: moved by the difference of their shifts."""
    return translation(*np.subtract(shift, first))
