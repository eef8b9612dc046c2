"""Rotations, encodings and range expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def rotation(axis: str, angle: float) -> list[list[float]]:
    """Rotation matrix about x, y or z."""
    c, s = math.cos(angle), math.sin(angle)
    i, j = {"x": (1, 2), "y": (2, 0), "z": (0, 1)}[axis]
    m = np.eye(3)
    m[i, i], m[i, j], m[j, i], m[j, j] = c, -s, s, c
    return m.tolist()


def axis_angle(axis: tuple[float, float, float], angle: float) -> list[list[float]]:
    """Rotation about any axis, as the exponential of its cross-product matrix."""
    x, y, z = np.asarray(axis, float) / np.linalg.norm(axis)
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return (np.eye(3) + math.sin(angle) * k + (1 - math.cos(angle)) * (k @ k)).tolist()


def rigid(matrix: list[list[float]], shift: tuple[float, float, float] = (0, 0, 0)) -> list[list[float]]:
    """A 3x3 matrix and a shift as 4x4."""
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = matrix, shift
    return m.tolist()


def inverse(matrix: list[list[float]]) -> list[list[float]]:
    return np.linalg.inv(np.asarray(matrix, float)).tolist()


def rescale(c: Column, source: tuple, target: tuple) -> Column:
    """Map the range ``source`` onto ``target``."""
    return (c - source[0]) * (target[1] - target[0]) / (source[1] - source[0]) + target[0]


def sine_encoding(c: Column, n: int, temperature: float = 10000.0, scale: float = 2 * math.pi) -> Column:
    """``n`` sines and cosines of a coordinate in 0..1, interleaved."""
    waves = [(c * scale) / (temperature ** (2 * (i // 2) / n)) for i in range(n)]
    return F.array(*(F.sin(w) if i % 2 == 0 else F.cos(w) for i, w in enumerate(waves)))


def fourier_encoding(axes: tuple[str, ...], n: int, seed: int = 0, gauss: float = 1.0) -> Column:
    """Sines then cosines of random projections of the axes; the projection follows from the seed."""
    b = np.random.default_rng(seed).normal(size=(len(axes), n)) * gauss
    waves = [sum((F.col(a) * float(2 * math.pi * b[i, k]) for i, a in enumerate(axes)), F.lit(0.0)) for k in range(n)]
    return F.array(*map(F.sin, waves), *map(F.cos, waves))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def time_hash(p: Column, t: Column, base: int) -> Column:
    """One key of a position and a time index."""
    return p * base + t


def ravel(cells: list[Column], dims: list[int]) -> Column:
    """Flat row-major index of cell coordinates."""
    out = F.lit(0).cast("long")
    for c, d in zip(cells, dims):
        out = out * d + c
    return out
