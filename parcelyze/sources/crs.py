"""Coordinate systems: WGS 84, Web Mercator and the UTM zones on WGS 84. Any other code is an error, never passed through.

UTM by the Krueger series to the sixth order (below a millimetre within a zone).
"""

from __future__ import annotations

import re

import numpy as np

_A, _F = 6378137.0, 1 / 298.257223563
_N = _F / (2 - _F)
_K0 = 0.9996
_RECT = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
# The series' coefficients in powers of the third flattening.
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)


def parse(code: str) -> int:
    """The number of ``EPSG:n``; raises ValueError for codes that are not supported."""
    m = re.fullmatch(r"EPSG:(\d{4,6})", code or "")
    n = int(m[1]) if m else 0
    if n in (4326, 3857) or 32601 <= n <= 32660 or 32701 <= n <= 32760:
        return n
    raise ValueError(f"unsupported coordinate system {code!r}")


def _utm(n: int) -> tuple[float, float]:
    """(central meridian in radians, false northing)."""
    return np.radians((n % 100) * 6 - 183), 0.0 if n < 32700 else 1e7


def to_wgs84(x, y, code: str) -> tuple[np.ndarray, np.ndarray]:
    """Degrees of projected coordinates."""
    n, x, y = parse(code), np.asarray(x, float), np.asarray(y, float)
    if n == 4326:
        return x, y
    if n == 3857:
        return np.degrees(x / _A), np.degrees(2 * np.arctan(np.exp(y / _A)) - np.pi / 2)
    lon0, north = _utm(n)
    xi, eta = (y - north) / (_K0 * _RECT), (x - 5e5) / (_K0 * _RECT)
    u, v = xi.copy() if xi.ndim else xi, eta.copy() if eta.ndim else eta
    for j, b in enumerate(_BETA, 1):
        u = u - b * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        v = v - b * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
    chi = np.arcsin(np.sin(u) / np.cosh(v))
    # From the conformal latitude by iteration.
    e = np.sqrt(_F * (2 - _F))
    q, lat = np.arctanh(np.sin(chi)), chi
    for _ in range(6):
        lat = np.arcsin(np.tanh(q + e * np.arctanh(e * np.sin(lat))))
    return np.degrees(lon0 + np.arctan2(np.sinh(v), np.cos(u))), np.degrees(lat)


def from_wgs84(lon, lat, code: str) -> tuple[np.ndarray, np.ndarray]:
    """Projected coordinates of degrees."""
    n, lon, lat = parse(code), np.asarray(lon, float), np.asarray(lat, float)
    if n == 4326:
        return lon, lat
    if n == 3857:
        return np.radians(lon) * _A, np.log(np.tan(np.pi / 4 + np.radians(lat) / 2)) * _A
    lon0, north = _utm(n)
    e, s = np.sqrt(_F * (2 - _F)), np.sin(np.radians(lat))
    tau = np.sinh(np.arctanh(s) - e * np.arctanh(e * s))
    d = np.radians(lon) - lon0
    xi, eta = np.arctan2(tau, np.cos(d)), np.arcsinh(np.sin(d) / np.hypot(tau, np.cos(d)))
    u, v = xi, eta
    for j, a in enumerate(_ALPHA, 1):
        u = u + a * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        v = v + a * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
    return 5e5 + _K0 * _RECT * v, north + _K0 * _RECT * u


def transform(position: list, source: str, target: str) -> list:
    """A position with its other ordinates kept."""
    lon, lat = to_wgs84(position[0], position[1], source)
    x, y = from_wgs84(lon, lat, target)
    if not (np.isfinite(x) and np.isfinite(y)):
        raise ValueError("a coordinate cannot be transformed")
    return [float(x), float(y), *position[2:]]


def of_wkt(wkt: str) -> str | None:
    """The code of a .prj text, if it is one of the supported systems."""
    low = wkt.upper().replace("_", " ")
    if m := re.search(r"UTM ZONE (\d{1,2})\s*([NS])", low):
        return f"EPSG:{(32600 if m[2] == 'N' else 32700) + int(m[1])}"
    if "MERCATOR" in low and ("WEB" in low or "PSEUDO" in low or "AUXILIARY" in low):
        return "EPSG:3857"
    return "EPSG:4326" if "PROJCS" not in low and "GEOGCS" in low and ("WGS" in low and "84" in low) else None
