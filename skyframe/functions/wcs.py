"""Tangent-plane coordinates as column expressions.

A WCS is a struct of crval1, crval2, crpix1, crpix2, cd11, cd12, cd21, cd22 (degrees, FITS pixels that count from 1).
Polynomial distortion (SIP) is a struct of two arrays of coefficients; tabulated distortions are not part of it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SIP_ORDER = 5
FIELDS = ("crval1", "crval2", "crpix1", "crpix2", "cd11", "cd12", "cd21", "cd22")


def from_header(header: Column, hdu: int = 1) -> Column:
    """The struct from a header map; null where a key is missing or no number."""
    keys = ("CRVAL1", "CRVAL2", "CRPIX1", "CRPIX2", "CD1_1", "CD1_2", "CD2_1", "CD2_2")
    values = [F.try_element_at(header, F.lit(f"h{hdu}_{k}")).try_cast("double") for k in keys]
    whole = values[0].isNotNull()
    for v in values[1:]:
        whole = whole & v.isNotNull()
    return F.when(whole, F.struct(*[v.alias(n) for v, n in zip(values, FIELDS, strict=True)]))


def no_terms() -> Column:
    return F.array(*[F.lit(0.0)] * len(terms()))


def terms(order: int = SIP_ORDER) -> list[tuple[int, int]]:
    """Powers (p, q) of the coefficients, in the order they have in the arrays."""
    return [(p, q) for p in range(order + 1) for q in range(order + 1 - p)]


def sip_from_header(header: Column, hdu: int = 1) -> Column:
    """The distortion from a header map: a struct of a and b, each the coefficients of ``terms()``, 0 where a key is missing; null without A_ORDER and
    B_ORDER, and where either is over ``SIP_ORDER``."""
    at = lambda k: F.try_element_at(header, F.lit(f"h{hdu}_{k}")).try_cast("double")
    side = lambda name: F.array(*[F.coalesce(at(f"{name}_{p}_{q}"), F.lit(0.0)) for p, q in terms()])
    return F.when(F.greatest(at("A_ORDER"), at("B_ORDER")) <= SIP_ORDER, F.when(at("A_ORDER").isNotNull() & at("B_ORDER").isNotNull(), F.struct(side("A").alias("a"), side("B").alias("b"))))


def _polynomial(c: Column, u: Column, v: Column) -> Column:
    """Sum of c_pq u^p v^q, nested so that each coefficient costs one product."""
    place = {pq: k for k, pq in enumerate(terms())}
    total = None
    for p in range(SIP_ORDER, -1, -1):
        inner = None
        for q in range(SIP_ORDER - p, -1, -1):
            term = c[place[p, q]]
            inner = term if inner is None else inner * v + term
        total = inner if total is None else total * u + inner
    return total


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is worked out once, however often it stands in the body."""
    return F.transform(F.array(value), body)[0]


def distorted(sip: Column, u: Column, v: Column) -> Column:
    """(u, v) moved by the polynomials; as they are where there is no distortion."""
    a, b = F.coalesce(sip.a, no_terms()), F.coalesce(sip.b, no_terms())
    return F.struct((u + _polynomial(a, u, v)).alias("u"), (v + _polynomial(b, u, v)).alias("v"))


def undistorted(sip: Column, u: Column, v: Column, rounds: int = 12) -> Column:
    """The place that ``distorted`` moves to (u, v), by fixed-point rounds: each takes the distortion at the last place off the target."""
    a, b = F.coalesce(sip.a, no_terms()), F.coalesce(sip.b, no_terms())
    target = F.struct(u.alias("u"), v.alias("v"))
    step = lambda s, _: F.struct((u - _polynomial(a, s.u, s.v)).alias("u"), (v - _polynomial(b, s.u, s.v)).alias("v"))
    return F.when(sip.isNull(), target).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), target, step))


def pixel_to_sky(wcs: Column, x: Column, y: Column, sip: Column | None = None) -> Column:
    """(ra, dec) in degrees of a pixel counted from 0."""
    u, v = x + 1 - wcs.crpix1, y + 1 - wcs.crpix2
    return _sky(wcs, u, v) if sip is None else let(distorted(sip, u, v), lambda moved: _sky(wcs, moved.u, moved.v))


def _sky(wcs: Column, u: Column, v: Column) -> Column:
    xi, eta = F.radians(wcs.cd11 * u + wcs.cd12 * v), F.radians(wcs.cd21 * u + wcs.cd22 * v)
    d0 = F.radians(wcs.crval2)
    den = F.cos(d0) - eta * F.sin(d0)
    ra = wcs.crval1 + F.degrees(F.atan2(xi, den))
    dec = F.degrees(F.atan2(F.sin(d0) + eta * F.cos(d0), F.hypot(den, xi)))
    return F.struct(F.pmod(ra, F.lit(360.0)).alias("ra"), dec.alias("dec"))


def sky_to_pixel(wcs: Column, ra: Column, dec: Column, sip: Column | None = None) -> Column:
    """(x, y) counted from 0, null on the far half of the sky."""
    d, d0, da = F.radians(dec), F.radians(wcs.crval2), F.radians(ra - wcs.crval1)
    den = F.sin(d) * F.sin(d0) + F.cos(d) * F.cos(d0) * F.cos(da)
    xi = F.degrees(F.cos(d) * F.sin(da) / F.nullif(den, F.lit(0.0)))
    eta = F.degrees((F.sin(d) * F.cos(d0) - F.cos(d) * F.sin(d0) * F.cos(da)) / F.nullif(den, F.lit(0.0)))
    det = wcs.cd11 * wcs.cd22 - wcs.cd12 * wcs.cd21
    u, v = (wcs.cd22 * xi - wcs.cd12 * eta) / det, (wcs.cd11 * eta - wcs.cd21 * xi) / det
    place = lambda p: F.struct((p.u + wcs.crpix1 - 1).alias("x"), (p.v + wcs.crpix2 - 1).alias("y"))
    plain = F.struct(u.alias("u"), v.alias("v"))
    return F.when(den > 0, place(plain) if sip is None else let(let(plain, lambda t: undistorted(sip, t.u, t.v)), place))


def project(a: Column, b: Column, x: Column, y: Column, sip_a: Column | None = None, sip_b: Column | None = None) -> Column:
    """Where a pixel of ``a`` falls in ``b``."""
    sky = pixel_to_sky(a, x, y, sip_a)
    return sky_to_pixel(b, sky.ra, sky.dec) if sip_a is None and sip_b is None else let(sky, lambda s: sky_to_pixel(b, s.ra, s.dec, sip_b))


def _sums(c: Sequence[np.ndarray], u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``_polynomial`` over arrays; coefficients that are 0 throughout cost nothing."""
    place = {pq: k for k, pq in enumerate(terms())}
    total = np.zeros_like(u)
    for p in range(SIP_ORDER, -1, -1):
        inner = np.zeros_like(u)
        for q in range(SIP_ORDER - p, -1, -1):
            term = c[place[p, q]]
            inner = inner * v + term if inner.any() else inner + term
        total = total * u + inner if total.any() else inner
    return total


def project_arrays(a: Sequence[np.ndarray], b: Sequence[np.ndarray], x: np.ndarray, y: np.ndarray, sip_a: Sequence[Sequence[np.ndarray]], sip_b: Sequence[Sequence[np.ndarray]], rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """``project`` for many pixels at once: (x, y) in ``b``, NaN on the far half of the sky.

    ``a`` and ``b`` are the ``FIELDS`` and ``sip_a`` and ``sip_b`` the coefficients (of a, of b), each an array with a value for each pixel.
    """
    ra0, dec0, p1, p2, cd11, cd12, cd21, cd22 = a
    u, v = x + 1 - p1, y + 1 - p2
    u, v = u + _sums(sip_a[0], u, v), v + _sums(sip_a[1], u, v)
    xi, eta, d0 = np.radians(cd11 * u + cd12 * v), np.radians(cd21 * u + cd22 * v), np.radians(dec0)
    den = np.cos(d0) - eta * np.sin(d0)
    ra, d = np.mod(ra0 + np.degrees(np.arctan2(xi, den)), 360.0), np.radians(np.degrees(np.arctan2(np.sin(d0) + eta * np.cos(d0), np.hypot(den, xi))))
    ra0, dec0, p1, p2, cd11, cd12, cd21, cd22 = b
    d0, da = np.radians(dec0), np.radians(ra - ra0)
    den = np.sin(d) * np.sin(d0) + np.cos(d) * np.cos(d0) * np.cos(da)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        xi, eta = np.degrees(np.cos(d) * np.sin(da) / den), np.degrees((np.sin(d) * np.cos(d0) - np.cos(d) * np.sin(d0) * np.cos(da)) / den)
        det = cd11 * cd22 - cd12 * cd21
        u0, v0 = (cd22 * xi - cd12 * eta) / det, (cd11 * eta - cd21 * xi) / det
        u, v = u0, v0
        for _ in range(rounds):
            u, v = u0 - _sums(sip_b[0], u, v), v0 - _sums(sip_b[1], u, v)
        return np.where(den > 0, u + p1 - 1, np.nan), np.where(den > 0, v + p2 - 1, np.nan)


def translation(a: Column, b: Column, x: Column, y: Column) -> Column:
    """How far ``b`` is shifted against ``a`` at a pixel."""
    there = project(a, b, x, y)
    return F.struct((there.x - x).alias("tx"), (there.y - y).alias("ty"))


def overlap(a: Column, b: Column, width: int, height: int, margin: int = 10) -> Column:
    """Box of ``a``'s pixels that ``b`` covers, from b's corners drawn in by ``margin``; null where they don't meet."""
    corner = lambda x, y: let(pixel_to_sky(b, F.lit(float(x)), F.lit(float(y))), lambda s: sky_to_pixel(a, s.ra, s.dec))
    corners = F.array(*[corner(x, y) for x in (margin, width - 1 - margin) for y in (margin, height - 1 - margin)])
    # the inner two of four corners bound what lies inside on both sides
    low = lambda v: F.greatest(F.ceil(F.round(v[1], 6)), F.lit(0)).cast("int")
    high = lambda v, size: F.least(F.floor(F.round(v[2], 6)), F.lit(size - 1)).cast("int") + 1

    def box(c: Column) -> Column:
        return F.struct(low(c.ys).alias("y0"), low(c.xs).alias("x0"), high(c.ys, height).alias("y1"), high(c.xs, width).alias("x1"))

    placed = let(corners, lambda c: F.struct(F.array_sort(F.transform(c, lambda p: p.x)).alias("xs"), F.array_sort(F.transform(c, lambda p: p.y)).alias("ys")))
    return let(let(placed, box), lambda b: F.when((b.y1 > b.y0) & (b.x1 > b.x0), b))


def overlap_fraction(a: Column, b: Column, width: int, height: int, margin: int = 10) -> Column:
    """The share of ``a``'s pixels in the box that ``b`` covers; 0 where they don't meet."""
    return let(overlap(a, b, width, height, margin), lambda box: F.coalesce((box.y1 - box.y0) * (box.x1 - box.x0) / float(width * height), F.lit(0.0)))
