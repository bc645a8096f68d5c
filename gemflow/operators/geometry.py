"""Meshes and masks: enclosed volumes, shape signatures, figures of a silhouette."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def boxes(rows: DataFrame, key: str, open_: Column | None = None) -> DataFrame:
    """Triangles (key, a, b, c: arrays of three numbers) of boxes with edges x, y, z; two faces' triangles are left out where ``open_``."""
    corners = [(i & 1, i >> 1 & 1, i >> 2) for i in range(8)]
    faces = [(0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5)]  # seen from outside, against the clock
    triangles = [t for p, q, r, s in faces for t in ((p, q, r), (p, r, s))]
    point = lambda i: F.array(*[F.col(c) * corners[i][k] for k, c in enumerate("xyz")])
    listed = F.array(*[F.struct(*[point(i).alias(n) for n, i in zip("abc", t)]) for t in triangles])
    shown = listed if open_ is None else F.when(open_, F.slice(listed, 1, 10)).otherwise(listed)
    return rows.select(key, F.inline(shown))


def closed_volumes(triangles: DataFrame, key: str, off: float = 0.02) -> DataFrame:
    """(key, volume) of meshes given as triangles (key, a, b, c); null where the surface is open.

    A closed surface has the same signed volume from every point; one from which two points see volumes apart by more
    than ``off`` is open. The volume seen from a point o is that from zero less o times the sum of the triangles' normals,
    so one aggregate, combined map-side, has both points' volumes: a mesh with most triangles is no hot group, and meshes
    are joined to nothing. Normals are of edges, so a mesh far from zero keeps the digits its corners have.
    """
    corner = lambda f, i: f(*[F.col(c)[i] for c in "abc"])
    p, q, r = ([F.col(c)[i] for i in range(3)] for c in "abc")
    u, v = ([x[i] - p[i] for i in range(3)] for x in (q, r))
    normal = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    volume = p[0] * normal[0] + p[1] * normal[1] + p[2] * normal[2]  # null where a number is missing; such a triangle adds nothing
    sums = triangles.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.sum(volume).alias("v"), *[F.sum(F.when(volume.isNotNull(), normal[i])).alias(f"n{i}") for i in range(3)],
        *[F.min(corner(F.least, i)).alias(f"low{i}") for i in range(3)], *[F.max(corner(F.greatest, i)).alias(f"high{i}") for i in range(3)],
    )
    seen = lambda o: (F.col("v") - (o[0] * F.col("n0") + o[1] * F.col("n1") + o[2] * F.col("n2"))) / 6
    low = [F.col(f"low{i}") for i in range(3)]
    both = sums.select(key, seen(low).alias("v0"), seen([F.col(f"high{i}") * 2 - low[i] for i in range(3)]).alias("v1"))
    closed = F.abs(F.col("v0") - F.col("v1")) <= off * F.greatest(F.abs("v0"), F.lit(1e-12))
    return both.select(key, F.when(closed, F.abs("v0")).alias("volume"))


def shape_gap(a, b) -> Column:
    """Largest relative difference of two signatures (two lengths and a ratio); the ratio counts at least from a half."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.greatest(F.abs(a[0] - b[0]) / b[0], F.abs(a[1] - b[1]) / b[1], F.abs(a[2] - b[2]) / F.greatest(b[2], F.lit(0.5)))


def mask_figures(mask: str, rows: int, columns: int) -> list[Column]:
    """sym, ink and fill of a mask given row by row: overlap with its mirror image, share of ink, share of its box."""
    m = F.col(mask)
    rows_ = [F.slice(m, r * columns + 1, columns) for r in range(rows)]
    mirrored = F.concat(*[F.reverse(r) for r in rows_])
    count = lambda a: F.size(F.filter(a, lambda x: x)).cast("double")
    both, either = F.zip_with(m, mirrored, lambda x, y: x & y), F.zip_with(m, mirrored, lambda x, y: x | y)
    inked = F.filter(F.transform(m, lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
    r, c = F.transform(inked, lambda i: F.floor(i / columns)), F.transform(inked, lambda i: i % columns)
    box = (F.array_max(r) - F.array_min(r) + 1) * (F.array_max(c) - F.array_min(c) + 1)
    return [
        F.round(count(both) / F.greatest(count(either), F.lit(1.0)), 4).alias("sym"), F.round(count(m) / (rows * columns), 4).alias("ink"),
        F.round(F.coalesce(box, F.lit(0)) / (rows * columns), 4).alias("fill"),
    ]
