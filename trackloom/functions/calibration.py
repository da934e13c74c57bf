"""Calibration as column expressions: matrices are ARRAY<ARRAY<DOUBLE>> columns or 3 x 3 lists of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackloom.functions.expressions import distance, undistorted

Matrix = list[list[Column]]


def cells(h: Column) -> Matrix:
    """The nine cells of an array column."""
    return [[h[i][j] for j in range(3)] for i in range(3)]


def rotation(rx: Column, ry: Column, rz: Column) -> Matrix:
    """The rotation matrix of a rotation vector, in closed form; the identity for the zero vector."""
    angle = F.sqrt(rx * rx + ry * ry + rz * rz)
    axis = [F.when(angle > 0, r / angle).otherwise(0.0) for r in (rx, ry, rz)]
    c, s = F.cos(angle), F.sin(angle)
    x, y, z = axis
    skew = [[F.lit(0.0), -z, y], [z, F.lit(0.0), -x], [-y, x, F.lit(0.0)]]
    return [[(c if i == j else F.lit(0.0)) + (1 - c) * axis[i] * axis[j] + s * skew[i][j] for j in range(3)] for i in range(3)]


def ground_homography(fx: Column, fy: Column, cx: Column, cy: Column, rotated: Matrix, moved: list[Column]) -> Matrix:
    """World-to-image homography of the plane z = 0: the pinhole camera matrix without its column for z."""
    plane = [[r[0], r[1], t] for r, t in zip(rotated, moved, strict=True)]
    return [[fx * plane[0][j] + cx * plane[2][j] for j in range(3)], [fy * plane[1][j] + cy * plane[2][j] for j in range(3)], plane[2]]


def inverse_point(h: Matrix, x: Column, y: Column) -> tuple[Column, Column]:
    """The ground point of an image point, by the adjugate of a world-to-image homography."""
    (a, b, c), (d, e, f), (g, i, j) = h
    adjugate = [[e * j - f * i, c * i - b * j, b * f - c * e], [f * g - d * j, a * j - c * g, c * d - a * f], [d * i - e * g, b * g - a * i, a * e - b * d]]
    p = [x * r[0] + y * r[1] + r[2] for r in adjugate]
    return p[0] / p[2], p[1] / p[2]


def frobenius(h: Matrix) -> Column:
    return F.sqrt(sum((v * v for row in h for v in row), F.lit(0.0)))


def normalised(h: Matrix) -> Matrix:
    """Scaled so that the last cell is 1; by the norm where that cell is 0."""
    by = F.when(F.abs(h[2][2]) > 1e-12, h[2][2]).otherwise(frobenius(h))
    return [[v / by for v in row] for row in h]


def relative_difference(a: Matrix, b: Matrix) -> Column:
    """Norm of the difference of two normalised homographies over the norm of the second."""
    a, b = normalised(a), normalised(b)
    return frobenius([[x - y for x, y in zip(r, s, strict=True)] for r, s in zip(a, b, strict=True)]) / frobenius(b)


def undistorted_pixel(x: Column, y: Column, cx: Column, cy: Column, dx: Column, dy: Column, k: Column) -> tuple[Column, Column]:
    """A pixel without radial distortion; dx and dy are the sensor's size of a pixel."""
    s = undistorted(k, (x - cx) * dx, (y - cy) * dy)
    return (x - cx) * s + cx, (y - cy) * s + cy


def distortion_shift(h: Matrix, x: Column, y: Column, cx: Column, cy: Column, dx: Column, dy: Column, k: Column) -> Column:
    """How far on the ground the distortion moves an image point."""
    return distance(*inverse_point(h, x, y), *inverse_point(h, *undistorted_pixel(x, y, cx, cy, dx, dy, k)))


def grid(width: Column, height: Column, steps: int = 5) -> Column:
    """Points (x, y) spread evenly over the middle four fifths of an image; to be exploded."""
    at = lambda size, i: size * (0.1 + 0.8 * i / (steps - 1))
    return F.array(*[F.struct(at(width, i).alias("x"), at(height, j).alias("y")) for i in range(steps) for j in range(steps)])
