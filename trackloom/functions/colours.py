"""Named colours: the nearest of a palette by distance in CIE Lab, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names and RGB values must equal these for the same answers.
PALETTE = {
    "black": (20, 20, 20),
    "white": (235, 235, 235),
    "gray": (128, 128, 128),
    "dark gray": (70, 70, 70),
    "red": (200, 30, 30),
    "dark red": (120, 20, 20),
    "orange": (230, 120, 30),
    "yellow": (220, 200, 40),
    "green": (40, 150, 60),
    "dark green": (20, 90, 40),
    "blue": (40, 90, 200),
    "dark blue": (20, 40, 110),
    "light blue": (130, 180, 230),
    "purple": (120, 50, 150),
    "pink": (230, 140, 180),
    "brown": (110, 70, 40),
    "beige": (210, 190, 150),
}


def lab(r: Column, g: Column, b: Column) -> list[Column]:
    """sRGB (0 to 255) under D65 as CIE Lab in bytes: L scaled to 255, a and b moved by 128, all rounded."""
    linear = [F.when(v / 255.0 > 0.04045, F.pow((v / 255.0 + 0.055) / 1.055, F.lit(2.4))).otherwise(v / 255.0 / 12.92) for v in (r, g, b)]
    mix = lambda *w: linear[0] * w[0] + linear[1] * w[1] + linear[2] * w[2]
    x, y, z = mix(0.412453, 0.357580, 0.180423) / 0.950456, mix(0.212671, 0.715160, 0.072169), mix(0.019334, 0.119193, 0.950227) / 1.088754
    f = lambda t: F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116.0)
    light = F.when(y > 0.008856, 116.0 * F.cbrt(y) - 16.0).otherwise(903.3 * y)
    return [F.rint(light * 2.55), F.rint(500.0 * (f(x) - f(y)) + 128.0), F.rint(200.0 * (f(y) - f(z)) + 128.0)]


def nearest_colour(r: Column, g: Column, b: Column, palette: dict[str, tuple[int, int, int]] = PALETTE) -> Column:
    """The palette's name that is nearest in Lab; the first one on ties."""
    own = lab(r, g, b)
    scored = []
    for place, (name, rgb) in enumerate(palette.items()):
        other = lab(*[F.lit(float(v)) for v in rgb])
        apart = sum(((p - q) * (p - q) for p, q in zip(own, other, strict=True)), F.lit(0.0))
        scored.append(F.struct(apart.alias("apart"), F.lit(place).alias("place"), F.lit(name).alias("name")))
    return F.array_min(F.array(*scored))["name"]
