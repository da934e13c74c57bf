"""Column expressions: rounding, geometry, vectors and caption text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rint(x: Column, digits: int = 0) -> Column:
    """Half-even rounding of x * 10^digits, as numpy rounds."""
    return F.rint(x * 10.0**digits) / 10.0**digits if digits else F.rint(x)


def mmss(seconds: Column) -> Column:
    total = F.rint(seconds).cast("long")
    return F.format_string("%d:%02d", F.floor(total / 60), total % 60)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def _overlap(a: list[Column], b: list[Column]) -> tuple[Column, Column, Column]:
    """Areas of the intersection and of both (left, top, right, bottom) boxes."""
    w, h = F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0)), (a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1])


def corners(box: list[Column]) -> list[Column]:
    """(left, top, width, height) as (left, top, right, bottom)."""
    return [box[0], box[1], box[0] + box[2], box[1] + box[3]]


def iou(a: list[Column], b: list[Column], as_corners: bool = False) -> Column:
    """Intersection over union of (left, top, width, height) boxes, or of boxes given by corners; 0 where the union is empty."""
    inter, one, two = _overlap(*((a, b) if as_corners else (corners(a), corners(b))))
    union = one + two - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def ioa(a: list[Column], b: list[Column], as_corners: bool = False) -> Column:
    """Intersection over the first box's own area; 0 where that is empty."""
    inter, one, _ = _overlap(*((a, b) if as_corners else (corners(a), corners(b))))
    return F.when(one > 0, inter / one).otherwise(0.0)


def ground_point(left: Column, top: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """The middle of a box's lower edge."""
    return left + width / 2, top + height


def touches_margin(left: Column, top: Column, width: Column, height: Column, frame_width: Column, frame_height: Column, margin: int = 5) -> Column:
    """Whether a box comes within `margin` pixels of the frame's edge."""
    return (left <= margin) | (top <= margin) | (left + width >= frame_width - margin) | (top + height >= frame_height - margin)


def clipped(left: Column, top: Column, width: Column, height: Column, frame_width: Column, frame_height: Column) -> Column:
    """(x1, y1, x2, y2) of the box inside the frame in whole pixels, null where nothing of it is."""
    x1, y1 = F.greatest(F.lit(0), left.cast("int")), F.greatest(F.lit(0), top.cast("int"))
    x2, y2 = F.least(frame_width.cast("int"), (left + width).cast("int")), F.least(frame_height.cast("int"), (top + height).cast("int"))
    return F.when((x2 > x1) & (y2 > y1), F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))


def seconds(frame: Column, fps: float = 30.0) -> Column:
    return rint(frame / fps, 3)


def geometric_mean(x: Column, y: Column) -> Column:
    return F.sqrt(x * y)


def jaccard(x: Column, y: Column) -> Column:
    """The Jaccard value, in per cent, of two scores in per cent that are its recall and precision; 0 where both are 0."""
    a, b = x / 100, y / 100
    return F.when(a + b - a * b > 0, 100 * (a * b) / (a + b - a * b)).otherwise(0.0)


def multiplication(x: Column, y: Column) -> Column:
    """The product, in per cent, of two scores in per cent."""
    return x * y / 100


def to_world(h: list[list[float]], x: Column, y: Column) -> tuple[Column, Column]:
    """Image point to ground point by a world-to-image homography, inverted in closed form."""
    (a, b, c), (d, e, f), (g, i, j) = h
    inv = [[e * j - f * i, c * i - b * j, b * f - c * e], [f * g - d * j, a * j - c * g, c * d - a * f], [d * i - e * g, b * g - a * i, a * e - b * d]]
    p = [x * r[0] + y * r[1] + F.lit(r[2]) for r in inv]
    return p[0] / p[2], p[1] / p[2]


def undistorted(k: Column, x: Column, y: Column) -> Column:
    """The scale s after five fixed-point steps of s = 1 / (1 + k r^2 s^2)."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(5)), F.lit(1.0), lambda s, _: 1 / (1 + k * (x * x + y * y) * s * s))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """The vector at unit length; a zero vector stays as it is."""
    return F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0)))[0]


def mean_confidence(probabilities: Column) -> Column:
    """The mean of each step's highest probability (an array of arrays); null without steps."""
    return F.aggregate(probabilities, F.lit(0.0), lambda s, p: s + F.array_max(p)) / F.when(F.size(probabilities) > 0, F.size(probabilities))


# Words of captions that speak of a person, and those that name a colour.
PERSON_WORDS = ["man", "men", "woman", "women", "person", "people", "boy", "boys", "girl", "girls", "child", "children", "kid", "kids", "guy", "gentleman", "lady", "individual", "player", "players"]
COLOUR_WORDS = ["black", "white", "gray", "grey", "dark", "light", "red", "orange", "yellow", "green", "blue", "purple", "pink", "brown", "beige", "navy", "maroon", "tan", "khaki", "silver", "gold", "golden", "olive", "teal", "magenta", "cream", "charcoal", "burgundy"]
BLANKS = " \t\n\x0b\x0c\r"


def _split(c: Column) -> Column:
    """The text at blanks of any kind, without empty parts."""
    bare = F.btrim(c, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"\s+"))


def caption_words(c: Column) -> Column:
    return _split(F.regexp_replace(F.lower(c), "[,.]", " "))


def mentions(c: Column, words: list[str] | None = None) -> Column:
    """Whether a caption has one of the words, of persons if none are given; a null caption has none."""
    return F.coalesce(F.arrays_overlap(caption_words(c), F.array(*[F.lit(w) for w in (words or PERSON_WORDS)])), F.lit(False))


def degenerate(c: Column) -> Column:
    """Whether one word, marks included, stands three times in a row; not so without words."""
    places = lambda w: F.when(F.size(w) >= 3, F.sequence(F.lit(2), F.size(w) - 1)).otherwise(F.array().cast("array<int>"))
    again = lambda w: F.exists(places(w), lambda i: (F.get(w, i) == F.get(w, i - 1)) & (F.get(w, i) == F.get(w, i - 2)))
    return F.transform(F.array(_split(F.lower(F.coalesce(c, F.lit(""))))), again)[0]  # the words are bound once


def without_words(c: Column, words: list[str] | None = None) -> Column:
    """The caption without listed words, colours if none are given: marks at their ends aside, hyphened ones if a part is listed.

    Blanks are collapsed, and none stays before a comma or full stop.
    """
    listed = F.array(*[F.lit(w) for w in (words or COLOUR_WORDS)])
    bare = lambda w: F.lower(F.btrim(w, F.lit(".,;:")))
    kept = F.array_join(F.filter(_split(c), lambda w: ~F.arrays_overlap(F.split(bare(w), "-"), listed)), " ")
    return F.replace(F.replace(kept, F.lit(" ,"), F.lit(",")), F.lit(" ."), F.lit("."))


#: Fixed value: the caption of a crop too small or too blurred to describe.
UNCLEAR = "appearance unclear (low-quality crop)"


def joined_captions(captions: Column) -> Column:
    """The captions that do not begin with UNCLEAR, joined by blanks; the first one where all do."""
    clear = F.filter(captions, lambda c: ~c.startswith(UNCLEAR))
    return F.when(F.size(clear) > 0, F.array_join(clear, " ")).otherwise(F.get(captions, F.lit(0)))
