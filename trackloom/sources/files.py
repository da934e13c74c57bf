"""Readers and writers of the text formats of multi-camera tracking, with explicit schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.expressions import BLANKS, rint

DETECTION = "frame INT, track_id INT, class STRING, bbox_left DOUBLE, bbox_top DOUBLE, bbox_width DOUBLE, bbox_height DOUBLE, conf DOUBLE"
RECORD = "camera_id INT, id INT, frame_id INT, x DOUBLE, y DOUBLE, width DOUBLE, height DOUBLE, xworld DOUBLE, yworld DOUBLE"
MOT = "frame_id DOUBLE, id DOUBLE, x DOUBLE, y DOUBLE, width DOUBLE, height DOUBLE, conf DOUBLE, xworld DOUBLE, yworld DOUBLE, zworld DOUBLE"
#: Columns of track features that may be missing.
OPTIONAL = {"caption_embedding": "array<double>", "first_px_x": "double", "first_px_y": "double", "last_px_x": "double", "last_px_y": "double"}


def read_detections(spark: SparkSession, path: str, kind: str = "person") -> DataFrame:
    """JSON lines of single-camera detections, of one class."""
    return spark.read.schema(DETECTION).json(path).where(F.col("class") == kind)


def write_detections(boxes: DataFrame, path: str) -> None:
    """boxes with centres (cx, cy, w, h) as JSON lines with the top left corner."""
    boxes.select("frame", "track_id", "class", (F.col("cx") - F.col("w") / 2).alias("bbox_left"), (F.col("cy") - F.col("h") / 2).alias("bbox_top"), F.col("w").alias("bbox_width"), F.col("h").alias("bbox_height"), "conf").write.json(path)


def read_records(spark: SparkSession, path: str, cameras: list[int] | None = None, interval: int = 1) -> DataFrame:
    """Nine-column records; world positions are rounded to 3 decimals.

    Negative ids and frames, and fields that are no numbers, raise an error, in rows that the filters would leave out too.
    """
    r = spark.read.schema(RECORD).option("sep", " ").option("mode", "FAILFAST").csv(path)
    bad = (F.col("camera_id") < 0) | (F.col("id") < 0) | (F.col("frame_id") < 0)
    wanted = F.col("frame_id") % interval == 0
    wanted = wanted & F.col("camera_id").isin(cameras) if cameras else wanted
    # one expression, so that no row is filtered before it is checked
    r = r.where(F.when(bad, F.raise_error(F.lit("negative CameraId, Id or FrameId")).cast("boolean")).otherwise(wanted))
    return r.withColumns({c: rint(F.col(c), 3) for c in ("xworld", "yworld")})


def copy_cameras(spark: SparkSession, source: str, target: str, cameras: list[int]) -> None:
    """The lines of a record file whose first field is one of the cameras, as they are."""
    first = F.split(F.trim("value"), r"\s+")[0].try_cast("int")
    spark.read.text(source).where(first.isin(cameras)).write.text(target)


def write_records(records: DataFrame, path: str) -> None:
    line = F.format_string("%d %d %d %.2f %.2f %.2f %.2f %.4f %.4f", *["camera_id", "id", "frame_id", "x", "y", "width", "height", "xworld", "yworld"])
    records.select(line.alias("value")).write.text(path)


def read_scene_map(spark: SparkSession, path: str) -> DataFrame:
    """(scene_name, camera_id); scenes that come twice are joined."""
    m = spark.read.schema("scene_name STRING, camera_ids ARRAY<INT>").option("multiLine", True).json(path)
    return m.select("scene_name", F.explode("camera_ids").alias("camera_id")).distinct()


def read_mot(spark: SparkSession, path: str, crowd: dict[str, list[str]] | None = None, valid: dict[str, list[str]] | None = None, convert: dict[str, dict[str, float]] | None = None, drop_negative: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, ignored): ten-column records of one scene, blank, comma, tab or semicolon between; ids and frames as whole numbers.

    crowd: values by column of rows that go to the ignored ones; valid: values by column that other rows must have;
    convert: values by column and (lower-case) text, in both; drop_negative: without rows of negative ids. Texts are
    compared in lower case. A number that cannot be read raises an error. Zipped files must be unpacked before.
    """
    names = [f.split()[0] for f in MOT.split(", ")]
    parts = F.split(F.regexp_replace(F.trim("value"), r"[\s,;]+$", ""), r"\s*[,;]\s*|\s+")
    raw = spark.read.text(path).where(F.trim("value") != "").select(*[F.lower(F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(names)])
    any_of = lambda rules: reduce(lambda x, y: x | y, [F.coalesce(F.col(c).isin([v.lower() for v in vs]), F.lit(False)) for c, vs in rules.items()], F.lit(False))
    aside = any_of(crowd or {})
    rows = raw.where(~aside)
    for c, vs in (valid or {}).items():
        rows = rows.where(F.col(c).isin([v.lower() for v in vs]))

    def typed(df: DataFrame) -> DataFrame:
        for c, by in (convert or {}).items():
            known = F.create_map(*[F.lit(x) for k, v in by.items() for x in (k.lower(), str(v))])
            df = df.withColumn(c, known[F.col(c)])
        df = df.select(*[F.col(n).cast("double").alias(n) for n in names])
        return df.withColumn("frame_id", F.col("frame_id").cast("int")).withColumn("id", F.col("id").cast("int"))

    found = typed(rows)
    return (found.where("id >= 0") if drop_negative else found), typed(raw.where(aside))


def read_sequences(spark: SparkSession, seqmap: str, scenes: str) -> DataFrame:
    """(scene, seq_length) of the scenes that a sequence map lists (first line aside), from scenes/<scene>/seqinfo.ini; a scene without one raises an error."""
    listed = spark.read.text(seqmap).select(F.trim(F.split("value", ",")[0]).alias("scene")).where("scene <> '' AND scene <> 'name'")
    ini = spark.read.text(f"{scenes}/*/seqinfo.ini", wholetext=True).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+)/seqinfo\.ini", 1).alias("scene"), F.regexp_extract("value", r"(?mi)^\s*seqLength\s*[=:]\s*([0-9.]+)", 1).try_cast("double").cast("int").alias("seq_length")
    )
    length = F.when(F.col("seq_length").isNull(), F.raise_error(F.concat(F.lit("no seqinfo.ini with a length: "), "scene")).cast("int")).otherwise(F.col("seq_length"))
    return listed.join(ini, "scene", "left").select("scene", length.alias("seq_length"))


def write_features(tracks: DataFrame, path: str) -> None:
    tracks.write.parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Track features; columns that older files lack come out null."""
    f = spark.read.parquet(path)
    return f.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in f.columns})


def write_graph(path: str, **tables: DataFrame) -> None:
    """The event graph as Parquet tables: entities, sightings, edges."""
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str, names: tuple[str, ...] = ("entities", "sightings", "edges")) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def write_id_map(ids: DataFrame, path: str) -> None:
    """(camera, track_id, global_id) as JSON lines with the key "camera,track_id"."""
    ids.select(F.concat_ws(",", F.col("camera").cast("string"), F.col("track_id").cast("string")).alias("key"), "global_id").write.json(path)


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    key = F.split("key", ",")
    return spark.read.schema("key STRING, global_id LONG").json(path).select(key[0].alias("camera"), key[1].cast("int").alias("track_id"), "global_id")


# The order of the fields in a summary file.
SUMMARY = ["HOTA", "DetA", "AssA", "DetRe", "DetPr", "AssRe", "AssPr", "LocA", "OWTA", "HOTA(0)", "LocA(0)", "HOTALocA(0)", "MOTA", "MOTP", "MODA", "CLR_Re", "CLR_Pr", "MTR", "PTR", "MLR", "CLR_TP", "CLR_FN", "CLR_FP", "IDSW", "MT", "PT", "ML", "Frag", "sMOTA", "IDF1", "IDR", "IDP", "IDTP", "IDFN", "IDFP", "Dets", "GT_Dets", "IDs", "GT_IDs"]


def write_summary(summary: DataFrame, path: str) -> None:
    """One row of fields as a blank-separated file with a header: known fields in their order, others behind."""
    fields = [f for f in SUMMARY if f in summary.columns] + [c for c in summary.columns if c not in SUMMARY]
    summary.select(*[F.col(f"`{f}`") for f in fields]).coalesce(1).write.option("sep", " ").option("header", True).csv(path)


def read_summaries(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(tracker, field, value) of the summary files of several trackers."""
    out = None
    for tracker, path in paths.items():
        s = spark.read.option("sep", " ").option("header", True).csv(path)
        long = s.select(F.lit(tracker).alias("tracker"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("double").alias("value")) for c in s.columns])).alias("f")).select("tracker", "f.*")
        out = long if out is None else out.unionByName(long)
    return out


def write_detailed(detailed: DataFrame, path: str) -> None:
    """Rows (seq, fields) as CSV with a header, in order of seq, COMBINED last."""
    rows = detailed.orderBy(F.col("seq") == "COMBINED", "seq")
    rows.coalesce(1).write.option("header", True).csv(path)


def read_detailed(spark: SparkSession, path: str) -> DataFrame:
    """(seq, field, value) of a detailed file; COMBINED is named COMBINED_SEQ. Rows without a name or with missing values are left out."""
    d = spark.read.option("header", True).csv(path)
    fields = d.columns[1:]
    seq = F.when(F.col("seq") == "COMBINED", "COMBINED_SEQ").otherwise(F.col("seq"))
    whole = d.where(F.col("seq").isNotNull() & (F.size(F.filter(F.array(*[F.col(f"`{f}`") for f in fields]), lambda x: x.isNull())) == 0))
    return whole.select(seq.alias("seq"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("double").alias("value")) for c in fields])).alias("f")).select("seq", "f.*")


def read_homographies(spark: SparkSession, path: str) -> DataFrame:
    """(camera, h): the 3 x 3 matrices under "# Ground plane homography" of each "# Camera" block of a calibration text."""
    block = spark.read.text(path, wholetext=True).select(F.explode(F.slice(F.split("value", "# Camera "), F.lit(2), F.size(F.split("value", "# Camera ")))).alias("b"))
    numbers = lambda line: F.transform(F.split(F.btrim(line, F.lit(BLANKS)), r"\s+"), lambda x: x.cast("double"))
    lines = F.filter(F.split(F.split("b", "# Ground plane homography")[1], "\n"), lambda x: ~F.btrim(x, F.lit(BLANKS)).startswith("#") & (F.btrim(x, F.lit(BLANKS)) != ""))
    return block.select(F.btrim(F.split("b", "\n")[0], F.lit(BLANKS)).cast("int").alias("camera"), F.transform(F.slice(lines, 1, 3), numbers).alias("h"))


TSAI = {"Geometry": ["width", "height", "dpx", "dpy"], "Intrinsic": ["focal", "kappa1", "cx", "cy", "sx"], "Extrinsic": ["tx", "ty", "tz", "rx", "ry", "rz"]}


def read_tsai(spark: SparkSession, path: str) -> DataFrame:
    """(file, width, height, dpx, ...): the numbers of Tsai camera models in XML, one file a camera."""
    x = spark.read.text(path, wholetext=True)
    value = lambda tag, name: F.expr(f"xpath_string(value, '//{tag}/@{name}')").cast("double").alias(name)
    return x.select(F.input_file_name().alias("file"), *[value(tag, n) for tag, names in TSAI.items() for n in names])
