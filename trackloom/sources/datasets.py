"""Folders of tracking files, plain or zipped, as tables with the files' order, for any of the evaluated variants.

A folder holds `<scene>/gt/gt.txt` and `<scene>/seqinfo.ini` for the truth, `<scene>.txt` for a tracker; either may also
be one zip archive with such members. All files of a folder are one table, read in parallel.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.expressions import BLANKS

#: The order of a file's lines: files by name, then blocks, then lines; compares as a whole.
ORDINAL = "struct<file:string,block:bigint,row:bigint>"
#: Bytes of a member that are decoded and given out at once.
CHUNK_LINES = 10_000


@dataclass(frozen=True)
class Variant:
    """Where a line has what: places, from 0, of the position (two numbers) or box (four), of the mark and of the class; None: no such column."""

    place: tuple[int, ...]
    mark: int | None = 6
    kind: int | None = None
    zero_distance: float = 2.0

    @property
    def boxes(self) -> bool:
        return len(self.place) == 4


# The columns of the two variants.
GROUND, BOXES = Variant((7, 8)), Variant((2, 3, 4, 5), kind=7)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, ordinal) of all lines of the text files at a path, or of the members of the zip archives there."""
    if path.endswith(".zip"):
        files = spark.read.format("binaryFile").load(path).select("path", "content")
        return files.mapInPandas(_members, f"value string, ordinal {ORDINAL}")
    # a block's lines come one after the other in a partition, so the row number orders them
    row = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path).select("value", row.alias("ordinal"))


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for path, content in zip(b["path"], b["content"], strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for name in z.namelist():
                    if name.endswith("/"):
                        continue
                    with io.TextIOWrapper(z.open(name), "utf-8", newline="\n") as lines:
                        rows: list[tuple] = []
                        for i, line in enumerate(lines):
                            rows.append((line.rstrip("\r\n"), {"file": f"{path}/{name}", "block": 0, "row": i}))
                            if len(rows) == CHUNK_LINES:
                                yield pd.DataFrame(rows, columns=["value", "ordinal"])
                                rows = []
                        if rows:
                            yield pd.DataFrame(rows, columns=["value", "ordinal"])


def _fields(value: Column) -> Column:
    """A line's fields: blanks, tabs, commas, semicolons, bars or colons between, as the line has them; ends do not count."""
    return F.split(F.regexp_replace(F.btrim(value, F.lit(BLANKS)), r"[\s,;|:]+$", ""), r"\s*[,;|:]\s*|\s+")


def read_scenes(spark: SparkSession, path: str, pattern: str, variant: Variant, scenes: list[str] | None = None) -> DataFrame:
    """(scene, frame, id, x, y, w, h, mark, class, ordinal): w and h only for boxes; pattern: what names the scene in a file's path.

    frame and id are whole numbers; mark is 1 and class 1 where the variant has none. scenes: only these, by file name, so
    that lines of others are not parsed. A field that is no number raises an error; empty lines are passed over.
    """
    lines = read_lines(spark, path).withColumn("scene", F.regexp_extract(F.col("ordinal.file"), pattern, 1)).where("scene <> ''")
    lines = lines if scenes is None else lines.where(F.col("scene").isin(scenes))
    lines = lines.where(F.btrim("value", F.lit(BLANKS)) != "").withColumn("f", _fields(F.col("value")))
    number = lambda i: F.get("f", F.lit(i)).cast("double")
    names = ["x", "y", "w", "h"][: len(variant.place)]
    return lines.select(
        "scene", number(0).cast("long").alias("frame"), number(1).cast("long").alias("id"), *[number(p).alias(n) for p, n in zip(variant.place, names, strict=True)],
        (F.lit(1.0) if variant.mark is None else number(variant.mark)).alias("mark"), (F.lit(1) if variant.kind is None else F.coalesce(number(variant.kind), F.lit(1)).cast("int")).alias("class"), "ordinal",
    )


def read_truth(spark: SparkSession, folder: str, variant: Variant, scenes: list[str] | None = None) -> DataFrame:
    """The truth of all scenes of a folder or archive; rows marked 0 are left out."""
    path = folder if folder.endswith(".zip") else f"{folder}/*/gt/gt.txt"
    return read_scenes(spark, path, r"([^/]+)/gt/gt\.txt$", variant, scenes).where("mark <> 0")


def read_tracker(spark: SparkSession, folder: str, variant: Variant, scenes: list[str] | None = None) -> DataFrame:
    """A tracker's rows of all scenes; its class column counts where the variant has one and it is above 0, else the class is 1."""
    path = folder if folder.endswith(".zip") else f"{folder}/*.txt"
    return read_scenes(spark, path, r"([^/]+)\.txt$", variant, scenes).withColumn("class", F.when(F.col("class") > 0, F.col("class")).otherwise(1))


def read_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """(scene, seq_length) from the seqinfo.ini files of a truth folder or archive."""
    lines = read_lines(spark, folder if folder.endswith(".zip") else f"{folder}/*/seqinfo.ini")
    length = F.regexp_extract("value", r"(?i)^\s*seqLength\s*[=:]\s*([0-9.]+)", 1).try_cast("double").cast("long")
    return lines.select(F.regexp_extract(F.col("ordinal.file"), r"([^/]+)/seqinfo\.ini$", 1).alias("scene"), length.alias("seq_length")).where("scene <> '' AND seq_length IS NOT NULL")
