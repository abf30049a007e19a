"""Photo and translation joins, membership counts, what is still to do.

No join here is hinted: the planner broadcasts a side below its size threshold, and
beyond it adaptive execution splits a skewed key of the many-rows side.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcorp import constants as K
from parcorp.functions.text import remove_all
from parcorp.operators.dedup import keep_first


def photo_id(path: Column) -> Column:
    """The text id in a photo path, null when there is none."""
    return F.nullif(F.regexp_extract(path, K.PHOTO_ID_PATTERN, 1), F.lit(""))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def photo_index(artifacts: DataFrame, assets: DataFrame, file_format: str = "jpg") -> DataFrame:
    """(artifact_id, image_type, image, artifact_type, id) for the photos of artifacts."""
    photos = assets.where(F.col("file_format") == file_format)
    return artifacts.join(photos, "artifact_id").select(
        "artifact_id", F.col("asset_type").alias("image_type"),
        file_name(F.col("path")).alias("image"), "artifact_type",
        photo_id(F.col("path")).alias("id"),
    )


def texts_with_photos(texts: DataFrame, photos: DataFrame) -> DataFrame:
    """One row per photo of a text; texts of all splits in one join."""
    split = [c for c in ("split",) if c in texts.columns]
    return texts.join(photos, "id").select(
        "id", "glyphs", "image", "image_type", "period", "genre", *split
    )


def texts_with_translations(texts: DataFrame, second: DataFrame, order: list[str]) -> DataFrame:
    """Texts of all splits with the first translation of their id, layout marks removed."""
    first = keep_first(second, ["id"], order).select("id", "translation")
    return texts.join(first, "id").select(
        "id", "split", "period", "genre",
        remove_all(F.col("transliteration"), K.LAYOUT_TOKENS).alias("transliteration"),
        "translation",
    )


def count_present(ids: DataFrame, other: DataFrame, row_id: str = "id") -> DataFrame:
    """(n, found): rows, and rows whose id the other table has."""
    marks = other.select(row_id).distinct().withColumn("_found", F.lit(True))
    return ids.join(marks, row_id, "left").agg(
        F.count("*").alias("n"), F.count("_found").alias("found")
    )


def still_to_do(work: DataFrame, done: DataFrame, row_id: str = "id") -> DataFrame:
    return work.join(done.select(row_id), row_id, "left_anti")


SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)"


def without_scheme(path: Column) -> Column:
    """A path without its file system: `hdfs://host/a`, `s3a://b/a` and `file:/a` are `/a`."""
    return F.regexp_replace(path, SCHEME, "")


def missing_files(local: DataFrame, present: DataFrame, root: str) -> DataFrame:
    """Local files (path) whose path below `root` is not in `present` (name)."""
    top = re.sub(SCHEME, "", root).rstrip("/") + "/"
    path = without_scheme(F.col("path"))
    relative = F.when(F.startswith(path, F.lit(top)), F.substr(path, F.lit(len(top) + 1))).otherwise(path)
    files = local.withColumn("name", relative)
    return files.join(present.select("name"), "name", "left_anti")
