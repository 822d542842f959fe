"""Text helpers: paths, prefixes, versions, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPECIAL = r"[|@#!¡·$€%&()=?¿^*;:,¨´><+]"


def clean(text: Column) -> Column:
    """Special characters become underscores."""
    return F.regexp_replace(text, SPECIAL, "_")


def numeric_prefix(stem: Column) -> Column:
    """The stem without a trailing _digits."""
    return F.regexp_replace(stem, r"_\d+$", "")


def last_prefix(stem: Column) -> Column:
    """The stem up to its last underscore."""
    return F.regexp_replace(stem, r"_[^_]*$", "")


def label_path(image_path: Column) -> Column:
    """The last /images/ becomes /labels/, the extension .txt."""
    return F.regexp_replace(F.regexp_replace(image_path, r"^(.*)/images/", "$1/labels/"), r"\.[^./]*$", ".txt")


def label_path_everywhere(image_path: Column) -> Column:
    """Every /images/ becomes /labels/, the extension .txt."""
    return F.regexp_replace(F.replace(image_path, F.lit("/images/"), F.lit("/labels/")), r"\.[^./]*$", ".txt")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def class_folder(path: Column) -> Column:
    return F.regexp_extract(path, r"/([^/]+)/[^/]+$", 1)


def version_at_least(version: Column, least: str) -> Column:
    """Numeric comparison of dotted versions."""
    return F.transform(F.split(version, r"\."), lambda x: x.cast("int")) >= F.array(*(F.lit(int(x)) for x in least.split(".")))


def is_ascii(text: Column) -> Column:
    return ~text.rlike(r"[^\x00-\x7F]")


def is_chinese(text: Column) -> Column:
    return text.rlike("[一-鿿]")


def upright_size(width: Column, height: Column, orientation: Column) -> tuple[Column, Column]:
    """Width and height after the EXIF orientation: quarter turns swap them."""
    turned = orientation.isin(6, 8)
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)


def is_url(c: Column) -> Column:
    """Whether a text has a scheme and a host; nothing is fetched."""
    return F.coalesce(c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), F.lit(False))


def age_in_days(modified: Column, now: Column) -> Column:
    """Whole days between two times."""
    return F.floor((F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(modified.cast("timestamp"))) / 86400).cast("long")


def plain_date(modified: Column) -> Column:
    """Year-month-day without leading zeros."""
    return F.concat_ws("-", F.year(modified).cast("string"), F.month(modified).cast("string"), F.day(modified).cast("string"))


def frame_name(stem_: Column, is_image: Column, frame: Column) -> Column:
    """Name of an output file: the stem, with the frame number for videos."""
    return F.when(is_image, stem_).otherwise(F.concat(stem_, F.lit("_"), frame.cast("string")))
