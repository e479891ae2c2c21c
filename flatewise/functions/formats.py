"""Formats and names: by extension, by first bytes, and of outputs. Column expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First bytes, and suffix, of each format (fixed values).
MAGIC = {"gzip": "1F8B", "zlib": "78", "zip": "504B0304"}
SUFFIX = {"gzip": ".gz", "zlib": ".zz", "zip": ".zip"}


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1)


def format_of_extension(path: Column) -> Column:
    """gzip, zlib or zip, else null."""
    ext = F.lower(extension(path))
    return F.when(ext.isin("gz", "gzip"), "gzip").when(ext == "zz", "zlib").when(ext == "zip", "zip")


def format_of_path(path: Column) -> Column:
    return F.coalesce(format_of_extension(path), F.lit("gzip"))


def format_of_bytes(content: Column) -> Column:
    """By the first bytes; null where none of the formats fits."""
    first = F.hex(F.substring(content, 1, 4))
    return F.when(F.startswith(first, F.lit(MAGIC["gzip"])), "gzip").when(F.startswith(first, F.lit(MAGIC["zip"])), "zip").when(F.startswith(first, F.lit(MAGIC["zlib"])), "zlib")


def is_compressed(path: Column) -> Column:
    return format_of_extension(path).isNotNull()


def compressed_name(path: Column, force: Column, suffix: Column) -> Column:
    """The suffix is appended; under force the last extension (and .tar before it) goes first."""
    bare = F.regexp_replace(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), r"(?<=[^/])\.tar$", "")
    base = F.when(force & (extension(path) != ""), bare).otherwise(path)
    return F.concat(base, F.when(F.startswith(suffix, F.lit(".")), suffix).otherwise(F.concat(F.lit("."), suffix)))


def decompressed_name(path: Column, stdout: Column) -> Column:
    """A known extension goes; else .out is appended; unchanged for stdout."""
    bare = F.regexp_replace(path, r"\.[^./]+$", "")
    return F.when(stdout, path).when(is_compressed(path), bare).otherwise(F.concat(path, F.lit(".out")))
