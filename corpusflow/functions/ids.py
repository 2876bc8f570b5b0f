"""Deterministic identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"  # the URL namespace of RFC 4122


def uuid5(name: Column, namespace: str = NAMESPACE_URL) -> Column:
    """The version-5 UUID of a name."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def chunk_id(file_hash: Column, ordinal: Column) -> Column:
    return uuid5(F.concat_ws(":", file_hash, ordinal.cast("string")))


def parent_id(file_hash: Column, number: Column) -> Column:
    return uuid5(F.concat_ws(":", file_hash, F.lit("parent"), number.cast("string")))


def fingerprint(*columns: Column | str) -> Column:
    """Hash of columns in the given order; null differs from empty."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
