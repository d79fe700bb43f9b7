"""Identifiers as column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def tenant_hash(name: Column | str) -> Column:
    """First 8 hex digits of the md5 of a novel's folder."""
    return F.substring(F.md5(F.col(name) if isinstance(name, str) else name), 1, 8)


def scene_key(novel: str = "novel_hash", vol: str = "vol_num", scene: str = "scene_index") -> Column:
    return F.concat(F.col(novel), F.lit(":vol"), F.col(vol).cast("string"), F.lit(":scene"), F.col(scene).cast("string"))


def uuid5(key: Column, namespace: uuid.UUID = uuid.NAMESPACE_DNS) -> Column:
    """Version 5 UUID of a text key: sha1 of namespace and key with the version and variant bits set, on the JVM side."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), key.cast("binary")))
    # the variant's two bits are set in the 17th hex digit: 8 + its value modulo 4
    variant = F.substr(F.lit("89ab89ab89ab89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1), F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
