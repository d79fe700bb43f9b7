"""Settings with their defaults; a session's `spark.scenograph.<name>` overrides each."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    identity_strong: float = 0.75
    identity_keep: float = 0.62
    content_least: float = 0.10
    content_strong: float = 0.35
    top_k: int = 5
    most_aliases: int = 8
    longest_description: int = 800
    least_name_cosine: float = 0.75
    scene_cap: int = 4096
    scene_floor: int = 128
    scene_limit: int = 8192
    context_tokens: int = 65_536
    context_gate: float = 0.7
    most_iterations: int = 20

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        read = {f.name: spark.conf.get(f"spark.scenograph.{f.name}", None) for f in fields(cls)}
        return cls(**{f.name: type(f.default)(read[f.name]) for f in fields(cls) if read[f.name] is not None})
