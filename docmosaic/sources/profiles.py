"""Query profiles: which collections a question is put to."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class QueryProfile:
    """Explicit collections come first, then those of the prefixes, each once."""

    collections: list[str] = field(default_factory=list)
    collection_prefixes: list[str] = field(default_factory=list)
    similarity_top_k: int | None = None
    system_prompt: str | None = None

    @classmethod
    def from_dict(cls, data: dict) -> QueryProfile:
        q = data.get("query") or {}
        named = data.get("collections") or []
        return cls(
            [c["name"] if isinstance(c, dict) else c for c in named],
            [p["name"] if isinstance(p, dict) else p for p in data.get("collection_prefixes") or []],
            q.get("similarity_top_k"),
            q.get("system_prompt"),
        )

    @classmethod
    def from_yaml(cls, path: str) -> QueryProfile:
        import yaml

        with open(path, encoding="utf-8") as f:
            return cls.from_dict(yaml.safe_load(f) or {})


def profile_collections(chunks: DataFrame, profile: QueryProfile) -> DataFrame:
    """(collection, position) of the catalogued collections a profile selects."""
    names = chunks.select("collection").distinct()
    steps = [F.when(F.col("collection") == c, F.lit(i)) for i, c in enumerate(profile.collections)]
    n = len(steps)
    steps += [
        F.when(F.startswith("collection", F.lit(f"{p}_")), F.lit(n + i))
        for i, p in enumerate(profile.collection_prefixes)
    ]
    if not steps:
        raise ValueError("the profile names no collections and no prefixes")
    # names are catalog metadata: one row per collection, so one window orders them
    place = names.select("collection", F.coalesce(*steps).alias("k")).where("k is not null")
    order = Window.orderBy("k", "collection")
    return place.select("collection", (F.row_number().over(order) - 1).cast("bigint").alias("position"))
