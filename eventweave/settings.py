"""Settings of a run, from a session's configuration or any mapping of texts."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

RUN_MODES = ("benchmark", "open_world")
_TRUE = ("1", "true", "yes", "on")
PREFIX = "spark.eventweave."


@dataclass(frozen=True)
class Settings:
    """What a run may change. Counts are at least 1 and the relevance threshold lies within 0 and 1, whatever is asked."""

    run_mode: str = "benchmark"
    event_type_mode: str = "closed_set"
    enable_search: bool = False
    search_max_results: int = 5
    search_top_k: int = 3
    search_min_relevance: float = 0.18
    rag_index_root: str = "data/rag/indexes"
    rag_default_top_k: int = 3
    rag_text_top_k: int = 3
    rag_image_top_k: int = 3
    rag_bridge_top_k: int = 3
    rag_enable_image_query: bool = True
    rag_embedding_dims: int = 0
    perception_enabled: bool = False
    perception_cache: bool = True
    model_timeout_seconds: float = 30.0
    repair_attempts: int = 3
    image_iou: float = 0.5

    @property
    def search(self) -> bool:
        """Whether evidence is looked up: only in open-world runs that ask for it."""
        return self.run_mode == "open_world" and self.enable_search

    def top_k(self) -> dict[str, int]:
        """How many examples each layer retrieves."""
        return {"text": self.rag_text_top_k, "image": self.rag_image_top_k, "bridge": self.rag_bridge_top_k}

    @classmethod
    def of(cls, given: Mapping[str, str]) -> Settings:
        """Settings of texts by field name. A text that doesn't read as a field's kind counts as not given; an unknown run mode is the default one."""
        made: dict[str, object] = {}
        for field in fields(cls):
            text = given.get(field.name)
            if text is None:
                continue
            text = str(text).strip()
            try:
                if isinstance(field.default, bool):
                    value: object = text.lower() in _TRUE
                elif isinstance(field.default, int):
                    value = max(0 if field.name == "rag_embedding_dims" else 1, int(text))
                elif isinstance(field.default, float):
                    value = float(text)
                else:
                    value = text or field.default
            except ValueError:
                continue
            made[field.name] = value
        made["run_mode"] = mode if (mode := str(made.get("run_mode", "benchmark")).lower()) in RUN_MODES else "benchmark"
        made["search_min_relevance"] = max(0.0, min(1.0, float(made.get("search_min_relevance", cls.search_min_relevance))))
        return cls(**made)

    @classmethod
    def from_session(cls, spark: SparkSession) -> Settings:
        """Settings of a session's ``spark.eventweave.*`` configuration."""
        return cls.of({f.name: spark.conf.get(PREFIX + f.name) for f in fields(cls) if spark.conf.get(PREFIX + f.name, None) is not None})
