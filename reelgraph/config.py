"""Typed settings: frozen dataclasses read from a JSON or YAML file or the environment.

Credentials are never stored here; model callables get theirs from wherever they run.
"""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class RetrievalSettings:
    similarity_threshold: float = 0.7
    top_k_text: int = 10
    top_k_visual: int = 5
    top_k_final: int = 15
    confidence_threshold: float = 0.6
    text_weight: float = 0.4
    visual_weight: float = 0.3
    entity_weight: float = 0.2
    temporal_weight: float = 0.1
    per_video_limit: int = 3
    diversity_min_rows: int = 5
    cache_size: int = 100
    cache_ttl_seconds: float = 3600.0


@dataclass(frozen=True)
class ProcessingSettings:
    chunk_seconds: float = 30.0
    frames_fast: int = 5
    frames_detailed: int = 15
    max_keyframes: int = 20
    scene_threshold: float = 30.0
    supported_formats: tuple[str, ...] = ("mp4", "avi", "mov", "mkv", "webm")


@dataclass(frozen=True)
class GraphSettings:
    entity_similarity_threshold: float = 0.8
    cleanup_threshold: float = 0.3
    co_occurrence_window: float = 30.0
    default_confidence: float = 0.7


@dataclass(frozen=True)
class ClusterSettings:
    heartbeat_seconds: float = 30.0
    offline_factor: float = 2.0
    dead_factor: float = 5.0
    max_retries: int = 3
    task_ttl_hours: float = 24.0


@dataclass(frozen=True)
class ChatSettings:
    max_messages: int = 50
    history_messages: int = 6
    summary_messages: int = 5


@dataclass(frozen=True)
class ModelSettings:
    name: str
    enabled: bool = True
    device: str = "auto"
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Settings:
    retrieval: RetrievalSettings = RetrievalSettings()
    processing: ProcessingSettings = ProcessingSettings()
    graph: GraphSettings = GraphSettings()
    cluster: ClusterSettings = ClusterSettings()
    chat: ChatSettings = ChatSettings()
    models: tuple[ModelSettings, ...] = ()

    def model(self, name: str) -> ModelSettings | None:
        return next((m for m in self.models if m.name == name), None)

    def is_model_enabled(self, name: str) -> bool:
        found = self.model(name)
        return bool(found and found.enabled)

    def with_model(self, name: str, **changes) -> "Settings":
        """A copy in which model ``name`` carries ``changes``; unknown names are added."""
        if self.model(name) is None:
            return replace(self, models=self.models + (ModelSettings(name, **changes),))
        return replace(self, models=tuple(replace(m, **changes) if m.name == name else m for m in self.models))

    def problems(self) -> list[str]:
        """What is wrong with these values; empty when they are usable."""
        r, p = self.retrieval, self.processing
        checks = [
            (0.0 <= r.similarity_threshold <= 1.0, "similarity_threshold must lie in [0, 1]"),
            (0.0 <= r.confidence_threshold <= 1.0, "confidence_threshold must lie in [0, 1]"),
            (min(r.top_k_text, r.top_k_visual, r.top_k_final) > 0, "top_k values must be positive"),
            (p.chunk_seconds > 0, "chunk_seconds must be positive"),
            (p.frames_fast > 0 and p.frames_detailed > 0, "frame counts must be positive"),
            (len(p.supported_formats) > 0, "at least one media format is needed"),
            (self.cluster.heartbeat_seconds > 0, "heartbeat_seconds must be positive"),
        ]
        return [message for ok, message in checks if not ok]


def settings_from_dict(data: dict) -> Settings:
    sections = {}
    for f in fields(Settings):
        raw = data.get(f.name)
        if raw is None:
            continue
        if f.name == "models":
            sections["models"] = tuple(ModelSettings(**m) for m in raw)
            continue
        kind = type(getattr(Settings(), f.name))
        known = {x.name for x in fields(kind)}
        values = {k: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k in known}
        sections[f.name] = kind(**values)
    return Settings(**sections)


def load_settings(path: str | None = None) -> Settings:
    """Read settings from a JSON or YAML file; a file that isn't there gives the defaults, one that can't be read raises."""
    if not path or not Path(path).exists():
        return Settings()
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        return settings_from_dict(yaml.safe_load(text) or {})
    return settings_from_dict(json.loads(text))


def save_settings(settings: Settings, path: str) -> None:
    Path(path).write_text(json.dumps(asdict(settings), indent=2), encoding="utf-8")


def settings_from_env(env: dict[str, str] | None = None) -> Settings:
    """Defaults overridden by ``REELGRAPH_<SECTION>_<FIELD>`` variables."""
    env = dict(os.environ) if env is None else env
    data: dict[str, dict] = {}
    for f in fields(Settings):
        if f.name == "models":
            continue
        section = getattr(Settings(), f.name)
        for x in fields(section):
            raw = env.get(f"REELGRAPH_{f.name}_{x.name}".upper())
            if raw is None:
                continue
            default = getattr(section, x.name)
            if isinstance(default, tuple):
                value = tuple(part.strip() for part in raw.split(","))
            else:
                value = type(default)(raw)
            data.setdefault(f.name, {})[x.name] = value
    return settings_from_dict(data)
