"""Settings: bounded, immutable, merged from stored values and the environment (which wins)."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields, replace

SECRETS = ("store_token", "model_key", "notify_token")
#: name -> (least, most) of what shapes results
BOUNDS = {"ocr_min_chars": (1, 1000), "chunk_chars": (2000, 100_000), "candidate_limit": (10, 500), "reduce_batch": (4, 50), "min_confidence": (0.0, 1.0), "max_attempts": (1, 10), "lease_seconds": (60, 7200), "page_concurrency": (1, 16)}


def clean_url(url: str) -> str:
    url = url.strip().rstrip("/")
    if url and not url.startswith(("http://", "https://")):
        raise ValueError("URL must start with http:// or https://")
    return url


@dataclass(frozen=True)
class Settings:
    store_url: str = ""
    store_token: str = ""
    model_url: str = ""
    model_key: str = ""
    notify_topic: str = ""
    notify_token: str = ""
    notifications: bool = False
    ocr_min_chars: int = 24
    chunk_chars: int = 12_000
    candidate_limit: int = 80
    reduce_batch: int = 16
    min_confidence: float = 0.68
    apply_mode: str = "missing_only"
    allow_new_tags: bool = True
    allow_new_correspondents: bool = True
    allow_new_types: bool = True
    allow_new_fields: bool = False
    hidden_tags: str = ""
    queue_tag: str = ""
    context_tokens: int = 16_384
    output_tokens: int = 4_096
    max_attempts: int = 3
    lease_seconds: int = 900
    page_concurrency: int = 1
    keep_original_version: bool = True

    def __post_init__(self):
        put = lambda name, value: object.__setattr__(self, name, value)
        for name in ("store_url", "model_url"):
            put(name, clean_url(getattr(self, name)))
        for name, (low, high) in BOUNDS.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must lie between {low} and {high}")
        if self.apply_mode not in ("missing_only", "overwrite"):
            raise ValueError("apply_mode must be missing_only or overwrite")
        if not re.fullmatch(r"[A-Za-z0-9_-]*", self.notify_topic):
            raise ValueError("a topic holds letters, digits, - and _ only")
        if self.notifications and not self.notify_topic:
            raise ValueError("notifications need a topic")
        if self.context_tokens - self.output_tokens < 2048:
            raise ValueError("the context must leave 2048 tokens for input")
        put("queue_tag", " ".join(self.queue_tag.split()))
        put("hidden_tags", ", ".join(dict.fromkeys(x for x in (" ".join(p.split()) for p in self.hidden_tags.split(",")) if x)))
        put("chunk_chars", min(self.chunk_chars, max(2000, (self.context_tokens - self.output_tokens - 1000) * 3)))

    def public(self) -> dict:
        """Without secrets; whether each is set."""
        return {k: v for k, v in asdict(self).items() if k not in SECRETS} | {f"{k}_configured": bool(getattr(self, k)) for k in SECRETS}

    def updated(self, changes: Mapping, environment: Mapping | None = None) -> Settings:
        """With changes; unknown names are errors, and the environment still wins."""
        names = {f.name for f in fields(self)}
        if unknown := set(changes) - names:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return replace(self, **(dict(changes) | from_environment(environment or {})))


def from_environment(environment: Mapping[str, str], prefix: str = "SCRIPTORIUM_") -> dict:
    found = {}
    for f in fields(Settings):
        if (raw := environment.get(prefix + f.name.upper())) is not None:
            found[f.name] = raw.strip().lower() in ("1", "true", "yes", "on") if f.type == "bool" else {"int": int, "float": float}.get(f.type, str)(raw)
    return found


def load(stored: str | None, environment: Mapping[str, str], renamed: Mapping[str, str] = {}) -> Settings:
    """From stored JSON (old names renamed, unknown ones left out) and the environment."""
    names = {f.name for f in fields(Settings)}
    kept = {renamed.get(k, k): v for k, v in (json.loads(stored) if stored else {}).items()}
    return Settings(**({k: v for k, v in kept.items() if k in names} | from_environment(environment)))
