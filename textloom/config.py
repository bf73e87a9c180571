"""Settings of a run from YAML, with unknown keys refused and values checked."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields, replace


@dataclass(frozen=True)
class Analysis:
    content_format: str = "markdown"
    reserved_tokens: int = 16
    target_utilization: float = 0.95
    overlap: int = 128
    longest: int = 50

    def check(self) -> list[str]:
        bad = [] if self.content_format in ("markdown", "html", "auto") else ["content_format"]
        bad += [] if 0 < self.target_utilization <= 1 else ["target_utilization"]
        return bad + [n for n in ("reserved_tokens", "overlap") if getattr(self, n) < 0] + (["longest"] if self.longest < 1 else [])


@dataclass(frozen=True)
class Preparation:
    max_seq_length: int = 20_000
    reserved_tokens: int = 16
    validation: float = 0.10
    test: float = 0.10
    seed: int = 3407
    keep_empty: bool = False

    def check(self) -> list[str]:
        bad = [] if 0 <= self.reserved_tokens < self.max_seq_length else ["max_seq_length"]
        return bad + ([] if min(self.validation, self.test) >= 0 and self.validation + self.test < 1 else ["validation"])


@dataclass(frozen=True)
class Evaluation:
    documents: int = 200
    context: int = 8192
    stride: int = 1024
    max_total: int = 20_000
    max_generation: int = 1024
    fallback_prefix: int = 1024
    min_reference: int = 128

    def check(self) -> list[str]:
        bad = [f.name for f in fields(self) if getattr(self, f.name) < 1]
        return bad + (["stride"] if self.stride > self.context else [])


@dataclass(frozen=True)
class Training:
    """What the arithmetic of a training run needs; the training itself is not done here."""

    batch: int = 1
    accumulation: int = 16
    epochs: float = 1.0
    warmup: float = 0.03
    eval_steps: int = 100
    logging_steps: int = 10
    max_steps: int = 0
    pad_multiple: int = 8
    kept_checkpoints: int = 3

    def check(self) -> list[str]:
        bad = [n for n in ("batch", "accumulation", "epochs", "eval_steps", "logging_steps", "pad_multiple", "kept_checkpoints") if getattr(self, n) <= 0]
        return bad + [n for n in ("max_steps",) if getattr(self, n) < 0] + ([] if 0 <= self.warmup < 1 else ["warmup"])


@dataclass(frozen=True)
class Settings:
    analysis: Analysis = field(default_factory=Analysis)
    preparation: Preparation = field(default_factory=Preparation)
    evaluation: Evaluation = field(default_factory=Evaluation)
    training: Training = field(default_factory=Training)

    def checked(self) -> Settings:
        bad = [f"{f.name}.{name}" for f in fields(self) for name in getattr(self, f.name).check()]
        if bad:
            raise ValueError(f"bad settings: {', '.join(bad)}")
        return self

    def key(self) -> str:
        """Names results of these settings: the first 16 hex digits of a hash."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]


def settings(values: dict | None, overrides: dict[str, object] | None = None) -> Settings:
    """Settings from sections of keys, and overrides like ``{"evaluation.stride": 512}``; NULL overrides nothing."""
    kinds = {f.name: type(getattr(Settings(), f.name)) for f in fields(Settings)}
    parts: dict[str, dict] = {name: {} for name in kinds}
    given = dict(values or {})
    for path, value in (overrides or {}).items():
        if value is not None:
            section, _, key = path.partition(".")
            given[section] = {**(given.get(section) or {}), key: value}
    for section, keys in given.items():
        if section not in kinds:
            raise KeyError(f"unknown section {section!r}")
        if unknown := sorted(set(keys or {}) - {f.name for f in fields(kinds[section])}):
            raise KeyError(f"unknown keys in {section}: {unknown}")
        parts[section] = dict(keys or {})
    return Settings(**{name: replace(kinds[name](), **parts[name]) for name in kinds}).checked()


def load_settings(path: str, overrides: dict[str, object] | None = None) -> Settings:
    import yaml

    with open(path, encoding="utf-8") as f:
        return settings(yaml.safe_load(f), overrides)
