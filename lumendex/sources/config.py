"""Index configuration from TOML."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from lumendex.functions.paths import context_id
from lumendex.operators.chunkers import CHUNKERS, ItemFilter
from lumendex.operators.search import DEFAULT_RULES, BoostRule

_KEYS = {"enabled-file-types", "targets", "file-types", "boost-rules"}


@dataclass
class Config:
    enabled: tuple[str, ...] | None = None  # None: the chunkers that are on by default
    targets: tuple[str, ...] = ()
    languages: dict[str, dict] = field(default_factory=dict)
    rules: tuple[BoostRule, ...] = DEFAULT_RULES
    exists: bool = False

    def filters(self) -> dict[str, ItemFilter | None]:
        """Enabled context types and their item filters. Without a file every language is on with its
        default filter; with one, a language without a section has no filter at all."""
        if not self.exists:
            return {k: c.default_filter for k, c in CHUNKERS.items()}
        on = [k for k, c in CHUNKERS.items() if c.default_on] if self.enabled is None else [context_type(n) for n in self.enabled]
        out: dict[str, ItemFilter | None] = {k: None for k in on if k in CHUNKERS}
        for name, section in self.languages.items():
            kind = context_type(name)
            if kind in CHUNKERS:
                out[kind] = item_filter(kind, section)
        return out


def context_type(name: str) -> str:
    return next((k for k, c in CHUNKERS.items() if name in c.config_keys), name)


def item_filter(kind: str, section: dict) -> ItemFilter:
    unknown = set(section) - {"visibility", "items", "min-doc-lines"}
    if unknown:
        raise ValueError(f"unknown keys of {kind}: {sorted(unknown)}")
    default = CHUNKERS[kind].default_filter
    vis = section.get("visibility", default.visibility)
    return ItemFilter(tuple(vis) if vis is not None else None, tuple(section.get("items", default.items)), int(section.get("min-doc-lines", 0)))


def parse(text: str) -> Config:
    raw = tomllib.loads(text)
    unknown = set(raw) - _KEYS
    if unknown:
        raise ValueError(f"unknown keys: {sorted(unknown)}")
    rules = tuple(BoostRule(r["pattern"], float(r.get("multiplier", 1.0)), r.get("description", "")) for r in raw.get("boost-rules", ()))
    targets = tuple(context_id(t) for t in raw.get("targets", ()))
    enabled = raw.get("enabled-file-types")
    cfg = Config(tuple(enabled) if enabled is not None else None, targets, raw.get("file-types", {}), rules if "boost-rules" in raw else DEFAULT_RULES, True)
    cfg.filters()  # malformed sections fail here
    return cfg


def load(path: str | Path) -> Config:
    p = Path(path)
    return parse(p.read_text()) if p.exists() else Config()
