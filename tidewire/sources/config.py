"""Settings: defaults, YAML or JSON file, dotenv file, environment and keyword arguments, in rising precedence."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from ..functions import timewin

GROUP_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]{0,63}")


@dataclass(frozen=True)
class Group:
    """A tenant: its channels and the settings it overrides."""

    id: str
    channels: tuple[str, ...] = ()
    enabled: bool = True
    variant: str = "news"
    overrides: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Settings:
    poll_seconds: int = 60
    batch: int = 20
    pending_multiplier: int = 5
    min_score: int = 7
    news_max_age_seconds: int = 1800
    daily_calls: int = 288
    min_call_interval_seconds: int = 180
    timezone: str = "Asia/Shanghai"
    quiet_hours: str = "00:00-08:00"
    shoulder_hours: str = "22:00-00:00"
    quiet_card_cap: int = 5
    groups: tuple[Group, ...] = ()

    def __post_init__(self):
        timewin.zone(self.timezone)
        timewin.Span.parse(self.quiet_hours)
        timewin.Span.parse(self.shoulder_hours)
        if not 1 <= self.min_score <= 10 or self.batch < 1 or self.poll_seconds < 1:
            raise ValueError("a setting is out of range")
        taken: dict[str, str] = {}
        for g in self.groups:
            if not GROUP_ID.fullmatch(g.id):
                raise ValueError(f"not a group id: {g.id!r}")
            for c in g.channels:
                if taken.setdefault(c, g.id) != g.id:
                    raise ValueError(f"channel {c} is in groups {taken[c]} and {g.id}")
        if len({g.id for g in self.groups}) < len(self.groups):
            raise ValueError("group ids repeat")

    def of(self, group: Group, name: str):
        """A group's value of a setting; an empty window text disables the window."""
        return group.overrides.get(name, getattr(self, name))

    def active(self) -> list[Group]:
        """Groups to process: enabled and with channels; without any group, one named legacy."""
        return [g for g in self.groups if g.enabled and g.channels] if self.groups else [Group("legacy")]


def channels(value) -> tuple[str, ...]:
    """Channel names from a list, a JSON array or a comma-separated text: lower case, no leading @, each once."""
    if isinstance(value, str):
        value = json.loads(value) if value.strip().startswith("[") else re.split(r"[,\n]", value)
    return tuple(dict.fromkeys(c for v in value or () if (c := str(v).strip().lower().lstrip("@"))))


def read_dotenv(path: str | Path) -> dict[str, str]:
    """KEY=value lines; comments, export and quotes are understood."""
    out = {}
    for line in Path(path).read_text("utf-8").splitlines():
        line = line.strip().removeprefix("export ")
        if line and not line.startswith("#") and "=" in line:
            k, v = (x.strip() for x in line.split("=", 1))
            out[k] = v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "'\"" else v.split(" #")[0].strip()
    return out


def read_file(path: str | Path) -> dict:
    text = Path(path).read_text("utf-8")
    if str(path).endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text) or {}


def load(path: str | Path | None = None, dotenv: str | Path | None = None, environ: dict | None = None, prefix: str = "TIDEWIRE_", **kwargs) -> Settings:
    values: dict = dict(read_file(path)) if path else {}
    for source in (read_dotenv(dotenv) if dotenv else {}, os.environ if environ is None else environ):
        folded = {k.upper(): v for k, v in source.items()}
        values |= {f.name: folded[prefix + f.name.upper()] for f in fields(Settings) if f.name != "groups" and prefix + f.name.upper() in folded}
    values |= kwargs
    known = {f.name: f for f in fields(Settings)}
    groups = tuple(g if isinstance(g, Group) else Group(g["id"], channels(g.get("channels")), g.get("enabled", True), g.get("variant", "news"), {k: v for k, v in g.items() if k in known}) for g in values.pop("groups", ()))
    plain = {k: int(v) if isinstance(getattr(Settings, k), int) else str(v) for k, v in values.items() if k in known}
    return replace(Settings(), **plain, groups=groups)


def topic_policy(path: str | Path) -> dict[str, dict]:
    """A topic policy: 'default' and group blocks of enabled and flat patterns; categories hold a text or list each."""
    raw = read_file(path)

    def flat(block: dict) -> dict:
        found = block.get("categories", block.get("patterns", ()))
        values = found.values() if isinstance(found, dict) else [found]
        patterns = [p for v in values for p in ([v] if isinstance(v, str) else v or ()) if isinstance(p, str)]
        return {"enabled": bool(block.get("enabled", True)), "patterns": patterns}

    return {"default": flat(raw.get("default") or {"enabled": False})} | {k: flat(v or {}) for k, v in (raw.get("groups") or {}).items()}
