"""Source descriptors, their checks, and the registry."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame

from .normalize import NORMALIZERS


@dataclass(frozen=True)
class Descriptor:
    """What a source offers: its streams, how its cursor moves, and the limits it asks readers to keep."""

    source_id: str
    version: str
    cursor: str  # timestamp | token | integer | none
    kinds: tuple[str, ...]
    scopes: dict[str, str] = field(default_factory=dict)  # scope -> why it is needed
    rate_per_second: float = 1.0
    burst: int = 5
    page_size: int = 100
    supports_deletes: bool = False

    def to_dict(self) -> dict:
        return asdict(self)


def problems(d: Descriptor) -> list[str]:
    """What a descriptor lacks; empty if it may be registered."""
    out = [f"scope {s!r} is not justified" for s, why in d.scopes.items() if not why.strip()]
    if not (d.rate_per_second > 0 and d.burst >= 1 and 1 <= d.page_size <= 1000):
        out.append("limits must be positive, pages of at most 1000")
    if d.cursor not in ("timestamp", "token", "integer", "none"):
        out.append(f"unknown cursor {d.cursor!r}")
    if not re.fullmatch(r"\d+\.\d+\.\d+", d.version):
        out.append("version must have three numbers")
    return out


class Registry:
    def __init__(self):
        self._of: dict[str, tuple[Descriptor, Callable[[DataFrame], dict[str, DataFrame]]]] = {}

    def register(self, d: Descriptor, normalize: Callable[[DataFrame], dict[str, DataFrame]]) -> None:
        if found := problems(d):
            raise ValueError("; ".join(found))
        if d.source_id in self._of:
            raise ValueError(f"{d.source_id} is registered already")
        self._of[d.source_id] = (d, normalize)

    def get(self, source_id: str) -> Descriptor:
        if source_id not in self._of:
            raise KeyError(f"unknown source {source_id!r}; known are {', '.join(self.ids())}")
        return self._of[source_id][0]

    def normalizer(self, source_id: str):
        self.get(source_id)
        return self._of[source_id][1]

    def ids(self) -> list[str]:
        return sorted(self._of)

    def describe(self) -> list[dict]:
        return [self._of[i][0].to_dict() for i in self.ids()]


def builtin() -> Registry:
    out = Registry()
    cursors = {"slack": "timestamp", "gmail": "token", "discord": "token", "whatsapp": "integer", "gdrive": "token", "onedrive": "token", "dropbox": "token", "notion": "timestamp", "evernote": "integer", "youtube": "token"}
    kinds = {"gdrive": ("file",), "onedrive": ("file",), "dropbox": ("file",), "notion": ("note",), "evernote": ("note",), "youtube": ("video", "transcript"), "gmail": ("email", "file")}
    for name, run in NORMALIZERS.items():
        out.register(Descriptor(name, "1.0.0", cursors[name], kinds.get(name, ("message", "file")), supports_deletes=name in ("onedrive", "dropbox")), run)
    return out
