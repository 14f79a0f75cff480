"""Settings of a database, by profile or out of TOML.

Parquet files are the log, so there is no buffer, sync mode or worker to set: what is left is whether transactions may define attributes
and how many uncompacted transactions may pile up.
"""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path

from tesserae.errors import SerializationError


@dataclass(frozen=True)
class Settings:
    #: Whether a transaction may use attributes that are not yet defined.
    infer_schema: bool = True
    #: Compacts after the transaction that leaves this many uncompacted ones; 0: only when compact() is called. Now and then that rewrites
    #: large files, so a large log is better compacted by a job of its own.
    compact_after: int = 0

    @classmethod
    def for_profile(cls, name: str) -> "Settings":
        """embedded, balanced or server."""
        if name not in PROFILES:
            raise SerializationError(f"no profile {name}")
        return PROFILES[name]

    @classmethod
    def from_toml(cls, text: str) -> "Settings":
        """Settings by name in the table [database], over those of its `profile` (balanced where it gives none)."""
        try:
            given = dict(tomllib.loads(text).get("database", {}))
        except tomllib.TOMLDecodeError as e:
            raise SerializationError(f"TOML: {e}") from e
        base = cls.for_profile(given.pop("profile", "balanced"))
        for f in fields(cls):
            if f.name in given and type(given[f.name]) is not type(getattr(base, f.name)):
                raise SerializationError(f"{f.name} is of type {f.type}")
        if unknown := sorted(set(given) - {f.name for f in fields(cls)}):
            raise SerializationError("no setting " + ", ".join(unknown))
        return replace(base, **given)

    @classmethod
    def load(cls, path: str) -> "Settings":
        """Those of a TOML file, or the balanced profile's where there is no file."""
        file = Path(path)
        return cls.from_toml(file.read_text()) if file.exists() else cls.for_profile("balanced")


PROFILES = {"embedded": Settings(compact_after=8), "balanced": Settings(compact_after=64), "server": Settings()}
