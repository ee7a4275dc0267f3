"""Where the parts of a lake lie, and the settings that the environment gives."""

from __future__ import annotations

import os
from dataclasses import dataclass


@dataclass(frozen=True)
class Lake:
    root: str

    def bronze(self, pipeline: str, table: str) -> str:
        return f"{self.root}/bronze/{pipeline}/{table}"

    def silver(self, pipeline: str, table: str) -> str:
        return f"{self.root}/silver/{pipeline}/{table}"

    def quarantine(self, pipeline: str, table: str) -> str:
        return f"{self.root}/quarantine/{pipeline}/{table}"

    def control(self, pipeline: str, table: str) -> str:
        return f"{self.root}/_control/{pipeline}/{table}"

    def checkpoint(self, pipeline: str, table: str, stage: str) -> str:
        return f"{self.root}/_checkpoints/{pipeline}/{table}/{stage}"

    @property
    def audit(self) -> str:
        return f"{self.root}/audit/stage_runs"


def application(pipeline: str, table: str, sink: str) -> str:
    """The name under which a sink's transactions are counted."""
    return f"sluice.{pipeline}.{table}.{sink}"


@dataclass(frozen=True)
class Settings:
    lake: Lake
    gateway: str | None = None

    @classmethod
    def from_env(cls) -> Settings:
        return cls(Lake(os.environ.get("SLUICE_LAKE", "lake").rstrip("/")), os.environ.get("SLUICE_PUSHGATEWAY") or None)
