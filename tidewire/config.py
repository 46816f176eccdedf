"""Settings of jobs: ``key=value`` arguments over defaults. Unknown keys are an error."""

from __future__ import annotations

from dataclasses import dataclass, fields
from pathlib import Path

from tidewire.sources.sinks import file_name


@dataclass
class Config:
    """Settings with their defaults; a count of -1 is all, a threshold of -1 or a rate of 0 is the experiment's own."""

    job: str = "test"
    data: str = "data"
    out: str = ""
    count: int = -1
    fraction: float = 1.0
    partitions: int = 50
    buckets: int = 10
    category: str = ""
    start: str = ""
    confidence: float = 0.5
    types: bool = False
    broad_match: bool = True
    super_sample: bool = False
    features: str = "bow"
    threshold: int = -1
    size: int = 64
    hidden: int = 10
    layers: str = "700,500"
    bow_layers: str = "1000"
    rate: float = 0.0
    batch: int = 50
    rounds: int = 2
    parallelism: int = 1
    seed: int = 123
    level: int = 0
    tag: str = ""

    @classmethod
    def of(cls, args: list[str]) -> Config:
        """Settings of arguments."""
        kinds = {f.name: type(f.default) for f in fields(cls)}
        made = {}
        for arg in args:
            key, given, value = arg.partition("=")
            if not given or key not in kinds:
                raise SystemExit(f"unknown argument: {arg}")
            made[key] = value.lower() in ("true", "1", "yes") if kinds[key] is bool else kinds[key](value)
        return cls(**made)

    @property
    def limit(self) -> int | None:
        return None if self.count < 0 else self.count

    @property
    def run_name(self) -> str:
        """A file name that tells runs apart: job, tag and what differs from the defaults."""
        other = [f"{f.name}={getattr(self, f.name)}" for f in fields(self) if f.name not in ("job", "tag", "data", "out") and getattr(self, f.name) != f.default]
        return file_name(" ".join(filter(None, [self.job, self.tag, *other])))

    def path(self, *parts: str) -> str:
        """A path below the output folder."""
        return "/".join([self.out.rstrip("/"), *map(file_name, parts)])

    def local(self, name: str) -> Path:
        """A path of a local file, in the form of this system."""
        return Path(name).expanduser()
