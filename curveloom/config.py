"""Run configuration as frozen dataclasses, kept as JSON."""

from __future__ import annotations

import json
import logging
import time
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from pathlib import Path

from .sources.files import PointFile


@dataclass(frozen=True)
class Output:
    path: str = "-"
    id_name: str = "id"
    category_name: str = "category"
    header: bool = True
    log_file: str = ""
    log_level: str = "info"


@dataclass(frozen=True)
class Index:
    """Bits a dimension (-1: those of the largest value) and what the search for an order may cost."""

    bits: int = -1
    outlier_size: int = 5
    noise_skip: int = 10
    max_trials: int = 1000
    parallel_trials: int = 4
    patience: int = 3
    strategy: str = "halving"


@dataclass(frozen=True)
class Classifier:
    neighbors: int = 5
    exact_distance: bool = False
    outlier_factor: float = 5.0
    merge_distance: int = 0


@dataclass(frozen=True)
class Density:
    skip: bool = False
    window: int = 50
    radius_factor: float = 0.4
    unmergeable_fraction: float = 1 / 6
    mergeable_shrinkage: float = 0.0


@dataclass(frozen=True)
class Config:
    input: str = "-"
    data: PointFile = field(default_factory=PointFile)
    output: Output = field(default_factory=Output)
    index: Index = field(default_factory=Index)
    classifier: Classifier = field(default_factory=Classifier)
    density: Density = field(default_factory=Density)
    acceptable_b_cubed: float = 0.98

    def write(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2) + "\n")

    @staticmethod
    def read(path: str) -> Config:
        d = json.loads(Path(path).read_text())
        parts = {"data": PointFile, "output": Output, "index": Index, "classifier": Classifier, "density": Density}
        return Config(**{k: parts[k](**v) if k in parts else v for k, v in d.items()})


class Timers:
    """Named stage times in the order they began."""

    def __init__(self):
        self.spent: dict[str, float] = {}

    @contextmanager
    def stage(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.spent[name] = self.spent.get(name, 0.0) + time.perf_counter() - began

    def log(self) -> None:
        for name, s in self.spent.items():
            logging.getLogger("curveloom").info("%s: %.3f s", name, s)


def log_to(output: Output) -> None:
    """Messages of the library to the configured file, or to standard error for ``-`` and no name, from the configured level on."""
    log = logging.getLogger("curveloom")
    for h in list(log.handlers):
        log.removeHandler(h)
    log.addHandler(logging.StreamHandler() if output.log_file in ("", "-") else logging.FileHandler(output.log_file))
    log.setLevel(output.log_level.upper())
    log.propagate = False
