"""Settings of a tuning run, read on the driver and checked as a whole."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, fields
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values.
MODES = ("actor_only", "speculator_only", "dual")
KINDS = ("convergence", "reaction")
POSITIVE = ("latency_ns", "window_duration_s", "run_duration_s", "threads", "cpu_max_prime", "perturbation_min_granularity_ns", "request_timeout_s")


@dataclass(frozen=True)
class RunConfig:
    mode: str
    run_kind: str = "convergence"
    latency_ns: int = 1000
    min_granularity_range_ns: tuple[int, int] = (50_000, 50_000_000)
    window_duration_s: int = 1
    run_duration_s: int = 200
    threads: int = 40
    cpu_max_prime: int = 50_000
    perturbation_min_granularity_ns: int = 10_000_000
    request_timeout_s: float = 30.0
    further: dict[str, Any] = field(default_factory=dict)

    def problems(self) -> list[str]:
        low, high = self.min_granularity_range_ns
        checks = {f"mode isn't among {MODES}": self.mode in MODES, f"run_kind isn't among {KINDS}": self.run_kind in KINDS, "min_granularity_range_ns needs two positive numbers in rising order": 0 < low < high}
        checks |= {f"{n} isn't above zero": getattr(self, n) > 0 for n in POSITIVE}
        checks["whole windows must fill run_duration_s"] = self.window_duration_s <= 0 or self.run_duration_s % self.window_duration_s == 0
        return [text for text, ok in checks.items() if not ok]

    @property
    def iterations(self) -> int:
        return self.run_duration_s // self.window_duration_s


def flat_yaml(text: str) -> dict[str, Any]:
    """The settings of a YAML file of `name: value` lines, its values being numbers, truth values, lists in brackets or strings."""
    got = {}
    for line in text.split("\n"):
        name, colon, value = re.sub(r"(^|\s)#.*", "", line).partition(":")
        if colon and name.strip():
            value = value.strip()
            try:
                got[name.strip()] = json.loads(value)
            except ValueError:
                got[name.strip()] = value.strip("'\"")
    return got


def parse(text: str) -> RunConfig:
    raw = json.loads(text) if text.lstrip().startswith("{") else flat_yaml(text)
    known = {f.name for f in fields(RunConfig)} - {"further"}
    if "min_granularity_range_ns" in raw:
        raw["min_granularity_range_ns"] = tuple(raw["min_granularity_range_ns"])
    got = RunConfig(**{k: v for k, v in raw.items() if k in known}, further={k: v for k, v in raw.items() if k not in known})
    if wrong := got.problems():
        raise ValueError("; ".join(wrong))
    return got


def checked(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, iterations, problems) of each settings text: iterations is null if there are problems."""
    kind = texts.schema[key].dataType.simpleString()

    def one(t: str) -> tuple[int | None, str]:
        try:
            return parse(t).iterations, ""
        except (ValueError, TypeError) as e:
            return None, str(e)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [one(t) for t in b[text]]
            yield pd.DataFrame({key: b[key], "iterations": pd.array([i for i, _ in got], "Int64"), "problems": [p for _, p in got]})

    return texts.select(key, F.col(text)).mapInPandas(run, f"{key} {kind}, iterations long, problems string")
