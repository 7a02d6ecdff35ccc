"""Settings: a task's own over the common ones, unknown names rejected."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import Any


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 5000
    minimum_tail: int = 500
    n_fraction_limit: float = 0.2
    identity: float = 0.95
    coverage: float = 0.85
    kmers_per_fragment: int = 80
    genome_ani: float = 0.95
    genome_fraction: float = 0.85
    train: float = 0.8
    validation: float = 0.1
    inference: float = 0.1
    seed: int = 0
    label_smoothing: float = 0.05
    class_weight_power: float = 0.5
    bootstrap_repeats: int = 200
    reliability_bins: int = 10
    reject_below: float = 0.8
    minimum_train_genomes_per_taxon: int = 5

    @property
    def ratios(self) -> dict[str, float]:
        return {"train": self.train, "validation": self.validation, "inference": self.inference}


def merge(common: dict[str, Any], task: dict[str, Any] | None = None) -> Settings:
    known = {f.name for f in fields(Settings)}
    merged = {**common, **(task or {})}
    if unknown := sorted(set(merged) - known):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    found = replace(Settings(), **merged)
    if abs(sum(found.ratios.values()) - 1) > 1e-9:
        raise ValueError("the split ratios do not add up to 1")
    return found
