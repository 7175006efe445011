"""Parameters of the workflows; the defaults are fixed values of the methods."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CleaningParams:
    min_raw_length: int = 6  # genotype strings have to be longer
    max_sample_missing: float = 0.30
    max_marker_missing: float = 0.20
    min_balance: float = 0.10
    max_balance: float = 0.90
    max_isolated_flip: float = 0.12


@dataclass(frozen=True)
class HmmParams:
    match: float = 0.98
    mismatch: float = 0.02
    missing: float = 0.5
    per_bp: float = 1e-8
    min_switch: float = 1e-6
    max_switch: float = 0.05
    close_bp: int = 2_000_000


@dataclass(frozen=True)
class SwitchParams:
    min_run_markers: int = 2
    min_run_bp: int = 1_000_000
    close_bp: int = 2_000_000


@dataclass(frozen=True)
class SimulationParams:
    regions: int = 100_000
    flank: int = 5_000
    seed: int = 25


@dataclass(frozen=True)
class ProfileParams:
    bin_size: int
    flanking_bp: int
    body_bins: int
    uniform: bool = False
    gap_slots: int = 5

    def __post_init__(self) -> None:
        if self.bin_size <= 0:
            raise ValueError("bin_size must be positive")
        if self.flanking_bp < 0:
            raise ValueError("flanking_bp must not be negative")
        if self.flanking_bp % self.bin_size:
            raise ValueError("flanking_bp must be a multiple of bin_size")
        if self.body_bins <= 0:
            raise ValueError("body_bins must be positive")

    @property
    def flank_bins(self) -> int:
        return self.flanking_bp // self.bin_size

    @property
    def right_offset(self) -> int:
        return self.flank_bins + 2 * self.body_bins + self.gap_slots

    @property
    def total(self) -> int:
        return 2 * self.flank_bins + 2 * self.body_bins + self.gap_slots
