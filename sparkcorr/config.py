"""Run configuration and the rules that derive effective parameters."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace


def default_basic_window(w: int, step: int) -> int:
    """The divisor of ``w`` of its parity that is a multiple of ``step`` and closest to its root; else ``step``."""
    fits = [b for b in range(1, w + 1) if w % b == 0 and b % 2 == w % 2 and b % max(step, 1) == 0]
    return min(fits, key=lambda b: (abs(b - math.sqrt(w)), b), default=step)


@dataclass(frozen=True)
class CorrConfig:
    """Geometry, thresholds and plan of one correlation query.

    ``step`` 0 means the basic window. ``cell_stretch`` that isn't positive means 1, as does a
    ``grid_dimension`` that isn't. ``n_lags`` is rounded down to the step.
    """

    w: int = 168
    step: int = 12
    n_lags: int = 168
    threshold: float = 0.7
    neg_corr: bool = False
    basic_window: int | None = None
    n_vectors: int = 16
    cell_stretch: float = 1.0
    grid_dimension: int = 1
    partitioned: bool = False
    freq_threshold: float = 0.5
    sketch_norm: str = "mean_l2"
    seed: int = 2468
    seed_toggle: int = 1357
    preprocess: bool = False
    corr_val: bool = True
    merge_orientations: bool = False
    carry_sign_over_gap: bool = True
    origin: int | None = 0
    id_blocks: int = 1

    def __post_init__(self):
        set_ = lambda k, v: object.__setattr__(self, k, v)
        if self.w < 2 or self.step < 0 or self.n_lags < 0 or self.n_vectors <= 0 or self.id_blocks < 1:
            raise ValueError("w >= 2, step >= 0, n_lags >= 0, n_vectors > 0 and id_blocks >= 1 are asked for")
        if self.basic_window is None:
            set_("basic_window", default_basic_window(self.w, self.step))
        if self.step == 0:
            set_("step", self.basic_window)
        if self.w % self.basic_window or self.basic_window % self.step or self.w % self.step:
            raise ValueError("the step must divide the basic window, and that the window")
        set_("n_lags", self.n_lags // self.step * self.step)
        if not self.cell_stretch or not self.cell_stretch > 0:
            set_("cell_stretch", 1.0)
        if self.grid_dimension <= 0:
            set_("grid_dimension", 1)
        if self.partitioned and self.n_vectors % self.grid_dimension:
            raise ValueError("the grid dimension must divide the number of vectors")
        if self.sketch_norm not in ("mean_l2", "z"):
            raise ValueError("sketch_norm is mean_l2 or z")

    @property
    def n_grids(self) -> int:
        return self.n_vectors // self.grid_dimension if self.partitioned else 1

    @property
    def base_cell(self) -> float:
        return math.sqrt(2 * (1 - self.threshold)) / math.sqrt(self.n_vectors)

    @property
    def tau(self) -> float:
        """Radius of the neighbour search, on whole sketches or on each grid's chunk."""
        if self.partitioned:
            return min(self.base_cell * self.cell_stretch * math.sqrt(self.grid_dimension), 0.5)
        return self.cell_stretch * math.sqrt(2 * (1 - self.threshold))

    @property
    def min_votes(self) -> float:
        return self.freq_threshold * self.n_grids if self.partitioned else 0.0

    @property
    def retained(self) -> int:
        """Windows of a series that an anchor is compared with: lags 0 to ``n_lags``."""
        return self.n_lags // self.step + 1

    def counts(self, n: int, m: int) -> dict[str, int]:
        """Windows a series, windows in all, and retained ones, for m series of n ticks."""
        n_w = max(0, (n - self.w) // self.step + 1)
        return {"n_w": n_w, "total_w": m * n_w, "mem_w": self.n_lags // self.step, "total_time": (n_w - 1) * self.step + self.w if n_w else 0}

    def blocks_for(self, m: int, windows: int = 20_000) -> int:
        """The ``id_blocks`` that keep a key's group to about so many windows a side, for m series."""
        return max(1, -(-2 * m * self.retained // windows))

    def stretch_of_cell(self, cell: float) -> float:
        """The stretch that gave a stored cell size."""
        base = self.tau / self.cell_stretch
        return cell / base if base > 0 else 1.0

    def with_(self, **changes) -> CorrConfig:
        """Another configuration for a restarted query; the same checks hold."""
        return replace(self, **({"basic_window": None} if {"w", "step"} & changes.keys() and "basic_window" not in changes else {}), **changes)
