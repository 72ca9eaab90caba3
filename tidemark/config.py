"""Rule parameters, presets and their validation."""

from __future__ import annotations

import datetime as dt
from dataclasses import asdict, dataclass, replace

# fixed values of the tested rules
SIG_N = 20
MED_MIN = 250
SMA_N = 200
REBALANCE_THRESHOLD = 0.10
TOLERANCE = 1e-9
ANCHOR = "2019-06-01"
COST = 0.001
TRADING_DAYS = 252
SEED = 20261005
N_BOOT = 2000
N_SHUFFLE = 200
MIN_STOCKS = 10
MIN_INFORMATIVE = 10
MAX_UNDEFINED = 0.05
MATCH_STOP = 1e-9
MATCH_OK = 1e-6
BISECT_MAX = 100
HOLM_ALPHA = 0.05

#: preset -> (vol, vol_floor, below_sma)
PRESETS = {
    "v": (True, None, 1.0),
    "f": (False, None, 0.5),
    "vf": (True, None, 0.5),
    "vf75": (True, 0.75, 0.75),
}
DEFAULT_PRESET = "vf75"

#: Marks an option that was not given; None is a value (no floor).
UNSET = object()


@dataclass(frozen=True)
class Rule:
    """A target-weight rule: volatility target with an optional floor, times a weight below the moving average."""

    preset: str | None = DEFAULT_PRESET
    vol: bool = True
    vol_floor: float | None = 0.75
    below_sma: float = 0.75
    anchor: str = ANCHOR
    sig_n: int = SIG_N
    med_min: int = MED_MIN
    sma_n: int = SMA_N
    rebalance_threshold: float = REBALANCE_THRESHOLD

    def __post_init__(self):
        if self.vol_floor is not None and not 0 <= self.vol_floor <= 1:
            raise ValueError("vol_floor must lie in [0, 1] or be None")
        if not 0 < self.below_sma <= 1:
            raise ValueError("below_sma must lie in (0, 1]")
        if min(self.sig_n, self.sma_n, self.med_min) < 1 or self.sig_n < 2:
            raise ValueError("window lengths must be positive, sig_n at least 2")
        dt.date.fromisoformat(self.anchor)

    @property
    def triple(self) -> tuple:
        return self.vol, self.vol_floor, self.below_sma

    def as_row(self) -> dict:
        return asdict(self)


def rule(preset: str = DEFAULT_PRESET, *, vol=UNSET, vol_floor=UNSET, below_sma=UNSET, **rest) -> Rule:
    """The preset's rule with what is given put over it."""
    if preset not in PRESETS:
        raise ValueError(f"unknown preset {preset!r}")
    base = dict(zip(("vol", "vol_floor", "below_sma"), PRESETS[preset]))
    given = {k: v for k, v in (("vol", vol), ("vol_floor", vol_floor), ("below_sma", below_sma)) if v is not UNSET}
    return Rule(preset=preset, **(base | given), **rest)


def parse_floor(text: str) -> float | None:
    """A floor option: a number in [0, 1], or `none`."""
    value = None if text.strip().lower() == "none" else float(text)
    return replace(Rule(), vol_floor=value).vol_floor


def parse_budget(text: str) -> float:
    value = float(text)
    if not 0 < value < float("inf"):
        raise ValueError("a budget is finite and positive")
    return value
