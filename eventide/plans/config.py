"""Run configuration and hypothesis registry: plain, frozen, loadable from JSON; no data work here."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Hypothesis:
    """One test: a predictor against a flag, within controls and strata."""

    id: str
    predictor: str
    flag: str
    expected: str = "+"  # "+", "-", "shape", "regime", "n/a"
    controls: tuple[str, ...] = ()
    strata: tuple[str, ...] = ()
    invert: str = ""  # "", "quadratic", "binned"
    topline: bool = False
    testable: bool = True
    title: str = ""


@dataclass(frozen=True)
class RunConfig:
    """Settings of a run; unknown keys are errors."""

    label: str = "run"
    event_percentile: float = 90.0
    rank_bins: int = 128
    control_bins: int = 5
    min_events: int = 20
    reps: int = 300
    block_days: int = 7
    inference: str = "block"
    alpha: float = 0.05
    seed: int = 0
    hypotheses: str | tuple[str, ...] = "all"
    run_controls: bool = True
    strata: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    valid: tuple[str, ...] = ()  # products that a row must have
    complete_days: bool = False

    def __post_init__(self) -> None:
        if self.inference not in ("block", "iid"):
            raise ValueError(f"inference must be block or iid, not {self.inference!r}")
        if not 0 < self.event_percentile < 100:
            raise ValueError("event_percentile must lie between 0 and 100")

    @classmethod
    def from_dict(cls, values: Mapping) -> "RunConfig":
        known = {f.name for f in dataclasses.fields(cls)}
        unknown = set(values) - known
        if unknown:
            raise ValueError(f"unknown settings {sorted(unknown)}; there are {sorted(known)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})

    @classmethod
    def from_json(cls, text: str) -> "RunConfig":
        return cls.from_dict(json.loads(text))

    @classmethod
    def preset(cls, name: str, products: Sequence[str], **more) -> "RunConfig":
        """``all``: every product known; ``complete``: and every slot of the day; ``first_last``: only the first and last product."""
        sets = {"all": {"valid": tuple(products)}, "complete": {"valid": tuple(products), "complete_days": True}, "first_last": {"valid": (products[0], products[-1])}}
        if name not in sets:
            raise ValueError(f"unknown preset {name!r}; there are {sorted(sets)}")
        return cls(**({"label": name} | sets[name] | more))

    @classmethod
    def from_files(cls, paths: Sequence[str]) -> "RunConfig":
        """Settings from several JSON files; one setting in two of them is an error."""
        merged: dict = {}
        for p in paths:
            with open(p) as f:
                own = json.load(f)
            if twice := sorted(set(own) & set(merged)):
                raise ValueError(f"settings {twice} stand in more than one file")
            merged |= own
        return cls.from_dict(merged)

    def key(self, *names: str) -> str:
        """A digest of the named settings (all by default), for versioned paths."""
        values = dataclasses.asdict(self)
        return hashlib.sha256(json.dumps({n: values[n] for n in (names or sorted(values))}, sort_keys=True, default=str).encode()).hexdigest()[:16]


def select(registry: Sequence[Hypothesis], which: str | Sequence[str]) -> list[Hypothesis]:
    """``all``, ``topline`` or ids; an unknown id is an error."""
    if which == "all":
        return list(registry)
    if which == "topline":
        return [h for h in registry if h.topline]
    by_id = {h.id: h for h in registry}
    missing = set(which) - set(by_id)
    if missing:
        raise ValueError(f"unknown hypotheses {sorted(missing)}")
    return [by_id[i] for i in which]


def experiment_grid(factors: Mapping[str, Sequence]) -> list[dict]:
    """All combinations of factor levels, the last factor fastest."""
    grid: list[dict] = [{}]
    for name, levels in factors.items():
        grid = [{**g, name: v} for g in grid for v in levels]
    return grid


def block_experiments(core: Mapping[str, Sequence[str]], swaps: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """Name -> columns: all core blocks with each alternative of a swap block, each core block left out, none of the swap, and each block alone.

    The first alternative goes with the reduced sets; two alternatives never stand in one experiment.
    """
    columns = lambda *names: [c for n in names for c in (core | swaps)[n]]
    main = next(iter(swaps))
    out = {f"full-{s}": columns(*core, s) for s in swaps}
    out |= {f"drop-{b}": columns(*(x for x in core if x != b), main) for b in core}
    out["drop-swap"] = columns(*core)
    return out | {f"solo-{b}": columns(b) for b in [*core, *swaps]}
