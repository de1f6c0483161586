"""Protocols, named by their content, and results sealed in a fixed order."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass
from pathlib import Path

import numpy as np

from ..operators.splits import chain, content_hash

#: What is sealed, in this order.
STAGES = ("genesis", "pool_census", "selection_protocol", "cv_result", "pareto_optimality_result", "feature_effects_result", "recommender_result")


@dataclass(frozen=True)
class Reference:
    """Upper bounds of the three objectives and where they come from; never taken from observations."""

    path_length: float
    headland_turns: float
    row_crossings: float
    basis: str

    def __post_init__(self):
        if min(self.path_length, self.headland_turns, self.row_crossings) <= 0 or not self.basis:
            raise ValueError("bounds are above 0 and have a basis")


@dataclass(frozen=True)
class ReverseCost:
    """How much dearer reverse driving is, and what a change of gear costs in metres. Both must be told."""

    multiplier: float
    penalty: float

    def __post_init__(self):
        if self.multiplier < 1 or self.penalty < 0:
            raise ValueError("a multiplier is at least 1, a penalty at least 0")


@dataclass(frozen=True)
class Protocol:
    """What a benchmark's numbers mean; another target, reference or reverse cost is another protocol."""

    protocol_id: str
    coverage_target: str
    reference: Reference
    reverse_cost: ReverseCost
    coverage_threshold: float = 0.99
    area_epsilon_m2: float = 1e-9
    resample_step_m: float = 0.25
    clearance_sample_step_m: float = 0.25

    def __post_init__(self):
        if not self.protocol_id or not 0 <= self.coverage_threshold <= 1 or min(self.resample_step_m, self.clearance_sample_step_m) <= 0 or self.area_epsilon_m2 < 0:
            raise ValueError("a protocol has a name, a threshold in [0, 1] and steps above 0")

    @property
    def spec_hash(self) -> str:
        return content_hash(asdict(self))


@dataclass(frozen=True)
class Sampling:
    """Fields for a comparison: at least so many with holes, and of these with several."""

    seed: int = 20260821
    total: int = 14
    with_obstacles: int = 6
    with_several: int = 2

    def __post_init__(self):
        if not 0 <= self.with_several <= self.with_obstacles <= self.total or self.total < 1:
            raise ValueError("a part is no larger than the whole")

    def pick(self, holes: dict[str, int]) -> list[str]:
        """Ids chosen by their number of holes: several first, then one or several, then none; in order of ids."""
        several, one, none = (sorted(k for k, n in holes.items() if (n >= 2, n == 1, n == 0)[c]) for c in range(3))
        if len(several) < self.with_several or len(several) + len(one) < self.with_obstacles:
            raise ValueError("there are too few fields with holes")
        r = np.random.default_rng(self.seed)
        chosen: set[str] = set()
        for pool, upto in ((several, self.with_several), (one + several, self.with_obstacles), (none, self.total)):
            left = [k for k in pool if k not in chosen]
            n = min(upto - len(chosen), len(left))
            if n > 0:
                chosen.update(str(k) for k in r.choice(np.array(left, object), size=n, replace=False))
        if len(chosen) < self.total:
            raise ValueError("there are too few fields")
        return sorted(chosen)


def request_id(place: int, field_id: str) -> str:
    return f"f2b_{place:03d}_{field_id}"


class Seals:
    """A log of results, each at its place in :data:`STAGES`; the same payload may be sealed again, another not."""

    def __init__(self):
        self.payloads: list[dict] = []

    def seal(self, artifact: str, payload: dict) -> dict:
        place = STAGES.index(artifact)
        entry = {"artifact": artifact, **payload}
        if place < len(self.payloads):
            if content_hash(self.payloads[place]) != content_hash(entry):
                raise ValueError(f"{artifact} is sealed with another result")
        elif place > len(self.payloads):
            raise ValueError(f"{STAGES[len(self.payloads)]} comes before {artifact}")
        else:
            self.payloads.append(entry)
        return self.log()[place]

    def log(self) -> list[dict]:
        return chain(self.payloads)

    def require_unsealed(self, artifact: str) -> None:
        if any(p["artifact"] == artifact for p in self.payloads):
            raise ValueError(f"{artifact} is sealed already")


def utm_code(longitude: float, latitude: float) -> int:
    """The EPSG code of the zone that holds a point."""
    if not (math.isfinite(longitude) and math.isfinite(latitude)):
        raise ValueError("a coordinate is finite")
    return (32600 if latitude >= 0 else 32700) + min(60, int((longitude + 180) // 6) + 1)


def code_hash(folder: str) -> str:
    """SHA-256 names of a folder's sources in order, as one hash."""
    return content_hash([[str(p.relative_to(folder)), p.read_text(encoding="utf-8")] for p in sorted(Path(folder).rglob("*.py"))])
