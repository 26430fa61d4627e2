"""Search configuration and the gear table."""

from __future__ import annotations

from dataclasses import dataclass

DIM, K, DEGREE, CENTROIDS = 64, 10, 32, 256
SCALE = 1000

#: Gear, least bytes, list size, code length.
GEARS = [
    (0, 11400, 10, 16),
    (1, 14269, 15, 16),
    (2, 17025, 20, 16),
    (3, 17936, 10, 32),
    (4, 22315, 15, 32),
    (5, 26552, 20, 32),
]
#: Capacitance, scale, efficiency, volts at which work stops, microjoules per byte.
CAPACITANCE, MICRO, EFFICIENCY, V_OFF, UJ_PER_BYTE = 0.0047, 500000, 0.4, 2.8, 0.079904

RERANK = ("full", "partial", "two_stage", "list")


@dataclass(frozen=True)
class SearchConfig:
    """l_size: entries kept; m: subspaces of the code; rerank: what is compared exactly.

    full: every expanded vertex; partial: the best `partial` of them by code distance; two_stage: long codes,
    then the best `refine` exactly; list: the final list instead of the expanded vertices.
    """

    l_size: int = 10
    m: int = 16
    k: int = K
    degree: int = DEGREE
    rerank: str = "full"
    partial: int = 20
    refine: int = 30
    max_hops: int | None = None
    early_stop: bool = False
    max_expanded: int = 1000

    def __post_init__(self) -> None:
        wrong = [
            (self.l_size < 1, "l_size must be positive"),
            (self.m not in (16, 32), "m must be 16 or 32"),
            (self.k < 1, "k must be positive"),
            (self.degree < 1, "degree must be positive"),
            (self.rerank not in RERANK, f"rerank must be one of {RERANK}"),
            (self.rerank == "two_stage" and self.m == 32, "two-stage reranking refines short codes: m must be 16"),
            (self.rerank == "two_stage" and self.refine < self.k, "refine must be at least k"),
            (self.rerank == "partial" and self.partial < self.k, "partial must be at least k"),
            (self.max_hops is not None and self.max_hops < 1, "max_hops must be positive"),
            (self.max_hops is not None and self.early_stop, "a hop limit and early stopping exclude each other"),
            (self.max_expanded < self.l_size, "max_expanded must hold at least l_size vertices"),
        ]
        for bad, why in wrong:
            if bad:
                raise ValueError(why)


def gear_config(gear: int, **more: object) -> SearchConfig:
    """The configuration of a gear."""
    row = next((g for g in GEARS if g[0] == gear), None)
    if row is None:
        raise ValueError(f"no gear {gear}")
    return SearchConfig(l_size=row[2], m=row[3], **more)  # type: ignore[arg-type]
