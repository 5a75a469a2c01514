"""Networks, grids and parameters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Network:
    """A directed multigraph: ``nodes`` keyed by ``id``, ``edges`` keyed by ``u, v, key``; ids are text."""

    nodes: DataFrame
    edges: DataFrame
    crs: str = ""
    directed: bool = True

    def with_(self, **changes) -> "Network":
        return replace(self, **changes)


@dataclass(frozen=True)
class GridSpec:
    """Cells of ``dx`` by ``dy``; (x0, y0) is the upper left corner, rows grow downwards when ``dy`` > 0."""

    x0: float
    y0: float
    dx: float
    dy: float
    rows: int
    cols: int


@dataclass(frozen=True)
class SubcatchmentDerivation:
    subbasin_streamorder: int | None = None
    subbasin_membership: float = 0.5
    subbasin_clip_method: str = "subbasin"
    lane_width: float = 3.5
    carve_depth: float = 2.0
    max_street_length: float = 60.0
    node_merge_distance: float = 10.0

    def __post_init__(self):
        _within("subbasin_membership", self.subbasin_membership, 0, 1)
        _within("lane_width", self.lane_width, 2, 5)
        _within("carve_depth", self.carve_depth, 1, 3)
        _within("max_street_length", self.max_street_length, 40, 100)
        _within("node_merge_distance", self.node_merge_distance, 1, 39.9)


@dataclass(frozen=True)
class OutfallDerivation:
    method: str = "separate"
    river_buffer_distance: float = 150.0
    outfall_length: float = 40.0

    def __post_init__(self):
        _within("river_buffer_distance", self.river_buffer_distance, 10, 500)


@dataclass(frozen=True)
class TopologyDerivation:
    weights: Sequence[str] = ("chahinian_slope", "chahinian_angle", "length", "contributing_area")
    omit_edges: Sequence[str] = ("motorway", "motorway_link", "bridge", "tunnel", "corridor")
    scaling: dict = field(default_factory=dict)
    exponent: dict = field(default_factory=dict)


@dataclass(frozen=True)
class HydraulicDesign:
    diameters: Sequence[float] = tuple(0.15 + 2.85 * i / 38 for i in range(39))
    max_fr: float = 0.8
    min_v: float = 0.75
    max_v: float = 5.0
    min_depth: float = 0.5
    max_depth: float = 5.0
    precipitation: float = 0.006
    depth_nbins: int = 10
    edge_design_parameters: Sequence[str] = ("diameter", "cost_usd")

    def __post_init__(self):
        _within("max_fr", self.max_fr, 0, 1)
        _within("min_v", self.min_v, 0, 2)
        _within("max_v", self.max_v, 3, 10)
        _within("min_depth", self.min_depth, 0, 1)
        _within("max_depth", self.max_depth, 2, 10)


@dataclass(frozen=True)
class MetricEvaluation:
    grid_scale: float = 100.0
    warmup: float = 0.0

    def __post_init__(self):
        _within("grid_scale", self.grid_scale, 10, 5000)
        if not 0 <= self.warmup < 1:
            raise ValueError("warmup must lie in [0, 1)")


def _within(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must lie between {low} and {high}")
