"""Schemas and settings of collections."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from typing import Any

from quiver.functions.distance import metric_name
from quiver.functions.filters import META_TYPE

QUANTIZATIONS = {"none": "none", "None": "none", "sq8": "sq8", "SQ8": "sq8", "pq": "pq", "PQ": "pq"}
LOG_SCHEMA = f"seq bigint, pos bigint, op string, id bigint, vec array<float>, meta {META_TYPE}"

#: Settings that a request must name, and how answers spell two others. Fixed values of the service.
REQUIRED = ("dim", "m", "m0", "ef_construction", "metric", "max_elements")
ANSWERED = ("dim", "m", "m0", "ef_construction", "metric", "max_elements", "quant_mode", "pq_m")
METRICS_SPELLED = {"cosine": "Cosine", "l2": "L2", "dot": "DotProduct", "l1": "L1", "hamming": "Hamming"}
QUANTIZATIONS_SPELLED = {"none": "None", "sq8": "SQ8", "pq": "PQ"}


@dataclass(frozen=True)
class Config:
    """Settings of a collection. The defaults are fixed values of the data model."""

    dim: int
    m: int = 16
    m0: int = 0
    ef_construction: int = 200
    metric: str = "l2"
    max_elements: int = 0
    quant_mode: str = "none"
    pq_m: int = 8
    segment_max_size: int = 10_000

    def __post_init__(self):
        object.__setattr__(self, "metric", metric_name(self.metric))
        if self.quant_mode not in QUANTIZATIONS:
            raise ValueError(f"unknown quantization: {self.quant_mode}")
        object.__setattr__(self, "quant_mode", QUANTIZATIONS[self.quant_mode])
        if self.dim < 1 or self.m < 2 or self.pq_m < 1 or self.segment_max_size < 1:
            raise ValueError("dim, pq_m and segment_max_size must be positive, m 2 or more")
        if not self.m0:
            object.__setattr__(self, "m0", 2 * self.m)

    @classmethod
    def parse(cls, spec: dict[str, Any]) -> Config:
        """From a request: unknown keys are refused."""
        unknown = set(spec) - set(cls.__dataclass_fields__)
        if unknown or "dim" not in spec:
            raise ValueError(f"unknown settings: {sorted(unknown)}" if unknown else "dim is missing")
        return cls(**spec)

    def as_dict(self) -> dict[str, Any]:
        return asdict(self)

    def as_answer(self) -> dict[str, Any]:
        """As the service shows it."""
        shown = {k: v for k, v in self.as_dict().items() if k in ANSWERED}
        return shown | {"metric": METRICS_SPELLED[self.metric], "quant_mode": QUANTIZATIONS_SPELLED[self.quant_mode]}
