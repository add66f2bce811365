"""Parameters of the operators. Everything is immutable and passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

# --- fixed values: minutes a person needs per task class -----------------------
MANUAL_MINUTES = {
    "text_generation": 15.0,
    "code_help": 30.0,
    "data_analysis": 45.0,
    "education": 20.0,
    "information_search": 15.0,
    "task_management": 25.0,
    "other": 15.0,
}
MANUAL_MINUTES_DEFAULT = 15.0

# Prototype variant of the same table ("tools" variant of the ROI rows).
MANUAL_MINUTES_TOOLS = {**MANUAL_MINUTES, "other": 10.0}
MANUAL_MINUTES_TOOLS_DEFAULT = 10.0


@dataclass(frozen=True)
class RateModel:
    """Inputs the two money rates are derived from."""

    monthly_rate: float = 400_000.0
    hours_per_month: float = 168.0
    token_price_per_mln: float = 139.0
    infra_capex: float = 100_000_000.0
    amortization_years: float = 5.0
    electricity_per_year: float = 600_000.0
    tokens_per_year: float = 20_000_000_000.0

    @property
    def hourly_rate(self) -> float:
        return self.monthly_rate / self.hours_per_month if self.hours_per_month > 0 else 0.0

    @property
    def token_price_per_1k(self) -> float:
        return self.token_price_per_mln / 1000.0


@dataclass(frozen=True)
class RoiConfig:
    hourly_rate: float = RateModel().hourly_rate
    price_per_1k: float = RateModel().token_price_per_1k
    coeff_short: float = 0.3
    coeff_medium: float = 1.0
    coeff_long: float = 2.0
    short_max_tokens: int = 4000
    long_min_tokens: int = 30000
    chars_per_token: float = 3.0
    tokens_per_scenario: float = 1100.0
    voice_recommend_percent: float = 20.0
    manual_minutes: dict[str, float] = field(default_factory=lambda: dict(MANUAL_MINUTES))
    manual_default: float = MANUAL_MINUTES_DEFAULT
    rates: RateModel = RateModel()
    hourly_overridden: bool = False
    price_overridden: bool = False


@dataclass(frozen=True)
class AggConfig:
    top_tasks: int = 7
    top_scenarios: int = 9
    trend_threshold: float = 15.0
    trend_min_total: int = 20
    trend_min_previous: int = 5
    top_signals: int = 10
    examples: int = 5


@dataclass(frozen=True)
class UsersConfig:
    active_days: int = 7
    failure_weight: float = 0.6
    outlier_weight: float = 0.4
    specialist_share: float = 0.35
    super_user_categories: int = 5
    casual_fraction: float = 0.5
    casual_floor: float = 5.0
    guidance_frustration: float = 15.0
    advice_frustration: float = 20.0


@dataclass(frozen=True)
class NormalizeConfig:
    now: datetime = datetime(2024, 2, 1)
    synthesize: bool = True
    span_days: int = 14
    id_prefix: str = "req_"
    namespace: str | None = None
    name_prefix: str = "agentlog"


@dataclass(frozen=True)
class Filters:
    """Optional predicates; `only_failures` and the ids apply to the joined view."""

    source_id: str | None = None
    from_: str | None = None
    to: str | None = None
    task_type: str | None = None
    scenario_id: str | None = None
    only_failures: bool = False

    @property
    def has_workspace(self) -> bool:
        return bool(self.source_id or self.from_ or self.to)


@dataclass(frozen=True)
class LongTextConfig:
    max_direct: int = 8000
    chunk: int = 512
    overlap: int = 64
    max_chunks: int = 8
    head_words: int = 40


@dataclass(frozen=True)
class ScenarioConfig:
    min_cluster_size: int = 10
    min_samples: int = 4
    max_clusters: int = 5
    match_threshold: float = 0.75
    join_threshold: float = 0.85
    # Neighbour search: tables of direction cells, rows of a cell that choose its bits, rows
    # compared with each other, neighbours kept per row and table.
    hash_tables: int = 8
    cell_rows: int = 256
    block_rows: int = 512
    neighbours: int = 8
    # Share of a class's rows that may lie outside its radius, and the least length of the
    # mean unit vector below which rows do not point one way.
    radius_quantile: float = 0.05
    coherence: float = 0.6
    seed: int = 42
    reduce_dims: int | None = None  # project on so many principal components
    examples: int = 10
    boundary: int = 2
