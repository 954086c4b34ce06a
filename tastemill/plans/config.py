"""Configurations with range checks, and the mining presets."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from ..operators.itemsets import MOST_ITEMS


@dataclass(frozen=True)
class PipelineConfig:
    test_frac: float = 0.1
    split_policy: str = "global"
    cutoff_date: str | None = None
    like_threshold: float = 4.0
    min_tag_freq: int = 10
    random_seed: int = 42
    reduction_families: tuple[str, ...] = ("genre", "movie", "tag")
    min_token_df: int = 5
    top_k_movies: int | None = 5000
    top_k_tags: int | None = 500
    min_items: int = 2
    max_items: int | None = None
    sample_frac: float | None = None
    schema_version: str = "1.0"
    run_tag: str | None = None
    min_coverage: float = 0.95
    buckets: int | None = None

    def __post_init__(self) -> None:
        def need(good: bool, what: str) -> None:
            if not good:
                raise ValueError(what)

        need(0 < self.test_frac < 1, "test_frac must be between 0 and 1")
        need(self.split_policy in ("global", "per_user"), "split_policy must be global or per_user")
        need(self.like_threshold >= 0, "like_threshold must be 0 or more")
        need(self.min_tag_freq >= 1, "min_tag_freq must be 1 or more")
        need(self.min_token_df >= 1, "min_token_df must be 1 or more")
        need(self.min_items >= 1, "min_items must be 1 or more")
        need(self.max_items is None or self.max_items >= self.min_items, "max_items must be min_items or more")
        need(self.sample_frac is None or 0 < self.sample_frac <= 1, "sample_frac must be above 0 and at most 1")
        need(self.buckets is None or self.buckets >= 1, "buckets must be 1 or more")
        for k in (self.top_k_movies, self.top_k_tags):
            need(k is None or k >= 1, "top_k must be 1 or more")


@dataclass(frozen=True)
class MiningConfig:
    preset: str = "custom"
    mode: str = "genre_tag"
    algorithm: str = "pairs"
    limits: bool = False
    caps_on: bool = False
    tops: dict = field(default_factory=lambda: {"movie": 600, "tag": 600})
    caps: dict = field(default_factory=lambda: {"movie": 60, "tag": 60})
    high_support: float = 0.01
    low_support: float = 0.001
    min_confidence: float = 0.4
    min_lift: float = 1.5
    max_len: int = 2
    gate1: bool = False
    gate2: bool = False
    gate1_min_ab: int = 50
    gate1_min_a: int = 100
    gate1_max_support_b: float | None = 0.20
    gate2_min_confidence: float = 0.10
    gate2_min_ratio: float = 0.80
    gate2_min_ab: int = 50
    across: tuple[str, str] | None = None

    def __post_init__(self) -> None:
        if not 1 <= self.max_len <= MOST_ITEMS:
            raise ValueError(f"max_len must be 1 to {MOST_ITEMS}")

    def _on(self, switch: bool) -> bool:
        """The movie-tag miner has limits and caps in controlled modes only."""
        return self.mode.startswith("controlled_") or (switch and self.algorithm != "movie_tag")

    @property
    def active_tops(self) -> dict:
        return self.tops if self._on(self.limits) else {}

    @property
    def active_caps(self) -> dict:
        return self.caps if self._on(self.caps_on) else {}


# The presets' parameters.
PRESETS = {
    "A": dict(mode="movie_only", limits=True, caps_on=True, low_support=0.001, min_confidence=0.3, caps={"movie": 39, "tag": 39}),
    "B": dict(mode="controlled_movie_tag", algorithm="movie_tag", low_support=0.001, min_confidence=0.4, min_lift=1.5, across=("movie", "tag")),
    "C": dict(mode="genre_tag", low_support=0.005, min_confidence=0.25, min_lift=1.2, across=("genre", "tag")),
}


def preset(name: str | None, **changes) -> MiningConfig:
    """A named preset, or ``custom`` (also where the name is empty) from the changes alone; case and outer spaces of the name don't count."""
    wanted = (name or "custom").strip().upper()
    if wanted != "CUSTOM" and wanted not in PRESETS:
        raise ValueError(f"unknown preset {name!r}")
    return MiningConfig(preset="custom" if wanted == "CUSTOM" else wanted, **(PRESETS.get(wanted, {}) | changes))


def clamp(config: MiningConfig) -> MiningConfig:
    """For the full, not reduced, baskets with the general miner: limits and caps are forced, supports raised and K and caps lowered."""
    if config.algorithm != "pairs":
        return config
    least = {"tops": 600, "caps": 60}
    lowered = {k: {f: min(v or most, most) for f, v in getattr(config, k).items()} for k, most in least.items()}
    return replace(
        config, limits=True, caps_on=True, high_support=max(config.high_support, 0.01), low_support=max(config.low_support, 0.001), **lowered
    )
