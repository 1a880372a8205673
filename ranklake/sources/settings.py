"""Settings of each method, read from JSON: unknown keys are ignored, values that break a rule raise ``ValueError``."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field, fields
from datetime import datetime, timezone
from pathlib import Path


def _amount(x) -> bool:
    return isinstance(x, (int, float)) and math.isfinite(x) and x >= 0


def _share(x) -> bool:
    return _amount(x) and x <= 1


def _count(x) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and x >= 1


@dataclass
class Settings:
    """``rules`` yields (holds, message); ``problems`` lists the messages of those that do not hold."""

    @classmethod
    def read(cls, path: str | Path):
        known = {f.name for f in fields(cls)}
        made = cls(**{k: v for k, v in json.loads(Path(path).read_text("utf-8")).items() if k in known})
        if made.problems():
            raise ValueError("; ".join(made.problems()))
        return made

    def rules(self) -> Iterator[tuple[bool, str]]:
        yield from ()

    def problems(self) -> list[str]:
        return [message for holds, message in self.rules() if not holds]


@dataclass
class Ranked(Settings):
    top_k_values: list[int] = field(default_factory=lambda: [5, 10, 20])

    @property
    def max_k(self) -> int:
        return max(self.top_k_values, default=20)

    def rules(self):
        yield len(self.top_k_values) > 0, "top_k_values is empty"
        yield all(map(_count, self.top_k_values)), "top_k_values holds something else than whole numbers from 1"


@dataclass
class Judged(Ranked):
    relevance_threshold: int = 1

    def rules(self):
        yield from super().rules()
        yield self.relevance_threshold in (1, 2, 3), "relevance_threshold is not 1, 2 or 3"


@dataclass
class Keyword(Judged):
    k1: float = 1.5
    b: float = 0.75
    # how often each field counts
    field_weights: dict[str, int] = field(default_factory=lambda: {"title": 3, "description": 1, "category": 2, "subcategory": 2, "brand": 2})
    use_stopwords: bool = True

    def rules(self):
        yield from super().rules()
        yield self.k1 > 0, "k1 is not positive"
        yield _share(self.b), "b is not in [0, 1]"
        yield any(w > 0 for w in self.field_weights.values()), "no field has a positive weight"


@dataclass
class Semantic(Judged):
    word_ngram_range: list[int] = field(default_factory=lambda: [1, 2])
    char_ngram_range: list[int] = field(default_factory=lambda: [3, 5])
    word_weight: float = 1.0
    char_weight: float = 0.5
    min_df: int = 1
    max_df: float = 1.0
    sublinear_tf: bool = True
    svd_components: int = 64
    random_state: int = 20260614

    def rules(self):
        yield from super().rules()
        for name in ("word_ngram_range", "char_ngram_range"):
            span = getattr(self, name)
            yield len(span) == 2 and all(map(_count, span)) and span[0] <= span[1], f"{name} is not a pair of rising whole numbers from 1"
        weights = (self.word_weight, self.char_weight)
        yield min(weights) >= 0 and max(weights) > 0, "word_weight and char_weight are negative or both zero"
        yield self.svd_components >= 2, "svd_components is under 2"
        yield isinstance(self.random_state, int), "random_state is no whole number"
        yield self.min_df >= 1, "min_df is under 1"
        yield 0 < self.max_df <= 1, "max_df is not in (0, 1]"


@dataclass
class Fusion(Judged):
    candidate_k: int = 100
    rrf_k: int = 60
    bm25_weight: float = 0.5
    semantic_weight: float = 0.5
    score_normalization: str = "min_max"

    def rules(self):
        yield from super().rules()
        yield _count(self.candidate_k) and self.candidate_k >= self.max_k, "candidate_k is under 1 or under the largest cut-off"
        yield self.rrf_k > 0, "rrf_k is not positive"
        weights = (self.bm25_weight, self.semantic_weight)
        yield all(map(_amount, weights)) and sum(weights) > 0, "bm25_weight and semantic_weight are negative, infinite or both zero"
        yield self.score_normalization == "min_max", "score_normalization is not min_max"


@dataclass
class Personal(Ranked):
    train_ratio: float = 0.8
    event_weights: dict[str, float] = field(default_factory=lambda: {"click": 1.0, "favorite": 2.0, "add_to_cart": 3.0, "purchase": 5.0})
    half_life_days: float = 30.0
    retrieval_weight: float = 0.70
    category_weight: float = 0.12
    subcategory_weight: float = 0.06
    brand_weight: float = 0.06
    price_weight: float = 0.06
    behavior_relevance: dict[str, int] = field(default_factory=lambda: {"click": 1, "favorite": 2, "add_to_cart": 3, "purchase": 4})

    @property
    def mix(self) -> dict[str, float]:
        """What ``personalization.rerank`` takes as weights."""
        return {name: getattr(self, f"{name}_weight") for name in ("retrieval", "category", "subcategory", "brand", "price")}

    def rules(self):
        yield from super().rules()
        yield 0 < self.train_ratio < 1, "train_ratio is not in (0, 1)"
        for name, weights in (("event_weights", self.event_weights), ("the re-ranking weights", self.mix)):
            yield all(map(_amount, weights.values())) and any(w > 0 for w in weights.values()), f"{name} are negative, infinite or all zero"
        yield self.half_life_days > 0, "half_life_days is not positive"
        yield all(map(_count, self.behavior_relevance.values())), "behavior_relevance holds something else than whole numbers from 1"
        steps = [self.behavior_relevance.get(t, 0) for t in ("click", "favorite", "add_to_cart", "purchase")]
        yield steps == sorted(steps), "behavior_relevance falls along the funnel"


@dataclass
class Simulation(Settings):
    seed: int = 20260614
    num_items: int = 500
    num_users: int = 100
    num_queries: int = 200
    num_sessions: int = 500
    target_event_count: int = 8000
    cold_start_user_ratio: float = 0.1
    cold_start_item_ratio: float = 0.1
    start_date: str = "2026-01-01T00:00:00+00:00"
    end_date: str = "2026-03-31T23:59:59+00:00"
    categories: list[str] = field(default_factory=list)
    subcategories: dict[str, list[str]] = field(default_factory=dict)
    brands: dict[str, list[str]] = field(default_factory=dict)
    price_ranges: dict[str, list[float]] = field(default_factory=dict)
    price_preference_levels: list[str] = field(default_factory=lambda: ["budget", "mid_range", "premium"])
    activity_levels: list[str] = field(default_factory=lambda: ["low", "medium", "high"])
    serp_size: int = 20
    position_decay_alpha: float = 0.6
    base_click_probability: float = 0.14
    max_clicks_per_request: int = 3
    post_click_stop_probability: float = 0.50
    relevance_boost: float = 1.8
    preference_boost: float = 1.4
    base_favorite_probability: float = 0.10
    base_add_to_cart_probability: float = 0.09
    base_purchase_probability: float = 0.35

    @property
    def event_types(self) -> list[str]:
        return ["impression", "click", "favorite", "add_to_cart", "purchase"]

    @property
    def start(self) -> float:
        """Seconds since 1970."""
        return self._seconds(self.start_date)

    @property
    def end(self) -> float:
        return self._seconds(self.end_date)

    @staticmethod
    def _seconds(text: str) -> float:
        moment = datetime.fromisoformat(text)
        return (moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)).timestamp()

    def rules(self):
        yield self.seed >= 0, "seed is negative"
        for name in ("num_items", "num_users", "num_queries", "num_sessions", "serp_size", "max_clicks_per_request"):
            yield _count(getattr(self, name)), f"{name} is no whole number from 1"
        for name in ("cold_start_user_ratio", "cold_start_item_ratio", "post_click_stop_probability", "base_favorite_probability", "base_add_to_cart_probability", "base_purchase_probability"):
            yield _share(getattr(self, name)), f"{name} is not in [0, 1]"
        yield self.start < self.end, "start_date is not before end_date"
        yield self.position_decay_alpha > 0, "position_decay_alpha is not positive"
        yield 0 < self.base_click_probability <= 1, "base_click_probability is not in (0, 1]"
        for name in ("categories", "price_preference_levels", "activity_levels"):
            yield len(getattr(self, name)) > 0, f"{name} is empty"
