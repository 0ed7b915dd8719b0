"""Rating parameters."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from ladderline import fixed_values as fv


@dataclass(frozen=True)
class RatingConfig:
    initial_rating: float = fv.INITIAL_RATING
    k_factor: float = fv.K_FACTOR
    home_advantage: float = fv.HOME_ADVANTAGE
    goal_margin: bool = True
    league_strength: dict[str, float] = field(default_factory=lambda: dict(fv.LEAGUE_STRENGTH))
    league_baseline: dict[str, float] = field(default_factory=lambda: dict(fv.LEAGUE_BASELINE))
    season_regression: float = fv.SEASON_REGRESSION
    season_gap_days: int = fv.SEASON_GAP_DAYS

    @property
    def gap_ms(self) -> int:
        return self.season_gap_days * 86_400_000

    def flat(self) -> "RatingConfig":
        """The replay variant: one start rating for everybody, no league effect, no regression."""
        return replace(self, league_strength={}, league_baseline={}, season_regression=0.0)
