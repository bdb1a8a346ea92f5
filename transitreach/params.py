"""Parameter snapshot of one dashboard query.

Every serving query is a pure function of these values (the dashboard only
recomputes on its buttons), so one frozen dataclass carries them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- Fixed values: the choice lists offered by the dashboard ----
SIZE_CHOICES = (
    "Under 1,000",
    "1,000 - 4,999",
    "5,000 - 9,999",
    "10,000 - 19,999",
    "20,000 and above",
)
DEGREE_LEVEL_CHOICES = ("2-year", "4-year or higher")
DEGREE_TYPE_CHOICES = ("Associate", "Baccalaureate", "Doctoral", "Master's", "Special Focus")
SECTOR_CHOICES = ("Private for-profit", "Private nonprofit", "Public")
RUN_CHOICES = {"AM": "morning", "PM": "evening", "Both": "both"}
RUNS = ("morning", "evening")
CUTOFF_GRID = tuple(range(15, 101, 5))  # the time slider: 15..100 step 5
DEFAULT_CUTOFF = 60                      # slider default
DEFAULT_TRANSFERS = 5                    # slider default
FUNCTION_DEFAULT_CUTOFF = 90             # default of the counting function itself


@dataclass(frozen=True)
class AccessParams:
    sizes: tuple = SIZE_CHOICES
    degree_levels: tuple = DEGREE_LEVEL_CHOICES
    sectors: tuple = SECTOR_CHOICES
    degree_types: tuple = DEGREE_TYPE_CHOICES
    carnegie: tuple | None = None   # None = every class still offered by the other filters
    run: str = "both"
    cutoff: float = DEFAULT_CUTOFF
    transfers: int = DEFAULT_TRANSFERS
    use_slots: bool = False
    # census tab
    concept: str | None = None
    variable: str | None = None
    use_percent: bool = False
    flip_axes: bool = False
    extra: dict = field(default_factory=dict, compare=False)

    def run_filter_active(self) -> bool:
        return self.run != "both"
