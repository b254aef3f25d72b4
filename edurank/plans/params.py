"""Request parameters: filters, weights and the limits that apply to them."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, replace
from datetime import datetime, timezone

# Limits and defaults of a request that came from a form; see ``validated``.
RATING_LIMIT = {"min": 10, "max": 2000, "default": 300}
PER_PAGE = {"min": 5, "max": 200, "default": 20}
YEAR_RANGE = (2000, 2100)
SCORE_RANGE = (0, 100)
DEFAULT_WEIGHTS = {"graduates": 0.25, "avg_score": 0.45, "match_share": 0.20, "threshold_share": 0.10}


def bounded(value, low, high=None, default=None):
    """Clamp a number; a missing one becomes the default."""
    if value is None:
        value = default
    if value is None:
        return None
    value = max(low, value)
    return value if high is None else min(high, value)


def normalize_query(text: str | None) -> str:
    """Fold the searched text the way stored names are folded; LIKE wildcards stay live."""
    squeezed = re.sub(r"\s+", " ", (text or "").strip())
    return squeezed.lower().replace("ё", "е")


def unique_ids(values) -> tuple[int, ...]:
    return tuple(sorted({int(v) for v in values or ()}))


@dataclass(frozen=True)
class SchoolFilters:
    """What a school search may ask for; an unset field does not restrict."""

    q: str = ""
    region_id: int | None = None
    municipality_id: int | None = None
    profile_ids: tuple[int, ...] = ()
    year: int | None = None
    kind: str | None = None
    subject_ids: tuple[int, ...] = ()

    def __post_init__(self):
        for name in ("profile_ids", "subject_ids", "institute_ids", "program_ids"):
            if hasattr(self, name):
                object.__setattr__(self, name, unique_ids(getattr(self, name)))

    def as_dict(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class RatingFilters(SchoolFilters):
    """Search filters plus admission scope; ``limit`` keeps the best schools only, None keeps all."""

    institute_ids: tuple[int, ...] = ()
    program_ids: tuple[int, ...] = ()
    min_graduates: int | None = None
    min_avg_score: float | None = None
    enforce_subject_threshold: bool = True
    limit: int | None = None

    def validated(self) -> RatingFilters:
        """The request as a form may send it: every number in its allowed range, the number of schools too."""
        return replace(
            self,
            limit=bounded(self.limit, RATING_LIMIT["min"], RATING_LIMIT["max"], RATING_LIMIT["default"]),
            min_graduates=bounded(self.min_graduates, 0),
            min_avg_score=bounded(self.min_avg_score, *SCORE_RANGE),
        )

    @property
    def has_subjects(self) -> bool:
        return bool(self.subject_ids)

    @property
    def has_programs(self) -> bool:
        return bool(self.institute_ids) or bool(self.program_ids)

    @property
    def has_scope(self) -> bool:
        """Potential applicants only make sense for chosen subjects or programs."""
        return self.has_subjects or self.has_programs

    @property
    def all_thresholds(self) -> bool:
        """Without a scope every averaged subject has to reach its pass mark."""
        return self.enforce_subject_threshold and not self.has_scope


@dataclass(frozen=True)
class RatingWeights:
    graduates: float = DEFAULT_WEIGHTS["graduates"]
    avg_score: float = DEFAULT_WEIGHTS["avg_score"]
    match_share: float = DEFAULT_WEIGHTS["match_share"]
    threshold_share: float = DEFAULT_WEIGHTS["threshold_share"]

    def normalized(self) -> RatingWeights:
        """Negative weights count as zero, the rest adds up to one."""
        positive = {name: max(0.0, float(w)) for name, w in asdict(self).items()}
        total = sum(positive.values())
        if total <= 0:
            return RatingWeights()
        return RatingWeights(**{name: w / total for name, w in positive.items()})

    def effective(self, has_scope: bool) -> RatingWeights:
        """Weights used for scoring: no match part without a scope."""
        return (self if has_scope else replace(self, match_share=0.0)).normalized()


@dataclass(frozen=True)
class Page:
    """One page of an ordered result."""

    number: int = 1
    size: int = PER_PAGE["default"]

    def validated(self) -> Page:
        """The page as a form may ask for it."""
        return replace(self, number=max(1, self.number), size=bounded(self.size, PER_PAGE["min"], PER_PAGE["max"]))

    @property
    def limit(self) -> int:
        return max(1, int(self.size))

    @property
    def offset(self) -> int:
        return (max(1, int(self.number)) - 1) * self.limit

    def clamped(self, total: int) -> Page:
        """The nearest page that exists for ``total`` rows."""
        last = max(1, -(-total // self.limit))
        return Page(min(max(1, self.number), last), self.size)


def guess_year_basis(year: int | None, first_last_year: int | None) -> int:
    """Filter year, else the year of the best row, else the current one."""
    for candidate in (year, first_last_year):
        if candidate is not None:
            return bounded(int(candidate), *YEAR_RANGE)
    return bounded(datetime.now(timezone.utc).year, *YEAR_RANGE)
