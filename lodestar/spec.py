"""Column roles of a case table.

Every operator takes a :class:`CaseSpec` instead of hard-coded column
names, so the same code explains any tabular classifier.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Bin:
    """Right-closed binning: x <= cuts[0] -> labels[0],
    (cuts[i-1], cuts[i]] -> labels[i], anything else -> labels[-1]."""

    source: str
    name: str
    cuts: tuple[float, ...]
    labels: tuple[str, ...]

    def __post_init__(self):
        if len(self.labels) != len(self.cuts) + 1:
            raise ValueError("a bin needs one more label than cuts")


@dataclass(frozen=True)
class Ratio:
    """Net ratio feature (plus - minus) / (base + 1); NaN/null -> 0."""

    name: str
    plus: str
    minus: str
    base: str


@dataclass(frozen=True)
class CaseSpec:
    key: str
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    target: str = "target"
    actionable: tuple[str, ...] = ()
    immutable: tuple[str, ...] = ()
    non_actionable: tuple[str, ...] = ()
    # dependent numeric -> (source categorical, {category: value})
    dependent: dict = field(default_factory=dict)
    # ordinal categorical -> {category: level}; levels may not decrease
    ordinal: dict = field(default_factory=dict)
    # categorical -> destinations a counterfactual may never hold
    forbidden: dict = field(default_factory=dict)
    # numeric -> (lo, hi) fixed permitted range; others use training bounds
    permitted: dict = field(default_factory=dict)
    # numerics whose drawn values are whole numbers
    integral: tuple[str, ...] = ()
    bins: tuple[Bin, ...] = ()
    ratios: tuple[Ratio, ...] = ()

    @property
    def frozen(self) -> tuple[str, ...]:
        return tuple(self.immutable) + tuple(self.non_actionable)

    @property
    def features(self) -> tuple[str, ...]:
        return tuple(self.numeric) + tuple(self.categorical)

    @property
    def distance_numeric(self) -> tuple[str, ...]:
        """Numerics that enter the distance (dependents are skipped)."""
        return tuple(c for c in self.numeric if c not in self.dependent)

    @property
    def actionable_numeric(self) -> tuple[str, ...]:
        return tuple(c for c in self.actionable if c in self.numeric)

    @property
    def actionable_categorical(self) -> tuple[str, ...]:
        return tuple(c for c in self.actionable if c in self.categorical)

    @property
    def encoded_categorical(self) -> tuple[str, ...]:
        """Categoricals that are one-hot encoded: declared + binned."""
        return tuple(self.categorical) + tuple(b.name for b in self.bins)

    @property
    def encoded_numeric(self) -> tuple[str, ...]:
        return tuple(self.numeric) + tuple(r.name for r in self.ratios)


# Fixed values of the order case table (stand-in for the census roles).
PRIORITY_LEVELS = {
    "5-LOW": 1.0,
    "4-NOT SPECIFIED": 2.0,
    "3-MEDIUM": 3.0,
    "2-HIGH": 4.0,
    "1-URGENT": 5.0,
}

ORDER_CASES = CaseSpec(
    key="case_id",
    numeric=("total_price", "acct_bal", "line_count", "sum_qty", "avg_discount", "priority_num"),
    categorical=("segment", "priority", "status", "nation", "region"),
    target="target",
    actionable=("total_price", "line_count", "sum_qty", "avg_discount", "segment", "priority"),
    immutable=("nation", "region"),
    non_actionable=("acct_bal", "status"),
    dependent={"priority_num": ("priority", PRIORITY_LEVELS)},
    ordinal={"priority": PRIORITY_LEVELS},
    forbidden={"segment": ("FURNITURE",)},
    permitted={"sum_qty": (1.0, 300.0)},
    integral=("line_count", "sum_qty"),
    bins=(
        Bin("total_price", "price_band",
            (50000.0, 100000.0, 150000.0, 200000.0, 250000.0, 300000.0),
            ("upto_50k", "50k_100k", "100k_150k", "150k_200k", "200k_250k", "250k_300k", "over_300k")),
        Bin("sum_qty", "qty_band", (25.0, 50.0, 100.0, 150.0, 200.0),
            ("tiny", "small", "medium", "large", "bulk", "huge")),
        Bin("priority_num", "urgency", (1.0, 2.0, 3.0, 4.0, 5.0),
            ("low", "not_specified", "medium", "high", "urgent", "beyond")),
    ),
    ratios=(Ratio("price_per_line", "total_price", "acct_bal", "line_count"),),
)

# A second case table over documents and labels: proves the operators are
# generic in their column lists.
DOCUMENT_CASES = CaseSpec(
    key="case_id",
    numeric=("n_chars",),
    categorical=("lang", "source"),
    target="target",
    actionable=("n_chars", "source"),
    immutable=("lang",),
    bins=(Bin("n_chars", "length_band", (1000.0, 10000.0, 50000.0), ("short", "medium", "long", "very_long")),),
)
