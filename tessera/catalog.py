"""Rules and catalogues kept as data.

Header rules, segment prefixes and the metric catalogue are tables a user can
extend; operators compile them into Spark Column expressions (no Python runs per
row).
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --------------------------------------------------------------------------- #
# FIXED VALUES — these must equal the source filings' wording and the
# original tool's catalogue for results to be right. Kept together, in the
# order they are tried.
# --------------------------------------------------------------------------- #

# Header rules. A normalised header (lower case, whitespace runs collapsed)
# matches a rule when it equals ``equals`` (if given), starts with ``prefix``
# (if given) and contains every text in ``contains``. First match wins;
# dimension rules are tried before metric rules.
#
# (key, role, equals, prefix, contains)
LAYOUT_B_RULES = [
    ("naic", "dim", "naic code", None, ()),
    ("company", "dim", "company name", None, ()),
    ("policy_type", "dim", "policy type", None, ()),
    ("pif_excl_wind", "metric", None, "number of policies in force", ("exclude wind",)),
    ("pif_incl_wind", "metric", None, "number of policies in force", ("include wind",)),
    ("pif", "metric", None, "total number of policies in force", ()),
    ("cancelled_hurricane", "metric", None, None, ("canceled due to hurricane",)),
    ("cancelled", "metric", None, None, ("policies canceled",)),
    ("nonrenewed_hurricane", "metric", None, None, ("nonrenewed due to hurricane",)),
    ("nonrenewed", "metric", None, None, ("policies nonrenewed",)),
    ("transferred_out", "metric", None, None, ("transferred to other insurers",)),
    ("new_written", "metric", None, None, ("new policies written",)),
    ("received_in", "metric", None, None, ("received from other insurers",)),
    ("tiv_excl_wind", "metric", None, None, ("value of exposure", "exclude wind")),
    ("tiv_incl_wind", "metric", None, None, ("value of exposure", "include wind")),
    ("tiv", "metric", None, None, ("value of exposure",)),
    ("dpw_excl_wind", "metric", None, None, ("direct premium written", "exclude wind")),
    ("dpw_incl_wind", "metric", None, None, ("direct premium written", "include wind")),
    ("dpw", "metric", None, None, ("direct premium written",)),
    ("claims_opened", "metric", None, "total number of claims opened", ()),
    ("claims_closed", "metric", None, "total number of claims closed", ()),
    ("claims_pending", "metric", None, "total number of claims pending", ()),
    ("lawsuits_closed_consumer", "metric", None, None, ("lawsuits closed with consideration",)),
    ("lawsuits_closed", "metric", None, "number of lawsuits closed", ()),
    ("lawsuits_opened", "metric", None, "number of lawsuits opened", ()),
    ("lawsuits_open_end", "metric", None, None, ("lawsuits open at end",)),
]

# Layout A. The premium rules come before the policy-count rules: their text
# contains the count rules' text, so in the other order they could never match.
LAYOUT_A_RULES = [
    ("rank", "dim", None, "rank by total", ()),
    ("company", "dim", "company name", None, ()),
    ("naic", "dim", "naic code", None, ()),
    ("a_dpw_commercial", "metric", None, None,
     ("direct premium written for policies in force that are commercial",)),
    ("a_dpw_personal", "metric", None, None,
     ("direct premium written for policies in force that are personal",)),
    ("a_pif_commercial", "metric", None, None, ("policies in force that are commercial",)),
    ("a_pif_personal", "metric", None, None, ("policies in force that are personal",)),
    ("a_pif", "metric", None, "total number of policies in force", ()),
    ("a_dpw", "metric", None, "total direct premium written for policies in force", ()),
]

# Anchor text of the header row and of the footer row; header search depth.
HEADER_ANCHOR = "company name"
HEADER_SCAN_ROWS = 10
TOTAL_ROW_NAME = "total"

# File-name tokens that select the layout (tried in this order).
LAYOUT_B_TOKEN = "by_company_and_policy_type"
LAYOUT_A_TOKEN = "by_company_and_commercial_personal"
PERIOD_TOKEN = r"(\d{4})q([1-4])"
PULL_TOKEN = r"(\d{8}t\d{6})"
PULLED_ON = r"(?i)data pulled on (.+?)\)"

# Segment text → line of business.
LINE_PREFIXES = [
    ("commercial residential", "Commercial Residential"),
    ("personal residential", "Personal Residential"),
]
OTHER_LINE = "Other"
WIND_ONLY_TEXT = "wind only"
SHORT_LINE_PREFIXES = [
    ("Commercial Residential - ", "C: "),
    ("Personal Residential - ", "P: "),
]
WIND_MARK = "〜 "
NULL_LABEL = "—"
OTHERS_LABEL = "All others"
ALL_TARGET = "__ALL__"
ALL_TARGET_NAME = "★ All carriers (filtered slice)"
CHECKSUM_TOLERANCE = 0.0001

# Metric catalogue: (id, label, kind, wind split, derived, ratio).
METRIC_ROWS = [
    ("pif", "Policies in force (PIF)", "count", True, False, False),
    ("tiv", "Exposure / TIV ($)", "money", True, False, False),
    ("dpw", "Direct premium written ($)", "money", True, False, False),
    ("new_written", "New policies written", "count", False, False, False),
    ("received_in", "Received (takeout / assumption)", "count", False, False, False),
    ("cancelled", "Policies cancelled", "count", False, False, False),
    ("cancelled_hurricane", "Cancelled — hurricane risk", "count", False, False, False),
    ("nonrenewed", "Policies nonrenewed", "count", False, False, False),
    ("nonrenewed_hurricane", "Nonrenewed — hurricane risk", "count", False, False, False),
    ("transferred_out", "Transferred to other insurers", "count", False, False, False),
    ("claims_opened", "Claims opened", "count", False, False, False),
    ("claims_closed", "Claims closed", "count", False, False, False),
    ("claims_pending", "Claims pending", "count", False, False, False),
    ("lawsuits_opened", "Lawsuits opened", "count", False, False, False),
    ("lawsuits_closed", "Lawsuits closed", "count", False, False, False),
    ("lawsuits_closed_consumer", "Lawsuits closed (for consumer)", "count", False, False, False),
    ("lawsuits_open_end", "Lawsuits open at end", "count", False, False, False),
    ("net_flow", "⊕ Net policy flow", "count", False, True, False),
    ("avg_premium", "⊕ Avg premium / policy ($)", "money", False, True, True),
    ("rate_on_line", "⊕ Rate-on-line (DPW/TIV)", "pct", False, True, True),
    ("wind_concentration", "⊕ Wind concentration (incl/total TIV)", "pct", False, True, True),
]

# Money scales for labels: (threshold, divisor, suffix), largest first.
MONEY_SCALES = [(1e12, 1e12, "T"), (1e9, 1e9, "B"), (1e6, 1e6, "M"), (1e3, 1e3, "K")]
FIXED_SCALE_SUFFIX = {1: "", 1000: "K", 1000000: "M", 1000000000: "B"}
TOPN_CHOICES = [10, 20, 30, 50, 9999]
# --------------------------------------------------------------------------- #
# end of fixed values
# --------------------------------------------------------------------------- #

# Components every derived metric is built from (null counts as 0 there).
DERIVED_PARTS = ["dpw", "pif", "tiv", "tiv_incl_wind", "new_written",
                 "received_in", "cancelled", "nonrenewed", "transferred_out"]


@dataclass(frozen=True)
class HeaderRule:
    key: str
    role: str
    equals: str | None = None
    prefix: str | None = None
    contains: tuple[str, ...] = field(default_factory=tuple)


@dataclass(frozen=True)
class Metric:
    id: str
    label: str
    kind: str
    wind: bool = False
    derived: bool = False
    ratio: bool = False


def header_rules(layout: str) -> list[HeaderRule]:
    rows = LAYOUT_B_RULES if layout == "B" else LAYOUT_A_RULES
    return [HeaderRule(*r) for r in rows]


METRICS = {r[0]: Metric(*r) for r in METRIC_ROWS}


def metric(metric_id: str) -> Metric:
    try:
        return METRICS[metric_id]
    except KeyError:
        raise ValueError(f"unknown metric {metric_id!r}; known: {sorted(METRICS)}") from None


def layout_b_metric_keys() -> list[str]:
    return [r[0] for r in LAYOUT_B_RULES if r[1] == "metric"]


def layout_a_metric_keys() -> list[str]:
    return [r[0] for r in LAYOUT_A_RULES if r[1] == "metric"]


def metrics_frame(spark):
    """The metric catalogue as a DataFrame (21 rows, fixed)."""
    return spark.createDataFrame(
        METRIC_ROWS, "id string, label string, kind string, wind boolean, "
                     "derived boolean, ratio boolean")
