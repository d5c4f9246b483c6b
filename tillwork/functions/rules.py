"""Rule data: names, signatures, keywords, weights and thresholds used as defaults by the operators.

Every operator takes these as arguments, so another retailer passes its own lists.
"""

from __future__ import annotations

from dataclasses import dataclass

# Calendar.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august",
          "september", "october", "november", "december"]
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# Report signatures, looked up in this order in the first lines of a file.
REPORT_SIGNATURES = [
    ("monthly sales", "monthly_sales"),
    ("sales by items by group", "items_by_group"),
    ("average sales by menu", "avg_sales_menu"),
    ("customer orders (delivery)", "customer_orders"),
    ("sales by customer in details", "transaction_baskets"),
    ("time & attendance", "attendance"),
]
# The text each parser itself asks for.
PARSER_SIGNATURES = {
    "monthly_sales": "monthly sales",
    "items_by_group": "sales by items by group",
    "avg_sales_menu": "average sales by menu",
    "customer_orders": "customer orders",
    "transaction_baskets": "sales by customer in details",
    "attendance": "time & attendance",
}
# File names of the sources that are read by name.
SOURCE_FILES = {
    "monthly_sales_by_branch.csv": "monthly_sales",
    "rep_s_00334_1_smry.csv": "monthly_sales",
    "customer_orders_delivery.csv": "customer_orders",
    "rep_s_00150.csv": "customer_orders",
    "tax_summary_by_branch.csv": "tax_summary",
    "rep_s_00194_smry.csv": "tax_summary",
    "time_and_attendance_logs.csv": "attendance",
    "rep_s_00461.csv": "attendance",
    "sales_by_customer_detail_delivery.csv": "delivery_detail",
    "rep_s_00502.csv": "delivery_detail",
}

# Line patterns of the reports.
PAGE_BREAK = r"(?i)Page\s+\d+\s+of"
FOOTER = r"(?i)Copyright|All Rights Reserved|^REP_S_\d+,"
DATE_LINE = r"^\d{2}-\w{3}-\d{2}"
TOTAL_LINE = r"(?i)^\s*,?\s*Total"
NUMBER = r"^-?\d+\.?\d*$"
# Patterns inside report lines.
PERSON = r"Person_\d+"
STAMP = r"\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}"
EMPLOYEE = r"EMP ID\s*:\s*([\d.]+)"
EMPLOYEE_NAME = r"NAME\s*:\s*(Person_\d+)"
PUNCH_DATE = r"(\d{2}-\w{3}-\d{2})"
PUNCH_TIME = r"(\d{2}\.\d{2}\.\d{2})"

# Item categories by division text, the first match from the top wins.
CATEGORY_PATTERNS = [
    ("milkshake", r"(?i)shakes?|milkshakes?"),
    ("coffee_cold", r"(?i)frappes?|iced.?coffee|cold.?brew"),
    ("coffee_hot", r"(?i)hot.?coffee"),
    ("other_beverage", r"(?i)juice|lemonade|tea|smoothie|drink|mojito"),
]
BEVERAGE_CATEGORIES = ["coffee_hot", "coffee_cold", "milkshake", "other_beverage"]

# Keyword registry of the item classifier, class by class in order.
ITEM_KEYWORDS = {
    "coffee": ["coffee", "espresso", "cappuccino", "latte", "mocha", "americano", "macchiato",
               "cortado", "ristretto", "frappe", "cold brew", "flat white", "affogato", "lungo",
               "doppio", "cafe", "caffe"],
    "milkshake": ["milkshake", "milk shake", "shake", "smoothie"],
    "other_bev": ["juice", "lemonade", "tea", "matcha", "hot chocolate", "chocolate drink", "soda",
                  "water", "drink", "beverage"],
}
ITEM_EXCLUSIONS = ["sauce", "topping", "paste", "powder", "syrup", "flavour", "filling"]
TARGET_CLASSES = ["coffee", "milkshake"]
DELIVERY_MARKER = "DELIVERY CHARGE"

# Shift thresholds in hours.
SHIFT_TOO_SHORT = 2.0
SHIFT_TOO_LONG = 14.0

# Staffing constants.
SHARE_MIN, SHARE_MAX = 0.005, 0.20
SPREAD_HIGH, SPREAD_MEDIUM, SPREAD_LOW = 0.20, 0.35, 0.50
TARGET_FLOOR = 0.25
UPLIFT_CAP = 3.5
LOW_CONFIDENCE_MIN_SLOTS = 8
LOW_CONFIDENCE_CAP = 1.5
SHAPE_SUPPORT_ROWS = 12
SHAPE_SPARSE_RATIO = 4.0

# Forecast constants.
WMA_WEIGHTS = (0.5, 0.3, 0.2)
VOLATILITY_CAP = 0.75
SIMILARITY_BELOW = 4
SIMILARITY_WEIGHT = 0.5
HORIZON = 3

# Weights of the composite scores, in the order that breaks ties between drivers.
FEASIBILITY_WEIGHTS = {"growth": 0.30, "revenue": 0.25, "stability": 0.15, "avg_order": 0.15,
                       "delivery": 0.10, "ops_eff": 0.05}
POTENTIAL_WEIGHTS = {"low_attachment": 0.35, "order_volume": 0.35, "assoc_lift": 0.30}
RECONCILE_TOLERANCE = 0.10


@dataclass(frozen=True)
class AnomalyRule:
    """One growth rule: applies to ``entity`` (any if None) in ``month`` (any if None)."""

    label: str
    threshold: float
    direction: str  # "up": growth >= threshold, "down": growth <= threshold
    weight: float  # weight of such a month in the sensitive scenario, 0 drops it
    entity: str | None = None
    month: int | None = None


# Anomaly thresholds and weights; rules naming an entity are passed by the caller.
ANOMALY_RULES = (
    AnomalyRule("likely_partial_month", -0.80, "down", 0.0, month=12),
    AnomalyRule("potential_surge", 1.5, "up", 0.5, month=12),
)


@dataclass(frozen=True)
class RegionRule:
    """Wording and entities of one region of the expansion decision."""

    region: str
    title: str
    entity: str | None
    candidates: tuple[str, ...]
    warning: str | None = None
