"""Fixed values.

Word lists, patterns, formats and thresholds that define what an export means.
They are part of the data contract: changing one changes results.
"""

from __future__ import annotations

ACCOUNT = "(account)"
UNNAMED = "(unnamed)"

# Spellings of "no data", compared after decoration is removed and lowercased.
NO_DATA = ["", "-", "--", "---", "–", "—", "n/a", "na", "nan", "null", "nil", "none"]

# Characters dropped from a cell before it is read as a number.
CURRENCY_SYMBOLS = "$£€¥₹"

# Every Unicode white-space character.
SPACES = (
    "\t\n\x0b\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# A plain decimal number.
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"

# A number that carries no decoration and no separator to settle.
PLAIN_NUMBER = r"^-?[0-9]+([.][0-9]+)?$"

# Metric concepts in match order: (concept, addable, canonical count, patterns).
CONCEPTS = [
    ("cost per", False, 0,
     ["cpa", "cpc", "cpm", "cpv", "cpl", "cost per", "cost pe", "spend per", "revenue per",
      "value per"]),
    ("rate", False, 0,
     ["ctr", "cvr", "roas", "rate", "ratio", "share", "percent", "frequency", "avg", "average",
      "mean"]),
    ("revenue", True, 7,
     ["revenue", "conversion value", "conversions value", "conv value", "convs value",
      "purchase value", "purchases value", "sales", "turnover"]),
    ("conversions", True, 3,
     ["conversions", "conversion", "conv", "purchases", "purchase", "results", "result", "leads",
      "lead", "signups", "sign ups", "installs", "install", "registrations", "add to cart",
      "adds to cart", "orders", "order", "actions", "action"]),
    ("clicks", True, 2,
     ["clicks", "click", "landing page views", "landing page view", "taps", "tap", "visits",
      "sessions"]),
    ("impressions", True, 5,
     ["impressions", "impression", "impr", "imps", "imp", "views", "view", "plays"]),
    ("spend", True, 4, ["cost", "spend", "spent", "amount"]),
]

# Abbreviations whose denominator is implied.
IMPLIED_DENOMINATORS = [
    ("impressions", ["ctr", "click through rate", "cpm", "cpv"]),
    ("clicks", ["cpc", "cvr", "conversion rate"]),
    ("conversions", ["cpa", "cpl"]),
    ("spend", ["roas"]),
]

# Last words that make a numeric column an identifier.
IDENTIFIER_WORDS = ["id", "ids", "code"]

# Substrings of a column that is set rather than observed.
SETTING_PARTS = ["budget", "bid", "target", "limit", "cap"]

# Substrings of a column that is a ratio.
RATIO_PARTS = ["ctr", "rate", "%", "ratio", "share", "avg.", "avg ", "average"]

# Accented letters and their plain form.
ACCENTS_FROM = "àáâãäåèéêëìíîïòóôõöùúûüýÿñçšžð"
ACCENTS_TO = "aaaaaaeeeeiiiiooooouuuuyyncszd"
ACCENTS_LONG = [("œ", "oe"), ("æ", "ae"), ("þ", "th")]

# Words of a status column that say an entity is switched on or off.
STATES_ON = ["enabled", "active", "running", "live", "serving"]
STATES_OFF = ["paused", "removed", "ended", "disabled", "archived", "stopped", "deleted", "draft"]

# Header words that give away a date column that is not the first one.
DATE_HEADERS = ["day", "date", "days", "dates", "datum", "fecha", "data"]

# Concepts whose forecast cannot be negative.
NON_NEGATIVE = ["spend", "impressions", "clicks", "conversions", "cost per"]

# Limits and thresholds.
MIN_DAYS = 32
IMPORT_MIN_DAYS = 90
IMPORT_GOOD_DAYS = 365
IMPORT_BEST_DAYS = 730
MAX_CROSSING = 0.05
NEGLIGIBLE_SCALE = 1e-6
SHOWN_NAMES = 12

# History windows, longest first (0 = everything), and the averaged one.
WINDOWS = [("full", 0), ("270d", 270), ("90d", 90)]
AVERAGE_WINDOW = "90d"
AVERAGE_LABEL = "average@90d"

# The quantile grid of the native forecasters.
GRID = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
