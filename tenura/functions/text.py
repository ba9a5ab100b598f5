"""Text to typed values, as Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenura.params import MISSING_MARKERS

# White space at both ends, no-break space included.
STRIP_PATTERN = r"(?U)^\s+|\s+$"

# Plain decimal notation; checked before any cast because a cast alone accepts "30d" or "inf".
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

# Date formats in the order they are tried. Both slash conventions are listed;
# a column uses one of them, see `slash_convention`.
DATE_FORMATS = (
    ("%Y-%m-%d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("%Y/%m/%d", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("%d/%m/%Y", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("%m/%d/%Y", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("%d-%m-%Y", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("%d.%m.%Y", r"^\d{1,2}\.\d{1,2}\.\d{4}$"),
    ("%d %b %Y", r"^\d{1,2} [A-Za-z]{3} \d{4}$"),
    ("%d %B %Y", r"^\d{1,2} [A-Za-z]{4,} \d{4}$"),
    ("%Y%m%d", r"^\d{8}$"),
)


def strip(c: Column) -> Column:
    """Remove leading and trailing Unicode white space, no-break space included."""
    return F.regexp_replace(c, STRIP_PATTERN, "")


def normalise(c: Column) -> Column:
    """Stripped, lower-case label; null stays null."""
    return F.lower(strip(c))


# The functions below take a column name and build one SQL expression: a wide raw table has
# dozens of such columns, and one parsed expression is far cheaper to plan than nested calls.


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _replace(e: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({e}, r'{pattern}', '{replacement}')"


def _strip(e: str) -> str:
    return _replace(e, STRIP_PATTERN, "")


def _to_double(e: str) -> str:
    """Number in plain notation, else null (no match extracts "", which casts to null)."""
    return f"try_cast(regexp_extract({e}, r'{NUMBER_PATTERN}', 0) AS DOUBLE)"


# Repair of a hand-written number, one rewrite after the other. Each step reads its input once,
# so the expression stays linear in size.
REPAIRS = (
    (r"[  ]", ""),  # no-break spaces
    (r"[€$£%]", ""),  # symbols
    (STRIP_PATTERN, ""),
    (r"(?i)(\d)\s*(?:h|j|min)$", "$1"),  # unit after the last digit
    (r"(?s),(?=.*\.[^,.]*$)", ""),  # last separator is a point: commas are thousands
    (r"^(\d{1,3}),(\d{3})$", "$1$2"),  # single comma before exactly three digits: thousands
    (r"(?s)\.(?=.*,[^,.]*$)", ""),  # last separator is a comma: points are thousands
    (",", "."),  # any comma left is decimal
    (r"(\d)\s+(\d)", "$1$2"),  # spaces between digits
)


def _number(column: str) -> str:
    plain = _name(column)
    v = _strip(plain)
    for pattern, replacement in REPAIRS:
        v = _replace(v, pattern, replacement)
    return f"coalesce({_to_double(plain)}, {_to_double(v)})"


def number(column: str) -> Column:
    """Number of a text column; repairs run only where the value is not a plain number."""
    return F.expr(_number(column))


def is_plain_number(column: str) -> Column:
    return F.expr(f"{_strip(_name(column))} RLIKE r'{NUMBER_PATTERN}'")


def is_marker(column: str) -> Column:
    """True for a text that stands for a missing value, after strip and lower-casing."""
    markers = ", ".join(f"'{m}'" for m in MISSING_MARKERS)
    return F.expr(f"lower({_strip(_name(column))}) IN ({markers})")


def coercion_status(column: str) -> Column:
    """How `number` gets its value: direct, repare, manquant or irrecuperable."""
    markers = ", ".join(f"'{m}'" for m in MISSING_MARKERS)
    c = _name(column)
    return F.expr(
        f"CASE WHEN {c} IS NULL OR lower({_strip(c)}) IN ({markers}) THEN 'manquant' "
        f"WHEN {_strip(c)} RLIKE r'{NUMBER_PATTERN}' THEN 'direct' "
        f"WHEN {_number(column)} IS NOT NULL THEN 'repare' ELSE 'irrecuperable' END"
    )


def coerce_number(column: str) -> Column:
    """Text column to struct(value double, status)."""
    return F.struct(number(column).alias("value"), coercion_status(column).alias("status"))


# Numeric date shapes and their rewriting to year-month-day; the slash reading is separate.
DATE_REWRITES = (
    (r"^(\d{4})/(\d{1,2})/(\d{1,2})$", "$1-$2-$3"),
    (r"^(\d{1,2})-(\d{1,2})-(\d{4})$", "$3-$2-$1"),
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", "$3-$2-$1"),
    (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
)
SLASH = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"


def _date(column: str, month_first: str) -> str:
    order = f"CASE WHEN {month_first} THEN '$3-$1-$2' ELSE '$3-$2-$1' END"
    t = f"regexp_replace({_strip(_name(column))}, r'{SLASH}', {order})"
    for pattern, replacement in DATE_REWRITES:
        t = _replace(t, pattern, replacement)
    tries = [f"try_to_timestamp({t}, '{p}')" for p in ("yyyy-M-d", "d MMM yyyy", "d MMMM yyyy")]
    return f"CAST(coalesce({', '.join(tries)}) AS DATE)"


def parse_date(column: str, month_first: str = "false") -> Column:
    """Date of a text column in any of DATE_FORMATS.

    `month_first` is a boolean SQL expression, usually the name of a flag column.
    """
    return F.expr(_date(column, month_first))


def date_format_used(column: str, month_first: bool = False) -> Column:
    """Name of the format that reads a value, null when none does."""
    skipped = "%d/%m/%Y" if month_first else "%m/%d/%Y"
    t = _strip(_name(column))
    cases = " ".join(
        f"WHEN {t} RLIKE r'{shape}' THEN '{name}'" for name, shape in DATE_FORMATS if name != skipped
    )
    parsed = _date(column, str(month_first).lower())
    return F.expr(f"CASE WHEN {parsed} IS NOT NULL THEN CASE {cases} END END")
