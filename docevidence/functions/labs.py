"""Laboratory values, printed ranges, flags and delimited rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docevidence.functions.text import WS, trim

# Header patterns by role, in order of precedence, and printed flags.
ROLES = [
    ("referenceRange", r"\b(ref(erence)?|normal|biological)\b.*|\brange\b|\binterval\b"),
    ("unit", r"^units?\b"),
    ("flag", r"^(flag|status|remarks?|interpretation|abnormal|h\s*/\s*l)\b"),
    ("date", r"^(date|collected|reported)\b"),
    ("result", r"^(result|value|observed( value)?|reading|your value)\b"),
    ("test", r"^(test|tests|investigation|parameter|analyte|component|test name|examination)\b"),
]
FLAGS = [("High", ["h", "hi", "high", "↑", "*h", "above"]), ("Low", ["l", "lo", "low", "↓", "*l", "below"]), ("Normal", ["n", "normal", "within range", "wnl"]), ("Critical", ["critical", "panic", "c", "hh", "ll"])]
NUMBER = r"-?\d+(?:[.,]\d+)?"


def column_role(header: Column) -> Column:
    """L1"""

    def role_of(h: Column) -> Column:
        out = F.lit(None).cast("string")
        for role, pattern in reversed(ROLES):
            out = F.when(h.rlike("(?i)" + pattern), role).otherwise(out)
        return out

    return F.transform(F.array(trim(header)), role_of)[0]  # trimmed once


def roles_of(cells: Column) -> Column:
    return F.transform(cells, column_role)


def is_lab_header(cells: Column) -> Column:
    """L2: names a test and a result column. Most rows have no cell that looks like a result's name; of the others alone the roles are found."""
    pattern = "(?im)" + dict(ROLES)["result"].replace("^", f"^{WS}*", 1)
    found = F.transform(F.array(F.filter(roles_of(cells), lambda r: r.isNotNull())), lambda roles: F.array_contains(roles, "test") & F.array_contains(roles, "result"))[0]
    return F.when(cells.isNotNull(), F.array_join(cells, "\n").rlike(pattern) & found)


def normalize_flag(flag: Column) -> Column:
    """L3: a known flag's label, any other as it is."""

    def label(f: Column) -> Column:
        out = f
        for name, words in reversed(FLAGS):
            out = F.when(F.lower(f).isin(words), name).otherwise(out)
        return out

    return F.transform(F.array(trim(flag)), label)[0]


def cell_number(cell: Column) -> Column:
    """L4: the number of a cell that is one, with an optional comparator before it."""
    return F.regexp_extract(F.replace(cell, F.lit(",")), r"^[<>≤≥]?\s*(-?\d+(?:\.\d+)?)\z", 1).try_cast("double")


def map_row(cells: Column, roles: Column) -> Column:
    """A row as a struct by the first column of each role; null without test or result. Plain expressions that repeat: generated code
    computes equal ones once a row, where ``cells`` and ``roles`` are columns."""

    def get(role: str) -> Column:
        cell = F.get(cells, F.array_position(roles, role).cast("int") - 1)
        plain = cell.between("!", "~") & F.right(cell, F.lit(1)).between("!", "~")  # begins and ends with a sign of ASCII
        value = F.when(plain, cell).otherwise(trim(cell))
        return F.when(value != "", value)

    row = F.struct(get("test").alias("test"), get("result").alias("result"), cell_number(get("result")).alias("numeric_result"), get("unit").alias("unit"), get("referenceRange").alias("reference_range"), normalize_flag(get("flag")).alias("flag"), get("date").alias("date"))
    return F.when(get("test").isNotNull() & get("result").isNotNull(), row)


def row_text(row: Column, page: Column | None = None) -> Column:
    """A row as searchable lines."""
    unit, ref = row["unit"], row["reference_range"]
    shown = F.concat(ref, F.when(unit.isNotNull() & ~F.contains(ref, unit), F.concat(F.lit(" "), unit)).otherwise(""))
    parts = [F.concat(row["test"], F.lit(":")), F.concat(F.lit("Result = "), F.concat_ws(" ", row["result"], unit)), F.concat(F.lit("Reference range = "), shown), F.concat(F.lit("Flag = "), row["flag"]), F.concat(F.lit("Date = "), row["date"])]
    return F.concat_ws("\n", *parts, *([F.concat(F.lit("Page = "), page.cast("string"))] if page is not None else []))


def _to_number(c: Column) -> Column:
    """Commas before three digits separate thousands, another is the decimal point."""
    return F.replace(F.regexp_replace(c, r",(?=\d{3}\b)", ""), F.lit(","), F.lit(".")).try_cast("double")


def result_number(value: Column) -> Column:
    """The leading number; none if the rest starts with a digit or comparator."""
    return _to_number(F.regexp_extract(trim(value), rf"^({NUMBER})(?:{WS}*[^\d<>=≤≥].*)?\z", 1))


# Parts of a printed range: two numbers with a dash or "to" between them, an upper bound, a lower bound.
BETWEEN = rf"(?i)({NUMBER}){WS}*(?:-|–|—|to){WS}*({NUMBER})"
AT_MOST, AT_LEAST = rf"(?i)^(?:<=|<|≤|up to|upto){WS}*({NUMBER})", rf"^(?:>=|>|≥){WS}*({NUMBER})"


def _bounds(text: Column) -> tuple[Column, Column, Column]:
    """low, high, and whether there is a range. Plain expressions that repeat: generated code computes equal ones once a row."""
    t = trim(text)
    number = lambda pattern, group=1: _to_number(F.regexp_extract(t, pattern, group))
    low, high, top, floor = number(BETWEEN), number(BETWEEN, 2), number(AT_MOST), number(AT_LEAST)
    two = F.regexp_extract(t, BETWEEN, 1) != ""
    there = F.when(two, F.coalesce(low < high, F.lit(False))).otherwise(top.isNotNull() | floor.isNotNull())
    return F.when(two, low).when(top.isNull(), floor), F.when(two, high).otherwise(top), there


def parse_range(text: Column) -> Column:
    """(low, high) of a printed range; null if it is none or not ascending."""
    low, high, there = _bounds(text)
    return F.when(there, F.struct(low.alias("low"), high.alias("high")))


def flag_from_range(value: Column, text: Column) -> Column:
    """Low, High or Normal against the printed range (bounds included); null if either can't be read."""
    low, high, there = _bounds(text)
    read = F.struct(result_number(value).alias("n"), low.alias("low"), high.alias("high"), there.alias("there"))  # each once
    return F.transform(F.array(read), lambda s: F.when(s["n"].isNull() | ~F.coalesce(s["there"], F.lit(False)), None).when(s["n"] < s["low"], "Low").when(s["n"] > s["high"], "High").otherwise("Normal"))[0]


def lab_is_out(flag: Column, is_abnormal: Column) -> Column:
    """The flag decides if there is one."""
    return F.when(flag.isNotNull() & (flag != ""), flag != "Normal").otherwise(F.coalesce(is_abnormal, F.lit(False)))


def same_test(a: Column, b: Column) -> Column:
    """Equal as letters and digits, or one contains the other (three at least)."""
    return same_key(test_key(a), test_key(b))


def test_key(c: Column) -> Column:
    """Letters and digits of a test's name."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def same_key(x: Column, y: Column) -> Column:
    """L11 for names that are test_keys already."""
    shorter, longer = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    return (x == y) | ((F.length(shorter) >= 3) & F.contains(longer, shorter))


def split_delimited(line: Column) -> Column:
    """Trimmed cells of a bar or tab row without empty outer ones; null if it is no row, empty for a separator row."""
    cells = F.transform(F.when(F.contains(line, F.lit("|")), F.split(line, r"\|")).when(F.contains(line, F.lit("\t")), F.split(line, "\t")), trim)
    full = F.transform(F.filter(F.transform(cells, lambda c, i: F.struct(i.alias("i"), c.alias("c"))), lambda s: s["c"] != ""), lambda s: s["i"])
    inner = F.when(F.size(full) > 0, F.slice(cells, F.array_min(full) + 1, F.array_max(full) - F.array_min(full) + 1))
    rule = F.forall(inner, lambda c: c.rlike(r"^:?-{2,}:?\z"))
    return F.when(F.size(inner) >= 2, F.when(rule, F.array().cast("array<string>")).otherwise(inner))


def pages_text(lab: Column) -> Column:
    """The page, or the pages, that a lab stands on."""
    several = F.when(F.size(lab["pages"]) > 0, F.concat(F.lit(" [pp."), F.array_join(F.transform(lab["pages"], lambda p: p.cast("string")), ", "), F.lit("]")))
    return F.coalesce(F.concat(F.lit(" [p."), lab["page"].cast("string"), F.lit("]")), several, F.lit(""))


def lab_text(lab: Column) -> Column:
    """One out-of-range lab (name, value, unit, normal_range, flag, is_abnormal, page, pages) as a list item."""
    given = lambda c, before, after="": F.coalesce(F.concat(F.lit(before), F.nullif(c, F.lit("")), F.lit(after)), F.lit(""))
    flag = F.coalesce(F.nullif(lab["flag"], F.lit("")), F.when(F.coalesce(lab["is_abnormal"], F.lit(False)), "abnormal").otherwise("normal"))
    return F.concat(F.lit("- "), lab["name"], F.lit(": "), lab["value"], given(lab["unit"], " "), given(lab["normal_range"], " (printed range ", ")"), F.lit(" - "), flag, pages_text(lab))
