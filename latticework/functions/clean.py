"""Scalar cleaning functions: Column in, Column out; everything stays in generated code."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mean "missing", by the kind of source they occur in.
NA_HISTORIC = ("", "na", "n/a", "nan", "null", "-")
NA_SPREADSHEET = ("", "n/a", "na", "-", "--")

NA_COMBINED = ("", "n/a")

# States by postal code.
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado",
    "CT": "Connecticut", "DE": "Delaware", "DC": "District of Columbia", "FL": "Florida", "GA": "Georgia",
    "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky",
    "LA": "Louisiana", "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota",
    "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire",
    "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York", "NC": "North Carolina", "ND": "North Dakota",
    "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island",
    "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont",
    "VA": "Virginia", "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming",
}

NUMBER = "^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def blank_to_null(c: Column) -> Column:
    """Trimmed text, or null if nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def is_na(c: Column, words: Iterable[str] = NA_HISTORIC) -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin(*words)


def lenient_number(c: Column, words: Iterable[str] = NA_HISTORIC) -> Column:
    """Number after dropping thousands commas, percent and dollar signs; missing words and other text are null.

    Only plain decimal notation counts: NaN, infinities and type suffixes are text here.
    """
    bare = F.trim(F.regexp_replace(c, "[,%$]", ""))
    return F.when(~is_na(bare, words) & bare.rlike(NUMBER), bare.try_cast("double"))


def non_negative(c: Column) -> Column:
    """The value if it is a number of at least zero."""
    return F.when(~F.isnan(c) & (c >= 0), c)


def leading_integer(c: Column) -> Column:
    """Integer at the start of a text such as a tied rank ("12T"); null without one."""
    return F.nullif(F.regexp_extract(c, "^\\s*([0-9]+)", 1), F.lit("")).try_cast("int")


def first_digits(c: Column) -> Column:
    """First run of digits, as text."""
    return F.nullif(F.regexp_extract(c, "[0-9]+", 0), F.lit(""))


def grade_point(c: Column) -> Column:
    """Grade point average over 0 and up to 5, repeated points read as one."""
    text = F.regexp_extract(F.regexp_replace(F.regexp_replace(c, "[.]{2,}", "."), "^[. ]+|[. ]+$", ""), "^[0-5]([.][0-9]{1,2})?", 0)
    v = F.nullif(text, F.lit("")).try_cast("double")
    return F.when((v > 0) & (v <= 5), v)


def percentage(c: Column, fraction_below: float = 1.0) -> Column:
    """Percentage between 0 and 100 with two decimals; values over 0 and under fraction_below are fractions."""
    v = F.nullif(F.regexp_extract(F.regexp_replace(c, "[%,]", ""), "-?[0-9]+([.][0-9]+)?", 0), F.lit("")).try_cast("double")
    v = F.when((v > 0) & (v < fraction_below), v * 100).otherwise(v)
    return F.when(v.between(0, 100), F.round(v, 2))


def money(c: Column) -> Column:
    """First amount in a text, rounded half to even, as a whole number."""
    v = F.regexp_replace(F.regexp_extract(c, "[0-9][0-9,]*([.][0-9]+)?", 0), ",", "")
    return F.rint(F.nullif(v, F.lit("")).try_cast("double")).cast("bigint")


def compact_number(c: Column) -> Column:
    """Whole numbers without decimals, others with at most four and no final zeros."""
    trimmed = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", c), "0+$", ""), "[.]$", "")
    return F.when(c == F.floor(c), c.cast("decimal(38,0)").cast("string")).otherwise(trimmed)


def percent_points(c: Column, decimals: int = 1) -> Column:
    """Fraction as percentage points, halves to even."""
    return F.bround(c * 100, decimals)


def complement(c: Column) -> Column:
    """100 - x for x between 0 and 100."""
    return F.when(c.between(0, 100), 100 - c)


def checked(c: Column, kind: str) -> Column:
    """struct(value, flag): a lenient number within the range of its kind, or the flag that says why not.

    Kinds: pct and inv_pct (0 to 100, the latter complemented), gpa (0 to 5), money (not negative), other.
    """
    v = lenient_number(c)
    # Flag by kind.
    flags = {"pct": "pct_oor", "inv_pct": "housing_pct_oor", "gpa": "gpa_oor", "money": "money_neg"}
    ok = {"pct": v.between(0, 100), "inv_pct": v.between(0, 100), "gpa": v.between(0, 5), "money": v >= 0}.get(kind, F.lit(True))
    shown = 100 - v if kind == "inv_pct" else v
    bare = F.trim(F.regexp_replace(c, "[,%$]", ""))
    flag = F.when(is_na(bare), None).when(v.isNull(), F.lit("nonnumeric")).when(~ok, F.lit(flags.get(kind)))
    return F.struct(F.when(v.isNotNull() & ok, shown).alias("value"), flag.alias("flag"))


def strip_if_number(c: Column, words: Iterable[str] = NA_SPREADSHEET) -> Column:
    """Text without commas, dollar and percent signs if that makes it a number; other text as it is."""
    t = F.trim(c)
    bare = F.regexp_replace(t, "[,%$]", "")
    return F.when(is_na(t, words), None).when(bare.rlike(NUMBER), bare).otherwise(t)


def split_last_comma(c: Column) -> Column:
    """struct(city, state) at the last comma; without one, all is city."""
    return F.struct(
        F.trim(F.when(c.contains(","), F.regexp_extract(c, "(?s)^(.*),", 1)).otherwise(c)).alias("city"),
        F.when(c.contains(","), F.trim(F.regexp_extract(c, "(?s)^.*,(.*)$", 1))).alias("state"),
    )


def academic_year(start: Column, end: Column) -> Column:
    """'2024' and '25' or '2025' as '2024-2025'."""
    end = F.trim(end)
    return F.concat_ws("-", start, F.when(F.length(end) == 2, F.concat(F.substring(start, 1, 2), end)).otherwise(end))


def year_from_url(c: Column) -> Column:
    """Academic year named in a url: the first pair of consecutive years, else the first year and the next."""
    pairs = F.regexp_extract_all(c, F.lit("(20[0-9]{2})[-_]((?:20)?[0-9]{2})(?![0-9])"), 0)
    both = F.transform(pairs, lambda p: F.struct(F.substring(p, 1, 4).cast("int").alias("a"), F.concat(F.substring(p, 1, 2), F.substring(p, -2, 2)).cast("int").alias("b")))
    good = F.filter(both, lambda p: p["b"] == p["a"] + 1)
    one = F.nullif(F.regexp_extract(c, "20[0-9]{2}", 0), F.lit("")).try_cast("int")
    year = F.coalesce(F.try_element_at(good, F.lit(1))["a"], one)
    return F.when(year.isNotNull(), F.concat_ws("-", year, year + 1))


def decode_entities(c: Column) -> Column:
    """The four common named entities, ampersand last."""
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def aliases(c: Column, wide_gaps: bool = False) -> Column:
    """Non-blank parts of an alias list split at bars, with wide_gaps also at two or more spaces."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "\\||\\s{2,}" if wide_gaps else "\\|"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def place_label(city: Column, state: Column) -> Column:
    """'city, state', or whichever is known, or an empty text."""
    return F.concat_ws(", ", blank_to_null(city), blank_to_null(state))


def display(c: Column, kind: str) -> Column:
    """Text of a value by kind: percent (of a fraction), currency, rank, number."""
    if kind == "percent":
        p = c * 100
        return F.concat(F.when(p < 10, F.format_string("%.1f", p)).otherwise(F.format_string("%.0f", p)), F.lit("%"))
    whole = F.format_number(F.round(c), 0)
    if kind == "currency":
        return F.concat(F.lit("$"), whole)
    if kind == "rank":
        return F.concat(F.lit("#"), whole)
    return F.when(c == F.floor(c), whole).otherwise(F.format_string("%.1f", c))


def stable_slot(c: Column, slots: int = 12) -> Column:
    """Stable slot of a key: h = 31 h + code over its characters in signed 32-bit arithmetic, |h| mod slots."""
    codes = F.filter(F.split(c.cast("string"), ""), lambda x: x != "")
    h = F.aggregate(codes, F.lit(0).cast("bigint"), lambda a, x: (a * 31 + F.ascii(x)).bitwiseAND(F.lit(0xFFFFFFFF)))
    signed = F.when(h >= 2**31, h - 2**32).otherwise(h)
    return (F.abs(signed) % slots).cast("int")


def rate_percent(acceptance: Column) -> Column:
    """Acceptance on a 0-100 scale: values up to 1 are fractions."""
    return F.when(acceptance <= 1, acceptance * 100).otherwise(acceptance)


def weighted_composite(reading: Column, math_: Column) -> Column:
    """Linear composite of two percentile scores, nulls as zero, one decimal."""
    # Fitted coefficients and intercept.
    return F.round(0.587 * F.coalesce(reading, F.lit(0.0)) + 0.801 * F.coalesce(math_, F.lit(0.0)) + 1.17, 1)


def code_label(c: Column, labels: dict, default: Column | None = None) -> Column:
    """Label of a code from a fixed table, else the default, else null."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    found = F.try_element_at(table, c)
    return found if default is None else F.coalesce(found, default)


def composite_price(reported: Column, public: Column, private: Column) -> Column:
    """First known of the reported, public and private average price."""
    return F.coalesce(reported, public, private)


def both_sum(a: Column, b: Column, decimals: int = 6) -> Column:
    """Sum of two parts, null unless both are known."""
    return F.round(a + b, decimals)


def contains_na(c: Column) -> Column:
    """Whether a cell is missing or has the word N/A anywhere in it."""
    return c.isNull() | (F.trim(c) == "") | F.upper(c).contains("N/A")


def state_name(c: Column) -> Column:
    """Name of a state by its code; other text as it is."""
    return code_label(F.upper(F.trim(c)), STATES, c)


def state_code(c: Column) -> Column:
    """Code of a state by its name; other text as it is."""
    return code_label(F.lower(F.trim(c)), {v.lower(): k for k, v in STATES.items()}, c)


def is_entity_id(c: Column) -> Column:
    """Whether an id is digits only."""
    return F.coalesce(c.cast("string").rlike("^[0-9]+$"), F.lit(False))


def cohort_year(edition: Column, shift: int = 2) -> Column:
    """Year of the cohort that an edition reports; the edition stays in a column of its own."""
    return edition.cast("int") - shift


def coordinate(c: Column) -> Column:
    """Latitude or longitude of a text cell; blanks and other text are null."""
    return blank_to_null(c.cast("string")).try_cast("double")


def name_or(c: Column, placeholder: str = "(Unnamed)") -> Column:
    """The name, or a placeholder where it is blank."""
    return F.coalesce(blank_to_null(c.cast("string")), F.lit(placeholder))


def nested_metric(metrics: Column, name: str) -> Column:
    """A metric of a map by name, null if it is absent."""
    return F.try_element_at(metrics, F.lit(name))


# Regions and their states, in the order in which they are shown.
REGIONS = {
    "New England": ["Connecticut", "Maine", "Massachusetts", "New Hampshire", "Rhode Island", "Vermont"],
    "Mid East": ["Delaware", "Washington DC", "Maryland", "New Jersey", "New York", "Pennsylvania"],
    "Great Lakes": ["Illinois", "Indiana", "Michigan", "Ohio", "Wisconsin"],
    "Plains": ["Iowa", "Kansas", "Minnesota", "Missouri", "Nebraska", "North Dakota", "South Dakota"],
    "Southeast": ["Alabama", "Arkansas", "Florida", "Georgia", "Kentucky", "Louisiana", "Mississippi", "North Carolina", "South Carolina", "Tennessee", "Virginia", "West Virginia"],
    "Southwest": ["Arizona", "New Mexico", "Oklahoma", "Texas"],
    "Rocky Mountains": ["Colorado", "Idaho", "Montana", "Utah", "Wyoming"],
    "Far West": ["Alaska", "California", "Hawaii", "Nevada", "Oregon", "Washington"],
}

# Columns of the race codes of enrolment files.
RACES = {1: "pct_white", 2: "pct_black", 3: "pct_hispanic", 4: "pct_asian", 5: "pct_aian", 6: "pct_nhpi", 7: "pct_two_or_more", 8: "pct_international", 9: "pct_unknown"}


def region_of(state: Column) -> Column:
    """Region of a state by its name; null for others."""
    return code_label(state, {name: region for region, names in REGIONS.items() for name in names})


def race_column(code: Column) -> Column:
    """Column of an enrolment file's race code; null for totals and others."""
    return code_label(code.cast("int"), RACES)
