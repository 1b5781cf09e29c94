"""Phone numbers in international form, by calling code and national number.

Full number metadata is not available here: a number counts as valid if its national part has
the pattern below. That is an approximation of the real ranges, for the countries listed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Country: calling code, trunk prefix, pattern of the national number.
COUNTRIES = {
    "CY": ("357", "", r"[2789]\d{7}"),
    "GR": ("30", "", r"(?:2\d|6[89]|[789]0)\d{8}"),
    "GB": ("44", "0", r"[1-35789]\d{8,9}"),
    "DE": ("49", "0", r"[1-9]\d{5,11}"),
    "FR": ("33", "0", r"[1-9]\d{8}"),
    "ES": ("34", "", r"[5-9]\d{8}"),
    "IT": ("39", "", r"(?:0\d{5,10}|3\d{8,9}|8\d{5,9})"),
    "PT": ("351", "", r"[2-9]\d{8}"),
    "NL": ("31", "0", r"[1-9]\d{8}"),
    "BE": ("32", "0", r"[1-9]\d{7,8}"),
    "AT": ("43", "0", r"[1-9]\d{5,12}"),
    "CH": ("41", "0", r"[1-9]\d{8}"),
    "IE": ("353", "0", r"[1-9]\d{6,9}"),
    "PL": ("48", "", r"[1-9]\d{8}"),
    "RO": ("40", "0", r"[237]\d{8}"),
    "BG": ("359", "0", r"[2-9]\d{6,8}"),
    "TR": ("90", "0", r"[2-589]\d{9}"),
    "IL": ("972", "0", r"[2-9]\d{7,8}"),
    "BD": ("880", "0", r"(?:1[3-9]\d{8}|[2-9]\d{5,8})"),
    "US": ("1", "1", r"[2-9]\d{2}[2-9]\d{6}"),
}


def e164(raw: Column, country: Column) -> Column:
    """The number with + and calling code, or null if it is not valid for its country.

    A number with + or 00 names its country itself; any other is taken as a national number of
    ``country``. Extensions (x12, ext. 12) are dropped.
    """
    value = F.regexp_replace(F.regexp_replace(raw, r"^\s+|\s+$", ""), r"(?i)\s*(?:ext\.?|x|#)\s*\d{1,6}$", "")
    value = F.when(value.rlike(r"^[+(]?[0-9\s().\-/+]+$"), F.regexp_replace(value, r"\(0\)", ""))
    digits = F.regexp_replace(value, r"\D", "")
    abroad = value.rlike(r"^\(?\+") | digits.startswith("00")
    number = F.regexp_replace(digits, "^00", "")
    foreign, home, code = F, F, F.upper(country)
    for name, (calling, trunk, pattern) in COUNTRIES.items():
        foreign = foreign.when(number.rlike(f"^{calling}{pattern}$"), F.concat(F.lit("+"), number))
        national = F.regexp_replace(digits, f"^{trunk}", "") if trunk else digits
        home = home.when((code == name) & national.rlike(f"^{pattern}$"), F.concat(F.lit(f"+{calling}"), national))
    return F.when(abroad, foreign.otherwise(F.lit(None).cast("string"))).otherwise(home.otherwise(F.lit(None).cast("string")))
