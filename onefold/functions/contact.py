"""E-mail addresses, phone numbers and GitHub handles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from onefold.functions.text import trimmed

#: Calling codes of countries, with the least and most digits of a national number.
CALLING_CODES = {
    "20": (8, 10), "27": (9, 9), "30": (10, 10), "31": (9, 9), "32": (8, 9), "33": (9, 9), "34": (9, 9), "36": (8, 9), "39": (6, 11), "40": (9, 9),
    "41": (9, 9), "43": (4, 13), "44": (9, 10), "45": (8, 8), "46": (7, 10), "47": (8, 8), "48": (9, 9), "49": (5, 13), "51": (8, 9), "52": (10, 10),
    "54": (10, 11), "55": (10, 11), "56": (9, 9), "57": (10, 10), "58": (10, 10), "60": (8, 10), "61": (9, 9), "62": (7, 12), "63": (8, 10), "64": (8, 10),
    "65": (8, 8), "66": (8, 9), "81": (9, 10), "82": (8, 10), "84": (9, 10), "86": (10, 11), "90": (10, 10), "91": (10, 10), "92": (9, 10), "93": (9, 9),
    "94": (9, 9), "95": (7, 10), "98": (10, 10), "212": (9, 9), "213": (8, 9), "216": (8, 8), "234": (8, 10), "254": (9, 9), "255": (9, 9), "256": (9, 9),
    "351": (9, 9), "352": (6, 11), "353": (7, 9), "354": (7, 9), "355": (8, 9), "356": (8, 8), "357": (8, 8), "358": (5, 12), "359": (7, 9), "370": (8, 8),
    "371": (8, 8), "372": (7, 8), "373": (8, 8), "374": (8, 8), "375": (9, 9), "380": (9, 9), "381": (8, 9), "385": (8, 9), "386": (8, 8), "420": (9, 9),
    "421": (9, 9), "852": (8, 8), "853": (8, 8), "880": (8, 10), "886": (8, 9), "961": (7, 8), "962": (8, 9), "965": (8, 8), "966": (9, 9), "971": (8, 9),
    "972": (8, 9), "974": (8, 8), "977": (8, 10), "995": (9, 9), "998": (9, 9), "7": (10, 10),
}
#: North American numbers: an area code whose middle digit is no 9, and an exchange that is no service code.
NORTH_AMERICAN = "[2-9][0-8][0-9](?!.11)[2-9][0-9]{6}"

_ABROAD = "|".join(f"{code}[1-9][0-9]{{{low - 1},{high - 1}}}" for code, (low, high) in sorted(CALLING_CODES.items()))


def email(c: Column) -> Column:
    """Lower case, without white space and angle brackets around it; null unless it looks like local@domain.tld."""
    found = F.lower(F.regexp_replace(trimmed(c), "^[<>]+|[<>]+$", ""))
    return F.when(found.rlike(r"(?U)^[^@\s]+@[^@\s]+\.[^@\s]+$"), found)


def phone(c: Column) -> Column:
    """E.164, or null if it can't be a number in use.

    A number that begins with + is international, any other North American. Lengths and the North American plan are
    checked; which codes are assigned within other countries is not.
    """
    raw = trimmed(c)
    digits = F.regexp_replace(raw, r"[\s().\-/]", "")
    home = F.when(digits.rlike(f"^1?{NORTH_AMERICAN}$"), F.concat(F.lit("+1"), F.right(digits, F.lit(10))))
    abroad = F.when(digits.rlike(rf"^\+(1{NORTH_AMERICAN}|{_ABROAD})$"), digits)
    return F.when(raw.startswith("+"), abroad).otherwise(home)


def distinct_of(c: Column, normalize) -> Column:
    """The normalized values of an array, each once, in the order of their first use; nulls go."""
    return F.array_distinct(F.array_compact(F.transform(c, normalize)))


def handle(c: Column) -> Column:
    """A GitHub handle from a handle or a link to it; null if none is left."""
    raw = F.regexp_replace(trimmed(c), "/+$", "")
    own = F.when(raw.contains("github.com/"), F.substring_index(F.substring_index(raw, "github.com/", -1), "/", 1)).otherwise(raw)
    own = F.regexp_replace(own, "^@+", "")
    return F.when(own != "", own)
