"""Countries as ISO 3166 alpha-2 codes, and places of city, region and country."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from onefold.functions.text import clean, table, trimmed

#: Informal names and names in their own languages.
ALIASES = {
    "usa": "US", "u.s.a.": "US", "u.s.": "US", "us": "US", "america": "US", "united states": "US", "united states of america": "US",
    "uk": "GB", "u.k.": "GB", "britain": "GB", "great britain": "GB", "england": "GB", "united kingdom": "GB",
    "uae": "AE", "south korea": "KR", "republic of korea": "KR", "korea": "KR", "north korea": "KP", "russia": "RU", "bharat": "IN", "india": "IN",
    "deutschland": "DE", "nederland": "NL", "holland": "NL", "brasil": "BR", "espana": "ES", "españa": "ES", "italia": "IT", "suomi": "FI",
    "sverige": "SE", "norge": "NO", "danmark": "DK", "osterreich": "AT", "österreich": "AT", "schweiz": "CH", "suisse": "CH", "polska": "PL",
    "turkiye": "TR", "türkiye": "TR", "cesko": "CZ", "magyarorszag": "HU",
}
#: Official names that the JVM's tables lack.
OFFICIAL = {
    "russian federation": "RU", "viet nam": "VN", "korea, republic of": "KR", "korea, democratic people's republic of": "KP", "iran, islamic republic of": "IR",
    "syrian arab republic": "SY", "bolivia, plurinational state of": "BO", "venezuela, bolivarian republic of": "VE", "tanzania, united republic of": "TZ",
    "moldova, republic of": "MD", "lao people's democratic republic": "LA", "brunei darussalam": "BN", "taiwan, province of china": "TW", "czech republic": "CZ",
    "netherlands, kingdom of the": "NL", "hong kong": "HK", "macao": "MO", "palestine, state of": "PS", "holy see (vatican city state)": "VA", "côte d'ivoire": "CI",
}


@lru_cache(maxsize=1)
def _codes() -> tuple[tuple[str, str], ...]:
    """Lower-case codes and English names of all countries, from the JVM."""
    locale = SparkSession.active()._jvm.java.util.Locale
    found = {}
    for code in locale.getISOCountries():
        one = locale("", code)
        found |= {one.getDisplayCountry(locale.ENGLISH).lower(): code, one.getISO3Country().lower(): code, code.lower(): code}
    return tuple((found | OFFICIAL | ALIASES).items())


def country(c: Column) -> Column:
    return F.try_element_at(table(dict(_codes())), F.lower(trimmed(c)))


def place(c: Column) -> Column:
    """(city, region, country) of a struct with these fields."""
    return F.struct(clean(c["city"]).alias("city"), clean(c["region"]).alias("region"), country(c["country"]).alias("country"))


def place_of_text(c: Column) -> Column:
    """Of a text like "Paris, Ile-de-France, France": the last part if it is a country, then the first two that are left."""
    parts = F.filter(F.transform(F.split(c, ","), trimmed), lambda x: x != "")
    known = country(F.try_element_at(parts, F.lit(-1)))
    rest = F.when(known.isNotNull(), F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return F.struct(F.get(rest, F.lit(0)).alias("city"), F.get(rest, F.lit(1)).alias("region"), known.alias("country"))
