"""Scalar parsers of store payloads, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP_WORDS = ("app", "free", "pro", "the")
SPLIT_AT = r"[-:|–—(]"


def parse_count(s: Column) -> Column:
    """Digits of a count; null, empty or digit-free text is 0."""
    return F.coalesce(F.regexp_replace(s, r"[^0-9]", "").try_cast("long"), F.lit(0).cast("long"))


def parse_float(s: Column) -> Column:
    return F.coalesce(F.trim(s).try_cast("double"), F.lit(0.0))


def parse_store_date(s: Column) -> Column:
    """'May 29, 2013' to a date; anything else null."""
    found = F.regexp_extract(F.trim(s), r"^([A-Z][a-z]{2} [0-9]{1,2}, [0-9]{4})$", 1)
    return F.try_to_date(F.when(found != "", found), "MMM d, yyyy")


def parse_compact_count(s: Column) -> Column:
    """'5M', '500k', '1.2B+', '100,000+' to a long; without a digit null."""
    text = F.lower(F.trim(s))
    number = F.regexp_extract(text, r"^([0-9]+(?:\.[0-9]+)?)\s*([kmb])\+?$", 1)
    unit = F.regexp_extract(text, r"^([0-9]+(?:\.[0-9]+)?)\s*([kmb])\+?$", 2)
    factor = F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "b", 1e9)
    compact = F.round(F.when(number != "", number).try_cast("double") * factor).cast("long")
    return F.coalesce(compact, F.regexp_replace(text, r"[^0-9]", "").try_cast("long"))


def parse_iso_date(s: Column) -> Column:
    found = F.regexp_extract(F.trim(s), r"^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    return F.try_to_date(F.when(found != "", found), "yyyy-MM-dd")


def parse_flexible_date(s: Column) -> tuple[Column, Column]:
    """(date, precision): store or ISO dates are 'day', a bare year is its 1 July, 'year'."""
    day = F.coalesce(parse_store_date(s), parse_iso_date(s))
    year = F.regexp_extract(F.trim(s), r"^((?:19|20)[0-9]{2})$", 1)
    middle = F.make_date(F.when(year != "", year).cast("int"), F.lit(7), F.lit(1))
    return F.coalesce(day, middle), F.when(day.isNotNull(), "day").when(middle.isNotNull(), "year")


def package_from_url(s: Column) -> Column:
    """The ``id`` parameter, else the last path segment if dotted, else the input."""
    text = F.trim(s)
    given = F.try_parse_url(text, F.lit("QUERY"), F.lit("id"))
    last = F.element_at(F.split(F.regexp_replace(text, r"[?#].*$", ""), "/"), -1)
    return F.coalesce(given, F.when(last.contains("."), last), text)


def keyword_from_title(title: Column) -> Column:
    """Head of a title without filler words; more than five words keep four; none is null."""
    head = F.element_at(F.split(F.lower(F.coalesce(title, F.lit(""))), SPLIT_AT), 1)
    words = F.filter(F.split(F.regexp_replace(head, r"[^a-z0-9 ]", " "), " "), lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    kept = F.when(F.size(words) > 5, F.slice(words, 1, 4)).otherwise(words)
    return F.when(F.size(kept) > 0, F.array_join(kept, " "))


def first_truthy(*columns: Column) -> Column:
    """The first value that is neither null nor zero, else 0."""
    return F.coalesce(*[F.nullif(c, F.lit(0).cast("long")) for c in columns], F.lit(0).cast("long"))


def human_number(n: Column) -> Column:
    """1234 as 1.2K, 3000000 as 3M, 4e9 as 4B.

    The quotient is rounded by its exact binary value, ties to even, as printf does in C,
    Python and SQL engines; Java's rounds the decimal digits half up (309650 to 309.7K).
    """

    def unit(size: float, mark: str) -> Column:
        x = n.cast("double") / size
        # from 1 on a fraction is a whole number of 2^-52, so tenths and rest are exact
        whole, part = F.floor(x), ((x - F.floor(x)) * 2.0**52).cast("long") * 10
        tenth, rest = F.shiftright(part, 52), part.bitwiseAND(2**52 - 1)
        up = (rest > 2**51) | ((rest == 2**51) & (tenth % 2 == 1))
        digits = F.regexp_replace((whole * 10 + tenth + up.cast("long")).cast("string"), r"(.)$", r".$1")
        # from 2^52 on there is no fraction
        shown = F.when(x < 2.0**52, digits).otherwise(F.format_string("%.1f", x))
        return F.concat(F.regexp_replace(shown, r"\.0$", ""), F.lit(mark))

    return F.when(n >= 1e9, unit(1e9, "B")).when(n >= 1e6, unit(1e6, "M")).when(n >= 1e3, unit(1e3, "K")).otherwise(n.cast("long").cast("string"))
