"""Quantities of quotes with their scale, unit and currency, compared exactly; column expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scale words as powers of ten, currencies by their names, and the shape of a quantity.
SCALE_POWERS = {"thousand": 3, "million": 6, "billion": 9, "trillion": 12}
CURRENCIES = {"usd": "USD", "$": "USD", "dollar": "USD", "dollars": "USD", "us dollar": "USD", "us dollars": "USD", "eur": "EUR", "€": "EUR", "euro": "EUR", "euros": "EUR", "krw": "KRW", "₩": "KRW"}
CURRENCY = r"USD|EUR|KRW|US dollars?|dollars?|euros?|[$€₩]"
QUANTITY = rf"(?i)({CURRENCY})?\s*(\d[\d,]*(?:\.\d+)?)\s*(thousand|million|billion|trillion)?\s*({CURRENCY}|units?|modules?|percent|%)?"
YEAR = r"\b(?<!\d\.)(?:19|20)\d{2}\b(?!\.\d)"  # no part of a decimal number
FORECAST = r"forecast|projected|expected|predict|전망|예상"
NOT_DEFINING = ("of", "the", "global", "worldwide", "in")
REASONS = ("definition", "geography", "currency", "dimension", "year", "scope", "capacity", "forecast", "amount", "unit")


def _lookup(table: dict, x: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in table.items() for v in pair]), x)


def exact(number: Column, power: Column) -> Column:
    """A number, written as digits, point and perhaps an exponent, times ten to ``power``, in the one form equal numbers share.

    Digits without zeros at either end, and a power of ten; any number of digits, nothing is rounded."""
    parts = lambda k: F.regexp_extract(number, r"^([-+]?)([0-9]*)\.?([0-9]*)(?:[eE]([-+]?[0-9]+))?$", k)
    digits = F.regexp_replace(F.concat(parts(2), parts(3)), "^0+", "")
    short = F.regexp_replace(digits, "0+$", "")
    own = F.coalesce(F.when(parts(4) != "", parts(4)).cast("int"), F.lit(0)) - F.length(parts(3)) + F.length(digits) - F.length(short) + power
    return F.when(short == "", F.lit("0")).otherwise(F.concat(F.when(parts(1) == "-", "-").otherwise(""), short, F.lit("e"), own.cast("string")))


def currency(x: Column) -> Column:
    return _lookup(CURRENCIES, F.lower(F.trim(x)))


def scale_power(x: Column) -> Column:
    """The power of ten of the first scale word that a text has, thousand before million and so on."""
    return F.coalesce(*[F.when(F.lower(x).rlike(rf"\b{w}\b"), F.lit(p)) for w, p in SCALE_POWERS.items()], F.lit(0))


def dimension(x: Column) -> Column:
    low = F.lower(x)
    return F.when(low.rlike(r"\bunits?\b|\bmodules?\b"), "count").when(low.contains("%") | low.rlike(r"\bpercent\b"), "percent")


def definition_words(x: Column) -> Column:
    """Words that define a market: letters only, without an s at the end, without places and articles."""
    words = F.regexp_extract_all(F.replace(F.lower(x), F.lit("production volume"), F.lit("production")), F.lit(r"[\p{L}\p{Nl}\p{No}]+"), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(*NOT_DEFINING))
    return F.array_distinct(F.transform(kept, lambda w: F.regexp_replace(w, "s+$", "")))


def metric_reason(metric: Column, quote: Column) -> Column:
    """'ok' if a quote states a metric, else what it fails at.

    ``metric``: struct of value (double), unit, currency, year (string), market_definition, geography, actual_or_forecast.  The quote
    has to name the market and the region; then one clause has to have the year (or none, and the quote has it), the
    market, capacity if and only if the market is one, a forecast if and only if the metric is, and a quantity of the same
    amount, dimension and currency.  The code is that of the clause that comes farthest.  Null fields count as empty.
    """
    field = lambda c: F.coalesce(metric[c].cast("string"), F.lit(""))
    text = F.trim(F.regexp_replace(F.lower(F.coalesce(quote, F.lit(""))), r"(?U)\s+", " "))
    market, unit = field("market_definition"), field("unit")
    words = definition_words(market)
    region = F.lower(F.trim(field("geography")))
    placed = F.when(region.isin("global", "worldwide"), text.rlike(r"\b(global|worldwide)\b")).otherwise(F.contains(text, region))
    asked = F.when(field("currency") != "", F.upper(field("currency")))
    first = F.regexp_extract(unit, f"(?i)({CURRENCY})", 1)
    in_unit = F.when(first != "", currency(first))
    kind = F.coalesce(dimension(unit), F.when(asked.isNotNull(), F.lit("money")))
    wanted = exact(field("value"), scale_power(unit))
    years = F.regexp_extract_all(text, F.lit(YEAR), F.lit(0))
    covers = lambda have: F.size(F.array_except(words, have)) == 0

    def quantity(clause):
        part = lambda k: F.regexp_extract_all(clause, F.lit(QUANTITY), F.lit(k))
        found = F.arrays_zip(part(1).alias("prefix"), part(2).alias("number"), part(3).alias("scale"), part(4).alias("unit"))

        def rank(q):
            amount = exact(F.replace(q["number"], F.lit(","), F.lit("")), F.coalesce(_lookup(SCALE_POWERS, F.lower(q["scale"])), F.lit(0)))
            money = F.coalesce(currency(q["prefix"]), currency(q["unit"]))
            own = F.coalesce(dimension(q["unit"]), F.when(money.isNotNull(), F.lit("money")))
            return F.when(amount != wanted, 8).when(~(own.eqNullSafe(kind) & money.eqNullSafe(asked)), 9).otherwise(10)

        return F.coalesce(F.array_max(F.transform(found, rank)), F.lit(8))

    def stage(clause):
        own = F.regexp_extract_all(clause, F.lit(YEAR), F.lit(0))
        dated = F.array_contains(F.when(F.size(own) > 0, own).otherwise(years), field("year"))
        return (
            F.when(~dated, 4).when(~covers(definition_words(clause)), 5).when(F.lower(market).contains("capacity") != clause.contains("capacity"), 6)
            .when(clause.rlike(FORECAST) != (field("actual_or_forecast") == "forecast"), 7).otherwise(quantity(clause))
        )

    clauses = F.split(text, r"\s*,?\s+while\s+|;|(?<=[.!?])\s+")
    reached = F.array_max(F.transform(clauses, stage))
    failed = (
        F.when((F.size(words) == 0) | ~covers(definition_words(text)), 0).when(~placed, 1)
        .when(in_unit.isNotNull() & ~in_unit.eqNullSafe(asked), 2).when(kind.isNull(), 3).otherwise(reached)
    )
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, REASONS)), F.when(failed < 10, failed + 1)), F.lit("ok"))
