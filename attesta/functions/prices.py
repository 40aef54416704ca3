"""Price, period and plan expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from attesta import constants as K

_NUMBER = r"\d[\d,]*(?:\.\d+)?"


def price_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({K.PRICE_TOKEN})"), 1)


def has_price(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(K.PRICE_TOKEN)


def price_currency(token: Column) -> Column:
    """Currency sign of a token; dollar spellings and codes fall together."""
    low = F.lower(F.coalesce(token, F.lit("")))
    out = None
    for spelling, sign in K.CURRENCY_OF:
        hit = F.contains(low, F.lit(spelling))
        out = F.when(hit, F.lit(sign)) if out is None else out.when(hit, F.lit(sign))
    return out.otherwise(F.regexp_extract(low, f"[{K.PRICE_SIGNS}]", 0))


def price_digits(token: Column, keep_leading_dot: bool = True) -> Column:
    """Digits without thousands commas.  '.012' keeps its dot unless told otherwise."""
    rx = rf"{_NUMBER}|\.\d+" if keep_leading_dot else _NUMBER
    token = F.regexp_replace(F.coalesce(token, F.lit("")), r"(?i)Rs\.", "Rs")
    return F.replace(F.regexp_extract(token, rx, 0), F.lit(","), F.lit(""))


def price_key(token: Column, keep_leading_dot: bool = True) -> Column:
    """'currency|digits': equal for '$39', 'US$39' and '39 USD'; '' without digits."""
    digits = price_digits(token, keep_leading_dot)
    return F.when(digits == "", F.lit("")).otherwise(
        F.concat(price_currency(token), F.lit("|"), digits))


def amount(c: Column) -> Column:
    """First number of a price text as DECIMAL."""
    num = F.replace(F.regexp_extract(F.coalesce(c, F.lit("")), f"({_NUMBER})", 1), F.lit(","), F.lit(""))
    return F.nullif(num, F.lit("")).cast("decimal(18,4)")


def digits_only(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\d.]", "")


def normal_period(c: Column) -> Column:
    """Billing period as '/mo', 'billed', '/yr', '' or the text itself when unknown."""
    per = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), K.PERIOD_UNIT, ""))
    month, year = per.rlike(K.PERIOD_MONTH), per.rlike(K.PERIOD_YEAR)
    return (F.when(month & year, F.lit("billed")).when(month, F.lit("/mo"))
            .when(per.rlike(K.PERIOD_BILLED), F.lit("billed")).when(year, F.lit("/yr"))
            .otherwise(per))


def is_free_plan(name: Column, price: Column) -> Column:
    return (F.trim(F.coalesce(name, F.lit(""))).rlike(K.FREE_NAME)
            | F.lower(F.trim(F.coalesce(price, F.lit("")))).isin(K.FREE_PRICES))


def is_custom_plan(name: Column, price: Column) -> Column:
    name, price = F.coalesce(name, F.lit("")), F.coalesce(price, F.lit(""))
    return (~is_free_plan(name, price) & ~price.rlike(r"\d")
            & (name.rlike(K.CUSTOM_WORDS) | price.rlike(K.CUSTOM_WORDS)))


def is_no_period_plan(name: Column, price: Column) -> Column:
    return is_free_plan(name, price) | is_custom_plan(name, price)


def is_price_statement(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(K.PRICE_STATEMENT)


def is_annual(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(K.AUDIT_ANNUAL)


def is_monthly(c: Column) -> Column:
    p = F.trim(F.coalesce(c, F.lit("")))
    return (p != "") & ~is_annual(p) & p.rlike(K.AUDIT_MONTHLY)
