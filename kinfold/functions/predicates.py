"""Predicates over addresses and names, and the membership of filter lists, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

#: Four numbers between dots, at the end.
IPV4 = r"(?:\d+[.]){3}\d+\z"
#: RFC 4291: groups left out stand as two colons; else there are eight groups of hexadecimal digits, or a link-local zone follows at once.
IPV6 = r"::|[\da-fA-F](?::[\da-fA-F]{1,4}){7}|fe80:%[\da-zA-Z]"


def domain(email: Column) -> Column:
    """What follows the last at sign; the whole text if there is none."""
    return F.substring_index(email, "@", -1)


def first_domain(email: Column) -> Column:
    """What stands between the first at sign and the next one or the end; null without an at sign."""
    return F.try_element_at(F.split(email, "@"), F.lit(2))


def top_level(dom: Column) -> Column:
    """The last label of a domain."""
    return F.substring_index(dom, ".", -1)


def has_at(email: Column) -> Column:
    return F.contains(email, F.lit("@"))


def is_multiple_email(email: Column) -> Column:
    """Several at signs: more than one address in the field."""
    return F.length(email) - F.length(F.replace(email, F.lit("@"), F.lit(""))) > 1


def is_single_label(dom: Column) -> Column:
    """No dot in the domain; true for the empty string."""
    return ~F.contains(dom, F.lit("."))


def is_ip_domain(dom: Column) -> Column:
    """An IPv4 address at the end of the domain, or an IPv6 address anywhere in it."""
    return dom.rlike(IPV4) | dom.rlike(IPV6)


def in_list(values: set[str] | list[str] | DataFrame) -> Callable[[Column], Column]:
    """The membership predicate of a list: a small one stands in the plan, a frame of one column of any size is joined."""
    if isinstance(values, DataFrame):
        blank = F.lit("")  # neither side can be null, so the join needs no broadcast
        entries = values.select(F.coalesce(F.col(values.columns[0]), blank).alias("entry")).where("entry <> ''")
        return lambda c: F.coalesce(c, blank).isin(entries)
    members = sorted(values)
    return (lambda c: c.isin(*members)) if members else (lambda c: F.lit(False))


def recent_cutoff(as_of: datetime, months: int) -> datetime:
    """``as_of`` a number of months earlier; a day the earlier month does not have runs on into the next month."""
    from datetime import timedelta

    if months < 1:
        raise ValueError("months must be at least 1")
    year, month = divmod(as_of.year * 12 + as_of.month - 1 - months, 12)
    return as_of.replace(year=year, month=month + 1, day=1) + timedelta(days=as_of.day - 1)


def is_recent(when: Column, cutoff: datetime) -> Column:
    """Strictly after the cutoff."""
    return when > F.lit(cutoff)
