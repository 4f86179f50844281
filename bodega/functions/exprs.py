"""Column expressions shared by the operators (all JVM-side built-ins)."""
from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's.
VAT_RATE = Decimal("0.21")          # VAT on every order line, whatever the product's rate
DEFAULT_DELIVERY_DAYS = 7           # delivery date defaults to now + 7 days
DEFAULT_REPORT_DAYS = 30            # reports look back 30 days
ORDER_TYPE = "client"               # constant order type of the listings
DELIVERY_DEPOT = "deposito"         # bDeposito = 1
DELIVERY_ROUTE = "por reparto"      # anything else
STATE_PENDING = "Pendiente"         # state of a new order
MAX_ITEMS = 99                      # Item is two characters wide


def ts(value) -> Column:
    """A timestamp without zone as a literal (as_of is always passed in)."""
    if isinstance(value, dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S")
    return F.lit(str(value)).cast("timestamp_ntz")


def shift_days(value, days: float) -> Column:
    """``value`` + ``days`` days as a constant NTZ literal (folded by Catalyst)."""
    if not isinstance(value, dt.datetime):
        value = dt.datetime.fromisoformat(str(value))
    return ts(value + dt.timedelta(days=days))


def add_days(c: Column, days: int) -> Column:
    return c + F.make_dt_interval(F.lit(days))


def full_name(first: Column, last: Column) -> Column:
    """``first + ' ' + ISNULL(last, '')``: NULL first name gives NULL."""
    return F.concat(first, F.lit(" "), F.coalesce(last, F.lit("")))


def trimmed_full_name(first: Column, last: Column) -> Column:
    """``RTRIM(first) + ' ' + RTRIM(ISNULL(last, ''))``."""
    return F.concat(F.rtrim(first), F.lit(" "), F.rtrim(F.coalesce(last, F.lit(""))))


def delivery_type(b_deposito: Column) -> Column:
    return F.when(b_deposito == 1, F.lit(DELIVERY_DEPOT)).otherwise(F.lit(DELIVERY_ROUTE))


def deposit_flag(kind: Column) -> Column:
    return F.when(kind == DELIVERY_DEPOT, F.lit(1)).otherwise(F.lit(0)).cast("smallint")


def falsy_number(c: Column) -> Column:
    """JavaScript falsiness of a number: null, 0 or NaN."""
    return c.isNull() | (c == 0) | F.isnan(c.cast("double"))


def falsy_text(c: Column) -> Column:
    return c.isNull() | (c == "")


def or_default_number(c: Column, default) -> Column:
    """``x || default`` for a numeric field."""
    d = default if isinstance(default, Column) else F.lit(default)
    return F.when(falsy_number(c), d).otherwise(c)


def or_default_text(c: Column, default) -> Column:
    d = default if isinstance(default, Column) else F.lit(default)
    return F.when(falsy_text(c), d).otherwise(c)


def item_number(pos: Column) -> Column:
    """Two-digit, zero-padded line number (1 -> '01'); never cut."""
    return F.format_string("%02d", pos.cast("int"))


def money(c: Column) -> Column:
    return c.cast("decimal(18,2)")


def out_double(c: Column) -> Column:
    """Results leave as DOUBLE: sums are exact in decimal, then converted once."""
    return c.cast("double")
