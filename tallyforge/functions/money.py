"""Money, tax and pack arithmetic on decimal columns. All money rounds to cents, halves away from zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY, QUANTITY, RATE = "decimal(12,2)", "decimal(12,3)", "decimal(5,2)"
BASES = ("HT", "TTC")


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def money_round(amount) -> Column:
    return F.round(_col(amount), 2)


def basis(raw) -> Column:
    """A tax basis, HT where none is given."""
    return F.upper(F.coalesce(_col(raw), F.lit("HT")))


def requested_basis(raw: str | None) -> str:
    return raw if raw in BASES else "HT"


def comparable(source, vat, target: str) -> Column:
    """The bases are the same, or a VAT rate is known; an unknown rate is never taken as zero."""
    return (basis(source) == F.lit(target)) | _col(vat).isNotNull()


def convert(amount, source, vat, target: str) -> Column:
    """An amount in the basis ``target``, not rounded; null if the bases differ and no rate is known."""
    amount, factor = _col(amount).cast("decimal(20,4)"), (F.lit(100) + _col(vat).cast(RATE)).cast("decimal(7,2)")
    if target == "HT":
        other = (amount * F.lit(100).cast("decimal(3,0)")).cast("decimal(23,4)") / factor
    else:
        other = amount * factor / F.lit(100).cast("decimal(3,0)")
    return F.when(basis(source) == F.lit(target), amount.cast("decimal(38,12)")).when(_col(vat).isNotNull(), other.cast("decimal(38,12)"))


def converted(amount, source, vat, target: str) -> Column:
    """The converted amount as shown: rounded to cents."""
    return money_round(convert(amount, source, vat, target)).cast(MONEY)


def required_packs(quantity, reference_quantity) -> Column:
    """Whole packs that cover a quantity."""
    return F.ceil(_col(quantity).cast(QUANTITY) / _col(reference_quantity).cast(QUANTITY)).cast("int")


def packs_cost(price, packs, source, vat, target: str) -> Column:
    """Price of so many packs: converted as a total, then rounded."""
    total = _col(price).cast(MONEY) * _col(packs).cast("decimal(10,0)")
    return converted(total, source, vat, target)


def cents(amount) -> Column:
    return (_col(amount) * 100).cast("bigint")


def derived_vat(ht, ttc) -> Column:
    """VAT rate in percent from both prices, to two places; null out of 0 to 100 or without a positive HT price."""
    h, t = _col(ht).cast("decimal(12,4)"), _col(ttc).cast("decimal(12,4)")
    rate = F.round((t / F.when(h > 0, h) - 1) * 100, 2)
    return F.when(rate.between(0, 100), rate.cast(RATE))


def parse_rate(text) -> Column:
    """'20', '20,0' or ' 20.00 ' as a rate; null if blank, malformed or out of 0 to 100."""
    rate = F.replace(F.trim(_col(text)), F.lit(","), F.lit(".")).try_cast(RATE)
    return F.when(rate.between(0, 100), rate)


def parse_money_even(text) -> Column:
    """Two places with halves to even, as live feeds are read."""
    return F.bround(F.replace(F.trim(_col(text)), F.lit(","), F.lit(".")).try_cast("decimal(18,6)"), 2).cast(MONEY)
