"""Units of measure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The units that a product may have, and the spellings that stand for one.
PRODUCT_UNITS = ("pièce", "m", "m²", "kg", "L", "sac", "rouleau", "boîte", "seau", "panneau", "cartouche", "plaque")
SPELLINGS = {
    "pièce": ("piece", "pièce", "pieces", "pièces", "pcs", "u", "unité", "unite"),
    "m": ("m", "ml", "mètre", "metre", "mètres", "metres"),
    "m²": ("m2", "m²", "m^2", "mètres²", "metres2"),
    "kg": ("kg", "kilo"),
    "L": ("l", "litre", "litres"),
    "sac": ("sac",),
    "rouleau": ("rouleau",),
    "boîte": ("boite", "boîte"),
    "seau": ("seau",),
    "panneau": ("panneau",),
    "cartouche": ("cartouche",),
    "plaque": ("plaque",),
    "lot": ("lot",),
}


def normalize_unit(raw) -> Column:
    """The usual spelling of a unit; an unknown one stays as it is, blank becomes null."""
    text = F.trim(F.col(raw) if isinstance(raw, str) else raw)
    key = F.replace(F.lower(text), F.lit(" "), F.lit(""))
    out = F.when(text == "", F.lit(None).cast("string"))
    for unit, ways in SPELLINGS.items():
        out = out.when(key.isin(*ways), F.lit(unit))
    return out.otherwise(text)


def units_compatible(product_unit, offer_unit) -> Column:
    """A product without a unit fits nothing; an offer without one has its product's."""
    p, s = normalize_unit(product_unit), normalize_unit(offer_unit)
    return F.when(p.isNull(), False).when(s.isNull(), True).otherwise(p == s)


def allowed_unit(raw) -> Column:
    return normalize_unit(raw).isin(*PRODUCT_UNITS)
