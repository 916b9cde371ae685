"""Small column functions over supplier payloads: availability, packs, keys, sensitive names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.text import fold, let

#: Name parts that mark a payload's key as secret.
SENSITIVE = ("cookie", "set-cookie", "authorization", "auth_token", "access_token", "refresh_token", "session", "password", "secret", "api_key", "apikey", "bearer")


def availability_state(salable: Column, available: Column, label: Column) -> Column:
    """AVAILABLE, DELAYED, ORDER_ONLY or UNAVAILABLE, from two flags and a French label.

    A false flag or no label means unavailable; 'sous ... jours' is delayed; any other text can be ordered.
    """
    said = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    off = F.coalesce(~salable, F.lit(False)) | F.coalesce(~available, F.lit(False)) | (said == "")
    late = said.contains("sous") & said.contains("jour")
    return F.when(off, "UNAVAILABLE").when(said == "disponible", "AVAILABLE").when(late, "DELAYED").otherwise("ORDER_ONLY")


def purchasable_quantity(*counts: Column) -> Column:
    """The first positive whole count, else 0; what is no number is passed by."""
    whole = [c.try_cast("int") for c in counts]
    return F.coalesce(*(F.when(c > 0, c) for c in whole), F.lit(0))


def pack_quantity(raw: Column) -> Column:
    """Units of a pack, to three places; 1 for none, for no number, and for zero or less."""
    n = raw.try_cast("decimal(18,6)")
    return F.when(n > 0, F.round(n, 3)).otherwise(F.lit(1)).cast("decimal(12,3)")


def plain_value(raw: Column) -> Column:
    """A value as text that equals compare by: whole numbers without places, others to two, text folded; blank is null.

    A number is digits with a point or comma and digits after it; all of up to 28 digits before it are kept exactly.
    """

    def number(n: Column) -> Column:
        return let(F.regexp_replace(F.round(n, 2).cast("string"), r"\.?0+$", ""), lambda t: F.when(t.isin("-0", ""), "0").otherwise(t))

    def read(said: Column) -> Column:
        n = F.replace(said, F.lit(","), F.lit(".")).try_cast("decimal(38,10)")
        return F.when(said.rlike(r"^[+-]?\d+([.,]\d+)?$") & n.isNotNull(), let(n, number)).when(said != "", fold(said))

    return let(F.trim(raw), read)


def name_key(name: Column) -> Column:
    """A supplier's name as it is looked up: folded, with '_' and '-' as blanks."""
    return F.trim(F.translate(fold(name), "_-", "  "))


#: A string of a JSON text, and the colon after it if it is a key.
_JSON_STRING = r'("[^"\\]*+(?:\\.[^"\\]*+)*+"\s*:?)'


def has_sensitive_key(payload: Column) -> Column:
    """Whether any key of a JSON text, at any depth, holds a name part that marks a secret.

    The text is written anew from its parsed form, so that escapes are resolved, and taken apart into strings from
    its beginning: a quote inside a value opens none. A text that is no JSON is taken as it stands.
    """
    plain = F.coalesce(F.to_json(F.try_parse_json(payload)), payload)
    secret = "(?i)(?:" + "|".join(SENSITIVE) + ")"
    return F.exists(F.regexp_extract_all(plain, F.lit(_JSON_STRING), F.lit(1)), lambda k: k.endswith(":") & k.rlike(secret))


def line_token(project: Column, line: Column, place: Column) -> Column:
    """The key of a purchase line in a snapshot, as text."""
    return F.concat_ws(":", project.cast("string"), line.cast("string"), place)


def token_parts(token: Column) -> Column:
    """(project, line, place) of a line's key; place may hold colons; null if it isn't one."""
    found = F.regexp_extract(token, r"^(\d+):(\d+):(.+)$", 1)
    parts = F.struct(
        found.try_cast("long").alias("project"), F.regexp_extract(token, r"^(\d+):(\d+):(.+)$", 2).try_cast("long").alias("line"), F.regexp_extract(token, r"^(\d+):(\d+):(.+)$", 3).alias("place")
    )
    return F.when(found != "", parts)


def unit_mismatch(name: Column, unit: Column) -> Column:
    """What is wrong with a reference unit: profiles are counted in pieces, not metres; boards not in square metres."""
    said, u = F.lower(name), F.lower(F.trim(F.coalesce(unit, F.lit(""))))
    profile = said.contains("rail") | said.contains("montant") | said.contains("fourrure")
    return F.when(profile & u.isin("m", "ml", "mètre", "metre", "mètres", "metres"), "profile_in_metres").when(
        said.contains("plaque") & u.isin("m2", "m²", "m^2", "metre2", "mètre2"), "board_in_square_metres"
    )
