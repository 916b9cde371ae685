"""Text functions on designation columns: folding, tokens, measures, identifiers."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def let(value: Column, f) -> Column:
    """f(value) with ``value`` evaluated once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


@lru_cache
def _folding() -> tuple[str, str, dict[str, str]]:
    """Compatibility decomposition without combining marks, of all of Unicode but the Hangul syllables.

    Signs with one sign instead, then the marks, which translate() drops as they have no counterpart; and what
    becomes several signs.
    """
    one, to, gone, more = [], [], [], {}
    for c in map(chr, range(0x80, 0x110000)):
        if "\ud800" <= c <= "\udfff" or "\uac00" <= c <= "\ud7a3":
            continue
        d = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if d == c:
            continue
        if not d:
            gone.append(c)
        elif len(d) == 1:
            one.append(c)
            to.append(d)
        else:
            more[c] = d
    return "".join(one + gone), "".join(to), more


@lru_cache
def _several() -> str:
    """The signs that become several, and the Hangul syllables."""
    return "".join([*_folding()[2], *map(chr, range(0xAC00, 0xD7A4))])


def _expanded(text: Column) -> Column:
    """``text`` with each sign that decomposes into several written out; Hangul syllables by their arithmetic."""
    table = F.str_to_map(F.lit("\x01".join(f"{c}\x02{d}" for c, d in _folding()[2].items())), F.lit("\x01"), F.lit("\x02"))
    jamo = lambda first, n: F.lit("".join(map(chr, range(first, first + n))))

    def syllable(c: Column) -> Column:
        k = F.ascii(c) - 0xAC00
        tail = F.when(k % 28 > 0, F.substring(jamo(0x11A8, 27), k % 28, 1)).otherwise("")
        return F.concat(F.substring(jamo(0x1100, 19), F.floor(k / 588).cast("int") + 1, 1), F.substring(jamo(0x1161, 21), F.floor(k % 588 / 28).cast("int") + 1, 1), tail)

    sign = lambda c: F.when(F.ascii(c).between(0xAC00, 0xD7A3), syllable(c)).when(F.translate(c, _several(), "") != c, table[c]).otherwise(c)
    return F.array_join(F.transform(F.split(text, ""), sign), "")


#: The name of a column that holds a label in folded form; functions that are given the name don't fold it again.
FOLDED = "__folded"


def fold(text) -> Column:
    """Lower case without accents and in compatibility form (NFKD); letters that don't decompose (œ, ø) stay.

    ASCII texts only become lower case. Signs that become several (㎡, ﬃ, ½) are rare: only texts that hold one
    are taken apart.
    """
    if isinstance(text, str) and text == FOLDED:
        return F.col(FOLDED)
    one, to, _ = _folding()
    t = _col(text)
    whole = F.when(F.translate(t, _several(), "") != t, _expanded(t)).otherwise(t)
    return F.when(t.rlike(r"[^\x00-\x7F]"), F.lower(F.translate(whole, one, to))).otherwise(F.lower(t))


def parse_number(text) -> Column:
    """'2 500' or '2,50' as a decimal; null if it is none."""
    raw = F.replace(F.replace(F.trim(_col(text)), F.lit(" "), F.lit("")), F.lit(","), F.lit("."))
    return raw.try_cast("decimal(18,6)")


def to_mm(value, unit, low: int = 1, high: int = 10_000, bare_small_as_meters: bool = False) -> Column:
    """Millimetres, halves up, null out of bounds or for an unknown unit; no unit means mm, or m below 20 if asked for."""
    v, u = _col(value).cast("decimal(18,6)"), F.replace(F.lower(F.coalesce(_col(unit), F.lit(""))), F.lit(" "), F.lit(""))
    bare = F.when(v < 20, v * 1000).otherwise(v) if bare_small_as_meters else v
    mm = F.when(u.isin("m", "ml", "metre", "metres", "mètre", "mètres"), v * 1000).when(u == "cm", v * 10).when(u == "mm", v).when(u == "", bare)
    whole = F.round(mm, 0).cast("int")
    return F.when(whole.between(low, high), whole)


def tokens(text, least: int = 3) -> Column:
    """Folded words of ``least`` characters."""
    said = text if isinstance(text, str) and text == FOLDED else F.coalesce(_col(text), F.lit(""))
    return F.filter(F.regexp_extract_all(fold(said), F.lit(r"([\p{L}\p{N}_]+)")), lambda t: F.length(t) >= least)


def content_tokens(text, stopwords: tuple[str, ...] = (), least: int = 3) -> Column:
    """Tokens that are neither stop words nor bare numbers."""
    words = F.filter(tokens(text, least), lambda t: ~t.rlike(r"^\d+$"))
    return F.filter(words, lambda t: ~t.isin(*stopwords)) if stopwords else words


def bigrams(words) -> Column:
    """Neighbouring tokens, joined by a space."""
    w = _col(words)
    return F.when(F.size(w) < 2, F.array().cast("array<string>")).otherwise(
        F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(1))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    )


def idf(df, n) -> Column:
    """ln((n + 1) / (df + 1)) + 1 to four places; 0 without documents."""
    return F.when(_col(n) <= 0, 0.0).otherwise(F.round(F.log((_col(n) + 1) / (_col(df) + 1)) + 1, 4))


_NUMBER = r"(\d+(?:[.,]\d+)?)"


def _measure(text, units: dict[str, int], low: int, high: int) -> Column:
    """The first number with one of the units, in the smallest unit; null out of bounds."""
    folded = fold(text)
    pattern = rf"(?<![\d.,]){_NUMBER}\s*({'|'.join(sorted(units, key=len, reverse=True))})\b"
    value, unit = F.regexp_extract(folded, pattern, 1), F.regexp_extract(folded, pattern, 2)
    factor = F.lit(None).cast("int")
    for name, by in units.items():
        factor = F.when(unit == name, F.lit(by)).otherwise(factor)
    whole = F.round(F.replace(value, F.lit(","), F.lit(".")).try_cast("decimal(18,6)") * factor, 0).cast("int")
    return F.when(whole.between(low, high), whole)


def volume_ml(text) -> Column:
    return _measure(text, {"ml": 1, "cl": 10, "dl": 100, "l": 1000, "litre": 1000, "litres": 1000}, 1, 1_000_000)


def weight_g(text) -> Column:
    return _measure(text, {"g": 1, "gr": 1, "kg": 1000}, 1, 500_000)


def nominal_diameter(text) -> Column:
    n = F.regexp_extract(fold(text), r"\bdn\s*(\d{1,4})\b", 1).try_cast("int")
    return F.when(n.between(1, 2000), n)


def power_w(text) -> Column:
    n = F.regexp_extract(fold(text), r"\b(\d{1,5})\s*w(?:atts?)?\b", 1).try_cast("int")
    return F.when(n.between(1, 50_000), n)


# The forms of a diameter and a length in folded labels.
_PAIR = r"(?<![\d.,])(\d{1,2}(?:[.,]\d{1,2})?)\s*(?:mm)?\s*[x*×]\s*(\d{1,3}(?:[.,]\d{1,2})?)(?!\d)\s*(?:mm)?"


def diameter_lengths(text) -> Column:
    """array(struct(diameter_mm, length_mm)) of all pairs like 4,5x60 or Ø 4 x 40 mm, plausible or not, in their order."""
    num = lambda t, i: F.transform(F.regexp_extract_all(t, F.lit(_PAIR), F.lit(i)), lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("decimal(8,2)"))
    pair = lambda d, l: F.struct(d.alias("diameter_mm"), F.round(l, 0).cast("int").alias("length_mm"))  # noqa: E731, E741
    return let(fold(text), lambda t: F.zip_with(num(t, 1), num(t, 2), pair))


def diameter_length(text, d=(2, 8), l=(10, 200)) -> Column:  # noqa: E741
    """struct(diameter_mm, length_mm): the first pair within the bounds; implausible ones before it are skipped."""
    return F.try_element_at(F.filter(diameter_lengths(text), lambda p: p["diameter_mm"].between(*d) & p["length_mm"].between(*l)), F.lit(1))


# The forms of lengths, widths and thicknesses in lower-case labels without accents on e.
_SIZE = r"(\d+(?:[.,]\d+)?)\s*(mm|cm|m)?"
_BY = r"\s*[x*]\s*"
_LAST = r"(\d+(?:[.,]\d+)?)(\s?\+)?\s*(mm|cm|m)?"
_LABELLED = rf"l\.?\s*{_SIZE}\s*[x*]?\s*l\.?\s*{_SIZE}\s*[x*]?\s*(?:epaisseur|ep\.?|e\.?)\s*{_LAST}"
_TRIPLE = rf"(?:l\.?\s*)?{_SIZE}{_BY}(?:l\.?\s*)?{_SIZE}{_BY}(?:epaisseur|ep\.?\s*|e\.?\s*)?{_LAST}"
_PAIR_OF_SIDES = rf"(?:l\.?\s*)?{_SIZE}{_BY}(?:l\.?\s*)?{_SIZE}"
_THICKNESS = rf"(?:epaisseur|ep\.?)\s*{_SIZE}"


def _groups(text: Column, pattern: str, n: int) -> Column:
    return F.array(*(F.nullif(F.regexp_extract(text, pattern, i), F.lit("")) for i in range(1, n + 1)))


def _plain_label(text) -> Column:
    return F.translate(F.lower(_col(text)), "éèê×", "eeex")


def _sides(p: Column) -> Column:
    """struct(length_mm, width_mm) of two numbers with units, the longer first; one unit counts for both, none means metres below 20."""
    a, b = (to_mm(parse_number(p[i]), F.coalesce(p[i + 1], p[3 - i]), bare_small_as_meters=True) for i in (0, 2))
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(F.greatest(a, b).alias("length_mm"), F.least(a, b).alias("width_mm")))


def _thick(number: Column, unit: Column) -> Column:
    n = parse_number(number)
    return F.when(unit.isNull() & (n < 100), F.round(n, 0).cast("int")).otherwise(to_mm(n, F.coalesce(unit, F.lit("mm")), bare_small_as_meters=True))


def dimensions(text) -> Column:
    """struct(length_mm, width_mm, thickness_mm) from 'L. a x l. b x ep. c' or 'a x b x c', the longer side first.

    A unit at one of both sides counts for the other; without any, sides below 20 are metres. A bare third number
    below 100 is in mm. Doubled boards such as '13 + 80' give null.
    """

    def read(p: Column) -> Column:
        thick = _thick(p[4], p[6])
        whole = lambda s: F.when(s.isNotNull() & (thick > 0) & p[5].isNull(), F.struct(s["length_mm"], s["width_mm"], thick.alias("thickness_mm")))
        return let(_sides(p), whole)

    return let(_plain_label(text), lambda t: F.coalesce(*(let(_groups(t, p, 7), read) for p in (_LABELLED, _TRIPLE))))


def length_width(text) -> Column:
    """struct(length_mm, width_mm) of the first 'a x b', with or without a thickness after it."""
    return let(_groups(_plain_label(text), _PAIR_OF_SIDES, 4), _sides)


def thickness_alone(text) -> Column:
    """Thickness in mm after 'ép.' or 'épaisseur'; a bare number below 100 is in mm."""
    return let(_groups(_plain_label(text), _THICKNESS, 2), lambda p: _thick(p[0], p[1]))


def bar_length_mm(text) -> Column:
    """A bar's length between 500 and 12000 mm: 'longueur 3 m', 'L. 250 cm', '2,5 m', '3000 mm', in this order."""
    ways = (rf"\b(?:longueur|long\.?|lg\.?|l\.?)\s*[:=]?\s*{_NUMBER}\s*(mm|cm|m)\b", rf"(?<![\dx.,]){_NUMBER}\s*(m)\b(?!m|²|2)", rf"(?<![\dx.,]){_NUMBER}\s*(mm)\b", rf"(?<![\dx.,]){_NUMBER}\s*(cm)\b")
    found = lambda t: F.coalesce(*(let(F.array(F.regexp_extract(t, p, 1), F.regexp_extract(t, p, 2)), lambda x: to_mm(parse_number(x[0]), F.nullif(x[1], F.lit("")), 500, 12_000)) for p in ways))
    return let(fold(text), found)


# Packs and profiles in folded labels.
_PACK = r"\b(?:lot|pack|paquet|botte|colis|boite|bte|seau|sachet)\s*(?:de\s*)?(\d{1,4})\b(?!\s*(?:kg|g\b|mg|l\b|ml\b|cl\b|m\b|mm\b|cm\b|v\b|w\b))"
_PIECES = r"\b(\d{1,3}(?:\s\d{3})*|\d{1,5})\s*(?:pieces?|pcs?)\b"
_PROFILE = r"\b(r\s*48|r\s*70|r\s*90|r\s*100|m\s*48|m\s*70|m\s*90|f\s*45|m48\d{2})\b"
_RAIL = r"\brail\s+de\s+(48|70|90|100)\b"
_MONTANT = r"\bmontant\s+(48|70|90)\b"
_FOURRURE = r"\bfourrure\s+(?:profilee\s+)?(?:galvanisee?\s+)?(45)\b"


def _count(folded: Column, pattern: str, most: int) -> Column:
    n = F.regexp_replace(F.regexp_extract(folded, pattern, 1), r"\s", "").try_cast("int")
    return F.when(n.between(1, most), n)


def lot_quantity(text) -> Column:
    """Pieces in a lot, box or bag, up to 1000; a mass, a volume or a length is no count."""
    return _count(fold(text), _PACK, 1000)


def piece_count(text) -> Column:
    """Pieces in a pack up to 100000: 'N pièces' ('1 000 pièces' too) first, then 'lot de N', 'boîte N'."""
    return let(fold(text), lambda t: F.coalesce(_count(t, _PIECES, 100_000), _count(t, _PACK, 100_000)))


def profile_code(text) -> Column:
    """Metal profile of the known ones: its code (M4835 is M48), else by 'rail de 48', 'montant 48', 'fourrure 45'."""

    def read(t: Column) -> Column:
        of = lambda p: F.nullif(F.regexp_replace(F.regexp_extract(t, p, 1), r"\s", ""), F.lit(""))
        code = of(_PROFILE)
        return F.coalesce(F.upper(F.when(code.startswith("m48"), "m48").otherwise(code)), *(F.concat(F.lit(k), of(p)) for k, p in (("R", _RAIL), ("M", _MONTANT), ("F", _FOURRURE))))

    return let(fold(text), read)


# Diameters, wall thicknesses, sections and colours of bars in folded labels.
_DIAMETER = r"(?:[oø]\.?|diam(?:etre)?\.?)\s*(\d{1,2}(?:[.,]\d{1,2})?)\s*mm"
_DIAMETER_LENGTH = r"(?<![\d.,])(\d{1,2}(?:[.,]\d{1,2})?)\s*mm\s+\d+(?:[.,]\d+)?\s*m\b"
_TUBE = r"(?<![\d.,])(\d{1,2}(?:[.,]\d{1,2})?)\s*[x×*]\s*(\d{1,2}(?:[.,]\d{1,2})?)\s*mm"


def _figure(value: Column) -> Column:
    """A number without needless places, with a decimal comma."""
    return F.replace(F.regexp_replace(value.cast("decimal(8,2)").cast("string"), r"\.?0+$", ""), F.lit("."), F.lit(","))


def bar_profile(text) -> Column:
    """'D10': the diameter of a bar from 3 to 40 mm, by 'Ø 10 mm', else by '10 mm 2 m'."""

    def read(t: Column) -> Column:
        ways = (parse_number(F.regexp_extract(t, p, 1)) for p in (_DIAMETER, _DIAMETER_LENGTH))
        return F.concat(F.lit("D"), _figure(F.coalesce(*(F.when(d.between(3, 40), d) for d in ways))))

    return let(fold(text), read)


def tube_profile(text) -> Column:
    """'20X1,5': outer diameter (8 to 80 mm) and wall (0.5 to 5 mm) of a tube."""

    def read(t: Column) -> Column:
        d, wall = (parse_number(F.regexp_extract(t, _TUBE, i)) for i in (1, 2))
        return F.when(d.between(8, 80) & wall.between(0.5, 5), F.concat(_figure(d), F.lit("X"), _figure(wall)))

    return let(fold(text), read)


# Sections in mm and colours of angles in folded labels, the first that fits.
_SECTIONS = (
    r"(?:section|h\.?)\s*(\d{1,3}(?:[.,]\d{1,2})?)\s*[x×*]\s*(?:l\.?\s*)?(\d{1,3}(?:[.,]\d{1,2})?)\s*mm",
    r"(?<![\d.,])(\d{1,3}(?:[.,]\d{1,2})?)\s*[x×*]\s*(\d{1,3}(?:[.,]\d{1,2})?)\s*mm",
    r"l\.?\s*(\d{1,3})\s*mm\s*[x×*]\s*h\.?\s*(\d{1,3})\s*mm",
)
_COLOURS = {"gris_alu": r"gris\s+alu", "gris_titane": r"gris\s+titane", "blanc": "blanc", "noir": "noir", "gris": r"\bgris\b"}


def angle_profile(text) -> Column:
    """'20X30_blanc': both sides of an angle (3 to 120 mm, the smaller first) and its colour, '_ADH' if adhesive."""

    def read(t: Column) -> Column:
        def sides(p: str) -> Column:
            a, b = (parse_number(F.regexp_extract(t, p, i)) for i in (1, 2))
            return F.when(a.between(3, 120) & b.between(3, 120), F.concat(_figure(F.least(a, b)), F.lit("X"), _figure(F.greatest(a, b))))

        colour = F.coalesce(*(F.when(t.rlike(p), c) for c, p in _COLOURS.items()))
        return F.concat(F.coalesce(*map(sides, _SECTIONS)), F.lit("_"), colour, F.when(t.contains("adhesiv"), "_ADH").otherwise(""))

    return let(fold(text), read)


# Words of sets of unlike things, and of the small parts that are sold by number.
SETS = ("ensemble", "kit", "set", "meuble", "composition", "assortiment", "accessoire", "collection", "gamme", "coffret")
PARTS = ("vis", "cheville", "clou", "boulon", "ecrou", "rondelle", "rivet", "pointe", "agrafe", "tirefond", "goujon", "insert", "joint", "rail", "montant", "fourrure")


def reference_quantity(stored, designation) -> Column:
    """Units in a pack: the stored number unless it is 1, missing or not positive; then the label's count, for
    families of identical small parts only, and not for sets, mixed packs or a small bracketed count."""
    one = F.lit(1).cast("decimal(12,3)")
    base = F.when(_col(stored) > 0, _col(stored).cast("decimal(12,3)")).otherwise(one)
    folded = fold(F.coalesce(_col(designation), F.lit("")))
    spaced = F.regexp_replace(F.regexp_replace(folded, "tire[- ]fond", "tirefond"), "([+/])", " $1 ")

    def loose(words: Column) -> Column:
        """Whether the label names small parts of one kind, by its words."""
        has = lambda names: F.arrays_overlap(words, F.array(*(F.lit(x) for n in names for x in (n, n + "s"))))
        added = F.transform(words, lambda w, i: w.isin("vis", "cheville", "chevilles") & F.coalesce(F.get(words, i - 1).isin("+", "/", "avec", "et"), F.lit(False)))
        bracket = F.array_join(words, " ").rlike("patte(s|) a vis( |$)")
        together = (has(["cheville"]) & (has(["vis"]) | has(["patte"]))) | bracket | F.exists(added, lambda x: x)
        return has(PARTS) & ~has(SETS) & ~together

    few = F.coalesce(F.regexp_extract(folded, r"\( *([0-9]+) *pieces? *\)", 1).try_cast("int") <= 12, F.lit(False))
    n = piece_count(designation)
    counted = (base == one) & (n > 1) & ~few & let(F.split(spaced, "[^a-z0-9+/]+"), loose)
    return F.when(counted, n.cast("decimal(12,3)")).otherwise(base)


def ean(text) -> Column:
    """Digits of a bar code of 8, 12, 13 or 14 digits."""
    digits = F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"\D", "")
    return F.when(F.length(digits).isin(8, 12, 13, 14), digits)


def identity_code(prefix: str, identity, digits: int = 8) -> Column:
    """A product code from an identity: a prefix and hex digits of its SHA-1."""
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha1(_col(identity)), 1, digits)))


def own_key(label, reference) -> Column:
    """What a thing without any other identity goes by: its label, folded and squeezed, or its reference."""
    squeezed = F.trim(F.regexp_replace(fold(F.coalesce(_col(label), F.lit(""))), r"\s+", " "))
    return F.when(squeezed != "", squeezed).otherwise(F.concat(F.lit("sku:"), _col(reference)))


def strip_html(html) -> Column:
    """Text of a piece of HTML: line breaks kept, tags dropped, blanks squeezed, empty lines removed."""
    text = F.regexp_replace(_col(html), r"(?i)<br\s*/?>", "\n")
    text = F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", ""), r"[ \t]+", " ")
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: s != ""), "\n")


def search_key(text) -> Column:
    """Folded letters and digits with single spaces, for look-ups of addresses."""
    return F.trim(F.regexp_replace(fold(text), r"[^a-z0-9]+", " "))


def address_lines(street, postal_code, city) -> Column:
    """The street, and postal code and city, a line each; what is missing or blank leaves no line."""
    given = lambda c: F.nullif(F.trim(_col(c)), F.lit(""))
    place = F.nullif(F.concat_ws(" ", given(postal_code), given(city)), F.lit(""))
    return F.concat_ws("\n", given(street), place)


def contains_any(query: str, *columns: str) -> Column:
    """A literal, case-insensitive substring search over some columns; wildcards have no meaning."""
    q = F.lower(F.lit(query))
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(F.col(c)), q), F.lit(False))
    return found


def parse_timestamp(text) -> Column:
    """The first of some usual forms that fits; without a zone it is UTC (the session's zone)."""
    forms = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "dd/MM/yyyy HH:mm", "dd/MM/yyyy")
    return F.coalesce(*(F.try_to_timestamp(F.trim(_col(text)), F.lit(f)) for f in forms))


def http_url(text) -> Column:
    """An http(s) address with a host, at most 500 characters, blanks inside kept; anything else is null."""
    t = F.trim(_col(text))
    return F.when(t.rlike(r"(?i)^https?://[^/?#]+") & (F.length(t) <= 500), t)


def redact(text) -> Column:
    """An error message without secrets and addresses."""
    out = F.regexp_replace(_col(text), r"(?i)(token|key|secret|password|authorization)(\s*[=:]\s*)\S+", "$1$2***")
    return F.substring(F.regexp_replace(out, r"https?://\S+", "<url>"), 1, 500)
