"""Categories of a building-supplies catalogue whose identity is text: kind, decor, colour, format and the like.

A category is a table: what a folded label must and must not hold, and for each key of the identity where its value is
from: a measure that all categories share, the first of some patterns, or a fixed word. Measures are read once for each
label; a row then gives one claim for each category that it falls in.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import FOLDED, dimensions, fold, let, parse_number, to_mm
from tallyforge.operators.labels import by_label, stored
from tallyforge.operators.resolve import BOARD, BAGGED, IdentityModel

# Packs before a label, names in quotes or capitals, capitals that are no name, and signs that stand for x, ø and a blank.
_PACK = r"(?i)^(?:lot|pack|sachet|paquet|boite|set)\s+de\s+\d+\s+"
_QUOTED = '["«]([^"»]{2,40})["»]'
_CAPITALS = r"\b([A-Z][A-Z0-9]{2,})\b"
_NO_NAMES = ("LED", "PVC", "XPS", "MDF", "OSB", "PER", "USB", "NF", "DIN", "ISO", "AC4", "AC5", "AC6", "DIY", "BBC", "CEM", "CPJ")
_SIGNS = ("×✕⌀Ø∅\u00a0\u202f", "xxøøø  ")
# Forms of sizes in folded labels.
_N = r"(\d+(?:[.,]\d+)?)"
_SIDES = rf"{_N}\s*(mm|cm|m)?\s*[x]\s*(?:[lhp]|ep|e)?\.?\s*{_N}\s*(mm|cm|m)?(?:\s*[x]\s*(?:ep(?:aisseur)?|e)?\.?\s*{_N}\s*(mm|cm|m)?)?"
_LHP = rf"l\.?\s*{_N}\s*(?:cm|mm)?\s*x\s*h\.?\s*{_N}\s*(?:cm|mm)?\s*x\s*p\.?\s*{_N}\s*(cm|mm)?"
_ROUND = rf"(?:ø|diam(?:etre)?\.?)\s*:?\s*{_N}\s*(mm|cm)?"
_TRIPLE = rf"(?i){_N}\s*[x×]\s*{_N}\s*[x×]\s*{_N}\s*(mm|cm|m)\b"
# Colours, the longer phrases first, and finishes.
COLOURS = (
    "blanc pur", "blanc casse", "extra blanc", "gris anthracite", "gris clair", "gris fonce", "gris acier", "gris perle", "beige clair", "beige fonce", "bleu ciel", "bleu marine", "bleu canard", "bleu gris",
    "vert sapin", "vert olive", "chene clair", "chene gris", "chene naturel", "chene blanchi", "chene fonce", "ivoire", "creme", "sable", "taupe", "anthracite", "ardoise", "graphite", "basalte", "ficelle",
    "terracotta", "bordeaux", "moutarde", "sauge", "greige", "pierre", "blanc", "noir", "gris", "beige", "bleu", "rouge", "vert", "marron", "orange", "jaune", "rose", "violet", "inox", "chrome", "dore", "cuivre",
    "naturel", "incolore", "wenge", "noyer", "hetre", "pin", "teck", "bronze", "laiton", "lin", "argile", "kaki", "perle",
)
FINISHES = {r"\bbrillant\b": "brillant", r"\bvelours\b": "velours", r"\bsatine?e?\b": "satin", r"\blaque\b": "laque", r"\bmate?\b": "mat"}
CABLE_COLOURS = ("bleu", "rouge", "noir", "blanc", "marron", "orange", "violet", "gris", "vert", "jaune")


def strip_pack(label: Column) -> Column:
    """The label without the pack before it."""
    return F.regexp_replace(F.trim(label), _PACK, "")


def decor(label: Column) -> Column:
    """The name in quotes, else the first word in capitals that isn't a usual abbreviation, folded."""
    quoted = F.regexp_extract(label, _QUOTED, 1)
    names = F.filter(F.regexp_extract_all(label, F.lit(_CAPITALS), F.lit(1)), lambda w: ~w.isin(*_NO_NAMES))
    return F.when(quoted != "", F.nullif(F.btrim(fold(quoted), F.lit(" -")), F.lit(""))).otherwise(fold(F.try_element_at(names, F.lit(1))))


def _mm(number: Column, unit: Column, bare: str) -> Column:
    """Whole millimetres up to 8000; a number without a unit is in ``bare``."""
    n, by = parse_number(number), {"mm": 1, "cm": 10, "m": 1000}
    factor = F.when(unit == "mm", 1).when(unit == "cm", 10).when(unit == "m", 1000).otherwise(by[bare])
    return let(F.bround(n * factor, 0).cast("int"), lambda v: F.when(v.between(1, 8000), v))


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def last_pair(text: Column) -> Column:
    """struct(a, b, c, d, e, f): numbers and units of the last pair or triple of sizes with a unit, else of the last one; null without any."""
    found = F.struct(*(F.regexp_extract_all(text, F.lit(_SIDES), F.lit(i)).alias(n) for i, n in enumerate("abcdef", 1)))
    pairs = let(found, lambda g: F.transform(g["a"], lambda x, i: F.struct(*(F.nullif(g[n][i], F.lit("")).alias(n) for n in "abcdef"))))
    unit = lambda p: F.coalesce(p["b"], p["d"], p["f"]).isNotNull()
    return let(pairs, lambda ps: F.coalesce(F.try_element_at(F.filter(ps, unit), F.lit(-1)), F.try_element_at(ps, F.lit(-1))))


def _sized(m: Column, bare: str, lone: Column | None = None) -> Column:
    unit = F.coalesce(m["b"], m["d"], m["f"])
    sides = F.array(_mm(m["a"], unit, bare), _mm(m["c"], F.coalesce(m["d"], unit), bare))
    thick = _mm(m["e"], m["f"], "mm")
    return let(sides, lambda s: F.when(s[0].isNotNull() & s[1].isNotNull(), F.concat_ws("x", F.greatest(s[0], s[1]), F.least(s[0], s[1]), thick if lone is None else F.coalesce(thick, lone))))


def _lone_thickness(text: Column) -> Column:
    return let(_mm(_first(text, rf"\b{_N}\s*mm\b"), F.lit("mm"), "mm"), lambda t: F.when(t.between(4, 30), t))


def format_pair(text: Column, bare: str = "cm", loose_thickness: bool = False) -> Column:
    """'LxW' or 'LxWxT' in millimetres, the longer side first, of last_pair; a loose thickness may stand anywhere."""
    return let(last_pair(text), lambda m: _sized(m, bare, _lone_thickness(text) if loose_thickness else None))


def format_lhp(text: Column, pair: Column) -> Column:
    """'L..xH..xP..' of a cupboard in millimetres, else its pair of sides."""

    def size(g: Column) -> Column:
        values = F.transform(F.slice(g, 1, 3), lambda x: _mm(x, F.coalesce(g[3], F.lit("cm")), "cm"))
        whole = let(values, lambda v: F.when(F.forall(v, lambda x: x.isNotNull()), F.concat(F.lit("L"), v[0], F.lit("xH"), v[1], F.lit("xP"), v[2])))
        return F.when(g[0].isNotNull(), whole).otherwise(pair)

    return let(F.array(*(_first(text, _LHP, i) for i in range(1, 5))), size)


def _plain(number: Column) -> Column:
    """A number without needless zeros."""
    return F.regexp_replace(parse_number(number).cast("string"), r"\.?0+$", "")


def _quantity(text: Column, pattern: str, unit: str, low: float, high: float) -> Column:
    return let(_first(text, pattern), lambda n: F.when(parse_number(n).between(low, high), F.concat(_plain(n), F.lit(unit))))


def volume(text: Column) -> Column:
    ml = _first(text, rf"{_N}\s*ml\b")
    return F.coalesce(F.concat(_plain(ml), F.lit("ml")), _quantity(text, rf"{_N}\s*l(?:itres?)?\b", "l", 0, 30))


def weight(text: Column) -> Column:
    heavy = rf"{_N}\s*kg\b"
    return F.coalesce(_quantity(text, heavy, "kg", 0, 40), F.when(~text.rlike(heavy), _quantity(text, rf"{_N}\s*g\b", "g", 50, 5000)))


def diameter(text: Column) -> Column:
    known = _first(text, _ROUND)
    found = F.when(known.isNotNull(), _mm(known, _first(text, _ROUND, 2), "mm")).otherwise(_mm(_first(text, rf"\b{_N}\s*mm\b"), F.lit("mm"), "mm"))
    return let(found, lambda v: F.when(v <= 400, v.cast("string")))


def _between(text: Column, pattern: str, low: int, high: int) -> Column:
    return let(_first(text, pattern), lambda n: F.when(n.try_cast("int").between(low, high), n.try_cast("int").cast("string")))


def colour(text: Column) -> Column:
    plain = F.replace(F.replace(text, F.lit("blanche"), F.lit("blanc")), F.lit("blancs"), F.lit("blanc"))
    return let(plain, lambda t: F.coalesce(*(F.when(t.rlike(rf"(?<![a-z]){c}(?![a-z])"), F.lit(c.replace(" ", "_"))) for c in COLOURS)))


def canonical_box(label: Column) -> Column:
    """Three sizes of a block in millimetres, the greatest first: as a board's, with one unit for all, or as three lengths in cm."""
    prepared = F.regexp_replace(label, r"(?i)\b(mm|cm|m)\.", "$1 ")
    down = lambda a: F.reverse(F.array_sort(a))
    whole = lambda a: F.forall(a, lambda x: x.isNotNull())

    def read(t: Column) -> Column:
        board = let(dimensions(t), lambda d: F.array(d["length_mm"], d["width_mm"], d["thickness_mm"]))
        shared = F.array(*(to_mm(parse_number(_first(t, _TRIPLE, i)), F.lower(_first(t, _TRIPLE, 4))) for i in (1, 2, 3)))
        each = F.transform(F.regexp_extract_all(fold(t), F.lit(rf"{_N}\s*cm\b"), F.lit(1)), lambda x: to_mm(parse_number(x), F.lit("cm")))
        return F.when(whole(board) & (F.array_max(board) >= 200), down(board)).when(t.rlike(_TRIPLE), F.when(whole(shared), down(shared))).when((F.size(each) == 3) & whole(each), down(each))

    return let(prepared, read)


def within(box: Column, low: tuple[int, int, int], high: tuple[int, int, int]) -> Column:
    """The box if each of its sizes is in bounds."""
    inside = F.lit(True)
    for i in range(3):
        inside = inside & box[i].between(low[i], high[i])
    return F.when(inside, box)


def cable(text: Column) -> Column:
    """struct(kind, section_mm2, conductors, length_m, color) of a folded label, null unless all are there and one colour only."""
    compact = F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("-"), F.lit(""))
    kind = F.when(text.rlike("hifi|speedfil|coax|rj45|utp|ftp"), F.lit(None)).when(compact.contains("h07vu"), "h07vu").when(text.rlike(r"\br2v\b"), "r2v").when(compact.contains("h05vvf"), "h05vvf")
    grouped, crossed, single = rf"(\d)\s*g\s*{_N}", rf"(\d)\s*x\s*{_N}\s*mm", rf"{_N}\s*mm"
    size = lambda n: F.when((parse_number(n) > 0) & (parse_number(n) <= 35), _plain(n))
    section = F.when(text.rlike(grouped), size(_first(text, grouped, 2))).when(text.rlike(crossed), size(_first(text, crossed, 2))).otherwise(size(_first(text, single)))
    wires = F.when(text.rlike(grouped), _first(text, grouped)).when(text.rlike(crossed), _first(text, crossed)).when(kind == "h07vu", "1").try_cast("int")
    lengths = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)\s*m(?!m)\b"), F.lit(1)), lambda x: x.try_cast("int")), lambda n: n.between(5, 500))
    pair = r"(?s)^(.*?)vert\s*[/\-]\s*jaune"
    rest = F.regexp_replace(text, pair, "$1 ")
    found = F.array_compact(F.array(F.when(text.rlike(pair), F.lit("vert_jaune")), *(F.when(rest.rlike(rf"\b{c}\b"), F.lit(c)) for c in CABLE_COLOURS)))
    out = F.struct(kind.alias("kind"), section.alias("section_mm2"), wires.alias("conductors"), F.when(F.size(lengths) == 1, lengths[0]).alias("length_m"), F.when(F.size(found) == 1, found[0]).alias("color"))
    whole = lambda s: s["kind"].isNotNull() & s["section_mm2"].isNotNull() & s["length_m"].isNotNull() & s["color"].isNotNull() & s["conductors"].between(1, 5) & ((s["kind"] != "h07vu") | (s["conductors"] == 1))
    return let(out, lambda s: F.when(whole(s), s))


def _both(a: str, b: str) -> str:
    return f"(?s)^(?=.*{a})(?=.*{b})"


@dataclass(frozen=True)
class Category:
    """``needs`` are patterns of which a folded label must hold all, ``bans`` one that it must not hold.

    ``fields`` gives each key's source: the name of a measure, '=' and a word, patterns with their words in order, or several
    of these, of which the first that gives a value counts. Any(names, word) gives the word if one of the measures is there,
    All(names, word) if all are.
    """

    code: str
    label: str
    needs: tuple[str, ...]
    bans: str
    fields: dict = field(hash=False)
    of: IdentityModel | None = None

    @property
    def keys(self) -> tuple[str, ...]:
        return tuple(self.fields)

    @property
    def model(self) -> IdentityModel:
        return self.of or IdentityModel(f"CATALOG_{self.code}", self.keys, hierarchy=self.keys[:1])


@dataclass(frozen=True)
class Any:
    names: tuple
    word: str


@dataclass(frozen=True)
class All:
    names: tuple
    word: str


def _same(*words: str) -> dict[str, str]:
    return {w: w for w in words}


# The categories.
_CADENAS = r"^cadenas|^.{0,12} cadenas"
_OTHERS = "h07vu|h05vvf| r2v|beton cellulaire|siporex|ytong|polystyrene extrud|granul"
_SIDE = _same("gauche", "droit")
_ESSENCES = {"chene": "chene", "douglas": "douglas", "pin": "pin", "sapin|epicea": "sapin"}
_ASPECTS = {f"(?:aspect|effet) {x}": x for x in ("pierre", "bois", "beton", "marbre", "ciment", "metal", "uni")}
_COATS = "lasure|vitrificateur|saturateur|vernis|sous[ -]couche"
_ELECTRICAL = IdentityModel("ELECTRICAL_CABLE", ("kind", "section_mm2", "conductors", "length_m", "color"), hierarchy=("kind", "section_mm2", "conductors"), secondary=("material",))
_BOX = {"length_mm": "box0", "width_mm": "box1", "thickness_mm": "box2"}
CATEGORIES = (
    Category("BETON_CELLULAIRE", "Béton cellulaire", ("cellulaire|siporex|ytong",), "cheville|colle|trepan|frottoir|enduit|lot de|kit", {**{k: f"cell_{v}" for k, v in _BOX.items()}, "type": ({"angle": "angle", "chainage|linteau": "chainage", "carreau": "carreau"}, "=bloc")}, BOARD),
    Category("PARPAING", "Parpaing", ("parpaing", "bancher|angle|chainage|linteau|creux"), "crepi|trepan|colle|enduit|cheville|lot de|kit", {**{k: f"block_{v}" for k, v in _BOX.items()}, "type": {"bancher": "bancher", "angle": "angle", "chainage|linteau": "chainage", "creux": "creux"}}, BOARD),
    Category("POLYSTYRENE_XPS", "Polystyrène extrudé", ("polystyr|xps", "extrud|xps", "panneau|plaque"), "colle|corniche|moulure|doublage|dalle|plafond|frottoir|taloche|habillage|rosace|lot de|kit", {**{k: f"xps_{v}" for k, v in _BOX.items()}, "type": "=xps"}, BOARD),
    Category("GRANULE_BOIS", "Granulés de bois", ("granul", "bois"), "sable|piscine|ramonage|deshumid|silice|lot de", {"type": "=granule_bois", "weight_kg": "kg5_20"}, BAGGED),
    Category("CIMENT_CEM2", "Ciment CEM II", ("ciment", r"32[,.]5|\bcpj\b", "c *e *m *i *i|cpj"), "colorant|joint|prompt|epoxy|mortier|colle|blanc", {"type": "=ciment_cem2_325", "weight_kg": "kg10_40"}, BAGGED),
    Category("CABLE_ELEC", "Câble électrique", (r"h[ -]*0[ -]*7[ -]*v[ -]*u|\br2v\b|h[ -]*0[ -]*5[ -]*v[ -]*v[ -]*f",), "", {k: f"cable_{k}" for k in _ELECTRICAL.keys}, _ELECTRICAL),
    Category("CAT_PLINTHE", "Plinthe", ("plinthe",), "", {"decor": ("decor", {"chene clair": "chene_clair", **_same("chene", "blanc", "gris", "noir", "pierre", "beton")}), "material": ({"gres": "gres", "mdf": "mdf", "bois|chene": "bois"}, "=std"), "format": "format"}),
    Category("CAT_STRATIFIE", "Sol stratifié", ("stratif",), "kit de pose|pare vapeur|joint|plinthe|sous couche|film |plan de travail|plan travail", {
        "decor": ("decor", {"chene clair": "chene_clair", "chene gris": "chene_gris", "chene": "chene", "bois clair": "bois_clair", **_same("noyer", "pin", "beton", "hetre", "beige")}), "format": "format_loose", "usage": "=sol"}),
    Category("CAT_LAME", "Lame de sol ou terrasse", ("lame", "terrasse|pvc|vinyle|bardage|clin|sol"), "scie|taille|stratif|rideau", {
        "kind": {"terrasse": "terrasse", "pvc|vinyle": "pvc", "bardage|clin": "bardage", "sol": "sol"}, "material": {"composite": "composite", "pin": "pin", "bois|chene": "bois", "pvc": "pvc"}, "color": ("color", "=nr"), "format": "format"}),
    Category("CAT_CARRELAGE", "Carrelage", ("carrelage|faience",), "plinthe|lunette|coupe carrelage|bouchon|croisillon|spatule", {
        "usage": {_both("exterieur", "sol"): "sol_ext", "exterieur": "exterieur", "faience|mural": "mur", "sol": "sol"}, "material": (_same("gres", "faience"), "=carrelage"), "decor": ("decor", _ASPECTS), "color": "color", "finish": ("finish", "=std"), "format": "format"}),
    Category("CAT_PLAN", "Plan de travail", ("plan de travail|^plan travail",), "", {"material": {"stratif": "stratifie", "bois|chene": "bois", "resine": "resine"}, "decor": ("decor", "color"), "format": "format"}),
    Category("CAT_LAINE", "Laine isolante", (f"{_both('laine', 'verre')}|{_both('laine', 'roche')}|ouate",), "", {
        "material": {_both("laine", "verre"): "verre", _both("laine", "roche"): "roche", "ouate": "ouate"}, "thickness_mm": "thick20_400", "form": _same("rouleau", "panneau"), "r_value": ("r_value", "=nr"), "format": ("format", "=nr")}),
    Category("CAT_PANNEAU", "Panneau", (f"{_both('sandwich', 'panneau')}|(?s)^panneau.*(?:alveolaire|alveole|bois|3 plis|trois plis)",), f"{_OTHERS}|osb|contreplaqu|agglomere|agglo|mdf|platre|laine|porte", {
        "kind": {_both("sandwich", "panneau"): "sandwich", "(?s)^panneau.*(?:alveolaire|alveole)": "alveolaire", "(?s)^panneau.*(?:bois|3 plis|trois plis)": "bois"}, "format": "format"}),
    Category("CAT_BOIS", "Bois débité", ("tasseau|chevron|lambourde|madrier|bastaing|volige|latte",), "", {
        "kind": _same("tasseau", "chevron", "lambourde", "madrier", "bastaing", "volige", "latte"), "essence": "essence", "section": "format", "length": "metres8"}),
    Category("CAT_LIQUIDE", "Peinture et finition", (f"{_COATS}|peinture",), "rouleau|pinceau|pistolet|bac |ruban|decapant|diluant|decaps|ouvre|manchon|pack complet", {
        "kind": {"lasure": "lasure", "vitrificateur": "vitrificateur", "saturateur": "saturateur", "vernis": "vernis", "sous[ -]couche": "sous_couche", "peinture": "peinture"},
        "usage": {"facade": "facade", "sol|escalier": "sol", "boiserie": "boiserie", "metal|fer ": "metal", _both("interieur", "exterieur"): "interieur_exterieur", _both("mur", "plafond"): "mur_plafond", "mur": "mur", "plafond": "plafond", "exterieur": "exterieur", _COATS: "bois"},
        "finish": ("finish", {"aerosol|spray": "aerosol"}), "color": ("color", {"ton pierre": "pierre"}), "volume": "volume", "gamme": ("decor", "=std")}),
    Category("CAT_ENDUIT", "Enduit", ("enduit",), "", {"fonction": {**_same("rebouchage", "lissage", "joint", "facade"), "garnissant|degross": "garnissant", "multi": "multi"}, "form": (_same("pate", "poudre"), "=nr"), "poids": "weight"}),
    Category("CAT_MORTIER", "Mortier", ("mortier",), "", {"kind": {"colle|flex": "colle", "impermeab": "impermeabilisation", **_same("refractaire", "rapide", "universel", "joint")}, "poids": "weight"}),
    Category("CAT_COLLE", "Colle", ("colle",), "mortier|enduit|(?s)^(?:(?!colle|pistolet).)*pistolet", {
        "kind": {**_same("neoprene", "polyurethane", "bitume", "cyano", "carrelage", "plinthe", "parquet", "moquette"), "polystyr": "polystyrene", **_same("pvc", "bois", "multi")}, "quantite": ("weight", "volume")}),
    Category("CAT_JOINT", "Joint", ("^joint",), "enduit", {"kind": {"silicone": "silicone", "carrelage|gres": "carrelage", "acryl": "acrylique"}, "color": "color", "quantite": ("weight", "volume")}),
    Category("CAT_BLOC_PORTE", "Bloc-porte", ("bloc[ -]porte|bloque porte",), "cale", {"kind": ({"postform": "postforme", **_same("isoplane", "vitre", "isolant")}, "=bloc"), "width_cm": "cm2_3", "sens": _SIDE, "color": ("color", "=nr")}),
    Category("CAT_FENETRE", "Fenêtre", ("^fenetre",), "store|poignee|raccord|volet|moustiquaire|joint|film", {
        "material": {"pvc": "pvc", "aluminium| alu": "alu", "bois": "bois", "toit": "toit"}, "opening": ({"oscillo": "oscillo_battant", **_same("coulissant", "battant")}, "=nr"), "format": "format", "color": ("color", "=nr")}),
    Category("CAT_STORE", "Store ou volet", ("store|volet",), "", {"kind": _same("volet", "store"), "format": "format", "color": "color"}),
    Category("CAT_POIGNEE", "Poignée", ("^poignee",), "", {"kind": _same("fenetre", "meuble", "porte"), "finish": {"dore|effet or": "dore", **_same("inox", "noir", "blanc"), "chrom": "chrome", "laiton": "laiton"}, "entraxe": ("entraxe", "=nr"), "modele": "decor"}),
    Category("CAT_SERRURE", "Serrure", (f"{_CADENAS}|^serrure",), "", {"kind": ({_CADENAS: "cadenas", "5 point": "5_points", "3 point": "3_points", "cylindre": "cylindre"}, "=serrure"), "axe": "axis", "sens": {_CADENAS: "nr", **_SIDE}}),
    Category("CAT_MITIGEUR", "Mitigeur", ("mitigeur|melangeur",), "cartouche|joint|flexible pour", {
        "usage": {"douche": "douche", "evier|cuisine": "evier", **_same("bain", "bidet", "lavabo")}, "finish": {"dore|effet or": "dore", **_same("noir", "blanc", "brosse"), "chrom": "chrome"}, "modele": "decor"}),
    Category("CAT_SANITAIRE", "Sanitaire", (r"receveur|baignoire|\bwc\b|cuvette|vasque|lave[ -]mains|colonne de douche",), "^kit|^ensemble|meuble", {
        "kind": {**_same("receveur", "baignoire"), r"\bwc\b|cuvette": "wc", "vasque": "vasque", "lave[ -]mains": "lave_mains", "colonne de douche": "colonne_douche"},
        "modele": ("decor", All((("format", "diameter"), "color"), "std")), "color": ("color", Any(("decor",), "nr")), "format": ("format", "diameter", Any(("decor",), "nr"))}),
    Category("CAT_RADIATEUR", "Radiateur", ("^radiateur",), "", {
        "kind": {_both("seche", "serviette"): "seche_serviette", **_same("ceramique", "inertie", "fonte"), "eau|hydraulique": "eau", "electrique": "electrique"}, "power_w": "power", "color": "color",
        "modele": ("decor", Any(("format",), "std")), "format": ("format", Any(("decor",), "nr"))}),
    Category("CAT_TUBE", "Tube", ("^tube",), "colle|mastic|led|neon|fluo|cuivre esthetique", {"material": _same("multicouche", "cuivre", "per", "pvc", "acier"), "diameter_mm": "diameter", "length": "metres50"}),
    Category("CAT_RACCORD", "Raccord", ("^(?:raccord|coude|manchon|mamelon|collecteur|reduction|union|bouchon|te )",), "fenetre|toiture", {
        "kind": _same("collecteur", "coude", "manchon", "mamelon", "reduction", "union", "bouchon", "te", "raccord"),
        "material": ({"multicouche": "multicouche", "cuivre|bicone|laiton": "cuivre", r"\bper\b": "per", "pvc": "pvc"}, {"sertir": "multicouche", "souder|bicone|bague": "cuivre", "glissement": "per"}),
        "diameter_mm": ("diameter", "thread"), "thread": ("thread", "=nr"), "system": ({"sertir": "sertir", "souder": "souder", "bicone|bague": "bicone", **_same("glissement", "visser")}, "=nr")}),
    Category("CAT_APPAREILLAGE", "Appareillage", ("odace|dooxie|celiane|niloe|mosaic|plexo|arnould|zephyr",), "", {
        "gamme": _same("odace", "dooxie", "celiane", "niloe", "mosaic", "plexo", "arnould", "zephyr"), "kind": {"va et vient|va-et-vient": "va_et_vient", **_same("interrupteur", "prise", "poussoir", "rj45")}, "pose": (_same("saillie", "encastre"), "=nr"), "color": "color"}),
    Category("CAT_FORET", "Foret", ("foret",), "perceuse|visseuse|porte[ -]foret|kit", {"material": {"beton": "beton", "bois": "bois", "metal|metaux": "metal", "universel|multi": "multi"}, "format": "format_mm"}),
    Category("CAT_LUMINAIRE", "Luminaire", ("^spot|^.{0,14} spot |^applique|^plafonnier|^reglette",), "", {
        "kind": {"^spot|^.{0,14} spot ": "spot", "^applique": "applique", "^plafonnier": "plafonnier", "^reglette": "reglette"}, "power_w": ("power", Any(("format", "decor"), "nr")), "color": "color", "format": ("format", Any(("power", "decor"), "nr")), "modele": ("decor", Any(("power", "format"), "std"))}),
    Category("CAT_MEUBLE", "Meuble", ("^meuble|^.{0,17}meuble |^colonne",), "facade|douche|^kit|^ensemble", {
        "kind": ({"sous[ -]vasque": "sous_vasque", **_same("vasque", "colonne", "haut", "bas", "angle", "armoire")}, "=meuble"), "collection": "decor", "color": "color", "finish": ("finish", "=nr"), "format": "lhp"}),
    Category("CAT_FACADE", "Façade", ("facade",), "peinture|manchon|traitement|enduit|rouleau", {"kind": "=facade", "collection": "decor", "color": "color", "finish": ("finish", "=nr"), "format": ("lhp", "format")}),
    Category("CAT_KIT", "Kit", ("^kit|^ensemble",), "", {
        "kind": _same("douche", "meuble", "porte", "wc", "salle", "fixation", "plomberie", "robinet", "coulissant", "cuisine", "bain", "sol", "terrasse"), "modele": "decor", "format": ("lhp", "format", "=nr"), "color": ("color", "=nr")}),
    Category("CAT_PORTE_RANG", "Porte de rangement", ("^porte coulissante|porte de placard|^porte placard",), "", {"kind": {"^porte coulissante": "coulissante", "porte de placard|^porte placard": "placard"}, "collection": "decor", "color": ("color", _same("chene", "miel")), "format": "format"}),
    Category("CAT_EQUERRE", "Équerre", ("equerre",), "", {"kind": {"charge": "charge", "etagere|tablette": "etagere", "bardage": "bardage", "fenetre|volet": "menuiserie"}, "format": "format"}),
    Category("CAT_DISQUE", "Disque", ("^disque",), "", {"material": {"diamant": "diamant", "beton": "beton", "bois": "bois", "metal|acier|inox": "metal"}, "diameter_mm": "diameter"}),
)


def _bag(text: Column, low: int, high: int) -> Column:
    """The only weight in a label, in whole kilograms."""
    found = F.regexp_extract_all(text, F.lit(rf"{_N}\s*kg\b"), F.lit(1))
    return let(found, lambda f: F.when(F.size(f) == 1, let(parse_number(f[0]), lambda n: F.when((n == F.floor(n)) & n.between(low, high), n.cast("int").cast("string")))))


def _essence(t: Column) -> Column:
    wood = F.coalesce(*(F.when(t.rlike(p), F.lit(v)) for p, v in _ESSENCES.items()))
    return F.when(t.rlike("autoclave|classe 4"), F.concat_ws("_", wood, F.lit("autoclave"))).otherwise(wood)


def _measures(label: Column, t: Column, pair: Column) -> dict[str, Column]:
    """All that categories take from a label (without its pack), its folded form and the last pair of sizes in it."""
    cm = lambda p, most: _quantity(t, p, "m", 0, most)
    thread = r"(\d{2})\s*/\s*(\d{2})"
    axis = F.when(t.rlike(_CADENAS), _first(t, r"(\d{2,3})\s*mm\b")).otherwise(F.concat(_first(t, r"(\d{2})\s*x\s*(\d{2})", 1), F.lit("x"), _first(t, r"(\d{2})\s*x\s*(\d{2})", 2)))
    thick = let(_mm(_first(t, rf"{_N}\s*mm\b"), F.lit("mm"), "mm"), lambda v: F.when(v.between(20, 400), v.cast("string")))
    resist = let(_first(t, rf"\br\s*[:=]?\s*{_N}"), lambda n: F.when(parse_number(n) <= 15, _plain(n)))
    return {
        "decor": decor(label), "format": _sized(pair, "cm"), "format_mm": _sized(pair, "mm"), "format_loose": _sized(pair, "cm", _lone_thickness(t)), "lhp": format_lhp(t, _sized(pair, "cm")), "color": colour(t),
        "finish": F.coalesce(*(F.when(t.rlike(p), F.lit(v)) for p, v in FINISHES.items())), "volume": volume(t), "weight": weight(t), "power": _between(t, r"(\d{2,5})\s*w\b", 20, 5000), "diameter": diameter(t),
        "metres8": cm(rf"{_N}\s*m\b(?!m)", 8), "metres50": cm(rf"{_N}\s*m\b(?!m|l)", 50), "thread": F.concat(_first(t, thread), F.lit("_"), _first(t, thread, 2)), "axis": axis, "entraxe": _first(t, r"entraxe\s*(\d+)"),
        "cm2_3": _first(t, r"(\d{2,3})\s*cm\b"), "thick20_400": thick, "r_value": resist, "essence": _essence(t), "kg5_20": _bag(t, 5, 20), "kg10_40": _bag(t, 10, 40),
    }


#: Bounds of blocks by category: the least and the greatest sizes, in descending order.
_BOUNDS = {"cell": ((400, 150, 40), (700, 400, 300)), "block": ((400, 150, 50), (650, 300, 250)), "xps": ((800, 400, 10), (3000, 1500, 200))}


def _value(source, t: Column, p: dict[str, Column]) -> Column:
    if isinstance(source, dict):
        return F.coalesce(*(F.when(t.rlike(k), F.lit(v)) for k, v in source.items())) if source else F.lit(None).cast("string")
    if isinstance(source, tuple):
        return F.coalesce(*(_value(s, t, p) for s in source))
    if isinstance(source, (Any, All)):
        there = F.lit(isinstance(source, All))
        for n in source.names:
            known = _value(n, t, p).isNotNull()
            there = there & known if isinstance(source, All) else there | known
        return F.when(there, F.lit(source.word))
    return F.lit(source[1:]) if source.startswith("=") else p[source]


def catalogue_claims(rows: DataFrame, categories: tuple[Category, ...] = CATEGORIES, text_col: str = "designation") -> DataFrame:
    """A row for each category that a label falls in, with rule and identity, a map of the category's keys; an unknown key is null.

    Labels without a category, and null labels, are left out. Measures are read only for labels with a category, once each.
    """
    blank = F.trim(F.coalesce(F.col(text_col), F.lit("")))
    t = F.col(FOLDED)

    def applies(c: Category) -> Column:
        out = ~t.rlike(c.bans) if c.bans else F.lit(True)
        for need in c.needs:
            out = t.rlike(need) & out
        # A kit is named by the label itself, not by what is in a pack of several.
        return out & F.col("__whole") if c.code == "CAT_KIT" else out

    codes = F.array_compact(F.array(*(F.when(applies(c), F.lit(c.code)) for c in sorted(categories, key=lambda c: c.code))))

    def read(labels: DataFrame) -> DataFrame:
        packed = labels.withColumn("__label", strip_pack(blank)).withColumn("__whole", F.col("__label") == blank)
        told = stored(packed.withColumn(FOLDED, fold(F.translate("__label", *_SIGNS))))
        told = stored(told.withColumn("__codes", codes)).where(F.size("__codes") > 0)
        told = stored(told.withColumn("__pair", last_pair(t)))
        parts = _measures(F.col("__label"), t, F.col("__pair"))
        boxed = F.exists("__codes", lambda c: c.isin("BETON_CELLULAIRE", "PARPAING", "POLYSTYRENE_XPS"))
        told = stored(told.withColumns({f"__{k}": v for k, v in parts.items()} | {"__box": F.when(boxed, canonical_box(F.col("__label"))), "__cable": F.when(F.array_contains("__codes", "CABLE_ELEC"), cable(t))}))
        told = told.withColumn("rule", F.explode("__codes"))
        p = {k: F.col(f"__{k}") for k in parts} | {f"cable_{k}": F.col("__cable")[k].cast("string") for k in _ELECTRICAL.keys}
        p |= {f"{n}_box{i}": within(F.col("__box"), *b)[i].cast("string") for n, b in _BOUNDS.items() for i in range(3)}
        identity = F.lit(None).cast("map<string,string>")
        for c in categories:
            identity = F.when(F.col("rule") == c.code, F.create_map(*(x for k, s in c.fields.items() for x in (F.lit(k), _value(s, t, p))))).otherwise(identity)
        return told.withColumn("identity", identity).select(text_col, "rule", "identity")

    return by_label(rows, text_col, read)
