"""Entity resolution: rules that read an identity from a label, and the match of identities with products."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import FOLDED, angle_profile, bar_length_mm, bar_profile, diameter_lengths, dimensions, ean, fold, identity_code, length_width, let, own_key, profile_code, thickness_alone, tube_profile, weight_g
from tallyforge.operators.labels import by_label, stored

#: Nominal lengths of profiles that stand for another; others stay as they are.
NOMINAL_LENGTHS = {2490: 2500, 2990: 3000}
STATUS_ORDER = ("EXACT", "HIGH", "REVIEW", "UNMAPPED")


@dataclass(frozen=True)
class IdentityModel:
    """Which keys make an identity, and what counts when not all of them agree: dimensions, or a hierarchy of keys.

    ``flags`` must not differ where both sides know them; ``secondary`` tell products with one identity apart.
    """

    name: str
    keys: tuple[str, ...]
    dims: tuple[str, ...] = ()
    type_key: str | None = None
    hierarchy: tuple[str, ...] = ()
    flags: tuple[str, ...] = ()
    secondary: tuple[str, ...] = ()


FASTENER = IdentityModel("DIMENSIONAL_FASTENER", ("type", "diameter_mm", "length_mm"), hierarchy=("type", "diameter_mm"), secondary=("head", "drive", "finish", "material"))
_FLAGS = ("hydrofuge", "fire_resistant", "acoustic")
BOARD = IdentityModel("BOARD_PANEL", ("length_mm", "width_mm", "thickness_mm", "type"), ("length_mm", "width_mm", "thickness_mm"), "type", flags=_FLAGS, secondary=_FLAGS)
PROFILE = IdentityModel("LINEAR_PROFILE", ("kind", "profile", "nominal_length_mm"), hierarchy=("kind", "profile"), secondary=("material",))
BAGGED = IdentityModel("BAGGED_PRODUCT", ("type", "weight_kg"), hierarchy=("type",), secondary=("usage",))


@dataclass(frozen=True)
class Rule:
    """A category: what a folded label must hold (all patterns of ``include``) and must not, and the identity that is read from it."""

    code: str
    model: IdentityModel
    kind: str
    include: str | tuple[str, ...]
    exclude: str = ""
    most: dict = field(default_factory=dict, hash=False)
    profile: str = "__profile"

    def applies(self, folded: Column) -> Column:
        out = ~folded.rlike(self.exclude) if self.exclude else F.lit(True)
        for p in (self.include,) if isinstance(self.include, str) else self.include:
            out = folded.rlike(p) & out
        return out


def _board_sizes(text: Column) -> Column:
    """Three sizes of a board, with blanks for thousands; without all three, two sides and a thickness wherever they are."""

    def loose(t: Column) -> Column:
        return let(length_width(t), lambda s: F.struct(s["length_mm"].alias("length_mm"), s["width_mm"].alias("width_mm"), thickness_alone(t).alias("thickness_mm")))

    return let(F.regexp_replace(text, r"(\d)\s+(\d{3})\b", "$1$2"), lambda t: F.coalesce(dimensions(t), loose(t)))


def _measures(text: Column) -> dict[str, Column]:
    """What labels of any rule are read for, most of it from their folded form; each is read once for all rules."""
    profiles = {"__profile": profile_code, "__angle": angle_profile, "__rod": bar_profile, "__tube": tube_profile}
    return {"__board": _board_sizes(text), "__screws": diameter_lengths(FOLDED), "__bar": bar_length_mm(FOLDED), "__weight": weight_g(FOLDED), **{k: f(FOLDED) for k, f in profiles.items()}}


def _identity(rules: tuple[Rule, ...]) -> Column:
    """The identity map of a row by its rule, from its measures."""
    of = lambda value: F.create_map(*(F.lit(x) for r in rules for x in (r.code, value(r))))[F.col("rule")]
    kind = of(lambda r: r.kind)
    bound = lambda c, lo, hi: F.when(c.between(lo, hi), c)
    board, bar = F.col("__board"), F.col("__bar")
    wide, long, thick = of(lambda r: r.most.get("diameter", 8)), of(lambda r: r.most.get("length", 300)), of(lambda r: r.most.get("thickness", 400))
    screw = F.try_element_at(F.filter("__screws", lambda p: p["diameter_mm"].between(2, wide) & p["length_mm"].between(10, long)), F.lit(1))
    profile = F.col("__profile")
    for name in sorted({r.profile for r in rules} - {"__profile"}):
        profile = F.when(F.col("rule").isin([r.code for r in rules if r.profile == name]), F.col(name)).otherwise(profile)
    nominal = bar
    for a, b in NOMINAL_LENGTHS.items():
        nominal = F.when(bar == a, b).otherwise(nominal)
    read = {
        FASTENER: {"type": kind, "diameter_mm": screw["diameter_mm"], "length_mm": screw["length_mm"]},
        BOARD: {"type": kind, "length_mm": bound(board["length_mm"], 200, 4000), "width_mm": bound(board["width_mm"], 200, 2000), "thickness_mm": bound(board["thickness_mm"], 3, thick)},
        PROFILE: {"kind": kind, "profile": profile, "nominal_length_mm": nominal},
        BAGGED: {"type": kind, "weight_kg": (F.col("__weight") / 1000).cast("decimal(9,3)")},
    }
    out = F.lit(None).cast("map<string,string>")
    for model, parts in read.items():
        mine = [r.code for r in rules if r.model is model]
        if mine:
            out = F.when(F.col("rule").isin(mine), F.create_map(*(x for k, c in parts.items() for x in (F.lit(k), c.cast("string"))))).otherwise(out)
    return out


# What folded labels of each category must and must not hold, and the greatest sizes.
_COMMON = r"visseuse|embout|assortiment|\bkits?\b|coffret|colle|mastic|ni\s+clou\s+ni\s+vis|pistolet"
_PLASTERBOARD = r"plaq(?:ues?)?\.?\s*(?:de\s+)?pl?atre"
_NOT_PANEL = r"equerre|\blots?\b|\bkits?\b|porte|cloison|treillis|brise|cloture|plinthe|lambris|chant\b|meuble|corniere|vis\b|cheville"
_NOT_BOARD = r"plinthe|\bvis\b|colle|mastic|meuble|porte\b"
RULES = (
    Rule("CHEVILLE_NYLON", FASTENER, "cheville_nylon", r"chevil.*(?:nylon|plastique|plastic|duopower|universel|expansion)",
         _COMMON + r"|molly|metal|metall|acier|laiton|a\s+frappe|autoforeuse|avec\s+vis|\bvis\b", {"diameter": 20, "length": 200}),
    Rule("VIS_BETON", FASTENER, "beton", r"\bvis\b.*\bbeton\b|\bbeton\b.*\bvis\b",
         _COMMON + r"|cheville|boulon|tirefond|terrasse|\bagglo\b|\bplaco\b", {"diameter": 12, "length": 400}),
    Rule("VIS_TOLE", FASTENER, "tole", r"\bvis\b.*\btole\b|\btole\b.*\bvis\b|autoforeuse.*\bvis\b|\bvis\b.*autoforeuse",
         _COMMON + r"|cheville|beton|terrasse|agglo|placo|bois|multi", {"length": 200}),
    Rule("VIS_TERRASSE", FASTENER, "terrasse", r"\bvis\b.*terrasse|terrasse.*\bvis\b", _COMMON + r"|cheville|beton|tole|agglo|placo", {"diameter": 10, "length": 300}),
    Rule("TIREFOND", FASTENER, "tirefond", r"tire[\s-]?fond|tirefond", _COMMON + r"|cheville", {"diameter": 20, "length": 400}),
    Rule("BOULON", FASTENER, "boulon", r"\bboulon\b|\btrcc\b|\bhb\b.*boulon|boulon.*poelier|boulon.*tete", _COMMON + r"|cheville|visseuse|\becrou\b\s*seul", {"diameter": 24, "length": 400}),
    Rule("GOUJON", FASTENER, "goujon", r"goujon", _COMMON + r"|chemise|capsule", {"diameter": 24, "length": 400}),
    Rule("VIS_METAUX", FASTENER, "metaux", r"\bvis\b.*(?:metaux|mecanique)|(?:metaux|mecanique).*\bvis\b",
         _COMMON + r"|cheville|terrasse|\btole\b|\bagglo\b|\bplaco\b|\bbois\b|\bbeton\b|tirefond|boulon|goujon|charniere|bardage|\bcadre\b|multi|ecrou", {"diameter": 12, "length": 200}),
    Rule("VIS_AGGLO", FASTENER, "agglo", (r"\bvis\b", r"\bagglo\b"),
         rf"visseuse|embout|{_PLASTERBOARD}|\bplaco\b|trompette|\bttpc\b|terrasse|beton|cheville|boulon|tirefond|\btole\b|assortiment|\bkits?\b"),
    Rule("VIS_BOIS", FASTENER, "bois", (r"\bvis\b", r"\bbois\b"),
         rf"visseuse|embout|{_PLASTERBOARD}|\bplaco\b|trompette|\bttpc\b|cheville|boulon|tirefond|\bagglo\b|\bbeton\b|multi[\s-]?materiau|multi[\s-]?usage|tous[\s-]?materiau|universel|assortiment|\bkits?\b|anneau|patte|rallonge"),
    Rule("VIS_PLACO", FASTENER, "placo", (r"\bvis\b", rf"{_PLASTERBOARD}|placo|trompette|\bttpc\b|autoperforant(?:e|es)?\b|autopercant(?:e|es)?\b|autoforeuses?\b"),
         r"visseuse|embout|\bbois\b|terrasse|beton|cheville|boulon|tirefond|agglo|multi[\s-]?usage|\btole\b|assortiment|\bkits?\b", {"length": 200}),
    Rule("VIS_MULTI", FASTENER, "multi", (r"\bvis\b", r"multi[\s-]?materiau|tous[\s-]?materiau|multi[\s-]?support|multi[\s-]?usage"),
         rf"visseuse|embout|{_PLASTERBOARD}|\bplaco\b|trompette|\bttpc\b|cheville|boulon|\bagglo\b|assortiment|\bkits?\b|ni\s+clou\s+ni\s+vis|\bcolle\b|\bcollage\b|\bmastic\b|\badhesif\b"),
    Rule("CHEVILLE_METAL", FASTENER, "cheville_metal", (r"chevil", r"metal|metall|acier|laiton|molly|expansion|a\s+frappe|autoforeuse"),
         r"nylon|plastique|plastic|\bvis\b|avec\s+vis|pattes?\s+a\s+vis|assortiment|\bkits?\b|coffret", {"diameter": 20, "length": 200}),
    Rule("ROND_ACIER", PROFILE, "ROND_ACIER", (r"\brond\b", r"\baci?er\b|\betire\b"), r"tube|fer\s+a\s+beton|torsad|pvc|connecteur|tringle|chrome|aluminium|\balu\b", profile="__rod"),
    Rule("TUBE_ROND_ACIER", PROFILE, "TUBE_ROND_ACIER", (r"\btube\b", r"\brond\b", r"\baci?er\b"), r"connecteur|pvc|aluminium|\balu\b|chrome|tringle|blanc|decor", profile="__tube"),
    Rule("FER_BETON", PROFILE, "FER_BETON", r"fer\s+a\s+beton|torsad.*beton|beton.*torsad", r"tube|corniere|connecteur|\bkits?\b|assortiment", profile="__rod"),
    Rule("CORNIERE_PVC", PROFILE, "CORNIERE_PVC", (r"corni", r"\bpvc\b"), r"acier\s+inoxidable|inox|meuble|cuisine|bardage|assortiment|\blots?\b|\bkits?\b|perfore|\bplaco\b|galvanis|\bacier\b", profile="__angle"),
    Rule("PANNEAU_OSB", BOARD, "osb", r"\bosb\b", _NOT_PANEL, {"thickness": 40}),
    Rule("PANNEAU_CP", BOARD, "contreplaque", (r"panneau|osb", r"contreplaqu|contre[\s-]?plaque|\bcp\b.*panneau|panneau.*\bcp\b"), _NOT_PANEL, {"thickness": 40}),
    Rule("PANNEAU_AGGLO", BOARD, "agglomere", (r"panneau|osb", r"agglomer|agglo(?!.*\bvis\b)|panneau.*particule|particule"), _NOT_PANEL, {"thickness": 40}),
    Rule("PANNEAU_MDF", BOARD, "mdf", (r"\bpanneau\b", r"\bmdf\b"),
         r"equerre|\blots?\b|\bkits?\b|porte|cloison|treillis|brise[\s-]?vent|cloture|plinthe|lambris|chant\b|meuble|ilot", {"thickness": 40}),
    # Own words for what follows.
    Rule("OSSATURE_FOURRURE", PROFILE, "fourrure", r"\bfourrure\b"),
    Rule("OSSATURE_MONTANT", PROFILE, "montant", r"\bmontant\b"),
    Rule("OSSATURE_RAIL", PROFILE, "rail", r"\brail\b", r"volet|rideau|spot"),
    Rule("PLAQUE_PLATRE", BOARD, "standard", r"\b(?:plaque.*(?:platre|ba\s?13)|ba\s?13)\b", _NOT_BOARD + r"|hydro|phon", {"thickness": 40}),
    Rule("PLAQUE_PLATRE_HYDRO", BOARD, "hydro", r"\b(?:plaque|ba\s?13)\b.*hydro", _NOT_BOARD, {"thickness": 40}),
    Rule("CIMENT", BAGGED, "ciment", r"\bciment\b", _COMMON),
    Rule("GRANULE_BOIS", BAGGED, "granule", r"\b(?:granules?|pellets?)\b", _COMMON),
)


# Attributes besides the identity in folded labels, the first that fits; and what a board may withstand.
_HEADS = {"fraisee": "frais", "plate": r"\bplates?\b", "turbo": r"\bturbo\b", "hex": r"\bhex(?:agonale?s?)?\b"}
_DRIVES = {"pozidriv": "pozidriv|posidriv", "philips": "philips", "torx": r"\btorx\b|\btx\b"}
_FINISHES = {"zingue": "zingue", "jaune": r"\bjaune\b", "inox": r"\binox\b"}
_WITHSTANDS = {"hydrofuge": "hydro", "fire_resistant": "coupe[- ]feu|anti[- ]feu|resist[a-z]* au feu", "acoustic": "phoni|acoust"}


def attributes(folded: Column) -> Column:
    """map<string,string> of what a folded label says besides its identity: head, drive, finish and what it withstands; nothing is inferred from silence."""
    first = lambda forms: F.coalesce(*(F.when(folded.rlike(p), F.lit(k)) for k, p in forms.items()))
    told = {"head": first(_HEADS), "drive": first(_DRIVES), "finish": first(_FINISHES), **{k: F.when(folded.rlike(p), F.lit("true")) for k, p in _WITHSTANDS.items()}}
    return F.map_filter(F.create_map(*(x for k, c in told.items() for x in (F.lit(k), c))), lambda k, v: v.isNotNull())


def _read(ruled: DataFrame, rules: tuple[Rule, ...], text_col: str) -> DataFrame:
    """``ruled``, which has FOLDED, with identity instead; only labels that a rule applies to are read."""
    read = {k: F.when(F.col("rule").isNotNull(), c) for k, c in _measures(F.col(text_col)).items()}
    return stored(ruled.withColumns(read)).withColumn("identity", _identity(rules)).drop(FOLDED, *read)


def extract(rows: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "designation") -> DataFrame:
    """Rows with ``rule`` and ``identity``: the first rule, in the order of codes, that applies to the label.

    identity is a map of the model's keys; an unknown one is null. The cheap pattern of a rule gates what it reads.
    """
    rule = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: r.code, reverse=True):
        rule = F.when(r.applies(F.col(FOLDED)), r.code).otherwise(rule)
    return by_label(rows, text_col, lambda labels: _read(stored(stored(labels.withColumn(FOLDED, fold(text_col))).withColumn("rule", rule)).where("rule IS NOT NULL"), rules, text_col), "left")


def claims(rows: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "designation") -> DataFrame:
    """A row for each rule that applies to a label, with rule, identity and attributes; labels without a rule are left out."""
    codes = F.array_compact(F.array(*(F.when(r.applies(F.col(FOLDED)), F.lit(r.code)) for r in sorted(rules, key=lambda r: r.code))))

    def read(labels: DataFrame) -> DataFrame:
        told = stored(stored(labels.withColumn(FOLDED, fold(text_col))).withColumn("__codes", codes)).where(F.size("__codes") > 0)
        return _read(told.withColumn("attributes", attributes(F.col(FOLDED))).withColumn("rule", F.explode("__codes")).drop("__codes"), rules, text_col)

    return by_label(rows, text_col, read)


def by_rule(rules: tuple[Rule, ...], value) -> Column:
    """The list that ``value`` gives for the rule of a row."""
    return F.create_map(*(x for r in rules for x in (F.lit(r.code), F.array(*map(F.lit, value(r))).cast("array<string>"))))[F.col("rule")]


def _joined(source: str, keys: Column) -> Column:
    """The values of ``keys``, or null if one of them is unknown or there are no keys."""
    values = F.transform(keys, lambda k: F.col(source)[k])
    return F.when((F.size(keys) > 0) & F.forall(values, lambda v: v.isNotNull()), F.array_join(values, "|"))


def match(rows: DataFrame, products: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, rule, status, product_id, score, reason) of each row (id, rule, identity and, if there, attributes) of the rules, all at once.

    ``products``: product_id, rule, identity and attributes as maps. EXACT: all keys known and equal. Boards with equal
    dimensions but not the same identity: HIGH if the type is equal, REVIEW if a side doesn't know it, else none; and if
    they differ in a flag that both know, REVIEW at most. Hierarchies: REVIEW of a product that agrees in their first two
    keys and doesn't know the last one. Several EXACT or HIGH products are ambiguous and only proposed. Without the
    dimensions, or the whole identity in a hierarchy, data are insufficient. Products are counted by all that decides
    before they are joined, so that a hot identity is a row, and rows meet only products with an equal key.
    """
    empty = F.create_map().cast("map<string,string>")
    rows = rows if "attributes" in rows.columns else rows.withColumn("attributes", empty)
    products = products if "attributes" in products.columns else products.withColumn("attributes", empty)
    codes = [r.code for r in rules]
    keys, dims, flags = (by_rule(rules, lambda r, k=k: getattr(r.model, k)) for k in ("keys", "dims", "flags"))
    head = by_rule(rules, lambda r: r.model.hierarchy[:2])
    kind = by_rule(rules, lambda r: (r.model.type_key,) if r.model.type_key else ())
    flat = F.size(dims) > 0
    tag = lambda name, c: F.concat(F.lit(name + "|"), c)

    def told(df: DataFrame, name: str) -> DataFrame:
        known = F.map_filter("attributes", lambda k, v: F.array_contains(flags, k))
        return df.where(F.col("rule").isin(codes)).withColumns({
            "whole": _joined(name, keys), "dims": _joined(name, dims), "head": _joined(name, head), "type": _joined(name, kind), "flags": F.array_sort(F.map_entries(known)), "flat": flat,
        })

    left = told(rows, "identity").withColumn("enough", F.when(F.col("flat"), F.col("dims").isNotNull()).otherwise(F.col("whole").isNotNull()))
    left = left.select("id", "rule", "enough", "whole", "type", "flags", F.when(F.col("enough"), F.when(F.col("flat"), F.array(tag("d", F.col("dims")))).otherwise(F.array(tag("x", F.col("whole")), tag("h", F.col("head"))))).alias("meet"))
    right = told(products, "identity")
    meet = F.when(F.col("flat"), tag("d", F.col("dims"))).when(F.col("whole").isNotNull(), tag("x", F.col("whole"))).when(_joined("identity", keys).isNull(), tag("h", F.col("head")))
    right = right.select("rule", meet.alias("meet"), F.col("whole").alias("p_whole"), F.col("type").alias("p_type"), F.col("flags").alias("p_flags"), "product_id").where("meet IS NOT NULL")
    right = right.groupBy("rule", "meet", "p_whole", "p_type", "p_flags").agg(F.min("product_id").alias("product_id"), F.countDistinct("product_id").alias("n"))
    # Equal rows, and rows that agree in all that decides, are judged once each by their own id.
    pairs = left.select("id", "rule", "whole", "type", "flags", F.explode("meet").alias("meet")).join(right, ["rule", "meet"])
    conflict = F.exists("flags", lambda a: F.exists("p_flags", lambda b: (a["key"] == b["key"]) & (a["value"] != b["value"])))
    same, both = F.col("whole") == F.col("p_whole"), F.col("type").isNotNull() & F.col("p_type").isNotNull()
    d = F.startswith("meet", F.lit("d|"))
    judged = lambda s, x: F.struct(F.lit(s).alias("s"), F.lit(x).alias("score"))
    judge = (
        F.when(conflict & d, judged(2, 0.2)).when(conflict, judged(3, 0.0)).when(F.coalesce(same, F.lit(False)), judged(0, 1.0)).when(d & both & (F.col("type") == F.col("p_type")), judged(1, 0.85))
        .when(d & both, judged(3, 0.0)).when(d, judged(2, 0.55)).otherwise(judged(2, 0.3))
    )
    scored = pairs.select("id", "rule", judge.alias("j"), "product_id", "n").where("j.s < 3")
    best = scored.groupBy("id", "rule").agg(
        F.min(F.struct("j.s", (-F.col("j.score")).alias("minus"), "product_id")).alias("b"), F.sum(F.when(F.col("j.s") == 0, F.col("n"))).alias("n0"), F.sum(F.when(F.col("j.s") == 1, F.col("n"))).alias("n1")
    )
    out = left.join(best.withColumnRenamed("id", "__id").withColumnRenamed("rule", "__rule"), F.col("id").eqNullSafe(F.col("__id")) & (F.col("rule") == F.col("__rule")), "left")
    s, names = F.col("b.s"), F.array(*map(F.lit, STATUS_ORDER))
    several = F.coalesce(((s == 0) & (F.col("n0") > 1)) | ((s == 1) & (F.col("n1") > 1)), F.lit(False))
    lost = s.isNull()
    return out.select(
        "id", "rule", F.when(lost, "UNMAPPED").when(several, "REVIEW").otherwise(F.element_at(names, s + 1)).alias("status"), F.col("b.product_id").alias("product_id"),
        F.when(lost, 0.0).when(several, F.round(-F.col("b.minus") * 0.7, 4)).otherwise(-F.col("b.minus")).alias("score"),
        F.when(~F.col("enough"), "INSUFFICIENT_DATA").when(lost & F.col("whole").isNotNull(), "NO_PRODUCT").when(lost, "INSUFFICIENT_DATA").when(several, "AMBIGUOUS").otherwise(F.element_at(names, s + 1)).alias("reason"),
    )


def unanimous(claims: DataFrame) -> DataFrame:
    """(id, product_id) where all rules that claim a row claim the same product."""
    return claims.where("product_id is not null").groupBy("id").agg(F.min("product_id").alias("product_id"), F.countDistinct("product_id").alias("n")).where("n = 1").drop("n")


def arbitrate(matches: DataFrame) -> DataFrame:
    """(id, rule, product_id, outcome) of each row that any rule applies to, from its matches by all of them.

    EXACT if all rules that match it exactly name one product; RULES_DISAGREE if they name several. Otherwise the best
    outcome of its rules, by status, then score, then code: HIGH, REVIEW, AMBIGUOUS, NO_PRODUCT or INSUFFICIENT_DATA.
    """
    exact = (F.col("status") == "EXACT") & (F.col("reason") == "EXACT")
    order = F.array_position(F.array(*map(F.lit, ("EXACT", "HIGH", "REVIEW", "AMBIGUOUS", "NO_PRODUCT", "INSUFFICIENT_DATA"))), F.col("reason"))
    best = matches.groupBy("id").agg(
        F.min(F.struct(order.alias("o"), (-F.col("score")).alias("minus"), "rule", "product_id", "reason")).alias("b"), F.min(F.when(exact, F.col("product_id"))).alias("low"), F.max(F.when(exact, F.col("product_id"))).alias("high")
    )
    split = F.coalesce(F.col("low") != F.col("high"), F.lit(False))
    return best.select("id", "b.rule", F.when(~split, F.col("b.product_id")).alias("product_id"), F.when(split, "RULES_DISAGREE").otherwise(F.col("b.reason")).alias("outcome"))


def map_in_order(references: DataFrame, owners: DataFrame, arbitrated: DataFrame, prefix: str = "SPC-") -> DataFrame:
    """(sp_id, product_id, code, source) of all references (sp_id, product_id, ean, designation, supplier_reference), in stages that see only what is left.

    A mapping that is there is kept. Then a bar code that one product owns (``owners``: ean, product_id); then what
    ``arbitrate`` found EXACT; the rest gets a product of its own, by a code from its label, shared by equal labels.
    """
    ids = references.select("sp_id").where("sp_id IS NOT NULL")
    held = ean(F.col("ean"))
    unique = owners.select(ean(F.col("ean")).alias("__ean"), "product_id").where("__ean IS NOT NULL AND product_id IS NOT NULL").groupBy("__ean").agg(F.min("product_id").alias("by_ean"), F.max("product_id").alias("__most")).where("by_ean = __most").drop("__most")
    exact = arbitrated.where("outcome = 'EXACT'").select(F.col("id").alias("sp_id"), F.col("product_id").alias("by_rule")).join(ids.distinct(), "sp_id", "left_semi")
    out = references.withColumn("__ean", F.when(F.col("product_id").isNull(), held)).join(unique, "__ean", "left").join(exact, "sp_id", "left")
    own = own_key(F.col("designation"), F.coalesce("supplier_reference", F.col("sp_id").cast("string")))
    source = F.when(F.col("product_id").isNotNull(), "kept").when(F.col("by_ean").isNotNull(), "ean").when(F.col("by_rule").isNotNull(), "exact_rule").otherwise("specific")
    code = F.when(F.coalesce("product_id", "by_ean", "by_rule").isNull(), identity_code(prefix, own, 16))
    return out.select("sp_id", F.coalesce("product_id", "by_ean", "by_rule").alias("product_id"), code.alias("code"), source.alias("source"))


def apply_exact(references: DataFrame, matches: DataFrame) -> DataFrame:
    """References with EXACT matches taken over where there was no mapping; all other rows stay as they are."""
    found = matches.where("status = 'EXACT'").select("id", F.col("product_id").alias("__found"))
    out = references.join(found, "id", "left")
    take = F.col("product_id").isNull() & F.col("__found").isNotNull()
    return out.withColumn("correction_source", F.when(take, "exact_rule").otherwise(F.col("correction_source"))).withColumn("product_id", F.when(take, F.col("__found")).otherwise(F.col("product_id"))).drop("__found")


def product_seeds(rows: DataFrame, known: DataFrame, prefix: str) -> DataFrame:
    """One new product for each different whole identity that no product has: its code, and the longest label as its name."""
    key = F.array_join(F.transform(F.array_sort(F.map_entries("identity")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), "|")
    whole = rows.where(F.forall(F.map_values("identity"), lambda v: v.isNotNull())).withColumn("identity_key", F.concat_ws("|", "rule", key))
    named = whole.groupBy("identity_key").agg(F.max_by("designation", F.struct(F.length("designation"), "designation")).alias("name"), F.count("*").alias("references"))
    code = F.concat(F.lit(prefix), F.upper(F.substring(F.sha1("identity_key"), 1, 8))).alias("code")
    return named.join(known.select("identity_key"), "identity_key", "left_anti").select(code, "identity_key", "name", "references")
