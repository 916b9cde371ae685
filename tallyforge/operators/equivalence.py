"""Equivalence of two suppliers' references: an index of identities, a veto of what contradicts, and typed properties that fill gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.feeds_text import plain_value
from tallyforge.functions.text import fold, let, parse_number, to_mm
from tallyforge.operators.labels import stored
from tallyforge.operators.resolve import RULES, Rule, by_rule, claims

# Short forms in folded labels, what is added for them, and the word that must be there as well.
SYNONYMS = (
    (r"\btf\b", "tete fraisee", "vis"), (r"\btx\b", "torx", None), (r"\bba\s*13\b", "plaque de platre 13 mm", None), (r"\bcp\b", "contreplaque", "panneau"),
    (r"\bagglo\b", "agglomere", None), (r"\bgalva\b", "galvanise", None), (r"\binox\b", "acier inoxydable", None),
)
# Variants that both sides must name, or neither.
VARIANTS = (r"isolation[^\d]{0,24}(\d+)\s*mm", r"\b(male|femelle)\b", r"\b(\d+)\s*vantaux?\b", r"\b(carrelage|multi[\s-]?usage|a eau|jante continue)\b")
# Folded names of properties, the first that is there; short names of drives; signs of materials.
PROPERTIES = {
    "length_mm": ("longueur de la vis", "longueur du clou", "longueur"), "diameter_mm": ("diametre", "diametre de la vis"), "thickness_mm": ("epaisseur en mm", "epaisseur", "epaisseur du verre"),
    "width_mm": ("largeur",), "drive": ("empreinte de la vis", "empreinte"), "material": ("matiere",), "color": ("couleur", "coloris"),
}
DRIVES = {"tx": "torx", "torx": "torx", "pz": "pozidriv", "pozidriv": "pozidriv", "ph": "philips", "philips": "philips", "phillips": "philips"}
MATERIALS = {"inox": "inox", "galva": "galvanise", "laiton": "laiton", "pvc": "pvc", "bois": "bois"}


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def expand_synonyms(label) -> Column:
    """The label with the long forms of its short ones after it; nothing is replaced. 'CP' alone is no plywood, beside 'panneau' it is."""
    said = F.coalesce(_col(label), F.lit(""))

    def added(t: Column) -> Column:
        return F.array_compact(F.array(*(F.when(t.rlike(p) & (F.lit(True) if w is None else t.contains(w)), F.lit(long)) for p, long, w in SYNONYMS)))

    return F.concat_ws(" ", said, F.nullif(F.array_join(let(fold(said), added), " "), F.lit("")))


def measure_mm(value, bare_small_as_meters: bool = False) -> Column:
    """Millimetres of the first number of a text with mm, cm, m or no unit."""
    return let(fold(_col(value)), lambda t: to_mm(parse_number(F.regexp_extract(t, r"(\d+(?:[.,]\d+)?)\s*(mm|cm|m)?\b", 1)), F.regexp_extract(t, r"(\d+(?:[.,]\d+)?)\s*(mm|cm|m)?\b", 2), bare_small_as_meters=bare_small_as_meters))


def typed_properties(properties) -> Column:
    """map<string,string> of the attributes that a supplier's properties (map<string,string>) name; of two names that fold to one the first counts."""
    entries = F.transform(F.coalesce(F.map_entries(_col(properties)), F.array().cast("array<struct<key:string,value:string>>")), lambda e: F.struct(fold(e["key"]).alias("k"), F.trim(e["value"]).alias("v")))

    def read(es: Column) -> Column:
        # The value of the first name that has one.
        named = lambda n: F.try_element_at(F.filter(es, lambda e: (e["k"] == n) & (e["v"] != "")), F.lit(1))["v"]
        of = lambda names: F.coalesce(*map(named, names))
        thick = of(PROPERTIES["thickness_mm"])
        in_mm = F.exists(es, lambda e: e["k"] == PROPERTIES["thickness_mm"][0])
        drive, material = fold(of(PROPERTIES["drive"])), fold(of(PROPERTIES["material"]))
        short = F.create_map(*(F.lit(x) for pair in DRIVES.items() for x in pair))
        sign = F.coalesce(*(F.when(material.contains(s), F.lit(name)) for s, name in MATERIALS.items()), material)
        values = {
            "length_mm": measure_mm(of(PROPERTIES["length_mm"]), True), "diameter_mm": measure_mm(of(PROPERTIES["diameter_mm"])), "thickness_mm": F.when(in_mm, measure_mm(thick)).otherwise(measure_mm(thick, True)),
            "width_mm": measure_mm(of(PROPERTIES["width_mm"]), True), "drive": F.coalesce(short[F.split_part(drive, F.lit(" "), F.lit(1))], drive), "material": sign, "color": fold(of(PROPERTIES["color"])),
        }
        return F.map_filter(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v.cast("string")))), lambda k, v: v.isNotNull())

    return let(entries, read)


def overlay(known, told, wanted: Column) -> Column:
    """struct(values, sources, conflict): ``told`` fills what ``known`` lacks of the ``wanted`` keys, and changes nothing.

    Both are maps of text. sources says where each value is from: text or property. Two different values of a wanted key
    are a conflict, whatever their form ('5' and '5.0' are one value).
    """
    a, b = _col(known), _col(told)

    def both(x: Column, y: Column) -> Column:
        more = F.map_filter(y, lambda k, v: F.array_contains(wanted, k) & x[k].isNull())
        kept = F.map_filter(x, lambda k, v: v.isNotNull())
        clash = F.exists(F.map_keys(y), lambda k: F.array_contains(wanted, k) & F.coalesce(plain_value(x[k]) != plain_value(y[k]), F.lit(False)))
        return F.struct(
            F.map_concat(kept, more).alias("values"), F.map_concat(F.transform_values(kept, lambda k, v: F.lit("text")), F.transform_values(more, lambda k, v: F.lit("property"))).alias("sources"), clash.alias("conflict")
        )

    return let(F.struct(a.alias("a"), b.alias("b")), lambda p: both(p["a"], p["b"]))


def attributes_conflict(a: Column, b: Column, keys: Column) -> Column:
    """Whether a key that both maps know has two different values; what a side doesn't say contradicts nothing."""
    return F.exists(keys, lambda k: F.coalesce(plain_value(a[k]) != plain_value(b[k]), F.lit(False)))


def unsupported_variant(a, b) -> Column:
    """Whether the first label names a variant that the second doesn't name alike."""
    def differs(p: Column) -> Column:
        found = lambda t, v: F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(v), F.lit(1))))
        out = F.lit(False)
        for v in VARIANTS:
            out = out | ((F.size(found(p["a"], v)) > 0) & (found(p["a"], v) != found(p["b"], v)))
        return out

    said = lambda x: fold(F.coalesce(_col(x), F.lit("")))
    return let(F.struct(said(a).alias("a"), said(b).alias("b")), differs)


def identity_grounded(values: Column, a, b) -> Column:
    """Whether each size such as '1200x950' of an identity is in both labels, side by side or not."""
    said = lambda x: F.replace(fold(F.coalesce(_col(x), F.lit(""))), F.lit(" "), F.lit(""))

    def there(p: Column) -> Column:
        sizes = F.filter(values, lambda v: v.rlike(r"^\d") & v.contains("x"))
        return F.forall(F.flatten(F.transform(sizes, lambda v: F.split(v, "x"))), lambda s: F.contains(p["a"], s) & F.contains(p["b"], s))

    return let(F.struct(said(a).alias("a"), said(b).alias("b")), there)


def match_text(label, properties) -> Column:
    """A label and the values of its properties, as one text that rules can read."""
    values = F.filter(F.map_values(_col(properties)), lambda v: F.trim(v) != "")
    return F.concat_ws(" ", F.coalesce(_col(label), F.lit("")), F.nullif(F.array_join(F.coalesce(values, F.array().cast("array<string>")), " "), F.lit("")))


def family_of(rule) -> Column:
    """The family that a rule's links are reported by."""
    code = _col(rule)
    has = lambda *parts: code.rlike("|".join(parts))
    return (
        F.when(has("^VIS", "TIREFOND", "GOUJON"), "VIS").when(has("CHEVILLE"), "CHEVILLE").when(has("BOULON"), "BOULON").when(has("PLAQUE"), "PLAQUE").when(has("PANNEAU", "OSB", "MDF", "AGGLO"), "PANNEAU")
        .when(has("CIMENT", "MORTIER", "ENDUIT"), "CIMENT").when(has("CABLE", "^H07", "ELEC"), "ELECTRICITE").when(has("OSSATURE", "RAIL", "MONTANT"), "OSSATURE").otherwise(code)
    )


def _values(source: str, keys: Column) -> Column:
    """The values of an identity in plain form, or null if one of them is missing, blank or 'nr'."""
    plain = F.transform(keys, lambda k: plain_value(F.col(source)[k]))
    return F.when((F.size(keys) > 0) & F.forall(plain, lambda v: v.isNotNull() & (v != "nr")), plain)


def _keys(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    return by_rule(rules, lambda r: r.model.keys), by_rule(rules, lambda r: tuple(k for k in r.model.secondary if k not in r.model.keys))


def identity_index(targets: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(rule, values, secondary, n, product): the products of each identity and each set of other attributes.

    ``targets``: product_id, name, designation, attributes (map<string,string>). A product is read from its smallest label
    that a rule reads whole; its own attributes go before those of the label. product is the one with the smallest id.
    """
    keys, secondary = _keys(rules)
    read = stored(claims(targets.withColumnRenamed("attributes", "own").withColumn("__text", expand_synonyms("designation")), rules, "__text"))
    own = F.coalesce(F.col("own"), F.create_map().cast("map<string,string>"))
    told = F.map_concat(F.col("attributes"), F.map_filter("identity", lambda k, v: v.isNotNull()))
    rows = read.withColumn("told", told).withColumn("mine", F.map_filter(own, lambda k, v: v.isNotNull())).withColumn("all", F.map_concat("mine", F.map_filter("told", lambda k, v: F.col("mine")[k].isNull())))
    rows = stored(rows.select("rule", "product_id", "designation", "name", "all"))
    rows = rows.withColumn("values", _values("all", keys)).where("values IS NOT NULL")
    kept = F.array_sort(F.map_entries(F.transform_values(F.map_filter("all", lambda k, v: F.array_contains(secondary, k)), lambda k, v: plain_value(v))))
    one = rows.select("rule", "product_id", F.struct("designation", "name", "values", kept.alias("secondary")).alias("x")).groupBy("rule", "product_id").agg(F.min("x").alias("x"))
    return one.groupBy("rule", "x.values", "x.secondary").agg(F.count("*").alias("n"), F.min(F.struct("product_id", F.col("x.name").alias("name"))).alias("product"))


def equivalents(rows: DataFrame, index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, outcome, level, rule, product_id) of every row (id, designation, properties, product_id).

    A rule that reads a row's label, gaps filled by its properties, proposes the only product of that identity
    (complete), or the only one that no other known attribute contradicts (strong); several are ambiguous, and so is a
    property that contradicts the label. A variant that one side alone names, or a size that a label lacks, lets the
    proposal drop. One product from all rules is linked, by the foremost level, then the code; several are
    ambiguous. outcome: linked, same (it is the row's product already), ambiguous or none.
    """
    keys, secondary = _keys(rules)
    empty = F.create_map().cast("map<string,string>")
    read = stored(claims(rows.withColumn("__text", expand_synonyms(match_text("designation", "properties"))), rules, "__text"))
    known = F.map_concat(F.map_filter("identity", lambda k, v: v.isNotNull()), "attributes")
    read = read.withColumn("o", overlay(known, typed_properties(F.coalesce("properties", empty)), F.concat(keys, secondary)))
    read = stored(read.select("id", "designation", "rule", "o"))
    # Repeated rows are judged once.
    read = read.select("id", "designation", "rule", F.col("o.conflict").alias("conflict"), F.array_sort(F.map_entries("o.values")).alias("told")).distinct()
    read = read.withColumn("told", F.map_from_entries("told")).withColumn("values", F.when(~F.col("conflict"), _values("told", keys)))
    clash = F.exists("secondary", lambda e: F.array_contains(secondary, e["key"]) & F.coalesce(plain_value(F.col("told")[e["key"]]) != e["value"], F.lit(False)))
    met = read.where("values IS NOT NULL").join(index.select("rule", "values", "secondary", "n", "product"), ["rule", "values"]).withColumn("clash", clash)
    # A row's products are counted by group before one of them is looked at.
    proposed = met.groupBy("id", "rule", "values", "designation").agg(
        F.sum("n").alias("bucket"), F.sum(F.when(~F.col("clash"), F.col("n")).otherwise(0)).alias("fits"), F.min(F.when(~F.col("clash"), F.col("product"))).alias("product")
    )
    sound = ~unsupported_variant("designation", "product.name") & identity_grounded(F.col("values"), "designation", "product.name")
    state = F.when(F.col("fits") != 1, "ambiguous").when(sound, F.when(F.col("bucket") == 1, "complete").otherwise("strong"))
    proposed = proposed.select("id", "rule", state.alias("state"), F.col("product.product_id").alias("found"))
    proposed = proposed.unionByName(read.where("conflict").select("id", "rule", F.lit("ambiguous").alias("state"), F.lit(None).cast(proposed.schema["found"].dataType).alias("found"))).where("state IS NOT NULL")
    good = F.col("state") != "ambiguous"
    per = proposed.groupBy("id").agg(
        F.min(F.when(good, F.struct("state", "rule", "found"))).alias("b"), F.min(F.when(good, F.col("found"))).alias("low"), F.max(F.when(good, F.col("found"))).alias("high"), F.min("rule").alias("first")
    )
    out = rows.select("id", "product_id").join(per, "id", "left")
    one = F.col("low").isNotNull() & (F.col("low") == F.col("high"))
    outcome = F.when(F.col("first").isNull(), "none").when(one & F.col("product_id").eqNullSafe(F.col("low")), "same").when(one, "linked").otherwise("ambiguous")
    return out.select("id", outcome.alias("outcome"), F.when(one, F.col("b.state")).alias("level"), F.when(one, F.col("b.rule")).alias("rule"), F.when(one, F.col("low")).alias("product_id"))
