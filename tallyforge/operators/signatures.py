"""Signatures of product families: what their labels can be read for, and the identity model that follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.functions.text import let
from tallyforge.operators.discover import STOPWORDS
from tallyforge.operators.labels import by_label, stored

# Words that tell what a family is, and the shares from which a measure or a word counts.
LEXICONS = {
    "fastener": (
        "vis", "cheville", "chevilles", "boulon", "boulons", "ecrou", "ecrous", "clou", "clous", "rivet", "rivets", "goujon", "goujons", "tirefond", "tirefonds",
        "fixation", "fixations", "rondelle", "rondelles", "agrafe", "agrafes",
    ),
    "profile": ("rail", "rails", "montant", "montants", "fourrure", "fourrures", "profil", "profils", "profile", "corniere", "cornieres", "ossature"),
    "panel": ("plaque", "plaques", "panneau", "panneaux", "osb", "ba13", "ba10", "ba18", "contreplaque", "melamine", "agglomere", "lamelle"),
    "pipe": ("tube", "tubes", "tuyau", "tuyaux", "raccord", "raccords", "pvc", "per", "cuivre", "multicouche", "evacuation", "canalisation"),
    "paint": (
        "peinture", "peintures", "lasure", "lasures", "vernis", "laque", "laques", "acrylique", "glycero", "mat", "mate", "satine", "satinee", "brillant", "souscouche",
        "sous", "couche", "teinte", "coloris", "base", "testeur", "testeurs",
    ),
    "liquid_ambiguity": ("teinte", "coloris", "base", "testeur", "testeurs", "ral", "nuancier"),
    "bagged": ("ciment", "mortier", "colle", "colles", "enduit", "enduits", "beton", "platre", "chape", "ragreage", "joint", "joints", "sac", "sacs"),
    "tile": ("carrelage", "carreau", "carreaux", "faience", "parquet", "lame", "lames", "lamine", "dalle", "dalles", "vinyle", "pvc", "sol"),
    "insulation": ("isolant", "isolation", "laine", "polystyrene", "xps", "eps", "liege", "multicouche", "panneau", "rouleau", "lambda"),
}
HIGH, MIDDLE, LOW, WORDS, POOR = 0.70, 0.50, 0.35, 0.35, 0.15
EXISTING = ("DIMENSIONAL_FASTENER", "LINEAR_PROFILE", "BOARD_PANEL")
FEATURES = (
    "length_mm", "width_mm", "thickness_mm", "dimensions_lxwxt", "diameter_mm", "screw_length_mm", "diameter_x_length", "bar_length_mm", "profile", "volume_ml", "weight_g",
    "dn", "packaging_qty",
)


def raw_features(label) -> Column:
    """map<string,string> of all that a label, whose folded form is the column text.FOLDED, can be read for; what it doesn't hold is no key."""
    label = F.coalesce(label if isinstance(label, Column) else F.col(label), F.lit(""))
    whole = let(text.dimensions(label), lambda d: F.struct(d["length_mm"].alias("l"), d["width_mm"].alias("w"), d["thickness_mm"].alias("t")))
    parts = F.struct(whole.alias("whole"), text.length_width(label).alias("pair"), text.thickness_alone(label).alias("thick"), text.diameter_length(text.FOLDED).alias("screw"))

    def named(p: Column) -> Column:
        d, pair, screw = p["whole"], p["pair"], p["screw"]
        diameter = screw["diameter_mm"].cast("double").cast("string")
        values = {
            "length_mm": F.coalesce(d["l"], pair["length_mm"]), "width_mm": F.coalesce(d["w"], pair["width_mm"]), "thickness_mm": F.coalesce(d["t"], p["thick"]),
            "dimensions_lxwxt": F.concat(d["l"].cast("string"), F.lit("x"), d["w"].cast("string"), F.lit("x"), d["t"].cast("string")),
            "diameter_mm": diameter, "screw_length_mm": screw["length_mm"], "diameter_x_length": F.concat(diameter, F.lit("x"), screw["length_mm"].cast("string")),
            "bar_length_mm": text.bar_length_mm(text.FOLDED), "profile": text.profile_code(text.FOLDED), "volume_ml": text.volume_ml(text.FOLDED), "weight_g": text.weight_g(text.FOLDED),
            "dn": text.nominal_diameter(text.FOLDED), "packaging_qty": text.piece_count(text.FOLDED),
        }
        return F.create_map(*(x for k in FEATURES for x in (F.lit(k), values[k].cast("string"))))

    return F.map_filter(let(parts, named), lambda k, v: v.isNotNull())


def read_labels(rows: DataFrame, id_col: str = "id", text_col: str = "designation", mapped: Column | None = None) -> DataFrame:
    """(id, features, hits, mapped): what each label is read for, once for all families it is in, and the lexicons it has a word of."""
    words = text.content_tokens(text.FOLDED, STOPWORDS)
    found = lambda w: F.array(*(F.when(F.arrays_overlap(w, F.array(*map(F.lit, lex))), F.lit(name)) for name, lex in LEXICONS.items()))
    told = rows.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"), (F.lit(False) if mapped is None else F.coalesce(mapped, F.lit(False))).alias("mapped"))

    def read(labels: DataFrame) -> DataFrame:
        folded = stored(labels.withColumn(text.FOLDED, text.fold("__text")))
        return folded.select("__text", raw_features("__text").alias("features"), F.filter(let(words, found), lambda x: x.isNotNull()).alias("hits"))

    return by_label(told, "__text", read).select("id", "features", "hits", "mapped")


def signatures(members: DataFrame, labels: DataFrame, by: str = "family", top: int = 5) -> DataFrame:
    """(family, count, mapped, technical, features, lexical) of each family of ``members`` (family, id).

    features maps a measure to struct(coverage, distinct, examples): the share of labels with it, how many values it
    has and its most frequent ones, ties by value. lexical maps a lexicon to the share of labels with one of its words,
    technical is the share of labels with any measure. A member counts once for each family; families and ids that are
    null, and members without a label, count nowhere. Values are counted by family before they are ranked, and no row
    holds more than the measures there are, so a family of any size is spread over all tasks.
    """
    held = members.select(F.col(by).alias("family"), "id").where("family IS NOT NULL AND id IS NOT NULL").distinct().join(labels, "id")
    share = lambda n: F.count_if(n) / F.count("*")
    size = held.groupBy("family").agg(
        F.count("*").alias("count"), F.count_if("mapped").alias("mapped"), share(F.size("features") > 0).alias("technical"),
        F.create_map(*(x for name in LEXICONS for x in (F.lit(name), share(F.array_contains("hits", name))))).alias("lexical"),
    )
    values = held.select("family", F.explode("features").alias("key", "value")).groupBy("family", "key", "value").agg(F.count("*").alias("n"))
    ranked = values.withColumn("r", F.expr("row_number() OVER (PARTITION BY family, key ORDER BY n DESC, value)"))
    per = ranked.groupBy("family", "key").agg(
        F.sum("n").alias("n"), F.count("*").alias("distinct"), F.array_sort(F.collect_list(F.when(F.col("r") <= top, F.struct("r", "value")))).alias("best")
    )
    per = per.join(size.select("family", "count"), "family").groupBy("family").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", F.struct((F.col("n") / F.col("count")).alias("coverage"), "distinct", F.transform("best", lambda x: x["value"]).alias("examples")))))).alias("features")
    )
    none = F.create_map().cast("map<string,struct<coverage:double,distinct:bigint,examples:array<string>>>")
    return size.join(per, "family", "left").select("family", "count", "mapped", "technical", F.coalesce("features", none).alias("features"), "lexical")


def _share(key: str) -> Column:
    return F.coalesce(F.col("features")[key]["coverage"], F.lit(0.0))


def candidate_model() -> Column:
    """The first identity model whose measures and words a signature has, null for none."""
    lex = lambda k: F.coalesce(F.col("lexical")[k], F.lit(0.0))
    board = (_share("dimensions_lxwxt") >= MIDDLE) | ((_share("length_mm") >= MIDDLE) & (_share("width_mm") >= MIDDLE) & (_share("thickness_mm") >= LOW))
    tests = {
        "DIMENSIONAL_FASTENER": (((_share("diameter_mm") >= HIGH) & (_share("screw_length_mm") >= HIGH)) | (_share("diameter_x_length") >= HIGH)) & (lex("fastener") >= WORDS),
        "BOARD_PANEL": board & ((lex("panel") >= WORDS) | (_share("dimensions_lxwxt") >= HIGH)),
        "LINEAR_PROFILE": (_share("bar_length_mm") >= MIDDLE) & ((_share("profile") >= LOW) | (lex("profile") >= WORDS)),
        "PIPE": (lex("pipe") >= WORDS) & ((_share("dn") >= LOW) | (_share("diameter_mm") >= MIDDLE)),
        "LIQUID_FINISH": (_share("volume_ml") >= MIDDLE) & (lex("paint") >= WORDS),
        "BAGGED_MATERIAL": (_share("weight_g") >= MIDDLE) & (lex("bagged") >= WORDS),
        "TILE_OR_FLOORING": (lex("tile") >= WORDS) & (_share("length_mm") >= LOW) & (_share("width_mm") >= LOW),
        "INSULATION": (_share("thickness_mm") >= MIDDLE) & (lex("insulation") >= WORDS),
    }
    return F.coalesce(*(F.when(ok, F.lit(name)) for name, ok in tests.items()))


def qualify(signed: DataFrame, known: Column | None = None, generic: Column | None = None) -> DataFrame:
    """``signed`` (see signatures) with candidate_model, status and complexity.

    ``known`` marks families of a rule that exists, ``generic`` those whose label says nothing; neither has a model.
    """
    known = F.coalesce(known, F.lit(False)) if known is not None else F.lit(False)
    generic = F.coalesce(generic, F.lit(False)) if generic is not None else F.lit(False)
    telling = F.array_max(F.map_values("lexical")) >= WORDS
    poor = (F.col("technical") < POOR) & ~telling
    out = signed.withColumn("candidate_model", F.when(~known & ~generic & ~poor, candidate_model()))
    m = F.col("candidate_model")
    status = (
        F.when(known, "KNOWN_CATEGORY").when(generic, "NOISY_CLUSTER").when(poor, "POOR_DATA").when(m == "LIQUID_FINISH", "NEEDS_IDENTITY_DECISION").when(m.isin(*EXISTING), "READY_EXISTING_MODEL")
        .when(m.isNotNull(), "READY_GENERIC_FEATURES").when(F.col("technical") >= MIDDLE, "NEEDS_IDENTITY_DECISION").otherwise("POOR_DATA")
    )
    out = out.withColumn("status", status)
    of = F.create_map(*(F.lit(x) for pair in {
        "KNOWN_CATEGORY": "XS", "READY_EXISTING_MODEL": "XS", "READY_GENERIC_FEATURES": "S", "NEEDS_IDENTITY_DECISION": "M", "POOR_DATA": "L", "NOISY_CLUSTER": "L",
    }.items() for x in pair))
    return out.withColumn("complexity", of[F.col("status")])


def quick_wins(qualified: DataFrame, top: int = 50) -> DataFrame:
    """Families with a model, the simplest first, then by unmapped members, size and name."""
    ready = qualified.where(F.col("status").isin("READY_EXISTING_MODEL", "READY_GENERIC_FEATURES"))
    return ready.orderBy(F.col("complexity") != "XS", F.col("mapped") - F.col("count"), F.desc("count"), "family").limit(top)


def high_impact(qualified: DataFrame, top: int = 50) -> DataFrame:
    """Families with a model or measures, by unmapped members, size and name."""
    held = qualified.where(F.col("status").isin("READY_EXISTING_MODEL", "READY_GENERIC_FEATURES", "NEEDS_IDENTITY_DECISION"))
    return held.orderBy(F.col("mapped") - F.col("count"), F.desc("count"), "family").limit(top)
