"""Consolidation of candidate families: attribute clusters join the product families that hold their members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import content_tokens, let
from tallyforge.operators.components import connected_components
from tallyforge.operators.discover import STOPWORDS, overlaps

# Words of attributes, nouns of products, and the shares from which clusters are linked.
ATTRIBUTE_WORDS = (
    "tete", "fraisee", "fraise", "plate", "bombee", "trompette", "hexagonale", "hexagonal", "cylindrique", "fraisée", "posidriv", "philips", "phillips", "torx", "cruciforme",
    "empreinte", "six", "pans", "zingué", "zingue", "zinc", "inox", "galvanise", "galvanisé", "laiton", "blanc", "noir", "jaune", "brut", "classe", "carbone", "trempe",
    "autoforeuse", "autoperforante", "autoperçante", "autopercante", "turbo", "agglo", "placo", "multi", "universelle", "universel",
)
PRODUCT_NOUNS = (
    "vis", "cheville", "chevilles", "boulon", "boulons", "ecrou", "ecrous", "clou", "clous", "rivet", "goujon", "rondelle", "tirefond", "panneau", "panneaux", "plaque",
    "plaques", "osb", "contreplaque", "rail", "rails", "montant", "montants", "fourrure", "fourrures", "corniere", "cornieres", "profil", "profile", "tube", "tuyau", "raccord",
    "carrelage", "carreau", "parquet", "dalle", "ciment", "mortier", "colle", "enduit", "isolant", "laine", "peinture", "lasure", "vernis",
)
CONTAINED, JACCARD = 0.55, 0.30
#: Natures by the claim they have to be the root of a component.
NATURES = ("PRODUCT_FAMILY", "MIXED", "UNCERTAIN", "ATTRIBUTE_CLUSTER")
FASTENER_NOUNS = ("vis", "cheville", "chevilles", "boulon", "boulons", "ecrou", "ecrous", "clou", "clous")


def nature(label) -> Column:
    """What a cluster's label names: a product, attributes, a product with more attributes than nouns, or neither."""
    words = F.array_distinct(content_tokens(F.replace(label if isinstance(label, Column) else F.col(label), F.lit("_"), F.lit(" ")), STOPWORDS))
    hits = lambda w, lex: F.size(F.filter(w, lambda x: x.isin(*lex)))

    def judge(w: Column) -> Column:
        nouns, attributes = hits(w, PRODUCT_NOUNS), hits(w, ATTRIBUTE_WORDS)
        return F.when((nouns > 0) & (attributes <= nouns), "PRODUCT_FAMILY").when(nouns > 0, "MIXED").when(attributes > 0, "ATTRIBUTE_CLUSTER").otherwise("UNCERTAIN")

    return let(words, judge)


def links(members: DataFrame) -> DataFrame:
    """Pairs of families of one model whose members overlap by JACCARD, or of which one holds CONTAINED of the other's.

    ``members`` (model, family, id). A family's key is model and name, so families of other models never meet.
    """
    keyed = members.select(F.concat_ws("\x1f", "model", "family").alias("family"), F.concat_ws("\x1f", "model", "id").alias("id"))
    return overlaps(keyed).where((F.col("jaccard") >= JACCARD) | (F.col("a_in_b") >= CONTAINED) | (F.col("b_in_a") >= CONTAINED))


def consolidate(families: DataFrame, members: DataFrame) -> DataFrame:
    """(model, family, nature, root, role) of every candidate family.

    ``families`` (model, family), one row each; ``members`` (family, id). In each component of linked families the
    product families are the roots; without any the mixed ones, then the uncertain, then the attributes. The largest
    root (ties by name) is primary. Attribute clusters of the component, and roots with CONTAINED of their members in
    the primary, are attached to it. role is primary, attached, alone (a root that is not) or apart (a member that is
    neither root nor attribute); the last two are families of their own, as is an attribute cluster without links.
    """
    named = families.select("model", "family", nature("family").alias("nature")).distinct()
    held = named.select("model", "family").join(members.select("family", "id").where("id IS NOT NULL").distinct(), "family")
    size = held.groupBy("model", "family").agg(F.count("*").alias("n"))
    rank = F.array_position(F.array(*map(F.lit, NATURES)), F.col("nature"))
    nodes = named.join(size, ["model", "family"], "left").select("model", "family", "nature", F.coalesce("n", F.lit(0)).alias("n"), F.concat_ws("\x1f", "model", "family").alias("key"), rank.alias("rank")).checkpoint()
    pairs = links(held).select("a", "b", "shared", "a_in_b", "b_in_a").checkpoint()
    comp = connected_components(pairs).withColumnRenamed("vertex", "key")
    placed = nodes.join(comp, "key", "left").withColumn("component", F.coalesce("component", "key"))
    first = placed.groupBy("component").agg(F.min(F.struct("rank", (-F.col("n")).alias("minus"), "family", "key")).alias("p"))
    placed = placed.join(first, "component")
    both = pairs.select(F.col("a").alias("key"), F.col("b").alias("primary"), F.col("a_in_b").alias("held")).unionByName(pairs.select(F.col("b").alias("key"), F.col("a").alias("primary"), F.col("b_in_a").alias("held")))
    placed = placed.withColumn("primary", F.col("p.key")).join(both, ["key", "primary"], "left")
    attribute = F.col("nature") == "ATTRIBUTE_CLUSTER"
    root = F.col("rank") == F.col("p.rank")
    role = (
        F.when(F.col("key") == F.col("primary"), "primary").when(attribute | (root & (F.coalesce("held", F.lit(0.0)) >= CONTAINED)), "attached")
        .when(root, "alone").otherwise("apart")
    )
    out = placed.select("model", "family", "nature", "n", F.col("p.family").alias("primary_family"), role.alias("role"))
    root = F.when(F.col("role").isin("primary", "attached"), F.col("primary_family")).otherwise(F.col("family"))
    return out.select("model", "family", "nature", "n", "role", root.alias("root"))


def consolidated(placed: DataFrame, members: DataFrame) -> DataFrame:
    """(model, root, unique_members, sources, attributes, nature, role) of each family that is left; see consolidate."""
    counted = placed.select("model", "root", "family").join(members.select("family", "id").where("id IS NOT NULL").distinct(), "family").groupBy("model", "root").agg(F.countDistinct("id").alias("unique_members"))
    own = lambda c: F.max(F.when(F.col("family") == F.col("root"), F.col(c)))
    names = placed.groupBy("model", "root").agg(
        F.array_sort(F.collect_list(F.when(F.col("role") != "attached", F.col("family")))).alias("sources"), F.array_sort(F.collect_list(F.when(F.col("role") == "attached", F.col("family")))).alias("attributes"),
        own("nature").alias("nature"), own("role").alias("role"),
    )
    return names.join(counted, ["model", "root"], "left").withColumn("unique_members", F.coalesce("unique_members", F.lit(0)))


def audit(families: DataFrame, placed: DataFrame, members: DataFrame, labels: DataFrame, tokens: DataFrame) -> DataFrame:
    """``families`` (see consolidated) with coverage, distinct_identities, risks, false_positive and safe_quick_win.

    ``labels`` (id, features) as signatures.read_labels gives them, ``tokens`` (id, tokens). Fasteners need diameter and
    length in 70 % of the labels each, three pairs of sizes, and few labels without a noun of theirs; boards three sizes
    in 60 %, two boards, and few with a length alone; profiles a bar length in 50 %, and a profile in 30 % or two
    identities. Families of other models are never safe.
    """
    held = placed.select("model", "root", "family").join(members.select("family", "id").distinct(), "family").select("model", "root", "id").distinct()
    f = lambda k: F.col("features")[k]
    has = lambda *ks: F.forall(F.array(*(f(k) for k in ks)), lambda x: x.isNotNull())
    board, fastener = F.col("model") == "BOARD_PANEL", F.col("model") == "DIMENSIONAL_FASTENER"
    sizes = F.coalesce(f("dimensions_lxwxt"), F.concat_ws("x", f("length_mm"), f("width_mm"), f("thickness_mm")))
    profile = F.when(f("profile").isNotNull(), F.concat_ws("|", f("profile"), F.coalesce(f("bar_length_mm"), F.lit("None")))).otherwise(f("bar_length_mm"))
    whole = F.when(board, has("length_mm", "width_mm", "thickness_mm")).when(fastener, f("screw_length_mm").isNotNull()).otherwise(f("bar_length_mm").isNotNull())
    identity = F.when(board, F.when(has("length_mm", "width_mm", "thickness_mm"), sizes)).when(fastener, f("diameter_x_length")).otherwise(profile)
    noun = F.arrays_overlap("tokens", F.array(*map(F.lit, FASTENER_NOUNS)))
    risk = F.when(fastener, ~noun).when(board, ~has("length_mm", "width_mm", "thickness_mm") & f("length_mm").isNotNull() & f("width_mm").isNull()).otherwise(F.lit(False))
    known = F.col("model").isin("DIMENSIONAL_FASTENER", "BOARD_PANEL", "LINEAR_PROFILE")
    n = F.count("*")
    told = held.join(labels.select("id", "features"), "id").join(tokens.select("id", "tokens"), "id").groupBy("model", "root").agg(
        n.alias("n"), F.round(F.count_if(f("diameter_mm").isNotNull()) / n, 4).alias("diameter"), (F.count_if(whole) / n).alias("length"), (F.count_if(f("profile").isNotNull()) / n).alias("profile"),
        F.countDistinct(identity).alias("distinct_identities"), F.least(F.count_if(risk), F.lit(8)).alias("risks"),
    )
    few = lambda share: F.col("risks") <= F.greatest(F.lit(2), F.floor(share * F.col("n")))
    ids = F.col("distinct_identities")
    safe = (
        F.when(fastener, (F.col("diameter") >= 0.7) & (F.col("length") >= 0.7) & (ids >= 3) & few(0.1)).when(board, (F.col("length") >= 0.6) & (ids >= 2) & few(0.15))
        .when(known, (F.col("length") >= 0.5) & ((F.col("profile") >= 0.3) | (ids >= 2))).otherwise(F.lit(False))
    )
    name = F.lower("root")
    wrong = (board & name.contains("corniere")) | ((F.col("model") == "INSULATION") & name.rlike("fenetre|gazon|evier")) | (fastener & (F.col("nature") == "ATTRIBUTE_CLUSTER"))
    out = families.join(told, ["model", "root"], "left")
    return out.select(
        "model", "root", "nature", "unique_members", "sources", "attributes", F.when(fastener, F.col("diameter")).alias("diameter_coverage"),
        F.when(known, F.round("length", 4)).alias("length_coverage"), F.when(known, ids).alias("distinct_identities"), F.when(known, F.col("risks")).alias("risks"), wrong.alias("false_positive"),
        (F.coalesce(safe, F.lit(False)) & ~wrong & ~((F.col("nature") == "UNCERTAIN") & (F.col("role") == "apart"))).alias("safe_quick_win"),
    )


def first_lot(audited: DataFrame) -> DataFrame:
    """Safe families of the three models that exist, the largest first, then by model and name."""
    return audited.where("safe_quick_win").orderBy(F.desc("unique_members"), "model", "root")
