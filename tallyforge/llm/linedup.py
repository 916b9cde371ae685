"""Near-duplicate lines by a segment-partition edit join: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.components import connected_components
from tallyforge.session import ensure_checkpoint_dir, scratch, written

#: Edits that two lines may differ by at most, and characters that the shorter one needs for each of them.
EDITS, CHARS_PER_EDIT = 2, 10
#: Lines of one index entry that are paired directly; larger entries are split by a further segment first.
LIST = 1024
#: Segments that an entry is split by, one after another, before what is left in it is paired.
LEVELS = 4
#: Letters that are counted in each line; all others are counted together.
LETTERS = "eaintsrouldh"
BLANK = r" \t\r\x0B\f"


def norm(line: Column | str) -> Column:
    """A line as it is compared: trimmed of ASCII white space and lower-cased."""
    return F.lower(F.trim(F.col(line) if isinstance(line, str) else line, F.lit(" \t\r\x0b\x0c")))


def distinct_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(norm, first_id, copies): each different non-blank line, with the smallest id that holds it."""
    lines = docs.select(F.col(id_col).alias("id"), F.explode(F.split(text_col, "\n")).alias("line")).select("id", norm("line").alias("norm"))
    return lines.where("norm <> ''").groupBy("norm").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))


def _let(name: str, value: str, body: str) -> str:
    """SQL that computes ``value`` once and uses it under a name."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def banded_distance(x: str, y: str, edits: int) -> str:
    """SQL for the edit distance of two strings if it is at most ``edits``, else some larger number.

    The bit-parallel recurrence of the dynamic program's vertical differences, on a diagonal band of
    2 * edits + 1 rows that moves down by one row for each character of ``y``: one step of word
    operations a character. Lengths may differ by ``edits`` at most.
    """
    top = 2 * edits
    every = f"{(1 << (top + 1)) - 1}L"
    match = " | ".join(f"if(get(v.p, j - {edits} + {t}) = c, {1 << t}L, 0L)" for t in range(top + 1))
    edge = f"(size(v.p) - s.j + {edits})"
    across, down = f"((s.vn | ~(d | s.vp)) & {every})", "(d & s.vp)"
    lower = f"1 - (shiftright(d, {top}) & 1L)"
    last = f"(shiftright({across}, {edge}) & 1L) - (shiftright({down}, {edge}) & 1L)"
    step = (
        f"named_struct('vp', ({down} | ~(shiftright(d, 1) | {across})) & {every}, 'vn', shiftright(d, 1) & {across}, "
        f"'n', s.n + if(s.j <= size(v.p) - {edits}, {lower}, {last}), 'j', s.j + 1)"
    )
    zero = f"((((m & s.vp) + s.vp) ^ s.vp) | m | s.vn) & {every}"
    start = f"named_struct('vp', {((1 << (top + 1)) - 1) & ~((1 << edits) - 1)}L, 'vn', 0L, 'n', {edits}L, 'j', 1)"
    run = f"aggregate(transform(v.q, (c, j) -> {match}), {start}, (s, m) -> {_let('d', zero, step)}, s -> s.n)"
    return _let("v", f"named_struct('p', split({x}, ''), 'q', split({y}, ''))", run)


def _segment(length: str, i: int, parts: int) -> tuple[str, str]:
    """SQL for start (from 0) and size of segment i (from 0) of a line cut into even segments, the longer ones last."""
    short = f"({parts} - {length} % {parts})"
    return f"({i} * ({length} div {parts}) + greatest(0, {i} - {short}))", f"({length} div {parts} + if({i} >= {short}, 1, 0))"


def _entries(text: str, parent: str, edits: int) -> tuple[list[str], list[str], dict[int, list[str]]]:
    """SQL structs (key, own, less, start, size) of a line: its own segments; for its equals in length, what may
    have moved; and by ``less`` all that a line looks up which is no owner.

    Of edits + 1 segments of a line, one is whole in any line within ``edits`` edits. A line looks up
    lines that are ``less`` characters shorter. Where a segment may have moved to is bounded by the edits
    that can lie to its left and to its right (multi-match-aware choice). Owners of equal length with a
    segment in place meet by their own entries. ``parent`` is part of every key.
    """
    parts = edits + 1

    def entry(own: bool, less: int, i: int, off: int) -> str:
        length = f"(length({text}) - {less})"
        start, size = _segment(length, i, parts)
        start = f"cast({start} + {off} as int)"
        key = f"xxhash64({parent}, {length}, {i}, substr({text}, {start} + 1, cast({size} as int)))"
        return f"named_struct('key', {key}, 'own', {str(own).lower()}, 'less', {less}, 'start', {start}, 'size', cast({size} as int))"

    places = {
        less: [(i, off) for i in range(parts) for off in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1)]
        for less in range(parts)
    }
    own = [entry(True, 0, i, 0) for i in range(parts)]
    moved = [entry(False, 0, i, off) for i, off in places[0] if off]
    return own, moved, {less: [entry(False, less, *x) for x in where] for less, where in places.items()}


def _index(owners: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` of keys that other lines meet, with low, high (lines that own the key) and held (the owners' number).

    Owners are added up by key before they are sent, and a key is one row of the index; the entries
    that look it up stream past, so that a frequent key can be split among tasks.
    """
    held = owners.groupBy("key").agg(F.min("line").alias("low"), F.max("line").alias("high"), F.count("*").alias("held"))
    return rows.join(held.hint("shuffle_hash"), "key").where("held > 1 or line <> low")


def _pairs(*some: DataFrame) -> DataFrame:
    """Rows of (a, b) as distinct unordered pairs."""
    every = some[0]
    for more in some[1:]:
        every = every.union(more)
    return every.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def letter_counts(text: str) -> Column:
    """How often each of LETTERS occurs in a text, and how often other characters do.

    An edit changes the counts by two in sum at most, so lines whose counts differ by more than twice
    the edits are not near.
    """
    counts = [f"length({text}) - length(replace({text}, '{c}', ''))" for c in LETTERS]
    return F.expr(f"named_struct({', '.join(f"'{c}', {n}" for c, n in zip(LETTERS, counts, strict=True))}, 'rest', length(translate({text}, '{LETTERS}', '')))")


def _alike(x: str, y: str, edits: int) -> str:
    return " + ".join(f"abs({x}.{c} - {y}.{c})" for c in (*LETTERS, "rest")) + f" <= {2 * edits}"


def _verified(pairs: DataFrame, texts: DataFrame, edits: int, chars: int) -> DataFrame:
    """Those of the pairs whose lines are within the edits that the shorter of them allows."""
    one = lambda n, t: texts.select(F.col("line").alias(n), F.col("norm").alias(t), F.col("letters").alias(f"{t}l"))
    both = written(pairs, "line-pairs").join(one("a", "x"), "a").join(one("b", "y"), "b")
    budget = F.least(F.lit(edits), F.least(F.length("x"), F.length("y")) / chars)
    near = (F.abs(F.length("x") - F.length("y")) <= edits) & F.expr(_alike("xl", "yl", edits))
    # Written before it is filtered: a filter moved below the projection would run the recurrence twice.
    told = both.where(near).select("a", "b", F.expr(banded_distance("x", "y", edits)).alias("distance"), budget.alias("budget"))
    return written(told, "line-links").where("distance <= budget").select("a", "b", "distance")


def line_links(known: DataFrame, edits: int = EDITS, chars: int = CHARS_PER_EDIT) -> DataFrame:
    """(a, b, distance): verified links between different lines, whose components are those of all near pairs.

    ``known`` has (line, norm) of each different line once. Two lines are near if they are within
    ``edits`` edits, and within one for every ``chars`` characters of the shorter. Candidates come
    from equal segment keys. First every line meets two owners of each key it has. A key with more owners
    whose lines are in different components after that pairs all of them whose letter counts allow it,
    directly if they are LIST or fewer; else its lines are cut by the segment they share, and what is
    left of them is partitioned and looked up anew, so that lines meet only if they share a segment at
    every level. Nothing is left out: a pair within ``edits`` edits shares one at each.
    """
    if chars < edits + 1 or edits < 1:
        raise ValueError("a line needs a character in each segment")
    ensure_checkpoint_dir(known.sparkSession)
    own, moved, probes = _entries("norm", "0", edits)
    entries = own + moved + [p for less in range(1, edits + 1) for p in probes[less]]
    keys = lambda some: F.expr(f"array({', '.join(f'{e}.key' for e in some)})")
    long = known.where(F.length("norm") >= chars)
    owners = long.select("line", F.explode(keys(own)).alias("key"))
    rows = long.select("line", F.posexplode(keys(entries)).alias("kind", "key"))
    members = written(_index(owners, rows), "line-index")
    met = written(members.select("line").union(members.select("low")).distinct(), "lines-met")
    texts = written(known.select("line", "norm").join(met, "line", "left_semi").select("line", "norm", letter_counts("norm").alias("letters")), "line-texts")
    star = _pairs(members.select(F.col("line").alias("a"), F.col("low").alias("b")), members.select("line", "high"))
    links = _verified(star, texts, edits, chars)
    many = members.where("held > 2").select("key", "line", "kind")
    if many.isEmpty():
        return links
    labels = written(connected_components(links), "line-labels").select(F.col("vertex").alias("line"), F.col("component").alias("label"))
    level = many.join(labels, "line", "left").select("key", "line", F.coalesce("label", "line").alias("label"), (F.col("kind") < len(own)).alias("own"), "kind")
    level, found = written(level, "line-lists"), []
    for depth in range(LEVELS + 1):
        cut = depth > 0
        per = level.groupBy("key").agg(
            F.count_if("own").alias("held"), F.count("*").alias("n"), F.min("label").alias("lowest"), F.max("label").alias("highest"),
            (F.min(F.length("rest")) if cut else F.lit(chars)).alias("left_over"),
        )
        level = written(level.join(per.where("held > 0 and lowest < highest").select("key", "n", "left_over"), "key"), "line-lists")
        few = F.lit(True) if depth == LEVELS else (F.col("n") <= LIST) | (F.col("left_over") <= edits)
        here = level.where(few).select("key", "line", "label", "own").join(texts.select("line", "letters"), "line")
        x = here.where("own").select("key", F.col("line").alias("a"), F.col("label").alias("la"), F.col("letters").alias("xl"))
        y = here.select("key", F.col("line").alias("b"), F.col("label").alias("lb"), F.col("letters").alias("yl"), "own")
        found.append(x.join(y, "key").where(f"la <> lb and (not own or a < b) and {_alike('xl', 'yl', edits)}").select("a", "b"))
        wide = level.where(~few)
        if depth == LEVELS or wide.isEmpty():
            break
        if not cut:
            entry = F.expr(f"array({', '.join(entries)})[kind]")
            wide = wide.join(texts.select("line", "norm"), "line").select("key", "line", "label", "own", "norm", entry.alias("e"))
            wide = wide.select("key", "line", "label", "own", F.col("e.less").alias("less"), F.expr("overlay(norm placing '' from e.start + 1 for e.size)").alias("rest"))
        mine, shifted, looked = _entries("rest", "key", edits)
        cases = " ".join(f"when less = {less} then array({', '.join(some)})" for less, some in looked.items())
        wide = wide.select("line", "label", "rest", F.explode(F.expr(f"case when own then array({', '.join(mine + shifted)}) {cases} end")).alias("e"))
        level = written(
            wide.select("e.key", "line", "label", "e.own", "e.less", F.expr("overlay(rest placing '' from e.start + 1 for e.size)").alias("rest")), "line-level"
        )
    return links.union(_verified(_pairs(*found), texts, edits, chars))


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, chars: int = CHARS_PER_EDIT) -> DataFrame:
    """(norm, first_id, copies, class, members, near) of each different line: a class is what links connect.

    class is the number of one of its lines, members the number of different lines in it. near is true
    for all lines of a class but its first, in the order of first_id, then a hash of the text. Null ids come
    last in that order.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    numbered = distinct_lines(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("line"), "*", F.xxhash64("norm").alias("code"))
    known = written(numbered, "lines")
    roots = written(connected_components(line_links(known, edits, chars)), "line-roots").select(F.col("vertex").alias("line"), F.col("component").alias("class"))
    linked = known.select("line", "first_id", "code").join(roots, "line")
    order = F.struct(F.col("first_id").isNull(), "first_id", "code", "line")
    firsts = linked.groupBy("class").agg(F.min(order).alias("head"), F.count("*").alias("members"))
    judged = linked.join(firsts, "class").select("line", "class", "members", (F.col("line") != F.col("head.line")).alias("near"))
    return known.join(written(judged, "line-classes"), "line", "left").select(
        "norm", "first_id", "copies", F.coalesce("class", "line").alias("class"), F.coalesce("members", F.lit(1)).cast("long").alias("members"), F.coalesce("near", F.lit(False)).alias("near")
    )


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, chars: int = CHARS_PER_EDIT) -> DataFrame:
    """(id, n_lines, n_repeated, n_near, n_linked) of every document.

    n_lines counts non-blank lines. n_repeated: occurrences beyond the first of their text, the first being
    in the smallest id that holds it (within it, the topmost). Of the lines that the document is the first
    to hold, n_linked counts those in a class of several lines, n_near those that are not the first of
    their class. Null texts have no line and give zeros; rows with one id, null included, are one
    document; an empty input gives an empty result; extra columns are ignored.
    """
    with scratch(docs.sparkSession):
        classes = line_classes(docs, id_col, text_col, edits, chars)
        held = classes.groupBy("first_id").agg(
            F.count("*").alias("firsts"), F.count_if(F.col("members") > 1).alias("linked"), F.count_if("near").alias("n_near")
        )
        held = held.checkpoint()
    count = F.coalesce(F.regexp_count(text_col, F.lit(rf"[^\n{BLANK}][^\n]*")), F.lit(0))
    per = docs.groupBy(F.col(id_col).alias("__id")).agg(F.sum(count).cast("long").alias("n_lines"))
    joined = per.join(held, per["__id"].eqNullSafe(held["first_id"]), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return joined.select(
        F.col("__id").alias(id_col), "n_lines", (F.col("n_lines") - zero("firsts")).alias("n_repeated"), zero("n_near").alias("n_near"), zero("linked").alias("n_linked")
    )


def drop_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, chars: int = CHARS_PER_EDIT) -> DataFrame:
    """(id, text) with repeated and near-repeated lines removed; documents keep their lines' order.

    Ids are expected to be unique. A document that loses all lines keeps an empty text; a null text
    stays null.
    """
    classes = line_classes(docs, id_col, text_col, edits, chars).where("not near").select("norm", "first_id")
    base = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    rows = base.select("__id", F.posexplode(F.split("__text", "\n")).alias("line_no", "line")).withColumn("norm", norm("line"))
    tops = rows.where("norm <> ''").groupBy("__id", "norm").agg(F.min(F.struct("line_no", "line")).alias("top"))
    kept = tops.join(classes, (tops["norm"] == classes["norm"]) & tops["__id"].eqNullSafe(classes["first_id"]), "left_semi").select("__id", "top")
    kept = kept.union(rows.where("norm = ''").select("__id", F.struct("line_no", "line")))
    lines = kept.groupBy("__id").agg(F.expr("array_join(transform(array_sort(collect_list(top)), x -> x.line), '\n')").alias("kept"))
    joined = base.join(lines.withColumnRenamed("__id", "__other"), F.col("__id").eqNullSafe(F.col("__other")), "left")
    return joined.select(F.col("__id").alias(id_col), F.when(F.col("__text").isNotNull(), F.coalesce("kept", F.lit(""))).alias(text_col))
