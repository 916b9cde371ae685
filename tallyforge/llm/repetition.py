"""Quality rules with repetition measured on a suffix array of each text's words.

The suffixes of all texts of a slice are sorted at once by prefix doubling, with the text as the first
key, so that suffixes of one text are neighbours. Their longest common prefixes give intervals of
suffixes that share a string; an interval whose occurrences don't all follow the same word is a
maximal repeat. Work and memory grow in proportion to a text's words (times the logarithm of its
longest repeat); no text is cut and none is compared with another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.batches import byte_set, raw_bytes, slices, word_spans
from tallyforge.session import ship_package

IN_WORD = ~byte_set((0x09, 0x0D), (0x20, 0x20))
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
#: The base rules: words of a window, least words of a text, percent of its words in repeated windows.
WINDOW, LEAST_WORDS, REPEATED_PERCENT = 5, 10, 20
#: The method's rules: words of a repeat that counts, percent of a text's characters that such repeats may cover,
#: and words that a single repeat may have.
REPEAT_WORDS, COVERED_PERCENT, LONGEST_WORDS = 10, 20, 100
SPANS = "array<struct<start:bigint,stop:bigint>>"


def word_ids(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words only. ``skip`` flags the bytes outside the words."""
    cuts = np.concatenate(([0], np.cumsum(stops - starts)))
    held = np.ascontiguousarray(data[~skip])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(held)])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def suffix_array(ids: np.ndarray, row: np.ndarray, row_end: np.ndarray) -> np.ndarray:
    """The suffixes in order of (row, words); a suffix that ends is smaller than one that goes on."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64)
    key = row * (int(ids.max()) + 1) + ids
    order = np.argsort(key, kind="stable")
    at = np.arange(n)

    def ranks(held: np.ndarray, base: np.ndarray, changes: np.ndarray):
        """Ranks of the sorted suffixes ``held`` at the places ``base``: the place of the first equal one."""
        lead = np.maximum.accumulate(np.where(changes, np.arange(len(held)), 0))
        return base[lead], lead

    sa, rank = order.copy(), np.empty(n, np.int64)
    r, lead = ranks(order, at, np.r_[True, key[order[1:]] != key[order[:-1]]])
    rank[order] = r
    size = np.bincount(lead, minlength=n)
    tied = size[lead] > 1
    active, place, k = order[tied], at[tied], 1
    while len(active):
        # Only suffixes that are still tied are sorted again, by the rank of what follows k words on.
        ahead = active + k
        inside = ahead < row_end[active]
        second = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[active] * (n + 1) + second
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        sa[place] = active
        r, lead = ranks(active, place, np.r_[True, key[1:] != key[:-1]])
        rank[active] = r
        tied = np.bincount(lead, minlength=len(active))[lead] > 1
        active, place, k = active[tied], place[tied], 2 * k
    return sa


def _agreement(ids: np.ndarray, a: int, b: int, most: int) -> int:
    """Words that the suffixes a and b have in common, compared in stretches of doubling length."""
    done, step = 0, 64
    while done < most:
        step = min(step, most - done)
        other = np.flatnonzero(ids[a + done : a + done + step] != ids[b + done : b + done + step])
        if len(other):
            return done + int(other[0])
        done, step = done + step, 2 * step
    return done


def common_prefixes(ids: np.ndarray, row: np.ndarray, row_start: np.ndarray, row_end: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """lcp[i]: words that the suffixes sa[i - 1] and sa[i] have in common, 0 at the first of a row.

    A suffix whose neighbour follows the same word has one word less in common than the suffix before it;
    only the others are compared, and their lengths add up to at most n log n.
    """
    n = len(ids)
    before = np.full(n, -1, np.int64)
    if n > 1:
        before[sa[1:]] = np.where(row[sa[1:]] == row[sa[:-1]], sa[:-1], -1)
    at = np.arange(n)
    led = (before >= 0) & (at > row_start) & (before > row_start)
    led &= ids[np.maximum(at - 1, 0)] == ids[np.maximum(before - 1, 0)]
    plcp = np.zeros(n, np.int64)
    a = np.flatnonzero(~led & (before >= 0))
    b = before[a]
    most = np.minimum(row_end[a] - a, row_end[b] - b)
    got = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for step in range(16):
        live = live[most[live] > step]
        live = live[ids[a[live] + step] == ids[b[live] + step]]
        got[live] = step + 1
    for k in live[most[live] > 16].tolist():
        got[k] = 16 + _agreement(ids, int(a[k]) + 16, int(b[k]) + 16, int(most[k]) - 16)
    plcp[a] = got
    source = np.maximum.accumulate(np.where(led, 0, at))
    plcp = np.where(led, plcp[source] - (at - source), plcp)
    return plcp[sa]


def intervals(lcp: np.ndarray, least: int) -> np.ndarray:
    """Rows (length, lo, hi): all runs lo..hi of the suffix array that share ``length`` >= ``least`` words, in no larger run."""
    out, stack, previous = [], [], -2
    for i in np.flatnonzero(lcp >= least).tolist():
        if i != previous + 1:
            while stack:
                length, lo = stack.pop()
                out.append((length, lo, previous))
        value, lo = int(lcp[i]), i - 1
        while stack and stack[-1][0] > value:
            length, lo = stack.pop()
            out.append((length, lo, i - 1))
        if not stack or stack[-1][0] < value:
            stack.append((value, lo))
        previous = i
    while stack:
        length, lo = stack.pop()
        out.append((length, lo, previous))
    return np.array(out, np.int64).reshape(-1, 3)


class Texts:
    """The measures of all texts of a slice."""

    def __init__(self, data: np.ndarray, cuts: np.ndarray):
        self.data, self.cuts = data, cuts
        skip = ~IN_WORD[data]
        self.starts, self.stops, self.first = word_spans(data, cuts, IN_WORD)
        self.points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        self.in_words = np.concatenate(([0], np.cumsum(~skip)))
        per_row = np.diff(self.first)
        self.row = np.repeat(np.arange(len(per_row)), per_row)
        self.row_start, self.row_end = np.repeat(self.first[:-1], per_row), np.repeat(self.first[1:], per_row)
        self.word_points = np.concatenate(([0], np.cumsum(self.points[self.stops] - self.points[self.starts])))
        self.ids = word_ids(data, self.starts, self.stops, skip)
        self.sa = suffix_array(self.ids, self.row, self.row_end)
        self.lcp = common_prefixes(self.ids, self.row, self.row_start, self.row_end, self.sa)
        self.repeat = np.zeros(len(self.ids), np.int64)  # the longest string that starts at a word and elsewhere in its text
        self.repeat[self.sa] = np.maximum(self.lcp, np.append(self.lcp[1:], 0))

    def per_row(self, sums: np.ndarray, at: np.ndarray) -> np.ndarray:
        return sums[at[1:]] - sums[at[:-1]]

    def symbols(self) -> np.ndarray:
        return self.per_row(np.concatenate(([0], np.cumsum(SYMBOLS[self.data]))), self.cuts)

    def repeated_lines(self) -> np.ndarray:
        """Lines with a word that equal an earlier line of their text."""
        feeds = np.flatnonzero(self.data == 0x0A)
        rows = np.concatenate((np.arange(len(self.cuts) - 1), np.searchsorted(self.cuts, feeds, "right") - 1))
        ends = np.concatenate((self.cuts[1:], feeds))
        order = np.argsort(ends, kind="stable")
        rows, ends = rows[order], ends[order]
        gone = np.concatenate(([0], np.cumsum(self.data == 0x0A)))
        cuts = np.concatenate(([0], ends - gone[ends])).astype(np.int64)
        lines = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(self.data[self.data != 0x0A]))])
        ids = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words = np.diff(self.in_words[np.concatenate(([0], ends))]) > 0
        rows, ids = rows[words], ids[words]
        _, firsts = np.unique(rows * (int(ids.max(initial=0)) + 1) + ids, return_index=True)
        n = len(self.cuts) - 1
        return np.bincount(rows, minlength=n) - np.bincount(rows[firsts], minlength=n)

    def covered(self, where: np.ndarray, length) -> np.ndarray:
        """Flags of the words in [where, where + length)."""
        edge = np.zeros(len(self.ids) + 1, np.int64)
        np.add.at(edge, where, 1)
        np.add.at(edge, where + length, -1)
        return np.cumsum(edge[:-1]) > 0

    def repeated_words(self, window: int) -> np.ndarray:
        held = self.covered(np.flatnonzero(self.repeat >= window), window)
        return self.per_row(np.concatenate(([0], np.cumsum(held))), self.first)

    def maximal(self, least: int):
        """(covered, number, longest): words covered by maximal repeats of ``least`` words, how many there are and the longest, by row."""
        n = len(self.first) - 1
        found = intervals(self.lcp, least)
        # An interval is maximal unless every occurrence follows the same word.
        previous = np.where(self.sa > self.row_start[self.sa], self.ids[np.maximum(self.sa - 1, 0)], -1 - self.sa) if len(self.sa) else self.sa
        differs = np.concatenate(([0], np.cumsum(np.r_[0, previous[1:] != previous[:-1]]))) if len(self.sa) else np.zeros(1, np.int64)
        left = differs[found[:, 2] + 1] - differs[found[:, 1] + 1] > 0
        found = found[left]
        rows = self.row[self.sa[found[:, 1]]]
        longest = np.zeros(n, np.int64)
        np.maximum.at(longest, rows, found[:, 0])
        # An occurrence goes on to the left where the word before it starts one that is longer by a word.
        grown = np.zeros(len(self.ids), bool)
        grown[1:] = (self.repeat[1:] + 1 == self.repeat[:-1]) & (self.row[1:] == self.row[:-1])
        where = np.flatnonzero((self.repeat >= least) & ~grown)
        return self.covered(where, self.repeat[where]), np.bincount(rows, minlength=n), longest

    def spans(self, covered: np.ndarray) -> pa.Array:
        """Runs of covered words of each row, in code points of its text."""
        n = len(self.ids)
        held = np.concatenate((covered, [False]))
        opens = held.copy()
        opens[1:] &= ~held[:-1]
        if n:
            heads = self.first[:-1][self.first[:-1] < n]
            opens[heads] = held[heads]
        closes = np.zeros(n + 1, bool)
        closes[1:] = held[:-1] & (~held[1:] | opens[1:])
        a, b = np.flatnonzero(opens), np.flatnonzero(closes) - 1
        base = self.points[self.cuts[self.row[a]]] if len(a) else a
        parts = [pa.array(self.points[self.starts[a]] - base, pa.int64()), pa.array(self.points[self.stops[b]] - base, pa.int64())]
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(a, self.first), pa.int32()), pa.StructArray.from_arrays(parts, ["start", "stop"]))


def measures(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeat_words: int = REPEAT_WORDS, covered_percent: int = COVERED_PERCENT,
    longest_words: int = LONGEST_WORDS,
) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_chars, n_repeats, longest_repeat, spans, base_failed, kept) of every row.

    A repeat is a string of ``repeat_words`` words or more that starts twice in a text, overlaps included, and can't
    be made longer to the left or right at all its places. covered_chars counts the characters of the words that
    repeats cover, spans are the covered runs in code points. A text is kept if the base rules hold, at most
    ``covered_percent`` of its word characters are covered and no repeat has more than ``longest_words`` words.
    Null texts count as empty: no words, so that the base rules fail. Rows with equal ids are judged each for
    itself; extra columns are ignored; an empty table gives no rows. A text is held whole by one task.
    """
    ship_package(docs.sparkSession)
    kept = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_chars", "n_repeats", "longest_repeat"]

    def run(batches):
        for some in slices(batches, most=1 << 20):
            t = Texts(*raw_bytes(some.column(1)))
            covered, number, longest = t.maximal(repeat_words)
            chars = np.diff(t.word_points)
            values = [
                np.diff(t.first), t.per_row(t.word_points, t.first), t.symbols(), t.repeated_lines(), t.repeated_words(WINDOW),
                t.per_row(np.concatenate(([0], np.cumsum(np.where(covered, chars, 0)))), t.first), number, longest,
            ]
            yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(v, pa.int64()) for v in values), t.spans(covered)], ["id", *longs, "spans"])

    kind = kept.schema["id"].dataType.simpleString()
    found = kept.mapInArrow(run, f"id {kind}, {', '.join(f'{c} long' for c in longs)}, spans {SPANS}").withColumnRenamed("id", id_col)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    clean = (100 * F.col("covered_chars") <= covered_percent * F.col("word_chars")) & (F.col("longest_repeat") <= longest_words)
    return found.withColumns({"base_failed": failed, "kept": ~failed & clean})


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures without spans."""
    return measures(docs, id_col, text_col).drop("spans")


def keep_clean(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """The rows of ``docs`` whose text is kept, each text judged once for every row that has it."""
    keyed = docs.withColumn("__key", F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    judged = measures(keyed.select("__key", text_col), "__key", text_col, **limits).where("kept").select("__key").distinct()
    return keyed.join(judged, "__key", "left_semi").select(*docs.columns)
