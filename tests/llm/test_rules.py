"""Importance resampling, repetition rules and fill-in-middle against plain Python."""

import collections
import hashlib
import math
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent.parent))
import compare  # noqa: E402

from tallyforge.llm import fim, queries, repetition, resample  # noqa: E402
from tallyforge.session import table  # noqa: E402

SCHEMA = "doc_id long, text string, key string, n long, head boolean, spans string"
SAID = "the same ten words are said again and again here today "
ODD = [
    (9001, None), (9002, ""), (9003, " \n\t "), (9004, "ab " * 3000), (9005, "x" * 5000), (9006, "Été <S> don't  we'll ́a"), (9006, "again"), (None, "nameless words here"), (9004, "ab " * 3000),
    (9008, "ab " * 3000), (9009, f"{SAID}one {SAID}two"), (9010, " ".join(map(str, range(3000))) + " tail" * 3), (9011, "a\x00b c\x00  d \U0001f600 e"), (9012, "line one\nline two\n\nline one\n \nline one"),
    (9013, "y" * 70 + " " + "z" * 65 + " q " + "Z" * 64), (9014, " ".join(random.Random(3).choices("ab", k=900))), (9015, "lead" + " \n" * 40 + "trail  \t"),
]


@pytest.fixture(scope="module")
def rows(spark, sf):
    return [(r.doc_id, r.text) for r in table(spark, sf, "documents").orderBy("doc_id").limit(80).collect()] + ODD


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 5, None, "s") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(r):
    return tuple((x is None, x) for x in r)


# Resampling

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return [zlib.crc32(f.encode()) % 10_000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]], len(w)


def resampled(rows, target, share=25):
    held = [(i, *features(t)) for i, t in rows]
    s = collections.Counter(b for _, f, _ in held for b in f)
    t = collections.Counter(b for x in target for b in features(x)[0])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (s_all + 10000.0) / ((s[b] + 1.0) * (t_all + 10000.0)))) for b in range(10_000)]
    out = []
    for i, f, n in held:
        w = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    order = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    rank = {id(r): k + 1 for k, r in enumerate(order[: share * len(order) // 100])}
    return sorted((tuple([*r[:4], rank.get(id(r))]) for r in out), key=key)


@pytest.mark.parametrize("chunk", [resample.CHUNK, 1000, 64])
def test_resampling_matches_plain_counting(spark, sf, docs, rows, chunk):
    target = table(spark, sf, "benchmark")
    want = resampled(rows, [r.text for r in target.collect()])
    assert sorted(map(tuple, resample.resample(docs, target, chunk=chunk).collect()), key=key) == want


def test_resampling_of_all_rows_repeats_and_empty_tables(spark, docs, rows, empty):
    target = spark.createDataFrame([("ab ab", "clash"), (None, None)], "text string, doc_id string")
    same = spark.createDataFrame([(7, "ab " * 900)] * 5 + [(7, "ab " * 700)] * 3, "doc_id long, text string")
    got = sorted(map(tuple, resample.resample(same, target, chunk=100, share=50).collect()), key=key)
    assert got == resampled([(7, "ab " * 900)] * 5 + [(7, "ab " * 700)] * 3, ["ab ab", None], 50)
    assert sorted(r[-1] or 0 for r in got) == [0, 0, 0, 0, 1, 2, 3, 4]
    assert sorted(map(tuple, resample.resample(docs, empty, share=100).collect()), key=key) == resampled(rows, [], 100)
    assert resample.resample(empty, target).count() == 0
    kept = resample.drawn(docs, target)
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)


def test_chunks_hold_each_start_once(docs):
    cut = resample._chunks(docs.where("octet_length(text) > 500").select(F.col("doc_id").alias("id"), "text"), 2, 500).collect()
    whole = {i: features(t)[1] for i, t in ODD}
    for i in (9005, 9010):
        mine = [r for r in cut if r.id == i]
        words = [len(re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text)) - r.carry for r in mine]
        assert sum(words) == whole[i] and sum(r.head for r in mine) == 1 and (i == 9005 or len(mine) > 20)


def test_hashes_are_crc32():
    texts = [b"a bc  " + b"d" * 64 + b" " + b"e" * 65 + b" f", b"", "é ü".encode(), b"g"]
    data, cuts = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    found, at, first = resample.bucket_runs(data, cuts, 3, 1 << 31)
    words = [t.split() for t in texts]
    for n, b in enumerate(found):
        want = [zlib.crc32(b" ".join(w[k : k + n + 1])) % (1 << 31) for w in words for k in range(len(w) - n)]
        assert b.tolist() == want
    assert first.tolist() == [0, 5, 5, 7, 8]


# Repetition

def measured(text, least=repetition.REPEAT_WORDS):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)

    def covered(n):
        seen = collections.Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
        hit = [False] * len(w)
        for k in range(len(w) - n + 1):
            if seen[tuple(w[k : k + n])] > 1:
                hit[k : k + n] = [True] * n
        return hit

    lines, seen, again = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            again += x in seen
            seen.add(x)
    long = sum(len(a) for a, b in zip(w, covered(least)) if b)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), again, sum(covered(5)), long


def maximal_repeats(w, least):
    places = collections.defaultdict(list)
    for a in range(len(w)):
        for n in range(least, len(w) - a + 1):
            places[tuple(w[a : a + n])].append(a)
    out = []
    for s, at in places.items():
        before = {w[a - 1] if a else None for a in at}
        after = {w[a + len(s)] if a + len(s) < len(w) else None for a in at}
        if len(at) > 1 and (len(before) > 1 or 0 in at) and (len(after) > 1 or at[-1] + len(s) == len(w)):
            out.append(len(s))
    return out


def test_repetition_matches_plain_counting(docs, rows, empty):
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.covered_chars) for r in repetition.measures(docs).collect()), key=key)
    assert got == sorted(((i, *measured(t)) for i, t in rows), key=key)
    by = {r.doc_id: r for r in repetition.measures(docs).collect()}
    assert by[9001].base_failed and by[9002].base_failed and not by[9001].kept and by[9004].base_failed
    assert (by[9004].longest_repeat, by[9009].longest_repeat, by[9009].n_repeats) == (2999, 11, 1)
    assert [(s.start, s.stop) for s in by[9009].spans] == [(0, len(SAID) - 1), (len(SAID) + 4, 2 * len(SAID) + 3)]
    assert repetition.measures(empty).count() == 0 and repetition.keep_clean(empty).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_and_maximal_repeats(seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices("abc"[: 1 + seed % 3], k=rng.randrange(0, 60))) for _ in range(5)] + ["", "a b c d e f g h a b c d x a b c d"]
    t = repetition.Texts(np.frombuffer("".join(x + "\n" for x in texts).encode(), np.uint8), np.cumsum([0, *(len(x) + 1 for x in texts)]))
    want, common = [], []
    for k, x in enumerate(texts):
        w = x.split()
        order = sorted(range(len(w)), key=lambda i: [t.ids[t.first[k] + j] for j in range(i, len(w))])
        want += [int(t.first[k]) + i for i in order]
        for n, i in enumerate(order):
            a, b = (w[i:], w[order[n - 1] :]) if n else ([], [])
            common.append(next((j for j, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b))))
    assert t.sa.tolist() == want and t.lcp.tolist() == common
    for least in (1, 3):
        covered, number, longest = t.maximal(least)
        for k, x in enumerate(texts):
            found = maximal_repeats(x.split(), least)
            assert (number[k], longest[k]) == (len(found), max(found, default=0))
            assert sum(len(w) for w, c in zip(x.split(), covered[t.first[k] :]) if c) == measured(x, least)[5]


def test_long_repeats_and_wide_cover_are_dropped(spark):
    w = [f"w{k}" for k in range(2000)]
    texts = {1: w, 2: w + w[:100], 3: w + w[:101], 4: w[:200] + w[:40], 5: w[:12] + ["x"] + w[:12] + w[20:130], 6: w[:9] + ["x"] + w[:9]}
    rows = [(i, " ".join(x)) for i, x in texts.items()]
    got = {r.doc_id: (r.base_failed, r.kept) for r in repetition.measures(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (False, True), 2: (False, True), 3: (False, False), 4: (True, False), 5: (False, True), 6: (True, False)}
    again = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string")
    strict = repetition.keep_clean(again, covered_percent=5)
    assert sorted(str(r.doc_id) for r in strict.collect()) == ["1", "None"] and repetition.keep_clean(again).count() == 4


def test_a_huge_repetitive_text_stays_linear():
    text = b"ab cd " * 60_000 + b"end"
    t = repetition.Texts(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    covered, number, longest = t.maximal(10)
    assert covered.sum() == 120_000 and longest[0] == 119_998 and number[0] > 0


# Fill-in-middle

def cut(i, text):
    text = text or ""
    u = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    d = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return i, len(u), "plain", None, None, text
    spm = h[3] % 100 < 80
    return i, len(u), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_fim_matches_plain_cutting_and_round_trips(spark, docs, rows, empty):
    more = rows + [(k, t) for k in range(100, 140) for t in ("one two  three\nfour", "< P> <S <", "a <M")]
    frame = spark.createDataFrame([(i, t, "clash", 5, None, "s") for i, t in more], SCHEMA).repartition(2)
    done = fim.transform(frame).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in done), key=key) == sorted((cut(i, t) for i, t in more), key=key)
    assert sorted(r.back for r in done) == sorted(t or "" for _, t in more)
    assert {r.form for r in done} == {"plain", "spm", "psm"} and fim.transform(empty).count() == 0
    got = sorted((tuple(r) for r in fim.digests(docs).collect()), key=key)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert got == sorted(((*(c := cut(i, t))[:5], sha(c[5]), sha(t)) for i, t in rows), key=key)


def test_registered_queries(spark, sf):
    con = compare.connect(sf)
    same, extra, missing = compare.differences(queries.op13_fim(spark, sf), con, queries.oracle_sql()["op13_fim"])
    assert same and not extra and not missing
    rows = con.execute("SELECT doc_id, text FROM documents").fetchall()
    want = resampled(rows, [t for (t,) in con.execute("SELECT text FROM benchmark").fetchall()])
    assert sorted(map(tuple, queries.op11_resample(spark, sf).collect()), key=key) == want
    got = queries.op12_repetition(spark, sf).collect()
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.covered_chars) for r in got) == sorted((i, *measured(t)) for i, t in rows)
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) for r in got)
