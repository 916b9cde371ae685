import os
import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from tallyforge.llm import ann, decontam, folds, langid, linedup, mixing, quality, queries, simhash, suffix, token_store, tokens  # noqa: E402
from tallyforge.session import table  # noqa: E402

BYTE, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = [(9001, None), (9002, ""), (9003, "   \n\t "), (9004, "ab " * 3000), (9005, "x" * 5000), (9006, "Été <|endoftext|> don't  we'll ́a"), (9006, "again"), (None, "nameless words here"), (9008, "ab " * 3000)]
SCHEMA = "doc_id long, text string, lang string, source string, id string, fp int"


@pytest.fixture(scope="module")
def texts(spark, sf):
    some = [(r.doc_id, r.text) for r in table(spark, sf, "documents").orderBy("doc_id").limit(120).collect()]
    return some + ODD


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None if k % 7 == 0 else ("en", "fr")[k % 2], None if k % 11 == 0 else f"s{k % 3}", "clash", 1) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_simhash_matches_brute_force(docs, texts, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(texts)
    want = sorted(brute.simhash(t) for _, t in texts)
    assert sorted(int(r.fingerprint, 16) for r in got) == want
    nodes = sorted(set(want))
    comp = brute.components(nodes, [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if (a ^ b).bit_count() <= 3])
    least = {}
    for i, t in texts:
        c = comp[brute.simhash(t)]
        least[c] = min(x for x in (least.get(c), i) if x is not None) if i is not None or c in least else None
    assert all(r.component_id == least[comp[int(r.fingerprint, 16)]] for r in got)
    assert simhash.near_duplicates(empty).count() == 0


def test_trie_join_finds_dense_and_sparse_links(spark):
    rng = np.random.default_rng(5)
    near = [int(0xF0F0F0F012345678) ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (150, 2))]
    fps = sorted({*map(int, rng.integers(0, 1 << 63, 300)), *near, 0, 7, (1 << 64) - 1})
    rows = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    got = {r.fp & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in simhash.fingerprint_components(spark.createDataFrame(rows, "fp long")).collect()}
    comp = brute.components(fps, [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 3])
    groups = {}
    for f, c in comp.items():
        groups.setdefault(c, set()).add(f)
    mine = {}
    for f, c in got.items():
        mine.setdefault(c, set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_keep_one_keeps_columns_and_unnamed_rows(docs, empty):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 1
    assert kept.where("doc_id = 9008").count() == 0 and kept.where("doc_id = 9006").count() <= 1
    assert simhash.keep_one(empty).count() == 0


@pytest.mark.parametrize("chunk, overlap", [(1 << 16, 512), (700, 16), (300, 8)])
def test_token_counts_equal_the_library(docs, texts, chunk, overlap):
    t = tokens.load(BYTE)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(docs, BYTE, chunk=chunk, overlap=overlap).collect())
    n = lambda s: len(t.encode(s or "", add_special_tokens=False))
    assert got == sorted((str(i), len((s or "").encode()), n(s), n(s) > 1024) for i, s in texts)


def test_chunks_resynchronise_after_hard_seams(texts):
    t = tokens.load(BYTE)
    text = "\n".join(x or "" for _, x in texts)[:40_000] + " don't <|endoftext|>\n\n  we'll 's" * 200
    for chunk, overlap in ((900, 8), (257, 4), (5000, 100), (tokens.CHUNK, tokens.OVERLAP)):
        seen = []
        assert tokens.count_long(t, text, chunk, overlap, seen) == len(t.encode(text, add_special_tokens=False))
        assert len(seen) >= len(text) // (4 * chunk) and (overlap > 8 or max(seen) > overlap)
    assert tokens.count_long(t, "x" * 30_000, 512, 16) == len(t.encode("x" * 30_000, add_special_tokens=False))


def test_token_store_round_trip(spark, docs, texts, empty):
    t = tokens.load(WORD)
    got = sorted(token_store.token_store(docs, WORD, per_file=20, sequence=64).collect(), key=lambda r: r.start)
    at = 0
    ordered = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert len(got) == len(ordered)
    for r, (i, s) in zip(got, ordered):
        ids = np.array([*t.encode(s or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_store.token_store(empty, WORD).count() == 0


def test_stream_file_has_equal_sequences_without_copies(tmp_path):
    import pyarrow as pa

    ids = np.arange(1000, dtype="<u2")
    path = str(tmp_path / "x.arrows")
    with pa.OSFile(path, "wb") as sink:
        w = token_store.StreamFileWriter(sink, np.dtype("<u2"), 64, 3)
        for k in range(0, 1000, 37):
            w.add(ids[k : k + 37].tobytes())
        w.close()
    f = token_store.StreamFile(pa.memory_map(path))
    assert f.n_sequences == 16 and f[3][0].tolist() == list(range(192, 256)) and not f[3][0].flags.owndata
    assert f[15][1].sum() == 1000 - 15 * 64 and f.ids(100, 500).tolist() == list(range(100, 600))


@pytest.mark.parametrize("length", [200, 25, 3])
def test_repeats_match_brute_force(docs, texts, length):
    got = [tuple(r) for r in suffix.repeats_report(docs, length=length).collect()]
    want = brute.repeats(list(enumerate(t for _, t in texts)), length)
    assert sorted((str(g[0]), *g[1:]) for g in got) == sorted((str(texts[k][0]), *w) for k, w in want.items())


def test_repeats_edge_cases(docs, empty):
    assert suffix.repeats_report(empty).count() == 0
    cut = suffix.remove_repeats(docs)
    assert cut.columns == docs.columns and cut.where("doc_id = 9001 and text is null").count() == 1
    assert cut.where("doc_id in (9004, 9008)").agg(F.max(F.length("text"))).first()[0] == 0
    for q in (2, 3, 5, 7, 11, 13):
        v, d = suffix.difference_cover(q)
        assert {(x - y) % v for x in d for y in d} == set(range(v))


@pytest.mark.parametrize("direct", [1024, 8])
def test_line_links_connect_what_brute_force_connects(spark, monkeypatch, direct):
    monkeypatch.setattr(linedup, "LIST", direct)
    rng = random.Random(3)
    lines = set()
    for size, members, noise in ((20, 6, "xy"), (1, 250, ["", "xq", "yz", "w"])):
        for _ in range(size):
            base = "the quick brown fox jumps over the lazy dog" if size == 1 else "".join(rng.choice("abc dé") for _ in range(rng.randint(9, 40)))
            for _ in range(members):
                s = list(base)
                for _ in range(rng.randint(0, 3)):
                    k = rng.randrange(len(s))
                    s[k : k + rng.randint(0, 1)] = rng.choice(noise)
                lines.add("".join(s).strip())
    lines = sorted(x for x in lines if x)
    df = spark.createDataFrame(list(enumerate(lines)), "line long, norm string")
    got = linedup.line_links(df).collect()
    budget = lambda a, b: min(2, min(len(a), len(b)) // 10)
    assert all(brute.edits(lines[r.a], lines[r.b], 2) == r.distance <= budget(lines[r.a], lines[r.b]) for r in got)
    near = [(i, j) for i, a in enumerate(lines) for j in range(i + 1, len(lines)) if min(len(a), len(lines[j])) >= 10 and brute.edits(a, lines[j], 2) <= budget(a, lines[j])]
    assert near and brute.components(range(len(lines)), [(r.a, r.b) for r in got]) == brute.components(range(len(lines)), near)


def test_banded_distance_is_the_edit_distance(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(400):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(2, 90)))
        s = list(a)
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(s) + 1)
            s[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "x"])
        if abs(len(s) - len(a)) <= 2:
            rows.append((a, "".join(s)))
    got = spark.createDataFrame(rows, "x string, y string").selectExpr("x", "y", f"{linedup.banded_distance('x', 'y', 2)} AS d").collect()
    for r in got:
        d = brute.edits(r.x, r.y, 90)
        assert r.d == d if d <= 2 else r.d > 2


def test_line_report_counts_and_drops(spark, empty):
    long = "this is a line of some length"
    rows = [(1, f"{long}\nshort\n{long}\n\n"), (2, f"{long}\n \t{long.upper()}S\nshort"), (3, None), (None, "short\nonly here, a different line"), (4, ""), (5, "a short line one\nb"), (6, "a short line onf\n" + "word " * 20_000)]
    df = spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], "id long, text string, norm string, line string, first_id int")
    got = {r.id: tuple(r[1:]) for r in linedup.line_report(df, "id").collect()}
    assert got == {1: (3, 1, 0, 1), 2: (3, 2, 1, 1), 3: (0, 0, 0, 0), None: (2, 1, 0, 0), 4: (0, 0, 0, 0), 5: (2, 0, 0, 1), 6: (2, 0, 1, 1)}
    kept = {r.id: r.text for r in linedup.drop_duplicate_lines(df, "id").collect()}
    assert kept[1] == f"{long}\nshort\n\n" and kept[2] == kept[4] == "" and kept[3] is None and kept[None] == "only here, a different line"
    assert linedup.line_report(empty).count() == 0


def test_containment_is_exact(spark, docs, texts, empty):
    items = [(1, " ".join(texts[3][1].split()[:40])), (2, "nameless WORDS, here"), (3, None), (4, ""), (5, " ".join(texts[5][1].split()[2:30]) + " and further words"), (1, "again")]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def grams(words, n):
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}

    want = []
    for i, t in texts:
        for item, s in items:
            w = decontam.words_of(s)
            if w and decontam.words_of(t):
                g = grams(w, min(5, len(w)))
                shared = len(g & grams(decontam.words_of(t), min(5, len(w))))
                if shared >= 0.8 * len(g) - 1e-9:
                    want.append((str(i), item, len(g), shared))
    for chars in (decontam.BLOCK_CHARS, 200):
        got = [(str(r.doc_id), *r[1:4]) for r in decontam.contained_items(docs, bench, block_chars=chars).collect()]
        assert sorted(got) == sorted(want) and len(want) > 3
    assert decontam.drop_contaminated(docs, bench).count() == len(texts) - len({w[0] for w in want if w[0] != "9006"}) - sum(1 for w in want if w[0] == "9006")
    named = bench.selectExpr("concat('item ', item_id) AS item_id", "text")
    assert sorted((str(r.doc_id), r.item_id) for r in decontam.contained_items(docs, named).collect()) == sorted((w[0], f"item {w[1]}") for w in want)
    assert decontam.contained_items(docs, bench.limit(0)).count() == 0 and decontam.contained_items(empty, bench).count() == 0


def test_held_out_split_is_crc32(docs):
    for r in docs.select("doc_id", folds.held_out().alias("h")).collect():
        assert r.h == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_language_accuracy_and_odd_texts(spark, docs, empty):
    real = table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.fit(real)
    assert model.code.shape == (4, 7)
    pred = langid.predict(real, model).join(real.select("doc_id", "lang"), "doc_id").where("held_out")
    assert pred.where("lang = lang_pred").count() >= 0.98 * pred.count()
    odd = {r.doc_id: r for r in langid.predict(docs, model).where("doc_id > 9000").collect()}
    assert odd[9001].lang_pred == odd[9002].lang_pred == "und" and odd[9001].score == 0 and odd[9001].ambiguous
    assert langid.keep_known(docs, model).columns == docs.columns
    signs = spark.createDataFrame([(1, "½ ² ① 12"), (2, "12 ² a"), (3, "½" * 200_000 + "é")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in langid.predict(signs, model).orderBy("doc_id").collect()] == [True, False, False]
    assert langid.predict(docs, langid.fit(empty)).where("lang_pred <> 'und'").count() == 0
    assert (langid.codewords(40).shape, langid.codewords(1).shape) == ((40, 63), (1, 1))


def test_quality_separates_held_out_labels(spark, docs, empty):
    real, labels = (table(spark, "/root/testdata/sf0.01", x) for x in ("documents", "labels"))
    model = quality.fit(real, labels)
    got = quality.score(real, model).join(labels, "doc_id").where("held_out").select("score", "quality").collect()
    good, bad = ([r.score for r in got if r.quality == q] for q in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.9
    odd = quality.score(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in odd)
    none = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {round(r.score, 6) for r in quality.score(docs, none).collect()} == {0.5}


def test_nearest_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 16))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000 + i, [1.0] * 16) for i in range(40)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] + [1.0] * 15), (2003, [None] + [1.0] * 15), (2004, [1.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int" if False else "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ids = np.array([i for i, v in rows[:740]])
    e = np.array([v for i, v in rows[:740]])
    assert sorted(got) == sorted(i for i in ids.tolist() if i % 50 == 0)
    hits = 0
    for i, found in got.items():
        d = np.sqrt(((e - e[ids == i]) ** 2).sum(1))
        d[ids == i] = np.inf
        best = np.lexsort((ids, d))[:10]
        assert [a for a, _, _ in sorted(found)] == list(range(1, 11))
        hits += len({b for _, b, _ in found} & set(ids[best].tolist()))
        assert all(abs(s - d[ids == b][0]) < 1e-9 for _, b, s in found)
    assert hits >= 0.9 * 10 * len(got)
    assert sorted(b for _, b, _ in got[1000]) == list(range(1001, 1011))
    few = df.where("vec_id in (0, 1, 2000)")
    assert [tuple(r[:3]) for r in ann.nearest(few, few).orderBy("query_id").collect()] == [(0, 1, 1), (1, 1, 0)]
    assert ann.nearest(df.where("vec_id = 2000"), df).count() == 0


def test_mix_meets_targets(spark, empty):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * 3 for _ in range(rng.randint(0, 60))), "abc"[min(2, int(rng.random() * 4))] if i % 9 else None) for i in range(3000)] + [(3001, None, "a"), (None, "one two", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed_words(df).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    name = {i: s for i, _, s in rows}
    per = {}
    for r in got:
        p = per.setdefault(name[r.doc_id], [0, 0, r.target, r.source_size])
        p[0] += r.size
        p[1] += r.taken
    assert all(p[0] == p[3] and abs(p[1] - p[2]) <= 60 for p in per.values())
    assert abs(sum(p[2] for p in per.values()) - 1.5 * sum(p[0] for p in per.values())) < 1e-6
    assert got == mixing.mixed_words(df).collect() or sorted(map(str, got)) == sorted(map(str, mixing.mixed_words(df).collect()))
    mixed = mixing.mix(df)
    assert mixed.groupBy("shard").count().count() == mixing.SHARDS
    assert mixing.mixed_words(empty).count() == 0 and mixing.mix(empty).count() == 0
    clash = df.selectExpr("*", "1 AS passes", "2 AS whole", "3 AS cut", "4 AS cut_key", "'x' AS shard", "5 AS shards")
    again = mixing.mix(clash)
    assert again.columns == [*(c for c in clash.columns if c != "shard"), "shard", "shard_key"]
    assert {(r.doc_id, r.n) for r in again.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {(r.doc_id, r.n) for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert {(r.doc_id, r.n) for r in mixed.where("length(text) > 0").groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {(r.doc_id, r.taken // r.size) for r in got if r.taken}


def test_taken_words_come_from_the_dealt_shards(spark, monkeypatch):
    """A tree that loses a quota shows in the digest."""
    df = spark.createDataFrame([(i, "two words", "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    whole = mixing.mixed_words(df).agg(F.sum("taken")).first()[0]
    deal = mixing.splitting_tree
    monkeypatch.setattr(mixing, "splitting_tree", lambda *a: deal(*a).withColumn("quota", F.expr("if(shard = 0, 0L, quota)")))
    assert mixing.mixed_words(df).agg(F.sum("taken")).first()[0] < whole


def test_splitting_tree_is_exact(spark):
    quotas = [1000, 0, 37, 5, 4096]
    got = mixing.splitting_tree(spark.createDataFrame(list(enumerate(quotas, 1)), "rank long, quota long"), 16, seed=3).collect()
    for rank, q in enumerate(quotas, 1):
        assert sum(r.quota for r in got if r.rank == rank) == q
    per = {}
    for r in got:
        assert r.quota >= 0
        per[r.shard] = per.get(r.shard, 0) + r.quota
    assert len(per) == 16 and max(per.values()) - min(per.values()) <= 1
    share = [r.quota for r in got if r.rank == 1]
    assert 30 < min(share) and max(share) < 100


def test_queries_are_registered_and_oracles_agree(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    assert {q.split("_")[0] for q in queries.queries()} == {f"op{i}" for i in range(1, 11)}
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, sf)
        ran = con.execute(sql)
        cols = [c[0] for c in ran.description]
        assert sorted(map(str, map(tuple, got.select(*cols).collect()))) == sorted(map(str, ran.fetchall())), name
