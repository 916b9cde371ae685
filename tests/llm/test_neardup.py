import os
import random
import sys

import corpus_pipeline

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from tallyforge.session import table  # noqa: E402


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def grams(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_dedup_stage_keeps_one_of_each_class_by_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    rng = random.Random(3)
    base = docs.orderBy("doc_id").limit(40).collect()
    rows = []
    for r in base:  # copies with a share of words changed, on both sides of the threshold
        for k in range(4):
            w = r.text.split(" ")
            for _ in range(max(1, len(w) * k // 60)):
                w[rng.randrange(len(w))] = f"changed{rng.randrange(9)}"
            rows.append((*r[:1], " ".join(w), *r[2:]))
    dense = [f"w{i}" for i in range(100)]
    for k in range(60):  # a group whose members differ in one or two words each
        w = list(dense)
        w[rng.randrange(100)] = f"x{k}"
        rows.append((0, " ".join(w), *base[0][2:]))
    rows = [(10_000 + i, *r[1:]) for i, r in enumerate(rows)]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    texts = {r.doc_id: grams(r.text) for r in docs.select("doc_id", "text").collect()}
    ids = sorted(texts)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if jaccard(texts[a], texts[b]) >= 0.8 - 1e-12]
    assert sum(texts[a] != texts[b] for a, b in linked) > 60
    want = set(brute.components(ids, linked).values())
    assert {r.doc_id for r in stage(spark, docs, sf).select("doc_id").collect()} == want


def test_fingerprint_classes_link_what_is_similar(spark):
    """the stage had no SimHash step."""
    from tallyforge.llm import neardup
    from tallyforge.session import scratch

    words = [f"w{i}" for i in range(400)]
    near = [*words[:200], "other", *words[201:]]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[:390][::-1])), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    with scratch(spark):
        sets = neardup.written(neardup._sets(docs, "doc_id", "text", 5, 0.8), "sets")
        node = {r.id: r.node for r in sets.collect()}
        got = [{r.a, r.b} for r in neardup._fingerprint_links(sets, 5, 0.8).collect()]
    assert got == [{node[1], node[2]}]
