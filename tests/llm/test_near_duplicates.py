"""Near-duplicates of the pipeline against brute force, and one row of each group."""

import itertools
import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from atlasweave.llm import jaccard, pii, quality, simhash, toxicity

SCHEMA = "doc_id long, text string"


def grams(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def plain_groups(rows):
    """Components of rows whose sets are equal or have a similarity of 0.8 or more."""
    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    having = {}
    for k, s in enumerate(sets):
        for g in s or {b""}:
            having.setdefault(g, []).append(k)
    for a, b in {p for own in having.values() for p in itertools.combinations(own, 2)}:
        both = len(sets[a] & sets[b])
        if 9 * both >= 4 * (len(sets[a]) + len(sets[b])):
            root[find(a)] = find(b)
    out = {}
    for k in range(len(rows)):
        out.setdefault(find(k), []).append(k)
    return sorted(map(tuple, out.values()))


def found_groups(df, rows):
    out, at = {}, {r: k for k, r in enumerate(rows)}
    marks = {(r.doc_id, r.mark): (r.doc_id, r.text) for r in df.selectExpr("doc_id", "text", "xxhash64(text) as mark").collect()}
    for r in jaccard.groups(df).collect():
        out.setdefault(r.root, []).append(at[marks[r.doc_id, r.mark]])
    return sorted(tuple(sorted(x)) for x in out.values())


def clump(n, seed=7):
    """Near copies of one text, each with its own number of changes: chains, near misses, and links between them."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    out = []
    for k in range(n):
        words = list(base)
        for _ in range(rng.randrange(8)):
            words[rng.randrange(150)] = f"x{rng.randrange(40)}"
        out.append((k, " ".join(words)))
    return list(dict.fromkeys(out))


def test_groups_equal_brute_force(spark):
    other = [(1000, None), (1001, ""), (1002, " \n "), (1003, "one"), (1004, "One"), (1005, "a b c d e"), (1006, "a b c d e f"), (1007, "A b  c d e"), (1008, "a b c d e " * 50)]
    rows = clump(250) + other
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = plain_groups(rows)
    assert 1 < len(want) < len(rows)
    assert found_groups(df, rows) == want
    assert jaccard.deduplicated(df.where("false")).count() == 0


def test_near_copies_leave_the_corpus(spark):
    """Five words of 64 changed at one place: over 0.8 in five-word shingles, beyond two bits of a fingerprint."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted(min(rows[k][0] for k in own) for own in plain_groups(rows))
    kept = corpus_pipeline.near_dedup(spark, docs, "/root/testdata/sf0.01")
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.select("doc_id").collect())
    assert ids == want and {2, 56} - set(ids)


A, B, C, D = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")


@pytest.mark.parametrize("dedup", [simhash.deduplicated, jaccard.deduplicated])
def test_one_row_of_each_group(spark, dedup):
    """Null ids on unrelated texts, one id on several texts, an id smaller in another group, repeated rows."""
    rows = [(None, A), (None, B), (None, B), (5, C), (5, D), (5, D), (3, D), (9, A + " end" if dedup is jaccard.deduplicated else A)]
    kept = sorted(((r.doc_id, r.text) for r in dedup(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()), key=str)
    assert kept == sorted([(9, rows[-1][1]), (None, B), (5, C), (3, D)], key=str)


def test_pipeline_stages_with_near_copies(spark):
    """All stages against plain versions, near copies by brute force."""
    sf = "/root/testdata/sf0.01"
    seen = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in seen.collect()}
    clean = {r.doc_id for r in toxicity.scored(seen, toxicity.fit(seen, spark.read.parquet(f"{sf}/labels.parquet"))).collect() if r.score < 0.5}
    good = clean & {r.doc_id for r in quality.judged(seen).collect() if r.kept}
    left = [(i, text[i]) for i in sorted(good)]
    one = {min(left[k][0] for k in own) for own in plain_groups(left)}
    assert len(one) < len({r.component_id for r in simhash.near_duplicates(seen.where(F.col("doc_id").isin(sorted(good)))).collect()})
    for name, stage in corpus_pipeline.STAGES:
        seen = corpus_pipeline.materialise(stage(spark, seen, sf), name)
        rows = seen.collect()
        assert {r.doc_id for r in rows} == {"toxicity": clean, "quality": good}.get(name, one)
        if name == "pii":
            assert all(r.text == pii.redacted(text[r.doc_id], pii.all_spans([text[r.doc_id]], pii.model())[0][1]) for r in rows)
    columns = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).select(columns).collect())) == sorted(map(tuple, seen.select(columns).collect()))
