"""The pipeline's near copies come from fingerprints and covering masks; texts are checked after that."""

import itertools
import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from test_near_duplicates import SCHEMA, clump, plain_groups

from atlasweave.llm import jaccard, simhash


def grouped(groups, rows):
    """Places in rows by root, from rows (doc_id, mark, root); doc_ids are unique."""
    out, at = {}, {i: k for k, (i, _) in enumerate(rows)}
    for r in groups.collect():
        out.setdefault(r.root, []).append(at[r.doc_id])
    return sorted(tuple(sorted(x)) for x in out.values())


def test_masks_cover_eleven_bits():
    masks, rng = simhash.near_masks().tolist(), random.Random(3)
    assert sorted(m.bit_count() for m in masks) == [16] * 124 + [32] * 2
    for _ in range(5_000):
        turned = sum(1 << b for b in rng.sample(range(64), simhash.NEAR))
        assert any(not turned & m for m in masks)


def test_near_links_miss_no_lone_pair(spark):
    """Pairs of 1 to 11 differing bits are found among strangers; the nearest of several is."""
    rng, pairs = random.Random(5), {}
    for k in range(220):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << x for x in rng.sample(range(64), 1 + k % simhash.NEAR))
        pairs[max(a, b)] = min(a, b)
    alone = [rng.getrandbits(64) for _ in range(3_000)]
    whole = np.array([*pairs, *pairs.values(), *alone], np.uint64)
    assert sum(int((np.bitwise_count(whole[k + 1 :] ^ whole[k]) <= simhash.NEAR).sum()) for k in range(len(whole))) == len(pairs)
    prints = spark.createDataFrame([(simhash.signed(int(x)),) for x in whole], "fp long")
    assert {(r.a % 2**64, r.b % 2**64) for r in simhash.near_links(prints).collect()} == set(pairs.items())
    a, b, bits = simhash.nearest_leaders(np.array([0, 0, 0], np.uint8), np.array([0, 0b1000, 0b1010], np.uint64))
    assert (a.tolist(), b.tolist(), bits.tolist()) == ([8, 10], [0, 0], [1, 2])


def test_the_stage_finds_near_copies_by_fingerprints(spark, monkeypatch):
    """What fingerprints propose, once confirmed, is what the stage links at sf0.01; the check adds nothing there."""
    docs, seen = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), []
    real = simhash.met
    monkeypatch.setattr(simhash, "met", lambda prints: seen.append(real(prints)) or seen[-1])
    kept = corpus_pipeline.near_dedup(spark, docs, "/root/testdata/sf0.01").count()
    assert len(seen) == 1
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    place, mark = {}, {r.doc_id: r.mark for r in docs.select("doc_id", F.xxhash64("text").alias("mark")).collect()}
    for k, (i, _) in enumerate(rows):
        place.setdefault(mark[i], k)
    want = plain_groups(rows)
    group = {k: n for n, own in enumerate(want) for k in own}
    root = {m: m for m in place}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in ((r.a, r.b) for r in seen[0].collect()):
        if group[place[a]] == group[place[b]]:
            root[find(a)] = find(b)
    assert kept == len(want) == len({find(m) for m in root})


def test_candidates_never_change_the_groups(spark):
    """False candidates are not linked, and links beyond the fingerprints' reach are found."""
    rows = [*clump(120), (1000, None), (1001, ""), (1002, "one"), (1003, "One"), (1004, "a b c d e f"), (1005, "A b c d e f")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = plain_groups(rows)
    marks = [r.mark for r in df.select(F.xxhash64("text").alias("mark")).distinct().collect()]
    every = spark.createDataFrame(list(itertools.combinations(marks, 2)), "a long, b long")
    found = simhash.met(simhash.fingerprints(df, marked=True))
    for met in (every, every.where("false"), found):
        assert grouped(jaccard.groups(df, met=met), rows) == want
    empty = df.where("false")
    assert jaccard.groups(empty, met=simhash.met(simhash.fingerprints(empty, marked=True))).count() == 0
