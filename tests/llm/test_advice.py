"""Gates, bounds and cuts that the review of the first round names."""

import inspect
from datetime import datetime

import numpy as np
import pytest

from atlasweave.llm import pii, toxicity
from atlasweave.operators import aggregates
from atlasweave.plans import queries


@pytest.mark.parametrize("span, text", [
    ("correcthorse", "password: correcthorse"), ("abcdefgh", 'secret: "abcdefgh"'), ("John (AT) example (DOT) com", "John (AT) example (DOT) com"),
    ("john AT example DOT com", "write john AT example DOT com"), ("dead:beef:cafe:babe:dead:beef:cafe:babe", "from dead:beef:cafe:babe:dead:beef:cafe:babe"), ("aB3x" * 60, "token: " + "aB3x" * 60), ("Pw!x" * 60, "password=" + "Pw!x" * 60),
])
def test_pii_candidates_have_no_gate_of_their_own(span, text):
    at = text.index(span)
    assert (at, at + len(span)) in [c[1:] for c in pii.candidates(text)]
    assert set(pii.candidates(text)) <= set(pii.candidates(text + " 7"))


def test_pii_redacts_whole_secrets():
    trees = pii.model()
    for text in ("password: correcthorse", "passwd: " + "q7Zp" * 60):
        assert pii.redacted(text, pii.all_spans([text], trees)[0][1]) == text.split()[0] + " [SECRET]"


def test_toxicity_windows_are_bounded_by_named_parameters():
    bounds = inspect.signature(toxicity.fit_chain).parameters
    assert bounds["hot_windows"].default == toxicity.HOT_WINDOWS and bounds["clean_windows"].default == toxicity.CLEAN_WINDOWS
    docs = [["vile"]] * 3 + [["fine"]] * 3
    tags = [np.array([k < 3]) for k in range(6)]
    assert toxicity.fit_chain(docs, tags, 2).weights.any() and (toxicity.fit_chain(docs, tags, 2, hot_windows=0).weights <= 0).all()


def test_opening_hours_of_large_user_ids(spark, tmp_path):
    """The SQL leaves ids from 100,000 out; the query may not."""
    rows = [(u, datetime(2024, 1, d)) for u in (1, 100_000, 250_000) for d in range(1, 8)]
    spark.createDataFrame(rows, "user_id long, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    assert {r.user_id: r.hours for r in queries.queries()["opening_hours"](spark, str(tmp_path)).collect()} == dict.fromkeys((1, 100_000, 250_000), "Mon-Sun 10:00-19:00")


def test_united_notes_are_whole_up_to_the_cut(spark):
    rows = spark.createDataFrame([(1, ["x"], n * 30) for n in "abc"] + [(2, ["x"], n * 300) for n in "abcd"], "k long, kinds array<string>, notes string")
    notes = {r.k: r.notes for r in aggregates.united(rows, "k", ["kinds"], "notes").collect()}
    assert notes == {1: " | ".join(n * 30 for n in "abc"), 2: " | ".join(n * 300 for n in "abcd")[:800]}
