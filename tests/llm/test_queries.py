"""What the registered queries return, held against rules written anew here."""

import re
import zlib

import pytest
from tidemark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize(("name", "parts", "held"), [("op3_quality", 3, 1), ("op7_language", 4, 2)])
def test_held_out_rule(spark, docs, name, parts, held):
    got = {r.doc_id: r for r in queries.queries()[name](spark, SF).collect()}
    assert got.keys() == docs.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % parts == held) for i, r in got.items())
    assert any(r.held_out for r in got.values()) and all(0 <= r.score <= 1 for r in got.values())
    if name == "op3_quality":
        assert all(r.predicted == (r.score >= 0.5) for r in got.values())
    else:
        known = {d.lang for d in docs.values() if d.lang is not None} | {"und"}
        assert all(r.lang_pred in known for r in got.values())
        assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in docs[i].text or "")) for i, r in got.items())


def test_targets_and_words_taken(spark, docs):
    """Targets by a search for the common factor of all weights, sizes by Python's expression."""
    got = {r.doc_id: r for r in queries.op9_mixing(spark, SF).collect()}
    assert got.keys() == docs.keys()
    sizes: dict = {}
    for i, d in docs.items():
        assert got[i].size == len(re.findall(r"[^\x20\x09-\x0D]+", d.text or ""))
        sizes[d.source] = sizes.get(d.source, 0) + got[i].size
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(names)}
    low, high = 0.0, 2.0 * sum(sizes.values())
    for _ in range(200):
        factor = (low + high) / 2
        total = sum(min(2 * sizes[s], factor * weight[s]) for s in names)
        low, high = (factor, high) if total < 1.5 * sum(sizes.values()) else (low, factor)
    for s in names:
        rows = [got[i] for i, d in docs.items() if d.source == s]
        want = min(2 * sizes[s], high * weight[s])
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(want, rel=1e-6, abs=1e-6) and 0 <= r.taken <= 2 * r.size for r in rows)
        assert sum(r.taken for r in rows) == pytest.approx(want, abs=1)


def test_each_row_is_answered_once(spark, docs):
    counts = {r.doc_id: r for r in queries.op2_token_counts(spark, SF).collect()}
    coded = {r.doc_id: r for r in queries.op8_bpe(spark, SF).collect()}
    assert counts.keys() == coded.keys() == docs.keys()
    for i, d in docs.items():
        assert counts[i].n_bytes == len((d.text or "").encode()) and counts[i].over_limit == (counts[i].n_tokens > 1024)
        assert counts[i].n_tokens == coded[i].n_tokens
