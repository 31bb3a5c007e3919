from __future__ import annotations

import os
import sys
import zlib

import brute
import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from conftest import SF_SMALL  # noqa: E402
from oracle import compare, duck  # noqa: E402

from terrapanel.llm import packing, pairwise_quality  # noqa: E402
from terrapanel.llm.queries import ORACLES, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], ORACLES[name], SF_SMALL)
    assert r["hash_match"] and r["spark_rows"] == r["duck_rows"], r


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_quality_query(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op10_pairwise_quality"](spark, SF_SMALL).collect()}
    assert len(got) == docs.count()
    for i, r in got.items():
        assert r.held_out == brute.held_out(i) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [i for i in labels if brute.held_out(i)]
    assert np.mean([got[i].predicted == labels[i] for i in held]) >= 0.85


def test_packing_query(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op2_best_two_fit"](spark, SF_SMALL).collect()
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    ids = {i: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for i, t in rows.items()}
    for r in got:
        assert zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes()) == r.ids_crc32
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
    assert len({r.sequence_id for r in got}) <= -(-sum(map(len, ids.values())) // 4096) + 1


def test_mix_query(spark):
    got = QUERIES["op9_pivotal_mix"](spark, SF_SMALL).collect()
    texts = {r.doc_id: (r.source, len((r.text or "").translate(str.maketrans("\x1c\x1d\x1e\x1f\x85\xa0", "......")).split()))
             for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    sizes, taken = {}, {}
    for s, n in texts.values():
        sizes[s] = sizes.get(s, 0) + n
    want = brute.targets(sizes)
    for r in got:
        assert r["size"] == texts[r.doc_id][1] and r.target == pytest.approx(want[r.source]) and r.taken <= 2 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= max(n for o, n in texts.values() if o == s) for s in sizes)


def test_stages_against_brute_force(spark):
    """Each stage, on what its predecessor kept, does what the plain versions do."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = corpus_pipeline.materialize(stage(spark, docs, SF_SMALL), "test_stage")
        kept[name] = docs.collect()
        if name != "best-fit packing":
            assert docs.columns == columns
        if name == "quality classifier":
            model = pairwise_quality.train(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
            good = {r.doc_id for r in before if model.scores(pairwise_quality.features((r.text or "").encode())[None, :])[0] >= 0.3}
            assert {r.doc_id for r in kept[name]} == good and len(good) < len(before)
        elif name == "line dedup":
            want = {d: t for d, _, _, t in brute.line_dedup([(r.doc_id, r.text) for r in before])}
            assert {r.doc_id: r.text for r in kept[name]} == want and all(r.n_chars == len(r.text) for r in kept[name])
        elif name == "MinHash near-dedup":
            want = {d for d, (_, c) in brute.near_duplicates([(r.doc_id, r.text) for r in before]).items() if d == c}
            assert {r.doc_id for r in kept[name]} == want
        elif name == "mixing sources":
            sizes = {}
            for r in before:
                sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
            want, taken, copies = brute.targets(sizes), {}, {}
            for r in kept[name]:
                taken[r.source] = taken.get(r.source, 0) + len((r.text or "").split())
                copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
            longest = max(len((r.text or "").split()) for r in before)
            assert all(abs(taken.get(s, 0) - want[s]) <= longest for s in sizes) and max(copies.values()) <= 2
        else:
            assert sorted(r.doc_id for r in kept[name] if r.piece == 0) == sorted(r.doc_id for r in before)
            fill = {}
            for r in kept[name]:
                fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
            assert max(fill.values()) <= 4096 and len(fill) <= -(-sum(fill.values()) // 4096) + 1


def test_stages_on_odd_tables(spark):
    """Nulls, empty and repeated rows and clashing column names pass through every stage; so does an empty table."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row string, drop int"
    rows = [(1, "a clean sentence of words. " * 5, "en", "s", 1, True, "x", 0), (1, "a clean sentence of words. " * 5, "en", "s", 1, True, "x", 0),
            (None, None, None, None, None, None, None, None), (2, "", None, None, 0, False, "y", 1), (None, "text without an id, of some words.", "en", None, 3, True, "z", 2)]
    for table in (rows, []):
        docs = spark.createDataFrame(table, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.materialize(stage(spark, docs, SF_SMALL), "test_odd")
            if name != "best-fit packing":
                assert docs.columns == [f.split()[0] for f in schema.split(", ")]
        assert (docs.count() == 0) == (not table)
