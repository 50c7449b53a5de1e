"""Every query with a DuckDB statement gives the statement's rows on the smallest tables."""

import os

import duckdb
import pytest
from textgate import plans

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{FOLDER}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_statement(spark, duck, name):
    found = plans.QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
    want = duck.execute(plans.ORACLES[name])
    names = [d[0] for d in want.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())


#: Queries without a statement: what they have a row for. Their values are in test_values.py and test_near.py.
ROWS = {
    "documents": (
        "f01_clean_text_nfkc f02_normalized_exact f04_mask_contacts f05_contextual_masks f07_family_skeleton f08_simhash a37_lexical_features j11_near_clusters m08_heuristic_scores m09_scan r01_signal_flags "
        "r05_protective_labels r06_label_policies r07_override r08_targets r09_output_contract j07_policy_join x01_scorer_backend x04_blend_methods"
    ).split(),
    "conversations": "d02_speaker_neutral d04_evidence_turns d05_excerpts d06_evidence_recent d07_action_preserving d08_x03_policies g06_visibility p09_speaker_flags".split(),
}


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_without_statement_has_its_rows(spark, duck, name):
    found = plans.QUERIES[name](spark, FOLDER).collect()
    if name in ROWS["documents"]:
        assert sorted(r.id for r in found) == sorted(str(r[0]) for r in duck.sql("SELECT doc_id FROM documents").fetchall())
    elif name in ROWS["conversations"]:
        assert sorted(r.conv_id for r in found) == sorted(r[0] for r in duck.sql("SELECT DISTINCT conv_id FROM conversations").fetchall())
    elif name != "s07_regional_rows":  # texts without ids, some of which are copies
        assert len({str(r) for r in found}) == len(found)
