import hashlib
from collections import defaultdict

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from textgate.llm import grace_dedup


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[grace_dedup.normalised(r[1])].append(r)
    out = []
    for content, members in groups.items():
        best = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        for r in members:
            out.append((r[0], best[0], len(members), hashlib.sha256(content).hexdigest()))
    return sorted(out, key=str)


def test_groups_against_brute_force(odd, odd_rows, none):
    got = grace_dedup.groups(odd).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute(odd_rows)
    kept = defaultdict(int)
    for r in got:
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}
    assert grace_dedup.groups(none).collect() == []


def test_rows_that_stay(odd, none):
    left = grace_dedup.deduplicated(odd)
    assert left.columns == odd.columns and left.schema == odd.schema
    rows = left.collect()
    assert sum(r.doc_id in (1, 2, 3) for r in rows) == 1 and any(r.doc_id == 3 for r in rows)
    assert sum(r.doc_id == 9 for r in rows) == 1
    assert grace_dedup.deduplicated(none).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=6), st.integers(0, 50)), max_size=200))
def test_spilling_changes_nothing(items):
    records = [(xxhash.xxh3_64_intdigest(c), c, (o,), 1, (o,)) for c, o in items]
    plain = sorted(grace_dedup.grace(iter(records), 1 << 30))
    assert sorted(grace_dedup.grace(iter(records), 900)) == plain
    want = {}
    for c, o in items:
        want[c] = (min(o, want[c][0]), want[c][1] + 1) if c in want else (o, 1)
    assert {r[1]: (r[2][0], r[3]) for r in plain} == want


def test_equal_hashes_are_told_apart_by_content():
    records = [(7, bytes([i]) * 400, (0,), 1, (i,)) for i in range(20)] * 2
    got = list(grace_dedup.grace(iter(records), 2000))
    assert sorted(r[4][0] for r in got) == list(range(20)) and all(r[3] == 2 for r in got)


def test_groups_with_spills_stretches_and_a_hot_content(spark, monkeypatch):
    from tests.llm.conftest import SCHEMA, prose, row

    rows = [row(i, prose(i % 7, 30) + " " * (i % 3)) for i in range(300)] + [row(i % 5, "hot") for i in range(300)] + [row(None, "hot ")] * 3
    rows += [row(1000 + i, prose(500 + i, 20)) for i in range(200)]
    monkeypatch.setattr(grace_dedup, "STRETCH_ROWS", 37)
    for table_bytes in (2000, 1 << 20):
        got = grace_dedup.groups(spark.createDataFrame(rows, SCHEMA).repartition(5), table_bytes=table_bytes).collect()
        assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute(rows)
        kept = defaultdict(int)
        for r in got:
            kept[r.text_sha256] += r.kept
            assert not r.kept or r.doc_id == r.keep_id
        assert set(kept.values()) == {1}


def test_table_counts_what_it_holds():
    table = grace_dedup.OpenAddressingTable()
    table.add((1, b"x", (0,), 1, ("short",)))
    small = table.bytes
    table.add((1, b"x", (-1,), 1, ("y" * 10_000,)))
    assert table.bytes > small + 9_000
    members = grace_dedup.OpenAddressingTable()
    for i in range(1000):
        members.add((1, b"x", (i,), grace_dedup.Members(1, [i]), (i,)))
    assert len(members.records) == 1 and members.records[0][3].names == list(range(1000)) and members.bytes > 40_000
