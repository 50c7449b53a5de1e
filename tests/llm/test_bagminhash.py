import itertools

import numpy as np
from textgate.llm import bagminhash as bag
from tests.llm.conftest import SCHEMA, prose, row


def brute(rows, least=0.8):
    """Least id of each row's group, by all pairs."""
    sets = [bag.shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bag.similarity(sets[i], sets[j]) >= least:
                parent[max(top(i), top(j))] = min(top(i), top(j))
    ids = {}
    for i, r in enumerate(rows):
        ids.setdefault(top(i), []).append(r[0])
    return sorted(((r[0], min((x for x in ids[top(i)] if x is not None), default=None), len(ids[top(i)])) for i, r in enumerate(rows)), key=str)


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    off = []
    for _ in range(150):
        a = np.unique(rng.integers(0, 1 << 60, rng.integers(1, 60)).astype(np.uint64))
        b = np.unique(np.concatenate([a[: len(a) // 2 + 1], rng.integers(0, 1 << 60, 5).astype(np.uint64)]))
        x, y = (a, rng.integers(1, 12, len(a))), (b, rng.integers(1, 12, len(b)))
        s = bag.signatures([x, y])
        off.append((s[0] == s[1]).mean() - bag.similarity(x, y))
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.05


def test_odd_rows(odd, odd_rows, none):
    got = bag.groups(odd).collect()
    assert sorted([(r.doc_id, r.class_id, r.group_size) for r in got], key=str) == brute(odd_rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({str((r.class_id, r.group_size)) for r in got} )
    left = bag.deduplicated(odd)
    assert left.columns == odd.columns and left.count() == len(kept)
    assert bag.groups(none).collect() == [] and bag.deduplicated(none).count() == 0


def test_near_copies_in_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(bag, "BUCKET", 6)
    base, passage = prose(50, 150).split(), prose(60, 90)
    rows = []
    for i in range(60):
        w = list(base)
        for k in range(1 + i % 4):
            w[(i * 7 + k * 31) % 150] = f"new{i}x{k}"
        rows.append(row(i, " ".join(w)))
    rows += [row(100 + i, passage + " " + prose(200 + i, 45)) for i in range(40)]
    rows += [row(200 + i, prose(400 + i, 60)) for i in range(40)]
    got = bag.groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted([(r.doc_id, r.class_id, r.group_size) for r in got], key=str) == brute(rows)


def test_components_in_one_task_and_by_stars(spark):
    rng = np.random.default_rng(8)
    ties = [(f"n{a:03d}", f"n{b:03d}") for a, b in rng.integers(0, 150, (110, 2))] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(40)]
    df = spark.createDataFrame(ties, "a string, b string")
    one = {tuple(r) for r in bag.components(df).collect()}
    many = {tuple(r) for r in bag.components(df, 0).collect()}
    loops = {a for a, b in ties if a == b}
    assert many <= one and all(n == r and n in loops for n, r in one - many)


def test_pairs_with_one_band_in_a_large_bucket(spark, monkeypatch):
    """All classes share one band and no other: each near pair is still found, whatever the parts."""
    monkeypatch.setattr(bag, "PART", 17)
    rows = []
    for i in range(60):
        w = prose(700 + i, 120).split()
        rows.append(row(2 * i, " ".join(w)))
        w[i] = "changed"
        rows.append(row(2 * i + 1, " ".join(w)))
    docs = spark.createDataFrame(rows, SCHEMA)
    signed = bag.sign(docs, "doc_id", "text").collect()
    classes = [(r["class"], r.id, r.text_key, [7] + [1000 * n + k for k in range(1, bag.BANDS)], r.slots) for n, r in enumerate(signed)]
    frame = spark.createDataFrame(classes, "class string, id long, text_key long, bands array<long>, slots array<long>")
    named = {r["class"]: r.id for r in signed}
    tied = {tuple(sorted((named[r.a], named[r.b]))) for r in bag.links(docs, frame, "doc_id", "text").collect()}
    assert tied == {(2 * i, 2 * i + 1) for i in range(60)}


def test_rows_of_one_id_and_text_leave_the_least(spark):
    base = [row(1, prose(80), source=s) for s in ("c", "a", "b")] + [row(2, prose(81), source=None), row(2, prose(81), source="z")] + [row(3, prose(82))] * 3
    found = []
    for parts in (1, 3):
        left = bag.deduplicated(spark.createDataFrame(base, SCHEMA).repartition(parts)).collect()
        found.append(sorted((r.doc_id, r.source) for r in left if r.doc_id != 2))
        assert len(left) == 3
    assert found[0] == found[1] == [(1, "a"), (3, "a")]


def test_recall_over_a_whole_table(spark):
    """Every group of the small table, against all pairs that share a shingle."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    sets = [bag.shingles(t) for _, t in rows]
    places = {}
    for i, (h, _) in enumerate(sets):
        for x in h.tolist():
            places.setdefault(x, []).append(i)
    near = {p for at in places.values() if len(at) > 1 for p in itertools.combinations(at, 2)}
    near = [(i, j) for i, j in near if bag.similarity(sets[i], sets[j]) >= 0.8]
    of = {r.doc_id: r.class_id for r in bag.groups(docs).collect()}
    assert len(near) > 90 and all(of[rows[i][0]] == of[rows[j][0]] for i, j in near)
    top = {i: i for i in range(len(rows))}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in near:
        top[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), r[0]), r[0])
    assert of == {r[0]: least[root(i)] for i, r in enumerate(rows)}


def test_hot_keys_are_joined_apart(spark):
    from textgate.llm.common import joined_with_hot

    left = [("hot" if i % 3 == 0 else f"k{i % 4000}", i) for i in range(9000)] + [("none", -1)]
    sizes = {}
    for k, _ in left:
        sizes[k] = sizes.get(k, 0) + 1
    right = [(k, n, f"v{k}") for k, n in sizes.items() if k != "none"]
    one, other = spark.createDataFrame(left, "key string, i long"), spark.createDataFrame(right, "key string, n long, v string")
    got = joined_with_hot(one, other, "key", "n").collect()
    assert sorted((r.key, r.i, r.n, r.v) for r in got) == sorted((k, i, sizes[k], f"v{k}") for k, i in left if k != "none")
    assert joined_with_hot(one.where("i > 1000000"), other, "key", "n").collect() == []
    assert joined_with_hot(one, other.where("n < 0"), "key", "n").collect() == []
