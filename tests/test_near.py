"""Near families and near overlaps against brute force over whole tables."""

import random

from pyspark.sql import functions as F
from textgate import plans
from textgate.functions.simhash import signature
from textgate.functions.text import short_hash
from textgate.operators import near

BASE = "dear customer your parcel is waiting please confirm the delivery address on our site today thank you very much indeed"
SCHEMA = "id string, text string, label string, split string"


def messages(n=60, seed=3):
    """Groups of near copies over several splits and labels, exact copies, empty texts and lone texts."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = BASE.split()
        random.Random(i % 9).shuffle(words)
        if i % 4 == 1:
            words.append(r.choice(("now", "ok")))
        text = "" if i % 17 == 16 else " ".join(words)
        rows.append((f"{r.randrange(10**6):06d}", text, None if i == 5 else "SCAM" if i % 9 == 4 and i > 30 else "SAFE", r.choice(("train", "dev", "validation", "test"))))
    return rows


def signed(df):
    found = df.select("id", near.family_skeleton(F.col("text")).alias("s")).select("id", "s", short_hash(F.col("s")).alias("h")).collect()
    return {r.id: (signature(r.s), r.h) for r in found}


def near_rows(sig, i, j):
    return (sig[i][0] ^ sig[j][0]).bit_count() <= 6


def test_one_per_near_family_by_brute_force(spark):
    rows = messages()
    df = spark.createDataFrame(rows, SCHEMA)
    sig, by_id = signed(df), {r[0]: r for r in rows}
    assert len(by_id) == len(rows)
    left, want = set(by_id), {}
    sizes = []
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            i = todo.pop()
            group.add(i)
            more = {j for j in left if near_rows(sig, i, j)}
            left -= more
            todo += more
        sizes.append(len(group))
        if len({by_id[i][2] for i in group}) == 1:
            first = min(group, key=lambda i: ({"test": 0, "validation": 1, "dev": 1, "train": 2}[by_id[i][3]], i))
            want[first] = ("near-" + min(sig[i][1] for i in group), by_id[first][3], len(group))
    assert max(sizes) > 4 and 2 < len(want) < len(sizes)
    got = near.one_per_near_family(df).collect()
    assert {r.id: (r.family_id, r.split, r.n) for r in got} == want and len(got) == len(want)


def folder(spark, tmp_path, texts, benchmark):
    path = str(tmp_path)
    spark.createDataFrame([(i, x, "en", "a", len(x)) for i, x in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in texts], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_query_keeps_one_of_each_family(spark, tmp_path):
    path = folder(spark, tmp_path, [(i, BASE) for i in range(30)] + [(99, "an entirely different sentence about the weather in the hills")], [(0, "x")])
    got = plans.QUERIES["a04_near_families"](spark, path).collect()
    assert sorted(r.n for r in got) == [1, 30]


def test_overlap_per_file_by_brute_force(spark, tmp_path):
    near_base = BASE.replace("today", "now")
    late = "quite another opening line of more than forty characters before it " + BASE
    head = BASE[:45] + " and then a long text about mountains, rivers, old bridges, sheep and the weather in the north of the country"
    texts = list(enumerate([BASE, BASE.upper() + "!", BASE, near_base, late, head, "lone text of its own about nothing at all"]))
    benchmark = [(0, BASE), (3, "some words that nobody repeats in this place"), (1, near_base), (2, "no message is like this one, not even nearly"), (5, late)]
    path = folder(spark, tmp_path, texts, benchmark)
    sig = signed(spark.createDataFrame([(f"m{i}", x) for i, x in texts] + [(f"b{i}", x) for i, x in benchmark], "id string, text string"))
    normal = lambda x: "".join(c for c in x.lower() if c.isalnum() or c == " ")
    want = {
        f"file{f}": (
            sum(any(normal(x) == normal(y) for j, y in benchmark if j % 3 == f) for _, x in texts),
            sum(any(near_rows(sig, f"m{i}", f"b{j}") for j, _ in benchmark if j % 3 == f) for i, _ in texts),
        )
        for f in range(3)
    }
    assert want["file0"][0] == 3 and want["file2"][0] == 1
    assert {r.file: (r.exact, r.near) for r in plans.QUERIES["j15_overlap_counts"](spark, path).collect()} == want


def test_messages_near_benchmark_and_across_splits(spark, tmp_path):
    r = random.Random(8)
    texts = [(i, x[1] if i % 3 else " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(20))) for i, x in enumerate(messages(40))]
    path = folder(spark, tmp_path, texts, [(i, texts[i][1] + " now") for i in (1, 3, 5, 7)])
    sig = signed(spark.createDataFrame([(str(i), x) for i, x in texts] + [(f"b{i}", texts[i][1] + " now") for i in (1, 3, 5, 7)], "id string, text string"))
    ids = [str(i) for i, _ in texts]
    want = {i for i in ids if any(near_rows(sig, i, f"b{j}") for j in (1, 3, 5, 7))}
    assert 0 < len(want) < len(ids)
    assert sorted(x.id for x in plans.QUERIES["j10_message_overlap"](spark, path).collect()) == sorted(want)
    split = {x.id: x.s for x in spark.createDataFrame([(i,) for i in ids], "id string").select("id", near.split_for_family(F.col("id")).alias("s")).collect()}
    pairs = sorted((a, split[a], b, split[b]) for a in ids for b in ids if a < b and split[a] != split[b] and near_rows(sig, a, b))
    assert pairs
    assert sorted(map(tuple, plans.QUERIES["j14_message_leaks"](spark, path).collect())) == pairs


def test_component_subset_sees_every_source(spark, tmp_path):
    from textgate.operators.sequential import nearest_subset

    path = str(tmp_path)
    sizes = {f"src{i}": 1 + i % 4 for i in range(40)}
    rows = [(1000 * i + k, "x", "en", s, 1) for i, (s, n) in enumerate(sizes.items()) for k in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    got = {r.source: r.n for r in plans.QUERIES["t06_component_subset"](spark, path).collect()}
    assert got == {s: sizes[s] for s in nearest_subset(sizes, 0.2, "partition")}
    assert abs(sum(got.values()) - 0.2 * sum(sizes.values())) <= 4


def broadcasts(df):
    """What the plan would send whole, although every table here is small enough for Spark."""
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_block_joins_are_never_sent_whole(spark):
    sigs = spark.range(200).select(F.col("id").alias("k"), F.xxhash64("id").alias("sig"))
    assert broadcasts(sigs.join(sigs, "k")) == 1
    assert broadcasts(near.hamming_pairs(sigs, key="k")) == 0
    assert broadcasts(near.hamming_pairs(sigs, sigs.where("k % 8 = 1"), key="k")) == 0


def test_pairs_come_once_by_their_first_key(spark):
    from textgate.functions import simhash

    r = random.Random(4)
    rows = [(r.getrandbits(63) & r.getrandbits(63) & r.getrandbits(63) & r.getrandbits(63),) for _ in range(150)] + [(0,)]
    for blocks in (7, 9, 10):
        keys = spark.createDataFrame(rows, "d long").select("d", F.posexplode(simhash.block_keys(F.lit(0).cast("long"), 6, blocks)).alias("place", "zero"), simhash.block_keys(F.col("d"), 6, blocks).alias("own"))
        shared = keys.where(F.get("own", F.col("place")) == F.col("zero"))
        both = shared.select((simhash.first_key(F.col("d"), 6, blocks) == F.col("place")).alias("x"), simhash.is_first_key(F.col("d"), F.col("place"), 6, blocks).alias("y")).collect()
        assert {(True, True), (False, False)} == {tuple(b) for b in both}


def test_ties_and_components_are_never_sent_whole(spark, monkeypatch):
    sent, write = [], near.written
    monkeypatch.setattr(near, "written", lambda df, name: (sent.append(broadcasts(df)), write(df, name))[1])
    sigs = write(spark.range(60).select(F.col("id").alias("k"), F.expr("shiftleft(id div 4, 20) + id % 4").alias("sig")), "sigs")
    for most in (near.EDGES_IN_ONE_TASK, 0):
        found = near.components(sigs, near.ties(sigs, "k"), "k", most)
        assert broadcasts(found) == 0 and len(sent) > 4 and not any(sent)
        assert {r.root for r in found.collect()} == {0}


def test_heads_of_any_shape_are_found(spark, tmp_path):
    """Heads without two whole words: line ends, several blanks, blanks in front, long words, short and empty texts."""
    heads = [
        (0, "one\ntwo three four five"), (1, "six  seven eight"), (2, "  leading blanks here too"), (3, "x" * 60), (4, "日本語の文章には空白がない"), (5, "two words"),
        (6, "ab"), (7, ""), (8, "tab\tbed words in a row"), (9, None), (10, "😀😀 wide"), (11, "plain words that go on for more than forty characters"), (12, " "),
    ]
    texts = [f"before {h} after" for _, h in heads if h] + [f"glued{h[:40]}on" for _, h in heads if h] + [h for _, h in heads] + ["nothing", "tw", "one two three four five"]
    for k, chosen in enumerate([heads, [h for h in heads if h[0] in (0, 11)], [h for h in heads if h[0] in (1, 4)], heads[9:10]]):
        path = folder(spark, tmp_path / str(k), list(enumerate(["" if x is None else x for x in texts])), spark.createDataFrame(chosen, "item_id long, text string").collect() if len(chosen) > 1 else [(9, "no such text")])
        want = {}
        for i, h in chosen:
            if h is not None:
                want.setdefault(f"file{i % 3}", set()).update(j for j, x in enumerate(texts) if h[:40] in (x or ""))
        got = plans.QUERIES["j15_overlap_per_file"](spark, path).collect()
        assert {r.file: r.n for r in got} == {f: len(x) for f, x in want.items() if x}


def test_planted_queries_send_no_table_whole(spark):
    for name in ("j10_near_overlap", "j10_hamming_pairs", "j14_split_leaks"):
        assert broadcasts(plans.QUERIES[name](spark, "/root/testdata/sf0.001")) == 0, name


def test_leaks_send_no_table_whole(spark, tmp_path):
    path = folder(spark, tmp_path, [(i, x[1]) for i, x in enumerate(messages(20))], [(0, "x")])
    assert broadcasts(plans.QUERIES["j14_message_leaks"](spark, path)) == 0


def test_near_leaks_are_counted_without_pairs(spark, tmp_path):
    texts = [(i, x[1]) for i, x in enumerate(messages(60))] + [(100 + i, BASE) for i in range(40)] + [(200, "a lone text about bridges and the weather in the north")]
    path = folder(spark, tmp_path, texts, [(0, "x")])
    ids = spark.createDataFrame([(str(i), x) for i, x in texts], "id string, text string")
    sig, split = signed(ids), {x.id: x.s for x in ids.select("id", near.split_for_family(F.col("id")).alias("s")).collect()}
    links = {i: sum(split[i] != split[j] and near_rows(sig, i, j) for j in sig) for i in sig}
    want = sorted(("near leak", split[i], i, f"{sig[i][1]}: {n} near rows of other splits") for i, n in links.items() if n)
    found = plans.QUERIES["g01_near_leaks"](spark, path)
    assert sorted(map(tuple, found.collect())) == want and len({w[3] for w in want}) > 4
    assert broadcasts(found) == 0


def test_links_are_those_of_all_pairs(spark):
    rows = messages(50)
    rows += rows[:9] + [("000001", BASE, "SAFE", "train"), ("000001", BASE, "SAFE", "test"), ("000001", "another text of the same id", "SAFE", "dev"), ("000002", BASE, "SAFE", "none"), ("000003", None, "SAFE", "dev")]
    df = spark.createDataFrame(rows, SCHEMA)
    splits = ("train", "dev", "validation", "test")
    want = {}
    for p in near.split_leaks(df.where(F.col("split").isin(*splits)).distinct()).collect():
        for own, other in (((p.id_a, p.split_a), (p.id_b, p.split_b)), ((p.id_b, p.split_b), (p.id_a, p.split_a))):
            want.setdefault(own, set()).add(other)
    got = near.split_links(df, splits).collect()
    assert {(r.id, r.split): r.links for r in got} == {k: len(v) for k, v in want.items()} and len(got) == len(want)


def test_pairs_of_equal_signatures_are_all_there(spark):
    """Four rows of one signature and three of one near it, keys of either order, and a key that comes twice."""
    rows = [(k, 5) for k in (9, 2, 40, 7)] + [(k, 4) for k in (8, 1, 30)] + [(100, 1 << 40), (100, (1 << 40) + 1), (50, (1 << 40) - 1), (60, None)]
    want = sorted((a, b) for a, x in rows for b, y in rows if a < b and x is not None and y is not None and (x ^ y).bit_count() <= 6)
    got = near.hamming_pairs(spark.createDataFrame(rows, "k long, sig long"), key="k").collect()
    assert sorted(map(tuple, got)) == want and len(want) == 35
