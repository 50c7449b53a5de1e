"""Operator 9: near-duplicate groups by BagMinHash signatures, banding and verified overlap.

A text is the multiset of its five-word shingles. A shingle's count is its weight, discretised to
unit levels and covered by intervals (0,1], (1,2], (2,4], (4,8], ... Each pair of a shingle and an
interval runs one Poisson process of the interval's width times the number of slots; each point has
a slot and a level, and counts where the level is within the weight (an interval that the weight
covers in part is thinned). A slot keeps its earliest point, so two texts agree in a slot with a
probability that is their weighted Jaccard similarity. All texts of a batch advance together, a
point at a time, and a process ends once it is later than every slot of its text.

Texts of one multiset are one class. Classes that agree in a band of slots are candidates. First
every class is checked, in a few rounds, against one class drawn anew for each of its buckets,
which ties large groups together with as many checks as members; then the pairs of a bucket that
are still in different components are checked, all of them. In buckets beyond ``BUCKET`` classes
both of a pair must have enough shingles in common with other classes of such buckets to be a link
at all, which is a bound and loses none, so that a passage that many texts share does not pair them
all. A check first compares signatures and then the complete multisets; pairs of similarity
``least`` or more are links, and their connected components are the groups.

Defined cases: words are runs of letters, digits and underscores, lower-cased; a text of one to
four words is one shingle; a text without a word is the one shingle of its characters without
blanks, so null, empty and blank texts are alike; null ids never lead a group that has another id;
rows that repeat entirely are one class; an empty table gives no rows; further columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discarded, joined_with_hot, released, text_or_empty, written

WORDS = 5
BANDS = 32
ROWS = 6
SLOTS = BANDS * ROWS
LEAST = 0.8
#: Signatures alone rule a pair out below this share of equal slots: 5.2 deviations under 0.8, so
#: that they lose fewer than 1 in a million pairs of similarity 0.8.
LEAST_SLOTS = 0.65
BUCKET = 48
#: So many classes of a bucket are compared with all others of it in one task.
PART = 4096
STARS = 2
#: So many links (of two 32-character names) at most are united in one task.
LINKS_IN_ONE_TASK = 500_000
BATCH_SHINGLES = 400_000
WORD = re.compile(r"\w+")
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles, ascending, and their counts."""
    words = WORD.findall((text or "").lower()) or ["".join((text or "").split())]
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(w) for w in words), np.uint64, len(words))
    n = max(1, len(h) - WORDS + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(h))):
        out = out * np.uint64(0x9E3779B97F4A7C55) + _mix(h[k : k + n] + np.uint64(k))
    return np.unique(_mix(out), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)


def signatures(texts: list[tuple[np.ndarray, np.ndarray]], slots: int = SLOTS) -> np.ndarray:
    """Of each text, the 64 bits of its earliest point in each slot."""
    least = np.full((len(texts), slots), np.inf)
    flat = least.reshape(-1)
    owner = np.repeat(np.arange(len(texts)), [len(t[0]) for t in texts])
    key = np.concatenate([t[0] for t in texts]) if texts else np.zeros(0, np.uint64)
    count = np.concatenate([t[1] for t in texts]).astype(np.int64) if texts else np.zeros(0, np.int64)
    parts = []
    low, width, level = 0, 1, 0
    while True:  # the intervals (0,1], (1,2], (2,4], ...
        at = np.flatnonzero(count > low)
        if not len(at):
            break
        state = _mix(key[at] + np.uint64((level + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
        parts.append((owner[at], state, np.full(len(at), low), np.full(len(at), width), count[at]))
        low, width, level = low + width, max(1, low + width), level + 1
    if not parts:
        return least.view(np.uint64)
    who, state, low_, width_, limit = (np.concatenate(x) for x in zip(*parts, strict=True))
    time = np.zeros(len(who))
    end = np.full(len(texts), np.inf)
    turn = 0
    while len(who):
        turn += 1
        draw = _mix(state + np.uint64(turn * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log1p(-(draw >> np.uint64(11)).astype(np.float64) * 2.0**-53) / (width_ * slots)
        alive = time < end[who]
        if not alive.all():
            who, state, low_, width_, limit, time, draw = (x[alive] for x in (who, state, low_, width_, limit, time, draw))
        draw = _mix(draw ^ np.uint64(0xA0761D6478BD642F))
        slot = ((draw >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)
        at_level = low_ + ((((draw & np.uint64(0xFFFFFFFF)) * width_.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)) + 1
        within = at_level <= limit
        np.minimum.at(flat, (who * slots + slot.astype(np.int64))[within], time[within])
        if turn < 6 or turn % 8 == 0:
            some = np.unique(who) if turn > 6 else slice(None)
            end[some] = least[some].max(axis=1)
    return least.view(np.uint64)


def bands(signature: np.ndarray) -> np.ndarray:
    """A row of 64-bit keys per text, one key a band."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    out = np.zeros(parts.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64) * GOLDEN
    for k in range(ROWS):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C55) + parts[:, :, k])
    return out.view(np.int64)


def _class_key(found: tuple[np.ndarray, np.ndarray]) -> str:
    return xxhash.xxh3_128_hexdigest(found[0].tobytes() + found[1].astype(np.int64).tobytes())


def sign(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text_key, row, class, bands, slots (8 bits of each slot, eight slots a long); a narrow map.

    ``row`` tells rows apart that repeat entirely, once the result is written."""
    kind = docs.schema[id_col].dataType.simpleString()
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), F.monotonically_increasing_id().alias("row"), text.alias("text"))

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(3).to_pylist()
            at = 0
            while at < len(texts):
                held, total, first = [], 0, at
                while at < len(texts) and (not held or total < BATCH_SHINGLES):
                    held.append(shingles(texts[at]))
                    total += len(held[-1][0])
                    at += 1
                s = signatures(held)
                small = (_mix(s) >> np.uint64(56)).astype(np.uint8)
                keys = bands(s)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(i).slice(first, at - first) for i in range(3)), pa.array(map(_class_key, held), pa.string()),
                        pa.array(list(keys), pa.list_(pa.int64())), pa.array(list(small.view(np.int64)), pa.list_(pa.int64())),
                    ],
                    names=["id", "text_key", "row", "class", "bands", "slots"],
                )

    return rows.mapInArrow(per_batch, f"id {kind}, text_key long, row long, class string, bands array<long>, slots array<long>")


def _equal_slots(x: str, y: str) -> Column:
    """The share of equal slots of two columns of packed slots, eight bits each."""

    def differ(j: Column) -> Column:
        """How many of eight slots differ: the bits of each byte of the exclusive or, or-ed together."""
        z = F.get(x, j).bitwiseXOR(F.get(y, j))
        for shift in (4, 2, 1):
            z = z.bitwiseOR(F.shiftrightunsigned(z, shift))
        return F.bit_count(z.bitwiseAND(F.lit(0x0101010101010101)))

    places = F.sequence(F.lit(0), F.lit(SLOTS // 8 - 1))
    return 1 - F.aggregate(places, F.lit(0), lambda n, j: n + differ(j)) / F.lit(SLOTS)


def _links(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Pairs whose complete multisets overlap enough. texts: (class, text) of all classes in pairs."""
    both = pairs.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a").select("a", "b", "text_a", "text_b")

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, found = None, None
        for batch in batches:
            keep = []
            for a, text_a, text_b in zip(*(batch.column(n).to_pylist() for n in ("a", "text_a", "text_b")), strict=True):
                if a != last:
                    last, found = a, shingles(text_a)
                keep.append(similarity(found, shingles(text_b)) >= least)
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(kept), batch.column("b").filter(kept)], names=["a", "b"])

    return both.mapInArrow(per_batch, "a string, b string")


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    above: dict[str, str] = {}

    def top(x: str) -> str:
        while (y := above.setdefault(x, x)) != x:
            above[x] = above[y]
            x = y
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = sorted((top(a), top(b)))
            above[y] = x
    yield pa.RecordBatch.from_arrays([pa.array(list(above), pa.string()), pa.array([top(x) for x in above], pa.string())], names=["node", "root"])


def components(links: DataFrame, in_one_task: int = LINKS_IN_ONE_TASK) -> DataFrame:
    """(node, root): the least node of each node's connected component.

    Up to ``in_one_task`` links, which are counted first, one task unites them. Beyond that, large
    and small stars alternate: every round is a written table and costs joins on nodes, which Spark
    splits where one node has many links; rounds end when the links no longer change.
    """
    links = links if getattr(links, "written_to", None) else written(links.select("a", "b"), "ties")
    if links.count() <= in_one_task:
        return links.coalesce(1).mapInArrow(_united, "node string, root string")
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = _state(edges)
    while True:
        two = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = two.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = edges.select(F.col("u").alias("x"), F.col("v").alias("u")).join(least, "u").select(F.col("x").alias("u"), F.col("m").alias("v"))
        # links to smaller nodes keep their own least as well, so that nothing comes apart
        own = edges.select("u").distinct().join(least, "u").select("u", F.col("m").alias("v"))
        stars = large.unionByName(own).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        stars = written(stars, "stars")
        lowest = stars.groupBy("u").agg(F.min("v").alias("m"))
        small = stars.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = written(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = _state(edges)
        if now == state:
            break
        state = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())


def _apart(buckets: DataFrame, root: DataFrame) -> DataFrame:
    """(key, class, n, root) of the buckets that hold more than one component."""
    rows = buckets.join(root.withColumnRenamed("node", "class"), "class", "left")
    rows = rows.select("key", "class", "n", F.coalesce("root", "class").alias("root"))
    mixed = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    return rows.join(mixed, "key")


def links(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, least: float = LEAST) -> DataFrame:
    """Verified pairs of classes, as a written table: every pair of classes that shares a band is one
    of them, or was checked, or lies in one component already."""
    rows = classes.select("class", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = written(rows.join(shared, "key"), "buckets")
    # one text for every class that is in a bucket with another
    busy = buckets.select("class").distinct().join(classes.select("class", "id", "text_key"), "class")
    text = text_or_empty(text_col)
    whole = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    same = [whole["id"].eqNullSafe(busy["id"]), whole["text_key"] == busy["text_key"]]
    texts = whole.join(busy, same).select("class", "text")
    texts = written(texts.groupBy("class").agg(F.min("text").alias("text")), "texts")
    slots = classes.select("class", "slots")
    apart = buckets.withColumn("root", F.col("class")).join(slots, "class")
    found = tried = rest = None
    for turn in range(STARS):
        # each bucket's classes against two of them, others in each bucket and round
        draw = F.struct(F.xxhash64("class", "key", F.lit(turn)).alias("h"), F.col("class").alias("c"), F.col("root").alias("r"), F.col("slots").alias("s"))
        centres = apart.groupBy("key").agg(F.explode(F.array(F.min(draw), F.max(draw))).alias("centre")) if turn else apart.groupBy("key").agg(F.min(draw).alias("centre"))
        centres = centres.select("key", "centre.c", "centre.r", "centre.s")
        pairs = apart.join(centres, "key").where((F.col("root") != F.col("r")) & (_equal_slots("slots", "s") >= LEAST_SLOTS)).select(F.greatest("class", "c").alias("b"), F.least("class", "c").alias("a"))
        pairs = pairs.select("a", "b").distinct()
        pairs = written(pairs.join(tried, ["a", "b"], "left_anti") if turn else pairs, "pairs")
        new = _links(pairs, texts, least)
        before, found = found, written(found.unionByName(new) if turn else new, "links")
        tried = tried.unionByName(pairs) if turn else pairs
        last, rest = rest, written(_apart(buckets, components(found)), "apart")
        discarded(before, last)
        new = centres = draw = None
        released(docs.sparkSession)
        apart = rest.where(F.col("n") > BUCKET).join(slots, "class")
        if not apart.limit(1).count():
            break
    # what is still apart: all pairs that can be links, each in the first of its common buckets
    small = rest.where(F.col("n") <= BUCKET).select("class", "key", "n", "root", *[F.lit(0.0).alias(c) for c in ("mass", "size")])
    mass = _shared_mass(texts.join(apart.select("class").distinct(), "class"), least)
    large = apart.select("class", "key", "n", "root").join(mass, "class")
    # a large bucket's pairs are dealt to several tasks: one side by parts, the other to each part
    parts = F.ceil(F.col("n") / F.lit(PART)).cast("int")
    cells = small.unionByName(large).join(classes.select("class", "bands", "slots"), "class")
    other = cells.select("key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), *[F.col(c).alias(f"{c}_b") for c in ("class", "root", "mass", "size", "bands", "slots")])
    cells = cells.withColumn("part", F.pmod(F.xxhash64("class"), parts).cast("int"))
    both = F.least("mass", "mass_b")
    pairs = cells.join(other, ["key", "part"]).where(
        (F.col("class") < F.col("class_b")) & (F.col("root") != F.col("root_b")) & (both >= least * (F.col("size") + F.col("size_b") - both))
        & (_equal_slots("slots", "slots_b") >= LEAST_SLOTS) & (F.get(F.array_intersect("bands", "bands_b"), F.lit(0)) == F.col("key"))
    )
    pairs = pairs.select(F.col("class").alias("a"), F.col("class_b").alias("b")).distinct()
    pairs = written(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
    all_ = written(found.unionByName(_links(pairs, texts, least)), "all")
    discarded(buckets, texts, found, rest, pairs)
    return all_


def _shared_mass(texts: DataFrame, least: float) -> DataFrame:
    """(class, mass, size): shingles of a class, and those of them that another class has as well.

    Two classes can't share more than the lesser mass. Classes without enough of it for any link are
    left out. Shingles are told apart by 32 bits, which can only raise a mass.
    """

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, text in zip(b.column("class").to_pylist(), b.column("text").to_pylist(), strict=True):
                h, n = shingles(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(h), pa.string()), pa.array((h >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(n.astype(np.int64))],
                    names=["class", "h", "n"],
                )

    spread = texts.select("class", "text").mapInArrow(per_batch, "class string, h int, n long")
    per = spread.groupBy("h").agg(F.count(F.lit(1)).alias("in"), F.min("class").alias("class"), F.sum("n").alias("n"))
    alone = per.where(F.col("in") == 1).groupBy("class").agg(F.sum("n").alias("alone"))
    size = spread.groupBy("class").agg(F.sum("n").cast("double").alias("size"))
    rows = size.join(alone, "class", "left").withColumn("mass", F.col("size") - F.coalesce("alone", F.lit(0)))
    return rows.where(F.col("mass") >= least * F.col("size")).select("class", "mass", "size")


def _grouped(docs: DataFrame, id_col: str, text_col: str, least: float) -> DataFrame:
    """id, text_key, class_id, group_size, stays: one row per row of ``docs``."""
    signed = written(sign(docs, id_col, text_col), "signed")
    best = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("text_key").alias("text_key"), F.col("row").alias("row"))
    classes = signed.groupBy("class").agg(
        F.min(best).alias("best"), F.count(F.lit(1)).alias("rows"), F.first("bands").alias("bands"), F.first("slots").alias("slots")
    )
    classes = written(classes.select("class", "best.id", "best.text_key", "best.row", "rows", "bands", "slots"), "classes")
    found = links(docs, classes, id_col, text_col, least)
    tied = components(found).withColumnRenamed("node", "class")
    of = classes.select("class", "id", "row", "rows").join(tied, "class", "left").withColumn("root", F.coalesce("root", "class"))
    of = written(of, "of")
    leader = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("class").alias("class"), F.col("row").alias("row"))
    whole = of.groupBy("root").agg(F.min(leader).alias("leader"), F.sum("rows").alias("group_size"), F.count(F.lit(1)).alias("classes"))
    whole = written(whole.select("root", F.col("leader.id").alias("class_id"), F.col("leader.row").alias("first"), "group_size", "classes"), "whole")
    of = written(joined_with_hot(of.select("class", "root", "rows"), whole, "root", "classes").select("class", "rows", "class_id", "first", "group_size"), "named")
    rows = joined_with_hot(signed.select("id", "text_key", "row", "class"), of, "class", "rows")
    return rows.select("id", "text_key", "class_id", "group_size", (F.col("row") == F.col("first")).alias("stays"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """doc_id, class_id, group_size, kept: one row per row of ``docs``.

    ``class_id`` is the least id of the group, ``group_size`` its number of rows, and ``kept`` marks
    one row of each group.
    """
    rows = _grouped(docs, id_col, text_col, least)
    return rows.select(F.col("id").alias("doc_id"), "class_id", "group_size", F.col("stays").alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, its columns as they were.

    Of rows that repeat their id and text, the one whose other columns are the least as text stays.
    """
    rows = _grouped(docs, id_col, text_col, least).groupBy("id", "text_key").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("times"))
    rows = written(rows, "grouped")
    key = F.xxhash64(text_or_empty(text_col))

    def is_in(these: DataFrame) -> list[Column]:
        return [docs[id_col].eqNullSafe(these["id"]), key == these["text_key"]]

    go, again = rows.where("NOT stays"), rows.where("stays AND times > 1")
    if not again.limit(1).count():
        return docs.join(go, is_in(go), "left_anti")
    go = rows.where("NOT stays OR times > 1")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = docs.join(again, is_in(again), "left_semi").select(F.col(id_col).alias("i"), key.alias("t"), whole.alias("w"))
    one = repeated.groupBy("i", "t").agg(F.min_by("w", F.to_json("w")).alias("w")).select("w.*")
    return docs.join(go, is_in(go), "left_anti").unionByName(one)
