import random
import zlib
from collections import defaultdict

import numpy as np
from textgate.llm import packing
from textgate.llm.registry import packing_files


def test_encoder_ids():
    e = packing.Encoder(*packing_files())
    r = random.Random(5)
    letters = [chr(i) for i in range(0x250)] + [" "] * 80 + list("theand's") * 20 + ["<|endoftext|>", "中"]
    for _ in range(500):
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 60)))
        assert e.ids(t).tolist() == e.slow.encode(t, add_special_tokens=False).ids


def test_differencing_keeps_every_piece_and_capacity():
    r = random.Random(2)
    for n in (0, 1, 2, 7, 300):
        sizes = [r.randint(1, 512) for _ in range(n)]
        windows = packing.windows_of(sizes, 2048)
        assert sorted(i for w in windows for i in w) == list(range(n))
        assert all(sum(sizes[i] for i in w) <= 2048 for w in windows)
    assert sorted(w[0] for w in packing.difference([8, 7, 6, 5, 4], 2)) == [14, 16]  # Karmarkar and Karp's own example
    assert len(packing.windows_of([2000, 2000, 2000], 2048)) == 3


def test_round_trip(odd, odd_rows, none):
    got = packing.pack(odd, packing_files(), group_tokens=20_000).collect()
    e = packing.Encoder(*packing_files())
    sequences, pieces = defaultdict(list), defaultdict(list)
    for p in got:
        sequences[p.sequence_id].append((p.offset, p.length))
        pieces[p.doc_id].append((p.start, p.length, p.ids_crc32, p.doc_tokens))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    want = defaultdict(list)
    for row in odd_rows:
        ids = np.append(e.ids(row[1] or ""), 1).astype("<u4")
        for start, length in packing.cuts(len(ids), 2048, packing.PIECE):
            want[row[0]].append((start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids)))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    assert packing.pack(none, packing_files()).collect() == []


def test_little_padding():
    r = random.Random(9)
    sizes = [s for _ in range(1500) for _, s in packing.cuts(r.randint(20, 2047), 2048, packing.PIECE)]
    windows = packing.windows_of(sizes, 2048)
    assert 1 - sum(sizes) / (2048 * len(windows)) < 0.02


def test_documents_stay_together(spark):
    r = random.Random(4)
    sizes, owners = [], []
    for doc in range(600):
        for _, n in packing.cuts(r.randint(20, 2047), 2048, packing.PIECE):
            sizes.append(n)
            owners.append(doc)
    before = packing.windows_of(sizes, 2048)
    after = packing.gathered(before, sizes, owners)
    assert sorted(i for w in after for i in w) == list(range(len(sizes)))
    assert [sorted(sizes[i] for i in w) for w in after] == [sorted(sizes[i] for i in w) for w in before]

    def spread(windows):
        found = defaultdict(set)
        for n, w in enumerate(windows):
            for i in w:
                found[owners[i]].add(n)
        return sum(map(len, found.values())) / len(found)

    assert spread(after) < 0.6 * spread(before)
    assert packing.gathered([], [], []) == [] and packing.gathered([[0]], [5], [0]) == [[0]]
