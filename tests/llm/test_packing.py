"""Containers along the Hilbert curve."""

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm.packing import Packer, hilbert_keys, normal_share, pack
from tickloom.llm.tokens import BYTE_BPE_50K, encoder


def test_the_curve_visits_every_cell_by_single_steps():
    for bits, dims in ((4, 2), (3, 3), (1, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(1, 50), max_size=40), max_size=6), st.integers(0, 90))
def test_no_container_overflows(windows, reach):
    packer, load, born, seen = Packer(50, reach), {}, {}, 0
    for sizes in windows:
        for size, box in zip(sizes, packer.place(sizes, len(sizes)), strict=True):
            load[box] = load.get(box, 0) + size
            assert seen - born.setdefault(box, seen) < max(1, reach)  # closed by then
        seen += len(sizes)
    assert all(x <= 50 for x in load.values())
    assert len(load) == packer.made


@pytest.mark.skipif(not os.path.exists(BYTE_BPE_50K), reason="no vocabulary files here")
def test_documents(spark):
    rng = random.Random(8)
    words = "alpha beta gamma delta kappa sigma omega line station robot".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 60))), 0, "") for i in range(1500)]
    rows += [(2000, None, 0, ""), (2001, "", 0, ""), (2002, " ".join(rng.choices(words, k=900)), 0, "")] + [(3000 + i, "the same text again and again", 0, "") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n bigint, doc string")
    out = pack(df, "doc_id", "text", capacity=128, window=500, partitions=3).collect()
    size = {i: len(encoder(BYTE_BPE_50K).encode(t)) if t else 0 for i, t, *_ in rows}
    pieces, load = {}, {}
    for r in out:
        pieces.setdefault(r["doc_id"], []).append(r)
        if r["container"] is None:
            assert r["n_tokens"] == 0
        else:
            load[r["container"]] = load.get(r["container"], 0) + r["n_tokens"]
    assert set(pieces) == set(size)
    for i, own in pieces.items():
        own.sort(key=lambda r: r["piece"])
        assert all(r["doc_tokens"] == size[i] for r in own)
        assert len(own) == max(1, -(-size[i] // 128))
        assert [r["start"] for r in own] == [128 * k for k in range(len(own))]
        assert sum(r["n_tokens"] for r in own) == size[i]
    assert max(load.values()) <= 128
    assert sum(load.values()) >= 0.98 * 128 * (len(load) - 3)
    assert pack(df.limit(0), "doc_id", "text").count() == 0


def test_neighbours_share_containers(spark):
    """Documents of one subject meet far more often than in random order, and containers are full all the same."""
    rng = random.Random(5)
    subjects = [[f"{a}{b}" for b in ("one", "two", "red", "blue", "belt", "gear", "fish", "stone")] for a in ("ka", "mi", "to", "re", "su", "ne", "po", "da")]
    subject = [rng.randrange(8) for _ in range(4000)]
    rows = [(i, " ".join(rng.choices(subjects[s], k=rng.randrange(2, 60)))) for i, s in enumerate(subject)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    boxes = {}
    for r in pack(df, "doc_id", "text", capacity=512, partitions=1).where("container is not null").collect():
        boxes.setdefault(r["container"], []).append((subject[r["doc_id"]], r["n_tokens"]))
    pairs = [(a[0], b[0]) for items in boxes.values() for i, a in enumerate(items) for b in items[:i]]
    assert sum(a == b for a, b in pairs) > 0.5 * len(pairs)  # 0.125 in random order
    assert sum(n for items in boxes.values() for _, n in items) >= 0.99 * 512 * len(boxes)


def test_share_of_the_normal_distribution():
    z = np.linspace(-6, 6, 2001)
    from math import erf

    assert np.abs(normal_share(z) - [0.5 * (1 + erf(x / 2**0.5)) for x in z]).max() < 2e-7
