"""Dense groups of near-duplicates, by pairs of blocks or by deeper trees."""

import random

import pytest
from test_edges import components_of

from rdlab.llm import minhash


@pytest.mark.parametrize("paired", [32, 0])
def test_dense_group_in_pieces(spark, monkeypatch, paired):
    """Most of 60 documents are similar, but few link: their sets meet by pairs of blocks, without nodes of deeper trees, unless the group is too large for that."""
    monkeypatch.setattr(minhash, "LEAF", 8)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "DEPTH", 6)
    monkeypatch.setattr(minhash, "PAIRED", paired, raising=False)
    walks, walk = [], minhash._walk

    def spy(tables, sigs, active, last):
        walks.append(last)
        return walk(tables, sigs, active, last)

    monkeypatch.setattr(minhash, "_walk", spy)
    rng = random.Random(5)
    base = [f"w{rng.getrandbits(40)}" for _ in range(60)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"x{rng.getrandbits(40)}"
        texts.append(" ".join(w))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    assert got == components_of(texts)
    assert walks == ([minhash.DEEP] if paired else [minhash.DEEP, minhash.DEPTH])
