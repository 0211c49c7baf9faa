"""A text's score has the same bits wherever the text lies in a batch."""

import numpy as np
import pyarrow as pa

from rdlab.llm import quality


def test_sums_of_a_bag_do_not_depend_on_its_place():
    rng = np.random.default_rng(6)
    model = quality.Attention()
    model.w["c"] = rng.standard_normal(quality.SIZE).astype(np.float32)
    bags = [rng.random((n, quality.WIDTH), np.float32) for n in rng.integers(1, 40, 120)]
    starts = np.cumsum([0, *(len(b) for b in bags[:-1])])
    weight, total = model.sums(np.concatenate(bags), starts)
    scores = model.score(weight, total)
    for i, bag in enumerate(bags):
        w, t = model.sums(bag, np.array([0]))
        assert w[0] == weight[i]
        assert (t[0] == total[i]).all()
        assert model.score(w, t)[0] == scores[i]


def test_equal_texts_of_a_batch_score_alike(monkeypatch):
    monkeypatch.setattr(quality, "BATCH", 300_000)
    rng = np.random.default_rng(7)
    model = quality.Attention()
    model.w["c"] = rng.standard_normal(quality.SIZE).astype(np.float32)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 900, n)) for n in (1, 60, 700, 30_000)]
    order = rng.integers(0, 4, 60)
    batch = pa.array([texts[i] for i in order])
    weight, total = np.zeros(len(order)), np.zeros((len(order), quality.SIZE))
    parts, owner, held = [], [], 0
    for i, t in enumerate(batch):
        for p in quality.stretches(t.as_py()):
            parts.append(p)
            owner.append(i)
            held += len(p)
            if held >= quality.BATCH:
                quality._add(model, parts, owner, weight, total)
                parts, owner, held = [], [], 0
    if parts:
        quality._add(model, parts, owner, weight, total)
    scores = model.score(weight, total)
    assert all(len(set(scores[order == i])) == 1 for i in range(4))
