"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages, and only the document has a label. Every passage is encoded as hashed byte trigrams, kinds
of characters and repeats, and embedded by a learned layer; a learned gated attention weighs the passages, and the
weighted sum of their embeddings is scored. All weights are learned together from the labels of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASSAGE = 512  #: bytes of a passage at most
DAMP = 64  #: bytes that a passage counts as longer, so that very short ones say little
STRETCH = 128  #: passages of a text that are encoded together; repeats are seen within them
BATCH = 2_000_000  #: bytes encoded at once
HASHED, KINDS = 512, 8
WIDTH = HASHED + KINDS + 3
SIZE, GATE = 24, 12  #: of an embedding, and of the two layers of the attention
ROWS = 8  #: passages of a bag that are multiplied together

_KIND = np.full(256, 6, np.uint8)  # other signs
for _k, _chars in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t", b"\n\r\x0b\x0c", b".,;:!?'\"()-")):
    _KIND[[*_chars]] = _k
_KIND[128:] = 7
_END = b"\0\0"


def stretches(text: str | None) -> list[bytes]:
    """The whole text in stretches of whole passages, each with an end mark; one stretch with only the mark for a null or empty text."""
    data, size = (text or "").encode(), PASSAGE * STRETCH - len(_END)
    return [data[i : i + size] + _END for i in range(0, max(1, len(data)), size)]


def encode(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all passages of some stretches, and the stretch of each."""
    sizes = np.array([len(p) for p in parts])
    many = -(-sizes // PASSAGE)
    data = np.frombuffer(b"".join(parts) + _END + bytes(16), np.uint8)
    n = int(sizes.sum())
    of = np.repeat(np.arange(len(parts)), many)
    start = np.cumsum(sizes) - sizes
    nth = np.arange(len(of)) - (np.cumsum(many) - many)[of]
    length = (sizes // many)[of] + (nth < (sizes % many)[of])  # all passages of a stretch are about as long
    at = np.repeat(np.arange(len(of)), length)
    gram = data[:n].astype(np.uint32) * np.uint32(0x9E3779B1) + data[1 : n + 1] * np.uint32(0x85EBCA77) + data[2 : n + 2] * np.uint32(0xC2B2AE3D)
    last = start + sizes - 1
    gram[last] = gram[last - 1] = 0  # these would read on in the next stretch
    gram ^= gram >> np.uint32(15)
    gram = (gram * np.uint32(0x27D4EB2F)) >> np.uint32(32 - (HASHED - 1).bit_length())
    x = np.empty((len(of), WIDTH), np.float32)
    hashed = np.sqrt(np.bincount(at * HASHED + gram, minlength=len(of) * HASHED).reshape(-1, HASHED).astype(np.float32))
    x[:, :HASHED] = hashed / np.sqrt(length[:, None] + DAMP)
    kind = _KIND[data[:n]]
    x[:, HASHED : HASHED + KINDS] = np.bincount(at * KINDS + kind, minlength=len(of) * KINDS).reshape(-1, KINDS) / length[:, None]
    gap = (kind == 3) | (kind == 4)
    after_gap = np.r_[True, gap[:-1]]
    after_gap[start] = True
    first = np.flatnonzero(~gap & after_gap)  # words begin here
    part = np.searchsorted(start, first, "right") - 1
    left = (start + sizes)[part] - first  # bytes up to the end of the stretch
    next16 = np.where(np.arange(16) < left[:, None], data[first[:, None] + np.arange(16)], 0).astype(np.uint8).view(np.uint64)
    key = next16[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ next16[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ part.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    again = np.ones(len(first), bool)
    again[np.unique(key, return_index=True)[1]] = False
    ends = np.flatnonzero(np.r_[gap, True])
    long = np.minimum(ends[np.searchsorted(ends, first)] - first, left)
    word = next16.view(np.uint8).reshape(-1, 16) * (np.arange(16) < long[:, None]) | 32
    twice = np.r_[False, (word[1:] == word[:-1]).all(1) & (part[1:] == part[:-1])][: len(first)]
    words = np.maximum(1, np.bincount(at[first], minlength=len(of)))
    x[:, -3] = np.bincount(at[first], weights=twice, minlength=len(of)) / words
    x[:, -2] = np.bincount(at[first], weights=again, minlength=len(of)) / words
    x[:, -1] = np.log1p(length / words) / 4
    return x, of


class Attention:
    """Embedding, gated attention and score of a bag of passages; weights lie in one dict of arrays."""

    def __init__(self, prior: float = 0.5, seed: int = 7):
        draw = np.random.default_rng(seed)
        layer = lambda a, b: (draw.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.w = {"e": layer(WIDTH, SIZE), "eb": np.zeros(SIZE, np.float32), "v": layer(SIZE, GATE), "u": layer(SIZE, GATE), "a": layer(GATE, 1)[:, 0], "c": np.zeros(SIZE, np.float32), "b": np.float32(np.log(prior / (1 - prior)))}

    def passages(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        w = self.w
        h = np.tanh(x @ w["e"] + w["eb"])
        t, g = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
        return h, t, g, np.exp((t * g) @ w["a"])  # the exponent is at most the sum of |a|

    def sums(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each bag its sum of weights and of weighted embeddings, which add up over parts of a bag.

        The last bits of a product depend on the shape of the matrix and the place of a row in it. Each bag begins a new block of ROWS rows, so its sums are the same whatever lies beside it.
        """
        many = np.diff(np.r_[starts, len(x)])
        whole = -(-many // ROWS) * ROWS
        at = np.arange(len(x)) + np.repeat(np.cumsum(whole) - whole - starts, many)
        blocks = np.zeros((int(whole.sum()), x.shape[1]), x.dtype)
        blocks[at] = x
        h, _, _, s = self.passages(blocks.reshape(-1, ROWS, x.shape[1]))
        h, s = h.reshape(-1, SIZE)[at], s.reshape(-1)[at]
        return np.add.reduceat(s, starts), np.add.reduceat(s[:, None] * h, starts)

    def score(self, weight: np.ndarray, total: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((total / weight[:, None] * self.w["c"]).sum(1) + self.w["b"], -30, 30)))

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        h, t, g, s = self.passages(x)
        many = np.diff(np.r_[starts, len(x)])
        weight = s / np.repeat(np.add.reduceat(s, starts), many)
        z = np.add.reduceat(weight[:, None] * h, starts)
        d = (1 / (1 + np.exp(-np.clip(z @ w["c"] + w["b"], -30, 30))) - y) / len(y)
        dz = np.repeat(d[:, None] * w["c"], many, 0)
        dweight = (dz * h).sum(1)
        dlog = weight * (dweight - np.repeat(np.add.reduceat(weight * dweight, starts), many))
        dt, dg = dlog[:, None] * w["a"] * g * (1 - t * t), dlog[:, None] * w["a"] * t * g * (1 - g)
        dh = (weight[:, None] * dz + dt @ w["v"].T + dg @ w["u"].T) * (1 - h * h)
        return {"e": x.T @ dh, "eb": dh.sum(0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ dlog, "c": z.T @ d, "b": d.sum()}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, rounds: int = 40, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 11) -> Attention:
        """Adam over shuffled batches of bags."""
        draw = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        step = 0
        for _ in range(rounds):
            for ids in np.array_split(draw.permutation(len(bags)), -(-len(bags) // batch)):
                x = np.concatenate([bags[i] for i in ids]).astype(np.float32)
                starts = np.cumsum([0, *(len(bags[i]) for i in ids[:-1])])
                step += 1
                for k, d in self.gradients(x, starts, y[ids].astype(np.float32)).items():
                    d = d + decay * self.w[k]
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.99 * v[k] + 0.01 * d * d
                    self.w[k] = (self.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 1200, passages: int = 48) -> Attention:
    """A model learned from at most `sample` documents of each label, picked by a hash of the id, with at most `passages` passages each, evenly spread.

    df and labels join on id_col; rows with a null id or label, and null or empty texts, teach nothing. With no labels, or only one kind,
    every score is the share of label 1, one of each kind added. The picked ids (at most 2 * sample) are broadcast; at most four times as many rows come to the driver.
    """
    given = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col).cast("int") == 1).cast("int").alias("label"))
    pick = lambda label: given.where(F.col("label") == label).orderBy(F.xxhash64("id", F.lit(5)), "id").limit(sample)
    texts = df.where(F.col(id_col).isNotNull() & (F.col(text_col) != "")).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, label in zip(b.column("text"), b.column("label").to_pylist(), strict=True):
                x = np.concatenate([encode([p])[0] for p in stretches(t.as_py())])
                x = x[np.unique(np.linspace(0, len(x) - 1, min(passages, len(x))).astype(int))]
                yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float16).tobytes()], pa.binary()), pa.array([label], pa.int32())], ["x", "label"])

    rows = texts.join(F.broadcast(pick(0).unionAll(pick(1))), "id").select("text", "label")
    seen = rows.mapInArrow(look, "x binary, label int").orderBy(F.xxhash64("x"), "x", "label").limit(4 * sample).collect()
    y = np.array([r["label"] for r in seen], float)
    model = Attention((y.sum() + 1) / (len(y) + 2))
    if 0 < y.sum() < len(y):
        model.fit([np.frombuffer(r["x"], np.float16).reshape(-1, WIDTH) for r in seen], y)
    return model


def score(text: str | Column, model) -> Column:
    """double in (0, 1): higher where label 1 is likelier. model is a broadcast Attention. All passages of the whole text count; a null text is scored as an empty one, which has one empty passage."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            weight, total = np.zeros(len(b)), np.zeros((len(b), SIZE))
            parts: list[bytes] = []
            owner: list[int] = []
            held = 0
            for i, t in enumerate(b):
                for p in stretches(t.as_py()):
                    parts.append(p)
                    owner.append(i)
                    held += len(p)
                    if held >= BATCH:
                        _add(model.value, parts, owner, weight, total)
                        parts, owner, held = [], [], 0
            if parts:
                _add(model.value, parts, owner, weight, total)
            yield pa.array(model.value.score(weight, total), pa.float64())

    return F.arrow_udf(run, "double")(text)


def _add(model: Attention, parts: list[bytes], owner: list[int], weight: np.ndarray, total: np.ndarray) -> None:
    x, of = encode(parts)
    w, t = model.sums(x, np.flatnonzero(np.r_[True, of[1:] != of[:-1]]))
    np.add.at(weight, owner, w)
    np.add.at(total, owner, t)
