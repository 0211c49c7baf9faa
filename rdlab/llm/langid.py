"""Language ID by a linear-chain conditional random field over the words of a line.

Emission features of a word are its affixes, inner n-grams and the word itself, hashed, and the languages whose word
lists hold it; the lists and the transitions are learned.
Forward-backward labels each word, so code-switched text gets more than one language.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15  #: hashed emission features
MEMO = 100_000  #: words whose scores a worker keeps
MEMO_CHARS = 10_000_000  #: and their characters
PIECE = 500  #: characters of a piece of a line to learn from
CHUNK = 500  #: texts tagged at once; many together share the steps of long lines
NONE = "und"
LONG = 512  #: words of a line from which it is stepped through in windows side by side


def features(word: str) -> list[int]:
    """Hashed features of a lower-cased word, over all its UTF-8 bytes: prefixes and suffixes of 1 to 4, inner 2- and 3-grams, the word itself."""
    w = word.encode()
    n, last = len(w), BUCKETS - 1
    out = [crc32(w[:i], i) & last for i in range(1, min(4, n) + 1)] + [crc32(w[-i:], 10 + i) & last for i in range(1, min(4, n) + 1)]
    out += [crc32(w[i : i + 2], 21) & last for i in range(n - 1)] + [crc32(w[i : i + 3], 22) & last for i in range(n - 2)]
    out.append(crc32(w, 30) & last)
    return out


def core(token: str) -> str:
    """The word of a token: its letters, lower-cased; empty if it has none."""
    t = token.lower()
    return t if t.isalpha() else "".join(filter(str.isalpha, t))


class Known:
    """Places of tokens met so far in the table of their emission scores."""

    def __init__(self, labels: int):
        self.clear(labels)

    def clear(self, labels: int) -> None:
        self.places: dict[str, int] = {}
        self.words: dict[str, int] = {"": -1}
        self.rows = np.empty((0, labels))
        self.chars = 0


class Crf:
    """Labels, emission weights (features x labels), transition and start weights."""

    def __init__(self, labels: list[str], lexicon: dict[str, list[int]] | None = None):
        self.labels, self.lexicon, n = labels, lexicon or {}, len(labels)
        self.emit, self.move, self.start = np.zeros((BUCKETS + n + 1, n)), np.zeros((n, n)), np.zeros(n)
        # the word lists as sorted hashes and the number of the set of labels that have the word: workers hold nothing else of them
        rows = sorted((xxhash.xxh3_64_intdigest(w), tuple(x)) for w, x in self.lexicon.items())
        self.sets = sorted({x for _, x in rows})
        self.hashes, self.kinds = array("Q", [h for h, _ in rows]), array("L", [self.sets.index(x) for _, x in rows])

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "lexicon"}

    def features(self, word: str) -> list[int]:
        """The hashed features of a word and, behind them, one for each label whose word list holds it, or one for none."""
        h = xxhash.xxh3_64_intdigest(word)
        i = bisect_left(self.hashes, h)
        known = self.sets[self.kinds[i]] if i < len(self.hashes) and self.hashes[i] == h else (len(self.labels),)
        return [*features(word), *(BUCKETS + k for k in known)]

    def scores(self, words: list[str]) -> np.ndarray:
        """Emission scores, a row for each word; long words are summed by themselves, in pieces."""
        out = np.zeros((len(words), self.emit.shape[1]))
        short = np.array([len(w) <= 64 for w in words], bool)
        found = [self.features(w) for w in words if len(w) <= 64]
        if found:
            starts = np.cumsum([0, *map(len, found[:-1])])
            out[short] = np.add.reduceat(self.emit[np.fromiter(chain.from_iterable(found), np.int64)], starts, axis=0)
        for i in np.flatnonzero(~short):
            f = np.array(self.features(words[i]))
            for lo in range(0, len(f), 100_000):
                out[i] += self.emit[f[lo : lo + 100_000]].sum(0)
        return out

    def marginals(self, scores: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward over chains padded to one length: scores is (chain, place, label). Gives the marginals and the summed expected transitions."""
        n, t, k = scores.shape
        e = np.exp(scores - scores.max(2, keepdims=True))
        a, move = np.empty((t, n, k)), np.exp(self.move - self.move.max())
        for i in range(t):
            x = np.exp(self.start - self.start.max()) * e[:, i] if not i else (a[i - 1] @ move) * e[:, i]
            x /= x.sum(1, keepdims=True)
            a[i] = x if not i else np.where((i < lengths)[:, None], x, a[i - 1])
        p, pairs = np.empty((t, n, k)), np.zeros((k, k))
        b = np.ones((n, k))
        for i in range(t - 1, -1, -1):
            x = a[i] * b
            p[i] = x / x.sum(1, keepdims=True)
            if i:
                y = e[:, i] * b
                on = (i < lengths)[:, None]
                z = (a[i - 1][:, :, None] * move[None] * y[:, None, :]) if self.training else None
                if z is not None:
                    pairs += (z / z.sum((1, 2), keepdims=True))[on[:, 0]].sum(0)
                y = y @ move.T
                b = np.where(on, y / y.sum(1, keepdims=True), b)
        return p.transpose(1, 0, 2), pairs

    def long_marginals(self, scores: np.ndarray) -> np.ndarray:
        """The marginals of one long chain (place, label), the same as by single steps.

        The chain is cut into windows. First the products of their transfer matrices are built for all windows side by side; these carry the forward and
        backward messages from window to window; then all windows are stepped through side by side, each from the messages at its ends.
        """
        t, k = scores.shape
        size = max(2, int(np.sqrt(t)))
        n = -(-t // size)
        e = np.ones((n * size, k))
        e[:t] = np.exp(scores - scores.max(1, keepdims=True))
        e, inside = e.reshape(n, size, k), (np.arange(n * size) < t).reshape(n, size)
        move, start = np.exp(self.move - self.move.max()), np.exp(self.start - self.start.max())
        unit = lambda x: x / x.sum(-1, keepdims=True)
        carry = np.tile(np.eye(k), (n, 1, 1))
        for i in range(size):
            step = (carry @ move) * e[:, i][:, None, :]
            step /= step.sum((1, 2), keepdims=True)
            carry = np.where((inside[:, i] & ((i > 0) | (np.arange(n) > 0)))[:, None, None], step, carry)
        before, behind = np.empty((n, k)), np.ones((n, k))
        x = unit(start * e[0, 0])
        for w in range(n):
            before[w] = x  # of window 0: the message at its first place
            x = unit(x @ carry[w])
        x = np.ones(k)
        for w in range(n - 1, 0, -1):
            behind[w] = x
            x = unit(carry[w] @ x)
        behind[0] = x
        a = np.empty((size, n, k))
        for i in range(size):
            a[i] = unit(((before if not i else a[i - 1]) @ move) * e[:, i])
            if not i:
                a[0, 0] = before[0]
        p, b = np.empty((size, n, k)), behind
        for i in range(size - 1, -1, -1):
            p[i] = unit(a[i] * b)
            b = np.where(inside[:, i][:, None], unit((e[:, i] * b) @ move.T), b)
            # places behind the end of the chain don't change the message
        return p.transpose(1, 0, 2).reshape(n * size, k)[:t]

    training = False

    def fit(self, chains: list[tuple[list[str], list[int]]], epochs: int = 4, size: int = 64, rate: float = 0.3, decay: float = 1e-4, seed: int = 3) -> Crf:
        """Conditional maximum likelihood by Adagrad over chains of (words, labels)."""
        rng, k = np.random.default_rng(seed), len(self.labels)
        ge, gm, gs = np.full_like(self.emit, 1e-3), np.full_like(self.move, 1e-3), np.full_like(self.start, 1e-3)
        memo: dict[str, np.ndarray] = {}
        self.training = True
        for _ in range(epochs):
            order = rng.permutation(len(chains))
            for lo in range(0, len(order), size):
                part = sorted((chains[i] for i in order[lo : lo + size]), key=lambda c: len(c[0]))
                length = np.array([len(c[0]) for c in part])
                scores, gold = np.zeros((len(part), length.max(), k)), np.zeros((len(part), length.max(), k))
                feats, at, who = [], [], []
                moves, first = np.zeros((k, k)), np.zeros(k)
                for i, (words, tags) in enumerate(part):
                    for j, (w, g) in enumerate(zip(words, tags, strict=True)):
                        if (f := memo.get(w)) is None:
                            f = memo[w] = np.array(self.features(w))
                        scores[i, j] = self.emit[f].sum(0)
                        gold[i, j, g] = 1
                        feats.append(f)
                        at.append((i, j))
                        who.append(len(f))
                    np.add.at(moves, (tags[:-1], tags[1:]), 1)
                    first[tags[0]] += 1
                p, pairs = self.marginals(scores, length)
                at = np.array(at)
                diff = (gold - p)[at[:, 0], at[:, 1]]
                ids = np.concatenate(feats)
                near, back = np.unique(ids, return_inverse=True)
                g = np.zeros((len(near), k))
                np.add.at(g, back, np.repeat(diff, who, axis=0))
                g -= decay * self.emit[near]
                ge[near] += g * g
                self.emit[near] += rate * g / np.sqrt(ge[near])
                g = moves - pairs - decay * self.move
                gm += g * g
                self.move += rate * g / np.sqrt(gm)
                g = first - p[:, 0].sum(0) - decay * self.start
                gs += g * g
                self.start += rate * g / np.sqrt(gs)
        self.training = False
        return self

    def tag(self, texts: list[str | None], known: Known) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text the places of its words with letters among its tokens, and their marginals."""
        lines, owner, new = [], [], []
        if len(known.rows) > MEMO or len(known.places) > 2 * MEMO or known.chars > MEMO_CHARS:
            known.clear(len(self.labels))
        memo, words, n = known.places, known.words, len(known.rows)
        for i, text in enumerate(texts):
            for line in (text or "").split("\n"):
                ids = []
                for token in line.split():
                    at = memo.get(token)
                    if at is None:
                        word = core(token)
                        at = words.get(word)
                        if at is None:
                            at = words[word] = n + len(new)
                            new.append(word)
                        memo[token] = at
                        known.chars += len(token)
                    ids.append(at)
                if ids:
                    lines.append(np.array(ids))
                    owner.append(i)
        parts = [x[x >= 0] for x in lines]
        if new:
            known.rows = np.concatenate([known.rows, self.scores(new)])
        emit, done = known.rows, [None] * len(lines)
        order = sorted((i for i in range(len(lines)) if len(parts[i])), key=lambda i: len(parts[i]))
        while order and len(parts[order[-1]]) >= LONG:
            i = order.pop()
            done[i] = self.long_marginals(emit[parts[i]]).astype(np.float32)
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and hi - lo < 4096 and len(parts[order[hi]]) <= 1.3 * len(parts[order[lo]]) + 4 and (hi - lo + 1) * len(parts[order[hi]]) <= 200_000:
                hi += 1
            part = order[lo:hi]
            length = np.array([len(parts[i]) for i in part])
            ids = np.zeros((len(part), length.max()), np.int64)
            for r, i in enumerate(part):
                ids[r, : length[r]] = parts[i]
            p, _ = self.marginals(emit[ids], length)
            for r, i in enumerate(part):
                done[i] = p[r, : length[r]].astype(np.float32)
            lo = hi
        k, at = len(self.labels), 0
        for i in range(len(texts)):
            places, got, base = [], [], 0
            while at < len(lines) and owner[at] == i:
                if done[at] is not None:
                    places.append(np.flatnonzero(lines[at] >= 0) + base)
                    got.append(done[at])
                base += len(lines[at])
                at += 1
            yield (np.concatenate(places), np.concatenate(got)) if got else (np.empty(0, np.int64), np.empty((0, k)))


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", per_label: int = 150, max_words: int = 60_000, lexicon_words: int = 20_000, seed: int = 11) -> Crf:
    """A model from a bounded sample of labelled lines.

    About per_label documents of each label, picked by a hash of the text, give their lines, in pieces of at most PIECE
    characters: at most max_words / 4 pieces, and max_words / labels words of each label. Chains join pieces of unlike documents, so that changes
    of language occur and transitions are learned. About 2 * per_label other documents of each label give the word
    lists: words found at least twice, the most frequent lexicon_words * labels of them. Rows with a null text or label take no part; repeated rows count
    as often as they occur. With no labelled row the model has no label and every prediction is `und`.
    """
    rows = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    labels = sorted(counts)
    if not labels:
        return Crf(labels)
    place = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    share = F.element_at(F.create_map(*[x for c in labels for x in (F.lit(c), F.lit(per_label / counts[c]))]), F.col("lang"))
    picked = rows.where(place < share).select("lang", F.explode(F.split("text", "\n")).alias("line"), F.xxhash64("text").alias("doc"))
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length("line") - 1) / PIECE).cast("int")), lambda i: F.substring("line", i * PIECE + 1, F.lit(PIECE)))
    lines = picked.where("line <> ''").select("lang", "doc", F.explode(pieces).alias("line")).orderBy(F.xxhash64("line", "doc"), "line", "lang").limit(max_words // 4).collect()
    words = rows.where((place >= share) & (place < 3 * share)).select("lang", F.explode(F.split("text", r"\s+")).alias("token")).select("lang", F.regexp_replace(F.lower("token"), r"[^\p{L}]", "").alias("word"))
    often = words.where("word <> ''").groupBy("word", "lang").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "word", "lang").limit(lexicon_words * len(labels))
    lexicon: dict[str, list[int]] = {}
    for r in often.collect():
        lexicon.setdefault(r["word"], []).append(labels.index(r["lang"]))
    model = Crf(labels, {w: sorted(x) for w, x in lexicon.items()})
    room, rng = dict.fromkeys(labels, max_words // len(labels)), np.random.default_rng(seed)
    taken: list[tuple[list[str], int]] = []
    for r in sorted(lines, key=lambda r: (r["doc"], r["lang"], r["line"])):
        words = [w for w in map(core, r["line"].split()) if w]
        if words and room[r["lang"]] > 0:
            room[r["lang"]] -= len(words)
            taken.append((words, labels.index(r["lang"])))
    chains, order = [], rng.permutation(len(taken))
    for i in range(0, len(order), 2):
        words, tags = [], []
        for j in order[i : i + 2]:
            words += taken[j][0]
            tags += [taken[j][1]] * len(taken[j][0])
        chains.append((words, tags))
    return model.fit(chains)


def detect(text: str | Column, model) -> Column:
    """struct(lang, score, words array<struct(place, lang, p)>) of a text; model is a broadcast Crf.

    A word is a token of the text (white space apart) with a letter; words hold each one's label and
    marginal, lang is the label with the largest mean marginal (the first by name on a tie), score that mean. A text that is null or has no letter is
    `und` with score 0 and no words, and so is every text if the model has no label. Long texts are read whole, line by line.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = model.value
        if not m.labels:
            yield from (_structs([(NONE, 0.0, [])] * len(b), []) for b in batches)
            return
        known = Known(len(m.labels))
        for b in batches:
            out = []
            for lo in range(0, len(b), CHUNK):
                for places, p in m.tag(b.slice(lo, CHUNK).to_pylist(), known):
                    if not len(p):
                        out.append((NONE, 0.0, []))
                        continue
                    mean = p.mean(0)
                    i = int(mean.argmax())
                    out.append((m.labels[i], min(1.0, float(mean[i])), (places, p.argmax(1), p.max(1))))
            yield _structs(out, m.labels)

    return F.arrow_udf(run, "struct<lang:string,score:double,words:array<struct<place:int,lang:string,p:float>>>")(text)


def _structs(rows: list, labels: list[str]) -> pa.Array:
    ends = np.cumsum([0, *[len(r[2][0]) if len(r[2]) else 0 for r in rows]], dtype=np.int32)
    full = [r[2] for r in rows if len(r[2])]
    place, tag, p = (np.concatenate([x[i] for x in full]) if full else np.empty(0) for i in range(3))
    names = pa.array(labels or [NONE], pa.string()).take(pa.array(tag.astype(np.int64)))
    words = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(place.astype(np.int32)), names, pa.array(p.astype(np.float32))], ["place", "lang", "p"]))
    return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), words], ["lang", "score", "words"])


def _documents(rows: list) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array([x[0] for x in rows], pa.string()), *[pa.array([x[i] for x in rows], pa.float64()) for i in (1, 2)]], ["lang", "score", "sure"])


def detect_document(text: str | Column, model) -> Column:
    """struct(lang, score, sure) of a text: lang and score as detect() without the words, sure the mean over the words of each one's largest marginal."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = model.value
        if not m.labels:
            yield from (_documents([(NONE, 0.0, 0.0)] * len(b)) for b in batches)
            return
        known = Known(len(m.labels))
        for b in batches:
            out = []
            for lo in range(0, len(b), CHUNK):
                for _, p in m.tag(b.slice(lo, CHUNK).to_pylist(), known):
                    mean = p.mean(0) if len(p) else None
                    out.append((NONE, 0.0, 0.0) if mean is None else (m.labels[int(mean.argmax())], min(1.0, float(mean.max())), min(1.0, float(p.max(1).mean()))))
            yield _documents(out)

    return F.arrow_udf(run, "struct<lang:string,score:double,sure:double>")(text)


def held_out(id_col: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % parts == part
