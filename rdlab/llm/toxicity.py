"""Toxicity by a noisy channel: restore obfuscated words, then score the restored text.

A suspicious token, or a run of single characters, becomes a lattice: each sign or run of signs may stand for letters
(leetspeak), be noise, or repeat, and in a run words may end at any gap. Viterbi picks the reading with the best sum
of channel costs and a character trigram model. The score is a logistic model over evidence from words and n-grams
learned from labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rdlab.llm.common import new_path, remove

#: Letters that a sign is used for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Letters written with several signs or letters.
SEVERAL = {"vv": "w", "ph": "f", "\\/": "v", "/\\": "a", "()": "o", "|<": "k", "|)": "d", "|-|": "h", "|\\|": "n"}
NOISE = frozenset(".-_*~'`^#,/\\:;\"")
EDGE = ".,?*&%#:;\"')[]{}<>-_/\\`~^"  #: signs at the ends of a token that stand for no letter by themselves
OPENS, CLOSES = frozenset("(|"), frozenset("!|")  #: signs with letters that are punctuation before or after a word
SWAP, SEVERAL_SWAP, SKIP, ODD_SKIP, AGAIN, JOIN = -1.0, -1.5, -0.7, -6.0, -0.5, -3.0  #: log costs: a sign for a letter, several for one, a dropped punctuation mark, a dropped sign elsewhere at an end, a dropped repeat, no word end at a wide gap
_SIGN = r"(?:[^\W_]|[$@!|(+€£])"
SPACED = re.compile(rf"(?<!\S)(?:{_SIGN}[\s.\-_*]+){{3,}}{_SIGN}(?!\w)")
GAP = re.compile(r"[\s.\-_*]+")
SIGNS = re.compile("|".join(re.escape(x) for x in sorted(SEVERAL, key=len, reverse=True) if not x.isalpha()))
LETTERS = re.compile(r"[^\W\d_]+")
LONG = 64  #: longer tokens are split into words, and not kept in memos
ODD = re.compile(r"(.)\1\1|vv|ph")
_SEVERAL = {c: [(x, to) for x, to in SEVERAL.items() if x[0] == c] for c in {x[0] for x in SEVERAL}}
MIN_DOCS, MIN_SHARE, MIN_ODDS = 4, 1e-4, 2.0  #: a term's toxic texts, their share of all toxic texts, its log odds


class CharModel:
    """Interpolated character trigrams over letters, with ^ before a word and $ after it."""

    def __init__(self, counts: dict[str, int]):
        self.tri: Counter = Counter()
        self.bi: Counter = Counter()
        self.uni: Counter = Counter()
        for g, n in counts.items():
            self.tri[g] += n
            self.bi[g[1:]] += n
            self.uni[g[2:]] += n
        self.total = sum(self.uni.values()) or 1
        self.before3, self.before2 = Counter(), Counter()
        for g, n in self.tri.items():
            self.before3[g[:2]] += n
        for g, n in self.bi.items():
            self.before2[g[:1]] += n
        self.memo: dict[str, float] = {}

    def __call__(self, a: str, b: str) -> float:
        """log P(b | last two characters of a)."""
        g = (a[-2:] + b).rjust(3, "^")
        got = self.memo.get(g)
        if got is None:
            p = 0.05 * (self.uni[b] + 0.5) / (self.total + 50)
            p += 0.25 * self.bi[g[1:]] / max(1, self.before2[g[1:2]]) + 0.7 * self.tri[g] / max(1, self.before3[g[:2]])
            got = self.memo[g] = math.log(p)
        return got


def stripped(token: str) -> str:
    """A token without the signs at its ends that can't be letters, alone or with their neighbours."""
    return token if SIGNS.search(token) else token.strip(EDGE)


def suspicious(token: str) -> bool:
    """Whether a stripped token mixes letters with signs, repeats a character three times or may write one letter as two."""
    if token.isalpha():
        return ODD.search(token) is not None
    return any(c.isalpha() for c in token) and any(c in LEET or c in NOISE for c in token)


def restore(token: str, model: CharModel, wide: list[bool] | None = None) -> str:
    """The best reading of a token's lattice, in linear time; states are the last two letters written.

    Signs at the ends may be letters or punctuation. With `wide`, which tells whether a wide gap stands before each
    character, words may end before any character: the reading has a space there.
    """
    # the states before a character and before the three after it; a reading is a chain (chain before, letter)
    ahead: list[dict[str, tuple[float, tuple | None]]] = [{"^^": (0.0, None)}, {}, {}, {}]
    core = [i for i, c in enumerate(token) if c.isalnum()]
    first, last = (core[0], core[-1]) if core else (0, len(token))
    before, done = "", []

    def put(after: dict, state: str, score: float, text: tuple | None) -> None:
        if state not in after or after[state][0] < score:
            after[state] = (score, text)

    for i, c in enumerate(token):
        states = ahead.pop(0)
        ahead.append({})
        if wide is not None and i:
            ended = [(score + model(state, "$"), (text, " ")) for state, (score, text) in states.items() if state != "^^"]
            if wide[i]:
                states = {state: (score + JOIN, text) for state, (score, text) in states.items()}
            for score, text in ended:
                put(states, "^^", score, text)
        ways = [(1, c, 0.0)] if c.isalpha() else [(1, x, SWAP) for x in LEET.get(c, "")]
        ways += [(len(x), to, SEVERAL_SWAP) for x, to in _SEVERAL.get(c, ()) if token.startswith(x, i)]
        skip = SKIP if c in NOISE or not ways or i < first and c in OPENS or i > last and c in CLOSES else ODD_SKIP if not first <= i <= last else None
        for state, (score, text) in states.items():
            for width, x, cost in ways:
                put(ahead[width - 1], state[1] + x, score + cost + model(state, x), (text, x))
            if skip is not None:
                put(ahead[0], state, score + skip, text)
            if c == before:
                put(ahead[0], state, score + AGAIN, text)
        before = c
        if len(token) > LONG and len(ahead[0]) == 1 and not ahead[1] and not ahead[2]:  # all readings agree so far
            ((state, (score, text)),) = ahead[0].items()
            done.append(_letters(text))
            ahead[0] = {state: (score, None)}
    return "".join(done) + max((s + model(state, "$"), _letters(text)) for state, (s, text) in ahead[0].items())[1]


def unspaced(run: str, model: CharModel) -> str:
    """The words of a run of single characters with gaps between them, which may be of any width."""
    gaps = [len(x) for x in GAP.findall(run)]
    usual = Counter(gaps).most_common(1)[0][0]
    return restore(GAP.sub("", run), model, [False, *(x > usual for x in gaps)])


def _letters(chain: tuple | None) -> str:
    out = []
    while chain:
        chain, x = chain
        out.append(x)
    return "".join(reversed(out))


def split(letters: str, model: CharModel) -> list[str]:
    """The words of a run of letters with the best sum of the character model, in linear time."""
    n = len(letters)
    if not n:
        return []
    # at each letter: a word began with it, or goes on; ends[i] and goes[i] tell whether the letter before had begun its word
    began, on = model("^^", letters[0]), -math.inf
    ends, goes = bytearray(n), bytearray(n)
    for i in range(1, n):
        a, x = letters[i - 1], letters[i]
        pair = letters[i - 2 : i] if i > 1 else "^" + a
        ended = (began + model("^" + a, "$"), on + model(pair, "$"))
        more = (began + model("^" + a, x), on + model(pair, x))
        ends[i], goes[i] = ended[0] >= ended[1], more[0] >= more[1]
        began, on = max(ended) + model("^^", x), max(more)
    first = began + model("^" + letters[-1], "$") >= on + model(letters[-2:], "$")
    out, end = [], n
    for i in range(n - 1, -1, -1):
        if first:
            out.append(letters[i:end])
            end, first = i, bool(ends[i])
        else:
            first = bool(goes[i])
    return out[::-1]


def words_of(text: str) -> set[str]:
    """Distinct stripped tokens of a text, lower-cased, and its runs of single characters."""
    text = text.lower()
    out = {w if w.isalnum() else stripped(w) for w in set(text.split())}
    out.update(x for x in map(re.Match.group, SPACED.finditer(text)) if len(x.split()) > 1 and any(c.isalpha() for c in x))
    return out


class Reader:
    """Terms of a token, with a bounded memo."""

    def __init__(self, chars: CharModel):
        self.chars = chars

    def word(self, token: str) -> str:
        """The reading of a stripped token; that of a run of characters may be several words."""
        if len(token.split()) > 1:
            return unspaced(token, self.chars)
        return restore(token, self.chars) if suspicious(token) else token

    def terms(self, token: str) -> list[set[str]]:
        """Terms of each word of a token: the restored word and its 4-grams.

        A long token is split into words, a run has its own; a 4-gram over their borders goes to the word that it begins in, so all 4-grams are there.
        """
        w = self.word(token)
        if not w:
            return []
        if " " not in w and len(token) <= LONG:
            return [_grams(w)]
        parts = [x for run in LETTERS.finditer(w) for x in ([run.group()] if " " in w else split(run.group(), self.chars))]
        w = w.replace(" ", "")
        out: dict[str, set[str]] = {}
        at = 0
        for x in parts:
            at = w.index(x, at)
            found = out.setdefault(x, _grams(x))
            found.update("#" + w[i : i + 4] for i in range(at, min(at + len(x), len(w) - 3)))
            at += len(x)
        # 4-grams that begin with a sign
        rest = {"#" + w[i : i + 4] for i in range(len(w) - 3) if not LETTERS.match(w[i])}
        return [*out.values(), *([rest] if rest else [])]


def _grams(word: str) -> set[str]:
    x = f"^{word}$"
    return {word, *("#" + x[i : i + 4] for i in range(len(x) - 3))}


def char_counts(df: DataFrame, text_col: str = "text") -> dict[str, int]:
    """Counts of character trigrams in the alphabetic words of all texts, of every kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words: Counter = Counter()
            for t in b.column(0).to_pylist():
                if t:
                    words.update(w for w in map(str.strip, t.lower().split()) if w.isalpha())
            out: Counter = Counter()
            for w, n in words.items():
                x = f"^^{w}$"
                for i in range(len(x) - 2):
                    out[x[i : i + 3]] += n
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([*out]), pa.array([*out.values()], pa.int64())], ["g", "n"])

    rows = df.select(F.col(text_col)).mapInArrow(run, "g string, n long").groupBy("g").agg(F.sum("n").alias("n"))
    return {r["g"]: r["n"] for r in rows.orderBy(F.desc("n"), "g").collect()}


class Toxicity:
    """Character model, weights of terms, and a logistic model over the evidence of a text."""

    def __init__(self, chars: CharModel, odds: dict[str, float], model: np.ndarray):
        self.chars, self.odds, self.model = chars, odds, model

    def evidence(self, text: str | None, memo: dict[str, list[float]], reader: Reader) -> tuple[float, ...]:
        """Sum, largest and number of the positive word odds of a text, damped by its length."""
        total = most = 0.0
        n = many = 0
        for w in words_of(text or ""):
            found = memo.get(w)
            if found is None:
                found = [max((self.odds[t] for t in terms if t in self.odds), default=0.0) for terms in reader.terms(w)] or [0.0]
                if len(w) <= LONG:
                    if len(memo) > 400_000:
                        memo.clear()
                    memo[w] = found
            for got in found:
                n += 1
                if got:
                    total += got
                    many += 1
                    most = max(most, got)
        return (1.0, math.log1p(total), most, math.log1p(many), total / (n + 5))

    def scorer(self):
        memo: dict[str, list[float]] = {}
        reader = Reader(self.chars)
        return lambda text: 1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(self.model, self.evidence(text, memo, reader)))))))


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 4000) -> Toxicity:
    """A model from all texts of df (characters) and the labelled ones (terms).

    df and labels hold what may be learned from; they join on id_col. Rows with a null id, text or label give no label;
    repeated rows count as often as they occur. Term counts cover all labelled rows; all terms with odds of at
    least MIN_ODDS in MIN_DOCS toxic texts and a share MIN_SHARE of them are kept, so the support grows with the labels and
    the kept terms stay below 1 / MIN_SHARE times the mean number of terms of a toxic text. The logistic model is fitted on at
    most 2 * sample rows with the `sample` labels picked by a hash of the id. With no labels, or none of one kind, every score is below 0.5.
    Labelled texts are shuffled once, by the same plan at every size.
    """
    chars = CharModel(char_counts(df, text_col))
    given = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col), F.col(label_col).cast("int").alias("label"))
    texts = df.where(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("text"))
    rows = texts.hint("merge").join(given, id_col).select("text", "label")
    shared = df.sparkSession.sparkContext.broadcast(chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, memo = Reader(shared.value), {}
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            kinds = [*seen[0].keys() | seen[1].keys()]
            out = pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array([seen[1][t] for t in kinds], pa.int64()), pa.array([seen[0][t] for t in kinds], pa.int64())], ["term", "bad", "fine"])
            seen[0].clear()
            seen[1].clear()
            return out

        for b in batches:
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                terms: set[str] = set()
                for w in words_of(text):
                    got = memo.get(w)
                    if got is None:
                        got = reader.terms(w)
                        if len(w) <= LONG:
                            if len(memo) > 100_000:
                                memo.clear()
                            memo[w] = got
                    terms.update(*got)
                seen[int(label == 1)].update(terms)
                seen[int(label == 1)][""] += 1  # the texts themselves
                if len(seen[0]) + len(seen[1]) > 400_000:
                    yield flush()
        yield flush()

    counts = rows.mapInArrow(run, "term string, bad long, fine long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("fine").alias("fine"))
    path = new_path(df.sparkSession, "terms")
    counts.where(F.col("bad") >= MIN_DOCS).write.parquet(path)
    counts = df.sparkSession.read.schema(counts.schema).parquet(path)
    whole = counts.where("term = ''").first()
    model = np.array([-4.0, 0.0, 0.0, 0.0, 0.0])
    if whole is None or not whole["fine"]:
        remove(df.sparkSession, path)
        return Toxicity(chars, {}, model)
    odds = F.log((F.col("bad") + 0.5) / (whole["bad"] + 1)) - F.log((F.col("fine") + 0.5) / (whole["fine"] + 1))
    kept = counts.where("term <> ''").where(F.col("bad") >= MIN_SHARE * whole["bad"]).select("term", odds.alias("odds")).where(F.col("odds") >= MIN_ODDS).orderBy(F.desc("odds"), "term").collect()
    remove(df.sparkSession, path)
    out = Toxicity(chars, {r["term"]: r["odds"] for r in kept}, model)
    picked = given.orderBy(F.xxhash64(id_col, F.lit(5)), id_col, "label").limit(sample)
    held = df.sparkSession.sparkContext.broadcast(out)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, reader = {}, Reader(held.value.chars)
        for b in batches:
            got = [held.value.evidence(t, memo, reader) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.float64())), b.column("label")], ["x", "label"])

    # at most `sample` rows are broadcast, and twice as many come back
    near = texts.join(F.broadcast(picked), id_col).select("text", "label")
    seen = near.mapInArrow(look, "x array<double>, label int").orderBy(F.xxhash64("x", "label")).limit(2 * sample).collect()
    if seen:
        out.model = logistic(np.array([r["x"] for r in seen]), np.array([float(r["label"] == 1) for r in seen]))
    return out


def logistic(x: np.ndarray, y: np.ndarray, decay: float = 0.05) -> np.ndarray:
    """Newton steps for a logistic model; the first column is the constant."""
    w, keep = np.zeros(x.shape[1]), decay * np.eye(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - decay * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(text: str | Column, model) -> Column:
    """double in (0, 1): higher where a toxic label is likelier; model is a broadcast Toxicity. A null or empty text gets the score of one without evidence."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = model.value.scorer()
        for b in batches:
            yield pa.array([f(t) for t in b.to_pylist()], pa.float64())

    return F.arrow_udf(run, "double")(text)


def restored(text: str | Column, model) -> Column:
    """string: the text with its suspicious tokens restored and white space runs as one space; null stays null."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader, memo = Reader(model.value.chars), {}
        for b in batches:
            out = []
            for t in b.to_pylist():
                if t is not None:
                    t = SPACED.sub(lambda m: reader.word(m.group()) if any(c.isalpha() for c in m.group()) else m.group(), t.lower())
                    parts = []
                    for w in t.split():
                        got = memo.get(w)
                        if got is None:
                            got = reader.word(stripped(w)) or w
                            if len(w) <= LONG:
                                if len(memo) > 100_000:
                                    memo.clear()
                                memo[w] = got
                        parts.append(got)
                    t = " ".join(parts)
                out.append(t)
            yield pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(text)


def held_out(id_col: Column, parts: int = 5, part: int = 0) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % parts == part
