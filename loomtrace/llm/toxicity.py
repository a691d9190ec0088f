"""Toxicity of texts behind a noisy channel.

Writers hide words by look-alike signs, by spacing letters out and by repeating them. Suspicious tokens and runs of
single signs are read as lattices: each sign offers letters it may stand for, a word boundary or nothing, each at a
cost. Viterbi decoding under a character language model, 4-grams of letters counted over all documents, restores the
likeliest text. Restored words and the words as written are then scored by weights learned from labelled rows.

Labels are read from a bounded sample of labelled rows, ``sample``; the language model counts every document.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, spool

#: Symbols of the language model: 0 a word boundary, 1 to 26 the letters, 27 any other letter's byte.
SYMBOLS = 28
OTHER = 27
ORDER = 4
_SHIFT = 5
_STATE = (1 << _SHIFT * (ORDER - 1)) - 1
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SYMBOL = np.array([OTHER if c >= 128 else c - 96 if 97 <= c <= 122 else 0 for c in range(256)], np.uint32)

# Signs and the letters they may stand for.
LOOKALIKES = {
    "0": "o",
    "1": "il",
    "2": "z",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "bg",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "il",
    "|": "il",
    "+": "t",
    "(": "c",
    "<": "c",
    "€": "e",
    "£": "l",
    "¡": "i",
    "*": "abcdefghijklmnopqrstuvwxyz",
    "#": "abcdefghijklmnopqrstuvwxyz",
    "ı": "i",
    "а": "a",
    "е": "e",
    "о": "o",
    "р": "p",
    "с": "c",
    "х": "x",
    "у": "y",
    "і": "i",
    "ѕ": "s",
}

# Costs of the channel, in nats.
_SUBSTITUTE = 1.0
_MASK = 2.5
_AS_BOUNDARY = 2.0
_DROP_SIGN = 4.0
_DROP_SEPARATOR = 0.1
_KEEP_SEPARATOR = 2.5
#: White space between pieces of several letters: dropped, kept.
_GAP_OF_PIECES = (2.5, 0.0)
_DROP_REPEAT = {2: 2.0, 3: 0.3}
_KEEP_REPEAT = {2: 0.0, 3: 1.5}
#: States times options of a step that are looked at one by one; more are taken as arrays.
_FEW = 150

_EDGE = ".,;:?!\"'()[]{}&%#*$~`-_/\\<>=+|"
_SIGNS = frozenset(LOOKALIKES)
_REPEATED = re.compile(r"([a-z])\1")
#: Runs of three or more single signs, each parted from the next by white space.
_SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
_GAP = re.compile(r"[\s._\-~/]+")


def folded(text: str) -> list[bytes]:
    """Lower-case words of a text: runs of ASCII letters and bytes of longer characters."""
    return text.lower().encode("utf-8", "replace").translate(_FOLD).split()


def gram_counts(text: str) -> np.ndarray:
    """Ids of the 4-grams of symbols of a text, words set apart by one boundary."""
    data = np.frombuffer(b"   " + b" ".join(folded(text)) + b" ", np.uint8)
    s = _SYMBOL[data]
    return (s[:-3] << 15) | (s[1:-2] << 10) | (s[2:-1] << 5) | s[3:]


def language_model(docs: DataFrame) -> np.ndarray:
    """Negative log-probabilities of a symbol after three others (index: 5 bits for each), from all texts.

    Each order is smoothed by the one below. Null texts count nothing.
    """

    def counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << _SHIFT * ORDER, np.int64)
        waiting, size = [], 0
        for b in it:
            for t in b.column("text"):
                if t.is_valid:
                    waiting.append(gram_counts(t.as_py()))
                    size += waiting[-1].size
                    if size > 4_000_000:
                        total += np.bincount(np.concatenate(waiting), minlength=total.size)
                        waiting, size = [], 0
        if waiting:
            total += np.bincount(np.concatenate(waiting), minlength=total.size)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(total[ids])], ["gram", "n"])

    found = docs.select("text").mapInArrow(counts, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # 28^4 rows at most
    n = np.zeros(1 << _SHIFT * ORDER)
    n[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    n = n.reshape((1 << _SHIFT,) * ORDER)
    p = np.zeros(1 << _SHIFT)
    p[:SYMBOLS] = 1 / SYMBOLS
    for order in range(1, ORDER + 1):
        c = n.sum(axis=tuple(range(ORDER - order)))
        smooth = 5.0 if order > 1 else 1.0
        p = (c + smooth * p) / (c.sum(axis=-1, keepdims=True) + smooth)
    return -np.log(np.maximum(p, 1e-12)).ravel().astype(np.float32)


def _lattice(token: str, native: bool = False, gap: tuple[float, float] = (_DROP_SEPARATOR, _KEEP_SEPARATOR)) -> list[tuple[tuple[int | None, float], ...]]:
    """For each sign of a token, what it may stand for: (symbol, or None for nothing; cost).

    Bytes of other letters stand for themselves; the model knows them as ``OTHER``. So do
    letters that look like ASCII ones where the token is read in its ``native`` script. ``gap`` has the costs of
    dropping and of keeping a separator.
    """
    out: list[tuple[tuple[int | None, float], ...]] = []
    previous, run = "", 0
    for ch in token:
        run = run + 1 if ch == previous else 1
        previous = ch
        if "a" <= ch <= "z":
            s = ord(ch) - 96
            if run == 1:
                out.append(((s, 0.0),))
            else:
                k = min(run, 3)
                out.append(((s, _KEEP_REPEAT[k]), (None, _DROP_REPEAT[k])))
        elif ch in _SIGNS and not (native and ch.isalpha()):
            letters = LOOKALIKES[ch]
            cost = _MASK if len(letters) > 5 else _SUBSTITUTE
            repeat = ((None, _DROP_REPEAT[3]),) if run > 1 else ()
            out.append((*((ord(x) - 96, cost) for x in letters), (0, _AS_BOUNDARY), (None, _DROP_SIGN), *repeat))
        elif ch.isspace() or not ch.isalnum():
            out.append(((None, gap[0]), (0, gap[1])))
        else:
            out += [((byte, 0.0),) for byte in ch.encode("utf-8", "replace")]
    return out


_Step = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _step(states: np.ndarray, costs: np.ndarray, options: list | tuple, model: np.ndarray) -> _Step:
    """All states after one sign with the least cost of each: (states, costs, place of the state before, symbol or -1)."""
    to, cost, before, symbols = [], [], [], []
    every = np.arange(states.size)
    for symbol, extra in options:
        stays = np.full(states.size, symbol is None) if symbol != 0 else states & 31 == 0
        gram = (states << _SHIFT) | min(symbol or 0, OTHER)
        to.append(np.where(stays, states, gram & _STATE))
        cost.append(costs + extra + np.where(stays, 0.0, model[gram]))
        before.append(every)
        symbols.append(np.where(stays, -1, symbol or 0))
    to_, cost_ = np.concatenate(to), np.concatenate(cost)
    least = np.full(_STATE + 1, np.inf)
    np.minimum.at(least, to_, cost_)
    won = np.flatnonzero(cost_ == least[to_])
    after, first = np.unique(to_[won], return_index=True)
    won = won[first]
    return after, cost_[won], np.concatenate(before)[won], np.concatenate(symbols)[won]


def restore(token: str, model: np.ndarray) -> list[bytes]:
    """The likeliest words behind a lower-case token or spaced run, by exact Viterbi decoding over all states.

    A token with letters of another script that look like ASCII ones is read both ways.
    """
    words = _decoded(_lattice(token), model)
    if any(c in _SIGNS and c.isalpha() for c in token):
        words += _decoded(_lattice(token, native=True), model)
    return words


def _decoded(lattice: list, model: np.ndarray) -> list[bytes]:
    states, costs = [0], [0.0]
    steps: list[tuple] = []
    for options in [*lattice, ((0, 0.0),)]:
        if len(states) * len(options) > _FEW:
            after, c, before, symbols = _step(np.array(states), np.array(costs), options, model)
            states, costs = after.tolist(), c.tolist()
            steps.append((before, symbols))
            continue
        place: dict[int, int] = {}
        to_, cost_, before_, symbols_ = [], [], [], []
        for i, (state, cost) in enumerate(zip(states, costs, strict=True)):
            for symbol, extra in options:
                c = cost + extra
                if symbol is None or symbol == 0 and not state & 31:
                    to, written = state, -1
                else:
                    gram = (state << _SHIFT) | (symbol if symbol < OTHER else OTHER)
                    c += float(model[gram])
                    to, written = gram & _STATE, symbol
                at = place.get(to)
                if at is None:
                    place[to] = len(to_)
                    to_.append(to)
                    cost_.append(c)
                    before_.append(i)
                    symbols_.append(written)
                elif c < cost_[at]:
                    cost_[at], before_[at], symbols_[at] = c, i, written
        states, costs = to_, cost_
        steps.append((before_, symbols_))
    at = min(range(len(costs)), key=costs.__getitem__)
    symbols = []
    for before, written in reversed(steps):
        if written[at] >= 0:
            symbols.append(int(written[at]))
        at = before[at]
    return bytes(s if s > OTHER else 96 + s if s else 32 for s in reversed(symbols)).split()


def suspicious(token: str) -> str:
    """The part of a lower-case token worth decoding, or an empty string.

    Any token with a sign among its letters or a doubled letter is; so are four signs or more without a letter.
    """
    core = token.strip(_EDGE)
    if core.isalpha() and core.isascii():
        inner = core if _REPEATED.search(core) else ""
        # A sign at the edge may be a letter, unless it comes in a run, as ornament.
        edge = token.strip(".,;:?\"'")
        return inner or (edge if len(edge) == len(core) + 1 and any(c in _SIGNS and c not in "!*#" for c in (edge[0], edge[-1])) else "")
    if not core:
        return ""
    edge = token.strip(".,;:?\"'&%~`-_/\\")
    if len(edge) > len(core) + 2:
        edge = core
    if any(c in _SIGNS for c in core) and (any(c.isalpha() for c in core) or sum(c in _SIGNS for c in core) >= 4):
        return edge
    return core if _REPEATED.search(core) or not core.isalpha() and any(c.isalpha() for c in core) else ""


def hidden_words(text: str, tokens: list[str], model: np.ndarray, memo: dict[str, tuple[bytes, ...]]) -> Iterator[bytes]:
    """Words restored from spaced runs of a lower-case text whose tokens are given, each as often as it occurs."""
    if sum(len(t) == 1 for t in tokens) >= 3:
        for m in _SPACED.finditer(text):
            run = _GAP.sub(" ", m[0])
            words = memo.get(run)
            if words is None:
                words = memo[run] = tuple(restore(run, model))
            yield from words


def words_of(text: str, model: np.ndarray, memo: dict[str, tuple[bytes, ...]]) -> set[bytes]:
    """Words of a whole text, as written and as restored. ``memo`` keeps those of each token."""
    text = text.lower()
    tokens = text.split()
    if len(memo) > 400_000:
        memo.clear()
    out: set[bytes] = set()
    for t in set(tokens):
        ws = memo.get(t)
        if ws is None:
            ws = folded(t)
            part = suspicious(t)
            ws = memo[t] = tuple({*ws, *restore(part, model)}) if part else tuple(ws)
        out.update(ws)
    out.update(hidden_words(text, tokens, model, memo))
    return out


_DOUBLE = re.compile(rb"(.)\1+")


def squeezed(word: bytes) -> bytes:
    """A word with each run of a letter cut to one."""
    return _DOUBLE.sub(rb"\1", word)


@dataclass
class Scorer:
    """Weights of words, and the logistic curve over a text's features.

    A restored word that has no weight is looked up once more without doubled letters, which the channel hides.
    """

    model: np.ndarray
    weights: dict[bytes, float] = field(default_factory=dict)
    curve: np.ndarray = field(default_factory=lambda: np.array([-3.0, 0.0, 0.0, 0.0]))
    plain: dict[bytes, bytes] = field(default_factory=dict)

    def in_pieces(self, text: str) -> set[bytes]:
        """Weighted words that a lower-case text writes in two or three pieces, where the decoder reads them as one."""
        ws = folded(text)
        twos = list(map(add, ws, ws[1:]))
        hits = (self.weights.keys() & set(twos)) | (self.weights.keys() & set(map(add, twos, ws[2:])))
        out: set[bytes] = set()
        for w in hits:
            for i in range(len(ws) - 1):
                if w.startswith(ws[i]) and ws[i] != w:
                    pieces = next((ws[i : i + n] for n in (2, 3) if b"".join(ws[i : i + n]) == w), None)
                    if pieces and w in _decoded(_lattice(b" ".join(pieces).decode("utf-8", "replace"), gap=_GAP_OF_PIECES), self.model):
                        out.add(w)
                        break
        return out

    def restored(self, words: tuple[bytes, ...] | list[bytes]) -> list[tuple[bytes, float]]:
        """Restored words that have a weight."""
        if not self.plain:
            self.plain = {squeezed(w): w for w in sorted(self.weights, key=lambda w: (self.weights[w], w))}
        known = (w if w in self.weights else self.plain.get(squeezed(w)) for w in words)
        return [(w, self.weights[w]) for w in known if w is not None]

    @staticmethod
    def features(weights: list[float]) -> tuple[float, float, float]:
        """The greatest weight, the mean of the three greatest and the count of words, levelled."""
        top = sorted(weights, reverse=True)[:3]
        return (top[0] if top else 0.0, sum(top) / 3, math.log1p(len(weights)))

    def probability(self, weights: list[float]) -> float:
        x = self.features(weights)
        z = self.curve[0] + sum(a * b for a, b in zip(self.curve[1:], x, strict=True))
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))

    def score(self, text: str | None, memo: dict[str, tuple[tuple[bytes, float], ...]], spaced: dict[str, tuple[bytes, ...]]) -> float:
        """The score of a whole text; null counts as empty. ``memo`` keeps each token's weighted words."""
        text = (text or "").lower()
        tokens = text.split()
        if len(memo) > 1_000_000:
            memo.clear()
        if len(spaced) > 100_000:
            spaced.clear()
        found: dict[bytes, float] = {}
        for t in set(tokens):
            hit = memo.get(t)
            if hit is None:
                written = folded(t)
                hit = [(w, self.weights[w]) for w in written if w in self.weights]
                if (not hit or len(hit) < len(written)) and (part := suspicious(t)):
                    hit += self.restored(restore(part, self.model))
                hit = memo[t] = tuple(hit)
            if hit:
                found.update(hit)
        found.update(self.restored(list(hidden_words(text, tokens, self.model, spaced))))
        found.update((w, self.weights[w]) for w in self.in_pieces(text) - found.keys())
        return self.probability(list(found.values()))


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps, with an intercept first."""
    a = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(a.shape[1])
    penalty = ridge * len(a) * np.eye(a.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + penalty + 1e-9 * np.eye(a.shape[1])
        step = np.linalg.solve(h, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, sample: int = 20_000, fold: int = 0, of: int = 5) -> Scorer:
    """A scorer from the ``toxic`` labels of documents outside the held-out fold.

    At most ``sample`` labelled documents are read, in the order of a hash of their id; of equal texts one counts. One
    half of them gives the words' weights (log-odds of being in a toxic text), the other the curve. Nulls in ids,
    labels or texts leave a row out; of several labels for one document or one text the greatest counts. Without labels
    of both kinds, every text gets the same score.
    """
    model = language_model(docs)
    known = labels.where("doc_id is not null and toxic is not null").where(crc_of_id("doc_id") % of != fold)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    spark = docs.sparkSession
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toArrow()  # rows: sample
    if not chosen.num_rows:
        return Scorer(model)
    chosen = spark.createDataFrame(chosen)
    sent = spark.sparkContext.broadcast(model)

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[bytes, ...]] = {}
        for b in it:
            ws = [[w.decode("utf-8", "replace") for w in words_of(t.as_py(), sent.value, memo)] for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("toxic"), pa.array(ws, pa.list_(pa.string()))], ["h", "toxic", "words"])

    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    read_ = rows.select(F.xxhash64("text").alias("h"), F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(read, "h long, toxic int, words array<string>")
    kept = spool(read_.groupBy("h").agg(F.max("toxic").alias("toxic"), F.first("words").alias("words"))).withColumn("half", F.pmod(F.hash("h"), F.lit(2)))
    sizes = {(r.half, r.toxic): r.n for r in kept.groupBy("half", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get((0, 1), 0), sizes.get((0, 0), 0)
    if not n1 or not n0:
        return Scorer(model)
    least = max(1, min(5, n1 // 10))
    each = kept.where("half = 0").select("toxic", F.explode("words").alias("word"))
    odds = (
        each.groupBy("word")
        .agg(F.sum("toxic").alias("c1"), F.sum(1 - F.col("toxic")).alias("c0"))
        .where(F.col("c1") >= least)
        .withColumn("weight", F.log((F.col("c1") + 0.5) / (n1 + 1)) - F.log((F.col("c0") + 0.5) / (n0 + 1)))
        .where("weight > 1.0")
    )
    best = odds.select("word", "weight").toArrow().sort_by([("weight", "descending"), ("word", "ascending")])  # bounded by the sample's texts
    weights = dict(zip((w.encode() for w in best.column("word").to_pylist()), best.column("weight").to_pylist(), strict=True))
    lexicon = spark.createDataFrame(best) if best.num_rows else spark.createDataFrame([], "word string, weight double")
    hits = kept.where("half = 1").select("h", F.explode("words").alias("word")).join(F.broadcast(lexicon), "word").groupBy("h").agg(F.collect_list("weight").alias("ws"))
    seen = kept.where("half = 1").select("h", "toxic").join(hits, "h", "left").select("h", "toxic", F.coalesce("ws", F.array().cast("array<double>")).alias("ws")).toArrow().sort_by("h")  # rows: sample
    x = np.array([Scorer.features(ws) for ws in seen.column("ws").to_pylist()]).reshape(-1, 3)
    y = seen.column("toxic").to_numpy().astype(float)
    out = Scorer(model, weights)
    if 0 < y.sum() < len(y):
        out.curve = fit_curve(x, y)
    return out


def score(docs: DataFrame, scorer: Scorer, column: str = "score") -> DataFrame:
    """``docs`` with the probability that its ``text`` is toxic, from the whole text alone.

    Null and empty texts get the score of a text without any weighted word. Rows may repeat, other columns may be
    null, and an empty table gives no rows. A column of the same name is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(scorer)  # bounded: the model's table and the sample's words

    @F.pandas_udf("double")
    def judged(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo: dict = {}
        spaced: dict = {}
        for texts in it:
            yield pd.Series([sent.value.score(t, memo, spaced) for t in texts], dtype="float64")

    return docs.withColumn(column, judged("text"))
