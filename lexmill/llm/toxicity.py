"""Toxicity scores after noisy-channel restoration.

The channel writes letters as look-alikes, repeats them, puts separators
between them or spaces a word out. A suspect piece of text becomes a lattice of
what each character may stand for, and Viterbi's algorithm finds the reading
that is likeliest under a character trigram model of the whole corpus, less the
channel's costs. Scores come from the words of both the text and its restored
form: a word or word beginning that goes with label 1 in the training sample has
a probability, and a text's score is the chance that at least one is right.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ._common import bound_batches, cut, discard, map_arrow, table, text_or_empty

#: Labelled rows used to fit the classifier: those with the smallest hashes of their ids, this many at most.
TRAINING_ROWS = 24_000
PREDICT_AT = 0.3
#: Letters of the model; another character is a word's edge, another letter one class.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xDF, 0x100)))
EDGE, OTHER, CLASSES = 0, len(LETTERS) + 1, len(LETTERS) + 2
CLASS = {c: k + 1 for k, c in enumerate(LETTERS)}
#: What a character may stand for (fixed values).
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "*": "aeiouc",
}
SEPARATORS = frozenset("._-*~'`^/\\ \t")
#: Costs of the channel in nats: a look-alike, a dropped separator, a dropped symbol, a letter of a run kept once or twice.
COST = {"lookalike": 0.7, "separator": 0.2, "symbol": 4.0, "once": 0.3, "twice": 0.6, "foreign": 9.0}
WORD = re.compile(r"[^\W\d_]+")
#: What is taken off a chunk's ends: symbols that stand for no letter.
PLAIN_EDGE = ".,;:?\"'[]{}<>&%#-_~`^)"
#: The same with symbols that may stand for one.
ANY_EDGE = PLAIN_EDGE + "".join(c for c in LOOKALIKES if not c.isalnum())
RUN = re.compile(r"([^\W\d_])\1\1+")
MEMORY = 250_000
#: Longer chunks are read anew each time.
REMEMBERED = 64


def trigram_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Counts of character trigrams over all texts: ``gram, n``; counted in each task, summed over tasks."""
    import pyarrow as pa

    def run(batches):
        kinds = np.zeros(0x300, np.int64)
        for c, k in CLASS.items():
            kinds[ord(c)] = k
        kinds[0x100:] = OTHER
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
                k = np.where(codes < 0x300, kinds[np.minimum(codes, 0x2FF)], EDGE)
                k = np.concatenate(([EDGE], k))
                total += np.bincount((k[:-2] * CLASSES + k[1:-1]) * CLASSES + k[2:], minlength=CLASSES**3) if len(k) > 4096 else 0
                if len(k) <= 4096:
                    np.add.at(total, (k[:-2] * CLASSES + k[1:-1]) * CLASSES + k[2:], 1)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])

    bound_batches(df.sparkSession)
    counted = df.select(text_or_empty(text_col).alias("t")).mapInArrow(run, "gram int, n bigint")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


class CharModel:
    """Interpolated character trigram model; its size is fixed by the alphabet."""

    def __init__(self, grams: list[tuple[int, int]]):
        n = np.zeros(CLASSES**3)
        for g, count in grams:
            n[g] = count
        n = n.reshape(CLASSES, CLASSES, CLASSES)
        two, one = n.sum(0), n.sum((0, 1))
        p1 = (one + 1) / (one.sum() + CLASSES)
        p2 = (two + 20 * p1) / (two.sum(1, keepdims=True) + 20)
        p3 = (n + 20 * p2[None]) / (n.sum(2, keepdims=True) + 20)
        self.cost = (-np.log(p3)).astype(np.float32)
        self._flat: list[float] | None = None

    def costs(self) -> list[float]:
        """Cost of letter c after a and b at ``(a * CLASSES + b) * CLASSES + c``; made once a process."""
        if self._flat is None:
            self._flat = self.cost.ravel().tolist()
        return self._flat

    def __getstate__(self):
        return {"cost": self.cost, "_flat": None}


class _Kinds(dict):
    """The class of each character, kept once it was asked for."""

    def __missing__(self, c: str) -> int:
        self[c] = k = CLASS.get(c, OTHER if c.isalpha() else EDGE)
        return k


KINDS = _Kinds()


def kind(c: str) -> int:
    return KINDS[c]


def lattice(piece: str) -> list[list[tuple[str, float]]]:
    """What each character, or run of one letter, may stand for, with the channel's cost."""
    out, i = [], 0
    while i < len(piece):
        c, j = piece[i], i + 1
        while j < len(piece) and piece[j] == c:
            j += 1
        if c.isalpha():
            n, end = j - i, j  # a run goes on through separators
            while True:
                k = end
                while k < len(piece) and piece[k] in SEPARATORS:
                    k += 1
                if k == end or k == len(piece) or piece[k] != c:
                    break
                while k < len(piece) and piece[k] == c:
                    k, n = k + 1, n + 1
                end = k
            if n >= 3:
                j = end
            out.append([(c * (j - i), 0.0)] if n < 3 else [(c, COST["once"]), (c * 2, COST["twice"])])
        else:
            may = [(x, COST["lookalike"] + (1.0 if c == "*" else 0.0)) for x in LOOKALIKES.get(c, "")]
            if c in SEPARATORS:
                may.append(("", COST["separator"]))
            elif not c.isdigit():
                may.append(("", COST["symbol"]))
            may.append((" ", COST["foreign"]))
            out += [may] * (j - i) if c not in SEPARATORS or c == "*" else [may]
        i = j
    return out


#: Steps after which the readings' common beginning is settled, so a long piece keeps no more than it must.
SETTLE = 256


def restore(piece: str, model: CharModel) -> str:
    """The likeliest reading of a piece, whatever its length.

    States hold the last two letters as one number; of equal readings the one from the
    smallest state, then symbol, is taken. Time is in proportion to the length.
    What all surviving readings share is settled on the way.
    """
    best, price, kinds, square = {EDGE * CLASSES + EDGE: 0.0}, model.costs(), KINDS, CLASSES * CLASSES
    back: list[dict] = []
    settled: list[str] = []

    def trace(state, steps: list[dict]) -> str:
        out = []
        for step in reversed(steps):
            state, x = step[state]
            out.append(x)
        return "".join(reversed(out))

    for may in [*lattice(piece), [(" ", 0.0)]]:
        if len(may) == 1 and len(best) == 1:  # no choice: the cost is the same for all readings
            ((state, cost),) = best.items()
            x = may[0][0]
            if back:  # one reading is left: what led to it is settled
                settled.append(trace(state, back))
                back = []
            settled.append(x)
            for c in x[-2:]:
                state = (state * CLASSES + kinds[c]) % square
            best = {state: cost}
            continue
        new: dict[int, float] = {}
        step: dict[int, tuple[int, str]] = {}
        options = [(x, extra, [kinds[c] for c in x]) for x, extra in may]
        for state, cost in best.items():
            for x, extra, letters in options:
                to, total = state, cost + extra
                for k in letters:
                    at = to * CLASSES + k
                    total += price[at]
                    to = at % square
                known = new.get(to)
                if known is None or total < known or (total == known and (state, x) < step[to]):
                    new[to], step[to] = total, (state, x)
        best = new
        back.append(step)
        if len(back) >= SETTLE and len(back) % SETTLE == 0:
            alive, k = set(best), len(back)
            while len(alive) > 1:
                k -= 1
                alive = {back[k][s][0] for s in alive}
            settled.append(trace(alive.pop(), back[:k]))
            back = back[k:]
    return ("".join(settled) + trace(min(best, key=lambda s: (best[s], s)), back)).strip()


def disguised(core: str) -> bool:
    """If a core without white space may be disguised: a letter together with any other character, or a run of one letter."""
    if len(core) < 3:
        return False
    return bool(RUN.search(core)) if core.isalpha() else any(map(str.isalpha, core))


def pieces(chunk: str) -> list[str]:
    """The parts of a chunk without white space that are decoded, of any length.

    All of it with the look-alikes at its ends and without them, and what each
    kind of separator in it parts.
    """
    core = chunk.strip(PLAIN_EDGE)
    if not disguised(core):
        return []
    found = {core: None}
    if disguised(inner := core.strip(ANY_EDGE)):
        found[inner] = None
    for c in sorted(SEPARATORS.intersection(core)):
        found.update((part, None) for x in core.split(c) if disguised(part := x.strip(PLAIN_EDGE)))
    return list(found)


def features(words: list[str]) -> set[str]:
    """A word, and its beginnings of 4 to 8 letters."""
    out = set()
    for w in words:
        if len(w) >= 3:
            out.add(w)
            out.update("^" + w[:n] for n in range(4, 9) if len(w) >= n)
    return out


class Reader:
    """Words of chunks, plain and restored, remembered up to a bound."""

    def __init__(self, model: CharModel):
        self.model, self.known = model, {}

    def words(self, chunk: str) -> list[str]:
        if chunk.isalpha() and not RUN.search(chunk):
            return [chunk]
        found = WORD.findall(chunk)
        for piece in pieces(chunk):
            found += WORD.findall(restore(piece, self.model))
        return found

    def spaced(self, chunks: list[str]) -> list[str]:
        """Words of three or more characters that stand alone one after the other, with white space of any kind and length between."""
        sizes = list(map(len, chunks))
        if sizes.count(1) < 3:
            return []
        out, alone = [], [k for k, n in enumerate(sizes) if n == 1]
        at = 0
        while at + 2 < len(alone):
            end = at + 1
            while end < len(alone) and alone[end] == alone[end - 1] + 1:
                end += 1
            if end - at >= 3:
                out += WORD.findall(restore(" ".join(chunks[alone[at] : alone[end - 1] + 1]), self.model))
            at = end
        return out

    def features(self, text: str) -> set[str]:
        chunks = text.lower().split()
        out = features(self.spaced(chunks))
        for chunk in set(chunks):
            if (f := self.known.get(chunk)) is None:
                if len(self.known) > MEMORY // 8:
                    self.known.clear()
                f = features(self.words(chunk))
                if len(chunk) <= REMEMBERED:
                    self.known[chunk] = f
            out |= f
        return out


@dataclass
class Model:
    """The character model and each feature's probability of label 1. Its size is bounded by the alphabet and the training sample."""

    chars: CharModel
    weights: dict[str, float] = field(default_factory=dict)

    def scorer(self):
        reader, known, weights = Reader(self.chars), {}, self.weights
        starts = {f[1:5] for f in weights if f[0] == "^"}

        def rest(words: list[str]) -> float:
            words = [w for w in words if w in weights or w[:4] in starts]  # the others have no weight
            if not words:
                return 0.0
            most = max((weights.get(f, 0.0) for f in features(words)), default=0.0)
            return math.log1p(-min(most, 0.999))

        def score(text: str) -> float:
            chunks = text.lower().split()
            total = math.fsum(rest([w]) for w in reader.spaced(chunks))
            different = set(chunks)
            if new := different.difference(known):
                if len(known) > MEMORY:
                    known.clear()
                    new = different
                made = {c: rest(reader.words(c)) for c in new}
                known.update((c, x) for c, x in made.items() if len(c) <= REMEMBERED)
                total += math.fsum([*made.values(), *map(known.__getitem__, different.difference(made))])
            else:
                total += math.fsum(map(known.__getitem__, different))
            return 1.0 - math.exp(total) if total else 0.0

        return score


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit the character model on all texts and the classifier on at most ``rows`` labelled ones.

    Labels of held-out ids, null ids and null labels aren't read. Of texts with
    one id the first in order is fitted. Without any label 1 every score is 0.
    """
    spark = docs.sparkSession
    chars = CharModel([(r.gram, r.n) for r in trigram_counts(docs, text_col).collect()])
    named = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & ~held_out(id_col))
    one = named.groupBy(F.col(id_col).alias("i")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    chosen = one.orderBy(F.xxhash64("i"), "i").limit(rows)
    texts = docs.select(F.col(id_col).alias("i"), text_or_empty(text_col).alias("t"))
    sample = cut(texts.join(F.broadcast(chosen), "i").groupBy("i", "y").agg(F.min("t").alias("t")))
    n = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    ones, zeros = sum(v for k, v in n.items() if k == 1), sum(v for k, v in n.items() if k != 1)
    if not ones:
        discard(sample)
        return Model(chars)
    shared = spark.sparkContext.broadcast(chars)

    def positives():
        reader = Reader(shared.value)

        def step(columns):
            names, sketches = [], []
            for text in columns[0]:
                found = reader.features(text)
                # Copies have one sketch mostly, so a passage's words don't count for each of them.
                sketch = min((zlib.crc32(c.encode("utf-8", "surrogatepass")) for c in set(text.split())), default=0)
                names += found
                sketches += [sketch] * len(found)
            return names, sketches

        return step

    seen = map_arrow(sample.where("y = 1"), [F.col("t")], "f string, sketch bigint", positives)
    counted = seen.groupBy("f").agg(F.count("*").alias("n"), F.count_distinct("sketch").alias("d")).where("d >= 4").collect()
    wanted = spark.sparkContext.broadcast({r.f for r in counted})

    def negatives():
        reader = Reader(shared.value)

        def step(columns):
            c = Counter(f for text in columns[0] for f in reader.features(text) & wanted.value)
            return list(c), list(c.values())

        return step

    against = map_arrow(sample.where("y <> 1"), [F.col("t")], "f string, n bigint", negatives)
    zero = {r.f: r.n for r in against.groupBy("f").agg(F.sum("n").alias("n")).collect()}
    discard(sample)
    base, weights = ones / (ones + zeros), {}
    least = math.log(len(counted) + 1) + 2
    for r in counted:
        n0 = zero.get(r.f, 0)
        total = r.d + n0
        p = (r.d + 4 * base) / (total + 4)
        gain = r.d * math.log(r.d / (total * base)) + (n0 * math.log(n0 / (total * (1 - base))) if n0 and base < 1 else 0)
        if p >= 0.5 and gain >= least:
            weights[r.f] = p
    return Model(chars, weights)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for each row of the input; null and empty texts score 0, rows and null ids stay."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def start():
        f = shared.value.scorer()
        return lambda columns: (columns[0], [f(t) for t in columns[1]])

    return map_arrow(df, [F.col(id_col).cast("bigint"), text_or_empty(text_col)], "doc_id bigint, score double", start)


def keep_clean(docs: DataFrame, labels: DataFrame, text_col: str = "text", at: float = PREDICT_AT) -> DataFrame:
    """The rows of ``docs`` that score under ``at``; all columns stay as they are, and null texts stay."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text_col=text_col))

    @pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return texts.map(_scorer(shared)).astype("float64")

    bound_batches(docs.sparkSession)
    return docs.where(scored(text_or_empty(text_col)) < at)


_made: list = []


def _scorer(model):
    """Made once a worker process; the last one is kept, with the model it stands for."""
    if not _made or _made[0] is not model:
        _made[:] = [model, model.value.scorer()]
    return _made[1]


def query(spark, sf_dir):
    """Every document's score; labels of held-out documents aren't used."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
