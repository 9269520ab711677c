"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five small transducers read a clause as a string of word classes: insults (whose words are a match), threats (whose words wait
for a target behind them: "I will kill you", but not "to kill time"), targets, negation (a word and the SCOPE words after it)
and reported speech, which a colon or quotation mark doesn't end. Each is a transition table with weights on its arcs; they are
composed once into one automaton, whose states are tuples of theirs and whose arcs carry the product of theirs: a match counts
nothing behind a negation, a REPORTED share in reported speech, and ADDRESSED times behind a target. What it writes on a match is
its kind: plain, addressed, negated, reported or threat. Insults are weighted stems learned from labels, the others fixed words.
A document's score is a logistic combination of its matches by kind and of their weights, not of words as such.

Stems and the combination are learned from at most SAMPLE documents of label 1 and OTHERS of label 0 (least hash of doc_id
first) outside the held-out fold: stems are whole words or prefixes of 3 to 8 letters, kept if documents that have them in a clause
without a negation or a report are labelled toxic far more often than the sample (log-likelihood gain of at least GAIN, share of
at least PURE). Words are what
stands between ASCII other than letters, the signs of Latin-1 and general or CJK punctuation, in lower case, in any script.

Defined results: null and empty texts match nothing; without labelled rows of both kinds there are no stems and the score is
the share of label 1 (0 without any); equal rows and rows that share a doc_id are one document (see
exchange.unique_documents); an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .exchange import rows, ship, unique_documents
from .quality_classifier import fold, sample_ids, sigmoid
from .substring_dedup import _columns

SAMPLE, OTHERS, GAIN, PURE = 3000, 9000, 12.0, 0.9
#: Weights of arcs: matches in reported speech, and behind a target; behind a negation they count nothing.
REPORTED, ADDRESSED = 0.25, 1.5
#: Words of the fixed transducers; fixed values.
THREATS = "kill hurt destroy shoot stab murder strangle beat burn hang tue töten matar".split()
TARGETS = "you your yours he him she her they them these those this that du ihr sie dich tu toi vous usted ustedes".split()
NEGATIONS = "not no never neither nor without nicht kein nie pas jamais nunca jamás".split()
REPORTS = "said says say wrote writes claimed claims quoted quotes reported called sagte schrieb dit dijo".split()
SCOPE = 3
KINDS = ("plain", "addressed", "negated", "reported", "threat")
#: Word classes; STOP ends a clause.
OTHER, STOP, INSULT, THREAT, TARGET, NEGATION, REPORT = range(7)
CLASSES = 7
LETTER = np.ones(256, dtype=bool)
LETTER[97:123] = False
LETTER[128:] = False
ENDS = np.zeros(256, dtype=bool)
ENDS[list(b".!?;\n|")] = True
#: What parts words, for lower-case texts on the JVM; spaced() does the same on bytes.
PARTS = r"[\x00-\x60\x7B-\x7F\u0080-\u00BF\u2000-\u207F\u3000-\u303F]+"


def spaced(blob: np.ndarray) -> np.ndarray:
    """The bytes with the signs of Latin-1 and general and CJK punctuation (two and three bytes in UTF-8) as spaces."""
    out = blob.copy()
    two = np.flatnonzero(blob == 0xC2)
    for k in range(2):
        out[np.minimum(two + k, len(out) - 1)] = 0x20
    first = np.flatnonzero((blob[:-2] == 0xE2) & ((blob[1:-1] == 0x80) | (blob[1:-1] == 0x81)) | (blob[:-2] == 0xE3) & (blob[1:-1] == 0x80)) if len(blob) > 2 else two[:0]
    for k in range(3):
        out[first + k] = 0x20
    return out


class Transducer:
    """A transition table: step[state, class] is the next state, weight[state, class] what the arc multiplies a match by; the clause
    starts in state 0."""

    def __init__(self, states: int, step, weight=lambda s, c: 1.0):
        self.states = states
        self.step = np.array([[0 if c == STOP else step(s, c) for c in range(CLASSES)] for s in range(states)])
        self.weight = np.array([[weight(s, c) for c in range(CLASSES)] for s in range(states)], dtype=float)

    def compose(self, other: Transducer) -> Transducer:
        """Both on the same string: states are pairs, numbered row by row, and weights multiply."""
        out = Transducer(self.states * other.states, lambda s, c: 0)
        out.step = (self.step[:, None, :] * other.states + other.step[None, :, :]).reshape(out.states, CLASSES)
        out.weight = (self.weight[:, None, :] * other.weight[None, :, :]).reshape(out.states, CLASSES)
        return out


def automaton() -> tuple[list[list[int]], list[list[int]], list[list[float]]]:
    """The composed table; the kind (index in KINDS, or -1) that it writes on each class in each state; the weights of its arcs."""
    target = Transducer(2, lambda s, c: int(s or c == TARGET), lambda s, c: ADDRESSED if s and c == INSULT else 1.0)
    report = Transducer(2, lambda s, c: int(s or c == REPORT), lambda s, c: REPORTED if s else 1.0)
    negation = Transducer(SCOPE + 1, lambda s, c: SCOPE if c == NEGATION else max(s - 1, 0), lambda s, c: 0.0 if s else 1.0)
    insult = Transducer(1, lambda s, c: 0, lambda s, c: float(c in (INSULT, TARGET)))
    threat = Transducer(2, lambda s, c: int(c == THREAT or s and c != TARGET), lambda s, c: float(c == INSULT or s and c == TARGET))
    parts = (target, report, negation, insult, threat)
    whole = parts[0]
    for x in parts[1:]:
        whole = whole.compose(x)
    state = np.stack(np.unravel_index(np.arange(whole.states), [x.states for x in parts]))
    write = np.full((whole.states, CLASSES), -1)
    for s, (addressed, reported, negated, _, waiting) in enumerate(state.T):
        for c in (INSULT, *([TARGET] if waiting else [])):
            kind = "negated" if negated else "reported" if reported else "threat" if c == TARGET else "addressed" if addressed else "plain"
            write[s, c] = KINDS.index(kind)
    return whole.step.tolist(), write.tolist(), whole.weight.tolist()


def lowered(blob: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1 (in UTF-8) in lower case."""
    out = K.LOWER[blob]
    if len(blob) > 1:
        second = (blob[:-1] == 0xC3) & (blob[1:] >= 0x80) & (blob[1:] <= 0x9E) & (blob[1:] != 0x97)
        out[1:][second] += 0x20
    return out


def word_key(text: str) -> int:
    own = np.frombuffer(text.encode(), np.uint8)
    return int(K.words_hash(own, np.array([0]), np.array([len(own)]))[0])


class Grammar:
    """Word classes by hash, and the composed automaton over a clause."""

    def __init__(self, stems: list[tuple[str, float]]):
        self.whole: dict[int, tuple[int, float]] = {}
        self.prefix: dict[int, dict[int, float]] = {}
        for kind, own in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)):
            self.whole |= {word_key(x): (kind, 1.0) for x in own}
        for stem, weight in stems:
            if stem.endswith("$"):
                self.whole[word_key(stem[:-1])] = (INSULT, weight)
            else:
                self.prefix.setdefault(len(stem.encode()), {})[word_key(stem)] = weight
        self.keys = np.array(sorted(self.whole), dtype=np.uint64)
        self.prefix_keys = {n: np.array(sorted(x), dtype=np.uint64) for n, x in self.prefix.items()}
        self.step, self.write, self.weight = automaton()

    @staticmethod
    def among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
        if not len(keys) or not len(values):
            return np.zeros(len(values), dtype=bool)
        cells = np.zeros(1 << 16, dtype=bool)
        cells[(keys >> np.uint64(48)).astype(np.int64)] = True
        near = np.flatnonzero(cells[(values >> np.uint64(48)).astype(np.int64)])
        out = np.zeros(len(values), dtype=bool)
        out[near] = keys[np.minimum(np.searchsorted(keys, values[near]), len(keys) - 1)] == values[near]
        return out

    def features(self, blob: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text, in lower case: matches of each kind, and the sum of their words' weights times those of their arcs."""
        text = spaced(blob)
        starts, ends, at = K.words(text, offsets, LETTER)
        out = np.zeros((len(offsets) - 1, len(KINDS) + 1))
        if not len(starts):
            return out
        hashes = K.words_hash(text, starts, ends)
        kind, weight = np.zeros(len(starts), dtype=np.int8), np.zeros(len(starts))
        for n, keys in self.prefix_keys.items():
            long = np.flatnonzero(ends - starts >= n)
            own = K.words_hash(text, starts[long], starts[long] + n)
            for i in np.flatnonzero(self.among(own, keys)):
                kind[long[i]], weight[long[i]] = INSULT, max(weight[long[i]], self.prefix[n][int(own[i])])
        for i in np.flatnonzero(self.among(hashes, self.keys)):
            known, own = self.whole[int(hashes[i])]
            kind[i], weight[i] = known, max(weight[i], own)
        match = np.flatnonzero((kind == INSULT) | (kind == THREAT))
        if not len(match):
            return out
        stops = np.concatenate(([0], np.cumsum(ENDS[blob])))
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        clause = stops[starts] + doc  # a text's end ends a clause
        begin = np.flatnonzero(np.append(True, clause[1:] != clause[:-1]))
        end = np.append(begin[1:], len(clause))
        for c in np.unique(np.searchsorted(begin, match, side="right") - 1).tolist():
            a, b, state = int(begin[c]), int(end[c]), 0
            for i, symbol in enumerate(kind[a:b].tolist(), a):
                wrote, factor, state = self.write[state][symbol], self.weight[state][symbol], self.step[state][symbol]
                if wrote >= 0:
                    out[doc[i], wrote] += 1
                    out[doc[i], -1] += factor * weight[i]
        return out


def stems(sample: DataFrame, toxic: int, total: int) -> list[tuple[str, float]]:
    """Learned stems and their weights: counts of documents by stem on the executors, those that pass to the driver."""
    share = max(min(toxic / total, 0.99), 0.01)
    turned = f"(^|{PARTS})({'|'.join([*NEGATIONS, *REPORTS])})({PARTS}|$)"
    plain = F.filter(F.split("text", r"[.!?;\n|]"), lambda c: ~F.rlike(c, F.lit(turned)))
    words = F.array_distinct(F.split(F.array_join(plain, " "), PARTS))
    own = F.flatten(F.transform(words, lambda w: F.when(F.length(w) >= 3, F.concat(F.array(F.concat(w, F.lit("$"))), F.transform(F.sequence(F.lit(3), F.least(F.length(w), F.lit(8))), lambda k: F.substring(w, 1, k)))).otherwise(F.array().cast("array<string>"))))
    counts = sample.select("label", F.explode(F.array_distinct(own)).alias("stem")).groupBy("stem").agg(F.sum("label").alias("bad"), F.count("*").alias("n"))
    pure = F.col("bad") / F.col("n")
    gain = F.col("bad") * F.log(pure / share) + F.when(F.col("n") > F.col("bad"), (F.col("n") - F.col("bad")) * F.log((1 - pure) / (1 - share))).otherwise(0.0)
    best = counts.where((pure >= PURE) & (F.col("bad") >= 3)).withColumn("gain", gain).where(F.col("gain") >= GAIN).orderBy(F.desc("gain"), "stem").collect()
    kept = {r["stem"]: r for r in best}
    shortest = [r for r in best if not any(r["stem"][:k] in kept for k in range(3, len(r["stem"])))]
    return [(r["stem"], float(np.log((r["bad"] + 0.5) / (r["n"] - r["bad"] + 0.5)))) for r in shortest]


def design(x: np.ndarray) -> np.ndarray:
    """Logarithms of the features, whether any weight is left, and the constant."""
    return np.column_stack((np.log1p(x), x[:, -1] > 0, np.ones(len(x))))


def regression(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the constant."""
    x = design(x)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = sigmoid(x @ w)
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w - np.linalg.solve(hess, x.T @ (p - y) + 0.1 * w)
    return w


def apply(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sigmoid(design(x) @ w)


def scored(docs: DataFrame, labels: DataFrame, column: str = "toxic", folds: int = 5, held: int = 0, most: int = SAMPLE, others: int = OTHERS) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    spark = docs.sparkSession
    ship(spark)
    docs = unique_documents(docs).withColumn("text", F.lower("text"))
    outside = fold(F.col("doc_id"), folds) != held
    label = F.col(column).cast("int")
    one, zero = (sample_ids(labels, column, n, outside & (label == v)) for v, n in ((1, most), (0, others)))
    zero = zero.join(one.select("doc_id"), "doc_id", "left_anti")
    # at most `most` + `others` ids: a bounded broadcast; their texts stay on the executors
    sample = docs.join(F.broadcast(one.unionByName(zero)), "doc_id")
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, total = n.get(1, 0), sum(n.values())
    model = None
    if 0 < toxic < total:
        grammar = Grammar(stems(sample, toxic, total))

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, ids, blob, offsets in _columns(batch):
                    yield rows([pa.array(ids, pa.int64()), part.column("label"), pa.array(grammar.features(blob, offsets).tolist(), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

        got = sorted(sample.select("doc_id", "text", "label").mapInArrow(measure, "doc_id bigint, label int, x array<double>").collect())
        model = regression(np.array([r[2] for r in got]), np.array([r[1] for r in got], dtype=float))
    share = toxic / total if total else 0.0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, blob, offsets in _columns(batch):
                s = apply(model, grammar.features(blob, offsets)) if model is not None else np.full(part.num_rows, share)
                yield rows([part.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    out = docs.mapInArrow(score, "doc_id bigint, score double")
    return out.select("doc_id", (~outside).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
