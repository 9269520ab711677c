"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage is encoded (counted features, standardised, then one tanh
layer), gets a gated attention weight, and the weighted sum of a document's encodings is scored; all of it is learned from
document labels alone. Training takes whole labelled documents outside the held-out fold, least hash of doc_id first: at most
SAMPLE of them, and no more once they hold LEARNED passages together (the first is taken whatever its length). Features of
that sample and the weights are all that the driver holds. Every passage of every text is scored.

Defined results: null and empty texts are one empty passage; without labelled rows of both kinds the score is the share of
label 1 (0.5 without any); equal rows and rows that share a doc_id are one document (see exchange.unique_documents); an
empty table gives an empty table; further columns are ignored. Rows without a doc_id or label aren't learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import kernels as K
from .exchange import rows, ship, unique_documents, written
from .substring_dedup import _columns

PASSAGE, SAMPLE, LEARNED = 64, 3000, 200_000
WIDTH, GATE, EPOCHS = 16, 8, 250
#: Byte classes whose shares are features.
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".", ",", "!", "?", "|", "#*$%&<>", "'\"()[]{}", "-_=+~^", ":;/\\@"]
CLASS = np.full(256, len(CLASSES), dtype=np.uint8)
for _i, _x in enumerate(CLASSES):
    CLASS[list(_x.encode())] = _i
CLASS[128:] = len(CLASSES) + 1
FEATURES = len(CLASSES) + 2 + 5


def fold(key: Column, n: int) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % n


def shares(blob: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Share of each byte class in blob[begin:end], a segment at a time; the spans follow each other."""
    n = FEATURES - 5
    out = np.zeros((len(begin), n))
    for a in range(0, len(blob), K.SEGMENT):
        b = min(a + K.SEGMENT, len(blob))
        i, j = int(np.searchsorted(end, a, side="right")), int(np.searchsorted(begin, b))
        of = np.repeat(np.arange(j - i, dtype=np.int32), np.minimum(end[i:j], b) - np.maximum(begin[i:j], a))
        out[i:j] += np.bincount(of * n + CLASS[blob[a:b]], minlength=(j - i) * n).reshape(-1, n)
    return out / np.maximum(end - begin, 1)[:, None]


def passages(blob: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and where each text's passages begin (n + 1 offsets)."""
    starts, ends, at = K.words(blob, offsets)
    count = np.maximum(1, -(-np.diff(at) // PASSAGE))
    where = np.concatenate(([0], np.cumsum(count)))
    doc = np.repeat(np.arange(len(count)), count)
    first = at[doc] + (np.arange(len(doc)) - where[doc]) * PASSAGE
    last = np.minimum(first + PASSAGE, at[doc + 1])
    edge = np.append(starts, len(blob))
    begin = np.where(first == at[doc], offsets[doc], edge[np.minimum(first, len(starts))])
    end = np.append(begin[1:], len(blob))
    x = shares(blob, begin, end)
    n = np.maximum(last - first, 1)
    own = np.repeat(np.arange(len(doc)), last - first)
    length = np.bincount(own, ends - starts, len(doc)) / n
    hashes = K.words_hash(K.LOWER[blob], starts, ends)
    tail = np.isin(blob[np.maximum(ends - 1, 0)], np.frombuffer(b"#*$%&|<>!", np.uint8)) if len(blob) else np.zeros(0, bool)

    def repeats(values: np.ndarray, group: np.ndarray) -> np.ndarray:
        key = K.mix(values ^ K.mix(group.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key, kind="stable")
        same = np.zeros(len(key))
        same[order[1:]] = key[order[1:]] == key[order[:-1]]
        return same

    in_doc = np.repeat(np.arange(len(count)), np.diff(at))
    pair = np.zeros(len(hashes))
    if len(hashes) > 2:
        pair[2:] = repeats(K.windows_hash(hashes, 3), in_doc[2:])
    extra = [length / 10, np.bincount(own, tail, len(doc)) / n, np.bincount(own, repeats(hashes, own), len(doc)) / n, np.bincount(own, pair, len(doc)) / n, np.log1p(n) / 4]
    return np.concatenate((x, np.stack(extra, axis=1)), axis=1), where


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(p: dict, x: np.ndarray, where: np.ndarray) -> dict:
    h = np.tanh(((x - p["mean"]) / p["scale"]) @ p["W"] + p["b"])
    t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
    a = np.exp(np.clip((t * g) @ p["w"], -20, 20))
    begin = where[:-1]
    weight = a / np.repeat(np.add.reduceat(a, begin), np.diff(where))
    z = np.add.reduceat(h * weight[:, None], begin, axis=0)
    return {"h": h, "t": t, "g": g, "a": weight, "z": z, "y": sigmoid(z @ p["c"] + p["d"][0])}


def gradients(p: dict, x: np.ndarray, where: np.ndarray, labels: np.ndarray) -> dict:
    """Of the mean log loss, for every learned array."""
    xs, of = (x - p["mean"]) / p["scale"], np.repeat(np.arange(len(labels)), np.diff(where))
    f = forward(p, x, where)
    e = (f["y"] - labels) / len(labels)
    up = (e[:, None] * p["c"])[of]
    da = (up * f["h"]).sum(axis=1)
    ds = f["a"] * (da - np.add.reduceat(f["a"] * da, where[:-1])[of])
    dtg = ds[:, None] * p["w"]
    dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
    dh = (up * f["a"][:, None] + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
    return {"W": xs.T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ ds, "c": f["z"].T @ e, "d": np.array([e.sum()])}


def train(bags: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> dict:
    """Adam on the log loss."""
    x = np.concatenate(bags)
    where = np.concatenate(([0], np.cumsum([len(b) for b in bags])))
    rng = np.random.default_rng(seed)
    n = x.shape[1]
    p = {"mean": x.mean(axis=0), "scale": x.std(axis=0) + 1e-3, "W": rng.normal(0, n**-0.5, (n, WIDTH)), "b": np.zeros(WIDTH), "V": rng.normal(0, 0.3, (WIDTH, GATE)), "U": rng.normal(0, 0.3, (WIDTH, GATE)), "w": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.3, WIDTH), "d": np.zeros(1)}
    learned = ("W", "b", "V", "U", "w", "c", "d")
    m, v = ({k: np.zeros_like(p[k]) for k in learned} for _ in range(2))
    for step in range(1, EPOCHS + 1):
        grad = gradients(p, x, where, labels)
        for k in learned:
            g = grad[k] + 1e-4 * p[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            p[k] = p[k] - 0.03 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return p


def sample_ids(labels: DataFrame, column: str, most: int, keep: Column) -> DataFrame:
    """At most `most` labelled doc_ids, least hash first; of several labels of a doc_id the largest."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & keep).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col(column).cast("int")).alias("label"))
    return own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def sampled(docs: DataFrame, labels: DataFrame, column: str, folds: int, held: int, most: int, learned: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Bags and labels of the training sample, in the order of its hashes."""
    ids = sample_ids(labels, column, most, fold(F.col("doc_id"), folds) != held)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, ids, blob, offsets in _columns(batch):
                x, where = passages(blob, offsets)
                own = [x[a:b].astype("<f4").tobytes() for a, b in zip(where[:-1], where[1:], strict=True)]
                yield rows([pa.array(ids, pa.int64()), part.column("label"), pa.array(np.diff(where), pa.int64()), pa.array(own, pa.binary())], ["doc_id", "label", "n", "bag"])

    # a broadcast of at most `most` ids; as many rows stand in the one partition of the window
    bags = written(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").mapInArrow(encode, "doc_id bigint, label int, n bigint, bag binary"), "bags", "doc_id")
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id")
    total = bags.select("doc_id", (F.sum("n").over(order) <= learned).alias("fits"), F.row_number().over(order).alias("rank"))
    taken = total.where("fits OR rank = 1").select("doc_id", "rank")
    got = bags.join(F.broadcast(taken), "doc_id").orderBy("rank").select("label", "bag").collect()
    return [np.frombuffer(r[1], "<f4").reshape(-1, FEATURES).astype(float) for r in got], np.array([r[0] for r in got], dtype=float)


def scores(docs: DataFrame, labels: DataFrame, keep: list[str], column: str, folds: int, held: int, most: int, learned: int) -> DataFrame:
    """The columns `keep` of the documents and a score; docs: one row for each."""
    bags, y = sampled(docs, labels, column, folds, held, most, learned)
    model = train(bags, y) if 0 < y.sum() < len(y) else None
    share = float(y.mean()) if len(y) else 0.5
    names = [*keep, "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, blob, offsets in _columns(batch):
                s = forward(model, *passages(blob, offsets))["y"] if model else np.full(part.num_rows, share)
                yield rows([*(part.column(c) for c in keep), pa.array(s, pa.float64())], names)

    return docs.mapInArrow(score, StructType([*(docs.schema[c] for c in keep), StructField("score", DoubleType())]))


def scored(docs: DataFrame, labels: DataFrame, column: str = "quality", folds: int = 3, held: int = 1, most: int = SAMPLE, learned: int = LEARNED) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    ship(docs.sparkSession)
    out = scores(unique_documents(docs), labels, ["doc_id"], column, folds, held, most, learned)
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, learned: int = LEARNED) -> DataFrame:
    """Documents that the classifier rejects (score under 0.5) go; lang and source stay beside the text."""
    ship(docs.sparkSession)
    kept = scores(unique_documents(docs, "lang", "source"), labels, ["doc_id", "text", "lang", "source"], "quality", 3, 1, most, learned).where("score >= 0.5")
    return kept.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))
