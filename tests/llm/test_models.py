"""Learned operators against plain re-computations, and the pipeline's stages against brute force."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from voxelgraph.llm import decontamination, ngram_join, packing, quality_classifier, quality_rules, substring_dedup, toxicity

from .test_operators import SCHEMA, corpus, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_bags_by_plain_counting():
    rng = random.Random(2)
    own = ["".join(rng.choices("ab CD12 .,!?|#é\n", k=n)) for n in (0, 1, 40, 3000)] + ["x" * 300_000 + " y", " \n"]
    data = [t.encode() for t in own]
    offsets = np.cumsum([0, *map(len, data)])
    x, where = quality_classifier.passages(np.frombuffer(b"".join(data), np.uint8), offsets)
    for t, a, b in zip(data, where[:-1], where[1:], strict=True):
        spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)]
        heads = [0, *(spans[i][0] for i in range(quality_classifier.PASSAGE, len(spans), quality_classifier.PASSAGE))]
        assert b - a == len(heads)
        for k, (lo, hi) in enumerate(zip(heads, [*heads[1:], len(t)], strict=True)):
            part = t[lo:hi]
            share = [sum(quality_classifier.CLASS[c] == j for c in part) / max(len(part), 1) for j in range(quality_classifier.FEATURES - 5)]
            words = [t[i:j] for i, j in spans[k * quality_classifier.PASSAGE : (k + 1) * quality_classifier.PASSAGE]]
            n = max(len(words), 1)
            extra = [sum(map(len, words)) / n / 10, sum(w[-1] in b"#*$%&|<>!" for w in words) / n, (len(words) - len({w.lower() for w in words})) / n]
            assert np.allclose(x[a + k, : len(share)], share) and np.allclose(x[a + k, len(share) : len(share) + 3], extra) and math.isclose(x[a + k, -1], math.log1p(n) / 4)


def bags_and_model():
    rng = np.random.default_rng(4)
    bags = [rng.normal(size=(n, quality_classifier.FEATURES)) for n in (1, 3, 2, 5)]
    labels = np.array([1.0, 0.0, 1.0, 0.0])
    x, where = np.concatenate(bags), np.cumsum([0, 1, 3, 2, 5])
    p = {"mean": x.mean(axis=0), "scale": x.std(axis=0), "W": rng.normal(size=(x.shape[1], 16)) / 5, "b": rng.normal(size=16), "V": rng.normal(size=(16, 8)), "U": rng.normal(size=(16, 8)), "w": rng.normal(size=8), "c": rng.normal(size=16), "d": rng.normal(size=1)}
    return bags, labels, x, where, p


def scored_plainly(p: dict, bag: np.ndarray) -> float:
    encoded = [np.tanh(((row - p["mean"]) / p["scale"]) @ p["W"] + p["b"]) for row in bag]
    gate = [math.exp(float(np.tanh(h @ p["V"]) * (1 / (1 + np.exp(-(h @ p["U"])))) @ p["w"])) for h in encoded]
    z = sum(h * g / sum(gate) for h, g in zip(encoded, gate, strict=True))
    return 1 / (1 + math.exp(-float(z @ p["c"] + p["d"][0])))


def test_attention_forward_and_gradients():
    bags, labels, x, where, p = bags_and_model()
    assert np.allclose(quality_classifier.forward(p, x, where)["y"], [scored_plainly(p, b) for b in bags])
    grad = quality_classifier.gradients(p, x, where, labels)

    def loss(q: dict) -> float:
        return -sum(math.log(s if y else 1 - s) for s, y in zip((scored_plainly(q, b) for b in bags), labels, strict=True)) / len(labels)

    for name, at in (("W", (3, 5)), ("b", (2,)), ("V", (4, 1)), ("U", (7, 2)), ("w", (3,)), ("c", (9,)), ("d", (0,))):
        step = np.zeros_like(p[name])
        step[at] = 1e-5
        assert math.isclose((loss(p | {name: p[name] + step}) - loss(p | {name: p[name] - step})) / 2e-5, grad[name][at], rel_tol=1e-3, abs_tol=1e-7)


def test_the_sample_is_whole_documents(spark):
    docs = spark.createDataFrame([(i, "word " * (64 * (i % 5 + 1))) for i in range(40)] + [(None, "x"), (3, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    bags, y = quality_classifier.sampled(quality_classifier.unique_documents(docs), labels, "quality", 3, 1, 100, 30)
    assert sum(map(len, bags)) <= 30 < sum(map(len, bags)) + 5 and all(len(b) <= 5 for b in bags) and len(bags) == len(y)
    assert len(quality_classifier.sampled(quality_classifier.unique_documents(docs), labels, "quality", 3, 1, 100, 0)[0]) == 1


def test_classifiers_on_nulls_and_repeated_rows(spark):
    rows = [(i, None if i == 0 else "" if i == 1 else f"you zzbad {i} &&&" if i % 2 else f"calm words number {i}", "l", 9, 1.0) for i in range(120)]
    docs = spark.createDataFrame([*rows, rows[5], rows[5], (None, "lost", "l", 9, 1.0)], "doc_id bigint, text string, label string, score int, bag double").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 2 == 0), int(i % 2)) for i in range(2, 120)] + [(4, None, None)], "doc_id bigint, quality int, toxic int")
    for module in (quality_classifier, toxicity):
        got = {r.doc_id: r for r in module.scored(docs, labels).collect()}
        assert sorted(got) == list(range(120)) and got[0].score == got[1].score and 0 <= got[0].score <= 1
        assert got == {r.doc_id: r for r in module.scored(docs.coalesce(1).orderBy("text"), labels).collect()} or all(abs(r.score - got[r.doc_id].score) < 1e-9 for r in module.scored(docs.coalesce(1).orderBy("text"), labels).collect())
        assert sum(r.predicted == (r.doc_id % 2 == (module is toxicity)) for r in got.values()) >= 110


def plain_features(text: str, stems: dict[str, float]) -> list[float]:
    out = [0.0] * (len(toxicity.KINDS) + 1)
    for clause in re.split(r"[.!?;\n|]", text.lower()):
        addressed = reported = waiting = False
        negated = 0
        for word in re.split(toxicity.PARTS, clause):
            if not word:
                continue
            whole = {x: k for k, own in ((toxicity.TARGET, toxicity.TARGETS), (toxicity.NEGATION, toxicity.NEGATIONS), (toxicity.REPORT, toxicity.REPORTS), (toxicity.THREAT, toxicity.THREATS)) for x in own}
            hits = [w for s, w in stems.items() if (word == s[:-1] if s.endswith("$") else word.startswith(s))]
            kind = toxicity.INSULT if word + "$" in stems else whole.get(word, toxicity.INSULT if hits else toxicity.OTHER)
            if kind == toxicity.INSULT or kind == toxicity.TARGET and waiting:
                name = "negated" if negated else "reported" if reported else "threat" if kind == toxicity.TARGET else "addressed" if addressed else "plain"
                out[toxicity.KINDS.index(name)] += 1
                times = 0 if negated else toxicity.REPORTED if reported else 1
                weight = max([*hits, *([1.0] if word in whole and word + "$" not in stems else [])])
                out[-1] += times * weight * (toxicity.ADDRESSED if kind == toxicity.INSULT and addressed else 1)
            waiting = kind == toxicity.THREAT or waiting and kind != toxicity.TARGET
            negated = toxicity.SCOPE if kind == toxicity.NEGATION else max(negated - 1, 0)
            addressed, reported = addressed or kind == toxicity.TARGET, reported or kind == toxicity.REPORT
    return out


def test_grammar_by_plain_reading():
    rng = random.Random(8)
    stems = {"idiot": 2.5, "dumm$": 1.5, "дура": 3.0, "kill$": 4.0, "kil": 0.5, "crétin": 2.0}
    words = ["you", "not", "said", "idiot", "idiots", "dumm", "dummy", "дурак", "kill", "killed", "crétine", "hurt", "calm", "é", "the", "—", "“idiot”", "x1y"]
    own = ["", "."] + [" ".join(rng.choice(words) + rng.choice(["", "", "", ".", "!", ",", "\n"]) for _ in range(rng.randint(1, 40))) for _ in range(200)]
    own += ["calm, " * 60_000 + "you idiot", "not calm calm kill. not calm calm calm kill"]
    data = [t.lower().encode() for t in own]
    grammar = toxicity.Grammar(list(stems.items()))
    got = grammar.features(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    assert np.allclose(got, [plain_features(t, stems) for t in own])


def test_composed_automaton():
    step, write, weight = toxicity.automaton()
    assert len(step) == len(weight) == 2 * 2 * (toxicity.SCOPE + 1) * 2 and all(len(r) == toxicity.CLASSES for r in step)
    assert all(row[toxicity.STOP] == 0 for row in step)
    assert toxicity.KINDS[write[0][toxicity.INSULT]] == "plain" and write[0][toxicity.OTHER] == -1


def test_clauses_are_scored_not_words(spark):
    """Negated and reported insults weigh less than plain ones, threats need a target, reports go on behind a colon."""
    grammar = toxicity.Grammar([("idiot$", 2.5)])
    texts = ["you idiot", "you are not an idiot", "he said you are an idiot", "he wrote: you idiot", "i will kill you", "we kill time", "the sun beat down and logs burn", "i will not hurt him", "idiot"]
    data = [t.encode() for t in texts]
    got = grammar.features(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    kinds = [[toxicity.KINDS[k] for k in np.flatnonzero(x[:-1])] for x in got]
    assert kinds == [["addressed"], ["negated"], ["reported"], ["reported"], ["threat"], [], [], ["negated"], ["plain"]]
    assert got[:, -1].tolist() == [3.75, 0.0, 0.9375, 0.9375, 1.0, 0.0, 0.0, 0.0, 2.5]


def test_stems_by_plain_counting(spark):
    """Prefixes and words of clauses without negation or report, kept by share and gain; weights are smoothed log odds."""
    rng = random.Random(21)
    calm = ["river", "stone", "window", "garden", "paper", "light"]
    rows = []
    for i in range(160):
        words = rng.choices(calm, k=6)
        toxic = i % 4 == 0
        words.insert(2, rng.choice(["moronic", "moronish", "dolt"]) if toxic else rng.choice(calm))
        tail = ". he said moronic things. that is not a dolt" if i % 3 == 0 else ""
        rows.append((i, " ".join(words) + tail, int(toxic)))
    own = toxicity.stems(spark.createDataFrame(rows, "doc_id int, text string, label int"), 40, 160)
    count: dict[str, list[int]] = {}
    for _, text, label in rows:
        found = set()
        for clause in re.split(r"[.!?;\n|]", text):
            words = [w for w in re.split(toxicity.PARTS, clause) if w]
            if not set(words) & {*toxicity.NEGATIONS, *toxicity.REPORTS}:
                found |= {x for w in words if len(w) >= 3 for x in [w + "$", *(w[:k] for k in range(3, min(len(w), 8) + 1))]}
        for x in found:
            count.setdefault(x, [0, 0])[label] += 1
    kept = {}
    for stem, (good, bad) in count.items():
        pure = bad / (good + bad)
        gain = bad * math.log(pure / 0.25) + (good * math.log((1 - pure) / 0.75) if good else 0.0) if bad else 0.0
        if pure >= toxicity.PURE and bad >= 3 and gain >= toxicity.GAIN:
            kept[stem] = math.log((bad + 0.5) / (good + 0.5))
    want = {s: w for s, w in kept.items() if not any(s[:k] in kept for k in range(3, len(s)))}
    assert {s for s in want if s.startswith("mor")} and {s for s in want if s.startswith("dol")}
    assert dict(own) == pytest.approx(want)


def test_regression_reaches_the_least_loss():
    """The weights' gradient is zero, and moving any of them raises the penalised loss."""
    rng = np.random.default_rng(3)
    x = np.abs(rng.normal(size=(300, 6)))
    y = (x[:, 0] + rng.normal(size=300) > 1).astype(float)
    w = toxicity.regression(x, y)
    own = toxicity.design(x)

    def loss(v: np.ndarray) -> float:
        s = own @ v
        return float((np.logaddexp(0, s) - y * s).sum() + 0.05 * (v * v).sum())

    assert all(loss(w) < loss(w + d * np.eye(len(w))[k]) for k in range(len(w)) for d in (-0.01, 0.01))
    assert np.allclose(toxicity.apply(w, x), 1 / (1 + np.exp(-own @ w)))


def test_likelihood_ratio_by_plain_counting(spark):
    docs = spark.createDataFrame([(i, t) for i, t in corpus()], "doc_id bigint, text string")
    got = {r.doc_id: r for r in quality_rules.judged(docs).collect()}
    n_cells = quality_rules.BUCKETS

    def cells(words: list[str]) -> list[int]:
        h = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words]
        signed = lambda x: x.to_bytes(8, "little")
        two = [xxhash.xxh64_intdigest(signed(b), seed=xxhash.xxh64_intdigest(signed(a), seed=42)) for a, b in zip(h, h[1:], strict=False)]
        return [x >> (64 - n_cells.bit_length() + 1) for x in [*h, *two]]

    words = {i: WORD.findall(t.decode()) for i, t in texts()}
    raw, good = [1] * n_cells, [1] * n_cells
    for i, w in words.items():
        r, t = got[i], dict(texts())[i].decode()
        sure = not r.base_failed and 200 * r.n_symbols <= r.word_chars and 10 * sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in t) <= r.word_chars and r.n_dup_lines == 0 and r.n_repeat_words == 0
        for c in cells(w):
            raw[c] += 1
            good[c] += sure
    table = [round(1000 * math.log(g / sum(good) * sum(raw) / r)) for g, r in zip(good, raw, strict=True)]
    for i, w in words.items():
        own = [table[c] for c in cells(w)]
        assert got[i].llr == (math.floor(sum(own) / len(own)) if own else None)
        assert got[i].kept == (not got[i].base_failed and bool(own) and sum(own) / len(own) >= quality_rules.THRESHOLD or (not got[i].base_failed and bool(own) and math.floor(sum(own) / len(own)) >= quality_rules.THRESHOLD))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents, labels and benchmark with nulls, repeated rows and further columns, as files."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefg", k=rng.randint(3, 7))) for _ in range(400)]
    item = "how many boxes of apples does the farmer carry to the old market when every box weighs nine kilos and the cart holds two tons"
    passage = " ".join(rng.choices(words, k=70))
    rows: list[tuple] = []
    for i in range(90):
        t = " ".join(rng.choices(words, k=rng.randint(60, 200)))
        rows.append((i, " ".join(f"{w}&&&" for w in t.split()) if i % 3 == 0 else t))
    plain = [r for r in rows if r[0] % 3]
    rows += [(100 + k, plain[k][1].replace(plain[k][1].split()[5], "changed")) for k in range(8)] + [(120 + k, plain[k][1]) for k in range(8)]
    rows += [(140 + k, f"{plain[20 + k][1]} {passage}\n{plain[30 + k][1]}") for k in range(4)]
    rows += [(150, f"{plain[10][1]} {item} {plain[11][1]}"), (160, None), (161, ""), (None, "lost")]
    rows += [rows[1], rows[1]]
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, "s", len(t or ""), 1, "x", True) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, label int, spans string, score boolean")
    docs.repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(90)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item, 5, "y"), (2, None, 6, "z")], "item_id bigint, text string, doc_id bigint, pos string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def rows_of(df) -> dict:
    out = {r.doc_id: r for r in df.collect()}
    assert len(out) == df.count()
    return out


def linked_plainly(own: dict[int, str], words: int, num: int, den: int) -> dict[int, int]:
    sets = {i: (lambda w: {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())(WORD.findall(t.lower())) for i, t in own.items()}
    root = {i: i for i in own}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(own)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def cut_plainly(own: dict[int, str], window: int) -> dict[int, str]:
    seen, out = set(), {}
    for i in sorted(own):
        t = own[i]
        spans = [m.span() for m in WORD.finditer(t)]
        w, gone = [t[a:b] for a, b in spans], [False] * len(spans)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone[k : k + window] = [True] * window
            seen.add(key)
        edges = [*(a for a, _ in spans), len(t)]
        out[i] = "".join([t[: edges[0]], *(t[edges[k] : edges[k + 1]] for k, g in enumerate(gone) if not g)])
        if w and all(gone):
            del out[i]
    return out


def test_pipeline_stage_by_stage(spark, tables):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    kept = stages["quality_classifier"](spark, docs, tables)
    judged = {r.doc_id: r.predicted for r in quality_classifier.scored(docs, spark.read.parquet(f"{tables}/labels.parquet")).collect()}
    own = rows_of(kept)
    assert kept.columns == columns and sorted(own) == sorted(i for i, p in judged.items() if p) and len(judged) == len({r.doc_id for r in docs.collect()} - {None})
    assert sum(i % 3 != 0 for i in own if i < 90) >= 55 and sum(i % 3 == 0 for i in own if i < 90) <= 2
    assert all(own[i].lang == ("en" if i % 2 else None) and own[i].n_chars == len(own[i].text) for i in own)
    first = stages["ngram_jaccard_join"](spark, kept, tables)
    got = rows_of(first)
    assert first.columns == columns and sorted(got) == [i for i, r in sorted(linked_plainly({i: r.text for i, r in own.items()}, 5, 4, 5).items()) if i == r]
    cut = stages["substring_dedup"](spark, first, tables)
    assert cut.columns == columns and {i: r.text for i, r in rows_of(cut).items()} == cut_plainly({i: r.text for i, r in got.items()}, 50)
    clean = stages["benchmark_decontamination"](spark, cut, tables)
    assert clean.columns == columns and sorted(rows_of(clean)) == sorted(i for i in rows_of(cut) if i != 150)
    packed = stages["best_fit_packing"](spark, clean, tables).collect()
    assert sorted({r.doc_id for r in packed}) == sorted(rows_of(clean))
    whole = corpus_pipeline.run(spark, tables)
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in whole.collect()) == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed)


def test_pipeline_on_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_second_and_third_sweep(spark):
    """Chains of near sets whose stars part into components that only the later sweeps join."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(5000)]
    base = rng.sample(words, 80)
    rows, now = [], base
    for i in range(60):
        now = list(now)
        now[rng.randrange(80)] = f"n{i}"
        rows.append((rng.randrange(10**6) * 100 + i, " ".join(now)))
    own = dict(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for n, num, den in ((3, 90, 100), (5, 4, 5)):
        got = {r.doc_id: r.component_id for r in ngram_join.linked(docs, n, num, den).collect()}
        assert got == linked_plainly(own, n, num, den)


def test_decontamination_by_shuffle(spark, tables):
    docs, benchmark = (spark.read.parquet(f"{tables}/{n}.parquet") for n in ("documents", "benchmark"))
    for most in (decontamination.SMALL, 0):
        got = {r.doc_id: r["items"] for r in decontamination.judged(docs.unionByName(docs), benchmark.unionByName(benchmark), most).collect()}
        assert got == {r.doc_id: [1] if r.doc_id == 150 else [] for r in docs.where("doc_id IS NOT NULL").collect()}


def fitted(lengths: list[int], capacity: int) -> int:
    """Sequences of best-fit decreasing, a piece at a time."""
    gaps: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps[gaps.index(min(fits))] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_packing_against_best_fit_decreasing(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows = packing.pack(docs, capacity=256).collect()
    best = fitted([r.length for r in rows], 256)
    assert len({r.sequence_id for r in rows}) <= best + max(1, best // 100)


def test_packing_rounds_place_every_piece_once(spark):
    rng = random.Random(12)
    counts = {n: rng.randint(1, 30) for n in rng.sample(range(1, 101), 60)}
    rows = packing.moves(spark.createDataFrame(list(counts.items()), "length bigint, n bigint"), 100).collect()
    ranks: dict[int, list[int]] = {n: [] for n in counts}
    sequences: dict[int, list[tuple[int, int]]] = {}
    for r in rows:
        for i in range(r.n):
            ranks[r.length].append(r["first"] + i)
            sequences.setdefault(r.sequence + i // r.each, []).append((r.at + i % r.each * r.length, r.length))
    assert {n: sorted(v) for n, v in ranks.items()} == {n: list(range(k)) for n, k in counts.items()}
    for own in sequences.values():
        assert all(a + n == b for (a, n), (b, _) in zip([(0, 0), *sorted(own)], sorted(own), strict=False)) and sum(n for _, n in own) <= 100
    best = fitted([n for n, k in counts.items() for _ in range(k)], 100)
    assert sorted(sequences) == list(range(len(sequences))) and len(sequences) <= best + max(1, best // 100)


def test_words_and_schema_clash(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "a", 1, "b", "c") for i, t in corpus()], SCHEMA)
    assert substring_dedup.stage(docs).columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert ngram_join.stage(docs).columns == ["doc_id", "text", "lang", "source", "n_chars"]
