"""Filter audit, phrases and SimHash against brute force, with nulls, ties, copies, very long texts and empty tables."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from voxelgraph.llm import filter_audit, phrases, simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, mask int, band string, word string, part string"
LABELS = "doc_id bigint, quality int, toxic int"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def corpus() -> list[tuple]:
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdé", k=rng.randint(1, 3))) for _ in range(14)]
    out = []
    for _ in range(60):
        text = " ".join(rng.choice(words) + rng.choice(["", "", "", "", ",", ".", "\n", "!"]) for _ in range(rng.randint(1, 160)))
        out.append((text.upper() if rng.random() < 0.2 else text, rng.choice(["en", "fr", None]), rng.choice(["a", "b", None, ""])))
    out += [out[3], out[3], out[7], (None, "en", "a"), ("", None, "b"), (" \n\t", "en", None), ("one two three", "fr", "a"), ("X" * 70, "en", "a"), ("50% of # & *", "en", "b")]
    out += [("big " + " ".join(rng.choices(words, k=30_000)), "en", "a"), ("Zürich “quoted” 東京 " * 40, "und", "c")]
    near = [f"w{i}" for i in range(400)]
    for k in range(12):
        own = list(near)
        for _ in range(k % 5):
            own[rng.randrange(400)] = f"x{rng.randrange(99)}"
        out.append((" ".join(own), "de", "b"))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    own = [(i, t, lang, source, 1, "a", "b", "c") for i, (t, lang, source) in enumerate(corpus())]
    own += [own[5], (None, "lost words here", "en", "a", 1, "a", "b", "c")]
    return spark.createDataFrame(own, SCHEMA).repartition(4)


def labels_of() -> list[tuple]:
    rng = random.Random(9)
    return [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(50)] + [(3, 1, 0), (None, 1, 1)]


def fails(rows: list[tuple[int, str]]) -> dict[int, set[str]]:
    first, out = {}, {}
    for i, t in sorted(rows):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        bad = {"A"} if len(words) < 50 else set()
        if 100 * len(set(words)) < 65 * len(words):
            bad.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t):
            bad.add("C")
        if any(c in "#$%&*|" for c in t):
            bad.add("D")
        if t in first:
            bad.add("E")
        first.setdefault(t, i)
        out[i] = bad
    return out


def test_filter_audit_counts_every_order(spark, docs):
    texts = [(i, t or "") for i, (t, _, _) in enumerate(corpus())]
    part = {i: source or "" for i, (_, _, source) in enumerate(corpus())}
    bad = fails(texts)
    good = {i for i, q, _ in labels_of() if q == 1}
    toxic = {i for i, _, x in labels_of() if x == 1}
    want, shares = {}, Counter()
    for p in set(part.values()):
        own = [i for i in part if part[i] == p]
        for order in permutations("ABCDE"):
            left = set(own)
            for step, f in enumerate(order, 1):
                gone = {i for i in left if f in bad[i]}
                left -= gone
                shares[p, f] += len(gone)
                want[p, "".join(order), step] = [len(left), len(gone), sum(f in bad[i] for i in own) - len(gone), sum(bad[i] == {f} for i in own), len(gone & good), len(gone & toxic)]
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit(docs, spark.createDataFrame(labels_of(), LABELS)).collect()}
    assert got.keys() == want.keys()
    for key, r in got.items():
        assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost] == want[key]
        assert r.shapley == shares[r.part, r.filter_order[r.step - 1]]


def test_signed_sums_invert_exactly(spark, docs):
    sums = filter_audit.signed_sums(docs, spark.createDataFrame(labels_of(), LABELS))
    cells = filter_audit.cells(sums).collect()
    assert sum(x.n for r in cells for x in r.cells) == len(corpus()) and all(x.n >= 0 for r in cells for x in r.cells)
    assert sum(r.w0 for r in sums.collect()) == len(corpus())


def listed(rows: list[tuple[str | None, str]], least: int, top: int) -> set[tuple]:
    f: Counter = Counter()
    n: Counter = Counter()
    for text, lang in rows:
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", (text or "").encode().translate(LOWER)):
            words = [w for w in re.split(rb"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for d in range(1, 5):
                for i in range(len(words) - d + 1):
                    f[lang, tuple(words[i : i + d])] += 1
    out = {}
    for (lang, g), a in f.items():
        if len(g) < 2 or a < least:
            continue
        cuts = [(2_000_000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g))]
        out[lang, g] = (a, *min(cuts))
    dropped = {(lang, g[i : i + m]) for (lang, g), (a, *_) in out.items() for m in range(2, len(g)) for i in range(len(g) - m + 1) if 100 * a >= 80 * out[lang, g[i : i + m]][0]}
    rows = set()
    for lang in n:
        own = sorted((-s, -a, b" ".join(g), left, right) for (x, g), (a, s, _, left, right) in out.items() if x == lang and (x, g) not in dropped)
        rows |= {(lang, k, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(own[:top], 1)}
    return rows


def test_phrases_against_listing(docs):
    got = {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(docs).collect()}
    want = listed([(t, lang or "und") for t, lang, _ in corpus()], 30, 2000)
    assert len(want) > 300 and got == want


def test_intervals_of_small_shards_add_up():
    """Shards of 50 words cut texts anywhere; their counts together are those of the whole."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") + rng.choice(["", "", "", ";"]) for _ in range(rng.randint(0, 200))) for _ in range(9)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["en", "fr", "en"] * 3)], ["text", "lang"])
    found: Counter = Counter()
    for _, low, starts, ends, row, key, left, first in phrases.shards(iter([batch]), phrases.hashing(0), 50):
        for d, at, count in phrases.intervals(key, left, first):
            for i, c in zip(at.tolist(), count.tolist(), strict=True):
                found[["en", "fr", "en"][row[i] % 3], tuple(low[starts[j] : ends[j]].tobytes().decode() for j in range(i, i + d))] += c
    want: Counter = Counter()
    for i, t in enumerate(texts):
        for piece in t.split(";"):
            w = piece.split()
            for d in (2, 3, 4):
                for j in range(len(w) - d + 1):
                    want[["en", "fr", "en"][i % 3], tuple(w[j : j + d])] += 1
    assert found == want


def fingerprint(text: str | None) -> int:
    words = WORD.findall((text or "").encode().translate(LOWER))
    own = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: list[int], most: int) -> list[int]:
    parent = list(range(len(prints)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= most:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def test_simhash_against_all_pairs(docs):
    prints = [fingerprint(t) for t, _, _ in corpus()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{p:016x}", c) for i, (p, c) in enumerate(zip(prints, components(prints, 4), strict=True))}


def crowded() -> list[int]:
    """Crowds around few centres, chains of single flips, far strays; many within and just beyond four bits."""
    rng = random.Random(8)
    out = [rng.getrandbits(64) for _ in range(300)]
    for centre in (out[0], out[1], 0, 2**64 - 1):
        out += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for _ in range(250)]
        out += [centre ^ sum(1 << b for b in rng.sample(range(10), rng.randint(0, 9))) for _ in range(150)]
    return sorted(set(out))


@pytest.mark.parametrize("most", [4, 2])
def test_gray_index_finds_every_link(spark, most):
    """Crowds fill many blocks, so links inside blocks and across them are both needed; parts are those of all pairs."""
    prints = crowded()
    own = spark.createDataFrame([(i, p - 2**64 if p >> 63 else p) for i, p in enumerate(prints)], "doc_id bigint, bits bigint")
    blocks = simhash.gray_sorted(own, most)
    inside = simhash.within(blocks, most).collect()
    assert len({r.block for r in blocks.select("block").distinct().collect()}) > 1 and len(inside) <= (most + 1) * len(prints)
    alone = spark.createDataFrame([], "doc_id bigint, component_id bigint")
    links = [(r.a, r.b) for r in [*inside, *simhash.across(blocks, alone, most).collect()]]
    parent = list(range(len(prints)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(prints))] == components(prints, most)


def test_index_prunes_to_the_true_pairs():
    rng = np.random.default_rng(4)
    codes = np.unique(rng.integers(0, 2**20, 700, dtype=np.uint64) << np.uint64(30))
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    asked = codes[::3] ^ np.uint64(1 << 33)
    walker, code = simhash.Index(codes).close(asked, np.full(len(asked), -1), np.arange(len(codes)), 3)
    want = {(i, j) for i, a in enumerate(asked) for j, c in enumerate(codes) if int(a ^ c).bit_count() <= 3}
    assert set(zip(walker.tolist(), code.tolist(), strict=True)) == want and len(walker) == len(want)


def test_fingerprint_bits_of_many_hashes():
    rng = np.random.default_rng(6)
    sizes = [0, 1, 2, 254, 255, 256, 3000, 0, 510]
    hashes = rng.integers(0, 2**64, sum(sizes), dtype=np.uint64)
    offsets = np.append(0, np.cumsum(sizes))
    want = [sum(1 << b for b in range(64) if 2 * int((hashes[a:z] >> np.uint64(b) & np.uint64(1)).sum()) > z - a) for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
    assert simhash.fingerprint_bits(hashes, offsets).tolist() == want


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert filter_audit.audit(empty, spark.createDataFrame([], LABELS)).count() == 0
    assert phrases.collocations(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
