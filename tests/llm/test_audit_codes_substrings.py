"""Source divergence, vector codes and substring deduplication against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from .test_operators import DOCS, LONG, SCHEMA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*d, *["x"] * 7) for d in DOCS], SCHEMA)


def corpus(seed, n=60):
    """Few words, shared passages, copies, runs of one word; null texts, ids, languages and sources."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["É", "été", "ÉTÉ", "x1y", "日本語", "A", "a"]
    passages = [[rng.choice(words) for _ in range(rng.randint(15, 60))] for _ in range(4)]
    out = []
    for k in range(n):
        text = []
        for _ in range(rng.randint(0, 5)):
            kind = rng.random()
            text += rng.choice(passages) if kind < 0.4 else [rng.choice(words)] * rng.randint(1, 45) if kind < 0.5 else [rng.choice(words) for _ in range(rng.randint(1, 50))]
        out.append((k, rng.choice([" ", "\n", "\t  "]).join(text), rng.choice(["en", "de", None]), rng.choice(["s", "t", "u", None])))
    return [*out, (n, None, "en", "s"), (n + 1, out[3][1], "fr", "s"), (n + 2, out[3][1], "de", "alone")]


def spark_docs(spark, data):
    return spark.createDataFrame([(*d, *["x"] * 7) for d in data], SCHEMA)


# --- op11 ---


def brute_divergence(data, min_docs=3, top=200):
    groups, counts, df = set(), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in data:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = ["".join(c.lower() if c.isascii() else c for c in t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts[lang, source].update(terms)
        df[lang].update(set(terms))
    out = set()
    for lang, source in groups:
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        own = [g for g in groups if g[0] == lang]

        def share(g, t):
            total = sum(sum(counts[x][u] for u in kept) for x in g)
            return 1 + 10**9 * (sum(counts[x][t] for x in g) + 1) // (total + len(kept))

        p = {g: {t: share([g], t) for t in kept} for g in own}
        q = {t: share(own, t) for t in kept}
        mine = p[lang, source]
        pairs = [(s, sum((mine[t] - p[lang, s][t]) ** 2 // p[lang, s][t] for t in kept)) for _, s in own if s != source]
        terms = [(t, (mine[t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, source][t] and mine[t] > q[t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            for k, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]):
                out.add((lang, source, part, item, value, k + 1))
    return out


@pytest.mark.parametrize("limits", [{}, {"ENTRIES": 5, "SLICE": 16, "PAIRS": 2}])
def test_source_divergence(spark, limits, monkeypatch):
    from quillstone.llm import source_divergence as S

    data = corpus(1)
    for k, v in limits.items():
        monkeypatch.setattr(S, k, v)
    out = S.source_divergence(spark_docs(spark, data), top=7).collect()
    assert len(out) == len(set(out)) and {tuple(r) for r in out} == brute_divergence(data, top=7)


def test_slices_of_terms_and_bounded_pairs(monkeypatch):
    from quillstone.llm import source_divergence as S

    text = "Ab cé,É " * 50 + "x" * 300
    for size in (1, 7, 100, 10_000):
        parts = list(S.slices_of_terms(text.encode(), size))
        assert [t.decode() for p in parts for t in p] == ["ab", "cé", "É"] * 50 + ["x" * 300]
    monkeypatch.setattr(S, "PAIRS", 3)
    import pyarrow as pa

    rng = np.random.default_rng(4)
    shares = {(t, s): int(rng.integers(1, 1000)) for t in range(9) for s in range(rng.integers(1, 9))}
    zero = [7 + s for s in range(9)]
    keys = sorted(shares)
    batch = pa.RecordBatch.from_arrays([["l"] * len(keys), [str(t) for t, _ in keys], [str(s) for _, s in keys], pa.array([shares[k] for k in keys]), pa.array([zero[s] for _, s in keys])], names=list("abcde"))
    got, want = Counter(), Counter()
    for b in S.pair_sums(iter([batch.slice(0, 11), batch.slice(11)])):
        for r in b.to_pylist():
            got[r["source"], r["item"]] += r["value"]
    f = lambda p, q: (p - q) ** 2 // q
    for t, g in keys:
        for u, h in keys:
            if t == u:
                p, q = shares[t, g], shares[t, h]
                want[str(g), str(h)] += f(p, q) - f(p, zero[h]) - f(zero[g], q) + f(zero[g], zero[h])
    assert {k: v for k, v in got.items() if v and k[0] != k[1]} == {k: v for k, v in want.items() if v and k[0] != k[1]}


def test_source_divergence_edges(spark, docs):
    from quillstone.llm.source_divergence import source_divergence

    assert {tuple(r) for r in source_divergence(docs).collect()} == brute_divergence([d[:4] for d in DOCS])
    assert source_divergence(docs.limit(0)).count() == 0


# --- op12 ---


def brute_codes(data, parts=4, entries=256, rounds=4):
    """data: (vec_id, vector, label). Returns (vec_id, code, error, label_error, sha) of every kept row."""
    kept = [d for d in data if d[1] is not None and all(x is not None and math.isfinite(x) for x in d[1])]
    dims = -(-max([1, *(len(d[1]) for d in kept)]) // parts) * parts
    size = dims // parts
    whole = [[math.floor(1024 * x) for x in d[1]] + [0] * (dims - len(d[1])) for d in kept]
    cut = [[v[k * size : (k + 1) * size] for k in range(parts)] for v in whole]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[cut[i][k] for i in order] for k in range(parts)]
    near = lambda x, k: min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(books[k]))
    for _ in range(rounds):
        new = []
        for k in range(parts):
            of = defaultdict(list)
            for v in cut:
                of[near(v[k], k)[1]].append(v[k])
            new.append([[sum(c) // len(of[j]) for c in zip(*of[j])] if of[j] else e for j, e in enumerate(books[k])])
        books = new
    found = [[near(v[k], k) for k in range(parts)] for v in cut]
    most = (1 << 63) - 1
    errors, by_label = [min(most, sum(d for d, _ in f)) for f in found], Counter()
    for d, e in zip(kept, errors):
        by_label[d[2]] += e
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return [(d[0], "".join(f"{j:02x}" for _, j in f), e, min(most, by_label[d[2]]), sha) for d, f, e in zip(kept, found, errors)]


def vectors(spark, data, kind="float"):
    return spark.createDataFrame([(*d, "x", "y") for d in data], f"vec_id long, embedding array<{kind}>, label int, vector string, `a.b` string")


COLUMNS = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


@pytest.mark.parametrize("entries", [3, 40])
def test_vector_codes(spark, entries):
    from quillstone.llm.vector_codes import vector_codes

    rng = random.Random(entries)
    data = [(k, [rng.choice((rng.gauss(0, 0.1), 0.25, -0.5)) for _ in range(8)], rng.choice((1, 2, None))) for k in range(90)]
    data += [(5, data[5][1], 1), (3, None, 1), (4, [], 9), (6, [0.5, None] * 4, 1), (7, [float("nan")] * 8, 1), (8, [float("inf")] * 8, 1), (None, [0.25] * 8, 2), (-1, [0.1, -0.1], None), *[(1000 + k, [0.125] * 8, 3) for k in range(60)]]
    data = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c) for i, v, c in data]
    out = vector_codes(vectors(spark, data), entries=entries).select(COLUMNS).collect()
    assert Counter(map(tuple, out)) == Counter(brute_codes(data, entries=entries))


def test_vector_codes_of_large_numbers_and_edges(spark):
    from quillstone.llm.vector_codes import vector_codes

    data = [(k, [v, -v, 0.5, v / 3, 1e-3], 0) for k, v in enumerate((1e5, 3e6, -7e7, 1e5 + 0.001, 2.0, 1e8))]
    assert Counter(map(tuple, vector_codes(vectors(spark, data, "double"), entries=3).select(COLUMNS).collect())) == Counter(brute_codes(data, entries=3))
    most = vector_codes(vectors(spark, [(1, [1e300, 0.0], 0), (2, [-1e300, 0.0], 0), (3, [0.0, 0.0], 0)], "double"), entries=1).collect()
    assert all(0 <= r["error"] < 1 << 63 for r in most) and len(most) == 3
    assert vector_codes(vectors(spark, data[:0])).count() == 0
    assert vector_codes(vectors(spark, [(1, None, 0), (2, [None], 1)])).count() == 0


@pytest.mark.parametrize("spread", [3, 1 << 20, 1 << 40])
def test_va_file_filters_and_finds_the_nearest(spread):
    from quillstone.llm.vector_codes import VAFile, narrowed

    rng = random.Random(spread)
    draw = lambda n: narrowed([[rng.randint(-spread, spread) for _ in range(4)] for _ in range(n)], 4)
    entries, queries = draw(50), draw(700)
    queries[:50] = entries
    if (entries.dtype == object) != (queries.dtype == object):
        entries, queries = entries.astype(object), queries.astype(object)
    book = VAFile(entries)
    least, most = book.bounds(queries)
    exact = ((queries[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (least <= exact).all() and (exact <= most).all()
    index, distance, refined = book.nearest(queries)
    assert index.tolist() == [min(range(50), key=lambda j: (row[j], j)) for row in exact.tolist()]
    assert distance.tolist() == [min(row) for row in exact.tolist()]
    assert refined < 0.5 * exact.size or spread == 3


# --- op13 ---


def brute_kept(data, window=20):
    """(doc_id, n_words, n_removed, kept text) of documents in the order of their ids."""
    seen, out = set(), []
    for i, text, *_ in data:
        words = WORD.findall(text or "")
        gone = set()
        for at in range(len(words) - window + 1):
            w = tuple(words[at : at + window])
            if w in seen:
                gone.update(range(at, at + window))
            seen.add(w)
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return out


@pytest.mark.parametrize("limits", [{}, {"HOT": 1, "SHARD_WORDS": 60, "HELD": 3}, {"SHARD_WORDS": 200, "SLICE": 50, "CHUNK": 64}])
def test_substring_dedup(spark, limits, monkeypatch):
    from quillstone.llm import substring_fm as S

    data = corpus(2)
    want = brute_kept(data)
    assert sum(x[2] for x in want) > 500
    if "CHUNK" in limits:  # slices of texts, in this process, as workers don't see the changed limits
        import pyarrow as pa

        text = pa.array([d[1] for d in data], pa.string())
        batch = pa.RecordBatch.from_arrays([pa.array([0] * len(data)), pa.array(range(len(data))), text], names=["file", "row", "text"])
        whole = {tuple(r.values()) for b in S.scanned(iter([batch]), 20, 6) for r in b.to_pylist()}
        for k, v in limits.items():
            monkeypatch.setattr(S, k, v)
        sliced = {tuple(r.values()) for b in S.scanned(iter([batch]), 20, 6) for r in b.to_pylist()}
        windows = lambda rows: {(f, r, at + j, key) for key, f, r, at, n in rows for j in range(n)}
        assert windows(sliced) == windows(whole) and len(sliced) >= len(whole)
        return
    for k, v in limits.items():
        monkeypatch.setattr(S, k, v)
    out = S.substring_dedup(spark_docs(spark, data)).collect()
    assert sorted(map(tuple, out)) == want


def test_substring_dedup_edges(spark, docs):
    from quillstone.llm.substring_fm import substring_dedup

    order = sorted(DOCS, key=lambda d: (d[0] is not None, d[0] or 0))
    assert Counter(map(tuple, substring_dedup(docs).collect())) == Counter(brute_kept(order))
    assert substring_dedup(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, LONG), (1, LONG), (None, LONG)], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in substring_dedup(twice).collect())[1:] == [40_000, 40_000]


@pytest.mark.parametrize("words", [2, 5, 300])
def test_fm_index_streams_foreign_texts(words):
    from quillstone.llm.substring_fm import FMIndex

    rng = np.random.default_rng(words)
    depth = 4
    texts = [rng.integers(1, words + 1, rng.integers(depth, 40)) for _ in range(20)]
    texts += [np.concatenate([texts[0][1:9], texts[1]])]
    index = FMIndex(np.concatenate([np.append(t, 0) for t in texts]), depth)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    places = defaultdict(list)
    for t, at in zip(texts, begins):
        for i in range(len(t) - depth + 1):
            places[tuple(t[i : i + depth])].append(at + i)
    streams = [*texts, *[np.where(rng.random(len(t)) < 0.1, rng.integers(0, words + 3, len(t)), t) for t in texts]]
    first = np.cumsum([0] + [len(t) for t in streams])
    flat = np.concatenate(streams)
    got = {}
    for at, lo, hi, earliest in index.matches(flat, first[:-1], first[1:]):
        got |= {a: (h - i, e) for a, i, h, e in zip(at.tolist(), lo.tolist(), hi.tolist(), earliest.tolist())}
    want = {}
    for t, at in zip(streams, first):
        for i in range(len(t) - depth + 1):
            if p := places.get(tuple(t[i : i + depth])):
                want[at + i] = (len(p), min(p))
    assert got == want


def test_segments_share_the_keys_of_equal_windows():
    from quillstone.llm.substring_fm import segments, word_hashes

    rng = random.Random(8)
    text = " ".join(rng.choice("abc") for _ in range(4000)).encode()
    hashes, starts = word_hashes(text)
    doc = np.repeat([0, 1], [1500, 2500])
    at, n, key = segments(hashes, doc, 20, 6)
    of = {a + j: k for a, m, k in zip(at.tolist(), n.tolist(), key.tolist()) for j in range(m)}
    assert sorted(of) == [i for i in range(4000 - 19) if i + 19 < 1500 or i >= 1500]
    by_window = defaultdict(set)
    for i, k in of.items():
        by_window[text[starts[i] : starts[i] + 39]].add(k)
    assert all(len(k) == 1 for k in by_window.values()) and n.max() <= 20
