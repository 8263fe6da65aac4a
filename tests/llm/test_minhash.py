import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa

from deltaweave.llm import minhash as M
from deltaweave.llm import textops as X


def grams(text, k=3):
    w = "".join(c.lower() if c.isalnum() or ord(c) > 127 else " " for c in text).split()
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()


def jp(a, b):
    """The probability Jaccard similarity, by its definition."""
    keys = list(set(a) | set(b))
    x, y = np.array([a[k] for k in keys], float), np.array([b[k] for k in keys], float)
    both = np.flatnonzero((x > 0) & (y > 0))
    x, y = x / x.sum(), y / y.sum()
    return sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in both)


def sign(texts, m=128):
    data, off = X.strings(pa.array(texts))
    return M.signatures(*M.shingles(data, off), m)


def test_shingles_are_counted_by_text():
    data, off = X.strings(pa.array(["a b c a b c a", "", "A b C.", "x"]))
    h, n, bounds = M.shingles(data, off)
    assert np.diff(bounds).tolist() == [3, 0, 1, 1] and sorted(n[:3].tolist()) == [1, 2, 2] and h[3] in h[:3]


def test_registers_agree_with_probability_jaccard():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    for cut in (0, 10, 40, 90):
        a = [rng.choice(words) for _ in range(200)] + ["the", "same", "run"] * 20
        b = a[:]
        b[:cut] = [rng.choice(words) for _ in range(cut)]
        sig = sign([" ".join(a), " ".join(b)], m=2048)
        assert abs((sig[0] == sig[1]).mean() - jp(grams(" ".join(a)), grams(" ".join(b)))) < 0.05


def test_signature_does_not_depend_on_the_batch():
    texts = ["alpha beta", "one", "a b c d e f g h i j k l m n o p" * 9, "alpha beta"]
    together, alone = sign(texts), [sign([t])[0] for t in texts]
    assert all((x == y).all() for x, y in zip(together, alone)) and (together[0] == together[3]).all()


def test_link_joins_what_any_pair_joins():
    rng = np.random.default_rng(1)
    base = rng.integers(1, 1 << 31, (6, 32)).astype(np.uint32)
    rows = []
    for b in base:  # chains of steps, whose ends are unlike
        x = b.copy()
        for s in range(5):
            rows.append(x.copy())
            x[s * 6 : s * 6 + 6] = rng.integers(1, 1 << 31, 6)
    sig = np.array(rows)[rng.permutation(30)]
    root = list(range(30))

    def find(x, r):
        return x if r[x] == x else find(r[x], r)

    for i in range(30):
        for j in range(i):
            if (sig[i] == sig[j]).sum() >= 24:
                root[find(i, root)] = find(j, root)
    got = list(range(30))
    for i, j in M.link(sig, 0.75):
        got[find(i, got)] = find(j, got)
    classes = lambda r: {frozenset(j for j in range(30) if find(j, r) == find(i, r)) for i in range(30)}
    assert classes(root) == classes(got)


def test_finds_what_brute_force_finds(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    rows = df.select("doc_id", "text").orderBy("doc_id").collect()
    # plant copies that differ in every fortieth word, some in chains of exact copies
    rng, planted, n = random.Random(3), [], 10_000
    for r in rows[:30]:
        w = r.text.split(" ")
        if len(w) < 60:
            continue
        for i in range(0, len(w), 40):
            w[i] = f"new{rng.random()}"
        planted += [(n, " ".join(w)), (n + 1, " ".join(w))]
        n += 2
    docs = [(r.doc_id, r.text) for r in rows] + planted
    g = {d: grams(t) for d, t in docs}
    index = {}
    for d, c in g.items():
        for k in c:
            index.setdefault(k, set()).add(d)
    pairs = {(min(a, b), max(a, b)) for s in index.values() for a in s for b in s if a != b}
    true = {p for p in pairs if jp(g[p[0]], g[p[1]]) >= 0.6}
    never = {p for p in pairs if jp(g[p[0]], g[p[1]]) < 0.25}
    got = M.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    group = {d: r.doc_id for r in got for d in [r.doc_id, *r.copies]}
    assert set(group) == {d for d, _ in docs} and all(r.copies == sorted(r.copies) and (not r.copies or r.doc_id < r.copies[0]) for r in got)
    assert sum(group[a] == group[b] for a, b in true) >= 0.97 * len(true) and len(true) > 20
    linked = {frozenset(p) for p in true}
    alone = {d for d, _ in docs} - {d for p in pairs - never for d in p}
    assert all(not r.copies for r in got if r.doc_id in alone) and linked


def test_groups_span_components(spark):
    from deltaweave.llm.components import components

    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (95, 100), (90, 200)] + [(300, 300)]
    got = {r.doc_id: r.kept for r in components(spark, spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {95: 90, 100: 90, 200: 90}


def test_without_words_nothing_is_alike(spark):
    df = spark.createDataFrame([(1, ""), (2, ""), (3, " .,"), (4, None), (None, "a b c"), (6, "a b c"), (7, "A, b c!")], "doc_id bigint, text string")
    got = {(r.doc_id, tuple(r.copies)) for r in M.near_duplicates(df).collect()}
    assert got == {(6, (7,)), (None, ())} | {(i, ()) for i in (1, 2, 3, 4)}


def test_a_bucket_of_unlike_signatures_takes_seconds():
    """Documents that share boilerplate only, and a few real copies among them."""
    rng = np.random.default_rng(0)
    n = 50_000
    base, sig = rng.integers(1, 1 << 31, 128).astype(np.uint32), rng.integers(1, 1 << 31, (n, 128)).astype(np.uint32)
    m = rng.random((n, 128)) < 0.1
    sig[m] = np.broadcast_to(base, (n, 128))[m]
    sig[:, :3] = base[:3]
    want = set()
    for i in range(0, 400, 2):
        sig[n - 1 - i] = np.where(rng.random(128) < 0.7, sig[i], sig[n - 1 - i])
        if (sig[n - 1 - i] == sig[i]).sum() >= 64:
            want.add((i, n - 1 - i))
    start = time.time()
    got = set(M.link(sig, 0.5))
    assert time.time() - start < 30 and got <= want and len(got) >= 0.98 * len(want)


def test_crowded_keys_across_batches():
    rng = np.random.default_rng(2)
    key = np.sort(rng.integers(0, 60, 200))
    old = rng.random(200) < 0.6
    order = np.lexsort((old, key))
    key, old, ids = key[order], old[order], np.arange(200)
    cols = [pa.array(key), pa.array(old), pa.array(np.zeros(200, np.int32)), pa.array(ids)]
    t = pa.RecordBatch.from_arrays(cols, names=["key", "old", "at", "doc_id"])
    want = {int(i) for i in ids if (key == key[i]).sum() > 1 and not old[key == key[i]].all()}
    for size in (1, 2, 7, 200):
        got = [x for b in M._crowded(t.slice(i, size) for i in range(0, 200, size)) for x in b.column(2).to_pylist()]
        assert len(got) == len(set(got)) and set(got) == want, size


def test_hot_buckets_are_split_and_lose_nothing(spark, data):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    notice = " ".join(rng.choice(words) for _ in range(40))
    docs, n = [], 0
    for i in range(150):
        own = [rng.choice(words) for _ in range(60)]
        for _ in range(rng.choice([1, 1, 3])):
            copy = own[:]
            copy[rng.randint(0, 59)] = "changed"
            docs.append((n, notice + " " + " ".join(copy)))
            n += 1
    many = [rng.choice(words) for _ in range(150)]
    for i in range(60):
        copy = many[:]
        copy[i] = "changed"
        docs.append((n + i, " ".join(copy)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    groups = lambda **p: sorted((r.doc_id, *r.copies) for r in M.near_duplicates(df, **p).collect())
    plain = groups()
    assert groups(hot=8) == plain and len(plain) < len(docs) - 60
