import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import pyarrow as pa
from deltaweave.llm import quality_rules as Q
from deltaweave.llm import textops as X


def statistics(text):
    words, chars = [w for w in text.replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").replace("\n", " ").replace("\t", " ").split(" ") if w], len(text)
    share = lambda f: np.log(sum(f(c) for c in text) / (chars + 100) + 0.02)
    n, d = len(words), len(set(words))
    return np.rint(np.array([np.log(n + 20), np.log((sum(map(len, words)) + 50) / (n + 10)), share(lambda c: c in "#$%&*@^~|<>{}[]\\=+_`!"), share(lambda c: "A" <= c <= "Z"), share(lambda c: "0" <= c <= "9"), np.log(d + 20) - 0.9 * np.log(n + 20)]) * Q.UNIT)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aB1#é \n\t", max_size=40), min_size=1, max_size=5))
def test_statistics(texts):
    data, off = X.strings(pa.array(texts))
    assert np.array_equal(Q.statistics(data, off), np.array([statistics(t) for t in texts]))


def brute(x, share=Q.SHARE, trace=None):
    """Squared distances from the least determinant's estimate, by concentration steps over all rows from three starts."""
    low = lambda c: np.sort(c)[int(np.ceil(len(c) / 2)) - 1]
    med = np.array([low(c) for c in x.T])
    scale = np.maximum([1.4826 * low(np.abs(c - m)) for c, m in zip(x.T, med)], Q.RIDGE * Q.FLOORS)

    def floor(cov, least=Q.RIDGE):
        w, v = np.linalg.eigh(cov / np.outer(Q.FLOORS, Q.FLOORS))
        return v @ np.diag(np.maximum(w, least**2)) @ v.T * np.outer(Q.FLOORS, Q.FLOORS)

    def step(mean, cov):
        z = x - mean
        b = np.floor(np.log2(np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z) + 2.0**-20) * Q.BUCKETS)
        sub = x[b <= np.sort(b)[int(np.ceil(share * len(x))) - 1]]
        cov = floor(np.cov(sub.T, bias=True) * Q.consistency(share))
        return np.linalg.slogdet(cov)[1], sub.mean(axis=0), cov

    z = (x - med) / scale
    t = np.rint(np.tanh(z) * Q.SIGN)
    length = np.sqrt((z**2).sum(axis=1, keepdims=True))
    u = np.rint(z / np.where(length == 0, 1, length) * Q.SIGN)
    cov = np.cov(t.T, bias=True)
    d = np.sqrt(np.maximum(np.diag(cov), 1))
    corr = cov / np.outer(d, d)
    np.fill_diagonal(corr, 1)
    got = []
    for k, m in enumerate((np.eye(Q.P), corr, u.T @ u / len(u) / Q.SIGN**2 * Q.P)):
        now = (None, med, floor(m * np.outer(scale, scale)))
        for _ in range(Q.FIRST):
            now = step(*now[1:])
        got.append((now[0], k, now))
    best = min(got, key=lambda g: g[:2])[2]
    for _ in range(Q.STEPS - Q.FIRST):
        new = step(*best[1:])
        settled = not new[0] < best[0] - Q.SETTLED
        best = min(best, new, key=lambda e: e[0])
        if settled:
            break
    if trace is not None:
        trace.append((min(g[0] for g in got), max(g[0] for g in got), best[0]))
    z = x - best[1]
    return np.einsum("ij,jk,ik->i", z, np.linalg.inv(floor(best[2], 1)), z)


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/documents.parquet")


def test_distances_equal_brute_force(spark, docs):
    rows, names = Q.judged(docs)
    got = {r._c0: r for r in rows.collect()}
    pdf = docs.toPandas()
    data, off = X.strings(pa.array(pdf["text"]))
    x = Q.statistics(data, off) / Q.UNIT
    cut = Q.chi2_quantile(Q.P, Q.TAIL)
    for lang, ix in pdf.groupby("lang").indices.items():
        want = brute(x[ix]) if len(ix) >= Q.LEAST else brute(x)[ix]
        for i, d in zip(ix, want):
            r = got[pdf["doc_id"][i]]
            big = pdf[(pdf["lang"] == lang) & (pdf["source"] == pdf["source"][i])]
            if len(big) < Q.LEAST:
                assert r.distance2 == pytest.approx(d, rel=1e-6, abs=1e-9) and (r.keep == (d <= cut) or abs(d - cut) < 1e-6)


def test_rejects_junk_and_keeps_the_rest(spark, docs, data):
    labels = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/labels.parquet")
    kept = {r.doc_id for r in Q.kept_with_distance(docs).collect()}
    good = [r.doc_id in kept for r in labels.where("quality = 1").collect()]
    junk = [r.doc_id in kept for r in labels.where("quality = 0").collect()]
    assert np.mean(good) > 0.98 and np.mean(junk) < 0.1


def test_few_rows_have_no_distance_and_blank_ones_go(spark):
    df = spark.createDataFrame([(1, "a b"), (2, " \n"), (3, None), (4, "")], "doc_id bigint, text string").selectExpr("*", "'en' as lang", "cast(null as string) as source")
    assert [tuple(r) for r in Q.kept_with_distance(df).collect()] == [(1, "en", None, None)]


def test_chi2():
    assert Q.chi2_quantile(6, 0.05) == pytest.approx(12.5916, abs=1e-4) and Q.chi2_quantile(8, 0.5) == pytest.approx(7.3441, abs=1e-4)


WORDS = "the of and to a in is it that was he for on are with as his they be at one have this from or had by hot but some what there we can out other were all your when up use word how said an each she".split()


@pytest.fixture(scope="module")
def many():
    """Texts of two languages and five sources of 120 to 260 documents each, one with two populations and one below LEAST."""
    rng, rows = np.random.default_rng(12), []
    for lang, source, n in (("en", "a", 260), ("en", "b", 130), ("en", "few", 40), ("de", "a", 150), ("de", None, 120)):
        for i in range(n):
            k = int(rng.lognormal(4 if lang == "en" else 3, 0.6)) + 1
            words = [rng.choice(WORDS) * (1 + (lang == "de" and rng.random() < 0.3)) for _ in range(k)]
            if source == "b" and i % 3 == 0:
                words = [w.upper() for w in words[:20]] * 3
            if rng.random() < 0.1:
                words += ["#%$", "12345", "AB_C"] * int(rng.integers(1, 60))
            rows.append((len(rows), " ".join(words), lang, source))
    return rows


def test_each_source_has_its_own_estimate(spark, many):
    data, off = X.strings(pa.array([r[1] for r in many]))
    x = Q.statistics(data, off) / Q.UNIT
    df = spark.createDataFrame(many, "doc_id bigint, text string, lang string, source string")
    rows, _ = Q.judged(df)
    got = {r._c0: r for r in rows.collect()}
    cut, trace = Q.chi2_quantile(Q.P, Q.TAIL), []
    by = lambda f: {k: [i for i, r in enumerate(many) if f(r) == k] for k in {f(r) for r in many}}
    lang = {k: dict(zip(ix, brute(x[ix]))) for k, ix in by(lambda r: r[2]).items()}
    checked = 0
    for (k, s), ix in by(lambda r: r[2:]).items():
        want = dict(zip(ix, brute(x[ix], trace=trace))) if len(ix) >= Q.LEAST else lang[k]
        for i in ix:
            assert got[i].distance2 == pytest.approx(want[i], rel=1e-6, abs=1e-9), (k, s)
            assert got[i].keep == (want[i] <= cut) or abs(want[i] - cut) < 1e-6
            checked += len(ix) >= Q.LEAST
    assert checked == 660 and any(hi - lo > 1e-6 for lo, hi, _ in trace)  # starts differ
    assert any(b < lo - Q.SETTLED for lo, _, b in trace)  # and steps lower the determinant further


def test_the_estimate_has_the_least_determinant(spark, many):
    """No subset of as many rows that concentration finds from random starts has a clearly lesser determinant."""
    data, off = X.strings(pa.array([r[1] for r in many]))
    x = (Q.statistics(data, off) / Q.UNIT)[[i for i, r in enumerate(many) if r[2:] == ("en", "a")]]
    trace = []
    brute(x, trace=trace)
    rng, least = np.random.default_rng(3), np.inf
    for _ in range(200):
        sub = x[rng.choice(len(x), Q.P + 1, replace=False)]
        for _ in range(20):
            cov = Q.floored(np.cov(sub.T, bias=True) * Q.consistency(Q.SHARE), Q.RIDGE)
            z = x - sub.mean(axis=0)
            sub = x[np.argsort(np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z))[: int(np.ceil(Q.SHARE * len(x)))]]
        least = min(least, np.linalg.slogdet(Q.floored(np.cov(sub.T, bias=True) * Q.consistency(Q.SHARE), Q.RIDGE))[1])
    assert trace[0][2] <= least + 0.1
