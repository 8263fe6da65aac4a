import numpy as np
import pyarrow as pa

from deltaweave.llm import classifier as C
from deltaweave.llm import textops as X


def test_features_are_those_of_each_text():
    texts = ["Ab cd ab", "", "x", "abcd efgh"]
    data, off = X.strings(pa.array(texts))
    together = C.buckets(data, off)
    for k, t in enumerate(texts):
        for (b, bounds), (c, _) in zip(together, C.buckets(*X.strings(pa.array([t])))):
            assert b[bounds[k] : bounds[k + 1]].tolist() == c.tolist()
    words, pairs, grams = (np.diff(b).tolist() for _, b in together)
    assert words == [3, 0, 1, 2] and pairs == [2, 0, 0, 1] and grams == [5, 0, 0, 6]
    assert together[0][0][0] == together[0][0][2]


def test_scores_equal_the_embedding_formula():
    rng = np.random.default_rng(1)
    vectors, weights = rng.normal(size=(C.KINDS * C.BUCKETS, 4)).astype(np.float32), rng.normal(size=(C.CLASSES, 4)).astype(np.float32)
    table = np.ascontiguousarray((vectors @ weights.T).reshape(C.KINDS, C.BUCKETS, C.CLASSES).transpose(0, 2, 1))
    data, off = X.strings(pa.array(["some words in a text", "one"]))
    got = C.Model(table, np.zeros(C.CLASSES, np.float32)).probabilities(data, off)
    for k in range(2):
        hidden = sum(vectors[b[q[k] : q[k + 1]] + kind * C.BUCKETS].sum(0) / max(1, q[k + 1] - q[k]) for kind, (b, q) in enumerate(C.buckets(data, off)))
        assert np.allclose(got[k], C.softmax(weights @ hidden), atol=1e-4)


def test_held_out_accuracy(spark, data):
    at = data.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    train, test = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    rows = C.labelled(docs, train)
    model = C.train([r.text for r in rows], np.array([r.y for r in rows]))
    held = docs.join(test, "doc_id").collect()
    seen = {r.text for r in rows}
    held = [r for r in held if r.text not in seen]
    prob = model.probabilities(*X.strings(pa.array([r.text for r in held])))
    keep = prob[:, 0] >= C.KEEP
    good, junk, toxic = (np.array([f(r) for r in held]) for f in (lambda r: r.quality == 1 and r.toxic == 0, lambda r: r.quality == 0 and r.toxic == 0, lambda r: r.toxic == 1))
    assert keep[good].mean() > 0.97 and keep[junk].mean() < 0.15 and (keep & (prob[:, 2] < C.TOXIC))[toxic].mean() < 0.25


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.p_good for r in C.classify(docs, labels).collect()}
    assert abs(got[1] - 1 / 3) < 1e-9 and got[None] is None


def test_kept_leaves_few_toxic_documents(spark, data):
    at = data.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    train, test = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    seen = {r.text for r in C.labelled(docs, train)}
    held = [r for r in docs.join(test, "doc_id").collect() if r.text not in seen]
    ids = {r.doc_id for r in C.kept(docs.join(test.select("doc_id"), "doc_id").unionByName(docs.join(train.select("doc_id"), "doc_id")), train).collect()}
    share = lambda rows: np.mean([r.doc_id in ids for r in rows])
    good, toxic = [r for r in held if r.quality == 1 and r.toxic == 0], [r for r in held if r.toxic == 1]
    assert share(toxic) < 0.25 and share([r for r in toxic if len(r.text.split()) >= 200]) < 0.3 and share(good) > 0.92


def test_training_equals_plain_loops():
    """Every step of the descent, a feature and a class at a time."""
    texts, labels = ["good words here good", "bad words", "you idiot you", ""], np.array([0, 1, 2, 0])
    dim, epochs, rate, seed = 3, 3, 0.4, 5
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((C.KINDS * C.BUCKETS, dim), dtype=np.float32) - 0.5) / dim).astype(float)
    weights, bias = np.zeros((C.CLASSES, dim)), np.zeros(C.CLASSES)
    count = np.bincount(labels, minlength=C.CLASSES)
    step, total = 0, epochs * len(texts)
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            now = rate * (1 - step / total)
            step += 1
            share = {}
            for kind, (b, _) in enumerate(C.buckets(*X.strings(pa.array([texts[i]])))):
                for x in b.tolist():
                    share[x + kind * C.BUCKETS] = share.get(x + kind * C.BUCKETS, 0) + 1 / len(b)
            if not share:
                continue
            hidden = [sum(w * vectors[f][j] for f, w in share.items()) for j in range(dim)]
            z = [sum(weights[c][j] * hidden[j] for j in range(dim)) + bias[c] for c in range(C.CLASSES)]
            p = [np.exp(x - max(z)) for x in z]
            g = [(x / sum(p) - (c == labels[i])) * np.sqrt(count.max() / max(count[labels[i]], 1)) for c, x in enumerate(p)]
            back = [sum(g[c] * weights[c][j] for c in range(C.CLASSES)) for j in range(dim)]
            for c in range(C.CLASSES):
                bias[c] -= now * 0.1 * g[c]
                for j in range(dim):
                    weights[c][j] -= now * g[c] * hidden[j]
            for f, w in share.items():
                for j in range(dim):
                    vectors[f][j] -= now * np.sqrt(w) * back[j]
    model = C.train(texts, labels, epochs, rate, dim, seed)
    assert np.allclose(model.bias, bias, atol=1e-5)
    assert np.allclose(model.table, (vectors @ weights.T).reshape(C.KINDS, C.BUCKETS, C.CLASSES).transpose(0, 2, 1), atol=1e-5)
