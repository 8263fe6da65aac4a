import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from deltaweave.llm import substring_dedup as S
from deltaweave.llm import textops as X


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=400).map(lambda b: b.hex()), min_size=1, max_size=4))
def test_chunks_cover_each_text_and_depend_on_it_alone(texts):
    data, off = X.strings(pa.array(texts))
    starts, ends, bounds = S.chunks(data, off)
    for k, t in enumerate(texts):
        got = [data[a:b].tobytes().decode() for a, b in zip(starts[bounds[k] : bounds[k + 1]], ends[bounds[k] : bounds[k + 1]])]
        one, o = X.strings(pa.array([t]))
        a, b, _ = S.chunks(one, o)
        assert "".join(got) == t and got == [t[x:y] for x, y in zip(a, b)]


def test_hash_is_the_sum_of_shifted_gears():
    data = np.frombuffer(bytes(random.Random(1).randbytes(200)), np.uint8)
    h = S.gear(data)
    for i in (0, 5, 31, 32, 199):
        assert int(h[i]) == sum(int(S.GEAR[data[i - k]]) << k for k in range(min(32, i + 1))) % (1 << 32)


def test_text_without_borders_is_cut_as_well():
    for word in ("And ", "x", "Thti "):
        data, off = X.strings(pa.array([word * 900, "a"]))
        starts, ends, bounds = S.chunks(data, off)
        assert (ends - starts).max() <= S.LONGEST and (starts[1:] == ends[:-1]).all() and ends[-1] == len(data) and bounds[-1] - bounds[1] == 1


def test_insertions_shift_borders_only():
    text = prose(random.Random(2), 800)
    cut = lambda t: {t[a:b] for a, b, in zip(*S.chunks(*X.strings(pa.array([t])))[:2])}
    assert len(cut(text) - cut(text[:900] + "something new" + text[900:])) <= 4


def test_planted_passages_are_found_and_nothing_else(spark):
    rng = random.Random(3)
    passages = [prose(rng, 55) for _ in range(40)]
    docs, want = [], {}
    for i in range(300):
        t = prose(rng, 200)
        if i % 3 == 0:
            p = passages[i // 3 % 40]
            k = rng.randint(0, len(t))
            want[i] = (p, len(t[:k]))
            t = t[:k] + " " + p + " " + t[k:]
        docs.append((i, t))
    got = S.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    later = {i for i in want if i >= 120}
    found = {r.doc_id for r in got}
    assert found <= later and len(found) >= 0.97 * len(later)
    for r in got:
        p, k = want[r.doc_id]
        assert k <= r.begin and r.end <= k + len(p) + 2 and want[r.first_doc_id][0] == p and r.first_doc_id < r.doc_id


def count_words(raw):
    return len(raw.replace(b"\x0b", b" ").replace(b"\x0c", b" ").split())


def brute(docs, least=S.LEAST_WORDS):
    """{(doc_id, begin, end, n_words, first_doc_id)}: windows looked up as bytes."""
    first, wins = {}, {}
    for d, t in sorted(docs):
        raw, o = X.strings(pa.array([t]))
        a, b, _ = S.chunks(raw, o)
        begins = [i for i in range(len(raw)) if raw[i] not in b" \t\n\r\x0b\x0c" and (i == 0 or raw[i - 1] in b" \t\n\r\x0b\x0c")]
        wins[d] = []
        for i, x in enumerate(a.tolist()):
            y = next((y for y in b[i:].tolist() if sum(x <= w < y for w in begins) >= least), None)
            if y is not None:
                wins[d].append((x, y, raw[x:y].tobytes()))
                first.setdefault(raw[x:y].tobytes(), d)
        wins[d] = wins[d], begins
    out = set()
    for d, (ws, begins) in wins.items():
        run = []
        for x in [*[w for w in ws if first[w[2]] != d], None]:
            if run and (x is None or x[0] > run[-1][1]):
                times = {}
                for y in run:
                    times[first[y[2]]] = times.get(first[y[2]], 0) + 1
                a, b = run[0][0], run[-1][1]
                out.add((d, a, b, sum(a <= w < b for w in begins), min(times, key=lambda k: (-times[k], k))))
                run = []
            if x is not None:
                run.append(x)
    return out


def test_equals_brute_force(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect() if len(r.text) < 20_000]
    got = {tuple(r) for r in S.repeated_passages(df.where("length(text) < 20000")).collect()}
    assert got == brute(docs) and got


def test_a_passage_stands_whole_in_one_earlier_document(spark):
    """Pieces of many documents side by side are no passage, whatever their number."""
    rng = random.Random(7)
    texts = [prose(rng, 60) for _ in range(300)]
    words = [t.split(" ") for t in texts]
    part = lambda k: rng.choice(words)[k : k + 9]
    mixed = [" ".join(w for _ in range(25) for w in part(rng.randint(0, 50))) for _ in range(50)]
    docs = list(enumerate(texts + mixed))
    assert S.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).count() == 0


def test_repeated_rows_and_empty_tables(spark):
    rng = random.Random(6)
    p = prose(rng, 60)
    rows = [(1, p), (1, p), (2, p), (2, p), (3, ""), (None, p), (4, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = S.repeated_passages(df).collect()
    assert [r.doc_id for r in got] == [2] and got[0].first_doc_id == 1
    cut = sorted((str(r.doc_id), r.text) for r in S.without_repeats(df).collect() if r.text is not None)
    assert cut[0][1] == cut[1][1] == p and cut[2][1] == cut[3][1] != p and cut[4] == ("3", "") and cut[5] == ("None", p)
    none = df.limit(0)
    assert S.repeated_passages(none).count() == S.without_repeats(none).count() == 0


def test_cutting(spark):
    rng = random.Random(5)
    p, q = prose(rng, 80), prose(rng, 80)
    df = spark.createDataFrame([(1, p, 0), (2, "é" + q + p, 1), (3, None, 2), (None, p, 3)], "doc_id bigint, text string, x int")
    got = {r.x: r.text for r in S.without_repeats(df).collect()}
    assert got[0] == p and got[3] == p and got[2] is None and got[1].startswith("é" + q) and len(got[1]) < len(q) + 100
