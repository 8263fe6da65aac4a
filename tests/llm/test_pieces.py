import numpy as np
import pyarrow as pa
import pytest
import sentencepiece as sp
from hypothesis import given, settings
from hypothesis import strategies as st

from deltaweave.llm import pieces as S
from deltaweave.llm import textops as X

TEXTS = st.lists(st.text(alphabet="aé ▁\nﬁ①Ａ̈ö😀é", max_size=25), min_size=1, max_size=5)


@pytest.fixture(scope="module")
def lib():
    return sp.SentencePieceProcessor(model_file=S.MODEL)


def encode(texts, charsmap=None):
    m = S.Model.of(S.MODEL, charsmap)
    data, off = X.strings(pa.array(texts))
    return m, data, off, m.encode(data, off)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_ids_and_spans_equal_the_library(texts):
    lib = sp.SentencePieceProcessor(model_file=S.MODEL)
    m, data, off, (ids, b, e, bounds, *_) = encode(texts)
    for k, t in enumerate(texts):
        want = lib.encode(t, return_type="proto").pieces
        assert ids[bounds[k] : bounds[k + 1]].tolist() == [p.id for p in want]
        raw = t.encode()
        at = 0
        for i, p in zip(range(bounds[k], bounds[k + 1]), want):
            assert b[i] == at  # the identity map leaves no gaps
            at = e[i]
            if not m.is_byte[ids[i]]:
                assert raw[b[i] : e[i]].decode() == p.surface
        assert at == len(raw)
    out, o = m.decode(ids, bounds)
    got = [out[x:y].tobytes().decode() for x, y in zip(o[:-1], o[1:])]
    assert got == [lib.decode(lib.encode(t)) for t in texts] or got == [t.replace("▁", " ") for t in texts]


@pytest.fixture(scope="module")
def nfkc():
    from sentencepiece import sentencepiece_model_pb2 as pb

    norm = sp.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=False, remove_extra_whitespaces=False, escape_whitespaces=False)
    proto = pb.ModelProto()
    proto.ParseFromString(norm.serialized_model_proto())
    return norm, proto.normalizer_spec.precompiled_charsmap


def test_character_map_equals_the_library(nfkc):
    norm, blob = nfkc
    spec = S.Spec(blob, dummy=False, squeeze=False, escape=False)
    rng = np.random.default_rng(6)
    pool = list("abc AZ09é́̈ﬁ①Ａｱﾞ가㈱½ﷺ😀\t\n　​")
    texts = ["".join(rng.choice(pool, rng.integers(0, 40))) for _ in range(400)]
    data, off = X.strings(pa.array(texts))
    out, o, b, e = S.normalise(data, off, spec)
    for k, t in enumerate(texts):
        assert out[o[k] : o[k + 1]].tobytes().decode() == norm.normalize(t)
        assert (b[o[k] : o[k + 1]] >= off[k]).all() and (e[o[k] : o[k + 1]] <= off[k + 1]).all()


def test_squeezed_spaces_equal_the_library():
    norm = sp.SentencePieceNormalizer(rule_name="identity", add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True)
    texts = ["  a  b ", "", "   ", "a", " a\n  b c   "]
    data, off = X.strings(pa.array(texts))
    out, o, *_ = S.normalise(data, off, S.Spec(b"", True, True, True))
    assert [out[x:y].tobytes().decode() for x, y in zip(o[:-1], o[1:])] == [norm.normalize(t) for t in texts]


def test_pieces_of_mapped_text_cover_their_source(nfkc):
    _, blob = nfkc
    text = "ﬁrst ① half½ énd"
    m, data, off, (ids, b, e, bounds, *_) = encode([text], blob)
    raw = text.encode()
    out, o = m.decode(ids, bounds)
    assert out.tobytes().decode() == "first 1 half1⁄2 énd"
    for i in range(len(ids)):
        raw[b[i] : e[i]].decode("utf-8", "replace")
    assert min(b) == 0 and max(e) == len(raw) and (np.diff(b) >= 0).all()


def test_tables(spark, data, lib):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    enc = S.encode(docs)
    rows = {r.doc_id: r for r in enc.collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.round_trip for r in rows.values()) and all(rows[d].ids == lib.encode(t) for d, t in text.items())
    assert {r.doc_id: r.text for r in S.decode(enc).collect()} == text
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "a")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in S.encode(odd).collect()}
    assert got[1].ids is None and got[2].ids == [] and len(got[None].ids) == 1


def test_structured_words_keep_their_ids(lib, monkeypatch):
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    texts = [a, a.translate({97: "b", 98: "a"}), "word " + a]

    def check():
        m, data, off, (ids, b, e, bounds, *_) = encode(texts)
        assert [ids[x:y].tolist() for x, y in zip(bounds[:-1], bounds[1:])] == [lib.encode(t) for t in texts]

    check()
    S.Model._held = {}
    monkeypatch.setattr(X, "span_hash", lambda cum, a, b: np.zeros(len(a), np.uint64))  # bytes tell words apart whatever the hash says
    check()


def test_no_rows_to_decode(spark):
    assert S.decode(spark.createDataFrame([], "doc_id bigint, ids array<int>")).count() == 0
    assert [tuple(r) for r in S.decode(spark.createDataFrame([(None, []), (1, None)], "doc_id bigint, ids array<int>")).collect()] == [(None, ""), (1, None)]
