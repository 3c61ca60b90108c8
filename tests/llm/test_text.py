"""Encoding, packing and personal information: exact round trips and edge cases."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.llm import phrases
from tidecurve.llm import packing as P, pii_lexer as X, pii_model as M, personal, tokens as K, transducer as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


def test_transducer_round_trip():
    rng = random.Random(4)
    words = {bytes(rng.choices(b"abcd", k=rng.randint(1, 7))): [rng.randint(0, 9)] * rng.randint(1, 3) for _ in range(600)}
    read = T.Transducer(T.compile_lexicon(words))
    assert all(read.get(w) == ids for w, ids in words.items())
    others = [bytes(rng.choices(b"abcde", k=rng.randint(1, 8))) for _ in range(500)]
    assert all(read.get(w) is None for w in others if w not in words)
    assert read.words == len(words) and read.states < 600 * 4
    for listed in (sorted([*words, *others]), [*others, *words]):
        assert list(read.walk(listed)) == [words.get(w) for w in listed]


def test_transducer_is_minimal():
    read = T.Transducer(T.compile_lexicon({w: [1] for w in (b"tap", b"taps", b"top", b"tops")}))
    assert read.states == 5  # t, a|o, p, s and the root


def test_merges_equal_the_library(tokenizer):
    ranks = K.load_ranks(K.VOCABULARY)
    rng = random.Random(1)
    for word in ["Hello", "naïve", "中文字", "x" * 3000, "ab" * 700, *("".join(rng.choices("abcdefghé中", k=30)) for _ in range(100))]:
        assert K.merge(word.encode(), ranks) == tokenizer.encode(word, add_special_tokens=False).ids


def test_encoding(spark, tokenizer):
    texts = [None, "", "   \n\t ", "Hello  world's <|endoftext|>", "ünïcödé ﬁ​x", "a" * 5000, "don't  \r\n stop", "Hello  world's <|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit("clash")).withColumn("key", F.lit(1))
    got = {r["doc_id"]: list(r["ids"]) for r in K.encode_texts(df, "doc_id", "text").collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        assert got[k] == (tokenizer.encode(text, add_special_tokens=False).ids if text else [])
    small = K.build_lexicon(df, "text", share=0.2)
    assert {r["doc_id"]: list(r["ids"]) for r in K.encode_texts(df, "doc_id", "text", small).collect()} == got
    sizes = {r["doc_id"]: r["n_tokens"] for r in K.count_tokens(df, "doc_id", "text", small).collect()}
    assert sizes == {k: len(v) for k, v in got.items()}
    assert K.encode_texts(df.limit(0), "doc_id", "text").count() == 0


def test_harmonic_fill():
    rng = random.Random(2)
    for _ in range(30):
        sizes = [rng.randint(0, 100) for _ in range(rng.randint(0, 200))]
        bins = P.harmonic_fill(sizes, 100)
        fill = {}
        for b, s in zip(bins, sizes):
            fill[b] = fill.get(b, 0) + s
        assert all(v <= 100 for v in fill.values())
        assert len([v for v in fill.values() if v]) <= -(-sum(sizes) // 100) * 1.35 + 1
        assert set(bins) == set(range(max(bins, default=-1) + 1))


def test_layouts_depend_on_classes_alone():
    rng = random.Random(5)
    bounds = P.class_bounds(2048)
    sizes = [min(2048, int(rng.lognormvariate(5, 1)) + 1) for _ in range(3000)]
    assert {2048 // k for k in range(1, 2049)} <= set(bounds.tolist())
    widest = [int(bounds[bounds.searchsorted(s)]) for s in sizes]  # every item as long as its class allows
    assert P.harmonic_fill(sizes, 2048) == P.harmonic_fill(widest, 2048)
    assert max(P.harmonic_fill(sizes, 2048)) + 1 <= 1.03 * sum(sizes) / 2048 + 2


def test_pack(spark):
    rows = [(1, 5000), (2, 2048), (3, 0), (4, None), *((10 + k, 300) for k in range(200))]
    df = spark.createDataFrame(rows, "doc_id bigint, n bigint").withColumn("shard", F.lit("x"))
    out = P.pack(df, "doc_id", "n", 2048, 50).collect()
    fill, pieces = {}, {}
    for r in out:
        fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["length"]
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    assert max(fill.values()) <= 2048
    assert sorted(pieces[1]) == [(0, 0, 2048), (1, 2048, 2048), (2, 4096, 904)]
    assert all(len(v) == 1 for k, v in pieces.items() if k != 1) and len(pieces) == len(rows)
    assert P.pack(df.limit(0), "doc_id", "n").count() == 0


@pytest.mark.parametrize(
    "text,expected",
    [
        ("write to reel.ramo [at] example DOT com now", [("<email>", "reel.ramo [at] example DOT com")]),
        ("mailto:REEL.N@POST.EXAMPLE", [("<email>", "REEL.N@POST.EXAMPLE")]),
        ("see you @ the matinee, @handle", [("<link>", "@handle")]),
        ("tel: ６８６ ５５５ ０１８５.", [("<ten>", "６８６ ５５５ ０１８５")]),
        ("+44 (0)20 7946 0395", [("<world>", "+44 (0)20 7946 0395")]),
        ("passport (000 12 2129)", [("<social>", "000 12 2129")]),
        ("at Harrier House, 465 Copper Rd", [("<numbered>", "Harrier House, 465 Copper Rd")]),
        ("lives at No. 363, Millrace Lane", [("<numbered>", "No. 363, Millrace Lane")]),
        ("156 bis rue des Moulin", [("<numbered>", "156 bis rue des Moulin")]),
        ("in Barrowgasse 285a, 65654", [("<joined>", "Barrowgasse 285a")]),
        ("Plaza Mayor Vieja 175", [("<named>", "Plaza Mayor Vieja 175")]),
        ("Take 15 Road test, ISRC ZZ-9CA-41-38698", [("<code>", "ZZ-9CA-41-38698")]),
    ],
)
def test_outlines(text, expected):
    _, cut = X.cut(text)
    marked = [(form, text[s:e]) for s, e, form in cut if form[0] == "<" and form not in ("<digits>", "<") and len(form) > 1]
    assert [m for m in marked if m in expected or m[0] != "<digits>"][: len(expected)] == expected


@pytest.fixture(scope="module")
def trained(sf):
    rows = pq.read_table(f"{sf}/../sf0.1/documents.parquet", columns=["text"]).column("text").to_pylist()
    docs = [t for t in rows if t and t.strip()]
    return M.train(docs[:2500]), docs[2500:4000]


def test_names_in_phrases_nobody_trained_on(trained):
    """Names found in texts not seen in training, held against phrases that no evidence lists."""
    model, docs = trained
    hit = wrong = missed = 0
    for at in range(0, len(docs), 300):
        cuts = [X.cut(t) for t in docs[at : at + 300]]
        for (flat, tokens), labels in zip(cuts, M.predict(model, [c[1] for c in cuts])):
            got = {s for s, _, kind in M.entities(model, tokens, labels) if kind == "name"}
            want = phrases.named(flat)
            hit, wrong, missed = hit + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert hit > 200 and hit / (hit + wrong) > 0.93 and hit / (hit + missed) > 0.93


def test_skip_links_lift_repeats(trained):
    """A person named once in a telling place and again in a bare one: more repeats are found with the links than without."""
    model, docs = trained
    texts = []
    for text in docs:
        flat, tokens = X.cut(text)
        first = next((flat[s:e] for s, e, k in M.entities(model, tokens, M.predict(model, [tokens])[0]) if k == "name" and " " in flat[s:e]), None)
        if first and len(text) < 2500:
            texts += [(f"{text}\n{first}", len(text) + 1), (f"{text} Sent to {first.split()[-1]} again.", len(text) + 9)]
    found = {}
    for skip in (True, False):
        cuts = [X.cut(t)[1] for t, _ in texts]
        found[skip] = sum(
            any(s == at and k == "name" for s, _, k in M.entities(model, c, y)) for c, y, (_, at) in zip(cuts, M.predict(model, cuts, skip), texts))
    assert model.skips[0] > 0.1 and found[True] > found[False]


def test_messages_rest_and_agree_with_exact_marginals():
    """Two short chains joined by one skip link are a tree: message passing is exact there."""
    rng = np.random.default_rng(3)
    forms = {f: k for k, f in enumerate(M._GENERIC)}
    vocabulary = M.Vocabulary(forms, set())
    shape = lambda *s: rng.normal(0, 1, s).astype(np.float32)
    model = M.Model(vocabulary, shape(len(M.OFFSETS), len(forms), M.COUNT), shape(len(M.NEAR), M.KINDS, M.COUNT), shape(M.COUNT, M.COUNT), np.array([1.3, 0.4], np.float32))
    scores, chain = shape(5, M.COUNT), model.chain + M._NEVER
    laid = M.Laid(np.zeros(5, np.int32), np.zeros(5, np.int32), [(0, 5)], np.array([[1, 3, 0]]))
    got = M._beliefs(model, laid, scores, np.array([[0, 2], [2, 5]]))
    exact = np.zeros((5, M.COUNT))
    first = scores[0][:, None] + chain + scores[1][None]  # labels of tokens 0, 1
    back = scores[2][:, None, None] + chain[:, :, None] + scores[3][None, :, None] + chain[None] + scores[4][None, None]  # tokens 2, 3, 4
    joint = np.exp(first[:, :, None, None, None] + back[None, None] + 1.3 * M._AGREE[None, :, None, :, None])
    for k in range(5):
        exact[k] = joint.sum(tuple(a for a in range(5) if a != k))
    assert np.allclose(np.exp(got), exact / exact.sum(1, keepdims=True), atol=0.02)


def test_words_are_counted_alike(spark):
    texts = ["The old Dunroven mill. Ramo saw Dunroven at night, ramo's IRON gate", "In Dunroven, Ramo won’t sing. The IRON gate", None, "  ", "a gate in Dunroven"] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    here = M.vocabulary_of(M.count_words([X.cut(t)[1] for t in texts if t and t.strip()]), 15)
    there = personal.words(df, "text")
    words = lambda v: {f for f in v.forms if f[0].isalpha()}
    assert words(there) == words(here) and there.proper == here.proper and "dunroven" in there.proper


def test_personal_edges(spark):
    texts = [None, "", "  ", "Write to a.b@mail.example or +1 214 555 0197.", "nothing here", "Write to a.b@mail.example or +1 214 555 0197." * 3, "x " * 20000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("kind", F.lit("clash"))
    model = M.train([t for t in texts if t] * 30)
    got = [(r["doc_id"], r["kind"], r["start_pos"]) for r in personal.occurrences(df, "doc_id", "text", model).collect()]
    assert (3, "email", 9) in got and (3, "phone", 29) in got and {g[0] for g in got} == {3, 5}
    clean = {r["doc_id"]: r["text"] for r in personal.redacted(df, "doc_id", "text", model).collect()}
    assert clean[3] == "Write to [EMAIL] or [PHONE]." and clean[0] is None and clean[1] == "" and clean[6] == texts[6]
    assert personal.occurrences(df.limit(0), "doc_id", "text").count() == 0
