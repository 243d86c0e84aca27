"""Quality rules, secret scan, packing, sampled pieces, classifier on small texts."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from honestpick.llm import packing, piece_sampling, quality_classifier, quality_rules, secret_scan
from tests.llm import brute
from tests.llm.conftest import frame

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TEXT = st.text(st.sampled_from("ab .\n\t é!1'<|>▁z🎉"), max_size=60)


# quality rules -------------------------------------------------------------------------------
def test_base_measures(docs, rows):
    judged = quality_rules.judge(docs)
    assert judged.columns == [*docs.columns, "_quality"]
    got = judged.select("doc_id", *[f"_quality.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")])
    assert Counter(map(tuple, got.collect())) == Counter(
        (i, *brute.base_measures(t)) for i, t in rows)


def test_common_lines(spark):
    def text(i, extra):
        line = " ".join(f"w{i}x{j}" for j in range(61))       # digits count as one another
        return "\n".join([line.translate(str.maketrans("0123456789", "abcdefghij")), *extra])
    pairs = []
    for i in range(1, 61):
        tail = "abcdefghijklmnopqrstuvwxyz"
        more = [f"now{p}{q}" for p in tail for q in tail][:90 if i % 10 == 0 else 3]
        notice = "  Read   our 2020 NOTICE " + " ".join(more)
        pairs.append((i * 2, text(i, [notice] if i % 2 else [notice.replace("2020", "2031")])))
    pairs += [(1000, pairs[0][1])] * 50         # copies are one document
    df = frame(spark, pairs).withColumn("source", F.when(F.col("doc_id") < 1000, F.lit(None))
                                        .otherwise("copies").cast("string"))
    got = quality_rules.judge(df.drop("quality"), min_docs=20, max_share=0.3).collect()
    for r in got:
        cut = r.quality.n_words_cut
        if r.doc_id == 1000 or r.doc_id // 2 % 10 == 0:
            assert cut == 0 and r.quality.kept and r.quality.clean == r.text
        else:
            assert cut == 7 and r.quality.clean == r.text.split("\n")[0] and r.quality.kept
    # the long notice is rarer than the limit above, not than this one
    low = quality_rules.judge(df.drop("quality"), min_docs=1, max_share=0.01,
                              min_left=0.9).collect()
    assert {r.doc_id for r in low if not r.quality.kept} == {i for i, _ in pairs if i < 1000}


def test_quality_odd_rows(nulls, empty):
    got = quality_rules.judge(nulls.drop("quality")).collect()
    assert len(got) == 7 and sum(r.quality.kept for r in got) == 5
    assert all(r.quality.base_failed and r.quality.n_words == 0 for r in got if r.text is None)
    assert quality_rules.judge(empty.drop("quality")).count() == 0


# secrets -------------------------------------------------------------------------------------
def test_base_spans(docs, rows):
    got = secret_scan.digest(secret_scan.scan(docs)).collect()
    want = []
    for i, t in rows:
        s = brute.base_spans(t)
        n = Counter(k for k, _, _ in s)
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in s)
        want.append((i, n["assign"], n["access"], n["hex"],
                     hashlib.sha256(line.encode()).hexdigest(), line))
    assert Counter(map(tuple, got)) == Counter(want)


SECRETISH = st.text(st.sampled_from(list("aA1_=: \"'.-é") + ["token", "secret", "api_key", "AKIA",
                                    "passwd", "PassWord", "0123456789abcdef", "ſ", "İ"]),
                    max_size=30)


@given(st.lists(st.sampled_from(["token", "secret", "api_key", "apikey", "AKIA", "passwd", "=", ":",
                                 " ", "\"", "abcdef", "ABCDEF01234567890", "é", "ſ", "İ", "_", ".",
                                 "0123456789abcdef", "PASSWORD"]), max_size=14).map("".join))
@settings(max_examples=300, deadline=None)
def test_spans_like_a_full_search(text):
    auto = secret_scan.keyword_automaton()
    got = [s for s in secret_scan.find_spans(text, auto) if s[0] != "issued"]
    assert got == brute.base_spans(text)


def test_issued_tokens_need_their_checksum():
    auto = secret_scan.keyword_automaton()
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    good = "ghp_" + body + secret_scan.checksum62(body)
    bad = "npm_" + body + "000000"
    assert secret_scan.find_spans(f"é {good}, {bad}", auto) == [("issued", 2, 42)]
    assert secret_scan.find_spans(good + "x", auto) == []
    text = f"a token={good} b"
    spans = secret_scan.find_spans(text, auto)
    assert [s[0] for s in spans] == ["assign", "issued"]
    assert secret_scan.redact(text, spans) == "a [assign removed] b"


def test_redacted_keeps_columns(docs, nulls, empty):
    out = secret_scan.redacted(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    changed = out.join(docs.select("doc_id", F.col("text").alias("was")).distinct(), "doc_id")
    auto = secret_scan.keyword_automaton()
    for r in changed.collect():
        spans = secret_scan.find_spans(r.was or "", auto)
        assert (r.text == r.was) == (not spans)
        if r.text:
            assert not secret_scan.find_spans(r.text, auto)
    assert Counter(secret_scan.redacted(nulls).collect()) == Counter(nulls.collect())
    assert secret_scan.redacted(empty).count() == secret_scan.scan(empty).count() == 0


# packing -------------------------------------------------------------------------------------
@pytest.mark.parametrize("length", [7, 2048])
def test_packing(docs, rows, length):
    tok = Tokenizer.from_file(BPE)
    ids = Counter(tuple([*tok.encode(t or "", add_special_tokens=False).ids, 1]) for _, t in rows)
    pieces = packing.pack(docs, BPE, length, with_ids=True).collect()
    seqs, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) and 0 < p.length <= length
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        seqs[p.sequence_id].append((p.offset, p.length))
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at == length or s is seqs[max(seqs)]
    assert sorted(seqs) == list(range(len(seqs)))
    stream = [x for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)) for x in p.ids]
    found, doc = Counter(), []
    for x in stream:
        doc.append(x)
        if x == 1 and tuple(doc) in ids:
            found[tuple(doc)] += 1
            doc = []
    assert found == ids
    del by_doc


def test_packing_odd_rows(nulls, empty):
    got = packing.pack(nulls, BPE).collect()
    assert sum(p.doc_tokens == 1 for p in got if p.start == 0) == 2
    assert packing.pack(empty, BPE).count() == 0


@given(st.lists(TEXT, max_size=6))
@settings(max_examples=200, deadline=None)
def test_chunked_ids_are_the_tokenizers(texts):
    known = packing.chunk_ids(BPE, "<u2")
    want = [e.ids for e in known.tokenizer.encode_batch([*texts, "it's <|endoftext|> x"],
                                                        add_special_tokens=False)]
    got = [np.frombuffer(x, "<u2").tolist() for x in known.of([*texts, "it's <|endoftext|> x"])]
    assert got == want


# sampled pieces ------------------------------------------------------------------------------
def test_pieces_round_trip(docs, rows, nulls, empty):
    got = piece_sampling.encode(docs, PIECES).cache()
    assert got.where("NOT lossless OR n_ids <> size(ids)").count() == 0
    back = piece_sampling.decode(got, PIECES)
    assert Counter(map(tuple, back.collect())) == Counter((i, t or "") for i, t in rows)
    again = piece_sampling.encode(docs.repartition(7), PIECES)
    assert Counter(map(str, got.collect())) == Counter(map(str, again.collect()))
    other = piece_sampling.encode(docs, PIECES, seed=1)
    assert Counter(map(str, got.collect())) != Counter(map(str, other.collect()))
    assert [r.n_ids for r in piece_sampling.encode(nulls, PIECES).collect()].count(0) == 2
    assert piece_sampling.encode(empty, PIECES).count() == 0


@pytest.mark.parametrize("alpha", [1.0, 0.2])
def test_pieces_follow_path_weights(alpha):
    lat = piece_sampling.lattice(PIECES, alpha, True)
    text, n = " them", 20_000

    def paths(s):
        if not s:
            yield (), 0.0
        for k in range(1, len(s) + 1):
            if s[:k] in lat.id_of:
                for p, w in paths(s[k:]):
                    yield (lat.id_of[s[:k]], *p), w + lat.weight[lat.id_of[s[:k]]]

    want = {p: math.exp(w) for p, w in paths(text)}
    total = sum(want.values())
    got = Counter(tuple(x.tolist()) for x in lat.sample(
        [text] * n, piece_sampling.seeds_of(list(range(n)), 1)))
    assert set(got) <= set(want)
    for p, w in want.items():
        q = w / total
        assert abs(got[p] / n - q) < 5 * math.sqrt(q * (1 - q) / n) + 1e-4


@given(TEXT)
@settings(max_examples=200, deadline=None)
def test_any_text_is_decoded(text):
    lat = piece_sampling.lattice(PIECES, 1.0, True)
    ids = lat.sample([text, text[::-1]], piece_sampling.seeds_of([1, 2], 0))
    assert [lat.decode(x.tolist()) for x in ids] == [text, text[::-1]]


# classifier ----------------------------------------------------------------------------------
def graded_docs(spark):
    r = np.random.default_rng(4)
    good, bad = ([f"{p}{i}" for i in range(80)] for p in "gb")
    data = []
    for i in range(600):
        grade = i % 3
        w = [str(r.choice(bad if r.random() < (0.9, 0.5, 0.1)[grade] else good))
             for _ in range(60)]
        data.append((i, " ".join(w)))
    return data


def test_classifier_on_held_out_rows(spark):
    data = graded_docs(spark)
    df = frame(spark, data)
    labels = df.where("doc_id < 400").select("doc_id", (F.col("doc_id") % 3).alias("grade"))
    labels = labels.union(spark.createDataFrame([(None, 1), (3, None), (9999, 2), (6, 7)],
                                                "doc_id bigint, grade bigint"))
    model = quality_classifier.train(df, labels, grades=3)
    assert np.all(np.diff(model.thresholds) > 0)
    rows = [r for r in quality_classifier.score(df, model).collect() if r.doc_id >= 400]
    right = [round(r.expected_grade) == r.doc_id % 3 for r in rows]
    assert sum(right) > 0.9 * len(rows)
    assert all(r.p_over_0 >= r.p_over_1 for r in rows)
    kept = quality_classifier.select(df, model, over=1)
    assert kept.columns == df.columns
    assert sum(r.doc_id % 3 == 2 for r in kept.collect()) > 0.9 * kept.count()


def test_classifier_gradient_reaches_the_maximum():
    """Three rows of one feature: better than any nearby parameters."""
    rows = [(0, [0], [1.0]), (1, [0], [2.0]), (1, [1], [1.0]), (2, [0], [3.0]), (0, [0], [2.5])]
    model = quality_classifier.fit(rows, 3, penalty=1e-3, steps=3000, rate=0.05)

    def loss(w, cuts):
        cut, total = np.concatenate([[-np.inf], cuts, [np.inf]]), 0.0
        for y, idx, val in rows:
            s = sum(w[i] * v for i, v in zip(idx, val, strict=True))
            up, low = (1 / (1 + np.exp(s - cut[y + 1])), 1 / (1 + np.exp(s - cut[y])))
            total -= math.log(up - low)
        return total / len(rows) + 0.5e-3 * float(w @ w)

    best = loss(model.weights, model.thresholds)
    for k in range(2):
        for d in (-0.05, 0.05):
            w, cuts = model.weights.copy(), model.thresholds.copy()
            w[k] += d
            assert loss(w, cuts[:]) > best - 1e-7
            cuts[k] += d
            assert loss(model.weights, cuts) > best - 1e-7


def test_classifier_odd_rows(spark, nulls, empty):
    model = quality_classifier.train(empty, empty.select("doc_id", F.col("n").alias("grade")))
    got = quality_classifier.score(nulls, model).collect()
    assert len(got) == 7 and all(abs(r.expected_grade - 1) < 0.01 for r in got)
    assert quality_classifier.select(nulls, model).count() == 5     # null texts go
    assert quality_classifier.score(empty, model).count() == 0
