"""Cross-tokenizer alignment, conversation repair, source mixing against plain Python."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from honestpick.llm import conversation_repair, queries, source_mixing, token_alignment
from honestpick.llm.conversation_repair import Conversation, Costs
from tests.llm import brute
from tests.llm.conftest import frame

A, B = queries.BPE_50K, queries.PIECES_32K
TOKENS = Tokenizer.from_file(A)
TOKENS.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=B)
_SHOWN = [b for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r)]
_LETTER = {chr(b): b for b in _SHOWN}
_LETTER |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


# alignment -----------------------------------------------------------------------------------
def align_one(text):
    """(A ids, B ids, groups as id lists) of a text encoded whole."""
    if not text:
        return [], [], []
    a, b = TOKENS.encode(" " + text, add_special_tokens=False).ids, PIECES.encode(text)
    ba = [bytes(_LETTER[c] for c in TOKENS.id_to_token(i)) for i in a]
    bb = [bytes([int(PIECES.id_to_piece(i)[3:5], 16)]) if PIECES.is_byte(i)
          else PIECES.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(ba) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
        return [], [], []
    ea, eb = (np.cumsum([len(x) for x in y]).tolist() for y in (ba, bb))
    groups, i, j = [], 0, 0
    for cut in sorted(set(ea) & set(eb)):
        k, m = ea.index(cut) + 1, eb.index(cut) + 1
        groups.append((a[i:k], b[j:m]))
        i, j = k, m
    return a, b, groups


def shown(groups):
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


def align_all(rows):
    found, count = [], Counter()
    for i, t in rows:
        a, b, groups = align_one(t)
        links = Counter(p for x, y in groups for p in itertools.product(x, y))
        count.update(links.keys())
        found.append((i, a, b, groups, links))
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    return Counter((i, len(a), len(b), len(g), links.total(),
                    sum(n for p, n in links.items() if count[p] == top[p[0]]),
                    sum(n * count[p] for p, n in links.items()),
                    hashlib.sha256(shown(g).encode()).hexdigest() if g else "")
                   for i, a, b, g, links in found), count


@given(st.lists(st.sampled_from(list("ab .\n\té!1'<|>z🎉▁\x1c\x85\xa0") + [
    "  ", "<s>", "<|endoftext|>", " the", "'s", "ing", "\r\n", "ﬁ"]), max_size=30).map("".join))
@settings(max_examples=400, deadline=None)
def test_alignment_of_odd_texts(text):
    aligner = token_alignment._aligner(A, B)
    chunks = aligner.of([text])[0]
    assert aligner.groups(chunks) == shown(align_one(text)[2])


@given(st.lists(st.integers(1, 9), min_size=1, max_size=40),
       st.lists(st.integers(1, 9), min_size=1, max_size=40))
def test_cuts_are_the_common_ends(x, y):
    x[-1] += max(0, sum(y) - sum(x))
    y[-1] += max(0, sum(x) - sum(y))
    a, b = np.cumsum(x).tolist(), np.cumsum(y).tolist()
    cuts = sorted(set(a) & set(b))
    starts = [0, *cuts[:-1]]
    pos = {e: i + 1 for i, e in enumerate(a)} | {0: 0}, {e: i + 1 for i, e in enumerate(b)} | {0: 0}
    # two equal intervals, one after the other
    x, y, n, m = [*a, *[e + a[-1] for e in a]], [*b, *[e + b[-1] for e in b]], len(a), len(b)
    got = token_alignment.cut_groups(*(np.array(v) for v in (x, y, [0, n], [n, 2 * n], [0, m],
                                                             [m, 2 * m])))
    want = [(pos[0][s], pos[0][e], pos[1][s], pos[1][e]) for s, e in zip(starts, cuts, strict=True)]
    assert list(zip(*[g.tolist() for g in got], strict=True)) == want + [
        (i + n, k + n, j + m, o + m) for i, k, j, o in want]


def test_large_groups_and_long_chunks(spark):
    """Long stretches without spaces; pairs of a large group are counted by id."""
    r = random.Random(1)
    texts = ["".join(r.choice("aeiouxq") for _ in range(4000)), "é" * 3000, "字" * 500 + " 字",
             "".join(r.choice("0123456789") for _ in range(3000))]
    old, token_alignment._LARGE = token_alignment._LARGE, 3
    try:
        aligner = token_alignment.Aligner(A, B)
        for t in texts:
            chunks = aligner.of([t])[0]
            a, b, groups = align_one(t)
            assert aligner.groups(chunks) == shown(groups)
            numbers = np.array(aligner.numbers).reshape(-1, 6)
            _, codes, code, total = token_alignment._doc_pairs(
                numbers, np.array(aligner.pairs), np.array(aligner.times), [chunks])
            links = Counter(p for x, y in groups for p in itertools.product(x, y))
            assert {(int(codes[c]) >> 32, int(codes[c]) & 0xFFFFFFFF): int(n)
                    for c, n in zip(code, total, strict=True)} == dict(links)
    finally:
        token_alignment._LARGE = old


@pytest.mark.parametrize("chars", [500, 4_000_000])
def test_alignment(docs, rows, chars):
    want, count = align_all(rows)
    saved = token_alignment.aligned(docs, A, B, chars=chars)
    pairs = token_alignment.link_counts(saved)
    assert {(r.a, r.b): r.docs for r in pairs.collect()} == dict(count)
    got = token_alignment.with_counts(saved, pairs)
    assert Counter(map(tuple, got.collect())) == want
    assert {(r.doc_id, r.groups) for r in token_alignment.groups(docs, A, B, chars=chars).collect()
            } == {(i, shown(align_one(t)[2])) for i, t in rows}


def test_alignment_odd_rows(spark, nulls, empty):
    assert token_alignment.align(empty, A, B).count() == 0
    rows = [(r.doc_id, r.text) for r in nulls.collect()]
    assert Counter(map(tuple, token_alignment.align(nulls, A, B).collect())) == align_all(rows)[0]
    none = frame(spark, [(1, None), (2, ""), (3, "a▁b")])
    assert {tuple(r) for r in token_alignment.align(none, A, B).collect()} == {
        (i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)}


# conversations -------------------------------------------------------------------------------
def faults(rows):
    seen, found = set(), []
    for role, text in rows:
        w = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
        found.append("blank" if not w else "duplicate" if (role, text) in seen
                     else "truncated" if w[-1] not in ".!?" else None)
        seen.add((role, text))
    return found


def repair_one(rows, costs=Costs(), inserts=2):
    """All edits with so many inserted rows at most."""
    options = []
    for row, fault in zip(rows, faults(rows), strict=True):
        more = costs.truncated if fault == "truncated" else 0
        options.append([("D", costs.delete, None)] + ([] if fault in ("blank", "duplicate") else [
            ("K", more, row), *[("R", costs.rerole + more, (r, row[1]))
                                for r in ("user", "assistant")]]))
    gaps = [g for n in range(3) for g in itertools.product(("user", "assistant"), repeat=n)]
    found = []
    for put in itertools.product(gaps, repeat=len(rows) + 1):
        if sum(map(len, put)) > inserts:
            continue
        for chosen in itertools.product(*options):
            cost, audit, out = 0, "", []
            for i, gap in enumerate(put):
                out += [(r, "") for r in gap]
                cost, audit = cost + costs.insert * len(gap), audit + "I" * len(gap)
                if i < len(rows):
                    letter, c, row = chosen[i]
                    cost, audit, out = cost + c, audit + letter, out + ([row] if row else [])
            if all(r for r, _ in out) and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out)):
                found.append((cost, audit, out))
    cost, audit, out = min(found, key=lambda f: f[:2])
    return cost, audit, "\n".join(f"{r}:{t}" for r, t in out)


ROLES = st.sampled_from(["user", "assistant", "system", "tool", " ", ""])
SAID = st.sampled_from(["a.", "b", "c!", "  ", "", "d? "])


@given(st.lists(st.tuples(ROLES, SAID), max_size=4),
       st.builds(Costs, st.integers(1, 6), st.integers(1, 9), st.integers(4, 5), st.integers(0, 5)))
@settings(max_examples=150, deadline=None)
def test_cheapest_repair(rows, costs):
    c = Conversation(1, costs)
    for i, (role, text) in enumerate(rows):
        c.read(i, role, text)
    cost, audit, out = repair_one(rows, costs)
    assert c.result()[-3:] == (cost, audit, hashlib.sha256(out.encode()).hexdigest())


def test_inserts_when_they_are_cheap():
    c = Conversation(1, Costs(rerole=9, delete=9, insert=1))
    c.read(0, "assistant", "yes.")
    c.read(1, "assistant", "no.")
    assert c.result()[-3:-1] == (2, "IKIK")


def test_long_conversation_takes_little():
    r = random.Random(2)
    c = Conversation(1, Costs())
    for i in range(30_000):
        c.read(i, r.choice(["user", "assistant", "system"]), f"{i}{r.choice('.a')}")
    assert c.search.room <= 256 and len(c.search.nodes) <= 4
    got = c.result()
    assert len(got[-2]) == 30_000 and got[1] == 0


def test_repair(spark, empty):
    r = random.Random(4)
    rows = [(k if k % 5 else None, t, r.choice(["user", "assistant", "system", None, "tool"]),
             r.choice(["a.", "b", "c!", " ", None, "d?"]))
            for k in range(40) for t in [None, *range(r.randint(0, 3))]]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string") \
        .withColumn("k", F.lit("x")).withColumn("place", F.lit(None).cast("int")).repartition(5)
    there = F.coalesce(F.col("conv_id") != 7, F.lit(True))
    audits = conversation_repair.repair(df, there=there)
    got = {x.conv_id: x for x in audits.collect()}
    by = defaultdict(list)
    for k, t, role, text in rows:
        by[k].append((-1 if t is None else t, role or " ", " " if text is None else text))
    assert set(got) == set(by)
    lines = defaultdict(list)
    for x in conversation_repair.repaired(df, audits, there=there).collect():
        lines[x.conv_id].append((x.place, f"{x.role}:{x.text}"))
    for k, conv in by.items():
        conv = [] if k == 7 else [(a, b) for _, a, b in sorted(conv)]
        text = "\n".join(x for _, x in sorted(lines[k]))
        assert got[k].repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [got[k][f] for f in ("blank", "duplicate", "truncated")] == [
            faults(conv).count(f) for f in ("blank", "duplicate", "truncated")]
        pairs = list(itertools.pairwise(a[:1] for a, _ in conv))
        assert got[k].illegal == sum(x + y not in ("su", "ua", "au") for x, y in pairs)
        if len(conv) < 5:
            assert (got[k].cost, got[k].audit, text) == repair_one(conv)
    assert tuple(got[7])[1:8] == (0, 0, 0, 0, 0, 0, "")
    assert conversation_repair.repair(df.where("false")).count() == 0


def test_conversation_split_by_batches(spark):
    """One conversation has most rows; small Arrow batches."""
    rows = [(1, i, "ua"[i % 2] + "x", f"{i}.") for i in range(3000)] + [(2, 0, "user", "a.")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = {r.conv_id: r for r in conversation_repair.repair(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got[1].audit == "K" * 3000 and got[1].cost == 0 and got[2].audit == "D"


# mixing --------------------------------------------------------------------------------------
def fill(sizes, percent=150, epochs=2, weights=(3, 1, 2)):
    """Targets by the rule as it reads: clamp, share the excess, again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = percent * sum(sizes.values()) / 100
    target = {s: total * w[s] / sum(w.values()) for s in order}
    held = set()
    while over := {s for s in order if s not in held and target[s] > epochs * sizes[s] + 1e-9}:
        excess = sum(target[s] - epochs * sizes[s] for s in over)
        held |= over
        for s in over:
            target[s] = float(epochs * sizes[s])
        free = [s for s in order if s not in held]
        for s in free:
            target[s] += excess * w[s] / sum(w[x] for x in free)
    return target


def check_mix(df, **kw):
    got = source_mixing.mix(df, **kw).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size + r.extra
    want = fill(sizes)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-9)
    return got, want, taken


def test_mix(docs, rows):
    got, want, taken = check_mix(docs)
    assert Counter((r.doc_id, r.size) for r in got) == Counter(
        (i, len(brute.words(t))) for i, t in rows)
    # equal rows at the cut may lack a word each
    assert all(abs(taken[s] - want[s]) <= 3 for s in want)
    again = source_mixing.mix(docs.repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    other = source_mixing.mix(docs, seed=1).collect()
    assert {(r.doc_id, r.target) for r in other} == {(r.doc_id, r.target) for r in got}


def test_mix_hot_source(spark):
    """Most rows in one source, some sources far above their cap, long and empty texts."""
    r = random.Random(3)
    pairs = [(i, "w " * r.choice([0, 1, 5, 40, 900])) for i in range(1500)]
    df = spark.createDataFrame(pairs, "doc_id int, text string").withColumn(
        "source", F.when(F.col("doc_id") % 3 > 0, "hot").when(
            F.col("doc_id") % 30 == 0, F.lit(None).cast("string")).otherwise(
            F.concat(F.lit("s"), (F.col("doc_id") % 17).cast("string"))))
    _, want, taken = check_mix(df)
    assert all(abs(taken[s] - want[s]) < 1 for s in want)
    assert sum(want.values()) == pytest.approx(1.5 * sum(len(t.split()) for _, t in pairs))


def test_mix_odd_rows(spark, nulls, empty):
    assert source_mixing.mix(empty).count() == 0
    got, want, taken = check_mix(nulls)
    assert len(got) == 7 and len({tuple(r) for r in got}) < 7
    same = spark.createDataFrame([(1, "a b c d", "x")] * 9, "doc_id int, text string, source string")
    got = source_mixing.mix(same, percent=150).collect()
    assert {(r.taken, r.target) for r in got} == {(6, 54.0)}
    none = same.withColumn("text", F.lit(None).cast("string"))
    assert {(r.size, r.taken, r.target) for r in source_mixing.mix(none).collect()} == {(0, 0, 0.0)}
