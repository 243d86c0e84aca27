"""Exact dedup, substring dedup and Jaccard join against plain Python."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from honestpick.llm import exact_dedup, jaccard_join, substring_dedup
from tests.llm import brute
from tests.llm.conftest import frame


def key(rows):
    return Counter(map(tuple, rows))


def exact_want(pairs):
    out = []
    for i, t in pairs:
        same = [j for j, u in pairs if (u or "") == (t or "")]
        ids = [j for j in same if j is not None]
        out.append((i, max(ids) if ids else None, len(same)))
    return Counter(out)


@pytest.mark.parametrize("bits", [256, 2])
def test_exact(spark, docs, rows, bits):
    """Also with a digest of two bits, where different texts meet."""
    digest = exact_dedup.sha256 if bits == 256 else (
        lambda t: F.substring(F.sha2(t, 256), 1, 1).cast("binary"))
    got = exact_dedup.duplicates(docs, digest=digest, files_per_batch=1).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == exact_want(rows)
    texts = dict(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({t or "" for t in texts.values()})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_exact_odd_rows(spark, nulls, empty):
    got = exact_dedup.duplicates(nulls).collect()
    pairs = [(r.doc_id, r.text) for r in nulls.collect()]
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == exact_want(pairs)
    assert sum(r.kept for r in got) == 3        # equal rows with the largest id: one stays
    assert exact_dedup.duplicates(empty).count() == 0
    left = exact_dedup.distinct_texts(nulls)
    assert left.columns == nulls.columns and left.count() == 3


def test_exact_goes_on_from_its_state(spark, tmp_path):
    log, state = str(tmp_path / "log"), str(tmp_path / "state")
    one = frame(spark, [(1, "a"), (2, "b"), (3, "a")])
    exact_dedup.located(one).drop("text").write.parquet(log)
    first = {r.n: r.keep_id for r in exact_dedup.follow(spark, log, state).collect()}
    assert first == {2: 3, 1: 2}
    two = frame(spark, [(9, "b"), (5, "c")])
    exact_dedup.located(two).drop("text").write.mode("append").parquet(log)
    again = {(r.n, r.keep_id) for r in exact_dedup.follow(spark, log, state).collect()}
    assert again == {(2, 3), (2, 9), (1, 5)}


def test_substring(docs, rows):
    got = substring_dedup.deduplicate(docs, 50).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    assert key(got.collect()) == key(brute.substring_dedup(rows, 50))


def test_substring_random_overlaps(spark):
    """Short vocabulary, many repeats of all lengths around the window."""
    r = np.random.default_rng(3)
    pool = [str(x) for x in r.integers(0, 4, 4000)]
    pairs = []
    for i in range(60):
        parts = []
        for _ in range(r.integers(1, 6)):
            a, n = r.integers(0, 3900), r.integers(1, 90)
            parts += pool[a:a + n] + [f"u{r.integers(0, 50)}"] * int(r.integers(0, 3))
        pairs.append((int(i * 7 % 61), " ".join(parts)))
    for size in (16, 30, 50):
        got = substring_dedup.deduplicate(frame(spark, pairs), size).select(
            "doc_id", "n_words", "n_removed", F.sha2("kept", 256))
        assert key(got.collect()) == key(brute.substring_dedup(pairs, size))


def test_substring_odd_rows(nulls, empty):
    got = substring_dedup.deduplicate(nulls, 50).collect()
    assert key((r.doc_id, r.n_words, r.n_removed) for r in got) == Counter(
        {(None, 0, 0): 1, (4, 0, 0): 1, (None, 70, 0): 2, (4, 70, 70): 2, (2, 71, 0): 1})
    assert substring_dedup.deduplicate(empty, 50).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.deduplicate(empty, 10)


def test_places_do_not_depend_on_the_lot():
    """A document alone, last and followed by another; its last window in a longer text."""
    r = np.random.default_rng(8)

    def found(texts, k):
        got = substring_dedup.places(*substring_dedup._joined(texts, substring_dedup._HASHES), 50)
        return [row[1:] for row in zip(*(x.tolist() for x in got), strict=True) if row[0] == k]

    for _ in range(3000):
        one, other, more = (" ".join(str(x) for x in r.integers(0, 30, n))
                            for n in (r.integers(50, 70), 55, 20))
        alone = found([one], 0)
        assert alone == found([other, one], 1) == found([one, other], 0)
        last = len(one.split()) - 50
        x_alone, x_within = ({x for a, b, x, _ in rows if a <= last <= b}
                             for rows in (alone, found([f"{one} {more}"], 0)))
        assert x_alone == x_within


def test_equal_stretches_get_equal_places():
    """A window in other surroundings is filed under the same place and hash."""
    r = np.random.default_rng(1)
    window = r.integers(0, 6, 50).astype(np.uint64)
    found = set()
    for _ in range(40):
        left, right = (r.integers(0, 6, r.integers(0, 30)).astype(np.uint64) for _ in range(2))
        words = np.concatenate([np.array([99], np.uint64), left, window, right])
        doc, a, b, x, _ = substring_dedup.places(words, np.array([1]), np.array([len(words)]), 50)
        at = len(left)
        found.add(int(x[(a <= at) & (at <= b)][0]))
    assert len(found) == 1


@pytest.mark.parametrize("frequent", [131_072, 3, 0])
def test_jaccard(docs, rows, frequent):
    got = jaccard_join.join(docs, known_frequent=frequent)
    assert key(got.collect()) == key(brute.jaccard(rows))


def test_jaccard_chains_and_shared_passages(spark):
    """Chains of near copies, and a passage in every document."""
    r = np.random.default_rng(8)
    passage = [f"p{i}" for i in range(40)]
    pairs, n = [], 0
    for c in range(8):
        w = [f"c{c}w{i}" for i in range(100)]
        for step in range(9):
            for j in r.choice(100, 2 if c % 2 else 3, replace=False):
                w[j] = f"m{n}x{j}"
            n += 1
            pairs.append((n * 37 % 101, " ".join(w + passage * (c % 3))))
    pairs += [(200 + i, " ".join([f"z{i}", *passage])) for i in range(30)]
    got = jaccard_join.join(frame(spark, pairs, 5))
    assert key(got.collect()) == key(brute.jaccard(pairs))


def test_jaccard_opens_groups_fully(spark, monkeypatch):
    """Without min-hash groups all links come from the matrix."""
    r = np.random.default_rng(2)
    w = [f"w{i}" for i in range(120)]
    pairs = []
    for i in range(25):
        v = list(w)
        for j in r.choice(120, int(r.integers(1, 6)), replace=False):
            v[j] = f"v{i}"
        pairs.append((i, " ".join(v)))
    real, calls = jaccard_join._Texts.compare, []

    def compare(self, pairs):
        calls.append(1)
        return real(self, pairs.where("false") if len(calls) == 1 else pairs)

    monkeypatch.setattr(jaccard_join._Texts, "compare", compare)
    assert key(jaccard_join.join(frame(spark, pairs)).collect()) == key(brute.jaccard(pairs))
    assert len(calls) == 3


def test_jaccard_members_beyond_the_leader(spark):
    """Far members of a group, linked with a query that its leader is not linked with."""
    base = [f"w{i}" for i in range(200)]

    def changed(tag, places):
        w = list(base)
        for j in places:
            w[j] = f"{tag}{j}"
        return " ".join(w)

    pairs = [(1, " ".join(base))] + [(10 + i, changed(f"a{i}x", [5 * i])) for i in range(20)]
    pairs += [(50, changed("b", range(0, 24))), (51, changed("b", range(0, 45))),
              (52, changed("b", range(0, 70))), (53, changed("c", range(90, 126)))]
    assert key(jaccard_join.join(frame(spark, pairs)).collect()) == key(brute.jaccard(pairs))


def test_jaccard_crowd_beside_a_larger_one(spark, monkeypatch):
    """A crowd whose members meet a larger crowd's leader, just below 75 %, gets a group too."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(300)]
    other = base[:240] + [f"v{i}" for i in range(60)]       # 236 of 356 shingles are shared

    def near(words, i):
        at = int(rng.integers(0, 230))
        return " ".join([*words[:at], f"x{i}", *words[at + 1:]])

    pairs = [(i, near(base, i)) for i in range(16)] + [(i, near(other, i)) for i in range(16, 28)]
    real, found = jaccard_join._grouped, []

    def grouped(*args):
        found.append(real(*args))
        return found[-1]

    monkeypatch.setattr(jaccard_join, "_grouped", grouped)
    got = jaccard_join.join(frame(spark, pairs)).collect()
    assert key(got) == key(brute.jaccard(pairs))
    assert {r.component_id for r in got} == {0, 16}
    rows = found[0].collect()
    assert len({r.x for r in rows}) == len(rows)            # no set has two leaders
    assert sum(r.linked for r in rows) >= 24                # both crowds are in groups


def test_jaccard_far_copies_of_one_text_do_not_meet_each_other(spark, monkeypatch):
    """Copies below 75 % of their text, with its words in all of them, are not paired."""
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(150)]

    def near(i, changes):
        w = list(base)
        for j in rng.choice(150, changes, replace=False):
            w[j] = f"x{i}y{j}"
        return " ".join(w)

    pairs = [(0, " ".join(base))] + [(i, near(i, 2)) for i in range(1, 31)]
    pairs += [(i, near(i, 9)) for i in range(31, 91)]
    real, compared = jaccard_join._Texts.compare, []

    def compare(self, pairs):
        compared.append(pairs.count())
        return real(self, pairs)

    monkeypatch.setattr(jaccard_join._Texts, "compare", compare)
    got = jaccard_join.join(frame(spark, pairs)).collect()
    assert key(got) == key(brute.jaccard(pairs))
    assert sum(compared) <= 4 * len(pairs)


def test_jaccard_signatures_bound_what_sets_share():
    """Never less than two sets share, whatever their sizes; close for sets that are nearly linked."""
    r = np.random.default_rng(4)
    for _ in range(500):
        na, nb = (int(x) for x in r.integers(1, 900, 2))
        both = int(r.integers(0, min(na, nb) + 1))
        pool = r.integers(0, 2 ** 63, na + nb).astype(np.uint64)
        token = np.concatenate([pool[:na], pool[:both], pool[na:na + nb - both]])
        a, none, b = jaccard_join.signatures(np.repeat([0, 1, 2], [na, 0, nb]), token,
                                             np.array([na, 0, nb])).to_pylist()
        most = jaccard_join.most_shared(a, b, na, nb)
        assert both <= most == jaccard_join.most_shared(b, a, nb, na)
        assert jaccard_join.most_shared(a, none, na, 0) == 0
        if 100 * both >= 70 * (na + nb - both):
            assert most - both <= 8 + (na + nb) // 20


def saved(monkeypatch):
    """[(columns, rows)] of the tables that the join saves."""
    real, out = jaccard_join.save_table, []

    def save(df):
        df = real(df)
        out.append((df.columns, df.count()))
        return df

    monkeypatch.setattr(jaccard_join, "save_table", save)
    return out


def test_jaccard_moves_no_texts_of_sets_far_apart(spark, monkeypatch):
    """Sets that share a third are met, but neither their texts nor their tokens are looked up."""
    passage = [f"p{i}" for i in range(100)]
    pairs = [(i, " ".join([f"d{i}w{j}" for j in range(100)] + passage)) for i in range(40)]
    pairs += [(50, pairs[0][1] + " end"), (51, pairs[7][1] + " end")]
    tables = saved(monkeypatch)
    got = jaccard_join.join(frame(spark, pairs), known_frequent=0).collect()
    assert key(got) == key(brute.jaccard(pairs))
    assert sum(n for c, n in tables if "text" in c) == 4
    assert sum(n for c, n in tables if c == ["x", "g", "nx", "both"]) < 10


def test_jaccard_few_far_copies_do_not_meet(spark, monkeypatch):
    """Words of three far copies of a text come after the copies' own."""
    rng = np.random.default_rng(6)
    pairs = []
    for b in range(12):
        for i in range(3):
            w = [f"b{b}w{j}" for j in range(150)]
            for j in rng.choice(150, 9, replace=False):
                w[j] = f"b{b}x{i}y{j}"
            pairs.append((3 * b + i, " ".join(w)))
    tables = saved(monkeypatch)
    got = jaccard_join.join(frame(spark, pairs, 1)).collect()
    assert key(got) == key(brute.jaccard(pairs))
    assert sum(n for c, n in tables if c[:3] == ["x", "g", "token"]) < 40


def test_jaccard_looks_texts_up_by_filter_too(docs, rows, monkeypatch):
    """With more names than are sent to every task."""
    monkeypatch.setattr(jaccard_join, "_FEW", 0)
    assert key(jaccard_join.join(docs).collect()) == key(brute.jaccard(rows))


def test_jaccard_lots_of_text_are_small():
    """A worker holds about a million bytes of text as strings, whatever the batch."""
    texts = ["x" * 400_000, None, "", "y" * 2_500_000, "é" * 600_000, "w"] * 2
    got = list(jaccard_join._lots(pa.array(texts)))
    assert [t for _, _, part in got for t in part] == texts
    assert [(lo, hi) for lo, hi, _ in got] == [(lo, lo + len(part)) for lo, _, part in got]
    assert all(sum(len((t or "").encode()) for t in part[:-1]) <= 1_000_000 for *_, part in got)
    assert not list(jaccard_join._lots(pa.array([], pa.string())))


def test_jaccard_odd_rows(nulls, empty):
    got = jaccard_join.join(nulls).collect()
    assert key(got) == Counter({(None, 0, None): 1, (4, 0, 4): 1, (None, 66, 2): 2,
                                (4, 66, 2): 2, (2, 67, 2): 1})
    assert jaccard_join.join(empty).count() == 0
    left = jaccard_join.one_of_each(nulls)
    assert left.columns == nulls.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter({None: 1, 4: 1, 2: 1})


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 7), (60, 61), (5, 5)],
                                  "x bigint, y bigint")
    got = {r.sid: r.comp for r in jaccard_join.components(edges).collect()}
    assert got == {i: 0 for i in [*range(41), 100]} | {60: 60, 61: 60}
