"""Alignment of two tokenizers' tokens by divide and conquer at shared cuts.

Both token sequences of a text cover the same bytes.  A cut is a byte offset where a token of each
ends; the stretches between neighbouring cuts are the groups.  Cuts are found by halving: from the
token in the middle outwards, each end is looked up in the other sequence by bisection; the first
common one cuts the interval in two, and both parts are treated alike.  An interval without a
common end is a group.

Neither vocabulary has a token that goes on over a space after another character, so a text falls
into chunks (a space before it, no other white space before that) whose tokens and groups do not
depend on what stands around them.  A task aligns each different chunk once, and puts texts
together from chunks.  That vocabularies and texts are so is checked: other texts are aligned whole.

A pair of ids is counted once for each document that holds it linked.  A task counts within lots
of documents, so that Spark adds up one row per lot and pair instead of one per document and pair.
The counts go back to the lots the same way and are looked up there: documents move once, with the
places of their pairs in the lot's list.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from honestpick.functions.lineage import save_table
from honestpick.llm.packing import byte_ranks
from honestpick.llm.text import lots

_ROOM = 500_000                     # chunks a worker remembers
_CHUNK = re.compile(r"(?<=\S)(?= )")
_ODD = re.compile(r"\A |\s ")       # chunks with several spaces or other white space in front
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
# Fixed value: how the byte-level vocabulary cuts text before merging.
_WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _cuts(a: np.ndarray, b: np.ndarray, i, k) -> tuple[np.ndarray, np.ndarray]:
    """For each interval of A tokens i..k-1 the token nearest its middle, but not the last, whose
    end is an end of B too, and that B token; -1 without one."""
    mid = (i + k - 1) // 2
    reach = np.maximum(mid - i + 1, k - 1 - mid)
    cut = np.full(len(i), -1, dtype=np.int64)
    cut_b = cut.copy()
    left, d = np.arange(len(i)), 0
    while len(left) > 4:
        for at in (mid[left] - d, mid[left] + d):
            try_ = (at >= i[left]) & (at < k[left] - 1) & (cut[left] < 0)
            at, who = at[try_], left[try_]
            y = np.searchsorted(b, a[at])
            hit = b[y] == a[at]
            cut[who[hit]], cut_b[who[hit]] = at[hit], y[hit]
        d += 1
        left = left[(cut[left] < 0) & (reach[left] > d)]
    for x in left.tolist():
        lo, hi, m = int(i[x]), int(k[x]) - 1, int(mid[x])
        for at in (m + e for n in range(d, int(reach[x])) for e in ((-n, n) if n else (0,))):
            if lo <= at < hi and b[y := bisect_left(b, a[at])] == a[at]:
                cut[x], cut_b[x] = at, y
                break
    return cut, cut_b


def cut_groups(a: np.ndarray, b: np.ndarray, i, k, j, m):
    """Groups (first A token, its end, first B token, its end) in the intervals i..k of A and j..m
    of B tokens; a and b are the tokens' end offsets, equal at each interval's last tokens.

    All intervals are halved at once, level by level.
    """
    done = [[np.zeros(0, dtype=np.int64)] * 4]
    while len(i):
        cut, cut_b = _cuts(a, b, i, k)
        leaf = cut < 0
        done.append([x[leaf] for x in (i, k, j, m)])
        i, k, j, m, cut, cut_b = (x[~leaf] for x in (i, k, j, m, cut + 1, cut_b + 1))
        i, k, j, m = (np.concatenate(x) for x in ((i, cut), (cut, k), (j, cut_b), (cut_b, m)))
    groups = [np.concatenate(x) for x in zip(*done, strict=True)]
    order = np.argsort(groups[0])
    return [x[order] for x in groups]


_LARGE = 1_024      # pairs of a group from which equal ids are counted before they are paired


class Aligner:
    """Chunks met by a worker: their counts, groups as text, and linked id pairs."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken
        ranks = byte_ranks(path_a)
        if ranks is None:
            raise ValueError("tokenizer A must be a byte-level BPE whose ids follow its merges")
        self.a = tiktoken.Encoding("a", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = {i: t for t, i in ranks.items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if self.b.is_byte(i) and (m := _BYTE.fullmatch(p))
                        else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id("▁")
        self.chunked = not any(re.search("[^▁]▁", p) for p in pieces)
        self.sizes_a = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self.sizes_a[list(self.bytes_a)] = [len(t) for t in self.bytes_a.values()]
        self.sizes_b = np.array([len(t) for t in self.bytes_b], dtype=np.int64)
        # a token as text, in a group and as the last of its side
        self.shown = [f"{i}{end}" for ends, n in ((",|", len(self.sizes_a)), (",;", len(pieces)))
                      for i in range(n) for end in ends]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[str] = []
        self.numbers = array("q")           # per chunk: usable, A, B, groups, links, pairs
        self.pairs, self.times = array("q"), array("q")

    def _encode_a(self, chunks: list[str], joined: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks, number of ids of each); the first `joined` end in no white space
        and are encoded as one string."""
        ids = self.a.encode_ordinary("".join(chunks[:joined]))
        after = np.cumsum(self.sizes_a[ids])
        cuts = np.searchsorted(after, np.cumsum([len(c.encode()) for c in chunks[:joined]])) + 1
        rest = [self.a.encode_ordinary(c) for c in chunks[joined:]]
        counts = np.concatenate([np.diff(cuts, prepend=0), [len(x) for x in rest]])
        return (np.array([*ids, *chain.from_iterable(rest)], dtype=np.int64),
                counts.astype(np.int64))

    def _encode_b(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # a prefix space is added, but not to nothing
        found = [ids if k else [self.space] for k, ids in
                 zip(keys, self.b.encode(keys, num_threads=1), strict=True)]
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter(chain.from_iterable(found), dtype=np.int64, count=counts.sum()), counts

    def learn(self, keys: list[str]) -> None:
        """Chunks without their first space."""
        keys = ([k for k in keys if k and not k[-1].isspace()]
                + [k for k in keys if not k or k[-1].isspace()])
        chunks = [" " + k for k in keys]
        joined = sum(not c[-1].isspace() for c in chunks)
        (ids_a, n_a), (ids_b, n_b) = self._encode_a(chunks, joined), self._encode_b(keys)
        raw = "".join(chunks).encode()
        good = np.ones(len(keys), dtype=bool)
        if (b"".join(map(self.bytes_a.__getitem__, ids_a.tolist())) != raw
                or b"".join(map(self.bytes_b.__getitem__, ids_b.tolist())) != raw):
            for which, ids, n in ((self.bytes_a, ids_a, n_a), (self.bytes_b, ids_b, n_b)):
                ends = np.cumsum(n).tolist()
                for x, (c, end, size) in enumerate(zip(chunks, ends, n.tolist(), strict=True)):
                    whole = b"".join([which[i] for i in ids[end - size:end].tolist()])
                    good[x] &= whole == c.encode()
            ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
            n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
        for k in keys:
            self.known[k] = len(self.known)
        self._add(good, ids_a, n_a, ids_b, n_b)

    def _add(self, good, ids_a, n_a, ids_b, n_b) -> None:
        a, b = np.cumsum(self.sizes_a[ids_a]), np.cumsum(self.sizes_b[ids_b])
        last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
        some = np.flatnonzero(n_a)
        i, k, j, m = cut_groups(a, b, (last_a - n_a)[some], last_a[some], (last_b - n_b)[some],
                                last_b[some])
        p, q = k - i, m - j
        chunk = np.searchsorted(last_a, i, "right")
        # linked pairs, each occurrence one row but for large groups
        small = np.flatnonzero(p * q <= _LARGE)
        n = (p * q)[small]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        g = np.repeat(small, n)
        owner, code = [chunk[g]], [ids_a[i[g] + at // q[g]] << 32 | ids_b[j[g] + at % q[g]]]
        times = [np.ones(len(g), dtype=np.int64)]
        for x in np.flatnonzero(p * q > _LARGE).tolist():
            u, v = (np.unique(ids, return_counts=True) for ids in (ids_a[i[x]:k[x]],
                                                                   ids_b[j[x]:m[x]]))
            code.append((u[0][:, None] << 32 | v[0][None, :]).ravel())
            times.append(np.outer(u[1], v[1]).ravel())
            owner.append(np.full(len(code[-1]), chunk[x]))
        owner, code, times = map(np.concatenate, (owner, code, times))
        order = np.argsort(owner, kind="stable")
        self.pairs.frombytes(code[order].tobytes())
        self.times.frombytes(times[order].tobytes())
        links = np.bincount(chunk, p * q, len(good)).astype(np.int64)
        self.numbers.frombytes(np.column_stack([
            good, n_a, n_b, np.bincount(chunk, minlength=len(good)), links,
            np.bincount(owner, minlength=len(good))]).astype(np.int64).tobytes())
        # a group's A tokens stand before its B tokens, both after all tokens of earlier groups
        place = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
        end = np.zeros(len(ids_a), dtype=np.int64)
        end[k - 1] = 1
        place[np.arange(len(ids_a)) + np.repeat(j, p)] = 2 * ids_a + end
        end = np.zeros(len(ids_b), dtype=np.int64)
        end[m - 1] = 1
        place[np.arange(len(ids_b)) + np.repeat(k, q)] = 2 * (len(self.sizes_a) + ids_b) + end
        shown = list(map(self.shown.__getitem__, place.tolist()))
        ends = (last_a + last_b).tolist()
        self.texts += ["".join(shown[x:y]) for x, y in zip([0, *ends], ends, strict=False)]

    def keys(self, text: str) -> list[str]:
        if not self.chunked:
            return [text]
        if _ODD.search(text) is None:
            return text.split(" ")
        return [c[1:] for c in _CHUNK.split(" " + text)]

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """Numbers of the chunks of each text; none for a text that is not covered."""
        if len(self.known) > _ROOM:
            self.forget()
        split = [self.keys(t) if t else [] for t in texts]
        new = list({k for keys in split for k in keys if k not in self.known})
        if new:
            self.learn(new)
        usable = np.frombuffer(self.numbers, dtype=np.int64).reshape(-1, 6)[:, 0].astype(bool)
        found = []
        for keys in split:
            at = np.fromiter(map(self.known.__getitem__, keys), dtype=np.int64, count=len(keys))
            found.append(at if usable[at].all() else at[:0])
        return found

    def groups(self, chunks: np.ndarray) -> str:
        return "".join(map(self.texts.__getitem__, chunks.tolist()))[:-1]


_KNOWN: dict[tuple, Aligner] = {}


def _aligner(*paths: str) -> Aligner:
    """One per worker: it keeps what it has learnt for its next task."""
    if paths not in _KNOWN:
        _KNOWN[paths] = Aligner(*paths)
    return _KNOWN[paths]


def _doc_pairs(numbers: np.ndarray, pairs: np.ndarray, times: np.ndarray,
               chunks: list[np.ndarray]):
    """(document, pair, times): the different linked pairs of each document, sorted."""
    doc = np.repeat(np.arange(len(chunks)), [len(c) for c in chunks])
    at = np.concatenate(chunks) if chunks else np.zeros(0, np.int64)
    first = np.cumsum(numbers[:, 5]) - numbers[:, 5]
    n = numbers[at, 5]
    place = np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    doc = np.repeat(doc, n)
    codes, code = np.unique(pairs[place], return_inverse=True)
    key, slot = np.unique(doc * np.int64(max(len(codes), 1)) + code, return_inverse=True)
    total = np.zeros(len(key), dtype=np.int64)
    np.add.at(total, slot, times[place])
    return key // max(len(codes), 1), codes, key % max(len(codes), 1), total


def _least_type(top: int) -> str:
    return "<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8"


_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
_SAVED = ["doc_id", "lot", *_COUNTS, "groups_sha256", "n_pairs", "codes", "times", "pairs", "docs"]


def _align(path_a: str, path_b: str, chars: int):
    """A row per document with its pairs' places in its lot's list, and a row per lot with that
    list and the number of documents that hold each pair."""
    def lot_rows(aligner, number, ids, texts):
        chunks = aligner.of(texts)
        numbers = np.frombuffer(aligner.numbers, dtype=np.int64).reshape(-1, 6)
        doc, codes, code, total = _doc_pairs(
            numbers, np.frombuffer(aligner.pairs, dtype=np.int64),
            np.frombuffer(aligner.times, dtype=np.int64), chunks)
        ends = np.searchsorted(doc, np.arange(len(texts) + 1))
        sums, shas, places, times = [], [], [], []
        for i, at in enumerate(chunks):
            sums.append(numbers[at, 1:5].sum(axis=0))
            shas.append(hashlib.sha256(aligner.groups(at).encode()).hexdigest() if len(at) else "")
            one = slice(ends[i], ends[i + 1])
            places.append(code[one].astype(_least_type(len(codes))).tobytes())
            times.append(total[one].astype(_least_type(int(total[one].max(initial=0)))).tobytes())
        sums = np.array(sums, dtype=np.int64).reshape(-1, 4)
        n = len(texts)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(np.full(n, number)), *[pa.array(c) for c in sums.T.copy()],
             pa.array(shas), pa.array(np.diff(ends)), pa.array(places, pa.binary()),
             pa.array(times, pa.binary()), pa.nulls(n, pa.list_(pa.int64())),
             pa.nulls(n, pa.list_(pa.int64()))], _SAVED)
        if len(codes):
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, ids.type), pa.array([number]), *[pa.nulls(1, pa.int64())] * 4,
                 pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), *[pa.nulls(1, pa.binary())] * 2,
                 pa.array([codes.tolist()], pa.list_(pa.int64())),
                 pa.array([np.bincount(code, minlength=len(codes)).tolist()],
                          pa.list_(pa.int64()))], _SAVED)

    def run(batches: Iterator[pa.RecordBatch]):
        aligner, number = _aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = [int(n or 0) for n in pc.utf8_length(batch.column(1)).to_pylist()]
            first = 0
            for end in _ends(sizes, chars):
                ids = batch.column(0).slice(first, end - first)
                yield from lot_rows(aligner, number, ids,
                                    batch.column(1).slice(first, end - first).to_pylist())
                first, number = end, number + 1
    return run


def _ends(sizes: list[int], chars: int) -> list[int]:
    return [end for _, end in lots([range(n) for n in sizes], chars)]


def _slim(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"),
                       F.col(f"`{text}`").cast("string").alias("text"))


def aligned(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id",
            text: str = "text", chars: int = 4_000_000) -> DataFrame:
    """The saved rows of documents and lots that the functions below read."""
    slim = _slim(docs, doc_id, text)
    kind = slim.schema["doc_id"].dataType.simpleString()
    longs = ", ".join(f"{c} bigint" for c in _COUNTS)
    return save_table(slim.mapInArrow(
        _align(path_a, path_b, chars),
        f"doc_id {kind}, lot bigint, {longs}, groups_sha256 string, n_pairs bigint, codes binary, "
        "times binary, pairs array<bigint>, docs array<bigint>"))


def link_counts(rows: DataFrame) -> DataFrame:
    """a, b, docs, best: in how many documents each pair of ids is linked, and whether that is the
    highest number of its A id."""
    each = rows.where("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "docs")).alias("p"))
    sums = save_table(each.groupBy(F.col("p.pairs").alias("pair")).agg(
        F.sum("p.docs").alias("docs")))
    a = F.shiftright("pair", 32)
    most = save_table(sums.groupBy(a.alias("a")).agg(F.max("docs").alias("most")))
    return sums.withColumn("a", a).join(most, "a").select(
        "a", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "docs",
        (F.col("docs") == F.col("most")).alias("best"))


def _look_up():
    """Documents' sums; the counts of a lot come before its documents."""
    def run(batches: Iterator[pa.RecordBatch]):
        counts = best = np.zeros(0, np.int64)
        for batch in batches:
            n_best, sums, keep = [], [], []
            places, times = batch.column("codes"), batch.column("times")
            n_pairs = batch.column("n_pairs").to_pylist()
            for i, n in enumerate(n_pairs):
                if n is None:
                    counts = batch.column("counts")[i].values.to_numpy()
                    best = batch.column("best")[i].values.to_numpy(zero_copy_only=False)
                    continue
                keep.append(i)
                if not n:
                    n_best.append(0)
                    sums.append(0)
                    continue
                at, t = (np.frombuffer(c[i].as_buffer(), dtype=f"<u{c[i].as_buffer().size // n}")
                         .astype(np.int64) for c in (places, times))
                n_best.append(int(t[best[at]].sum()))
                sums.append(int((counts[at] * t).sum()))
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [rows.column(c) for c in ("doc_id", *_COUNTS)]
                + [pa.array(n_best, pa.int64()), pa.array(sums, pa.int64()),
                   rows.column("groups_sha256")],
                ["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256"])
    return run


def with_counts(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 per document."""
    pair = F.shiftleft("a", 32).bitwiseOR(F.col("b"))
    known = save_table(counts.select(pair.alias("pair"), F.col("docs").alias("count"), "best"))
    asked = rows.where("pairs IS NOT NULL").select("lot", F.posexplode("pairs").alias("at", "pair"))
    answers = asked.join(known, "pair").groupBy("lot").agg(
        F.sort_array(F.collect_list(F.struct("at", "count", "best"))).alias("x")).select(
        "lot", F.lit(0).alias("k"), F.col("x.count").alias("counts"), F.col("x.best").alias("best"))
    parts = answers.unionByName(rows.where("pairs IS NULL").drop("pairs", "docs").withColumn(
        "k", F.lit(1)), allowMissingColumns=True)
    ordered = parts.repartition("lot").sortWithinPartitions("lot", "k")
    kind = rows.schema["doc_id"].dataType.simpleString()
    longs = ", ".join(f"{c} bigint" for c in (*_COUNTS, "n_best", "count_sum"))
    return ordered.mapInArrow(_look_up(), f"doc_id {kind}, {longs}, groups_sha256 string")


def align(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id",
          text: str = "text", chars: int = 4_000_000) -> DataFrame:
    """One row per document: doc_id, n_a, n_b (tokens), n_groups, n_links (pairs of token
    occurrences in one group), n_best (links whose count is their A id's highest), count_sum
    (counts of all links), groups_sha256 (of `a1,a2|b1;...`; '' without tokens).

    A is a byte-level BPE file, encoded with a space before the text; B a SentencePiece model.
    Special tokens' names in a text are text.  A null or empty text, or one whose bytes the tokens
    do not give back, has no tokens.  Rows with equal or null ids are documents of their own.  An
    empty table gives no rows; other columns are not read.  Lots hold about `chars` characters: a
    setting of the work, not of the result.
    """
    rows = aligned(docs, path_a, path_b, doc_id, text, chars)
    return with_counts(rows, link_counts(rows))


def _groups(path_a: str, path_b: str, chars: int):
    def run(batches: Iterator[pa.RecordBatch]):
        aligner = _aligner(path_a, path_b)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in lots(texts, chars):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo),
                     pa.array([aligner.groups(c) for c in aligner.of(texts[lo:hi])], pa.string())],
                    ["doc_id", "groups"])
    return run


def groups(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text",
           chars: int = 1_000_000) -> DataFrame:
    """doc_id, groups: the groups of each document as `a1,a2|b1;a3|b2,b3` in text order."""
    slim = _slim(docs, doc_id, text)
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(_groups(path_a, path_b, chars), f"doc_id {kind}, groups string")
