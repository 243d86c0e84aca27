"""Long repeats across documents, by recompression.

Words are hashed; rounds then name runs of one symbol and pairs of neighbours (a pair joins when
the coin of its left symbol says left and that of its right one right).  Names are hashes of what
they stand for, hence the same in every task without any exchange, and equal stretches of text
get equal symbols but near their ends.  For every symbol the words that decided it are tracked:
a symbol decided within `BEFORE` words before its start and `AFTER` from it is the same wherever
these words stand.

Each window of `size` words is then filed under one place inside it: the start of the symbol of
the highest round, smallest hash first, leftmost of equals.  Equal windows are filed under equal
places, so repeats are found by comparing places, about one for every eighteen words:

1. a place leaves the hash X of the words around it, the range of its windows, and the hash H of
   all words in them;
2. places whose X stands in several documents are looked at; where H agrees with that of a
   document with a smaller id, the whole range is repeated;
3. where H differs (at the ends of repeats), the document with the smallest id of each H gets
   its windows hashed and compared one by one, under the same X.

Maxima and minima are combined before each shuffle; texts move only for step 3 and for the
result.  All hashes compared have 64 bits and are compared under an equal X only, so that a
chance equality is not to be expected at any size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from honestpick.functions.lineage import save_table
from honestpick.llm.text import Hashed, WordHashes, lots, mix, words_of

BEFORE, AFTER, ROUNDS = 6, 10, 3
_PAIR, _RUN = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def symbol_rounds(words: np.ndarray, rounds: int = ROUNDS):
    """After each round: symbols, starts, and the stretch [low, high) that decided each."""
    sym, n = words, len(words)
    start = np.arange(n)
    low, high = start, start + 1
    for r in range(rounds):
        # runs of one symbol; that a run ends is decided by its neighbours
        first = np.flatnonzero(np.concatenate([[True], sym[1:] != sym[:-1]]))
        last = np.concatenate([first[1:], [len(sym)]])
        count = (last - first).astype(np.uint64)
        s = np.where(count > 1, mix(sym[first] + count * _RUN), sym[first])
        st = start[first]
        lo = low[np.maximum(first - 1, 0)]
        hi = high[np.minimum(last, len(sym) - 1)]
        salt = np.uint64((r + 1) * int(_PAIR) % (1 << 64))
        # pairs of a left and a right symbol
        coin = (mix(s + salt) & np.uint64(1)).astype(bool)
        m = len(s)
        pair = np.zeros(m, dtype=bool)
        pair[:-1] = ~coin[:-1] & coin[1:]
        second = np.zeros(m, dtype=bool)
        second[1:] = pair[:-1]
        after, before = np.minimum(np.arange(m) + 1, m - 1), np.maximum(np.arange(m) - 1, 0)
        name = np.where(pair, mix(s * _PAIR + s[after]), s)
        # a left symbol is decided by what follows it, a right one by what stands before
        hi = np.where(~coin, hi[after], hi)
        lo = np.where(coin, lo[before], lo)
        keep = ~second
        sym, start, low, high = name[keep], st[keep], lo[keep], hi[keep]
        yield sym, start, low, high


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """For each i the index of the smallest of values[i:i + width], leftmost of equals."""
    v, p, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        a, b = slice(0, len(v) - step), slice(step, None)
        right = v[b] < v[a]
        v, p = np.where(right, v[b], v[a]), np.where(right, p[b], p[a])
        have += step
    return p


def places(words: np.ndarray, doc_starts: np.ndarray, doc_ends: np.ndarray, size: int):
    """(document, first window, last window, X, H) for the places of all windows.

    `words` holds all documents, with one word of no document before each of them and after the
    last: a symbol that depends on what follows must not seem decided where the words end.
    Windows are counted from the document's first word.
    """
    n, span = len(words), BEFORE + AFTER
    width = size - span + 1
    long_enough = doc_ends - doc_starts >= size
    if n < size or not long_enough.any():
        z = np.zeros(0, dtype=np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    level = np.zeros(n, dtype=np.uint64)
    for r, (_, start, low, high) in enumerate(symbol_rounds(words)):
        near = (start - low <= BEFORE) & (high - start <= AFTER)
        level[start[near]] = r + 1
    hashed = Hashed(words)
    context = np.arange(n - span + 1)           # of the place context + BEFORE
    x = hashed.of(context, context + span)
    rank = np.uint64(ROUNDS) - level[BEFORE:BEFORE + len(context)]
    order = (mix(x) >> np.uint64(2)) | (rank << np.uint64(62))
    best = smallest(order, width)               # best[i]: context of the window that starts at i
    doc = np.repeat(np.flatnonzero(long_enough), (doc_ends - doc_starts)[long_enough] - size + 1)
    first = doc_starts[doc]
    ones = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1])
    counts = np.diff([*ones, len(doc)])
    i = first + np.arange(len(doc)) - np.repeat(ones, counts)
    at = best[i]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
    a = np.flatnonzero(new)
    b = np.concatenate([a[1:], [len(i)]]) - 1
    h = mix(hashed.of(i[a], i[b] + size) + (at[a] - i[a]).astype(np.uint64))
    return doc[a], i[a] - first[a], i[b] - first[b], x[at[a]], h


def _joined(texts: list[str], hashes: WordHashes):
    """All words of the texts in one array, one foreign word before each and after the last;
    starts and ends."""
    parts, sizes = [], []
    for k, t in enumerate(texts):
        w = words_of(t)
        parts += [np.array([_PAIR ^ np.uint64(k + 1)]), hashes.of(w)]
        sizes.append(len(w))
    parts.append(np.array([_PAIR ^ np.uint64(len(texts) + 1)]))
    sizes = np.array(sizes, dtype=np.int64)
    ends = np.cumsum(sizes + 1)
    return np.concatenate(parts), ends - sizes, ends


_HASHES = WordHashes()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _places(size: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for lo, hi in lots(texts):
                words, starts, ends = _joined(texts[lo:hi], _HASHES)
                doc, a, b, x, h = places(words, starts, ends, size)
                if len(doc):
                    at = pa.array(doc + lo)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(at), batch.column(1).take(at), _signed(x),
                         _signed(h), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))],
                        ["doc_id", "t", "x", "h", "a", "b"])
    return run


def _windows(size: int):
    def run(batches):
        for batch in batches:
            texts, asked = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i, (text, ranges) in enumerate(zip(texts, asked, strict=True)):
                hashed = Hashed(_HASHES.of(words_of(text)))
                ranges = list({(r["x"], r["a"], r["b"]) for r in ranges})
                counts = [b - a + 1 for _, a, b in ranges]
                at = np.concatenate([np.arange(a, b + 1) for _, a, b in ranges])
                here = pa.array(np.full(len(at), i))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(here), batch.column(1).take(here),
                     pa.array(np.repeat(np.array([r[0] for r in ranges]), counts)),
                     _signed(hashed.of(at, at + size)), pa.array(at.astype(np.int32))],
                    ["doc_id", "t", "x", "w", "i"])
    return run


def covered_words(n: int, ranges: list[tuple[int, int]]) -> np.ndarray:
    """Whether each of n words lies in a [start, end) range."""
    delta = np.zeros(n + 1, dtype=np.int64)
    for s, e in ranges:
        delta[s] += 1
        delta[e] -= 1
    return np.cumsum(delta[:-1]) > 0


def _cut(batches):
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for text, ranges in zip(batch.column("text").to_pylist(),
                                batch.column("ranges").to_pylist(), strict=True):
            words = words_of(text)
            if ranges:
                gone = covered_words(len(words), [(r["s"], r["e"]) for r in ranges])
                left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            else:
                left = words
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_words, pa.int64()),
             pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept"])


def repeated_ranges(rows: DataFrame, size: int) -> DataFrame:
    """doc_id, t, s, e: stretches of words (end exclusive) made of windows that also start in a
    document with a smaller id.  `rows` has doc_id (not null), t (hash of the text), text."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = save_table(rows.select("doc_id", "t", "text").mapInArrow(
        _places(size), f"doc_id {kind}, t bigint, x bigint, h bigint, a int, b int"))
    shared = save_table(found.groupBy("x").agg(
        F.min("doc_id").alias("least"), (F.min("h") != F.max("h")).alias("differ"),
        F.max("doc_id").alias("most")).where("least < most").select("x", "least", "differ"))
    seen = save_table(found.join(shared, "x"))
    whole = seen.where("NOT differ AND doc_id > least").select("doc_id", "t", "a", "b")
    mixed = seen.where("differ").drop("least", "differ")
    # saved before the join: else both share one exchange, which Spark cannot split by size
    first = save_table(mixed.groupBy("x", "h").agg(F.min("doc_id").alias("own")))
    mixed = save_table(mixed.join(first, ["x", "h"]))
    whole = whole.unionByName(mixed.where("doc_id > own").select("doc_id", "t", "a", "b"))
    asked = mixed.where("doc_id = own").groupBy("doc_id", "t").agg(
        F.collect_list(F.struct("x", "a", "b")).alias("ranges"))    # no more than the text's words
    windows = save_table(rows.join(save_table(asked), ["doc_id", "t"])
                         .select("doc_id", "t", "text", "ranges").mapInArrow(
        _windows(size), f"doc_id {kind}, t bigint, x bigint, w bigint, i int"))
    earliest = save_table(windows.groupBy("x", "w").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most"))
    single = (windows.join(earliest.select("x", "w", "least"), ["x", "w"])
              .where("doc_id > least").select("doc_id", "t", "i"))
    return (whole.select("doc_id", "t", F.col("a").alias("s"), (F.col("b") + size).alias("e"))
            .unionByName(single.select("doc_id", "t", F.col("i").alias("s"),
                                       (F.col("i") + size).alias("e"))))


def deduplicate(docs: DataFrame, size: int = 50, doc_id: str = "doc_id",
                text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept for every row: `kept` holds the words that stay, joined
    by one space.

    A word goes when a window of `size` consecutive words around it also starts in a document
    with a smaller id.  Windows are judged on the texts as given.  A null or empty text has no
    words; texts shorter than `size` stay whole, as do rows with a null id, which are not
    compared.  Rows with equal ids don't remove each other's words.  `size` is at least
    BEFORE + AFTER.
    """
    if size < BEFORE + AFTER:
        raise ValueError(f"size must be at least {BEFORE + AFTER}")
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(body).alias("t"),
                       body.alias("text"))
    ranges = repeated_ranges(rows.where("doc_id IS NOT NULL"), size).groupBy("doc_id", "t").agg(
        F.collect_set(F.struct("s", "e")).alias("ranges"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return (rows.join(save_table(ranges), ["doc_id", "t"], "left")
            .select("doc_id", "text", "ranges")
            .mapInArrow(_cut, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string"))
