"""Similar documents by Jaccard similarity of word shingles, through a token-group matrix.

Similar documents are first put in groups: each distinct shingle set is compared with the most
central set that it shares min-hashes with, and joins that leader's group if they are linked; those
left over by a leader that has a group choose again among themselves.  The matrix says which tokens each group's members hold together.  A set is a query against the groups
of other components: it can be similar to a member only if enough of its tokens are in the
group's union, so the overlap of query and union bounds every pair at once, and only groups that
reach the bound are opened.  An opened group's leader is compared first.  A link settles the
group, as all its members are linked with the leader.  Else the overlap with a member is at most
that with the leader plus the member's tokens that the leader lacks, and only members for which
this is enough, and that a token brings together with the query, are compared.

The matrix holds prefixes only: tokens are put in one order for all documents (rare before
frequent ones).  All that two sets share comes at or after the first token they share, so its
place tells how large a partner the set can be linked with (`reach`).  The larger set of a link is
the query and the smaller one the member: a query keeps tokens that reach 75 % of its size, the
matrix those that reach the member's own size, and a token brings the two together only where
each reaches the other.  No link is lost, as its first shared token does.  Near copies of one text
that are too far from it to be linked begin with tokens of their own, beyond which they reach
nothing of their size, so a crowd of them meets its centre but not each other.  The order needs no
exact counts: the most frequent tokens found by counting within lots
of documents go last, at most `known_frequent` of them (8 bytes each are sent to every task);
which tokens these are changes the work, never the result.

Most pairs to compare are settled by signatures: bit i of a set's tells whether an odd number of
its tokens fall on i, so sets differ in at least as many tokens as their signatures in bits, which
bounds what they share (`most_shared`).  A pair that may be linked by that bound is compared by its
texts; only these texts move.

Tokens and sets are known by 64-bit hashes; two sets with one name are found by a second hash, and
then all names are made anew.  Frequent tokens are dealt to several tasks; sums and minima are
combined before shuffles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from honestpick.functions.lineage import save_table
from honestpick.llm.text import Hashed, WordHashes, mix

KEYS = 8
_FILTER_BITS = 25
_FEW = 20_000           # names of texts that are sent to every task as they are
_HASHES = WordHashes()


def _let_go() -> None:
    """Gives back the memory that a worker would else hold until its next task."""
    _HASHES.clear()
    pa.default_memory_pool().release_unused()


def _lots(column: pa.Array):
    """(first, end, texts) of about a million bytes of text each."""
    sizes = np.array(pc.fill_null(pc.binary_length(column), 0))
    lot = (np.cumsum(sizes, dtype=np.int64) - sizes) // 1_000_000
    at = [0, *(np.flatnonzero(np.diff(lot)) + 1).tolist(), len(lot)]
    for lo, hi in zip(at, at[1:]):
        if lo < hi:
            yield lo, hi, column.slice(lo, hi - lo).to_pylist()


def ceil_share(n, percent: int):
    """ceil(n * percent / 100) in whole numbers."""
    return -(-n * percent // 100)


def prefix_length(n, percent: int):
    """Tokens of a set of n whose place leaves percent of it: a link's first shared one is there."""
    return np.minimum(n, n - ceil_share(n, percent) + 1)


def reach(n, place, percent: int):
    """The most tokens of a set linked with one of n that shares no token before `place`."""
    return (100 + percent) * (n - place) // percent - n


def shingle_sets(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, token): the distinct shingles of each text, sorted; A-Z count as a-z.

    A text of fewer than `size` words is one shingle, a text without words none.
    """
    parts, counts = [], []
    for t in texts:
        w = t.encode("utf-8", "surrogatepass").lower().split() if t else []
        parts.append(_HASHES.of(w))
        counts.append(len(w))
    counts = np.array(counts, dtype=np.int64)
    ends = np.cumsum(counts)
    hashed = Hashed(np.concatenate(parts) if parts else np.zeros(0, np.uint64))
    shingles = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(texts)), shingles)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    start = (ends - counts)[doc] + at
    token = hashed.of(start, start + np.minimum(counts, size)[doc])
    order = np.lexsort((token, doc))
    doc, token = doc[order], token[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])
    return doc[new], token[new]


def set_names(doc: np.ndarray, token: np.ndarray, n_docs: int, seed: int):
    """(size, name, second name, min-hashes [KEYS, document]) of each document's set."""
    n = np.bincount(doc, minlength=n_docs)
    have = np.flatnonzero(n)
    first = (np.cumsum(n) - n)[have]

    def folded(fold, salt):
        out = np.zeros(n_docs, dtype=np.uint64)
        if len(have):
            out[have] = fold.reduceat(mix(token + np.uint64(salt)), first)
        return out

    name = mix(folded(np.add, 1 + 1000 * seed) + n.astype(np.uint64))
    return n, name, folded(np.add, 2 + 1000 * seed), [folded(np.minimum, 3 + k)
                                                      for k in range(KEYS)]


def signatures(doc: np.ndarray, token: np.ndarray, n: np.ndarray) -> pa.Array:
    """Of each set of n tokens, 2 n bits at least: a bit is 1 if it is met by an odd number of them.

    The number of bits is a power of two, so the halves of a signature, one xor the other, are the
    signature of half as many bits."""
    bits = 1 << np.ceil(np.log2(np.maximum(2 * n, 64))).astype(np.int64)
    ends = np.cumsum(bits)
    at = (ends - bits)[doc] + (token & (bits - 1).astype(np.uint64)[doc]).astype(np.int64)
    odd = np.bincount(at, minlength=int(bits.sum())) & 1
    offsets = np.concatenate([[0], ends // 8]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [
        None, pa.py_buffer(offsets), pa.py_buffer(np.packbits(odd.astype(np.uint8),
                                                              bitorder="little"))])


def most_shared(a: bytes, b: bytes, na: int, nb: int) -> int:
    """No fewer than the tokens shared by sets of na and nb tokens with signatures a and b."""
    x, y = (int.from_bytes(v, "little") for v in (a, b))
    if len(a) < len(b):
        a, b, x, y = b, a, y, x
    bits = 8 * len(a)
    while bits > 8 * len(b):
        bits //= 2
        x = (x >> bits) ^ (x & ((1 << bits) - 1))
    return min(na, nb, (na + nb - (x ^ y).bit_count()) // 2)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


_NAMED = ["doc_id", "t", "n", "sid", "second", *[f"key{k}" for k in range(KEYS)], "sig", "token",
          "docs"]


def _name(size: int, seed: int, lot: int = 4_000_000, at_least: int = 2):
    """One row per document with its set's names, and rows of tokens that are frequent in a lot
    of documents (with the number of distinct sets there); at_least: 2 or more."""
    def frequent(doc_type, tokens):
        held = np.concatenate(tokens)
        tokens.clear()
        held.sort()
        token = np.unique(held[1:][held[1:] == held[:-1]])      # little room: most are met once
        count = np.searchsorted(held, token, "right") - np.searchsorted(held, token)
        token, count = token[count >= at_least], count[count >= at_least]
        kinds = {"doc_id": doc_type, "sig": pa.binary()}
        for lo in range(0, len(token), 20_000):     # the nulls beside them take room, too
            t, n = token[lo:lo + 20_000], count[lo:lo + 20_000]
            nulls = [pa.nulls(len(t), kinds.get(c, pa.int64())) for c in _NAMED[:-2]]
            yield pa.RecordBatch.from_arrays(
                [*nulls, _signed(t), pa.array(n.astype(np.int64))], _NAMED)

    def run(batches):
        seen, tokens, held, kind = set(), [], 0, None
        for batch in batches:
            kind = batch.column(0).type
            for lo, hi, texts in _lots(batch.column(2)):
                doc, token = shingle_sets(texts, size)
                n, name, second, keys = set_names(doc, token, hi - lo, seed)
                fresh = np.zeros(hi - lo, dtype=bool)
                for i, s in enumerate(name.tolist()):
                    if s not in seen:
                        seen.add(s)
                        fresh[i] = True
                tokens.append(token[fresh[doc]])
                held += len(tokens[-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo),
                     pa.array(n), _signed(name), _signed(second), *map(_signed, keys),
                     signatures(doc, token, n), pa.nulls(hi - lo, pa.int64()),
                     pa.nulls(hi - lo, pa.int64())], _NAMED)
                if held >= lot:
                    yield from frequent(kind, tokens)
                    tokens, held = [], 0
        if held:
            yield from frequent(kind, tokens)
        _let_go()
    return run


def _prefixes(size: int, seed: int, percent: int, frequent: np.ndarray, counts: np.ndarray,
              deal: int):
    """Rows (token, salt, sid, n, reach): prefixes of the distinct sets of a task.

    Tokens in more than `deal` sets get a salt, by which they are dealt to several tasks."""
    by_count = np.argsort(counts, kind="stable")
    rank = np.empty(len(counts), dtype=np.int64)
    rank[by_count] = np.arange(1, len(counts) + 1)

    def run(batches):
        seen = set()
        for batch in batches:
            for lo, hi, texts in _lots(batch.column(0)):
                doc, token = shingle_sets(texts, size)
                n, name, _, _ = set_names(doc, token, hi - lo, seed)
                fresh = np.zeros(hi - lo, dtype=bool)
                for i, s in enumerate(name.tolist()):
                    if s not in seen:
                        seen.add(s)
                        fresh[i] = True
                doc, token = doc[fresh[doc]], token[fresh[doc]]
                late = np.zeros(len(token), dtype=np.int64)
                salts = np.zeros(len(token), dtype=np.int64)
                if len(frequent):
                    slot = np.minimum(np.searchsorted(frequent, token), len(frequent) - 1)
                    known = frequent[slot] == token
                    late[known] = rank[slot[known]]
                    tasks = (counts[slot] // deal + 1).astype(np.uint64)
                    salts = np.where(known & (tasks > 1),
                                     1 + (name[doc] % tasks).astype(np.int64), 0)
                order = np.lexsort((token, late, doc))
                doc, token, salts = doc[order], token[order], salts[order]
                left = np.where(fresh, n, 0)
                place = np.arange(len(doc)) - (np.cumsum(left) - left)[doc]
                keep = place < prefix_length(n, percent)[doc]
                doc, place = doc[keep], place[keep]
                yield pa.RecordBatch.from_arrays(
                    [_signed(token[keep]), pa.array(salts[keep].astype(np.int32)),
                     _signed(name[doc]), pa.array(n[doc].astype(np.int64)),
                     pa.array(reach(n[doc], place, percent).astype(np.int64))],
                    ["token", "salt", "sid", "n", "reach"])
        _let_go()
    return run


_SIFTED = ["x", "y", "tx", "ty", "nx", "ny", "both"]


def _sift(batches):
    """Pairs with the sizes of their sets and the most that they can share, by signatures."""
    for batch in batches:
        most = [most_shared(*row) for row in zip(*(batch.column(c).to_pylist() for c in (
            "sx", "sy", "nx", "ny")), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in _SIFTED[:-1]), pa.array(most, pa.int64())], _SIFTED)


def _fetch(bits: np.ndarray):
    """(t, text) of texts whose hash may be wanted, each once in a task."""
    def run(batches):
        seen = set()
        for batch in batches:
            t = batch.column(0).to_numpy()
            slot = t & ((1 << _FILTER_BITS) - 1)
            maybe = np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
            at = []
            for i in maybe.tolist():
                if t[i] not in seen:
                    seen.add(t[i])
                    at.append(i)
            if at:
                yield batch.take(pa.array(at))
    return run


def _compare(size: int):
    """(x, y, nx, ny, both) for pairs with their texts: sizes of the sets and of what they share."""
    def run(batches):
        for batch in batches:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            tx, ty = batch.column("text_x"), batch.column("text_y")
            sets: dict[int, np.ndarray] = {}
            found = []
            for i, (a, b) in enumerate(zip(x, y, strict=True)):
                if len(sets) > 2_000:
                    sets.clear()
                for k, col in ((a, tx), (b, ty)):
                    if k not in sets:
                        sets[k] = shingle_sets([col[i].as_py()], size)[1]
                p, q = sets[a], sets[b]
                found.append((len(p), len(q), len(np.intersect1d(p, q, assume_unique=True))))
            cols = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("x"), batch.column("y"), *[pa.array(c, pa.int64()) for c in cols]],
                ["x", "y", "nx", "ny", "both"])
        _let_go()
    return run


class _Texts:
    """Signatures and texts of the sets that pairs name, and their comparison."""

    def __init__(self, rows: DataFrame, sets: DataFrame, size: int, percent: int):
        self.rows, self.sets, self.size, self.percent = rows, sets, size, percent

    def _moved(self, named: DataFrame) -> DataFrame:
        """(t, text), saved: each text named in a row (t) once."""
        if named.count() <= _FEW:
            near = self.rows.select("t", "text").join(F.broadcast(named), "t")
        else:
            # a bit filter of a fixed four megabytes keeps most other texts from moving
            slot = F.col("t").bitwiseAND(F.lit((1 << _FILTER_BITS) - 1))
            # (bucket b and position p of the bitmap functions stand for the number
            # 32768 (b - 1) + p + 1)
            found = (named.select((slot + 1).alias("s")).groupBy(
                F.bitmap_bucket_number("s").alias("b")).agg(
                F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m"))).collect()
            bits = np.zeros(1 << (_FILTER_BITS - 3), dtype=np.uint8)
            for r in found:
                part = np.frombuffer(bytes(r["m"]), dtype=np.uint8)
                at = (r["b"] - 1) * 4096
                bits[at:at + len(part)] = part
            near = self.rows.select("t", "text").mapInArrow(_fetch(bits), "t bigint, text string")
            near = near.join(named, "t")
        return save_table(near.groupBy("t").agg(F.first("text").alias("text")))

    def compare(self, pairs: DataFrame) -> DataFrame:
        """(x, y, nx, ny, both, linked), saved, for distinct pairs (x, y) of sids.

        both is exact for linked pairs, else what they share at most."""
        pairs = save_table(pairs)
        named = save_table(pairs.select(F.col("x").alias("sid")).union(pairs.select("y")).distinct())
        sets = save_table(self.sets.join(named, "sid"))
        x, y = (sets.select(F.col("sid").alias(k), F.col("t").alias(f"t{k}"),
                            F.col("n").alias(f"n{k}"), F.col("sig").alias(f"s{k}")) for k in "xy")
        sifted = save_table(pairs.join(x, "x").join(y, "y").mapInArrow(
            _sift, ", ".join(f"{c} bigint" for c in _SIFTED)))
        enough = f"{100 + self.percent} * both >= {self.percent} * (nx + ny)"
        near = sifted.where(enough)
        named = save_table(near.select(F.col("tx").alias("t")).union(near.select("ty")).distinct())
        done = sifted.where(f"NOT ({enough})").select("x", "y", "nx", "ny", "both")
        if not named.isEmpty():
            texts = self._moved(named)
            both = near.select("x", "y", "tx", "ty").join(
                texts.select(F.col("t").alias("tx"), F.col("text").alias("text_x")), "tx").join(
                texts.select(F.col("t").alias("ty"), F.col("text").alias("text_y")), "ty")
            done = done.union(both.select("x", "y", "text_x", "text_y").mapInArrow(
                _compare(self.size), "x bigint, y bigint, nx bigint, ny bigint, both bigint"))
        return save_table(done.withColumn("linked", F.expr(enough)))


def components(edges: DataFrame) -> DataFrame:
    """(sid, comp): for every sid in an edge (x, y) the smallest sid it is connected with.

    Large-star and small-star steps until nothing changes; the frame is saved after each."""
    pairs = save_table(edges.where("x <> y").select(F.greatest("x", "y").alias("u"),
                                                    F.least("x", "y").alias("v")).distinct())
    while True:
        both = pairs.union(pairs.select("v", "u"))
        least = save_table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"),
                                                            F.col("m").alias("v"))
        large = save_table(large.where("u <> v").distinct())
        least = save_table(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u")
        small = (small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        small = save_table(small)
        if small.exceptAll(pairs).isEmpty() and pairs.exceptAll(small).isEmpty():
            break
        pairs = small
    return save_table(pairs.select(F.col("u").alias("sid"), F.col("v").alias("comp"))
                      .union(pairs.select("v", "v")).distinct())


def _with_comp(df: DataFrame, comps: DataFrame, key: str, name: str) -> DataFrame:
    c = comps.select(F.col("sid").alias(key), F.col("comp").alias("_c"))
    return df.join(c, key, "left").withColumn(name, F.coalesce("_c", key)).drop("_c")


def _leaders(sets: DataFrame) -> DataFrame:
    """(x, y): each set and the one that it shares most min-hashes with, of those that lead one.

    The one with most of its prefix in other sets too leads (`common`), then the one that shares
    its min-hashes with most others: the middle of a cluster.  Sums are
    saved before they are joined with their rows: else both would share one exchange, which
    Spark cannot split where a key is frequent."""
    keyed = sets.select("sid", "common", F.posexplode(F.array(*[f"key{k}" for k in range(KEYS)]))
                        .alias("k", "key"))
    sizes = save_table(keyed.groupBy("k", "key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    shared = save_table(keyed.join(sizes, ["k", "key"]))
    central = save_table(shared.groupBy("sid").agg(F.sum("c").alias("s")))
    lead = save_table(shared.join(central, "sid").groupBy("k", "key").agg(
        F.max(F.struct("common", "s", "sid")).alias("b")).select(
            "k", "key", F.struct("b.common", "b.s").alias("s"), F.col("b.sid").alias("y")))
    met = shared.join(lead, ["k", "key"]).where("sid <> y").groupBy(
        F.col("sid").alias("x"), "y").agg(F.count(F.lit(1)).alias("c"), F.first("s").alias("s"))
    return met.groupBy("x").agg(F.max(F.struct("c", "s", "y")).alias("b")).select("x", "b.y")


def _grouped(sets: DataFrame, texts: _Texts) -> DataFrame:
    """(x, y, nx, ny, both, linked): sets against leaders; no x is linked with two.

    A crowd may meet the leader of a larger crowd that it is not linked with, and hide its own.
    Such sets choose again among themselves, while a round links one in a hundred of those it
    looks at: how often changes the groups and the work, never the result."""
    found = texts.compare(_leaders(sets))
    done = found
    while True:
        linked = save_table(found.where("linked").select("x", "y"))
        heads = save_table(linked.select("y").distinct())
        apart = save_table(found.where("NOT linked").join(heads, "y", "left_semi")
                           .select(F.col("x").alias("sid"))
                           .join(heads.select(F.col("y").alias("sid")), "sid", "left_anti"))
        looked, won = apart.count(), linked.count()
        if not won or 100 * won < looked + won or not looked:
            return done
        found = texts.compare(_leaders(sets.join(apart, "sid", "left_semi")))
        done = save_table(done.join(found.where("linked").select("x"), "x", "left_anti")
                          .union(found.where("linked")))


def links(rows: DataFrame, named: DataFrame, frequent: DataFrame, size: int, percent: int,
          seed: int, known_frequent: int, deal: int = 1_000) -> DataFrame:
    """(sid, comp) of all sets that have a link."""
    sets = save_table(named.where("n > 0").groupBy("sid").agg(
        F.min("t").alias("t"), F.first("n").alias("n"),
        *[F.first(c).alias(c) for c in (*[f"key{k}" for k in range(KEYS)], "sig")]))
    texts = _Texts(rows, sets.select("sid", "t", "n", "sig"), size, percent)

    # prefixes, as far as tokens are in several sets
    top = frequent.groupBy("token").agg(F.sum("docs").alias("docs")).orderBy(
        F.desc("docs"), "token").limit(known_frequent).toArrow()    # a few bytes each, bounded
    token = top["token"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(token)
    prefixes = rows.select("text").mapInArrow(
        _prefixes(size, seed, percent, token[order], top["docs"].to_numpy()[order], deal),
        "token bigint, salt int, sid bigint, n bigint, reach bigint")
    same = Window.partitionBy("token", "salt")
    shared = save_table(
        prefixes.withColumn("lo", F.min("sid").over(same)).withColumn("hi", F.max("sid").over(same))
        .withColumn("held", F.max(F.expr("reach >= n")).over(same) | (F.col("salt") > 0))
        .where("salt > 0 OR lo < hi").select("token", "salt", "sid", "n", "reach", "held")
        .distinct().drop("salt"))
    # a set without a token that another one holds in the matrix has no link
    common = shared.groupBy("sid").agg(
        (F.count(F.lit(1)) / (F.first("n") - F.ceil(F.first("n") * percent / 100) + 1))
        .alias("common"), F.max("held").alias("held")).where("held").select("sid", "common")
    first = _grouped(save_table(sets.join(common, "sid").drop("t", "n", "sig")), texts)
    edges = first.where("linked").select("x", "y")
    comps = components(edges)
    # a member has a leader it is linked with, and `extra` tokens that the leader lacks
    member = first.where("linked").select(F.col("x").alias("sid"), F.col("y").alias("g"),
                                          F.col("nx").alias("ny"),
                                          (F.col("nx") - F.col("both")).alias("extra"))

    # the matrix, as far as tokens are in several components
    placed = save_table(comps.join(member.select("sid", "g"), "sid", "left"))
    live = save_table(shared.where("held").drop("held").join(placed, "sid", "left").withColumns(
        {"comp": F.coalesce("comp", "sid"), "g": F.coalesce("g", "sid")}))
    several = save_table(live.groupBy("token").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token"))
    live = save_table(live.join(several, "token"))
    held = live.where("reach >= n")
    matrix = save_table(held.groupBy("token", "g").agg(
        F.first("comp").alias("gc"), F.min("n").alias("least"), F.max("n").alias("most"),
        F.max("reach").alias("far")))

    # queries against groups: tokens that can be the first ones shared with a member
    hits = save_table(live.select("token", F.col("sid").alias("x"), "n", "reach", "comp").join(
        matrix, "token").where(
        f"comp <> gc AND n >= least AND reach >= least AND far >= n AND 100 * most >= {percent} * n")
        .select("x", "g", "token", "n", "reach"))
    opened = save_table(hits.select("x", F.col("g").alias("y")).distinct())
    # pairs compared above are not compared again
    met = first.where("NOT linked")
    second = texts.compare(opened.join(met, ["x", "y"], "left_anti")).union(
        met.join(opened, ["x", "y"], "left_semi").select("x", "y", "nx", "ny", "both", "linked"))
    edges = edges.union(second.where("linked").select("x", "y"))
    comps2 = components(edges)

    # groups still apart: a member y shares at most what the leader shares and what y has besides
    apart = _with_comp(_with_comp(second.where("NOT linked"), comps2, "x", "cx"), comps2, "y", "cy")
    apart = apart.where("cx <> cy").select("x", F.col("y").alias("g"), "nx", "both")
    # (the most that any member adds to the bound below; groups of one have none)
    more = member.groupBy("g").agg(
        F.max(F.expr(f"{100 + percent} * extra - {percent} * ny")).alias("more"))
    apart = apart.join(more, "g").where(f"{100 + percent} * both + more >= {percent} * nx").drop(
        "more")
    inside = held.where("sid <> g").select("token", "g", F.col("sid").alias("y"),
                                           F.col("n").alias("ny"), F.col("reach").alias("far"))
    rest = save_table(apart).join(hits.select("x", "g", "token", "reach"), ["x", "g"])
    rest = save_table(rest).join(save_table(inside), ["token", "g"]).where(
        f"nx >= ny AND reach >= ny AND far >= nx AND 100 * ny >= {percent} * nx").select(
        "x", "y", "nx", "ny", "both").distinct()
    rest = rest.join(member.select(F.col("sid").alias("y"), "extra"), "y").where(
        f"{100 + percent} * (both + extra) >= {percent} * (nx + ny)")
    third = texts.compare(rest.select("x", "y").distinct())
    return components(edges.union(third.where("linked").select("x", "y")))


def judged(docs: DataFrame, size: int, percent: int, doc_id: str, text: str,
           known_frequent: int) -> DataFrame:
    """doc_id, t (hash of the text), n_shingles, component_id for every row."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(body).alias("t"),
                       body.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    longs = ", ".join(f"{c} {'binary' if c == 'sig' else 'bigint'}" for c in _NAMED[1:])
    for seed in range(8):
        found = save_table(rows.mapInArrow(_name(size, seed), f"doc_id {kind}, {longs}"))
        named = found.where("token IS NULL").drop("token", "docs")
        frequent = found.where("token IS NOT NULL").select("token", "docs")
        twice = named.groupBy("sid").agg(
            (F.min("second") != F.max("second")).alias("a"), (F.min("n") != F.max("n")).alias("b"))
        if twice.where("a OR b").isEmpty():
            break
    comps = links(rows, named, frequent, size, percent, seed, known_frequent)
    own = _with_comp(named.select("doc_id", "t", "n", "sid"), comps, "sid", "comp")
    own = save_table(own)
    least = save_table(own.where("n > 0").groupBy("comp").agg(
        F.min("doc_id").alias("component_id")))
    return own.join(least, "comp", "left").select(
        "doc_id", "t", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
        .alias("component_id"))


def join(docs: DataFrame, size: int = 5, percent: int = 75, doc_id: str = "doc_id",
         text: str = "text", known_frequent: int = 131_072) -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    Two rows link when their sets of `size`-word shingles have 100 * |both| >= percent * |union|;
    a component is what links connect, named by its smallest id.  A text without words (or null)
    has no shingles and is linked with nothing.  Rows with equal ids are rows of their own; a
    null id names a component only if there is no other.  An empty table gives no rows; other
    columns are not read.
    """
    return judged(docs, size, percent, doc_id, text, known_frequent).drop("t")


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 75, doc_id: str = "doc_id",
                text: str = "text", known_frequent: int = 131_072) -> DataFrame:
    """The rows of `docs` whose id is that of their component, with all their columns.

    A row with a null id goes where its component has a named row; else it stays, as do rows
    without words.  Equal rows stay or go together: take out exact copies first.
    """
    gone = save_table(judged(docs, size, percent, doc_id, text, known_frequent)
                      .where("NOT doc_id <=> component_id").distinct()
                      .select(F.col("doc_id").alias("_gone"), F.col("t").alias("_t")))
    body = F.coalesce(docs[f"`{text}`"].cast("string"), F.lit(""))
    return docs.join(gone, docs[f"`{doc_id}`"].eqNullSafe(gone["_gone"])
                     & (F.xxhash64(body) == gone["_t"]), "left_anti")
