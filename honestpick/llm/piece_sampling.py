"""Sampled segmentations over the piece lattice, and lossless decoding.

All ways to cut a text into vocabulary pieces form a lattice.  A forward pass sums the weights
of all paths up to each position; a backward pass draws one path with probability proportional
to its weight.  No piece goes on after a space or newline begins the next word, so every path
passes those places and words can be summed apart: the forward pass runs once for each distinct
word of a few hundred documents, the backward pass for all its occurrences at once.

Each random number is a hash of the seed, the row's key and the position in the text: the same
row gives the same pieces in any partitioning and after a lost executor.  Texts are taken as
they are: a space is the vocabulary's space sign, a character without a piece becomes its bytes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from honestpick.llm.text import mix, text_pieces

_SPACE_SIGN = "▁"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(42)


def _hash(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h + ord(c) + 1) * int(_MULTIPLIER) % (1 << 64)
    return h


class Lattice:
    """Vocabulary of a piece model with a weight for each piece.

    A model whose scores are log probabilities uses them (`ranked=False`); one whose scores are
    merge ranks gives the piece of rank r the probability 1 / r.  `alpha` is the power that all
    path weights are raised to: 0 is uniform over paths, large values near the best path.
    """

    def __init__(self, model_path: str, alpha: float = 1.0, ranked: bool = True):
        import sentencepiece
        m = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = m.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, dtype=np.int64)
        self.id_of: dict[str, int] = {}
        weight = np.full(n + 1, -np.inf)
        rank = 0
        for i in range(n):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_id[value], self.bytes_of[i] = i, bytes([value])
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                rank += 1
                plain = piece.replace(_SPACE_SIGN, " ")
                self.id_of[plain], self.bytes_of[i] = i, plain.encode()
                weight[i] = alpha * (-np.log(rank) if ranked else m.get_score(i))
        self.longest = max(map(len, self.id_of))
        hashes = np.array([_hash(p) for p in self.id_of], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.hashed_ids = np.array(list(self.id_of.values()), dtype=np.int32)[order]
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[self.hashes >> _SHIFT] = True
        self.weight = weight            # the last is for a character without a piece: see below
        self.weight[n] = 0.0            # that character has no other way, so any weight will do
        breaks = "\n" if not any("\n" in p for p in self.id_of) else ""
        if any(re.search("[^ ] ", p) for p in self.id_of):
            raise ValueError("a piece goes on after a space; words cannot be taken apart")
        self.words = re.compile(f" *[^ {breaks}]+| +" + (f"|{breaks}" if breaks else ""))

    # A lattice edge is a piece id, -1 for none, or -2 - code point for a character's bytes.
    def _edges(self, words: list[str], length: int) -> np.ndarray:
        """[word, end - 1, piece length - 1] -> edge.

        Substrings are looked up by hash, one length after the other for all words; `lossless`
        would show a chance equality.
        """
        widest = min(length, self.longest)
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        code = code.reshape(len(words), length).astype(np.uint64)
        edges = np.full((len(words), length, widest), -1, dtype=np.int32)
        h = np.zeros_like(code)
        for k in range(widest):
            h = (h[:, :length - k] + code[:, k:] + np.uint64(1)) * _MULTIPLIER
            likely = np.flatnonzero(self.maybe[(h >> _SHIFT).ravel()])
            found = h.ravel()[likely]
            slot = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
            ok = self.hashes[slot] == found
            row, start = np.divmod(likely[ok], length - k)
            edges[row, start + k, k] = self.hashed_ids[slot[ok]]
        single = edges[:, :, 0]
        edges[:, :, 0] = np.where(single >= 0, single, -2 - code.astype(np.int32))
        return edges

    def _cumulative(self, edges: np.ndarray) -> np.ndarray:
        """Chance that the last piece before each end is at most so long, by forward sums."""
        count, length, widest = edges.shape
        w = self.weight[np.where(edges < -1, len(self.weight) - 1, edges)]
        w[edges == -1] = -np.inf
        total = np.full((count, length + 1), -np.inf)
        total[:, 0] = 0.0
        chance = np.zeros(edges.shape)
        for end in range(1, length + 1):
            k = min(end, widest)
            terms = total[:, end - k:end][:, ::-1] + w[:, end - 1, :k]
            top = terms.max(axis=1, keepdims=True)
            e = np.exp(terms - top)
            total[:, end] = top[:, 0] + np.log(e.sum(axis=1))
            chance[:, end - 1, :k] = e
        cum = np.cumsum(chance, axis=2)
        return cum / cum[:, :, -1:]

    def sample(self, texts: list[str], seeds: np.ndarray) -> list[np.ndarray]:
        """Piece ids of each text; `seeds` are unsigned 64-bit, one for each text."""
        words = [self.words.findall(t) for t in texts]
        per_text = np.array([len(w) for w in words], dtype=np.int64)
        flat = [w for ws in words for w in ws]
        lengths = np.array(list(map(len, flat)), dtype=np.int64)
        starts = np.cumsum(lengths) - lengths           # in all texts put together
        text_of = np.repeat(np.arange(len(texts)), per_text)
        text_start = np.cumsum([0, *map(len, texts)])[:-1]
        distinct = list(dict.fromkeys(flat))
        number = dict(zip(distinct, range(len(distinct)), strict=True))
        code = np.fromiter(map(number.__getitem__, flat), dtype=np.int64, count=len(flat))
        at, chosen = [], []
        for length in np.unique(lengths):
            occ = np.flatnonzero(lengths == length)
            own, inverse = np.unique(code[occ], return_inverse=True)
            edges = self._edges([distinct[i] for i in own], int(length))
            cum = self._cumulative(edges)
            end = np.full(len(occ), length)
            seed = seeds[text_of[occ]]
            first = starts[occ]
            local = (first - text_start[text_of[occ]]).astype(np.uint64)
            while len(end):
                r = mix(seed + (local + end.astype(np.uint64)) * _STEP)
                u = (r >> np.uint64(11)).astype(np.float64) / float(1 << 53)
                k = (cum[inverse, end - 1] <= u[:, None]).sum(axis=1)
                k = np.minimum(k, edges.shape[2] - 1)
                edge = edges[inverse, end - 1, k]
                end = end - k - 1
                at.append(first + end)
                chosen.append(edge)
                go = end > 0
                end, seed, first, local, inverse = (x[go] for x in (end, seed, first, local,
                                                                    inverse))
        if not at:
            return [np.zeros(0, dtype=np.int32) for _ in texts]
        at, chosen = np.concatenate(at), np.concatenate(chosen)
        order = np.argsort(at)
        at, chosen = at[order], chosen[order]
        pieces_in = np.diff(np.searchsorted(at, [*text_start, int(lengths.sum())]))
        out, i = [], 0
        for n in pieces_in:
            out.append(self._with_bytes(chosen[i:i + n]))
            i += n
        return out

    def _with_bytes(self, edges: np.ndarray) -> np.ndarray:
        if not len(edges) or edges.min() >= 0:
            return edges.astype(np.int32)
        parts, last = [], 0
        for i in np.flatnonzero(edges < 0):
            raw = np.frombuffer(chr(-2 - edges[i]).encode("utf-8", "surrogatepass"), np.uint8)
            parts += [edges[last:i], self.byte_id[raw]]
            last = i + 1
        return np.concatenate([*parts, edges[last:]]).astype(np.int32)

    def decode(self, ids) -> str:
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "surrogatepass")


def seeds_of(keys: list, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(f"{seed}:{k}".encode()) for k in keys],
                    dtype=np.uint64)


_LATTICES: dict[tuple, Lattice] = {}


def lattice(*key) -> Lattice:
    """One per worker and setting."""
    if key not in _LATTICES:
        _LATTICES[key] = Lattice(*key)
    return _LATTICES[key]


def _encode(model_path: str, alpha: float, ranked: bool, seed: int):
    def run(batches):
        lat = lattice(model_path, alpha, ranked)
        for batch in batches:
            for i, texts in text_pieces(batch.column(1), rows=800):
                texts = [t or "" for t in texts]
                keys = batch.column(0).slice(i, len(texts))
                ids = lat.sample(texts, seeds_of(keys.to_pylist(), seed))
                sizes = np.array([len(x) for x in ids])
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(sizes, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids),
                                                                       pa.int32())),
                     pa.array([lat.decode(x.tolist()) == t
                               for x, t in zip(ids, texts, strict=True)])],
                    ["doc_id", "n_ids", "ids", "lossless"])
    return run


def encode(docs: DataFrame, model_path: str, alpha: float = 1.0, ranked: bool = True,
           seed: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_ids, ids, lossless for every row; `lossless` tells that decoding was tried.

    A null or empty text has no ids.  Rows with the same key and text get the same ids; a null
    key is a key of its own; other columns are not read.
    """
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"),
                       F.col(f"`{text}`").cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(_encode(model_path, alpha, ranked, seed),
                           f"doc_id {kind}, n_ids bigint, ids array<int>, lossless boolean")


def _decode(model_path: str):
    def run(batches):
        lat = lattice(model_path, 1.0, True)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([lat.decode(x or []) for x in
                                            batch.column(1).to_pylist()], pa.string())],
                ["doc_id", "text"])
    return run


def decode(encoded: DataFrame, model_path: str, doc_id: str = "doc_id",
           ids: str = "ids") -> DataFrame:
    """doc_id, text; null ids give an empty text."""
    slim = encoded.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{ids}`").alias("ids"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(_decode(model_path), f"doc_id {kind}, text string")
