"""Packing by concatenate and cut.

All documents' token ids, each with an end mark, form one long stream that is cut every `length`
ids.  Pass one tokenizes: one row per document with its ids, written to the shared folder along
with the number of the writing task and the ids before it in that task.  Prefix sums over the
tasks' totals (one row per task) turn that into offsets in the whole stream.  Pass two cuts at
the multiples of `length`; a document across a boundary gets one record for each side.

Nothing is shuffled but the totals; the only broadcast is one number per input partition.  A
lost task of pass one is done again from the same split; pass two reads files.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from honestpick.functions.lineage import save_table
from honestpick.llm.text import text_pieces

_ROOM = 400_000     # chunks a worker remembers
_UNSAFE = re.compile(r" (?=\s|\Z)")
# Fixed value: how byte-level vocabularies cut text before merging.
_CUTS = (r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """bytes -> id of a byte-level BPE file whose ids follow its merges; else None."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if (model.get("type") != "BPE" or spec.get("normalizer") or model.get("dropout")
            or any(pre.get(k, v) != v for k, v in plain.items()) or "type" not in pre):
        return None
    shown = [b for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r)]
    letter = {chr(b): b for b in shown}
    letter |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    vocab = model["vocab"]
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if merged != sorted(merged):
        return None
    special = {t["content"] for t in spec.get("added_tokens", [])}
    return {bytes(letter[c] for c in t): i for t, i in vocab.items() if t not in special}


class ChunkIds(dict):
    """Ids (as bytes) of text chunks; chunks not met before are encoded together.

    A byte-level BPE never joins a space to what stands before it, so a text splits before a
    space without changing its ids, unless white space or the end follows that space.  New
    chunks are put in one string, encoded at once, and cut apart by the lengths of their ids.
    Texts that cannot be split, or hold a special token, go to the tokenizer whole.
    """

    def __init__(self, path: str, width: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer, self.width = Tokenizer.from_file(path), width
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = byte_ranks(path)
        self.merger = None
        if ranks is not None:
            import tiktoken
            self.merger = tiktoken.Encoding("chunks", pat_str=_CUTS, mergeable_ranks=ranks,
                                            special_tokens={})
            self.id_bytes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
            for token, i in ranks.items():
                self.id_bytes[i] = len(token)

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(ids, dtype=self.width).tobytes()

    def learn(self, chunks: list[str]) -> None:
        """Chunks that begin with a space, but for those at the start of a text."""
        for c in [c for c in chunks if not c.startswith(" ")]:
            self[c] = np.array(self.merger.encode_ordinary(c), dtype=self.width).tobytes()
        rest = [c for c in chunks if c.startswith(" ")]
        ids = np.array(self.merger.encode_ordinary("".join(rest)), dtype=np.int64)
        after = np.cumsum(self.id_bytes[ids])
        ends = np.cumsum([len(c.encode()) for c in rest])
        cuts = (np.searchsorted(after, ends) + 1).tolist() if rest else []
        if rest and not np.array_equal(after[np.array(cuts) - 1], ends):
            raise AssertionError("an id goes beyond its chunk")
        raw, size, start = ids.astype(self.width).tobytes(), np.dtype(self.width).itemsize, 0
        for c, end in zip(rest, cuts, strict=True):
            self[c] = raw[start * size:end * size]
            start = end

    def of(self, texts: list[str]) -> Iterator[bytes]:
        split: list[list[str] | None] = []
        for t in texts:
            if self.merger is None or _UNSAFE.search(t) or any(s in t for s in self.special):
                split.append(None)
            else:
                first, *rest = t.split(" ")
                split.append([first, *[" " + x for x in rest]])
        if len(self) > _ROOM:
            self.clear()
        new = {c for chunks in split if chunks for c in chunks if c not in self}
        if new:
            self.learn(list(new))
        for t, chunks in zip(texts, split, strict=True):
            yield self.whole(t) if chunks is None else b"".join(map(self.__getitem__, chunks))


_KNOWN: dict[tuple, ChunkIds] = {}


def chunk_ids(*key) -> ChunkIds:
    """One per worker and tokenizer: a worker keeps what it has learnt for its next task."""
    if key not in _KNOWN:
        _KNOWN[key] = ChunkIds(*key)
    return _KNOWN[key]


def _tokenize(path: str, end_id: int, width: str):
    def run(batches):
        ids, part, before = chunk_ids(path, width), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype=width).tobytes()
        for batch in batches:
            for i, texts in text_pieces(batch.column(1), rows=1_000):
                packed = [x + end for x in ids.of([t or "" for t in texts])]
                sizes = np.array([len(x) for x in packed], dtype=np.int64) // len(end)
                starts = before + np.cumsum(sizes) - sizes
                before += int(sizes.sum())
                n = len(packed)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, n), pa.array(np.full(n, part, dtype=np.int32)),
                     pa.array(starts), pa.array(sizes), pa.array(packed, pa.binary())],
                    ["doc_id", "part", "start_in_part", "doc_tokens", "ids"])
    return run


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int = 1, doc_id: str = "doc_id",
              text: str = "text", wide: bool = False) -> DataFrame:
    """doc_id, part, start_in_part, doc_tokens, ids (binary, 2 or with `wide` 4 bytes each)."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(
        _tokenize(tokenizer_path, end_id, "<u4" if wide else "<u2"),
        f"doc_id {kind}, part int, start_in_part bigint, doc_tokens bigint, ids binary")


def with_offsets(tokens: DataFrame) -> DataFrame:
    """Adds `at`, the ids before the document in the whole stream."""
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    # one row per input partition, whatever the number of documents
    return (tokens.join(F.broadcast(before), "part")
            .withColumn("at", F.col("before") + F.col("start_in_part")).drop("before", "part"))


def _cut(length: int, width: str, with_ids: bool):
    def pieces(at: int, n: int):
        start = 0
        while start < n:
            offset = (at + start) % length
            size = min(length - offset, n - start)
            yield start, size, (at + start) // length, offset
            start += size

    def run(batches):
        for batch in batches:
            # flush in small lots: a very long document has many pieces
            rows: list[tuple] = []
            keys = batch.column("doc_id")
            index: list[int] = []
            for i, (at, n, raw) in enumerate(zip(batch.column("at").to_pylist(),
                                                 batch.column("doc_tokens").to_pylist(),
                                                 batch.column("ids"), strict=True)):
                ids = np.frombuffer(raw.as_buffer(), dtype=width).astype("<u4")
                for start, size, seq, offset in pieces(at, n):
                    part = ids[start:start + size]
                    rows.append((start, size, zlib.crc32(part), n, seq, offset,
                                 part.tolist() if with_ids else None))
                    index.append(i)
                    if len(rows) >= 20_000:
                        yield _batch(keys, index, rows, with_ids)
                        rows, index = [], []
            if rows:
                yield _batch(keys, index, rows, with_ids)
    return run


def _batch(keys, index, rows, with_ids):
    cols = list(zip(*rows, strict=True))
    arrays = [keys.take(pa.array(index))] + [pa.array(c, pa.int64()) for c in cols[:6]]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if with_ids:
        arrays.append(pa.array(cols[6], pa.list_(pa.int32())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(arrays, names)


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1,
         doc_id: str = "doc_id", text: str = "text", wide: bool = False,
         with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    (and `ids`, when asked for).

    Every sequence but the last is full, so padding is under one sequence for all documents.
    A null or empty text is the end mark alone.  Equal rows and equal or null keys stay separate
    documents; other columns are not read.  An empty table gives no rows.  `wide` is for
    vocabularies of more than 65,536 ids.
    """
    saved = save_table(tokenized(docs, tokenizer_path, end_id, doc_id, text, wide))
    kind = saved.schema["doc_id"].dataType.simpleString()
    return with_offsets(saved).select("doc_id", "doc_tokens", "ids", "at").mapInArrow(
        _cut(length, "<u4" if wide else "<u2", with_ids),
        f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
        "sequence_id bigint, offset bigint" + (", ids array<int>" if with_ids else ""))
