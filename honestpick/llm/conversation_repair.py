"""Cheapest repair of a conversation's structure, decided by one minimum of whole numbers.

An edit keeps, reroles or deletes a row, or inserts one, so that the initials of the roles read
(s?(ua)+)?.  A node of the search is (rows read, what the initials so far end in, letters written);
an edge is an edit.  Each edge weighs one big integer: its cost in the high digits, and its audit
letter as the digit that belongs to the letter's position.  Digits are of fixed width, follow the
letters' order, and are zero after the last letter, so the sum of an audit's edges compares first
by cost, then as text does, the shorter of two first.  The least weight at the last row therefore
gives the cost, the audit and with it the repaired rows.

Spark deals conversations to tasks and sorts them; a task reads them as one stream.  For a
conversation it holds the weights of the few live nodes, a hash of the repaired rows for each,
and a 16-byte digest of each different row.  Letters that all live nodes share are moved out of
the weights, so a long conversation costs time in proportion to its rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Audit letters in their order, the roles' initials, white space of the contract.
LETTERS = "DIKR"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_BITS = 3
_START, _SYSTEM, _USER, _DONE = range(4)
_NEXT = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_DONE, "u"): _USER,
         (_USER, "a"): _DONE}
_ROLES = {"u": "user", "a": "assistant"}
_LEGAL = {"su", "ua", "au"}


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


@dataclass
class _Node:
    weight: int
    rows: hashlib._hashlib.HASH      # of the repaired rows so far
    empty: bool                      # no repaired row yet


class Search:
    """The nodes after the rows read so far, by (state, letters written)."""

    def __init__(self, costs: Costs, room: int = 16):
        self.costs, self.room, self.out = costs, room, []
        self.nodes = {(_START, 0): _Node(0, hashlib.sha256(), True)}
        # what one state must pay at most, to be followed by all that may follow another: an
        # inserted user or assistant row (or both), and that a kept system row is deleted
        lacks = {_START: 0, _SYSTEM: 0, _DONE: 0, _USER: 1}
        self.bridge = {(s, t): 0 if s == t else costs.insert * (
            lacks[s] + lacks[t] if s != _SYSTEM else 1 if t == _USER else 2)
            + (costs.delete if t == _START else 0) for s in lacks for t in lacks}

    def _edge(self, cost: int, letter: str, k: int) -> int:
        return ((cost << _BITS * self.room)
                + ((LETTERS.index(letter) + 1) << _BITS * (self.room - 1 - k)))

    def _cost(self, node: _Node) -> int:
        return node.weight >> _BITS * self.room

    def _digits(self, node: _Node) -> str:
        low = node.weight & ((1 << _BITS * self.room) - 1)
        return f"{low:0{self.room}o}"

    def _make_room(self) -> None:
        """Letters that all nodes begin with leave the weights; else digits are added."""
        texts = [self._digits(n)[:k] for (_, k), n in self.nodes.items()]
        lo, hi = min(texts), max(texts)
        n = next((i for i, (a, b) in enumerate(zip(lo, hi, strict=False)) if a != b),
                 min(map(len, texts)))
        more = self.room if n < self.room // 2 else 0
        self.out.append(lo[:n])
        self.nodes = {(s, k - n): _Node(
            (self._cost(v) << _BITS * (self.room + more))
            + (((v.weight & ((1 << _BITS * (self.room - n)) - 1)) << _BITS * (n + more))), v.rows,
            v.empty) for (s, k), v in self.nodes.items()}
        self.room += more

    def _relax(self, edges) -> dict:
        """The nodes that edges (from, to state, cost, letter, role, text) lead to."""
        best: dict = {}
        for (state, k), node, to, cost, letter, row in edges:
            w = node.weight + self._edge(cost, letter, k)
            old = best.get((to, k + 1))
            if old is None or w < old[0]:
                best[to, k + 1] = w, node, row
        return best

    @staticmethod
    def _written(found) -> _Node:
        w, node, row = found
        if row is None:
            return _Node(w, node.rows, node.empty)
        rows = node.rows.copy()
        rows.update((row if node.empty else "\n" + row).encode("utf-8", "surrogatepass"))
        return _Node(w, rows, False)

    def _least(self, best: dict) -> dict:
        """Without nodes that another one undercuts, also after the edits that allow it all that
        may follow the first."""
        cost, room = {}, _BITS * self.room
        for (s, _), f in best.items():
            c = f[0] >> room
            if c < cost.get(s, c + 1):
                cost[s] = c
        limit = {s: min([c + self.bridge[t, s] for t, c in cost.items()]) for s in cost}
        return {at: f for at, f in best.items() if f[0] >> room <= limit[at[0]]}

    def _insert(self) -> None:
        """Up to two inserted rows before the next one: a third would come back to a state."""
        front = self.nodes
        for _ in range(2):
            best = self._relax(
                (at, node, _NEXT[at[0], c], self.costs.insert, "I", _ROLES[c] + ":")
                for at, node in front.items() for c in "ua" if (at[0], c) in _NEXT)
            old = {at: (v.weight, v, None) for at, v in self.nodes.items()}
            both = old | {at: f for at, f in best.items()
                          if at not in old or f[0] < old[at][0]}
            kept = self._least(both)
            front = {at: self._written(f) for at, f in kept.items() if f is not old.get(at)}
            self.nodes = {at: v for at, v in self.nodes.items()
                          if at in kept and at not in front} | front
            if not front:
                break

    def _ready(self) -> None:
        while max(k for _, k in self.nodes) + 3 > self.room:
            self._make_room()
        self._insert()

    def read(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        self._ready()
        extra = self.costs.truncated if truncated else 0
        edges = []
        for at, node in self.nodes.items():
            edges.append((at, node, at[0], self.costs.delete, "D", None))
            if must_go:
                continue
            to = _NEXT.get((at[0], role[:1]))
            if to is not None:
                edges.append((at, node, to, extra, "K", f"{role}:{text}"))
            for c, name in _ROLES.items():
                to = _NEXT.get((at[0], c))
                if to is not None:
                    edges.append((at, node, to, self.costs.rerole + extra, "R", f"{name}:{text}"))
        self.nodes = {at: self._written(f) for at, f in self._least(self._relax(edges)).items()}

    def result(self) -> tuple[int, str, str]:
        """(cost, audit, hex SHA-256 of the repaired rows)."""
        self._ready()
        end = min((v for (s, _), v in self.nodes.items() if s in (_START, _DONE)),
                  key=lambda v: v.weight)
        digits = "".join(self.out) + self._digits(end).rstrip("0")
        return self._cost(end), "".join(LETTERS[int(d) - 1] for d in digits), end.rows.hexdigest()


class Conversation:
    """Counts and repair of one conversation, whose rows come in order."""

    def __init__(self, key, costs: Costs):
        self.key, self.search = key, Search(costs)
        self.low = self.high = self.turn = None
        self.turns = self.illegal = 0
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.seen: set[bytes] = set()
        self.initial = None

    def read(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
            self.turns += 1
        if self.initial is not None and self.initial + role[:1] not in _LEGAL:
            self.illegal += 1
        self.initial = role[:1]
        raw = role.encode("utf-8", "surrogatepass")
        digest = hashlib.blake2b(b"%d:%b%b" % (len(raw), raw, text.encode(
            "utf-8", "surrogatepass")), digest_size=16).digest()
        solid = text.rstrip(SPACE)
        fault = ("blank" if not solid else "duplicate" if digest in self.seen
                 else "truncated" if solid[-1] not in ".!?" else None)
        self.seen.add(digest)
        if fault:
            self.faults[fault] += 1
        self.search.read(role, text, fault in ("blank", "duplicate"), fault == "truncated")

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.key, gaps, *self.faults.values(), self.illegal, *self.search.result())


_NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
          "repaired_sha256"]


def _repair(costs: Costs, kind: pa.DataType | None = None, lot: int = 2_000):
    def run(batches: Iterator[pa.RecordBatch]):
        def packed(done):
            cols = list(zip(*done, strict=True))
            types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types, strict=True)], _NAMES)

        now, done, chars = None, [], 0
        for batch in batches:
            kind = batch.column(0).type
            for i in range(0, batch.num_rows, 1_000):
                part = batch.slice(i, 1_000)
                for key, turn, role, text, there in zip(*[c.to_pylist() for c in part.columns],
                                                        strict=True):
                    if now is None or key != now.key:
                        if now is not None:
                            done.append(now.result())
                            chars += len(done[-1][-2])
                        now = Conversation(key, costs)
                    if there:
                        now.read(turn, role, text)
                    if len(done) >= lot or chars > 10_000_000:
                        yield packed(done)
                        done, chars = [], 0
        if now is not None:
            done.append(now.result())
            yield packed(done)
    return run


def _rows(conv: DataFrame, conv_id: str, turn: str, role: str, text: str,
          there: Column | None) -> DataFrame:
    def said(c):
        return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    return conv.select(F.col(f"`{conv_id}`").alias("conv_id"),
                       F.col(f"`{turn}`").cast("bigint").alias("turn"), said(role).alias("role"),
                       said(text).alias("text"),
                       F.coalesce(F.lit(True) if there is None else there, F.lit(False))
                       .alias("there"))


def repair(conv: DataFrame, costs: Costs = Costs(), conv_id: str = "conv_id", turn: str = "turn",
           role: str = "role", text: str = "text", there: Column | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit
    (one letter per edit, in order: D delete, I insert, K keep, R rerole), repaired_sha256
    (of the repaired `role:text`, joined by newlines).

    Rows are taken by turn, nulls first, then by role and text.  A null role or text is one space;
    such a role, or an empty one, must be changed or deleted.  A blank row or one whose role and
    text came before must be deleted; one that does not end in [.!?] costs more while it stays.
    A null conv_id is a conversation.  Rows for which `there` is not true only name their
    conversation: without others it has zeros, an empty audit and the hash of nothing.  An empty
    table gives no rows; other columns are not read.
    """
    rows = _rows(conv, conv_id, turn, role, text, there)
    kind = rows.schema["conv_id"].dataType.simpleString()
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(
        _repair(costs), f"conv_id {kind}, gaps bigint, blank bigint, duplicate bigint, "
        "truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")


def _apply():
    """Rows of the repaired conversations; the audit comes before the rows it belongs to."""
    def run(batches: Iterator[pa.RecordBatch]):
        letters, state, at, n = "", _START, 0, 0

        def inserted():
            nonlocal at, state, n
            while at < len(letters) and letters[at] == "I":
                c = "a" if state == _USER else "u"
                at, state, n = at + 1, _NEXT[state, c], n + 1
                yield (n - 1, "I", _ROLES[c], "")

        for batch in batches:
            for i in range(0, batch.num_rows, 1_000):
                part, out, key_at = batch.slice(i, 1_000), [], []
                for j, (audit, role, text) in enumerate(zip(*[part.column(c).to_pylist() for c in (
                        "audit", "role", "text")], strict=True)):
                    if audit is not None:
                        letters, state, at, n = audit, _START, 0, 0
                        made = [*inserted()]
                    else:
                        edit, at = letters[at], at + 1
                        made = []
                        if edit != "D":
                            c = role[:1] if edit == "K" else "a" if state == _USER else "u"
                            state, n = _NEXT[state, c], n + 1
                            made.append((n - 1, edit, role if edit == "K" else _ROLES[c], text))
                        made += inserted()
                    out += made
                    key_at += [j] * len(made)
                if out:
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(key_at)), pa.array(cols[0], pa.int64()),
                         *[pa.array(c, pa.string()) for c in cols[1:]]],
                        ["conv_id", "place", "edit", "role", "text"])
    return run


def repaired(conv: DataFrame, audits: DataFrame, conv_id: str = "conv_id", turn: str = "turn",
             role: str = "role", text: str = "text", there: Column | None = None) -> DataFrame:
    """conv_id, place (from 0), edit, role, text: the rows of the repaired conversations, by the
    audits that repair() gave for the same rows."""
    rows = _rows(conv, conv_id, turn, role, text, there).where("there").select(
        "conv_id", F.lit(1).alias("k"), "turn", "role", "text",
        F.lit(None).cast("string").alias("audit"))
    first = audits.select("conv_id", F.lit(0).alias("k"), F.lit(None).cast("bigint").alias("turn"),
                          F.lit("").alias("role"), F.lit("").alias("text"), "audit")
    ordered = rows.union(first).repartition("conv_id").sortWithinPartitions(
        "conv_id", "k", "turn", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(
        _apply(), f"conv_id {kind}, place bigint, edit string, role string, text string")
