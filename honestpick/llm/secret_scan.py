"""Secret scans: keyword automaton, anchored patterns at its hits, checksums inside tokens.

One pass over an ASCII-lowered copy of each text with an Aho-Corasick automaton gives the places
worth looking at; patterns are matched there only, anchored at the hit.  Long hex runs have no
keyword and are searched for directly.  Issued tokens that carry a checksum (a CRC-32 in base 62
at the end) count only when it fits.
"""

from __future__ import annotations

import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from honestpick.llm.text import text_pieces

# The kinds' forms.
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ISSUED_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
ISSUED = re.compile(r"(?:ghp|gho|ghu|ghs|ghr|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum62(body: str) -> str:
    """CRC-32 of the body in base 62, six digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


def keyword_automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for kind, words in (("assign", ASSIGN_WORDS), ("access", ("akia",)),
                        ("issued", ISSUED_PREFIXES)):
        for w in words:
            auto.add_word(w, (kind, len(w)))
    auto.make_automaton()
    return auto


def lowered(text: str) -> str:
    """A-Z lower-cased, every other character and all positions as they were."""
    if text.isascii():
        return text.lower()
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def find_spans(text: str, auto: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start and then kind.

    Matches of a kind don't overlap; the leftmost is taken.  A match that fails its length or
    checksum is dropped, and what it covers is not searched again for that kind.
    """
    found: list[tuple[str, int, int]] = []
    done = {"assign": 0, "access": 0, "issued": 0}
    hits = sorted((last - n + 1, kind) for last, (kind, n) in auto.iter(lowered(text)))
    for start, kind in hits:
        if start < done[kind]:
            continue
        if kind == "assign" and (m := ASSIGN.match(text, start)):
            done[kind] = m.end()
            if len(m[2]) >= 6:
                found.append((kind, start, m.end()))
        elif kind == "access" and (m := ACCESS.match(text, start)):
            done[kind] = m.end()
            if m.end() - start >= 20:
                found.append((kind, start, m.end()))
        elif kind == "issued" and (m := ISSUED.match(text, start)):
            done[kind] = m.end()
            if checksum62(m[1]) == m[2]:
                found.append((kind, start, m.end()))
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    order = {k: i for i, k in enumerate((*BASE_KINDS, "issued"))}
    return sorted(found, key=lambda s: (s[1], order[s[0]]))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by the name of its kind in brackets; where spans
    overlap, one replacement covers them and names the first."""
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"[{kind} removed]"]
        at = end
    return "".join(out) + text[at:]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def _scan(with_text: bool):
    def run(batches):
        auto = keyword_automaton()
        for batch in batches:
            for i, texts in text_pieces(batch.column(batch.num_columns - 1)):
                spans = [find_spans(t, auto) if t else [] for t in texts]
                cols = [batch.column(c).slice(i, len(texts))
                        for c in range(batch.num_columns - 1)]
                cols.append(pa.array([[dict(zip(("kind", "start", "end"), s, strict=True))
                                       for s in row] for row in spans], pa.list_(_SPAN)))
                names = [*batch.schema.names[:-1], "spans"]
                if with_text:
                    cols.append(pa.array([redact(t, s) if s else t
                                          for t, s in zip(texts, spans, strict=True)],
                                         pa.string()))
                    names.append("clean")
                yield pa.RecordBatch.from_arrays(cols, names)
    return run


_SPANS = "spans array<struct<kind:string,start:bigint,`end`:bigint>>"


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans (array of kind, start, end) for every row.

    A null or empty text has no spans; equal rows are scanned each; other columns are not read.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(_scan(False), f"doc_id {kind}, {_SPANS}")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns of `docs`, with secrets in `text` replaced; a null text stays null."""
    rest = [c for c in docs.columns if c != text]
    names = [f"c{i}" for i in range(len(rest))]
    slim = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(rest, names, strict=True)],
                       F.col(f"`{text}`").cast("string").alias("text"))
    kept = ", ".join(f"{n} {slim.schema[n].dataType.simpleString()}" for n in names)
    out = slim.mapInArrow(_scan(True), (kept + ", " if kept else "") + f"{_SPANS}, clean string")
    back = dict(zip(rest, names, strict=True)) | {text: "clean"}
    return out.select(*[F.col(back[c]).alias(c) for c in docs.columns])


def _joined(c):
    return F.array_join(F.transform(c, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the SHA-256 of their spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
                        F.sha2(_joined(base), 256).alias("base_sha256"),
                        _joined(F.col("spans")).alias("spans"))
