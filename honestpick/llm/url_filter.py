"""URL filter: host and path rules first, else a logistic regression on hashed n-grams.

The model is trained on the driver from a small labelled table (LABELLED below, or the caller's
own); scoring runs in tasks on distinct urls of a batch.  Longest fitting rule wins.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from honestpick.llm.text import lower_ascii

# Invented hosts for training: to block, and to allow.  Each is paired with every path, so that
# paths alone say nothing unless a caller's own table makes them.
BLOCKED_HOSTS = tuple("""
casino-royal.example.com win-casino.example.net www.casino-win.example.org casino24.example.com
m.poker-win.example.org free-bets.example.net m.bets-free.example.com bet-free-now.example.org
sports-bets.example.com blog.free-bets.example.com big-win-bets.example.net
cheap-pills.example.org pills-online.example.com buy-cheap-meds.example.net
www.cheap-pills-shop.example.com pharma-pills.example.org diet-pills.example.net
spam-farm.example.com link-spam.example.net m.spam-farm.example.org seo-spam-links.example.com
content-farm.example.org link-farm.example.net adult-x.example.com www.adult-video.example.net
m.adult-x.example.org xxx-adult.example.com adult-dating.example.org x-cams.example.net
ads-track.example.com track-ads.example.net www.ads-track.example.org adserver.example.com
click-track.example.net banner-ads.example.org blog.ads-track.example.net
""".split())
ALLOWED_HOSTS = tuple("""
www.example.com blog.example.net news.example.org www.library.example.com m.weather.example.net
university.example.org blog.gardening.example.com museum.example.net www.history.example.org
docs.software.example.com recipes.example.net www.thornton.example.com thether.example.org
blog.tension.example.net m.thering.example.com www.therest.example.org nation.example.net
blog.thistle.example.com www.another.example.org m.station.example.net thermal.example.com
blog.edition.example.org www.thread.example.net healthy.example.com city-council.example.org
science-review.example.net blog.open-data.example.com www.bird-watch.example.org
m.train-times.example.net language-notes.example.com www.the-letters.example.org
old-maps.example.net blog.tonight.example.com m.brother.example.org www.rather.example.net
""".split())
PATHS = ("/", "/en/12", "/de/345.html", "/fr/77", "/es/608/", "/en/9012")
LABELLED = tuple((h + p, y) for y, hosts in ((1, BLOCKED_HOSTS), (0, ALLOWED_HOSTS))
                 for h in hosts for p in PATHS)
# The rules of the registered query: (host/path, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"),
         ("org/fr/", "allow"))


def host_of(url: Column) -> Column:
    """Between the first :// and the next / ? # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(_after(url), "^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ? or #; else empty."""
    return F.coalesce(F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, nulls if none fits."""
    rule = verdict = None
    for name, said in sorted(rules, key=lambda r: -len(r[0])):
        top, _, rest = name.partition("/")
        fits = ((host == top) | host.endswith("." + top)) & path.startswith("/" + rest)
        rule = F.when(fits, name) if rule is None else rule.when(fits, name)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


@dataclass(frozen=True)
class UrlModel:
    weights: np.ndarray
    bias: float
    sizes: tuple[int, ...]

    def features(self, host: str, path: str) -> np.ndarray:
        return ngrams(host, path, self.sizes, len(self.weights))

    def probability(self, host: str, path: str) -> float:
        """Of the label 1; 0 for a url too short to have n-grams: nothing speaks against it."""
        idx = self.features(host, path)
        if not len(idx):
            return 0.0
        z = self.bias + self.weights[idx].sum() / np.sqrt(len(idx))
        return float(1 / (1 + np.exp(-z)))


def ngrams(host: str, path: str, sizes: tuple[int, ...], slots: int) -> np.ndarray:
    """Slots of the distinct character n-grams; host and path hash apart."""
    grams = {(part + s[i:i + n]).encode("utf-8", "surrogatepass")
             for part, s in (("h", f"^{host}$" if host else ""), ("p", path))
             for n in sizes for i in range(len(s) - n + 1)}
    return np.unique(np.array([zlib.crc32(g) % slots for g in grams], dtype=np.int64))


def train(labelled=LABELLED, slots: int = 1 << 16, sizes: tuple[int, ...] = (3, 4, 5),
          penalty: float = 0.01, steps: int = 400, rate: float = 0.5) -> UrlModel:
    """Gradient descent on the mean log loss with a quadratic penalty; deterministic."""
    model = UrlModel(np.zeros(slots), 0.0, tuple(sizes))
    rows, y = [], np.array([label for _, label in labelled], dtype=float)
    for url, _ in labelled:
        host, slash, rest = url.partition("/")
        rows.append(model.features(host, (slash + rest).split("?")[0].split("#")[0]))
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    idx = np.concatenate(rows)
    value = np.repeat([1 / np.sqrt(len(r)) for r in rows], [len(r) for r in rows])
    w, b = np.zeros(slots), 0.0
    for _ in range(steps):
        z = b + np.bincount(row, value * w[idx], minlength=len(rows))
        g = (1 / (1 + np.exp(-z)) - y) / len(rows)
        w -= rate * 20 * (np.bincount(idx, value * g[row], minlength=slots) + penalty * w / 20)
        b -= rate * g.sum()
    return UrlModel(w, float(b), tuple(sizes))


def _judge(model: UrlModel, threshold: float):
    def run(batches):
        for batch in batches:
            seen: dict[tuple[str, str], float] = {}
            p = []
            for key in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(),
                           strict=True):
                if key not in seen:
                    seen[key] = model.probability(*key)
                p.append(seen[key])
            said = ["block" if x >= threshold else "allow" for x in p]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[batch.column(c) for c in ("host", "path", "rule", "ruled")],
                 pa.array(p, pa.float64()), pa.array(said)],
                ["id", "host", "path", "rule", "ruled", "p_block", "modelled"])
    return run


def judge_urls(pages: DataFrame, model: UrlModel | None = None, rules=RULES,
               threshold: float = 0.5, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, p_block for every row.

    A null url, or one without ://, has empty host and path, fits no rule and is allowed.  Equal rows are judged alike; other columns are not read.
    """
    model = model or train()
    u = F.col(f"`{url}`").cast("string")
    slim = (pages.select(F.col(f"`{page_id}`").alias("id"), host_of(u).alias("host"),
                         path_of(u).alias("path")))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    slim = slim.select("id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    kind = slim.schema["id"].dataType.simpleString()
    out = slim.mapInArrow(_judge(model, threshold),
                          f"id {kind}, host string, path string, rule string, ruled string, "
                          "p_block double, modelled string")
    return out.select(F.col("id").alias(page_id), "host", "path", "rule",
                      F.coalesce("ruled", "modelled").alias("verdict"), "p_block")
