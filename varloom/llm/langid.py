"""Language identification by Bayesian evidence fusion.

posterior(l) ~ P(text | l)^t * P(declared | l) * P(suffix | l) * prior_host(l)

* text: a multinomial model over hashed byte trigrams of the whole visible text, trained by grouped
  aggregation over all labelled documents; t < 1 tempers it, since overlapping trigrams are no independent
  evidence;
* declared: the markup's lang attribute (its primary subtag), with a confusion table estimated from the
  texts' own posteriors;
* suffix: the address's country suffix (generic ones are one class), estimated likewise;
* host: counts of the texts' posteriors by host, smoothed towards the registered domain, and that towards
  all pages; a page's own share is taken out of its host's and domain's counts before it is judged.

All tables come from partial aggregations, so a host with a third of the pages is a sum like any other.

Defined cases: null or empty html has no text evidence (the priors decide); a missing lang attribute or
one that is no two- or three-letter code is neutral; a null url has the host ''; ties go to the first
language by name; repeated pages count each; no labelled text gives null languages; an empty table gives
an empty result; other columns are ignored. Documents without a label or text teach nothing.
"""

from __future__ import annotations

import html as html_lib
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, lean, text_buffers, written

FEATURES = 1 << 14
_BLOCK = 1 << 15  # text bytes whose trigrams are looked up at once, a row of languages each
_PIECE = 4 << 20  # of a longer text, whose trigrams are counted
_SKIP = re.compile(r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")


@dataclass(frozen=True)
class LangParams:
    temper: float = 0.2
    smooth: float = 0.5  # of trigram counts
    host_weight: float = 10.0  # pseudo-pages of the domain behind a host
    domain_weight: float = 20.0  # pseudo-pages of all hosts behind a domain
    table_smooth: float = 1.0


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the byte trigrams of each text (A-Z lower-cased) and their number per text."""
    n = np.maximum(np.diff(offsets) - 2, 0)
    if len(data) < 3 or not n.sum():
        return np.zeros(0, np.int64), np.zeros(len(n), np.int64)
    low = data.astype(np.uint32)
    low += ((data >= 65) & (data <= 90)).astype(np.uint32) * 32
    code = low[:-2] << 16 | low[1:-1] << 8 | low[2:]
    feature = (code * np.uint32(2654435761)) >> np.uint32(18)
    keep = np.ones(len(code), bool)
    ends = offsets[1:][np.diff(offsets) > 0]
    for back in (1, 2):
        at = ends - back
        keep[at[(at >= 0) & (at < len(code))]] = False
    return feature[keep].astype(np.int64), n


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", smooth: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Language names and the log probability of each feature, [FEATURES, languages]; counts cover all rows."""
    import pyarrow as pa

    def count(batches):
        tally: dict[str, np.ndarray] = {}
        for batch in batches:
            data, off = text_buffers(batch.column(0))
            names = batch.column(1).to_pylist()
            for i, j in blocks(off, 4 << 20):
                feature, n = trigrams(data[off[i] : off[j]], off[i : j + 1] - off[i])
                own = np.repeat(np.arange(i, j), n)
                for name in {x for x in names[i:j] if x}:
                    mine = np.array([x == name for x in names[i:j]])
                    got = np.bincount(feature[mine[own - i]], minlength=FEATURES)
                    tally[name] = tally.get(name, 0) + got
        for name, got in tally.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(got[at])], names=["lang", "feature", "n"])

    rows = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("l is not null and t is not null")
    counts = rows.mapInArrow(lean(count), "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(counts["lang"].unique())  # at most FEATURES rows a language
    table = np.full((FEATURES, len(names)), smooth)
    for k, name in enumerate(names):
        mine = counts[counts["lang"] == name]
        table[mine["feature"].to_numpy(), k] += mine["n"].to_numpy()
    return names, np.log(table / table.sum(axis=0)) if names else table


def visible(html: str | None) -> str:
    return html_lib.unescape(_SKIP.sub(" ", html)) if html else ""


def _score(texts: list[str], model: np.ndarray) -> np.ndarray:
    import pyarrow as pa

    data, off = text_buffers(pa.array(texts, pa.large_string()))
    out = np.zeros((len(texts), model.shape[1]))
    for i, j in blocks(off, _BLOCK):
        if off[j] - off[i] > _BLOCK:  # one long text: its counts, gathered piece by piece
            tally = np.zeros(len(model), np.int64)
            for lo in range(int(off[i]), int(off[j]), _PIECE):
                part = data[lo : min(lo + _PIECE + 2, off[j])]
                tally += np.bincount(trigrams(part, np.array([0, len(part)]))[0], minlength=len(model))
            out[i] = tally @ model
            continue
        feature, n = trigrams(data[off[i] : off[j]], off[i : j + 1] - off[i])
        cells = np.concatenate([np.zeros((1, model.shape[1])), np.cumsum(model[feature], axis=0)])
        ends = np.cumsum(n)
        out[i:j] = cells[ends] - cells[ends - n]
    return out


def _vector(table: Column, size: int) -> list[Column]:
    return [table[i] for i in range(size)]


def identify(pages: DataFrame, model: tuple[list[str], np.ndarray], key: str = "page_id", url: str = "url", html: str = "html", p: LangParams = LangParams()) -> DataFrame:
    """(page_id, lang, prob, text_lang, declared, host)"""
    import pyarrow as pa

    names, table = model
    size = len(names)
    spark = pages.sparkSession
    address = F.coalesce(F.col(url), F.lit(""))
    host = F.lower(F.regexp_extract(address, "://([^/?#]*)", 1))
    declared = F.lower(F.regexp_extract(F.coalesce(F.col(html), F.lit("")), "(?is)<html\\b[^>]*\\blang\\s*=\\s*[\"']?([a-zA-Z]{2,3})(?![a-zA-Z])", 1))
    rows = pages.select(F.col(key).alias("page_id"), host.alias("host"), declared.alias("declared"), F.col(html).alias("html"))
    if not size:
        none = F.lit(None).cast("string")
        return rows.select("page_id", none.alias("lang"), F.lit(None).cast("double").alias("prob"), none.alias("text_lang"), "declared", "host")
    shared = spark.sparkContext.broadcast(table)  # FEATURES x languages

    def score(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ll = _score([visible(x) for x in part.column(3).to_pylist()], shared.value)
                cut = pa.array(np.arange(0, ll.size + 1, size, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.ListArray.from_arrays(cut, pa.array(ll.ravel()))], names=["page_id", "host", "declared", "ll"])

    kind = pages.schema[key].dataType.simpleString()
    scored = rows.mapInArrow(lean(score), f"page_id {kind}, host string, declared string, ll array<double>")
    # the text's own posterior
    scored = scored.withColumn("s", F.transform("ll", lambda x: F.lit(p.temper) * (x - F.array_max("ll"))))
    scored = scored.withColumn("e", F.transform("s", F.exp))
    scored = scored.withColumn("q", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, b: a + b)))
    label = F.substring_index("host", ".", -1)
    scored = scored.select(
        "page_id", "host", F.regexp_extract("host", "([^.]+\\.[^.]+)$", 1).alias("domain"),
        F.when(label.rlike("^[a-z]{2}$"), label).otherwise("").alias("suffix"), "declared", "s", "q",
    )
    scored = written(scored, "language-scores")
    sums = lambda q: F.array(*[F.sum(x) for x in _vector(q, size)])
    hosts = written(scored.groupBy("host", "domain").agg(sums(F.col("q")).alias("hs")), "hosts")
    domains = hosts.groupBy("domain").agg(sums(F.col("hs")).alias("ds"))
    # one row each: at most 27**2 suffixes and 27**3 + 27**2 codes
    total = [float(x or 0) for x in domains.agg(sums(F.col("ds")).alias("g")).first()["g"]]
    hosts = written(hosts.join(domains, "domain").select("host", "hs", "ds"), "host-priors")
    prior = [(x + 1.0) / (sum(total) + size) for x in total]

    def likelihood(column: str) -> DataFrame:
        got = scored.where(F.col(column) != "").groupBy(column).agg(sums(F.col("q")).alias("c"))
        n = got.count() + 1
        cells = [F.log((F.col("c")[i] + p.table_smooth) / F.lit(total[i] + p.table_smooth * n)) for i in range(size)]
        return F.broadcast(got.select(column, F.array(*cells).alias(f"{column}_ll")))

    full = scored.join(hosts, "host", "left").join(likelihood("declared"), "declared", "left").join(likelihood("suffix"), "suffix", "left")

    def fused(i: int) -> Column:
        own = F.col("q")[i]
        ds, hs = F.greatest(F.col("ds")[i] - own, F.lit(0.0)), F.greatest(F.col("hs")[i] - own, F.lit(0.0))
        domain = (ds + p.domain_weight * prior[i]) / (F.col("dn") + p.domain_weight)
        by_host = (hs + p.host_weight * domain) / (F.col("hn") + p.host_weight)
        other = [F.coalesce(F.col(f"{c}_ll")[i], F.lit(0.0)) for c in ("declared", "suffix")]
        return F.col("s")[i] + F.log(by_host) + other[0] + other[1]

    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    full = full.withColumns({"dn": F.greatest(add("ds") - 1, F.lit(0.0)), "hn": F.greatest(add("hs") - 1, F.lit(0.0))})
    full = full.withColumn("f", F.array(*[fused(i) for i in range(size)]))
    tongue = F.array(*[F.lit(x) for x in names])
    best = lambda c: F.element_at(tongue, F.array_position(c, F.array_max(c)).cast("int"))
    prob = 1 / F.aggregate("f", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("f")))
    return full.select("page_id", best("f").alias("lang"), prob.alias("prob"), best("q").alias("text_lang"), "declared", "host")
