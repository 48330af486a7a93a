"""URL filter: rules for hosts and paths, and boosted trees on lexical features for the rest."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.llm import textbuf
from cartulary.llm.trees import Boosted
from cartulary.llm.workspace import Workspace

# The rules of the query.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Labelled URLs, by hash, on which the trees are fitted.
SAMPLE = 20_000
#: Host suffixes whose statistics are broadcast at most; beyond, they are joined by a shuffle.
BROADCAST_SUFFIXES = 200_000
THRESHOLD = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("length", "host length", "path length", "depth", "host labels", "digit ratio", "hyphens", "host entropy", "path entropy", "parameters", "query length", "fragment", "port", "escapes", "longest digits", "longest label", "extension", "suffix share", "suffix count")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule whose host is the host or a domain above it and whose path begins the path."""
    out = None
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}")
        out = F.when(fits, rule) if out is None else out.when(fits, rule)
    return out if out is not None else F.lit(None).cast("string")


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _entropy(s: str) -> float:
    if not s:
        return 0.0
    _, n = np.unique(np.frombuffer(s.encode("utf-8", "replace"), np.uint8), return_counts=True)
    p = n / n.sum()
    return float(-(p * np.log2(p)).sum())


def features(urls: list[str | None], hosts: list[str], paths: list[str], shares: list[float | None], counts: list[float | None]) -> np.ndarray:
    """A row of FEATURES for each URL; shares and counts: the statistics of its suffix, None where no labelled URL has it."""
    out = np.zeros((len(urls), len(FEATURES)))
    for i, (url, host, path, share, count) in enumerate(zip(urls, hosts, paths, shares, counts)):
        url = url or ""
        query = url.partition("?")[2].partition("#")[0]
        digits = re.findall(r"[0-9]+", url)
        out[i] = (
            len(url), len(host), len(path), path.count("/"), host.count(".") + 1 if host else 0, sum(map(len, digits)) / max(1, len(url)), host.count("-"), _entropy(host), _entropy(path),
            query.count("&") + 1 if query else 0, len(query), "#" in url, ":" in host, url.count("%"), max(map(len, digits), default=0), max(map(len, host.split("."))), "." in path.rpartition("/")[2], 0.5 if share is None else share, np.log1p(count or 0.0),
        )
    return out


def judge(pages: DataFrame, *, rules: tuple = RULES, labelled: DataFrame | None = None, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """A row per page: page_id, host, path, rule, verdict, score (null where a rule decides).

    labelled holds url and allow (boolean); without it, the URLs that the rules
    decide are the labelled ones.  Suffix statistics count all of them; the trees
    are fitted on a sample of bounded expected size.  With labels of one class all
    other URLs get its verdict; with none, they are allowed.  A null URL or one
    without "://" has empty host and path and is judged by the trees.  Repeated
    rows are returned as often as they occur; an empty table gives no rows.
    """
    allow = [r for r, v in rules if v == "allow"]
    seen = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    seen = seen.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    if labelled is None:
        taught = seen.where("rule is not null").select("url", "host", "path", F.col("rule").isin(allow).alias("allow"))
    else:
        taught = labelled.where("url is not null and allow is not null").select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "allow")
    counts = taught.groupBy(suffix_of(F.col("host")).alias("suffix")).agg(F.count("*").alias("n"), F.sum(F.col("allow").cast("long")).alias("good"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counts = Workspace(pages.sparkSession, "url-filter").table("suffixes", counts)
    known = counts.select("suffix", ((F.col("good") + 1) / (F.col("n") + 2)).alias("share"), (F.col("n") / max(1, total)).alias("count"))
    known = F.broadcast(known) if counts.count() <= BROADCAST_SUFFIXES else known
    rate = min(1.0, sample / max(1, total))
    chosen = taught.where(F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < int(np.ceil(rate * (1 << 20)))).orderBy(F.xxhash64("url"), "url").limit(2 * sample)
    rows = chosen.withColumn("suffix", suffix_of(F.col("host"))).join(known, "suffix", "left").select("url", "host", "path", "share", "count", "allow").collect()
    rows = sorted(map(tuple, rows), key=lambda r: (r[0], r[5]))
    model = Boosted(features(*([r[k] for r in rows] for k in range(5))), np.array([r[5] for r in rows], float))
    if not rows:
        model.base = 1.0

    @textbuf.frugal
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            url, host, path, share, count, rule = (batch.column(c).to_pylist() for c in ("url", "host", "path", "share", "count", "rule"))
            open_ = np.array([r is None for r in rule], bool)
            at = np.flatnonzero(open_).tolist()
            p = np.full(len(rule), np.nan)
            p[open_] = model.of(features(*([x[i] for i in at] for x in (url, host, path, share, count))))
            verdict = ["allow" if (r in allow if r is not None else p[i] >= threshold) else "block" for i, r in enumerate(rule)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(verdict, pa.string()), pa.array(p, pa.float64(), mask=~open_)], ["page_id", "host", "path", "rule", "verdict", "score"])

    # One suffix may have a large share of all URLs: the join is on few statistics, and its large side can be split.
    seen = seen.withColumn("suffix", suffix_of(F.col("host"))).join(known, "suffix", "left")
    return seen.mapInArrow(score, "page_id long, host string, path string, rule string, verdict string, score double")
