"""Language of pages by Bayesian evidence fusion.

The posterior of a language is the product of four kinds of evidence: how likely the text is under a byte trigram model of
the language, how often pages of that language declare what this page's markup declares, how often they have its address
suffix, and the language's share on its host. Shares are smoothed hierarchically (host by domain, domain by all pages).
Every table behind them is a grouped aggregation of the text posteriors of all pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import slices, stored
from gazette.llm.html_text import host_of

#: Hash buckets of trigrams; pseudo-counts of a trigram, of evidence tables and of the levels of the host prior.
BUCKETS, TRIGRAM_SMOOTHING, EVIDENCE_SMOOTHING, HOST_SMOOTHING = 1 << 15, 0.5, 1.0, 8.0
#: Trigrams of one text overlap and repeat, so a text counts as this many independent ones at most.
INDEPENDENT = 40.0

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|title)\b.*?(?:</\1\s*>|\Z)|<[^>]*>", re.S | re.I)
_DECLARED = re.compile(r"<html\b[^>]*?\s(?:xml:)?lang\s*=\s*[\"']?\s*([A-Za-z]+)", re.I)


@dataclass(frozen=True)
class Model:
    """Languages in order, and the log-likelihood of each trigram bucket under each (a row for each language)."""

    languages: tuple[str, ...]
    table: np.ndarray


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram buckets of all texts in a row, and where each text's begin (last: their end). A text begins and ends with a space."""
    data = [f" {text} ".encode("utf-8", "replace") if text else b"" for text in texts]
    sizes = np.array([max(0, len(d) - 2) for d in data], np.int64)
    every = _FOLD[np.frombuffer(b"".join(data), np.uint8)].astype(np.uint32)
    if len(every) < 3:
        return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    code = (every[:-2] << np.uint32(16)) | (every[1:-1] << np.uint32(8)) | every[2:]
    keep = np.ones(len(code), bool)
    ends = np.cumsum([len(d) for d in data])[:-1]
    ends = ends[(ends > 0) & (ends < len(every))]
    keep[np.clip(np.concatenate([ends - 1, ends - 2]), 0, len(code) - 1)] = False if len(ends) else keep[0]
    code = code[keep] * np.uint32(2654435761)
    return code >> np.uint32(32 - 15), np.concatenate([[0], np.cumsum(sizes)])


def train(documents: DataFrame, sample: int = 20_000, seed: int = 5) -> Model:
    """A model from labelled texts (text, lang), fitted on a random sample of about ``sample`` rows.

    Counts are made by Spark; what comes to the driver is the model, a number for each language and bucket. Rows with a
    null label, null or empty text count nothing; without rows the model knows no language.
    """
    total = documents.count()
    rows = documents.where("lang is not null and text <> ''").select("lang", "text").sample(fraction=min(1.0, sample / max(1, total)), seed=seed)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                langs = np.array(batch.column(0).to_pylist(), object)
                texts = batch.column(1).to_pylist()
                for lang in set(langs):
                    buckets, _ = trigrams([t for t, own in zip(texts, langs) if own == lang])
                    sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    sums[lang] += np.bincount(buckets, minlength=BUCKETS)
        for lang, n in sums.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some, pa.int32()), pa.array(n[some], pa.int64())], names=["lang", "bucket", "n"])

    counts = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    languages = tuple(sorted({r.lang for r in counts}))
    table = np.full((len(languages), BUCKETS), TRIGRAM_SMOOTHING)
    for r in counts:
        table[languages.index(r.lang), r.bucket] += r.n
    return Model(languages, np.log(table / table.sum(1, keepdims=True)).astype(np.float32))


def visible(page: str) -> str:
    """Text of a page without its markup."""
    return html.unescape(_MARKUP.sub(" ", page))


def likelihoods(model: Model, texts: list[str]) -> np.ndarray:
    """Log-likelihood of each text under each language, for as many trigrams as count as independent; 0 for empty ones."""
    buckets, starts = trigrams(texts)
    out = np.zeros((len(texts), len(model.languages)))
    some = np.flatnonzero(np.diff(starts))
    if len(some):
        size = np.diff(starts)[some]
        for k, row in enumerate(model.table):
            out[some, k] = np.add.reduceat(row[buckets].astype(np.float64), starts[some]) / size * np.minimum(size, INDEPENDENT)
    return out


def read_pages(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, declared (language of the markup), scores (log-likelihoods) and shares (the text's posterior)."""
    held = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html", 1 << 20):
                raw = [page or "" for page in batch.column(2).to_pylist()]
                score = likelihoods(held.value, [visible(page) for page in raw])
                share = np.exp(score - score.max(1, keepdims=True))
                share /= share.sum(1, keepdims=True)
                found = [_DECLARED.search(page) for page in raw]
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), pa.float64()), score.shape[1]).cast(pa.list_(pa.float64())) for x in (score, share)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([m and m[1].lower() for m in found], pa.string()), *lists], names=["page_id", "url", "declared", "scores", "shares"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, declared string, scores array<double>, shares array<double>")


def each(count: int, value) -> Column:
    """Array of ``value(k)`` for each language."""
    return F.array(*(value(k) for k in range(count)))


def evidence(read: DataFrame, column: str, whole: list[float], pages: int) -> DataFrame:
    """Per value of a column the chance that a page of each language shows it (array ``p_<column>``), smoothed by one page a value."""
    count = len(whole)
    sums = read.groupBy(column).agg(each(count, lambda k: F.sum(F.col("shares")[k])).alias("n"), F.count("*").alias("pages"))
    return sums.select(column, each(count, lambda k: (F.col("n")[k] + EVIDENCE_SMOOTHING * F.col("pages") / pages) / (whole[k] + EVIDENCE_SMOOTHING)).alias(f"p_{column}"))


def identified(pages: DataFrame, model: Model) -> DataFrame:
    """Per row of ``pages``: page_id, lang (null if the model knows none), probability, declared.

    Null and empty pages have no text evidence and go by the rest; null addresses share the empty host; a page declaring
    nothing shows "no language", which is evidence like any other. A page's own share is taken out of its host's and
    domain's counts. Repeated rows have the same result; an empty table gives no rows; other columns aren't read.
    """
    count = len(model.languages)
    if not count:
        return pages.select(F.col("page_id").cast("long").alias("page_id"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("declared"))
    read = stored(read_pages(pages, model), "pages-read")
    host = host_of(F.col("url"))
    labels = F.split("host", r"\.")
    read = read.select("page_id", "declared", "scores", "shares", F.coalesce("declared", F.lit("")).alias("markup"), host.alias("host"))
    read = read.withColumns({"suffix": F.element_at(labels, -1), "domain": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")})
    sums = lambda name: read.groupBy(name).agg(each(count, lambda k: F.sum(F.col("shares")[k])).alias(f"n_{name}"))
    *whole, number = read.agg(*(F.coalesce(F.sum(F.col("shares")[k]), F.lit(0.0)) for k in range(count)), F.count("*")).first()
    hosts = read.select("host", "domain").distinct().join(sums("host"), "host").join(sums("domain"), "domain").drop("domain")
    joined = read.join(hosts, "host").join(evidence(read, "markup", whole, max(1, number)), "markup").join(evidence(read, "suffix", whole, max(1, number)), "suffix")

    def prior(k: int) -> Column:
        total = lambda name: sum(F.col(name)[i] for i in range(count)) - 1
        own = F.col("shares")[k]
        at_all = (whole[k] + 1) / (sum(whole) + count)
        at_domain = (F.greatest(F.col("n_domain")[k] - own, F.lit(0.0)) + HOST_SMOOTHING * at_all) / (F.greatest(total("n_domain"), F.lit(0.0)) + HOST_SMOOTHING)
        return (F.greatest(F.col("n_host")[k] - own, F.lit(0.0)) + HOST_SMOOTHING * at_domain) / (F.greatest(total("n_host"), F.lit(0.0)) + HOST_SMOOTHING)

    fused = joined.withColumn("fused", each(count, lambda k: F.col("scores")[k] + F.log(prior(k)) + F.log(F.col("p_markup")[k]) + F.log(F.col("p_suffix")[k])))
    best = F.array_max("fused")
    names = F.array(*map(F.lit, model.languages))
    place = F.array_position("fused", best).cast("int")
    odds = F.aggregate("fused", F.lit(0.0), lambda acc, x: acc + F.exp(x - best))
    return fused.select("page_id", F.element_at(names, place).alias("lang"), (1 / odds).alias("probability"), "declared")
