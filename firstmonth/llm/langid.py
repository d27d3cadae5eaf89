"""Language identification by Bayesian evidence fusion.

The posterior of each row adds up, for every language,

    text        log likelihood of its byte trigrams (naive Bayes), tempered because trigrams overlap
    declared    log P(language declared in the markup | language)
    suffix      log P(last label of the address | language)
    host        log prior of its host, smoothed towards its domain, and that towards all rows

The last three tables are not given but learned from the rows themselves, by grouped aggregation of what the text alone
says (one vote a row, or none without text). A row's own vote is left out of its host's prior.

The text model alone is fitted to labelled rows: about ``SAMPLE_ROWS`` of each language, picked by a hash of id and
text, and at least one, so that every label with a text of three bytes or more stays a possible answer. Rows of equal
id and text count once in it. All rows are scored and voted. Scores are written once, without texts. Tables of hosts and the like are broadcast only
up to a counted size; counting is summed map-side, so a host of any size is one row a task.

Null or empty text gives no text evidence and no vote; null hosts, suffixes and declarations give no evidence of
their kind; a row without any gets the commonest language. Ties go to the first language by name. Repeated rows are
judged alike. Without labelled rows the language is null. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firstmonth.llm.common import measured_broadcast, save, sliced

SAMPLE_ROWS = 5_000
BUCKETS = 1 << 15
#: Share of the trigrams that count, as neighbours overlap, and how many count at most.
TEMPER, MOST = 1 / 3, 200.0
#: Weight of the level above, in votes.
PRIOR_VOTES = 5.0
_CHUNK = 1 << 16
#: Range of the hash that picks the sample; whole numbers up to it are exact as doubles.
_KEYS = 1 << 53

INPUT = "doc_id long, page_id long, text string, markup boolean, host string, declared string"
_SCORED = "doc_id long, page_id long, host string, declared string, score array<double>, vote int"
_HIDDEN = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->", re.DOTALL | re.IGNORECASE)
_TAG = re.compile(r"<[^>]*>")


@dataclass
class TextModel:
    languages: list[str]
    weights: np.ndarray  #: log P(bucket | language), a row for each bucket


def document_rows(docs: DataFrame) -> DataFrame:
    """Documents as input: the source stands for the host; ``lang`` is the label and not used as evidence."""
    null = F.lit(None).cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.lit(None).cast("long").alias("page_id"),
        "text",
        F.lit(False).alias("markup"),
        F.col("source").alias("host"),
        null.alias("declared"),
    )


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages as input: host of the address, and the primary language tag of the html element."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://([^/?#:]*)", 1))
    tag = r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)"
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), tag, 1))
    return pages.select(
        F.lit(None).cast("long").alias("doc_id"),
        F.col("page_id").cast("long").alias("page_id"),
        F.col("html").alias("text"),
        F.lit(True).alias("markup"),
        F.nullif(host, F.lit("")).alias("host"),
        F.nullif(declared, F.lit("")).alias("declared"),
    )


def plain_text(markup: str) -> str:
    return html.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", markup)))


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the byte trigrams of the whole text, a stretch at a time."""
    data = np.frombuffer(text.lower().encode(errors="replace"), dtype=np.uint8).astype(np.uint32)
    for start in range(0, len(data) - 2, _CHUNK):
        part = data[start : start + _CHUNK + 2]
        mixed = part[:-2] * np.uint32(0x9E3779B1) + part[1:-1] * np.uint32(0x85EBCA77) + part[2:] * np.uint32(0xC2B2AE3D)
        yield mixed >> np.uint32(32 - BUCKETS.bit_length() + 1)


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> TextModel:
    """Fit trigram counts to about ``sample_rows`` of each language of ``labelled`` (``doc_id``, ``text``, ``lang``)."""
    key = F.pmod(F.xxhash64("doc_id", "text"), F.lit(_KEYS))
    rows = labelled.where(F.col("lang").isNotNull() & (F.octet_length("text") > 2)).select("lang", "text", key.alias("key"))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least"))
    last = F.greatest(F.col("least").cast("double"), F.lit(float(_KEYS) * sample_rows) / F.col("n"))
    limits = save(sizes.select(F.col("lang").alias("of_lang"), last.alias("last")), "sample-limits")
    rows = rows.join(measured_broadcast(limits), F.col("lang") == F.col("of_lang")).where("key <= last")
    rows = rows.groupBy("lang", "key").agg(F.first("text").alias("text"))  # equal rows, however many, are one

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in sliced(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen = counts.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                for part in trigrams(text):
                    seen += np.bincount(part, minlength=BUCKETS)
        for lang, seen in counts.items():
            used = np.flatnonzero(seen)
            columns = [pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(seen[used])]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "n"])

    counted = rows.select("lang", "text").mapInArrow(count, "lang string, bucket long, n long")
    counted = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # languages x BUCKETS at most
    languages = sorted(counted["lang"].unique())
    n = np.full((BUCKETS, len(languages)), 0.5)
    for i, lang in enumerate(languages):
        own = counted[counted["lang"] == lang]
        n[own["bucket"].to_numpy(dtype=np.int64), i] += own["n"].to_numpy(dtype=np.float64)
    return TextModel(languages, np.log(n / n.sum(axis=0)).astype(np.float32))


def score(rows: DataFrame, model: TextModel) -> DataFrame:
    """Saved text scores and votes of ``rows`` (columns of ``INPUT``)."""
    shared = rows.sparkSession.sparkContext.broadcast(model.weights)

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in sliced(batches):
            scores, votes = [], []
            for text, markup in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                total, n = np.zeros(weights.shape[1]), 0
                for part in trigrams(plain_text(text) if markup and text else text or ""):
                    total += weights[part].sum(axis=0, dtype=np.float64)
                    n += len(part)
                total *= min(TEMPER, MOST / n) if n else 0.0
                scores.append(total.tolist())
                votes.append(int(total.argmax()) if n and len(total) else None)
            columns = [batch.column(i) for i in (0, 1, 4, 5)]
            columns += [pa.array(scores, pa.list_(pa.float64())), pa.array(votes, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "page_id", "host", "declared", "score", "vote"])

    return save(rows.mapInArrow(evaluate, _SCORED), "language-scores")


def _votes(n: int) -> list[Column]:
    return [F.count_if(F.col("vote") == i).alias(f"n{i}") for i in range(n)]


def _array(n: int) -> Column:
    return F.array(*[F.col(f"n{i}").cast("double") for i in range(n)])


def likelihoods(scored: DataFrame, name: str, totals: list[int]) -> DataFrame:
    """Saved rows: a value of column ``name`` and log P(value | language) with add-one smoothing."""
    n = len(totals)
    counts = save(scored.where(F.col(name).isNotNull()).groupBy(name).agg(*_votes(n)), f"votes-{name}")
    kinds = counts.count()
    logs = [F.log((F.col(f"n{i}") + 1.0) / F.lit(float(totals[i] + kinds))) for i in range(n)]
    return counts.select(F.col(name).alias(f"{name}_value"), F.array(*logs).alias(f"{name}_log"))


def host_priors(scored: DataFrame, totals: list[int]) -> DataFrame:
    """Saved rows: ``host_value``, its ``votes`` and the smoothed shares of its ``domain``."""
    n = len(totals)
    hosts = scored.where(F.col("host").isNotNull()).groupBy("host").agg(*_votes(n))
    hosts = save(hosts.withColumn("domain", domain(F.col("host"))), "votes-host")
    domains = hosts.groupBy("domain").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(n)])
    everywhere = [(t + 1) / (sum(totals) + n) for t in totals]
    all_votes = sum((F.col(f"n{i}") for i in range(n)), F.lit(0))
    shares = [(F.col(f"n{i}") + PRIOR_VOTES * p) / (all_votes + PRIOR_VOTES) for i, p in enumerate(everywhere)]
    domains = domains.select("domain", F.array(*shares).alias("domain_share"))
    joined = hosts.join(domains, "domain")
    return save(joined.select(F.col("host").alias("host_value"), _array(n).alias("votes"), "domain_share"), "host-priors")


def domain(host: Column) -> Column:
    """The last two labels."""
    return F.substring_index(host, ".", -2)


def suffix(host: Column) -> Column:
    """The last label of an address; null if there is only one."""
    return F.when(F.instr(host, ".") > 0, F.substring_index(host, ".", -1))


def identify(rows: DataFrame, model: TextModel) -> DataFrame:
    """``doc_id``, ``page_id``, ``host``, ``declared``, ``text_lang``, ``lang``, ``confidence`` of each of ``rows``."""
    scored = score(rows, model).withColumn("suffix", suffix(F.col("host")))
    n = len(model.languages)
    kept = ["doc_id", "page_id", "host", "declared"]
    if not n:
        null = F.lit(None)
        return scored.select(
            *kept, null.cast("string").alias("text_lang"), null.cast("string").alias("lang"), null.cast("double").alias("confidence")
        )
    counted = scored.agg(*_votes(n)).first()
    totals = [counted[i] for i in range(n)]
    everywhere = F.array(*[F.lit(math.log((t + 1) / (sum(totals) + n))) for t in totals])
    fused = scored
    for name in ("declared", "suffix"):
        fused = fused.join(
            measured_broadcast(save(likelihoods(scored, name, totals), f"likelihoods-{name}")),
            F.col(name) == F.col(f"{name}_value"),
            "left",
        )
    fused = fused.join(measured_broadcast(host_priors(scored, totals)), F.col("host") == F.col("host_value"), "left")
    own = F.array(*[F.coalesce((F.col("vote") == i).cast("double"), F.lit(0.0)) for i in range(n)])
    others = F.zip_with("votes", own, lambda a, b: a - b)
    n_others = F.aggregate(others, F.lit(0.0), lambda a, b: a + b)
    host_log = F.zip_with(
        others, "domain_share", lambda votes, share: F.log((votes + PRIOR_VOTES * share) / (n_others + PRIOR_VOTES))
    )
    posterior = F.zip_with("score", F.coalesce(host_log, everywhere), lambda a, b: a + b)
    for name in ("declared", "suffix"):
        posterior = F.zip_with(
            posterior, F.coalesce(F.col(f"{name}_log"), F.array(*[F.lit(0.0)] * n)), lambda a, b: a + b
        )
    names = F.array(*[F.lit(x) for x in model.languages])
    best = F.array_max("posterior")
    return fused.withColumn("posterior", posterior).select(
        *kept,
        F.get(names, F.col("vote")).alias("text_lang"),
        F.element_at(names, F.array_position("posterior", best).cast("int")).alias("lang"),
        (1 / F.aggregate("posterior", F.lit(0.0), lambda a, x: a + F.exp(x - best))).alias("confidence"),
    )
