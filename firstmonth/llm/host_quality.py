"""Quality rules of documents and of the hosts they come from.

Each document is held against rules on its own. Failures are counted by host and rule; the rate of each host is drawn
towards the mean of all hosts by a beta prior that is fitted to the hosts themselves (method of moments), so that a
few documents condemn no host. A host whose shrunk rate for any rule is over ``HOST_LIMIT`` takes its remaining
documents with it.

Only DataFrame functions are used. What is known of a document is written once, without its text; hosts are
summed map-side first, so a host of any size is one row a task.

Null text has no words and fails. Null hosts form one host of their own. Repeated rows count as often as they occur.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firstmonth.llm.common import join_keys, let, measured_broadcast, row_key, save

WINDOW = 8
MIN_WORDS = 20
NO_SPACE = r"[^ \t\n\x0B\f\r]"
SYMBOLS = "[#*$%&|<>]+"

#: A host fails if the shrunk failure rate of a rule is larger.
HOST_LIMIT = 0.75

#: Bounds for the weight of the prior, in documents: with equal rates at all hosts the moments have no limit.
PRIOR_WEIGHT = (1.0, 10_000.0)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+"), "")


def host_row_key() -> Column:
    """Rows of equal id and text at two hosts are judged apart."""
    return F.xxhash64(row_key(), F.col("source"), F.col("source").isNull())


def text_measures(docs: DataFrame) -> DataFrame:
    """Per document: id, host, row key, and the measures of its whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    measured = docs.select(
        F.col("doc_id"),
        host_row_key().alias("row_key"),
        F.col("source").alias("host"),
        let(
            words(text),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.char_length(F.array_join(w, "")).cast("long").alias("chars"),
                _repeated(w).alias("n_repeat"),
            ),
        ).alias("w"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(
            F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(NO_SPACE))),
            lambda lines: F.struct(
                F.size(lines).cast("long").alias("n"),
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup"),
            ),
        ).alias("lines"),
    )
    return measured.select(
        "doc_id",
        "row_key",
        "host",
        F.col("w.n_words").alias("n_words"),
        F.col("w.chars").alias("word_chars"),
        "n_symbols",
        F.col("lines.n_dup").alias("n_dup_lines"),
        F.col("w.n_repeat").alias("n_repeat_words"),
        F.col("lines.n").alias("n_lines"),
    )


def _repeated(w: Column) -> Column:
    """Words in windows that occur twice or more. Windows are compared by a hash first; only texts in which two agree
    compare the words themselves."""
    n_windows = F.size(w) - F.lit(WINDOW - 1)

    def windows(make) -> Column:
        return F.transform(F.sequence(F.lit(1), n_windows), make)

    def hashed() -> Column:
        return let(
            F.transform(w, lambda word: F.xxhash64(word)),
            lambda h: windows(lambda at: F.xxhash64(F.slice(h, at, WINDOW))),
        )

    distinct = let(hashed(), lambda h: F.size(F.array_distinct(h)) == F.size(h))
    spelled = windows(lambda at: F.struct(F.array_join(F.slice(w, at, WINDOW), " ").alias("text"), at.alias("at")))
    return F.when((n_windows < 2) | distinct, F.lit(0).cast("long")).otherwise(
        let(F.array_sort(spelled), lambda s: _covered(_positions(s)))
    )


def _positions(ordered: Column) -> Column:
    """Where windows stand that equal a neighbour in sorted order, ascending."""

    def text(at: Column) -> Column:
        return F.get(ordered, at)["text"]

    last = F.size(ordered) - 1
    indexes = F.filter(
        F.sequence(F.lit(0), last),
        lambda i: F.coalesce(text(i) == text(i - 1), F.lit(False)) | F.coalesce(text(i) == text(i + 1), F.lit(False)),
    )
    return F.array_sort(F.transform(indexes, lambda i: F.get(ordered, i)["at"]))


def _covered(positions: Column) -> Column:
    """Words under windows that begin at ascending ``positions``; each word counts once."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(
        positions,
        start,
        lambda seen, at: F.struct(
            (seen["n"] + F.least(F.lit(WINDOW).cast("long"), at + F.lit(WINDOW) - seen["end"])).alias("n"),
            (at + F.lit(WINDOW)).cast("long").alias("end"),
        ),
        lambda seen: seen["n"],
    )


def rule_failures(measures: DataFrame) -> dict[str, Column]:
    """The rules a document can fail, by name."""
    n = F.col("n_words")
    return {
        "short": n < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > 30 * n,
        "symbols": 100 * F.col("n_symbols") > 20 * F.col("word_chars"),
        "lines": 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n),
    }


def host_verdicts(measures: DataFrame) -> DataFrame:
    """One row a host: ``host``, ``n_docs``, the shrunk rate of each rule, ``host_failed``."""
    rules = rule_failures(measures)
    hosts = measures.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"), *[F.count_if(failed).alias(name) for name, failed in rules.items()]
    )
    hosts = save(hosts, "hosts")
    prior = hosts.agg(*[_moments(name) for name in rules]).first()  # two numbers for each rule
    rates = [
        ((F.col(name) + (prior[name]["mean"] or 0.0) * prior[name]["weight"]) / (F.col("n_docs") + prior[name]["weight"]))
        for name in rules
    ]
    rated = hosts.select("host", "n_docs", *[rate.alias(f"{name}_rate") for name, rate in zip(rules, rates)])
    return rated.withColumn("host_failed", F.greatest(*[F.col(f"{name}_rate") for name in rules]) > HOST_LIMIT)


def _moments(name: str) -> Column:
    """Mean and weight (alpha + beta) of the beta distribution with the mean and variance of the hosts' rates."""
    rate = F.col(name) / F.col("n_docs")
    mean, variance = F.avg(rate), F.var_pop(rate)
    weight = F.when(variance > 0, mean * (1 - mean) / variance - 1).otherwise(F.lit(PRIOR_WEIGHT[1]))
    bounded = F.greatest(F.lit(PRIOR_WEIGHT[0]), F.least(F.lit(PRIOR_WEIGHT[1]), weight))
    return F.struct(mean.alias("mean"), bounded.alias("weight")).alias(name)


def judge(docs: DataFrame) -> DataFrame:
    """Measures and verdicts of ``docs`` (``doc_id``, ``text``, ``source``): ``base_failed``, ``host_failed``, ``kept``."""
    measures = save(text_measures(docs), "measures")
    rules = rule_failures(measures)
    verdicts = save(host_verdicts(measures).select(F.col("host").alias("judged"), "host_failed"), "host-verdicts")
    judged = measures.join(measured_broadcast(verdicts), F.col("host").eqNullSafe(F.col("judged")))
    base = rules["short"] | rules["repeats"]
    return judged.drop("judged").withColumn("base_failed", base).withColumn("kept", ~(base | F.col("host_failed")))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, as they are."""
    rejected = save(judge(docs).where(~F.col("kept")).select("doc_id", "row_key").distinct(), "rejected")
    return join_keys(docs, rejected, "left_anti", host_row_key)
