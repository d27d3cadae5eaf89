"""The fused evidence of language identification against plain loops, and the text model on labels it has not seen."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from firstmonth.llm import langid
from firstmonth.llm.registry import op1_language_id

SF_DIR = "/root/testdata/sf0.001"


def buckets_of(text):
    data = text.lower().encode(errors="replace")
    counts = Counter(data[i : i + 3] for i in range(len(data) - 2))
    found = Counter()
    for (a, b, c), n in counts.items():
        found[(a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % 2**32 >> 17] += n
    return found


def model_of(labelled):
    """Log weights by language and bucket of (id, text, label), equal rows once."""
    counts = defaultdict(Counter)
    for _, text, lang in set(labelled):
        if lang is not None and text is not None and len(text.encode()) > 2:
            counts[lang] += buckets_of(text)
    weights = {}
    for lang, seen in counts.items():
        total = sum(seen.values()) + 0.5 * 32768
        weights[lang] = defaultdict(
            lambda rest=float(np.float32(math.log(0.5 / total))): rest,
            {b: float(np.float32(math.log((n + 0.5) / total))) for b, n in seen.items()},
        )
    return dict(sorted(weights.items()))


def fused_of(rows, weights):
    """(language, confidence) of (text, host, declared), one at a time."""
    languages = list(weights)
    scores, votes = [], []
    for text, _, _ in rows:
        seen = buckets_of(text or "")
        n = sum(seen.values())
        scale = min(1 / 3, 200 / n) if n else 0.0
        scores.append([scale * math.fsum(weights[lang][b] * k for b, k in seen.items()) for lang in languages])
        votes.append(scores[-1].index(max(scores[-1])) if n else None)
    n = len(languages)

    def tally(values):
        table = defaultdict(lambda: [0] * n)
        for value, vote in zip(values, votes):
            if value is not None:
                table[value][vote or 0] += vote is not None
        return table

    hosts = [host for _, host, _ in rows]
    domains = [None if h is None else ".".join(h.split(".")[-2:]) for h in hosts]
    suffixes = [None if h is None or "." not in h else h.split(".")[-1] for h in hosts]
    declared = [d for _, _, d in rows]
    by_host, by_domain, by_suffix, by_declared = map(tally, (hosts, domains, suffixes, declared))
    totals = [votes.count(i) for i in range(n)]
    everywhere = [(t + 1) / (sum(totals) + n) for t in totals]
    found = []
    for i, score in enumerate(scores):
        posterior = list(score)
        for j in range(n):
            if hosts[i] is None:
                posterior[j] += math.log(everywhere[j])
            else:
                of_domain, of_host = by_domain[domains[i]], list(by_host[hosts[i]])
                share = (of_domain[j] + 5 * everywhere[j]) / (sum(of_domain) + 5)
                if votes[i] is not None:
                    of_host[votes[i]] -= 1
                posterior[j] += math.log((of_host[j] + 5 * share) / (sum(of_host) + 5))
            for value, table in ((declared[i], by_declared), (suffixes[i], by_suffix)):
                if value is not None:
                    posterior[j] += math.log((table[value][j] + 1) / (totals[j] + len(table)))
        best = max(posterior)
        found.append((languages[posterior.index(best)], 1 / sum(math.exp(x - best) for x in posterior)))
    return found


def same(found, expected):
    """Equal languages and confidences, rows with the same evidence in any order."""
    assert sorted(lang for lang, _ in found) == sorted(lang for lang, _ in expected)
    for (lang, sure), (other, certain) in zip(sorted(found), sorted(expected)):
        assert lang == other and sure == pytest.approx(certain, abs=1e-6)


def test_all_documents_and_pages_against_plain_loops(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    weights = model_of([(r.doc_id, r.text, r.lang) for r in docs.collect()])
    rows = langid.page_rows(pages).unionByName(langid.document_rows(docs)).collect()
    plain = [(langid.plain_text(r.text) if r.markup and r.text else r.text, r.host, r.declared) for r in rows]
    expected = dict(zip([(r.doc_id, r.page_id) for r in rows], fused_of(plain, weights)))
    found = op1_language_id(spark, SF_DIR).collect()
    assert len(found) == len(rows) == len(expected)
    for r in found:
        lang, sure = expected[r.doc_id, r.page_id]
        assert r.lang == lang and r.confidence == pytest.approx(sure, abs=1e-6), r


def test_odd_rows_ties_and_clashing_columns_against_plain_loops(spark, documents, odd):
    """Odd texts, repeated rows, hosts without a dot, and two languages that no evidence tells apart."""
    labelled = [(i, t, x) for i, (t, x) in enumerate([("same words here", "bb"), ("same words here", "aa"), ("other ones", "cc")])]
    rows = spark.createDataFrame(labelled, "doc_id long, text string, lang string")
    for train_on in (rows, documents):
        weights = model_of([(r.doc_id, r.text, r.lang) for r in train_on.select("doc_id", "text", "lang").collect()])
        model = langid.train(train_on)
        assert model.languages == list(weights)
        clashing = odd.withColumns({c: F.lit("x") for c in ("host", "vote", "votes", "score", "n0", "posterior", "suffix")})
        given = langid.document_rows(clashing)
        plain = [(r.text, r.host, r.declared) for r in given.collect()]
        found = [(r.lang, r.confidence) for r in langid.identify(given, model).collect()]
        same(found, fused_of(plain, weights))
    ties = spark.createDataFrame([(1, "same words", "h"), (2, "same words", None), (3, None, "h")], "doc_id long, text string, source string")
    found = langid.identify(langid.document_rows(ties), langid.train(rows)).collect()
    assert [r.lang for r in found] == ["aa"] * 3


def test_pages_with_hosts_suffixes_and_declarations_against_plain_loops(spark):
    words = {"en": "the cat and the dog of the house", "fr": "les chats que nous avons dans la maison", "de": "der hund und die katze in dem haus"}
    labelled = [(i, f"{text} {i}", lang) for i, (lang, text) in enumerate(list(words.items()) * 5)]
    weights = model_of(labelled)
    model = langid.train(spark.createDataFrame(labelled, "doc_id long, text string, lang string"))
    pages = []
    for i in range(120):
        lang = ["en", "fr", "de"][i * i % 3]
        text = [words[lang], words["en"] if i % 7 == 0 else "", "ab", "zz qq xx", None][i % 5]
        host = ["a.x.fr", "b.x.fr", "c.de", "localhost", "D.Example.COM:80"][i % 4 if i % 11 else 4]
        tag = [f'<html lang="{lang}-XX">', "<html>", ""][i % 3]
        pages.append((i, f"http://{host}/p{i}" if i % 13 else None, None if text is None else f"{tag}<p>{text}</p>"))
    given = langid.page_rows(spark.createDataFrame(pages, "page_id long, url string, html string"))
    rows = given.collect()
    plain = [(langid.plain_text(r.text) if r.text else r.text, r.host, r.declared) for r in rows]
    expected = dict(zip([r.page_id for r in rows], fused_of(plain, weights)))
    for r in langid.identify(given.repartition(5), model).collect():
        lang, sure = expected[r.page_id]
        assert r.lang == lang and r.confidence == pytest.approx(sure, abs=1e-6), r


def test_text_alone_on_labels_it_has_not_seen(spark, documents):
    """Documents of ids that 3 divides are held out, with every text that is also elsewhere."""
    seen, held_out = documents.where("doc_id % 3 > 0"), documents.where("doc_id % 3 = 0 and lang is not null and length(text) > 20")
    held_out = held_out.join(seen.select("text").distinct(), "text", "left_anti")
    truth = {r.doc_id: r.lang for r in held_out.collect()}
    found = langid.identify(langid.document_rows(held_out), langid.train(seen)).collect()
    right = sum(r.text_lang == truth[r.doc_id] for r in found)
    assert len(truth) > 20 and right >= 0.95 * len(truth), (right, len(truth))
