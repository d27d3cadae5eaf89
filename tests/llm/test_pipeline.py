"""The pipeline, stage by stage."""

from __future__ import annotations

import re
from collections import defaultdict

import corpus_pipeline
import numpy as np
from firstmonth.llm import decontaminate, host_quality, lsh_forest, packing, secret_scan
from firstmonth.llm.common import save
from firstmonth.llm.tokens import tokenizer_path
from test_operators import SPACE, base_of, contamination_of, groups_of, measures_of, tie
from test_tokens import check_packed, ids_of
from tokenizers import Tokenizer

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark, documents):
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    docs, names = documents, [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]
    texts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, save(stage(spark, docs, SF_DIR), f"test-{name}")
        assert docs.columns == documents.columns
        texts[name] = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality":
            assert set(texts[name]) == {r.doc_id for r in host_quality.judge(before).where("kept").collect()}
        if name == "near_duplicates":
            assert set(texts[name]) == {r.class_id for r in lsh_forest.near_duplicates(before).collect()}
        if name == "decontamination":
            clean = decontaminate.contamination(before, benchmark).where("not contaminated").collect()
            assert set(texts[name]) == {r.doc_id for r in clean}
        if name == "secrets":
            assert texts[name] == {i: secret_scan.masked(t) for i, t in texts["decontamination"].items()}
    packed = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r.doc_id for r in packed} == set(texts["secrets"])


def test_pipeline_of_odd_rows(spark, odd, nothing):
    for docs in (odd, nothing):
        for name, stage in corpus_pipeline.STAGES:
            docs = save(stage(spark, docs, SF_DIR), f"odd-{name}")
        assert docs.count() == len({r.doc_id for r in docs.collect()})


def test_packing_returns_the_tokens(spark, odd):
    placed = corpus_pipeline.STAGES[-1][1](spark, odd, SF_DIR)
    assert all(len(r.ids) == 4 * r.length for r in placed.collect())
    assert all(len(r.ids) == 4 * r.n_tokens for r in packing.sequences(placed).collect())


def plain_quality(rows):
    """Kept ids of (id, text, host): rules, and rates of hosts drawn towards a beta prior by moments."""
    failed, hosts = {}, defaultdict(list)
    for doc_id, text, host in rows:
        n, chars, symbols, dup_lines, repeated, failed[doc_id] = measures_of(text)
        lines = [x for x in text.split("\n") if re.search(f"[^{SPACE}]", x)]
        rules = (n < 20, 100 * repeated > 30 * n, 100 * symbols > 20 * chars, 100 * dup_lines > 30 * len(lines), not 2 * n <= chars <= 20 * n)
        hosts[host].append(rules)
    bad = set()
    for rule in range(5):
        rates = {host: sum(r[rule] for r in docs) / len(docs) for host, docs in hosts.items()}
        mean = sum(rates.values()) / len(rates)
        variance = sum((x - mean) ** 2 for x in rates.values()) / len(rates)
        weight = min(10_000, max(1, mean * (1 - mean) / variance - 1)) if variance > 0 else 10_000
        bad |= {h for h, docs in hosts.items() if (rates[h] * len(docs) + mean * weight) / (len(docs) + weight) > 0.75}
    return {doc_id for doc_id, _, host in rows if not failed[doc_id] and host not in bad}


def base_masked(text):
    kept, at = [], 0
    for start, end in sorted(tuple(map(int, x.split(":")[1:])) for x in filter(None, base_of(text).split(","))):
        if start >= at:
            kept += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*kept, text[at:]])


def test_stages_against_plain_loops(spark, documents, tmp_path):
    fine = " ".join(f"word{i}" for i in range(40))
    added = [(text, "good") for text in tie("near", 24, 3, 3)] + [(text, "good") for text in tie("apart", 24, 3, 4)]
    added += [("buy now " * 20 if i % 10 else f"{fine} {i}", "bad") for i in range(40)]
    config = "\n".join(f"option_{i}: {i}" for i in range(40))
    added += [(f"user=bob\n{config}\nkey: aB3dE5fG7hI9jK1lM2nO3pQ4\nat: HTTPS://DB.Example.com\n", "good")]
    start = documents.agg({"doc_id": "max"}).first()[0] + 1
    columns = documents.select("doc_id", "text", "source").schema
    more = spark.createDataFrame([(start + i, text, host) for i, (text, host) in enumerate(added)], columns)
    documents.unionByName(more, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    found = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = save(stage(spark, docs, str(tmp_path)), f"plain-{name}")
        found.append({r.doc_id: r.text for r in docs.collect()})
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text", "source").collect()
    texts = {r.doc_id: r.text for r in rows}

    expected = plain_quality([tuple(r) for r in rows])
    assert set(found[0]) == expected and not expected & set(range(start + 4, start + 44))
    expected = {group for _, group, *_ in groups_of([(i, texts[i]) for i in sorted(expected)])}
    assert set(found[1]) == expected and {start, start + 1, start + 2, start + 3} - expected == {start + 1}
    items = [tuple(r) for r in benchmark.select("item_id", "text").collect()]
    expected = {i for i in expected if not contamination_of(texts[i], items)[4]}
    assert set(found[2]) == expected
    masks = {i: base_masked(texts[i]) for i in expected}
    masks[start + 44] = f"[SECRET]\n{config}\nkey: [SECRET]\nat: [SECRET]\n"
    assert found[3] == masks

    library = Tokenizer.from_file(tokenizer_path())
    placed = corpus_pipeline.run(spark, str(tmp_path))
    packed = placed.collect()
    check_packed(packed, 1024)
    ids = defaultdict(bytes)
    for r in sorted(packed, key=lambda r: (r.doc_id, r.piece)):
        assert len(r.ids) == 4 * r.length and r.start * 4 == len(ids[r.doc_id])
        ids[r.doc_id] += bytes(r.ids)
    assert ids == {i: np.array(ids_of(library, text), dtype="<u4").tobytes() for i, text in masks.items()}
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(placed).collect()}
    for r in packed:
        assert whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)
