"""Line bitmaps, vector codes and the filter audit against plain loops, and defined results for odd rows."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from firstmonth.llm import filter_audit, line_dedup, lsh_forest, vector_codes
from pyspark.sql import functions as F

DOCS = "doc_id long, text string"

# lines


def key_of(line):
    return line.strip(line_dedup.BLANKS).translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER))


def dropped_of(rows, min_documents, keep_first=False):
    """Positions to drop by (id, text); equal rows are one document."""
    documents = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    at = defaultdict(list)
    for d, (_, text) in enumerate(documents):
        for position, line in enumerate((text or "").split("\n")):
            if key_of(line):
                at[key_of(line)].append((d, position))
    dropped = defaultdict(set)
    for places in at.values():
        if len({d for d, _ in places}) >= min_documents:
            for d, position in places[1:] if keep_first else places:
                dropped[documents[d]].add(position)
    return dropped


def kept_of(rows, min_documents, keep_first=False):
    dropped = dropped_of(rows, min_documents, keep_first)
    out = []
    for row in rows:
        lines = (row[1] or "").split("\n")
        kept = "\n".join(x for i, x in enumerate(lines) if i not in dropped[row])
        out.append((row[0], len(lines), len(dropped[row]), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def lines_of(spark, rows, min_documents, keep_first=False, partitions=4):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        docs = spark.createDataFrame(rows, DOCS).repartition(3)
        bitmaps = line_dedup.keep_bitmaps(docs, min_documents, keep_first=keep_first)
        return Counter(map(tuple, line_dedup.digests(docs, bitmaps).collect()))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("partitions", [1, 4, 40])
def test_lines_over_any_number_of_ranges(spark, keep_first, partitions):
    """One line is in all documents, so that its run covers many ranges; others begin and end anywhere."""
    rng = random.Random(partitions)
    pool = [f" Line {i}\t" for i in range(30)] + ["", "  ", "Rare\x85", "é"]
    rows = []
    for i in range(150):
        lines = ["THE common line"] + [rng.choice(pool) if rng.random() < 0.6 else f"own {i} {j}" for j in range(rng.randrange(6))]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    assert lines_of(spark, rows, 10, keep_first, partitions) == kept_of(rows, 10, keep_first)


def test_the_threshold_counts_documents(spark):
    nine = [(i, "nine times\nnine times") for i in range(9)]
    ten = [(i, " TEN times \nown") for i in range(20, 30)]
    rows = nine + ten + [(99, "ten times\nTen times\nnine")]
    assert lines_of(spark, rows, 10) == kept_of(rows, 10)
    assert lines_of(spark, nine, 10) == kept_of(nine, 10)


def test_lines_of_odd_rows(spark, odd, nothing):
    rows = [(None, "a\nb")] * 12 + [(1, "a\nc")] * 3 + [(1, "a\nd"), (2, None), (3, ""), (4, "\n\n"), (None, None), (5, "x" * 50_000)]
    for keep_first in (False, True):
        assert lines_of(spark, rows, 3, keep_first) == kept_of(rows, 3, keep_first)
    docs = odd.withColumn("keep", F.lit("mine")).withColumn("left_id", F.lit(7))
    bitmaps = line_dedup.keep_bitmaps(docs, 2)
    out = line_dedup.drop_lines(docs, bitmaps)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert {r.text for r in out.where("doc_id is null or doc_id = 4").collect()} == {"no id here", None, "short one"}
    assert "".join({r.text for r in out.where("doc_id in (1, 2)").collect()}) == ""  # in two documents: ids 1 and 2
    assert line_dedup.keep_bitmaps(nothing).collect() == []
    assert line_dedup.digests(nothing, line_dedup.keep_bitmaps(nothing)).collect() == []


def test_bitmaps_keep_a_bit_for_each_line(spark):
    docs = spark.createDataFrame([(i, f"own {i}\nshared\nlast {i}") for i in range(3)], DOCS)
    rows = line_dedup.keep_bitmaps(docs, 3).collect()
    assert [(r.n_lines, r.n_dropped) for r in rows] == [(3, 1)] * 3
    assert {line_dedup.kept_text("x\ny\nz", r.keep) for r in rows} == {"x\nz"}
    assert {r.keep for r in line_dedup.keep_bitmaps(docs, 4).collect()} == {None}


# codes


def codes_of(rows, parts=8, entries=16, rounds=6):
    """(id, code, error, label error) by a plain loop, and the codebooks."""
    good = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    good = [r for r in good if len(r[1]) == len(good[0][1])]
    whole = [[math.floor(4096 * x) for x in v] + [0] * (-len(v) % parts) for _, v, _ in good]
    size = len(whole[0]) // parts
    cut = [[tuple(v[p * size : (p + 1) * size]) for p in range(parts)] for v in whole]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]

    def nearest(part, p):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), i) for i, entry in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for v in cut:
                groups[nearest(v[p], p)[1]].append(v[p])
            for i, members in groups.items():
                books[p][i] = [sum(x) // len(members) for x in zip(*members)]
    found, by_label = [], Counter()
    for (vec_id, _, label), v in zip(good, cut):
        best = [nearest(v[p], p) for p in range(parts)]
        found.append((vec_id, "".join(f"{i:02x}" for _, i in best), sum(d for d, _ in best), label))
        by_label[label] += found[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, code, error, by_label[label], digest) for i, code, error, label in found)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def as_float(rows):
    """Components as 32-bit floats hold them."""
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]


def test_codes_of_clustered_and_tied_vectors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 0.3, (12, 16))
    rows = [(i, (centres[i % 12] + rng.normal(0, 0.02, 16)).tolist(), i % 3) for i in range(700)]
    rows += [(1000 + i, [0.25 * (i % 3), -0.25] * 8, None) for i in range(300)]  # few values: ties and whole nodes
    rows = as_float(rows)
    found = vector_codes.compress(vectors(spark, rows).repartition(5))
    assert Counter(map(tuple, found.collect())) == codes_of(rows)


def test_whole_nodes_are_assigned_by_their_sums():
    rng = np.random.default_rng(1)
    points = np.concatenate([c + rng.integers(-5, 5, (400, 4)) for c in (0, 1000, 5000)])
    tree = vector_codes.build_tree(points)
    entries = np.array([[5000] * 4, [0] * 4, [1000] * 4, [0] * 4])
    compared = []
    original = vector_codes._compare
    vector_codes._compare = lambda *a: compared.append(sum(len(x[0]) for x in a[4])) or original(*a)
    try:
        codes, sums, counts = vector_codes.assign(points, tree, vector_codes.EntryTree(entries))
    finally:
        vector_codes._compare = original
    table = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (codes == table.argmin(axis=1)).all() and counts.tolist() == [400, 400, 400, 0]
    assert all((sums[e] == points[codes == e].sum(axis=0)).all() for e in range(4))
    assert compared[0] < 2 * len(tree[1]) / 2  # only leaves between two equal entries are looked into


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 33, 500])
def test_assignments_equal_all_distances(n):
    rng = np.random.default_rng(n)
    for spread in (2, 300):
        points, entries = rng.integers(-spread, spread, (n, 3)), rng.integers(-spread, spread, (min(n, 16), 3))
        codes, sums, counts = vector_codes.assign(points, vector_codes.build_tree(points), vector_codes.EntryTree(entries))
        table = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (codes == table.argmin(axis=1)).all() and counts.sum() == n and (sums.sum(axis=0) == points.sum(axis=0)).all()


def test_codes_of_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i % 40, rng.normal(0, 1, 11).tolist(), i % 2) for i in range(60)]
    rows += [rows[3]] * 5 + [(None, rows[7][1], None), (None, rows[7][1], 1)]
    rows += [(0, None, 1), (0, [], 1), (0, [math.nan] * 11, 1), (1, [math.inf] * 11, 1), (2, [None] * 11, 1), (90, [0.5] * 4, 1)]
    rows = as_float(rows)
    clash = vectors(spark, rows).withColumn("code", F.lit("x")).withColumn("cells", F.lit("y")).withColumn("error", F.lit(1))
    assert Counter(map(tuple, vector_codes.compress(clash).collect())) == codes_of(rows)
    few = rows[:5]
    assert Counter(map(tuple, vector_codes.compress(vectors(spark, few)).collect())) == codes_of(few)
    huge = as_float([(i, [10.0**i, -(10.0**i)] * 4, 0) for i in range(38)])
    assert vector_codes.compress(vectors(spark, huge)).count() == 38
    assert vector_codes.compress(vectors(spark, [])).collect() == []
    assert vector_codes.compress(vectors(spark, [(1, None, 1)])).collect() == []


# audit


def audit_of(rows, labels):
    """All rows of the audit by a plain loop over (id, text, lang)."""
    first = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    good = {i for i, quality, _ in labels if quality == 1}
    toxic = {i for i, _, bad in labels if bad == 1}
    parts = defaultdict(list)
    for doc_id, text, lang in rows:
        t = text or ""
        words = [w for w in t.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
        failed = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": doc_id is not None and doc_id > first[t],
        }
        failed = {x for x, y in failed.items() if y}
        parts[lang or ""].append((failed, doc_id is not None and doc_id in good, doc_id is not None and doc_id in toxic))
    out, shapley = [], Counter()
    for part, docs in parts.items():
        for order in map("".join, permutations("ABCDE")):
            for step, letter in enumerate(order):
                now = [d for d in docs if not d[0] & set(order[:step])]
                gone = [d for d in now if letter in d[0]]
                fails = sum(letter in d[0] for d in docs)
                alone = sum(d[0] == {letter} for d in docs)
                shapley[part, letter] += len(gone)
                out.append((part, order, step + 1, len(now) - len(gone), len(gone), fails - len(gone), alone, sum(d[1] for d in gone), sum(d[2] for d in gone)))
    return Counter((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


AUDIT = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def audited(spark, folder, labels, batches):
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return Counter(map(tuple, filter_audit.audit(spark, str(folder), table, batches).select(*AUDIT).collect()))


def documents_in_files(spark, folder, files):
    for rows in files:
        table = spark.createDataFrame(rows, "doc_id long, text string, lang string, part string, flags string")
        table.coalesce(1).write.mode("append").parquet(str(folder))


def test_smaller_ids_in_later_files_retract_masks(spark, tmp_path):
    long_text = " ".join(f"w{i}" for i in range(120))
    texts = [long_text, "SHORT # text", "", None, "A a a a", long_text + " |", "é" * 30]
    rng = random.Random(3)
    rows = [(rng.randrange(60) if i % 9 else None, rng.choice(texts), rng.choice(["en", "de", "", None]), "p", "f") for i in range(200)]
    rows += [rows[1]] * 4
    rows.sort(key=lambda r: -(r[0] or 0))  # every file brings smaller ids than the one before
    files = [rows[i : i + 34] for i in range(0, len(rows), 34)]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 80, 3)] + [(3, 0, 1), (6, None, None), (None, 1, 1)]
    documents_in_files(spark, tmp_path / "docs", files)
    expected = audit_of([r[:3] for r in rows], labels)
    assert sum(expected.values()) == 3 * 600
    for batches in (1, 3, 100):
        assert audited(spark, tmp_path / "docs", labels, batches) == expected


def test_audit_without_rows_or_labels(spark, tmp_path):
    documents_in_files(spark, tmp_path / "none", [[]])
    assert not audited(spark, tmp_path / "none", [], 8)
    documents_in_files(spark, tmp_path / "one", [[(None, None, None, None, None)]])
    assert audited(spark, tmp_path / "one", [], 8) == audit_of([(None, None, None)], [])


def test_state_of_one_text():
    state = filter_audit.TextState()
    state.add(5, "en", 1, 2)
    state.add(9, "de", 1, 1)
    assert +state.changes == {("en", 1): 2, ("de", 17): 1}
    state.add(2, "fr", 1, 1)
    assert (state.least, +state.held, +state.changes) == (2, {("fr", 1): 1}, {("en", 17): 2, ("de", 17): 1, ("fr", 1): 1})


# near duplicates


def test_a_near_copied_text_repeated_in_most_rows(spark):
    """Copies of one text, with and without id, are one class, linked once with each of its near copies."""
    base = [f"word{i}" for i in range(120)]
    near = [" ".join(base[:60] + [f"x{j}"] + base[61:]) for j in range(3)]
    rows = [(None, " ".join(base))] * 2000 + [(7, " ".join(base))] * 500 + [(10 + j, t) for j, t in enumerate(near)] + [(99, "all by itself here now")]
    found = lsh_forest.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(6)).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    assert {by_id[i].class_id for i in (None, 7, 10, 11, 12)} == {7} and by_id[99].class_id == 99
    classes = lsh_forest.text_classes(lsh_forest.signatures(spark.createDataFrame(rows, DOCS)))
    n_links = {r.n_links for r in lsh_forest.links(spark.createDataFrame(rows, DOCS), classes).collect()}
    assert n_links == {3}


def test_nodes_with_the_same_members_are_compared_once(spark, monkeypatch):
    base = [f"word{i}" for i in range(400)]
    rows = [(i, " ".join(base[:200] + [f"x{i}"] + base[201:])) for i in range(2)] + [(5, "nothing like the others at all")]
    classes = lsh_forest.text_classes(lsh_forest.signatures(spark.createDataFrame(rows, DOCS)))
    ties = lsh_forest.candidate_ties(classes)
    assert ties.count() == 1
    plan = ties._jdf.queryExecution().optimizedPlan().toString()
    assert "members0" in plan
