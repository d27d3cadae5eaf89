"""Encoding, Huffman files, length histogram and packing against plain loops."""

from __future__ import annotations

import heapq
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from firstmonth.llm import common, huffman, packing, token_counts
from firstmonth.llm.registry import op2_huffman, op8_packing
from firstmonth.llm.tokens import END_ID, Encoder, tokenizer_path
from tokenizers import Tokenizer

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [END_ID]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_encoder_equals_library(library):
    pool = [" ", "  ", "\n", " \n", "a", "Bc", "é", "!", "<|endoftext|>", "9", "\x1c", "\x85", "'s", "中", "😀", "<|", "\t", ".", "***", "'"]
    draw = random.Random(7)
    small = Encoder(tokenizer_path(), limit=50)  # forgets all the time
    for _ in range(400):
        texts = ["".join(draw.choices(pool, k=draw.randint(0, 14))) for _ in range(4)]
        encoded = [np.frombuffer(x, "<u4").tolist() for x in small.encode(texts)]
        assert encoded == [library.encode(x, add_special_tokens=False).ids for x in texts]


def huffman_bits(counts):
    heap, total = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    return total


def test_code_lengths():
    counts = np.array([0, 5, 9, 12, 13, 16, 45, 0])
    free = huffman.code_lengths(counts, 20)
    assert (free * counts).sum() == huffman_bits(counts[counts > 0])
    tight = huffman.code_lengths(counts, 3)
    assert tight.max() == 3 and sum(2.0 ** -int(x) for x in tight if x) == 1
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9, dtype=np.int64), 3)
    assert huffman.code_lengths(np.array([0, 7]), 20).tolist() == [0, 1]


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_block_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).geometric(0.05, n), 400).astype("<u4")
    lengths = huffman.code_lengths(np.bincount(ids, minlength=401) + 1)
    checkpoints, words = huffman.encode_ids(ids, lengths, huffman.canonical_codes(lengths))
    assert (huffman.decode_ids(n, checkpoints, words, huffman.decoding_table(lengths)) == ids).all()


@pytest.mark.parametrize("size_bits", [5, 16])  # entries of 32 and of 64 bits
def test_blocks_are_decoded_side_by_side(size_bits, monkeypatch):
    monkeypatch.setattr(huffman, "_SIZE_BITS", size_bits)
    draw = np.random.default_rng(size_bits)
    blocks = [np.minimum(draw.zipf(1.2, n), 70_000).astype("<u4") for n in (300, 0, 1, 128, 5000, 129)]
    lengths = huffman.code_lengths(np.bincount(np.concatenate(blocks), minlength=70_001))
    codes, table = huffman.canonical_codes(lengths), huffman.decoding_table(lengths)
    coded = [(len(ids), *huffman.encode_ids(ids, lengths, codes)) for ids in blocks]
    assert [x.tolist() for x in huffman.decode_blocks(coded, table)] == [x.tolist() for x in blocks]
    assert [x.tolist() for x in huffman.decode_blocks(coded[1:2], table)] == [[]]


def test_id_counts_come_with_the_blocks(odd, nothing, library, monkeypatch):
    monkeypatch.setattr(huffman, "BLOCK_IDS", 50)
    counts = huffman.id_counts(huffman.id_blocks(odd))
    expected = Counter(x for r in odd.collect() for x in ids_of(library, r.text))
    assert {r.id: r.n for r in counts.collect()} == expected
    assert "InArrow" not in counts._jdf.queryExecution().toString()  # the ids are not read again
    assert huffman.id_counts(huffman.id_blocks(nothing)).collect() == []


def expected_files(library, rows):
    start, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = ids_of(library, text)
        out.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def test_archive_of_documents(spark, documents, library):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    found = sorted(tuple(r) for r in op2_huffman(spark, SF_DIR).collect())
    assert found == expected_files(library, rows)


def test_archive_of_odd_rows(spark, odd, nothing, library):
    archive = huffman.write_archive(odd)
    found = huffman.read_archive(spark, archive, with_ids=True).orderBy("start").collect()
    expected = expected_files(library, [(r.doc_id, r.text) for r in odd.collect()])
    assert [tuple(r)[:4] for r in found] == expected
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in found)
    assert huffman.read_archive(spark, huffman.write_archive(nothing)).collect() == []


def test_small_blocks_make_many(spark, documents, library, monkeypatch):
    monkeypatch.setattr(huffman, "BLOCK_IDS", 300)
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    found = sorted(tuple(r) for r in op2_huffman(spark, SF_DIR).collect())
    assert found == expected_files(library, rows)


def test_length_histogram(odd, nothing, library):
    lengths = sorted(len(library.encode(r.text or "", add_special_tokens=False).ids) for r in odd.collect())
    histogram = token_counts.length_histogram(token_counts.token_lengths(odd)).collect()
    assert sorted(r.length for r in histogram) == sorted(set(lengths))
    for r in histogram:
        assert r.n_docs == lengths.count(r.length)
        assert r.docs_over == sum(x > r.length for x in lengths) and r.tokens_over == sum(x for x in lengths if x > r.length)
        assert r.docs_up_to + r.docs_over == len(lengths) and r.tokens_up_to + r.tokens_over == sum(lengths)
        assert r.truncated_total == sum(min(x, r.length) for x in lengths)
        assert r.quantile == pytest.approx(r.docs_up_to / len(lengths))
    assert token_counts.length_histogram(token_counts.token_lengths(nothing)).collect() == []


def test_histogram_over_blocks_of_lengths(spark):
    lengths = [0, 5, 5, 4095, 4096, 9000, 9000, 20_000]
    histogram = token_counts.length_histogram(spark.createDataFrame([(x,) for x in lengths], "length long"))
    assert all(r.truncated_total == sum(min(x, r.length) for x in lengths) for r in histogram.collect())
    totals = {r.limit: r.total for r in token_counts.truncated_totals(histogram, [1, 4096, 10**6]).collect()}
    assert totals == {x: sum(min(y, x) for y in lengths) for x in (1, 4096, 10**6)}
    assert token_counts.length_quantile(histogram, 0.5).first().length == 4095


def test_fullest_against_all_subsets():
    draw = random.Random(3)
    for _ in range(200):
        available = {draw.randint(1, 12): draw.randint(1, 3) for _ in range(draw.randint(0, 4))}
        room = draw.randint(0, 20)
        sums = {0}
        for length, n in available.items():
            sums = {s + length * k for s in sums for k in range(n + 1) if s + length * k <= room}
        chosen = packing.fullest(room, available)
        assert sum(chosen) == max(sums) and all(available[x] >= n for x, n in Counter(chosen).items())


def check_packed(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(spark, documents, library):
    rows = op8_packing(spark, SF_DIR).collect()
    n_bins = check_packed(rows, 1024)
    assert n_bins <= 1.02 * -(-sum(r.length for r in rows) // 1024)  # close to what any packing needs
    pieces = {(r.doc_id, r.piece): r for r in rows}
    assert len(pieces) == len(rows)
    for doc_id, text in documents.select("doc_id", "text").collect():
        ids = ids_of(library, text)
        first, at, piece = len(ids) % 1024 or 1024, 0, 0
        while at < len(ids):
            r = pieces.pop((doc_id, piece))
            n = first if piece == 0 else 1024
            assert (r.start, r.length, r.ids_crc32) == (at, n, crc(ids[at : at + n]))
            at, piece = at + n, piece + 1
    assert not pieces


def test_a_third_of_the_rows_is_one_empty_text_without_id(spark, capsys):
    """Spread over the tasks that read them, and numbered without moving a piece."""
    rows = [(None, None)] * 500 + [(i, f"text {i} " * (i % 60)) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    placed = packing.pack_documents(docs, capacity=64, with_ids=True)
    placed.explain("formatted")
    plan = capsys.readouterr().out
    assert "Window" not in plan and "BroadcastHashJoin" in plan and " Exchange" not in plan.replace("BroadcastExchange", "")
    found = placed.collect()
    check_packed(found, 64)
    assert sum(r.doc_id is None for r in found) == 500
    shuffled = packing.pack(common.save(packing.pieces(docs, 64), "test-pieces").hint("merge"), 64)
    check_packed(shuffled.collect(), 64)


def test_texts_of_any_kind_of_character_equal_the_library(library):
    rng = random.Random(1)
    signs = ["a", "Z", "é", "ɏ", "×", "0", " ", " ", "\n", "\t", "\r", "'", "'s", "'ll", "'RE", " '", "-", "!", "_", "\x1c", "\x85"]
    signs += ["\xa0", "½", "ª", "’", "—", "€", "中", "😀", "<|endoftext|>", "\x00", "\x7f", "don't", " the"]
    texts = ["".join(rng.choice(signs[: rng.randrange(8, 33)]) for _ in range(rng.randrange(25))) for _ in range(5000)]
    for limit in (0, 50, 10_000):  # words come and go
        encoder = Encoder(tokenizer_path(), limit)
        found = [ids for i in range(0, len(texts), 50) for ids in encoder.encode(texts[i : i + 50])]
        assert [list(np.frombuffer(x, "<u4")) for x in found] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(encoder.words) <= limit and len(encoder.once) <= limit


def test_remembered_words_are_looked_up_and_never_walked(library):
    class Remembered(dict):
        def __iter__(self):
            raise AssertionError("as many steps as words are remembered")

    encoder = Encoder(tokenizer_path())
    encoder.once = Remembered(encoder.once)
    if hasattr(encoder.words, "once"):
        encoder.words.once = encoder.once
    texts = ["abc xyzzy12", "abc plugh", "qwertz, it's xyzzy12", "abc qwertz"]
    found = [encoder.encode([x])[0] for x in texts]
    assert [list(np.frombuffer(x, "<u4")) for x in found] == [library.encode(x, add_special_tokens=False).ids for x in texts]
    assert "abc" in encoder.words and "plugh" not in encoder.words and " plugh" in encoder.once


def test_a_failed_batch_leaves_no_words_without_ids(library, monkeypatch):
    encoder = Encoder(tokenizer_path())
    with monkeypatch.context() as broken, pytest.raises(MemoryError):
        broken.setattr(encoder, "_encode_new", lambda *_: (_ for _ in ()).throw(MemoryError()))
        encoder.encode(["some words"])
    assert list(np.frombuffer(encoder.encode(["some words"])[0], "<u4")) == library.encode("some words", add_special_tokens=False).ids


def test_packing_odd_rows(odd, nothing):
    placed = packing.pack_documents(odd, capacity=16, with_ids=True)
    rows = placed.collect()
    check_packed(rows, 16)
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6, None}
    whole = packing.sequences(placed).collect()
    assert sum(r.n_tokens for r in whole) == sum(r.length for r in rows)
    assert all(len(bytes(r.ids)) == 4 * r.n_tokens for r in whole)
    assert packing.pack_documents(nothing).collect() == []
