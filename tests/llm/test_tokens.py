"""Token ids, the ORC store, flat files and packing against the library itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from flowframe import runtime
from flowframe.llm import packing, token_counts, token_store
from flowframe.llm.tokens import encoder

VOCABULARIES = ("byte_bpe_50k.json", "word_bpe_49k.json")


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


@pytest.mark.parametrize("name", VOCABULARIES)
def test_units_give_the_librarys_ids(name, rows):
    r = random.Random(2)
    pieces = [*"abcDE éßñ×÷'\n\t\r\x1c\x85\xa0\u2003\u3000!*,.19中\u0301Σςᾳ’—<|>", " ", " ", "\n", "<|endoftext|>", "'s", "'ll", "Å", "the"]
    made = ["".join(r.choices(pieces, k=r.randint(0, 40))) for _ in range(6000)] + [t for _, t in rows]
    ends, ids = encoder(name).encode(pa.array(made, pa.string()), 7)
    expected = library(name).encode_batch([t or "" for t in made], add_special_tokens=False)
    for k, e in enumerate(expected):
        assert ids[ends[k] : ends[k + 1]].tolist() == [*e.ids, 7], repr(made[k])[:200]
    again, same = encoder(name).encode(pa.array(made, pa.string()).slice(3, 50))
    assert same.tolist() == [i for e in expected[3:53] for i in e.ids]


@pytest.mark.parametrize("name", VOCABULARIES)
def test_long_texts_in_pieces(name, rows, monkeypatch):
    from flowframe.llm import tokens

    monkeypatch.setattr(tokens, "BLOCK", 100)
    made = [t for _, t in rows if t] + ["a\n\nb \t\n c, d" * 60, "x" * 900 + "é, ü\n" * 80 + "<|endoftext|>" + " it's" * 90, "\u3000" * 150]
    ends, ids = encoder(name).encode(pa.array(made), 7)
    for k, e in enumerate(library(name).encode_batch(made, add_special_tokens=False)):
        assert ids[ends[k] : ends[k + 1]].tolist() == [*e.ids, 7], made[k][:60]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_store(spark, docs, no_docs, rows):
    path = runtime.new_path(spark, "t")
    token_store.write_tokens(docs, path)
    found = token_store.read_tokens(spark, path).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    ids = [e.ids + [1] for e in library("word_bpe_49k.json").encode_batch([t or "" for _, t in ordered], add_special_tokens=False)]
    found.sort(key=lambda r: r["start"])
    assert [(r["doc_id"], r["ids"]) for r in found] == [(i, x) for (i, _), x in zip(ordered, ids)]
    assert [r["start"] for r in found] == np.cumsum([0, *map(len, ids)])[:-1].tolist()
    one = token_store.read_tokens(spark, path, token_store.F.col("doc_id") == 5).collect()
    assert [r["doc_id"] for r in one] == [5]
    token_store.write_tokens(no_docs, path + "-none")
    assert token_store.read_tokens(spark, path + "-none").count() == 0


@pytest.mark.parametrize("block", [3, 64, 1 << 20])
def test_counts(spark, docs, rows, block):
    path = runtime.new_path(spark, "t")
    token_counts.write_flat(docs.repartition(4), path, docs_per_file=3)
    found = sorted(token_counts.count_tokens(spark, path, block).collect())
    sizes = [len(e.ids) for e in library("word_bpe_49k.json").encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    assert [r["doc_no"] for r in found] == list(range(len(rows)))
    assert sorted(r["n_tokens"] for r in found) == sorted(sizes)
    assert [r["start"] for r in found] == np.cumsum([0, *(r["n_tokens"] for r in found)])[:-1].tolist()
    assert all(r["ended"] for r in found)


def test_counts_of_nothing_and_of_one_long_document(spark, no_docs):
    path = runtime.new_path(spark, "t")
    token_counts.write_flat(no_docs, path)
    assert token_counts.count_tokens(spark, path).count() == 0
    long = " ".join(f"w{k} some words" for k in range(40_000))
    token_counts.write_flat(spark.createDataFrame([("a b",), (long,), (None,)], "text string").coalesce(1), path + "-long")
    (size,) = (len(e.ids) for e in library("word_bpe_49k.json").encode_batch([long], add_special_tokens=False))
    found = sorted(map(tuple, token_counts.count_tokens(spark, path + "-long", 1 << 14).collect()))
    assert size > 5 << 14 and [r[2] for r in found][1:] == [size, 0] and [r[0] for r in found] == [0, 1, 2]


def test_counts_through_spark_alone(spark, tmp_path, monkeypatch):
    ids = np.array([5, 1, 1, 7, 8, 9, 1, 4], "<u2").tobytes()
    (tmp_path / "a").write_bytes(ids[:5])  # the odd byte goes
    (tmp_path / "b").write_bytes(ids)
    plain = sorted(map(tuple, token_counts.count_tokens(spark, str(tmp_path), 2).collect()))
    assert plain == [(0, 0, 1, True), (1, 1, 1, True), (2, 2, 0, True), (3, 2, 3, True), (4, 5, 1, False)]

    def no_store(path):
        raise OSError(path)

    monkeypatch.setattr(token_counts, "open_file", no_store)
    assert sorted(map(tuple, token_counts.count_tokens(spark, str(tmp_path), 2).collect())) == plain


def test_ids_are_integers(spark):
    with pytest.raises(ValueError, match="integer"):
        token_store.write_tokens(spark.createDataFrame([("a", "b")], "doc_id string, text string"), "nowhere")


def test_counts_over_file_borders(spark, tmp_path):
    r = random.Random(4)
    ids = [1 if r.random() < 0.1 else r.randint(2, 9) for _ in range(500)] + [5, 5]
    cuts = [0, 3, 4, 90, 91, 300, 502]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        (tmp_path / f"part-{k}.bin").write_bytes(np.array(ids[a:b], "<u2").tobytes())
    (tmp_path / "part-9.bin").write_bytes(b"")
    expected, n, start = [], 0, 0
    for x in ids:
        if x == 1:
            expected.append((len(expected), start, n, True))
            start, n = start + n, 0
        else:
            n += 1
    expected.append((len(expected), start, n, False))
    for block in (1, 7, 64):
        assert sorted(map(tuple, token_counts.count_tokens(spark, str(tmp_path), block).collect())) == expected


def test_packing(spark, docs, no_docs, rows):
    found = packing.pack(docs, 256).collect()
    ids = [e.ids + [0] for e in library("byte_bpe_50k.json").encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    expected = []
    for (doc_id, _), x in zip(rows, ids):
        at = 0
        for piece in range(-(-len(x) // 256)):
            n = len(x) % 256 or 256 if piece == 0 else 256
            expected.append((doc_id, piece, at, n, crc(x[at : at + n])))
            at += n
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted((tuple(r)[:5] for r in found), key=key) == sorted(expected, key=key)
    check_sequences([(r["sequence_id"], r["offset"], r["length"]) for r in found], 256)
    assert packing.pack(no_docs).count() == 0


def check_sequences(placed, most):
    by = {}
    for sequence, offset, n in placed:
        by.setdefault(sequence, []).append((offset, n))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= most
    return len(by)


def place(counts, most):
    return [(first + k, offset, size) for size, _, n, first, offset in packing.plan(counts, most) for k in range(n)]


def fewest(items, most):
    """The least number of sequences, by trying."""
    best = len(items)

    def go(rest, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if not rest:
            best = len(rooms)
            return
        tried = set()
        for k, room in enumerate(rooms):
            if room >= rest[0] and room not in tried:
                tried.add(room)
                go(rest[1:], [*rooms[:k], room - rest[0], *rooms[k + 1 :]])
        go(rest[1:], [*rooms, most - rest[0]])

    go(sorted(items, reverse=True), [])
    return best


def test_dominance_keeps_the_optimum():
    r = random.Random(6)
    for _ in range(300):
        items = [r.randint(1, 20) for _ in range(r.randint(1, 9))]
        counts = {s: items.count(s) for s in set(items)}
        fixed, left = packing.reduce_by_dominance(counts, 20)
        rest = [s for s, n in left.items() for _ in range(n)]
        assert sorted([s for sizes, n in fixed for s in sizes * n] + rest) == sorted(items)
        assert all(sum(sizes) <= 20 for sizes, _ in fixed)
        assert sum(n for _, n in fixed) + fewest(rest, 20) == fewest(items, 20), items
        placed = place(counts, 20)
        assert sorted(n for _, _, n in placed) == sorted(items)
        check_sequences(placed, 20)


def test_plan_of_a_large_histogram():
    r = np.random.default_rng(1)
    sizes = np.minimum(r.geometric(0.002, 200_000), 2048)
    counts = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True))))
    places = packing.plan(counts, 2048)
    assert len(places) < 40_000
    assert check_sequences(place(counts, 2048), 2048) <= sizes.sum() / 2048 * 1.002 + 1




def test_store_is_read_by_metadata(spark, docs):
    path = runtime.new_path(spark, "t")
    token_store.write_tokens(docs, path, stripe_bytes=1 << 16)
    asked = token_store.read_tokens(spark, path, token_store.F.col("doc_id") == 5)
    assert "EqualTo(doc_id,5)" in asked._jdf.queryExecution().executedPlan().toString()
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    files = [f.getPath() for f in place.getFileSystem(conf).listStatus(place) if f.getPath().getName().endswith(".orc")]
    blooms = 0
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(f, jvm.org.apache.orc.OrcFile.readerOptions(conf))
        rows = reader.rows()
        for k in range(reader.getStripes().size()):
            footer = rows.readStripeFooter(reader.getStripes().get(k))
            kinds = [str(footer.getStreams(i).getKind()) for i in range(footer.getStreamsCount())]
            assert "ROW_INDEX" in kinds
            blooms += any("BLOOM" in x for x in kinds)
        rows.close()
    assert blooms
