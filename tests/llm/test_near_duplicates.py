"""SimHash, components and substring dedup against brute force."""

import random

import numpy as np
import xxhash

from flowframe.llm import simhash, substring_dedup
from flowframe.llm.components import connected_components
from tests.llm.conftest import PASSAGE, prose

M = 2**64 - 1


def plain_fingerprint(text, shingle=4):
    raw = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
    words = raw.split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(nodes, linked):
    """Each node's least connected node, by search."""
    out = {}
    for n in sorted(nodes):
        if n in out:
            continue
        todo = [n]
        out[n] = n
        while todo:
            x = todo.pop()
            for y in nodes:
                if y not in out and linked(x, y):
                    out[y] = n
                    todo.append(y)
    return out


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(500)] + [(7, 7), (1, 2), (2, 1)]
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    found = {x["node"]: x["root"] for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == groups_of(nodes, lambda x, y: y in near[x])
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_of_all_fingerprints(spark, monkeypatch):
    r = random.Random(9)
    fps = {r.getrandbits(64) for _ in range(250)}
    centre = r.getrandbits(64)
    for _ in range(350):  # a dense group, and chains that leave it by four bits at a time
        x = centre
        for _ in range(r.randint(1, 3)):
            x ^= sum(1 << b for b in r.sample(range(64), r.randint(1, 4)))
        fps.add(x)
    fps |= {0, 15, M}
    for cell, groups, bits in ((4096, 6, 4), (4096, 9, 4), (40, 7, 4), (4096, 10, 8), (60, 11, 8)):  # 40, 60: cells are split into pairs of blocks
        expected = groups_of(fps, lambda x, y: (x ^ y).bit_count() <= bits)
        monkeypatch.setattr(simhash, "CELL", cell)
        df = spark.createDataFrame([(s, s, 0, s) for s in (x - 2**64 if x >> 63 else x for x in fps)], "name long, part long, k int, group long")
        links = [(a & M, b & M) for a, b in simhash.fingerprint_links(df, groups, bits).collect()]
        near = {}
        for a, b in links:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        assert groups_of(fps, lambda x, y: y in near.get(x, ())) == expected


def test_lower_bound():
    x = np.random.default_rng(3).integers(0, 2**64, 2000, np.uint64)
    a, b = simhash.segment_counts(x[:1000]), simhash.segment_counts(x[1000:])
    distance = np.bitwise_count(x[:1000] ^ x[1000:])
    bound = simhash.manhattan(a, b)
    plain = [sum(abs((p >> s & 3).bit_count() - (q >> s & 3).bit_count()) for s in range(0, 64, 2)) for p, q in zip(x[:1000].tolist(), x[1000:].tolist())]
    assert (bound <= distance).all() and bound.tolist() == plain


def grouped(rows, fps, bits):
    """Each fingerprint's group, and each group's least doc_id."""
    group = groups_of(set(fps.values()), lambda x, y: (x ^ y).bit_count() <= bits)
    least = {}
    for i, t in rows:
        if i is not None:
            least[group[fps[t]]] = min(i, least.get(group[fps[t]], i))
    return group, least


def test_links_by_part_and_name(spark, monkeypatch):
    """Several parts a name, a dense group that must not be joined through names that are far."""
    r = random.Random(19)
    flip = lambda x, n: x ^ sum(1 << b for b in r.sample(range(64), n))
    signed = lambda x: x - 2**64 if x >> 63 else x
    centre, part, rows = r.getrandbits(64), r.getrandbits(64), set()
    for _ in range(300):
        name = flip(centre, r.randint(0, 16))
        rows |= {(name, 0, flip(part, r.randint(0, 6))), (name, 1, flip(part, 20))}
    for _ in range(100):
        rows.add((r.getrandbits(64), r.randint(0, 1), flip(part, r.randint(0, 5))))
    names = {n for n, _, _ in rows}
    linked = {(a, b) for a, k, x in rows for b, m, y in rows if k == m and (x ^ y).bit_count() <= 8 and 0 < (a ^ b).bit_count() <= 18}
    expected = groups_of(names, lambda a, b: (a, b) in linked)
    assert 50 < len(set(expected.values())) < 250
    merged = lambda n: min(x for x in names if expected[x] == expected[n] and (x ^ n) % 3 == 0)
    for cell, groups, group in ((4096, 10, int), (50, 10, int), (4096, 11, int), (4096, 10, merged), (50, 10, merged)):
        monkeypatch.setattr(simhash, "CELL", cell)
        df = spark.createDataFrame([(signed(n), k, signed(x), signed(group(n))) for n, k, x in rows], "name long, k int, part long, group long")
        found = {(a & M, b & M) for a, b in simhash.fingerprint_links(df, groups, 8, 18).collect()}
        found |= {(n, group(n)) for n in names}
        assert groups_of(names, lambda a, b: (a, b) in found or (b, a) in found) == expected


def test_forest():
    pairs = np.array([[5, 9], [9, 5], [2, 9], [7, 8], [8, 11], [7, 11]], np.uint64)
    assert sorted(map(tuple, simhash.forest(pairs).tolist())) == [(5, 2), (8, 7), (9, 2), (11, 7)]
    assert len(simhash.forest(np.empty((0, 2), np.uint64))) == 0


def test_documents(spark, docs, no_docs, rows):
    prints, components = simhash.near_duplicate_components(docs)
    found = [(r["doc_id"], r["fp"] & M, r["component_id"]) for r in prints.join(components, "fp").collect()]
    fps = {t: plain_fingerprint(t) for _, t in rows}
    assert sorted(x[1] for x in found) == sorted(fps[t] for _, t in rows)
    group, least = grouped(rows, fps, 4)
    for doc_id, fp, component in found:
        assert component == least.get(group[fp])
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["text"] and r["doc_id"] is not None) == sorted(plain_keepers(rows))
    assert kept.where("doc_id is null").count() == 1 and kept.where("text is null or trim(text) = ''").count() == 1
    assert simhash.drop_near_duplicates(no_docs).count() == 0


def plain_prints(text):
    """The seven fingerprints of a text, bit by bit."""
    words = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    out = []
    for k in range(7):
        hashes = []
        for i in range(max(1, len(words) - 4) if words else 0):
            h = xxhash.xxh64_intdigest(b" ".join(words[i : i + 5]), 42)
            if k:
                h = ((h ^ (k * 0x9E3779B97F4A7C15 & M)) * 0xBF58476D1CE4E5B9) & M
                h = ((h ^ h >> 31) * 0x94D049BB133111EB) & M
                h ^= h >> 29
            hashes.append(h)
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    return out


def plain_keepers(rows):
    """The rows with a text and an id that stay: the least doc_id of each group."""
    prints = {t: plain_prints(t) for _, t in rows}
    near = lambda a, b: prints[a][0] == prints[b][0] or (prints[a][0] ^ prints[b][0]).bit_count() <= 18 and any((x ^ y).bit_count() <= 8 for x, y in zip(prints[a][1:], prints[b][1:]))
    todo, out = {t for _, t in rows}, []
    while todo:
        group, ends = set(), [todo.pop()]
        while ends:
            x = ends.pop()
            group.add(x)
            reached = {y for y in todo if near(x, y)}
            todo -= reached
            ends += reached
        members = [(i, t) for i, t in rows if t in group and i is not None]
        if members and any((t or "").split() for t in group):
            out.append(min(members, key=lambda m: (m[0], m[1] or "")))
    return out


def test_near_copies_are_caught(spark):
    """Texts with words exchanged here and there, of a similarity of 0.8 or more: nine tenths or more go; others stay."""
    r, data, alike = random.Random(23), [], []
    shingles = lambda ws: {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}
    for k in range(300):
        words = prose(r.randint(150, 600), f"near {k}").split()
        copy = list(words)
        for i in r.sample(range(len(words)), max(1, len(words) * r.randint(2, 22) // 1000)):
            copy[i] = "other"
        a, b = shingles(words), shingles(copy)
        data += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
        if len(a & b) >= 0.8 * len(a | b):
            alike.append(2 * k + 1)
    kept = {x["doc_id"] for x in simhash.drop_near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    caught = sum(i not in kept for i in alike) / len(alike)
    assert len(alike) > 200 and caught >= 0.95
    assert all(2 * k in kept for k in range(300))


def test_repeated_and_missing_ids(spark):
    a, b = prose(80, "a"), prose(80, "b")
    data = [(3, a, 1), (7, a, 2), (7, b, 3), (7, b, 4), (None, b, 5), (None, prose(60, "c"), 6), (None, prose(60, "c"), 6), (8, prose(90, "d"), 7)]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(data, "doc_id long, text string, n int")).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([(3, a), (7, b), (None, prose(60, "c")), (8, prose(90, "d"))], key=str)


def plain_chunks(raw):
    """Where chunks begin, by a rolling gear hash byte by byte and a search around each word start."""
    gear, space = substring_dedup.GEAR.tolist(), b" \t\n\x0b\x0c\r"
    words = [i for i in range(len(raw)) if raw[i] not in space and (i == 0 or raw[i - 1] in space)]
    at = {i: 2 for i in words}
    for i in words:
        end = next((j for j in range(i, len(raw)) if raw[j] in space), len(raw))
        if end - i >= 64:
            at |= {j: 1 for j in range(i, end) if raw[j] >= 0xE0}
    order, h = sorted(at), []
    for p in order:
        v = 0
        for byte in raw[max(0, p - 16) : p]:
            v = ((v << 1) + gear[byte]) & 0xFFFFFFFF
        h.append(v)
    found = [0]
    for k, p in enumerate(order):
        if p and all(h[k] < x for x in h[max(0, k - 3) : k]) and all(h[k] <= x for x in h[k + 1 : k + 4]):
            found.append(p)
    return found if raw else [], [sum(at[p] for p in order if a <= p < b) for a, b in zip(found, [*found[1:], len(raw)])] if raw else []


CHINESE = "".join(chr(0x4E00 + random.Random(3).randrange(5000)) for _ in range(1)) + "".join(chr(0x4E00 + random.Random(f"c{k}").randrange(5000)) for k in range(300))


def test_chunks(rows):
    text = prose(400, 21).encode()

    def pieces(raw):
        s = substring_dedup.chunks(raw)[0].tolist()
        return {raw[a:b] for a, b in zip(s, [*s[1:], len(raw)])}

    shifted = b"some new words " + text[:700] + b"inserted " + text[700:]
    assert len(pieces(text) & pieces(shifted)) > 0.9 * len(pieces(text))
    for raw in [*(t.encode() for _, t in rows if t is not None and len(t) < 20000), text, CHINESE.encode(), b"  a\n", (CHINESE + " abc " + CHINESE[:25]).encode()]:
        starts, halves = substring_dedup.chunks(raw)
        assert (starts.tolist(), halves.tolist()) == plain_chunks(raw)


def test_blocks_of_hashes(monkeypatch):
    raw = prose(300, 22).encode()
    whole = substring_dedup.chunks(raw)[0].tolist()
    monkeypatch.setattr(substring_dedup, "BLOCK", 37)
    assert substring_dedup.chunks(raw)[0].tolist() == whole


def plain_repeats(rows):
    """(doc_id, text) to texts without repeated windows, by lists of chunks as they are."""
    def split(raw):
        s, halves = plain_chunks(raw)
        return [raw[a:b] for a, b in zip(s, [*s[1:], len(raw)])], halves

    def spans(pieces, halves):
        for a in range(len(pieces)):
            n = 0
            for b in range(a, len(pieces)):
                n += halves[b]
                if n >= 2 * substring_dedup.MIN_WORDS:
                    yield a, b + 1
                    break
        if sum(halves) >= 2 * substring_dedup.MIN_WORDS:
            yield next(a for a in range(len(pieces) - 1, -1, -1) if sum(halves[a:]) >= 2 * substring_dedup.MIN_WORDS), len(pieces)

    key = lambda i, t: (i is None, i or 0, t if i is None else "")
    parts = [split((t or "").encode()) for _, t in rows]
    first = {}
    for (i, t), (pieces, halves) in zip(rows, parts):
        for a, b in spans(pieces, halves):
            w = tuple(pieces[a:b])
            first[w] = min(first.get(w, key(i, t)), key(i, t))
    out = []
    for (i, t), (pieces, halves) in zip(rows, parts):
        gone, seen = set(), {}
        for a, b in spans(pieces, halves):
            w = tuple(pieces[a:b])
            if (seen.get(w, (a, b)) != (a, b)) or first[w] < key(i, t):
                gone.update(range(a, b))
            seen.setdefault(w, (a, b))
        out.append((i, None if t is None else b"".join(x for k, x in enumerate(pieces) if k not in gone).decode()))
    return out


def test_substrings(spark, docs, no_docs, rows):
    found = [(r["doc_id"], r["clean"], r["n_removed_words"], r["spans"], r["text"]) for r in substring_dedup.find_repeats(docs).select("row.doc_id", "row.text", "clean", "n_removed_words", "spans").collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    assert sorted(((i, t) for i, t, *_ in found), key=key) == sorted(plain_repeats(rows), key=key)
    for _, clean, n, spans, text in found:
        assert (n > 0) == bool(spans)
        if spans:
            edges = [0, *(x for s in spans for x in (s["start"], s["end"])), len(text)]
            assert clean == "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
    holders = [t for _, t, *_ in found if t and PASSAGE in t]
    assert len(holders) == 1
    kept = substring_dedup.drop_repeats(docs)
    assert kept.columns == docs.columns and kept.where("text = ''").count() == 1
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in kept.collect())
    assert substring_dedup.drop_repeats(no_docs).count() == 0


def test_unrelated_common_chunks_are_no_passage(spark):
    raw = prose(60, 31).encode()
    s = substring_dedup.chunks(raw)[0].tolist()
    # each chunk with the bytes around it that decide its edges, in an earlier document of its own
    pieces = [raw[max(0, a - 40) : b + 30].decode(errors="ignore") for a, b in zip(s, [*s[1:], len(raw)])]
    data = [(k, f"{prose(30, f'before {k}')} {' '.join(x.split()[1:15])}") for k, x in enumerate(pieces)]
    whole, end = raw.decode(), prose(40, 32)
    data += [(500, whole), (501, f"{end} {whole}"), (502, whole)]
    found = {r["row"]["doc_id"]: (r["clean"], r["n_removed_words"]) for r in substring_dedup.find_repeats(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert found[500] == (whole, 0)  # the first copy stays whole
    assert found[501][1] > 40 and found[501][0].startswith(end[:200]) and found[502] == ("", 60)


def test_passages_go_and_other_text_stays(spark):
    """300 passages of 51 to 80 words, each in three documents; in Chinese too, where nothing is white space."""
    r, data = random.Random(5), []
    for k in range(300):
        passage = prose(r.randint(51, 80), f"p{k}")
        data += [(3 * k + j, f"{prose(r.randint(20, 90), f'a{k}{j}')} {passage} {prose(r.randint(20, 90), f'b{k}{j}')}", passage) for j in range(3)]
    data += [(1000 + j, "前" * j + CHINESE + "后" * j, CHINESE) for j in range(3)]
    found = {x["row"]["doc_id"]: x["clean"] for x in substring_dedup.find_repeats(spark.createDataFrame(data, "doc_id long, text string, passage string")).collect()}
    caught = kept = total = left = 0
    for i, text, passage in data[:900]:
        at = text.index(passage)
        if i % 3 == 0:
            assert found[i] == text
            continue
        total += 1
        rest = found[i]
        caught += len(rest) < len(text)
        left += max(0, len(rest) - len(text) + len(passage)) / len(passage)
        kept += rest.startswith(text[: at - 1]) and rest.endswith(text[at + len(passage) + 1 :])
    assert caught >= 0.99 * total and kept == total and left < 0.25 * total
    assert len(found[1000]) == len(CHINESE) and len(found[1001]) < 30 and len(found[1002]) < 30


def test_groups_grow_with_the_corpus():
    found = [simhash.groups_for(n) for n in (0, 1000, 10**6, 10**8, 10**10)]
    assert found == sorted(found) and found[0] == 6 and found[-1] > 8
