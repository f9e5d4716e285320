"""Benchmark decontamination with a generalised suffix automaton over the words of all test items.

Automata are built on the driver from blocks of items of a bounded number of words, one at a time: a block is read,
built, sent to the executors, run, and let go before the next. Tasks stream each document's words through it and keep
the longest match that ends at each word; matches as long as a window mark words, and the automaton's states tell which
items a window belongs to. A step takes constant time over a text, however repetitive text and items are.

Rows: null texts have no words; items without words never match; an item of fewer words than a window is one
window; repeated documents are each judged; rows with a null ``doc_id`` are judged and keep null; repeated
``item_id`` count once and a null ``item_id`` is left out; texts of any length are read whole, in blocks of words;
``doc_id`` may be of any type; empty tables give no rows, or no hits.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowframe import runtime
from flowframe.llm.common import frugal, replace_text, texts_of, with_row

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: A to Z and what they become.
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WINDOW = 8
#: Words of items in one automaton; its tables take about 60 bytes a word, and its vocabulary 100 a different one.
BLOCK_WORDS = 500_000
#: Characters of a text whose words are lists at once, and where such a block may end: what is in no word.
BLOCK_CHARS = 1 << 20
BREAK = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
FOUND = "clean string, n_words long, spans array<struct<first:int,last:int>>, items array<string>, starts array<int>, ends array<int>"
SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
KINDS = {"clean": pa.string(), "n_words": pa.int64(), "spans": SPANS, "items": pa.list_(pa.string()), "starts": pa.list_(pa.int32()), "ends": pa.list_(pa.int32())}


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.translate(LOWER)) if text else []


def blocks_of(text: str | None, size: int | None = None) -> Iterator[tuple[int, str]]:
    """(place, characters) of a text in blocks of about ``size`` characters that end between words, lower-cased."""
    size, at = size or BLOCK_CHARS, 0
    while text and at < len(text):
        end = len(text)
        if at + size < end and (found := BREAK.search(text, at + size)):
            end = found.start()
        yield at, text[at:end].translate(LOWER)
        at = end


class SuffixAutomaton:
    """All substrings of a set of word sequences, with the windows of each item, in flat arrays.

    Most states lead on by one word only: it stands in ``word`` and ``to``; what else leads on from a state is in
    ``more``. ``of_window[s]``: the state of the last ``window`` words of what ends in s, or -1 if that is shorter.
    ``short_at[s]``: the first state from s on up the suffix links where an item of fewer words ends, or -1.
    """

    def __init__(self, items: list[tuple[str, list[str]]], window: int = WINDOW) -> None:
        self.vocabulary: dict[str, int] = {}
        self.word, self.to, self.link, self.length = array("i", [-1]), array("i", [-1]), array("i", [-1]), array("i", [0])
        self.more: dict[int, dict[int, int]] = {}
        self.window, self.shortest, self.names = window, window, [name for name, _ in items]
        coded = [array("i", [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for _, words in items]
        for word_ids in coded:
            last = 0
            for c in word_ids:
                last = self._extend(last, c)
        link, length = self.link, self.length
        self.of_window, self.short_at = array("i", [-1]) * len(length), array("i", [-1]) * len(length)
        by_length = np.argsort(np.frombuffer(length, np.int32), kind="stable").tolist()
        for s in by_length:
            if length[s] >= window:
                self.of_window[s] = s if length[link[s]] < window else self.of_window[link[s]]
        self.short: dict[int, list[tuple[int, int]]] = {}
        states, owners = array("i"), array("i")
        for item, word_ids in enumerate(coded):
            state = 0
            for c in word_ids:
                state = self._next(state, c)
                if self.of_window[state] >= 0:
                    states.append(self.of_window[state])
                    owners.append(item)
            if 0 < len(word_ids) < window:
                self.short.setdefault(state, []).append((len(word_ids), item))
                self.shortest = min(self.shortest, len(word_ids))
        for s in by_length[1:]:
            self.short_at[s] = s if s in self.short else self.short_at[link[s]]
        # the items of each window's state, by state
        pairs = np.unique(np.stack([np.array(states, np.int32), np.array(owners, np.int32)], 1), axis=0)
        self.states, self.owners = pairs[:, 0].copy(), pairs[:, 1].copy()

    def _next(self, state: int, c: int) -> int:
        """Where ``c`` leads from ``state``, or -1."""
        if self.word[state] == c:
            return self.to[state]
        more = self.more.get(state)
        return -1 if more is None else more.get(c, -1)

    def _lead(self, state: int, c: int, target: int) -> None:
        if self.word[state] in (-1, c):
            self.word[state], self.to[state] = c, target
        else:
            self.more.setdefault(state, {})[c] = target

    def _new(self, length: int, link: int) -> int:
        for table, value in ((self.word, -1), (self.to, -1), (self.length, length), (self.link, link)):
            table.append(value)
        return len(self.length) - 1

    def _extend(self, last: int, c: int) -> int:
        """Add one word after ``last``, which may already lead on (so several items share one automaton)."""
        q = self._next(last, c)
        if q >= 0:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new, p = self._new(self.length[last] + 1, 0), last
        while p != -1 and (q := self._next(p, c)) < 0:
            self._lead(p, c, new)
            p = self.link[p]
        if p != -1:
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q])
        self.word[clone], self.to[clone] = self.word[q], self.to[q]
        if q in self.more:
            self.more[clone] = dict(self.more[q])
        while p != -1 and self._next(p, c) == q:
            self._lead(p, c, clone)
            p = self.link[p]
        self.link[q] = clone
        return clone

    def search(self, blocks: Iterable[list[str]]) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Of a text, as lists of words: how many there are, the stretches of words hit (first, last; ascending and
        apart), and the items that have a window in them, sorted."""
        known, word, to, more, link, length = self.vocabulary.get, self.word, self.to, self.more, self.link, self.length
        window, shortest, of_window, short_at, short = self.window, self.shortest, self.of_window, self.short_at, self.short
        spans: list[tuple[int, int]] = []
        windows: set[int] = set()
        found: set[int] = set()
        base = state = n = 0
        for words in blocks:
            codes = [known(w, -1) for w in words]
            # only runs of known words can hold a window; the first may go on from the block before, the last after it
            unknown = np.flatnonzero(np.array(codes, np.int64) < 0)
            edges = np.concatenate([[-1], unknown, [len(codes)]])
            runs = np.diff(edges) > shortest
            runs[0], runs[-1] = True, True
            for r in np.flatnonzero(runs):
                if r:
                    state = n = 0
                for at in range(int(edges[r]) + 1, int(edges[r + 1])):
                    c = codes[at]
                    while True:
                        if word[state] == c:
                            state, n = to[state], n + 1
                            break
                        if state in more and c in more[state]:
                            state, n = more[state][c], n + 1
                            break
                        if not state:
                            break
                        state = link[state]
                        n = length[state]
                    if n < shortest:
                        continue
                    hit = 0
                    if n >= window:
                        hit = window
                        windows.add(of_window[state])
                    up = short_at[state]
                    while up >= 0:
                        for k, item in short[up]:
                            if k <= n:
                                hit = max(hit, k)
                                found.add(item)
                        up = short_at[link[up]]
                    if hit:
                        first = base + at - hit + 1
                        while spans and spans[-1][1] >= first - 1:
                            first = min(first, spans.pop()[0])
                        spans.append((first, base + at))
            base += len(words)
        for w in windows:
            a, b = np.searchsorted(self.states, [w, w + 1])
            found.update(self.owners[a:b].tolist())
        return base, spans, sorted({self.names[k] for k in found})


def characters_of(text: str, spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Where in the text the spans of words begin and end."""
    firsts, lasts = [a for a, _ in spans], [b for _, b in spans]
    starts, ends, n = [], [], 0
    for at, block in blocks_of(text):
        if len(ends) == len(spans):
            break
        for m in WORD.finditer(block):
            if len(starts) < len(spans) and n == firsts[len(starts)]:
                starts.append(at + m.start())
            if len(ends) < len(spans) and n == lasts[len(ends)]:
                ends.append(at + m.end())
            n += 1
    return starts, ends


def item_blocks(benchmark: DataFrame, window: int, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[str]]]]:
    """The items by blocks of at most ``block_words`` words; a longer item goes on in the next block.

    The rows are fetched partition by partition, so the driver holds a block at a time.
    """
    block, n = [], 0
    rows = benchmark.where("item_id is not null").groupBy(F.col("item_id").cast("string").alias("item_id"), "text").agg(F.lit(1))
    for row in rows.select("item_id", "text").toLocalIterator():
        words = words_of(row["text"])
        for at in range(0, max(1, len(words) - window + 1), block_words):
            part = words[at : at + block_words + window - 1]
            if part and n + len(part) > block_words + window - 1 and block:
                yield block
                block, n = [], 0
            if part:
                block.append((row["item_id"], part))
                n += len(part)
    if block:
        yield block


def _rows(row: pa.Array, found: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(x, kind) for x, kind in zip(zip(*found) if found else [()] * len(KINDS), KINDS.values())]
    return pa.RecordBatch.from_arrays([row, *columns], names=["row", *KINDS])


def without(text: str | None, starts: list[int], ends: list[int]) -> str | None:
    """The text without its spans."""
    return "".join(text[a:b] for a, b in zip([0, *ends], [*starts, len(text)])) if starts else text


def match_rows(automaton, cut: bool):
    """For ``mapInArrow`` over rows with texts: hits of each document, and what is left of its text if ``cut``;
    ``automaton`` is a broadcast."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton.value
        for batch in batches:
            rows = []
            for text in texts_of(batch).to_pylist():
                n, spans, items = found.search(WORD.findall(block) for _, block in blocks_of(text))
                starts, ends = characters_of(text, spans) if spans else ([], [])
                rows.append((without(text, starts, ends) if cut else None, n, [{"first": a, "last": b} for a, b in spans], items, starts, ends))
            yield _rows(batch.column("row"), rows)

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, text_back: bool = False) -> DataFrame:
    """Hits of ``docs`` (text, and what else they have) on ``benchmark`` (item_id, text).

    Per document: ``row``, the document as it came (with its text only if that is wanted back, as is ``clean``, what
    is left of it); n_words; ``spans`` of word places hit (first,
    last); the ``items`` that have an occurring window; the spans' ``starts`` and ``ends`` in characters.
    A benchmark of one block takes one pass over the documents without a shuffle. Each further block is one
    more pass, whose hits are a table in the shared folder, and the spans are then united by text: equal texts have
    equal hits. The driver holds two blocks of words and one automaton at most.
    """
    spark = docs.sparkSession
    runtime.ship(spark)
    runtime.small_arrow_batches(spark)
    rows = with_row(docs, text_back)
    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL(FOUND).fields])
    blocks = item_blocks(benchmark, window, block_words)
    block, following = next(blocks, []), next(blocks, None)
    if following is None:
        return rows.mapInArrow(match_rows(spark.sparkContext.broadcast(SuffixAutomaton(block, window)), text_back), schema)
    text = F.col("row.text") if text_back else F.col("text")
    key = F.sha2(text, 256).alias("key")
    texts = rows.select(F.struct(key).alias("row"), text.alias("text"))
    keyed = T.StructType([texts.schema["row"], *T.StructType.fromDDL(FOUND).fields])
    parts = ("spans", "items", "starts", "ends")
    passes = []
    while block:
        automaton = spark.sparkContext.broadcast(SuffixAutomaton(block, window))
        found = texts.mapInArrow(match_rows(automaton, False), keyed).where("size(spans) > 0")
        found = found.select("row.key", *parts).groupBy("key").agg(*(F.first(c).alias(c) for c in parts))
        passes.append(runtime.write_table(found, "contamination")[0])
        automaton.destroy()
        block, following = following, next(blocks, None) if following else None
    united = functools.reduce(DataFrame.unionByName, passes).groupBy("key").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in parts))
    # a table of its own, so that a text which very many rows have can be split over tasks in the join
    united, _ = runtime.write_table(united, "contamination")
    return rows.withColumn("key", key).join(united, "key", "left").drop("key").mapInArrow(unite_rows, schema)


def unite_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow``: spans of several passes become spans that are apart."""
    for batch in batches:
        rows = []
        for text, *found in zip(texts_of(batch).to_pylist(), *(batch.column(c).to_pylist() for c in ("spans", "items", "starts", "ends"))):
            hits, items, starts, ends = (x or [] for x in found)
            spans: list[list[int]] = []
            for first, last, start, end in sorted((x["first"], x["last"], a, b) for x, a, b in zip(hits, starts, ends)):
                if spans and spans[-1][1] >= first - 1:
                    if last > spans[-1][1]:
                        spans[-1][1], spans[-1][3] = last, end
                else:
                    spans.append([first, last, start, end])
            starts, ends = [x[2] for x in spans], [x[3] for x in spans]
            rows.append((without(text, starts, ends), sum(len(WORD.findall(block)) for _, block in blocks_of(text)), [{"first": x[0], "last": x[1]} for x in spans], sorted(set(items)), starts, ends))
        yield _rows(batch.column("row"), rows)


def hit_words() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_coverage: float = 0.5) -> DataFrame:
    """Remove benchmark passages from ``docs``, which keep their columns.

    Spans of ``window`` words or more that occur in an item (and whole shorter items) go from ``text``; a
    document of which more than ``most_coverage`` of the words are hit goes altogether. A column ``n_chars``
    is counted anew where the text was cut.
    """
    found = find_contamination(docs, benchmark, window, text_back=True)
    kept = found.where(hit_words() <= F.col("n_words") * most_coverage)
    return replace_text(kept, docs.columns, "clean")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's hits on the benchmark: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    n_items = F.size("items").cast("long")
    return found.select(
        "row.doc_id",
        "n_words",
        hit_words().alias("n_hit"),
        n_items.alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_items >= 2).alias("contaminated"),
    )
