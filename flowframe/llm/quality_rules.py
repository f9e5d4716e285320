"""Quality rules as weak supervision: rules vote or abstain, and what their votes are worth is estimated.

Each rule looks at one statistic of a text and votes good, bad or not at all. Expectation-maximisation over the
counts of vote patterns estimates how accurate each rule is on good and on bad documents, and the posterior
probability of being good decides instead of an all-must-pass filter. A fixed base check comes first.

Rows: null and empty texts have no words and fail the base check; texts of any length are read whole; repeated
rows have equal results; a null ``doc_id`` stays null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowframe import runtime
from flowframe.llm.common import frugal, texts_of, with_row

WINDOW = 8
#: The white space between words, and the symbols counted.
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
STATISTICS = {
    "n_words": pa.int64(),
    "word_chars": pa.int64(),
    "n_symbols": pa.int64(),
    "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(),
    "n_lines": pa.int64(),
    "n_distinct_words": pa.int64(),
    "n_same_as_before": pa.int64(),
    "n_capitals": pa.int64(),
    "n_small": pa.int64(),
    "n_shouts": pa.int64(),
    "n_bars": pa.int64(),
}
CAPITALS, SMALL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in windows of ``window`` words that the list holds twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint64, len(words))
    if len(known) == len(words):
        return 0
    with np.errstate(over="ignore"):
        mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
        h = np.zeros(n, np.uint64)
        for k in range(window):
            h = h * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + n]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    # windows with equal hashes are compared word by word
    maybe = np.sort(order[np.concatenate([[False], same]) | np.concatenate([same, [False]])])
    rows = ids[maybe[:, None] + np.arange(window)]
    _, inverse, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    twice = maybe[counts[inverse.reshape(-1)] > 1]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """The numbers named in ``STATISTICS`` of a whole text."""
    if not text:
        return (0,) * len(STATISTICS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        len(set(words)),
        sum(map(eq, words, words[1:])),
        len(raw) - len(raw.translate(None, CAPITALS)),
        len(raw) - len(raw.translate(None, SMALL)),
        text.count("!"),
        text.count("|"),
    )


@frugal
def statistics_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow`` over (row, text): each row with its statistics."""
    for batch in batches:
        found = [statistics(t) for t in texts_of(batch).to_pylist()]
        columns = [pa.array(x, kind) for x, kind in zip(zip(*found) if found else [()] * len(STATISTICS), STATISTICS.values())]
        yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], names=["row", *STATISTICS])


def measure(docs: DataFrame) -> DataFrame:
    """``row``, all columns as they came but the text, and the statistics of the text."""
    runtime.ship(docs.sparkSession)
    runtime.small_arrow_batches(docs.sparkSession)
    rows = with_row(docs)
    fields = [T.StructField(name, T.LongType()) for name in STATISTICS]
    return rows.mapInArrow(statistics_rows, T.StructType([rows.schema["row"], *fields]))


def share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def between(value: Column, good: Column, bad: Column) -> Column:
    """1 for a good vote, -1 for a bad one, 0 for none; a bad vote goes before a good one."""
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Each rule's vote: 1 good, -1 bad, 0 abstains."""
    symbols, shouts, bars = share("n_symbols", "n_words"), share("n_shouts", "n_words"), share("n_bars", "n_words")
    capitals = F.col("n_capitals") / F.greatest(F.col("n_capitals") + F.col("n_small"), F.lit(1))
    same, distinct = share("n_same_as_before", "n_words"), share("n_distinct_words", "n_words")
    repeats, lines, length = share("n_repeat_words", "n_words"), share("n_dup_lines", "n_lines"), share("word_chars", "n_words")
    enough = F.col("n_words") >= 20
    return {
        "symbols": between(symbols, symbols < 0.02, symbols > 0.2),
        "capitals": between(capitals, capitals < 0.15, capitals > 0.4),
        "shouts": between(shouts, shouts < 0.02, shouts > 0.2),
        "bars": between(bars, bars < 0.01, bars > 0.15),
        "same": between(same, same < 0.03, same > 0.2),
        "variety": between(distinct, enough & (distinct > 0.4), enough & (distinct < 0.15)),
        "repeats": between(repeats, enough & (repeats < 0.05), repeats > 0.5),
        "lines": between(lines, (F.col("n_lines") >= 3) & (lines == 0), lines > 0.7),
        "length": between(length, (length >= 3) & (length <= 10), (length < 2) | (length > 20)),
    }


#: A rule that votes against more of the good documents than this is no rule; real rates lie far below.
MOST_FALSE = 0.5
#: Weight, as a share of all documents, of the prior that rules do not vote against good ones.
PRIOR = 0.2


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 1000, most_false: float = MOST_FALSE) -> dict[tuple[int, ...], float]:
    """Posterior probability of being good for each vote pattern, by expectation-maximisation.

    ``patterns``: documents by pattern. Documents are good or of one of some kinds of bad ones; in each class a rule
    that votes does so against a document with a probability of its own, and rules are independent given the class;
    an abstention says nothing. All rates are estimated, with one made-up observation of each vote and, for the good
    ones, ``PRIOR`` times all documents without a bad vote: where votes alone cannot tell a rule's errors from bad
    documents that only it sees, which is a flat ridge of the likelihood, the latter are taken. To begin with any bad
    vote puts a document with the bad ones. One kind of bad documents at a time is added, begun from those that some
    rule votes against, as long as the likelihood grows by more than the Bayesian information criterion asks for (with
    too few kinds the good class takes in what the bad ones cannot say) and each kind has a rule that mostly votes
    against it.
    """
    if not patterns:
        return {}
    keys = sorted(patterns)
    votes = np.array(keys, np.int64).reshape(len(keys), -1)
    n = np.array([patterns[k] for k in keys], np.float64)
    bad, fine = votes < 0, votes > 0

    def fit(share: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The log likelihood, each pattern's share of each class (the first is good) and each class's rates."""
        made_up = np.full((share.shape[1], 1), 2.0)
        made_up[0] += PRIOR * n.sum()
        before = -np.inf
        for _ in range(rounds):
            w = n[:, None] * share
            prior = (w.sum(0) + 1) / (n.sum() + share.shape[1])
            against = (w.T @ bad + 1) / (w.T @ (bad | fine) + made_up)
            against[0] = np.minimum(against[0], most_false)
            log = np.log(prior) + bad @ np.log(against).T + fine @ np.log(1 - against).T
            top = log.max(1, keepdims=True)
            share = np.exp(log - top)
            total = share.sum(1, keepdims=True)
            share /= total
            fits = float(n @ (np.log(total) + top)[:, 0])
            if abs(fits - before) < 1e-12 * abs(fits):
                break
            before = fits
        return fits, share, against

    good = np.where(bad.any(1), 0.1, 0.99)
    fits, share, _ = fit(np.stack([good, 1 - good], 1))
    cost = (bad.shape[1] + 1) / 2 * np.log(n.sum())
    while share.shape[1] <= bad.shape[1]:
        moved = [np.where(bad[:, [r]], 0.9, 0.0) for r in range(bad.shape[1])]
        tried = [fit(np.hstack([share * (1 - x), x])) for x in moved]
        tried = [x for x in tried if (x[2][1:].max(1) > 0.5).all()]
        best = max(tried, key=lambda x: x[0], default=None)
        if best is None or best[0] < fits + cost:
            break
        fits, share, _ = best
    return dict(zip(keys, share[:, 0].tolist()))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``row``, statistics, each rule's vote (``vote_...``), ``posterior``, ``base_failed`` and ``kept``.

    The votes of all documents count, those that fail the base check too, since they show what bad ones look like;
    as numbers of documents by pattern, which are three to the power of the rules at most. The statistics are written once, without texts.
    """
    spark = docs.sparkSession
    votes = rules()
    voted = measure(docs).select("*", *(v.alias(f"vote_{k}") for k, v in votes.items()), base_failed().alias("base_failed"))
    table, _ = runtime.write_table(voted, "votes")
    names = [f"vote_{k}" for k in votes]
    counted = table.groupBy(*names).agg(F.count("*").alias("n")).collect()
    posterior = estimate({tuple(r[c] for c in names): r["n"] for r in counted})
    schema = T.StructType([*(T.StructField(c, T.IntegerType()) for c in names), T.StructField("posterior", T.DoubleType())])
    # a row for each vote pattern, at most three to the power of the rules
    known = spark.createDataFrame([(*k, p) for k, p in posterior.items()], schema)
    judged = table.join(F.broadcast(known), names, "left")
    kept = ~F.col("base_failed") & (F.coalesce("posterior", F.lit(0.0)) >= threshold)
    return judged.select("row", *STATISTICS, *names, "posterior", "base_failed", kept.alias("kept"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's statistics, base check and verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    judged = judge(docs)
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
