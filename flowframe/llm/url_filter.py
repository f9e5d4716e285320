"""URL filters: rules by host and path, and a logistic regression on hashed character n-grams for the rest.

All of it is DataFrame expressions: extraction, rules, n-grams and their hashes, training and scoring.

Rows: a null url, or one without ``://``, has an empty host and path and is judged by the model on these; very
long urls are scored whole; repeated rows have equal results; an empty table gives no rows; columns besides the
url pass through under their names, and results named like one of them replace it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The rules of the query: (rule, verdict). A rule fits its host and all subdomains, for paths that begin with its
#: own; of several that fit the longest decides.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
#: Rules that become one expression; more of them, or rules in a table, are joined. Results are the same.
MOST_IN_EXPRESSION = 1000
#: Most labelled urls, since they are learnt from in one row.
MOST_LABELLED = 5000
SIZES, BUCKETS = (3, 4), 2048
EPOCHS, RATE, DECAY = 150, 4.0, 1e-3

#: A small labelled table, written for this filter: hosts to block, hosts to allow, and what comes before and after a
#: host. The k-th host of either kind has the k-th of these, in turn, so that they tell nothing by themselves.
BLOCK_HOSTS = """
online-pills pills-shop viagra-store buy-meds-online best-casino casino-online royalcasino poker-room bets-today sports-betting
betting-tips bet365-bonus adult-videos xxx-cams hot-adult-chat free-porn link-farm spammer bulk-spam seo-backlinks ads-server adtracker
clicktrack popunder-ads payday-loans fast-loan lottery-jackpot free-money porn-tube sexy-girls weight-loss-pills replica-watches
"""
ALLOW_HOSTS = """
news library garden python-docs history weather museum shop university recipes theatre forum harbour brickworks orchard mountain
cathedral kitchen quilting bicycle lighthouse pottery village aquarium research city trains parliament health science law music
adventure address-book between alphabet education nation station fiction nutrition traditions translation auction tables cable
sustainable vegetables convention vacation action invention international animation conversation portable spamalot-theatre tracks
winter winery freedom
"""
AROUND = (
    ("http://", "/en/482"), ("https://www.", "/"), ("https://", "/de/20"), ("http://m.", "/item/4?id=1"), ("http://blog.", "/es/245#top"), ("https://", "/en/65.html"),
    ("http://www.", ""), ("https://m.", "/fr/510/"), ("https://blog.", "/en/963?page=2"), ("http://", "/today"), ("https://", "/archive/2020"),
)


def _urls(hosts: str) -> list[str]:
    return [f"{AROUND[k % len(AROUND)][0]}{name}.test{AROUND[k % len(AROUND)][1]}" for k, name in enumerate(hosts.split())]


BLOCK, ALLOW = _urls(BLOCK_HOSTS), _urls(ALLOW_HOSTS)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z lower-cased; else empty."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def deciding_rule(host_: Column, path_: Column, rules) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, null if none does, as one expression."""
    rule = verdict = None
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        of_host, slash, rest = text.partition("/")
        fits = ((host_ == of_host) | host_.endswith("." + of_host)) & path_.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def join_rules(df: DataFrame, rules: DataFrame) -> DataFrame:
    """``df`` (with host and path) and the deciding ``rule`` and ``verdict`` out of a table (rule, verdict) of any size.

    A rule that fits is a suffix of the host, of as many labels as a rule's host has at most, followed by a prefix
    of the path, as long as a rule's path; so each url is joined by these texts, and a minimum by the url's digest,
    combined before the shuffle, keeps the longest. Only the lengths of rules' paths come to the driver. Of rules
    that stand twice the least verdict counts; null rules fit nothing.
    """
    once = rules.where("rule is not null").groupBy("rule").agg(F.min("verdict").alias("verdict"))
    of_host = F.substring_index("rule", "/", 1)
    shape = once.agg(F.max(F.size(F.split(of_host, r"\."))).alias("labels"), F.collect_set(F.length("rule") - F.length(of_host)).alias("lengths")).first()
    url = F.unhex(F.sha2(F.concat("host", "path"), 256))
    packed = df.select(F.struct(*(F.col(c) for c in df.columns if c not in ("rule", "verdict"))).alias("row"), url.alias("url"))
    labels, path_ = F.split(F.col("row.host"), r"\."), F.col("row.path")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.lit(shape["labels"] or 1), F.size(labels))), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    fitting = F.filter(F.lit(shape["lengths"]).cast("array<int>"), lambda n: n <= F.length(path_))
    prefixes = F.transform(fitting, lambda n: F.substring(path_, F.lit(1), n))
    tried = packed.select("url", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes")).select("url", "suffix", F.explode("prefixes").alias("prefix"))
    fits = tried.select("url", F.concat("suffix", "prefix").alias("rule")).join(once, "rule")
    best = fits.groupBy("url").agg(F.min(F.struct((-F.length("rule")).alias("n"), "rule", "verdict")).alias("best"))
    return packed.join(best, "url", "left").select("row.*", "best.rule", "best.verdict")


def with_rules(df: DataFrame, rules) -> DataFrame:
    """``df`` (with host and path) and the deciding ``rule`` and its ``verdict``; of pairs that stand twice the first counts."""
    if isinstance(rules, DataFrame):
        return join_rules(df, rules)
    if len(rules) > MOST_IN_EXPRESSION:
        return join_rules(df, df.sparkSession.createDataFrame(list(dict(reversed(list(rules))).items()), "rule string, verdict string"))
    rule, verdict = deciding_rule(F.col("host"), F.col("path"), rules)
    return df.withColumns({"rule": rule, "verdict": verdict})


def gram_buckets(host_: Column, path_: Column) -> Column:
    """The buckets of all character n-grams of host and path, each marked by where it comes from."""
    def grams(mark: str, text: Column, n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
        return F.transform(places, lambda i: F.pmod(F.xxhash64(F.concat(F.lit(mark), F.substring(text, i, F.lit(n)))), F.lit(BUCKETS)).cast("int"))

    marked = (("h", F.concat(F.lit("^"), host_, F.lit("$"))), ("p", F.concat(path_, F.lit("$"))))
    return F.flatten(F.array(*(grams(mark, text, n) for mark, text in marked for n in SIZES)))


def logit(buckets: Column, weights: Column) -> Column:
    """The last weight plus the sum of the buckets' weights over the root of their number."""
    total = F.aggregate(buckets, F.lit(0.0), lambda a, b: a + F.element_at(weights, b + 1))
    return F.element_at(weights, BUCKETS + 1) + total / F.sqrt(F.size(buckets))


def probability(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def train(labelled: DataFrame) -> list[float]:
    """Weights (``BUCKETS`` and a constant) from ``labelled`` (url, label: 1 to block), by gradient descent.

    The table is small: at most ``MOST_LABELLED`` rows, which is checked. They are one row of arrays here, and
    each epoch is a step of ``aggregate`` over that row; only the weights come to the driver. The constant is fixed at
    the log odds of the labels (each counted once more), so that a url of unknown n-grams is judged by these alone;
    without usable rows it is 0.
    """
    if labelled.limit(MOST_LABELLED + 1).count() > MOST_LABELLED:
        raise ValueError(f"at most {MOST_LABELLED} labelled urls")
    grams = labelled.where("label is not null").select(F.col("label").cast("double").alias("y"), gram_buckets(host(F.col("url")), path(F.col("url"))).alias("b"))
    rows = grams.agg(F.array_sort(F.collect_list(F.struct("y", "b"))).alias("rows"))
    m = F.greatest(F.size("rows"), F.lit(1))
    blocked = F.aggregate("rows", F.lit(0.0), lambda a, r: a + r["y"])
    begin = F.concat(F.array_repeat(F.lit(0.0), BUCKETS), F.array(F.log((blocked + 1) / (F.size("rows") - blocked + 1))))
    # for each bucket, the rows that have it and how often, as (row, weight of the n-gram there)
    shares = rows.select("rows", F.posexplode("rows").alias("k", "r")).select("k", F.explode("r.b").alias("bucket"), (1.0 / F.sqrt(F.size("r.b"))).alias("x"))
    shares = shares.groupBy("bucket", "k").agg(F.sum("x").alias("x")).groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("of"))
    inverse = shares.agg(F.map_from_entries(F.collect_list(F.struct("bucket", "of"))).alias("map"))
    both = rows.join(F.broadcast(inverse)).select("rows", F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda j: F.try_element_at("map", j)).alias("inverse"))

    def step(w: Column, _: Column) -> Column:
        errors = F.transform("rows", lambda r: probability(logit(r["b"], w)) - r["y"])

        def moved(w_: Column, e: Column) -> Column:
            buckets = F.zip_with(
                F.slice(w_, 1, BUCKETS),
                "inverse",
                lambda x, of: x * (1 - RATE * DECAY) - F.when(of.isNull(), 0.0).otherwise(F.aggregate(of, F.lit(0.0), lambda a, s: a + s["x"] * F.element_at(e, s["k"] + 1))) * RATE / m,
            )
            return F.concat(buckets, F.array(F.element_at(w_, BUCKETS + 1)))

        return F.aggregate(F.array(errors), w, moved)

    trained = both.select(F.aggregate(F.sequence(F.lit(1), F.lit(EPOCHS)), begin, step).alias("weights"))
    return list(trained.first()["weights"])


def labelled_urls(spark: SparkSession) -> DataFrame:
    rows = [(url, 1) for url in BLOCK] + [(url, 0) for url in ALLOW]
    return spark.createDataFrame(rows, "url string, label int")


def filter_urls(df: DataFrame, weights: list[float], rules=RULES, url: str = "url") -> DataFrame:
    """``df`` with host, path, rule, verdict (allow or block) and ``p_block``, the model's probability.

    ``rules`` are pairs (rule, verdict), or a table of them of any size.
    """
    parts = df.withColumns({"host": host(F.col(url)), "path": path(F.col(url))})
    scored = parts.withColumn("p_block", probability(logit(gram_buckets(F.col("host"), F.col("path")), F.lit(weights))))
    of_model = F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")
    return with_rules(scored, rules).withColumn("verdict", F.coalesce("verdict", of_model))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, deciding rule and verdict."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    judged = filter_urls(pages, train(labelled_urls(spark)))
    return judged.select("page_id", "host", "path", "rule", "verdict", "p_block")
