import random

import pytest

#: Names that operators use for columns of their own.
CLASHING = ["row", "fp", "spans", "chunks", "score", "posterior", "clean", "n_words", "base_failed", "key", "cell", "doc", "crc", "kept", "id", "nth", "keeper", "starts", "ends", "items", "component_id"]

rng = random.Random(17)
WORDS = ["".join(rng.choices("abcdefghijklmnoprstuéü", k=rng.randint(2, 9))) for _ in range(900)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


PASSAGE = prose(70, "passage")


def texts():
    base = prose(200, "base").split(" ")
    near = [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in (50, 120)]
    return [
        prose(120, 1),
        prose(300, 2),
        " ".join(base),
        " ".join(base),
        *near,
        None,
        "",
        " \n\t ",
        "two words",
        "<|endoftext|> it's a 'test',\n\n  with  spaces\t and <|im_start|> marks…",
        prose(40, 3) + " " + PASSAGE + " " + prose(60, 4),
        prose(90, 5) + " " + PASSAGE + " " + prose(20, 6),
        "ÄÖ ÉÈ\u3000\u00a0x 中文 字 🙂 " + prose(30, 7),
        "word " * 3000,
        prose(9000, 8),
        "x" * 70000,
        "| a | b | c |\n" * 40,
        "*** $$$ ### " * 30,
        "SHOUT!! LOUD!! " * 40,
    ]


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text), some rows twice, one doc_id null."""
    out = [(i, t) for i, t in enumerate(texts())]
    return [*out, out[0], out[4], (None, prose(50, 9))]


@pytest.fixture(scope="session")
def docs(spark, rows):
    data = [(i, t, "en", f"s{k % 3}", len(t) if t is not None else None, *[str(k)] * len(CLASHING)) for k, (i, t) in enumerate(rows)]
    names = ["doc_id bigint", "text string", "lang string", "source string", "n_chars bigint", *(f"{c} string" for c in CLASHING)]
    df = spark.createDataFrame(data, ", ".join(names)).repartition(5)
    return df


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
