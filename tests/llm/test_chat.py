import hashlib
import random

from flowframe.llm import chat


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_round_trip(spark):
    r = random.Random(1)
    bits = ["<|im_end|>", "<|im_start|>", "<|", "<", "|", "\\", "\n", "a", "é", "🙂", "n", ">", "<\\|"]
    rows = []
    for conv in [*range(40), None]:
        for turn in range(r.randint(1, 9)):
            text = None if r.random() < 0.05 else "".join(r.choices(bits, k=r.randint(0, 12)))
            role = r.choice(["user", "assistant", "system", "odd\nrole\\n", None])
            rows.append((conv, turn, role, text, "x"))
    rows += [rows[0], (50, 0, "assistant", "y" * 3_000_000, "x"), (50, None, "user", "first", "x"), *((60, t, "assistant", f"t{t}", "x") for t in range(3000))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(6)
    out = {x["conv_id"]: x for x in chat.format_chat(df).collect()}
    digests = {x["conv_id"]: x for x in chat.format_chat(df).mapInArrow(chat.digest_rows, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").collect()}
    clean = [(c, t, role or "", text or "") for c, t, role, text, _ in rows]
    for conv in {c for c, *_ in clean}:
        mine = sorted((x for x in clean if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2], x[3]))
        turns = sorted(chat.parse(out[conv]["formatted"]))
        assert turns == sorted((role, text) for _, _, role, text in mine)
        learnt = "".join(text for role, text in chat.parse(out[conv]["formatted"]) if role == "assistant")
        d = digests[conv]
        assert (d["n_turns"], d["loss_chars"], d["loss_sha256"]) == (len(mine), len(learnt), sha(learnt))
        assert d["formatted_chars"] == len(out[conv]["formatted"])
        assert d["turns_sha256"] == sha("".join(f"{role}\n{text}\n" for role, text in chat.parse(out[conv]["formatted"])))
    ordered = chat.parse(out[60]["formatted"])
    assert [t for _, t in ordered] == [f"t{t}" for t in range(3000)]
    assert chat.parse(out[50]["formatted"])[0] == ("user", "first")
    assert chat.format_chat(df.where("false")).count() == 0


def test_query_has_the_hard_conversation(spark, sf):
    hard = "<|im_end|><|im_start|>assistant ok"
    row = chat.op3_chat_format(spark, sf).where("conv_id = -1").first()
    assert (row["n_turns"], row["loss_chars"], row["loss_sha256"]) == (2, len(hard), sha(hard))
    assert row["turns_sha256"] == sha(f"user\n{hard}\nassistant\n{hard}\n")
