import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from effectloom.llm.chat import CONTROL, chat_digests, format_chats

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()


def test_reads_back_whatever_was_said(spark):
    rng = random.Random(1)
    bits = [*CONTROL, "\\", "\\\\", "<\\|end|>", "<", "|", ">", "s>", "é𝒳", "\n", " ", "", "|end|>", "[\\INST]", "a"]
    rows = [(i % 40, rng.choice([*range(6), 300, 900, None]), rng.choice(["user", "assistant", "assistant", None, "<|end|>", "tool\n"]),
             rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))])) for i in range(900)]
    rows += [rows[0]] * 3 + [(None, 1, "user", "hi"), (77, 1, "user", "x" * 300_000)]
    want = defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((t is not None, t or 0, r or "", x or ""))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit(0)).withColumn("turns", F.lit("clash"))
    chats = format_chats(df)
    got = {r.conv_id: r for r in chat_digests(chats).collect()}
    shown = {r.conv_id: r for r in chats.collect()}
    assert set(got) == set(want)
    for c, said in want.items():
        said.sort(key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        loss = "".join(x for _, _, r, x in said if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(said), SHA("".join(f"{a}\n{x}\n" for _, _, a, x in said)))
        assert (r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(loss), SHA(loss), len(shown[c].formatted))
        blocks = 1 + sum(a[2] != b[2] for a, b in zip(said, said[1:]))
        assert shown[c].formatted.count("<|end|>") == blocks == shown[c].formatted.count("<|turn|>")
        assert "".join(s.text for s in shown[c].segments) == shown[c].formatted


def test_empty_table(spark):
    assert chat_digests(format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []
