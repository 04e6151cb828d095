r"""Chat formatting with Spark expressions only.

A conversation's rows are collected as structs (first by stretches of turns, then
by conversation), sorted by turn, role and text, and adjacent rows of one role
are merged into one block; each text keeps its own place in the block.  The
formatted conversation is the concatenation of segments; every second one is a
whole escaped text, and those of the trained roles are under the loss mask.

Escaping is reversible: backslashes are doubled, then a backslash goes behind
the first character of every control string, the template's own and those of
common tokenizers.  Reading back splits the output at the template's marks and
undoes both steps.

null text and null role: as empty.  A null turn sorts first; rows with equal
turns sort by role and text; repeated rows are kept.  A null conv_id is one
conversation.  An empty table gives an empty result; other columns are not read.
A formatted conversation is one value, so a conversation has to fit in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, BODY, NEXT, CLOSE = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
#: Control strings, fixed values.
CONTROL = [OPEN, BODY, NEXT, CLOSE, "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|startoftext|>",
           "<|im_start|>", "<|im_end|>", "<|begin_of_text|>", "<|end_of_text|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>"]
STRETCH = 256


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    out = text
    for c in CONTROL:
        out = F.replace(out, F.lit(f"{c[0]}\\{c[1:]}"), F.lit(c))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def format_chats(conversations: DataFrame, loss_roles: Sequence[str] = ("assistant",), id_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id, segments (text, loss) in order, formatted (their texts joined)."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = conversations.select(F.col(id_col).alias("id"), F.floor(F.col(turn_col) / STRETCH).alias("stretch"), turn.alias("turn")).groupBy("id", "stretch").agg(
        F.collect_list("turn").alias("turns"))
    # stretches are few; their turns are sorted together
    whole = parts.groupBy("id").agg(F.sort_array(F.flatten(F.collect_list("turns"))).alias("turns"))
    turns = F.col("turns")

    def two(t: Column, i: Column) -> Column:
        same = (i > 0) & (F.get(turns, i - 1)["role"] == t["role"])
        opening = F.concat(F.when(i > 0, F.lit(CLOSE)).otherwise(F.lit("")), F.lit(OPEN), escape(t["role"]), F.lit(BODY))
        return F.array(F.struct(F.when(same, F.lit(NEXT)).otherwise(opening).alias("text"), F.lit(False).alias("loss")),
                       F.struct(escape(t["text"]).alias("text"), t["role"].isin(*loss_roles).alias("loss")))

    end = F.array(F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss")))
    cut = whole.select("id", F.concat(F.flatten(F.transform(turns, two)), end).alias("segments"))
    return cut.select(F.col("id").alias(id_col), "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_back(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation."""
    def cut(text: Column, mark: str) -> Column:
        return F.split(text, "\\Q" + mark + "\\E", -1)

    blocks = F.slice(cut(formatted, CLOSE), 1, F.size(cut(formatted, CLOSE)) - 1)
    return F.flatten(F.transform(blocks, lambda b: F.transform(
        cut(F.element_at(cut(b, BODY), 2), NEXT),
        lambda t: F.struct(unescape(F.substring(F.element_at(cut(b, BODY), 1), len(OPEN) + 1, F.length(b))).alias("role"), unescape(t).alias("text")))))


def chat_digests(chats: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What the formatted conversations say, read back from them."""
    turns = F.array_join(F.transform(read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return chats.select(id_col, F.size(read_back(F.col("formatted"))).cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), loss.alias("loss"), "formatted").select(
        id_col, "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


#: A conversation whose texts are another template's control strings.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def _escaped_sql(x: str) -> str:
    x = f"replace({x}, '\\', '\\\\')"
    for c in CONTROL:
        x = f"replace({x}, '{c}', '{c[0]}\\{c[1:]}')"
    return x


CHAT_SQL = f"""WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL
 VALUES {", ".join(f"({i}, {t}, '{r}', '{x}')" for i, t, r, x in PROBE)}),
t AS (SELECT conv_id, turn, coalesce(role,'') AS role, coalesce(text,'') AS text FROM c),
p AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM t),
e AS (SELECT *, length({_escaped_sql("text")}) + CASE WHEN before = role THEN {len(NEXT)}
 ELSE {len(OPEN) + len(BODY) + len(CLOSE)} + length({_escaped_sql("role")}) END AS n FROM p)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(n) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id"""
