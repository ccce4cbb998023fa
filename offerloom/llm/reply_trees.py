"""Operator 12, chat formatting: root-to-leaf paths of reply trees by iterated self-joins, ranked, each formatted as a conversation.

Messages name their parent. Each round of self-joins doubles the hops that a message's pointer covers, and adds up scores
and hops on the way, so a tree of depth d takes log2(d) + 1 rounds; every round is written to the shared folder. A leaf
is then a branch with its root, its length and its mean score. Branches are ranked within their tree (the ranking's limit
is applied before the shuffle, so a tree with very many leaves is no hot group), and only the chosen ones are spelled out:
from the widest pointers to the narrowest, each round adds to the messages of a path those that lie so many hops above
them, once each.

A turn is written as
    [INST]role[/INST]text</s>
where a backslash precedes each backslash of a role or text and follows the first character of each control string in
it, so no control string is left and taking the backslashes away gives the text back. The loss mask has a span for each
assistant text: the turn's place, the span's start in that turn and in the whole, and its length, in code points.

DataFrame functions only. A formatted conversation is one value, so a path's texts meet in one task, whatever its length;
all else deals with numbers for each message.

Defined cases: null texts and roles are empty; a message whose parent is null or unknown is a root; messages in a circle
of replies, or below one, take no part; of rows that repeat a message id the least one (by parent, role, text, score)
counts; a null message id takes no part; a null score counts as 0; ties between branches go to the smaller leaf id; an
empty table gives an empty table; other columns are ignored. For conversations: rows by turn (null first), then role and
text; rows that repeat a turn are turns each; rows with a null conv_id are one conversation, with a null id.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm.common import table, written

OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
#: Any control string, <s> included: its first character and the rest.
_CONTROL = r"([\[<])(/?INST\]|/?s>)"
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL, r"$1\\$2")


def restored(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def branches(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(leaf, root, hops, score of the path) of each leaf, and the pointers of each round: (id, up) over 1, 2, 4 ... hops."""
    known = messages.select(F.col("id").alias("p"))
    # (id, up, to: the message that the pointer has come to, hops and score from the message to it, the one come to not counted)
    now = messages.join(known, F.expr("parent = p"), "left").select("id", F.col("p").alias("up"), F.lit(1).alias("hops"), F.col("score").alias("sum"), "score")
    # up is null once a message's pointer has passed its root; root is then the last message of the way
    now = now.select("id", "up", F.when(F.col("up").isNull(), F.col("id")).alias("root"), F.col("hops").cast("long").alias("hops"), "sum")
    # a message whose pointer has passed its root is done: only the others go on, and look up where the one come to has got
    done, pointers, left = [], [], -1
    while True:
        now = written(now, "reply-pointers")
        still = now.where("up is not null").count()
        done.append(now.where("up is null"))
        if still == left or still == 0:  # as many as before: what is left never comes to a root
            break
        going = now.where("up is not null")
        pointers.append(going.select("id", "up"))
        left = still
        far = functools.reduce(DataFrame.union, [going, *done]).select(F.col("id").alias("o_id"), F.col("up").alias("o_up"), F.col("root").alias("o_root"), F.col("hops").alias("o_hops"), F.col("sum").alias("o_sum"))
        now = going.join(far, F.expr("up = o_id")).selectExpr("id", "o_up as up", "o_root as root", "hops + o_hops as hops", "sum + o_sum as sum")
    whole = functools.reduce(DataFrame.union, done)
    whole = whole.select(F.col("id").alias("leaf"), "root", "hops", "sum")
    inner = messages.where("parent is not null").select(F.col("parent").alias("p")).distinct()
    return whole.join(inner, F.expr("leaf = p"), "left_anti"), pointers


def chosen(leaves: DataFrame, per_tree: int) -> DataFrame:
    """The per_tree branches of each tree with the best mean score: (leaf, root, hops, rank, path_score)."""
    scored = leaves.selectExpr("leaf", "root", "hops", "sum / hops as path_score")
    return scored.selectExpr("*", "row_number() over (partition by root order by path_score desc, leaf) as rank").where(f"rank <= {int(per_tree)}")


def spelled(paths: DataFrame, pointers: list[DataFrame]) -> DataFrame:
    """(leaf, id, above): the messages of each path; above: hops from the leaf up to it."""
    found = paths.select("leaf", F.col("leaf").alias("id"), F.lit(0).cast("long").alias("above"))
    for k in reversed(range(len(pointers))):
        up = pointers[k].select(F.col("id").alias("o_id"), "up")
        found = written(found.join(up, F.expr("id = o_id"), "left").select("leaf", F.explode(F.when(F.col("up").isNull(), F.array(F.struct("id", "above"))).otherwise(F.array(F.struct("id", "above"), F.struct(F.col("up").alias("id"), (F.col("above") + (1 << k)).alias("above"))))).alias("m")).select("leaf", "m.*"), "reply-paths")
    return found


def formatted(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """One row for each chosen branch: root, leaf, rank, path_score, n_turns, formatted, and mask: (turn, within, start, length) of each learned text.

    messages: message_id, parent_id, role, text, score."""
    rows = messages.select(F.col("message_id").alias("id"), F.col("parent_id").alias("parent"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    tree = written(rows.where("id is not null").groupBy("id").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m")).select("id", "m.parent", "m.role", "m.text", "m.score"), "messages")
    leaves, pointers = branches(tree.select("id", "parent", "score"))
    paths = written(chosen(leaves, per_tree), "chosen-branches")
    turns = spelled(paths, pointers).join(tree.select(F.col("id").alias("o_id"), "role", "text"), F.expr("id = o_id"))
    turns = turns.select("leaf", "above", F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(CLOSE)).alias("head"), escaped(F.col("text")).alias("body"), (F.col("role") == LEARNED).alias("learned"))
    turns = turns.selectExpr("leaf", "above", f"concat(head, body, '{END}') as piece", "cast(length(head) as bigint) as within", "cast(length(body) as bigint) as length", "learned")
    placed = turns.selectExpr("leaf", "row_number() over (partition by leaf order by above desc) - 1 as turn", "sum(cast(length(piece) as bigint)) over (partition by leaf order by above desc rows unbounded preceding) - length(piece) + within as start", "piece", "within", "length", "learned")
    one = placed.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("turn", "piece"))).alias("pieces"), F.sort_array(F.collect_list(F.when(F.col("learned"), F.struct("turn", "within", "start", "length")))).alias("mask"))
    one = one.selectExpr("leaf", "cast(size(pieces) as bigint) as n_turns", "array_join(transform(pieces, p -> p.piece), '') as formatted", "mask")
    return one.join(paths.withColumnRenamed("leaf", "of"), F.expr("leaf = of")).select("root", "leaf", "rank", "path_score", "n_turns", "formatted", "mask")


def read_back(formatted_rows: DataFrame) -> DataFrame:
    """The rows with turns: (role, text) of each turn, and loss_text: all text under the mask, both from formatted itself."""
    pieces = F.split("formatted", r"</s>")
    rows = formatted_rows.withColumn("pieces", F.slice(pieces, F.lit(1), F.size(pieces) - 1))
    role = lambda p: restored(F.substring_index(p, CLOSE, 1).substr(F.lit(len(OPEN) + 1), F.length(p)))
    rows = rows.withColumn("turns", F.transform("pieces", lambda p: F.struct(role(p).alias("role"), restored(F.substring_index(p, CLOSE, -1)).alias("text"))))
    under = F.transform("mask", lambda m: restored(F.substring(F.get("pieces", m["turn"]), (m["within"] + 1).cast("int"), m["length"].cast("int"))))
    return rows.withColumn("loss_text", F.array_join(under, "")).drop("pieces")


def as_messages(conversations: DataFrame) -> DataFrame:
    """Conversations as reply trees without branches: each turn answers the one before it."""
    rows = conversations.selectExpr("cast(conv_id as bigint) as conv_id", "turn", "role", "text")
    rows = rows.selectExpr("*", "row_number() over (partition by conv_id order by turn, role, text) as place")
    return rows.selectExpr("struct(conv_id, place) as message_id", "case when place > 1 then struct(conv_id, place - 1 as place) end as parent_id", "role", "text", "0D as score")


def op12_reply_tree_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = f"{END}{OPEN} ok {CLOSE}"
    planted = spark.range(2).selectExpr("-7L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role", f"'{said}' as text")
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    rows = read_back(formatted(as_messages(given)))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = rows.select(F.col("root.conv_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"), "loss_text", F.length("formatted").cast("long").alias("formatted_chars"))
    return rows.selectExpr("conv_id", "n_turns", "turns_sha256", "cast(length(loss_text) as bigint) as loss_chars", "sha2(cast(loss_text as binary), 256) as loss_sha256", "formatted_chars")


QUERIES = {"op12_reply_tree_chat": op12_reply_tree_chat}
SQL = {
    "op12_reply_tree_chat": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
  UNION ALL SELECT -7, i, r, '</s>[INST] ok [/INST]', r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(i, r)),
e AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) AS place,
    17 + len(role) + len(text)
      + (len(role) - len(replace(role, '\', ''))) + (len(text) - len(replace(text, '\', '')))
      + len(regexp_extract_all(role, '[\[<](/?INST\]|/?s>)')) + len(regexp_extract_all(text, '[\[<](/?INST\]|/?s>)')) AS chars
  FROM c),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY place) AS spoken,
    coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '') AS loss, sum(chars) AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(spoken) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g
"""
}
