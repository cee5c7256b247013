r"""Formatting conversations into windows of a token budget, in DataFrame operations only.

Running sums of the turns' tokens cut a conversation into spans of whole turns. A window is a span with the conversation's
system turn before it and a limited history: the turns just before the span, repeated as far as the history budget goes.
Only assistant turns of the span itself are under the loss mask; what is repeated is masked out, so each assistant turn
is a target once.

Template: each turn is `<s>[INST] role [/INST]`, a newline, the text, `</s>` and a newline. In roles and texts a
backslash after the bracket escapes these control strings, and any that are escaped already get one more; that is
undone by taking one away.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST]\n", "</s>\n"
_CONTROL = r"(<|\[)(\\*)(/?s>|/?INST\])"
_ESCAPED = r"(<|\[)\\(\\*)(/?s>|/?INST\])"
#: Tokens of a turn's marks.
MARKS = 8


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, r"$1$2$3")


def count_tokens(text: Column) -> Column:
    """Runs of letters and digits, and other signs one by one: a tokenizer-free estimate. pack() takes any other."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\x20\x09-\x0D\p{L}\p{N}]"))


def windows(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    budget: int = 1024,
    history: int = 256,
    tokens: Callable[[Column], Column] = count_tokens,
) -> DataFrame:
    """One row for each window: conv_id, window, formatted, loss_spans (start, length in code points), n_repeated (turns at
    its head that an earlier window has), n_new, n_tokens.

    The first turn is the system turn if its role is `system`. The spans of a conversation are the cells that its running
    sum passes, of half the room that the system turn and the history leave, so two neighbouring parts always fit; a turn
    longer than that is a span of its own and may exceed the budget, as turns are never cut. Turns are in the order of
    (turn, role, text), nulls first; a null role or text is empty; a null conv_id is a conversation. Repeated rows are
    turns of their own. Further columns are ignored; an empty table gives an empty result.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text"))
    rows = rows.withColumn("cost", (tokens(F.col("text")) + MARKS).cast("long"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("n", F.row_number().over(order))
    is_system = (F.col("n") == 1) & (F.col("role") == "system")
    rows = rows.withColumn("is_system", is_system)
    rows = rows.withColumn("system", F.first(F.when(is_system, F.struct("role", "text", "cost"))).over(upto))
    room = F.floor((F.lit(budget - history) - F.coalesce(F.col("system")["cost"], F.lit(0))) / 2)
    rows = rows.withColumn("room", F.greatest(room, F.lit(1)))
    rows = rows.withColumn("own", F.when(is_system, F.lit(0)).otherwise(F.col("cost")))
    rows = rows.withColumn("end", F.sum("own").over(upto))
    rows = rows.withColumn("large", (~is_system & (F.col("cost") > F.col("room"))).cast("int"))
    cell = F.struct(F.floor((F.col("end") - 1) / F.col("room")).alias("cell"), (2 * F.sum("large").over(upto) - F.col("large")).alias("part"))
    rows = rows.withColumn("cell", F.when(~is_system, cell))
    fresh = ~is_system & F.coalesce(F.lag("cell").over(order) != F.col("cell"), F.lit(True))
    rows = rows.withColumn("fresh", fresh)
    rows = rows.withColumn("span", F.greatest(F.sum(F.col("fresh").cast("int")).over(upto) - 1, F.lit(0)))
    rows = rows.withColumn("begin", F.col("end") - F.col("own"))
    # A turn is history of the spans that begin within the history budget after its own begin.
    near = W.partitionBy("conv_id").orderBy("begin").rangeBetween(1, history)
    rows = rows.withColumn("later", F.when(~is_system, F.collect_list(F.when(F.col("fresh"), F.col("span"))).over(near)))
    later = F.transform(
        F.filter(F.coalesce("later", F.array().cast("array<long>")), lambda s: s > F.col("span")),
        lambda s: F.struct(s.cast("long").alias("window"), F.lit(1).alias("part")),
    )
    places = F.concat(F.array(F.struct(F.col("span").cast("long").alias("window"), F.lit(2).alias("part"))), later)
    placed = rows.select("conv_id", "n", "role", "text", "cost", "system", "is_system", F.explode(places).alias("at"))
    turn = F.struct(F.col("at.part").alias("part"), "n", "role", "text", "cost", "is_system")
    grouped = placed.groupBy("conv_id", F.col("at.window").alias("window")).agg(
        F.sort_array(F.collect_list(turn)).alias("turns"), F.first("system").alias("system")
    )
    again = F.array(F.struct(
        F.lit(0).alias("part"), F.lit(0).alias("n"), F.col("system.role").alias("role"), F.col("system.text").alias("text"),
        F.col("system.cost").alias("cost"), F.lit(True).alias("is_system"),
    ))
    own = F.col("turns")
    grouped = grouped.withColumn("turns", F.when(F.col("system").isNotNull() & (F.col("window") > 0), F.concat(again, own)).otherwise(own))
    piece = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE), escape(t["text"]), F.lit(CLOSE))
    grouped = grouped.withColumn("pieces", F.transform("turns", lambda t: F.struct(
        piece(t).alias("piece"), F.length(escape(t["text"])).alias("chars"), (t["part"] < 2).alias("repeated"),
        ((t["part"] == 2) & (t["role"] == "assistant")).alias("target"),
    )))
    none = F.array().cast("array<struct<start:int,length:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        end = acc["at"] + F.length(p["piece"])
        span = F.struct((end - len(CLOSE) - p["chars"]).alias("start"), p["chars"].alias("length"))
        return F.struct(end.alias("at"), F.when(p["target"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return grouped.select(
        "conv_id",
        "window",
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"),
        F.aggregate("pieces", start, step)["spans"].alias("loss_spans"),
        F.size(F.filter("pieces", lambda p: p["repeated"])).alias("n_repeated"),
        F.size(F.filter("pieces", lambda p: ~p["repeated"])).alias("n_new"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["cost"]).alias("n_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Windows -> conversations, from the formatted text and its mask alone: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars."""
    pieces = F.slice(F.split("formatted", CLOSE), F.col("n_repeated") + 1, F.col("n_new"))
    cut = lambda p: F.locate(MIDDLE, p) if isinstance(p, str) else F.call_function("locate", F.lit(MIDDLE), p)
    role = lambda p: unescape(F.substring(p, F.lit(len(OPEN) + 1), cut(p) - len(OPEN) - 1))
    text = lambda p: unescape(F.substring(p, cut(p) + len(MIDDLE), F.length(p)))
    turns = F.array_join(F.transform(pieces, lambda p: F.concat(role(p), F.lit("\n"), text(p), F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    part = F.struct("window", turns.alias("turns"), loss.alias("loss"))
    whole = formatted.groupBy("conv_id").agg(
        F.sum("n_new").alias("n_turns"), F.sort_array(F.collect_list(part)).alias("parts"), F.sum(F.length("formatted")).alias("formatted_chars")
    )
    joined = lambda name: F.array_join(F.transform("parts", lambda p: p[name]), "")
    whole = whole.withColumn("all_turns", joined("turns")).withColumn("all_loss", joined("loss"))
    return whole.select(
        "conv_id", "n_turns", F.sha2("all_turns", 256).alias("turns_sha256"), F.length("all_loss").cast("long").alias("loss_chars"),
        F.sha2("all_loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and one more, -1, whose texts hold the template's control strings."""
    spark = conversations.sparkSession
    said = "</s>[INST] ok [/INST]"
    rows = conversations.select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(rows.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    return rows.unionByName(probe)


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
  (len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\x20\x09-\x0D\p{L}\p{N}]')) + 8)::BIGINT AS cost,
  length(regexp_replace(role, '(<|\[)(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) + length(regexp_replace(text, '(<|\[)(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) + 24 AS chars FROM c),
s AS (SELECT *, n = 1 AND role = 'system' AS sys FROM r),
a AS (SELECT *, coalesce(max(CASE WHEN sys THEN cost END) OVER p, 0) AS sys_cost, coalesce(max(CASE WHEN sys THEN chars END) OVER p, 0) AS sys_chars,
  CASE WHEN sys THEN 0 ELSE cost END AS own FROM s WINDOW p AS (PARTITION BY conv_id)),
b AS (SELECT *, greatest(floor((1024 - 256 - sys_cost) / 2)::BIGINT, 1) AS room, sum(own) OVER (PARTITION BY conv_id ORDER BY n) AS upto FROM a),
d AS (SELECT *, CASE WHEN NOT sys AND cost > room THEN 1 ELSE 0 END AS large FROM b),
e AS (SELECT *, floor((upto - 1) / room)::BIGINT AS cell, 2 * sum(large) OVER (PARTITION BY conv_id ORDER BY n) - large AS part, upto - own AS start FROM d),
f AS (SELECT *, NOT sys AND coalesce(lag(CASE WHEN sys THEN -1 ELSE cell END) OVER w <> cell OR lag(part) OVER w <> part, true) AS fresh
  FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY n)),
g AS (SELECT *, CASE WHEN sys THEN 0 ELSE
  count(*) FILTER (fresh) OVER (PARTITION BY conv_id ORDER BY start RANGE BETWEEN 1 FOLLOWING AND 256 FOLLOWING) END AS later FROM f)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(CASE WHEN sys THEN chars ELSE chars * (1 + later) END) + max(sys_chars) * greatest(count(*) FILTER (fresh) - 1, 0))::BIGINT AS formatted_chars
FROM g GROUP BY conv_id
"""
