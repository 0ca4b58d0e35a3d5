"""Preference formatting: a shared prompt once, and two completions with loss masks.

Chosen and rejected conversations are arrays of turns in one row each. Their longest common prefix
of turns is the prompt; what follows on either side is rendered as a completion, with the spans of
characters that a model should learn: what assistants say there, with the mark that ends a turn.
All of it is DataFrame functions; a task holds one pair at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Template: a turn is HEAD, its role, MIDDLE, its text, END.
HEAD, MIDDLE, END = "<|", "|>\n", "<|end|>\n"
ASSISTANT = "assistant"
UNKNOWN = "unknown"


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, turns)``: one row for each conversation, with its turns (role, text) in order.

    A null turn comes first; turns with the same number go by role and text, nulls first; repeated
    rows are repeated turns. Turns without an id belong together with nothing: each is a conversation
    of its own, with a null id, and isn't moved. An empty table gives no rows. A task holds one
    conversation at a time, with texts of any length.
    """
    made = turns.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).alias("t"))
    plain = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    known = made.where("conv_id is not null").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), plain).alias("turns"))
    return known.unionByName(made.where("conv_id is null").select("conv_id", F.array(plain(F.col("t"))).alias("turns")))


def _clean(turns: Column) -> Column:
    """Null roles and texts filled; marks of the template in a text made harmless."""
    safe = lambda x, other: F.replace(F.coalesce(x, F.lit(other)), F.lit(HEAD), F.lit("< |"))
    return F.transform(F.coalesce(turns, F.array().cast("array<struct<role:string,text:string>>")), lambda t: F.struct(safe(t["role"], UNKNOWN).alias("role"), safe(t["text"], "").alias("text")))


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(HEAD), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(END))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _spans(turns: Column, base: Column) -> Column:
    """Spans [start, end) of code points that assistants say, from ``base`` on."""
    start = F.struct(base.cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(F.concat(F.lit(HEAD), t["role"], F.lit(MIDDLE)))
        end = acc["at"] + F.length(_rendered(t))
        said = F.array(F.struct(begin.cast("long").alias("start"), (end - (len(END) - len(END.rstrip()))).cast("long").alias("end")))
        return F.struct(end.cast("long").alias("at"), F.when(t["role"] == ASSISTANT, F.concat(acc["spans"], said)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def preference_format(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected", keep: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """The columns ``keep`` of ``pairs``, a prompt, two completions and what of them is learned.

    ``chosen`` and ``rejected``: arrays of (role, text). ``prompt_turns``: turns that both begin
    with; ``prompt``, ``chosen``, ``rejected``: rendered text, so that prompt + completion is the
    whole conversation; ``chosen_spans``, ``rejected_spans``: code points [start, end) of prompt +
    completion that count for the loss; nothing of the prompt does. ``tied``: both sides are equal,
    so there is nothing to prefer.

    A null side has no turns; a null role is "unknown" and a null text empty; template marks in
    texts are broken up, so no text can end its turn. Turns are compared in that form. Texts of any
    length are rendered whole. One row for each row of ``pairs``, repeated ones too; an empty table
    gives no rows; other columns may have any names.
    """
    rows = pairs.select(*keep, _clean(F.col(chosen)).alias("__c"), _clean(F.col(rejected)).alias("__r"))
    both = F.least(F.size("__c"), F.size("__r"))
    differ = F.filter(F.sequence(F.lit(0), both), lambda i: (i == both) | ~F.get(F.col("__c"), i).eqNullSafe(F.get(F.col("__r"), i)))
    rows = rows.withColumn("__n", F.array_min(differ))
    rest = lambda side: F.slice(F.col(side), F.col("__n") + 1, F.greatest(F.size(side) - F.col("__n"), F.lit(0)))
    rows = rows.select(*keep, F.col("__n").alias("prompt_turns"), _joined(F.slice(F.col("__c"), F.lit(1), F.col("__n"))).alias("prompt"), rest("__c").alias("__c"), rest("__r").alias("__r"))
    at = F.length("prompt")
    return rows.select(
        *keep, "prompt_turns", "prompt", _joined(F.col("__c")).alias("chosen"), _joined(F.col("__r")).alias("rejected"),
        _spans(F.col("__c"), at).alias("chosen_spans"), _spans(F.col("__r"), at).alias("rejected_spans"), ((F.size("__c") == 0) & (F.size("__r") == 0)).alias("tied"),
    )


#: Ids that a reply for the rejected side is looked for in: one row of the table of such neighbours.
NEIGHBOURS = 64


def with_other_reply(convs: DataFrame) -> DataFrame:
    """``(conv_id, chosen, rejected)``: each conversation, and itself with another's last reply.

    The rejected side ends where the last assistant turn stands, with the last assistant turn of the
    next conversation that has one in its place: by id among those whose ids are the same divided by
    ``NEIGHBOURS``, the first of them after the last. With none there, or without an id, it ends
    with nothing in its place. A conversation without an assistant turn is the same on both sides.
    ``conv_id`` is a number and names one conversation. For tables of single conversations, to have
    pairs that share a prompt.
    """
    place = F.array_max(F.transform(F.col("turns"), lambda t, i: F.when(t["role"] == ASSISTANT, i + 1)))
    marked = convs.select("conv_id", "turns", place.alias("place"), F.get(F.col("turns"), place - 1)["text"].alias("reply"))
    none = F.array().cast("array<struct<role:string,text:string>>")
    has = F.col("place").isNotNull() & F.col("conv_id").isNotNull()
    near = Window.partitionBy(F.floor(F.col("conv_id") / NEIGHBOURS)).orderBy("conv_id")
    said = lambda text: F.array(F.struct(F.lit(ASSISTANT).alias("role"), text.alias("text")))
    # Replies as arrays, so that a null text is told from no reply.
    first = F.first("said").over(near.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    alone = F.count(F.lit(1)).over(near.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) == 1
    paired = marked.where(has).withColumn("said", said(F.col("reply"))).withColumn("other", F.when(~alone, F.coalesce(F.lead("said").over(near), first)))
    rest = marked.where(~has).withColumns({"said": none, "other": none})
    rejected = F.when(F.col("place").isNull(), F.col("turns")).otherwise(F.concat(F.slice(F.col("turns"), F.lit(1), F.col("place") - 1), F.coalesce("other", none)))
    return paired.unionByName(rest).select("conv_id", F.col("turns").alias("chosen"), rejected.alias("rejected"))


#: The rows of op6 over ``conversations`` in DuckDB SQL.
SQL = """
WITH named AS (SELECT conv_id AS id, coalesce(conv_id::VARCHAR, 'none ' || row_number() OVER ()) AS conv_id, turn, role, text FROM conversations),
t AS (SELECT id, conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, replace(coalesce(role, 'unknown'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM named),
place AS (SELECT conv_id, min(id) AS id, max(i) AS n, max(CASE WHEN role = 'assistant' THEN i END) AS p FROM t GROUP BY conv_id),
reply AS (SELECT t.conv_id, t.id, t.text FROM t JOIN place ON t.conv_id = place.conv_id AND t.i = place.p WHERE t.id IS NOT NULL),
other AS (SELECT conv_id, count(*) OVER w AS n, coalesce(lead(text) OVER o, first_value(text) OVER o) AS text FROM reply WINDOW w AS (PARTITION BY floor(id / 64.0)), o AS (PARTITION BY floor(id / 64.0) ORDER BY id)),
r AS (SELECT t.conv_id, t.i, t.role, t.text FROM t JOIN place USING (conv_id) WHERE p IS NULL OR t.i < p
      UNION ALL SELECT conv_id, p, 'assistant', other.text FROM place JOIN other USING (conv_id) WHERE other.n > 1),
sides AS (SELECT coalesce(t.conv_id, r.conv_id) AS conv_id, coalesce(t.i, r.i) AS i, t.role AS cr, t.text AS ct, r.role AS rr, r.text AS rt,
          t.role IS DISTINCT FROM r.role OR t.text IS DISTINCT FROM r.text AS differs FROM t FULL JOIN r ON t.conv_id = r.conv_id AND t.i = r.i),
cut AS (SELECT conv_id, coalesce(min(CASE WHEN differs THEN i END) - 1, max(i)) AS k FROM sides GROUP BY conv_id),
text AS (SELECT conv_id, k,
  coalesce(string_agg(CASE WHEN i <= k THEN '<|' || cr || '|>' || chr(10) || ct || '<|end|>' || chr(10) END, '' ORDER BY i), '') AS prompt,
  coalesce(string_agg(CASE WHEN i > k AND cr IS NOT NULL THEN '<|' || cr || '|>' || chr(10) || ct || '<|end|>' || chr(10) END, '' ORDER BY i), '') AS chosen,
  coalesce(string_agg(CASE WHEN i > k AND rr IS NOT NULL THEN '<|' || rr || '|>' || chr(10) || rt || '<|end|>' || chr(10) END, '' ORDER BY i), '') AS rejected,
  coalesce(sum(CASE WHEN i > k AND cr = 'assistant' THEN length(ct) + 7 END), 0)::BIGINT AS chosen_learned,
  coalesce(sum(CASE WHEN i > k AND rr = 'assistant' THEN length(rt) + 7 END), 0)::BIGINT AS rejected_learned,
  bool_and(i <= k) AS tied FROM sides JOIN cut USING (conv_id) GROUP BY conv_id, k)
SELECT try_cast(conv_id AS BIGINT) AS conv_id, k::INTEGER AS prompt_turns, length(prompt)::INTEGER AS prompt_chars, sha256(prompt) AS prompt_sha256, sha256(chosen) AS chosen_sha256, sha256(rejected) AS rejected_sha256, chosen_learned, rejected_learned, tied FROM text"""
