"""Chat formatting by event-sourced reconstruction, in SQL functions only.

A conversation is a log of events: streamed deltas, edits, regenerations. Folding the log in order gives the final
messages, which are rendered with a template whose control strings cannot occur inside a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumispark.llm.common import table

#: Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>"
#: Code points of a streamed delta.
DELTA = 512


def escape(text: Column) -> Column:
    """No "<|" remains: one backslash is put between, after any that are there already; ``unescape`` takes it out again."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    """A role stands on one line: its line feeds become a control string, which ``escape`` keeps out of it."""
    return F.regexp_replace(escape(role), "\n", "<|nl|>")


def _unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"<\|nl\|>", "\n"))


def messages(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, part, role, text) of an event log.

    events: conv_id, turn, part, seq, kind, role, text. (turn, part) names a message; seq orders its events. Kinds:
    ``delta`` appends its text, ``edit`` puts its text in place of what is there, ``regenerate`` empties the message for
    the deltas that follow. So a message is the concatenation from its last edit or regeneration on. Null text appends
    nothing; the role is that of the last event that names one; ties in seq go by kind and text. A message of no text
    stays, as an empty one. Grouping is by message, so a hot conversation is dealt out by its turns.
    """
    keys = ["conv_id", "turn", "part"]
    log = events.select(*keys, F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), "role").alias("e"))
    log = log.groupBy(*keys).agg(F.array_sort(F.collect_list("e")).alias("log"))
    last = F.aggregate(F.transform("log", lambda e, i: F.when(e["kind"] != "delta", i).otherwise(-1)), F.lit(-1), lambda a, x: F.greatest(a, x))
    kept = F.filter("log", lambda e, i: (i >= F.col("last")) & (e["kind"] != "regenerate"))
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    return log.withColumn("last", last).select(
        *keys, F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"), F.array_join(F.transform(kept, lambda e: e["text"]), "").alias("text")
    )


def to_events(rows: DataFrame, delta: int = DELTA, drafts: bool = False) -> DataFrame:
    """Rows of (conv_id, turn, role, text) as a log of streamed deltas. Rows of one turn (repeated ones too) are messages
    of their own, told apart by ``part``, in the order of role and text; null role and text count as empty.

    drafts: the log of a conversation as it came about. By a hash, a third of the messages begin with a draft that is given
    up and regenerated, a third with a wrong beginning that an edit puts right before the deltas go on; events are
    logged latest first. Folding gives the rows' texts again."""
    text = F.coalesce("text", F.lit(""))
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    rows = rows.withColumn("part", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")))
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / delta)), lambda i: F.substring(F.col("text"), (i * delta + 1).cast("int"), F.lit(delta)))
    rows = rows.withColumn("pieces", pieces)
    event = lambda seq, kind, t: F.struct(F.lit(seq).cast("int").alias("seq") if isinstance(seq, int) else seq.cast("int").alias("seq"), F.lit(kind).alias("kind"), t.alias("text"))
    streamed = lambda some, first: F.transform(some, lambda p, i: event(i + first, "delta", p))
    log = streamed(F.col("pieces"), 0)
    if drafts:
        draft, none = F.reverse(F.substring("text", 1, 40)), F.lit(None).cast("string")
        given_up = F.concat(F.array(event(0, "delta", draft), event(1, "delta", F.lit("...")), event(2, "regenerate", none)), streamed(F.col("pieces"), 3))
        rest = F.slice("pieces", F.lit(2), F.size("pieces"))
        put_right = F.concat(F.array(event(0, "delta", draft), event(1, "edit", F.get("pieces", F.lit(0)))), streamed(rest, 2))
        way = F.pmod(F.xxhash64("conv_id", "turn", "part"), F.lit(3))
        log = F.reverse(F.when(way == 0, log).when(way == 1, given_up).otherwise(put_right))
    return rows.select("conv_id", "turn", "part", "role", F.explode(log).alias("e")).select("conv_id", "turn", "part", "role", "e.seq", "e.kind", "e.text")


def render(final: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): the template's text and the (start, length) of what is learnt, in code points.

    Turns go by (turn, part), a null turn first. A null conv_id is a conversation too. Each turn is rendered where it
    lies; only the rendered pieces meet, one row a conversation.
    """
    head = F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n"))
    body, tail = escape(F.col("text")), F.lit(END + "\n")
    turn = final.select("conv_id", "turn", "part", F.concat(head, body, tail).alias("s"), F.length(head).alias("skip"), F.when(F.col("role") == loss_role, F.length(body)).alias("size"))
    order = ["some", "turn", "part", "s", "skip", "size"]
    before = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    turn = turn.withColumn("some", F.col("turn").isNotNull())
    turn = turn.withColumn("at", F.coalesce(F.sum(F.length("s")).over(before), F.lit(0)).cast("int"))
    # the window has dealt and sorted turns by conversation already; running sums, so that many turns cost no more each
    whole = turn.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*order[:3], "at", *order[3:]))).alias("t"))
    learnt = F.filter("t", lambda t: t["size"].isNotNull())
    spans = F.transform(learnt, lambda t: F.struct((t["at"] + t["skip"]).alias("start"), t["size"].alias("length")))
    return whole.select("conv_id", F.array_join(F.transform("t", lambda t: t["s"]), "").alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The (role, text) turns of a rendered conversation, read back from the text alone."""
    pieces = F.filter(F.split(formatted, F.lit(r"<\|im_start\|>"), -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        at = F.instr(p, "\n")
        body = F.substring(p, at + 1, F.length(p) - at - len(END) - 1)
        return F.struct(_unescape_role(F.substring(p, F.lit(1), at - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit(END + START + "assistant ok")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    out = render(messages(to_events(rows.unionByName(extra), drafts=True)))
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learnt = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return (
        out.withColumn("turns", parse(F.col("formatted")))
        .withColumn("learnt", learnt)
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(turns, "").cast("binary"), 256).alias("turns_sha256"),
            F.length("learnt").cast("long").alias("loss_chars"),
            F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


_ESCAPED = r"regexp_replace({c}, '<(\\*)\|', '<\\\1|', 'g')"
#: The same from the table itself, without a log: turns in order, control strings escaped.
SQL_CHAT = f"""
WITH said AS (SELECT '{END}{START}assistant ok' AS s),
turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', s FROM said UNION ALL SELECT -1, 1, 'assistant', s FROM said),
escaped AS (
  SELECT *, replace({_ESCAPED.format(c="role")}, chr(10), '<|nl|>') AS r, {_ESCAPED.format(c="text")} AS t FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum({len(START)} + length(r) + 1 + length(t) + {len(END)} + 1)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id"""
