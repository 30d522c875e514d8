"""Chat formatting: a finite-state machine over roles and a declarative template.

Everything is DataFrame functions. A template names the marks of each role and whether
its text counts for the loss. Characters that begin a control string are escaped inside
texts, so no text can imitate a mark and every text can be read back.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineforge.llm.names import free_names

# Escapes, in the order in which they are put in; none introduces a character escaped later.
TEXT_ESCAPES = (("\\", "\\s"), ("<", "\\l"))
NAME_ESCAPES = (*TEXT_ESCAPES, ("|", "\\p"))


@dataclass(frozen=True)
class Template:
    """``open_mark`` role ``name_end`` text ``close_mark`` for each turn; ``learn``: roles whose text has loss."""

    open_mark: str = "<|"
    name_end: str = "|>"
    close_mark: str = "<|end|>"
    learn: tuple[str, ...] = ("assistant",)
    # state -> role -> next state; what is missing is an error, which is never left.
    turns: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "told", "user": "asked"},
            "told": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    final: tuple[str, ...] = ("answered",)

    def __post_init__(self):
        if not (self.open_mark.startswith("<") and self.close_mark.startswith("<") and "|" in self.name_end):
            raise ValueError("marks must begin with '<', and the end of a name hold '|', for escapes to protect them")


def escape(text: Column, pairs=TEXT_ESCAPES) -> Column:
    for plain, coded in pairs:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, pairs=TEXT_ESCAPES) -> Column:
    for plain, coded in reversed(pairs):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def _next_state(template: Template, state: Column, role: Column) -> Column:
    step = F.lit("error")
    for before, moves in template.turns.items():
        for name, after in moves.items():
            step = F.when((state == before) & (role == name), F.lit(after)).otherwise(step)
    return step


def format_chats(
    rows: DataFrame,
    template: Template = Template(),
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per conversation: its formatted segments and what the state machine says.

    Columns: the conversation's id, n_turns, ``segments`` (array of text and loss flag;
    joined they are the formatted text), valid, and error_turn, the number of the first
    row out of order counting from 1 (null if none; one more than n_turns if the end comes
    too early). A conversation out of order is formatted all the same.

    Null texts and roles count as empty. Rows of one turn number are ordered by role and
    text, null turns come first; repeated rows stay. Rows with a null id form one
    conversation. Other columns are ignored, an empty table gives no rows. A conversation
    becomes one string by its nature, so its rows meet in one task.
    """
    (kept_conv,) = free_names(["turns", "n_turns", "segments", "valid", "error_turn"], conv)
    turns = rows.groupBy(rows[conv].alias(kept_conv)).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    rows[turn].alias("at"),
                    F.coalesce(rows[role].cast("string"), F.lit("")).alias("role"),
                    F.coalesce(rows[text].cast("string"), F.lit("")).alias("text"),
                )
            )
        ).alias("turns")
    )
    mark = F.lit

    def segments(t: Column) -> Column:
        def segment(value: Column, loss: Column) -> Column:
            return F.struct(value.alias("text"), loss.alias("loss"))

        opening = F.concat(mark(template.open_mark), escape(t["role"], NAME_ESCAPES), mark(template.name_end))
        return F.array(
            segment(opening, F.lit(False)),
            segment(escape(t["text"]), t["role"].isin(*template.learn)),
            segment(mark(template.close_mark), F.lit(False)),
        )

    walk = F.aggregate(
        "turns",
        F.struct(F.lit("start").alias("state"), F.lit(0).alias("n"), F.lit(0).alias("bad")),
        lambda seen, t: F.struct(
            _next_state(template, seen["state"], t["role"]).alias("state"),
            (seen["n"] + 1).alias("n"),
            F.when(
                (seen["bad"] == 0) & (_next_state(template, seen["state"], t["role"]) == "error"), seen["n"] + 1
            )
            .otherwise(seen["bad"])
            .alias("bad"),
        ),
    )
    n_turns = F.size("turns").cast("long")
    checked = turns.select(
        F.col(kept_conv),
        n_turns.alias("n_turns"),
        F.flatten(F.transform("turns", segments)).alias("segments"),
        walk.alias("walk"),
    )
    ended = F.col("walk.state").isin(*template.final)
    return checked.select(
        kept_conv,
        "n_turns",
        "segments",
        ended.alias("valid"),
        F.when(F.col("walk.bad") > 0, F.col("walk.bad").cast("long")).when(~ended, F.col("n_turns") + 1).alias(
            "error_turn"
        ),
    )


def formatted(segments: str | Column = "segments") -> Column:
    """The formatted text of a conversation."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_turns(text: Column, template: Template = Template()) -> Column:
    """Roles and texts read back from a formatted text."""
    parts = F.split(text, F.lit(_quoted(template.close_mark)), F.lit(-1))
    # What follows the last closing mark is empty.
    turns = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(part: Column) -> Column:
        body = F.substring(part, F.lit(len(template.open_mark) + 1), F.length(part))
        name = F.substring_index(body, template.name_end, 1)
        said = F.substring(body, F.length(name) + 1 + len(template.name_end), F.length(body))
        return F.struct(unescape(name, NAME_ESCAPES).alias("role"), unescape(said).alias("text"))

    return F.transform(turns, turn)


def _quoted(mark: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() else c for c in mark)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, read back from the formatted text and its loss flags."""
    template = Template()
    imitation = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(imitation).alias("text"),
    )
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    chats = format_chats(rows.unionByName(added), template)
    whole = chats.select(
        "conv_id",
        "valid",
        "error_turn",
        formatted().alias("whole"),
        F.array_join(
            F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), ""
        ).alias("learned"),
    )
    turns = read_turns(F.col("whole"), template)
    return whole.select("conv_id", "valid", "error_turn", "learned", "whole", turns.alias("turns")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""),
            256,
        ).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("whole").cast("long").alias("formatted_chars"),
        "valid",
        "error_turn",
    )


# The state machine is told here by which role may follow which; the code walks states.
OP6_SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), numbered AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS from_end
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), judged AS (
  SELECT *, CASE WHEN before IS NULL THEN role IN ('system', 'user')
                 WHEN role = 'user' THEN before IN ('system', 'assistant')
                 WHEN role = 'assistant' THEN before = 'user' ELSE false END AS fits
  FROM numbered
), per AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '') AS learned,
    sum(length(text) + length(regexp_replace(text, '[^<\\\\]', '', 'g')) + length(role) + 11) AS formatted_chars,
    min(CASE WHEN NOT fits THEN k END) AS bad,
    max(CASE WHEN from_end = 1 THEN role END) AS last_role
  FROM judged GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, turns_sha256,
  CAST(length(learned) AS BIGINT) AS loss_chars, sha256(learned) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars,
  bad IS NULL AND last_role = 'assistant' AS valid,
  CAST(CASE WHEN bad IS NOT NULL THEN bad WHEN last_role <> 'assistant' THEN n_turns + 1 END AS BIGINT) AS error_turn
FROM per
"""
