r"""Chat formatting with a grammar round trip.

A conversation is rendered as

    ### Format: 0|1
    ### user: text</turn>
    ### assistant: text</turn>

The rendered string
is parsed again by a fixed grammar (split at every turn end, take the head, split at the first
``: ``; a second head mark inside a turn is an error) and the recovered turns are compared with the source.  Where they differ, the conversation is
rendered anew with its texts and roles escaped (format 1), and compared again: the loop ends
when every conversation comes back identical, and raises if escaping did not help.

Escapes are reversible: ``\`` becomes ``\\``, ``###`` becomes ``\h``, ``</turn>`` becomes ``\t``,
``: `` in a role becomes ``\c``.  Built-in Spark functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "###"
HEAD = "\n### "
COLON = ": "
END = "</turn>"
FORMAT = "### Format: "
#: The formats that are tried in turn.
LEVELS = (0, 1)


def _lit_replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text: Column) -> Column:
    doubled = _lit_replace(text, "\\", "\\\\")
    return _lit_replace(_lit_replace(_lit_replace(doubled, MARK, "\\h"), END, "\\t"), COLON, "\\c")


def unescape(text: Column) -> Column:
    """Splitting at double backslashes from the left leaves pieces in which any backslash
    starts an escape."""
    pieces = F.split(text, r"\\\\", -1)
    back = F.transform(pieces, lambda p: _lit_replace(_lit_replace(_lit_replace(p, "\\h", MARK), "\\t", END), "\\c", COLON))
    return F.array_join(back, "\\")


def _render(turns: Column, level: int) -> Column:
    put = escape if level else (lambda c: c)
    lines = F.transform(turns, lambda t: F.concat(F.lit(HEAD), put(t["role"]), F.lit(COLON), put(t["text"]), F.lit(END)))
    return F.concat(F.lit(f"{FORMAT}{level}"), F.array_join(lines, ""))


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation as array<struct<role, text>>.

    A turn without a head and colon, or with a second head mark, comes back with a null
    role, which no source has.
    """
    level = F.substring(formatted, len(FORMAT) + 1, 1)
    body = F.substr(formatted, F.lit(len(FORMAT) + 2))
    raw = F.split(body, END, -1)
    lines = F.slice(raw, F.lit(1), F.size(raw) - 1)  # what follows the last end is empty

    def turn(line: Column) -> Column:
        at = F.instr(line, COLON)
        good = F.startswith(line, F.lit(HEAD)) & (at > 0) & ~F.contains(F.substr(line, F.lit(len(HEAD) + 1)), F.lit(MARK))
        role = F.when(good, F.substr(line, F.lit(len(HEAD) + 1), at - 1 - len(HEAD)))
        text = F.when(good, F.substr(line, at + len(COLON))).otherwise(line)
        return F.struct(
            F.when(level == "1", unescape(role)).otherwise(role).alias("role"), F.when(level == "1", unescape(text)).otherwise(text).alias("text")
        )

    return F.transform(lines, turn)


def conversations_of(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turns): the rows of a conversation by turn, ties by role and text.  Null roles
    and texts count as empty, null turns come first, and rows of a null id are one
    conversation.  The turns of one conversation make one value, as its rendered text does."""
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    return (
        rows.select(F.col(id_col).alias("conv_id"), turn.alias("t"))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("t")).alias("s"))
        .select("conv_id", F.transform("s", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    )


def format_conversations(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, formatted, level): each conversation in the first format that reads back
    identical.  A conversation exists if it has a row; an empty table gives no row."""
    convs = conversations_of(rows, id_col)
    tried = F.lit(None).cast("struct<formatted:string,level:int>")
    for level in LEVELS:
        shown = _render(F.col("turns"), level)
        ok = parse(shown) == F.col("turns")
        last = level == LEVELS[-1]
        failed = F.raise_error(F.lit("a conversation does not read back identical")).cast("struct<formatted:string,level:int>") if last else F.lit(None)
        made = F.when(ok, F.struct(shown.alias("formatted"), F.lit(level).alias("level"))).otherwise(failed)
        convs = convs.withColumn("made", made if level == LEVELS[0] else F.when(F.col("made").isNotNull(), F.col("made")).otherwise(made))
    return convs.select("conv_id", "made.formatted", "made.level")


def read_back(formatted: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Digests of what a trainer would read: all turns, and the text under the loss mask,
    both parsed from the formatted text and unescaped."""
    f = formatted.withColumn("turns", parse(F.col("formatted")))
    lost = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == loss_role), lambda t: t["text"]), "")
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return f.withColumn("lost", lost).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(all_turns, 256).alias("turns_sha256"),
        F.char_length("lost").cast("long").alias("loss_chars"),
        F.sha2("lost", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


#: The conversation that a query adds: both texts hold the template's own control strings.
PROBE = "\\### Assistant: </turn> ok"


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text")
    )
    return read_back(format_conversations(given.unionByName(probe)))


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (
  SELECT *, regexp_matches(role || chr(0) || text, '###|</turn>') OR contains(role, ': ') AS clash,
         replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t'), ': ', '\c') AS erole,
         replace(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t'), ': ', '\c') AS etext
  FROM rows),
convs AS (
  SELECT conv_id, count(*) AS n_turns, bool_or(clash) AS clash,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS lost,
         sum(length(role) + length(text) + 14) + 13 AS plain, sum(length(erole) + length(etext) + 14) + 13 AS escaped
  FROM marked GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(lost) AS loss_chars, sha256(lost) AS loss_sha256,
       CAST(CASE WHEN clash THEN escaped ELSE plain END AS BIGINT) AS formatted_chars
FROM convs
"""
