r"""Chat formatting as a grammar round trip, in DataFrame functions only.

Grammar of a formatted conversation (no text of the source can look like its marks):

    conversation := turn*
    turn         := "<s>" body "</s>"            (role "assistant": its text is under the loss mask)
                  | "[INST]" body "[/INST]"      (any other role)
    body         := role "\n" text
    escapes      := "\" x stands for x; a role's own line feed is written "\" line feed

Each turn is rendered plainly first and parsed again. Where the parser doesn't give back the same role and text, or they
hold a mark, the turn is escaped: every "\" is doubled and every mark gets a "\" behind its first character. The whole
conversation is then parsed again; if it still differs from its source all its turns are escaped, and if it differs even
then the query fails rather than return a wrong row.

Defined cases: null text and null role are empty; turns are ordered by turn, role, text (nulls first), so ties and repeated
rows each stay a turn of their own; rows with a null conv_id form one conversation; other columns are ignored; an empty
table gives an empty result. All turns of one conversation meet in one row because its hashes run over all of them in
order; that is the only grouping, and different conversations never meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARKS = r"\[/?INST\]|</?s>"
TURN = r"(?s)\[INST\].*?\[/INST\]|<s>.*?</s>"
ROLE = r"(?s)^([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n"


def _unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def _escape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), r"([\[<])(/?(?:INST\]|s>))", r"$1\\$2")


def _wrap(role: Column, body_role: Column, body_text: Column) -> Column:
    talk = role == "assistant"
    return F.concat(F.when(talk, "<s>").otherwise("[INST]"), body_role, F.lit("\n"), body_text, F.when(talk, "</s>").otherwise("[/INST]"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""

    def turn(part: Column) -> Column:
        talk = part.startswith("<s>")
        body = F.substr(part, F.when(talk, 4).otherwise(7), F.length(part) - F.when(talk, 7).otherwise(13))
        role = F.regexp_extract(body, ROLE, 1)
        return F.struct(_unescape(role).alias("role"), _unescape(F.substr(body, F.length(role) + 2)).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), turn)


def format_chats(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) to (conv_id, formatted, turns): the text, and what its parser reads back from it."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    role, text = F.col("role"), F.col("text")
    rows = rows.withColumns({
        "plain": _wrap(role, role, text),
        "escaped": _wrap(role, F.regexp_replace(_escape(role), "\n", "\\\\\n"), _escape(text)),
    })
    same = (parse(F.col("plain")) == F.array(F.struct(role, text))) & ~role.rlike(MARKS) & ~text.rlike(MARKS)
    rows = rows.select("conv_id", F.struct("turn", "role", "text", F.when(same, F.col("plain")).otherwise(F.col("escaped")).alias("part"), "escaped").alias("t"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    source = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    convs = convs.withColumn("formatted", F.array_join(F.transform("t", lambda x: x["part"]), ""))
    convs = convs.withColumn("formatted", F.when(parse(F.col("formatted")) == source, F.col("formatted")).otherwise(F.array_join(F.transform("t", lambda x: x["escaped"]), "")))
    convs = convs.withColumn("turns", parse(F.col("formatted")))
    wrong = F.raise_error(F.concat(F.lit("no round trip for conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    return convs.select("conv_id", "formatted", F.when(F.col("turns") == source, F.col("turns")).otherwise(wrong.cast(convs.schema["turns"].dataType)).alias("turns"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    done = format_chats(turns.unionByName(probe))
    masked = F.array_join(F.transform(F.filter("turns", lambda x: x["role"] == "assistant"), lambda x: x["text"]), "")
    done = done.withColumn("masked", masked)
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (
  SELECT *, CASE WHEN role = 'assistant' THEN 8 ELSE 14 END + length(role) + length(text) AS plain,
    regexp_matches(role, '\[/?INST\]|</?s>|\\|\n') OR regexp_matches(text, '\[/?INST\]|</?s>')
      OR regexp_replace(text, '(?s)\\(.)', '\1', 'g') <> text AS odd,
    length(regexp_replace(role || text, '[^\\]', '', 'g')) + len(regexp_extract_all(role, '\n'))
      + len(regexp_extract_all(role, '\[/?INST\]|</?s>')) + len(regexp_extract_all(text, '\[/?INST\]|</?s>')) AS added
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(plain + CASE WHEN odd THEN added ELSE 0 END)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
