"""Conversation queries over ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from cedarlog.operators import chat as c
from cedarlog.registry.base import query
from cedarlog.sources import feed

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _conv(spark, d):
    return feed.table(spark, d, "conversations")


@query("session_history", "SELECT turn, role, text FROM conversations WHERE conv_id = 7 ORDER BY turn")
def session_history(spark, d):
    return c.session_history(_conv(spark, d), 7, "conv_id", "turn").select("turn", "role", "text")


def _last(n: int) -> str:
    return f"""SELECT conv_id, turn, role, text FROM conversations
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= {n}"""


@query("last_messages", _last(10))
def last_messages(spark, d):
    return c.last_messages(_conv(spark, d), "conv_id", "turn").select("conv_id", "turn", "role", "text")


@query("last_three_messages", _last(3))
def last_three_messages(spark, d):
    return c.last_messages(_conv(spark, d), "conv_id", "turn", 3).select("conv_id", "turn", "role", "text")


_TRANSCRIPT = f"""SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User' ELSE 'AI' END || ': ' || text
    || chr(10), '' ORDER BY turn) AS transcript FROM ({_last(10)}) GROUP BY conv_id"""


@query("transcript", _TRANSCRIPT)
def transcript(spark, d):
    return c.transcripts(_conv(spark, d), "conv_id", "turn", content="text")


@query(
    "prompt_table",
    f"""WITH q AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
    h AS (SELECT q.conv_id, q.turn, p.text, p.role FROM q LEFT JOIN conversations p
          ON p.conv_id = q.conv_id AND p.turn = q.turn - 1)
    SELECT q.conv_id, q.turn, 'History:' || chr(10) || CASE WHEN h.text IS NULL OR h.text = '' THEN 'No previous history.'
      ELSE CASE h.role WHEN 'user' THEN 'User' ELSE 'AI' END || ': ' || h.text || chr(10) END
      || chr(10) || chr(10) || 'Context:' || chr(10) || 'turn ' || q.turn || chr(10) || chr(10)
      || 'Question:' || chr(10) || q.text || chr(10) AS prompt
    FROM q JOIN h ON h.conv_id = q.conv_id AND h.turn = q.turn""",
)
def prompt_table(spark, d):
    """Each user message with the message before it as history."""
    conv = _conv(spark, d)
    before = conv.select(
        "conv_id", (F.col("turn") + 1).alias("turn"),
        c.speaker_line(F.col("role"), F.col("text")).alias("history"),
    )
    asked = conv.filter(F.col("role") == "user").join(before, ["conv_id", "turn"], "left")
    context = F.concat(F.lit("turn "), F.col("turn").cast("string"))
    return asked.select(
        "conv_id", "turn", c.fill_prompt(F.col("text"), context, F.col("history")).alias("prompt")
    )


_INTENT = """CASE WHEN regexp_matches(lower(text), '{kw}') THEN 'knowledge_query'
    WHEN regexp_matches(lower(text), '{dw}') THEN 'data_query' ELSE 'unknown' END""".format(
    kw="|".join(c.KNOWLEDGE_WORDS), dw="|".join(c.DATA_WORDS)
)


@query("keyword_intent", f"SELECT conv_id, turn, {_INTENT} AS intent FROM conversations WHERE role = 'user'")
def keyword_intent(spark, d):
    asked = _conv(spark, d).filter(F.col("role") == "user")
    return asked.select("conv_id", "turn", c.keyword_intent(F.col("text")).alias("intent"))


@query(
    "tool_route",
    f"""WITH t AS (SELECT doc_id, {_INTENT} AS intent FROM documents)
    SELECT doc_id, intent, CASE intent WHEN 'data_query' THEN 'SQLGenerator' WHEN 'knowledge_query' THEN 'RAGRetriever' END AS tool,
    CASE WHEN intent = 'unknown' THEN {_quote(c.NOT_UNDERSTOOD)} END AS message FROM t""",
)
def tool_route(spark, d):
    return c.route(feed.table(spark, d, "documents"), "text").select("doc_id", "intent", "tool", "message")


_LABEL = "CASE role WHEN 'user' THEN ' SQL ' WHEN 'assistant' THEN chr(10) || 'Rag' ELSE role || ' ' END"


@query(
    "label_normalise",
    """SELECT conv_id, turn, CASE role WHEN 'user' THEN 'sql' WHEN 'assistant' THEN 'rag' ELSE 'ambiguous' END AS label,
    CASE role WHEN 'user' THEN 'generate_sql' WHEN 'assistant' THEN 'retrieve_context' ELSE 'synthesize_answer' END AS step
    FROM conversations""",
)
def label_normalise(spark, d):
    raw = (
        F.when(F.col("role") == "user", " SQL ")
        .when(F.col("role") == "assistant", "\nRag")
        .otherwise(F.concat("role", F.lit(" ")))
    )
    return _conv(spark, d).withColumn("label", c.normal_label(raw)).select(
        "conv_id", "turn", "label", c.next_step(F.col("label")).alias("step")
    )


@query("prefix_cleanup", f"SELECT conv_id, turn, {_STRIP.format('text')} AS question FROM conversations")
def prefix_cleanup(spark, d):
    raw = (
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("  rewritten QUERY:  "), "text", F.lit("\n")))
        .when(F.col("turn") % 3 == 1, F.concat(F.lit("Here is the rewritten query:\nQuery: "), "text"))
        .otherwise(F.col("text"))
    )
    return _conv(spark, d).select("conv_id", "turn", c.without_prefixes(raw).alias("question"))


@query(
    "history_shortcut",
    f"""SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'Query: ' || text ELSE {_STRIP.format('text')} END AS question
    FROM conversations WHERE role = 'user'""",
)
def history_shortcut(spark, d):
    """A first message is kept as written; later ones take the cleaned rewrite."""
    asked = _conv(spark, d).filter(F.col("role") == "user")
    text = F.concat(F.lit("Query: "), "text")
    past = F.when(F.col("turn") > 0, "User: earlier\n")
    return asked.select("conv_id", "turn", c.rewritten_or_same(text, past, text).alias("question"))


@query("fence_cleanup", f"SELECT conv_id, turn, {_STRIP.format('text')} AS sql FROM conversations")
def fence_cleanup(spark, d):
    raw = F.concat(F.lit("```sql\n"), "text", F.lit("\n```"))
    return _conv(spark, d).select("conv_id", "turn", c.without_fences(raw).alias("sql"))


@query(
    "answer_context",
    """SELECT conv_id, turn, CASE
      WHEN turn % 3 = 0 AND role = 'system' THEN 'SQL Error: bad turn ' || turn
      WHEN turn % 3 = 0 THEN 'SQL: select ' || turn || chr(10) || 'Result: ' || text
      WHEN turn % 3 = 1 THEN 'Retrieved Context: ' || text ELSE 'Ambiguous intent.' END AS context FROM conversations""",
)
def answer_context(spark, d):
    turn = F.col("turn").cast("string")
    intent = F.when(F.col("turn") % 3 == 0, "sql").when(F.col("turn") % 3 == 1, "rag").otherwise("ambiguous")
    return _conv(spark, d).select(
        "conv_id", "turn",
        c.answer_context(
            intent,
            F.concat(F.lit("select "), turn),
            F.col("text"),
            F.when(F.col("role") == "system", F.concat(F.lit("bad turn "), turn)),
            F.col("text"),
        ).alias("context"),
    )


@query(
    "user_preview",
    """SELECT conv_id, turn, CASE WHEN length(text) > 30 THEN left(text, 30) || '...' ELSE text END AS preview
    FROM conversations WHERE role = 'user'""",
)
def user_preview(spark, d):
    return c.user_previews(_conv(spark, d), content="text").select("conv_id", "turn", "preview")


@query("source_preview", "SELECT doc_id, left(text, 150) || '...' AS preview FROM documents")
def source_preview(spark, d):
    return feed.table(spark, d, "documents").select("doc_id", c.source_preview(F.col("text")).alias("preview"))
