"""Conversation tables: history, transcripts, intent, routing and text cleanup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cedarlog.functions.text import cut, strip

# History length, words of each intent in order, accepted labels, tools, texts.
HISTORY_MESSAGES = 10
KNOWLEDGE_WORDS = ("why", "cause", "fix", "solution", "similar", "root cause")
DATA_WORDS = ("count", "how many", "show", "list", "errors", "fail", "trend")
KNOWLEDGE, DATA, UNKNOWN = "knowledge_query", "data_query", "unknown"
SQL_TOOL, RETRIEVER = "SQLGenerator", "RAGRetriever"
NOT_UNDERSTOOD = (
    "I didn't understand that. Try asking 'How many errors?' or 'Why is payment failing?'"
)
LABELS = ("sql", "rag", "ambiguous")
FALLBACK_LABEL = "ambiguous"
REWRITE_PREFIXES = ("Here is the rewritten query:", "Rewritten query:", "Query:")
FENCES = ("```sql", "```")
NO_HISTORY = "No previous history."
PREVIEW_CHARS, SOURCE_CHARS = 30, 150
USER_LABEL, AI_LABEL = "User", "AI"

PROMPT = "History:\n{chat_history}\n\nContext:\n{context}\n\nQuestion:\n{query}\n"


def session_history(messages: DataFrame, session: str, key: str, order: str) -> DataFrame:
    return messages.filter(F.col(key) == session).orderBy(order)


def last_messages(
    messages: DataFrame, key: str, order: str, n: int = HISTORY_MESSAGES
) -> DataFrame:
    """The last ``n`` messages of every session.

    Spark cuts each session to ``n`` rows per task before the shuffle, so a session that
    holds much of the table does not end up in one task.
    """
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return (
        messages.withColumn("_back", F.row_number().over(w))
        .filter(F.col("_back") <= n)
        .drop("_back")
    )


def speaker_line(role: Column, content: Column) -> Column:
    who = F.when(role == "user", USER_LABEL).otherwise(AI_LABEL)
    return F.concat(who, F.lit(": "), content, F.lit("\n"))


def transcripts(
    messages: DataFrame,
    key: str,
    order: str,
    role: str = "role",
    content: str = "content",
    n: int = HISTORY_MESSAGES,
) -> DataFrame:
    """``key, transcript``: the last ``n`` messages of every session as one text."""
    lines = last_messages(messages, key, order, n).select(
        key, order, speaker_line(F.col(role), F.col(content)).alias("_line")
    )
    return lines.groupBy(key).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(order, "_line"))), lambda x: x["_line"]),
            "",
        ).alias("transcript")
    )


def fill_prompt(query: Column, context: Column, chat_history: Column, text: str = PROMPT) -> Column:
    """Put three values into a text; an empty history has its own wording.

    Built from the text's pieces, so marks inside a value are not filled again.
    """
    values = {
        "{query}": query,
        "{context}": context,
        "{chat_history}": F.when(
            F.coalesce(F.length(chat_history), F.lit(0)) == 0, NO_HISTORY
        ).otherwise(chat_history),
    }
    parts: list[Column] = []
    rest = text
    while rest:
        found = [(rest.index(m), m) for m in values if m in rest]
        if not found:
            parts.append(F.lit(rest))
            break
        at, mark = min(found)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(F.coalesce(values[mark], F.lit("")))
        rest = rest[at + len(mark):]
    return F.concat(*parts)


def _any_word(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def keyword_intent(question: Column) -> Column:
    """Intent by words that occur anywhere in the text; knowledge words are tried first."""
    text = F.lower(question)
    return (
        F.when(_any_word(text, KNOWLEDGE_WORDS), KNOWLEDGE)
        .when(_any_word(text, DATA_WORDS), DATA)
        .otherwise(UNKNOWN)
    )


def tool_of(intent: Column) -> Column:
    return F.when(intent == DATA, SQL_TOOL).when(intent == KNOWLEDGE, RETRIEVER)


def route(questions: DataFrame, question: str = "question") -> DataFrame:
    """Add ``intent``, ``tool`` and, where no tool fits, a ``message``."""
    return (
        questions.withColumn("intent", keyword_intent(F.col(question)))
        .withColumn("tool", tool_of(F.col("intent")))
        .withColumn("message", F.when(F.col("tool").isNull(), NOT_UNDERSTOOD))
    )


def next_step(label: Column) -> Column:
    """Step that follows a label."""
    return (
        F.when(label == "sql", "generate_sql")
        .when(label == "rag", "retrieve_context")
        .otherwise("synthesize_answer")
    )


def normal_label(raw: Column) -> Column:
    label = F.lower(strip(raw))
    return F.when(label.isin(*LABELS), label).otherwise(FALLBACK_LABEL)


def without_prefixes(text: Column) -> Column:
    """A rewritten question without the introductions models like to add."""
    out = strip(text)
    for p in REWRITE_PREFIXES:
        out = F.when(
            F.lower(out).startswith(p.lower()), strip(F.substr(out, F.lit(len(p) + 1)))
        ).otherwise(out)
    return out


def rewritten_or_same(question: Column, transcript: Column, rewritten: Column) -> Column:
    """Without history a question stays as it is; so it does when a rewrite is missing."""
    return F.when(
        F.coalesce(F.length(transcript), F.lit(0)) == 0, question
    ).otherwise(F.coalesce(without_prefixes(rewritten), question))


def without_fences(sql: Column) -> Column:
    out = sql
    for f in FENCES:
        out = F.replace(out, F.lit(f), F.lit(""))
    return strip(out)


def answer_context(
    intent: Column, sql: Column, result: Column, error: Column, retrieved: Column
) -> Column:
    text = lambda c: F.coalesce(c, F.lit("None"))
    return (
        F.when(
            intent == "sql",
            F.when(F.length(error) > 0, F.concat(F.lit("SQL Error: "), error)).otherwise(
                F.concat(F.lit("SQL: "), text(sql), F.lit("\nResult: "), text(result))
            ),
        )
        .when(intent == "rag", F.concat(F.lit("Retrieved Context: "), text(retrieved)))
        .otherwise("Ambiguous intent.")
    )


def user_previews(messages: DataFrame, role: str = "role", content: str = "content") -> DataFrame:
    return messages.filter(F.col(role) == "user").withColumn(
        "preview", cut(F.col(content), PREVIEW_CHARS)
    )


def source_preview(context: Column) -> Column:
    return F.concat(F.left(context, F.lit(SOURCE_CHARS)), F.lit("..."))
