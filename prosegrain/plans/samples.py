"""Documents that exercise every rule: each one's whole text under a short Markdown snippet, by its id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SNIPPETS = [
    "The plan is simple — we ship it on Friday and then rest.",
    "The years 2024–2026 were good, and 1,200 – 1,300 people came.",
    "Here a dash – not between numbers – stands alone.",
    "```\na fence — with a dash, robust and seamless\n```\nAfter the fence it is robust.",
    "Inline `code — robust` is not prose, but delve is.",
    "It's not a tool, it's a way of life. This is not just fast but also cheap.",
    "Certainly! I'd be happy to help. Great question. Let me know if you have any questions.",
    "We leverage robust synergies and utilize seamless, best-in-class tools.",
    "I believe this seemed worth flagging, for what it's worth.",
    "I wanted to reach out about the report.\nThe rest follows.",
    "See JIRA-123 and flex-360 and #42. In sprint 7 we met the acceptance criteria.",
    "Per the spec this change adds a column. It now reads well in phase 2.",
    "Well done!! Really! ! 🎉🎉 🚀 and ✨ alone.",
    "We commence the run, perform checks, and it takes approximately two days to indicate success.",
    "Moving forward we circle back, move the needle, and touch base at the end of the day.",
    "Open the valve, if the light is on. Close the door carefully, when it rains. Go on now.",
    "1. Open the lid and then press the key\n2. Close the lid; wait\n3) Rest, then go\n4. Just stop;",
    "- Open the lid and then press the key\n* another item\n+ and also this one",
    "One is here now. Two is here now. Three is here now. Four is here now. Five is here now. Six is here now. Seven is here now.",
    "# Heading with — a dash\n\nTitle\n=====\n\n| a | b — c |\n| - | - |\n\n> quoted robust line",
    "Ask evo-modeler or EVO-B-GATE, not evo-hydra-library.",
    "A mark\u2060\u2060 is hidden here and\u200b\u2060 here.",
    "As an AI I cannot say.\r\nSecond line with robust words.\r\nThird.",
    "~~~\nunclosed fence with robust — words",
]


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def decorated_text(doc_id: Column, text: Column) -> Column:
    snippet = F.element_at(F.array(*[F.lit(s) for s in SNIPPETS]), (F.pmod(doc_id, F.lit(len(SNIPPETS))) + 1).cast("int"))
    return F.concat(snippet, F.lit("\n\n"), F.coalesce(text, F.lit("")))


def decorated(docs: DataFrame) -> DataFrame:
    """(path, text, lang, source) of every document."""
    return docs.select(F.col("doc_id").alias("path"), decorated_text(F.col("doc_id"), F.col("text")).alias("text"), "lang", "source")


DECORATED_SQL = "snippets(k, snippet) AS (VALUES " + ", ".join(f"({k}, {_quoted(s)})" for k, s in enumerate(SNIPPETS)) + f"), decorated AS (SELECT doc_id AS path, snippet || chr(10) || chr(10) || coalesce(text, '') AS text, lang, source FROM documents JOIN snippets ON doc_id % {len(SNIPPETS)} = k)"
