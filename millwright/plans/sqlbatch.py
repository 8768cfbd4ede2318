"""Run a user's SQL text over the registered tables, cut and read by the session's own parser."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Token:
    """A word, sign or literal of Spark's grammar; comments and white space are the hidden ones."""

    kind: int
    hidden: bool
    text: str

    def is_word(self, word: str) -> bool:
        return self.text.upper() == word


def _tokens(spark: SparkSession, text: str) -> list[Token]:
    """``text`` as Spark's lexer reads it: raw strings, hints, nested comments and quoted names included."""
    jvm = spark.sparkContext._jvm
    parser = jvm.org.apache.spark.sql.catalyst.parser
    stream = parser.UpperCaseCharStream(jvm.org.antlr.v4.runtime.CharStreams.fromString(text))
    lexer = parser.SqlBaseLexer(stream)
    lexer.removeErrorListeners()
    found = lexer.getAllTokens()
    tokens, at = [], 0
    for i in range(found.size()):
        token = found.get(i)
        start, end = token.getStartIndex(), token.getStopIndex() + 1
        if start > at:
            raise ValueError(f"the SQL text cannot be read at {text[at:start]!r}")
        tokens.append(Token(token.getType(), token.getChannel() != 0, text[start:end]))
        at = end
    if at < len(text) or (tokens and tokens[-1].text.startswith("/*") and not tokens[-1].text.endswith("*/")):
        raise ValueError("a comment or a literal is not closed")
    return tokens


def _parses(spark: SparkSession, statement: str) -> bool:
    try:
        spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    except Exception:
        return False
    return True


def _is_script(tokens: list[Token]) -> bool:
    """Whether a statement opens a block, ``BEGIN`` or ``label: BEGIN``, which holds semicolons itself."""
    words = [t for t in tokens if not t.hidden][:3]
    return bool(words) and (words[0].is_word("BEGIN") or [t.text.upper() for t in words[1:]] == [":", "BEGIN"])


def split_statements(text: str, fractions_as_double: bool = False, spark: SparkSession | None = None) -> list[str]:
    """Statements of a SQL text, without comments; optimizer hints stay.

    Borders are the semicolons that Spark's lexer sees. A ``BEGIN ... END`` script is one statement: it
    ends where the parser accepts it. With ``fractions_as_double`` a literal like ``1.0`` is read as a
    double, not as a decimal.
    """
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    decimal = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.parser.SqlBaseLexer.DECIMAL_VALUE

    def spelled(token: Token) -> str:
        if token.hidden and token.text.strip():
            return " "  # a comment
        return f"{token.text}D" if fractions_as_double and token.kind == decimal else token.text

    statements: list[str] = []
    current: list[Token] = []
    for token in [*_tokens(spark, text), None]:
        if token is not None and (token.hidden or token.text != ";"):
            current.append(token)
            continue
        statement = "".join(map(spelled, current)).strip()
        if token is not None and _is_script(current) and not _parses(spark, statement):
            current.append(token)  # a semicolon inside the script
            continue
        if statement:
            statements.append(statement)
        current = []
    return statements


def _view_parts(spark: SparkSession, statement: str) -> list[str]:
    """Name parts of the view that a ``CREATE VIEW`` statement makes; empty for all other statements."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    except Exception:
        return []  # Spark says what is wrong when it runs the statement
    if plan.getClass().getSimpleName() != "CreateView":
        return []
    parts = plan.child().nameParts()
    return [parts.apply(i) for i in range(parts.size())]


def _as_temporary(spark: SparkSession, statement: str, name: str) -> str | None:
    """The statement with a temporary view; None if it asks for a view only if there is none, and there is."""
    tokens = _tokens(spark, statement)
    words = [i for i, t in enumerate(tokens) if not t.hidden]
    view = next(n for n, i in enumerate(words) if tokens[i].is_word("VIEW"))
    rest = words[view + 1]
    if [tokens[i].text.upper() for i in words[view + 1 : view + 4]] == ["IF", "NOT", "EXISTS"]:
        if spark.catalog.tableExists(name):
            return None
        rest = words[view + 4]
    head = "".join(t.text for t in tokens[: words[view]])
    return f"{head}TEMPORARY VIEW {''.join(t.text for t in tokens[rest:])}"


def run_sql(spark: SparkSession, text: str, fractions_as_double: bool = False) -> DataFrame:
    """Run every statement of ``text`` and return the result of the last one.

    Statements run as they are written, as in ``spark.sql``. One thing is added: a view with a plain
    name that reads temporary views, such as those of a snapshot, could not be stored, and is made
    temporary instead. A view with a qualified name is always stored under that name.
    """
    statements = split_statements(text.lstrip("﻿"), fractions_as_double, spark)
    if not statements:
        raise ValueError("the SQL text is empty")
    result = None
    for statement in statements:
        parts = _view_parts(spark, statement)
        try:
            result = spark.sql(statement)
        except (AnalysisException, PySparkException) as error:
            if len(parts) != 1 or error.getCondition() != "INVALID_TEMP_OBJ_REFERENCE":
                raise
            temporary = _as_temporary(spark, statement, parts[0])
            result = spark.sql(temporary or "SELECT 1 WHERE FALSE")
    return result
