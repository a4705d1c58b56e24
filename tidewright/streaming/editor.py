"""The editor protocol as a stream: messages to document state to published diagnostics.

Messages are JSON rows. State is one document a uri, kept by Spark (see ``state``); what comes out is the text to lint, which a batch of the lint
plan then reads (see ``publish``).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import language_of
from ..plans import engine, reports
from .state import documents, session_messages

MESSAGE = (
    "jsonrpc string, id string, method string, params struct<textDocument: struct<uri: string, languageId: string, version: int, text: string>, "
    "contentChanges: array<struct<range: struct<start: struct<line: int, character: int>, `end`: struct<line: int, character: int>>, text: string>>, "
    "position: struct<line: int, character: int>>"
)
OPEN, CHANGE, CLOSE = "textDocument/didOpen", "textDocument/didChange", "textDocument/didClose"
#: Methods answered, and the protocol's error codes.
REQUESTS = ("initialize", "shutdown", "textDocument/codeAction", "textDocument/hover", "textDocument/completion", "textDocument/formatting")
DOCUMENT_REQUESTS = ("textDocument/codeAction", "textDocument/hover", "textDocument/completion", "textDocument/formatting")
NOTES = ("initialized", "exit", OPEN, CHANGE, CLOSE)
PARSE_ERROR, INVALID_REQUEST, METHOD_NOT_FOUND, NOT_INITIALIZED, INTERNAL_ERROR = -32700, -32600, -32601, -32002, -32603
ERRORS = {PARSE_ERROR: "Parse error", INVALID_REQUEST: "Invalid Request", METHOD_NOT_FOUND: "Method not found", NOT_INITIALIZED: "Server not initialized", INTERNAL_ERROR: "Internal error"}


def messages(raw: DataFrame, column: str = "value", keep: tuple[str, ...] = (), told: str | None = None) -> DataFrame:
    """seq, the columns ``keep`` and the message's fields; ``error`` is the protocol's code where a row is none or has no known method, or where the column
    ``told`` has one already. A request of a document that names none can't be handled and is an internal error.

    Unknown notifications (no id) are passed over, as the protocol asks.
    """
    m = F.from_json(F.col(column), MESSAGE)
    read = raw.withColumn("_m", m).withColumn("_ok", F.try_parse_json(column).isNotNull())
    known = F.col("_m.method").isin(*REQUESTS, *NOTES)
    error = F.when(~F.col("_ok"), PARSE_ERROR).when(F.col("_m.method").isNull(), INVALID_REQUEST).when(~known & F.col("_m.id").isNotNull(), METHOD_NOT_FOUND)
    of_document = F.col("_m.method").isin(*DOCUMENT_REQUESTS) & F.col("_m.id").isNotNull() & F.col("_m.params.textDocument.uri").isNull()
    error = F.coalesce(F.col(told) if told else F.lit(None).cast("int"), error, F.when(of_document, INTERNAL_ERROR))
    return read.select("seq", *keep, "_m.id", "_m.method", "_m.params", error.alias("error"))


def gated(read: DataFrame, session: str) -> DataFrame:
    """Messages (session, seq, ...) of a batch, requests before their session's initialize marked as an error; notifications
    before it go, but for exit. One window a session."""
    from pyspark.sql import Window

    hello = F.min(F.when((F.col("method") == "initialize") & F.col("error").isNull(), F.col("seq"))).over(Window.partitionBy(session))
    early = F.coalesce(F.col("seq") < F.col("_hello"), F.lit(True)) & F.col("method").isNotNull() & (F.col("method") != "initialize")
    rows = read.withColumn("_hello", hello).withColumn("_early", early)
    rows = rows.where(~F.col("_early") | F.col("id").isNotNull() | (F.col("method") == "exit"))
    return rows.withColumn("error", F.when(F.col("_early") & F.col("id").isNotNull(), NOT_INITIALIZED).otherwise(F.col("error"))).drop("_hello", "_early")


def frame_of(body: Column) -> Column:
    """A message as it goes over a pipe: its length in bytes, an empty line, itself."""
    return F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body)


def body_of(frame: Column) -> Column:
    """The message of one frame (header lines in any order, ends of line with or without a return); null without a length or with fewer bytes."""
    head = F.regexp_extract(frame, r"(?s)^(.*?\r?\n)\r?\n", 1)
    length = F.regexp_extract(head, r"(?m)^Content-Length: ([0-9]+)", 1).try_cast("int")
    rest = F.encode(F.regexp_replace(frame, r"(?s)^.*?\r?\n\r?\n", ""), "UTF-8")
    return F.when((length > 0) & (F.octet_length(rest) >= length), F.decode(F.substring(rest, F.lit(1), length), "UTF-8"))


def offset_of(text: str, line: int, character: int) -> int:
    """The place of a line and a character in it, both from 0; characters past the line's end stop there."""
    at = 0
    for _ in range(line):
        cut = text.find("\n", at)
        if cut < 0:
            return len(text)
        at = cut + 1
    end = text.find("\n", at)
    return min(at + character, len(text) if end < 0 else end)


def changed(text: str, change: dict) -> str:
    """The text after one edit; an edit without a range replaces all."""
    span = change.get("range")
    if not span:
        return change["text"]
    start, end = (offset_of(text, span[k]["line"], span[k]["character"]) for k in ("start", "end"))
    return text[:start] + change["text"] + text[end:]


def apply_message(state: tuple[str, str, int] | None, method: str, document: dict, changes: list[dict]) -> tuple[str, str, int] | None:
    """(text, language, version) of a document after a message; None: not open. Edits of unknown documents are passed over."""
    if method == OPEN:
        return document.get("text") or "", document.get("languageId") or "", document.get("version") or 0
    if method == CLOSE or state is None:
        return None
    text = state[0]
    for change in changes or []:
        text = changed(text, change)
    return text, state[1], document.get("version") or 0


def _edits(messages_df: DataFrame) -> DataFrame:
    return messages_df.where(F.col("method").isin(OPEN, CHANGE, CLOSE)).select(
        F.col("params.textDocument.uri").alias("uri"), "seq", "method",
        F.to_json("params.textDocument").alias("document"), F.to_json("params.contentChanges").alias("changes"),
    ).where("uri is not null")


def document_states(messages_df: DataFrame, quiet_ms: int = 0) -> DataFrame:
    """(uri, version, text, open) of every document that messages touch, its latest version once it was left alone for quiet_ms; closed ones come
    once, with empty text. See state.documents."""
    return documents(_edits(messages_df), quiet_ms)


def sources_of(states: DataFrame) -> DataFrame:
    return states.where("open").select(F.col("uri").alias("file"), F.col("text").alias("source"), language_of(F.col("uri")).alias("language"))


def publish(states: DataFrame, config: engine.Config | None = None) -> DataFrame:
    """(uri, message): a publishDiagnostics message a document; closed and clean ones publish an empty list.

    For a batch of states, as foreachBatch hands over.
    """
    found = reports.by_file(engine.lint(sources_of(states), config), reports.editor_record()).withColumnRenamed("file", "uri")
    rows = states.join(found, "uri", "left")
    none = F.from_json(F.lit("[]"), found.schema["records"].dataType)
    params = F.struct("uri", "version", F.coalesce("records", none).alias("diagnostics"))
    return rows.select("uri", F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), F.lit("textDocument/publishDiagnostics").alias("method"), params.alias("params"))).alias("message"))


def start(raw_stream: DataFrame, sink, checkpoint: str, config: engine.Config | None = None, quiet_ms: int = 0, **trigger):
    """Run the stream of messages (seq, value): ``sink(df, batch_id)`` gets the messages to publish. Returns the query."""

    def batch(states: DataFrame, batch_id: int) -> None:
        sink(publish(states, config), batch_id)

    writer = document_states(messages(raw_stream), quiet_ms).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(**trigger) if trigger else writer).start()


def start_sessions(chunks: DataFrame, folder: str, sink, checkpoint: str, **trigger):
    """Run the stream of bytes (session, seq, chunk): messages that pass the gate are written below ``folder`` as Parquet (seq, value), for start to read, and
    ``sink(df, batch_id)`` gets (session, n, id, reply). Returns the query."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        read = messages(rows.withColumnRenamed("n", "seq"), keep=("session",), told="error")
        kept = rows.where("error is null").select((F.lit(batch_id).cast("long") * (1 << 40) + F.col("n")).alias("seq"), "value")
        kept.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")  # a batch that runs again replaces itself
        sink(replies(read, keep=("session",)), batch_id)

    writer = session_messages(chunks).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(**trigger) if trigger else writer).start()


def hover_text() -> Column:
    fixes = F.concat(F.lit("\n\n**Suggestions:** "), F.array_join(F.transform("fixes", lambda x: F.concat(F.lit("`"), x, F.lit("`"))), ", "))
    return F.concat(F.lit("**["), "rule_id", F.lit("]** "), "message", F.when(F.size("fixes") > 0, fixes).otherwise(""))


def hovers(asked: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(id, value) of asked (id, uri, line, character from 0): the first diagnostic that covers the place; null where none does."""
    at = F.col("col") - 1
    d = diagnostics.withColumnRenamed("line", "_line").select("file", (F.col("_line") - 1).alias("d_line"), at.alias("first"), (at + F.octet_length("identifier")).alias("past"), "start", "rule_id", hover_text().alias("value"))
    covers = (F.col("uri") == F.col("file")) & (F.col("line") == F.col("d_line")) & (F.col("character") >= F.col("first")) & (F.col("character") < F.col("past"))
    return asked.join(d, covers, "left").groupBy("id").agg(F.min_by("value", F.struct("start", "rule_id")).alias("value"))


def code_actions(diagnostics: DataFrame) -> DataFrame:
    """(file, start, rule_id, action): a quick fix for each suggestion."""
    rows = diagnostics.select("*", F.explode("fixes").alias("fix"))
    edit = F.create_map(F.col("file"), F.array(F.struct(reports.editor_range().alias("range"), F.col("fix").alias("newText"))))
    action = F.struct(
        F.concat(F.lit("rename to '"), "fix", F.lit("'")).alias("title"), F.lit("quickfix").alias("kind"), F.lit(True).alias("isPreferred"), F.struct(edit.alias("changes")).alias("edit")
    )
    return rows.select("file", "start", "rule_id", F.to_json(action).alias("action"))


#: What the server tells of itself.
CAPABILITIES = {
    "textDocumentSync": {"openClose": True, "change": 2, "willSave": False, "willSaveWaitUntil": False, "save": {"includeText": False}},
    "hoverProvider": True,
    "codeActionProvider": True,
    "documentFormattingProvider": False,
    "diagnosticProvider": {"identifier": "tidewright", "interFileDependencies": False, "workspaceDiagnostics": False},
}


def replies(read: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(seq, the columns keep, id, reply) to messages that need no document: initialize, shutdown, completion, formatting, and errors."""
    method = F.col("method")
    hello = json.dumps({"capabilities": CAPABILITIES, "serverInfo": {"name": "tidewright", "version": "1.0.0"}})
    result = F.when(method == "initialize", hello).when(method == "textDocument/completion", "[]").when(method.isin("shutdown", "textDocument/formatting"), "null")
    text = F.element_at(F.create_map(*[F.lit(x) for kv in ERRORS.items() for x in kv]), F.col("error"))
    body = F.when(F.col("error").isNotNull(), F.concat(F.lit('"error":'), F.to_json(F.struct(F.col("error").alias("code"), text.alias("message"))))).otherwise(F.concat(F.lit('"result":'), result))
    # a number stays a number; anything else is a string
    name = F.when(F.col("id").rlike("^-?[0-9]+$"), F.col("id")).otherwise(F.coalesce(F.concat(F.lit('"'), F.col("id"), F.lit('"')), F.lit("null")))
    reply = F.concat(F.lit('{"jsonrpc":"2.0","id":'), name, F.lit(","), body, F.lit("}"))
    return read.select("seq", *keep, "id", reply.alias("reply")).where(F.col("reply").isNotNull())
