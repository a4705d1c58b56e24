"""State that streams keep by key: byte streams to messages, and the document store with its quiet time.

Both are processors of ``transformWithState``: state is Spark's (RocksDB, checkpointed with the query), so that a restart goes on where it was.
Sessions of streams that set no provider for it get one here.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_HEAD = re.compile(rb"\A(?:[^\n]*[^\r\n][^\n]*\n)*\r?\n")
_LENGTH = re.compile(rb"^Content-Length: (\d+)", re.M)


def _provided(spark: SparkSession) -> None:
    spark.streams.active  # noqa: B018  (the manager of streams coordinates state, for batches too)
    key = "spark.sql.streaming.stateStore.providerClass"
    if not spark.conf.get(key, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(key, PROVIDER)


def taken(held: bytes) -> tuple[list[bytes | None], bytes]:
    """(messages, rest): the whole frames at the start of held bytes; None for headers without a length, which have no body."""
    out: list[bytes | None] = []
    while m := _HEAD.match(held):
        lengths = _LENGTH.findall(m[0])
        size = int(lengths[-1]) if lengths else 0
        if len(held) < m.end() + size:
            break
        out.append(held[m.end() : m.end() + size] if size else None)
        held = held[m.end() + size :]
    return out, held


class Frames(StatefulProcessor):
    """Bytes of a session that arrived to the messages that they complete, and whether each may be answered yet."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("session", "rest binary, n long, ready boolean, over boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rest, n, ready, over = self.state.get() if self.state.exists() else (b"", 0, False, False)
        arrived = pd.concat(list(rows)).sort_values("seq", kind="stable")
        parts, out = [bytes(rest)], []
        parts += [bytes(c) for c in arrived["chunk"] if c is not None]
        bodies, rest = taken(b"".join(parts))
        for body in bodies:
            value, error, method, asks = None, None, None, False
            if over:  # nothing is read after exit
                continue
            if body is None:
                error = -32600
            else:
                value = body.decode("utf-8", "replace")
                try:
                    message = json.loads(value)
                    method, asks = (message.get("method"), message.get("id") is not None) if isinstance(message, dict) else (None, False)
                except ValueError:
                    pass  # told by who reads the message
            if method == "initialize":
                ready = True
            elif method is not None and not ready and method != "exit":
                if not asks:
                    continue
                error = -32002
            over = method == "exit"
            out.append((key[0], n, value, error))
            n += 1
        self.state.update((bytes(rest), n, ready, over))
        yield pd.DataFrame(out, columns=["session", "n", "value", "error"]).astype({"session": "string", "n": "int64", "value": "string", "error": "Int32"})

    def close(self) -> None:
        pass


def session_messages(chunks: DataFrame) -> DataFrame:
    """(session, n, value, error) of (session, seq, chunk): the messages of each session's byte stream, numbered, however it was cut into chunks.

    Frames may lie across chunks, chunks may hold many frames. error: -32600 for headers without a length, -32002 for requests before initialize;
    notifications before it go, but for exit, after which nothing is read. Chunks of a session count in order of seq within a trigger, triggers in
    their order; null chunks are empty. Bytes that are no UTF-8 are replaced. A session is one stream of bytes, so one task reads it.
    """
    _provided(chunks.sparkSession)
    return chunks.select(F.col("session").cast("string").alias("session"), "seq", "chunk").where("session is not null").groupBy("session").transformWithStateInPandas(Frames(), "session string, n long, value string, error int", "append", "none")


class Documents(StatefulProcessor):
    """The text of a document, by edits in their order; handed on once no edit came for a while."""

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("document", "text string, language string, version int")

    def _told(self, key, held, is_open: bool) -> pd.DataFrame:
        version = held[2] if held else None
        return pd.DataFrame({"uri": [key[0]], "version": [version], "text": [held[0] if held else ""], "open": [is_open]}).astype({"version": "Int32"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        from .editor import CLOSE, OPEN, apply_message

        before = held = tuple(self.state.get()) if self.state.exists() else None
        touched = False
        for r in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples(index=False):
            document = json.loads(r.document)
            version = document.get("version")
            if r.method not in (OPEN, CLOSE) and held is not None and version is not None and version <= held[2]:
                continue  # it came late: a newer version is here
            after = apply_message(held, r.method, document, json.loads(r.changes) if r.changes else [])
            touched |= after is not None or held is not None
            held = after
        if not touched:
            return
        for at in self.handle.listTimers() if self.quiet else ():
            self.handle.deleteTimer(at)
        if held is None:
            if before is not None or self.state.exists():
                self.state.clear()
            yield self._told(key, None, False)
        else:
            self.state.update(held)
            if self.quiet:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet)
            else:
                yield self._told(key, held, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.state.exists():
            yield self._told(key, tuple(self.state.get()), True)

    def close(self) -> None:
        pass


def documents(edits: DataFrame, quiet_ms: int = 0) -> DataFrame:
    """(uri, version, text, open) of edits (uri, seq, method, document, changes): every document's latest version once no edit came for quiet_ms,
    or after each trigger that touched it with 0; closed ones come at once, with empty text. Versions that came late are passed over."""
    _provided(edits.sparkSession)
    return edits.groupBy("uri").transformWithStateInPandas(Documents(quiet_ms), "uri string, version int, text string, open boolean", "append", "processingTime" if quiet_ms else "none")
