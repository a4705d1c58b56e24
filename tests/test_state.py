"""Byte streams cut anywhere, the gate of a session, and the document store with late versions, quiet time, close and restart."""

import json
import random
import time

from pyspark.sql import functions as F

from tidewright.streaming import editor, state


def frame(body: bytes) -> bytes:
    return b"Content-Length: %d\r\n\r\n" % len(body) + body


def test_frames_of_any_cut():
    rng = random.Random(1)
    bodies = [b'{"a": "\xc3\xa9"}', b"x", b"{}" * 500, b"\n\r\n\r\nContent-Length: 3\r\n\r\nabc"]
    stream = b"".join(b"X: y\n" * (i % 2) + frame(b) for i, b in enumerate(bodies * 3)) + b"Y: z\r\n\r\n" + frame(b"last")
    want = bodies * 3 + [None, b"last"]
    for _ in range(200):
        held, got, at = b"", [], 0
        while at < len(stream):
            n = rng.choice([1, 2, 7, 50, 4000])
            more, held = state.taken(held + stream[at : at + n])
            got += more
            at += n
        assert got == want and held == b""


def said(i, method, **params):
    return json.dumps({"jsonrpc": "2.0", **({"id": i} if i is not None else {}), "method": method, **({"params": params} if params else {})}).encode()


def test_sessions_and_restart(spark, tmp_path):
    """Two sessions' bytes over several triggers and a restart; replies, the gate and what goes on to the documents."""
    doc = {"uri": "a.py", "text": "tên = 1\n", "version": 1}
    talk = [said(1, "shutdown"), said(None, "initialized"), said(2, "initialize"), said(None, "initialized"), said(None, editor.OPEN, textDocument=doc), said(3, "nothing"), b"{", said(4, "textDocument/hover"), said(5, "shutdown"), said(None, "exit"), said(6, "shutdown")]
    stream = b"".join(map(frame, talk))
    rng = random.Random(5)
    got, sent = [], tmp_path / "in"
    sent.mkdir()
    schema = "session string, seq long, chunk binary"
    for session in ("s", "t"):
        at = seq = 0
        pieces = []
        while at < len(stream):
            n = rng.randint(1, 90)
            pieces.append((session, seq, bytearray(stream[at : at + n])))
            at, seq = at + n, seq + 1
        half = len(pieces) // 2
        for part in (pieces[:half], pieces[half:]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(sent))
    files = sorted(sent.glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    later = tmp_path / "later"
    later.mkdir()
    for p in files[1::2]:
        p.rename(later / p.name)
    for turn in range(2):  # the second run is a restart with what has come since
        query = editor.start_sessions(
            spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(sent)), str(tmp_path / "messages"), lambda df, _: got.extend((r["session"], r["seq"], json.loads(r["reply"])) for r in df.collect()), str(tmp_path / "state"), availableNow=True
        )
        assert query.awaitTermination(180)
        if turn == 0:
            for p in later.glob("*.parquet"):
                p.rename(sent / p.name)
    for session in ("s", "t"):
        answers = {r["id"]: r.get("error", {}).get("code", "ok") for s, _, r in sorted(got, key=lambda x: x[:2]) if s == session}
        assert answers == {1: editor.NOT_INITIALIZED, 2: "ok", 3: editor.METHOD_NOT_FOUND, None: editor.PARSE_ERROR, 4: editor.INTERNAL_ERROR, 5: "ok"}
        (early,) = [r for s, _, r in got if s == session and r["id"] == 1]
        assert early["error"]["message"] == "Server not initialized"
    kept = spark.read.parquet(str(tmp_path / "messages"))
    assert kept.where(F.col("value").contains("didOpen")).count() == 2 and kept.where(F.col("value").contains('"id": 1,')).count() == 0


def test_documents_keep_the_latest_version(spark, tmp_path):
    sent = tmp_path / "in"
    sent.mkdir()
    seqs = iter(range(100))

    def send(*rows):
        lines = [json.dumps({"seq": next(seqs), "value": json.dumps({"jsonrpc": "2.0", "method": m, "params": {"textDocument": d, **({"contentChanges": [{"text": t}]} if t else {})}})}) for m, d, t in rows]
        (sent / f"{time.time_ns()}.json").write_text("\n".join(lines))

    def run(**options):
        out = []
        stream = spark.readStream.schema("seq long, value string").json(str(sent))
        query = editor.start(stream, lambda df, _: out.extend((r["uri"], json.loads(r["message"])["params"]) for r in df.collect()), str(tmp_path / "state"), **options)
        return query, out

    send((editor.OPEN, {"uri": "a.py", "text": "x = 1", "version": 1}, None), (editor.CHANGE, {"uri": "a.py", "version": 5}, "tên = 1"), (editor.CHANGE, {"uri": "a.py", "version": 3}, "old = 1"), (editor.OPEN, {"uri": "b.py", "text": "á", "version": 1}, None))
    query, out = run(availableNow=True)
    assert query.awaitTermination(120) and sorted((u, p["version"], len(p["diagnostics"])) for u, p in out) == [("a.py", 5, 2), ("b.py", 1, 1)]
    send((editor.CHANGE, {"uri": "a.py", "version": 4}, "late = 1"), (editor.CLOSE, {"uri": "b.py"}, None), (editor.CHANGE, {"uri": "c.py", "version": 1}, "á"))
    query, out = run(availableNow=True)
    assert query.awaitTermination(120) and [(u, p["diagnostics"]) for u, p in out] == [("b.py", [])]


def test_documents_are_told_after_a_quiet_time(spark, tmp_path):
    """Edits that follow each other are linted once, and a restart goes on with the text as it was."""
    sent = tmp_path / "in"
    sent.mkdir()
    seqs = iter(range(100))

    def send(method, document, changes=None):
        params = {"textDocument": document, **({"contentChanges": changes} if changes else {})}
        (sent / f"{time.time_ns()}.json").write_text(json.dumps({"seq": next(seqs), "value": json.dumps({"jsonrpc": "2.0", "method": method, "params": params})}))

    for first, versions in ((True, (2, 3)), (False, (4, 5))):
        out = []
        stream = spark.readStream.schema("seq long, value string").json(str(sent))
        query = editor.start(stream, lambda df, _, out=out: out.extend((r["uri"], json.loads(r["message"])["params"]["version"]) for r in df.collect()), str(tmp_path / "state"), quiet_ms=4000, processingTime="200 milliseconds")
        try:
            if first:
                send(editor.OPEN, {"uri": "a.py", "text": "x = 1", "version": 1})
            for v in versions:
                send(editor.CHANGE, {"uri": "a.py", "version": v}, [{"range": {"start": {"line": 0, "character": 0}, "end": {"line": 0, "character": 1}}, "text": f"tên{v}"}])
            until = time.time() + 120
            while not out and time.time() < until:
                time.sleep(0.3)
        finally:
            query.stop()
        assert out == [("a.py", versions[-1])]
