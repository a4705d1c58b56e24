"""Queries of text positions, protocol frames, corpora, projects and reports, with their SQL. The SQL spells its patterns out."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as T
from .operators.lexer import tokens
from .plans import corpus, history, reports, training
from .queries import _ALL, ORACLE_SQL, SQL_CODE, SQL_HISTORY, SQL_NAMES, _history, code_files, query, table
from .sources import files
from .sources.files import spread
from .streaming import editor
from .surface import _corpus

_MARKED = "[\\x{C0}-\\x{24F}\\x{300}-\\x{36F}\\x{1E00}-\\x{1EFF}]"


@query(
    "f04_code_points",
    f"""SELECT d.doc_id, count(c) AS n, coalesce(sum(unicode(c)), 0)::BIGINT AS points, coalesce(sum(strlen(c)), 0)::BIGINT AS bytes, count(*) FILTER (regexp_matches(c, '{_MARKED}')) AS marked,
count(*) FILTER (regexp_matches(c, '[A-Za-z_]') OR unicode(c) > 127) AS starts, count(*) FILTER (regexp_matches(c, '[A-Za-z_0-9]') OR unicode(c) > 127) AS continues
FROM documents d LEFT JOIN (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents WHERE text <> '') x ON x.doc_id = d.doc_id GROUP BY d.doc_id""",
)
def code_points(spark, sf):
    """Null and empty texts have no code points."""
    rows = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.explode_outer(T.code_points(F.col("text"))).alias("c"))
    n = lambda c: F.count_if(F.col(f"c.{c}"))
    total = lambda c: F.coalesce(F.sum(f"c.{c}"), F.lit(0))
    return rows.groupBy("doc_id").agg(
        F.count("c").alias("n"), total("codepoint").alias("points"), total("byte_length").alias("bytes"), n("is_vietnamese").alias("marked"), n("is_id_start").alias("starts"), n("is_id_continue").alias("continues")
    )


@query(
    "f09_positions",
    """SELECT doc_id, strlen(h)::INTEGER AS "offset", (1 + length(h) - length(replace(h, chr(10), '')))::INTEGER AS line, (1 + length(string_split(h, chr(10))[-1]))::INTEGER AS "column"
FROM (SELECT doc_id, left(text, (doc_id * 37 % (length(text) + 1))::INTEGER) AS h FROM documents)""",
)
def positions(spark, sf):
    """A null text has no positions."""
    rows = table(spark, sf, "documents").withColumn("_k", F.expr("cast(doc_id * 37 % (length(text) + 1) as int)"))
    at = T.position_of(F.col("text"), F.octet_length(F.substring(F.col("text"), F.lit(1), F.col("_k"))))
    return rows.select("doc_id", F.when(F.col("text").isNotNull(), at).alias("p")).select("doc_id", "p.*")


@query("f07_valid_utf8", "SELECT doc_id, CASE WHEN text IS NOT NULL THEN doc_id % 3 <> 0 OR text = '' END AS valid, doc_id % 256 < 128 OR doc_id % 256 BETWEEN 194 AND 244 AS leads, chr((doc_id % 55000 + 1)::INTEGER) AS letter FROM documents")
def valid_utf8(spark, sf):
    raw = F.when((F.col("doc_id") % 3 == 0) & (F.col("text") != ""), F.concat(F.encode("text", "UTF-8"), F.lit(bytearray(b"\xc3")))).otherwise(F.encode("text", "UTF-8"))
    return table(spark, sf, "documents").select("doc_id", T.is_valid_utf8(raw).alias("valid"), T.is_leading_byte(F.col("doc_id") % 256).alias("leads"), T.utf8_of((F.col("doc_id") % 55000 + 1).cast("int")).alias("letter"))


@query("f21_json_round_trip", "SELECT doc_id, md5(text) AS text, CASE WHEN text IS NOT NULL THEN doc_id * 2 END AS n, CASE WHEN text IS NOT NULL THEN true END AS flag FROM documents")
def json_round_trip(spark, sf):
    """Texts through the writer of JSON strings, the parser, and typed access; a null text gives no document, and nulls."""
    made = F.concat(F.lit('{"s": "'), T.escape_json(F.col("text")), F.lit('", "n": '), (F.col("doc_id") * 2).cast("string"), F.lit(', "a": [true]}'))
    rows = table(spark, sf, "documents").select("doc_id", F.try_parse_json(made).alias("v"))
    got = lambda path, kind: F.try_variant_get("v", path, kind)
    return rows.select("doc_id", F.md5(got("$.s", "string")).alias("text"), got("$.n", "long").alias("n"), got("$.a[0]", "boolean").alias("flag"))


@query("s13_frames", "SELECT conv_id, turn, CASE WHEN text <> '' THEN strlen(text) END::INTEGER AS bytes, CASE WHEN text <> '' THEN md5(text) END AS body FROM conversations")
def frames(spark, sf):
    """Null and empty texts make no message."""
    rows = table(spark, sf, "conversations")
    framed = F.when(F.col("turn") % 2 == 0, editor.frame_of(F.col("text"))).otherwise(F.concat(F.lit("X: y\n"), F.replace(editor.frame_of(F.col("text")), F.lit("\r\n\r\n"), F.lit("\n\n")), F.lit("more")))
    body = editor.body_of(framed)
    return rows.select("conv_id", "turn", F.octet_length(body).alias("bytes"), F.md5(body).alias("body"))


@query("s11_request_bodies", "SELECT 'input.py' AS file, md5(text) AS source, 'Python' AS language FROM conversations WHERE text IS NOT NULL")
def request_bodies(spark, sf):
    lines = table(spark, sf, "conversations").select(F.to_json(F.struct(F.col("text").alias("source"))).alias("value"))
    return files.request_bodies(lines).withColumn("source", F.md5("source"))


@query(
    "x01_gate",
    "SELECT conv_id, turn, CASE WHEN turn < h OR h IS NULL THEN -32002 END AS error FROM (SELECT *, min(CASE WHEN turn % 3 = 1 THEN turn END) OVER (PARTITION BY conv_id) AS h FROM conversations)",
)
def gate(spark, sf):
    method = F.when(F.col("turn") % 3 == 1, "initialize").otherwise("shutdown")
    raw = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("seq"), F.to_json(F.struct(F.col("turn").alias("id"), method.alias("method"))).alias("value"))
    read = raw.select("conv_id", "seq", F.from_json("value", editor.MESSAGE).alias("m")).select("conv_id", "seq", "m.id", "m.method", F.lit(None).cast("int").alias("error"))
    return editor.gated(read, "conv_id").select("conv_id", F.col("seq").alias("turn"), "error")


@query("l06_identifiers", "SELECT doc_id, n FROM (SELECT file, count(*) FILTER (kind IN ('Identifier', 'VietnameseIdentifier', 'MixedIdentifier')) AS n FROM tok GROUP BY file) JOIN documents ON file = 'doc' || doc_id || '.py'")
def identifiers(spark, sf):
    rows = tokens(code_files(table(spark, sf, "documents")), end=False)
    named = F.count_if(F.col("kind").isin("Identifier", "VietnameseIdentifier", "MixedIdentifier"))
    return rows.groupBy("file").agg(named.alias("n")).select(F.regexp_extract("file", "[0-9]+", 0).cast("long").alias("doc_id"), "n")


ORACLE_SQL["l06_identifiers"] = _ALL.split(", found AS")[0] + ORACLE_SQL["l06_identifiers"]

_SKIP = "'if','else','for','while','return','import','from','class','def','var','let','const','function','true','false','null','None','True','False'"
_REPO_SQL = "SELECT coalesce(source, '-') AS repo, 'd' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '.txt' ELSE '.py' END AS path, text AS source FROM documents"
_CHOSEN = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path) AS k FROM ({_REPO_SQL}) WHERE path LIKE '%.py' AND strlen(source) < 300000) WHERE k <= 40)"
_IDS = f"SELECT id, min({{'repo': repo, 'path': path}}) AS at FROM (SELECT repo, path, unnest(regexp_extract_all(source, '[\\p{{L}}\\p{{M}}_][\\p{{L}}\\p{{M}}\\p{{N}}_]*')) AS id FROM {_CHOSEN}) WHERE length(id) BETWEEN 2 AND 80 AND NOT regexp_matches(id, '^[0-9]+$') AND id NOT IN ({_SKIP}) GROUP BY id"
_LABEL = ORACLE_SQL["f29_corpus_label"].replace(f"FROM ({SQL_NAMES})", f"FROM ({_IDS})")
_COLLECT = (
    f"SELECT i.id, l.label, CASE WHEN regexp_matches(i.id, '{_MARKED}') THEN 0.75 WHEN l.label = 3 THEN 0.80 ELSE 0.70 END::DOUBLE AS confidence, regexp_matches(i.id, '{_MARKED}') AS has_vietnamese, 'py' AS language, i.at.repo || '/' || i.at.path AS source "
    f"FROM ({_IDS}) i JOIN ({_LABEL}) l ON l.id = i.id WHERE i.id NOT IN ('ten', 'getUser') UNION ALL SELECT * FROM (VALUES ('ten', 3, 1.0::DOUBLE, false, '', 'curated'), ('getUser', 0, 1.0::DOUBLE, false, '', 'curated'))"
)


def _repos(spark, sf):
    ext = F.when(F.col("doc_id") % 5 == 0, ".txt").otherwise(".py")
    return spread(table(spark, sf, "documents")).select(F.coalesce("source", F.lit("-")).alias("repo"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), ext).alias("path"), F.col("text").alias("source"))


def _collected(spark, sf):
    curated = spark.createDataFrame([("ten", 3, 1.0), ("getUser", 0, 1.0)], "id string, label int, confidence double")
    return corpus.collect(_repos(spark, sf), curated, 40)


@query("m14_collect", _COLLECT)
def collected(spark, sf):
    return _collected(spark, sf)


@query("t07_label_counts", f"SELECT label, count(*) AS n FROM ({_COLLECT}) GROUP BY label")
def label_counts(spark, sf):
    return corpus.label_counts(_collected(spark, sf))


@query("a13_collection_stats", f"SELECT (SELECT count(DISTINCT repo) FROM {_CHOSEN}) AS repos_scanned, (SELECT count(*) FROM {_CHOSEN}) AS files_scanned, count(*) AS identifiers_found, count(*) FILTER (has_vietnamese) AS vietnamese_found FROM ({_COLLECT}) WHERE source <> 'curated'")
def collection_stats(spark, sf):
    return corpus.collection_stats(_repos(spark, sf), _collected(spark, sf), 40)


@query("t06_first_files", f"SELECT repo, path FROM {_CHOSEN}")
def first_files(spark, sf):
    return corpus.chosen_files(_repos(spark, sf), 40).select("repo", "path")


@query("a03_project_total", f"SELECT count(*) AS total FROM ({SQL_HISTORY}) WHERE project_id = 'p7'")
def project_total(spark, sf):
    return history.total(_history(spark, sf), "p7")


@query("t04_projects", "SELECT c_custkey::VARCHAR AS id, c_name AS name, c_acctbal AS created_at FROM customer")
def projects(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("created_at"))
    return history.projects(rows)


@query("u07_insert_or_ignore", f"SELECT id, project_id FROM ({SQL_HISTORY}) UNION ALL SELECT -event_id, 'new' FROM events WHERE event_id > 0 AND event_id % 10 = 0")
def insert_or_ignore(spark, sf):
    v = _history(spark, sf)
    gone = F.when(F.col("id") % 10 == 0, -F.col("id")).otherwise(F.col("id"))
    new = v.where("id > 0").withColumn("id", gone).withColumn("project_id", F.lit("new"))
    return history.insert_or_ignore(v, new.unionByName(new)).select("id", "project_id")


@query(
    "x13_text_reports",
    _ALL + f""", lined AS (SELECT f.*, string_split(s.source, chr(10)) AS l FROM found f JOIN ({SQL_CODE}) s ON s.file = f.file)
SELECT file, start, rule_id, md5(concat(file, ':', line, ':', col, ': ', severity, ' [', rule_id, ']: ', message, chr(10), '    | ', CASE WHEN line <= len(l) THEN l[line] ELSE l[1] END, chr(10), '    | ', repeat(' ', col - 1), '^', chr(10),
  CASE WHEN fixes <> '' THEN concat('    suggestion: ', replace(fixes, '|', ' or '), chr(10)) ELSE '' END)) AS report FROM lined""",
)
def text_reports(spark, sf):
    rows = code_files(table(spark, sf, "documents"))
    return reports.linted_reports(rows, digest=True)


def _styled(code: int, part: str) -> str:
    return f"chr(27) || '[{code}m' || {part} || chr(27) || '[0m'"


@query(
    "z03_report_context",
    _ALL + f""", lined AS (SELECT f.*, string_split(s.source, chr(10)) AS l FROM found f JOIN ({SQL_CODE}) s ON s.file = f.file)
SELECT file, start, rule_id, md5({_styled(1, "file || ':' || line || ':' || col || ': '")}
  || CASE severity WHEN 'warning' THEN {_styled(33, "'warning'")} WHEN 'info' THEN {_styled(36, "'info'")} ELSE {_styled(31, "'error'")} END
  || ' ' || {_styled(2, "'[' || rule_id || ']'")} || ': ' || message || chr(10)
  || CASE WHEN line <= len(l) THEN array_to_string(list_transform(l[greatest(line - 2, 1):line - 1], lambda x: {_styled(2, "'    | ' || x || chr(10)")}), '') ELSE '' END
  || {_styled(2, "'    | ' || CASE WHEN line <= len(l) THEN l[line] ELSE l[1] END || chr(10)")}
  || '    | ' || repeat(' ', col - 1) || {_styled(32, "'^'")} || chr(10)
  || CASE WHEN line <= len(l) THEN array_to_string(list_transform(l[line + 1:line + 2], lambda x: {_styled(2, "'    | ' || x || chr(10)")}), '') ELSE '' END
  || CASE WHEN fixes <> '' THEN {_styled(36, "'    suggestion: ' || replace(fixes, '|', ' or ')")} || chr(10) ELSE '' END
  || {_styled(2, "'    see: " + reports.BASE_URL + "' || rule_id || chr(10)")}) AS report FROM lined""",
)
def report_context(spark, sf):
    """Reports as a terminal shows them: colours, two lines before and after, and where the rule is described."""
    rows = code_files(table(spark, sf, "documents"))
    return reports.linted_reports(rows, url=True, color=True, context=2, digest=True)


@query(
    "a14_scores",
    f"WITH r AS ({ORACLE_SQL['a14_report']}), x AS (SELECT *, coalesce(precision, 0) AS p, coalesce(recall, 0) AS q FROM r) SELECT round(sum(hits)::DOUBLE / sum(support)::DOUBLE, 9) AS accuracy, round(avg(p), 9) AS precision, round(avg(q), 9) AS recall, round(avg(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END), 9) AS f1 FROM x",
)
def report_scores(spark, sf):
    got = training.scores(training.report(training.predict(_corpus(spark, sf))))
    return got.select(*[F.round(c, 9).alias(c) for c in got.columns])
