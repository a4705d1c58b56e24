"""Queries of reports, editor answers, grammars, corpora and declarations, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import grammars as G
from .plans import engine, reports, service, training
from .queries import _ALL, _EXT, ORACLE_SQL, SQL_CODE, SQL_NAMES, code_files, cls, fast, lit, names, plain, query, table
from .sources import files
from .streaming import editor


def _lint(spark, sf):
    return engine.lint(code_files(table(spark, sf, "documents")))


_FIXES = "CASE WHEN fixes = '' THEN []::VARCHAR[] ELSE string_split(fixes, '|') END"
_LEVEL = "CASE WHEN severity = 'error' THEN 'error' WHEN severity = 'warning' THEN 'warning' ELSE 'note' END"


@query("x14_gcc_lines", _ALL + "SELECT file || ':' || line || ':' || col || ': ' || CASE WHEN severity = 'error' THEN 'error' ELSE 'warning' END || ': ' || message || ' [' || rule_id || ']' AS out FROM found")
def gcc_lines(spark, sf):
    return _lint(spark, sf).select(reports.gcc_line().alias("out"))


@query("x14_json_records", _ALL + f"SELECT to_json({{'file': file, 'rule': rule_id, 'severity': severity, 'message': message, 'line': line, 'col': col, 'identifier': identifier, 'fixes': {_FIXES}}})::VARCHAR AS out FROM found")
def json_records(spark, sf):
    return _lint(spark, sf).select(reports.json_record().alias("out"))


@query(
    "x14_sarif_results",
    _ALL + f"SELECT to_json({{'ruleId': rule_id, 'level': {_LEVEL}, 'message': {{'text': message}}, 'locations': [{{'physicalLocation': {{'artifactLocation': {{'uri': file}}, 'region': {{'startLine': line, 'startColumn': col}}}}}}]}})::VARCHAR AS out FROM found",
)
def sarif_results(spark, sf):
    return _lint(spark, sf).select(F.to_json(reports.sarif_result()).alias("out"))


@query(
    "x14_sarif_documents",
    ORACLE_SQL["x14_sarif_results"].replace("::VARCHAR AS out FROM found", "::VARCHAR AS out, file, start, rule_id, \"end\" FROM found").replace("SELECT to_json({'ruleId'", "SELECT file, '{\"$schema\":\"https://json.schemastore.org/sarif-2.1.0.json\",\"version\":\"2.1.0\",\"runs\":[{\"tool\":{\"driver\":{\"name\":\"tidewright\",\"version\":\"1.0.0\",\"rules\":[]}},\"results\":[' || string_agg(out, ',' ORDER BY start, rule_id, \"end\") || ']}]}' AS report FROM (SELECT to_json({'ruleId'")
    + ") GROUP BY file",
)
def sarif_documents(spark, sf):
    return reports.sarif_documents(_lint(spark, sf))


@query(
    "x15_summary",
    _ALL + ", n AS (SELECT (SELECT count(*) FROM documents) AS files, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos FROM found) "
    "SELECT *, concat_ws(chr(10), 'Files scanned: ' || files, CASE WHEN errors > 0 THEN 'Errors: ' || errors END, CASE WHEN warnings > 0 THEN 'Warnings: ' || warnings END, CASE WHEN infos > 0 THEN 'Infos: ' || infos END, CASE WHEN errors = 0 AND warnings = 0 THEN 'No violations found' END) AS text FROM n",
)
def summary(spark, sf):
    files_of = code_files(table(spark, sf, "documents"))
    return reports.summary(files_of, engine.lint(files_of))


@query(
    "x05_hovers",
    _ALL + "SELECT d.doc_id::VARCHAR AS id, arg_min('**[' || rule_id || ']** ' || message || CASE WHEN fixes <> '' THEN chr(10) || chr(10) || '**Suggestions:** `' || replace(fixes, '|', '`, `') || '`' ELSE '' END, (start, rule_id)) AS value "
    "FROM documents d LEFT JOIN found f ON f.file = 'doc' || d.doc_id || '.py' AND f.line = 4 AND 5 >= f.col - 1 AND 5 < f.col - 1 + strlen(f.identifier) GROUP BY d.doc_id",
)
def hovers(spark, sf):
    asked = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".py")).alias("uri"), F.lit(3).alias("line"), F.lit(5).alias("character"))
    return editor.hovers(asked, _lint(spark, sf))


_GRAMMAR = "CASE " + " ".join(f"WHEN e IN ({', '.join(map(lit, es.split()))}) THEN {lit(g)}" for g, es in G.GRAMMARS if es) + " END"
_MANY = "py pyi rs scala ml h++ Makefile cs jsonc none".split()
_MANY_SQL = "list_extract([" + ", ".join(map(lit, _MANY)) + "], (doc_id % 10)::INTEGER + 1)"


@query("l12_grammars", f"SELECT doc_id, {_GRAMMAR} AS grammar, {_EXT} AS language FROM (SELECT doc_id, {_MANY_SQL} AS e FROM documents)")
def grammars(spark, sf):
    from .functions.text import language_of

    path = F.concat(F.lit("dir/x."), F.element_at(F.array(*map(F.lit, _MANY)), (F.col("doc_id") % 10).cast("int") + 1))
    return table(spark, sf, "documents").select("doc_id", G.grammar_of(path).alias("grammar"), language_of(path).alias("language"))


@query("s05_labelled_corpus", "SELECT lang || doc_id AS id, (doc_id % 8)::INTEGER AS label, 1.0::DOUBLE AS confidence FROM documents WHERE lang IS NOT NULL AND doc_id % 8 <= 5")
def corpus(spark, sf):
    row = F.struct(F.concat("lang", F.col("doc_id").cast("string")).alias("id"), (F.col("doc_id") % 8).alias("label"))
    return files.labelled_corpus(table(spark, sf, "documents").select(F.to_json(row).alias("value")))


@query(
    "r14_declarations",
    f"SELECT CASE WHEN {cls('id')} = 'MixedVietnamese' THEN 'VL-AST-002' ELSE 'VL-AST-001' END AS rule_id, id AS identifier, {plain('id')} AS fix FROM ({SQL_NAMES}) WHERE {fast('id')} AND {cls('id')} <> 'PureASCII'",
)
def declarations(spark, sf):
    rows = names(spark, sf).select(
        F.lit("src/a.cpp").alias("file"), F.lit("var").alias("decl_kind"), F.col("id").alias("qualified_name"), F.col("id").alias("name"), F.lit(1).alias("line"), F.lit(1).alias("col"), F.lit(False).alias("system")
    )
    return G.declaration_findings(rows, "src/").select("rule_id", "identifier", "fix")


@query("r15_naming_check", f"SELECT concat('[VL-AST-001]: identifier ''', id, ''' contains Vietnamese characters. Consider using ASCII equivalents.') AS message FROM ({SQL_NAMES}) WHERE {fast('id')}")
def naming_check(spark, sf):
    rows = names(spark, sf).select(F.lit("a.cpp").alias("file"), F.col("id").alias("name"), F.lit(1).alias("line"), F.lit(1).alias("col"), F.lit(False).alias("system"))
    return G.naming_check(rows).select("message")


_STATS = "to_json({'done': true, 'stats': {'errors': count(*) FILTER (severity = 'error'), 'warnings': count(*) FILTER (severity = 'warning'), 'infos': count(*) FILTER (severity = 'info')}})::VARCHAR"


@query(
    "x10_event_stream",
    _ALL + f"SELECT file, false AS done, 'data: ' || to_json({{'file': file, 'rule': rule_id, 'severity': severity, 'message': message, 'line': line, 'col': col, 'identifier': identifier, 'fixes': {_FIXES}}})::VARCHAR || chr(10) || chr(10) AS event FROM found "
    f"UNION ALL SELECT s.file, true, 'data: ' || {_STATS} || chr(10) || chr(10) FROM ({SQL_CODE}) s LEFT JOIN found f ON f.file = s.file GROUP BY s.file",
)
def event_stream(spark, sf):
    return service.linted_events(code_files(table(spark, sf, "documents"))).select("file", "done", "event")


#: Names as a corpus, with labels by the corpus' own rules.
_CORPUS = f"(SELECT id, label, 0.7::DOUBLE AS confidence FROM ({ORACLE_SQL['f29_corpus_label']}))"
_DEFICITS = f"(SELECT label, count(*) AS n, greatest(5000 - count(*), 0)::BIGINT AS deficit FROM {_CORPUS} GROUP BY label)"


def _corpus(spark, sf):
    from .functions.text import corpus_label

    return names(spark, sf).select("id", corpus_label(F.col("id")).cast("int").alias("label"), F.lit(0.7).alias("confidence"))


@query("a08_class_deficits", f"SELECT * FROM {_DEFICITS}")
def class_deficits(spark, sf):
    return training.deficits(_corpus(spark, sf), 5000)


_DRAW = "('0x' || substr(md5(id || ':' || k), 1, 8))::BIGINT"
_AT = f"({_DRAW} % greatest(length(id), 1))::INTEGER"


@query(
    "m10_augment",
    f"""WITH corpus AS {_CORPUS}, pool AS (
  SELECT c.*, d.n, d.deficit, row_number() OVER (PARTITION BY label ORDER BY md5(id), id) - 1 AS r FROM corpus c JOIN {_DEFICITS} d USING (label) WHERE d.deficit > 0
), made AS (SELECT *, unnest(range(1, (deficit // n + CASE WHEN r < deficit % n THEN 1 ELSE 0 END + 1)::BIGINT)) AS k FROM pool)
SELECT id, label, confidence FROM corpus UNION ALL
SELECT CASE label WHEN 0 THEN concat(substr(id, 1, {_AT}), translate(substr(id, {_AT} + 1, 1), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), substr(id, {_AT} + 2))
  WHEN 3 THEN CASE {_DRAW} % 4 WHEN 0 THEN 'get' || id WHEN 1 THEN 'set' || id WHEN 2 THEN id || 'Info' ELSE id || 'Data' END ELSE id END, label, confidence * 0.85::DOUBLE FROM made""",
)
def augment(spark, sf):
    return training.augment(_corpus(spark, sf))


_NUMBER = f"CASE {cls('id')} WHEN 'PureASCII' THEN 0 WHEN 'PureVietnamese' THEN 1 WHEN 'MixedVietnamese' THEN 2 WHEN 'TransliteratedViet' THEN 3 ELSE 4 END"


@query(
    "a14_report",
    f"SELECT c AS label, sum(s)::BIGINT AS support, sum(g)::BIGINT AS guesses, sum(h)::BIGINT AS hits, CASE WHEN sum(g) > 0 THEN sum(h)::DOUBLE / sum(g)::DOUBLE END AS precision, CASE WHEN sum(s) > 0 THEN sum(h)::DOUBLE / sum(s)::DOUBLE END AS recall FROM ("
    f"SELECT label AS c, 1 AS s, 0 AS g, (label = {_NUMBER})::INT AS h FROM {_CORPUS} UNION ALL SELECT {_NUMBER}, 0, 1, 0 FROM {_CORPUS}) GROUP BY c",
)
def classification_report(spark, sf):
    return training.report(training.predict(_corpus(spark, sf)))
