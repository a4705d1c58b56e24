"""Queries of the engine over the driver's tables, each with the SQL that says what it returns."""

from __future__ import annotations

import hashlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import constants as C
from .functions import features as M
from .functions import text as T
from .operators import encoding as E
from .operators import rules as R
from .operators.lexer import KINDS_OF_COMMENTS, KINDS_OF_NAMES, tokens
from .plans import engine, history
from .sources.files import spread

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
DIGEST = pa.schema([("file", pa.string()), ("n", pa.int64()), ("digest", pa.string())])


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- sources made of the driver's tables, in Spark and in DuckDB -------------------------------------------------


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(items) -> str:
    return "(" + ", ".join(lit(w) for w in items) + ")"


#: A source file for each document: comments, an import, definitions, strings and names with its whole text, every character of it
#: (in comments each line is one; in strings back slashes and quotes are escaped).
_SNIPPET = (
    "concat('# coding: ', CASE WHEN doc_id % 2 = 0 THEN 'utf-8' ELSE 'latin-1' END, chr(10), '# ', replace({s}, chr(10), concat(chr(10), '# ')), chr(10), 'import numpy as ', CASE WHEN doc_id % 3 = 0 THEN 'ten' ELSE 'np' END, chr(10), "
    "'def so_luong(tenhang, mã_khách):', chr(10), '    x = \"', {q}, '\"', chr(10), '    raise ValueError(\"', {q}, '\")', repeat(chr(10), 6), 'y = 1', chr(10), 'def ten_hang(b):', chr(10), '    \"Docs.\"', chr(10), "
    "'    danhSach = so_luong + á', chr(10), '    return danhSach', repeat(chr(10), 8), 'GetUser = getUser = nv = sdt0905123456 = FOO_BAR', chr(10), {s}, chr(10))"
)
_QUOTED = "replace(replace({s}, chr(92), concat(chr(92), chr(92))), chr(34), concat(chr(92), chr(34)))"


def code_files(docs: DataFrame) -> DataFrame:
    rows = spread(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_s")))
    return rows.select("doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".py")).alias("file"), F.expr(_SNIPPET.format(s="_s", q=_QUOTED.format(s="_s"))).alias("source"), F.lit("Python").alias("language"))


def text_files(docs: DataFrame) -> DataFrame:
    return spread(docs.select("doc_id", "text")).select("doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".py")).alias("file"), F.col("text").alias("source"), F.lit("Python").alias("language"))


SQL_CODE = f"SELECT doc_id, 'doc' || doc_id || '.py' AS file, {_SNIPPET.format(s='s', q=_QUOTED.format(s='s'))} AS source FROM (SELECT doc_id, coalesce(text, '') AS s FROM documents)"
SQL_TEXT = "SELECT doc_id, 'doc' || doc_id || '.py' AS file, text AS source FROM documents"


def fast(x: str) -> str:
    return f"regexp_matches({x}, {lit(C.FAST)})"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {lit(pattern)}))"


def low(x: str) -> str:
    return f"translate({x}, '{T.UPPER}', '{T.LOWER}')"


def style(x: str) -> str:
    return (
        f"CASE WHEN {x} = '' THEN 'Unknown' WHEN strlen({x}) = 1 THEN 'SingleLetter' WHEN contains({x}, '-') THEN 'KebabCase' WHEN contains({x}, '_') AND NOT regexp_matches({x}, '[a-z]') THEN 'ScreamingSnake' "
        f"WHEN contains({x}, '_') THEN 'SnakeCase' WHEN regexp_matches({x}, '^[A-Z]') AND regexp_matches({x}, '[a-z]') THEN 'PascalCase' WHEN regexp_matches({x}, '^[a-z]') AND regexp_matches({x}, '[A-Z]') THEN 'CamelCase' ELSE 'Unknown' END"
    )


def translit(x: str) -> str:
    bare = f"trim({low(x)}, '_')"
    parts = f"list_filter(string_split({bare}, '_'), lambda p: p <> '')"
    return f"({bare} IN {words(C.WORDS)} OR (len({parts}) >= 2 AND len(list_filter({parts}, lambda p: p NOT IN {words(C.WORDS)})) = 0))"


def cls(x: str) -> str:
    n, m = f"length(translate({x}, '_-', ''))", count(x, C.EXACT)
    return (
        f"CASE WHEN {x} IN {words(C.ABBREVIATIONS)} THEN 'Abbreviation' WHEN {m} = 0 AND {translit(x)} THEN 'TransliteratedViet' WHEN {m} = 0 THEN 'PureASCII' "
        f"WHEN {m} * 10 >= {n} * 9 THEN 'PureVietnamese' ELSE 'MixedVietnamese' END"
    )


def plain(x: str) -> str:
    return f"regexp_replace(translate({x}, '{C.STRIPPED}', '{C.BASES}'), '[^\\x00-\\x7F]', '?', 'g')"


def snake(x: str) -> str:
    return low(f"regexp_replace({plain(x)}, '([^A-Z])([A-Z])', '\\1_\\2', 'g')")


def camel(x: str) -> str:
    return f"concat({low(f'substr({plain(x)}, 1, 1)')}, substr({plain(x)}, 2))"


_NAME = words(KINDS_OF_NAMES)
_COMMENT = words(KINDS_OF_COMMENTS)


def sql_tokens(source: str, language: str = "Python") -> str:
    """CTEs ending in tok: a lexer in SQL. That of C++ has no raw strings, which take back references."""
    line, block = ("'#%'", "raw LIKE '\"\"\"%' OR raw LIKE '''''''%'") if language == "Python" else ("'//%'", "raw LIKE '/*%'")
    first = "WHEN pos = 0 AND raw LIKE '#%' THEN CASE WHEN contains(raw, 'coding') THEN 'EncodingDecl' ELSE 'Comment' END " if language == "Python" else ""
    last = {"Python": "WHEN raw LIKE '@%' THEN 'Decorator' ELSE 'Punctuation'", "JavaScript": "ELSE 'Punctuation'", "Cpp": "WHEN raw LIKE '#_%' THEN 'Punctuation' ELSE 'Operator'"}[language]
    template = "WHEN raw LIKE '`%' THEN 'TemplateLiteral' " if language == "JavaScript" else ""
    pattern = {"Python": C.SQL_PYTHON, "JavaScript": C.SQL_JAVASCRIPT, "Cpp": C.SQL_CPP.replace(C.RAW_STRING + "|", "").replace("(?md:^)", "(?m:^)")}[language]
    kind = (
        f"CASE WHEN raw = '' THEN 'EndOfFile' {first}"
        f"WHEN raw LIKE {line} THEN CASE WHEN {fast('raw')} THEN 'VietnameseComment' ELSE 'Comment' END "
        f"WHEN {block} THEN CASE WHEN {fast('raw')} THEN 'VietnameseComment' ELSE 'BlockComment' END {template}"
        f"WHEN regexp_matches(raw, '^[\"'']') THEN 'StringLiteral' WHEN raw = chr(10) THEN 'Newline' WHEN regexp_matches(raw, '^[ \\t\\r\\x0B\\x0C]') THEN 'Whitespace' "
        f"WHEN regexp_matches(raw, '^[A-Za-z_\\x{{80}}-\\x{{10FFFF}}]') THEN CASE WHEN raw IN {words(C.KEYWORDS[language])} THEN 'Keyword' WHEN {fast('raw')} AND regexp_matches(raw, '[A-Za-z_]') THEN 'MixedIdentifier' "
        f"WHEN {fast('raw')} THEN 'VietnameseIdentifier' ELSE 'Identifier' END WHEN regexp_matches(raw, '^[0-9]') THEN 'NumberLiteral' {last} END"
    )
    return f"""
WITH src AS ({source}),
lists AS (SELECT file, list_append(regexp_extract_all(coalesce(source, ''), {lit(pattern)}), '') AS l FROM src),
parts AS (SELECT file, unnest(l) AS raw, unnest(range(len(l)))::INTEGER AS pos FROM lists),
sums AS (
  SELECT *, coalesce(sum(strlen(raw)) OVER b, 0)::INTEGER AS start, (1 + coalesce(sum(length(raw) - length(replace(raw, chr(10), ''))) OVER b, 0))::INTEGER AS line
  FROM parts WINDOW b AS (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
ends AS (SELECT *, CASE WHEN contains(raw, chr(10)) THEN start + strlen(raw) - strlen(string_split(raw, chr(10))[-1]) END AS ls FROM sums),
every AS (SELECT *, (start - coalesce(max(ls) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1)::INTEGER AS col, {kind} AS kind FROM ends),
tok AS (
  SELECT file, pos, kind, raw, start, (start + strlen(raw))::INTEGER AS "end", line, col, {fast('raw')} AS hv,
         CASE WHEN kind IN {_NAME} THEN {cls('raw')} END AS cls
  FROM every WHERE kind NOT IN ('Whitespace', 'Newline')
)"""


# --- F: functions of text -----------------------------------------------------------------------------------------

_NAMES_SQL = f"SELECT DISTINCT unnest(regexp_extract_all(coalesce(text, ''), {lit(C.IDENTIFIER)})) AS id FROM documents"
_MADE = "SELECT unnest(['ten_khach_hang', 'so_luong', 'tênKhách', 'QLKH', '__init__', 'FOO', 'FOO_BAR', 'fooBar', 'FooBar', 'foo-bar', 'x', '__', 'bácSĩ', 'á', 'MA', 'đ', 'Việt', '_ten_', 'nhân_viên']) AS id"
SQL_NAMES = f"SELECT id FROM ({_NAMES_SQL}) UNION SELECT id FROM ({_MADE})"


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct identifiers of all documents and some made ones."""
    found = spread(table(spark, sf_dir, "documents").select("text")).select(F.explode(F.regexp_extract_all("text", F.lit(C.IDENTIFIER), F.lit(0))).alias("id"))
    made = spark.sql("SELECT explode(array" + _MADE.split("unnest(")[1].replace("[", "(").replace("])", "))"))
    return found.union(made.toDF("id")).distinct()


@query("f01_has_vietnamese", f"SELECT doc_id, {fast('text')} AS fast, regexp_matches(text, {lit(C.EXACT)}) AS exact, CASE WHEN {fast('text')} THEN {count('text', C.EXACT)} ELSE 0 END::INTEGER AS marked FROM documents")
def f01(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.has_vietnamese(F.col("text")).alias("fast"), T.has_exact(F.col("text")).alias("exact"), T.count_vietnamese(F.col("text")).cast("int").alias("marked"))


@query("l17_vietnamese_tokens", f"SELECT doc_id, array_to_string(CASE WHEN {fast('text')} THEN list_filter(regexp_extract_all(text, {lit(C.IDENTIFIER)}), lambda x: regexp_matches(x, {lit(C.EXACT)})) ELSE [] END, ' ') AS found FROM documents")
def l17(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.vietnamese_tokens(F.col("text")), " ").alias("found"))


@query("l16_distinct_identifiers", "SELECT doc_id, len(list_distinct(regexp_extract_all(text, '[\\p{L}\\p{M}_][\\p{L}\\p{M}\\p{N}_]*'))) AS n FROM documents")
def l16(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{M}_][\p{L}\p{M}\p{N}_]*"), F.lit(0)))).cast("long").alias("n"))


@query("f10_ratio", f"SELECT id, {count('id', C.EXACT)}::INTEGER AS marked, length(translate(id, '_-', ''))::INTEGER AS letters FROM ({SQL_NAMES})")
def f10(spark, sf):
    return names(spark, sf).select("id", T.marked_count(F.col("id")).cast("int").alias("marked"), T.letter_count(F.col("id")).alias("letters"))


@query("f11_naming_style", f"SELECT id, {style('id')} AS style FROM ({SQL_NAMES})")
def f11(spark, sf):
    return names(spark, sf).select("id", T.naming_style(F.col("id")).alias("style"))


@query("f14_classify", f"SELECT id, {cls('id')} AS cls, {translit('id')} AS translit FROM ({SQL_NAMES})")
def f14(spark, sf):
    return names(spark, sf).select("id", T.identifier_class(F.col("id")).alias("cls"), T.is_transliteration(F.col("id")).alias("translit"))


@query("f17_suggestions", f"SELECT id, {plain('id')} AS plain, {snake('id')} AS snake, {camel('id')} AS camel FROM ({SQL_NAMES})")
def f17(spark, sf):
    return names(spark, sf).select("id", T.ascii_name(F.col("id")).alias("plain"), T.snake_name(F.col("id")).alias("snake"), T.camel_name(F.col("id")).alias("camel"))


@query(
    "f29_corpus_label",
    f"SELECT id, CASE WHEN NOT regexp_matches(id, {lit(C.EXACT)}) THEN CASE WHEN lower(translate(id, '_-', '')) IN {words(C.CORPUS_WORDS)} OR lower(id) IN {words(C.CORPUS_WORDS)} THEN 3 "
    f"WHEN length(id) <= 6 AND regexp_matches(id, {lit(C.CORPUS_ABBREVIATION)}) THEN 4 ELSE 0 END WHEN {count('id', C.EXACT)} * 100 >= ({count('id', C.EXACT)} + {count('id', '[A-Za-z]')}) * 85 THEN 1 ELSE 2 END::INTEGER AS label FROM ({SQL_NAMES})",
)
def f29(spark, sf):
    return names(spark, sf).select("id", T.corpus_label(F.col("id")).cast("int").alias("label"))


#: All 32 control characters, quotes and back slashes stand in each text's tail, as the tables' texts have few.
_CONTROL = "array_to_string(list_transform(range(1, 32), lambda i: chr(i::INTEGER)), '')"


def _escaped(x: str) -> str:
    """In SQL: one character at a time, as the format says it."""
    one = "CASE WHEN c = '\"' THEN '\\\"' WHEN c = chr(92) THEN chr(92) || chr(92) WHEN c = chr(10) THEN '\\n' WHEN c = chr(13) THEN '\\r' WHEN c = chr(9) THEN '\\t' WHEN unicode(c) < 32 THEN '\\u00' || upper(lpad(to_hex(unicode(c)), 2, '0')) ELSE c END"
    return f"array_to_string(list_transform(string_split({x}, ''), lambda c: {one}), '')"


@query("f20_escape_json", f"SELECT doc_id, md5({_escaped('text || ' + _CONTROL)}) AS escaped FROM documents")
def f20(spark, sf):
    whole = F.concat("text", F.lit("".join(map(chr, range(1, 32)))))
    return table(spark, sf, "documents").select("doc_id", F.md5(T.escape_json(whole)).alias("escaped"))


@query("f23_json_access", "SELECT event_id, (props->>'$.k')::INTEGER AS k, props->>'$.none' IS NULL AS missing FROM events")
def f23(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.none").isNull().alias("missing"))


@query("f24_hex4", "SELECT event_id, h AS text, CASE WHEN regexp_matches(h, '^[0-9A-Fa-f]{4}$') THEN ('0x' || h)::INTEGER END AS code FROM (SELECT event_id, substr(md5(event_id::VARCHAR), 1, 4 + (event_id % 9 = 0)::INTEGER) AS h FROM events)")
def f24(spark, sf):
    h = F.expr("substr(md5(cast(event_id as string)), 1, 4 + cast(event_id % 9 = 0 as int))")
    return table(spark, sf, "events").select("event_id", h.alias("text"), T.hex4(h).alias("code"))


# --- S, L: sources and lexing -------------------------------------------------------------------------------------

_EXT = "CASE WHEN e = 'py' THEN 'Python' WHEN e IN ('js', 'mjs', 'cjs') THEN 'JavaScript' WHEN e IN ('ts', 'tsx') THEN 'TypeScript' WHEN e IN ('c', 'h') THEN 'C' WHEN e IN ('cpp', 'cxx', 'cc', 'hpp', 'hxx') THEN 'Cpp' ELSE 'Unknown' END"
_EXTS = "py js ts cpp c h xyz jsx tsx hpp".split()
_PICK = "list_extract(" + "[" + ", ".join(lit(x) for x in _EXTS) + "], (doc_id % 10)::INTEGER + 1)"


@query("l01_detect_language", f"SELECT doc_id, {_EXT} AS language FROM (SELECT doc_id, {_PICK} AS e FROM documents)")
def l01(spark, sf):
    path = F.concat(F.lit("dir/doc."), F.element_at(F.array(*map(F.lit, _EXTS)), (F.col("doc_id") % 10).cast("int") + 1))
    return table(spark, sf, "documents").select("doc_id", T.language_of(path).alias("language"))


def _tokens(spark, sf):
    return tokens(code_files(table(spark, sf, "documents")))


def digests(rows: DataFrame) -> DataFrame:
    """(file, n, digest) of each source with tokens: how many it has, and a hash of all of them in order, made as they are read.

    Tokens lie in place source by source, as tokens and unified_tokens give them, so that nothing is shuffled, sorted or gathered.
    """
    one = F.concat_ws(":", *[F.col(c).cast("string") for c in ("pos", "kind")], F.md5("raw"), *[F.col(c).cast("string") for c in ("start", "end", "line", "col")])

    def hashed(batches):
        row, now, name, n = None, None, None, 0
        for batch in batches:
            rows, files, said, done = batch.column("row").to_numpy(), batch.column("file"), batch.column("r").to_pylist(), []
            bounds = [0, *(np.flatnonzero(np.diff(rows)) + 1).tolist(), len(rows)] if len(rows) else []
            for a, b in pairwise(bounds):
                if n and rows[a] != row:
                    done.append((name, n, now.hexdigest()))
                    n = 0
                if not n:
                    row, now, name = rows[a], hashlib.md5(), files[a].as_py()
                now.update(("," * (n > 0) + ",".join(said[a:b])).encode())
                n += b - a
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(DIGEST.names, d, strict=True)) for d in done], schema=DIGEST)
        if n:
            yield pa.RecordBatch.from_pylist([dict(zip(DIGEST.names, (name, n, now.hexdigest()), strict=True))], schema=DIGEST)

    return rows.select("row", "file", one.alias("r")).mapInArrow(hashed, "file string, n long, digest string")


@query(
    "l02_tokens_python",
    sql_tokens(SQL_CODE) + "SELECT file, count(*) AS n, md5(string_agg(concat_ws(':', pos, kind, md5(raw), start, \"end\", line, col), ',' ORDER BY pos)) AS digest FROM tok GROUP BY file",
)
def l02(spark, sf):
    """A digest of all tokens of each file, in order."""
    return digests(_tokens(spark, sf))


@query("l02_token_kinds_of_prose", sql_tokens(SQL_TEXT) + "SELECT kind, count(*) AS n, sum(start)::BIGINT AS starts, sum(line)::BIGINT AS lines, sum(col)::BIGINT AS cols FROM tok GROUP BY kind")
def l02b(spark, sf):
    rows = tokens(text_files(table(spark, sf, "documents")))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"), F.sum("line").alias("lines"), F.sum("col").alias("cols"))


_JS = f"SELECT page_id, unnest(regexp_extract_all(html, {lit(C.SQL_JAVASCRIPT)})) AS raw FROM pages"


@query("l03_tokens_javascript", f"SELECT page_id, count(*) AS n, sum(strlen(raw))::BIGINT AS bytes FROM ({_JS}) WHERE NOT regexp_matches(raw, '^[ \\t\\r\\n\\x0B\\x0C]') GROUP BY page_id")
def l03(spark, sf):
    rows = spread(table(spark, sf, "pages")).select(F.col("page_id").cast("string").alias("file"), F.col("html").alias("source"), F.lit("JavaScript").alias("language"))
    return tokens(rows, end=False).groupBy(F.col("file").cast("long").alias("page_id")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("bytes"))


@query("l04_tokens_cpp", sql_tokens("SELECT url AS file, html AS source FROM pages", "Cpp").replace("PARTITION BY file ORDER BY pos", "PARTITION BY file, n ORDER BY pos").replace("SELECT file,", "SELECT file, n,").replace("AS source FROM pages", "AS source, row_number() OVER () AS n FROM pages") + "SELECT file, kind, count(*) AS count FROM tok GROUP BY file, kind")
def l04(spark, sf):
    rows = spread(table(spark, sf, "pages")).select(F.col("url").alias("file"), F.col("html").alias("source"), F.lit("Cpp").alias("language"))
    return tokens(rows).groupBy("file", "kind").count()


# --- R: rules -----------------------------------------------------------------------------------------------------


def _rule(rule: str):
    def run(spark, sf):
        found = R.find(code_files(table(spark, sf, "documents")), [rule])
        return found.select("file", "rule_id", "severity", "message", "identifier", "line", "col", "start", "end", F.array_join("fixes", "|").alias("fixes"))

    return run


def _found(rule: str, severity: str, message: str, where: str, fixes: str = "''", identifier: str = "raw", source: str = "tok") -> str:
    return f"SELECT file, '{rule}' AS rule_id, '{severity}' AS severity, {message} AS message, {identifier} AS identifier, line, col, start, \"end\", {fixes} AS fixes FROM {source} WHERE {where}"


def _around(a: str, b: str) -> str:
    return f"concat({lit(a)}, raw, {lit(b)})"


_TOK = sql_tokens(SQL_CODE)
_RULE_SQL = {
    "VL001": " UNION ALL ".join([
        _found("VL001", "warning", _around(*C.MESSAGES["VL001"]), "cls IN ('PureVietnamese', 'MixedVietnamese')", f"{snake('raw')} || '|' || {camel('raw')}"),
        _found("VL002", "warning", _around(*C.MESSAGES["VL001_MIXED"]), "cls = 'MixedVietnamese'", plain("raw")),
        _found("VL003", "info", _around(*C.MESSAGES["VL001_PLAIN"]), "cls = 'TransliteratedViet'"),
    ]),
    "VL002": _found("VL002", "info", lit(C.MESSAGES["VL002"]), f"kind IN {_COMMENT} AND hv AND regexp_matches(raw, '[A-Za-z]')", identifier="''"),
    "VL003": _found("VL003", "warning", lit(C.MESSAGES["VL003"]), "kind = 'EncodingDecl' AND NOT contains(raw, 'utf-8') AND NOT contains(raw, 'utf8')", "'# -*- coding: utf-8 -*-'", "''"),
    "VL004": _found("VL004", "info", _around(*C.MESSAGES["VL004"]), f"cls = 'TransliteratedViet' AND {low('raw')} NOT IN {words(C.PASSED)}", plain("raw")),
    "VL005": _found("VL005", "error", _around(*C.MESSAGES["VL005"]), "cls IS NOT NULL AND regexp_matches(raw, '(?s).[\\x{300}-\\x{36F}]')"),
    "VL007": _found("VL007", "info", lit(C.MESSAGES["VL007"]), "kind = 'StringLiteral' AND hv", identifier="''"),
    "VL-EX-001": _found("VL-EX-001", "warning", _around(*C.MESSAGES["VL-EX-001"]), f"cls IS NOT NULL AND regexp_matches(raw, {lit(C.PHONE)})", "'phone_number|phoneNumber'"),
    "VL-EX-002": _found("VL-EX-002", "info", "concat('Abbreviation ''', raw, ''' may mean ', CASE " + " ".join(f"WHEN {low('raw')} = '{k}' THEN {lit(v)}" for k, v in C.SHORT.items()) + " END)", f"cls IS NOT NULL AND strlen(raw) = 2 AND {low('raw')} IN {words(C.SHORT)}"),
    "VL009": _found(
        "VL009", "warning", lit(C.MESSAGES["VL009"]), "m = 1 AND kind = 'StringLiteral' AND hv", identifier="''",
        source="(SELECT *, last_value(CASE WHEN raw IN ('raise', 'throw') THEN 1 WHEN cls IS NOT NULL OR kind = 'Punctuation' THEN NULL ELSE 0 END IGNORE NULLS) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM tok)",
    ),
    "VL011": _found(
        "VL011", "warning", _around(*C.MESSAGES["VL011"]), "p = 'as' AND raw <> 'as' AND cls IN ('TransliteratedViet', 'PureVietnamese', 'MixedVietnamese')",
        source="(SELECT *, lag(raw) OVER (PARTITION BY file ORDER BY pos) AS p FROM tok)",
    ),
    "VL008": _found(
        "VL008", "warning", _around(*C.MESSAGES["VL008"])[:-1] + ", CASE WHEN s >= c THEN 'snake_case' ELSE 'camelCase' END, '.')",
        "s > 0 AND c > 0 AND CASE WHEN s < c THEN is_s ELSE is_c END",
        source="(SELECT *, count(*) FILTER (is_s) OVER (PARTITION BY file) AS s, count(*) FILTER (is_c) OVER (PARTITION BY file) AS c FROM (SELECT *, coalesce(cls = 'TransliteratedViet' AND contains(raw, '_'), false) AS is_s, coalesce(cls = 'TransliteratedViet' AND NOT contains(raw, '_') AND regexp_matches(substr(raw, 2), '[A-Z]'), false) AS is_c FROM tok))",
    ),
    "VL006": f"""SELECT file, 'VL006' AS rule_id, 'info' AS severity, concat({lit(C.MESSAGES["VL006"][0])}, d, {lit(C.MESSAGES["VL006"][1])}) AS message, '' AS identifier, line, col, start, "end", '' AS fixes
FROM (SELECT *, CASE greatest(a, b, c, e) WHEN a THEN 'snake_case' WHEN b THEN 'camelCase' WHEN c THEN 'PascalCase' ELSE 'SCREAMING_SNAKE' END AS d, a + b + c + e AS t FROM
  (SELECT file, count(*) FILTER (st = 'SnakeCase') AS a, count(*) FILTER (st = 'CamelCase') AS b, count(*) FILTER (st = 'PascalCase') AS c, count(*) FILTER (st = 'ScreamingSnake') AS e,
     arg_min(line, pos) AS line, arg_min(col, pos) AS col, arg_min(start, pos) AS start, arg_min("end", pos) AS "end"
   FROM (SELECT *, CASE WHEN cls IS NOT NULL AND strlen(raw) > 1 THEN {style('raw')} END AS st FROM tok) GROUP BY file))
WHERE t > 0 AND (d <> 'snake_case' AND a * 20 > t)::INT + (d <> 'camelCase' AND b * 20 > t)::INT + (d <> 'PascalCase' AND c * 20 > t)::INT + (d <> 'SCREAMING_SNAKE' AND e * 20 > t)::INT >= 2""",
    "VL010": f"SELECT file, 'VL010' AS rule_id, 'info' AS severity, {_around(*C.MESSAGES['VL010'])}"
    """ AS message, raw AS identifier, line, col, start, "end", '' AS fixes
FROM (
  SELECT file, seg, min(CASE WHEN opens THEN raw END) AS raw, min(CASE WHEN opens THEN line END) AS line, min(CASE WHEN opens THEN col END) AS col, min(CASE WHEN opens THEN start END) AS start, min(CASE WHEN opens THEN "end" END) AS "end",
         arg_min(event, pos) FILTER (event IS NOT NULL) AS e
  FROM (
    SELECT *, CASE WHEN nm OR (kind = 'Keyword' AND raw = 'def') THEN NULL WHEN kind = 'StringLiteral' AND NOT hv THEN 'clear' WHEN line > max(CASE WHEN opens THEN line END) OVER (PARTITION BY file, seg) + 5 THEN 'flag' END AS event
    FROM (
      SELECT *, sum(opens::INT) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg
      FROM (
        SELECT *, coalesce(cls IS NOT NULL AND df = 1, false) AS nm, coalesce(cls = 'TransliteratedViet' AND df = 1, false) AS opens
        FROM (SELECT *, last_value(CASE WHEN kind = 'Keyword' AND raw = 'def' THEN 1 WHEN cls IS NOT NULL THEN 0 END IGNORE NULLS) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS df FROM tok)
      )
    ) WHERE seg > 0
  ) GROUP BY file, seg
) WHERE e = 'flag'""",
}
for _rule_id, _sql in _RULE_SQL.items():
    _n = "r13" if _rule_id == "VL-EX-002" else "r12" if _rule_id == "VL-EX-001" else f"r{int(_rule_id[2:]):02d}"
    QUERIES[f"{_n}_{_rule_id.lower().replace('-', '_')}"] = _rule(_rule_id)
    ORACLE_SQL[f"{_n}_{_rule_id.lower().replace('-', '_')}"] = _TOK + _sql

#: All rules' findings in SQL, with the rule that registered each.
_ALL = _TOK + ", found AS (" + " UNION ALL ".join(f"SELECT *, '{k}' AS source_rule FROM ({v})" for k, v in _RULE_SQL.items() if k.startswith("VL0")) + ")"


#: The same source with comments and throws of the other languages, and the rules that they have.
_OTHER = {"JavaScript": ("VL003", "VL010"), "Cpp": ("VL003", "VL010", "VL011")}


def _other_source(s: str) -> str:
    return s.replace("'# ", "'// ").replace("'    raise ", "'    throw ")


def _other_rules(language: str) -> None:
    def run(spark, sf):
        made = F.expr(_other_source(_SNIPPET.format(s="_s", q=_QUOTED.format(s="_s"))))
        rows = spread(table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("_s"))).select(F.col("doc_id").cast("string").alias("file"), made.alias("source"), F.lit(language).alias("language"))
        found = R.find(rows).groupBy("file", "rule_id", "severity")
        n = lambda c: F.sum(c).alias(c)
        return found.agg(F.count(F.lit(1)).alias("n"), n("start"), n("line"), n("col"), F.sum(F.octet_length("message")).alias("said"), F.sum(F.octet_length(F.array_join("fixes", "|"))).alias("fixes"))

    source = _other_source(SQL_CODE).replace("'doc' || doc_id || '.py' AS file", "doc_id::VARCHAR AS file")
    found = " UNION ALL ".join(f"({v})" for k, v in _RULE_SQL.items() if k.startswith("VL0") and k not in _OTHER[language])
    name = f"r20_rules_{language.lower()}"
    QUERIES[name] = run
    ORACLE_SQL[name] = sql_tokens(source, language) + (
        "SELECT file, rule_id, severity, count(*) AS n, sum(start)::BIGINT AS start, sum(line)::BIGINT AS line, sum(col)::BIGINT AS col, sum(strlen(message))::BIGINT AS said, sum(strlen(fixes))::BIGINT AS fixes "
        f"FROM ({found}) GROUP BY file, rule_id, severity"
    )


for _language in _OTHER:
    _other_rules(_language)


# --- C, X: engine and sinks ---------------------------------------------------------------------------------------


def _lint(spark, sf, config=None):
    return engine.lint(code_files(table(spark, sf, "documents")), config)


@query("c05_lint_counts", _ALL + "SELECT rule_id, severity, count(*) AS n FROM found GROUP BY rule_id, severity")
def c05(spark, sf):
    return _lint(spark, sf).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("c03_effective_severity", _ALL + "SELECT source_rule, CASE WHEN source_rule = 'VL001' THEN 'error' ELSE severity END AS severity, count(*) AS n FROM found WHERE source_rule <> 'VL007' GROUP BY ALL")
def c03(spark, sf):
    config = engine.Config(rules={"VL001": (True, "error"), "VL007": (False, "info")})
    return _lint(spark, sf, config).groupBy("source_rule", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(
    "c04_max_violations",
    _ALL + "SELECT file, source_rule, n FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY file ORDER BY source_rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT file, source_rule, count(*) AS n FROM found GROUP BY file, source_rule)) WHERE b < 12",
)
def c04(spark, sf):
    return _lint(spark, sf, engine.Config(max_violations=12)).groupBy("file", "source_rule").agg(F.count(F.lit(1)).alias("n"))


@query("c06_without_doubles", _ALL + "SELECT rule_id, count(*) AS n FROM found f WHERE NOT (rule_id = 'VL003' AND EXISTS (SELECT 1 FROM found g WHERE g.file = f.file AND g.start = f.start AND g.rule_id = 'VL004')) GROUP BY rule_id")
def c06(spark, sf):
    return engine.without_doubles(_lint(spark, sf)).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@query("c08_exit_code", _ALL + "SELECT max(CASE WHEN severity = 'error' THEN 2 WHEN severity = 'warning' THEN 1 ELSE 0 END)::INTEGER AS exit_code FROM found")
def c08(spark, sf):
    return engine.exit_code(_lint(spark, sf))


@query("c09_stats", _ALL + "SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos FROM found")
def c09(spark, sf):
    return engine.stats(_lint(spark, sf))


_CATALOG = "(VALUES " + ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in C.RULES) + ") t(rule_id, name, description, category, severity)"


@query("c11_rule_catalog", _ALL + f"SELECT t.*, coalesce(n, 0) AS n FROM {_CATALOG} LEFT JOIN (SELECT source_rule, count(*) AS n FROM found GROUP BY source_rule) f ON f.source_rule = t.rule_id")
def c11(spark, sf):
    """The catalog, with what each of its rules found."""
    rules = spark.createDataFrame(C.RULES, "rule_id string, name string, description string, category string, severity string")
    counts = _lint(spark, sf).groupBy(F.col("source_rule").alias("rule_id")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(rules).join(counts, "rule_id", "left").fillna(0, ["n"])


@query("x13_text_lines", _ALL + "SELECT file || ':' || line || ':' || col || ': ' || severity || ' [' || rule_id || '] ' || message AS out FROM found")
def x13(spark, sf):
    return _lint(spark, sf).select(engine.text_line().alias("out"))


@query("x14_github_lines", _ALL + "SELECT '::' || CASE WHEN severity = 'error' THEN 'error' ELSE 'warning' END || ' file=' || file || ',line=' || line || ',col=' || col || '::[' || rule_id || '] ' || message AS out FROM found")
def x14(spark, sf):
    return _lint(spark, sf).select(engine.github_line().alias("out"))


@query("x09_editor_ranges", _ALL + "SELECT file, rule_id, line - 1 AS l, col - 1 AS c, col - 1 + strlen(identifier) AS e, CASE severity WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END AS code FROM found".replace("THEN 1 WHEN 'warning' THEN 2 ELSE 3", "THEN 1 WHEN 'warning' THEN 2 ELSE 3"))
def x09(spark, sf):
    code = F.when(F.col("severity") == "error", 1).when(F.col("severity") == "warning", 2).otherwise(3)
    return _lint(spark, sf).select("file", "rule_id", (F.col("line") - 1).alias("l"), (F.col("col") - 1).alias("c"), (F.col("col") - 1 + F.octet_length("identifier")).cast("long").alias("e"), code.alias("code"))


@query("x06_code_actions", _ALL + "SELECT file, rule_id, start, unnest(string_split(fixes, '|')) AS fix FROM found WHERE fixes <> ''")
def x06(spark, sf):
    return _lint(spark, sf).select("file", "rule_id", "start", F.explode("fixes").alias("fix"))


# --- A, T, U: history ---------------------------------------------------------------------------------------------

SQL_HISTORY = (
    "SELECT event_id AS id, 'p' || (user_id % 50) AS project_id, 'src/File' || (user_id % 97) || '.py' AS file_path, event_type AS rule_id, "
    "CASE (props->>'$.k')::INTEGER % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END AS severity, ts AS created_at FROM events"
)


def _history(spark, sf):
    return history.violations_of(table(spark, sf, "events"))


@query("a04_by_rule", f"SELECT rule_id, count(*) AS cnt, min(severity) AS severity FROM ({SQL_HISTORY}) GROUP BY rule_id")
def a04(spark, sf):
    return history.by_rule(_history(spark, sf))


@query("a05_by_severity", f"SELECT severity, count(*) AS cnt FROM ({SQL_HISTORY}) GROUP BY severity")
def a05(spark, sf):
    return history.by_severity(_history(spark, sf))


@query("a06_top_files", f"SELECT file_path, count(*) AS cnt FROM ({SQL_HISTORY}) GROUP BY file_path ORDER BY cnt DESC, file_path LIMIT 20")
def a06(spark, sf):
    return history.top_files(_history(spark, sf))


@query("t03_search", f"SELECT id, rule_id, severity FROM ({SQL_HISTORY}) WHERE project_id = 'p7' AND lower(file_path) LIKE '%file%' ORDER BY created_at DESC, id LIMIT 100 OFFSET 10")
def t03(spark, sf):
    return history.search(_history(spark, sf), "p7", file_like="FILE", offset=10).select("id", "rule_id", "severity")


@query("u07_delete_project", f"SELECT project_id, count(*) AS cnt FROM ({SQL_HISTORY}) WHERE project_id <> 'p7' GROUP BY project_id")
def u07(spark, sf):
    v = _history(spark, sf)
    gone = spark.createDataFrame([("p7",)], "project_id string")
    return v.join(F.broadcast(gone), "project_id", "left_anti").groupBy("project_id").agg(F.count(F.lit(1)).alias("cnt"))


@query("a07_label_histogram", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic")
def a07(spark, sf):
    return table(spark, sf, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query("x04_latest_versions", "SELECT conv_id, max(turn) AS version, arg_max(length(text), turn) AS n FROM conversations GROUP BY conv_id")
def x04(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("version"), F.max_by(F.length("text"), "turn").cast("long").alias("n"))


# --- E: encodings; M: features ------------------------------------------------------------------------------------


def _hits(charset: str, low: int = 0x80, high: int = 0xFF) -> str:
    """In SQL: how many bytes stand for another character than themselves."""
    return "len(list_filter(regexp_extract_all(v, '[\\x{80}-\\x{FF}]'), lambda c: unicode(c) BETWEEN " + f"{low} AND {high} AND NOT contains({lit(_SAME[charset])}, c)))"


_SAME = {k: "".join(chr(b) for b, c in zip(range(0x80, 0x100), v, strict=True) if ord(c) in (b, 0xFFFD)) for k, v in C.CHARSETS.items()}
_UNIT = "[\\x00-\\x7F]|[\\x{C2}-\\x{DF}][\\x{80}-\\x{BF}]|[\\x{E0}-\\x{EF}][\\x{80}-\\x{BF}]{2}|[\\x{F0}-\\x{FF}][\\x{80}-\\x{BF}]{3}"
_DETECT = f"""
WITH raw AS (
  SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN array_to_string(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda p: chr(('0x' || p)::INTEGER)), '')
    ELSE regexp_replace(translate(text, {lit(C.CHARSETS['tcvn3'])}, {lit(C.HIGH_BYTES)}), '[^\\x{{00}}-\\x{{FF}}]', '?', 'g') END AS bytes FROM documents
),
views AS (SELECT doc_id, bytes, substr(bytes, 1, 8192) AS v FROM raw),
counted AS (
  SELECT *, {count('v', '[\\x{80}-\\x{FF}]')} AS high, length(v) AS total, {_hits('tcvn3', 0x80, 0xDF)} AS t, {_hits('vni')} AS n, {_hits('windows-1258')} AS w, {count('v', _UNIT)} AS units, {count('v', _UNIT + '|(?s:.)')} AS parts FROM views
),
scored AS (
  SELECT *, CASE WHEN high > total * 0.08 THEN 0.8::DOUBLE * t / high ELSE 0 END AS st, CASE WHEN high > total * 0.05 THEN 0.75::DOUBLE * n / high ELSE 0 END AS sn,
         CASE WHEN total > 0 THEN 0.7::DOUBLE * w / total ELSE 0 END AS sw, CASE WHEN total > 0 THEN units::DOUBLE / parts ELSE 1 END AS su FROM counted
),
told AS (
  SELECT doc_id, starts_with(v, chr(239) || chr(187) || chr(191)) AS bom,
         CASE WHEN bytes = '' THEN 'us-ascii' WHEN starts_with(v, chr(239) || chr(187) || chr(191)) THEN 'utf-8-sig' WHEN high = 0 THEN 'us-ascii' WHEN su >= 0.99 THEN 'utf-8' WHEN st >= greatest(sn, sw, su) THEN 'tcvn3' WHEN sn >= greatest(sw, su) THEN 'vni' WHEN sw >= su THEN 'windows-1258' ELSE 'utf-8' END AS encoding
  FROM scored
)
SELECT doc_id, encoding, coalesce(bom, false) AS has_bom, encoding IN ('tcvn3', 'vni', 'windows-1258') AS needs_conversion FROM told"""


@query("e01_detect", _DETECT)
def e01(spark, sf):
    raw = F.when(F.col("doc_id") % 4 == 0, F.encode("text", "UTF-8")).otherwise(F.encode(F.translate("text", C.CHARSETS["tcvn3"], C.HIGH_BYTES), "ISO-8859-1"))
    return table(spark, sf, "documents").select("doc_id", E.detect(raw).alias("d")).select("doc_id", "d.encoding", "d.has_bom", "d.needs_conversion")


_LATIN = "regexp_replace(text, '[^\\x00-\\xFF]', '?', 'g')"


@query("e06_convert", "SELECT doc_id, " + ", ".join(f"md5(translate({_LATIN}, {lit(C.HIGH_BYTES)}, {lit(v)})) AS {k.replace('-', '_')}" for k, v in C.CHARSETS.items()) + " FROM documents")
def e06(spark, sf):
    raw = F.encode(F.regexp_replace("text", r"[^\x00-\xFF]", "?"), "ISO-8859-1")
    return table(spark, sf, "documents").select("doc_id", *[F.md5(F.encode(E.convert(raw, k), "UTF-8")).alias(k.replace("-", "_")) for k in C.CHARSETS])


@query("m01_features")
def m01(spark, sf):
    return names(spark, sf).select("id", M.features(F.col("id")).alias("features"))


@query(
    "m01_feature_counts",
    f"SELECT id, strlen(id)::INTEGER AS bytes, {fast('id')} AS fast, CASE WHEN strlen(id) <= 1 THEN 0 WHEN strlen(id) <= 3 THEN 1 WHEN strlen(id) <= 7 THEN 2 WHEN strlen(id) <= 15 THEN 3 WHEN strlen(id) <= 31 THEN 4 ELSE 5 END AS bucket, "
    f"{count('id', C.MARK)}::INTEGER AS marks, {count('id', '[A-Z]')}::INTEGER AS upper, {count('id', '[0-9]')}::INTEGER AS digits FROM ({SQL_NAMES})",
)
def m01c(spark, sf):
    s = F.col("id")
    n = lambda p: F.regexp_count(s, F.lit(p)).cast("int")
    return names(spark, sf).select("id", F.octet_length(s).alias("bytes"), T.has_vietnamese(s).alias("fast"), M.length_bucket(s).alias("bucket"), n(C.MARK).alias("marks"), n("[A-Z]").alias("upper"), n("[0-9]").alias("digits"))
