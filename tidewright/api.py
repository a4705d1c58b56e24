"""The public API: an engine, a classifier, a detector, functions of text, and SQL functions by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import constants as C
from .functions import text as T
from .functions.features import features
from .operators import encoding as E
from .plans import config, engine, reports
from .sources import files

#: Names of the 64 features, in order.
FEATURE_NAMES = (
    "unicode_ratio viet_ratio ascii_ratio combining_ratio length_bucket byte_length has_viet has_underscore has_hyphen style_snake style_camel style_pascal style_screaming style_mixed upper_ratio lower_ratio digit_ratio "
    "starts_upper starts_underscore ends_digit"
).split() + [f"block_{i}" for i in range(8)] + [f"bigram_{i}" for i in range(16)] + [f"trigram_{i}" for i in range(16)] + [f"reserved_{i}" for i in range(4)]
SCHEMA = "file string, source string, language string"
FORMATS = {"text": engine.text_line, "gcc": reports.gcc_line, "github": engine.github_line, "json": reports.json_record}


class LintEngine:
    """Lints strings, files and DataFrames of sources under one configuration."""

    def __init__(self, spark: SparkSession, configuration: engine.Config | str | None = None):
        self.spark = spark
        self.config = config.parse_config(configuration).lint if isinstance(configuration, str) else configuration or engine.Config()

    def lint(self, sources: DataFrame) -> DataFrame:
        """Diagnostics of (file, source, language)."""
        return engine.lint(sources, self.config)

    def lint_source(self, source: str, file: str = "input.py") -> DataFrame:
        rows = self.spark.createDataFrame([(file, source)], "file string, source string")
        return self.lint(rows.withColumn("language", T.language_of(F.col("file"))))

    def lint_files(self, *paths: str) -> DataFrame:
        """Diagnostics of files and of the source files below folders."""
        return self.lint(files.named_files(self.spark, list(paths)))

    def format(self, diagnostics: DataFrame, form: str = "text") -> DataFrame:
        """(out): a line a diagnostic, in one of FORMATS."""
        return diagnostics.select(FORMATS[form]().alias("out"))


def classify(names: DataFrame) -> DataFrame:
    """names (id, ...) with class, style, ratio and confidence."""
    name = F.col("id")
    cls = T.identifier_class(name)
    return names.select("*", cls.alias("class"), T.naming_style(name).alias("style"), T.vietnamese_ratio(name).alias("ratio"), T.class_confidence(cls).alias("confidence"))


def detect_encoding(content: DataFrame) -> DataFrame:
    """content (path, content) with what E.detect says."""
    return content.select("path", E.detect(F.col("content")).alias("d")).select("path", "d.*")


def feature_table(names: DataFrame) -> DataFrame:
    """names (id, ...) with a column a feature."""
    rows = names.withColumn("_f", features(F.col("id")))
    return rows.select(*names.columns, *[F.get("_f", F.lit(i)).alias(n) for i, n in enumerate(FEATURE_NAMES)])


def _language_sql() -> str:
    cases = (("Python", "py"), ("JavaScript", "js mjs cjs"), ("TypeScript", "ts tsx"), ("C", "c h"), ("Cpp", "cpp cxx cc hpp hxx"))
    return "CASE regexp_extract(s, r'\\.([^.]*)$', 1) " + " ".join(f"WHEN '{e}' THEN '{name}'" for name, es in cases for e in es.split()) + " ELSE 'Unknown' END"


def register(spark: SparkSession) -> list[str]:
    """Temporary SQL functions over strings, as SQL expressions that the optimizer sees into; their names."""
    quoted = lambda p: "r'" + p + "'"
    made = {
        "tw_has_vietnamese": ("BOOLEAN", f"s RLIKE {quoted(C.FAST)}"),
        "tw_has_exact_vietnamese": ("BOOLEAN", f"s RLIKE {quoted(C.EXACT)}"),
        "tw_count_vietnamese": ("INT", f"CASE WHEN s RLIKE {quoted(C.FAST)} THEN regexp_count(s, {quoted(C.EXACT)}) ELSE 0 END"),
        "tw_ascii_name": ("STRING", f"regexp_replace(translate(s, '{C.STRIPPED}', '{C.BASES}'), r'[^\\x00-\\x7F]', '?')"),
    }
    word_list = lambda words: ", ".join(f"'{w}'" for w in words)
    low = f"translate(s, '{T.UPPER}', '{T.LOWER}')"
    parts = f"filter(split(regexp_replace({low}, '^_+|_+$', ''), '_'), p -> p <> '')"
    plain, letters = made["tw_ascii_name"][1], "length(translate(s, '_-', ''))"
    marked = f"regexp_count(s, {quoted(C.EXACT)})"
    made |= {
        "tw_count_marked": ("INT", marked),
        "tw_ratio": ("DOUBLE", f"CASE WHEN {letters} = 0 THEN 0D ELSE {marked} / {letters} END"),
        "tw_style": (
            "STRING",
            "CASE WHEN s = '' THEN 'Unknown' WHEN octet_length(s) = 1 THEN 'SingleLetter' WHEN instr(s, '-') > 0 THEN 'KebabCase' WHEN instr(s, '_') > 0 AND NOT s RLIKE '[a-z]' THEN 'ScreamingSnake' WHEN instr(s, '_') > 0 THEN 'SnakeCase' "
            "WHEN s RLIKE '^[A-Z]' AND s RLIKE '[a-z]' THEN 'PascalCase' WHEN s RLIKE '^[a-z]' AND s RLIKE '[A-Z]' THEN 'CamelCase' ELSE 'Unknown' END",
        ),
        "tw_is_transliteration": (
            "BOOLEAN",
            f"regexp_replace({low}, '^_+|_+$', '') IN ({word_list(C.WORDS)}) OR (size({parts}) >= 2 AND forall({parts}, p -> array_contains(array({word_list(C.WORDS)}), p)))",
        ),
        "tw_snake_name": ("STRING", f"translate(regexp_replace({plain}, '([^A-Z])([A-Z])', '$1_$2'), '{T.UPPER}', '{T.LOWER}')"),
        "tw_camel_name": ("STRING", f"concat(translate(substr({plain}, 1, 1), '{T.UPPER}', '{T.LOWER}'), substr({plain}, 2))"),
        "tw_language": ("STRING", _language_sql()),
    }
    made["tw_class"] = (
        "STRING",
        f"CASE WHEN s IN ({word_list(C.ABBREVIATIONS)}) THEN 'Abbreviation' WHEN {marked} = 0 AND ({made['tw_is_transliteration'][1]}) THEN 'TransliteratedViet' WHEN {marked} = 0 THEN 'PureASCII' "
        f"WHEN {marked} * 10 >= {letters} * 9 THEN 'PureVietnamese' ELSE 'MixedVietnamese' END",
    )
    made["tw_confidence"] = ("DOUBLE", "CASE s " + " ".join(f"WHEN '{k}' THEN {v}D" for k, v in T.CONFIDENCE.items()) + " END")
    for name, (kind, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s STRING) RETURNS {kind} RETURN {body}")
    return list(made)
