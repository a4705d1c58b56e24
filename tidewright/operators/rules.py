"""The rule catalog as DataFrame plans over tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from .lexer import KINDS_OF_COMMENTS, KINDS_OF_NAMES
from .marks import marked_tokens

OUT = ["row", "file", "source_rule", "rule_id", "severity", "message", "identifier", "line", "col", "start", "end", "fixes"]
NO_FIX = "cast(array() as array<string>)"
#: Rules that find something only at single tokens that are not ASCII.
MARKED = frozenset(("VL002", "VL005", "VL007"))
#: A condition on a token, and the columns of what is found where it holds.
Finding = tuple[Column, dict[str, Column]]


def analysed(tokens: DataFrame) -> DataFrame:
    """tokens with cls, the class of names (null for other tokens). It is exploded, one row each, so that conditions on it are not moved below it, where
    each of them would tell the class anew."""
    cls = F.when(F.col("kind").isin(*KINDS_OF_NAMES), T.identifier_class(F.col("raw")))
    rows = tokens.select("*", cls.alias("cls"))
    return rows.select(*tokens.columns, F.explode(F.array("cls")).alias("cls"))


def _finding(source_rule: str, rule: str, severity: str, message: Column, fixes: Column | None = None, named: bool = True) -> dict[str, Column]:
    return {
        "source_rule": F.lit(source_rule), "rule_id": F.lit(rule), "severity": F.lit(severity), "message": message,
        "identifier": F.col("raw") if named else F.lit(""), "fixes": F.expr(NO_FIX) if fixes is None else fixes,
    }


def _says(*parts: str) -> Column:
    """Text around the token."""
    return F.concat(F.lit(parts[0]), F.col("raw"), F.lit(parts[1]))


def local_findings() -> dict[str, list[Finding]]:
    """By registering rule: the findings that a token makes by itself, each with its condition."""
    raw, cls, kind = F.col("raw"), F.col("cls"), F.col("kind")
    name, comment = cls.isNotNull(), kind.isin(*KINDS_OF_COMMENTS)
    snake, camel, plain = T.snake_name(raw), T.camel_name(raw), T.ascii_name(raw)
    return {
        "VL001": [
            (cls.isin("PureVietnamese", "MixedVietnamese"), _finding("VL001", "VL001", "warning", _says(*C.MESSAGES["VL001"]), F.array(snake, camel))),
            (cls == "MixedVietnamese", _finding("VL001", "VL002", "warning", _says(*C.MESSAGES["VL001_MIXED"]), F.array(plain))),
            (cls == "TransliteratedViet", _finding("VL001", "VL003", "info", _says(*C.MESSAGES["VL001_PLAIN"]))),
        ],
        "VL002": [(comment & F.col("has_vietnamese") & raw.rlike("[A-Za-z]"), _finding("VL002", "VL002", "info", F.lit(C.MESSAGES["VL002"]), named=False))],
        "VL003": [
            (
                (F.col("language") == "Python") & (kind == "EncodingDecl") & (F.instr(raw, "utf-8") == 0) & (F.instr(raw, "utf8") == 0),
                _finding("VL003", "VL003", "warning", F.lit(C.MESSAGES["VL003"]), F.array(F.lit("# -*- coding: utf-8 -*-")), named=False),
            )
        ],
        "VL004": [((cls == "TransliteratedViet") & ~T.ascii_lower(raw).isin(C.PASSED), _finding("VL004", "VL004", "info", _says(*C.MESSAGES["VL004"]), F.array(plain)))],
        "VL005": [(name & raw.rlike(r"(?s).[\x{300}-\x{36F}]"), _finding("VL005", "VL005", "error", _says(*C.MESSAGES["VL005"])))],
        "VL007": [((kind == "StringLiteral") & F.col("has_vietnamese"), _finding("VL007", "VL007", "info", F.lit(C.MESSAGES["VL007"]), named=False))],
        "VL-EX-001": [(name & raw.rlike(C.PHONE), _finding("VL-EX-001", "VL-EX-001", "warning", _says(*C.MESSAGES["VL-EX-001"]), F.array(F.lit("phone_number"), F.lit("phoneNumber"))))],
        "VL-EX-002": [
            (
                name & (F.octet_length(raw) == 2) & T.ascii_lower(raw).isin(list(C.SHORT)),
                _finding("VL-EX-002", "VL-EX-002", "info", F.concat(_says(*C.MESSAGES["VL-EX-002"]), F.element_at(F.create_map(*[F.lit(x) for kv in C.SHORT.items() for x in kv]), T.ascii_lower(raw)))),
            )
        ],
    }


def in_file(tokens: DataFrame, rules: list[str], kept: Column) -> DataFrame:
    """The tokens that ``kept`` or a rule beyond single tokens may find something at, with what those rules ask of their file, for token tables of any making;
    marks.marked_tokens tells the same where it cuts sources.

    All windows are within a source's row and follow its tokens, so that one exchange and one sort serve them. What they ask of other tokens are a few
    marks: the texts of those stay behind. Rules of single tokens alone need none.
    """
    raw, kind, name = F.col("raw"), F.col("kind"), F.col("cls").isNotNull()
    file = Window.partitionBy("row")
    order = file.orderBy("pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    viet = F.col("cls").isin(*VIETNAMESE)
    text = (kind == "StringLiteral") & F.col("has_vietnamese")
    marks: dict[str, Column] = {}
    add: dict[str, Column] = {}
    if "VL006" in rules:
        marks["_style"] = F.when(name & (F.octet_length(raw) > 1), T.naming_style(raw))
        add |= {f"_{k}": F.count_if(F.col("_style") == v).over(file) for k, v in STYLES.items()}
        add["_first"] = F.row_number().over(order) == 1
    if "VL008" in rules:
        kept = kept | (F.col("cls") == "TransliteratedViet")
        marks["_snake"], marks["_camel"] = _transliterations()
        add |= {"_s": F.count_if("_snake").over(file), "_c": F.count_if("_camel").over(file)}
    if "VL009" in rules:
        kept = kept | text
        marks["_raise"] = F.when(raw.isin("raise", "throw"), 1).when(name | (kind == "Punctuation"), None).otherwise(0)
        add["_raised"] = F.last("_raise", ignorenulls=True).over(before) == 1
    if "VL010" in rules:
        kept = kept | (F.col("cls") == "TransliteratedViet")
        marks["_def"] = F.when((kind == "Keyword") & (raw == "def"), 1).when(name, 0)
        marks["_clear"] = (kind == "StringLiteral") & ~F.col("has_vietnamese")
        add["_defined"] = F.last("_def", ignorenulls=True).over(before)
    if "VL011" in rules:
        kept = kept | viet
        marks["_as"] = raw == "as"
        add["_previous_as"] = F.lag("_as").over(order)
    kept = F.coalesce(kept, F.lit(False))
    short = {c: F.when(kept, F.col(c)).alias(c) for c in ("raw", "kind", "cls", "has_vietnamese")}
    rows = tokens.select(*[short.get(c, F.col(c)) for c in tokens.columns], kept.alias("_kept"), *[v.alias(k) for k, v in marks.items()]).withColumns(add)
    rows = rows.drop("_style", "_raise", "_as")
    if "VL006" in rules:
        rows = rows.withColumn("_kept", F.col("_kept") | F.col("_first"))
    if "VL010" not in rules:
        return rows.where("_kept")
    # a name after def opens a stretch, in which the first string without marks or the first token of a later line decides: of a line, one token can be that
    named = (F.col("_def") == 0) & (F.col("_defined") == 1)
    other = ~F.col("_clear") & ~F.coalesce(named | (F.col("_def") == 1), F.lit(False))
    rows = rows.withColumns({"_opens": F.coalesce(named & (F.col("cls") == "TransliteratedViet"), F.lit(False)), "_other": other})
    rows = rows.withColumn("_other", F.col("_other") & ~F.coalesce(F.max(F.when(F.col("_other"), F.col("line"))).over(before) == F.col("line"), F.lit(False)))
    rows = rows.where(F.col("_kept") | F.col("_clear") | F.col("_other"))
    rows = rows.withColumn("_line", F.last(F.when(F.col("_opens"), F.col("line")), ignorenulls=True).over(upto))
    event = F.when(F.col("_clear"), "clear").when(F.col("_other") & (F.col("line") > F.col("_line") + 5), "flag").when(F.col("_opens"), "opens")
    later = order.rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn("_event", event).where(F.col("_kept") | F.col("_event").isNotNull()).withColumn("_flag", F.col("_opens") & (F.first("_event", ignorenulls=True).over(later) == "flag")).where("_kept")


#: Classes of names that are Vietnamese.
VIETNAMESE = ("TransliteratedViet", "PureVietnamese", "MixedVietnamese")
#: Naming styles that a file may be dominated by, in order of precedence.
STYLES = {"snake_case": "SnakeCase", "camelCase": "CamelCase", "PascalCase": "PascalCase", "SCREAMING_SNAKE": "ScreamingSnake"}


def _transliterations() -> tuple[Column, Column]:
    """Whether a token is a transliteration in snake case, or in camel case."""
    raw, translit = F.col("raw"), F.coalesce(F.col("cls") == "TransliteratedViet", F.lit(False))
    return translit & (F.instr(raw, "_") > 0), translit & (F.instr(raw, "_") == 0) & raw.rlike("(?s)^.[^A-Z]*[A-Z]")


def _mixed_styles() -> Finding:
    """VL006, at a file's first token: at least two styles beside the dominant one hold over 5 %."""
    count = {k: F.col(f"_{k}") for k in STYLES}
    top, total = F.greatest(*count.values()), reduce(lambda a, b: a + b, count.values())
    dominant = reduce(lambda rest, k: F.when(count[k] == top, k).otherwise(rest), reversed(STYLES), F.lit(None))
    others = reduce(lambda a, b: a + b, [F.when((dominant != k) & (n * 20 > total), 1).otherwise(0) for k, n in count.items()])
    message = F.concat(F.lit(C.MESSAGES["VL006"][0]), dominant, F.lit(C.MESSAGES["VL006"][1]))
    return (F.col("_first") & (total > 0) & (others >= 2), _finding("VL006", "VL006", "info", message, named=False))


def _inconsistent_transliteration() -> Finding:
    """VL008: where a file has snake and camel transliterations, names of the rarer style (camel on a tie)."""
    rare = (F.col("_s") > 0) & (F.col("_c") > 0) & F.when(F.col("_s") < F.col("_c"), F.col("_snake")).otherwise(F.col("_camel"))
    dominant = F.when(F.col("_s") >= F.col("_c"), "snake_case").otherwise("camelCase")
    message = F.concat(_says(*C.MESSAGES["VL008"]), dominant, F.lit("."))
    return (rare, _finding("VL008", "VL008", "warning", message))


def file_findings() -> dict[str, Finding]:
    """By rule: the finding that a token makes in its file, with its condition, by the columns of in_file."""
    raw, kind = F.col("raw"), F.col("kind")
    return {
        "VL006": _mixed_styles(),
        "VL008": _inconsistent_transliteration(),
        "VL009": (
            F.col("_raised") & (kind == "StringLiteral") & F.col("has_vietnamese"),
            _finding("VL009", "VL009", "warning", F.lit(C.MESSAGES["VL009"]), named=False),
        ),
        "VL010": (
            (F.col("language") == "Python") & F.col("_flag"),
            _finding("VL010", "VL010", "info", _says(*C.MESSAGES["VL010"])),
        ),
        "VL011": (
            F.col("language").isin("Python", "JavaScript") & F.col("_previous_as") & (raw != "as") & F.col("cls").isin(*VIETNAMESE),
            _finding("VL011", "VL011", "warning", _says(*C.MESSAGES["VL011"])),
        ),
    }


BUILT_IN = tuple(r[0] for r in C.RULES)


def run_rules(tokens: DataFrame, rules: list[str] | tuple[str, ...] = BUILT_IN) -> DataFrame:
    """Findings of the named rules over tokens (with their EndOfFile rows), all in one pass over them; none without rules."""
    rows = analysed(tokens)
    found, beyond = _asked(rules)
    if beyond:
        rows = in_file(rows, list(rules), _some(found))
    return _findings(rows, found + beyond)


def find(sources: DataFrame, rules: list[str] | tuple[str, ...] = BUILT_IN) -> DataFrame:
    """Findings of the named rules in (file, source, language), as run_rules has them of their tokens; with a column ``_why``, a VL000 for each source that has one.

    Only tokens that a rule may find something at leave the lexer, with their marks. Where rules of a whole file are asked for they are dealt by source
    once, so that windows by source (limits, doubles, fixes) take no further exchange, and what is found is not made where files happened to lie.
    """
    found, beyond = _asked(rules)
    if "_why" in sources.columns:
        broken = _finding("VL000", "VL000", "error", F.concat(F.lit("Lexer error: "), F.col("_why")), named=False)
        found = [*found, (F.col("_why").isNotNull(), broken)]
    rows = marked_tokens(sources, list(rules))
    return _findings(rows.repartition("row") if beyond else rows, found + beyond)


def _asked(rules: list[str] | tuple[str, ...]) -> tuple[list[Finding], list[Finding]]:
    return [f for r, findings in local_findings().items() if r in rules for f in findings], [f for r, f in file_findings().items() if r in rules]


def _some(findings: list[Finding]) -> Column:
    return reduce(lambda a, b: a | b, [c for c, _ in findings], F.lit(False))


def _findings(rows: DataFrame, findings: list[Finding]) -> DataFrame:
    """What is found at each token: a row a condition that holds, whose texts are made later, and only those that are asked for.

    No filter asks for all conditions at once beforehand: Spark moves it below, where classes and marks are told anew for each of them.
    """
    if not findings:  # all rules are off
        findings = [(F.lit(False), _finding("", "", "", F.lit("")))]
    rows = rows.withColumn("_f", F.explode(F.array(*[F.when(c, i) for i, (c, _) in enumerate(findings)]))).where("_f is not null")
    said = {c: reduce(lambda so_far, i: so_far.when(F.col("_f") == i, findings[i][1][c]), range(1, len(findings)), F.when(F.col("_f") == 0, findings[0][1][c])) for c in findings[0][1]}
    return rows.withColumns(said).select(*OUT)
