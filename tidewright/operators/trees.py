"""Syntax trees as tables: their nodes to tokens, and lexing that takes a file's tree where it has one.

A tree comes from a parser outside, as rows (file, node, type, named, start, end, row, column): bytes from 0, lines and byte columns from 0,
``node`` a number that rises depth first (parents before children, left to right). Nested intervals say the rest, so that a walk is one pass over
a file's nodes and no tree is too deep for it. An optional ``depth`` settles whether an empty node at a node's end is its child; without it, it is not.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grammars import grammar_of
from ..functions.text import has_vietnamese
from .lexer import lexed, name_kind, small_batches, token_kind

#: By grammar, the types of nodes that are identifiers, comments and strings.
NODE_TYPES = {
    "Python": ("identifier type_comment", "comment", "string concatenated_string string_content"),
    "JavaScript": ("identifier property_identifier shorthand_property_identifier shorthand_property_identifier_pattern", "comment hash_bang_line", "string template_string string_fragment"),
    "TypeScript": ("identifier property_identifier type_identifier shorthand_property_identifier", "comment", "string template_string string_fragment"),
    "TSX": ("identifier property_identifier type_identifier", "comment", "string template_string jsx_text"),
    "C": ("identifier field_identifier type_identifier statement_identifier", "comment", "string_literal char_literal string_content"),
    "C++": ("identifier field_identifier type_identifier namespace_identifier statement_identifier", "comment", "string_literal char_literal raw_string_literal string_content"),
    "Go": ("identifier field_identifier type_identifier package_identifier label_name", "comment", "interpreted_string_literal raw_string_literal rune_literal"),
    "Rust": ("identifier field_identifier type_identifier lifetime", "line_comment block_comment doc_comment", "string_literal char_literal raw_string_literal"),
    "Java": ("identifier type_identifier", "line_comment block_comment", "string_literal character_literal text_block"),
    "C#": ("identifier", "comment multiline_comment documentation_comment", "string_literal verbatim_string_literal interpolated_string_expression"),
    "Scala": ("identifier operator_identifier", "comment multiline_comment block_comment", "string multiline_string_literal"),
    "Julia": ("identifier", "line_comment block_comment", "string_literal command_literal prefixed_string_literal"),
    "OCaml": ("value_name type_constructor_path module_name label_name", "comment line_number_directive", "string character"),
    "PHP": ("name variable_name member_name", "comment shell_command_expression", "string encapsed_string heredoc"),
    "CSS": ("tag_name class_name id_name property_name plain_value", "comment", "string_value"),
    "JSON": ("", "comment", "string_content"),
    "QL": ("simpleId qualId", "line_comment block_comment", "string"),
}
KINDS = ("Identifier", "Comment", "StringLiteral")
_TREE = "struct<node: long, start: int, end: int, row: int, column: int, kind: string>"


def node_kind(grammar: Column, kind: Column, named: Column, keywords: dict[str, list[str]] | None = None) -> Column:
    """The token kind of a node type; null for nodes that are no token.

    Keywords are unnamed nodes whose type is a word (parsers give them the text itself); ``keywords`` lists a grammar's own instead.
    """
    known = F.create_map(*[F.lit(x) for g, lists in NODE_TYPES.items() for k, names in zip(KINDS, lists, strict=True) for n in names.split() for x in (f"{g} {n}", k)])
    word = ~F.coalesce(named, F.lit(True)) & kind.rlike("^[A-Za-z_]+$")
    for g, names in (keywords or {}).items():
        word = F.when(grammar == g, kind.isin(names)).otherwise(word)
    return F.coalesce(F.try_element_at(known, F.concat_ws(" ", grammar, kind)), F.when(word & grammar.isin(*NODE_TYPES), "Keyword"))


def numbered(nodes: DataFrame) -> DataFrame:
    """nodes with ``node``, depth first: by start, the longer first, then by depth. For tables without such a number."""
    return nodes.withColumn("node", F.row_number().over(Window.partitionBy("file").orderBy("start", F.desc("end"), "depth")).cast("long") - 1)


#: Nodes that are packed at once, and what stands for null in them.
PACKED, NULL = 1 << 16, -(1 << 31)
_PLACED = ("end", "row", "column")
_KINDS = ("", *KINDS, "Keyword")


def _shrunk(values: np.ndarray, differences: bool) -> tuple[bytes, bytes]:
    """Numbers (or what each adds to the one before) in as few bytes each as the largest takes: how many those are, and they."""
    if differences:
        values = np.diff(values, prepend=0)
    low, high = (values.min(), values.max()) if len(values) else (0, 0)
    width = next(w for w in (1, 2, 4, 8) if low >= -(1 << 8 * w - 1) and high < 1 << 8 * w - 1)
    return bytes([width]), values.astype(f"<i{width}").tobytes()


def _pack(node: np.ndarray, start: np.ndarray, depth: np.ndarray, kind: np.ndarray, placed: list[np.ndarray]) -> bytes:
    """Nodes of a file as one text: their numbers, starts, depths and kinds; of those with a kind, the only ones that can be tokens, their ends, rows and columns."""
    named = kind > 0
    end, row, column = (x[named] for x in placed)
    parts = [_shrunk(node, True), _shrunk(start, True), _shrunk(depth, False), _shrunk(kind, False), _shrunk(end - start[named], False), _shrunk(row, True), _shrunk(column, False)]
    return len(node).to_bytes(8, "little") + int(named.sum()).to_bytes(8, "little") + b"".join([x for p in parts for x in p])


def _unpack(packed: bytes) -> list[np.ndarray]:
    """What _pack was given; ends, rows and columns of nodes without a kind are 0."""
    n, k, at, out = int.from_bytes(packed[:8], "little"), int.from_bytes(packed[8:16], "little"), 16, []
    for size, differences in ((n, True), (n, True), (n, False), (n, False), (k, False), (k, True), (k, False)):
        width = packed[at]
        values = np.frombuffer(packed, f"<i{width}", size, at + 1).astype(np.int64)
        out.append(np.cumsum(values) if differences else values)
        at += 1 + width * size
    named = out[3] > 0
    out[4] = out[4] + out[1][named]
    for i in range(4, 7):
        whole = np.zeros(n, np.int64)
        whole[named] = out[i]
        out[i] = whole
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, nodes) of (file, node, start, depth, kind, end, row, column): the nodes of a file that come near each other are one row."""

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        files = table.column("file").combine_chunks().dictionary_encode()
        if isinstance(files, pa.ChunkedArray):
            files = files.combine_chunks()
        codes = files.indices.to_numpy()
        number = lambda c, null: pc.fill_null(pc.cast(table.column(c), pa.int64()), null).to_numpy()
        columns = [number("node", -(1 << 62)), *(number(c, NULL) for c in ("start", "depth")), number("kind", 0), *(number(c, NULL) for c in _PLACED)]
        if np.any(np.diff(codes) < 0):
            order = np.argsort(codes, kind="stable")
            codes, columns = codes[order], [c[order] for c in columns]
        cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
        texts = [_pack(*(c[i:j] for c in columns[:4]), [c[i:j] for c in columns[4:]]) for i, j in pairwise(cuts)]
        return pa.RecordBatch.from_arrays([files.dictionary.take(pa.array(codes[cuts[:-1]])), pa.array(texts, pa.binary())], ["file", "nodes"])

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= PACKED:
            yield pack(held)
            held, n = [], 0
    if held:
        yield pack(held)


def _tokens_of(files: pa.Array, with_depth: bool) -> pa.Array:
    """_TREE of each file's tokens in order, of all of its packed nodes."""
    parts, who = [[] for _ in range(7)], []
    for i, packed in enumerate(files):
        for p in packed.as_py() or []:
            for out, values in zip(parts, _unpack(p), strict=True):
                out.append(values)
            who.append(np.full(len(parts[0][-1]), i))
    whole = [np.concatenate(p) if p else np.zeros(0, np.int64) for p in (*parts, who)]
    node, start, depth, kind, end, row, column, who = whole
    if np.any((np.diff(who) == 0) & (np.diff(node) < 0)):
        order = np.lexsort((node, who))
        node, start, depth, kind, end, row, column, who = (x[order] for x in whole)
    following = np.append(who[1:] == who[:-1], False) if len(who) else np.zeros(0, bool)
    after = lambda x: np.append(x[1:], NULL) if len(x) else x
    inside = following & (after(start) != NULL) & (after(start) < end)
    if with_depth:
        inside = np.where(following & (after(depth) != NULL) & (depth != NULL), after(depth) > depth, inside)
    long = (kind > 0) & (start != NULL) & (end != NULL) & (end > start)
    is_whole = long & ((kind == _KINDS.index("Comment")) | (kind == _KINDS.index("StringLiteral")))
    # the largest end of a comment or string before a node in its file: files lie one after another, each above all of the one before
    above = who << 33
    covered = np.maximum.accumulate(np.where(is_whole, end, -1) + above) if len(who) else above
    covered = np.maximum(np.concatenate([[-1], covered[:-1]])[: len(who)] - above, -1)
    token = np.flatnonzero(long & (is_whole | ~inside) & (covered < end))
    number = lambda x, kind: pa.array(x[token].astype(kind), mask=x[token] == NULL)
    columns = [pa.array(node[token], mask=node[token] == -(1 << 62)), *(number(x, np.int32) for x in (start, end, row, column)), pa.array(_KINDS).take(pa.array(kind[token]))]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(who[token].astype(np.int64), minlength=len(files)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(columns, ["node", "start", "end", "row", "column", "kind"]))


def walked(nodes: DataFrame, grammar: Column | None = None, keywords: dict[str, list[str]] | None = None) -> DataFrame:
    """(file, tree): the token nodes of each file's tree in order, as an array; empty for a tree without tokens.

    A token is a leaf with a kind, or a whole comment or string, with text, outside of all other comments and strings. One exchange, by file, of nodes in a few
    bytes each: they are packed where they lie, and walked file by file. Null files and types are no nodes.
    """
    kind = node_kind(grammar_of(F.col("file")) if grammar is None else grammar, F.col("type"), F.col("named"), keywords)
    with_depth = "depth" in nodes.columns
    depth = F.col("depth") if with_depth else F.lit(None)
    rows = nodes.where("file is not null and type is not null").withColumn("kind", kind)
    code = reduce(lambda so_far, i: so_far.when(F.col("kind") == _KINDS[i], i), range(2, len(_KINDS)), F.when(F.col("kind") == _KINDS[1], 1)).cast("byte")
    rows = rows.select("file", F.col("node").cast("long").alias("node"), F.col("start").cast("int").alias("start"), depth.cast("int").alias("depth"), code.alias("kind"), *(F.col(c).cast("int").alias(c) for c in _PLACED))
    small_batches(nodes.sparkSession)

    @F.arrow_udf(f"array<{_TREE}>")
    def tokens_of(files: pa.Array) -> pa.Array:
        return _tokens_of(files, with_depth)

    packed = rows.mapInArrow(_packed, "file string, nodes binary").groupBy("file").agg(F.collect_list("nodes").alias("_nodes"))
    return packed.select("file", tokens_of("_nodes").alias("tree"))


def _token_kind(kind: Column, raw: Column) -> Column:
    """A node's kind by its text, as the built-in lexers tell it."""
    return F.when(kind == "Identifier", name_kind(raw)).when((kind == "Comment") & has_vietnamese(raw), "VietnameseComment").otherwise(kind)


def unified_tokens(sources: DataFrame, nodes: DataFrame, keep_space: bool = False, end: bool = True, keywords: dict[str, list[str]] | None = None) -> DataFrame:
    """Tokens as lexer.tokens gives them, of a file's tree where nodes has one and its grammar is known, of the built-in lexer elsewhere.

    No file is read twice: a row's pieces come from one of the two. Trees have no EndOfFile row, and a tree without tokens gives none at all. Sources of one
    name share its tree; sources without a name have none; nodes past a source's end give what is left of it. Null sources are empty.
    """
    text = F.coalesce("source", F.lit(""))
    rows = sources.select(F.monotonically_increasing_id().alias("row"), "file", "language", F.encode(text, "UTF-8").alias("_bytes"))  # one form of a source goes to the join
    trees = walked(nodes, keywords=keywords).where(grammar_of(F.col("file")).isin(*NODE_TYPES))
    rows = rows.join(trees, "file", "left")
    raw = lambda n: F.decode(F.substring(F.col("_bytes"), n["start"] + 1, n["end"] - n["start"]), "UTF-8")
    token = lambda pos, piece, start, line, col, kind: F.struct(pos.alias("pos"), piece.alias("raw"), start.alias("start"), line.alias("line"), col.alias("col"), kind.alias("kind"))
    of_tree = F.transform("tree", lambda n, i: token(i, raw(n), n["start"], n["row"] + 1, n["column"] + 1, n["kind"]))
    none = F.lit(None).cast("string")
    small_batches(sources.sparkSession)
    rows = rows.withColumn("_l", lexed(F.when(F.col("tree").isNull(), F.decode("_bytes", "UTF-8")), F.col("language"), keep_space))
    built_in = F.transform("_l", lambda t: token(t["pos"], t["raw"], t["start"], t["line"], t["col"], none))
    found = rows.select("row", "file", "language", F.explode(F.when(F.col("tree").isNotNull(), of_tree).otherwise(built_in)).alias("t")).select("row", "file", "language", "t.*")
    if not end:
        found = found.where("raw <> ''")
    raw, kind = F.col("raw"), F.col("kind")
    told = F.when(kind.isNotNull(), _token_kind(kind, raw)).when(raw == "", "EndOfFile").otherwise(token_kind(raw, F.col("pos"), F.col("language")))
    return found.select("row", "file", "language", "pos", told.alias("kind"), "raw", "start", (F.col("start") + F.octet_length("raw")).alias("end"), "line", "col", has_vietnamese(raw).alias("has_vietnamese"))
