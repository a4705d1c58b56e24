"""The queries of this subpackage and the SQL that says what they return."""

from __future__ import annotations

from . import embed, fim, langid, minhash, mixing, packing, periodic, quality, secrets, sharding, tokens, toxicity, winnow
from .common import read_table


def op1_minhash(spark, sf_dir):
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_jump_shards(spark, sf_dir):
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"), 8)


def op3_toxicity(spark, sf_dir):
    return toxicity.toxicity_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_language(spark, sf_dir):
    return langid.identify_documents(read_table(spark, sf_dir, "documents"))


def op5_token_counts(spark, sf_dir):
    return tokens.count_tokens(read_table(spark, sf_dir, "documents"))


def op6_mixing(spark, sf_dir):
    out = mixing.mix(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op7_packing(spark, sf_dir):
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op8_winnowing(spark, sf_dir):
    return winnow.fingerprint_documents(read_table(spark, sf_dir, "documents"))


def op9_embeddings(spark, sf_dir):
    return embed.near_vectors(read_table(spark, sf_dir, "embeddings"))


def op10_secrets(spark, sf_dir):
    return secrets.scan_documents(read_table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark, sf_dir):
    return periodic.periodic_documents(read_table(spark, sf_dir, "documents"), plant=True)


def op12_quality_rules(spark, sf_dir):
    return quality.quality_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_fill_in_middle(spark, sf_dir):
    return fim.fill_in_middle(read_table(spark, sf_dir, "documents"))


def quality_base(spark, sf_dir):
    """The part of op12 that SQL can say: what the base rules count and decide."""
    return op12_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def winnow_edits(spark, sf_dir):
    """The part of op8 that SQL can say: the next document and the edited text."""
    return op8_winnowing(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def secret_base_spans(spark, sf_dir):
    """The part of op10 that SQL can say: the spans of the base patterns."""
    return op10_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_minhash, op2_jump_shards, op3_toxicity, op4_language, op5_token_counts, op6_mixing, op7_packing, op8_winnowing, op9_embeddings, op10_secrets, op11_periodic_runs, op12_quality_rules, op13_fill_in_middle, quality_base, winnow_edits, secret_base_spans, pipeline)}

#: The first hexadecimal digits of an md5 as a number.
_MD5 = "('0x' || substr(md5({text}), 1, {digits}))::BIGINT"


def _jump(shards: int) -> str:
    """Steps of the consistent hash: (b, j) -> (j, floor((j + 1) * 2^31 / r)) while j is below the shard count; b is the shard."""
    sql = "SELECT doc_id, -1::BIGINT AS b, 0::BIGINT AS j FROM (SELECT DISTINCT doc_id FROM documents)"
    for step in range(shards + 1):
        r = "((" + _MD5.format(text=f"coalesce(doc_id::VARCHAR, 'null') || ':{step}'", digits=8) + ") & 2147483647) + 1"
        sql = f"SELECT doc_id, CASE WHEN j < {shards} THEN j ELSE b END AS b, CASE WHEN j < {shards} THEN ((j + 1) * 2147483648) // ({r}) ELSE j END AS j FROM ({sql})"
    return sql


#: crc32 of distinct texts, byte by byte through the table of the polynomial.
_CRC = """
poly AS (
  WITH RECURSIVE t(i, c, k) AS (
    SELECT range, range, 0 FROM range(256)
    UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM t WHERE k < 8
  ) SELECT list(c ORDER BY i) AS l FROM t WHERE k = 8
),
bytes AS (
  SELECT text, list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda p: ('0x' || p)::BIGINT)) AS x
  FROM (SELECT DISTINCT coalesce(text, '') AS text FROM documents)
),
crcs AS (SELECT text, xor(list_reduce(x, lambda c, v: xor(c >> 8, l[(xor(c, v) & 255) + 1])), 4294967295)::BIGINT AS crc FROM bytes, poly)"""

#: The base kinds as SQL patterns, ASCII letters of either case spelled out, and the least length of the group that counts (0: all of the match).
_KINDS = {
    "assign": (
        "(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else "_?" for c in w) for w in "password passwd secret token api_key".split()) + """)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, 12,
    ),
    "access": ("AKIA[A-Z0-9]+", 0, 18),
    "hex": ("[0-9a-f]+", 0, 16),
}


def _spans(kind: str, at: int) -> str:
    """doc_id, kind and [start, end) of the matches of one kind: they are framed by two noncharacters (no text holds U+EFFFE or U+EFFFF), and cut apart there."""
    pattern, group, least = _KINDS[kind]
    pattern = pattern.replace("'", "''")
    framed = f"string_split(regexp_replace(text, '({pattern})', chr(983038) || '\\1' || chr(983039), 'g'), chr(983038))"
    return f"""
  SELECT doc_id, '{kind}' AS kind, {at} AS place, start, start + length(m) AS stop FROM (
    SELECT doc_id, string_split(part, chr(983039))[1] AS m, i, sum(length(part) - CASE WHEN i > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) - length(part) + 1 AS start
    FROM (SELECT doc_id, unnest({framed}) AS part, generate_subscripts({framed}, 1) AS i FROM documents)
  ) WHERE i > 1 AND length(regexp_extract(m, '{pattern}', {group})) >= {least}"""


ORACLE_SQL = {
    "op9_embeddings": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
good AS (
  SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS norm FROM v
  WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_dot_product(x, x) > 0
),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.98
),
reach(id, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r),
least AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN least ON id = vec_id LEFT JOIN counts ON a = vec_id
""",
    "op13_fill_in_middle": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, 'null')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS l
  FROM documents
),
e AS (
  SELECT *, len(l) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(l) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(l) + 1) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d
),
parts AS (
  SELECT *, array_to_string(l[1:least(a, b)], '') AS prefix, array_to_string(l[least(a, b) + 1:greatest(a, b)], '') AS middle, array_to_string(l[greatest(a, b) + 1:], '') AS suffix FROM e
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
""",
    "quality_base": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS i
  FROM (SELECT doc_id, list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')) AS s FROM d)
),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(8) r(k) GROUP BY doc_id),
counts AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS lines,
         len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS others, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN repeats ON repeats.doc_id = d.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, (lines - others)::BIGINT AS n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts
""",
    "winnow_edits": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT *, coalesce(lead(t) OVER w, first_value(t) OVER w) AS u FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 2) || substr(u, 1, length(t) // 2)) AS edited_sha256 FROM n
""",
    "secret_base_spans": f"""
WITH spans AS ({" UNION ALL ".join(_spans(k, i) for i, k in enumerate(_KINDS))}),
told AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, place) AS s
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(s, '')) AS base_sha256
FROM documents d LEFT JOIN told t ON t.doc_id = d.doc_id
""",
    "op2_jump_shards": f"""
WITH {_CRC},
now AS ({_jump(8)}),
grown AS ({_jump(9)}),
placed AS (
  SELECT d.doc_id, strlen(coalesce(d.text, '')) + 1 AS size, c.crc, n.b AS shard, g.b AS grown_shard,
         {_MD5.format(text="'slot:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || c.crc", digits=3)} // 4 AS salt
  FROM documents d JOIN crcs c ON c.text = coalesce(d.text, '') JOIN now n ON n.doc_id IS NOT DISTINCT FROM d.doc_id JOIN grown g ON g.doc_id IS NOT DISTINCT FROM d.doc_id
)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY salt, doc_id NULLS LAST, crc, size) - 1 AS slot, grown_shard::INTEGER AS grown_shard
FROM placed
""",
    "op6_mixing": r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text:' || text, 'null')), 1, 15))::BIGINT AS h
  FROM documents
),
sources AS (
  SELECT source, sum(size)::BIGINT AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM docs GROUP BY source
),
levels AS (
  SELECT *, 3.0::DOUBLE * n / w AS full_at,
         (sum(n) OVER () - 3 * coalesce(sum(n) OVER o, 0))::DOUBLE / (sum(w) OVER (ORDER BY n::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM sources WINDOW o AS (ORDER BY n::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
plan AS (
  SELECT source, n, least(3.0::DOUBLE * n, w * (SELECT max(level) FROM levels WHERE level <= full_at)) AS target FROM levels
),
parts AS (
  SELECT source, n, target, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END::BIGINT AS whole FROM plan
),
hashes AS (
  SELECT source, h, sum(size) AS size, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM docs WHERE size > 0 GROUP BY source, h
),
edges AS (
  SELECT p.source, min(CASE WHEN x.upto > p.target - p.whole * p.n THEN
    x.h * 2 + CASE WHEN (p.target - p.whole * p.n) - (x.upto - x.size) >= x.size / 2 THEN 1 ELSE 0 END END) AS edge
  FROM parts p LEFT JOIN hashes x ON x.source IS NOT DISTINCT FROM p.source GROUP BY p.source
)
SELECT d.doc_id, d.size, p.n AS source_size, p.target,
       (d.size * (p.whole + CASE WHEN e.edge IS NULL OR d.h < e.edge // 2 OR (d.h = e.edge // 2 AND e.edge % 2 = 1) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM docs d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source JOIN edges e ON d.source IS NOT DISTINCT FROM e.source
""",
}
