"""The registered queries: one per operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tractlens.llm import (
    chat_format, decontaminate, fertility, html_extract, jaccard_join, lattice_lm, license_scan, spelling_variants, token_orc, toxicity,
    turn_repair, url_filter, viterbi_pieces,
)
from tractlens.llm.common import read_table, vocabulary_path

#: The rules of op9.
URL_RULES = [
    url_filter.Rule("allow", "org", "/"), url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"), url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]
#: What both turns of conversation -1 say.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(read_table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    control = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit(CONTROL_TEXT).alias("text"))
    return chat_format.digests(chat_format.format_chats(chat_format.conversation_events(c.unionByName(control))))


def op3_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality(read_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_orc.new_path(spark, "token-orc")
    token_orc.write_tokens(read_table(spark, sf_dir, "documents"), path, vocabulary_path("byte_bpe_50k.json"))
    return token_orc.read_digests(spark, path)


def op6_viterbi_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi_pieces.round_trip(read_table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read_table(spark, sf_dir, "documents"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), (F.col("quality") == 0).cast("int").alias("bad"))
    return url_filter.url_verdicts(read_table(spark, sf_dir, "pages"), labels, URL_RULES)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, copies = turn_repair.damage(read_table(spark, sf_dir, "conversations"))
    return turn_repair.digests(turn_repair.repair(rows, copies=copies))


def op12_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.lattice_scores(read_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_chat_format": op2_chat_format,
    "op3_fertility": op3_fertility,
    "op4_toxicity": op4_toxicity,
    "op5_token_orc": op5_token_orc,
    "op6_viterbi_pieces": op6_viterbi_pieces,
    "op7_license_scan": op7_license_scan,
    "op8_html_extract": op8_html_extract,
    "op9_url_filter": op9_url_filter,
    "op10_decontaminate": op10_decontaminate,
    "op11_turn_repair": op11_turn_repair,
    "op12_lattice_lm": op12_lattice_lm,
    "op13_spelling_variants": op13_spelling_variants,
}

OP2_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 24) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, ws[i : i + 4] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(least.b, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN least ON least.a = w.doc_id
"""
#: Words as op10 takes them.
_WORDS = r"""regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
OP10_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS.format("text")} AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, len(ws[i : i + 12]) AS n, ws[i : i + 12] AS w
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dwin AS (
  SELECT doc_id, i, n, ws[i : i + n - 1] AS w
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lens WHERE len(ws) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM dwin JOIN win USING (n, w)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
  SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
found AS (SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (
  SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

#: The table of CRC-32 (reflected polynomial 0xEDB88320), and the checksum of a list of bytes.
_CRC_TABLE = """SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs"""
_CRC = """xor(list_reduce(list_prepend(4294967295, {}), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295)"""


def _more(state: str, cost: str, edit: str) -> str:
    """A state (its cost in six digits, then its edits; ~ if out of reach) after one more edit."""
    return (f"CASE WHEN {state} = '~' THEN '~' ELSE lpad(CAST(CAST(left({state}, 6) AS INT) + {cost} AS VARCHAR), 6, '0')"
            f" || substr({state}, 7) || '{edit}' END")


def _stay(initial: str, keeps: str, state: str) -> str:
    """A row that stays: another role, or its own where the state before allows it."""
    return (f"CASE WHEN bad THEN '~' ELSE least({_more(state, '2 + cut', 'R')}, "
            f"CASE WHEN first = '{initial}' THEN {_more(keeps, 'cut', 'K')} ELSE '~' END) END")


OP11_SQL = f"""
WITH RECURSIVE t AS ({_CRC_TABLE}),
h AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format(
    "list_transform(string_split(concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')), ''),"
    " lambda x: ascii(x))")} % 20 AS f
  FROM conversations, t),
d AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM h),
r AS (
  SELECT *, left(role, 1) AS first, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS p,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen
  FROM d),
c AS (
  SELECT *, s = '' AS blank, s <> '' AND seen > 1 AS dup, s = '' OR seen > 1 AS bad,
    CAST(s <> '' AND seen = 1 AND right(s, 1) NOT IN ('.', '!', '?') AS INT) AS cut,
    lag(first) OVER (PARTITION BY conv_id ORDER BY p) || first AS pair
  FROM r),
walk AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS p, '000000' AS s0, '~' AS s1, '~' AS s2, '~' AS s3 FROM conversations
  UNION ALL
  SELECT conv_id, p, {_more("s0", "3", "D")}, least({_more("s1", "3", "D")}, CASE WHEN first = 's' AND NOT bad THEN {_more("s0", "cut", "K")} ELSE '~' END),
    least({_more("i2", "3", "D")}, {_stay("u", "least(s0, s1, i3)", "least(s0, s1, i3)")}),
    least({_more("i3", "3", "D")}, {_stay("a", "i2", "i2")})
  FROM (
    SELECT *, least(s3, {_more("i2", "2", "I")}) AS i3
    FROM (
      SELECT c.*, s0, s1, s3, least(s2, {_more("least(s0, s1, s3)", "2", "I")}) AS i2
      FROM walk JOIN c ON c.conv_id IS NOT DISTINCT FROM walk.conv_id AND c.p = walk.p + 1))),
done AS (
  SELECT conv_id, arg_max(least(s0, s3, {_more("s2", "2", "I")}, {_more("s1", "4", "II")}), p) AS best FROM walk GROUP BY conv_id),
lines AS (
  SELECT conv_id, substr(best, 7) AS audit, 1 AS i, CAST(0 AS BIGINT) AS p, '' AS state, '' AS text FROM done
  UNION ALL
  SELECT l.conv_id, audit, i + 1, l.p + CAST(substr(audit, i, 1) <> 'I' AS BIGINT),
    CASE substr(audit, i, 1) WHEN 'D' THEN state WHEN 'K' THEN first ELSE CASE state WHEN 'u' THEN 'a' ELSE 'u' END END,
    l.text || CASE substr(audit, i, 1) WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || c.text
      ELSE chr(10) || CASE state WHEN 'u' THEN 'assistant' ELSE 'user' END || ':' || CASE substr(audit, i, 1) WHEN 'R' THEN c.text ELSE '' END END
  FROM lines l LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM l.conv_id AND c.p = l.p + 1
  WHERE i <= length(audit)),
repaired AS (SELECT conv_id, sha256(substr(text, 2)) AS sha FROM lines WHERE i = length(audit) + 1),
stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (dup) AS duplicate, CAST(sum(cut) AS BIGINT) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM c GROUP BY conv_id)
SELECT done.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(left(best, 6) AS BIGINT) AS cost,
  substr(best, 7) AS audit, sha AS repaired_sha256
FROM done LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM done.conv_id JOIN repaired ON repaired.conv_id IS NOT DISTINCT FROM done.conv_id
"""

OP13_SQL = f"""
WITH RECURSIVE t AS ({_CRC_TABLE}),
found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
runs AS (
  SELECT run, count(*) AS n, hex(encode(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', run))) AS x
  FROM found WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (
  SELECT run, n, {_CRC.format("list_transform(range(0, length(x) // 2), lambda i: CAST(concat('0x', substr(x, 2 * i + 1, 2)) AS BIGINT))")} AS h
  FROM runs, t),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT n, CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS (
  SELECT word, n, i, left(word, i) || substr(word, i + 2) AS v FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b USING (i, v) WHERE a.word <> b.word
  UNION SELECT less.word, words.word, words.n FROM less JOIN words ON words.word = v
  UNION SELECT words.word, less.word, less.n FROM less JOIN words ON words.word = v),
best AS (
  SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near FROM near
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1),
formed AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form,
    CASE WHEN near_n >= 10 * n THEN near_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root, form AS onward FROM formed
  UNION ALL SELECT chain.word, formed.word, formed.form FROM chain JOIN formed ON formed.word = chain.onward)
SELECT word, formed.form, root, n, n_near, form_n FROM formed JOIN chain USING (word) WHERE onward IS NULL
"""

ORACLE_SQL: dict[str, str] = {
    "op1_jaccard_join": OP1_SQL, "op2_chat_format": OP2_SQL, "op10_decontaminate": OP10_SQL, "op11_turn_repair": OP11_SQL,
    "op13_spelling_variants": OP13_SQL,
}
