"""Registered queries of the training-data operators (see each module), with
DuckDB oracles where SQL can express them."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir
from . import bpe, chat, jaccard, langid, licenses, packing, periodic, pii, prefix_trie, rangecoder, repeats, topk, vector_dedup

PII_KEY = "corpus-2024"  # production jobs pass their own secret


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"), length=100)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(_table(spark, sf_dir, "documents"), PII_KEY).select("doc_id", "text", "n_pseudonyms")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), size=1024)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(_table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat.read_back(chat.render(chat.fold(chat.turn_events(rows))))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicate_groups(_table(spark, sf_dir, "documents"), words=3, percent=90)


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-files/{uuid.uuid4().hex}"
    return rangecoder.token_file(_table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), k=10, every=100)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digests(licenses.license_places(_table(spark, sf_dir, "documents")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.collapse_runs(periodic.looped(_table(spark, sf_dir, "documents"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_suffix_array_dedup, op2_pii, op3_packing, op4_language_id, op5_chat, op6_ngram_join, op7_token_file, op8_top_k, op9_bpe,
    op10_embedding_dedup, op11_prefix_trie, op12_license_scan, op13_periodic_runs)}

_REACH = """
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
best AS (SELECT a, min(b) b FROM reach GROUP BY a)"""

# crc32 of the decimal text of a number, from the table of its polynomial
_CRC = """
crc_step(i, v, k) AS (SELECT i, i, 0 FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM crc_step WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) tab FROM crc_step WHERE k = 8)"""


def _crc32(number: str) -> str:
    return (f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)), "
            "lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295)")


def _notice_rows() -> str:
    """Notices, their words by position, and whether a word is of the key phrase."""
    rows = []
    for t, x in enumerate(licenses.PHRASES + licenses.NOTICES):
        text, key = x.text.split(), x.key.split()
        at = next(i for i in range(len(text)) if text[i:i + len(key)] == key)
        rows += [f"({t}, '{x.label}', {x.base}, {j}, '{w}', {at <= j < at + len(key)})" for j, w in enumerate(text)]
    return "VALUES " + ", ".join(rows)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op11_prefix_trie": f"""
WITH RECURSIVE {_CRC},
raw AS (SELECT conv_id c, turn, coalesce(role, '') role, coalesce(text, '') text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, length(text) n, sha256(length(role) || ':' || role || text) s,
  row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) - 1 i FROM raw),
sizes AS (SELECT c, count(*) k FROM own GROUP BY c),
convs AS (SELECT sizes.c, {_crc32("sizes.c")} % 6 h, sizes.c - sizes.c % 100 b, coalesce(base.k, 0) bk
  FROM sizes CROSS JOIN crc LEFT JOIN sizes base ON base.c = sizes.c - sizes.c % 100),
full_rows AS (
  SELECT convs.c, i + 1 d, s, n FROM convs JOIN own ON own.c = convs.b AND i < h
  UNION ALL SELECT convs.c, least(h, bk) + i - h + 1, s, n FROM convs JOIN own ON own.c = convs.c AND i >= h),
rows AS (SELECT c, 0 d, '' p, 0 n FROM convs
  UNION ALL SELECT c, d, string_agg(s, '') OVER (PARTITION BY c ORDER BY d), n FROM full_rows),
ends AS (SELECT p, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) e FROM rows JOIN (SELECT c, max(d) d FROM rows GROUP BY c) m USING (c, d) GROUP BY p),
nodes AS (SELECT p, d, min(c) c, count(*) m, any_value(n) n FROM rows GROUP BY p, d),
kids AS (SELECT left(p, (d - 1) * 64) p, count(*) k FROM nodes WHERE d > 0 GROUP BY 1),
sub AS (SELECT up.p, sum(CASE WHEN kids.k IS NULL THEN 1 ELSE 0 END) leaves, sum((w.m - 1) * w.n) saved
  FROM nodes w JOIN rows up ON up.c = w.c AND up.d <= w.d LEFT JOIN kids ON kids.p = w.p GROUP BY up.p)
SELECT x.c conv_id, CAST(x.d AS BIGINT) depth, up.c parent_conv_id, x.m n_convs, coalesce(kids.k, 0) n_children, CAST(leaves AS BIGINT) n_leaves,
  CAST(saved AS BIGINT) saved_tokens, coalesce(e, sha256('')) ends_sha256
FROM nodes x JOIN sub USING (p) LEFT JOIN kids USING (p) LEFT JOIN ends USING (p) LEFT JOIN nodes up ON x.d > 0 AND up.p = left(x.p, (x.d - 1) * 64)""",
    "op12_license_scan": f"""
WITH notices(t, label, base, j, word, in_key) AS ({_notice_rows()}),
docs AS (SELECT row_number() OVER () r, doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w FROM documents),
words AS (SELECT r, unnest(w) word, unnest(range(len(w))) i FROM docs),
hits AS (SELECT * FROM words WHERE word IN (SELECT word FROM notices)),
counts AS (SELECT word, count(DISTINCT r) k FROM hits GROUP BY word),
weights AS (SELECT v.word, greatest(1, length(bin(greatest(1, (SELECT count(*) FROM docs) // greatest(1, coalesce(k, 0)))))) w
  FROM (SELECT DISTINCT word FROM notices) v LEFT JOIN counts USING (word)),
full_notices AS (SELECT t, label, base, sum(w) total, sum(CASE WHEN in_key THEN 1 ELSE 0 END) key_words FROM notices JOIN weights USING (word) GROUP BY ALL),
met AS (SELECT r, t, i - j o, sum(w) got, sum(CASE WHEN in_key THEN 1 ELSE 0 END) key_met
  FROM hits JOIN notices USING (word) JOIN weights USING (word) GROUP BY ALL),
places AS (SELECT r, label, base, o, got / total share FROM met JOIN full_notices USING (t)
  WHERE key_met = key_words AND CASE WHEN base THEN got = total ELSE 100 * got >= {licenses.SHARE} * total END),
of_doc AS (SELECT r, count(*) FILTER (base) n, min(o) FILTER (base) a, max(o) FILTER (base) z, max(share) s,
  array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ',') bl, array_to_string(list_sort(list_distinct(list(label))), ',') al FROM places GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, coalesce(n, 0) n_base, CAST(a AS BIGINT) first_word, CAST(z AS BIGINT) last_word,
  coalesce(bl, '') base_labels, coalesce(al, '') labels, coalesce(CAST(s AS DOUBLE), 0.0) score
FROM docs LEFT JOIN of_doc USING (r)""",
    "op13_periodic_runs": f"""
WITH RECURSIVE {_CRC},
split AS (SELECT row_number() OVER () r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w,
  CASE WHEN doc_id IS NULL THEN 1 ELSE {_crc32("doc_id")} END h FROM documents CROSS JOIN crc),
planned AS (SELECT *, h // 10 g, len(w) n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END a FROM split),
docs AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w
  ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) END w FROM planned),
grams AS (SELECT r, i, n, array_to_string(w[i + 1:i + 8], ' ') g FROM (SELECT r, n, w, unnest(range(n - 7)) i FROM docs WHERE n >= 24)),
pairs AS (SELECT x.r, x.i, y.i - x.i q FROM grams x JOIN grams y ON x.r = y.r AND x.g = y.g AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
isles AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) k FROM pairs),
stretches AS (SELECT r, q, min(i) s, count(*) + 7 + q m FROM isles GROUP BY r, q, k HAVING count(*) + 7 + q >= greatest(24, 3 * q)),
runs AS (SELECT * FROM stretches x WHERE NOT EXISTS (SELECT 1 FROM stretches y WHERE y.r = x.r AND y.q < x.q AND y.s <= x.s AND y.s + y.m >= x.s + x.m)),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY m / q DESC, s, q) = 1),
lines AS (SELECT r, count(*) k, sha256(string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q)) sha FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + m)) i FROM runs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) t FROM (SELECT r, unnest(w) word, unnest(range(n)) i FROM docs) ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(lines.k, 0) n_runs, best.s AS "start", CAST(best.m AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period,
  CAST(1000 * best.m // best.q AS BIGINT) exponent_milli, coalesce(sha, sha256('')) runs_sha256, sha256(coalesce(t, '')) collapsed_sha256
FROM docs LEFT JOIN lines USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)""",
    "op5_chat": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') role, coalesce(text, '') text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
shown AS (
  SELECT *, length(regexp_replace(replace(text, '\', '\\'), '([\[<])(/?(?:(?:INST|SYS|BOT|MSG)\]|s>))', '\1|\2', 'g'))
    + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 10
      ELSE 18 + length(regexp_replace(replace(role, '\', '\\'), '([\[<])(/?(?:(?:INST|SYS|BOT|MSG)\]|s>))', '\1|\2', 'g')) END chars
  FROM rows)
SELECT conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) loss_sha256,
  CAST(sum(chars) AS BIGINT) formatted_chars
FROM shown GROUP BY conv_id""",
    "op6_ngram_join": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END g
  FROM w, unnest(range(1, greatest(len(w) - 1, 2))) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id a, y.doc_id b, count(*) c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * c >= 90 * (na.n + nb.n - c)),
{_REACH}
SELECT d.doc_id, coalesce(n.n, 0) n_shingles, least(d.doc_id, coalesce(best.b, d.doc_id)) component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN best ON d.doc_id = best.a""",
    "op8_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id query_id, x.vec_id, CAST(list_inner_product(q.v, x.v) AS BIGINT) score
  FROM v q JOIN v x ON q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op10_embedding_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) m FROM v WHERE len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id a, y.vec_id b FROM u x JOIN u y ON x.vec_id <> y.vec_id AND list_inner_product(x.v, y.v) / (x.m * y.m) >= 0.95),
{_REACH},
c AS (SELECT a, count(*) n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) n_links, least(vec_id, coalesce(best.b, vec_id)) component_id, least(vec_id, coalesce(best.b, vec_id)) = vec_id kept
FROM embeddings LEFT JOIN c ON vec_id = c.a LEFT JOIN best ON vec_id = best.a""",
}
