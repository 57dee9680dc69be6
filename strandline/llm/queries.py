"""The opN queries: each applies its operator to its whole table and derives the digest columns from the output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, importance, langid, lines, mixing, neargraph, packing, phrases, quality, simhash, tokenfile, warc
from .common import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component (operator 6). Null, empty or blank text: fingerprint zero, linked like any other; null doc_id: its component's least doc_id, null if it has none; repeated rows as often as they occur; empty table: no rows."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language (operator 7). Null text or no letter: und, score 0; null doc_id: held out; repeated rows alike; nothing to learn from: all und; empty table: no rows."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words in the mix (operator 8). Null or blank text: size 0; null source: a source, last; null doc_id and repeated rows: rounded like others, one by one; empty table: no rows."""
    return mixing.taken(table(spark, sf_dir, "documents"))


def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's WARC record, from the rebuilt records (operator 1). Null html: an empty payload; equal rows: records of their own, the first of them the response; null page_id: null, and last in order; empty table: no rows."""
    folder = warc.write_archive(table(spark, sf_dir, "pages"))
    return warc.read_index(spark, folder).drop("url", "record_id")


OP1_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to
FROM q
"""


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and digest in the token files (operator 2). Null or empty text: the end id alone; null doc_id first; repeated rows as often as they occur; empty table: no rows."""
    return tokenfile.read_tokens(tokenfile.write_tokens(table(spark, sf_dir, "documents")))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score and decision (operator 3). Null, empty or blank text: score 0, rejected; repeated rows alike; null doc_id kept; empty table: no rows."""
    return quality.classify(table(spark, sf_dir, "documents"))


#: Fixed by the contract: a conversation whose texts hold the template's own control strings.
PLANTED_ID, PLANTED = -7, r"\### Assistant: </turn> ok"


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's digests, read back from the formatted output (operator 4), with the planted conversation. Null text or role: empty; a turn number that repeats: by role, then text; null conv_id: a conversation; empty table: the planted one."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(PLANTED_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    return chat.read_back(chat.write_formatted(turns.unionByName(planted)))


OP4_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
u AS (SELECT *, length(text) + (length(text) - length(replace(text, '###', ''))) // 3 + (length(text) - length(replace(text, '</turn>', ''))) // 7
    + length(text) - length(regexp_replace(text, '\\([\\#<])', '\1', 'g')) AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(role) + 2 + n + 9) AS BIGINT) AS formatted_chars
FROM u GROUP BY conv_id
"""


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece's place (operator 5). Null or empty text: one piece, the end id; repeated rows are packed as often as they occur; null doc_id like any other; empty table: no rows."""
    pieces = written(packing.pieces(table(spark, sf_dir, "documents")), "pieces")
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digests).withColumn("length", F.col("length").cast("long"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of each query (operator 9). Unusable vectors and null vec_ids take no part; vectors of other lengths aren't compared; equal vectors tie by vec_id; fewer than ten candidates: all; empty table: no rows."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component (operator 10). Unusable vectors and null labels: no links; vectors of other lengths aren't compared; equal vectors link; null vec_id: no links, null component; empty table: no rows."""
    return neargraph.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines and the digest of those that stay (operator 11). Null or empty text: one empty line, which stays; null doc_id: one document, the last in order; repeated rows: one document, alike; empty table: no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup(docs, n_lines="n_lines", n_dropped="n_dropped").select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS p FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
b AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 2),
m AS (SELECT k.*, b.key IS NOT NULL AND k.doc_id IS DISTINCT FROM b.first AS gone FROM k LEFT JOIN b ON k.key = b.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight and score against the benchmark's words, and its rank in the draw (operator 12). Null, empty or wordless text: no features, weight 0, not drawn; null doc_id: hashed as empty, last among ties; repeated rows: ranked one by one; empty table: no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = importance.ranked(importance.scored(docs, table(spark, sf_dir, "benchmark").select("text")))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 is a fold over a word's bytes with a table of 256 that the recursion makes from its polynomial.
OP12_SQL = r"""
WITH RECURSIVE bits(i, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS step FROM bits WHERE k = 8),
texts AS (SELECT 0 AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
split AS (SELECT side, r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM texts),
used AS (SELECT side, r, unnest(words) AS w FROM split),
hexed AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM used)),
hashed AS (SELECT w, xor(4294967295, list_reduce(list_transform(range(0, len(h), 2), lambda i: CAST('0x' || substr(h, CAST(i AS BIGINT) + 1, 2) AS BIGINT)), lambda c, b: xor(step[(xor(c, b) & 255) + 1], c >> 8), CAST(4294967295 AS BIGINT))) % 10000 AS bucket FROM hexed, crc),
featured AS (SELECT side, r, bucket FROM used JOIN hashed USING (w)),
counted AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM featured GROUP BY bucket),
whole AS (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS s_all, CAST(coalesce(sum(t), 0) AS DOUBLE) AS t_all FROM counted),
gained AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (s_all + 10000) / ((CAST(s AS DOUBLE) + 1) * (t_all + 10000)))) AS BIGINT) AS gain FROM counted, whole),
weighed AS (SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM featured JOIN gained USING (bucket) WHERE side = 0 GROUP BY r),
scored AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM split LEFT JOIN weighed USING (r) WHERE side = 0),
drawn AS (SELECT *, n_features >= 20 AS may, count(*) FILTER (n_features >= 20) OVER () AS n, row_number() OVER (ORDER BY n_features >= 20 DESC, score DESC, doc_id NULLS LAST) AS k FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND k <= 10 * n // 100 THEN k END AS rank FROM drawn
"""


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 phrases (operator 13). Null or empty text: no words; null lang: und; null doc_id and repeated rows: count as often as they occur; empty table: no rows."""
    return phrases.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


OP13_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS id, lang, piece FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) s(size) WHERE len(w) >= size)),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size >= 2 AND f >= 30),
inner_runs AS (SELECT lang, a, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase FROM (SELECT lang, a, w, size, k, unnest(range(1, size - k + 2)) AS i FROM c, (VALUES (2), (3)) s(k) WHERE k < size)),
covered AS (SELECT lang, phrase, max(a) AS longer FROM inner_runs GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN covered USING (lang, phrase) WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(a AS HUGEINT)),
cuts AS (SELECT lang, phrase, a, k, array_to_string(list_slice(w, 1, k), ' ') AS x, array_to_string(list_slice(w, k + 1, size), ' ') AS y FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)),
scored AS (SELECT t.lang, t.phrase, a, k, l.f AS l, r.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (l.f + r.f) AS BIGINT) AS score FROM cuts t JOIN f l ON l.lang = t.lang AND l.phrase = x JOIN f r ON r.lang = t.lang AND r.phrase = y),
least AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM least WHERE o = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_archive": op1_warc_archive,
    "op2_token_files": op2_token_files,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_language_id": op7_language_id,
    "op8_mix_sources": op8_mix_sources,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_line_dedup": op11_line_dedup,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_phrase_collocations": op13_phrase_collocations,
}
ORACLES: dict[str, str] = {"op1_warc_archive": OP1_SQL, "op4_chat_formatting": OP4_SQL, "op11_line_dedup": OP11_SQL, "op12_importance_resampling": OP12_SQL, "op13_phrase_collocations": OP13_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
