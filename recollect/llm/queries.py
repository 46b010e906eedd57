"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import warc
from .chat import format_conversations, read_back
from .class_lm import score
from .common import table
from .divergence import audit
from .language import identify
from .licences import scan
from .mixing import mix_plan
from .neighbours import nearest
from .packing import pack
from .quality import base_failed, judge, text_statistics
from .repair import damage, summaries
from .simhash import near_duplicates
from .substring_dedup import remove_repeats


def op1_pack_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of all documents."""
    return pack(table(spark, sf_dir, "documents"), with_ids=False)


def op2_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of four-word shingles, linked at four bits."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, radius=4)


def op3_brown_class_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the model of those not held out."""
    return score(table(spark, sf_dir, "documents"))


def op4_substring_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed and the digest of those kept, at windows of 50 words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, words=50).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_mix_splitting_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix's plan, with the output shards that drew the document."""
    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.transform("draws", lambda d: d["shard"]).alias("shards"))


def op6_licence_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of all documents."""
    return scan(table(spark, sf_dir, "documents")).drop("spans")


def op7_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests read back from all formatted conversations and one that imitates the template; fails if one isn't read back as it was."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.sql("SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)").to(turns.schema)
    chats = format_conversations(turns.unionByName(hard))
    failed = F.raise_error(F.lit("a conversation isn't read back as it was")).cast("string")
    return read_back(chats.withColumn("formatted", F.when(F.col("round_trip"), F.col("formatted")).otherwise(failed)))


def op8_neighbours_projected_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for each twentieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op9_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of all documents."""
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of all pages, read back from archives."""
    path = warc.archive_folder(spark)
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    captures = warc.assemble(warc.read_archives(spark, path, with_payload=False))
    size = F.coalesce("capture.payload_bytes", F.col("metadata")[0]["payload_bytes"])
    return captures.select("capture.page_id", size.alias("payload_bytes"), "capture.payload_digest", F.col("capture.type").alias("record_type"), "capture.refers_to")


def op11_repair_ranked_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of all conversations after damage."""
    turns = table(spark, sf_dir, "conversations")
    return summaries(damage(turns), conversations=turns)


def op12_divergence_supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of all pairs of sources, and each source's dearest terms."""
    return audit(table(spark, sf_dir, "documents"))


def op13_language_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those not held out."""
    return identify(table(spark, sf_dir, "documents"))


def licence_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op6 finds without its method, which SQL can express."""
    return scan(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op9 finds without its method, which SQL can express."""
    stats = text_statistics(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets of op5, and what its mix takes of each source as a whole, which SQL can express."""
    plan = mix_plan(table(spark, sf_dir, "documents"))
    found = plan.groupBy("source").agg(F.sum("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("t"), F.sum("taken").alias("taken"))
    return found.select("source", "size", "source_size", F.round("t", 6).alias("target"), (F.abs(F.col("taken") - F.col("t")) <= 2).alias("met"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack_sum_of_squares": op1_pack_sum_of_squares,
    "op2_simhash_bk_trees": op2_simhash_bk_trees,
    "op3_brown_class_bigrams": op3_brown_class_bigrams,
    "op4_substring_doubling": op4_substring_doubling,
    "op5_mix_splitting_tree": op5_mix_splitting_tree,
    "op6_licence_automaton": op6_licence_automaton,
    "op7_chat_round_trip": op7_chat_round_trip,
    "op8_neighbours_projected_tree": op8_neighbours_projected_tree,
    "op9_quality_mcd": op9_quality_mcd,
    "op10_warc_transactions": op10_warc_transactions,
    "op11_repair_ranked_edits": op11_repair_ranked_edits,
    "op12_divergence_supports": op12_divergence_supports,
    "op13_language_dictionaries": op13_language_dictionaries,
    "licence_phrases": licence_phrases,
    "quality_statistics": quality_statistics,
    "mix_targets": mix_targets,
}

ORACLE_SQL: dict[str, str] = {
    "licence_phrases": r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 f AS (SELECT doc_id, len(w) AS n, list_filter(range(len(w)), lambda i: w[i + 1] = 'mit' AND w[i + 2] = 'license') AS m, list_filter(range(len(w)), lambda i: w[i + 1] = 'apache' AND w[i + 2] = 'license') AS a,
  list_filter(range(len(w)), lambda i: w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license') AS g FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(m) + len(a) + len(g) AS BIGINT) AS n_base, list_min(m || a || g) AS first_word, list_max(m || a || g) AS last_word,
 concat_ws(',', CASE WHEN len(a) > 0 THEN 'apache' END, CASE WHEN len(g) > 0 THEN 'gpl' END, CASE WHEN len(m) > 0 THEN 'mit' END) AS base_labels FROM f""",
    "quality_statistics": r"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 p AS (SELECT k, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
 h AS (SELECT k, i, count(*) OVER (PARTITION BY k, w[i], w[i + 1], w[i + 2]) AS n FROM p),
 c AS (SELECT k, count(DISTINCT i + j) AS n FROM h, (VALUES (0), (1), (2)) AS x(j) WHERE n > 1 GROUP BY k),
 s AS (SELECT d.*, coalesce(c.n, 0) AS rep, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d LEFT JOIN c USING (k))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(rep AS BIGINT) AS n_repeat_words, len(w) < 50 OR 100 * rep > 50 * len(w) AS base_failed FROM s""",
    "mix_targets": r"""WITH s AS (SELECT source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT) AS size FROM documents GROUP BY source),
 n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM s),
 w AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][number % 3 + 1] AS weight, 2.0::DOUBLE * size AS cap FROM n),
 r AS (SELECT *, cap / weight AS ratio FROM w),
 q AS (SELECT *, (1.5::DOUBLE * sum(size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS rate FROM r
  WINDOW b AS (ORDER BY ratio, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 f AS (SELECT rate FROM q WHERE rate <= ratio ORDER BY ratio, number LIMIT 1)
SELECT source, size, size AS source_size, round(least(cap, coalesce((SELECT rate FROM f) * weight, cap)), 6) AS target, true AS met FROM q""",
    "op4_substring_doubling": r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
 h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM p),
 r AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS owner FROM h) WHERE doc_id > owner),
 c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM r),
 g AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id),
 k AS (SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, w, range(1, len(w) + 1) AS every FROM d LEFT JOIN g USING (doc_id)),
 a AS (SELECT doc_id, unnest(w) AS word, unnest(every) AS pos FROM k),
 t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM a ANTI JOIN c USING (doc_id, pos) GROUP BY doc_id)
SELECT k.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k LEFT JOIN t USING (doc_id)""",
    "op7_chat_round_trip": r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
 e AS (SELECT *, contains(role || '|' || text, '</s>') OR contains(role, chr(10)) OR regexp_matches(role, '\\[nlb]') OR regexp_matches(text, '\\[nlb]') AS escaped,
  length(role) + length(text) + 8 AS n, length(regexp_replace(role || text, '[^\\<\n]', '', 'g')) AS more FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(n + CASE WHEN escaped THEN more ELSE 0 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op10_warc_transactions": """WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS b FROM pages),
 o AS (SELECT *, CASE WHEN b >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS owner FROM p)
SELECT page_id, CAST(b AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN page_id <> owner THEN owner END AS refers_to FROM o""",
    "op11_repair_ranked_edits": r"""WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc),
 src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '') AS k FROM conversations),
 coded AS (SELECT src.*, xor(list_reduce(list_prepend(4294967295, list_transform(k, lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS code FROM src, tab),
 dam AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM coded JOIN (VALUES (0), (1)) AS c(copy) ON copy = 0 OR code = 3 WHERE code <> 0),
 ord AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), sha256(text)) AS i FROM dam),
 flt AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
   WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS two FROM ord),
 nxt(state, ini, after) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
 run(state, run, after) AS (VALUES (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (2, 2, 2), (3, 0, 3), (3, 1, 2), (3, 2, 3)),
 mac AS (SELECT state, repeat('I', run) || 'D' AS code, 5 * run + 2 AS cost, NULL AS ini, after FROM run
  UNION ALL SELECT r.state, repeat('I', run) || 'K', 5 * run, ini, n.after FROM run r JOIN nxt n ON n.state = r.after
  UNION ALL SELECT r.state, repeat('I', run) || 'R', 5 * run + 1, NULL, n.after FROM run r JOIN nxt n ON n.state = r.after WHERE ini <> 's'),
 dp AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, {'cost': 0, 'audit': ''} AS best FROM conversations
  UNION ALL SELECT d.conv_id, f.i, m.after, min({'cost': d.best.cost + m.cost + CASE WHEN f.fault = 'truncated' AND m.code NOT LIKE '%D' THEN 5 ELSE 0 END, 'audit': d.best.audit || m.code})
   FROM dp d JOIN flt f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.i = d.i + 1 JOIN mac m ON m.state = d.state AND (m.ini IS NULL OR m.ini = left(f.role, 1)) AND (f.fault NOT IN ('blank', 'duplicate') OR m.code LIKE '%D')
   GROUP BY d.conv_id, f.i, m.after),
 res AS (SELECT conv_id, min({'cost': best.cost + 5 * n, 'audit': best.audit || repeat('I', n)}) AS best FROM dp JOIN (VALUES (0, 0), (1, 2), (2, 1), (3, 0)) AS e(state, n) USING (state)
  WHERE i = (SELECT count(*) FROM ord WHERE ord.conv_id IS NOT DISTINCT FROM dp.conv_id) GROUP BY conv_id),
 let AS (SELECT conv_id, pos, substr(best.audit, pos, 1) AS edit FROM (SELECT *, unnest(range(1, length(best.audit) + 1)) AS pos FROM res)),
 num AS (SELECT *, count(*) FILTER (edit <> 'I') OVER w AS i, count(*) FILTER (edit <> 'D') OVER w AS j FROM let WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
 fin AS (SELECT n.conv_id, n.pos, n.j, n.edit, CASE WHEN n.edit <> 'I' THEN o.role END AS role, CASE WHEN n.edit = 'I' THEN '' ELSE o.text END AS text,
   max(CASE WHEN n.j = 1 AND n.edit = 'K' AND o.role LIKE 's%' THEN 1 ELSE 0 END) OVER (PARTITION BY n.conv_id) AS s
  FROM num n LEFT JOIN ord o ON o.conv_id IS NOT DISTINCT FROM n.conv_id AND o.i = n.i AND n.edit <> 'I' WHERE n.edit <> 'D'),
 dig AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (j - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY pos)) AS h FROM fin GROUP BY conv_id),
 sta AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
   count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM flt GROUP BY conv_id)
SELECT r.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 CAST(best.cost AS BIGINT) AS cost, best.audit AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM res r LEFT JOIN sta s ON s.conv_id IS NOT DISTINCT FROM r.conv_id LEFT JOIN dig d ON d.conv_id IS NOT DISTINCT FROM r.conv_id""",
    "op12_divergence_supports": r"""WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
 e AS (SELECT k, lang, source, unnest(w) AS term FROM d),
 v AS (SELECT lang, term, count(*) AS n FROM e GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
 g AS (SELECT DISTINCT lang, source FROM d),
 c AS (SELECT g.lang, g.source, v.term, count(e.k) AS n, v.n AS m FROM g JOIN v USING (lang) LEFT JOIN e ON e.lang = g.lang AND e.source = g.source AND e.term = v.term GROUP BY g.lang, g.source, v.term, v.n),
 p AS (SELECT lang, source, term, n, 1 + CAST(1000000000 AS HUGEINT) * (n + 1) // (sum(n) OVER s + count(*) OVER s) AS p, 1 + CAST(1000000000 AS HUGEINT) * (m + 1) // (sum(m) OVER s + count(*) OVER s) AS q FROM c WINDOW s AS (PARTITION BY lang, source)),
 r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
  UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM v)
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r) WHERE part = 'pair' OR rank <= 200""",
}
