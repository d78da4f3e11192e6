"""The registered queries of the operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import avi, decontaminate, divergence, html_text, lexical, lm_score, mixing, pii, quality, repair, sharding, simhash, toxicity
from .common import held_out, table

SHARDS = 8


def scored(df: DataFrame, aside: Column) -> DataFrame:
    return df.select("doc_id", aside.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, aside = table(spark, sf_dir, "documents").select("doc_id", "text"), held_out(5, 0)
    net = toxicity.train(docs, table(spark, sf_dir, "labels"), ~aside)
    return scored(toxicity.score(docs, net, ["doc_id"]), aside)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("item_ids", F.array_join("item_ids", ","))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, aside = table(spark, sf_dir, "documents").select("doc_id", "text"), held_out(3, 1)
    ranking = quality.train(docs, table(spark, sf_dir, "labels"), ~aside)
    return scored(quality.score(docs, ranking, ["doc_id"]), aside)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.digests(table(spark, sf_dir, "documents"))


def op8_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("tie")


def op9_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.kd_shards(table(spark, sf_dir, "documents"), SHARDS)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.train(docs))


def op11_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return repair.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), by_words=True).drop("file")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pseudo_likelihood, op2_toxicity, op3_decontaminate, op4_quality, op5_simhash, op6_html_text, op7_avi, op8_pfair_mix, op9_kd_shards, op10_pii, op11_block_max_wand, op12_repair_ids, op13_source_divergence)}

#: Slots and blocks as in mixing.mix; a recursive query works out one period, earliest deadline first.
PFAIR = """
WITH RECURSIVE rows_ AS (
  SELECT doc_id, coalesce(source, '') AS source, strlen(coalesce(text, '')) + 1 AS size FROM documents
), placed AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // 65536 AS block FROM rows_
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS bytes, pow(CAST(sum(size) AS DOUBLE), 0.9) AS w FROM rows_ GROUP BY source
), shares AS (
  SELECT source, bytes, w / sum(w) OVER () AS target, greatest(1, CAST(floor(round(greatest(16384, 16 * count(*) OVER ())::DOUBLE * w / sum(w) OVER (), 6) + 0.5) AS BIGINT)) AS share,
         row_number() OVER (ORDER BY source) AS k FROM totals
), one AS (
  SELECT list(share ORDER BY k) AS q, CAST(sum(share) AS BIGINT) AS p, count(*) AS n FROM shares
), step AS (
  SELECT CAST(0 AS BIGINT) AS t, list_transform(q, lambda x: CAST(0 AS BIGINT)) AS done, CAST(NULL AS BIGINT) AS k FROM one
  UNION ALL
  SELECT t + 1, list_transform(range(1, n + 1), lambda j: done[j] + CASE WHEN j = pick THEN 1 ELSE 0 END), pick
  FROM (SELECT t, done, n, list_min(list_transform(
          list_filter(range(1, n + 1), lambda j: done[j] < q[j] AND (done[j] * p) // q[j] <= t),
          lambda j: (((done[j] + 1) * p + q[j] - 1) // q[j]) * 100000 + j)) % 100000 AS pick
        FROM step, one WHERE t < p)
), pattern AS (
  SELECT s.source, s.share, p AS period, t - 1 AS slot, row_number() OVER (PARTITION BY s.source ORDER BY t) - 1 AS turn
  FROM step JOIN shares s ON s.k = step.k, one WHERE step.k IS NOT NULL
), timed AS (
  SELECT placed.*, pattern.share, period, (block // share) * period + slot AS pos, (block // share) * period + (turn * period) // share AS r,
         (block // share) * period + ((turn + 1) * period + share - 1) // share AS d
  FROM placed JOIN pattern ON placed.source = pattern.source AND placed.block % pattern.share = pattern.turn
), stop AS (
  SELECT round(min(((bytes + 65535) // 65536 + 1) / target), 3) AS stop FROM shares
)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, block, CAST(pos AS BIGINT) AS slot, CAST(r AS BIGINT) AS "release", CAST(d AS BIGINT) AS deadline, pos < stop AS in_mix FROM timed, stop
"""

#: Templates and windows as in decontaminate.decontaminate, with eight tokens, for items of eight tokens or more (and shorter ones of five or more, whole).
TEMPLATES = """
WITH raw AS (
  SELECT 'd' AS kind, doc_id AS id, replace(coalesce(text, ''), '§', ' ') AS x FROM documents
  UNION ALL SELECT 'b', item_id, replace(coalesce(text, ''), '§', ' ') FROM benchmark
), named AS (
  SELECT kind, id, lower(regexp_replace(regexp_replace(regexp_replace(x,
    '([\\p{Ll}\\p{Nd},;:]\\s)(\\p{Lu}[\\p{L}\\p{M}]*)', '\\1§m\\2', 'g'), '([\\p{Ll}\\p{Nd},;:]\\s)(\\p{Lu}[\\p{L}\\p{M}]*)', '\\1§m\\2', 'g'), '([0-9]+)', ' §n\\1 ', 'g')) AS x FROM raw
), slotted AS (
  SELECT kind, id, trim(regexp_replace(regexp_replace(x, '(§n[0-9]+ +)(UNITS)([^\\p{L}\\p{M}\\p{Nd}]|$)', '\\1§u\\2\\3', 'g'), '[^\\p{L}\\p{M}\\p{Nd}§]+', ' ', 'g')) AS s FROM named
), words AS (
  SELECT kind, id, CASE WHEN s = '' THEN [] ELSE string_split(s, ' ') END AS raw,
         CASE WHEN s = '' THEN [] ELSE string_split(regexp_replace(s, '§([nmu])[^ ]+', '§\\1', 'g'), ' ') END AS w FROM slotted
), items AS (
  SELECT id AS item_id, raw, w, least(len(w), 8) AS size FROM words WHERE kind = 'b' AND len(w) >= 5
), wanted AS (
  SELECT item_id, size, unnest(range(0, len(w) - size + 1)) AS i, w FROM items
), have AS (
  SELECT id AS doc_id, size, unnest(range(0, greatest(0, len(w) - size + 1))) AS pos, w FROM words, (SELECT DISTINCT size FROM items) WHERE kind = 'd'
), hits AS (
  SELECT doc_id, item_id, h.size, pos - i AS shift, i FROM (SELECT doc_id, size, pos, array_to_string(w[pos + 1:pos + size], ' ') AS key FROM have) h
  JOIN (SELECT item_id, size, i, array_to_string(w[i + 1:i + size], ' ') AS key FROM wanted) b ON h.size = b.size AND h.key = b.key
), slots AS (
  SELECT DISTINCT doc_id, item_id, shift, items.raw[p + 1] AS a, d.raw[p + shift + 1] AS b
  FROM (SELECT DISTINCT doc_id, item_id, shift, unnest(range(i, i + size)) AS p FROM hits) c
  JOIN items USING (item_id) JOIN words d ON d.kind = 'd' AND d.id = c.doc_id
), checked AS (
  SELECT doc_id, item_id, shift, count(DISTINCT a) FILTER (a LIKE '§%') = count(*) FILTER (a LIKE '§%') AS consistent, coalesce(bool_or(a <> b) FILTER (a LIKE '§%'), false) AS altered
  FROM slots GROUP BY ALL
), passages AS (
  SELECT doc_id, item_id, altered, n FROM checked JOIN (SELECT doc_id, item_id, shift, count(DISTINCT i) AS n FROM hits GROUP BY ALL) USING (doc_id, item_id, shift) WHERE consistent
), per_item AS (
  SELECT doc_id, item_id, max(n) AS n, bool_and(altered) AS altered FROM passages GROUP BY ALL
), per_doc AS (
  SELECT doc_id, list(item_id ORDER BY item_id) AS item_ids, max(n) AS n, bool_or(altered) AS altered FROM per_item GROUP BY ALL
)
SELECT documents.doc_id, n IS NOT NULL AS contaminated, coalesce(altered, false) AS reparameterised, CAST(coalesce(len(item_ids), 0) AS BIGINT) AS n_items,
       CAST(coalesce(n, 0) AS BIGINT) AS n_windows, coalesce(array_to_string(item_ids, ','), '') AS item_ids FROM documents LEFT JOIN per_doc USING (doc_id)
""".replace("UNITS", "|".join(decontaminate.UNITS))

#: Scores of all documents, straight from the definition.
RANKED = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), whole AS (
  SELECT count(*) FILTER (len(t) > 0) AS big_n, CAST(coalesce(sum(len(t)), 0) AS BIGINT) AS big_l FROM d
), q AS (
  SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
), asked AS (
  SELECT q, item_id, unnest(t) AS term FROM q
), tf AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), df AS (
  SELECT term, count(*) AS df FROM tf GROUP BY term
), scored AS (
  SELECT q, item_id, r, doc_id, CAST(sum(CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM tf JOIN df USING (term) JOIN asked USING (term), whole GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= 10
"""

#: Shares and differences of all groups, straight from the definition.
DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), words AS (
  SELECT r, lang, source, unnest(t) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), v AS (
  SELECT lang, count(*) AS v, CAST(sum(n) AS HUGEINT) AS n FROM kept GROUP BY lang
), counts AS (
  SELECT lang, source, term, count(*) AS c FROM words GROUP BY ALL
), groups_ AS (
  SELECT lang, source, (SELECT CAST(coalesce(sum(c), 0) AS HUGEINT) FROM counts JOIN kept USING (lang, term) WHERE counts.lang = g.lang AND counts.source = g.source) AS n FROM (SELECT DISTINCT lang, source FROM d) g
), p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c, 0) AS c, CAST(1 + (1000000000::HUGEINT * (coalesce(c, 0) + 5)) // (g.n + 5 * v.v) AS BIGINT) AS p,
         CAST(1 + (1000000000::HUGEINT * (kept.n + 5)) // (v.n + 5 * v.v) AS BIGINT) AS q
  FROM groups_ g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN counts ON counts.lang = g.lang AND counts.source = g.source AND counts.term = kept.term
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS BIGINT) AS value
  FROM groups_ a JOIN groups_ b ON a.lang = b.lang AND a.source <> b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE c > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

ORACLES = {"op11_block_max_wand": RANKED, "op13_source_divergence": DIVERGENCE, "op3_decontaminate": TEMPLATES, "op8_pfair_mix": PFAIR}
