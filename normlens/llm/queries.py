"""The queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normlens.llm import decontaminate, filter_audit, html_text, langid, licences, lm, media, minhash, mixing, packing, quality, topk, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.fingerprint(media.store(_table(spark, sf_dir, "documents")))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages")).drop("n_lines", "n_kept")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    return topk.search(vectors, topk.query_of(F.col("vec_id"))).drop("depth")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("source")


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", whitening.integer_vector(F.col("embedding")).alias("x"))
    return whitening.whiten(vectors)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    out = f"lower(coalesce({text}, ''))"
    for form in (licences.TAG_LINE, licences.LAST_ADDRESS, licences.COPYRIGHT_LINE):
        out = f"regexp_replace({out}, {_quoted(form)}, chr(10), 'g')"
    for found, form in licences.SPELLINGS:
        out = f"replace({out}, {_quoted(found)}, {_quoted(form)})"
    out = f"regexp_replace({out}, {_quoted(licences.LIST_MARK)}, ' ', 'g')"
    return f"regexp_replace(trim(regexp_replace({out}, {_quoted(licences.NOT_WORD)}, ' ', 'g')), {_quoted(licences.NAMED)}, {_quoted(licences.UNNAMED)}, 'g')"


OP1_SQL = f"""
WITH known(license_id, form) AS (
  SELECT license_id, {_canonical_sql("body")}
  FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in sorted(licences.KNOWN.items()))}) t(license_id, body)),
digests AS (SELECT sha256(form) AS known_digest, min(license_id) AS license_id FROM known WHERE form <> '' GROUP BY 1),
own AS (SELECT doc_id, sha256({_canonical_sql("text")}) AS digest FROM documents)
SELECT doc_id, digest, license_id, license_id IS NOT NULL AS matched FROM own LEFT JOIN digests ON digest = known_digest
"""

OP7_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS place
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank, sum(source_size) OVER ()::BIGINT AS total,
         ceil(docs / greatest({mixing.SHARD_DOCS}.0::DOUBLE, sqrt(docs)))::BIGINT AS shards FROM sources),
weighed AS (SELECT *, [3, 1, 2][((rank - 1) % 3 + 1)::INT]::BIGINT AS weight FROM ranked),
run AS (
  SELECT *, row_number() OVER w AS ord,
         (3 * total - 4 * coalesce(sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
         (sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS lft
  FROM weighed WINDOW w AS (ORDER BY source_size::DOUBLE / weight, rank)),
level AS (SELECT arg_min(rest, ord) AS rest, arg_min(lft, ord) AS lft, min(ord) AS ord FROM run
          WHERE rest * weight < 4 * source_size * lft),
block AS (SELECT greatest(1, least({mixing.BLOCK}, coalesce(min(source_size) FILTER (source_size > 0), 0) // {mixing.BLOCKS}))::BIGINT AS b FROM sources),
targets AS (
  SELECT r.source, r.source_size, r.shards, r.total, r.rank, b,
         CASE WHEN r.ord >= l.ord THEN (l.rest * r.weight)::DOUBLE / (2 * l.lft)::DOUBLE ELSE (2 * r.source_size)::DOUBLE END AS target
  FROM run r, level l, block),
seats AS (SELECT *, ceil(3 * total / (2 * b)::DOUBLE - 0.5)::BIGINT AS m FROM targets),
votes AS (SELECT source, target, m, s FROM seats, range(0, 1 + (2 + ceil(target / b::DOUBLE))::BIGINT) t(s)),
won AS (
  SELECT source, count(*) FILTER (place <= m) AS quota
  FROM (SELECT *, row_number() OVER (ORDER BY target / (2 * s + 1) DESC, source NULLS LAST) AS place FROM votes WHERE target > 0)
  GROUP BY source),
quotas AS (SELECT t.*, coalesce(w.quota, 0) AS quota FROM targets t LEFT JOIN won w ON t.source IS NOT DISTINCT FROM w.source),
placed AS (
  SELECT d.*, q.source_size, q.target, q.quota, q.rank, q.b, ('0x' || substr(place, 1, 8))::BIGINT % q.shards AS shard
  FROM sized d JOIN quotas q ON d.source IS NOT DISTINCT FROM q.source),
streamed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY rank, shard ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM placed),
shard_sizes AS (SELECT rank, shard, sum(size)::BIGINT AS shard_size, any_value(quota) AS quota FROM placed GROUP BY rank, shard),
shard_votes AS (SELECT rank, shard, shard_size, quota, s FROM shard_sizes, range(0, quota + 1) t(s) WHERE shard_size > 0),
shard_won AS (
  SELECT rank, shard, count(*) FILTER (place <= quota) AS shard_quota
  FROM (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY shard_size::DOUBLE / (2 * s + 1) DESC, shard) AS place FROM shard_votes)
  GROUP BY rank, shard),
final AS (
  SELECT d.*, ceil(z.shard_size / b::DOUBLE)::BIGINT AS n, least(coalesce(w.shard_quota, 0), 2 * ceil(z.shard_size / b::DOUBLE)::BIGINT) AS q
  FROM streamed d JOIN shard_sizes z USING (rank, shard) LEFT JOIN shard_won w USING (rank, shard))
SELECT doc_id, size, source_size, target,
       (CASE WHEN n > 0 THEN q // n ELSE 0 END * size
        + greatest(0, least(size, CASE WHEN n > 0 THEN q % n ELSE 0 END * b - pos)))::BIGINT AS taken
FROM final
"""


OP8_SQL = f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingled AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {minhash.WORDS} THEN list_transform(range(1, len(w) - {minhash.WORDS - 2}), lambda i: array_to_string(w[i:i + {minhash.WORDS - 1}], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM worded),
sizes AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM shingled a JOIN shingled b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE {minhash.UNDER} * i >= {minhash.OVER} * (p.n + q.n - i)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, w.y FROM reached r JOIN ways w ON w.x = r.other),
found AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, f.component_id, d.doc_id = f.component_id AS kept
FROM documents d JOIN found f USING (doc_id) LEFT JOIN sizes z USING (doc_id)
"""


OP5_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({topk.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {topk.EVERY} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {topk.K}
"""


_SPACE_WORD = "'[^\\x20\\x09-\\x0D]+'"

OP11_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
worded AS (SELECT *, regexp_extract_all(t, {_SPACE_WORD}) AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM texts),
marks AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS bad FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > least, false) AS e, coalesce(good, false) AS good, coalesce(bad, false) AS bad
  FROM worded LEFT JOIN marks USING (doc_id)),
counted AS (
  SELECT part, MAP {{'A': a, 'B': b, 'C': c, 'D': d, 'E': e}} AS fails, a::INT + b::INT + c::INT + d::INT + e::INT AS n_fails,
         count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (bad) AS n_bad FROM failed GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT p.x || q.x || r.x || s.x || u.x AS filter_order FROM letters p, letters q, letters r, letters s, letters u
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5),
steps AS (SELECT filter_order, step::INT AS step, filter_order[step] AS own, string_split(filter_order[1:step - 1], '') AS earlier FROM orders, range(1, 6) t(step)),
met AS (
  SELECT part, filter_order, step, own, n, n_good, n_bad, n_fails, fails[own] AS here,
         len(list_filter(earlier, lambda x: coalesce(fails[x], false))) > 0 AS gone
  FROM counted, steps),
summed AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT gone AND NOT here), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND here), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (gone AND here), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (here AND n_fails = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(n_good) FILTER (NOT gone AND here), 0)::BIGINT AS good_lost, coalesce(sum(n_bad) FILTER (NOT gone AND here), 0)::BIGINT AS toxic_lost
  FROM met GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM summed
"""


_ITEM_WORD = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP13_SQL = f"""
WITH item_words AS (SELECT item_id, regexp_extract_all({_LOWERED}, {_ITEM_WORD}) AS w FROM benchmark),
cut AS (SELECT item_id, w, least(len(w), {decontaminate.WINDOW}) AS m, unnest(range(1, len(w) - least(len(w), {decontaminate.WINDOW}) + 2)) AS i FROM item_words WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS form FROM cut),
lengths AS (SELECT DISTINCT m FROM windows),
doc_words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWERED}, {_ITEM_WORD}) AS w FROM documents),
places AS (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc_words, lengths WHERE len(w) >= m),
hits AS (SELECT r, i, h.m, item_id FROM (SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS form FROM places) p JOIN windows h USING (m, form)),
hit_words AS (SELECT r, count(DISTINCT spot) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS spot FROM hits) GROUP BY r),
hit_items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""


def queries() -> dict:
    found = [op1_license_scan, op2_packing, op3_media, op4_html_text, op5_topk, op6_lm_score, op7_mixing, op8_near_dup, op9_language_id, op10_quality]
    found += [op11_filter_audit, op12_whitening, op13_decontamination]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": OP1_SQL, "op5_topk": OP5_SQL, "op7_mixing": OP7_SQL, "op8_near_dup": OP8_SQL, "op11_filter_audit": OP11_SQL, "op13_decontamination": OP13_SQL}
