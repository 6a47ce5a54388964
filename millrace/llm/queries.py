"""The operators of this subpackage as queries, with their production parameters, and SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import backoff_lm, clustering, decontaminate, fingerprints, language, licenses, mixing, near_dedup, ngram_join, resampling, substrings, toxicity, urls
from millrace.llm.language import in_fold
from millrace.session import apply_settings

# Whole texts travel to Python in batches of so many rows.
ARROW_ROWS = "2000"

RULES = [
    urls.Rule("com", "/", "allow"), urls.Rule("example.com", "/en/", "block"), urls.Rule("www.example.com", "/en/", "allow"),
    urls.Rule("net", "/es/", "block"), urls.Rule("net", "/fr/", "block"),
]


def settle(spark: SparkSession) -> None:
    apply_settings(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")  # these operators bound their batches by rows


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    settle(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = F.aggregate("takes", F.lit(0).cast("bigint"), lambda a, t: a + t["n_words"])
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def op2_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_read(spark, sf_dir, "pages"), RULES)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = in_fold(F.col("doc_id"), 5, 0)
    model = toxicity.fit_toxicity(docs.where(~held_out), _read(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "offending")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = in_fold(F.col("doc_id"), 4, 2)
    model = language.fit_languages(docs.where(~held_out))
    return language.predict_language(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"), ["doc_id"])


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(_read(spark, sf_dir, "documents"))


def op7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), ["doc_id"])
    ids = F.transform("leaks", lambda x: x["item_id"])
    return found.select("doc_id", (F.size("leaks") > 0).alias("leaked"), ids.alias("item_ids"), F.array_min(F.transform("leaks", lambda x: x["edits"])).alias("least_edits"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_read(spark, sf_dir, "documents"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = in_fold(F.col("doc_id"), 7, 2)
    scored = backoff_lm.score_texts(_read(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(_read(spark, sf_dir, "documents"))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_vectors(_read(spark, sf_dir, "embeddings"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(_read(spark, sf_dir, "documents"))


def base_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rules alone decide in op2_url_verdicts."""
    ruled = F.when(F.col("rule").isNotNull(), F.col("verdict"))
    return op2_url_verdicts(spark, sf_dir).select("page_id", "host", "path", "rule", ruled.alias("ruled"))


def base_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of op5_licenses."""
    return op5_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def base_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and unigram scores of op9_lm_scores, to six places."""
    found = op9_lm_scores(spark, sf_dir)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


def base_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edited texts of op10_fingerprints."""
    return op10_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


QUERIES = (
    op1_mix_sources, op2_url_verdicts, op3_toxicity, op4_language, op5_licenses, op6_near_duplicates, op7_leaks, op8_substrings, op9_lm_scores,
    op10_fingerprints, op11_clusters, op12_resampling, op13_ngram_join, base_urls, base_licenses, base_lm_scores, base_edits,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


_SIZE = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT"

_MIX = rf"""
WITH docs AS (SELECT doc_id, source, {_SIZE} AS size, md5('7:' || doc_id::VARCHAR) AS key FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source::BLOB) - 1 AS rank FROM docs GROUP BY source),
weighed AS (SELECT *, ([5, 2, 1])[1 + rank % 3]::BIGINT AS weight, 2 * source_size AS most FROM per),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE
             - coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
  FROM weighed),
opened AS (SELECT arg_min(level, (most / weight, rank)) AS level FROM levels WHERE most >= level * weight),
targets AS (
  SELECT l.source, l.source_size, least(l.most::DOUBLE, coalesce(o.level * l.weight, l.most::DOUBLE)) AS target
  FROM levels l, opened o),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS start
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, floor(target)::BIGINT - start))
        + greatest(0, least(size, floor(target)::BIGINT - start - source_size)))::BIGINT AS taken
FROM placed"""


_SUBSTRINGS = r"""
WITH docs AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
words AS (SELECT doc_id, len(ws) AS n, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM docs),
windows AS (
  SELECT doc_id, i, word, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS s
  FROM words),
starts AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS again FROM windows WHERE i + 19 <= n),
marked AS (
  SELECT w.doc_id, w.i, w.word,
         max(coalesce(s.again, false)::INT) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
  FROM words w LEFT JOIN starts s ON w.doc_id = s.doc_id AND w.i = s.i)
SELECT d.doc_id, len(any_value(d.ws))::BIGINT AS n_words, coalesce(sum(m.gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(m.word, ' ' ORDER BY m.i) FILTER (WHERE m.gone = 0), '')) AS kept_sha256
FROM docs d LEFT JOIN marked m ON d.doc_id = m.doc_id GROUP BY d.doc_id"""


_SHINGLES = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS shingles FROM docs),
rows AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS common
  FROM rows a JOIN rows b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM pairs WHERE 100 * common >= 80 * (n + m - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a)
SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles, l.component_id, coalesce(d.n_links, 0)::BIGINT AS n_links
FROM sets s JOIN least l USING (doc_id) LEFT JOIN degree d USING (doc_id)"""


def _clusters_sql(k: int = 40, rounds: int = 5) -> str:
    """Rounds spelled out as tables c0 … c5 of centroids and a0 … a5 of assigned vectors."""
    near = """a{r} AS (
  SELECT vec_id, v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (
    SELECT p.vec_id, p.v, c.cluster, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM points p, c{r} c) GROUP BY vec_id, v)"""
    move = """m{r} AS (
  SELECT cluster, list(x ORDER BY i) AS v FROM (
    SELECT cluster, i, ((sum(x)::BIGINT - ((sum(x)::BIGINT % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x
    FROM (SELECT cluster, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM a{p}) GROUP BY cluster, i) GROUP BY cluster),
c{r} AS (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{p} c LEFT JOIN m{r} m USING (cluster))"""
    parts = ["""points AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""", f"""c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR), v) - 1 AS cluster, v FROM points
  ORDER BY sha256('2:' || vec_id::VARCHAR), v LIMIT {k})""", near.format(r=0)]
    for r in range(1, rounds + 1):
        parts += [move.format(r=r, p=r - 1), near.format(r=r)]
    return "WITH " + ",\n".join(parts) + f"""
SELECT a.vec_id, a.cluster::INT AS cluster, a.distance, (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
       (sum(a.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (cluster)"""


# The table of CRC-32 is made by eight shifts of each byte; a word's CRC goes over the bytes of its hexadecimal form.
_CRC = r"""
crc AS (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, b) ORDER BY b) AS t FROM range(256) r(b))"""
_CRC_OF = "xor(list_reduce({bytes}, lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT)"
_RESAMPLING = rf"""
WITH {_CRC},
texts AS (
  SELECT doc_id AS id, 's' AS side, text FROM documents UNION ALL SELECT item_id, 't', text FROM benchmark),
words AS (
  SELECT id, side, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts),
hexed AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM words)),
bytes AS (SELECT word, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS bs FROM hexed),
buckets AS (
  SELECT word, {_CRC_OF.format(bytes="bs")} % 10000 AS bucket
  FROM bytes, crc),
features AS (SELECT w.id, w.side, b.bucket FROM words w JOIN buckets b USING (word)),
totals AS (SELECT bucket, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t FROM features GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0)::DOUBLE AS all_s, coalesce(sum(t), 0)::DOUBLE AS all_t FROM totals),
gains AS (
  SELECT bucket, floor(1000.0::DOUBLE * ln(((t + 1)::DOUBLE * (all_s + 10000)) / ((s + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain FROM totals, sums),
weighed AS (SELECT id, count(*) AS n, sum(gain)::BIGINT AS weight FROM features JOIN gains USING (bucket) WHERE side = 's' GROUP BY id),
scored AS (
  SELECT d.doc_id, coalesce(w.n, 0)::BIGINT AS n_features, coalesce(w.weight, 0)::BIGINT AS weight,
         ('0x' || substr(sha256('2024:' || d.doc_id::VARCHAR), 1, 8))::BIGINT::DOUBLE AS h FROM documents d LEFT JOIN weighed w ON d.doc_id = w.id),
noisy AS (SELECT doc_id, n_features, weight, weight + floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM scored),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM noisy WHERE n_features >= 20)
SELECT y.doc_id, y.n_features, y.weight, y.score, CASE WHEN p.place <= 10 * p.n // 100 THEN p.place END::BIGINT AS rank
FROM noisy y LEFT JOIN placed p USING (doc_id)"""


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_URLS = """
WITH rules(host, path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '.*') AS path FROM cut),
fits AS (
  SELECT page_id, arg_max(r.host || r.path, len(r.host || r.path)) AS rule, arg_max(verdict, len(r.host || r.path)) AS ruled
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY page_id)
SELECT page_id, host, path, rule, ruled FROM parts LEFT JOIN fits USING (page_id)"""

_LICENSES = rf"""
WITH phrases(words, label) AS (
  VALUES (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')),
docs AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
hits AS (
  SELECT doc_id, label, unnest(list_filter(range(1, len(ws) + 1), lambda i: ws[i:i + len(words) - 1] = words)) - 1 AS start FROM docs, phrases)
SELECT doc_id, any_value(len(ws))::BIGINT AS n_words, count(start)::BIGINT AS n_base, min(start)::BIGINT AS first_word, max(start)::BIGINT AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM docs LEFT JOIN hits USING (doc_id) GROUP BY doc_id"""

_UNIGRAMS = rf"""
WITH {_CRC},
docs AS (
  SELECT doc_id, {_CRC_OF.format(bytes="list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)")} % 7 = 2 AS held_out,
         list_append(coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []), ' ') AS tokens FROM documents, crc),
rows AS (SELECT doc_id, held_out, unnest(tokens) AS token FROM docs),
counts AS (SELECT token, count(*) AS c FROM rows WHERE NOT held_out GROUP BY token),
sums AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM counts)
SELECT doc_id, any_value(held_out) AS held_out, count(*)::BIGINT AS n_tokens, count(c)::BIGINT AS n_known, any_value(n)::BIGINT AS train_tokens,
       round(sum(log10((coalesce(c, 0) + 1)::DOUBLE / (n + v + 1))), 6) AS base_score
FROM rows LEFT JOIN counts USING (token), sums GROUP BY doc_id"""

_EDITS = """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
pairs AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS following FROM docs)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(left(text, length(text) - length(text) // 2) || left(following, length(text) // 2)) AS edited_sha256
FROM pairs"""


def oracle_sql() -> dict[str, str]:
    return {"base_urls": _URLS, "base_licenses": _LICENSES, "base_lm_scores": _UNIGRAMS, "base_edits": _EDITS, "op1_mix_sources": _MIX, "op8_substrings": _SUBSTRINGS, "op11_clusters": _clusters_sql(), "op12_resampling": _RESAMPLING, "op13_ngram_join": _SHINGLES}
