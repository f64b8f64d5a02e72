"""Registered queries of this subpackage, each over its whole table, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.session import scratch_path

from . import audit, bpe, decontamination, fim, langid, mixing, neighbours, packed, rollup, secrets, simhash, toxicity, vafile
from .common import crc_mod, stored, table

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")

QUALITY_TARGETS = {"clean": 0.90, "poor": 0.08, "toxic": 0.02}


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents"), WORD_BPE))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(table(spark, sf_dir, "documents")))


def op3_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=3)


def op5_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "packed-ids")
    packed.write_segments(table(spark, sf_dir, "documents"), path, BYTE_BPE, end_id=0)
    return packed.checksums(packed.read_documents(spark, path))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), crc_mod("doc_id", 4) == 2)


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labelled table: toxic, else poor or clean by quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    domains, mixed = mixing.mix(table(spark, sf_dir, "documents"), domains_of(table(spark, sf_dir, "labels")), QUALITY_TARGETS)
    return mixing.report(domains, mixed)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) == 0)


#: The two counters whose versions op9 keeps totals of.
COUNTERS = {"words-1": r"[^\x20\x09-\x0D]+", "letters-2": r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"}


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents enter under two counters; toxic ones are deleted; poor ones have their second count revised to
    that of their distinct lines; one batch is sent twice. Rows with equal or no doc_id count each: like rows are one
    change with their number, unlike ones differ in ``copy``. The counters are patterns, so that SQL can count too."""
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint"), "source", "lang", F.coalesce("text", F.lit("")).alias("text"))
    lines = F.array_join(F.array_distinct(F.split("text", "\n", -1)), "\n")
    count = lambda v, text: F.regexp_count(text, F.lit(COUNTERS[v])).cast("bigint")
    counted = docs.select("doc_id", "source", "lang", F.xxhash64("text", "source", "lang").alias("copy"),
                          *(count(v, F.col("text")).alias(v) for v in COUNTERS), count("letters-2", lines).alias("distinct lines"))
    like = stored(counted.groupBy(*counted.columns).agg(F.count("*").alias("docs")), "token-counts-rows")
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("of")).agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    known = like.join(marked, F.col("doc_id") == F.col("of"))
    columns = ["doc_id", "copy", "docs", "source", "lang"]
    change = lambda rows, op, counts: rows.select(*columns, F.lit(op).alias("op"), F.explode(F.array(
        *(F.struct(F.lit(v).alias("version"), F.col(f"`{c}`").alias("tokens")) for v, c in counts.items()))).alias("c")).select(*columns, "op", "c.version", "c.tokens")
    kept = rollup.TokenRollup(spark, scratch_path(spark, "token-counts"))
    gone = change(known.where("toxic = 1"), "delete", {v: v for v in COUNTERS})
    kept.apply("1-insert", change(like, "insert", {v: v for v in COUNTERS}))
    kept.apply("2-delete", gone)
    kept.apply("3-revise", change(known.where("quality = 0"), "revise", {"letters-2": "distinct lines"}))
    kept.apply("2-delete", gone)
    return kept.totals()


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-middle forms of all documents, seed 42: half of them cut, 80 % of those suffix first."""
    return fim.digests(fim.transform(table(spark, sf_dir, "documents"), seed=42, rate=50, spm_rate=80))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all 120 orders over all documents, by language."""
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents inside ten-word windows of all benchmark items."""
    return decontamination.report(decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_bpe, op2_secrets, op3_embedding_neardup, op4_simhash, op5_packed_ids, op6_langid, op7_mixing, op8_toxicity, op9_token_counts, op10_topk,
    op11_fim, op12_filter_audit, op13_decontamination, pipeline)}

_SECRETS = r"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
rules(kind, name, pattern, value) AS (VALUES
  (0, 'assign', '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', '^.{6,}$'),
  (1, 'access', 'AKIA[A-Z0-9]+', '^.{20,}$'),
  (2, 'hex', '[0-9a-f]+', '^.{24,}$'),
  (9, 'run', '[A-Za-z0-9+/_-]+', '^.{20,}$')),
hits AS (
  SELECT doc_id, r, kind, name, value,
    regexp_extract_all(text, pattern) AS found,
    regexp_extract_all(text, pattern, CASE WHEN kind = 0 THEN 2 ELSE 0 END) AS tested,
    list_transform(string_split_regex(text, pattern), lambda x: length(x)) AS gaps
  FROM docs, rules WHERE regexp_matches(text, pattern)),
each AS (
  SELECT doc_id, r, kind, name, value, unnest(found) AS hit, unnest(tested) AS part, unnest(range(1, len(found) + 1)) AS i, gaps, found FROM hits),
placed AS (
  SELECT doc_id, r, kind, name, hit,
    list_sum(gaps[1:i]) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS first
  FROM each WHERE regexp_matches(part, value)),
base AS (SELECT doc_id, r, kind, name, first::BIGINT AS first, (first + length(hit))::BIGINT AS last FROM placed WHERE kind < 9),
runs AS (
  SELECT doc_id, r, first, hit, regexp_full_match(hit, '[0-9a-f]+|[0-9A-F]+') AS narrow FROM placed
  WHERE kind = 9 AND regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]')
    AND NOT regexp_full_match(hit, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}')
    AND NOT regexp_full_match(hit, '/?([a-z]+[0-9]{0,4}|[0-9]{1,4}|[A-Z][a-z]+)([_/-]+([a-z]+[0-9]{0,4}|[0-9]{1,4}|[A-Z][a-z]+))+[_/-]*')
    AND NOT regexp_matches(hit, '(?i)example|sample|dummy|placeholder|changeme|0123456789abcdef|abcdefghijklmnop|1234567890')),
shifts AS (SELECT doc_id, r, first, hit, narrow, unnest(range(0, length(hit) - 19)) AS pos FROM runs),
high AS (
  SELECT doc_id, r, first, narrow, pos FROM shifts
  WHERE list_aggregate(string_split(substring(hit, (pos + 1)::BIGINT, 20), ''), 'entropy') >= CASE WHEN narrow THEN 3.051 ELSE 3.851 END),
breaks AS (
  SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY r, first ORDER BY pos) + 20 THEN 0 ELSE 1 END AS new FROM high),
islands AS (SELECT *, sum(new) OVER (PARTITION BY r, first ORDER BY pos) AS island FROM breaks),
added AS (
  SELECT doc_id, r, CASE WHEN narrow THEN 3 ELSE 4 END AS kind, CASE WHEN narrow THEN 'entropy_hex' ELSE 'entropy_key' END AS name,
    (first + min(pos))::BIGINT AS first, (first + max(pos) + 20)::BIGINT AS last
  FROM islands GROUP BY doc_id, r, first, narrow, island),
everything AS (SELECT * FROM base UNION ALL SELECT * FROM added),
written AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(name || ':' || first || ':' || last, ',' ORDER BY first, kind, last) FILTER (kind < 3) AS base,
    string_agg(name || ':' || first || ':' || last, ',' ORDER BY first, kind, last) AS spans
  FROM everything GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN written USING (r)
"""

_TOKEN_COUNTS = r"""
WITH marked AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id),
docs AS (SELECT d.*, coalesce(m.toxic, 0) AS toxic, coalesce(m.quality, 1) AS quality FROM documents d LEFT JOIN marked m USING (doc_id)),
counted AS (
  SELECT source, lang, 'words-1' AS version, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM docs WHERE toxic <> 1
  UNION ALL
  SELECT source, lang, 'letters-2', len(regexp_extract_all(
    CASE WHEN quality = 0 THEN (
      SELECT coalesce(string_agg(line, chr(10)), '') FROM (SELECT DISTINCT unnest(string_split(coalesce(text, ''), chr(10))) AS line)) ELSE coalesce(text, '') END,
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) FROM docs WHERE toxic <> 1)
SELECT source, lang, version, count(*) AS docs, sum(n)::BIGINT AS tokens FROM counted GROUP BY ALL
"""

_TOP_K = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)))),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

_FIM = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (
  SELECT *, len(units)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(units) + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (len(units) + 1) AS c2,
    CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 50 THEN 'plain'
      WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (
  SELECT *, array_to_string(units[:least(c1, c2)], '') AS p, array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
    array_to_string(units[greatest(c1, c2) + 1:], '') AS s FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""

_FILTER_AUDIT = r"""
WITH known AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
masks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
     regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails
  FROM docs LEFT JOIN known USING (doc_id)),
cells AS (SELECT part, good, toxic, fails, count(*) AS n FROM masks GROUP BY ALL),
letters(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (
  SELECT filter_order, step::INTEGER AS step, substr(filter_order, step, 1) AS letter,
    list_transform(range(1, step), lambda i: ascii(substr(filter_order, i, 1)) - 64) AS earlier, ascii(substr(filter_order, step, 1)) - 64 AS me
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
met AS (
  SELECT part, filter_order, step, letter, n, good, toxic, fails[me] AS now, len(list_filter(earlier, lambda i: fails[i])) > 0 AS gone,
    len(list_filter(fails, lambda f: f)) AS failing FROM cells, steps),
summed AS (
  SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT now AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (now AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (now AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (now AND failing = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (now AND NOT gone AND good = 1), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (now AND NOT gone AND toxic = 1), 0)::BIGINT AS toxic_lost
  FROM met GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM summed
"""

_DECONTAMINATION = r"""
WITH items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 10) AS k FROM items WHERE len(w) > 0),
placed AS (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized),
phrases AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM placed),
docs AS (
  SELECT doc_id, row_number() OVER () AS r,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
windows AS (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM phrases)),
found AS (SELECT r, k, i, item_id FROM (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM windows) JOIN phrases USING (k, phrase)),
hits AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS place FROM (SELECT DISTINCT r, k, i FROM found)) GROUP BY r),
held AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM found WHERE item_id IS NOT NULL GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN held USING (r)
"""

ORACLE: dict[str, str] = {"op2_secrets": _SECRETS, "op9_token_counts": _TOKEN_COUNTS, "op10_topk": _TOP_K, "op11_fim": _FIM,
                          "op12_filter_audit": _FILTER_AUDIT, "op13_decontamination": _DECONTAMINATION}
