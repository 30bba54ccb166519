"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytepair, decontamination, divergence, language, merkle, mixing, neighbours, personal, quality, repeats, sharding, simhash, tokens
from .common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.classify(docs, table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.withColumn("item_ids", F.array_join(F.col("item_ids").cast("array<string>"), ","))


def op3_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.self_search(table(spark, sf_dir, "embeddings"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the contract's counts are, like base_sha256, those of the base spans; what the method adds is in spans and n_added
    return personal.digest(personal.extract(table(spark, sf_dir, "documents").select("doc_id", "text")), "base")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.plan(docs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("copies")).cast("long").alias("taken"), F.col("copies").alias("shards"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytepair.digest(table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_decontamination": op2_decontamination,
    "op3_repeated_spans": op3_repeated_spans,
    "op4_sharding": op4_sharding,
    "op5_token_files": op5_token_files,
    "op6_language_id": op6_language_id,
    "op7_neighbours": op7_neighbours,
    "op8_personal_data": op8_personal_data,
    "op9_mixing": op9_mixing,
    "op10_simhash": op10_simhash,
    "op11_byte_pairs": op11_byte_pairs,
    "op12_divergence": op12_divergence,
    "op13_merkle": op13_merkle,
}
#: Exact containment of five-word shingles, exact divergences, and whole Merkle trees level by level. The others' methods are beyond SQL (fitted models, seeded draws, hashes and
#: encoders that DuckDB lacks); tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op2_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS t FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
n AS (SELECT DISTINCT least(5, len(t)) AS n FROM i WHERE len(t) > 0),
ds AS (SELECT DISTINCT doc_id, n, array_to_string(t[k:k + n - 1], ' ') AS s FROM (SELECT doc_id, t, n, unnest(range(1, len(t) - n + 2)) AS k FROM d, n)),
q AS (SELECT DISTINCT item_id, n, array_to_string(t[k:k + n - 1], ' ') AS s FROM (SELECT item_id, t, least(5, len(t)) AS n, unnest(range(1, len(t) - least(5, len(t)) + 2)) AS k FROM i WHERE len(t) > 0)),
size AS (SELECT item_id, count(*) AS total FROM q GROUP BY 1),
hit AS (SELECT doc_id, item_id, count(*) / total AS c FROM ds JOIN q USING (n, s) JOIN size USING (item_id) GROUP BY doc_id, item_id, total HAVING count(*) / total >= 0.8),
per AS (SELECT doc_id, count(*) AS n_items, string_agg(cast(item_id AS varchar), ',' ORDER BY item_id) AS item_ids, max(c) AS max_containment FROM hit GROUP BY 1)
SELECT doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(item_ids, '') AS item_ids, coalesce(max_containment, 0.0) AS max_containment
FROM documents LEFT JOIN per USING (doc_id)""",
    "op12_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT r, lang, source, unnest(t) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY 1),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, sum(n) AS total FROM f GROUP BY ALL),
p AS (SELECT f.lang, f.source, f.term, f.n, 1 + (1000000000::hugeint * (f.n + 2)) // (s.total + 2 * v.v) AS p, 1 + (1000000000::hugeint * (k.n + 2)) // (v.total + 2 * v.v) AS q
  FROM f JOIN s USING (lang, source) JOIN v USING (lang) JOIN kept k ON k.lang = f.lang AND k.term = f.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::bigint AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::bigint AS value FROM p WHERE n > 0 AND p > q)
SELECT *, cast(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS integer) AS rank FROM every
UNION ALL SELECT *, cast(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS integer) AS rank FROM terms QUALIFY rank <= 10""",
    "op13_merkle": r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, *, coalesce(strlen(cast(doc_id AS varchar)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(cast(n_chars AS varchar)) || ':' || n_chars, '-') AS head,
    xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id AS varchar), ''), lambda c: ascii(c)::bigint)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))) AS crc FROM documents),
l AS (SELECT r, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h,
  CASE WHEN crc % 5 = 0 THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS changed FROM d),
n AS (SELECT *, coalesce('s' || source, '') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM l),
t AS (SELECT tree, 0 AS level, i, h FROM n
  UNION ALL SELECT tree, level + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM t) WHERE c > 1 GROUP BY tree, level, i // 16),
sub AS (SELECT tree, arg_max(h, level) AS h, max(level) AS top, row_number() OVER (ORDER BY tree) - 1 AS i FROM t GROUP BY tree),
u AS (SELECT 0 AS level, i, h FROM sub
  UNION ALL SELECT level + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS c FROM u) WHERE c > 1 GROUP BY level, i // 16),
root AS (SELECT arg_max(h, level) AS root, max(level) AS top FROM u),
tp AS (SELECT a.tree, a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') || '|' || coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS p
  FROM t a JOIN t b ON a.tree = b.tree AND a.level = b.level AND a.i // 16 = b.i // 16 GROUP BY 1, 2, 3),
up AS (SELECT a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') || '|' || coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS p
  FROM u a JOIN u b ON a.level = b.level AND a.i // 16 = b.i // 16 GROUP BY 1, 2),
steps AS (SELECT n.r, tp.level AS k, tp.p FROM n JOIN sub USING (tree) JOIN tp ON tp.tree = n.tree AND tp.level < sub.top AND tp.i = n.i // (16 ** tp.level)::bigint
  UNION ALL SELECT n.r, 100 + up.level, up.p FROM n JOIN sub USING (tree), root, up WHERE up.level < root.top AND up.i = sub.i // (16 ** up.level)::bigint),
path AS (SELECT r, list(p ORDER BY k) AS p FROM steps GROUP BY 1),
out AS (SELECT n.doc_id, n.h AS leaf, sub.h AS subroot, root, sha256(replace(array_to_string(coalesce(path.p, []), ''), '|', '')) AS proof_sha256,
  list_reduce(list_prepend(coalesce(n.changed, n.h), coalesce(path.p, [])), lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root
  FROM n JOIN sub USING (tree) LEFT JOIN path USING (r), root)
SELECT *, folded_root = root AS verified FROM out""",
}
