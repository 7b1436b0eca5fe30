"""Queries over the driver's tables, one for each operator, with their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat, licenses, mixing, ngram_join, packing, pivots, planes, quality, runs, secrets, urls, winnowing
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_randomness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op2_diagonal_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_digest(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op5_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sampled(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "copies", "taken")


def op6_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias(c)
    found = chat.preferences(chat.neighbour_pairs(table(spark, sf_dir, "conversations")))
    return found.select("pair_id", "n_prompt", "prompt", "chosen", "rejected", spans("chosen_mask"), spans("rejected_mask"))


def op7_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = planes.file_round_trip(table(spark, sf_dir, "documents"), tokenizer_path())
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op9_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(table(spark, sf_dir, "documents"))


def op10_pivot_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.deduplicate(table(spark, sf_dir, "embeddings"))


def op11_drake_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digest(table(spark, sf_dir, "embeddings"))


def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_randomness": op1_randomness,
        "op2_diagonal_voting": op2_diagonal_voting,
        "op3_packing": op3_packing,
        "op4_redirect_equivalence": op4_redirect_equivalence,
        "op5_systematic_mix": op5_systematic_mix,
        "op6_preferences": op6_preferences,
        "op7_bit_planes": op7_bit_planes,
        "op8_rule_ledger": op8_rule_ledger,
        "op9_minhash_join": op9_minhash_join,
        "op10_pivot_permutations": op10_pivot_permutations,
        "op11_drake_bounds": op11_drake_bounds,
        "op12_winnowing": op12_winnowing,
        "op13_periodic_runs": op13_periodic_runs,
    }


OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents
), g AS (
  SELECT *, len(words) AS n_words,
    [x FOR x IN lines IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS wordy,
    [list_aggregate(words[i:i+4], 'string_agg', ' ') FOR i IN range(1, len(words) - 3)] AS grams
  FROM w
), pos AS (
  SELECT doc_id, unnest(grams) AS gram, unnest(range(1, len(grams) + 1)) AS i FROM g
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM pos) WHERE n > 1
), cov AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM rep) GROUP BY doc_id
), m AS (
  SELECT g.doc_id, CAST(n_words AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(wordy) - len(list_distinct(wordy)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(wordy) AS BIGINT) AS n_lines,
    CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper,
    CAST(length(text) - length(regexp_replace(text, '[a-z]', '', 'g')) AS BIGINT) AS n_lower,
    CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS n_shouts
  FROM g LEFT JOIN cov ON g.doc_id = cov.doc_id
), r AS (
  SELECT *,
    CAST(n_words < 10 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 20 * n_words AS BIGINT) + 4 * CAST(10 * n_symbols > n_words AS BIGINT)
    + 8 * CAST(100 * n_dup_lines > 40 * n_lines AS BIGINT) + 16 * CAST(word_chars < 2 * n_words AS BIGINT) + 32 * CAST(word_chars > 15 * n_words AS BIGINT)
    + 64 * CAST(2 * n_upper > n_upper + n_lower AND n_upper >= 20 AS BIGINT) + 128 * CAST(5 * n_shouts > n_words AS BIGINT) AS failed
  FROM m
)
SELECT *, failed & 3 <> 0 AS base_failed, failed = 0 AS kept FROM r
"""


#: The rules of op4 in SQL; pages carry no redirects or canonical links, without which aliases decide nothing.
OP4_SQL = r"""
WITH rules(verdict, host, start, rule) AS (
  VALUES ('allow', 'org', '/', 'org/'), ('block', 'example.org', '/es/', 'example.org/es/'), ('block', 'example.org', '/en/1', 'example.org/en/1'),
         ('allow', 'com', '/fr/', 'com/fr/'), ('block', 'com', '/de/', 'com/de/')
), p AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') ELSE '' END AS path
  FROM pages
), m AS (
  SELECT p.page_id, p.host, p.path, r.rule, r.verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC NULLS LAST) AS k
  FROM p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.start)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict, false AS by_alias FROM m WHERE k = 1
"""

OP6_SQL = r"""
WITH t AS (
  SELECT conv_id >> 1 AS pair_id, conv_id % 2 AS side, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), both_sides AS (
  SELECT pair_id FROM t GROUP BY pair_id HAVING count(DISTINCT side) = 2
), differ AS (
  SELECT pair_id, min(i) AS i FROM (
    SELECT pair_id, i FROM t GROUP BY pair_id, i HAVING count(*) < 2 OR count(DISTINCT (role, text)) > 1
  ) GROUP BY pair_id
), n AS (
  SELECT b.pair_id, coalesce(d.i - 1, (SELECT max(i) FROM t WHERE t.pair_id = b.pair_id)) AS n_prompt FROM both_sides b LEFT JOIN differ d ON b.pair_id = d.pair_id
), r AS (
  SELECT t.pair_id, side, i, role, n_prompt, '<|' || role || '|>' || chr(10) AS head, text || '<|end|>' || chr(10) AS body FROM t JOIN n ON t.pair_id = n.pair_id
), s AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY pair_id, side, i > n_prompt ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r
)
SELECT pair_id, CAST(any_value(n_prompt) AS BIGINT) AS n_prompt,
  coalesce(string_agg(head || body, '' ORDER BY i) FILTER (side = 0 AND i <= n_prompt), '') AS prompt,
  coalesce(string_agg(head || body, '' ORDER BY i) FILTER (side = 0 AND i > n_prompt), '') AS chosen,
  coalesce(string_agg(head || body, '' ORDER BY i) FILTER (side = 1 AND i > n_prompt), '') AS rejected,
  coalesce(string_agg((before + length(head)) || ':' || (before + length(head) + length(body)), ',' ORDER BY i) FILTER (side = 0 AND i > n_prompt AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg((before + length(head)) || ':' || (before + length(head) + length(body)), ',' ORDER BY i) FILTER (side = 1 AND i > n_prompt AND role = 'assistant'), '') AS rejected_mask
FROM s GROUP BY pair_id
"""


#: All pairs and the closure of their links: for small tables, on which the operators' recall is whole.
OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE [array_to_string(words[i:i+4], ' ') FOR i IN range(1, len(words) - 3)] END) AS gram
  FROM w WHERE len(words) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.8 * (x.n + y.n - k)
), reach(node, root) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.root
), c AS (
  SELECT node, min(root) AS class_id FROM reach GROUP BY node
)
SELECT d.doc_id, (SELECT count(*) FROM links l WHERE l.a = d.doc_id) AS n_links, c.class_id, d.doc_id = c.class_id AS kept FROM documents d JOIN c ON c.node = d.doc_id
"""

OP10_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), u AS (
  SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(node, root) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.root
), c AS (
  SELECT node, min(root) AS component_id FROM reach GROUP BY node
)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM embeddings e JOIN c ON c.node = e.vec_id
"""


def _op11_sql(clusters: int = 8, rounds: int = 10) -> str:
    """Every round as tables of its own: all distances, the nearest, the floors of the means."""
    parts = [
        """v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, list_transform(e, lambda x: CAST(floor(1024 * x) AS BIGINT)) AS e
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL)
  WHERE len(e) = 64 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h, r) - 1 AS k, e FROM (SELECT r, e, sha256('3:' || vec_id) AS h FROM v ORDER BY h, r LIMIT {clusters}))",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT r, min(d)[2] AS k, min(d)[1] AS d FROM (
    SELECT v.r, [list_sum([(v.e[j] - c.e[j]) * (v.e[j] - c.e[j]) FOR j IN range(1, 65)])::BIGINT, c.k] AS d FROM v, c{i} c
  ) GROUP BY r
)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN (
    SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS e FROM (
      SELECT k, j, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM (SELECT a.k, unnest(range(1, 65)) AS j, unnest(v.e) AS x FROM v JOIN a{i} a ON a.r = v.r) GROUP BY k, j
    ) GROUP BY k
  ) m ON m.k = c.k
)""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT v.vec_id, CAST(a.k AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM v JOIN a{rounds} a ON a.r = v.r JOIN c{rounds} c ON c.k = a.k
"""


OP11_SQL = _op11_sql()


OP12_SQL = r"""
WITH i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS size, unnest([array_to_string(words[k:k + least(10, len(words)) - 1], ' ') FOR k IN range(1, greatest(2, len(words) - 8))]) AS w FROM i WHERE len(words) > 0
), d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), p AS (
  SELECT r, s.size, unnest(range(1, len(words) - s.size + 2)) AS k, unnest([array_to_string(words[k:k + s.size - 1], ' ') FOR k IN range(1, len(words) - s.size + 2)]) AS w
  FROM d, (SELECT DISTINCT size FROM windows) s WHERE len(words) >= s.size
), m AS (
  SELECT p.r, p.k, p.size, windows.item_id FROM p JOIN windows ON p.w = windows.w AND p.size = windows.size
), h AS (
  SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(k, k + size)) AS j FROM m) GROUP BY r
), n AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.r = d.r LEFT JOIN n ON n.r = d.r
"""


#: Runs as stretches of equal 6-word windows a period apart, all pairs of them: for small tables.
OP13_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), h AS (
  SELECT w.*, len(words) AS n, CASE WHEN doc_id IS NULL THEN 1 ELSE xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) END AS h FROM w, crc
), g AS (
  SELECT *, h // 10 AS g FROM h
), a AS (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM g
), p AS (
  SELECT r, doc_id, n, CASE WHEN a IS NULL THEN words ELSE [words[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1] FOR i IN range(0, n)] END AS words FROM a
), k AS (
  SELECT r, unnest(range(0, n - 5)) AS i, unnest([hash(words[j + 1:j + 6]) FOR j IN range(0, n - 5)]) AS gram FROM p WHERE n >= 12
), e AS (
  SELECT x.r, x.i, y.i - x.i AS q FROM k x JOIN k y ON x.r = y.r AND x.gram = y.gram AND x.i < y.i
), s AS (
  SELECT r, q, min(i) AS s, max(i) + 6 + q AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM e) GROUP BY r, q, island
), u AS (
  SELECT r, s, e, min(q) AS q FROM s WHERE e - s >= 2 * q GROUP BY r, s, e HAVING e - s >= greatest(12, 2 * min(q))
), b AS (
  SELECT r, count(*) AS n_runs, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS lines, min([s - e, s, q]) AS best FROM u GROUP BY r
), gone AS (
  SELECT DISTINCT r, unnest(range(s + q, e)) AS i FROM u
), gone_lists AS (
  SELECT r, list(i) AS gone FROM gone GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best[2] AS start, -best[1] AS length, best[3] AS period, 1000 * -best[1] // best[3] AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(coalesce((SELECT string_agg(x, ' ' ORDER BY i) FROM (SELECT unnest(p.words) AS x, unnest(range(0, p.n)) AS i) WHERE gone IS NULL OR NOT list_contains(gone, i)), '')) AS collapsed_sha256
FROM p LEFT JOIN b ON b.r = p.r LEFT JOIN gone_lists ON gone_lists.r = p.r
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_redirect_equivalence": OP4_SQL,
        "op6_preferences": OP6_SQL,
        "op8_rule_ledger": OP8_SQL,
        "op9_minhash_join": OP9_SQL,
        "op10_pivot_permutations": OP10_SQL,
        "op11_drake_bounds": OP11_SQL,
        "op12_winnowing": OP12_SQL,
        "op13_periodic_runs": OP13_SQL,
    }
