"""DuckDB SQL oracles for the registered queries.

Each entry is plain SQL over the driver tables (``documents``,
``conversations``, ``part``, ``embeddings``, ...) that computes the same
result as the Spark query of the same name, with the same column names and
types. The helpers below write each rule once; the fixture views are inlined
as CTEs so each statement stands alone.
"""

from __future__ import annotations

from nearfield.functions.text import DEFAULT_MAX_REVIEW_WORDS, PART_SEPARATOR, TIER_LABELS, WS_CLASS, WS_CODE_POINTS

WS_SQL = "(" + "||".join(f"chr({c})" for c in WS_CODE_POINTS) + ")"
WS_RUN_SQL = "'" + WS_CLASS + "+'"


def strip(x: str) -> str:
    return f"trim({x}, {WS_SQL})"


def present(x: str) -> str:
    return f"coalesce(length({strip(x)}) > 0, false)"


def words(x: str) -> str:
    return f"regexp_split_to_array({strip(x)}, {WS_RUN_SQL})"


def word_count(x: str) -> str:
    return f"CAST(CASE WHEN {strip(x)} = '' THEN 0 ELSE len({words(x)}) END AS INTEGER)"


def truncate(x: str, n: int) -> str:
    return f"(CASE WHEN {word_count(x)} <= {n} THEN {x} ELSE array_to_string({words(x)}[1:{n}], ' ') END)"


def tier(t: str, g: str, d: str, r: str) -> str:
    pt, pg, pd, pr = present(t), present(g), present(d), present(r)
    return (
        f"(CASE WHEN {pt} AND {pg} AND {pd} AND {pr} THEN 1 WHEN {pt} AND {pg} AND {pd} THEN 2 "
        f"WHEN {pt} AND {pg} THEN 3 ELSE 4 END)"
    )


def emb_input(t: str, g: str, d: str, r: str, tier_expr: str, n: int = DEFAULT_MAX_REVIEW_WORDS) -> str:
    return (
        f"(CASE WHEN {tier_expr} < 4 THEN concat_ws('{PART_SEPARATOR}', {strip(t)}, {strip(g)}, "
        f"CASE WHEN {tier_expr} <= 2 THEN {strip(d)} END, "
        f"CASE WHEN {tier_expr} = 1 THEN {truncate(strip(r), n)} END) END)"
    )


def coalesce_present(a: str, b: str) -> str:
    return f"coalesce(CASE WHEN {present(a)} THEN {a} END, CASE WHEN {present(b)} THEN {b} END)"


def label(x: str) -> str:
    whens = " ".join(f"WHEN {x} = {k} THEN '{v}'" for k, v in sorted(TIER_LABELS.items()))
    return f"(CASE {whens} ELSE '' END)"


def pct(part: str, whole: str) -> str:
    return f"round(CAST({part} AS DOUBLE) * CAST(100 AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0), 4)"


ITEMS_CTE = """items AS (
SELECT d.doc_id AS item_id,
  CASE WHEN d.doc_id % 10 IN (0,1) THEN NULL WHEN d.doc_id % 10 = 2 THEN '  '
       ELSE split_part(d.text, chr(10), 1) END AS title,
  CASE WHEN d.doc_id % 7 = 0 THEN NULL WHEN d.doc_id % 7 = 1 THEN ''
       ELSE concat(d.lang, '|', d.source) END AS genres,
  CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE d.text END AS description,
  r.text AS review_text
FROM documents d
LEFT JOIN (SELECT conv_id, max(text) AS text FROM conversations
           WHERE role = 'user' GROUP BY conv_id) r ON r.conv_id = d.doc_id)"""

RESPONSES_CTE = """responses AS (
SELECT p_partkey AS item_id,
  CASE WHEN p_partkey % 13 = 0 THEN 'not json'
       WHEN p_partkey % 4 = 0 THEN '{"results":[]}'
       ELSE concat('{"results":[{"title":"', p_name, '","overview":"', p_brand, ' ', p_type,
                   '","genre_ids":[', p_size, ',', p_partkey % 20, ']},{"title":"second"}]}') END AS body
FROM part)"""

TIERED_CTE = f"""tiered AS (
SELECT *, {tier('title', 'genres', 'description', 'review_text')} AS initial_tier FROM items)"""

TOP_CTE = """top AS (
SELECT item_id, CASE WHEN json_valid(body) THEN json_extract(body, '$.results[0]') END AS t FROM responses)"""

FOUND_CTE = """found AS (
SELECT item_id,
  coalesce(json_extract_string(t, '$.title'), '') AS e_title,
  coalesce(json_extract_string(t, '$.overview'), '') AS e_description,
  coalesce(array_to_string(list_transform(CAST(json_extract(t, '$.genre_ids') AS BIGINT[]),
                                          lambda x: CAST(x AS VARCHAR)), '|'), '') AS e_genres
FROM top WHERE t IS NOT NULL)"""

BEST_CTE = """best AS (
SELECT item_id, s.e_title, s.e_description, s.e_genres
FROM (SELECT item_id, min({'e_title': e_title, 'e_description': e_description, 'e_genres': e_genres}) AS s
      FROM found GROUP BY item_id))"""

MERGED_CTE = f"""merged AS (
SELECT i.item_id,
  {coalesce_present('i.title', 'b.e_title')} AS title_final,
  {coalesce_present('i.genres', 'b.e_genres')} AS genres_final,
  {coalesce_present('i.description', 'b.e_description')} AS description_final,
  i.review_text, i.initial_tier
FROM tiered i LEFT JOIN best b ON b.item_id = i.item_id AND i.initial_tier = 4)"""


def prepared_cte(n: int = DEFAULT_MAX_REVIEW_WORDS) -> str:
    t = tier("title_final", "genres_final", "description_final", "review_text")
    return f"""prepared AS (
SELECT *, {emb_input('title_final', 'genres_final', 'description_final', 'review_text', 'embedding_tier', n)}
  AS embedding_input
FROM (SELECT *, {t} AS embedding_tier FROM merged))"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


PREP_CTES = (ITEMS_CTE, RESPONSES_CTE, TIERED_CTE, TOP_CTE, FOUND_CTE, BEST_CTE, MERGED_CTE, prepared_cte())


def text_oracles() -> dict[str, str]:
    q: dict[str, str] = {}
    q["tier_distribution"] = with_ctes(ITEMS_CTE, TIERED_CTE) + f"""
SELECT initial_tier AS tier, {label('initial_tier')} AS label, count(*) AS n_items,
  {pct('count(*)', 'sum(count(*)) OVER ()')} AS pct
FROM tiered GROUP BY initial_tier ORDER BY tier"""
    q["presence_flags"] = with_ctes(ITEMS_CTE, TIERED_CTE) + f"""
SELECT item_id, {present('title')} AS title_present, {present('genres')} AS genres_present,
  {present('description')} AS description_present, {present('review_text')} AS review_present,
  initial_tier
FROM tiered"""
    q["truncate_words"] = with_ctes(ITEMS_CTE) + f"""
SELECT item_id, {word_count('review_text')} AS review_words, {truncate('review_text', 16)} AS review_16
FROM items"""
    q["embedding_input"] = with_ctes(ITEMS_CTE, TIERED_CTE) + f"""
SELECT item_id, initial_tier,
  {emb_input('title', 'genres', 'description', 'review_text', 'initial_tier')} AS embedding_input
FROM tiered"""
    q["embedding_input_cap16"] = with_ctes(ITEMS_CTE, TIERED_CTE) + f"""
SELECT item_id, initial_tier,
  {emb_input('title', 'genres', 'description', 'review_text', 'initial_tier', 16)} AS embedding_input
FROM tiered"""
    q["needs_enrichment"] = with_ctes(ITEMS_CTE, TIERED_CTE) + """
SELECT item_id, title, genres, description, review_text, initial_tier FROM tiered WHERE initial_tier = 4"""
    q["parse_top_result"] = with_ctes(RESPONSES_CTE, TOP_CTE, FOUND_CTE) + """
SELECT t.item_id, f.e_title, f.e_description, f.e_genres
FROM top t LEFT JOIN found f ON f.item_id = t.item_id"""
    q["enrich"] = with_ctes(ITEMS_CTE, RESPONSES_CTE, TIERED_CTE, TOP_CTE, FOUND_CTE, BEST_CTE) + """
SELECT i.item_id, b.e_title, b.e_description, b.e_genres
FROM tiered i LEFT JOIN best b ON b.item_id = i.item_id WHERE i.initial_tier = 4"""
    q["merge_enrichment"] = with_ctes(*PREP_CTES[:-1]) + "SELECT * FROM merged"
    q["prepare_items"] = with_ctes(*PREP_CTES) + "SELECT * FROM prepared"
    q["prepare_items_cap16"] = with_ctes(*PREP_CTES[:-1], prepared_cte(16)) + "SELECT * FROM prepared"
    q["tier_distribution_after"] = with_ctes(*PREP_CTES) + f"""
SELECT embedding_tier AS tier, {label('embedding_tier')} AS label, count(*) AS n_items,
  {pct('count(*)', 'sum(count(*)) OVER ()')} AS pct
FROM prepared GROUP BY embedding_tier ORDER BY tier"""
    q["field_coverage"] = with_ctes(*PREP_CTES) + f"""
SELECT count(*) AS n_items, {pct('count(title_final)', 'count(*)')} AS title_pct,
  {pct('count(genres_final)', 'count(*)')} AS genres_pct,
  {pct('count(description_final)', 'count(*)')} AS description_pct
FROM prepared"""
    q["gap_report"] = with_ctes(*PREP_CTES) + f"""
SELECT count(*) FILTER (WHERE embedding_input IS NULL) AS n_gaps, count(*) AS n_items,
  {pct('count(*) FILTER (WHERE embedding_input IS NULL)', 'count(*)')} AS gap_pct
FROM prepared"""
    q["need_report"] = with_ctes(ITEMS_CTE, TIERED_CTE) + f"""
SELECT count(*) FILTER (WHERE initial_tier = 4) AS n_tier4, count(*) AS n_items,
  {pct('count(*) FILTER (WHERE initial_tier = 4)', 'count(*)')} AS tier4_pct
FROM tiered"""
    return q


# ------------------------------------------------------------------ vectors
DIM = 64
K = 5
CELLS = 16
MANY_CELLS = 60
SEEDS = ("the", "der", "zzz-none")


def dist(a: str, b: str) -> str:
    """Squared L2 in double precision."""
    return (
        f"list_sum(list_transform(list_zip(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), "
        f"lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    )


VECS_CTE = "vecs AS (SELECT vec_id AS item_id, embedding FROM embeddings)"
CENTS_CTE = f"cents AS (SELECT CAST(vec_id AS INTEGER) AS cell_id, embedding AS centroid FROM embeddings WHERE vec_id < {CELLS})"


def ranked_cells_cte(name: str, vecs: str, cents: str) -> str:
    return f"""{name} AS (
SELECT item_id, cell_id, row_number() OVER (PARTITION BY item_id ORDER BY d, cell_id) AS rn
FROM (SELECT v.item_id, c.cell_id, {dist('v.embedding', 'c.centroid')} AS d FROM {vecs} v CROSS JOIN {cents} c))"""


def topk_select(cand: str, vecs: str, k: int = K, digits: int = 6) -> str:
    return f"""SELECT query_id, item_id, rank, round(d, {digits}) AS distance FROM (
  SELECT query_id, item_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, item_id) AS rank
  FROM (SELECT c.query_id, c.item_id, {dist('q.embedding', 'x.embedding')} AS d
        FROM {cand} c JOIN {vecs} q ON q.item_id = c.query_id JOIN {vecs} x ON x.item_id = c.item_id))
WHERE rank <= {k}"""


def ivf_sql(nprobe: int) -> str:
    return with_ctes(
        VECS_CTE,
        CENTS_CTE,
        ranked_cells_cte("ranked", "vecs", "cents"),
        f"""cand AS (SELECT p.item_id AS query_id, a.item_id FROM ranked p
  JOIN ranked a ON a.cell_id = p.cell_id AND a.rn = 1 WHERE p.rn <= {nprobe} AND a.item_id <> p.item_id)""",
    ) + topk_select("cand", "vecs")


EXACT_SQL = with_ctes(
    VECS_CTE,
    "cand AS (SELECT q.item_id AS query_id, x.item_id FROM vecs q CROSS JOIN vecs x WHERE q.item_id <> x.item_id)",
) + topk_select("cand", "vecs")

HV_CTES = PREP_CTES + (
    "emb AS (SELECT item_id, embedding_input FROM prepared WHERE embedding_input IS NOT NULL)",
    f"""toks AS (SELECT item_id, unnest(regexp_split_to_array(lower({strip('embedding_input')}), {WS_RUN_SQL})) AS tok
  FROM emb)""",
    "hashed AS (SELECT item_id, md5(tok) AS h FROM toks WHERE tok <> '')",
    f"""coded AS (SELECT item_id, CAST(('0x' || substr(h, 1, 8))::BIGINT % {DIM} AS INTEGER) AS bucket,
  CASE WHEN substr(h, 9, 1) < '8' THEN 1 ELSE -1 END AS s FROM hashed)""",
    "summed AS (SELECT item_id, bucket, sum(s) AS v FROM coded GROUP BY item_id, bucket)",
    f"grid AS (SELECT e.item_id, CAST(g.range AS INTEGER) AS bucket FROM emb e CROSS JOIN range(0, {DIM}) g)",
    """hv AS (SELECT grid.item_id, list(CAST(coalesce(summed.v, 0) AS FLOAT) ORDER BY grid.bucket) AS embedding
  FROM grid LEFT JOIN summed ON summed.item_id = grid.item_id AND summed.bucket = grid.bucket
  GROUP BY grid.item_id)""",
    f"""hcents AS (SELECT CAST(item_id AS INTEGER) AS cell_id, embedding AS centroid FROM hv
  ORDER BY item_id LIMIT {CELLS})""",
    ranked_cells_cte("hranked", "hv", "hcents"),
    "hassigned AS (SELECT item_id, cell_id FROM hranked WHERE rn = 1)",
)

SEEDS_VALUES = "seeds AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}')" for s in SEEDS) + ") v(seed))"
MATCHES_CTE = """matches AS (SELECT s.seed, p.item_id, p.title_final AS title FROM prepared p JOIN seeds s
  ON regexp_matches(p.title_final, s.seed, 'i') WHERE p.embedding_input IS NOT NULL)"""


def vector_oracles() -> dict[str, str]:
    q: dict[str, str] = {}
    q["validate_vectors"] = f"""
SELECT count(*) AS n_rows, count(*) FILTER (WHERE embedding IS NULL) AS n_null,
  CAST(min(len(embedding)) AS INTEGER) AS dim_min, CAST(max(len(embedding)) AS INTEGER) AS dim_max,
  count(*) FILTER (WHERE embedding IS NULL OR len(embedding) <> {DIM}
                   OR list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x)))) AS n_bad
FROM embeddings"""
    q["l2_distance"] = f"""
SELECT a.vec_id AS item_id, b.vec_id AS next_id, round({dist('a.embedding', 'b.embedding')}, 6) AS distance
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""
    q["hash_embed"] = with_ctes(*HV_CTES) + "SELECT item_id, embedding FROM hv"
    q["embed_python_encoder"] = q["hash_embed"]
    q["assign_cells"] = with_ctes(VECS_CTE, CENTS_CTE, ranked_cells_cte("ranked", "vecs", "cents")) + (
        "SELECT item_id, cell_id FROM ranked WHERE rn = 1"
    )
    q["knn_exact"] = EXACT_SQL
    q["knn_exact_tiled"] = EXACT_SQL
    q["knn_ivf_nprobe1"] = ivf_sql(1)
    q["knn_ivf_nprobe4"] = ivf_sql(4)
    q["knn_ivf_nprobe4_tiled"] = ivf_sql(4)
    q["knn_ivf_nprobe16"] = ivf_sql(16)
    q["recall_at_k"] = f"""
WITH ivf AS ({ivf_sql(1)}), exact AS ({EXACT_SQL})
SELECT count(DISTINCT e.query_id) AS n_queries, count(*) AS n_expected, count(i.item_id) AS n_found,
  round(CAST(count(i.item_id) AS DOUBLE) / CAST(count(*) AS DOUBLE), 6) AS recall
FROM exact e LEFT JOIN ivf i ON i.query_id = e.query_id AND i.item_id = e.item_id"""
    q["cell_sizes"] = with_ctes(VECS_CTE, CENTS_CTE, ranked_cells_cte("ranked", "vecs", "cents")) + (
        "SELECT cell_id, count(*) AS n_items FROM ranked WHERE rn = 1 GROUP BY cell_id"
    )
    q["index_integrity"] = with_ctes(VECS_CTE, CENTS_CTE, ranked_cells_cte("ranked", "vecs", "cents")) + """
SELECT n_indexed, n_embedded, n_missing, n_extra,
  (n_missing = 0 AND n_extra = 0 AND n_indexed = n_embedded) AS ok
FROM (SELECT CAST(coalesce(sum(a.n), 0) AS BIGINT) AS n_indexed, CAST(coalesce(sum(v.n), 0) AS BIGINT) AS n_embedded,
  CAST(coalesce(sum(v.n) FILTER (WHERE a.item_id IS NULL), 0) AS BIGINT) AS n_missing,
  CAST(coalesce(sum(a.n) FILTER (WHERE v.item_id IS NULL), 0) AS BIGINT) AS n_extra
FROM (SELECT item_id, count(*) AS n FROM ranked WHERE rn = 1 GROUP BY item_id) a
FULL OUTER JOIN (SELECT item_id, count(*) AS n FROM vecs GROUP BY item_id) v ON v.item_id = a.item_id) t"""
    q["search_titles"] = with_ctes(*PREP_CTES, SEEDS_VALUES, MATCHES_CTE) + "SELECT * FROM matches"
    q["build_hash_index"] = with_ctes(*HV_CTES) + "SELECT item_id, cell_id FROM hassigned"
    q["similar_items"] = with_ctes(
        *HV_CTES,
        SEEDS_VALUES,
        MATCHES_CTE,
        "firsts AS (SELECT seed, min(item_id) AS seed_item_id FROM matches GROUP BY seed)",
        """cand AS (SELECT DISTINCT f.seed_item_id AS query_id, a.item_id FROM firsts f
  JOIN hassigned p ON p.item_id = f.seed_item_id JOIN hassigned a ON a.cell_id = p.cell_id
  WHERE a.item_id <> f.seed_item_id)""",
        f"nbrs AS ({topk_select('cand', 'hv', K, 4)})",
    ) + f"""
SELECT f.seed, f.seed_item_id, st.title_final AS seed_title, n.rank, n.item_id,
  coalesce(nt.title_final, '(unknown)') AS title, n.distance
FROM firsts f LEFT JOIN prepared st ON st.item_id = f.seed_item_id
JOIN nbrs n ON n.query_id = f.seed_item_id
LEFT JOIN prepared nt ON nt.item_id = n.item_id"""
    # The same report over text keys: every key is 'B' and the number.
    text_keys = {
        "SELECT d.doc_id AS item_id": "SELECT 'B' || d.doc_id AS item_id",
        "SELECT p_partkey AS item_id": "SELECT 'B' || p_partkey AS item_id",
        "CAST(item_id AS INTEGER) AS cell_id": "CAST(substr(item_id, 2) AS INTEGER) AS cell_id",
        "SELECT vec_id AS item_id": "SELECT 'B' || vec_id AS item_id",
    }

    def with_text_keys(sql: str) -> str:
        for number, text in text_keys.items():
            sql = sql.replace(number, text)
        return sql

    q["similar_items_string_keys"] = with_text_keys(q["similar_items"])
    q["knn_exact_string_keys"] = with_text_keys(EXACT_SQL)
    q["assign_cells_fallback"] = q["assign_cells"]
    q["load_items"] = """
SELECT doc_id AS item_id, CASE WHEN doc_id % 3 <> 0 THEN doc_id END AS title, lang AS genres, text AS description,
  CAST(NULL AS VARCHAR) AS review_text
FROM documents"""
    q["load_responses_parquet"] = q["load_responses_json"] = with_ctes(RESPONSES_CTE) + "SELECT item_id, body FROM responses"
    q["embeddings_round_trip"] = with_ctes(VECS_CTE) + "SELECT item_id, embedding FROM vecs"
    # What holds for any trained index, and its exact search when every cell is probed.
    q["build_index_trained"] = """
SELECT count(*) AS n_rows, true AS cells_in_bound, CAST(0 AS BIGINT) AS n_not_nearest FROM embeddings"""
    q["knn_ivf_trained"] = EXACT_SQL
    q["build_index_two_level"] = q["build_index_trained"]
    q["knn_ivf_two_level"] = EXACT_SQL
    q["assign_cells_tree"] = q["assign_cells"].replace(f"vec_id < {CELLS}", f"vec_id < {MANY_CELLS}")
    q["knn_ivf_stored"] = q["knn_ivf_stored_pruned"] = q["knn_ivf_stored_pruned_tiled"] = ivf_sql(4)
    q["enrichment_round_trip"] = text_oracles()["enrich"]
    q["materialized_stage"] = text_oracles()["needs_enrichment"]
    q["build_job_resumed"] = q["build_hash_index"]
    q["first_matches_many"] = with_ctes(*PREP_CTES) + """
SELECT seed, min(item_id) AS seed_item_id FROM (
  SELECT item_id, unnest(list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)))) AS seed
  FROM (SELECT item_id, lower(title_final) AS t FROM prepared WHERE embedding_input IS NOT NULL))
WHERE regexp_full_match(seed, '[a-z]{3}') GROUP BY seed"""
    q["run_summary"] = with_ctes(*HV_CTES) + """
SELECT 'tier_' || CAST(embedding_tier AS VARCHAR) AS metric, CAST(count(*) AS DOUBLE) AS value
FROM prepared GROUP BY embedding_tier
UNION ALL SELECT 'items_total', CAST(count(*) AS DOUBLE) FROM prepared
UNION ALL SELECT 'items_embeddable', CAST(count(embedding_input) AS DOUBLE) FROM prepared
UNION ALL SELECT 'true_gaps', CAST(count(*) FILTER (WHERE embedding_input IS NULL) AS DOUBLE) FROM prepared
UNION ALL SELECT 'index_rows', CAST(count(*) AS DOUBLE) FROM hassigned
UNION ALL SELECT 'index_cells', CAST(count(DISTINCT cell_id) AS DOUBLE) FROM hassigned"""
    q["pending_embeddings"] = with_ctes(*PREP_CTES) + """
SELECT p.item_id, p.embedding_input FROM prepared p
WHERE p.embedding_input IS NOT NULL AND NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = p.item_id)"""
    q["pending_runs"] = q["pending_embeddings"]
    return q


def all_oracles() -> dict[str, str]:
    q = dict(text_oracles())
    q.update(vector_oracles())
    return q
