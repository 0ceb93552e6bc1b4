"""The registered queries of this subpackage and their DuckDB SQL.

Each query applies one operator, with its production parameters, to its whole
table and derives the digest columns from what the operator returns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import shared_dir, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearfield.llm.packing import pack

    return pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearfield.llm.secret_scan import find_secrets

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s.kind != "novel")
    return find_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"), count("novel"),
    )


#: Fixed by the query's contract: host and path prefix, and the verdict.
URL_RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearfield.llm.url_filter import judge_urls

    rules = spark.createDataFrame(list(URL_RULES), "rule string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules, default="allow")


OP3_SQL = """
WITH parsed AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(rule, verdict) AS (
  VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')
), split AS (
  SELECT rule, verdict, split_part(rule, '/', 1) AS rule_host, substr(rule, strpos(rule, '/')) AS rule_path FROM rules
), urls AS (
  SELECT DISTINCT host, path FROM parsed
), best AS (
  SELECT u.host, u.path, arg_max(s.rule, length(s.rule)) AS rule, arg_max(s.verdict, length(s.rule)) AS verdict
  FROM urls u JOIN split s
    ON (u.host = s.rule_host OR ends_with(u.host, '.' || s.rule_host)) AND starts_with(u.path, s.rule_path)
  GROUP BY u.host, u.path
)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parsed p LEFT JOIN best b ON b.host = p.host AND b.path = p.path
"""


def op4_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearfield.llm.lattice_dedup import link_embeddings

    return link_embeddings(table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearfield.llm.toxicity import held_out, score_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", held_out().alias("held_out"), F.col("toxicity_score_").alias("score"), F.col("toxicity_predicted_").alias("predicted")
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearfield.llm.sharding import shard_by_size

    return shard_by_size(table(spark, sf_dir, "documents"), shards=24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearfield.llm.ngram_join import join_similar

    return join_similar(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "kept")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearfield.llm.langid import held_out, identify, learn

    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op9_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearfield.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


OP9_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (
  SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearfield.llm.bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents")).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearfield.llm.merkle import build, leaf_digest, proofs, verify

    others = ("doc_id", "source", "lang", "n_chars")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", leaf_digest(*others, "text").alias("leaf"),
                                                    F.when(tampered, leaf_digest(*others, lowered)).alias("shown"))
    manifest = build(rows, carry="shown")
    root = F.lit(None if manifest.root is None else manifest.root.hex())
    shown = proofs(manifest).withColumn("shown", F.coalesce("carried", "leaf"))
    folded = _hex("folded_root")
    return verify(shown, "shown").select(
        F.col("id").alias("doc_id"), _hex("leaf").alias("leaf"), _hex("subroot").alias("subroot"), root.cast("string").alias("root"),
        F.sha2(_hex("siblings").cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"), (folded == root).alias("verified"),
    )


def _hex(col):
    return F.lower(F.hex(col))


#: Levels that the statement below spells out for the documents of a language: up to 8 ** 7 of them.
SQL_LEVELS = 7


def _op11_sql() -> str:
    """The trees level by level: ``l0`` are the leaves, ``l1`` their parents and so on; then the same over the subroots."""

    def field(x: str) -> str:
        return f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(field(x) for x in ('doc_id', 'source', 'lang', 'n_chars', text))})"

    # of a byte list, the bits' steps in one fold: a byte is met by xor, each -1 shifts once
    steps = "flatten(list_transform(range(1, strlen(id) + 1), lambda i: [ascii(substr(id, i, 1)), -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = (f"xor(list_reduce(list_prepend(4294967295, {steps}), "
           "lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)")
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"""docs AS (SELECT doc_id, coalesce('=' || lang, '') AS part, {leaf('text')} AS leaf,
  CASE WHEN id IS NOT NULL AND {crc} % 3 = 0 THEN {leaf(lowered)} ELSE {leaf('text')} END AS shown
  FROM (SELECT *, CAST(doc_id AS VARCHAR) AS id FROM documents))""",
        """l0 AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf, shown) - 1 AS i,
  count(*) OVER (PARTITION BY part) AS n, leaf AS digest FROM docs)""",
    ]

    def climb(nodes: str, proofs: str, by: str, levels: int) -> tuple[str, str]:
        """Adds the levels above ``nodes`` and, in ``proofs``, each row's path; names of the last ones."""
        for k in range(levels):
            up, on = f"{nodes[0]}{k + 1}", f"{proofs[0]}{k + 1}"
            parts.append(f"""{up} AS (SELECT {by}, i // 8 AS i, (max(n) + 7) // 8 AS n,
  CASE WHEN max(n) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY i)) END AS digest
  FROM {nodes[0]}{k} GROUP BY {by}, i // 8)""")
            parts.append(f"""{on} AS (SELECT p.row_id, p.{by}, p.at // 8 AS at,
  p.siblings || coalesce(string_agg(s.digest, '' ORDER BY s.i) FILTER (WHERE s.i <> p.at), '') AS siblings,
  CASE WHEN max(s.n) = 1 THEN p.folded
       ELSE sha256(string_agg(CASE WHEN s.i = p.at THEN p.folded ELSE s.digest END, '' ORDER BY s.i)) END AS folded
  FROM {proofs[0]}{k} p JOIN {nodes[0]}{k} s ON s.{by} = p.{by} AND s.i // 8 = p.at // 8
  GROUP BY p.row_id, p.{by}, p.at, p.siblings, p.folded)""")
        return f"{nodes[0]}{levels}", f"{proofs[0]}{levels}"

    parts.append("""rows_ AS (SELECT *, row_number() OVER () AS row_id FROM l0)""")
    parts.append("p0 AS (SELECT row_id, part, i AS at, '' AS siblings, shown AS folded FROM rows_)")
    subroots, paths = climb("l", "p", "part", SQL_LEVELS)
    parts.append(f"""r0 AS (SELECT '' AS whole, part, digest, row_number() OVER (ORDER BY part) - 1 AS i, count(*) OVER () AS n FROM {subroots})""")
    parts.append(f"q0 AS (SELECT p.row_id, '' AS whole, r.i AS at, p.siblings, p.folded FROM {paths} p JOIN r0 r ON r.part = p.part)")
    root, whole = climb("r", "q", "whole", 4)
    return "WITH " + ",\n".join(parts) + f"""
SELECT d.doc_id, d.leaf, s.digest AS subroot, r.digest AS root, sha256(q.siblings) AS proof_sha256, q.folded AS folded_root,
  q.folded = r.digest AS verified
FROM rows_ d JOIN {whole} q ON q.row_id = d.row_id JOIN {subroots} s ON s.part = d.part JOIN {root} r ON true"""


OP11_SQL = _op11_sql()


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearfield.llm.filter_audit import audit, label_flags, later_copies, numbered, quality_conditions

    conditions = quality_conditions()
    rows = numbered(table(spark, sf_dir, "documents"), conditions, "source")
    failing = {name: rows.where(f"fails_{name}").select("row", "id") for name in conditions} | {"E": later_copies(rows)}
    return audit(rows, failing, label_flags(table(spark, sf_dir, "labels")))


OP12_SQL = """
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), firsts AS (
  SELECT text, min(doc_id) AS low FROM words GROUP BY text
), good AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id
), fails AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(words.text, '[^A-Z]', '', 'g')) > 5 * length(words.text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(words.text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN words.doc_id > low THEN 16 ELSE 0 END AS mask
  FROM words JOIN firsts ON firsts.text = words.text LEFT JOIN good ON good.doc_id = words.doc_id
), masks AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM fails GROUP BY part, mask
), letters(l, bit) AS (
  VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, (SELECT bit FROM letters WHERE l = substr(filter_order, step, 1)) AS own,
    list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, i, 1)) - 65))) AS set_before
  FROM orders, range(1, 6) r(step)
), laid AS (
  SELECT m.part, filter_order, step, own,
    sum(n) FILTER (WHERE mask & (CAST(coalesce(set_before, 0) AS BIGINT) | own) = 0) AS kept,
    sum(n) FILTER (WHERE mask & own <> 0 AND mask & CAST(coalesce(set_before, 0) AS BIGINT) = 0) AS removed,
    sum(n) FILTER (WHERE mask & own <> 0 AND mask & CAST(coalesce(set_before, 0) AS BIGINT) <> 0) AS redundant,
    sum(n) FILTER (WHERE mask = own) AS unique_fails,
    sum(good) FILTER (WHERE mask & own <> 0 AND mask & CAST(coalesce(set_before, 0) AS BIGINT) = 0) AS good_lost,
    sum(toxic) FILTER (WHERE mask & own <> 0 AND mask & CAST(coalesce(set_before, 0) AS BIGINT) = 0) AS toxic_lost
  FROM masks m CROSS JOIN steps GROUP BY m.part, filter_order, step, own
)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM laid
"""


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearfield.llm.warc import archive_and_read

    return archive_and_read(table(spark, sf_dir, "pages"), f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}", min_revisit_bytes=0)


#: The base32 digits are taken from the hex digest, five hex digits (20 bits) at a time.
OP13_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), tops AS (
  SELECT payload, max(page_id) AS top, sha1(payload) AS h FROM p GROUP BY payload
), marked AS (
  SELECT p.page_id, strlen(p.payload) AS payload_bytes, t.h, t.top,
    p.page_id IS NOT DISTINCT FROM t.top AND row_number() OVER (PARTITION BY p.page_id, p.payload) = 1 AS response
  FROM p JOIN tops t ON t.payload = p.payload
)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(h, CAST(i // 4 AS BIGINT) * 5 + 1, 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS BIGINT), 1)),
    'string_agg', '') AS payload_digest,
  CASE WHEN response THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN NOT response THEN top END AS refers_to
FROM marked
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_secrets": op2_secrets,
        "op3_urls": op3_urls,
        "op4_lattice": op4_lattice,
        "op5_toxicity": op5_toxicity,
        "op6_sharding": op6_sharding,
        "op7_ngram_join": op7_ngram_join,
        "op8_language": op8_language,
        "op9_exact": op9_exact,
        "op10_bpe": op10_bpe,
        "op11_merkle": op11_merkle,
        "op12_audit": op12_audit,
        "op13_warc": op13_warc,
        "pipeline": pipeline,
    }


def all_oracles() -> dict[str, str]:
    return {
        "op3_urls": OP3_SQL,
        "op9_exact": OP9_SQL,
        "op11_merkle": OP11_SQL,
        "op12_audit": OP12_SQL,
        "op13_warc": OP13_SQL,
    }
