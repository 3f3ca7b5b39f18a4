"""The registered queries of the text operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from revspan.llm import (
    conversation_trie, decontaminate, embedding_dedup, exact_dedup, html_text, langid, line_dedup, mixing, ngram_join,
    periodic_runs, pii, sentencepiece_codec, toxicity,
)
from revspan.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MAX_PASSES = 2.0  # how often the mixture may repeat a source


def _model() -> bytes:
    return sentencepiece_codec.load_model(os.environ.get("SENTENCEPIECE_MODEL", MODEL_PATH))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet", exact_dedup.state_folder(spark))
    return found.withColumnRenamed("digest", "text_sha256").select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentencepiece_codec.encode(table(spark, sf_dir, "documents"), _model(), digests=True)
    return encoded.withColumnRenamed("ids", "ids_sha256")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.temperature_mix(table(spark, sf_dir, "documents"), max_passes=MAX_PASSES)
    return mixed.select("doc_id", "source", "n_tokens", "pass", "block", "weight", "before", "progress")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(line_dedup.line_dedup(table(spark, sf_dir, "documents")))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard(table(spark, sf_dir, "documents"))


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(decontaminate.benchmark_passages(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), planted=True))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (
        op1_pii, op2_toxicity, op3_html_text, op4_language_id, op5_exact_dedup, op6_sentencepiece, op7_mixing,
        op8_embedding_dedup, op9_line_dedup, op10_ngram_join, op11_decontaminate, op12_periodic_runs, op13_conversation_trie)
}

_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: crc32 by its rule: a table of 256 remainders, and a macro-like expression over the decimal digits of a number.
_CRC_TABLE = """
    SELECT list_transform(range(256), lambda x: list_reduce(
        [x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384))) AS remainders
"""
_CRC = """xor(4294967295, list_reduce(
        list_concat([4294967295], list_transform(string_split({}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda c, b: xor(c >> 8, remainders[(xor(c, b) & 255) + 1])))"""

ORACLES: dict[str, str] = {
    "op5_exact_dedup": f"""
        WITH normal AS (
            SELECT doc_id, {_LOWERED.format("coalesce(text, '')")} AS body FROM documents
        )
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(body) AS text_sha256
        FROM normal WINDOW same AS (PARTITION BY body)
    """,
    "op8_embedding_dedup": """
        WITH RECURSIVE usable AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(embedding) AS x) WHERE x IS NULL OR NOT isfinite(x))
              AND EXISTS (SELECT 1 FROM (SELECT unnest(embedding) AS x) WHERE x <> 0)
        ), pairs AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
            ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
            WHERE list_cosine_similarity(a.v, b.v) >= 0.98
        ), reached(a, b) AS (
            SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reached r JOIN pairs p ON r.b = p.a
        ), least AS (SELECT a, min(b) AS b FROM reached GROUP BY a),
        degree AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
        SELECT vec_id, coalesce(d.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(l.b, vec_id)) AS component_id,
               vec_id <= coalesce(l.b, vec_id) AS kept
        FROM embeddings LEFT JOIN least l ON l.a = vec_id LEFT JOIN degree d ON d.a = vec_id
    """,
    "op9_line_dedup": rf"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents
        ), keyed AS (
            SELECT *, {_LOWERED.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines
        ), often AS (
            SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
        ), marked AS (
            SELECT doc_id, line, pos, key IN (SELECT key FROM often) AS gone FROM keyed
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op11_decontaminate": rf"""
        WITH d AS (
            SELECT doc_id, row_number() OVER () AS rid,
                   regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), items AS (
            SELECT item_id, regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark
        ), strings AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
            FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0
        ), places AS (
            SELECT rid, i, size, array_to_string(w[i:i + size - 1], ' ') AS s
            FROM d, (SELECT DISTINCT size FROM strings), unnest(range(1, len(w) - size + 2)) AS t(i)
        ), hits AS (
            SELECT rid, i, size, item_id FROM places JOIN strings USING (size, s)
        ), hit_words AS (
            SELECT rid, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(size)) AS t(k) GROUP BY rid
        ), hit_items AS (
            SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY rid
        )
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)
    """,
    # Words q apart are equal over a stretch of a run of 16 places at least, so eight words in a row recur there.
    "op12_periodic_runs": rf"""
        WITH crc AS ({_CRC_TABLE}), words AS (
            SELECT doc_id, row_number() OVER () AS rid, {_CRC.format("doc_id")} AS h,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
            FROM documents, crc
        ), planned AS (
            SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS r
            FROM words
        ), planted AS (
            SELECT doc_id, rid, n, CASE WHEN a IS NULL THEN w ELSE w[1:a] || list_transform(
                range(n - a), lambda i: w[a + i % (1 + (n - a) // r) + 1]) END AS w
            FROM planned
        ), blocks AS (
            SELECT rid, n, i, array_to_string(w[i + 1:i + 8], ' ') AS s FROM planted, unnest(range(n - 7)) AS t(i)
        ), recurring AS (
            SELECT x.rid, x.i, y.i - x.i AS q FROM blocks x JOIN blocks y ON x.rid = y.rid AND x.s = y.s
            WHERE y.i > x.i AND 3 * (y.i - x.i) <= x.n
        ), stretches AS (
            SELECT rid, q, min(i) AS start, max(i) - min(i) + 8 + q AS length
            FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM recurring)
            GROUP BY rid, q, island
        ), runs AS (
            SELECT rid, start, length, min(q) AS period FROM stretches
            WHERE length >= greatest(24, 3 * q) GROUP BY rid, start, length
        ), listed AS (
            SELECT rid, count(*) AS n_runs,
                   string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs
            FROM runs GROUP BY rid
        ), best AS (
            SELECT rid, start, length, period FROM runs
            QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length / period DESC, start, period) = 1
        ), dropped AS (
            SELECT DISTINCT rid, i FROM runs, unnest(range(start + period, start + length)) AS t(i)
        ), kept AS (
            SELECT rid, string_agg(w[i + 1], ' ' ORDER BY i) AS text
            FROM (SELECT rid, w, i FROM planted, unnest(range(n)) AS t(i)) ANTI JOIN dropped USING (rid, i) GROUP BY rid
        )
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period,
               1000 * length // period AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256,
               sha256(coalesce(text, '')) AS collapsed_sha256
        FROM planted LEFT JOIN listed USING (rid) LEFT JOIN best USING (rid) LEFT JOIN kept USING (rid)
    """,
    "op13_conversation_trie": rf"""
        WITH crc AS ({_CRC_TABLE}), turns AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS place
            FROM conversations WHERE conv_id IS NOT NULL
        ), convs AS (
            SELECT conv_id, {_CRC.format("conv_id")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns), crc
        ), rebuilt AS (
            SELECT c.conv_id, 0 AS part, t.place, t.role, t.text
            FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.place < h
            UNION ALL
            SELECT conv_id, 1, place, role, text FROM turns JOIN convs USING (conv_id) WHERE place >= h
        ), sequences AS (
            SELECT conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY part, place) FILTER (role IS NOT NULL), []) AS s
            FROM convs LEFT JOIN rebuilt USING (conv_id) GROUP BY conv_id
        ), prefixes AS (
            SELECT conv_id, s[1:d] AS p, d, d = len(s) AS at_end FROM sequences, unnest(range(len(s) + 1)) AS t(d)
        ), nodes AS (
            SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(
                       string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (at_end), '')) AS ends_sha256,
                   CASE WHEN d > 0 THEN (count(*) - 1) * length(p[d].text) ELSE 0 END AS saved
            FROM prefixes GROUP BY p, d
        ), children AS (
            SELECT p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1
        ), above AS (
            SELECT n.p[1:k] AS p, n.saved, c.n_children IS NULL AS is_leaf
            FROM nodes n LEFT JOIN children c USING (p), unnest(range(n.d + 1)) AS t(k)
        ), subtrees AS (
            SELECT p, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (is_leaf) AS n_leaves FROM above GROUP BY p
        )
        SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
               n_leaves, saved_tokens, n.ends_sha256
        FROM nodes n JOIN subtrees USING (p) LEFT JOIN children USING (p)
        LEFT JOIN nodes up ON n.d > 0 AND up.d = n.d - 1 AND up.p = n.p[1:n.d - 1]
    """,
}
