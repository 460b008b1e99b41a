"""The registered queries of this subpackage and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, codes, decontam, fim, idfiles, lines, lm, packing, quality, simhash, substring, topk, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfiles.report(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(table(spark, sf_dir, "conversations"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.report(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(table(spark, sf_dir, "documents"))


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.report(table(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.report(table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_quality_rules, op2_substring_dedup, op3_token_files, op4_line_dedup, op5_chat_formatting, op6_warc, op7_lm_scoring, op8_decontamination, op9_simhash, op10_packing, op11_topk_search, op12_vector_codes, op13_fill_in_middle]
    return {f.__name__: f for f in found}


SPACES = r"[\x20\x09-\x0D]"

OP1 = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACES}+'), lambda x: x <> '') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '{SPACES}', '', 'g') <> '') AS l FROM documents),
k AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t)),
again AS (SELECT doc_id, i FROM k QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM again) GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{SPACES}', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines FROM t LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, ((n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (10 * n_symbols > 3 * n_words)::BIGINT + 8 * (2 * n_dup_lines > n_lines)::BIGINT
             + 16 * (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words))::BIGINT + 32 * (n_words > 1000000)::BIGINT)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 31) = 0 AS kept, fail_bits, n_lines, (fail_bits & 3) = 0 AS kept_base_1, (fail_bits & 23) = 0 AS kept_strict_1, (fail_bits & 31) = 0 AS kept_strict_2 FROM b
"""

OP2 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i+34], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
again AS (SELECT doc_id, i FROM k QUALIFY count(*) OVER (PARTITION BY k) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM again),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
s AS (SELECT x.doc_id, count(gone.p)::BIGINT AS n_removed, string_agg(CASE WHEN gone.p IS NULL THEN word END, ' ' ORDER BY x.p) AS kept FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.p = x.p GROUP BY x.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s ON s.doc_id = d.doc_id
"""

OP4 = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
c AS (SELECT k FROM k WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(c.k)::BIGINT AS n_dropped, sha256(coalesce(string_agg(CASE WHEN c.k IS NULL THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.k = c.k GROUP BY doc_id
"""

OP5 = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, false AS control, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations
           UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok', true, NULL UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok', true, NULL),
e AS (SELECT *, replace(replace(text, '&', '&amp;'), '<|', '&lt;|') AS esc, replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;') AS erole,
             coalesce(lag(role) OVER (PARTITION BY conv_id, control, alone ORDER BY turn NULLS FIRST, role, text) = role, false) AS joined FROM r)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       sum(length(esc) + CASE WHEN joined THEN length('<|im_part|>') ELSE length('<|im_start|>') + length(erole) + 1 + length('<|im_end|>') + 1 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id, control, alone
"""


OP6 = r"""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS n FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS keeper FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> keeper THEN keeper END AS refers_to FROM g
"""

OP8 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
s AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 11, 2))) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, array_to_string(w[i:i+12], ' ') AS k, least(len(w), 13) AS n FROM s),
lens AS (SELECT DISTINCT n FROM bw),
ds AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens),
hit AS (SELECT doc_id, i, ds.n, item_id FROM ds JOIN bw ON bw.n = ds.n AND bw.k = array_to_string(w[i:i+ds.n-1], ' ')),
cov AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id)::BIGINT AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hit GROUP BY doc_id),
o AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items, '') AS items FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id))
SELECT doc_id, n_words, n_hit, n_items, sha256(items) AS items_sha256, n_hit > 0 AND 20 * n_hit >= n_words AS contaminated FROM o
"""


USABLE = "vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0"

OP11 = f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {USABLE}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score FROM e q JOIN e c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""


def _op12() -> str:
    parts, entries, rounds = 16, 64, 2
    told = [
        f"e AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {USABLE})",
        f"p AS (SELECT vec_id, label, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS x FROM e, (SELECT unnest(range({parts})) AS part))",
        f"c0 AS (SELECT part, dense_rank() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM e ORDER BY vec_id LIMIT {entries}))",
    ]
    for r in range(rounds + 1):
        told.append(
            f"a{r} AS (SELECT vec_id, label, p.part, any_value(x) AS x, arg_min(entry, (far, entry)) AS entry, min(far) AS far FROM (SELECT p.*, entry, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS far FROM p JOIN c{r} c ON c.part = p.part) p GROUP BY ALL)".replace("GROUP BY ALL", "GROUP BY vec_id, label, p.part")
        )
        if r < rounds:
            told += [
                f"m{r} AS (SELECT part, entry, list(floor(s / n)::BIGINT ORDER BY i) AS c FROM (SELECT part, entry, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM p))) AS i) GROUP BY part, entry, i) GROUP BY part, entry)",
                f"c{r + 1} AS (SELECT part, entry, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (part, entry))",
            ]
    told += [
        f"o AS (SELECT vec_id, label, string_agg(lpad(lower(printf('%x', entry)), 2, '0'), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM a{rounds} GROUP BY vec_id, label)",
        f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})",
    ]
    return "WITH " + ",\n".join(told) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o, h"


OP13 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, least(a, b) AS x, greatest(a, b) AS y FROM k),
c AS (SELECT *, substring(t, 1, x) AS p, substring(t, x + 1, y - x) AS m, substring(t, y + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM c
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1, "op2_substring_dedup": OP2, "op6_warc": OP6, "op4_line_dedup": OP4, "op5_chat_formatting": OP5, "op8_decontamination": OP8, "op11_topk_search": OP11, "op12_vector_codes": _op12(), "op13_fill_in_middle": OP13}
