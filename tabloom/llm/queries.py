"""The registered queries of this subpackage, with equivalent SQL where SQL can express them."""

from __future__ import annotations

from tabloom.llm.ann import op5_nearest_neighbours
from tabloom.llm.bpe import op13_bpe
from tabloom.llm.chat import OP6_SQL, op6_chat_format
from tabloom.llm.language import op10_language_id
from tabloom.llm.language_model import op2_lm_score
from tabloom.llm.line_dedup import op9_line_dedup
from tabloom.llm.mixing import op1_mix_sources
from tabloom.llm.near_duplicates import op4_minhash_near_dedup
from tabloom.llm.packing import op8_pack_sequences
from tabloom.llm.quality import op7_quality_classifier
from tabloom.llm.resampling import OP12_SQL, op12_importance_resampling
from tabloom.llm.topk import OP3_SQL, op3_exact_top_k
from tabloom.llm.whitening import op11_embedding_whitening

_WORDS = r"length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

_APPORTION = """
  {name}_q AS (
    SELECT *, count(*) OVER g AS n,
           CASE WHEN sum({weight}::DOUBLE) OVER g > 0 THEN seats * {weight} / sum({weight}::DOUBLE) OVER g ELSE 0.0 END AS q
    FROM {parts} WINDOW g AS (PARTITION BY {group})),
  {name}_b AS (
    SELECT *, least(floor(greatest(0.0, 1 - CASE WHEN seats > 0 THEN n / (2.0 * seats) ELSE 0 END - 1e-9) * q + 0.5)::BIGINT, most) AS low,
           least(floor((1 + CASE WHEN seats > 0 THEN n / (2.0 * seats) ELSE 0 END + 1e-9) * q + 0.5)::BIGINT, most) AS high
    FROM {name}_q),
  {name}_l AS (SELECT *, seats - sum(low) OVER (PARTITION BY {group}) AS rest FROM {name}_b),
  {name}_k AS (SELECT {group} AS grp, {key} AS key_, q, rest, unnest(range(low, high)) AS k FROM {name}_l WHERE high > low),
  {name}_r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY q / (2 * k + 1) DESC, key_, k) AS rk FROM {name}_k),
  {name}_m AS (SELECT grp, key_, count(*) AS more FROM {name}_r WHERE rk <= rest GROUP BY ALL),
  {name} AS (SELECT p.* EXCLUDE (n, q, low, high, rest), p.low + coalesce(m.more, 0) AS quota
             FROM {name}_l p LEFT JOIN {name}_m m ON m.grp = p.{group} AND m.key_ = p.{key})"""

OP1_SQL = f"""
WITH sized AS (SELECT doc_id, source, {_WORDS} AS size, md5(concat('17:', coalesce(doc_id::VARCHAR, ''))) AS order_key
               FROM documents),
  by_source AS (SELECT source, count(*) AS n_rows, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
  numbered AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS source_no FROM by_source),
  weighed AS (SELECT *, [3, 1, 2][(source_no - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM numbered),
  levelled AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source_no
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / sum(weight) OVER (ORDER BY cap / weight, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
               FROM weighed),
  opened AS (SELECT *, max(CASE WHEN cap / weight > level THEN level END) OVER () AS open_level FROM levelled),
  targets AS (SELECT source, source_no, source_size, 0 AS everything,
                     least(cap::DOUBLE, coalesce(open_level * weight, cap::DOUBLE)) AS target,
                     ceil(cap / 16)::BIGINT AS most, ceil(n_rows / 2048)::BIGINT AS shards FROM opened),
  seated AS (SELECT *, round(sum(target) OVER () / 16)::BIGINT AS seats FROM targets),
  {_APPORTION.format(name="sources", parts="seated", group="everything", key="source_no", weight="target").strip()},
  placed AS (SELECT d.*, s.source_no, s.source_size, s.target, s.quota AS source_quota,
                    ('0x' || substr(order_key, 1, 8))::BIGINT % s.shards AS shard
             FROM sized d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source),
  shard_sizes AS (SELECT source_no, shard, any_value(source_quota) AS seats, sum(size)::BIGINT AS shard_size,
                         ceil(sum(size) / 16)::BIGINT AS blocks, 2 * ceil(sum(size) / 16)::BIGINT AS most
                  FROM placed GROUP BY source_no, shard),
  {_APPORTION.format(name="shard_quota", parts="shard_sizes", group="source_no", key="shard", weight="shard_size").strip()},
  lines AS (SELECT p.*, q.shard_size, greatest(q.blocks, 1) AS blocks, q.quota,
                   ('0x' || substr(md5(concat_ws(':', '17', p.source_no, p.shard)), 1, 8))::BIGINT % greatest(q.blocks, 1) AS start,
                   sum(size) OVER (PARTITION BY p.source_no, p.shard ORDER BY order_key, doc_id, size
                                   ROWS UNBOUNDED PRECEDING) AS stop
            FROM placed p JOIN shard_quota q ON p.source_no = q.source_no AND p.shard = q.shard)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       ((quota // blocks) * size
        + greatest(0, least(stop, least((start + quota % blocks) * 16, shard_size)) - greatest(stop - size, least(start * 16, shard_size)))
        + greatest(0, least(stop, least(greatest(0, start + quota % blocks - blocks) * 16, shard_size)) - greatest(stop - size, 0))
       )::BIGINT AS taken
FROM lines"""

QUERIES = {
    "op1_mix_sources": (op1_mix_sources, OP1_SQL),
    "op2_lm_score": (op2_lm_score, None),
    "op3_exact_top_k": (op3_exact_top_k, OP3_SQL),
    "op4_minhash_near_dedup": (op4_minhash_near_dedup, None),
    "op5_nearest_neighbours": (op5_nearest_neighbours, None),
    "op6_chat_format": (op6_chat_format, OP6_SQL),
    "op7_quality_classifier": (op7_quality_classifier, None),
    "op8_pack_sequences": (op8_pack_sequences, None),
    "op9_line_dedup": (op9_line_dedup, None),
    "op10_language_id": (op10_language_id, None),
    "op11_embedding_whitening": (op11_embedding_whitening, None),
    "op12_importance_resampling": (op12_importance_resampling, OP12_SQL),
    "op13_bpe": (op13_bpe, None),
}
