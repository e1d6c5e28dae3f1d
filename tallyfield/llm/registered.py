"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm import (
    alignment, ann, chat, decontaminate, line_dedup, mixing, near_dedup, negatives, pii, quality, records,
    sharding, toxicity,
)
from tallyfield.llm.common import table
from tallyfield.session import scratch_path


SHARD_BYTES = 1024 * 1024


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    counts = [f"n_{kind}" for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_found")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, share=(85, 100))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, index = scratch_path(spark, "records"), scratch_path(spark, "records-index")
    records.write_records(table(spark, sf_dir, "documents"), path)
    records.write_index(spark, path, index)
    found = records.read_records(spark, path, index, shuffle_seed=5)
    tokens = F.octet_length("ids") / 4
    return found.select(
        "doc_id", "start", tokens.cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARD_BYTES)
    return placed.select("doc_id", "shard", "depth", "piece", "n_bytes", "shard_bytes")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = f"{chat.END}{chat.BEGIN}assistant ok"
    more = spark.createDataFrame([(-1, i, role, control) for i, role in enumerate(("user", "assistant"))], turns.schema)
    return chat.digests(chat.format_conversations(turns.unionByName(more)))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.select("vec_id", "embedding", noisy.alias("label")), F.col("vec_id") % 50 == 0)


QUERIES = {
    "op1_pii": op1_pii,
    "op2_toxicity": op2_toxicity,
    "op3_near_dedup": op3_near_dedup,
    "op4_ann": op4_ann,
    "op5_records": op5_records,
    "op6_line_dedup": op6_line_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_sharding": op8_sharding,
    "op9_mixing": op9_mixing,
    "op10_quality": op10_quality,
    "op11_alignment": op11_alignment,
    "op12_chat": op12_chat,
    "op13_negatives": op13_negatives,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+')"


def _shingles_sql(table_name: str, key: str, width: int) -> str:
    """Distinct (key, shingle) of a table; fewer words than ``width`` are one shingle."""
    return f"""
  SELECT DISTINCT {key}, array_to_string(w[i:least(i + {width} - 1, len(w))], ' ') AS s
  FROM (SELECT {key}, w, unnest(range(1, greatest(1, len(w) - {width} + 1) + 1)) AS i
        FROM (SELECT {key}, {_WORDS} AS w FROM {table_name}) WHERE len(w) > 0)"""


OP3_SQL = f"""
WITH RECURSIVE sets AS MATERIALIZED ({_shingles_sql("documents", "doc_id", 3)}
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), rare AS (
  SELECT s, count(*) AS c FROM sets GROUP BY s
), ranked AS (
  -- Sets this similar share one of their rarest shingles.
  SELECT doc_id, s, n, row_number() OVER (PARTITION BY doc_id ORDER BY c, s) AS r
  FROM sets JOIN rare USING (s) JOIN sizes USING (doc_id)
), firsts AS (SELECT * FROM ranked WHERE r <= n - ceil(0.85 * n) + 1
), pairs AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb
  FROM firsts a JOIN firsts b ON a.s = b.s AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
), links AS MATERIALIZED (
  SELECT a, b FROM pairs p JOIN sets x ON x.doc_id = p.a JOIN sets y ON y.doc_id = p.b AND y.s = x.s
  GROUP BY a, b, na, nb HAVING 100 * count(*) >= 85 * (na + nb - count(*))
), both_ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT a AS doc_id, a AS c FROM both_ways
  UNION
  SELECT b, c FROM reach JOIN both_ways ON a = doc_id
), component AS (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id,
       coalesce(c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN component USING (doc_id)
"""

OP7_SQL = f"""
WITH docs AS ({_shingles_sql("documents", "doc_id", 5)}
), items AS ({_shingles_sql("benchmark", "item_id", 5)}
), sizes AS (SELECT item_id, count(*) AS n FROM items GROUP BY item_id)
SELECT doc_id, item_id, count(*)::BIGINT AS n_shared, n::BIGINT AS n_shingles
FROM docs JOIN items USING (s) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 80 * n
"""

OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, n, pos, line,
         translate(trim(line, E' \t\n\x0B\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, len(parts) AS n, unnest(range(1, len(parts) + 1)) AS pos, unnest(parts) AS line
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), owners AS (
  SELECT key, min(doc_id) AS owner FROM lines WHERE length(key) >= 10 GROUP BY key
), marked AS (
  SELECT l.*, coalesce(o.owner < l.doc_id, false) AS gone FROM lines l LEFT JOIN owners o USING (key)
)
SELECT doc_id, any_value(n)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op8_sql(limit: int = SHARD_BYTES) -> str:
    return f"""
WITH rows_ AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(0) || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents
), nodes AS (
  SELECT d, h >> (60 - d)::INT AS p, sum(n_bytes)::BIGINT AS bytes, min(h) = max(h) AS same
  FROM rows_, range(0, 61) AS r(d) GROUP BY ALL
), final AS (SELECT * FROM nodes WHERE bytes <= {limit} OR same),
depths AS (
  SELECT doc_id, n_bytes, h, min(d) AS d FROM rows_ JOIN final ON h >> (60 - d)::INT = p GROUP BY ALL
)
SELECT doc_id, substr(lpad(bin(h), 60, '0'), 1, x.d::INT) AS shard, x.d::INTEGER AS depth, 0::BIGINT AS piece,
       n_bytes, bytes AS shard_bytes
FROM depths x JOIN final f ON f.d = x.d AND f.p = x.h >> (60 - x.d)::INT
"""


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS place
  FROM documents
), per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no, 3.0::DOUBLE * source_size AS most,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
         sum(source_size) OVER ()::DOUBLE AS total
  FROM per_source
), levels AS (
  SELECT *, (total - coalesce(sum(most) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM numbered WINDOW before AS (ORDER BY most / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), shared AS (
  SELECT source, source_size, no, total,
         least(most, w * coalesce(max(CASE WHEN level * w <= most THEN level END) OVER (), 'inf'::DOUBLE)) AS target
  FROM levels
), shares AS (
  SELECT *, sum(target) OVER (ORDER BY no) AS until FROM shared
), plan AS (
  SELECT greatest(1, total::BIGINT // 65536) AS block, total FROM shares LIMIT 1
), plan2 AS (
  SELECT *, (2 * total::BIGINT + block) // (2 * block) AS n FROM plan
), plan3 AS (
  SELECT *, CASE WHEN n <= 1 THEN 0 ELSE length(bin(n - 1)) END AS bits FROM plan2
), points AS (
  SELECT i, list_sum([((i >> b::INT) & 1) << (bits - 1 - b)::INT for b in range(0, bits)])::DOUBLE
            * total / (1::BIGINT << bits::INT)::DOUBLE AS place
  FROM (SELECT unnest(range(0, n)) AS i, bits, total FROM plan3)
), per_slots AS (
  SELECT s.no, count(*) AS slots FROM points p ASOF JOIN (SELECT no, until - target AS lo FROM shares WHERE target > 0) s
  ON p.place >= s.lo GROUP BY s.no
), used AS (
  SELECT s.*, least(coalesce(slots, 0), 3 * ceil(source_size / block)::BIGINT) AS slots, block,
         ceil(source_size / block)::BIGINT AS blocks
  FROM shares s LEFT JOIN per_slots USING (no), plan
), placed AS (
  SELECT doc_id, d.size, u.source_size, target, slots, block, blocks,
         (sum(d.size) OVER (PARTITION BY u.no ORDER BY place, doc_id, d.size
          ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS lo
  FROM sized d JOIN used u ON d.source IS NOT DISTINCT FROM u.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN blocks = 0 THEN 0 ELSE
       (slots // blocks) * size + greatest(0, least(lo + size, (slots % blocks) * block) - lo) END::BIGINT AS taken
FROM placed
"""

OP12_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'),
                                  (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'))
), written AS (
  SELECT *, '<|im_start|>' || replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<', '\l') || chr(10)
            || regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') || '<|im_end|>' || chr(10) AS formatted
  FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(formatted))::BIGINT AS formatted_chars
FROM written GROUP BY conv_id
"""

OP13_SQL = """
WITH rows_ AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) for x in embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS MATERIALIZED (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, a.label = b.label AS same, b.r, b.vec_id,
         list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows_ a JOIN rows_ b ON a.vec_id % 50 = 0 AND a.r <> b.r
), near AS (
  SELECT anchor, anchor_id, r AS positive, vec_id AS positive_id, score AS positive_score
  FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, r) <= 5
)
SELECT n.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, s.vec_id AS negative_id, positive_score,
       s.score AS negative_score
FROM near n JOIN scored s ON s.anchor = n.anchor AND NOT s.same
     AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY n.anchor, n.positive ORDER BY s.score DESC, s.vec_id, s.r)
QUALIFY rank <= 3
"""

SQL = {
    "op3_near_dedup": OP3_SQL,
    "op6_line_dedup": OP6_SQL,
    "op7_decontaminate": OP7_SQL,
    "op8_sharding": op8_sql(),
    "op9_mixing": OP9_SQL,
    "op12_chat": OP12_SQL,
    "op13_negatives": OP13_SQL,
}
