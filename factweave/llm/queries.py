"""The registered queries of this subpackage, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.common import words_of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The tools of the derived talk, and what their arguments must be.
TALK_TOOLS = {
    name: {
        "type": "object", "required": ["query", "limit"], "additionalProperties": False,
        "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}, "after": {"type": "object"}},
    }
    for name in ("search", "count", "translate")
}


def as_tool_talk(conversations: DataFrame) -> DataFrame:
    """Conversations whose assistants call tools, as the given tables hold no calls.

    Every assistant message gets a call ``c<turn>`` with its first four words
    and its number of words; from turn 3 on the call depends on the one of two
    turns before.  By a hash of conversation and turn, of twelve calls one has
    a limit that is no integer, one names an unlisted tool, one gets no result
    and one a result under another identifier.  Results are messages of role
    ``tool`` of the same turn.
    """
    chance = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(12))
    words = words_of(F.col("text"))
    limit = F.when(chance == 0, F.lit('"many"')).otherwise(F.size(words).cast("string"))
    after = F.when(F.col("turn") >= 3, F.concat(F.lit(',"after":{"$ref":"c'), F.col("turn") - 2, F.lit('"}'))).otherwise("")
    query = F.to_json(F.struct(F.array_join(F.slice(words, 1, 4), " ").alias("query")))
    arguments = F.concat(F.expr("substring(query_json, 1, length(query_json) - 1)"), F.lit(',"limit":'), limit, after, F.lit("}"))
    name = F.when(chance == 1, F.lit("unlisted")).otherwise(F.element_at(F.array(*map(F.lit, TALK_TOOLS)), (F.pmod(F.col("turn"), F.lit(3)) + 1).cast("int")))
    call = F.concat(F.lit('\n<tool_call>{"arguments":'), arguments, F.lit(',"id":"c'), F.col("turn"), F.lit('","name":"'), name, F.lit('"}</tool_call>'))
    asks = (F.col("role") == "assistant") & F.col("turn").isNotNull()
    talk = conversations.select("conv_id", "turn", "role", "text").withColumn("query_json", query)
    said = F.when(asks, F.concat(F.coalesce("text", F.lit("")), call)).otherwise(F.col("text"))
    answer = F.concat(F.lit('{"content":'), F.size(words).cast("string"), F.lit(',"tool_call_id":"'), F.when(chance == 3, "x").otherwise("c"), F.col("turn"), F.lit('"}'))
    messages = talk.select("conv_id", "turn", "role", said.alias("text"))
    return messages.union(talk.where(asks & (chance != 2)).select("conv_id", "turn", F.lit("tool"), answer))


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factweave.llm.tool_calls import format_messages

    return format_messages(as_tool_talk(_table(spark, sf_dir, "conversations")), TALK_TOOLS)


def op2_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factweave.llm.pii import find

    found, _ = find(_table(spark, sf_dir, "documents"))
    return found


def op3_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factweave.llm.weighted_sampling import fingerprints

    return fingerprints(_table(spark, sf_dir, "documents"))


def op4_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factweave.llm.warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages"))


def op5_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factweave.llm.decision_list import quality_report

    report, _ = quality_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return report.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op6_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factweave.llm.line_blocks import extract

    return extract(_table(spark, sf_dir, "pages"))


def op7_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factweave.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op8_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factweave.llm.water_filling import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_log_suffix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factweave.llm.suffix_dedup import repeated_spans

    return repeated_spans(_table(spark, sf_dir, "documents")).drop("removed")


def op10_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factweave.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op11_crc_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factweave.llm.crc_ring import importance_draw

    return importance_draw(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op12_variable_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factweave.llm.block_max import build_index, search

    return search(build_index(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))


def op13_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factweave.llm.string_kernel import identify

    return identify(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_tool_calls": op1_tool_calls,
    "op2_weak_supervision": op2_weak_supervision,
    "op3_weighted_sampling": op3_weighted_sampling,
    "op4_revisit_resolution": op4_revisit_resolution,
    "op5_decision_list": op5_decision_list,
    "op6_line_blocks": op6_line_blocks,
    "op7_residual_packing": op7_residual_packing,
    "op8_water_filling": op8_water_filling,
    "op9_log_suffix_index": op9_log_suffix_index,
    "op10_tensored_minhash": op10_tensored_minhash,
    "op11_crc_ring": op11_crc_ring,
    "op12_variable_blocks": op12_variable_blocks,
    "op13_string_kernel": op13_string_kernel,
}

ORACLE_SQL = {
    "op8_water_filling": r"""
WITH sizes AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('8:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw
  FROM documents
), per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn
  FROM sizes GROUP BY source
), capped AS (
  SELECT source, source_size, source_size * 2 AS cap,
         CASE turn WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM per_source
), ordered AS (
  SELECT *, CAST(coalesce(sum(cap) OVER before, 0) AS BIGINT) AS cap_before,
         CAST(sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS BIGINT) AS w_left,
         CAST(sum(source_size) OVER () AS BIGINT) * CAST(1.5 AS DOUBLE) AS wanted
  FROM capped
  WINDOW before AS (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), at_level AS (
  SELECT (wanted - cap_before) / w_left AS level FROM ordered
  WHERE cap_before + CAST(cap AS DOUBLE) / w * w_left >= wanted ORDER BY cap_before LIMIT 1
), targets AS (
  SELECT source, source_size,
         coalesce(least(CAST(cap AS DOUBLE), (SELECT level FROM at_level) * w), CAST(cap AS DOUBLE)) AS target
  FROM ordered
), rated AS (
  SELECT s.*, t.source_size, t.target,
         CASE WHEN t.source_size = 0 THEN 0 ELSE CAST(floor(t.target / t.source_size) AS BIGINT) END AS whole,
         sum(size) OVER (PARTITION BY s.source ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) AS ended
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (whole + CASE WHEN size > 0 AND ended * 2 - size <= (target - whole * source_size) * 2 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
""",
    "op11_crc_ring": r"""
WITH poly AS (
  SELECT list(c ORDER BY i) AS steps FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM (SELECT unnest(range(256)) AS i))
), texts AS (
  SELECT 'd' AS side, doc_id, row_number() OVER () AS row_id, text FROM documents
  UNION ALL SELECT 'b', NULL, -1, text FROM benchmark
), words AS (
  SELECT side, doc_id, row_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts
), runs AS (
  SELECT side, row_id, unnest(w) AS f FROM words
  UNION ALL SELECT side, row_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
  UNION ALL SELECT side, row_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM words
), counted AS (
  SELECT side, row_id, f, count(*) AS n FROM runs GROUP BY ALL
), hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(f)), lambda i: (instr('0123456789ABCDEF', hex(f)[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', hex(f)[2 * i + 2]) - 1)),
         lambda c, b: xor(c // 256, steps[xor(c % 256, b) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM counted), poly
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM counted JOIN hashed USING (f) GROUP BY bucket)
), weights AS (
  SELECT row_id, sum(n) AS n_features, sum(n * gain) AS weight FROM counted JOIN hashed USING (f) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY row_id
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM words LEFT JOIN weights USING (row_id) WHERE side = 'd'
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= 20) OVER () AS n FROM scored
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank
FROM placed
""",
    "op12_variable_blocks": r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), sums AS (
  SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM docs WHERE len(w) > 0
), postings AS (
  SELECT row_id, doc_id, term, count(*) AS tf, CAST(any_value(n) AS BIGINT) AS n
  FROM (SELECT row_id, doc_id, len(w) AS n, unnest(w) AS term FROM docs) GROUP BY row_id, doc_id, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM postings, sums GROUP BY term
), asked AS (
  SELECT DISTINCT query_id, item_id, term FROM (
    SELECT row_number() OVER () AS query_id, item_id,
           unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
    FROM benchmark)
), scored AS (
  SELECT query_id, item_id, row_id, doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term), sums GROUP BY query_id, item_id, row_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 10
""",
}
