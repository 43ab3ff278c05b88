"""Queries of the operators over the given tables, with their SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, filter_audit, html_text, id_files, language_id, line_quality, mixing, ngram_join, packing, scratch, sharding, suffix_dedup
from . import vector_codes, voronoi

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def query(name: str, table: str, sql: str | None = None):
    """Register a function of one table, read whole."""

    def register(fn: Callable[[DataFrame], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


OP1_SQL = """
WITH turns AS (
  SELECT conv_id, turn, role, replace(coalesce(text, ''), '<|im_', '<| im_') AS text FROM conversations WHERE conv_id IS NOT NULL
),
numbered AS (
  SELECT *, row_number() OVER dialogue AS number,
    ((sum(length(text) + coalesce(length(role), 0) + 40) OVER dialogue - (length(text) + coalesce(length(role), 0) + 40)) // 262144)::INTEGER AS part
  FROM turns WINDOW dialogue AS (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW
  )
),
heads AS (
  SELECT * FROM numbered n WHERE part = 0 AND role = 'system' AND NOT EXISTS (
    SELECT 1 FROM numbered o WHERE o.conv_id = n.conv_id AND o.number < n.number AND o.role IS DISTINCT FROM 'system'
  )
),
placed_in AS (
  SELECT conv_id, part, number, role, text FROM numbered
  UNION ALL
  SELECT h.conv_id, p.part, h.number, h.role, h.text FROM heads h JOIN (SELECT DISTINCT conv_id, part FROM numbered WHERE part > 0) p USING (conv_id)
),
people AS (SELECT DISTINCT conv_id, part, role AS participant FROM numbered WHERE role <> 'system'),
messages AS (
  SELECT conv_id, participant, part, number,
    '<|im_start|>' || CASE WHEN role = participant THEN 'assistant' WHEN role = 'system' THEN 'system'
      WHEN role IS NULL THEN 'user' ELSE 'user name=' || replace(role, '<|im_', '<| im_') END || chr(10) AS head,
    text || '<|im_end|>' AS body, coalesce(role = participant, false) AS own
  FROM placed_in JOIN people USING (conv_id, part)
),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (
    PARTITION BY conv_id, participant, part ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING
  ), 0)::BIGINT + length(head) AS start FROM messages
)
SELECT conv_id, participant, part, count(*) AS n_turns,
  string_agg(head || body || chr(10), '' ORDER BY number) AS text,
  coalesce(string_agg(start || '-' || (start + length(body)), ' ' ORDER BY number) FILTER (WHERE own), '') AS loss_spans
FROM placed GROUP BY conv_id, participant, part
"""


@query("op1_perspectives", "conversations", OP1_SQL)
def op1(turns: DataFrame) -> DataFrame:
    spans = F.transform("loss_spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    return chat.perspectives(turns).withColumn("loss_spans", F.array_join(spans, " "))


@query("op2_suffix_dedup", "documents")
def op2(docs: DataFrame) -> DataFrame:
    """Repeated passages of 50 words or more: one row per run of words of a document that stand elsewhere too."""
    return suffix_dedup.spans(suffix_dedup.repeats(docs))


@query("op3_ngram_join", "documents")
def op3(docs: DataFrame) -> DataFrame:
    return ngram_join.jaccard_groups(docs)


@query("op4_best_fit_packing", "documents")
def op4(docs: DataFrame) -> DataFrame:
    return packing.pack_documents(docs, TOKENIZER)


_BOILER = " OR ".join(f"contains(lower(l), '{phrase}')" for phrase in line_quality.BOILERPLATE)
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
OP5_SQL = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
windows AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM docs WHERE len(ws) >= 5),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i:i+4]) AS c FROM windows) WHERE c > 1
),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id
),
raw_lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS raw FROM docs),
lines AS (
  SELECT doc_id, raw, trim(raw, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS l
  FROM raw_lines WHERE regexp_matches(raw, '[^\x20\x09-\x0D]')
),
measured AS (
  SELECT *, len({_WORDS.format("l")}) AS n, len(regexp_extract_all(l, '[|»›•·]')) AS separators,
    length(l) - length(regexp_replace(l, '[#*$%&|<>]', '', 'g')) AS symbols
  FROM lines
),
judged AS (
  SELECT doc_id, raw, n,
    (regexp_matches(l, '[.!?…。！？:;]["''’”»)\]]*$') OR (n <= 5 AND separators = 0))
    AND separators < 3 AND separators * 4 <= n AND symbols * 10 <= n AND NOT ({_BOILER})
    AND NOT (n >= 3 AND NOT regexp_matches(l, '\p{{Ll}}') AND regexp_matches(l, '\p{{Lu}}')) AS passes
  FROM measured
),
by_doc AS (
  SELECT doc_id, count(*) - count(DISTINCT raw) AS dup, coalesce(sum(n) FILTER (WHERE passes), 0) AS clean
  FROM judged GROUP BY doc_id
),
counts AS (
  SELECT d.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dup, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(clean, 0) AS n_clean_words
  FROM docs d LEFT JOIN by_doc USING (doc_id) LEFT JOIN covered c USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_clean_words >= 10 AND 100 * n_clean_words >= 50 * n_words AS kept,
  n_clean_words::BIGINT AS n_clean_words
FROM counts
"""


@query("op5_line_quality", "documents", OP5_SQL)
def op5(docs: DataFrame) -> DataFrame:
    return line_quality.cleaned(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_clean_words"
    )


@query("op6_language_id", "documents")
def op6(docs: DataFrame) -> DataFrame:
    model = language_id.fitted(docs)
    return language_id.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "rejected"
    )


OP8_SQL = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, list_inner_product(q.v, d.v)::BIGINT AS score
  FROM v q, v d WHERE q.vec_id % 20 = 0 AND d.vec_id <> q.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
"""


@query("op8_voronoi_knn", "embeddings", OP8_SQL)
def op8(vectors: DataFrame) -> DataFrame:
    return voronoi.top_k(vectors, F.col("vec_id") % 20 == 0)


@query("op7_html_text", "pages")
def op7(pages: DataFrame) -> DataFrame:
    return html_text.rendered(pages.select("page_id", "url", "html"))


@query("op9_mixing", "documents")
def op9(docs: DataFrame) -> DataFrame:
    return mixing.mixture(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "extra")


@query("op10_id_files", "documents")
def op10(docs: DataFrame) -> DataFrame:
    path = scratch.folder(docs.sparkSession, "ids")
    shards = id_files.write(docs, path, TOKENIZER)
    return id_files.read(path, shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


_CRC = """
WITH RECURSIVE steps AS (
  SELECT n::UBIGINT AS n, n::UBIGINT AS crc, 0 AS bit FROM range(256) t(n)
  UNION ALL
  SELECT n, CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END, bit + 1 FROM steps WHERE bit < 8
),
crc_table AS (SELECT list(crc ORDER BY n) AS says FROM steps WHERE bit = 8),
texts AS (SELECT *, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS digits FROM documents),
"""
OP11_SQL = (
    _CRC
    + """
crcs AS (
  SELECT doc_id, t, octet_length(encode(t)) + 1 AS size,
    xor(list_reduce(
      list_transform(range(octet_length(encode(t))), lambda i: ('0x' || substr(digits, 2 * i + 1, 2))::UBIGINT),
      lambda crc, byte: xor(crc >> 8, says[(xor(crc, byte) & 255)::BIGINT + 1]), 4294967295::UBIGINT
    ), 4294967295::UBIGINT) AS crc
  FROM texts, crc_table
),
rows AS (
  SELECT *, substr(md5(t), 1, 15) AS content, sum(size) OVER (ORDER BY substr(md5(t), 1, 15), doc_id) AS high FROM crcs
),
groups AS (
  SELECT *, min(high - size) OVER (PARTITION BY content) AS group_low, max(high) OVER (PARTITION BY content) AS group_high,
    sum(size) OVER () AS total FROM rows
),
borders AS (
  SELECT s, CASE
      WHEN 1000 * least(abs(16 * group_low - s * total), abs(16 * group_high - s * total)) <= total
        THEN CASE WHEN abs(16 * group_low - s * total) <= abs(16 * group_high - s * total) THEN group_low ELSE group_high END
      WHEN abs(16 * (high - size) - s * total) <= abs(16 * high - s * total) THEN high - size ELSE high END AS border
  FROM groups, range(1, 16) t(s) WHERE 16 * (high - size) <= s * total AND s * total < 16 * high
),
dealt AS (
  SELECT g.*, (SELECT count(*) FROM borders WHERE border <= g.high - g.size)::INTEGER AS shard FROM groups g
)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY content, doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM dealt
"""
)


@query("op11_histogram_shards", "documents", OP11_SQL)
def op11(docs: DataFrame) -> DataFrame:
    """All documents in 16 shards of near equal bytes; sizes and digests are those of the texts in the shards."""
    text = F.coalesce("text", F.lit(""))
    return sharding.sharded(docs.select("doc_id", "text")).select(
        "doc_id", sharding.size_of(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


OP12_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
),
failed AS (
  SELECT doc_id, part, [
      len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws),
      100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t),
      regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)
    ] AS fails FROM words
),
marked AS (
  SELECT part, fails, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad,
    list_sum([f::INTEGER FOR f IN fails]) AS n_fails FROM failed LEFT JOIN labels USING (doc_id)
),
letters AS (SELECT * FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) t(f)),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
),
steps AS (
  SELECT *, substr(filter_order, step, 1) AS f, ascii(substr(filter_order, step, 1)) - 64 AS number,
    [ascii(c) - 64 FOR c IN string_split(left(filter_order, step - 1), '') IF c <> ''] AS before
  FROM (SELECT filter_order, unnest(range(1, 6))::INTEGER AS step FROM orders)
),
kinds AS (SELECT part, fails, good, bad, n_fails, count(*) AS n FROM marked GROUP BY ALL),
counts AS (
  SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (WHERE NOT fails[number] AND NOT gone), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE fails[number] AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE fails[number] AND gone), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE fails[number] AND n_fails = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (WHERE fails[number] AND NOT gone AND good), 0)::BIGINT AS good_lost,
    coalesce(sum(n) FILTER (WHERE fails[number] AND NOT gone AND bad), 0)::BIGINT AS toxic_lost
  FROM (SELECT kinds.*, steps.*, len([x FOR x IN before IF fails[x]]) > 0 AS gone FROM kinds, steps)
  GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counts
"""


def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters A to E over all documents, in all their orders, for each source."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{table}.parquet") for table in ("documents", "labels"))
    return filter_audit.audit(docs, filter_audit.text_filters(), labels)


QUERIES["op12_filter_audit"], ORACLES["op12_filter_audit"] = _op12, OP12_SQL


def _op13_sql(rounds: int = vector_codes.ROUNDS, width: int = 8) -> str:
    places = range(1, width + 1)
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"""near_{r} AS MATERIALIZED (
  SELECT vec_id, position, any_value(part) AS part, min(away) AS away, arg_min(entry, (away, entry)) AS entry FROM (
    SELECT p.vec_id, p.position, p.part, c.entry,
      list_sum(list_transform(range(1, {width + 1}), lambda i: (p.part[i] - c.value[i]) * (p.part[i] - c.value[i])))::BIGINT AS away
    FROM parts p JOIN books_{r} c USING (position)
  ) GROUP BY vec_id, position
)"""
        )
        if r < rounds:
            means = ", ".join(f"((sum(part[{i}]) - ((sum(part[{i}]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT" for i in places)
            steps.append(
                f"""books_{r + 1} AS MATERIALIZED (
  SELECT position, entry, coalesce(mean, value) AS value FROM books_{r}
  LEFT JOIN (SELECT position, entry, [{means}] AS mean FROM near_{r} GROUP BY position, entry) USING (position, entry)
)"""
            )
    return f"""
WITH kept AS (
  SELECT vec_id, label, [floor(4096 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
parts AS MATERIALIZED (
  SELECT vec_id, label, position, v[{width} * position + 1 : {width} * position + {width}] AS part FROM kept, range(8) t(position)
),
books_0 AS MATERIALIZED (
  SELECT position, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, part AS value FROM parts
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 16)
),
{", ".join(steps)},
coded AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY position) AS code, sum(away)::BIGINT AS error
  FROM near_{rounds} GROUP BY vec_id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(value, ','), ',' ORDER BY position, entry)) FROM books_{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


@query("op13_vector_codes", "embeddings", _op13_sql())
def op13(vectors: DataFrame) -> DataFrame:
    """All vectors as codes of 8 parts, and what they lose."""
    codes = vector_codes.compressed(vectors)
    hexed = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return codes.rows.select(F.col("id").alias("vec_id"), hexed.alias("code"), "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))
