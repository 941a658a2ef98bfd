"""The subpackage's registered queries, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm import bitplanes, context_tree, digests, jaccard, packing, pieces, quality_model, quality_rules, repair, samples, substring, vector_forest, warc
from thicket.llm import toxicity as tox

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: A word, for both engines.
WORD = r"[^\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None):
    """Register a query and its SQL."""

    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op6_substring_dedup",
    rf"""
    WITH words AS (
        SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p
        FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents)
    ),
    windows AS (
        SELECT doc_id, p, string_agg(word, ' ') OVER w AS s, count(*) OVER w AS n
        FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
    ),
    firsts AS (SELECT s, min(doc_id) AS m FROM windows WHERE n = 13 GROUP BY s),
    repeated AS (SELECT doc_id, p FROM windows JOIN firsts USING (s) WHERE n = 13 AND m < doc_id),
    gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM repeated),
    marked AS (SELECT words.doc_id, words.p, words.word, gone.p IS NOT NULL AS out FROM words LEFT JOIN gone USING (doc_id, p)),
    sums AS (
        SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE out) AS n_removed,
               coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT out), '') AS kept
        FROM marked GROUP BY doc_id
    )
    SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM documents LEFT JOIN sums USING (doc_id)
    """,
)
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.repeated_spans(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: A-Z to a-z and nothing else, as the contracts ask.
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op2_ngram_jaccard",
    rf"""
    WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORD}') AS ws FROM documents),
    words AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM texts),
    windows AS (
        SELECT doc_id, n, string_agg(word, ' ') OVER w AS s, count(*) OVER w AS k
        FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)
    ),
    shingles AS (SELECT DISTINCT doc_id, s FROM windows WHERE k = least(n, 5)),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
    links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
    edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a)
    SELECT r.a AS doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.b) AS component_id
    FROM reach r LEFT JOIN sizes s ON s.doc_id = r.a GROUP BY r.a
    """,
)
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query(
    "op1_quality_rules",
    rf"""
    WITH split AS (
        SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws,
               regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS ink,
               list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines
        FROM documents
    ),
    words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM split),
    windows AS (
        SELECT doc_id, p, word || ' ' || lead(word) OVER w || ' ' || lead(word, 2) OVER w AS s FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY p)
    ),
    twice AS (SELECT doc_id, s FROM windows WHERE s IS NOT NULL GROUP BY doc_id, s HAVING count(*) > 1),
    places AS (SELECT DISTINCT doc_id, unnest([p, p + 1, p + 2]) AS p FROM windows JOIN twice USING (doc_id, s)),
    repeats AS (SELECT doc_id, count(*) AS n FROM places GROUP BY doc_id),
    stats AS (
        SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, length(ink)::BIGINT AS word_chars, (length(ink) - length(translate(ink, '#*$%&|<>', '')))::BIGINT AS n_symbols,
               (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines
        FROM split LEFT JOIN repeats USING (doc_id)
    ),
    metrics AS (
        SELECT doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               unnest([
                   {{'metric': 'symbols', 'least': 8, 'v': n_symbols * 1000 // greatest(word_chars, 1)}}, {{'metric': 'word_length', 'least': 10, 'v': word_chars * 100 // greatest(n_words, 1)}},
                   {{'metric': 'dup_lines', 'least': 70, 'v': n_dup_lines * 1000 // greatest(n_lines, 1)}}, {{'metric': 'repeats', 'least': 60, 'v': n_repeat_words * 1000 // greatest(n_words, 1)}}
               ], recursive := true)
        FROM stats
    ),
    sketch AS (
        SELECT lang, source, metric, v - v % (1::BIGINT << greatest(length(bin(v)) - 7, 0)) AS b, count(*) AS n
        FROM metrics WHERE NOT base_failed GROUP BY ALL
    ),
    merged AS (
        SELECT 0 AS level, lang, source, metric, b, n FROM sketch
        UNION ALL SELECT 1, lang, NULL, metric, b, sum(n) FROM sketch GROUP BY lang, metric, b
        UNION ALL SELECT 2, NULL, NULL, metric, b, sum(n) FROM sketch GROUP BY metric, b
    ),
    counted AS (
        SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY b) AS up_to, sum(n) OVER (PARTITION BY level, lang, source, metric) AS total FROM merged
    ),
    quartiles AS (
        SELECT level, lang, source, metric, max(total) AS total, min(b) FILTER (WHERE 4 * up_to >= total) AS q1, min(b) FILTER (WHERE 4 * up_to >= 3 * total) AS q3
        FROM counted GROUP BY level, lang, source, metric
    ),
    chosen AS (
        SELECT DISTINCT ON (m.doc_id, m.metric) m.doc_id, m.metric, m.v, m.least, q.q1, q.q3
        FROM metrics m LEFT JOIN quartiles q ON q.metric = m.metric AND (q.level = 2 OR q.lang IS NOT DISTINCT FROM m.lang) AND (q.level > 0 OR q.source IS NOT DISTINCT FROM m.source)
             AND (q.level = 2 OR q.total >= 200)
        ORDER BY m.doc_id, m.metric, q.level
    ),
    verdicts AS (
        SELECT doc_id, bool_and(coalesce(v BETWEEN q1 - 6 * greatest(q3 - q1, least) AND q3 + 6 * greatest(q3 - q1, least), true)) AS inside FROM chosen GROUP BY doc_id
    )
    SELECT DISTINCT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND inside AS kept
    FROM metrics JOIN verdicts USING (doc_id)
    """,
)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select(F.col("row.doc_id").alias("doc_id"), *quality_rules.STATISTICS, "base_failed", "kept")


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tox.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    out = out.select("row.doc_id", "score", "n_windows")
    return out.select("doc_id", (samples.remainder("doc_id") == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_windows")


@query("op5_quality_classifier")
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_model.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"]).select("row.doc_id", "score")
    return out.select("doc_id", (samples.remainder("doc_id") == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query(
    "op10_warc",
    """
    WITH pages_read AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    firsts AS (SELECT payload_digest, min(page_id) AS first FROM pages_read WHERE payload_bytes >= 100 GROUP BY payload_digest)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to
    FROM pages_read LEFT JOIN firsts USING (payload_digest)
    """,
)
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive_folder(spark)
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op8_context_tree_lm")
def op8_context_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = context_tree.ctw_scores(table(spark, sf_dir, "documents"), samples.remainder("id") != 1)
    return out.withColumn("held_out", samples.remainder("doc_id") == 1).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


@query("op7_fingerprints")
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digests.edited_neighbours(docs, digests.corpus_ranks(docs))


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op9_sentencepiece")
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = pieces.decode(pieces.encode(docs))
    return out.select("doc_id", "n_tokens", F.sha2("tokens", 256).alias("tokens_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def _clusters_sql(k: int, rounds: int) -> str:
    """The clustering as one SQL statement: a pair of steps per round."""
    steps = [
        """kept AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
        )""",
        f"""c0 AS (
            SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k, e FROM kept QUALIFY k < {k}
        )""",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS (
            SELECT vec_id, any_value(e) AS e, min_by(k, (d, k)) AS k, min(d) AS d
            FROM (SELECT vec_id, v.e, k, list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept v, c{i} c) GROUP BY vec_id
        )""")
        if i < rounds:
            steps.append(f"""m{i + 1} AS (
                SELECT k, list(m ORDER BY p) AS e
                FROM (SELECT k, p, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m FROM (SELECT k, unnest(e) AS x, generate_subscripts(e, 1) AS p FROM a{i}) GROUP BY k, p) GROUP BY k
            ),
            c{i + 1} AS (SELECT k, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN m{i + 1} m USING (k))""")
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, a.k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
               sha256(array_to_string(c.e, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} c ON c.k = a.k"""


@query("op13_centroid_clusters", _clusters_sql(40, 5))
def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplanes.centroid_clusters(table(spark, sf_dir, "embeddings"))


#: Roles a repaired conversation may read, row by row, with the damage done before; the sequence of rows is followed from left to right.
_REPAIR_SQL = r"""
    WITH RECURSIVE sums AS (
        SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda x: ascii(x)::BIGINT)),
            lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: xor(y >> 1, 3988292384::BIGINT * (y & 1)))) AS crc
        FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations)
    ),
    kinds AS (SELECT *, xor(crc, 4294967295::BIGINT) % 20 AS kind FROM sums),
    damaged AS (
        SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
        FROM kinds WHERE kind != 0
    ),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM damaged),
    inked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) AS times, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS ink FROM placed),
    judged AS (SELECT *, left(role, 1) AS r, CASE WHEN ink = '' THEN 'blank' WHEN times > 1 THEN 'duplicate' WHEN ink NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM inked),
    seams AS (SELECT conv_id, r || lead(r) OVER (PARTITION BY conv_id ORDER BY p) AS pair FROM judged),
    illegal AS (SELECT conv_id, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM seams GROUP BY conv_id),
    counts AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, max(p) AS n,
               count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated
        FROM judged GROUP BY conv_id
    ),
    {paths},
    best AS (SELECT conv_id, least(s0, s3) AS s FROM paths JOIN counts USING (conv_id) WHERE p = n),
    audits AS (SELECT conv_id, left(s, 6)::BIGINT AS cost, substr(s, 7) AS audit FROM best),
    letters AS (SELECT conv_id, audit, unnest(string_split(audit, '')) AS l, generate_subscripts(string_split(audit, ''), 1) AS n FROM audits WHERE audit != ''),
    edits AS (
        SELECT conv_id, n, l, length(translate(left(audit, n), 'I', '')) AS p, length(translate(left(audit, n), 'D', '')) - 1 - length(translate(audit, 'D', '')) % 2 AS spot FROM letters
    ),
    lines AS (
        SELECT e.conv_id, n, CASE WHEN l = 'K' THEN role WHEN spot % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE l WHEN 'I' THEN '' ELSE text END AS line
        FROM edits e JOIN judged j ON j.conv_id = e.conv_id AND j.p = greatest(e.p, 1) WHERE l != 'D'
    ),
    texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY n) AS t FROM lines GROUP BY conv_id)
    SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
           coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN counts USING (conv_id) LEFT JOIN illegal USING (conv_id) LEFT JOIN audits USING (conv_id) LEFT JOIN texts USING (conv_id)
"""


def _edited(state: str, cost: str | int, letter: str) -> str:
    """SQL: a path (six digits of cost, then its audit) with one edit more."""
    return f"lpad((left({state}, 6)::INTEGER + {cost})::VARCHAR, 6, '0') || substr({state}, 7) || '{letter}'"


def _paths_sql() -> str:
    """SQL: the cheapest path to each state, row by row."""
    open_, keep, rerole = "least(s0, s1, s3)", ("more", "K"), ("1 + more", "R")
    inserted = [_edited(t, 5, "I") for t in ("t0", "t1", "t3")]
    user = f"least(t2, {', '.join(inserted)})"
    return f"""paths AS (
        SELECT conv_id, 0::BIGINT AS p, '000000' AS s0, NULL::VARCHAR AS s1, '000005I' AS s2, '000010II' AS s3 FROM counts
        UNION ALL
        SELECT conv_id, p, t0, t1, {user} AS u, least(t3, {_edited(user, 5, "I")})
        FROM (
            SELECT x.conv_id, x.p + 1 AS p, {_edited("s0", 2, "D")} AS t0, least({_edited("s1", 2, "D")}, CASE WHEN stays AND r = 's' THEN {_edited("s0", *keep)} END) AS t1,
                   least({_edited("s2", 2, "D")}, CASE WHEN stays AND r = 'u' THEN {_edited(open_, *keep)} END, CASE WHEN stays THEN {_edited(open_, *rerole)} END) AS t2,
                   least({_edited("s3", 2, "D")}, CASE WHEN stays AND r = 'a' THEN {_edited("s2", *keep)} END, CASE WHEN stays THEN {_edited("s2", *rerole)} END) AS t3
            FROM paths x JOIN (SELECT conv_id, p, r, fault IN ('', 'truncated') AS stays, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS more FROM judged) y
              ON y.conv_id IS NOT DISTINCT FROM x.conv_id AND y.p = x.p + 1
        )
    )"""


@query("op12_conversation_repair", _REPAIR_SQL.replace("{paths}", _paths_sql()))
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    summary, repaired = repair.repair(repair.damaged(rows))
    ids = rows.select(F.col("conv_id").alias("id")).distinct()
    out = ids.join(summary, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    texts = repair.digests(repaired)
    out = out.join(texts, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


@query(
    "op11_embedding_neighbours",
    """
    WITH RECURSIVE rows AS (
        SELECT vec_id, len(embedding) AS dim, embedding::DOUBLE[] AS e,
               embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0 AS fine
        FROM embeddings
    ),
    links AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM (SELECT * FROM rows WHERE fine) a JOIN (SELECT * FROM rows WHERE fine) b ON a.vec_id != b.vec_id AND a.dim = b.dim
        WHERE list_cosine_similarity(a.e, b.e) >= 0.9
    ),
    reach AS (SELECT vec_id AS a, vec_id AS b FROM rows UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
    SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
    FROM (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
    """,
)
def op11_embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_forest.near_vectors(table(spark, sf_dir, "embeddings"))
