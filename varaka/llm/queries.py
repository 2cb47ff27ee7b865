"""One query for each training-data operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; Arrow batches are bounded by bytes too, since a text may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varaka.llm.minhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, similar=(4, 5)).drop("text_key", "component_key")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varaka.llm.lm_score import scores

    return scores(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varaka.llm.exact_dedup import exact_duplicates

    found = exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varaka.llm.url_filter import judge

    return judge(table(spark, sf_dir, "pages"), URL_RULES)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varaka.llm.bpe import encode_decode

    found = encode_decode(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varaka.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varaka.llm.substring_dedup import repeated_windows

    found = repeated_windows(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varaka.llm.decontaminate import overlaps

    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites are the sources, their sections the languages."""
    from varaka.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varaka.llm.html_text import extract

    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "text", F.length("text").alias("n_chars"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varaka.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varaka.llm.parity_join import similar_documents

    return similar_documents(table(spark, sf_dir, "documents"), shingle=5, similar=(4, 5)).drop("text_key")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varaka.llm.repair import repaired_conversations

    return repaired_conversations(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_minhash_dedup, op2_lm_score, op3_exact_dedup, op4_url_filter, op5_bpe, op6_toxicity, op7_substring_dedup, op8_decontaminate, op9_quality, op10_html_text, op11_collocations, op12_ngram_jaccard_join, op13_conversation_repair)
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": """
        WITH d AS (
          SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \\t-\\r]+', ' ', 'g')) AS text_sha256 FROM documents
        ), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
    """,
    "op11_collocations": """
        WITH d AS (
          SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
        ), p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\n-\r]')) AS piece FROM d
        ), w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM p
        ), g AS (
          SELECT lang, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase
          FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS size))
        ), f AS (SELECT lang, size, phrase, count(*) AS a FROM g GROUP BY ALL
        ), n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE size = 1 GROUP BY 1
        ), c AS (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS v FROM f WHERE size > 1 AND a >= 10
        ), cuts AS (
          SELECT lang, size, phrase, a, v, unnest(range(1, size)) AS k FROM c
        ), sides AS (
          SELECT c.lang, c.size, c.phrase, c.a, k, x.a AS l, y.a AS r, ((1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a))::BIGINT AS score
          FROM cuts c
          JOIN f x ON x.lang = c.lang AND x.size = k AND x.phrase = array_to_string(list_slice(v, 1, k), ' ')
          JOIN f y ON y.lang = c.lang AND y.size = c.size - k AND y.phrase = array_to_string(list_slice(v, k + 1, c.size), ' ')
        ), least AS (
          SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ), inside AS (
          SELECT lang, part, max(a) AS longer
          FROM (SELECT lang, a, unnest([array_to_string(v[1:2], ' '), array_to_string(v[2:3], ' ')]) AS part FROM c WHERE size = 3) GROUP BY ALL
        ), kept AS (
          SELECT s.* FROM least s LEFT JOIN inside i ON s.size = 2 AND i.lang = s.lang AND i.part = s.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * s.a
        ), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
    """,
    "op13_conversation_repair": """
        WITH RECURSIVE hashed AS (
          SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT)),
              lambda crc, c: list_reduce(list_prepend(xor(crc, c), list_transform(range(8), lambda j: j::BIGINT)), lambda x, j: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS fault
          FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations)
        ), rows AS (
          SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
            CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
          FROM hashed, (SELECT unnest([1, 2]) AS copy) WHERE fault <> 0 AND (copy = 1 OR fault = 3)
        ), placed AS (
          SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS c,
            right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS z FROM rows
        ), judged AS (
          SELECT *, z = '' AS blank, z <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
            z NOT IN ('', '.', '!', '?') AS cut, lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair FROM placed
        ), facts AS (
          SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate,
            count(*) FILTER (cut AND NOT again) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id
        ), step AS (
          SELECT conv_id, i, role, text, c, blank OR again AS gone, cut::INT AS t FROM judged
        ), behind AS (
          SELECT conv_id, n + 1 AS i, 0 AS d0, 4 AS d1, 2 AS d2, 0 AS d3 FROM facts
          UNION ALL
          SELECT conv_id, i, least(b0, 2 + b2, 4 + b3), least(b1, 2 + b2, 4 + b3), least(b2, 2 + b3), least(b3, 2 + b2) FROM (
            SELECT s.conv_id, s.i,
              CASE WHEN gone THEN 3 + d0 ELSE least(3 + d0, 2 + t + d2, CASE WHEN c = 's' THEN t + d1 WHEN c = 'u' THEN t + d2 ELSE 99999999 END) END AS b0,
              CASE WHEN gone THEN 3 + d1 ELSE least(3 + d1, 2 + t + d2, CASE WHEN c = 'u' THEN t + d2 ELSE 99999999 END) END AS b1,
              CASE WHEN gone THEN 3 + d2 ELSE least(3 + d2, 2 + t + d3, CASE WHEN c = 'a' THEN t + d3 ELSE 99999999 END) END AS b2,
              CASE WHEN gone THEN 3 + d3 ELSE least(3 + d3, 2 + t + d2, CASE WHEN c = 'u' THEN t + d2 ELSE 99999999 END) END AS b3
            FROM behind b JOIN step s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.i = b.i - 1)
        ), costs AS (SELECT conv_id, i, [d0, d1, d2, d3] AS d FROM behind
        ), walk AS (
          SELECT conv_id, 1::BIGINT AS i, 0 AS q, '' AS audit, []::VARCHAR[] AS lines FROM facts
          UNION ALL
          SELECT conv_id, CASE WHEN letter = 'I' THEN i ELSE i + 1 END, CASE letter WHEN 'D' THEN q WHEN 'K' THEN kept ELSE nxt END, audit || letter,
            CASE letter WHEN 'D' THEN lines WHEN 'I' THEN list_append(lines, CASE nxt WHEN 2 THEN 'user:' ELSE 'assistant:' END) WHEN 'K' THEN list_append(lines, role || ':' || text)
              ELSE list_append(lines, CASE nxt WHEN 2 THEN 'user:' ELSE 'assistant:' END || text) END
          FROM (
            SELECT *, CASE WHEN role IS NOT NULL AND here = 3 + after[q + 1] THEN 'D' WHEN here = 2 + before[nxt + 1] THEN 'I'
              WHEN NOT gone AND kept IS NOT NULL AND here = t + after[kept + 1] THEN 'K' ELSE 'R' END AS letter
            FROM (
              SELECT w.*, s.role, s.text, s.gone, s.t, x.d AS before, y.d AS after, x.d[q + 1] AS here, CASE q WHEN 2 THEN 3 ELSE 2 END AS nxt,
                CASE WHEN s.c = 's' AND q = 0 THEN 1 WHEN s.c = 'u' AND q <> 2 THEN 2 WHEN s.c = 'a' AND q = 2 THEN 3 END AS kept
              FROM walk w JOIN facts f ON f.conv_id IS NOT DISTINCT FROM w.conv_id
              JOIN costs x ON x.conv_id IS NOT DISTINCT FROM w.conv_id AND x.i = w.i
              LEFT JOIN step s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.i = w.i
              LEFT JOIN costs y ON y.conv_id IS NOT DISTINCT FROM w.conv_id AND y.i = w.i + 1
              WHERE w.i <= f.n OR q IN (1, 2)))
        ), ended AS (SELECT w.* FROM walk w JOIN facts f ON f.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.i > f.n AND q IN (0, 3)
        ), every AS (SELECT DISTINCT conv_id FROM conversations)
        SELECT e.conv_id, coalesce(f.gaps, 0) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate, coalesce(f.truncated, 0) AS truncated, coalesce(f.illegal, 0) AS illegal,
          coalesce(c.d[1], 0)::BIGINT AS cost, coalesce(w.audit, '') AS audit, sha256(coalesce(array_to_string(w.lines, chr(10)), '')) AS repaired_sha256
        FROM every e LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN ended w ON w.conv_id IS NOT DISTINCT FROM e.conv_id
        LEFT JOIN costs c ON c.conv_id IS NOT DISTINCT FROM e.conv_id AND c.i = 1
    """,
}
