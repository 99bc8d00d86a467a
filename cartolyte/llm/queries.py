"""The operators' queries over the driver's tables, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolyte.llm import ann, bpe, collocations, divergence, exact_dedup, html_extract, line_dedup, near_dedup, packing, quality, substring_dedup, url_filter, warc
from cartolyte.llm.common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture of the day its id gives, against lists whose history derives from all hosts by rule."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetch_day", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(365)).cast("int")))
    host = url_filter.host_of(F.col("url"))
    domains = pages.select(F.regexp_replace(host, r"^(www|m|blog)\.", "").alias("pattern")).where("pattern IS NOT NULL").distinct()
    n = F.length("pattern")
    day = lambda first, more: F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(first, F.lit(200)) + more)
    change = lambda name, action, first, more, state: F.struct(F.lit(name).alias("list"), F.lit(action).alias("action"), day(first, more).alias("day"), F.lit(state).alias("state"))
    block = F.array(change("daily", "block", n * 17, 0, "added"), change("daily", "block", n * 17, 60, "removed"), change("daily", "block", n * 17, 120, "added"))
    allow = F.array(change("trusted", "allow", n * 5, 30, "added"))
    none = F.slice(block, 1, 0)
    changes = domains.select("pattern", F.explode(F.concat(F.when(n % 3 == 0, block).otherwise(none), F.when(n % 4 == 0, allow).otherwise(none))).alias("c")).select("pattern", "c.*")
    fixed = spark.createDataFrame([("spam", "block", p, "2020-01-01", "added") for p in ("spam-farm.example.org", "cheap-pills.example.com")], "list string, action string, pattern string, day string, state string")
    changes = changes.unionByName(fixed.withColumn("day", F.col("day").cast("date")))
    out = url_filter.filter_captures(captures, changes)
    return out.select("page_id", F.col("fetch_day").cast("string").alias("fetch_day"), F.col("_host").alias("host"), F.col("_blocked").alias("blocked"), F.col("_pattern").alias("pattern"), F.col("_lists").alias("lists"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as two to six captures: responses, one of them undated, and revisits before, after, with old and with wrong validators."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("digest"))
    start = F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 60)
    swapped = F.when(F.startswith("url", F.lit("https:")), F.concat(F.lit("http:"), F.substr("url", F.lit(7)))).otherwise(F.concat(F.col("url"), F.lit("#again")))
    second = F.md5(F.concat("digest", F.lit("2")))

    def capture(k: int, day: int | None, revisit: bool, etag, payload, url=F.col("url")):
        tag = F.concat(F.lit('W/"' if revisit else '"'), etag, F.lit('"'))
        names = ["content-type", "content-length", "cache-control", "etag", "date"] if not revisit else ["content-length", "cache-control", "etag", "date"]
        values = {"content-type": F.lit("text/html"), "content-length": F.lit("0" if revisit else "100"), "cache-control": F.lit(f"max-age={60 + k}"), "etag": tag, "date": F.lit(str(k))}
        headers = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(values[n] for n in names)))
        return F.struct(F.lit(k).alias("k"), url.alias("url"), (F.lit(None).cast("timestamp") if day is None else start + F.expr(f"INTERVAL {day} DAYS")).alias("warc_date"), F.lit(revisit).alias("is_revisit"), headers.alias("headers"), payload.alias("payload"))

    nothing, d = F.lit(None).cast("string"), F.col("digest")
    always = F.array(capture(0, 0, False, d, d), capture(1, 1, True, d, nothing, swapped))
    fifth = F.array(capture(2, 2, False, second, second), capture(3, 3, True, F.when(F.col("page_id") % 2 == 0, d).otherwise(second), nothing))
    seventh = F.array(capture(4, -400, True, d, nothing))
    undated = F.array(capture(5, None, False, second, second))
    none = F.slice(always, 1, 0)
    every = F.concat(always, *(F.when(F.col("page_id") % n == 0, more).otherwise(none) for n, more in ((5, fifth), (7, seventh), (11, undated))))
    records = pages.select("page_id", F.explode(every).alias("c")).select((F.col("page_id") * 8 + F.col("c.k")).alias("record_id"), "page_id", "c.*")
    out = warc.resolve_revisits(records)
    return out.select("record_id", "page_id", "canonical", "resolution", F.col("target_id").cast("string").alias("target_id"), "payload", warc.header_lines(F.col("merged_headers")).alias("header_lines"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents")).drop("keep_runs")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_bpe": op2_bpe,
    "op3_ann": op3_ann,
    "op4_html_extract": op4_html_extract,
    "op6_url_filter": op6_url_filter,
    "op9_warc": op9_warc,
    "op5_exact_dedup": op5_exact_dedup,
    "op7_near_dedup": op7_near_dedup,
    "op8_quality": op8_quality,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_line_dedup": op11_line_dedup,
    "op12_divergence": op12_divergence,
    "op13_collocations": op13_collocations,
}

_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

ORACLE_SQL = {
    "op5_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_NORM} AS norm FROM documents),
             g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
        FROM d JOIN g USING (norm)""",
    # The words of a text by position; windows by their words; a word goes if one of the windows over it starts earlier elsewhere.
    "op10_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
             s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20),
             h AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS t FROM s),
             f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) > 1 AS gone FROM h),
             g AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM f WHERE gone) GROUP BY doc_id),
             p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
             k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM p LEFT JOIN (SELECT doc_id, unnest(gone) AS i FROM g) x USING (doc_id, i) WHERE x.i IS NULL GROUP BY p.doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
    "op11_line_dedup": r"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
             e AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM d),
             k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
             f AS (SELECT key, max(doc_id) AS last_id FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
        SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (f.key IS NOT NULL AND k.doc_id <> last_id) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL OR k.doc_id = last_id), '')) AS kept_sha256
        FROM k LEFT JOIN f USING (key) GROUP BY k.doc_id""",
    # Shares are exact in HUGEINT; all pairs of groups meet over the kept terms, with zeros.
    "op12_divergence": r"""
        WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
             w AS (SELECT rowid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS rowid, * FROM d)),
             k AS (SELECT lang, term, count(*)::HUGEINT AS total FROM w GROUP BY lang, term HAVING count(DISTINCT rowid) >= 30),
             v AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM k GROUP BY lang),
             g AS (SELECT DISTINCT lang, source FROM d),
             c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
             s AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY ALL),
             f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(s.n, 0) + 5 * v.v) AS p, 1 + (1000000000::HUGEINT * (k.total + 5)) // (v.n + 5 * v.v) AS q
                   FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang LEFT JOIN s ON g.lang = s.lang AND g.source = s.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
             m AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
             r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source
                   UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM f WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM r QUALIFY part = 'pair' OR rank <= 50""",
    "op13_collocations": r"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
             w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
             g AS (SELECT lang, w, unnest(range(1, 6)) AS m FROM w),
             h AS (SELECT lang, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM g WHERE len(w) >= m),
             f AS (SELECT lang, m, w[i:i + m - 1] AS p, count(*)::HUGEINT AS f FROM h GROUP BY ALL HAVING count(*) >= 100),
             n AS (SELECT lang, count(*)::HUGEINT AS n FROM h WHERE m = 1 GROUP BY lang),
             c AS (SELECT lang, m, p, f AS a, unnest(range(1, m)) AS k FROM f WHERE m > 1),
             s AS (SELECT c.*, x.f AS l, y.f AS r, n.n, (1000::HUGEINT * a * n.n) // (x.f * y.f) AS score
                   FROM c JOIN f x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1:c.m] JOIN n ON n.lang = c.lang),
             b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
             o AS (SELECT lang, q[i:i + j - 1] AS p, max(a) AS longer FROM (SELECT *, unnest(range(1, m - j + 2)) AS i FROM (SELECT lang, m, p AS q, f AS a, unnest(range(2, m)) AS j FROM f WHERE m > 2)) GROUP BY ALL),
             k AS (SELECT b.*, array_to_string(p, ' ') AS phrase FROM b LEFT JOIN o USING (lang, p) WHERE longer IS NULL OR 100 * longer < 100 * a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM k QUALIFY rank <= 2000""",
    "op6_url_filter": r"""
        WITH c AS (SELECT page_id, DATE '2024-01-01' + (page_id % 365)::INT AS fetch_day,
                          nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '.'), '') AS host FROM pages),
             d AS (SELECT DISTINCT regexp_replace(host, '^(www|m|blog)\.', '') AS pattern FROM c WHERE host IS NOT NULL),
             e AS (SELECT 'daily' AS list, 'block' AS action, pattern, DATE '2024-01-01' + (length(pattern) * 17 % 200)::INT AS since, DATE '2024-01-01' + (length(pattern) * 17 % 200 + 60)::INT AS until FROM d WHERE length(pattern) % 3 = 0
                   UNION ALL SELECT 'daily', 'block', pattern, DATE '2024-01-01' + (length(pattern) * 17 % 200 + 120)::INT, DATE '9999-12-31' FROM d WHERE length(pattern) % 3 = 0
                   UNION ALL SELECT 'trusted', 'allow', pattern, DATE '2024-01-01' + (length(pattern) * 5 % 200 + 30)::INT, DATE '9999-12-31' FROM d WHERE length(pattern) % 4 = 0
                   UNION ALL SELECT 'spam', 'block', 'spam-farm.example.org', DATE '2020-01-01', DATE '9999-12-31'
                   UNION ALL SELECT 'spam', 'block', 'cheap-pills.example.com', DATE '2020-01-01', DATE '9999-12-31'),
             m AS (SELECT page_id, pattern, max(action = 'block') AS blocked, string_agg(DISTINCT list, ',' ORDER BY list) AS lists
                   FROM c JOIN e ON (host = pattern OR ends_with(host, '.' || pattern)) AND fetch_day >= since AND fetch_day < until GROUP BY page_id, pattern),
             b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC) = 1)
        SELECT c.page_id, fetch_day::VARCHAR AS fetch_day, host, coalesce(blocked, false) AS blocked, pattern, lists FROM c LEFT JOIN b USING (page_id)""",
    "op9_warc": r"""
        WITH p AS (SELECT page_id, url, md5(coalesce(html, '')) AS d, md5(md5(coalesce(html, '')) || '2') AS d2, TIMESTAMP '2024-01-01' + to_minutes(page_id) AS t FROM pages),
             r AS (SELECT page_id, 0 AS k, url, t AS ts, false AS is_revisit, d AS tag, d AS payload FROM p
                   UNION ALL SELECT page_id, 1, CASE WHEN url LIKE 'https:%' THEN 'http:' || substr(url, 7) ELSE url || '#again' END, t + INTERVAL 1 DAY, true, d, NULL FROM p
                   UNION ALL SELECT page_id, 2, url, t + INTERVAL 2 DAY, false, d2, d2 FROM p WHERE page_id % 5 = 0
                   UNION ALL SELECT page_id, 3, url, t + INTERVAL 3 DAY, true, CASE WHEN page_id % 2 = 0 THEN d ELSE d2 END, NULL FROM p WHERE page_id % 5 = 0
                   UNION ALL SELECT page_id, 4, url, t - INTERVAL 400 DAY, true, d, NULL FROM p WHERE page_id % 7 = 0
                   UNION ALL SELECT page_id, 5, url, NULL, false, d2, d2 FROM p WHERE page_id % 11 = 0),
             b AS (SELECT *, page_id * 8 + k AS record_id, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.\-]*://', '') AS bare FROM r),
             c AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www\.|:(80|443)$', '', 'g') || regexp_replace(bare, '^[^/?]*', ''), '/+$', '') AS canonical FROM b),
             j AS (SELECT *, last_value(CASE WHEN NOT is_revisit AND ts IS NOT NULL THEN record_id END IGNORE NULLS) OVER (PARTITION BY canonical ORDER BY ts NULLS LAST, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS found FROM c),
             f AS (SELECT j.*, x.tag AS found_tag, x.payload AS found_payload, x.k AS found_k FROM j LEFT JOIN c x ON j.found = x.record_id),
             s AS (SELECT *, CASE WHEN NOT is_revisit THEN 'response' WHEN found IS NULL THEN 'missing' WHEN tag = found_tag THEN 'resolved' ELSE 'mismatch' END AS resolution FROM f)
        SELECT record_id, page_id, canonical, resolution, CASE WHEN resolution = 'resolved' THEN found::VARCHAR END AS target_id,
               CASE WHEN resolution = 'resolved' THEN found_payload WHEN resolution = 'response' THEN payload END AS payload,
               'cache-control: max-age=' || (60 + k) || chr(10) || 'content-length: ' || CASE WHEN resolution IN ('response', 'resolved') THEN '100' ELSE '0' END || chr(10)
               || CASE WHEN resolution IN ('response', 'resolved') THEN 'content-type: text/html' || chr(10) ELSE '' END || 'date: ' || k || chr(10)
               || 'etag: ' || CASE WHEN is_revisit THEN 'W/' ELSE '' END || '"' || tag || '"' AS header_lines
        FROM s""",
}
