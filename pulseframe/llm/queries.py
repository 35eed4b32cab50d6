"""One query for each corpus operator, over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm import embeddings, licenses, line_dedup, mixing, ngram_join, packing, pii, quality, toxicity, warc
from pulseframe.llm.common import WORD, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.link_components(table(spark, sf_dir, "documents"), words=3, share=90)
    return out.withColumn("component_id", F.col("component_id").cast("long"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = toxicity.training_rows(docs, table(spark, sf_dir, "labels"))
    model = toxicity.train([t for _, t in rows], [y for y, _ in rows])
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return toxicity.score_toxicity(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))
    return out.withColumn("component_id", F.col("component_id").cast("long"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(table(spark, sf_dir, "documents"))
    kinds = F.array(*map(F.lit, pii.KINDS))
    ordered = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(F.array_position(kinds, s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined(ordered).alias("spans"), F.size(ordered).cast("long").alias("n_spans"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # longer documents are likelier: up to twelve words weigh 1, up to 120 weigh 2, more weigh 4
    spaces = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD))
    weight = F.when(spaces <= 12, 1.0).when(spaces <= 120, 2.0).otherwise(4.0)
    return mixing.plan_mix(docs, weight=weight).select("doc_id", "size", "source_size", "target", "taken")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"), "n_matches")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "captured", "url_key", "place")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_toxicity": op2_toxicity,
    "op3_embedding_neardup": op3_embedding_neardup,
    "op4_pii": op4_pii,
    "op5_mixing": op5_mixing,
    "op6_line_dedup": op6_line_dedup,
    "op7_licenses": op7_licenses,
    "op8_warc": op8_warc,
    "op9_packing": op9_packing,
    "op10_quality": op10_quality,
}

def _licenses_sql() -> str:
    """The scan as SQL: the constants are the operator's, the reading is written anew, a row for each paragraph."""
    known = ", ".join(f"'{k}': '{v}'" for k, v in licenses.KNOWN.items())
    normal = "trim(regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'), ' ')"
    # sentences between bars; known ones with a mark inside are put together
    joined = f"'|' || array_to_string(list_transform(string_split(regexp_replace({{}} || chr(10), '[.!?;:]+[\\x20\\x09-\\x0D]+', chr(10), 'g'), chr(10)), lambda s: {normal}), '||') || '|'"
    for parts, whole in licenses.PARTED.items():
        joined = f"replace({joined}, '{parts.replace('<', '|').replace('>', '|')}', '{whole.replace('<', '|').replace('>', '|')}')"
    marks = "array_to_string(list_transform(list_filter(string_split(trim({}, '|'), '||'), lambda s: s <> ''), lambda s: coalesce('<' || MAP {{{}}}[s] || '>', '~')), '')"
    anchors = " OR ".join(f"contains(lower(p), '{a}')" for a in licenses.ANCHORS)
    unknown = "repeat('~', len(list_filter(string_split(p, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))))"
    steps = []
    for i, (_, parts) in enumerate(licenses.RULES):
        pattern = "".join(f"<{p}>" for p in parts)
        steps.append(f"s{i + 1} AS (SELECT *, replace(q{i}, '{pattern}', '|') AS q{i + 1}, contains(q{i}, '{pattern}') AS h{i}, (length(q{i}) - length(replace(q{i}, '{pattern}', '|'))) // {len(pattern) - 1} AS c{i} FROM s{i})")
    n = len(licenses.RULES)
    first = {name: [i for i, r in enumerate(licenses.RULES) if r[0] == name] for name, _ in licenses.RULES}
    # a licence stands where its first rule that matched stands
    place = ", ".join(f"{{'p': CASE {' '.join(f'WHEN h{i} THEN {i}' for i in at)} ELSE -1 END, 'n': '{name}'}}" for name, at in first.items())
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        r AS (SELECT doc_id, unnest(string_split_regex(t, '\\n\\n+')) AS p, generate_subscripts(string_split_regex(t, '\\n\\n+'), 1) AS i FROM d),
        a AS (SELECT *, {anchors} AS may FROM r),
        j AS (SELECT *, CASE WHEN may THEN {joined.format('p')} ELSE '' END AS l, CASE WHEN may THEN {joined.format("replace(p, chr(10), ' ')")} ELSE '' END AS f FROM a),
        m AS (SELECT doc_id, i, may, CASE WHEN may THEN {marks.format('l', known)} ELSE {unknown} END AS l, CASE WHEN may THEN {marks.format('f', known)} ELSE '' END AS f FROM j),
        w AS (SELECT doc_id, bool_or(may) AS may, string_agg(CASE WHEN may AND length(replace(f, '<', '<<')) - length(f) > length(replace(l, '<', '<<')) - length(l) THEN f ELSE l END, '' ORDER BY i) AS q FROM m GROUP BY doc_id),
        s0 AS (SELECT doc_id, CASE WHEN may THEN replace(regexp_replace(q, '~{{{licenses.GAP},}}', '|', 'g'), '~', '') ELSE '' END AS q0 FROM w),
        {", ".join(steps)}
        SELECT doc_id, len(regexp_extract_all(q0, '<'))::BIGINT AS n_sentences, array_to_string(regexp_extract_all(q0, '<([^>]*)>', 1), ',') AS sentence_ids,
               array_to_string(list_transform(list_sort(list_filter([{place}], lambda x: x.p >= 0)), lambda x: x.n), ',') AS licenses,
               {" + ".join(f"c{i}" for i in range(n))} AS n_matches
        FROM s{n}"""


#: Of edges e (a, b) over nodes n (id): the smallest id that each reaches.
_REACH = "reach(id, other) AS (SELECT id, id FROM n UNION SELECT r.id, e.b FROM reach r JOIN e ON e.a = r.other)"

ORACLE_SQL = {
    "op1_ngram_join": rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                   ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w
        ), g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        c AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS k FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n) GROUP BY ALL),
        e AS (SELECT a, b FROM c WHERE 100 * k >= 90 * (na + nb - k)),
        n AS (SELECT doc_id AS id FROM documents),
        {_REACH}
        SELECT s.doc_id, len(s)::BIGINT AS n_shingles, m.component_id FROM s JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY id) m ON m.id = s.doc_id""",
    "op3_embedding_neardup": f"""
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0
        ), e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.9),
        n AS (SELECT vec_id AS id FROM embeddings),
        {_REACH},
        m AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id), d AS (SELECT a, count(*) AS n FROM e GROUP BY a)
        SELECT m.id AS vec_id, coalesce(d.n, 0) AS n_links, component_id, component_id = m.id AS kept FROM m LEFT JOIN d ON d.a = m.id""",
    "op8_warc": r"""
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS owner, lower(trim(coalesce(url, ''))) AS l FROM pages),
        u AS (
            SELECT *, regexp_replace(regexp_extract(l, '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', '') AS net,
                   regexp_extract(l, '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(l, '^[^?#]*[?]([^#]*)', 1) AS query FROM p
        ), k AS (
            SELECT *, array_to_string(list_reverse(string_split(regexp_replace(regexp_replace(net, ':[0-9]*$', ''), '^www[.]', ''), '.')), ',')
                   || CASE WHEN regexp_extract(net, ':([0-9]+)$', 1) IN ('', '80', '443') THEN '' ELSE ':' || regexp_extract(net, ':([0-9]+)$', 1) END
                   || ')' || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || query END AS url_key,
                   (1704067200 + page_id % 1000000000)::BIGINT AS captured FROM u
        )
        SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha1(h), (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - i % 4 * 5)::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
               CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> owner THEN owner END AS refers_to,
               url, captured, url_key, row_number() OVER (ORDER BY url_key, captured, page_id) - 1 AS place
        FROM k""",
    "op10_quality": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        b AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
        r AS (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS n FROM b) WHERE n > 1),
        k AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM r GROUP BY doc_id),
        l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
        c AS (
            SELECT d.doc_id, t, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
                   (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
            FROM d JOIN l USING (doc_id) LEFT JOIN k USING (doc_id)
        ), f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR 10 * n_symbols > n_words OR 2 * len(regexp_extract_all(t, '[A-ZÀ-ÖØ-Þ]')) > word_chars OR 4 * (length(t) - length(replace(t, '!', ''))) > n_words
                    OR 2 * n_dup_lines > 1 + length(t) - length(replace(t, chr(10), '')) OR NOT (2 * n_words <= word_chars AND word_chars <= 18 * n_words)) AS kept
        FROM f""",
    "op7_licenses": _licenses_sql(),
    "op6_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents
        ), keyed AS (
            SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
        ), shared AS (
            SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
        ), marked AS (
            SELECT k.doc_id, pos, line, s.key IS NOT NULL AND k.doc_id <> s.keeper AS dropped FROM keyed k LEFT JOIN shared s ON k.key = s.key
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op5_mixing": r"""
        WITH d AS (
            SELECT *, CASE WHEN size <= 12 THEN 1.0 WHEN size <= 120 THEN 2.0 ELSE 4.0 END::DOUBLE AS heavy
            FROM (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents)
        ), s AS (
            SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
        ), w AS (
            SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS w FROM s
        ), c AS (
            SELECT *, sum(source_size) OVER ()::BIGINT AS total, sum(w) OVER ()::BIGINT AS weight,
                   coalesce(sum(source_size) OVER o, 0)::BIGINT AS before_size, coalesce(sum(w) OVER o, 0)::BIGINT AS before_weight
            FROM w WINDOW o AS (ORDER BY source_size / w, source_size, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), f AS (
            SELECT *, (total - 3 * before_size) * w >= 3 * source_size * (weight - before_weight) AS capped FROM c
        ), t AS (
            SELECT source, source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE
                   ELSE ((total - coalesce(sum(CASE WHEN capped THEN 3 * source_size END) OVER (), 0)::BIGINT) * w)::DOUBLE / (sum(CASE WHEN NOT capped THEN w END) OVER ())::DOUBLE END AS target
            FROM f
        ), b AS (
            SELECT d.source, heavy, any_value(target) AS target, sum(size)::DOUBLE AS words FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source GROUP BY d.source, heavy
        ), bf AS (
            SELECT *, (target - 3 * coalesce(sum(words) OVER (PARTITION BY source ORDER BY heavy DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) * heavy
                      >= 3 * sum(words * heavy) OVER (PARTITION BY source ORDER BY heavy DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS full_ FROM b
        ), bl AS (
            SELECT source, heavy, CASE WHEN full_ THEN 3.0::DOUBLE ELSE least(heavy * coalesce((target - 3 * coalesce(sum(CASE WHEN full_ THEN words END) OVER o, 0.0))
                      / nullif(sum(CASE WHEN NOT full_ THEN words * heavy END) OVER o, 0.0), 0.0), 3.0::DOUBLE) END AS mean
            FROM bf WINDOW o AS (PARTITION BY source)
        ), r AS (
            SELECT doc_id, d.source, size, t.source_size, t.target, bl.mean,
                   (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || 'mix'), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN bl ON d.source IS NOT DISTINCT FROM bl.source AND d.heavy = bl.heavy
        ), q AS (
            SELECT *, floor(mean)::BIGINT AS whole,
                   CASE WHEN mean - floor(mean) > 0 AND size > 0 THEN (u / (1.0 - u)) / ((mean - floor(mean)) / (1.0 - (mean - floor(mean)))) END AS q FROM r
        ), e AS (
            SELECT *, target - sum(size * whole) OVER (PARTITION BY source) AS rest,
                   sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY q NULLS LAST, size, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM q
        ), g AS (
            SELECT *, q IS NOT NULL AND upto - size / 2.0 <= rest AS picked FROM e
        ), h AS (
            SELECT *, rest - coalesce(sum(CASE WHEN picked THEN size END) OVER (PARTITION BY source), 0) AS gap FROM g
        ), i AS (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN q IS NOT NULL AND NOT picked AND abs(gap - size) < abs(gap) THEN abs(gap - size) END NULLS LAST, q, size, doc_id) = 1
                      AND q IS NOT NULL AND NOT picked AND abs(gap - size) < abs(gap) AS closing FROM h
        )
        SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN picked OR closing THEN 1 ELSE 0 END))::BIGINT AS taken FROM i""",
}
