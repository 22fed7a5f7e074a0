"""One query for each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cross_entropy, decontaminate, lang_id, near_dedup, piece_codec, quality_rules, redirect_filter, suffix_dedup, toxicity, vector_codes, warc_audit, wavelet_tokens, whitening
from .common import fold_of, shared_dir, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    return decontaminate.find_leaks(docs, items)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.octet_length("text").cast("long")
    return found.select(
        "doc_id",
        size.alias("n_bytes"),
        (size - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


#: In the audited replica a character of every page with this remainder is changed, for the audit to find.
DAMAGED = (101, 7)


def op3_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    paths = [shared_dir(spark, f"warc-{k}") for k in "ab"]
    warc_audit.write_warc(pages.select(warc_audit.record()), paths[0])
    body = F.coalesce("html", F.lit(""))
    first = F.when(F.substring(body, 1, 1) == "(", "[").otherwise("(")
    hurt = F.when((F.col("page_id") % DAMAGED[0] == DAMAGED[1]) & (body != ""), F.concat(first, F.expr("substring(html, 2)"))).otherwise(body)
    warc_audit.write_warc(pages.withColumn("html", hurt).select(warc_audit.record()), paths[1])
    page_id = F.regexp_extract("record_id", "page:([^>]*)>", 1).cast("long")
    return warc_audit.audit(spark, *paths).select(page_id.alias("page_id"), "n_bytes", "sha256", "intact")


def op4_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return wavelet_tokens.token_table(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = fold_of("doc_id", 4) == 2
    costs = lang_id.train(docs.where(~held))
    return lang_id.predict_languages(docs.select("doc_id", held.alias("held_out"), "text"), costs)


def op6_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return cross_entropy.score_documents(docs, good)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality_rules.quality_rules(docs, table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(docs, near_dedup.Sketches(words=4))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(fold_of("doc_id", 5) != 0))
    return toxicity.score_toxicity(docs.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "text"), model)


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = piece_codec.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", F.octet_length("ids").cast("long").alias("n_id_bytes"), "n_ids", "ids_crc32", "restored")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


#: The rules of the query's contract: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op12_redirect_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redirect_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_warc_audit": op3_warc_audit,
    "op4_wavelet_tokens": op4_wavelet_tokens,
    "op5_language_id": op5_language_id,
    "op6_cross_entropy": op6_cross_entropy,
    "op7_quality_rules": op7_quality_rules,
    "op8_near_dedup": op8_near_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_piece_codec": op10_piece_codec,
    "op11_vector_codes": op11_vector_codes,
    "op12_redirect_filter": op12_redirect_filter,
    "op13_whitening": op13_whitening,
}

def _codes_sql(rounds: int = 4) -> str:
    """All distances to all entries, round by round; whole numbers of these sizes are exact in doubles."""
    far = "list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, c.v) + list_inner_product(c.v, c.v)"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT p.vec_id, p.part, any_value(p.v) AS v, min(struct_pack(d := {far}, e := c.entry)) AS best FROM p JOIN c{k} c USING (part) GROUP BY 1, 2)")
        if k < rounds:
            steps.append(f"""m{k} AS (SELECT part, entry, list(m ORDER BY pos) AS v FROM (
                SELECT part, best.e AS entry, pos, floor(sum(v[pos]) / count(*)) AS m FROM a{k}, (SELECT unnest(range(1, 1 + (SELECT max(len(v)) FROM p))) AS pos) GROUP BY 1, 2, 3) GROUP BY 1, 2)""")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{k}.v, c{k}.v) AS v FROM c{k} LEFT JOIN m{k} USING (part, entry))")
    return f"""
        WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS MATERIALIZED (SELECT vec_id, label, part, v[part * (len(v) // 4) + 1:(part + 1) * (len(v) // 4)] AS v FROM k, (SELECT unnest(range(4)) AS part)),
        c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM p QUALIFY entry < 256),
        {", ".join(steps)},
        out AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
        lab AS (SELECT k.label, CAST(sum(error) AS BIGINT) AS label_error FROM out JOIN k USING (vec_id) GROUP BY k.label),
        book AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})
        SELECT out.vec_id, code, error, label_error, codebooks_sha256 FROM out JOIN k USING (vec_id) JOIN lab ON lab.label IS NOT DISTINCT FROM k.label, book"""


def _filter_sql() -> str:
    """Rules by their longest text, links by the markup, and everything that a url reaches."""
    parts = r"(?s)^(.*?)://([^/?#]*)([^?#]*)(\?[^#]*)?"
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    part = lambda u, n: f"regexp_extract({u}, '{parts}', {n})"
    host = lambda u: f"translate({part(u, 2)}, '{up}', '{low}')"

    def plain(u: str) -> str:
        path = f"regexp_replace(regexp_replace({part(u, 3)}, '/index\\.html?$', '/'), '/+$', '')"
        query = f"regexp_replace(regexp_replace({part(u, 4)}, '([?&])utm_[^&]*', '\\1', 'g'), '&+', '&', 'g')"
        query = f"regexp_replace(regexp_replace({query}, '^\\?&', '?'), '[?&]$', '')"
        return f"CASE WHEN {host(u)} <> '' THEN regexp_replace(regexp_replace({host(u)}, '^(www\\.|m\\.)+', ''), ':(80|443)$', '') || {path} || {query} END"

    def resolved(link: str, base: str) -> str:
        site = f"{part(base, 1)} || '://' || {host(base)}"
        return f"""CASE WHEN regexp_matches({link}, '(?i)^https?://') THEN {link} WHEN regexp_matches({link}, '(?i)^[a-z][a-z0-9+.-]*:') THEN NULL
            WHEN starts_with({link}, '//') THEN {part(base, 1)} || ':' || {link} WHEN starts_with({link}, '/') THEN {site} || {link}
            WHEN {link} = '' OR starts_with({link}, '#') THEN NULL WHEN starts_with({link}, '?') THEN {site} || {part(base, 3)} || {link}
            ELSE {site} || CASE WHEN regexp_extract({part(base, 3)}, '(?s)^(.*/)', 1) = '' THEN '/' ELSE regexp_extract({part(base, 3)}, '(?s)^(.*/)', 1) END || {link} END"""

    value = lambda name: f"""regexp_replace(regexp_extract(tag, '(?is)[\\s"'']{name}\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s>"'']+)', 1), '^["'']|["'']$', '', 'g')"""
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return f"""
        WITH RECURSIVE rules(rh, rp, v) AS (VALUES {rules}),
        pg AS (SELECT row_number() OVER () AS n, page_id, url, coalesce({host("url")}, '') AS host, coalesce({part("url", 3)}, '') AS path, {plain("url")} AS plain, html FROM pages),
        tag AS (SELECT url, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g'), '(?is)(<(?:link|meta)\\b[^>]*>)', 1)) AS tag
            FROM pages WHERE url IS NOT NULL AND regexp_matches(html, '(?i)canonical|http-equiv')),
        said AS (SELECT url, replace(trim(CASE WHEN regexp_matches(tag, '(?i)^<link') AND regexp_matches(lower({value("rel")}), '(^|\\s)canonical(\\s|$)') THEN {value("href")}
            WHEN regexp_matches(tag, '(?i)^<meta') AND lower({value("http-equiv")}) = 'refresh' THEN regexp_extract({value("content")}, '(?is)url\\s*=\\s*["'']?([^"''>]*)', 1) END), '&amp;', '&') AS link FROM tag),
        decl AS (SELECT url, {resolved("link", "url")} AS target FROM said),
        url AS (SELECT url FROM pg UNION SELECT url FROM decl WHERE target IS NOT NULL UNION SELECT target FROM decl),
        fit AS (SELECT url, arg_max(v, (length(rh || rp), length(rh))) AS v, arg_max(rh || rp, (length(rh || rp), length(rh))) AS rule
            FROM url JOIN rules ON ({host("url")} = rh OR ends_with({host("url")}, '.' || rh)) AND starts_with({part("url", 3)}, rp) GROUP BY url),
        edge AS (SELECT {plain("url")} AS a, {plain("target")} AS b FROM decl WHERE target IS NOT NULL),
        bad AS (SELECT {plain("url")} AS node FROM fit WHERE v = 'block' UNION SELECT CASE WHEN edge.a = bad.node THEN edge.b ELSE edge.a END FROM bad JOIN edge ON bad.node IN (edge.a, edge.b))
        SELECT page_id, host, path, rule, coalesce(v, CASE WHEN plain IN (SELECT node FROM bad WHERE node IS NOT NULL) THEN 'block' ELSE 'allow' END) AS verdict FROM pg LEFT JOIN fit ON fit.url = pg.url"""


#: DuckDB SQL for the queries' rows; the others are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op3_warc_audit": f"""
        WITH records AS (
            SELECT page_id, html, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
                || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
                || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
                || 'Content-Type: text/html' || chr(13) || chr(10)
                || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10) || chr(13) || chr(10)
                || coalesce(html, '') AS record
            FROM pages)
        SELECT page_id, CAST(octet_length(encode(record)) AS BIGINT) AS n_bytes, sha256(record) AS sha256,
            NOT (page_id % {DAMAGED[0]} = {DAMAGED[1]} AND coalesce(html, '') <> '') AS intact
        FROM records""",
    # Windows of 200 bytes by their digests, runs of what they cover, and what stands between the runs.
    "op2_suffix_dedup": """
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
        s AS (SELECT doc_id, unnest(range(0, octet_length(b) - 199)) AS p, b FROM d),
        h AS (SELECT doc_id, p, md5(b[p + 1:p + 200]) AS h FROM s),
        twice AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
        hit AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM h JOIN twice USING (h)),
        run AS (SELECT doc_id, p, sum(CAST(before IS NULL OR p > before + 200 AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM hit),
        span AS (SELECT doc_id, min(p) AS a, max(p) + 200 AS z FROM run GROUP BY doc_id, r),
        bound AS (SELECT doc_id, a, z FROM span UNION ALL SELECT doc_id, octet_length(b), octet_length(b) FROM d),
        gap AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a, z), 0) AS start FROM bound),
        kept AS (SELECT doc_id, string_agg(hex(b[start + 1:a]), '' ORDER BY a, z) AS k, sum(z - a) AS removed, count(*) - 1 AS spans FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, octet_length(b) AS n_bytes, CAST(removed AS BIGINT) AS n_removed, spans AS n_spans, sha256(unhex(k)) AS kept_sha256 FROM kept JOIN d USING (doc_id)""",
    # All pairs that share a shingle, and what each document reaches.
    "op8_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(g) AS n FROM documents LEFT JOIN g USING (doc_id) GROUP BY doc_id),
        pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
        link AS (SELECT a, b FROM pair JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
        reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other)
        SELECT doc_id, n AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept FROM reach JOIN n USING (doc_id) GROUP BY doc_id, n""",
    "op11_vector_codes": _codes_sql(),
    "op12_redirect_filter": _filter_sql(),
}
