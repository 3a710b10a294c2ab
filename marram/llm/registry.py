"""The corpus queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.llm import bpe, contamination, infill, language, mixing, periodic, pii, simhash, substring, tokens, topk, urls, warc
from marram.sources.shared import materialise, table

SITE_RULES = [
    urls.SiteRule("org/", "allow"),
    urls.SiteRule("example.org/es/", "block"),
    urls.SiteRule("example.org/en/1", "block"),
    urls.SiteRule("com/fr/", "allow"),
    urls.SiteRule("com/de/", "block"),
]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.find_occurrences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return contamination.digest(found)


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.integer_vectors(table(spark, sf_dir, "embeddings"), every_row=True), F.col("vec_id") % 50 == 0)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), SITE_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    settings = (tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    trees = materialise(tokens.keep_trees(table(spark, sf_dir, "documents"), *settings), "trees")
    return tokens.apply_edits(trees, tokens.routine_edits(), *settings)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_spans(table(spark, sf_dir, "documents")))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.fill_in_middle(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.collapse_runs(table(spark, sf_dir, "documents"), words_of=periodic.looped)


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.per_row(mixing.plan(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_substrings": op2_substrings,
    "op3_warc": op3_warc,
    "op4_topk": op4_topk,
    "op5_language": op5_language,
    "op6_urls": op6_urls,
    "op7_bpe": op7_bpe,
    "op8_simhash": op8_simhash,
    "op9_token_counts": op9_token_counts,
    "op10_pii": op10_pii,
    "op11_infill": op11_infill,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_mixing": op13_mixing,
}

_HEX = lambda at: f"('0x' || substr(hex, {at}, 5))::BIGINT"
_BASE32 = " || ".join(f"substr('{warc.BASE32}', (({_HEX(at)} >> {k}) & 31)::INT + 1, 1)" for at in range(1, 41, 5) for k in (15, 10, 5, 0))

ORACLES: dict[str, str] = {
    "op1_decontaminate": r"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
        bw AS MATERIALIZED (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS k FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        dw AS (SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
        m AS MATERIALIZED (SELECT DISTINCT r, i, dw.n, item_id FROM dw JOIN bw USING (n, k)),
        h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM m)) GROUP BY r),
        t AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)""",
    "op2_substrings": r"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        v AS MATERIALIZED (SELECT r, doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS k FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE doc_id IS NOT NULL AND len(w) >= 20)),
        f AS (SELECT k, min({'doc_id': doc_id, 'i': i}) AS first FROM v GROUP BY k HAVING count(*) > 1),
        gone AS (SELECT DISTINCT r, unnest(range(i, i + 20)) AS p FROM v JOIN f USING (k) WHERE {'doc_id': doc_id, 'i': i} > first),
        g AS (SELECT r, count(*) AS n FROM gone GROUP BY r),
        kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (r, p) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
        FROM d LEFT JOIN g USING (r) LEFT JOIN kept USING (r)""",
    "op3_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
        d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
                     min(page_id) OVER (PARTITION BY hex) AS first_id FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM d""",
    "op4_topk": """
        WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS vec FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.vec, c.vec)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op6_urls": """
        WITH u AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        s AS (SELECT page_id, url,
                     translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        rules(rule, h, p, v) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
            ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
        fit AS (SELECT s.page_id, s.url, r.rule, r.v, row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.rule) DESC, r.rule) AS k
                FROM s JOIN rules r ON (s.host = r.h OR ends_with(s.host, '.' || r.h)) AND starts_with(s.path, r.p))
        SELECT s.page_id, s.host, s.path, fit.rule,
               coalesce(fit.v, CASE WHEN regexp_matches(s.url, '[?&]utm_source=|[?&]sessionid=|/login(?:[.]php)?(?:[/?#]|$)|[/.-]xxx[/.-]') THEN 'block' END, 'allow') AS verdict
        FROM s LEFT JOIN fit ON fit.page_id = s.page_id AND fit.k = 1""",
    "op11_infill": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS hex,
                          regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w FROM documents),
        h AS (SELECT *, len(w)::BIGINT AS n, ('0x' || substr(hex, 1, 8))::BIGINT AS h1, ('0x' || substr(hex, 9, 8))::BIGINT AS h2,
                     ('0x' || substr(hex, 17, 8))::BIGINT AS h3, ('0x' || substr(hex, 25, 8))::BIGINT AS h4 FROM d),
        c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                     CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                          WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
        p AS (SELECT doc_id, text, n, form, coalesce(array_to_string(list_slice(w, 1, a), ''), '') AS head, coalesce(array_to_string(list_slice(w, a + 1, b), ''), '') AS mid,
                     coalesce(array_to_string(list_slice(w, b + 1, n), ''), '') AS tail FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(head)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || mid ELSE '<S>' || tail || '<P>' || head || '<M>' || mid END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p""",
}
