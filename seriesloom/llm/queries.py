"""Named queries of the operators, with reference SQL where SQL can express one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from seriesloom.llm import byte_bpe, fast_minhash, gam, license_scan, packing, prefix_trie, quality_rules, rabitq, secret_scan, token_alignment, toxicity, va_search, warc_revisits
from seriesloom.llm.common import crc_remainder, read_table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_quality(spark, d):
    docs, labels = read_table(spark, d, "documents"), read_table(spark, d, "labels")
    model = gam.train(docs, labels, crc_remainder("doc_id", 5) != 0)
    return gam.decided(gam.score(docs, model), crc_remainder("doc_id", 5), 0)


def op2_secrets(spark, d):
    return secret_scan.span_digests(read_table(spark, d, "documents"), RANKS, public_tokenizers.PATTERN)


#: Words of a text, the unit in which op3_packing measures documents.
WORDS = r"[^\x20\x09-\x0D]+"


def op3_packing(spark, d):
    return packing.pack_documents(read_table(spark, d, "documents"), F.regexp_count("text", F.lit(WORDS)))


def op4_va_search(spark, d):
    vectors = va_search.prepare(read_table(spark, d, "embeddings"), 64)
    found = va_search.top_k(vectors, F.col("id") % 20 == 0, 20)
    return found.select(F.col("query_id").cast("long"), "rank", F.col("vec_id").cast("long"), "score")


def op5_revisits(spark, d):
    found = warc_revisits.resolve_revisits(warc_revisits.captures_of(read_table(spark, d, "pages")))
    listed = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return found.withColumn("headers", F.array_join(listed, ";"))


def op6_minhash(spark, d):
    return fast_minhash.near_duplicates(read_table(spark, d, "documents"))


def op7_toxicity(spark, d):
    docs, labels = read_table(spark, d, "documents"), read_table(spark, d, "labels")
    lexicon = toxicity.learn(docs, labels, crc_remainder("doc_id", 4) != 2)
    return gam.decided(toxicity.score(docs, lexicon), crc_remainder("doc_id", 4), 2)


def op8_licenses(spark, d):
    return license_scan.notice_digests(read_table(spark, d, "documents"))


def op9_byte_bpe(spark, d):
    return byte_bpe.encode_digests(read_table(spark, d, "documents"), RANKS, public_tokenizers.PATTERN)


def op10_rabitq(spark, d):
    return rabitq.near_vectors(read_table(spark, d, "embeddings"))


def op11_quality_rules(spark, d):
    return quality_rules.judge(read_table(spark, d, "documents"))


def op12_prefix_trie(spark, d):
    return prefix_trie.trie(read_table(spark, d, "conversations"), prefix_trie.Borrowing())


#: Files of the two aligned vocabularies.
BYTE_LEVEL, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op13_alignment(spark, d):
    return token_alignment.align(read_table(spark, d, "documents"), BYTE_LEVEL, PIECES)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality, op2_secrets, op3_packing, op4_va_search, op5_revisits,
        op6_minhash, op7_toxicity, op8_licenses, op9_byte_bpe, op10_rabitq,
        op11_quality_rules, op12_prefix_trie, op13_alignment,
    )
}
OP4_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id AS id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.id AS query_id, c.id AS vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
      FROM v q JOIN v c ON q.id % 20 = 0 AND q.r <> c.r AND len(q.x) = len(c.x)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""

OP5_SQL = r"""
WITH parts AS (SELECT *, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)([^?#]*)(?:\?([^#]*))?' AS re FROM pages),
cut AS (SELECT page_id, html, regexp_replace(regexp_replace(lower(regexp_extract(url, re, 1)), '^www\.', ''), ':(80|443)$', '')
          || regexp_replace(regexp_extract(url, re, 2), '/+$', '') AS place,
          array_to_string(list_sort(list_filter(string_split(regexp_extract(url, re, 3), '&'),
            lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|gclid|fbclid|ref)(=|$)'))), '&') AS query FROM parts),
p AS (SELECT page_id, html, md5(html) AS tag, 'day ' || page_id AS day,
        place || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical_url FROM cut),
response AS (SELECT page_id * 4 AS response_id, page_id * 1000 AS ts, canonical_url, tag, day, length(html) AS n FROM p),
revisit AS (
  SELECT page_id * 4 + k AS record_id, page_id * 1000 + CASE k WHEN 1 THEN 500000 ELSE -1 END AS ts, canonical_url,
    CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 7 = 0 THEN 'other' ELSE 'W/' || tag END AS etag,
    CASE WHEN page_id % 5 = 0 THEN day END AS day
  FROM p, (VALUES (1), (2)) t(k) WHERE k = 1 OR page_id % 11 = 0),
last AS (SELECT v.record_id, arg_max(r, (r.ts, r.response_id)) AS r FROM revisit v JOIN response r
         ON v.canonical_url = r.canonical_url AND (r.ts < v.ts OR (r.ts = v.ts AND r.response_id < v.record_id)) GROUP BY v.record_id),
j AS (SELECT v.*, l.r, CASE WHEN l.r IS NULL THEN 'no earlier response'
        WHEN v.etag IS NOT NULL AND replace(v.etag, 'W/', '') <> l.r.tag THEN 'validator differs'
        WHEN v.etag IS NULL AND v.day <> l.r.day THEN 'validator differs' ELSE 'resolved' END AS reason
      FROM revisit v LEFT JOIN last l USING (record_id))
SELECT record_id, canonical_url, CASE WHEN reason = 'resolved' THEN r.response_id END AS response_id, reason,
  CASE WHEN reason = 'resolved'
    THEN 'cache-control=max-age=600;content-length=' || r.n || ';content-type=text/html;etag=' || coalesce(etag, r.tag)
         || ';last-modified=' || coalesce(day, r.day)
    ELSE 'cache-control=max-age=600;content-length=0' || coalesce(';etag=' || etag, '') || coalesce(';last-modified=' || day, '')
  END AS headers
FROM j
"""

STOPS = ", ".join(f"'{w}'" for w in sorted(set(quality_rules.STOP_WORDS)))
OP11_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines FROM t),
windows AS (SELECT r, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) >= 8),
texts AS (SELECT r, i, array_to_string(words[i:i + 7], ' ') AS t FROM windows),
hits AS (SELECT r, i FROM texts QUALIFY count(*) OVER (PARTITION BY r, t) > 1),
steps AS (SELECT r, least(8, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 8)) AS n FROM hits),
again AS (SELECT r, sum(n) AS n FROM steps GROUP BY r),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(len(list_filter(words, lambda x: regexp_matches(x, '\pL'))) AS BIGINT) AS n_letter_words,
  CAST(len(list_filter(words, lambda x: list_contains([{STOPS}], lower(rtrim(x, '.,;:!?'))))) AS BIGINT) AS n_stop_words,
  CAST(len(regexp_extract_all(text, '[A-Z]')) AS BIGINT) AS n_capitals,
  CAST(len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS BIGINT) AS n_same_words,
  CAST(len(list_filter(lines, lambda x: regexp_matches(x, '^[ \t]*[-*•‣◦]'))) AS BIGINT) AS n_bullet_lines,
  CAST(len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\r]*$'))) AS BIGINT) AS n_ellipsis_lines
  FROM w LEFT JOIN again USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  list_filter([
    CASE WHEN n_words < 20 THEN 'few_words' END, CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 'repeated_windows' END,
    CASE WHEN n_words > 1000000 THEN 'many_words' END,
    CASE WHEN 100 * word_chars < 300 * n_words OR 100 * word_chars > 1200 * n_words THEN 'word_length' END,
    CASE WHEN 100 * n_symbols > 10 * n_words THEN 'symbols' END, CASE WHEN 100 * n_letter_words < 75 * n_words THEN 'letters' END,
    CASE WHEN 100 * n_stop_words < 6 * n_words THEN 'stop_words' END, CASE WHEN 100 * n_capitals > 30 * word_chars THEN 'capitals' END,
    CASE WHEN 100 * n_same_words > 15 * n_words THEN 'stutter' END, CASE WHEN 100 * n_dup_lines > 40 * n_lines THEN 'copied_lines' END,
    CASE WHEN 100 * n_bullet_lines > 90 * n_lines THEN 'bullets' END,
    CASE WHEN 100 * n_ellipsis_lines > 30 * n_lines THEN 'ellipses' END], lambda x: x IS NOT NULL) AS broken FROM m)
SELECT * EXCLUDE (broken), NOT base_failed AND len(broken) = 0 AS kept, array_to_string(broken, ',') AS broken_rules FROM f
"""

OP12_SQL = """
WITH steps AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
own AS (SELECT conv_id AS c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
          ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
sums AS (SELECT c, turns, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
            lambda s, b: xor(s >> 8, t[CAST(xor(s, b) & 255 AS BIGINT) + 1])), 4294967295) % 9 AS h FROM own, steps),
made AS (SELECT s.c, list_concat(list_slice(coalesce(b.turns, []), 1, s.h), list_slice(s.turns, s.h + 1, len(s.turns))) AS turns
         FROM sums s LEFT JOIN own b ON b.c = s.c - s.c % 5),
passed AS (SELECT c, len(turns) AS n, unnest(range(0, len(turns) + 1)) AS d, turns FROM made),
node AS (SELECT turns[1:d] AS path, d AS depth, min(c) AS conv_id, count(*) AS n_convs,
           sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256,
           count(*) FILTER (WHERE n > d) AS beyond FROM passed GROUP BY ALL),
up AS (SELECT path, unnest(range(0, depth + 1)) AS e, (n_convs - 1) * coalesce(octet_length(encode(path[depth].text)), 0) AS saved,
         CASE WHEN beyond = 0 THEN 1 ELSE 0 END AS leaf FROM node),
below AS (SELECT path[1:e] AS path, sum(saved) AS saved, sum(leaf) AS leaves FROM up GROUP BY ALL),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children,
  CAST(below.leaves AS BIGINT) AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM node n JOIN below USING (path) LEFT JOIN kids USING (path) LEFT JOIN node p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]
"""

ORACLES: dict[str, str] = {"op4_va_search": OP4_SQL, "op5_revisits": OP5_SQL, "op11_quality_rules": OP11_SQL, "op12_prefix_trie": OP12_SQL}
