"""The registered queries of this folder: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import alignment, bpe_trie, exact_dedup, language, licenses, minhash, packing, prefix_trie, quality, sharding, simhash, token_store, warc

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file lies; the same on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_license_join(spark: SparkSession, sf: str) -> DataFrame:
    """License phrases and templates in all documents."""
    return licenses.labels(documents(spark, sf))


def op2_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of all documents and the components that links of four bits or fewer make."""
    return simhash.near_duplicates(documents(spark, sf))


def op3_token_store(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of all documents written as Parquet lists, and what the files hold."""
    path = scratch_path(spark, "tokens")
    token_store.write_tokens(documents(spark, sf), path, tokenizer("word_bpe_49k.json"), end_id=1)
    return token_store.stored_digests(spark, path)


def op4_packing(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in sequences of at most 4096 ids, a row per piece."""
    return packing.pack(documents(spark, sf), tokenizer("word_bpe_49k.json"), end_id=2, with_ids=False)


def op5_host_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Measures of all documents, and the verdict by their own rules and their host's standing."""
    return quality.verdicts(documents(spark, sf))


def op6_warc(spark: SparkSession, sf: str) -> DataFrame:
    """All pages written as archives, and the records read back from them."""
    path = scratch_path(spark, "warc")
    warc.write_warc(spark.read.parquet(f"{sf}/pages.parquet"), path)
    return warc.page_records(warc.read_warc(spark, path))


def op7_language_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """The language of all documents by mixture inference."""
    return language.predictions(documents(spark, sf))


def op8_hash_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in 16 shards by the hash tree, and where they lie with one shard more."""
    rows = sharding.shard_slots(documents(spark, sf), sharding.even_tree(16))
    return rows.withColumn("law", F.lit("key"))


def op9_bpe_trie(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of all documents by the trie, and what they decode to."""
    return bpe_trie.round_trip(documents(spark, sf), tokenizer("byte_bpe_50k.json"))


def op10_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The verdict on every document by equality of whole normalised texts."""
    return exact_dedup.verdicts(documents(spark, sf))


def op11_text_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of all documents by two tokenizers, aligned."""
    return alignment.alignments(documents(spark, sf), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op12_minhash_stars(spark: SparkSession, sf: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles are 85 percent alike."""
    return minhash.near_duplicates(documents(spark, sf), shingle=3, percent=85)


def op13_prefix_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt so that many share their first turns."""
    turns = prefix_trie.written(prefix_trie.numbered(spark.read.parquet(f"{sf}/conversations.parquet")), "numbered-turns")
    return prefix_trie.trie(*prefix_trie.regrouped(turns))


QUERIES = {
    "op1_license_join": op1_license_join,
    "op2_simhash": op2_simhash,
    "op3_token_store": op3_token_store,
    "op4_packing": op4_packing,
    "op5_host_rules": op5_host_rules,
    "op6_warc": op6_warc,
    "op7_language_mixture": op7_language_mixture,
    "op8_hash_tree": op8_hash_tree,
    "op9_bpe_trie": op9_bpe_trie,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_text_alignment": op11_text_alignment,
    "op12_minhash_stars": op12_minhash_stars,
    "op13_prefix_blocks": op13_prefix_blocks,
}

# Base32 of SHA-1, from its hexadecimal digits: five of them are four letters.
_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {d}, 5))::BIGINT >> {b}) & 31)::INTEGER, 1)"
_BASE32 = " || ".join(_LETTER.format(d=5 * (i // 4) + 1, b=15 - 5 * (i % 4)) for i in range(32))

# Measures of each text, then the rules of hosts; limits as in `quality`.
_QUALITY = """
    WITH t AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS s FROM documents),
    w AS (SELECT k, regexp_extract_all(s, '[^\\x20\\x09-\\x0D]+') AS ws FROM t),
    win AS (SELECT k, i, list_slice(ws, i, i + 7) AS win FROM w, range(1, len(ws) - 6) r(i)),
    twice AS (SELECT k, i FROM win QUALIFY count(*) OVER (PARTITION BY k, win) > 1),
    rep AS (SELECT k, count(DISTINCT i + j) AS n FROM twice, range(8) r(j) GROUP BY k),
    lines AS (SELECT k, count(*) AS n, count(DISTINCT l) AS d FROM (SELECT k, unnest(string_split(s, chr(10))) AS l FROM t)
              WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY k),
    m AS (SELECT doc_id, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
                 length(s) - length(regexp_replace(s, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                 coalesce(lines.n - lines.d, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
                 coalesce(lines.n, 0) AS n_lines, length(s) - length(regexp_replace(s, '[A-Z]', '', 'g')) AS n_capitals,
                 length(s) - length(regexp_replace(s, '[a-z]', '', 'g')) AS n_small
          FROM t JOIN w USING (k) LEFT JOIN rep USING (k) LEFT JOIN lines USING (k)),
    b AS (SELECT *, n_words < {words} OR 100 * n_repeat_words > {repeat} * n_words AS base_failed FROM m),
    v AS (SELECT *, {values} FROM b),
    rates AS ({rates}),
    prior AS (SELECT *, sum(f) OVER r / sum(n) OVER r AS mean, sum(f * f / n) OVER r / sum(n) OVER r AS sq,
                     count(*) OVER r AS hosts, sum(n) OVER r AS total FROM rates WINDOW r AS (PARTITION BY rule)),
    spread AS (SELECT *, sq - mean * mean - hosts * mean * (1 - mean) / total AS b FROM prior),
    strength AS (SELECT *, least({high}, greatest({low}, CASE WHEN b > 0 THEN mean * (1 - mean) / b - 1 ELSE {high} END)) AS st
                 FROM spread),
    shrunk AS (SELECT *, (f + mean * st) / (n + st) AS p FROM strength),
    bad AS (SELECT host, rule FROM shrunk WHERE p - {credible} * sqrt(p * (1 - p) / (n + st + 1)) > {lift} * mean)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_small, base_failed,
           NOT base_failed AND NOT ({hard}) AND NOT ({soft}) AS kept FROM v"""
_SOFT = quality.SOFT_RULES


def _quality_sql() -> str:
    columns = [f"coalesce(({r.part}) / nullif({r.whole}, 0), 0) > {limit} AS {k}_{r.name}" for r in _SOFT for k, limit in (("s", r.soft), ("h", r.hard))]
    failed = {quality.BASE_RULE: "base_failed", **{r.name: f"s_{r.name}" for r in _SOFT}}
    rates = [f"SELECT source AS host, '{rule}' AS rule, count(*)::DOUBLE AS n, count_if({c})::DOUBLE AS f FROM v GROUP BY source" for rule, c in failed.items()]
    soft = [f"s_{r.name} AND EXISTS (SELECT 1 FROM bad WHERE host IS NOT DISTINCT FROM source AND rule IN ('{r.name}', '{quality.BASE_RULE}'))" for r in _SOFT]
    return _QUALITY.format(
        words=quality.MIN_WORDS, repeat=quality.REPEAT_PERCENT, values=", ".join(columns), rates=" UNION ALL ".join(rates),
        low=quality.PRIOR_STRENGTH[0], high=quality.PRIOR_STRENGTH[1], credible=quality.CREDIBLE, lift=quality.BAD_LIFT,
        hard=" OR ".join(f"h_{r.name}" for r in _SOFT), soft=" OR ".join(soft),
    )


def _license_sql() -> str:
    """All windows of all texts against all templates, without any filter."""
    ts = licenses.templates()
    rows = ", ".join(f"({t.stride}, '{t.label}', [{', '.join(repr(w) for w in sorted(t.distinct))}], {t.least(licenses.CONTAINMENT)})" for t in ts)
    strides = ", ".join(f"({s})" for s in sorted({t.stride for t in ts}))
    places = []
    for phrase, label in licenses.PHRASES.items():
        parts = phrase.split()
        same = " AND ".join(f"ws[i + {k}] = '{p}'" for k, p in enumerate(parts, 1))
        places.append(f"SELECT k, '{label}' AS label, i FROM w, range(0, len(ws) - {len(parts) - 1}) r(i) WHERE {same}")
    return f"""
        WITH w AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                          '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
        p AS ({" UNION ALL ".join(places)}),
        base AS (SELECT k, count(*) AS n, min(i) AS a, max(i) AS b, list(DISTINCT label) AS ls FROM p GROUP BY k),
        t(stride, label, tokens, least) AS (VALUES {rows}),
        s(stride) AS (VALUES {strides}),
        block AS (SELECT k, stride, list_distinct(list_slice(ws, i + 1, i + 2 * stride)) AS b
                  FROM w, s, range(0, len(ws), stride) r(i)),
        met AS (SELECT k, label, len(list_intersect(b, tokens)) AS n, len(tokens) AS size, least FROM block JOIN t USING (stride)
                WHERE len(list_intersect(b, tokens)) >= least),
        best AS (SELECT k, list(DISTINCT label) AS ls, max(n / size) AS score FROM met GROUP BY k)
        SELECT doc_id, len(ws) AS n_words, coalesce(base.n, 0) AS n_base, a AS first_word, b AS last_word,
               coalesce(array_to_string(list_sort(base.ls), ','), '') AS base_labels,
               coalesce(array_to_string(list_sort(list_distinct(list_concat(base.ls, best.ls))), ','), '') AS labels,
               CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(score, 0) END::DOUBLE AS score
        FROM w LEFT JOIN base USING (k) LEFT JOIN best USING (k)"""


# All pairs of distinct sets that share a shingle, and what they reach.
_MINHASH = f"""
    WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws
                         FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM t),
    d AS (SELECT *, sha256(array_to_string(list_sort(sh), chr(10))) AS h FROM s),
    reps AS (SELECT h, any_value(sh) AS sh, len(any_value(sh)) AS n, min(doc_id) AS first FROM d WHERE len(sh) > 0 GROUP BY h),
    e AS (SELECT h, n, unnest(sh) AS g FROM reps),
    links AS (SELECT a.h AS x, b.h AS y FROM e a JOIN e b ON a.g = b.g AND a.h <> b.h GROUP BY a.h, b.h, a.n, b.n
              HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
    reach AS (SELECT h, h AS z FROM reps UNION SELECT r.h, l.y FROM reach r JOIN links l ON r.z = l.x),
    c AS (SELECT reach.h, min(first) AS low FROM reach JOIN reps ON reps.h = reach.z GROUP BY reach.h)
    SELECT doc_id, len(sh) AS n_shingles, coalesce(low, doc_id) AS component_id, doc_id = coalesce(low, doc_id) AS kept
    FROM d LEFT JOIN c USING (h)"""

# Prefixes are spelled out as texts of digests, and subtrees found by comparing all nodes.
_CRC32 = """xor(4294967295, list_reduce(
        list_concat([4294967295::BIGINT], list_transform(range(1, 1 + length({text})), lambda i: ord(substr({text}, i, 1))::BIGINT)),
        lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))"""
_TRIE = f"""
    WITH o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS p,
                      sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g, strlen(coalesce(text, '')) AS bytes
               FROM conversations WHERE conv_id IS NOT NULL),
    size AS (SELECT c, count(*) AS n FROM o GROUP BY c),
    cs AS (SELECT c, c - c % 5 AS b, {_CRC32.format(text="c::VARCHAR")} % 9 AS h FROM size),
    r AS (SELECT cs.c, o.p, g, bytes FROM cs JOIN o ON o.c = b WHERE o.p < h
          UNION ALL SELECT c, o.p - h + least(h, coalesce(size.n, 0)), g, bytes FROM cs JOIN o USING (c) LEFT JOIN size ON size.c = b WHERE o.p >= h),
    m AS (SELECT c, 0 AS d, '' AS k, 0 AS bytes FROM cs
          UNION ALL SELECT c, p + 1, array_to_string(list(g) OVER (PARTITION BY c ORDER BY p), ''), bytes FROM r),
    nodes AS (SELECT d, k, min(c) AS conv_id, count(*) AS n, max(bytes) AS bytes, substr(k, 1, greatest(0, length(k) - 64)) AS up FROM m GROUP BY d, k),
    kids AS (SELECT up AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY up),
    n AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (k)),
    below AS (SELECT v.k, count_if(x.n_children = 0) AS n_leaves, sum((x.n - 1) * x.bytes)::BIGINT AS saved
              FROM n v JOIN n x ON x.d >= v.d AND starts_with(x.k, v.k) GROUP BY v.k),
    ends AS (SELECT k, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT c, max_by(k, d) AS k FROM m GROUP BY c) GROUP BY k)
    SELECT n.conv_id, n.d::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n AS n_convs, n.n_children, n_leaves, saved AS saved_tokens,
           sha256(coalesce(ids, '')) AS ends_sha256
    FROM n LEFT JOIN nodes u ON u.k = n.up AND n.d > 0 JOIN below ON below.k = n.k LEFT JOIN ends ON ends.k = n.k"""


ORACLE = {
    "op1_license_join": _license_sql(),
    "op5_host_rules": _quality_sql(),
    "op6_warc": f"""
        SELECT page_id, strlen(t) AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id < m THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id < m THEN m END AS refers_to
        FROM (SELECT page_id, t, sha1(t) AS h, max(page_id) OVER (PARTITION BY t) AS m
              FROM (SELECT page_id, coalesce(html, '') AS t FROM pages))""",
    "op10_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
        WINDOW w AS (PARTITION BY t)""",
    "op12_minhash_stars": _MINHASH,
    "op13_prefix_blocks": _TRIE,
}
