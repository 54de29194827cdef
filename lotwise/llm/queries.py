"""Registered queries of the operators, each over its whole table, and their SQL where there is some."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm import ann, decontaminate, langid, license_scan, merkle, near_dedup, packing, quality, resample, suffix_dedup, token_counts, token_store, tokens, warc
from lotwise.operators.durable import checkpoint_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: End-of-document ids, and the sequence length of the packing.
END_OF_TEXT, END_STORED, END_PACKED, CAPACITY = 50256, 2, 0, 2048


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/lotwise-{name}-{uuid.uuid4().hex}"


@query(
    "op1_suffix_dedup",
    """
    WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
    w AS (SELECT doc_id, p, md5(b[p : p + 49]) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 48)) AS p FROM d)),
    least AS (SELECT h, min(doc_id) AS first FROM w GROUP BY h),
    hit AS (SELECT doc_id, p FROM w JOIN least USING (h) WHERE first < doc_id),
    cut AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM hit),
    named AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM cut),
    span AS (SELECT doc_id, span, min(p) AS a, max(p) + 50 AS z FROM named GROUP BY doc_id, span),
    edge AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS before FROM span),
    part AS (SELECT doc_id, before AS s, a AS e FROM edge
             UNION ALL SELECT d.doc_id, coalesce(m.z, 1), octet_length(b) + 1 FROM d LEFT JOIN (SELECT doc_id, max(z) AS z FROM span GROUP BY doc_id) m USING (doc_id)),
    kept AS (SELECT doc_id, string_agg(CASE WHEN e > s THEN hex(b[s : e - 1]) ELSE '' END, '' ORDER BY s, e) AS x FROM part JOIN d USING (doc_id) GROUP BY doc_id)
    SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(octet_length(b) - length(x) / 2 AS BIGINT) AS n_removed,
           CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(x)) AS kept_sha256
    FROM d JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM span GROUP BY doc_id) c USING (doc_id)
    """,
)
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that a smaller document has too."""
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"))


@query("op2_license_scan")
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and texts."""
    return license_scan.licensed(table(spark, sf_dir, "documents")).drop("spans")


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokens.public(), CAPACITY, END_PACKED)


@query("op4_nearest_neighbours")
def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest neighbours of every hundredth vector."""
    return ann.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, from a flat token stream."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokens.public(), END_OF_TEXT)


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learnt from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~langid.held_out("doc_id")), "text", "lang", "doc_id")
    texts = docs.select("doc_id", langid.held_out("doc_id").alias("held_out"), "text")
    return langid.identify(texts, model).drop("text")


@query(
    "op7_warc_index",
    r"""
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, upper(sha1(coalesce(html, ''))) AS h FROM pages),
    f AS (SELECT page_id, n, h, min(page_id) OVER (PARTITION BY h) AS first FROM p),
    part AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://(?:www\.)?([^/?#:]*)', 1)) AS host, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '[?]([^#]*)', 1) AS query FROM pages),
    u AS (SELECT page_id, concat(array_to_string(list_reverse(string_split(host, '.')), ','), ')', lower(CASE WHEN path = '' THEN '/' ELSE path END),
                 CASE WHEN query <> '' THEN concat('?', lower(array_to_string(list_sort(string_split(query, '&')), '&'))) ELSE '' END) AS url_key,
                 strftime(TIMESTAMP '2020-01-01' + to_seconds(page_id % 1000000000), '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM part)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
           list_aggregate(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((CAST('0x' || h[1 + 5 * (i // 4) : 5 + 5 * (i // 4)] AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31)]), 'string_agg', '') AS payload_digest,
           CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN first <> page_id THEN first END AS refers_to, url_key, stamp,
           row_number() OVER (ORDER BY url_key, stamp, page_id) - 1 AS rank, row_number() OVER (PARTITION BY url_key ORDER BY stamp, page_id) - 1 AS nth
    FROM f JOIN u USING (page_id)
    """,
)
def op7_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of all pages, from the archives written of them."""
    index = warc.archived(table(spark, sf_dir, "pages"), folder(spark, "warc"), 0)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "stamp", "rank", "nth")


@query("op8_token_ids")
def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written in the order of their ids and read back."""
    return token_store.tokenized(table(spark, sf_dir, "documents"), folder(spark, "tokens"), tokens.public(), END_STORED)


@query(
    "op9_minhash_dedup",
    r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
    g AS (SELECT DISTINCT doc_id, list_aggregate(words[i : i + 4], 'string_agg', ' ') AS s
          FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
    pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
    both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
    c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
    SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, component_id = doc_id AS kept FROM c LEFT JOIN n USING (doc_id)
    """,
)
def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def _words_sql(source: str, key: str) -> str:
    return f"""SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM {source}"""


@query(
    "op10_decontamination",
    f"""
    WITH d AS ({_words_sql('documents', 'doc_id')}), i AS ({_words_sql('benchmark', 'item_id')}),
    win AS (SELECT item_id, k, list_aggregate(words[p : p + k - 1], 'string_agg', ' ') AS s
            FROM (SELECT item_id, words, least(len(words), 10) AS k, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS p FROM i WHERE len(words) > 0)),
    ks AS (SELECT DISTINCT k FROM win),
    spot AS (SELECT doc_id, words, k, unnest(range(1, len(words) - k + 2)) AS p FROM d, ks WHERE len(words) >= k),
    hit AS (SELECT doc_id, k, p, item_id FROM (SELECT doc_id, k, p, list_aggregate(words[p : p + k - 1], 'string_agg', ' ') AS s FROM spot) JOIN win USING (k, s)),
    word AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY doc_id),
    item AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM hit) GROUP BY doc_id)
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
           sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)
    """,
)
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in documents."""
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def _crc_sql(data: str) -> str:
    """CRC-32 of a blob; ``crc_table`` is the byte table of the ``crc`` view."""
    return f"""xor(4294967295, list_reduce([4294967295] || list_transform(range(octet_length({data})), lambda i: CAST('0x' || hex({data})[2 * i + 1 : 2 * i + 2] AS BIGINT)),
        lambda c, b: xor(c >> 8, crc_table[1 + (xor(c, b) & 255)])))"""


_CRC_TABLE = """SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_table"""

@query(
    "op11_quality_rules",
    rf"""
    WITH crc AS ({_CRC_TABLE}),
    w AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS words FROM documents),
    line AS (SELECT doc_id, count(*) AS n, count(DISTINCT l) AS u FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^ 	-
]') GROUP BY doc_id),
    win AS (SELECT doc_id, p, words[p : p + 2] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS p FROM w)),
    twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
    again AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM twice) GROUP BY doc_id),
    m AS (SELECT w.doc_id, lang, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
                 CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(line.n - line.u, 0) AS BIGINT) AS n_dup_lines,
                 CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(line.n, 0) AS BIGINT) AS n_lines,
                 CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper, CAST(length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS BIGINT) AS n_letters,
                 CAST(length(regexp_replace(t, '[^!]', '', 'g')) AS BIGINT) AS n_bangs
          FROM w LEFT JOIN line USING (doc_id) LEFT JOIN again USING (doc_id)),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
    worst AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
    lab AS (SELECT b.*, good, {_crc_sql('encode(CAST(doc_id AS VARCHAR))')} % {quality.FOLDS} = 0 AS fits FROM b JOIN worst USING (doc_id), crc WHERE NOT base_failed),
    val AS (SELECT doc_id, lang, base_failed, good, fits, unnest(v) AS v FROM
            (SELECT b.doc_id, b.lang, b.base_failed, good, fits, [{', '.join(f"{{'rule': '{r}', 'value': CAST({q.replace(' div ', ' // ')} AS BIGINT)}}" for r, q in quality.RULES.items())}] AS v
             FROM (SELECT b.*, lab.good, lab.fits FROM b LEFT JOIN lab USING (doc_id)) b)),
    fit AS (SELECT lang, v.rule AS rule, v.value AS value, sum(good) AS good, sum(1 - good) AS bad FROM val WHERE fits GROUP BY ALL),
    cum AS (SELECT lang, rule, value, sum(good) OVER u AS gu, sum(bad) OVER u AS bu, sum(good) OVER a AS goods, sum(bad) OVER a AS bads
            FROM fit WINDOW u AS (PARTITION BY lang, rule ORDER BY value), a AS (PARTITION BY lang, rule)),
    least AS (SELECT lang, rule, step, min(value) AS cutoff, min_by(goods - gu, value) AS gh, min_by(bads - bu, value) AS bh, any_value(goods) AS goods, any_value(bads) AS bads
              FROM cum, (SELECT unnest([{', '.join(map(str, quality.STEPS))}]) AS step) WHERE goods > 0 AND 1000 * (goods - gu) <= step * goods GROUP BY ALL),
    cut AS (SELECT lang, rule, step, cutoff FROM least WHERE bads > 0 AND 100 * bh >= {quality.CATCH} * bads AND bh * goods >= {quality.LIFT} * gh * bads),
    hit AS (SELECT val.doc_id, cut.lang, cut.step, val.good = 1 AND NOT val.fits AS tests, bool_or(v.value > cutoff) AS hit
            FROM val JOIN cut ON val.lang IS NOT DISTINCT FROM cut.lang AND v.rule = cut.rule WHERE NOT base_failed GROUP BY ALL),
    count AS (SELECT lang, step, count(*) AS n, count(*) FILTER (hit) AS k FROM hit WHERE tests GROUP BY ALL),
    p AS (SELECT lang, step, CASE WHEN k >= n * {quality.ALPHA} THEN 1 ELSE
            list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({quality.ALPHA}) + (n - i) * ln(1 - {quality.ALPHA})))) END AS p FROM count),
    held AS (SELECT lang, step, bool_and(p <= {quality.DELTA} / (SELECT count(*) FROM (SELECT DISTINCT lang FROM lab))) OVER (PARTITION BY lang ORDER BY step) AS held FROM p),
    final AS (SELECT lang, max(step) AS step FROM held WHERE held GROUP BY lang),
    gone AS (SELECT DISTINCT doc_id FROM hit JOIN final ON hit.lang IS NOT DISTINCT FROM final.lang AND hit.step = final.step WHERE hit)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND gone.doc_id IS NULL AS kept FROM b LEFT JOIN gone USING (doc_id)
    """,
)
def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures of all documents, and the verdict of cutoffs certified on labelled ones."""
    found = quality.ruled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _buckets_sql(source: str, key: str) -> str:
    """Distinct features of each row with their number, and whole rows' word counts."""
    return f"""SELECT id, f, count(*) AS c FROM (SELECT id, unnest(words || list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS f
               FROM ({_words_sql(source, f"{key} AS id")})) GROUP BY ALL"""


@query(
    "op12_importance_resampling",
    f"""
    WITH crc AS ({_CRC_TABLE}),
    d AS ({_buckets_sql('documents', 'doc_id')}), b AS ({_buckets_sql('benchmark', 'item_id')}),
    name AS (SELECT f, {_crc_sql('encode(f)')} % 10000 AS bucket FROM (SELECT f FROM d UNION SELECT f FROM b), crc),
    s AS (SELECT bucket, sum(c) AS n FROM d JOIN name USING (f) GROUP BY bucket), t AS (SELECT bucket, sum(c) AS n FROM b JOIN name USING (f) GROUP BY bucket),
    gain AS (SELECT s.bucket, CAST(floor(1000 * ln(((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT sum(n) FROM s) + 10000.0::DOUBLE)) / ((s.n + 1.0::DOUBLE) * (coalesce((SELECT sum(n) FROM t), 0) + 10000.0::DOUBLE)))) AS BIGINT) AS g
             FROM s LEFT JOIN t USING (bucket)),
    mean AS (SELECT id, sum(c) AS n, CAST(floor(sum(c * g) / CAST(sum(c) AS DOUBLE)) AS BIGINT) AS weight FROM d JOIN name USING (f) JOIN gain USING (bucket) GROUP BY id),
    w AS (SELECT doc_id, len(words) AS n_words FROM ({_words_sql('documents', 'doc_id')})),
    x AS (SELECT doc_id, n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
                 CAST('0x' || sha256('7:' || doc_id)[1:8] AS BIGINT) AS h FROM w LEFT JOIN mean ON id = doc_id),
    y AS (SELECT *, CAST(weight + floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM x),
    r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM y WHERE n_words >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN r <= 25 * (SELECT count(*) FROM r) // 100 THEN r END AS rank FROM y LEFT JOIN r USING (doc_id)
    """,
)
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents of 20 words and more, drawn towards the benchmark's words."""
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_FIELD_SQL = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode(CAST({0} AS VARCHAR))) || ':' || {0} END"


def _leaf_sql(n_chars: str = "n_chars") -> str:
    return f"sha256({' || '.join(_FIELD_SQL.format(c) for c in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


@query(
    "op13_merkle_manifest",
    f"""
    WITH RECURSIVE crc AS ({_CRC_TABLE}),
    l AS (SELECT doc_id, lang, {_leaf_sql()} AS leaf, CASE WHEN {_crc_sql('encode(CAST(doc_id AS VARCHAR))')} % 7 = 0 THEN {_leaf_sql('(n_chars + 1)')} END AS other FROM documents, crc),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM l),
    up AS (SELECT lang, pos, n, leaf AS h, 0 AS level FROM r
           UNION ALL SELECT lang, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)), level + 1 FROM up WHERE n > 1 GROUP BY lang, pos // 2, n, level),
    sub AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
    top AS (SELECT pos, n, h, 0 AS level FROM sub
            UNION ALL SELECT pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)), level + 1 FROM top WHERE n > 1 GROUP BY pos // 2, n, level),
    step AS (SELECT r.doc_id, r.lang, 0 AS stage, up.level, CASE WHEN up.pos % 2 = 1 THEN up.h ELSE '' END AS a, CASE WHEN up.pos % 2 = 0 THEN up.h ELSE '' END AS z
             FROM r JOIN up ON r.lang IS NOT DISTINCT FROM up.lang AND up.n > 1 AND up.pos = xor(r.pos >> up.level, 1)),
    -- a sibling left of the node is one at an even place
    side AS (SELECT doc_id, stage, level, z AS before, a AS behind FROM step
             UNION ALL SELECT r.doc_id, 1, top.level, CASE WHEN top.pos % 2 = 0 THEN top.h ELSE '' END, CASE WHEN top.pos % 2 = 1 THEN top.h ELSE '' END
             FROM r JOIN sub ON r.lang IS NOT DISTINCT FROM sub.lang JOIN top ON top.n > 1 AND top.pos = xor(sub.pos >> top.level, 1)
             UNION ALL SELECT r.doc_id, 0, x.level, '', '' FROM r JOIN (SELECT DISTINCT lang, level, n FROM up WHERE n > 1 AND n % 2 = 1) x ON r.lang IS NOT DISTINCT FROM x.lang AND r.pos >> x.level = x.n - 1
             UNION ALL SELECT r.doc_id, 1, x.level, '', '' FROM r JOIN sub ON r.lang IS NOT DISTINCT FROM sub.lang JOIN (SELECT DISTINCT level, n FROM top WHERE n > 1 AND n % 2 = 1) x ON sub.pos >> x.level = x.n - 1),
    path AS (SELECT doc_id, list(before ORDER BY stage, level) AS b, list(behind ORDER BY stage, level) AS c, string_agg(before || behind, '' ORDER BY stage, level) AS proof FROM side GROUP BY doc_id),
    fold AS (SELECT r.doc_id, 0 AS i, coalesce(other, leaf) AS h FROM r
             UNION ALL SELECT fold.doc_id, i + 1, sha256(b[i + 1] || h || c[i + 1]) FROM fold JOIN path USING (doc_id) WHERE i < len(b)),
    folded AS (SELECT doc_id, max_by(h, i) AS folded_root FROM fold GROUP BY doc_id)
    SELECT r.doc_id, leaf, sub.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = (SELECT h FROM top WHERE n = 1) AS verified
    FROM r JOIN sub ON r.lang IS NOT DISTINCT FROM sub.lang JOIN folded USING (doc_id) LEFT JOIN path ON path.doc_id = r.doc_id
    """,
)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents by language, and the check with every seventh one tampered with."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in fields]
    picked = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), fields, "lang", "doc_id", tampered, picked).drop("path")
