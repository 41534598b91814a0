"""The corpus operators' queries over the test tables, with the SQL that gives the same results."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm import bpe, chat, classifier, divergence, exact_dedup, html, langid, minhash, packing, quality_rules, token_counts, vector_codes, warc
from peakloom.llm.shared import bucket_of, table, text_of, words_of
from peakloom.storage import folder, written


def _held_out(modulus: int, rest: int):
    """Whether the row's crc32 bucket is the one kept from learning; a null id counts as the empty text."""
    return bucket_of(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), modulus) == rest


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs, ~_held_out(4, 2)))
    return found.select("doc_id", _held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = classifier.fit(docs, table(spark, sf_dir, "labels"), ~_held_out(3, 1))
    return classifier.score(docs, model).select("doc_id", _held_out(3, 1).alias("held_out"), "score", "predicted")


def op3_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op4_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op4_struck_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.struck_texts(table(spark, sf_dir, "documents")).select("doc_id", "source", "text")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), decoded=True)
    return ids.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


#: Two tokenizer versions: a vocabulary's name and its file.
TOKENIZERS = {"byte_bpe_50k": "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k": "byte_bpe_multi_50k.tiktoken"}


def _of(rows: DataFrame, count: str, version: str) -> DataFrame:
    return rows.select("source", "lang", F.lit(version).alias("version"), F.col(count).alias("tokens"))


def op10_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents of at least 20 words under two tokenizer versions.

    All documents come in under both versions, under the first with an estimate from their bytes; the short ones are
    deleted, the estimates revised to the counts, the ledger compacted, and a batch is replayed.
    """
    text = text_of(F.col("text"))
    docs = table(spark, sf_dir, "documents").select(
        "source", "lang", text.alias("text"), F.size(words_of(text)).alias("n_words"), F.floor(F.octet_length(text) / 4).cast("long").alias("estimate")
    )
    paths = {version: public_tokenizers.path(name) for version, name in TOKENIZERS.items()}
    counts = written(token_counts.counted(docs, paths, keep=("source", "lang", "n_words", "estimate")), "token-counts")
    first, second = TOKENIZERS
    short, left = counts.where("n_words < 20"), counts.where("n_words >= 20")
    ledger = token_counts.TokenLedger(spark)
    ledger.commit("estimates", token_counts.inserts(_of(counts, "estimate", first)))
    ledger.commit("second", token_counts.inserts(_of(counts, second, second)))
    ledger.commit("short", token_counts.deletes(_of(short, "estimate", first).unionByName(_of(short, second, second))))
    ledger.compact()
    ledger.commit("counts", token_counts.revisions(_of(left, "estimate", first), _of(left, first, first)))
    ledger.commit("second", token_counts.inserts(_of(counts, second, second)))
    return ledger.rollup()


def op10_word_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ledger over counts that SQL can express: words, revised to words with a letter, and bytes."""
    text = text_of(F.col("text"))
    found = table(spark, sf_dir, "documents").select("source", "lang", text.alias("text"), words_of(text).alias("words"))
    counts = written(
        found.select(
            "source", "lang", F.size("words").cast("long").alias("words_1"),
            F.size(F.filter("words", lambda w: w.rlike(r"\p{L}"))).cast("long").alias("words_2"),
            F.octet_length("text").cast("long").alias("bytes_1"),
        ),
        "token-counts",
    )
    of = lambda rows, version: _of(rows, version, version)
    short, long = counts.where("words_1 < 20"), counts.where("words_1 >= 20")
    ledger = token_counts.TokenLedger(spark)
    ledger.commit("words", token_counts.inserts(of(counts, "words_1")))
    ledger.commit("bytes", token_counts.inserts(of(counts, "bytes_1")))
    ledger.commit("short", token_counts.deletes(of(short, "words_1").unionByName(of(short, "bytes_1"))))
    ledger.commit("letters", token_counts.revisions(of(long, "words_1"), of(long, "words_2")))
    ledger.commit("bytes", token_counts.inserts(of(counts, "bytes_1")))
    return ledger.rollup()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' archives read back: an inventory of their records."""
    pages, to = table(spark, sf_dir, "pages"), folder(spark, "archives")
    warc.write_archives(pages, to)
    found = warc.inventory(warc.read_archives(spark, to))
    kind = dict(pages.dtypes)["page_id"]
    return found.select(F.col("key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def queries() -> dict:
    return {
        "op1_near_duplicates": op1_near_duplicates,
        "op2_language_id": op2_language_id,
        "op3_perspectives": op3_perspectives,
        "op4_line_frequency": op4_line_frequency,
        "op4_struck_texts": op4_struck_texts,
        "op5_main_text": op5_main_text,
        "op6_quality": op6_quality,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_best_fit": op9_best_fit,
        "op10_token_rollups": op10_token_rollups,
        "op10_word_rollups": op10_word_rollups,
        "op11_vector_codes": op11_vector_codes,
        "op12_source_divergence": op12_source_divergence,
        "op13_warc": op13_warc,
    }


def _vector_codes_sql(rounds: int = 6) -> str:
    """Every round as a table of assignments (distance times 16, plus entry) and a table of codebooks."""
    text = """
        WITH k AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
                   FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT v, row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS e FROM (SELECT vec_id, min(v) AS v FROM k GROUP BY vec_id)
              ORDER BY vec_id NULLS LAST LIMIT 16),
        x AS MATERIALIZED (SELECT r, p, v[p * (len(v) // 8) + 1:(p + 1) * (len(v) // 8)] AS x FROM k, range(8) AS t(p)),
        c0 AS MATERIALIZED (SELECT p, e, v[p * (len(v) // 8) + 1:(p + 1) * (len(v) // 8)] AS c FROM s, range(8) AS t(p))"""
    assign = """,
        a{i} AS MATERIALIZED (SELECT r, x.p, any_value(x) AS x, min(list_sum(list_transform(list_zip(x, c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT * 16 + e) AS m
                FROM x JOIN c{i} ON x.p = c{i}.p GROUP BY r, x.p)"""
    move = """,
        m{j} AS (SELECT p, m % 16 AS e, i, CAST(sum(x[i]) AS BIGINT) AS t, count(*) AS n FROM a{i}, range(1, 1 + (SELECT max(len(x)) FROM x)) AS u(i) GROUP BY ALL),
        n{j} AS (SELECT p, e, list((t - ((t % n) + n) % n) // n ORDER BY i) AS c FROM m{j} GROUP BY p, e),
        c{j} AS MATERIALIZED (SELECT p, e, coalesce(n{j}.c, c{i}.c) AS c FROM c{i} LEFT JOIN n{j} USING (p, e))"""
    for i in range(rounds):
        text += (assign + move).format(i=i, j=i + 1)
    return text + (assign + """,
        f AS (SELECT r, string_agg(printf('%02x', m % 16), '' ORDER BY p) AS code, CAST(sum(m // 16) AS BIGINT) AS error FROM a{i} GROUP BY r),
        h AS (SELECT sha256(string_agg(c, ',' ORDER BY p, e)) AS h FROM (SELECT p, e, array_to_string(c, ',') AS c FROM c{i}))
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
        FROM k JOIN f USING (r), h""").format(i=rounds)


SQL = {
    "op11_vector_codes": _vector_codes_sql(),
    "op13_warc": """
        WITH t AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS first FROM t)
        SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   ((CAST('0x' || substr(h, 1 + CAST(5 * i // 4 AS INTEGER), 2) AS INTEGER) >> CAST(3 - 5 * i % 4 AS INTEGER)) & 31) + 1, 1)), '') AS payload_digest,
               CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f""",
    "op12_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        e AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM e GROUP BY ALL),
        k AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY lang, term HAVING sum(docs) >= 30),
        v AS (SELECT lang, count(*) AS v, CAST(sum(total) AS BIGINT) AS nl FROM k GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        gt AS (SELECT lang, source, term, total, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
        p AS MATERIALIZED (SELECT lang, source, term, n, CAST(1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS BIGINT) AS p,
                    CAST(1 + (1000000000 * (total + 5)) // (nl + 5 * v) AS BIGINT) AS q FROM gt JOIN v USING (lang)),
        s AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value
              FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
              UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
        SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM o
        QUALIFY part = 'pair' OR rank <= 50""",
    "op3_perspectives": r"""
        WITH t AS (SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS speaker,
                          replace(coalesce(text, ''), '<|', '< |') AS said FROM conversations),
        s AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM t),
        r AS (SELECT conv_id, perspective, turn, speaker, said, speaker = perspective AS own,
                     CASE WHEN speaker = perspective THEN '<|assistant|>' ELSE '<|user name="' || replace(replace(speaker, '"', '\"'), '|>', '| >') || '"|>' END AS head
              FROM t JOIN s ON conv_id IS NOT DISTINCT FROM c),
        g AS (SELECT *, head || said || '<|end|>' || chr(10) AS segment FROM r),
        p AS (SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective
                     ORDER BY turn NULLS FIRST, speaker, said ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seg_end FROM g)
        SELECT conv_id, perspective, turn, speaker, segment, seg_end - length(segment) AS seg_start, seg_end,
               CASE WHEN own THEN seg_end - length(segment) + length(head) ELSE seg_end END AS mask_start, seg_end AS mask_end
        FROM p""",
    "op4_line_frequency": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
        x AS (SELECT r, unnest(generate_series(1, len(words) - 7)) AS i, words FROM w WHERE len(words) >= 8),
        y AS (SELECT r, i, array_to_string(words[i:i + 7], chr(31)) AS g FROM x),
        z AS (SELECT r, i FROM y QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
        c AS (SELECT r, least(8, i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -8)) AS n FROM z),
        rep AS (SELECT r, sum(n) AS n_repeat FROM c GROUP BY r),
        l AS (SELECT r, doc_id, source, text, CAST('0x' || substr(md5(text), 1, 15) AS BIGINT) AS content, unnest(string_split(text, chr(10))) AS raw FROM d),
        k AS (SELECT *, lower(trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line FROM l),
        m AS (SELECT * FROM k WHERE line <> ''),
        dup AS (SELECT r, count(*) - count(DISTINCT raw) AS n_dup FROM m GROUP BY r),
        f AS (SELECT source, line, first(doc_id ORDER BY doc_id NULLS LAST, content) AS first_id, first(content ORDER BY doc_id NULLS LAST, content) AS first_content
              FROM m GROUP BY source, line HAVING count(DISTINCT text) > 20),
        st AS (SELECT m.r, sum(length(m.line) - length(replace(m.line, ' ', '')) + 1) AS n_struck
               FROM m JOIN f ON m.source IS NOT DISTINCT FROM f.source AND m.line = f.line AND (m.doc_id IS DISTINCT FROM f.first_id OR m.content <> f.first_content) GROUP BY m.r),
        b AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
                     CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
                     CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
                     CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
                     CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words,
                     CAST(coalesce(n_struck, 0) AS BIGINT) AS n_struck_words
              FROM w LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN st USING (r)),
        v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
        SELECT *, NOT base_failed AND NOT (n_struck_words > 0 AND n_words - n_struck_words < 0.2 * n_words) AS kept FROM v""",
    "op4_struck_texts": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text AS given, coalesce(text, '') AS text FROM documents),
        l AS (SELECT r, doc_id, source, text, CAST('0x' || substr(md5(text), 1, 15) AS BIGINT) AS content,
                     unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
        k AS (SELECT *, lower(trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line FROM l),
        f AS (SELECT source, line, first(doc_id ORDER BY doc_id NULLS LAST, content) AS first_id, first(content ORDER BY doc_id NULLS LAST, content) AS first_content
              FROM k WHERE line <> '' GROUP BY source, line HAVING count(DISTINCT text) > 20),
        s AS (SELECT k.r, k.pos, k.raw, f.line IS NOT NULL AND (k.doc_id IS DISTINCT FROM f.first_id OR k.content <> f.first_content) AS struck
              FROM k LEFT JOIN f ON k.source IS NOT DISTINCT FROM f.source AND k.line = f.line),
        t AS (SELECT r, bool_or(struck) AS hit, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT struck), '') AS rest FROM s GROUP BY r)
        SELECT doc_id, source, CASE WHEN hit THEN rest ELSE given END AS text FROM d LEFT JOIN t USING (r)""",
    "op7_exact_dedup": """
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(n.t) AS text_sha256
        FROM n JOIN g ON n.t = g.t""",
    "op10_word_rollups": r"""
        WITH d AS (SELECT source, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        k AS (SELECT source, lang, len(list_filter(words, lambda w: regexp_matches(w, '\p{L}'))) AS words_2, octet_length(encode(text)) AS bytes_1
              FROM d WHERE len(words) >= 20),
        b AS (SELECT source, lang, 'words_2' AS version, words_2 AS tokens FROM k
              UNION ALL SELECT source, lang, 'bytes_1', bytes_1 FROM k),
        t AS (SELECT source, lang, version, count(*) AS n_docs, CAST(sum(tokens) AS BIGINT) AS n_tokens FROM b GROUP BY ALL)
        SELECT 'source_lang' AS level, source, lang, version, n_docs, n_tokens FROM t
        UNION ALL SELECT 'source', source, NULL, version, CAST(sum(n_docs) AS BIGINT), CAST(sum(n_tokens) AS BIGINT) FROM t GROUP BY source, version
        UNION ALL SELECT 'lang', NULL, lang, version, CAST(sum(n_docs) AS BIGINT), CAST(sum(n_tokens) AS BIGINT) FROM t GROUP BY lang, version
        UNION ALL SELECT 'all', NULL, NULL, version, CAST(sum(n_docs) AS BIGINT), CAST(sum(n_tokens) AS BIGINT) FROM t GROUP BY version""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
