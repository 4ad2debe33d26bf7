"""The queries of this subpackage, over whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import alignment, brown, decontaminate, langid, nearvec, packing, private, ranked, sharding, simhash, substring, urlfilter, warc
from lumenfold.llm.common import held_out, shared_dir, table

TOKENIZER = "word_bpe_49k.json"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4,096 tokens. Null texts are their end token; repeated rows are documents of their own. Every token bears loss here; ``packing.pack_conversations`` tells them apart."""
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, ``und`` without a letter. Null texts, null languages and repeated rows are rows like others."""
    docs = table(spark, sf_dir, "documents")
    languages, model = langid.train(docs, ~held_out("doc_id", 4, 2))
    out = langid.predict(docs, languages, model, ["doc_id"])
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.93 within a label. Null labels, null, zero and non-finite vectors link with nothing; repeated rows are vectors of their own."""
    return nearvec.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_brown_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and class scores of every text. A null text is its end alone; null ids are scored and not learned from; repeated rows count each."""
    scored = brown.train_and_score(table(spark, sf_dir, "documents"), ~held_out("doc_id", 5, 1))
    return scored.select("doc_id", held_out("doc_id", 5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old layout: 32 shards by a hash of the source, as uneven as the sources are."""
    docs = table(spark, sf_dir, "documents").withColumn("old_shard", F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(32)).cast("int"))
    rows, _ = sharding.reshard(docs, 40)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + sharding.ROW_BYTES
    return rows.select("doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that benchmark windows cover. Null texts have no words; null items are never found; repeated rows are judged alike."""
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left after repeated windows of 20 are gone. Null texts have none; repeated rows are one document; null ids come last."""
    out = substring.without_repeats(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page. A null url has neither host nor path and is judged by the model; repeated rows alike."""
    return urlfilter.url_verdicts(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "p_block")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives say after a round trip. Null html is an empty payload; null ids are responses; repeated rows are repeated records."""
    path = shared_dir(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document. Null and blank texts have fingerprint 0; repeated rows are repeated."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", simhash.hex16().alias("fingerprint"), "component_id")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of every text under two vocabularies. Null and empty texts have none; repeated rows are documents of their own and count each."""
    a, ranks, b = map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
    return alignment.cross_tokenizer(table(spark, sf_dir, "documents"), a, b, ["doc_id"], ranks, public_tokenizers.PATTERN)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's fifty best documents. Null texts are never found; repeated documents are ranked each, repeated items once."""
    return ranked.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every text, and the words that disclose it. Null texts have none; repeated rows are documents of their own."""
    found = private.find(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(private.said(private.base_only(F.col("spans"))), 256).alias("base_sha256"), private.said(F.col("spans")).alias("spans"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_language_id, op3_near_vectors, op4_brown_score, op5_sharding, op6_decontamination, op7_substring_dedup, op8_url_filter, op9_warc, op10_simhash, op11_alignment, op12_ranked_search, op13_private_data)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

SQL: dict[str, str] = {
    "op3_near_vectors": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
        u AS (
            SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v
            WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(e, e) > 0),
        half AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id < b.vec_id
            WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
        link AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
        reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
        component AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
        FROM v JOIN component c USING (vec_id) LEFT JOIN (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a) n USING (vec_id)""",
    "op6_decontamination": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark),
        bn AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
        bi AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bn),
        bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bi),
        di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bn) WHERE len(w) >= n),
        dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM di),
        hit AS (SELECT DISTINCT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
        covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit),
        nh AS (SELECT doc_id, count(*) AS n_hit FROM covered GROUP BY doc_id),
        ni AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
               FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN ni USING (doc_id)""",
    "op7_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        di AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
        g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS r FROM di),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM g WHERE r > 1),
        words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
        kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
        f AS (SELECT h, min(page_id) AS m FROM p GROUP BY h)
        SELECT page_id, strlen(h) AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   (((('0x' || substr(s, (i // 4) * 5 + 1, 5))::BIGINT >> ((3 - i % 4) * 5)::BIGINT) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
               CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to
        FROM p JOIN f USING (h)""",
    "op12_ranked_search": f"""
        WITH p AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
        d AS (SELECT r, doc_id, w, len(w) AS n FROM p WHERE len(w) > 0),
        c AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
        i AS (SELECT DISTINCT item_id, unnest(list_distinct(regexp_extract_all({_LOWER}, {_ALNUM}))) AS t FROM benchmark),
        x AS (SELECT r, doc_id, n, unnest(w) AS t FROM d),
        f AS (SELECT r, doc_id, n, t, count(*) AS tf FROM x WHERE t IN (SELECT t FROM i) GROUP BY ALL),
        w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, c GROUP BY t, n_docs),
        s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
              FROM f JOIN w USING (t) JOIN i USING (t), c GROUP BY ALL)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
        FROM s WHERE score > 0 QUALIFY rank <= 50""",
}
