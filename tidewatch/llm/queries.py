"""The operators as queries over the sample tables, and SQL for those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, conversations, decontaminate, embeddings, html, line_dedup, packing, quality, secret_parts, simhash, token_files, tokens, toxicity, warc
from .common import stored, table

END_OF_PACKED, END_OF_ENCODED = 1, 2


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives, and read back through the index of captures."""
    shards = warc.archive(spark, table(spark, sf_dir, "pages"))
    records = warc.read_records(warc.all_captures(shards), with_payload=False).drop("payload")
    return warc.resolve_revisits(stored(records, "warc-records")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2,048 tokens."""
    return packing.pack(
        table(spark, sf_dir, "documents"), tokens.tokenizer_path(tokens.BYTE_BPE), END_OF_PACKED, with_ids=False
    )


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every line of all documents."""
    found = line_dedup.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "line_no", "class_doc_id", "class_line_no", "kept")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with a copy of a benchmark item, and where it stands."""
    found = decontaminate.copies(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "score", "start", "end")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html.extract(table(spark, sf_dir, "pages"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all vectors."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to files and read back."""
    docs = table(spark, sf_dir, "documents")
    return token_files.token_files(spark, docs, tokens.tokenizer_path(tokens.WORD_BPE), END_OF_ENCODED)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, weak ones where their other parts are near."""
    return secret_parts.scan(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first phrases of each language by their weakest cut."""
    found = collocations.collocations(table(spark, sf_dir, "documents"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of all conversations, damaged before."""
    return conversations.repair(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_simhash, op2_warc, op3_packing, op4_lines, op5_decontamination, op6_html, op7_embeddings,
        op8_token_files, op9_toxicity, op10_quality, op11_secrets, op12_collocations, op13_conversations,
    )
}
ORACLES: dict[str, str] = {
    # The digest in base32: five hex digits of the SHA-1 are twenty bits, four characters.
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS h FROM p),
        f AS (SELECT h, payload_bytes, min(page_id) AS first_id FROM d GROUP BY ALL)
        SELECT page_id, d.payload_bytes AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '')
                   AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM d JOIN f USING (h, payload_bytes)
    """,
    "op7_embeddings": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
        ), ok AS (
            SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND vec_id IS NOT NULL
               AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
            ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98
        ), reach AS (
            SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        ), c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
        n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM v JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a
    """,
    "op12_collocations": r"""
        WITH t AS (
            SELECT coalesce(lang, 'und') AS lang,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
        ), pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
        p AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS words FROM pieces),
        totals AS (SELECT lang, sum(len(words)) AS n FROM p GROUP BY lang),
        g AS (
            SELECT lang, size, list_slice(words, pos, pos + size - 1) AS ws, count(*) AS f
            FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS pos
                  FROM p, (SELECT unnest(range(1, 6)) AS size))
            GROUP BY ALL HAVING count(*) >= 100
        ), covered AS (
            SELECT DISTINCT lang, unnest([list_slice(ws, 1, size - 1), list_slice(ws, 2, size)]) AS ws, f FROM g WHERE size > 2
        ), cuts AS (
            SELECT lang, ws, size, f AS a, unnest(range(1, size)) AS k FROM g WHERE size > 1
        ), scored AS (
            SELECT c.lang, c.ws, c.a, c.k, l.f AS l, r.f AS r, n,
                   (1000::HUGEINT * c.a * n // (l.f::HUGEINT * r.f))::BIGINT AS score
            FROM cuts c JOIN totals USING (lang)
            JOIN g l ON l.lang = c.lang AND l.ws = list_slice(c.ws, 1, k)
            JOIN g r ON r.lang = c.lang AND r.ws = list_slice(c.ws, k + 1, c.size)
        ), weakest AS (
            SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1
        ), named AS (
            SELECT lang, array_to_string(w.ws, ' ') AS phrase, a, l, r, n, score FROM weakest w
            WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.lang = w.lang AND c.ws = w.ws AND c.f = w.a)
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
               phrase, a, l, r, n::BIGINT AS n, score
        FROM named QUALIFY rank <= 2000
    """,
}
