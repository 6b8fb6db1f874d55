"""The registered queries of this subpackage, and their SQL where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .crf_quality import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mcd_rules import verdicts

    judged, v = verdicts(table(spark, sf_dir, "documents"))
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select("doc_id", *[F.col(f"{v}.{c}").alias(c) for c in columns])


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    records = round_trip(table(spark, sf_dir, "pages"))
    page = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).try_cast("long")
    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hyperminhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), threshold=0.85)


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_tree import score

    return score(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .grammar_secrets import scan

    return scan(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrase_index import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .compact_windows import near_duplicate_passages

    return near_duplicate_passages(table(spark, sf_dir, "documents"), classes=True)


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_tree import extract

    return extract(table(spark, sf_dir, "pages"))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_filters import identify

    return identify(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest

    return manifest(table(spark, sf_dir, "documents")).drop("leaf_index", "group_leaves")


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_quality, op2_quality_rules, op3_warc, op4_packing, op5_near_duplicates, op6_suffix_tree, op7_secrets, op8_decontamination,
        op9_passages, op10_main_text, op11_language, op12_whitening, op13_merkle,
    )
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE concat(octet_length(encode({value}::VARCHAR)), ':', {value}) END"


# crc32 of an id's digits: each digit is taken in, then shifted out in eight steps (-1).
_CRC = (
    "list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), "
    "lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)"
)

ORACLES = {
    "op3_warc": """
        WITH p AS (
          SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
        ), d AS (
          SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p
        ), h AS (
          SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS holder FROM d
        )
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN holder = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN holder = page_id THEN NULL ELSE holder END AS refers_to
        FROM h
    """,
    "op5_near_duplicates": rf"""
        WITH RECURSIVE w AS (
          SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), s AS (
          SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w]
                 ELSE list_distinct([w[i : i + 4] for i in range(1, len(w) - 3)]) END AS s
          FROM w
        ), n AS (
          SELECT doc_id, len(s) AS n_shingles FROM s
        ), e AS (
          SELECT doc_id, unnest(s) AS g FROM s
        ), o AS (
          SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM e AS a JOIN e AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
        ), links AS (
          SELECT a, b FROM o JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n_shingles + y.n_shingles - shared)
        ), reach(a, b) AS (
          SELECT doc_id, doc_id FROM n UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON r.b = l.a
        ), c AS (
          SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1
        )
        SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
    """,
    "op8_decontamination": rf"""
        WITH d AS (
          SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), i AS (
          SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), wins AS (
          SELECT DISTINCT item_id, unnest([w[k : k + 12] for k in range(1, greatest(len(w) - 12, 1) + 1)]) AS win FROM i WHERE len(w) > 0
        ), sizes AS (
          SELECT DISTINCT len(win) AS n FROM wins
        ), places AS (
          SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n
        ), found AS (
          SELECT doc_id, item_id, k, n FROM places JOIN wins ON wins.win = w[k : k + n - 1]
        ), hits AS (
          SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM found) GROUP BY 1
        ), items AS (
          SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY 1
        ), uw AS (
          SELECT win, row_number() OVER () AS num, list(item_id) AS items FROM wins GROUP BY win
        ), t AS (
          SELECT doc_id, unnest(w) AS term, unnest(range(0, len(w))) AS pos FROM d
        ), wt AS (
          SELECT num, unnest(win) AS term, unnest(range(0, len(win))) AS o, len(win) AS size FROM uw
        ), kinds AS (
          SELECT num, term, count(*) OVER (PARTITION BY num) AS kinds FROM (SELECT DISTINCT num, term FROM wt)
        ), pairs AS (
          SELECT doc_id, num FROM kinds JOIN (SELECT DISTINCT doc_id, term FROM t) USING (term) GROUP BY doc_id, num, kinds HAVING count(*) = kinds
        ), moved AS (
          SELECT p.doc_id, p.num, o, size, pos - o AS s FROM pairs AS p JOIN wt USING (num) JOIN t ON t.doc_id = p.doc_id AND t.term = wt.term
        ), cells AS (
          SELECT DISTINCT doc_id, num, o, size, unnest([floor(s / 10) * 2, floor((s + 5) / 10) * 2 + 1]) AS cell FROM moved
        ), close AS (
          SELECT DISTINCT doc_id, num FROM (SELECT doc_id, num FROM cells GROUP BY doc_id, num, size, cell HAVING count(*) = size)
        ), near AS (
          SELECT doc_id, count(DISTINCT item) AS n_near FROM (SELECT doc_id, unnest(items) AS item FROM close JOIN uw USING (num)) GROUP BY 1
        )
        SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated, coalesce(n_near, 0) AS n_near
        FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)
    """,
    "op13_merkle": f"""
        WITH RECURSIVE h AS (
          SELECT doc_id, n_chars, coalesce('=' || lang, '-') AS g, concat({_field('doc_id')}, {_field('source')}, {_field('lang')}) AS head, {_field('text')} AS tail,
                 coalesce(xor({_CRC}, 4294967295) % 7 = 0, false) AND n_chars IS NOT NULL AS hit
          FROM documents
        ), l AS (
          SELECT doc_id, g, sha256(concat(head, {_field('n_chars')}, tail)) AS leaf,
                 CASE WHEN hit THEN sha256(concat(head, {_field('(n_chars + 1)')}, tail)) ELSE sha256(concat(head, {_field('n_chars')}, tail)) END AS altered
          FROM h
        ), p AS (
          SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l
        ), t(g, h, nodes) AS (
          SELECT g, 0, list(leaf ORDER BY pos) FROM p GROUP BY g
          UNION ALL SELECT g, h + 1, list_transform(range(0, len(nodes), 2), lambda k: sha256(array_to_string(nodes[k + 1 : k + 2], ''))) FROM t WHERE len(nodes) > 1
        ), subs AS (
          SELECT g, nodes[1] AS subroot, row_number() OVER (ORDER BY g) - 1 AS gpos FROM t WHERE len(nodes) = 1
        ), u(h, nodes) AS (
          SELECT 0, list(subroot ORDER BY gpos) FROM subs
          UNION ALL SELECT h + 1, list_transform(range(0, len(nodes), 2), lambda k: sha256(array_to_string(nodes[k + 1 : k + 2], ''))) FROM u WHERE len(nodes) > 1
        ), steps AS (
          SELECT p.doc_id, p.g, pos, 0 AS tree, h, (pos >> h) % 2 AS side, nodes[xor(pos >> h, 1) + 1] AS other FROM p JOIN t USING (g) WHERE len(nodes) > 1
          UNION ALL
          SELECT p.doc_id, p.g, pos, 1, h, (gpos >> h) % 2, nodes[xor(gpos >> h, 1) + 1] FROM p JOIN subs USING (g), u WHERE len(nodes) > 1
        ), paths AS (
          SELECT g, pos, string_agg(coalesce(other, ''), '' ORDER BY tree, h) AS proof,
                 list(CASE WHEN other IS NULL THEN '-' WHEN side = 1 THEN 'L' || other ELSE 'R' || other END ORDER BY tree, h) AS path
          FROM steps GROUP BY g, pos
        ), f AS (
          SELECT p.doc_id, leaf, subroot, (SELECT nodes[1] FROM u WHERE len(nodes) = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
                 list_reduce(list_prepend(altered, coalesce(path, [])), lambda a, x: CASE x[1] WHEN 'L' THEN sha256(x[2:] || a) WHEN 'R' THEN sha256(a || x[2:]) ELSE sha256(a) END) AS folded_root
          FROM p JOIN subs USING (g) LEFT JOIN paths USING (g, pos)
        )
        SELECT *, folded_root = root AS verified FROM f
    """,
}
