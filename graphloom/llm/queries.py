"""Queries of the training-data problems over the driver's tables, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import (
    contamination,
    cooccurrence,
    format_duplicates,
    frequencies,
    lookalikes,
    set_overlap,
    similar_sets,
    tokenizer,
)
from graphloom.plans.tables import table


#: Folder with the public tokenizers' vocabulary files, on every executor.
TOKENIZERS = "/opt/tokenizers"


def _annotations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "term_element_edges", "term", "element")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Terms and elements too rare or too common to tell anything."""
    counted = frequencies.value_frequencies(_annotations(spark, folder))
    return counted.where(F.col("mark").isNotNull()).select("field_name", "field_value", "mark")


def p1_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and records of every term and element."""
    return frequencies.value_frequencies(_annotations(spark, folder))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Elements listed together at least ten times as often as their frequencies let expect."""
    found = cooccurrence.cooccurring_items(_annotations(spark, folder), least_together=5, least_lift=10)
    return found.select(F.col("item_a").alias("element_a"), F.col("item_b").alias("element_b"))


def p2_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of elements with five common terms, with lift and corrected log odds."""
    found = cooccurrence.cooccurring_items(_annotations(spark, folder), least_together=5)
    return found.withColumns({"lift": F.round("lift", 6), "log_odds": F.round("log_odds", 6)})


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the edge list that repeat an earlier edge in another spelling."""
    copies = format_duplicates.edge_copies(table(spark, folder, "edge_list", "edge_id", "vertex1", "vertex2"))
    found = copies.where(F.col("key") != F.col("first_key"))
    return found.select(F.col("first_key").alias("first_edge_id"), F.col("key").alias("copy_edge_id"))


def p3_edges(spark: SparkSession, folder: str) -> DataFrame:
    """One row per edge, with its number of copies."""
    edges = format_duplicates.distinct_edges(table(spark, folder, "edge_list", "edge_id", "vertex1", "vertex2"))
    return edges.select(F.col("key").alias("edge_id"), "copies")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Large terms that share at least half the elements of the smaller one."""
    found = set_overlap.set_overlaps(_annotations(spark, folder), least=100)
    found = found.where(F.col("shared") * 2 >= F.least("n_a", "n_b"))
    return found.select(F.col("set_a").alias("term_a"), F.col("set_b").alias("term_b"))


def p4_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Common elements of every two large terms that share any."""
    return set_overlap.set_overlaps(_annotations(spark, folder), least=100)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Terms whose sets of elements are nearly the same."""
    found = similar_sets.similar_keys(_annotations(spark, folder), threshold=0.7, least_size=4)
    return found.select(F.col("key_a").alias("term_a"), F.col("key_b").alias("term_b"))


def p7_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every term of four elements or more with its class of identical sets and its links."""
    _, membership = similar_sets.similar_sets(_annotations(spark, folder), threshold=0.7, least_size=4)
    return membership


def p8_ids(spark: SparkSession, folder: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Token ids of every page."""
    pages = table(spark, folder, "documents", "doc_id", "text")
    return tokenizer.encode_texts(pages, f"{tokenizers}/byte_bpe_50k.tiktoken")


def p8_round_trip(spark: SparkSession, folder: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Every page's text decoded from its ids."""
    path = f"{tokenizers}/byte_bpe_50k.tiktoken"
    coded = tokenizer.encode_texts(table(spark, folder, "documents", "doc_id", "text"), path)
    return tokenizer.decode_texts(coded, path)


def p8_offsets(spark: SparkSession, folder: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Code points that the slices of every page cover, and whether they have all its ids."""
    pages = table(spark, folder, "documents", "doc_id", "text")
    coded = tokenizer.encode_texts(pages, f"{tokenizers}/byte_bpe_50k.tiktoken", offsets=True)

    def total(numbers: str) -> Column:
        return F.aggregate(numbers, F.lit(0).cast("long"), lambda s, x: s + x)

    return coded.select(
        "doc_id", total("slice_chars").alias("n_chars"), (total("slice_ids") == F.size("ids")).alias("complete")
    )


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that reprint a passage of a test item."""
    return p9_reprints(spark, folder).select("doc_id", "item_id")


def p9_reprints(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that reprint a passage of a test item, with the length of the longest stretch."""
    pages = table(spark, folder, "documents", "doc_id", "text", "boxes")
    items = table(spark, folder, "benchmark", "item_id", "passage")
    found = contamination.leaked_items(pages, items)
    return found.select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), "n_words")


def p9_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Passages that hold twelve consecutive words of a passage, their own or another: reprints without damage."""
    items = table(spark, folder, "benchmark", "item_id", "passage")
    pages = items.withColumn("boxes", F.lit(None).cast("array<struct<x0:int,y0:int,x1:int>>"))
    found = contamination.leaked_items(pages, items, key="item_id", text="passage")
    return found.select(F.col("key").alias("page_id"), F.col("item").alias("item_id"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pages whose texts look the same but are different strings."""
    found = lookalikes.alike_pairs(table(spark, folder, "documents", "doc_id", "text"))
    return found.select(F.col("key_a").alias("doc_id_a"), F.col("key_b").alias("doc_id_b"))


def p10_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """Every page with the first page that looks the same."""
    found = lookalikes.canonical_rows(table(spark, folder, "documents", "doc_id", "text"))
    return found.select(F.col("key").alias("doc_id"), F.col("canonical_key").alias("canonical_doc_id"))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            p1_found,
            p1_frequencies,
            p2_found,
            p2_pairs,
            p3_found,
            p3_edges,
            p4_found,
            p4_overlaps,
            p7_found,
            p7_classes,
            p8_ids,
            p8_round_trip,
            p8_offsets,
            p9_found,
            p9_reprints,
            p9_passages,
            p10_found,
            p10_canonical,
        )
    }


_BLANK = r"[\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*"
_PAIRS = f"""
WITH p AS (SELECT term, element, count(*) AS n FROM term_element_edges
           WHERE NOT regexp_full_match(term, '{_BLANK}') AND NOT regexp_full_match(element, '{_BLANK}') GROUP BY 1, 2)"""
_FREQUENCIES = (
    _PAIRS
    + """,
d AS (SELECT count(DISTINCT term) AS terms, count(DISTINCT element) AS elements FROM p),
f AS (SELECT 'term' AS field_name, term AS field_value, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_records,
             CASE WHEN count(*) = 1 THEN 'rare' WHEN count(*) * 10 >= (SELECT elements FROM d) THEN 'common' END AS mark
      FROM p GROUP BY term
      UNION ALL
      SELECT 'element', element, CAST(sum(n) AS BIGINT), count(*),
             CASE WHEN count(*) = 1 THEN 'rare' WHEN count(*) * 10 >= (SELECT terms FROM d) THEN 'common' END
      FROM p GROUP BY element)
"""
)
_TOGETHER = (
    _PAIRS
    + """,
s AS (SELECT term, element FROM p WHERE term IN (SELECT term FROM p GROUP BY term HAVING count(*) <= 100)),
n AS (SELECT element, count(*) AS k FROM s GROUP BY element HAVING count(*) >= 5),
v AS (SELECT s.term, s.element, n.k FROM s JOIN n USING (element)),
j AS (SELECT a.element AS item_a, b.element AS item_b, any_value(a.k) AS n_a, any_value(b.k) AS n_b,
             count(*) AS n_together, (SELECT count(DISTINCT term) FROM s) AS n_all
      FROM v a JOIN v b ON a.term = b.term AND a.element < b.element GROUP BY 1, 2 HAVING count(*) >= 5)
"""
)
_EDGES = r"""
WITH b AS (SELECT edge_id, lower(regexp_replace(vertex1, '[\p{P}\p{Z}\p{Cc}\p{Cf}]', '', 'g')) AS v,
                  lower(regexp_replace(vertex2, '[\p{P}\p{Z}\p{Cc}\p{Cf}]', '', 'g')) AS w FROM edge_list),
g AS (SELECT edge_id, min(edge_id) OVER (PARTITION BY least(v, w), greatest(v, w)) AS first_edge_id,
             count(*) OVER (PARTITION BY least(v, w), greatest(v, w)) AS copies
      FROM b WHERE v <> '' AND w <> '')
"""
_OVERLAPS = (
    _PAIRS
    + """,
z AS (SELECT term, count(*) AS size FROM p GROUP BY term HAVING count(*) >= 100),
l AS (SELECT p.term, p.element, z.size FROM p JOIN z USING (term)),
o AS (SELECT a.term AS set_a, b.term AS set_b, any_value(a.size) AS n_a, any_value(b.size) AS n_b, count(*) AS shared
      FROM l a JOIN l b ON a.element = b.element AND a.term < b.term GROUP BY 1, 2)
"""
)
# prefix filter: a similar pair shares one of the rarest elements of either set
_SIMILAR = (
    _PAIRS
    + """,
z AS (SELECT term, count(*) AS size FROM p GROUP BY term HAVING count(*) >= 4),
e AS (SELECT element, count(*) AS k FROM p GROUP BY element),
r AS (SELECT p.term, p.element, z.size, row_number() OVER (PARTITION BY p.term ORDER BY e.k, p.element) AS pos
      FROM p JOIN z USING (term) JOIN e USING (element)),
x AS (SELECT * FROM r WHERE pos <= size - (size * 7 + 9) // 10 + 1),
c AS (SELECT DISTINCT a.term AS term_a, b.term AS term_b, a.size AS n_a, b.size AS n_b
      FROM x a JOIN x b ON a.element = b.element AND a.term < b.term
      WHERE least(a.size, b.size) * 10 >= greatest(a.size, b.size) * 7),
o AS (SELECT term_a, term_b, n_a, n_b, count(*) AS shared
      FROM c JOIN p s ON s.term = term_a JOIN p t ON t.term = term_b AND t.element = s.element GROUP BY 1, 2, 3, 4),
m AS (SELECT term_a, term_b, n_a + n_b - shared = shared AS twin FROM o WHERE shared * 10 >= (n_a + n_b - shared) * 7)
"""
)


# fixed values, written apart from the operator's own tables: letters of one shape, their accented forms,
# full-width forms (code points of ASCII plus 0xFEE0), single spaces, characters without width
_LETTERS = "АВЕЅІЈКМНОРСТУХаеѕіјорсухΑΒΕΖΗΙΚΜΝΟΡΤΥΧορνГПФЀЁЇЌѐёїΆΈΊΌΎΪΫόӐӒӖӢӦӮӰӑӓӗӧӯӱ"
_AS_LETTERS = "ABESIJKMHOPCTYXaesijopcyxABEZHIKMNOPTYXopvΓΠΦÈËÏḰèëïÁÉÍÓÝÏŸóĂÄĔ\u04e2ÖȲŸăäĕöȳÿ"
_FULL_WIDTH, _HALF_WIDTH = ("".join(map(chr, range(0x21 + shift, 0x7F + shift))) for shift in (0xFEE0, 0))
_SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_NO_WIDTH = "\u00ad\u034f\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff"
_SPELLED = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "Ĳ": "IJ", "ĳ": "ij"}
_SPELLED |= {"Ή": "H\u0301", "Ѓ": "Γ\u0301", "Ў": "Y\u0306", "ў": "y\u0306"}


def _shapes() -> str:
    """The look-alike form of every visible page, with the normalisation that SQL offers."""
    before = _LETTERS + _FULL_WIDTH + _SPACES + _NO_WIDTH
    after = (_AS_LETTERS + _HALF_WIDTH + " " * len(_SPACES)).replace("'", "''")
    text = "text"
    for c, letters in _SPELLED.items():
        text = f"replace({text}, '{c}', '{letters}')"
    return f"""
WITH k AS (SELECT doc_id, text, CASE WHEN regexp_matches(text, '[^\\p{{Z}}\\p{{Cc}}\\p{{Cf}}]')
             THEN nfc_normalize(translate({text}, '{before}', '{after}')) END AS s FROM documents)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p10_found": _shapes()
        + """SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b
FROM k a JOIN k b ON a.s = b.s AND a.doc_id < b.doc_id AND a.text <> b.text""",
        "p10_canonical": _shapes()
        + """SELECT doc_id, CASE WHEN s IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS canonical_doc_id
FROM k""",
        "p9_passages": r"""
WITH w AS (SELECT item_id, unnest(list_filter(list_transform(regexp_split_to_array(passage, '\s+'),
             lambda x: regexp_replace(lower(strip_accents(x)), '[^\p{L}\p{N}]', '', 'g')), lambda x: x <> '')) AS word,
             generate_subscripts(list_filter(list_transform(regexp_split_to_array(passage, '\s+'),
             lambda x: regexp_replace(lower(strip_accents(x)), '[^\p{L}\p{N}]', '', 'g')), lambda x: x <> ''), 1) AS i FROM benchmark),
g AS (SELECT item_id, string_agg(word, ' ') OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS words, i FROM w)
SELECT DISTINCT a.item_id AS page_id, b.item_id FROM g a JOIN g b USING (words) WHERE a.i >= 12 AND b.i >= 12""",
        "p8_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p8_offsets": "SELECT doc_id, CAST(coalesce(length(text), 0) AS BIGINT) AS n_chars, true AS complete FROM documents",
        "p1_found": _FREQUENCIES + "SELECT field_name, field_value, mark FROM f WHERE mark IS NOT NULL",
        "p1_frequencies": _FREQUENCIES + "SELECT * FROM f",
        "p2_found": _TOGETHER
        + "SELECT item_a AS element_a, item_b AS element_b FROM j WHERE n_together * n_all >= 10 * n_a * n_b",
        "p2_pairs": _TOGETHER
        + """SELECT *, round(n_together * CAST(n_all AS DOUBLE) / (CAST(n_a AS DOUBLE) * n_b), 6) AS lift,
round(ln((n_together + 0.5::DOUBLE) * (n_all - n_a - n_b + n_together + 0.5::DOUBLE)
   / ((n_a - n_together + 0.5::DOUBLE) * (n_b - n_together + 0.5::DOUBLE))), 6) AS log_odds FROM j""",
        "p3_found": _EDGES + "SELECT first_edge_id, edge_id AS copy_edge_id FROM g WHERE edge_id <> first_edge_id",
        "p3_edges": _EDGES + "SELECT edge_id, copies FROM g WHERE edge_id = first_edge_id",
        "p4_found": _OVERLAPS + "SELECT set_a AS term_a, set_b AS term_b FROM o WHERE shared * 2 >= least(n_a, n_b)",
        "p4_overlaps": _OVERLAPS + "SELECT * FROM o",
        "p7_found": _SIMILAR + "SELECT term_a, term_b FROM m",
        "p7_classes": _SIMILAR
        + """,
k AS (SELECT z.term AS key, least(z.term, coalesce(min(m.term_a), z.term)) AS class_key, z.size
      FROM z LEFT JOIN m ON m.term_b = z.term AND m.twin GROUP BY z.term, z.size),
l AS (SELECT class_key, count(DISTINCT other) AS links FROM (
        SELECT a.class_key, b.class_key AS other FROM m JOIN k a ON a.key = m.term_a JOIN k b ON b.key = m.term_b WHERE NOT twin
        UNION ALL
        SELECT b.class_key, a.class_key FROM m JOIN k a ON a.key = m.term_a JOIN k b ON b.key = m.term_b WHERE NOT twin)
      GROUP BY class_key)
SELECT k.key, k.class_key, k.size, coalesce(l.links, 0) AS links FROM k LEFT JOIN l USING (class_key)""",
    }
