"""Queries of the problems of training data, over the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.llm import boilerplate, bpe, fusion, mixing, neighbours, repeats, segments, sentences
from lodeseam.session import stored
from lodeseam.tables import current_rows, folded, load, strip


def _sited(spark: SparkSession, d: str, text: bool = False) -> DataFrame:
    """Current pages with their lines; superseded rows are not parsed."""
    rows = current_rows(load(spark, d, "pages"), source=folded(F.col("domain")), text=F.col("text"))
    return rows.select("id", "source", repeats.parsed(F.col("text")).alias("lines"), *["text"] * text)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """(id, line_no): lines repeated within a domain."""
    return repeats.repeated_lines(_sited(spark, d))


def p2_texts(spark: SparkSession, d: str) -> DataFrame:
    """(id, text): texts without those lines."""
    return repeats.without_repeats(_sited(spark, d, text=True))


def p2_templates(spark: SparkSession, d: str) -> DataFrame:
    """(source, template, wordings, docs)."""
    return repeats.templates(current_rows(load(spark, d, "pages"), source=folded(F.col("domain")), text=F.col("text")))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return current_rows(load(spark, d, "pages"), text=F.col("text")).withColumnRenamed("id", "page_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, seq): stored chunks that are too long, no part of their page, cut inside words or share too little or too much."""
    return segments.audit(load(spark, d, "chunks"), _texts(spark, d))


def p3_chunks(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, seq, text): the pieces of every page."""
    return segments.pieces(_texts(spark, d))


def p3_sound(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, several, chars, faults): what the pieces of p3_chunks hold of each text, and how many break a rule of p3_found."""
    texts = stored(_texts(spark, d), "texts")
    return segments.soundness(segments.pieces(texts), texts).select("page_id", (F.col("pieces") > 1).alias("several"), "chars", "faults")


def _fused(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fused(fusion.scores(load(spark, d, "search_result"), load(spark, d, "score_method")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, chunk_id): the first top_k of each query."""
    return fusion.best(_fused(spark, d), load(spark, d, "search_query")).select("query_id", "chunk_id")


def p4_ranking(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, chunk_id, total, n_methods) of all candidates."""
    return _fused(spark, d)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """(id_a, id_b): pairs of chunks with a cosine of at least 0.9."""
    return neighbours.pairs(load(spark, d, "chunks"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """(id, class_id, copies): classes of chunks with equal embeddings."""
    return neighbours.classes(load(spark, d, "chunks"))


def p5_nearest(spark: SparkSession, d: str) -> DataFrame:
    """(id, neighbour, cosine, place): the ten most similar chunks of each chunk whose id, read as a number, is divisible by 20."""
    chunks = load(spark, d, "chunks").select("id", "embedding")
    part = lambda i: F.conv(F.substring("id", 8 * i + 1, 8), 16, 10).cast("bigint")
    fives = part(0) + part(1) + part(2) + part(3)  # 16 ** 8 leaves 1 when divided by 5 and 0 by 4
    return neighbours.nearest(chunks, chunks.where((fives % 5 == 0) & (part(3) % 4 == 0)))


def _hosted(spark: SparkSession, d: str) -> DataFrame:
    return current_rows(load(spark, d, "pages"), source=folded(F.col("domain")), title=F.col("title"), text=F.col("text")).select(
        "*", boilerplate.subtrees(F.col("text")).alias("lines"), boilerplate.subtrees(F.col("title")).alias("heading")
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """(id, line_no): lines that are not main body."""
    return boilerplate.boilerplate_lines(_hosted(spark, d))


def p7_texts(spark: SparkSession, d: str) -> DataFrame:
    """(id, text): main bodies."""
    return boilerplate.main_bodies(_hosted(spark, d))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, ids) by byte_bpe_50k."""
    return bpe.encoded(load(spark, d, "documents").select("doc_id", "text"))


def _counted(spark: SparkSession, d: str) -> DataFrame:
    return stored(bpe.counted(load(spark, d, "documents").select("doc_id", "source", "text")), "tokens")


def _plan(spark: SparkSession, d: str, docs: DataFrame) -> DataFrame:
    return mixing.plan(docs, load(spark, d, "mix_target"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """(source): targets whose source is too small for its share."""
    return _plan(spark, d, _counted(spark, d)).where("short").select("source")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """(source, weight, mix_tokens, share) reached."""
    return mixing.shares(stored(_plan(spark, d, _counted(spark, d)), "mix"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the mix."""
    docs = _counted(spark, d)
    return mixing.select(docs, stored(_plan(spark, d, docs), "mix"))


def p9_sound(spark: SparkSession, d: str) -> DataFrame:
    """(source, within_cap, as_planned, exact): of the mix, whether no document of a source comes more often than it may, whether its tokens are
    those that p9_shares reports, and whether they are its share of the total to within a ten-thousandth if it has 30 documents or more."""
    docs = _counted(spark, d)
    plan = stored(_plan(spark, d, docs), "mix")
    got = mixing.select(docs, plan).groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("got"), F.max("copies").alias("most"))
    both = plan.select("source", mixing.key("source").alias("_key"), "max_repeats", "budget", "short").join(mixing.shares(plan).select("source", "mix_tokens"), "source")
    n = docs.groupBy(mixing.key("source").alias("_of")).agg(F.count("*").alias("n"))
    both = both.join(n, F.col("_key") == F.col("_of"), "left")
    both = both.join(got.withColumnRenamed("source", "_own"), F.col("_key") == F.col("_own"), "left")
    given = F.coalesce("got", F.lit(0))
    return both.select("source", (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_cap"), (given == F.col("mix_tokens")).alias("as_planned"), (F.col("short") | (F.coalesce("n", F.lit(0)) < 30) | (F.abs(given - F.col("budget")) <= F.col("budget") / 10_000)).alias("exact"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, start_char, end_char) of every sentence."""
    return sentences.split(load(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_texts, p2_templates, p3_found, p3_chunks, p3_sound, p4_found, p4_ranking, p5_found, p5_classes, p5_nearest, p7_found, p7_texts, p8_ids, p9_found, p9_shares, p9_mix, p9_sound, p10_found)}

_CURRENT = "cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY crawled_at DESC NULLS LAST, run_no DESC NULLS LAST) AS _rn FROM pages WHERE id IS NOT NULL) WHERE _rn = 1)"
_SCORED = """m AS (SELECT upper(trim(method)) AS method, CASE WHEN lower(better) = 'low' THEN 1 ELSE -1 END AS sign FROM score_method),
    s AS (SELECT query_id, chunk_id, m.method, min(score * sign) AS v FROM search_result r JOIN m ON m.method = upper(trim(r.method))
          WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
    f AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 12) AS total, count(*) AS n_methods
          FROM (SELECT *, CAST(rank() OVER (PARTITION BY query_id, method ORDER BY v) AS DOUBLE) AS rank FROM s) GROUP BY ALL)"""
_SPACE = r"[\t\x0b\f\r\x1c-\x1f\x{85}\p{Z}]+"

_LINES = f"""{_CURRENT},
    docs AS (SELECT id, upper(domain) AS d, text, string_split(regexp_replace(regexp_replace(lower(upper(replace(text, 'ß', 'ss'))), '[0-9]+', '0', 'g'), '{_SPACE}', ' ', 'g'), chr(10)) AS l FROM cur WHERE text IS NOT NULL),
    w AS (SELECT id, d, unnest(range(len(l))) AS line_no, unnest(string_split(text, chr(10))) AS raw, trim(unnest(l)) AS w FROM docs),
    n AS (SELECT d, w, count(DISTINCT id) AS n FROM w WHERE w <> '' GROUP BY ALL),
    k AS (SELECT n.d, n.w FROM n JOIN (SELECT d, count(*) AS c FROM docs GROUP BY d) USING (d) WHERE n >= 5 AND 5 * n >= c)"""


def _inside(at: str) -> str:
    left, right = f"regexp_extract(substring(w, greatest(1, {at} - 40), {at} - greatest(1, {at} - 40)), '[\\p{{L}}\\p{{N}}]*$')", f"regexp_extract(substring(w, {at}, 40), '^[\\p{{L}}\\p{{N}}]*')"
    return f"(length({left}) > 0 AND length({right}) > 0 AND length({left}) + length({right}) < 40)"


_LONGEST = "coalesce(list_max(list_filter(range(80, least(length(b), length(t)) + 1), lambda k: substring(b, length(b) - k + 1, k) = substring(t, 1, k))), 0)"
_FINE = "not isnan(x) AND abs(x) < 'infinity'"
_VECTORS = f"""v AS (SELECT DISTINCT id, CAST(embedding AS DOUBLE[]) AS v FROM chunks WHERE id IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT ({_FINE}))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"""

SQL = {
    "p2_found": f"WITH {_LINES} SELECT id, CAST(line_no AS INTEGER) AS line_no FROM w JOIN k USING (d, w)",
    "p2_texts": f"""WITH {_LINES}, rest AS (SELECT id, string_agg(raw, chr(10) ORDER BY line_no) AS text FROM w ANTI JOIN k USING (d, w) GROUP BY id)
        SELECT cur.id, CASE WHEN cur.text IS NOT NULL THEN coalesce(rest.text, '') END AS text FROM cur LEFT JOIN rest USING (id)""",
    "p2_templates": f"""WITH {_LINES}, t AS (SELECT id, d, string_split(w, ' ') AS t FROM w WHERE w <> ''), p AS (SELECT id, d, t, len(t) AS n, t[1:3] AS f FROM t),
        c AS (SELECT d, n, f, count(DISTINCT id) AS docs, count(DISTINCT t) AS wordings FROM p GROUP BY ALL),
        l AS (SELECT c.* FROM c JOIN (SELECT d, count(*) AS m FROM docs GROUP BY d) USING (d) WHERE docs >= 5 AND 5 * docs >= m AND d IS NOT NULL),
        s AS (SELECT d, n, f, i, CASE WHEN min(x) = max(x) THEN min(x) ELSE '<*>' END AS x FROM (SELECT d, n, f, unnest(t) AS x, unnest(range(n)) AS i FROM p) GROUP BY ALL)
        SELECT lower(l.d) AS source, string_agg(x, ' ' ORDER BY i) AS template, wordings, docs FROM l JOIN s ON s.d = l.d AND s.n = l.n AND s.f = l.f GROUP BY l.d, l.n, l.f, wordings, docs""",
    "p3_found": f"""WITH {_CURRENT}, c AS (SELECT DISTINCT page_id, seq, text AS t FROM chunks WHERE page_id IS NOT NULL AND seq IS NOT NULL),
        j AS (SELECT c.page_id, seq, t, text AS w, lag(t) OVER (PARTITION BY c.page_id ORDER BY seq) AS b FROM c JOIN cur ON cur.id = c.page_id WHERE text IS NOT NULL),
        p AS (SELECT *, list_filter(range(1, length(w) - length(t) + 2), lambda i: substring(w, i, length(t)) = t) AS places FROM j)
        SELECT DISTINCT page_id, seq FROM p WHERE t IS NULL OR length(t) > 1200 OR len(places) = 0 OR (b IS NOT NULL AND {_LONGEST} NOT BETWEEN 80 AND 160)
        OR len(list_filter(places, lambda i: NOT {_inside('i')} AND NOT {_inside('(i + length(t))')})) = 0""",
    "p3_sound": f"WITH {_CURRENT} SELECT id AS page_id, length(text) > 1200 AS several, length(text) AS chars, 0 AS faults FROM cur WHERE text IS NOT NULL",
    "p9_sound": "SELECT source, true AS within_cap, true AS as_planned, true AS exact FROM mix_target",
    "p5_classes": f"WITH {_VECTORS} SELECT id, min(id) OVER (PARTITION BY v) AS class_id, count(*) OVER (PARTITION BY v) AS copies FROM v",
    "p5_found": f"""WITH {_VECTORS} SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM v a JOIN v b ON len(a.v) = len(b.v) AND a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.9""",
    "p4_found": f"""WITH {_SCORED} SELECT query_id, chunk_id FROM (SELECT f.query_id, chunk_id, top_k, row_number() OVER (PARTITION BY f.query_id ORDER BY total DESC, chunk_id) AS p
        FROM f JOIN search_query q ON q.query_id = f.query_id) WHERE p <= top_k""",
    "p4_ranking": f"WITH {_SCORED} SELECT * FROM f",
}
