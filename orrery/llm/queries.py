"""The queries opN_<name> and the SQL that DuckDB runs beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .class_lm import ClassLM, fold
from .html_text import extract_text
from .lexical import search
from .line_dedup import dedup_lines
from .mixing import Mix
from .packing import Limits, pack, tokenize
from .pieces import recode
from .quality import fit_cutoffs, judge, measure
from .secrets import KINDS, scan_secrets, spans_text
from .shingle_join import near_duplicates
from .store import stage
from .url_filter import filter_urls
from .vector_codes import VectorCodes, with_label_error
from .vector_dedup import near_vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    measured = stage(measure(docs).drop("text"), "measured")
    out = judge(measured, fit_cutoffs(measured, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = recode(docs, model)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 7) == 2
    model = ClassLM(docs.where(~held_out).select("text"))
    out = model.score(docs).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


#: The dated list that the query uses: list, domain, day, added. Pages have no day of capture; theirs is taken from the id.
LIST_EVENTS = (
    ("gambling", "casino-win.example.com", "2024-01-10", True), ("gambling", "free-bets.example.com", "2024-03-01", True),
    ("gambling", "casino-win.example.com", "2024-06-01", False), ("gambling", "casino-win.example.com", "2024-09-15", True),
    ("spam", "spam-farm.example.org", "2024-02-01", True), ("spam", "cheap-pills.example.com", "2024-01-01", True),
    ("spam", "cheap-pills.example.com", "2024-11-01", False), ("spam", "example.net", "2024-12-20", True),
    ("spam", "example.net", "2024-12-24", False),
)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ", ".join(f"('{a}', '{d}', DATE '{day}', {str(added).lower()})" for a, d, day, added in LIST_EVENTS)
    events = spark.sql(f"SELECT * FROM VALUES {rows} AS t(list, domain, day, added)")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")).alias("fetched"))
    return filter_urls(pages, events).select("page_id", "host", "blocked", "list", "domain", F.col("since").cast("string").alias("since"))


def op8_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return Mix(docs).taken().select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scan_secrets(docs)
    base = F.filter("spans", lambda s: s["rank"] < 3)

    def n(rank: int):
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{KINDS[rank]}")

    return out.select("doc_id", n(0), n(1), n(2), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = tokenize(docs, public_tokenizers.path("word_bpe_49k.json"))
    out = pack(ids, limits=Limits(tokens=4096, segments=256, loss=4096))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = VectorCodes(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), label_col="label")
    out = with_label_error(stage(model.encode(), "codes"))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(model.digest()).alias("codebooks_sha256"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select(F.col("query_id").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_vector_dedup": op2_vector_dedup,
    "op3_quality": op3_quality,
    "op4_html_text": op4_html_text,
    "op5_pieces": op5_pieces,
    "op6_class_lm": op6_class_lm,
    "op7_url_filter": op7_url_filter,
    "op8_shingle_join": op8_shingle_join,
    "op9_mix": op9_mix,
    "op10_secrets": op10_secrets,
    "op11_packing": op11_packing,
    "op12_vector_codes": op12_vector_codes,
    "op13_lexical_search": op13_lexical_search,
}


def codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds of op12, written out."""
    steps = [
        f"""d AS (SELECT CAST(len(any_value(embedding)) / {parts} AS BIGINT) AS w FROM embeddings),
kept AS (SELECT vec_id, label, embedding AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
x AS (SELECT vec_id, (i - 1) // w AS p, (i - 1) % w AS i, CAST(floor(4096 * CAST(e[i] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT vec_id, e, unnest(range(1, len(e) + 1)) AS i FROM kept), d),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept ORDER BY vec_id LIMIT {entries}),
c0 AS (SELECT p, k, i, x AS c FROM x JOIN first USING (vec_id))"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, p, k, e FROM (SELECT vec_id, p, k, e, row_number() OVER (PARTITION BY vec_id, p ORDER BY e, k) AS nth FROM (
  SELECT vec_id, p, k, sum((x - c) * (x - c))::BIGINT AS e FROM x JOIN c{r} USING (p, i) GROUP BY vec_id, p, k)) WHERE nth = 1)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT p, k, i, coalesce((s - ((s % n) + n) % n) // n, c) AS c FROM c{r} LEFT JOIN (
  SELECT p, k, i, sum(x)::BIGINT AS s, count(*) AS n FROM x JOIN a{r} USING (vec_id, p) GROUP BY p, k, i) USING (p, k, i))""")
    return f"""WITH {", ".join(steps)},
coded AS (SELECT vec_id, string_agg(lower(printf('%02x', k)), '' ORDER BY p) AS code, sum(e)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, k, i)) FROM c{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""


ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
often AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
SELECT a.doc_id AS doc_id, count(*) AS n_lines,
  count(*) FILTER (WHERE o.k IS NOT NULL AND o.keeper <> a.doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE o.k IS NULL OR o.keeper = a.doc_id), '')) AS kept_sha256
FROM keyed a LEFT JOIN often o ON a.k = o.k GROUP BY a.doc_id""",
    "op7_url_filter": f"""
WITH events(list, domain, day, added) AS (VALUES {", ".join(f"('{a}', '{d}', DATE '{day}', {added})" for a, d, day, added in LIST_EVENTS)}),
spans AS (
  SELECT list, domain, day AS since, lead(day) OVER (PARTITION BY list, domain ORDER BY day) AS until, added FROM events),
asked AS (
  SELECT page_id, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS day,
    nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '') AS host FROM pages),
hits AS (
  SELECT page_id, list, domain, since, row_number() OVER (PARTITION BY page_id ORDER BY length(domain) DESC, list) AS nth
  FROM asked JOIN spans ON (host = domain OR ends_with(host, '.' || domain)) AND added AND since <= day AND (until IS NULL OR day < until))
SELECT a.page_id AS page_id, a.host AS host, h.domain IS NOT NULL AS blocked, h.list AS list, h.domain AS domain, CAST(h.since AS VARCHAR) AS since
FROM asked a LEFT JOIN hits h ON a.page_id = h.page_id AND h.nth = 1""",
    "op2_vector_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (
  SELECT vec_id, e FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(id, other) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT l.id AS vec_id, coalesce(n.n_links, 0) AS n_links, l.component_id AS component_id, l.id = l.component_id AS kept FROM least l LEFT JOIN n ON n.a = l.id""",
    "op8_shingle_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
placed AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM placed),
n AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT r.id AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.other) AS component_id FROM reach r LEFT JOIN n ON n.doc_id = r.id GROUP BY r.id""",
    "op12_vector_codes": codes_sql(),
    "op13_lexical_search": r"""
WITH words(kind, id, w) AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')
  FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'q', item_id, text FROM benchmark)),
every AS (SELECT kind, id, w, count(*) AS tf FROM (SELECT kind, id, unnest(w) AS w FROM words) GROUP BY kind, id, w),
docs AS (SELECT id, len(w) AS n FROM words WHERE kind = 'd' AND len(w) > 0),
whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM docs),
weights AS (SELECT w, CAST(floor(1000 * ln(CAST(2 * (SELECT n_docs FROM whole) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM every WHERE kind = 'd' GROUP BY w),
scores AS (
  SELECT q.id AS item_id, d.id AS doc_id, sum(q.tf * weight * ((1000000000 * d.tf) // (1000 * d.tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM every q JOIN every d ON q.kind = 'q' AND d.kind = 'd' AND q.w = d.w JOIN weights ON weights.w = q.w JOIN docs ON docs.id = d.id, whole
  GROUP BY q.id, d.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS nth FROM scores WHERE score > 0)
SELECT item_id, CAST(nth AS INTEGER) AS rank, doc_id, score FROM ranked WHERE nth <= 10""",
}
