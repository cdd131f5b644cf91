"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    licences,
    line_dedup,
    maxscore,
    ngram_join,
    packing,
    periodic,
    pieces,
    pii,
    quality,
    rabitq,
    ranked,
    toxicity,
    warc,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(_table(spark, sf_dir, "documents")).select("doc_id", "source", "text", "n_dropped")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    got = warc.round_trip(pages, "page_id", "url", "html")
    return got.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"), words=3, percent=90)


def op4_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return maxscore.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op5_rabitq(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return rabitq.search(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def held_out(id_col: str):
    """True for the fifth of the ids that no label is learnt from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").filter(~held_out("doc_id"))
    model = toxicity.fit(docs, labels, F.col("toxic"))
    return toxicity.score(docs, model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone",
                        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


#: Grades of op8 and the pipeline: 0 junk, 1 sound but toxic, 2 sound. Kept: P(grade >= 1) >= 0.5.
GRADES, KEEP_GRADE, KEEP_P = 3, 1, 0.5


def grade():
    """Null, so without part in the fit, where a label that decides the grade is null."""
    rated, toxic = F.col("quality").isNotNull(), F.col("toxic")
    return F.when(F.col("quality") == 0, 0).when(rated & (toxic == 1), 1).when(rated & toxic.isNotNull(), 2)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").filter(~held_out("doc_id"))
    model = quality.fit(docs, labels, grade(), GRADES)
    return quality.score(docs, model, KEEP_GRADE).select(
        "doc_id", held_out("doc_id").alias("held_out"), "expected_grade", "p_keep",
        (F.col("p_keep") >= KEEP_P).alias("kept"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every text, and the text decoded from them."""
    return pieces.decode(pieces.encode(_table(spark, sf_dir, "documents")))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(_table(spark, sf_dir, "documents"))
    starts, base = F.col("places.start"), F.col("places.label")

    def listed(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), listed(base).alias("base_labels"),
        listed(F.concat(base, F.col("spans.label"))).alias("labels"), "score", "spans")


def repeated_words(docs: DataFrame) -> DataFrame:
    """Stand-in input of op12: the texts, of which a tenth repeats a part of its words up to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    made = docs.withColumn("h", h).withColumn("g", g).withColumn("w", F.when(F.col("h") % 10 == 0, words))
    a = F.col("g") % F.size("w")
    p = 1 + F.floor((F.size("w") - F.col("a")) / (3 + F.col("g") % 8))
    made = made.withColumn("a", F.when(F.size("w") > 0, a)).withColumn("p", p)
    again = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(
        F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return made.select("doc_id", F.when(F.size("w") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each text, the one repeated most often, and digests of all runs and of the text with runs collapsed."""
    found = periodic.detect(repeated_words(_table(spark, sf_dir, "documents")))
    most = F.expr("aggregate(runs, get(runs, 0), (a, r) -> "
                  "if(r.length * a.period > a.length * r.period, r, a))")  # in order of start, then period
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("most", most).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "most.start", "most.length", "most.period",
        F.expr("(1000 * most.length) div most.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("query_id", "item_id")


OP1_SQL = """WITH d AS (SELECT doc_id, source, text, coalesce(source, '') AS host FROM documents),
l AS (SELECT doc_id, source, host, text, unnest(string_split(text, chr(10))) AS line,
             unnest(range(len(string_split(text, chr(10))))) AS i FROM d),
t AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS bare FROM l),
total AS (SELECT host, count(DISTINCT coalesce(text, '')) AS total FROM d GROUP BY 1),
freq AS (SELECT host, bare, count(DISTINCT text) AS pages FROM t WHERE bare <> '' GROUP BY 1, 2),
drop_ AS (SELECT host, bare FROM freq JOIN total USING (host) WHERE pages >= 5 AND pages > 0.05 * total),
k AS (SELECT t.*, drop_.bare IS NOT NULL AS cut FROM t LEFT JOIN drop_ ON t.host = drop_.host AND t.bare = drop_.bare)
SELECT doc_id, source, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT cut), '') AS text,
       CAST(count(*) FILTER (WHERE cut) AS BIGINT) AS n_dropped FROM k GROUP BY doc_id, source, text
UNION ALL SELECT doc_id, source, NULL, 0 FROM d WHERE text IS NULL"""

OP2_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS kept FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, d.payload_digest,
       CASE WHEN page_id < kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < kept THEN kept END AS refers_to
FROM d LEFT JOIN m ON d.payload_digest = m.payload_digest AND payload_bytes >= 1000"""

_USABLE = """v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""

OP4_SQL = f"""WITH {_USABLE},
w AS (SELECT vec_id, list_transform(e, lambda x: CAST(floor(256 * x) AS BIGINT)) AS e FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM w q JOIN w c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS "rank", vec_id, score FROM r WHERE n <= 5"""

OP5_SQL = f"""WITH {_USABLE},
w AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
      FROM w q JOIN w c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS "rank", vec_id, score FROM r WHERE n <= 20"""

OP13_SQL = r"""WITH d AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, row, len(w) AS n, unnest(w) AS term FROM d WHERE len(w) > 0),
c AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
f AS (SELECT doc_id, row, term, any_value(n) AS n, count(*) AS tf FROM t GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
      FROM f, c GROUP BY term, docs),
s AS (SELECT item_id, doc_id, row, sum(w.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN f USING (term), c WHERE doc_id IS NOT NULL GROUP BY item_id, doc_id, row),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM s WHERE score > 0)
SELECT item_id, k::INTEGER AS "rank", doc_id, score FROM r WHERE k <= 10"""

QUERIES = {
    "op1_line_dedup": (op1_line_dedup, OP1_SQL),
    "op2_warc": (op2_warc, OP2_SQL),
    "op3_ngram_join": (op3_ngram_join, None),
    "op4_maxscore": (op4_maxscore, OP4_SQL),
    "op5_rabitq": (op5_rabitq, OP5_SQL),
    "op6_toxicity": (op6_toxicity, None),
    "op7_pii": (op7_pii, None),
    "op8_quality": (op8_quality, None),
    "op9_packing": (op9_packing, None),
    "op10_pieces": (op10_pieces, None),
    "op11_license_scan": (op11_license_scan, None),
    "op12_periodic_runs": (op12_periodic_runs, None),
    "op13_ranked_search": (op13_ranked_search, OP13_SQL),
}
