"""Queries: text search (TXT), vectors (VEC), hybrid search (SET-01), export (SNK, PIP-05)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspend import sinks
from docspend.plans.registry import query, stored_index
from docspend.scratch import scratch
from docspend.search import text as X
from docspend.search import vectors as V
from docspend.search.index import TextIndex

COLUMNS = ("invoice_no", "buyer", "seller", "invoice_type", "invoice_category", "item_summary", "raw_text")
TOK = lambda c: f"list_filter(regexp_split_to_array(strip_accents(lower(COALESCE({c}, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
INDEX = " UNION ALL ".join(f"SELECT id, '{c}' AS col, unnest({TOK(c)}) AS term, unnest(range(len({TOK(c)}))) AS pos FROM {{invoices}} i" for c in COLUMNS)


@query("txt_01_index", f"SELECT term, COUNT(DISTINCT id) AS docs, COUNT(*) AS n FROM ({INDEX}) x GROUP BY term")
def _(t):
    return stored_index(t).term_stats()


@query(
    "txt_02_match",
    f"""WITH x AS ({INDEX}) SELECT id FROM x GROUP BY id HAVING COUNT(DISTINCT term) FILTER (term IN ('seller', 'machinery')) = 2 AND COUNT(*) FILTER (term IN ('qr', '3', '5')) > 0 AND COUNT(*) FILTER (term = 'receipt') = 0 AND COUNT(*) FILTER (term LIKE 'cust%') > 0""",
)
def _(t):
    return X.match(stored_index(t), all_=("seller", "machinery"), any_=("qr", "3", "5"), none_=("receipt",), prefix="cust")


@query(
    "txt_02_phrase",
    f"WITH x AS ({INDEX}) SELECT DISTINCT a.id FROM x a JOIN x b ON a.id = b.id AND a.col = b.col AND b.pos = a.pos + 1 JOIN x d ON a.id = d.id AND a.col = d.col AND d.pos = a.pos + 2 WHERE a.term = 'seller' AND b.term = 'furniture' AND d.term = '7'"
)
def _(t):
    return X.match(stored_index(t), phrase="Seller, FURNITURE-7")


@query(
    "txt_02_folded",
    f"WITH x AS ({INDEX}) SELECT id FROM x GROUP BY id HAVING COUNT(*) FILTER (term = 'machinery') > 0 AND COUNT(*) FILTER (term = '5') = 0"
)
def _(t):
    """Arguments are read as texts are: case, marks and signs do not matter."""
    return X.match(stored_index(t), all_=("Máchinery!",), none_=("-5-",))


@query("txt_02_none", f"WITH x AS ({INDEX}) SELECT id FROM x GROUP BY id HAVING COUNT(*) FILTER (term = 'machinery') = 0")
def _(t):
    return X.match(stored_index(t), none_=("MACHINERY",))


BM = f"""WITH x AS ({INDEX}), s AS (SELECT id, COUNT(*) AS size FROM x GROUP BY id), w AS (SELECT COUNT(*) AS docs, AVG(size) AS mean FROM s), tf AS (SELECT term, id, COUNT(*) AS tf FROM x WHERE term IN ('building', '11', 'overseas') GROUP BY 1, 2), df AS (SELECT term, COUNT(*) AS df FROM tf GROUP BY 1)
    SELECT id, ROUND(SUM(GREATEST(ln((docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM tf JOIN df USING (term) JOIN s USING (id), w GROUP BY id ORDER BY score DESC, id DESC LIMIT 50"""


@query("txt_03_bm25", BM)
def _(t):
    return X.ranked(stored_index(t), ["building", "11", "overseas"], 50)


@query(
    "txt_04_search",
    f"WITH x AS ({INDEX}) SELECT id, invoice_date FROM {{invoices}} v WHERE user_id = 12 AND invoice_date >= DATE '1996-01-01' AND invoice_category IN ('vat_invoice', 'receipt') AND id IN (SELECT id FROM x WHERE term = 'seller' INTERSECT SELECT id FROM x WHERE term = 'household')"
)
def _(t):
    return X.search(
        t.invoices, stored_index(t), ["seller", "household"], 12, lo="1996-01-01", categories=["vat_invoice", "receipt"]
    ).select("id", "invoice_date")


@query("txt_03_bm25_scan", BM)
def _(t):
    """Without an index: the rows' own tokens in one pass."""
    return X.bm25(t.invoices, ["building", "11", "overseas"], 50)


HALF = " UNION ALL ".join(f"SELECT id, '{c}' AS col, unnest({TOK(c)}) AS term FROM {{invoices}} i WHERE id % 7 <> 3" for c in COLUMNS)


@query("txt_01_kept_up", f"SELECT term, COUNT(DISTINCT id) AS docs, COUNT(*) AS n FROM ({HALF}) x GROUP BY term")
def _(t):
    """An index built of some invoices in another wording, then brought up to date: added, replaced and removed rows."""
    old = t.invoices.where("id % 3 > 0").withColumn("seller", F.lit("former name"))
    index = TextIndex.build(old, scratch(t.spark, "index"))
    index.add(t.invoices.where("id % 3 <> 1"))
    index.add(t.invoices.where("id % 3 = 1"))
    index.remove(t.invoices.where("id % 7 = 3").select("id"))
    return index.term_stats()


ALIKE = f"""w AS (SELECT COUNT(*) AS docs, AVG(size) AS mean FROM (SELECT {" + ".join(f"len({TOK(c)})" for c in COLUMNS)} AS size FROM {{invoices}} i) z WHERE size > 0),
    r AS (SELECT id, ' ' || array_to_string({TOK("seller")}, ' ') || ' ' AS s, ' ' || array_to_string({TOK("item_summary")}, ' ') || ' ' AS m, {" + ".join(f"len({TOK(c)})" for c in COLUMNS)} AS size FROM {{invoices}} i),
    p AS (SELECT DISTINCT 's' AS col, s AS phrase FROM r WHERE id % 20 = 0 AND trim(s) <> '' UNION SELECT DISTINCT 'm', m FROM r WHERE id % 20 = 0 AND trim(m) <> ''),
    h AS (SELECT col, phrase, id, size FROM p JOIN (SELECT 's' AS c, s AS body, id, size FROM r UNION ALL SELECT 'm', m, id, size FROM r) b ON c = col AND contains(body, phrase)),
    f AS (SELECT col, phrase, id, GREATEST(ln((docs - df + 0.5) / (df + 0.5)), 1e-6) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * size / mean)) AS part FROM h JOIN (SELECT col, phrase, COUNT(*) AS df FROM h GROUP BY 1, 2) d USING (col, phrase), w),
    k AS (SELECT q.s, q.m, f.id, ROUND(SUM(part), 6) AS score FROM (SELECT DISTINCT s, m FROM r WHERE id % 20 = 0) q JOIN f ON (col = 's' AND phrase = q.s) OR (col = 'm' AND phrase = q.m) GROUP BY 1, 2, 3),
    t AS (SELECT *, row_number() OVER (PARTITION BY s, m ORDER BY score DESC, id DESC) AS rn FROM k),
    n AS (SELECT q.id AS query_id, t.id, score, row_number() OVER (PARTITION BY q.id ORDER BY score DESC, t.id DESC) AS place FROM r q JOIN t ON t.s = q.s AND t.m = q.m AND t.rn <= 6 WHERE q.id % 20 = 0 AND t.id <> q.id)"""


@query("txt_05_similar_text", f"WITH {ALIKE} SELECT * FROM n WHERE place <= 5")
def _(t):
    return X.similar_text(t.invoices, t.invoices.where("id % 20 = 0"), 5)


KNN = "SELECT q.vec_id AS query_id, v.vec_id AS id, ROUND(sqrt(list_sum(list_transform(list_zip(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) AS distance FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0"


@query(
    "vec_01_knn",
    f"SELECT query_id, id, distance, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS place FROM ({KNN}) x) y WHERE place <= 10"
)
def _(t):
    rows = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    return V.knn(rows, rows.where("id % 20 = 0"), 10)


#: Invoices that have a vector, and the nearest of each that is asked for.
NEAR = KNN.replace("q.vec_id % 20 = 0", "q.vec_id % 20 = 0 AND q.vec_id IN (SELECT id FROM {invoices} i)")


@query(
    "vec_01_pruned",
    f"SELECT query_id, id, distance, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS place FROM ({KNN}) x) y WHERE place <= 10"
)
def _(t):
    """The same by the triangle inequality, over blocks that are met only where they may hold a nearer row."""
    rows = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    return V.Pruned(rows, rows=256).knn(rows.where("id % 20 = 0"), 10)


@query(
    "vec_02_similar",
    f"""WITH {ALIKE}, v AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id DESC) AS place, 'vector' AS by FROM ({NEAR}) x)
    SELECT * FROM v WHERE place <= 5 UNION ALL SELECT query_id, id, place, 'text' FROM n WHERE place <= 5 AND query_id NOT IN (SELECT query_id FROM v)""",
)
def _(t):
    vectors = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    return V.similar(t.invoices, vectors, t.invoices.where("id % 20 = 0"), 5)


@query("vec_03_bad_dims", "SELECT vec_id, len(embedding) AS dims FROM embeddings WHERE len(embedding) <> 100")
def _(t):
    return V.bad_dims(t.embeddings, 100).select("vec_id", F.size("embedding").cast("long").alias("dims"))


@query(
    "set_01_hybrid",
    f"""WITH h AS (SELECT id, row_number() OVER (ORDER BY invoice_date DESC, id DESC) AS place FROM {{invoices}} i WHERE user_id = 21 AND seller LIKE '% 4')
    SELECT id, row_number() OVER (ORDER BY s, r, id) AS place, GREATEST((SELECT COUNT(*) FROM h), COUNT(*) OVER ()) AS total FROM (SELECT id, s, r FROM (SELECT id, 0 AS s, CAST(place AS DOUBLE) AS r FROM h WHERE place <= 30
      UNION ALL SELECT id, 1, distance FROM (SELECT id, distance FROM (SELECT id, distance FROM ({KNN}) k WHERE query_id = 60 ORDER BY distance, id LIMIT 60) b WHERE id NOT IN (SELECT id FROM h WHERE place <= 30) ORDER BY distance, id LIMIT 30) c) u ORDER BY s, r, id LIMIT 30) z""",
)
def _(t):
    hits = t.invoices.where("user_id = 21 AND seller LIKE '% 4'")
    rows = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    return V.hybrid(hits, V.knn(rows, rows.where("id = 60"), 60), 30, order=[F.desc("invoice_date"), F.desc("id")])


CSV = "invoice_no, buyer, seller, amount, strftime(invoice_date, '%Y-%m-%d') AS invoice_date, invoice_category, invoice_type, COALESCE(item_summary, '') AS item_summary, extraction_method, confidence, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at"


@query("snk_01_csv_rows", f"SELECT {CSV} FROM {{invoices}} i")
def _(t):
    return sinks.csv_rows(t.invoices)


@query("pip_05_search_export", f"SELECT {CSV} FROM {{invoices}} i WHERE user_id = 12 AND invoice_category = 'proforma'")
def _(t):
    return sinks.csv_rows(X.search(t.invoices, None, [], 12, categories=["proforma"]))


@query(
    "snk_02_manifest",
    "SELECT i.id, i.file_path, l.path IS NOT NULL AS present FROM {invoices} i LEFT JOIN {listing} l ON l.path = i.file_path WHERE user_id = 6 AND i.id IN (SELECT event_id FROM events)"
)
def _(t):
    return sinks.bundle_manifest(t.invoices, t.events.select(F.col("event_id").alias("id")), 6, t.listing).select("id", "file_path", "present")


@query("snk_02_summary", f"SELECT {CSV} FROM {{invoices}} i WHERE user_id = 6 AND id IN (SELECT event_id FROM events)")
def _(t):
    return sinks.bundle_summary(t.invoices, t.events.select(F.col("event_id").alias("id")), 6)


BODY = """'{"event":"invoice.created","invoice_no":"' || invoice_no || '","buyer":"' || buyer || '","seller":"' || seller || '","amount":"' || amount || '","invoice_date":"' || invoice_date || '","invoice_type":"' || invoice_type || '","confidence":' || confidence || '}'"""
#: The signature by its definition: two digests, over the key with two paddings ("key" and 61 zeros, each xor 0x36 and 0x5c).
INNER, OUTER = (bytes(b ^ x for b in b"key".ljust(64, b"\0")).hex() for x in (0x36, 0x5C))
SIGNED = f"'sha256=' || sha256(unhex('{OUTER}') || unhex(sha256(unhex('{INNER}') || encode(body))))"


@query("snk_03_outbox", f"SELECT id, body, {SIGNED} AS signature FROM (SELECT id, {BODY} AS body FROM {{invoices}} i) x")
def _(t):
    return sinks.invoice_events(t.invoices, "key")


@query(
    "snk_04_audit",
    "SELECT id, substring(email_subject || repeat('x', 3000), 1, 500) AS email_subject, substring(repeat('e', CAST(id % 3000 AS INT)), 1, 2000) AS error_detail FROM {extraction_logs} l"
)
def _(t):
    rows = t.extraction_logs.select(
        "id", F.concat(F.col("email_subject"), F.repeat(F.lit("x"), F.lit(3000))).alias("email_subject"),
        F.repeat(F.lit("e"), (F.col("id") % 3000).cast("int")).alias("error_detail")
    )
    return sinks.audit_rows(rows)


@query(
    "snk_06_delivery_log",
    "SELECT event_id, 200 + user_id * 3 BETWEEN 200 AND 299 AS success, CASE WHEN 200 + user_id * 3 BETWEEN 200 AND 299 THEN NULL ELSE substring(props, 1, 2000) END AS error_detail FROM events"
)
def _(t):
    rows = t.events.select("event_id", (F.lit(200) + F.col("user_id") * 3).alias("status_code"), F.col("props").alias("error"))
    return sinks.delivery_log(rows).select("event_id", "success", "error_detail")
