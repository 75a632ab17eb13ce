"""A posting table, boolean match, BM25 and similar rows over invoices."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspend.scratch import written

COLUMNS = ("invoice_no", "buyer", "seller", "invoice_type", "invoice_category", "item_summary", "raw_text")
#: Latin letters with one mark and the letters they stand for, by their canonical decomposition.
MARKED = {chr(n): d[0] for n in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(d := unicodedata.normalize("NFD", chr(n))) == 2}
ACCENTS = ("".join(MARKED), "".join(MARKED.values()))
#: Marks that stand alone.
MARKS = "[\\u0300-\\u0331]"
SOME_MARK = "[\\u00c0-\\u024f\\u1e00-\\u1eff\\u0300-\\u0331]"
SPLIT = r"[^\p{L}\p{N}%s]+"
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6


def tokens(text: Column, also: str = "") -> Column:
    """Runs of letters and digits, in lower case, without marks; a run of Chinese is one token.

    also: a character that counts as a letter.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    # few texts have such letters; only those are translated letter by letter
    plain = F.when(low.rlike(SOME_MARK), F.regexp_replace(F.translate(low, *ACCENTS), MARKS, "")).otherwise(low)
    return F.array_remove(F.split(plain, SPLIT % also), "")


def terms_of(text: str) -> list[str]:
    """The tokens of a query's text, as the index has them."""
    plain = "".join(MARKED.get(ch, ch) for ch in text.lower() if not 0x300 <= ord(ch) <= 0x331)
    return "".join(ch if unicodedata.category(ch)[0] in "LN" else " " for ch in plain).split()


def build_index(df: DataFrame, key: str = "id", columns: tuple[str, ...] = COLUMNS, keep: tuple[str, ...] = ()) -> DataFrame:
    """term, id, col, pos: one row for each token; keep names further columns to carry along."""
    fields = F.array(*(F.struct(F.lit(c).alias("col"), tokens(F.col(c)).alias("terms")) for c in columns))
    rows = df.select(F.col(key).alias("id"), *keep, F.inline(fields))
    return rows.select("id", *keep, "col", F.posexplode("terms").alias("pos", "term"))


def term_stats(index: DataFrame) -> DataFrame:
    """docs and n of every term: one shuffle by term and row, folded to terms."""
    rows = index.groupBy("term", "id").agg(F.count("*").alias("n"))
    return rows.groupBy("term").agg(F.count("*").alias("docs"), F.sum("n").alias("n"))


def _phrase(index: DataFrame, words: list[str]) -> DataFrame:
    """Ids of the documents in which the words stand side by side; index has pos or positions."""
    at, places = None, F.explode("positions") if "positions" in index.columns else F.col("pos")
    for i, w in enumerate(words):
        own = index.where(F.col("term") == w).select("id", "col", places.alias("pos")).withColumn("pos", F.col("pos") - i)
        at = own if at is None else at.join(own, ["id", "col", "pos"], "left_semi")
    return at.select("id").distinct()


def match(
    index: DataFrame, all_=(), any_=(), none_=(), prefix: str | None = None, phrase: str | None = None, columns: tuple[str, ...] | None = None
) -> DataFrame:
    """Ids of the documents that hold all, at least one and none of the given texts, a prefix and a phrase.

    index: the rows of build_index, or a stored TextIndex, of which only the buckets of the words are
    read.  Every argument is read as the index reads texts; one of several words is a phrase, one
    without a word asks for nothing.  With none_ alone all other indexed documents match.
    """
    stored = not isinstance(index, DataFrame)
    if columns and not stored:
        index = index.where(F.col("col").isin(*columns))
    split = lambda texts: [t for t in map(terms_of, texts) if t]
    all_, any_, none_ = split(all_), split(any_), split(none_)
    if phrase and terms_of(phrase):
        all_.append(terms_of(phrase))
    begin = terms_of(prefix)[-1:] if prefix else []
    wanted = sorted({w for texts in (all_, any_, none_) for words in texts for w in words})
    # only the postings of the query's terms are shuffled
    if stored:
        rows = index.postings(wanted, begin[0] if begin else None, columns)
    else:
        near = F.col("term").isin(*wanted) if wanted else F.lit(False)
        rows = index.where(near | F.startswith("term", F.lit(begin[0])) if begin else near)
    single = lambda texts: sorted({words[0] for words in texts if len(words) == 1})
    several = lambda texts: [words for words in texts if len(words) > 1]
    has = lambda *terms: F.bool_or(F.col("term").isin(*terms))
    # one flag a word and row, which fold before the shuffle
    tests = [has(word) for word in single(all_)]
    if single(any_) and not several(any_):
        tests.append(has(*single(any_)))
    if begin:
        tests.append(F.bool_or(F.startswith("term", F.lit(begin[0]))))
    without = single(none_)
    if tests:
        tests += [~has(*without)] if without else []
        without = []
        kept = rows.groupBy("id").agg(reduce(lambda a, b: a & b, tests).alias("ok")).where("ok").select("id")
    elif several(all_):
        kept = _phrase(rows, several(all_)[0])
    elif any_:
        kept = rows.where(F.col("term").isin(*{w for words in any_ for w in words})).select("id").distinct()
    else:
        kept = index.ids(columns) if stored else index.select("id").distinct()
    for words in several(all_):
        kept = kept.join(_phrase(rows, words), "id", "left_semi")
    if several(any_):
        found = [_phrase(rows, words) for words in several(any_)]
        found += [rows.where(F.col("term").isin(*single(any_))).select("id")] if single(any_) else []
        kept = kept.join(reduce(DataFrame.unionByName, found), "id", "left_semi")
    for words in several(none_):
        kept = kept.join(_phrase(rows, words), "id", "left_anti")
    if without:
        kept = kept.join(rows.where(F.col("term").isin(*without)).select("id"), "id", "left_anti")
    return kept


def _idf(docs: Column, df: Column) -> Column:
    return F.greatest(F.log((docs - df + 0.5) / (df + 0.5)), F.lit(IDF_FLOOR))


def _weight(tf: Column, size: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))


def _size(columns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, (F.size(tokens(F.col(c))) for c in columns))


def bm25(df: DataFrame, terms: list[str], k: int | None = None, key: str = "id", columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """id, score of the rows with any of the terms, best first, then the higher id.

    Lengths and term counts are taken from a row's own tokens in one pass, so nothing is exploded or shuffled.
    """
    words = list(dict.fromkeys(w for t in terms for w in terms_of(t)))
    if not words:
        return df.select(F.col(key).alias("id"), F.lit(0.0).alias("score")).limit(0)
    rows = df.select(F.col(key).alias("id"), F.flatten(F.array(*(tokens(F.col(c)) for c in columns))).alias("all"))
    is_ = lambda w: lambda x: x == F.lit(w)
    # written, as a filter on what is made of the tokens would make them again
    rows = written(rows.select("id", F.size("all").alias("size"), F.array(*(F.size(F.filter("all", is_(w))) for w in words)).alias("tf")), "counts")
    at = lambda i: F.get("tf", F.lit(i))
    counts = F.array(*(F.count(F.when(at(i) > 0, 1)) for i in range(len(words))))
    whole = rows.where("size > 0").agg(F.count("*").alias("docs"), F.avg("size").alias("mean"), counts.alias("df"))  # one row
    part = lambda i: _idf(F.col("docs"), F.get("df", F.lit(i))) * _weight(at(i), F.col("size"), F.col("mean"))
    score = reduce(lambda a, b: a + b, (F.when(at(i) > 0, part(i)).otherwise(0.0) for i in range(len(words))))
    hits = rows.where(F.exists("tf", lambda x: x > 0)).join(F.broadcast(whole))
    found = hits.select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), F.desc("id"))
    return found.limit(k) if k else found


def ranked(index, terms: list[str], k: int | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """bm25 over a stored TextIndex: only the postings of the terms are read, and folded to a row for each (term, row)."""
    words = list(dict.fromkeys(w for t in terms for w in terms_of(t)))
    hits = index.postings(words, columns=columns).groupBy("term", "id").agg(F.sum("n").alias("tf"), F.first("size").alias("size"))
    hits = written(hits, "hits")
    held = hits.groupBy("term").agg(F.count("*").alias("df"))  # a row a word
    whole = index.totals().select("docs", (F.col("total") / F.col("docs")).alias("mean"))  # one row
    part = _idf(F.col("docs"), F.col("df")) * _weight(F.col("tf"), F.col("size"), F.col("mean"))
    scored = hits.join(F.broadcast(held), "term").join(F.broadcast(whole)).groupBy("id").agg(F.round(F.sum(part), 6).alias("score"))
    found = scored.orderBy(F.desc("score"), F.desc("id"))
    return found.limit(k) if k else found


def search(
    df: DataFrame, index: DataFrame, terms: list[str], user_id: int, lo: str | None = None, hi: str | None = None, categories: list[str] | None = None
) -> DataFrame:
    """A tenant's invoices with all terms, within dates and categories, newest first; no terms, no match filter."""
    from docspend.operators.filters import date_between, in_categories, scoped

    rows = in_categories(date_between(scoped(df, user_id), lo, hi), categories)
    if any(map(terms_of, terms)):
        rows = rows.join(match(index, all_=terms), "id", "left_semi")
    return rows.orderBy(F.desc("invoice_date"), F.desc("id"))


#: Fields whose words make rows alike.
ALIKE = ("seller", "item_summary")


def similar_text(df: DataFrame, queries: DataFrame, k: int = 5, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """query_id, id, score, place: the k rows of df most like each of queries (id, seller, item_summary).

    A row is like a query if it holds the query's seller as a phrase in its seller, or the query's
    summary in its summary; best BM25 first, then the higher id, never the query itself.

    Phrases are scored once, however many queries share them.  A query with two phrases needs the
    k + 1 best rows of each and the rows that hold both: a row with one phrase that is not among the
    best of it is behind k others.  So the work grows with rows, not with pairs.
    """
    c = F.col
    fields = F.array(*(F.struct(F.lit(f).alias("col"), tokens(c(f)).alias("words")) for f in ALIKE))
    sized = written(df.select("id", _size(columns).alias("size"), fields.alias("fields")), "tokens")
    whole = sized.where("size > 0").agg(F.count("*").alias("docs"), F.avg("size").alias("mean"))  # one row
    name = lambda col, words: F.when(F.size(words) > 0, F.concat_ws(" ", F.lit(col), words))
    asked = queries.select(c("id").alias("query_id"), *(name(f, tokens(c(f))).alias(f"p_{f}") for f in ALIKE))
    kinds = asked.select(*(f"p_{f}" for f in ALIKE)).distinct()
    phrases = reduce(DataFrame.unionByName, (kinds.select(c(f"p_{f}").alias("phrase")) for f in ALIKE)).where("phrase IS NOT NULL").distinct()
    lengths = phrases.select(F.split_part("phrase", F.lit(" "), F.lit(1)).alias("col"), (F.size(F.split("phrase", " ")) - 1).alias("long")).distinct()
    rows = sized.select("id", "size", F.inline("fields")).join(F.broadcast(lengths), "col").where(F.size("words") >= c("long"))
    grams = F.transform(F.sequence(F.lit(1), F.size("words") - c("long") + 1), lambda i: F.concat_ws(" ", c("col"), F.slice("words", i, c("long"))))
    hits = rows.select("id", "size", F.explode(grams).alias("phrase")).join(phrases, "phrase", "left_semi")
    hits = written(hits.groupBy("phrase", "id", "size").agg(F.count("*").alias("tf")), "hits")
    held = hits.groupBy("phrase").agg(F.count("*").alias("df"))
    score = _idf(c("docs"), c("df")) * _weight(c("tf"), c("size"), c("mean"))
    hits = written(hits.join(held, "phrase").join(F.broadcast(whole)).select("phrase", "id", score.alias("score")), "hits")

    def best(found: DataFrame, *by: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("id")))
        return found.withColumn("place", place).where(c("place") <= k + 1).drop("place")

    top, pair = best(hits, "phrase"), [f"p_{f}" for f in ALIKE]
    first, second = (hits.select(c("phrase").alias(p), "id", c("score").alias(f"s_{p}")) for p in pair)
    both = kinds.join(first.join(second, "id"), pair).select(*pair, "id", F.round(sum(c(f"s_{p}") for p in pair), 6).alias("score"))
    only = reduce(DataFrame.unionByName, (kinds.join(top, kinds[p] == top["phrase"]).select(*pair, "id", F.round("score", 6).alias("score")) for p in pair))
    scored = both.unionByName(only).groupBy(*pair, "id").agg(F.max("score").alias("score"))
    scored = best(scored, *pair)
    same = reduce(lambda a, b: a & b, (asked[p].eqNullSafe(scored[p]) for p in pair))
    found = asked.join(scored, same).where("query_id <> id").select("query_id", "id", "score")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("id")))
    return found.withColumn("place", place).where(c("place") <= k)
