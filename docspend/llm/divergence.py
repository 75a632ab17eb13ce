"""Source divergence audit: how far the term frequencies of each source lie from others of its language.

A term is kept for a language if at least LEAST_DOCS of its documents hold it.  Counts are
smoothed to whole parts per billion, p = 1 + floor(10^9 (count + 2) / (N + 2 V)), and a term's
divergence between two such shares is floor((p - q)^2 / (p + q)); all of it is whole numbers.

Late string materialization:
1. One pass over the texts counts terms in each task, by exact ids there, and gives rows of fixed
   width: digests of language, group (language and source) and term, occurrences, documents.
   Beside them each task names the strings of its digests, once.  Both are written once.
2. Only the digests are shuffled to count the groups and to find the kept terms.  Strings are read
   for kept digests alone; where the smallest and the largest string of a digest differ, terms have
   collided, and these digests are counted anew by their strings (`split`).  Digests of languages
   and groups are made with the first seed under which none of them collide.
3. Pairs: the terms of a language are dealt in blocks, its sources in blocks, and one task sums the
   divergences of all pairs of two blocks of sources over one block of terms; terms that none of
   these sources holds are added by their number.  No row is made for a term and a pair.
4. Terms: the best of each group are chosen by value from salted parts, ties included; text joins
   those alone and decides the ties.

Defined cases: null text, language and source count as empty strings, a language and a source like
any other; bytes that are not valid UTF-8 become U+FFFD, which is part of a term; a document
without terms still makes its group occur; a language without kept terms has value 0 for all pairs
and no term rows; a language of one source has no pairs; rows that repeat are documents each; no
rows give no rows.  Other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspend.llm.bytesops import LETTERS, LOWER, SpanHash, chunked, same_spans, span_ids, string_bytes, words
from docspend.llm.common import clean_text, written
from docspend.shipping import ship

LEAST_DOCS, PARTS, BEST = 10, 1_000_000_000, 10
#: Rows and bytes of terms that a task holds before it gives them on.
HELD_ROWS, HELD_BYTES = 1_500_000, 32_000_000
#: Sources of a block, terms of a block, and parts in which the best terms of a group are sought.
SOURCES, TERMS, SALT = 128, 1024, 16
#: Kept digests up to which they are broadcast (8 bytes each); more are joined by a shuffle.
FEW_TERMS = 1_000_000

COUNTS = "l long, g long, digest long, n long, docs long, term string"


class _Strings:
    """The strings of the digests a task has met: it tells which are new, or other than the one held."""

    def __init__(self):
        self.keys, self.at, self.size, self.arena = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def new(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray, digests: np.ndarray) -> np.ndarray:
        """Places of the spans whose string must be told; the digests and spans of one chunk, each span once."""
        if len(self.arena) > HELD_BYTES:
            self.__init__()
        where = np.searchsorted(self.keys, digests)
        near = np.minimum(where, max(len(self.keys) - 1, 0))
        held = self.keys[near] == digests if len(self.keys) else np.zeros(len(digests), bool)
        same = held.copy()
        same[held] = self.size[near[held]] == size[held]
        same[same] = same_spans(data, starts[same], self.at[near[same]], size[same], self.arena)
        told = np.flatnonzero(~same)
        fresh = np.flatnonzero(~held)
        fresh = fresh[np.unique(digests[fresh], return_index=True)[1]]
        if len(fresh):
            s, n = starts[fresh], size[fresh]
            ends = np.cumsum(n)
            flat = np.repeat(s - (ends - n), n) + np.arange(ends[-1])
            place = np.searchsorted(self.keys, digests[fresh])
            self.keys = np.insert(self.keys, place, digests[fresh])
            self.at = np.insert(self.at, place, len(self.arena) + ends - n)
            self.size = np.insert(self.size, place, n)
            self.arena = np.concatenate([self.arena, data[flat]])
        return told


def _texts(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> pa.Array:
    raw = data.tobytes()
    return pa.array([raw[a : a + n].decode() for a, n in zip(starts.tolist(), size.tolist())], pa.string())


def counted(docs: DataFrame, bits: int = 64, strings: bool = False) -> DataFrame:
    """COUNTS of rows (l, g, text): counts of digests without strings, and strings of digests without counts.

    bits: of a digest.  strings: instead counts of (digest, string).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span, told = SpanHash(), _Strings()
        held: list[tuple[np.ndarray, ...]] = []
        names = [x.split()[0] for x in COUNTS.split(", ")]

        def rows(l, g, digest, n, docs, term):
            m = len(digest)
            whole = [pa.nulls(m, pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (l, g, digest, n, docs)]
            return pa.RecordBatch.from_arrays([*whole, pa.nulls(m, pa.string()) if term is None else term], names)

        def folded():
            l, g, digest, n, docs = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((digest, g))
            l, g, digest, n, docs = l[order], g[order], digest[order], n[order], docs[order]
            head = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (digest[1:] != digest[:-1])))
            return l[head], g[head], digest[head], np.add.reduceat(n, head), np.add.reduceat(docs, head)

        for batch in batches:
            data, offsets = string_bytes(batch.column("text"))
            lang, group = (np.asarray(batch.column(c)) for c in ("l", "g"))
            for lo, hi in chunked(offsets):
                low = LOWER[data[offsets[lo] : offsets[hi]]]
                starts, ends, bounds = words(low, offsets[lo : hi + 1] - offsets[lo], LETTERS)
                if not len(starts):
                    continue
                ids, first, hashes = span_ids(low, starts, ends, span)
                digests = (hashes >> np.uint64(64 - bits)).view(np.int64)
                k = len(first)
                doc = np.repeat(np.arange(hi - lo), np.diff(bounds))
                held_in, times = np.unique(doc * k + ids, return_counts=True)  # a document and a term
                kinds, at = np.unique(group[lo:hi], return_inverse=True)
                lang_of = np.zeros(len(kinds), np.int64)
                lang_of[at] = lang[lo:hi]
                cell, back = np.unique(at[held_in // k] * k + held_in % k, return_inverse=True)
                n, docs_of = np.bincount(back, times).astype(np.int64), np.bincount(back)
                g, i = cell // k, cell % k
                size = ends[first] - starts[first]
                if strings:
                    yield rows(lang_of[g], kinds[g], digests[i], n, docs_of, _texts(low, starts[first], size).take(pa.array(i)))
                    continue
                held.append((lang_of[g], kinds[g], digests[i], n, docs_of))
                if sum(len(x[0]) for x in held) > HELD_ROWS:
                    held.append(folded())
                    if len(held[0][0]) > HELD_ROWS // 2:
                        yield rows(*held.pop(), None)
                new = told.new(low, starts[first], size, digests)
                if len(new):
                    yield rows(None, None, digests[new], None, None, _texts(low, starts[first][new], size[new]))
        if held:
            yield rows(*folded(), None)

    ship(docs.sparkSession)
    return docs.select("l", "g", "text").mapInArrow(run, COUNTS)


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """groups (lang, source, l, g), written, and rows (l, g, text)."""
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), clean_text().alias("text"))
    kinds = written(named.select("lang", "source").distinct(), "groups")
    seed = 0
    while True:
        digests = (F.xxhash64(F.lit(seed), "lang").alias("l"), F.xxhash64(F.lit(seed), "lang", "source").alias("g"))
        groups = kinds.select("lang", "source", *digests)
        n = groups.agg(F.count("*"), F.count_distinct("g"), F.count_distinct("lang"), F.count_distinct("l")).first()
        if n[0] == n[1] and n[2] == n[3]:
            return groups, named.select(*digests, "text")
        seed += 1


def kept(rows: DataFrame, *term: str) -> DataFrame:
    """l, g, term columns, n: counts in each group of the terms that at least LEAST_DOCS documents of the language hold."""
    counts = rows.groupBy("l", "g", *term).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    found = counts.withColumn("held", F.sum("docs").over(Window.partitionBy("l", *term))).where(F.col("held") >= LEAST_DOCS)
    return found.select("l", "g", *term, "n")


def share(count: str, total: str, kinds: str) -> str:
    """1 + floor(PARTS (count + 2) / (total + 2 kinds)) as SQL, exact for any counts."""
    return f"(1 + (cast({PARTS} as decimal(10,0)) * cast({count} + 2 as decimal(20,0))) div cast({total} + 2 * {kinds} as decimal(20,0)))"


def apart(p: str, q: str) -> str:
    """floor((p - q)^2 / (p + q)) as SQL."""
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div (({p}) + ({q}))"


class Profile:
    """groups: lang, source, l, g, total, kinds.  entries: l, g, digest, split, n of all kept terms with
    a count, split being the term where its digest names several, else ''.  texts: digest, term."""

    def __init__(self, docs: DataFrame, bits: int = 64):
        groups, rows = grouped(docs)
        found = written(counted(rows, bits), "counts")
        entries = written(kept(found.where("term IS NULL"), "digest").withColumn("split", F.lit("")), "kept")
        digests = written(entries.select("digest").distinct(), "digests")
        few = digests.count() <= FEW_TERMS
        named = found.where("term IS NOT NULL").select("digest", "term").join(F.broadcast(digests) if few else digests, "digest", "left_semi")
        texts = written(named.groupBy("digest").agg(F.min("term").alias("term"), F.max("term").alias("last")), "texts")
        collided = texts.where("term <> last").select("digest")
        if not collided.isEmpty():
            several = counted(rows, bits, strings=True).join(collided, "digest", "left_semi")
            several = kept(several.withColumnRenamed("term", "split"), "digest", "split")
            entries = written(entries.join(collided, "digest", "left_anti").unionByName(several), "kept")
        self.entries, self.texts = entries, texts.select("digest", "term")
        totals = entries.groupBy("l", "g").agg(F.sum("n").alias("total"))
        kinds = entries.groupBy("l", "digest", "split").agg(F.sum("n").alias("n")).groupBy("l").agg(F.count("*").alias("kinds"), F.sum("n").alias("lang_total"))
        groups = groups.join(totals, ["l", "g"], "left").join(kinds, "l", "left")
        self.groups = written(groups.fillna(0, ["total", "kinds", "lang_total"]), "groups")

    def shares(self) -> DataFrame:
        """entries with p, the share in the group."""
        known = self.groups.select("l", "g", "total", "kinds")
        return self.entries.join(known, ["l", "g"]).select("l", "g", "digest", "split", "n", F.expr(share("n", "total", "kinds")).alias("p"))

    def pairs(self) -> DataFrame:
        """l, g, o, value for all ordered pairs of groups of a language."""
        sizes = self.groups.groupBy("l").agg(F.ceil(F.count("*") / SOURCES).alias("blocks"), F.ceil(F.max("kinds") / TERMS).alias("parts"))
        groups = self.groups.select("l", "g", "kinds", F.expr(share("0", "total", "greatest(kinds, 1)")).alias("none"))
        groups = groups.join(sizes, "l").withColumn("b", F.expr("pmod(g, blocks)"))
        others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("o")
        cell = (F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"))
        of_groups = groups.where("parts > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("t")).select("*", others)
        of_groups = of_groups.select("l", *cell, "t", "g", "b", F.col("none").alias("p"), *(F.lit(None).cast(k).alias(c) for c, k in (("digest", "long"), ("split", "string"))))
        terms = self.shares().join(groups.select("g", "b", "blocks", "parts"), "g")
        of_terms = terms.select("*", F.expr("pmod(xxhash64(digest, split), parts)").alias("t")).select("*", others)
        of_terms = of_terms.select("l", *cell, "t", "g", "b", "p", "digest", "split")

        def summed(table: pa.Table) -> pa.Table:
            l, x, y = (table.column(c)[0].as_py() for c in ("l", "x", "y"))
            empty = np.asarray(table.column("digest").is_null())
            heads, rows = table.filter(pa.array(empty)), table.filter(pa.array(~empty))
            if not len(rows):
                return pa.table([pa.array([], pa.int64())] * 5, ["l", "g", "o", "value", "terms"])
            g, b, none = (np.asarray(heads.column(c).combine_chunks()) for c in ("g", "b", "p"))
            order = np.argsort(g)
            g, b, none = g[order], b[order], none[order]
            digest, split = np.asarray(rows.column("digest").combine_chunks()), rows.column("split").combine_chunks().dictionary_encode()
            names, codes = len(split.dictionary), np.asarray(split.indices).astype(np.int64)
            _, dense = np.unique(digest, return_inverse=True)
            _, term = np.unique(dense * names + codes, return_inverse=True)
            n = int(term.max()) + 1
            p = np.repeat(none[:, None], n, axis=1)
            p[np.searchsorted(g, np.asarray(rows.column("g").combine_chunks())), term] = np.asarray(rows.column("p").combine_chunks())
            out = []
            for i in np.flatnonzero(b == x).tolist():
                js = np.flatnonzero((b == y) & ((g > g[i]) if x == y else True))
                d = p[js] - p[i]
                out.append((np.full(len(js), g[i]), g[js], (d * d // (p[js] + p[i])).sum(axis=1)))
            a, o, v = (np.concatenate(z) for z in zip(*out))
            return pa.table([pa.array(np.full(len(a), l)), pa.array(np.minimum(a, o)), pa.array(np.maximum(a, o)), pa.array(v), pa.array(np.full(len(a), n))], ["l", "g", "o", "value", "terms"])

        cells = of_groups.unionByName(of_terms).groupBy("l", "x", "y", "t").applyInArrow(summed, "l long, g long, o long, value long, terms long")
        sums = written(cells.groupBy("l", "g", "o").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms")), "pairs")
        both = sums.unionByName(sums.select("l", F.col("o").alias("g"), F.col("g").alias("o"), "value", "terms"))
        a = groups.select("l", "g", "kinds", "none")
        b = groups.select("l", F.col("g").alias("o"), F.col("none").alias("other"))
        every = a.join(b, "l").where("g <> o").join(both, ["l", "g", "o"], "left")
        value = F.expr(f"if(kinds = 0, 0, coalesce(value, 0) + (kinds - coalesce(terms, 0)) * ({apart('none', 'other')}))")
        return every.select("l", "g", "o", value.alias("value"))

    def terms(self, best: int = BEST) -> DataFrame:
        """g, term, value, rank: the terms of each group that stand out most against its language."""
        langs = self.entries.groupBy("l", "digest", "split").agg(F.sum("n").alias("of_lang"))
        known = self.groups.select("l", "kinds", "lang_total").distinct()
        langs = langs.join(known, "l").select("l", "digest", "split", F.expr(share("of_lang", "lang_total", "kinds")).alias("q"))
        found = self.shares().join(langs, ["l", "digest", "split"]).where("p > q").select("g", "digest", "split", F.expr(apart("p", "q")).alias("value"))
        found = found.withColumn("salt", F.pmod(F.xxhash64("digest", "split"), F.lit(SALT)))
        for part in (["g", "salt"], ["g"]):
            by_value = Window.partitionBy(*part).orderBy(F.desc("value"))
            found = found.withColumn("r", F.rank().over(by_value)).where(F.col("r") <= best)
        found = found.join(self.texts, "digest").withColumn("term", F.when(F.col("split") == "", F.col("term")).otherwise(F.col("split")))
        for part in (["g", "salt"], ["g"]):
            by_text = Window.partitionBy(*part).orderBy(F.desc("value"), "term")
            found = found.withColumn("r", F.row_number().over(by_text)).where(F.col("r") <= best)
        return found.select("g", "term", "value", F.col("r").alias("rank"))


def report(docs: DataFrame, bits: int = 64) -> DataFrame:
    """lang, source, part, item, value, rank: all other sources of each source's language, and its best terms."""
    made = Profile(docs, bits)
    names = made.groups.select("g", "lang", "source")
    pairs = made.pairs().join(names, "g").join(names.select(F.col("g").alias("o"), F.col("source").alias("item")), "o")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    terms = made.terms().join(names, "g").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pairs.unionByName(terms)


ORACLE = r"""
WITH docs AS (
    SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents
), terms AS (
    SELECT d, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), vocabulary AS (
    SELECT lang, term FROM terms GROUP BY ALL HAVING count(DISTINCT d) >= 10
), groups AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (SELECT lang, count(*) AS v FROM vocabulary GROUP BY ALL),
counts AS (SELECT lang, source, term, count(*) AS c FROM terms JOIN vocabulary USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL),
shares AS (
    SELECT g.lang, g.source, v.term, coalesce(c.c, 0) AS c,
           (1 + (1000000000 * (coalesce(c.c, 0) + 2)::HUGEINT) // (coalesce(t.n, 0) + 2 * s.v)::HUGEINT)::HUGEINT AS p
    FROM groups g JOIN vocabulary v USING (lang) JOIN sizes s USING (lang) LEFT JOIN totals t USING (lang, source) LEFT JOIN counts c USING (lang, source, term)
), langs AS (
    SELECT c.lang, c.term, (1 + (1000000000 * (sum(c.c) + 2)::HUGEINT) // (any_value(x.n) + 2 * any_value(s.v))::HUGEINT)::HUGEINT AS q
    FROM counts c JOIN (SELECT lang, sum(n) AS n FROM totals GROUP BY ALL) x USING (lang) JOIN sizes s USING (lang) GROUP BY ALL
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL
), every AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
    FROM groups a JOIN groups b USING (lang) LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source WHERE a.source <> b.source
), best AS (
    SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM shares JOIN langs USING (lang, term) WHERE c > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM every
UNION ALL
SELECT * FROM (SELECT lang, source, 'term', item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM best) WHERE rank <= 10
"""
