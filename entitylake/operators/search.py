"""Ranked retrieval on texts and on index tables.

*On texts* (``search_texts``, ``boolean_search``, ``phrase_search``): each document
is matched and scored inside its row against all queries at once.  What is shuffled
is a few numbers per document, once, and the best ``top`` rows per query.

*On index tables* (``search_index``, ``fuzzy_search``, ``score_index``): postings are
joined with the query terms, scores summed per (query, document).  ``score_index``
takes the queries as a table of any size.

Scores are rounded to ``DECIMALS`` so that ties do not depend on summation order;
ties are broken by document id.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from entitylake.functions import text as X
from entitylake.functions.binding import keep_if, let, record
from entitylake.operators.index import BUCKETS, Tokenizer, bucket_of
from entitylake.rules import BM25_B, BM25_K1, MAX_EDITS
from entitylake.sources.stage import staged

DECIMALS = 6
# Tokens are neither empty nor blank, so these keys can stand beside terms.
NO_TERM = ""  # a document's length, the collection's totals
PHRASE = " "  # a phrase's frequency


@dataclass(frozen=True)
class Totals:
    """Collection statistics a weight may use: all are columns."""

    n_docs: Column
    total_len: Column


# weight(tf, df, doc_len, totals): what one query term adds to a document's score
Weight = Callable[[Column, Column, Column, Totals], Column]


def tfidf_classic(tf: Column, df: Column, doc_len: Column, totals: Totals) -> Column:
    return tf * F.ln(totals.n_docs / df)


def tfidf_smooth(tf: Column, df: Column, doc_len: Column, totals: Totals) -> Column:
    return tf * F.ln(1 + totals.n_docs / (1 + df))


def bm25_idf(df: Column, n_docs: Column) -> Column:
    return F.ln(1 + (n_docs - df + 0.5) / (df + 0.5))


def bm25_norm(tf: Column, doc_len: Column, totals: Totals) -> Column:
    relative = doc_len * totals.n_docs / totals.total_len
    return tf / (tf + BM25_K1 * (1 - BM25_B + BM25_B * relative))


def bm25(tf: Column, df: Column, doc_len: Column, totals: Totals) -> Column:
    """Okapi BM25 with exact document lengths."""
    return bm25_idf(df, totals.n_docs) * bm25_norm(tf, doc_len, totals)


WEIGHTS: dict[str, Weight] = {
    "tfidf_classic": tfidf_classic,
    "tfidf_smooth": tfidf_smooth,
    "bm25": bm25,
}


def _literals(queries: Sequence[str]) -> Column:
    """The caller's texts; a large set of queries is a table, see ``query_table_terms``."""
    if not queries:
        raise ValueError("give at least one query text")
    return F.array(*[F.lit(q) for q in queries])


def query_table_terms(queries: DataFrame, tokenizer: Tokenizer = X.tokens, text: str = "query") -> DataFrame:
    """(query, term, qtf, n_terms) of a table of query texts of any size."""
    each = queries.select(F.col(text).alias("query")).where("query IS NOT NULL").distinct()
    counted = each.select("query", X.term_counts(tokenizer(F.col("query"))).alias("terms"))
    return counted.select("query", F.size("terms").alias("n_terms"), F.inline("terms")).select(
        "query", "term", F.col("tf").alias("qtf"), "n_terms"
    )


def query_terms(spark: SparkSession, queries: Sequence[str], tokenizer: Tokenizer = X.tokens) -> DataFrame:
    """(query, term, qtf, n_terms) of the given texts; repeated tokens count in ``qtf``.

    ``n_terms`` is the number of distinct terms of the query.
    """
    return query_table_terms(spark.range(1).select(F.explode(_literals(queries)).alias("query")), tokenizer)


# --- on texts ---------------------------------------------------------------


def _parse(spark: SparkSession, queries: Sequence[str], tokenizer: Tokenizer) -> list[tuple[str, list[str]]]:
    """The caller's query texts with their tokens, cut by the same expression as documents."""
    parsed = F.transform(
        F.array_distinct(_literals(queries)), lambda q: record(query=q, tokens=tokenizer(q))
    )
    return [(q["query"], list(q["tokens"])) for q in spark.range(1).select(parsed).first()[0]]


def _string_array(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _term_maps(
    docs: DataFrame,
    terms: Sequence[str],
    doc_id: str,
    text: str,
    tokenizer: Tokenizer,
    phrase: Sequence[str] = (),
) -> DataFrame:
    """(doc_id, tfs) per document with tokens: how often it has each of ``terms``.

    ``tfs`` holds the document's length under ``NO_TERM`` and, where it occurs, the
    frequency of ``phrase`` under ``PHRASE``.  This small map per document is
    exchanged once: statistics and scores both read it from there, so the texts
    are scanned and cut once.
    """
    wanted = list(dict.fromkeys(terms))

    def occurrences(t: Column) -> Column:
        starts = F.filter(
            F.transform(t, lambda w, i: F.when(w == phrase[0], i + 1)),
            lambda i: i.isNotNull() & (F.slice(t, i, len(phrase)) == _string_array(phrase)),
        )
        found = F.size(starts)
        return F.filter(F.array(record(term=F.lit(PHRASE), tf=found)), lambda e: e["tf"] > 0)

    def entries(t: Column) -> Column:
        counts = [
            F.array(record(term=F.lit(NO_TERM), tf=F.size(t))),
            X.term_counts(F.filter(t, lambda x: x.isin(wanted))),
        ]
        if phrase:
            counts.append(occurrences(t))
        return record(tfs=F.map_from_entries(F.concat(*counts)), doc_len=F.size(t))

    found = let(tokenizer(F.col(text)), entries)
    return (
        docs.select(doc_id, keep_if(found, lambda r: r["doc_len"] > 0))
        .select(doc_id, "tfs")
        .repartition(doc_id)
    )


def _statistics(maps: DataFrame, doc_id: str) -> Column:
    """Scalar map: term -> (documents with it, their total length), bounded by the query terms.

    Documents are counted by their id so that all columns of ``maps`` are read
    here as in the scores; otherwise its exchange would be built twice.
    """
    rows = maps.select(
        doc_id, F.element_at("tfs", F.lit(NO_TERM)).alias("doc_len"), F.explode(F.map_keys("tfs")).alias("term")
    )
    per_term = rows.groupBy("term").agg(
        F.count(doc_id).alias("n"), F.sum("doc_len").alias("len")
    )
    return per_term.agg(
        F.map_from_entries(F.collect_list(F.struct("term", F.struct("n", "len"))))
    ).scalar()


def _totals(stats: Column) -> Totals:
    whole = F.element_at(stats, F.lit(NO_TERM))
    return Totals(whole["n"], whole["len"])


def _sum_of_weights(terms: Column, weigh: Weight) -> Column:
    """Sum over ``terms`` of their weights in the row's ``tfs``; absent terms add nothing."""

    def add(total: Column, term: Column) -> Column:
        tf = F.element_at(F.col("tfs"), term)
        df = F.element_at(F.col("stats"), term)["n"]
        doc_len = F.element_at(F.col("tfs"), F.lit(NO_TERM))
        return total + F.coalesce(weigh(tf, df, doc_len, _totals(F.col("stats"))), F.lit(0.0))

    return F.round(F.aggregate(terms, F.lit(0.0), add), DECIMALS)


def top_ranked(scores: DataFrame, top: int, doc_id: str = "doc_id", by: Sequence[str] = ("query",)) -> DataFrame:
    """The best ``top`` rows per query with their ``rank``; limited before the shuffle too."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col(doc_id))
    ranked = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select(*by, "rank", doc_id, "score")


def _queries_by_term(parsed: list[tuple[str, list[str]]]) -> Callable[[Column], Column]:
    """Looks up the queries that have a term, so a row meets only those of the terms it has."""
    by_term: dict[str, list[Column]] = {}
    for q, ts in parsed:
        asked = F.struct(F.lit(q).alias("query"), _string_array(ts).alias("tokens"))
        for t in dict.fromkeys(ts):
            by_term.setdefault(t, []).append(asked)
    nothing = F.array().cast("array<struct<query:string,tokens:array<string>>>")
    if not by_term:
        return lambda term: nothing
    known = F.create_map(*[x for t, qs in by_term.items() for x in (F.lit(t), F.array(*qs))])
    return lambda term: F.coalesce(F.element_at(known, term), nothing)


def score_texts(
    docs: DataFrame,
    queries: Sequence[str],
    weight: str | Weight = "tfidf_smooth",
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: Tokenizer = X.tokens,
) -> DataFrame:
    """(query, doc_id, score) of every document that holds a term of the query.

    A query term counts as often as it is repeated; a document that matches is
    listed even with score 0.
    """
    weigh = WEIGHTS[weight] if isinstance(weight, str) else weight
    parsed = _parse(docs.sparkSession, queries, tokenizer)
    maps = _term_maps(docs, [t for _, ts in parsed for t in ts], doc_id, text, tokenizer)
    concerned = F.array_distinct(F.flatten(F.transform(F.map_keys("tfs"), _queries_by_term(parsed))))
    pairs = maps.select(doc_id, "tfs", F.explode(concerned).alias("q"))
    rows = pairs.select("*", _statistics(maps, doc_id).alias("stats"))
    return rows.select(
        F.col("q.query").alias("query"), doc_id, _sum_of_weights(F.col("q.tokens"), weigh).alias("score")
    )


def search_texts(
    docs: DataFrame,
    queries: Sequence[str],
    weight: str | Weight = "tfidf_smooth",
    top: int = 10,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: Tokenizer = X.tokens,
) -> DataFrame:
    """(query, rank, doc_id, score): the best ``top`` documents of each query."""
    return top_ranked(score_texts(docs, queries, weight, doc_id, text, tokenizer), top, doc_id)


def boolean_search(
    docs: DataFrame,
    must: Sequence[str] = (),
    should: Sequence[str] = (),
    must_not: Sequence[str] = (),
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: Tokenizer = X.words,
) -> DataFrame:
    """(doc_id, score) of the documents with all ``must`` terms, no ``must_not`` term and,
    when there is no ``must``, at least one ``should`` term.

    Scored by BM25 over must and should terms.  Terms are given as single tokens.
    """
    wanted = [*must, *should]
    if not wanted:
        raise ValueError("give at least one must or should term")
    maps = _term_maps(docs, [*wanted, *must_not], doc_id, text, tokenizer)
    have = F.map_keys("tfs")
    hit = (
        F.forall(_string_array(must), lambda t: F.array_contains(have, t))
        if must
        else F.arrays_overlap(have, _string_array(should))
    )
    if must_not:
        hit = hit & ~F.arrays_overlap(have, _string_array(must_not))
    kept = maps.select(doc_id, keep_if(record(tfs=F.col("tfs"), hit=hit), lambda r: r["hit"]))
    scored = kept.select(doc_id, "tfs", _statistics(maps, doc_id).alias("stats"))
    return scored.select(doc_id, _sum_of_weights(_string_array(wanted), bm25).alias("score"))


def phrase_search(
    docs: DataFrame,
    phrase: str,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: Tokenizer = X.words,
) -> DataFrame:
    """(doc_id, phrase_freq, score) of the documents holding the words in this order.

    Scored by BM25 with the phrase's frequency and the sum of its terms' weights.
    The words of the phrase are compared at the positions of its first word only.
    """
    ((_, terms),) = _parse(docs.sparkSession, [phrase], tokenizer)
    if not terms:
        raise ValueError("the phrase holds no word")
    maps = _term_maps(docs, terms, doc_id, text, tokenizer, phrase=terms)
    frequency = F.element_at("tfs", F.lit(PHRASE))
    kept = maps.select(
        doc_id,
        keep_if(record(tfs=F.col("tfs"), phrase_freq=frequency), lambda r: r["phrase_freq"].isNotNull()),
    )
    scored = kept.select(doc_id, "tfs", "phrase_freq", _statistics(maps, doc_id).alias("stats"))

    def weigh(tf: Column, df: Column, doc_len: Column, totals: Totals) -> Column:
        return bm25_idf(df, totals.n_docs) * bm25_norm(F.col("phrase_freq"), doc_len, totals)

    return scored.select(doc_id, "phrase_freq", _sum_of_weights(_string_array(terms), weigh).alias("score"))


# --- on index tables --------------------------------------------------------


def collection_totals(lengths: DataFrame) -> Totals:
    """Totals of a table with one ``doc_len`` per document."""
    both = lengths.agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum("doc_len").alias("len"))).scalar()
    return Totals(both["n"], both["len"])


def score_index(
    postings: DataFrame,
    terms: DataFrame,
    totals: Totals,
    asked: DataFrame,
    weight: str | Weight = "tfidf_smooth",
    doc_id: str = "doc_id",
    small_query_table: bool = False,
    buckets: int = BUCKETS,
) -> DataFrame:
    """(query, doc_id, score) from ``postings(term, doc_id, tf, doc_len)`` and ``terms(term, df)``.

    ``asked`` is a (query, term, qtf) table; an optional ``boost`` column scales a
    term's part and an optional ``df`` saves looking it up in ``terms``.  With
    ``small_query_table`` it is broadcast: set it only for a table whose size is
    checked, such as those made by ``query_terms``.  Otherwise Spark picks
    the join by size and splits hot terms.  Stored postings are joined by bucket
    and term, so that a small set of terms prunes the folders to read.
    """
    weigh = WEIGHTS[weight] if isinstance(weight, str) else weight
    boost = F.col("boost") if "boost" in asked.columns else F.lit(1.0)
    weighted = asked
    if "df" not in asked.columns:
        few = F.broadcast(asked) if small_query_table else asked
        weighted = few.join(terms.select("term", "df"), "term")
    keys = ["term"]
    if "bucket" in postings.columns:
        keys = ["bucket", "term"]
        weighted = weighted.withColumn("bucket", bucket_of("term", buckets))
    hits = postings.join(F.broadcast(weighted) if small_query_table else weighted, keys)
    part = F.col("qtf") * boost * weigh(F.col("tf"), F.col("df"), F.col("doc_len"), totals)
    return (
        hits.groupBy("query", doc_id)
        .agg(F.sum(part).alias("score"))
        .select("query", doc_id, F.round("score", DECIMALS).alias("score"))
    )


def score_by_document(
    postings: DataFrame,
    totals: Totals,
    asked: DataFrame,
    weight: str | Weight = "tfidf_smooth",
    doc_id: str = "doc_id",
) -> tuple[DataFrame, DataFrame]:
    """(_query, doc_id, score) of a table of queries and (_query, query), its texts by number.

    As ``score_index``, for pairs of queries and documents that are many more than postings.
    A document's postings are brought together once, so that its pairs are made, added up
    and ranked in its task: neither pairs nor the texts of queries are shuffled.
    ``asked`` is a (query, term, qtf) table, ``postings`` those of its terms at least;
    both are read several times.
    """
    weigh = WEIGHTS[weight] if isinstance(weight, str) else weight
    # written, so that all scans see the same numbers and Spark knows the sizes
    numbers = staged(asked.select("query").distinct().withColumn("_query", F.monotonically_increasing_id()))
    terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = staged(asked.join(terms, "term").join(numbers, "query").select("_query", "term", "qtf", "df"))
    hits = postings.select(doc_id, "term", "tf", "doc_len").repartition(doc_id).join(weighted, "term")
    part = F.col("qtf") * weigh(F.col("tf"), F.col("df"), F.col("doc_len"), totals)
    scores = hits.groupBy("_query", doc_id).agg(F.sum(part).alias("score"))
    return scores.select("_query", doc_id, F.round("score", DECIMALS).alias("score")), numbers


def search_by_document(
    postings: DataFrame, totals: Totals, asked: DataFrame, weight: str | Weight = "tfidf_smooth", top: int = 10, doc_id: str = "doc_id"
) -> DataFrame:
    """(query, rank, doc_id, score): the best ``top`` documents of each query, by ``score_by_document``."""
    scores, numbers = score_by_document(postings, totals, asked, weight, doc_id)
    ranked = top_ranked(scores, top, doc_id, ["_query"])
    return ranked.join(numbers, "_query").select("query", "rank", doc_id, "score")


def search_index(
    postings: DataFrame,
    terms: DataFrame,
    totals: Totals,
    queries: Sequence[str],
    weight: str | Weight = "tfidf_smooth",
    top: int = 10,
    doc_id: str = "doc_id",
    tokenizer: Tokenizer = X.tokens,
    buckets: int = BUCKETS,
) -> DataFrame:
    """(query, rank, doc_id, score) of given query texts from index tables.

    The terms are literals in the filters of both tables: of stored tables only
    the folders and row groups that hold them are read.
    """
    spark = postings.sparkSession
    wanted = sorted({t for _, ts in _parse(spark, queries, tokenizer) for t in ts})
    here = F.col("term").isin(wanted)
    posts = postings.where(here)
    if "bucket" in postings.columns and wanted:
        # Constant, hence computed while planning: only these folders are listed.
        posts = posts.where(F.col("bucket").isin([bucket_of(F.lit(t), buckets) for t in wanted]))
    asked = query_terms(spark, queries, tokenizer)
    scores = score_index(posts, terms.where(here), totals, asked, weight, doc_id, True, buckets)
    return top_ranked(scores, top, doc_id)


def _cut(length: Column, pieces: int, i: int) -> Column:
    """Where the i-th of so many nearly equal pieces of a word begins."""
    return F.floor(length * i / pieces).cast("int")


def fuzzy_candidates(
    terms: DataFrame, wanted: DataFrame, max_edits: int = MAX_EDITS, lengths: Sequence[int] | None = None
) -> DataFrame:
    """(query_term, term, df): pairs among which are all within ``max_edits`` edits.

    A word is cut into ``max_edits + 1`` pieces; so many edits leave one piece whole,
    moved by at most as many places.  Both sides give keys (length of the wanted word,
    number of the piece, piece): the wanted word its own pieces, a term what stands in
    the places where a piece may be, for each length within reach.  ``lengths`` are those
    of the wanted words, where the caller knows them: terms far from all of them give no key.
    """
    pieces = max_edits + 1

    def of_word(word: Column) -> Column:
        n = F.length(word)
        return F.array(*[
            F.struct(n.alias("n"), F.lit(i).alias("i"), F.substring(word, _cut(n, pieces, i) + 1, _cut(n, pieces, i + 1) - _cut(n, pieces, i)).alias("piece"))
            for i in range(pieces)
        ])

    def of_term(term: Column) -> Column:
        """Only the places that the edits before and behind a piece allow: 19 for two edits."""
        keys = []
        known = (lambda n: n.isin(sorted(set(lengths)))) if lengths is not None else (lambda n: n > 0)
        for longer in range(-max_edits, max_edits + 1):
            n = F.length(term) - longer
            for i in range(pieces):
                start, size = _cut(n, pieces, i), _cut(n, pieces, i + 1) - _cut(n, pieces, i)
                for shift in range(max(-i, longer - (max_edits - i)), min(i, longer + max_edits - i) + 1):
                    inside = known(n) & (start + shift >= 0) & (start + shift + size <= F.length(term))
                    piece = F.when(inside, F.substring(term, start + shift + 1, size))
                    keys.append(F.struct(n.alias("n"), F.lit(i).alias("i"), piece.alias("piece")))
        return F.array(*keys)

    asked = wanted.select(F.col("term").alias("query_term")).distinct()
    left = asked.select("query_term", F.inline(of_word(F.col("query_term"))))
    if lengths is not None:
        near = sorted({n + d for n in lengths for d in range(-max_edits, max_edits + 1)})
        terms = terms.where(F.length("term").isin(near))
    right = terms.select("term", "df", F.inline(of_term(F.col("term")))).where("piece IS NOT NULL")
    return right.join(left, ["n", "i", "piece"]).select("query_term", "term", "df").distinct()


#: Letters of a word that its deletion variants are made of: more give more variants, fewer more candidates.
VARIANT_LETTERS = 7


def variants_of(word: Column, max_edits: int = MAX_EDITS, letters: int = VARIANT_LETTERS) -> Column:
    """The strings left of a word's first letters when up to ``max_edits`` of them are deleted.

    Words within so many edits have one in common: what both keep of their beginnings, in
    order, when each drops the letters that the other lacks.
    """

    def shorter(words: Column) -> Column:
        def each(w: Column) -> Column:
            places = F.slice(F.sequence(F.lit(1), F.lit(letters)), F.lit(1), F.length(w))
            return F.transform(places, lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))

        return F.array_distinct(F.flatten(F.transform(words, each)))

    found = [F.array(F.left(word, F.lit(letters)))]
    for _ in range(max_edits):
        found.append(let(found[-1], shorter))
    return F.array_distinct(F.concat(*found))


def deletion_variants(terms: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """(variant, term, df): the table by which fuzzy queries find vocabulary terms, 29 rows a term at most.

    To be stored with the vocabulary (``writers.write_variants``): a query then looks up
    its own variants and nothing else of it.
    """
    return terms.select(F.explode(variants_of(F.col("term"), max_edits)).alias("variant"), "term", "df")


def fuzzy_terms(
    terms: DataFrame,
    queries: Sequence[str] | DataFrame,
    max_edits: int = MAX_EDITS,
    tokenizer: Tokenizer = X.words,
    variants: DataFrame | None = None,
) -> DataFrame:
    """(query, query_term, term, df, edits, boost): vocabulary terms within the edit distance.

    ``queries`` are texts or a table with a column ``query``.  With ``variants``, the stored
    ``deletion_variants`` for at least so many edits, the words look up their own; without,
    candidates come from an equi-join on pieces of the words.  Either way the vocabulary is
    not multiplied by the query terms.  The edit distance, which stops at the bound, decides.  A swap of neighbours counts as two edits.  ``boost`` falls
    with the edits relative to the shorter word.
    """
    given = not isinstance(queries, DataFrame)
    wanted = query_terms(terms.sparkSession, queries, tokenizer) if given else query_table_terms(queries, tokenizer)
    if variants is not None:
        asked = wanted.select(F.col("term").alias("query_term")).distinct()
        asked = asked.select("query_term", F.explode(variants_of(F.col("query_term"), max_edits)).alias("variant"))
        candidates = variants.join(asked, "variant").select("query_term", "term", "df").distinct()
    else:
        lengths = [len(t) for _, ts in _parse(terms.sparkSession, queries, tokenizer) for t in ts] if given else None
        candidates = fuzzy_candidates(terms, wanted, max_edits, lengths)
    candidates = candidates.withColumn("edits", F.levenshtein("term", "query_term", max_edits)).where("edits >= 0")
    shorter = F.least(F.length("term"), F.length("query_term"))
    boost = (1 - F.col("edits") / shorter).alias("boost")
    close = candidates.select("query_term", "term", "df", "edits", boost).where("boost > 0")
    asked = wanted.select("query", F.col("term").alias("query_term"))
    return close.join(asked, "query_term").select("query", "query_term", "term", "df", "edits", "boost")


def fuzzy_search(
    postings: DataFrame,
    terms: DataFrame,
    totals: Totals,
    queries: Sequence[str],
    max_edits: int = MAX_EDITS,
    top: int = 10,
    doc_id: str = "doc_id",
    tokenizer: Tokenizer = X.words,
    buckets: int = BUCKETS,
    variants: DataFrame | None = None,
    close: DataFrame | None = None,
) -> DataFrame:
    """BM25 over all close terms, each scaled by its boost; none of them is cut off.

    Spark decides by size how the close terms meet the postings; ``close`` are the
    ``fuzzy_terms`` of the queries where the caller has written them, so that it knows it.
    """
    if close is None:
        close = fuzzy_terms(terms, queries, max_edits, tokenizer, variants)
    scores = score_index(postings, terms, totals, close.withColumn("qtf", F.lit(1)), "bm25", doc_id, False, buckets)
    return top_ranked(scores, top, doc_id)


# --- on an index with positions -----------------------------------------------


def _field_terms(occurrences: DataFrame, field: str, terms: Sequence[str], buckets: int) -> DataFrame:
    """The occurrences of given terms in a field: of stored ones only their folders and row groups are read."""
    found = occurrences.where((F.col("field") == field) & F.col("term").isin(list(terms)))
    if "bucket" in occurrences.columns and terms:
        found = found.where(F.col("bucket").isin([bucket_of(F.lit(t), buckets) for t in terms]))
    return found


def _field_statistics(per_term: DataFrame, totals: DataFrame, field: str) -> tuple[Column, Totals]:
    """Scalar map term -> documents with it, bounded by the query terms, and the field's totals."""
    counts = per_term.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = counts.agg(F.map_from_entries(F.collect_list(F.struct("term", "df")))).scalar()
    whole = totals.where(F.col("field") == field).agg(F.struct(F.max("n_docs").alias("n"), F.max("total_len").alias("len"))).scalar()
    return df, Totals(whole["n"], whole["len"])


def boolean_index(
    occurrences: DataFrame,
    totals: DataFrame,
    must: Sequence[str] = (),
    should: Sequence[str] = (),
    must_not: Sequence[str] = (),
    field: str = "content",
    top: int = 10,
    doc_id: str = "doc_id",
    buckets: int = BUCKETS,
) -> DataFrame:
    """(rank, doc_id, score): the best ``top`` documents by BM25 over must and should terms.

    As ``boolean_search``, on ``index.field_occurrences`` and ``index.field_totals``.
    """
    wanted = list(dict.fromkeys([*must, *should]))
    if not wanted:
        raise ValueError("give at least one must or should term")
    hits = _field_terms(occurrences, field, [*wanted, *must_not], buckets)
    per_term = hits.groupBy(doc_id, "term").agg(F.count(F.lit(1)).alias("tf"), F.max("doc_len").alias("doc_len"))
    df, whole = _field_statistics(per_term, totals, field)
    weighted = per_term.withColumn("w", bm25(F.col("tf"), F.element_at(df, F.col("term")), F.col("doc_len"), whole))
    times = F.element_at(F.create_map(*[x for t in wanted for x in (F.lit(t), F.lit([*must, *should].count(t)))]), F.col("term"))
    term = F.col("term")
    per_doc = weighted.groupBy(doc_id).agg(
        F.round(F.sum(F.when(term.isin(wanted), F.col("w") * times)), DECIMALS).alias("score"),
        F.count_if(term.isin(list(must))).alias("has"),
        F.count_if(term.isin(list(must_not))).alias("barred"),
    )
    kept = per_doc.where((F.col("has") == len(set(must))) & (F.col("barred") == 0) & F.col("score").isNotNull())
    return top_ranked(kept.withColumn("query", F.lit(0)), top, doc_id).drop("query")


def phrase_index(
    occurrences: DataFrame,
    totals: DataFrame,
    phrase: str,
    field: str = "content",
    top: int = 10,
    doc_id: str = "doc_id",
    tokenizer: Tokenizer = X.words,
    buckets: int = BUCKETS,
) -> DataFrame:
    """(rank, doc_id, phrase_freq, score): the best ``top`` documents with the words in this order.

    Positions come from the index: each hit is moved back to the phrase's start, and a
    start with as many hits as the phrase has words is one occurrence.
    """
    ((_, words),) = _parse(occurrences.sparkSession, [phrase], tokenizer)
    if not words:
        raise ValueError("the phrase holds no word")
    hits = _field_terms(occurrences, field, list(dict.fromkeys(words)), buckets)
    per_term = hits.groupBy(doc_id, "term").agg(F.count(F.lit(1)).alias("tf"))
    df, whole = _field_statistics(per_term, totals, field)
    places = F.filter(
        F.transform(_string_array(words), lambda w, i: F.when(w == F.col("term"), i)), lambda i: i.isNotNull()
    )
    starts = hits.select(doc_id, "doc_len", F.explode(F.transform(places, lambda i: F.col("pos") - i)).alias("start"))
    whole_phrase = starts.groupBy(doc_id, "start").agg(F.count(F.lit(1)).alias("hits"), F.max("doc_len").alias("doc_len"))
    found = whole_phrase.where(F.col("hits") == len(words)).groupBy(doc_id)
    found = found.agg(F.count(F.lit(1)).cast("int").alias("phrase_freq"), F.max("doc_len").alias("doc_len"))
    idf = sum((bm25_idf(F.element_at(df, F.lit(w)), whole.n_docs) for w in words), F.lit(0.0))
    score = F.round(idf * bm25_norm(F.col("phrase_freq"), F.col("doc_len"), whole), DECIMALS)
    scored = found.withColumn("score", score).withColumn("query", F.lit(0))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col(doc_id))
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("rank", doc_id, "phrase_freq", "score")


def search_field(
    occurrences: DataFrame,
    totals: DataFrame,
    queries: Sequence[str] | DataFrame,
    field: str = "content",
    weight: str | Weight = "bm25",
    top: int = 10,
    doc_id: str = "doc_id",
    tokenizer: Tokenizer = X.words,
) -> DataFrame:
    """(query, rank, doc_id, score) of query texts, or of a table of them, in one field."""
    many = isinstance(queries, DataFrame)
    asked = staged(query_table_terms(queries, tokenizer)) if many else query_terms(occurrences.sparkSession, queries, tokenizer)
    here = occurrences.where(F.col("field") == field).join(asked.select("term").distinct(), "term", "left_semi")
    posts = here.groupBy("term", doc_id).agg(F.count(F.lit(1)).alias("tf"), F.max("doc_len").alias("doc_len"))
    whole = totals.where(F.col("field") == field).agg(F.struct(F.max("n_docs").alias("n"), F.max("total_len").alias("len"))).scalar()
    if many:
        return search_by_document(staged(posts), Totals(whole["n"], whole["len"]), asked, weight, top, doc_id)
    terms = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return top_ranked(score_index(posts, terms, Totals(whole["n"], whole["len"]), asked, weight, doc_id), top, doc_id)


def phrase_postings(
    positions: DataFrame, spark: SparkSession, phrase: str, doc_id: str = "doc_id",
    tokenizer: Tokenizer = X.words,
) -> DataFrame:
    """(doc_id, phrase_freq) from ``positional_postings``: all words at consecutive positions.

    Each hit is moved back to the phrase's start, so a (document, start) pair with
    as many hits as the phrase has words is one occurrence.
    """
    words = spark.range(1).select(
        F.size(tokenizer(F.lit(phrase))).alias("n"), F.posexplode(tokenizer(F.lit(phrase))).alias("i", "term")
    )
    starts = positions.join(F.broadcast(words), "term").groupBy(
        doc_id, (F.col("pos") - F.col("i")).alias("start"), "n"
    )
    whole = starts.agg(F.count(F.lit(1)).alias("hits")).where("hits = n")
    return whole.groupBy(doc_id).agg(F.count(F.lit(1)).cast("int").alias("phrase_freq"))


def with_documents(
    ranked: DataFrame, docs: DataFrame, columns: Sequence[str], doc_id: str = "doc_id", default: str = "Unknown"
) -> DataFrame:
    """Ranked rows with document columns; a missing document or value gives ``default``.

    Spark picks the join by the size of ``ranked``, ``top`` rows per query: few are
    broadcast, and then the documents are not shuffled.
    """
    joined = docs.select(doc_id, *columns).join(ranked, doc_id, "right")
    return joined.select(
        *ranked.columns, *[F.coalesce(F.col(c).cast("string"), F.lit(default)).alias(c) for c in columns]
    )


def compare_methods(
    first: DataFrame, second: DataFrame, top: int = 5, doc_id: str = "doc_id"
) -> DataFrame:
    """Two ranked results side by side: one row per query and rank that either has."""

    def side(ranked: DataFrame, name: str) -> DataFrame:
        return ranked.where(F.col("rank") <= top).select(
            "query", "rank", F.col(doc_id).alias(f"{name}_id"), F.col("score").alias(f"{name}_score")
        )

    return side(first, "first").join(side(second, "second"), ["query", "rank"], "full")
