"""Index tables, ranked retrieval and its evaluation on the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindings import ORACLES, query, table
from bindings import sqltext as S
from bindings.derived import documents, records
from bindings.records import DOCUMENT_SQL
from entitylake.functions import text as X
from entitylake.operators import blocks, evaluate, index, search
from entitylake.operators.documents import build_field_documents
from entitylake.sources import segments, writers
from entitylake.sources.stage import fresh_folder, staged

QUERIES = ("the and that", "les des pour les", "der die und", "thereat other ertion", "nowhere zzz", "los las para")
FUZZY = ("therat", "mentoi")


def _values(queries) -> str:
    return ", ".join(f"('{q}')" for q in queries)


def collection_sql(tokens, source: str = "documents", doc_id: str = "doc_id", text: str = "text") -> str:
    """CTEs toks, lens, tf, df and n of a collection."""
    return f"""toks AS (SELECT {doc_id} AS doc_id, {tokens(text)} AS t FROM {source}),
lens AS (SELECT doc_id, len(t) AS doc_len FROM toks WHERE len(t) > 0),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM toks) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
n AS (SELECT count(*)::DOUBLE AS n, sum(doc_len)::DOUBLE AS total FROM lens)"""


def asked_sql(tokens, queries) -> str:
    return f"""asked AS (SELECT query, unnest({tokens('query')}) AS term
  FROM (SELECT DISTINCT query FROM (VALUES {_values(queries)}) AS v(query)))"""


WEIGHT_SQL = {
    "tfidf_classic": "tf * ln(n / df)",
    "tfidf_smooth": "tf * ln(1 + n / (1 + df))",
    "bm25": "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * doc_len * n / total))",
}


def ranked_sql(weight: str, tokens, queries, top: int = 10, **collection) -> str:
    return f"""{collection_sql(tokens, **collection)}, {asked_sql(tokens, queries)},
scores AS (SELECT query, doc_id, round(sum({WEIGHT_SQL[weight]}), 6) AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN lens USING (doc_id), n GROUP BY 1, 2),
ranked AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id)::INTEGER AS rank,
  doc_id, score FROM scores QUALIFY rank <= {top})"""


# --- index tables ---------------------------------------------------------------


@query(
    "postings",
    f"""WITH {collection_sql(S.tokens)} SELECT doc_id, term, tf::INTEGER AS tf, doc_len::INTEGER AS doc_len
FROM tf JOIN lens USING (doc_id)""",
)
def postings(spark, sf):
    return index.postings(documents(spark, sf, "text"))


@query("doc_lengths", f"WITH {collection_sql(S.tokens)} SELECT doc_id, doc_len::INTEGER AS doc_len FROM lens")
def doc_lengths(spark, sf):
    return index.doc_lengths(documents(spark, sf, "text"))


@query(
    "idf_table",
    f"""WITH {collection_sql(S.tokens)} SELECT term, df, round(log10(n / df), 6) AS idf_basic,
  round(log10(1 + n / (1 + df)), 6) AS idf_smooth FROM df, n""",
)
def idf_table(spark, sf):
    terms = index.terms_of_texts(documents(spark, sf, "text"))
    return terms.withColumns({c: F.round(c, 6) for c in ("idf_basic", "idf_smooth")})


FIELDS = ["name", "genres", "area", "content"]
EXACT = ["doc_id", "type"]


def _field_sql(field: str) -> str:
    column = {"name": "d_name", "genres": "coalesce(array_to_string(categories, ' '), '')", "area": "d_area"}.get(
        field,
        "concat_ws(' ', d_name, nullif(array_to_string(categories, ' '), ''), coalesce(type, wiki_type, 'Unknown'),"
        " d_area, abstract, nullif(rel_titles, ''))",
    )
    return f"SELECT '{field}' AS field, uuid AS doc_id, {S.words(column)} AS t FROM filled"


FIELD_SQL = f"""{DOCUMENT_SQL},
fields AS ({' UNION ALL '.join(_field_sql(f) for f in FIELDS)}
  UNION ALL SELECT 'doc_id', uuid, [uuid] FROM filled
  UNION ALL SELECT 'type', uuid, [coalesce(type, wiki_type, 'Unknown')] FROM filled),
field_tf AS (SELECT field, doc_id, term, count(*)::INTEGER AS tf, any_value(doc_len)::INTEGER AS doc_len
  FROM (SELECT field, doc_id, len(t) AS doc_len, unnest(t) AS term FROM fields) GROUP BY 1, 2, 3)"""


def field_index(spark, sf) -> DataFrame:
    return index.field_postings(build_field_documents(records(spark, sf)), FIELDS, EXACT)


@query("field_postings", f"WITH {FIELD_SQL} SELECT field, term, doc_id, tf, doc_len FROM field_tf")
def field_postings(spark, sf):
    return field_index(spark, sf)


# A refresh of the whole index: two sources come with new texts, one is emptied, conversations are added.
AFTER_SQL = """after AS (SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN text || ' refreshed words'
    WHEN source = 'src3' THEN '- -' ELSE text END AS text FROM documents
  UNION ALL SELECT 1000000000000 + conv_id * 1000 + turn, text FROM conversations)"""


def _versions(spark, sf):
    """All documents as they were, and what comes: changed, emptied and added ones."""
    docs = documents(spark, sf, "text", "source")
    changed = docs.where(F.col("source").isin("src1", "src2")).select("doc_id", F.concat("text", F.lit(" refreshed words")).alias("text"))
    emptied = docs.where("source = 'src3'").select("doc_id", F.lit("- -").alias("text"))
    turns = table(spark, sf, "conversations")
    added = turns.select((F.lit(10**12) + F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return docs.select("doc_id", "text"), changed.union(emptied).union(added)


@query(
    "index_upsert",
    f"""WITH {AFTER_SQL}, {collection_sql(S.tokens, source='after')}
SELECT doc_id, term, tf::INTEGER AS tf, doc_len::INTEGER AS doc_len FROM tf JOIN lens USING (doc_id)""",
)
def index_upsert(spark, sf):
    """Postings after the refresh, which has to equal an index built anew."""
    old, coming = _versions(spark, sf)
    return index.upsert_documents(index.postings(old), index.postings(coming), coming.select("doc_id").distinct())


@query(
    "index_upsert_stats",
    f"""WITH {AFTER_SQL}, a AS (SELECT doc_id, len({S.tokens('text')}) > 0 AS there FROM after),
b AS (SELECT doc_id, source, len({S.tokens('text')}) > 0 AS there FROM documents)
SELECT (SELECT count(*) FROM a LEFT JOIN b USING (doc_id) WHERE a.there AND NOT coalesce(b.there, false)) AS added,
  (SELECT count(*) FROM a JOIN b USING (doc_id) WHERE a.there AND b.there AND source IN ('src1', 'src2')) AS replaced,
  (SELECT count(*) FROM a JOIN b USING (doc_id) WHERE NOT a.there AND b.there) AS removed,
  (SELECT count(*) FROM a WHERE there) AS total""",
)
def index_upsert_stats(spark, sf):
    old, coming = _versions(spark, sf)
    return index.upsert_stats(index.doc_lengths(old), index.doc_lengths(coming), coming.select("doc_id"))


@query("index_refresh", ORACLES["index_upsert"])
def index_refresh(spark, sf):
    """Postings of a stored index after its refresh by a segment."""
    path = fresh_folder(spark)
    for docs in _versions(spark, sf):
        segments.refresh(docs, path, buckets=8)
    return segments.read(spark, path)[1].drop("bucket")


# --- ranked retrieval -----------------------------------------------------------


def _single(weight: str) -> str:
    return f"WITH {ranked_sql(weight, S.tokens, QUERIES[:1])} SELECT * FROM ranked"


@query("tfidf_classic", _single("tfidf_classic"))
def tfidf_classic(spark, sf):
    return search.search_texts(documents(spark, sf, "text"), QUERIES[:1], "tfidf_classic")


@query("tfidf_smooth", _single("tfidf_smooth"))
def tfidf_smooth(spark, sf):
    return search.search_texts(documents(spark, sf, "text"), QUERIES[:1], "tfidf_smooth")


@query("batch_search", f"WITH {ranked_sql('tfidf_smooth', S.tokens, QUERIES)} SELECT * FROM ranked")
def batch_search(spark, sf):
    return search.search_texts(documents(spark, sf, "text"), QUERIES, "tfidf_smooth")


@query("bm25", f"WITH {ranked_sql('bm25', S.words, QUERIES)} SELECT * FROM ranked")
def bm25(spark, sf):
    return search.search_texts(documents(spark, sf, "text"), QUERIES, "bm25", tokenizer=X.words)


def indexed(spark, sf, weight: str, queries, tokenizer=X.tokens, top: int = 10) -> DataFrame:
    """Ranked retrieval through index tables made on the way, in one pass over the texts."""
    counted = staged(index.count_terms(documents(spark, sf, "text"), tokenizer=tokenizer))
    posts = index.postings_of(counted)
    totals = search.collection_totals(counted)
    terms = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return search.search_index(posts, terms, totals, queries, weight, top, tokenizer=tokenizer)


@query("index_search", f"WITH {ranked_sql('bm25', S.words, QUERIES)} SELECT * FROM ranked")
def index_search(spark, sf):
    return indexed(spark, sf, "bm25", QUERIES, X.words)


@query(
    "search_with_meta",
    f"""WITH {ranked_sql('tfidf_smooth', S.tokens, QUERIES)}
SELECT r.*, coalesce(source, 'Unknown') AS source, coalesce(lang, 'Unknown') AS lang
FROM ranked r LEFT JOIN documents USING (doc_id)""",
)
def search_with_meta(spark, sf):
    ranked = indexed(spark, sf, "tfidf_smooth", QUERIES)
    return search.with_documents(ranked, table(spark, sf, "documents"), ["source", "lang"])


BOOLEAN_SQL = f"""WITH {collection_sql(S.words)}, {asked_sql(S.words, ['the and that'])},
have AS (SELECT doc_id, list(DISTINCT term) AS l FROM tf GROUP BY 1),
hit AS (SELECT doc_id FROM have WHERE %s)
SELECT doc_id, round(sum({WEIGHT_SQL['bm25']}), 6) AS score
FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN lens USING (doc_id) JOIN hit USING (doc_id), n GROUP BY 1"""


@query(
    "boolean_search",
    BOOLEAN_SQL % "list_contains(l, 'the') AND list_contains(l, 'and') AND NOT list_contains(l, 'for')",
)
def boolean_search(spark, sf):
    return search.boolean_search(documents(spark, sf, "text"), ["the", "and"], ["that"], ["for"])


@query(
    "boolean_any",
    BOOLEAN_SQL % "list_has_any(l, ['the', 'and', 'that']) AND NOT list_contains(l, 'for')",
)
def boolean_any(spark, sf):
    return search.boolean_search(documents(spark, sf, "text"), (), ["the", "and", "that"], ["for"])


PHRASE = "of the"
PHRASE_SQL = f"""{collection_sql(S.words)},
pos AS (SELECT doc_id, unnest(range(0, len(t))) AS i, unnest(t) AS term FROM toks),
freq AS (SELECT doc_id, count(*)::INTEGER AS phrase_freq FROM pos a JOIN pos b USING (doc_id)
  WHERE a.term = 'of' AND b.term = 'the' AND b.i = a.i + 1 GROUP BY 1)"""


PHRASE_SCORES_SQL = f"""WITH {PHRASE_SQL}, idf AS (SELECT sum(ln(1 + (n - df + 0.5) / (df + 0.5))) AS idf FROM df, n
  WHERE term IN ('of', 'the'))
SELECT doc_id, phrase_freq, round(idf * phrase_freq /
  (phrase_freq + 1.2 * (0.25 + 0.75 * doc_len * n / total)), 6) AS score FROM freq JOIN lens USING (doc_id), n, idf"""


@query("phrase_search", PHRASE_SCORES_SQL)
def phrase_search(spark, sf):
    return search.phrase_search(documents(spark, sf, "text"), PHRASE)


@query("phrase_postings", f"WITH {PHRASE_SQL} SELECT * FROM freq")
def phrase_postings(spark, sf):
    positions = index.positional_postings(documents(spark, sf, "text"))
    return search.phrase_postings(positions, spark, PHRASE)


CLOSE_SQL = f"""{collection_sql(S.tokens)}, {asked_sql(S.tokens, FUZZY)},
close AS (SELECT query, asked.term AS query_term, df.term, levenshtein(df.term, asked.term)::INTEGER AS edits,
    1 - levenshtein(df.term, asked.term)::DOUBLE / least(length(df.term), length(asked.term)) AS boost
  FROM df, asked WHERE levenshtein(df.term, asked.term) <= 2)"""


@query(
    "fuzzy_terms",
    f"WITH {CLOSE_SQL} SELECT query, query_term, term, edits, round(boost, 6) AS boost FROM close WHERE boost > 0",
)
def fuzzy_terms(spark, sf):
    vocabulary = index.terms_of_texts(documents(spark, sf, "text"))
    close = search.fuzzy_terms(vocabulary, FUZZY, tokenizer=X.tokens)
    return close.drop("df").withColumn("boost", F.round("boost", 6))


@query(
    "fuzzy_search",
    f"""WITH {CLOSE_SQL}, scores AS (SELECT query, doc_id, round(sum(boost * {WEIGHT_SQL['bm25']}), 6) AS score
  FROM close JOIN tf USING (term) JOIN df USING (term) JOIN lens USING (doc_id), n WHERE boost > 0 GROUP BY 1, 2)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores QUALIFY rank <= 10""",
)
def fuzzy_search(spark, sf):
    counted = staged(index.count_terms(documents(spark, sf, "text")))
    posts = index.postings_of(counted)
    terms = counted.select(F.explode("counts.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    close = staged(search.fuzzy_terms(terms, FUZZY, tokenizer=X.tokens))
    return search.fuzzy_search(posts, terms, search.collection_totals(counted), FUZZY, close=close)


@query("fuzzy_variants", ORACLES["fuzzy_terms"])
def fuzzy_variants(spark, sf):
    """A table of queries against the stored deletion variants of the vocabulary."""
    path = fresh_folder(spark)
    vocabulary = staged(index.terms_of_texts(documents(spark, sf, "text")).select("term", "df"))
    writers.write_variants(vocabulary, path)
    asked = spark.range(1).select(F.explode(F.array(*map(F.lit, FUZZY))).alias("query"))
    close = search.fuzzy_terms(vocabulary, asked, tokenizer=X.tokens, variants=spark.read.parquet(path))
    return close.drop("df").withColumn("boost", F.round("boost", 6))


@query(
    "field_search",
    f"""WITH {FIELD_SQL}, tf AS (SELECT * FROM field_tf WHERE field = 'genres'),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
n AS (SELECT count(*)::DOUBLE AS n, sum(doc_len)::DOUBLE AS total FROM (SELECT DISTINCT doc_id, doc_len FROM tf)),
{asked_sql(S.words, ['cat 12 brand'])},
scores AS (SELECT query, doc_id, round(sum({WEIGHT_SQL['bm25']}), 6) AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term), n GROUP BY 1, 2)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores QUALIFY rank <= 10""",
)
def field_search(spark, sf):
    found = index.field_occurrences(build_field_documents(records(spark, sf)), FIELDS, EXACT)
    return search.search_field(found, index.field_totals(found), ["cat 12 brand"], "genres")


def positions(spark, sf) -> DataFrame:
    """An index with positions of the documents, their text as the field ``content``."""
    return index.field_occurrences(documents(spark, sf, "text").withColumnRenamed("text", "content"), ["content"])


TOP_SQL = "SELECT row_number() OVER (ORDER BY score DESC, doc_id)::INTEGER AS rank, * FROM (%s) QUALIFY rank <= 10"


@query(
    "boolean_ranked",
    TOP_SQL % (BOOLEAN_SQL % "list_contains(l, 'the') AND list_contains(l, 'and') AND NOT list_contains(l, 'for')"),
)
def boolean_ranked(spark, sf):
    found = positions(spark, sf)
    return search.boolean_index(found, index.field_totals(found), ["the", "and"], ["that"], ["for"])


@query("phrase_ranked", TOP_SQL % PHRASE_SCORES_SQL)
def phrase_ranked(spark, sf):
    found = positions(spark, sf)
    return search.phrase_index(found, index.field_totals(found), PHRASE)


@query(
    "benchmark_search",
    f"""WITH {collection_sql(S.words)}, asked AS (SELECT query, term, count(*) AS qtf
  FROM (SELECT text AS query, unnest({S.words('text')}) AS term FROM (SELECT DISTINCT text FROM benchmark)) GROUP BY 1, 2),
scores AS (SELECT query, doc_id, round(sum(qtf * {WEIGHT_SQL['bm25']}), 6) AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN lens USING (doc_id), n GROUP BY 1, 2)
SELECT md5(query) AS query, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id)::INTEGER AS rank,
  doc_id, score FROM scores QUALIFY rank <= 3""",
)
def benchmark_search(spark, sf):
    """A table of queries: the passages of the benchmark, each with its best documents."""
    found = positions(spark, sf)
    asked = table(spark, sf, "benchmark").select(F.col("text").alias("query"))
    ranked = search.search_field(found, index.field_totals(found), asked, top=3)
    return ranked.withColumn("query", F.md5("query"))


COMPARED = QUERIES[:2]


@query(
    "compare_methods",
    f"""WITH s AS (WITH {ranked_sql('tfidf_smooth', S.tokens, COMPARED, 5)} SELECT * FROM ranked),
b AS (WITH {ranked_sql('bm25', S.words, COMPARED, 5)} SELECT * FROM ranked)
SELECT query, rank, s.doc_id AS first_id, s.score AS first_score, b.doc_id AS second_id, b.score AS second_score
FROM s FULL JOIN b USING (query, rank)""",
)
def compare_methods(spark, sf):
    docs = documents(spark, sf, "text")
    smooth = search.search_texts(docs, COMPARED, "tfidf_smooth", top=5)
    okapi = search.search_texts(docs, COMPARED, "bm25", top=5, tokenizer=X.words)
    return search.compare_methods(smooth, okapi)


# --- evaluation: parts looked up by name ------------------------------------------

TRUTH = {
    "red widget": ("red widget",),
    "small ring": ("small ring",),
    "COLD rod": ("cold rod",),
    "anvil": ("old anvil", "new anvil", "red anvil"),
    "economy widget": ("hot widget", "old widget"),
    "wdget": ("red widget",),
    "25 gizmo": ("large gizmo",),
    "u2": (),
}
TRUTH_SQL = ", ".join(
    f"('{q}', {repr(name) if name else 'NULL'})" for q, names in TRUTH.items() for name in (names or (None,))
)
PART_TEXT_SQL = "parts AS (SELECT p_partkey AS doc_id, p_name || ' ' || p_brand || ' ' || p_type AS text FROM part)"
NAMES_SQL = f"""{PART_TEXT_SQL}, truth AS (SELECT * FROM (VALUES {TRUTH_SQL}) AS v(query, relevant)),
smooth AS (WITH {ranked_sql('tfidf_smooth', S.tokens, TRUTH, 1, source='parts')} SELECT * FROM ranked),
okapi AS (WITH {ranked_sql('bm25', S.words, TRUTH, 1, source='parts')} SELECT * FROM ranked),
firsts AS (SELECT method, query, p_name AS first_result FROM (
    SELECT 'smooth' AS method, * FROM smooth UNION ALL SELECT 'bm25', * FROM okapi) JOIN part ON doc_id = p_partkey),
judged AS (SELECT m.method, q.query, f.first_result, q.total_relevant,
    coalesce(EXISTS (SELECT 1 FROM truth t WHERE t.query = q.query AND t.relevant = f.first_result), false) AS correct
  FROM (SELECT query, count(relevant) AS total_relevant FROM truth GROUP BY 1) q,
    (VALUES ('smooth'), ('bm25')) AS m(method) LEFT JOIN firsts f ON f.method = m.method AND f.query = q.query)"""


def judged_names(spark, sf) -> DataFrame:
    parts = table(spark, sf, "part").select(
        F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("name"),
        F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"),
    )
    pairs = [(q, n) for q, names in TRUTH.items() for n in (names or (None,))]
    truth = spark.range(1).select(
        F.inline(F.array(*[F.struct(F.lit(q).alias("query"), F.lit(n).cast("string").alias("relevant")) for q, n in pairs]))
    )

    def run(weight, tokenizer):
        ranked = search.search_texts(parts, list(TRUTH), weight, top=1, tokenizer=tokenizer)
        return search.with_documents(ranked, parts, ["name"])

    return evaluate.top1({"smooth": run("tfidf_smooth", X.tokens), "bm25": run("bm25", X.words)}, truth)


@query("eval_names_top1", f"WITH {NAMES_SQL} SELECT * FROM judged")
def eval_names_top1(spark, sf):
    return judged_names(spark, sf)


@query(
    "eval_names_summary",
    f"""WITH {NAMES_SQL} SELECT method, round(avg(correct::INT), 6) AS accuracy, count(*) FILTER (correct) AS correct_count,
  count(*) AS total_queries, round(avg(correct::INT), 6) AS avg_precision, round(avg(correct::INT), 6) AS avg_recall
FROM judged GROUP BY 1""",
)
def eval_names_summary(spark, sf):
    return evaluate.summary(judged_names(spark, sf))


@query(
    "eval_names_compare",
    f"""WITH {NAMES_SQL}, a AS (SELECT avg(correct::INT) FILTER (method = 'smooth') AS b,
    avg(correct::INT) FILTER (method = 'bm25') AS o FROM judged)
SELECT round(b, 6) AS base_accuracy, round(o, 6) AS other_accuracy,
  CASE WHEN o > b THEN 'bm25' WHEN b > o THEN 'smooth' ELSE 'tie' END AS winner,
  round(CASE WHEN b > 0 THEN (o - b) / b * 100 ELSE 0 END, 6) AS improvement FROM a""",
)
def eval_names_compare(spark, sf):
    return evaluate.compare(judged_names(spark, sf), "smooth", "bm25")


# --- evaluation: passages looked up in the documents that hold them -----------------

METHODS = {"smooth": ("tfidf_smooth", X.tokens, S.tokens), "bm25": ("bm25", X.words, S.words)}


def _firsts_sql(method: str) -> str:
    weight, _, tokens = METHODS[method]
    return f"""(WITH {collection_sql(tokens)}, asked AS (SELECT query, term, count(*) AS qtf
  FROM (SELECT query, unnest({tokens('query')}) AS term FROM passages) GROUP BY 1, 2),
scores AS (SELECT query, doc_id, round(sum(qtf * {WEIGHT_SQL[weight]}), 6) AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN lens USING (doc_id), n GROUP BY 1, 2)
SELECT '{method}' AS method, query, doc_id::VARCHAR AS first_result FROM scores
QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) = 1)"""


def _padded(c: str) -> str:
    return f"' ' || array_to_string({S.words(c)}, ' ') || ' '"


JUDGED_SQL = f"""passages AS MATERIALIZED (SELECT DISTINCT text AS query FROM benchmark WHERE text IS NOT NULL),
truth AS (SELECT query, doc_id::VARCHAR AS relevant FROM (SELECT query, {_padded('query')} AS phrase FROM passages)
  LEFT JOIN (SELECT doc_id, {_padded('text')} AS padded FROM documents) ON trim(phrase) <> '' AND contains(padded, phrase)),
firsts AS ({' UNION ALL '.join(map(_firsts_sql, METHODS))}),
judged AS (SELECT m.method, q.query, f.first_result, q.total_relevant,
    coalesce(EXISTS (SELECT 1 FROM truth t WHERE t.query = q.query AND t.relevant = f.first_result), false) AS correct
  FROM (SELECT query, count(relevant) AS total_relevant FROM truth GROUP BY 1) q,
    (VALUES ('smooth'), ('bm25')) AS m(method) LEFT JOIN firsts f ON f.method = m.method AND f.query = q.query)"""


def judged(spark, sf) -> DataFrame:
    """Each benchmark passage as a query of both methods; documents that hold it are relevant."""
    docs = documents(spark, sf, "text")
    passages = table(spark, sf, "benchmark").select(F.col("text").alias("query"))

    counted = {method: staged(index.count_terms(docs, tokenizer=tokenizer)) for method, (_, tokenizer, _) in METHODS.items()}

    def first(method):
        weight, tokenizer, _ = METHODS[method]
        asked = staged(search.query_table_terms(passages, tokenizer))
        posts = staged(index.postings_of(counted[method]).join(asked.select("term").distinct(), "term", "left_semi"))
        ranked = search.search_by_document(posts, search.collection_totals(counted[method]), asked, weight, top=1)
        return ranked.select("query", "rank", F.col("doc_id").cast("string").alias("name"))

    truth = evaluate.containing(passages, docs, postings=index.postings_of(counted["bm25"]))
    return evaluate.top1({method: first(method) for method in METHODS}, truth)


@query("eval_top1", f"WITH {JUDGED_SQL} SELECT * REPLACE (md5(query) AS query) FROM judged")
def eval_top1(spark, sf):
    return judged(spark, sf).withColumn("query", F.md5("query"))


@query(
    "eval_summary",
    f"""WITH {JUDGED_SQL} SELECT method, round(avg(correct::INT), 6) AS accuracy, count(*) FILTER (correct) AS correct_count,
  count(*) AS total_queries, round(avg(correct::INT), 6) AS avg_precision, round(avg(correct::INT), 6) AS avg_recall
FROM judged GROUP BY 1""",
)
def eval_summary(spark, sf):
    return evaluate.summary(judged(spark, sf))


@query(
    "eval_compare",
    f"""WITH {JUDGED_SQL}, a AS (SELECT avg(correct::INT) FILTER (method = 'smooth') AS b,
    avg(correct::INT) FILTER (method = 'bm25') AS o FROM judged)
SELECT round(b, 6) AS base_accuracy, round(o, 6) AS other_accuracy,
  CASE WHEN o > b THEN 'bm25' WHEN b > o THEN 'smooth' ELSE 'tie' END AS winner,
  round(CASE WHEN b > 0 THEN (o - b) / b * 100 ELSE 0 END, 6) AS improvement FROM a""",
)
def eval_compare(spark, sf):
    return evaluate.compare(judged(spark, sf), "smooth", "bm25")


# --- retrieval over stored blocks with score bounds ----------------------------------


def block_index(spark, sf) -> blocks.BlockIndex:
    """The documents as an index in blocks, written to the shared folder."""
    path = fresh_folder(spark)
    writers.write_block_index(documents(spark, sf, "text").withColumnRenamed("text", "content"), path, ["content"], buckets=8)
    return writers.read_block_index(spark, path, buckets=8)


@query("block_search", f"WITH {ranked_sql('bm25', S.words, QUERIES)} SELECT * FROM ranked")
def block_search(spark, sf):
    """Queries of frequent words, whose blocks without a chance are not opened."""
    return blocks.search_blocks(block_index(spark, sf), QUERIES)


@query("block_benchmark_search", ORACLES["benchmark_search"])
def block_benchmark_search(spark, sf):
    """The passages of the benchmark as a table of queries."""
    stored = block_index(spark, sf)
    passages = table(spark, sf, "benchmark").select(F.col("text").alias("query"))
    bounds = staged(blocks.query_bounds(stored, blocks.asked_terms(stored, passages, "content", X.words), "content", "bm25"))
    return blocks.search_blocks(stored, passages, top=3, bounds=bounds).withColumn("query", F.md5("query"))
