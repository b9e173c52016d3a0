"""The registered queries over the driver's tables, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.functions import codecs
from quillet.operators import cluster, ranking, retrieval, stats, wildcard
from quillet.operators.compressed import METHODS, compress, index_parts, posting_gaps
from quillet.operators.docvectors import DocumentVectors, kmeans_of, members_of
from quillet.operators.index import Index, build_index, from_postings, index_on_disk
from quillet.plans.boolean import to_rpn
from quillet.session import shared_dir
from quillet.sources import files, storage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# The SQL form of the token table; every oracle but those over whole tables starts with it.
TOKENS = r"""WITH a AS (SELECT doc_id, regexp_split_to_array(regexp_replace(lower(regexp_replace(text, '[^\p{L}\p{N}\s]+', '', 'g')), '^\s+|\s+$', '', 'g'), '\s+') AS w FROM documents),
tokens AS (SELECT * FROM (SELECT doc_id, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS pos, unnest(w) AS term FROM a) WHERE term <> ''),
inv AS (SELECT DISTINCT term, doc_id FROM tokens),
bi AS (SELECT DISTINCT term || ' ' || nxt AS biword, doc_id FROM (SELECT doc_id, term, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM tokens) WHERE nxt IS NOT NULL),
lex AS (SELECT DISTINCT term FROM inv),
tf AS (SELECT term, doc_id, count(*) AS tf FROM tokens GROUP BY ALL),
vec AS (SELECT doc_id, tf.term, tf * ln(1 + (SELECT count(*) FROM documents) / CAST(df AS DOUBLE)) AS tfidf FROM tf JOIN (SELECT term, count(*) AS df FROM tf GROUP BY term) d ON tf.term = d.term)
"""
ZONE_SQL = r""", zl AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l, source, lang FROM documents),
zones AS (SELECT doc_id, 'TITLE' AS zone, l[1] AS text FROM zl UNION ALL SELECT doc_id, 'AUTHOR', source FROM zl UNION ALL SELECT doc_id, 'SUBJECT', lang FROM zl UNION ALL SELECT doc_id, 'BODY', array_to_string(l[2:], chr(10)) FROM zl),
zp AS (SELECT DISTINCT zone, doc_id, term FROM (SELECT zone, doc_id, unnest(regexp_split_to_array(regexp_replace(lower(regexp_replace(text, '[^\p{L}\p{N}\s]+', '', 'g')), '^\s+|\s+$', '', 'g'), '\s+')) AS term FROM zones) WHERE term <> ''),
zw AS (SELECT * FROM (VALUES ('TITLE', 0.40), ('AUTHOR', 0.20), ('SUBJECT', 0.25), ('BODY', 0.15)) v(zone, weight))
"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def index_of(spark: SparkSession, sf_dir: str) -> Index:
    return build_index(documents(spark, sf_dir).select("doc_id", "text"))


def zoned(spark: SparkSession, sf_dir: str) -> Index:
    docs = documents(spark, sf_dir)
    return build_index(docs.select("doc_id", "text"), zones=files.table_zones(docs))


def over_index(name: str, run: Callable[[Index], DataFrame], sql: str | None = None, prefix: str = TOKENS, make: Callable[[SparkSession, str], Index] = index_of) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(make(spark, sf_dir))
    if sql:
        SQL[name] = prefix + sql


def over_table(name: str, run: Query, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = sql



def joined(column: str) -> Column:
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(column)


# scans and sources
over_index("tokens", lambda i: i.tokens, "SELECT doc_id, pos, term FROM tokens")
over_table(
    "doc_registry",
    lambda s, d: files.registry(s.read.parquet(f"{d}/pages.parquet").select(F.col("url").alias("path"), F.octet_length("html").cast("long").alias("size_bytes"))),
    "SELECT row_number() OVER (ORDER BY path, filename) AS doc_id, filename, size_bytes FROM (SELECT filename, min(url) AS path, CAST(arg_min(size, (url, size)) AS BIGINT) AS size_bytes FROM (SELECT url, regexp_extract(url, '[^/]*$') AS filename, strlen(html) AS size FROM pages) GROUP BY filename)",
)
over_index("document_names", lambda i: retrieval.document_names(i, retrieval.term_search(i, "from")), "SELECT DISTINCT doc_id, 'doc-' || doc_id AS filename FROM inv WHERE term = 'from'")
over_index("all_document_ids", lambda i: i.docs.select("doc_id"), "SELECT doc_id FROM documents", prefix="")
over_table("xml_detect", lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", files.is_xml("url", "html").alias("xml")), "SELECT page_id, lower(url) LIKE '%.xml' OR regexp_matches(lower(ltrim(html)), '^(<\\?xml|<mediawiki|<feed|<root)') AS xml FROM pages")
over_table(
    "xml_strip",
    lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", files.strip_xml("html").alias("plain")),
    "SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&[a-z]+;', ' ', 'g'), '&#[0-9]+;', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM pages",
)


def xml_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as XML, read back as text: the id is an element that is skipped, ends of elements are spaces."""
    legal = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0B-\x1F]", "")
    escaped = lambda c: F.replace(F.replace(legal(F.col(c)), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    xml = F.concat(F.lit("<root><id>"), F.col("doc_id").cast("string"), F.lit("</id><title>"), escaped("lang"), F.lit("</title><text>"), escaped("text"), F.lit("</text></root>"))
    return documents(spark, sf_dir).select("doc_id", files.xml_text(xml).alias("plain"))


over_table("xml_documents", xml_documents, r"SELECT doc_id, ' ' || regexp_replace(coalesce(lang, ''), '[\x00-\x08\x0B-\x1F]', '', 'g') || ' ' || regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B-\x1F]', '', 'g') || '  ' AS plain FROM documents")
over_table("xml_text", lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", files.xml_text("html").alias("plain")))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dressed as books: a header, of which every seventh lacks the title, and marks around the body."""
    title = F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("Title: Volume "), F.col("doc_id").cast("string"), F.lit("\n"))).otherwise("")
    text = F.concat(title, F.lit("Author: "), "source", F.lit("\nSubject: "), "lang", F.lit("\n\n*** START OF THE PROJECT GUTENBERG EBOOK ***\n"), F.coalesce("text", F.lit("")), F.lit("\n*** END OF THE PROJECT GUTENBERG EBOOK ***\nTitle: afterwards\n"))
    return documents(spark, sf_dir).select("doc_id", text.alias("text"))


over_table(
    "zone_parse",
    lambda s, d: files.parse_zones(books(s, d)).select("doc_id", "zone", "text"),
    r"""WITH l AS (SELECT doc_id, source, lang, regexp_replace(unnest(regexp_split_to_array(coalesce(text, ''), '\r\n|\n|\r')), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS line, generate_subscripts(regexp_split_to_array(coalesce(text, ''), '\r\n|\n|\r'), 1) AS no FROM documents),
b AS (SELECT doc_id, trim(string_agg(line, ' ' ORDER BY no)) AS text FROM l WHERE line <> '' GROUP BY doc_id)
SELECT doc_id, 'TITLE' AS zone, CASE WHEN doc_id % 7 = 0 THEN 'doc-' || doc_id ELSE 'Volume ' || doc_id END AS text FROM documents
UNION ALL SELECT doc_id, 'AUTHOR', source FROM documents WHERE doc_id % 7 <> 0
UNION ALL SELECT doc_id, 'SUBJECT', lang FROM documents WHERE doc_id % 7 <> 0
UNION ALL SELECT doc_id, 'BODY', text FROM b WHERE doc_id % 7 <> 0 AND text <> ''""",
)

# index builders
over_index("inverted_index", lambda i: i.inverted, "SELECT term, doc_id FROM inv")
over_index("positional_index", lambda i: i.postings.select("term", "doc_id", "tf", joined("positions")), "SELECT term, doc_id, CAST(count(*) AS INTEGER) AS tf, string_agg(pos, ',' ORDER BY pos) AS positions FROM tokens GROUP BY term, doc_id")
over_index("biword_index", lambda i: i.biwords, "SELECT biword, doc_id FROM bi")
over_index("term_doc_matrix", lambda i: i.matrix(["the", "of", "que"]), "SELECT d.doc_id, CAST(count(*) FILTER (term = 'the') AS INTEGER) AS the, CAST(count(*) FILTER (term = 'of') AS INTEGER) AS of, CAST(count(*) FILTER (term = 'que') AS INTEGER) AS que FROM documents d LEFT JOIN inv ON d.doc_id = inv.doc_id GROUP BY d.doc_id")
over_index("lexicon", lambda i: i.lexicon, "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term")
over_index("reverse_terms", lambda i: i.reverse_terms, "SELECT reverse(term) AS rev, term FROM lex")
over_index("permuterm_rotations", lambda i: i.permuterm.select("rotation", "term"), "SELECT substr(x, k) || substr(x, 1, k - 1) AS rotation, term FROM (SELECT term, term || '$' AS x, unnest(range(1, length(term) + 2)) AS k FROM lex)")
over_index("trigram_index", lambda i: i.trigrams.select("gram", "term"), "SELECT DISTINCT substr(x, k, 3) AS gram, term FROM (SELECT term, '$' || term || '$' AS x, unnest(range(1, length(term) + 1)) AS k FROM lex)")
over_index("zone_index", lambda i: i.zone_postings, "SELECT zone, term, doc_id FROM zp", TOKENS.rstrip() + ZONE_SQL, zoned)
over_index("rebuilt_biwords", lambda i: from_postings(i.docs, i.postings).biwords, "SELECT biword, doc_id FROM bi")


def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that cover the table: the second is all documents, of which those of the first are skipped."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return build_index(docs.where("doc_id % 3 <> 0")).add(build_index(docs)).inverted


over_table("incremental_index", incremental, SQL["inverted_index"])


def reindexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents replaced by themselves."""
    return index_of(spark, sf_dir).reindex(index_of(spark, sf_dir)).inverted


over_table("reindexed", reindexed, SQL["inverted_index"])


def disk_of(spark: SparkSession, sf_dir: str) -> Index:
    """The index written sorted to the shared folder: each table when the query first reads it."""
    import uuid

    return index_on_disk(index_of(spark, sf_dir), f"{shared_dir(spark)}/disk-{uuid.uuid4().hex}", lazy=True)


over_index("disk_index_search", lambda i: retrieval.term_search(i, "from"), "SELECT doc_id FROM inv WHERE term = 'from'", make=disk_of)

# lookup and boolean retrieval
over_index("term_search", lambda i: retrieval.term_search(i, "with"), "SELECT doc_id FROM inv WHERE term = 'with'")
over_index("term_search_biword", lambda i: retrieval.term_search(i, "of the", "biword"), "SELECT doc_id FROM bi WHERE biword = 'of the'")
over_index("and_search", lambda i: retrieval.and_search(i, "with", "from"), "SELECT doc_id FROM inv WHERE term = 'with' INTERSECT SELECT doc_id FROM inv WHERE term = 'from'")
over_index("or_search", lambda i: retrieval.or_search(i, "que", "der"), "SELECT DISTINCT doc_id FROM inv WHERE term IN ('que', 'der')")
over_index("not_search", lambda i: retrieval.not_search(i, "the"), "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM inv WHERE term = 'the'")
over_index("boolean_nested", lambda i: retrieval.boolean_query(i, "(with OR que) AND NOT from"), "(SELECT doc_id FROM inv WHERE term IN ('with', 'que')) EXCEPT SELECT doc_id FROM inv WHERE term = 'from'")
over_index("boolean_not_group_compat", lambda i: retrieval.boolean_query(i, "NOT (with OR que) AND from"), "SELECT doc_id FROM documents EXCEPT ((SELECT doc_id FROM inv WHERE term IN ('with', 'que')) INTERSECT SELECT doc_id FROM inv WHERE term = 'from')")
over_index("boolean_not_group_standard", lambda i: retrieval.boolean_query(i, "NOT (with OR que) AND from", "standard"), "SELECT doc_id FROM inv WHERE term = 'from' EXCEPT SELECT doc_id FROM inv WHERE term IN ('with', 'que')")
over_table("boolean_rpn", lambda s, d: s.createDataFrame([(q, to_rpn(q)) for q in ("a AND NOT b", "(a OR b) AND c", "NOT (a OR b) AND c")], "query string, rpn string"), "SELECT * FROM (VALUES ('a AND NOT b', 'a b NOT AND'), ('(a OR b) AND c', 'a b OR c AND'), ('NOT (a OR b) AND c', 'a b OR c AND NOT')) v(query, rpn)")
over_index("phrase_biword", lambda i: retrieval.phrase_search(i, "of the and", "biword"), "SELECT doc_id FROM bi WHERE biword IN ('of the', 'the and') GROUP BY doc_id HAVING count(*) = 2")
PHRASE = "SELECT DISTINCT x.doc_id FROM tokens x JOIN tokens y ON x.doc_id = y.doc_id AND y.pos = x.pos + 1 JOIN tokens z ON x.doc_id = z.doc_id AND z.pos = x.pos + 2 WHERE x.term = '{}' AND y.term = '{}' AND z.term = '{}'"
over_index("phrase_positional", lambda i: retrieval.phrase_search(i, "Of, the -- and!"), PHRASE.format("of", "the", "and"))
over_index("phrase_disk", lambda i: retrieval.phrase_search(i, "is of the", raw=True), PHRASE.format("is", "of", "the"), make=disk_of)
over_index("phrase_disk_biword", lambda i: retrieval.phrase_search(i, "of the and", "biword"), SQL["phrase_biword"].removeprefix(TOKENS), make=disk_of)
NEAR = "SELECT x.doc_id, x.pos AS position1, y.pos AS position2, CAST(abs(y.pos - x.pos) AS INTEGER) AS distance FROM tokens x JOIN tokens y ON x.doc_id = y.doc_id WHERE x.term = 'with' AND y.term = 'from' AND abs(y.pos - x.pos) <= 4"
over_index("proximity_detailed", lambda i: retrieval.proximity_matches(i, "with", "from", 4), NEAR)
over_index("proximity_docs", lambda i: retrieval.proximity_docs(i, "with", "from", 4), f"SELECT DISTINCT doc_id FROM ({NEAR})")
over_index("proximity_k1", lambda i: retrieval.proximity_docs(i, "of", "the", 1), "SELECT doc_id FROM bi WHERE biword = 'of the'")
over_index("proximity_counts", lambda i: retrieval.proximity_counts(i, "with", "from", 4), f"SELECT doc_id, count(*) AS matches FROM ({NEAR}) GROUP BY doc_id")

# wildcards
for _name, _query, _strategy, _like in (
    ("wildcard_prefix", "tho*", "btree", "tho%"), ("wildcard_suffix", "*ouer", "btree", "%ouer"), ("wildcard_middle", "th*ou", "permuterm", "th%ou"), ("wildcard_multi", "t*io*ed", "three_gram", "t%io%ed"),
    ("wildcard_permuterm_suffix", "*ouer", "permuterm", "%ouer"), ("wildcard_trigram_prefix", "tho*", "three_gram", "tho%"), ("wildcard_exact", "with", "permuterm", "with"),
):
    over_index(_name, lambda i, q=_query, s=_strategy: wildcard.wildcard_search(i, q, s), f"SELECT term, doc_id FROM inv WHERE term LIKE '{_like}'")
for _name, _query, _strategy, _like in (("disk_prefix", "tho*", "btree", "tho%"), ("disk_suffix", "*ouer", "btree", "%ouer"), ("disk_rotation", "th*ou", "permuterm", "th%ou"), ("disk_wildcard_multi", "t*io*ed", "three_gram", "t%io%ed")):
    over_index(_name, lambda i, q=_query, s=_strategy: wildcard.wildcard_search(i, q, s), f"SELECT term, doc_id FROM inv WHERE term LIKE '{_like}'", make=disk_of)
over_index("disk_predicate", lambda i: wildcard.terms_where(i, F.length("term") > 12), "SELECT term FROM lex WHERE length(term) > 12", make=disk_of)
over_index("disk_proximity", lambda i: retrieval.proximity_docs(i, "with", "from", 4), f"SELECT DISTINCT doc_id FROM ({NEAR})", make=disk_of)
over_index("disk_lexicon", lambda i: i.lexicon, SQL["lexicon"].removeprefix(TOKENS), make=disk_of)
over_index("wildcard_question", lambda i: wildcard.wildcard_search(i, "th?s", "scan", single=True), "SELECT term, doc_id FROM inv WHERE term LIKE 'th_s'")
over_index("wildcard_all_terms", lambda i: wildcard.wildcard_terms(i, "*"), "SELECT term FROM lex")

# ranking, vectors, clusters
over_index("zone_search", lambda i: ranking.zone_search(i, "with"), "SELECT DISTINCT doc_id FROM zp WHERE term = 'with'", TOKENS.rstrip() + ZONE_SQL, zoned)
over_index("zone_score", lambda i: ranking.zone_score(i, "with"), "SELECT doc_id, CAST(sum(weight) AS DOUBLE) AS score FROM zp JOIN zw ON zp.zone = zw.zone WHERE term = 'with' GROUP BY doc_id", TOKENS.rstrip() + ZONE_SQL, zoned)
over_index("zone_rank", lambda i: ranking.zone_rank(i, "en with the with"), "SELECT doc_id, CAST(sum(weight * times) AS DOUBLE) AS score FROM zp JOIN zw ON zp.zone = zw.zone JOIN (VALUES ('en', 1), ('with', 2), ('the', 1)) q(term, times) ON zp.term = q.term GROUP BY doc_id", TOKENS.rstrip() + ZONE_SQL, zoned)
over_index("tfidf", lambda i: ranking.tfidf(i).select("doc_id", "term", F.round("tfidf", 6).alias("tfidf")), "SELECT doc_id, term, round(tfidf, 6) AS tfidf FROM vec")


def some_cosines(index: Index) -> DataFrame:
    """Each document with the one behind it."""
    pairs = index.docs.select(F.col("doc_id").alias("doc_a"), (F.col("doc_id") + 1).alias("doc_b")).join(index.docs.select(F.col("doc_id").alias("doc_b")), "doc_b", "left_semi")
    return ranking.cosine(ranking.tfidf(index), pairs).select("doc_a", "doc_b", F.round("cosine", 6).alias("cosine"))


NORMS = "nrm AS (SELECT doc_id, sqrt(sum(tfidf * tfidf)) AS n FROM vec GROUP BY doc_id)"
over_index("cosine_pairs", some_cosines, f", {NORMS}, dots AS (SELECT x.doc_id AS doc_a, y.doc_id AS doc_b, sum(x.tfidf * y.tfidf) AS dot FROM vec x JOIN vec y ON y.doc_id = x.doc_id + 1 AND x.term = y.term GROUP BY ALL) SELECT p.doc_id AS doc_a, q.doc_id AS doc_b, round(coalesce(dot / (na.n * nb.n), 0.0), 6) AS cosine FROM documents p JOIN documents q ON q.doc_id = p.doc_id + 1 LEFT JOIN dots ON doc_a = p.doc_id AND doc_b = q.doc_id LEFT JOIN nrm na ON na.doc_id = p.doc_id LEFT JOIN nrm nb ON nb.doc_id = q.doc_id")
SEEDS = [1, 3, 5]
SEED_SQL = f", {NORMS}, c AS (SELECT CAST(s.k AS INTEGER) AS cluster_id, term, tfidf AS weight FROM vec JOIN (VALUES (1, 0), (3, 1), (5, 2)) s(d, k) ON doc_id = s.d), cn AS (SELECT cluster_id, sqrt(sum(weight * weight)) AS n FROM c GROUP BY cluster_id), sims AS (SELECT doc_id, cluster_id, round(sum(tfidf * weight) / (any_value(nrm.n) * any_value(cn.n)), 12) AS sim FROM vec JOIN c USING (term) JOIN cn USING (cluster_id) JOIN nrm USING (doc_id) GROUP BY doc_id, cluster_id), m AS (SELECT v.doc_id, CAST(coalesce(b.cluster_id, 0) AS INTEGER) AS cluster_id FROM (SELECT DISTINCT doc_id FROM vec) v LEFT JOIN (SELECT doc_id, cluster_id FROM sims WHERE sim > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, cluster_id) = 1) b ON v.doc_id = b.doc_id)"


def one_step(index: Index, sums: bool) -> tuple[DocumentVectors, DataFrame, DataFrame]:
    vectors = DocumentVectors(index)
    seeds = vectors.seeds(SEEDS)
    stepped = vectors.step(seeds, len(SEEDS), sums)
    vectors.close()
    return vectors, seeds, stepped


def one_update(index: Index) -> DataFrame:
    vectors, seeds, stepped = one_step(index, True)
    return vectors.named(vectors.means(stepped, seeds)).select("cluster_id", "term", F.round("weight", 6).alias("weight"))


over_index("kmeans_assign_step", lambda i: members_of(one_step(i, False)[2]), SEED_SQL + " SELECT doc_id, cluster_id FROM m")
over_index("kmeans_centroid_step", one_update, SEED_SQL + " SELECT cluster_id, term, round(avg(tfidf), 6) AS weight FROM vec JOIN m USING (doc_id) GROUP BY cluster_id, term")


def kmeans_sql(rounds: int) -> str:
    """The rounds written out: each assigns and takes means. Rounds after the last move give the same, so none need stop."""
    out = f", {NORMS}, c0 AS (SELECT CAST(s.k AS INTEGER) AS cluster_id, term, tfidf AS weight FROM vec JOIN (VALUES (1, 0), (3, 1), (5, 2)) s(d, k) ON doc_id = s.d)"
    for k in range(rounds):
        if k:
            out += f", c{k} AS (SELECT cluster_id, term, avg(tfidf) AS weight FROM vec JOIN m{k - 1} USING (doc_id) GROUP BY cluster_id, term UNION ALL SELECT cluster_id, term, weight FROM c{k - 1} WHERE cluster_id NOT IN (SELECT cluster_id FROM m{k - 1}))"
        out += f", cn{k} AS (SELECT cluster_id, sqrt(sum(weight * weight)) AS n FROM c{k} GROUP BY cluster_id)"
        out += f", sims{k} AS (SELECT doc_id, cluster_id, round(sum(tfidf * weight) / (any_value(nrm.n) * any_value(cn{k}.n)), 12) AS sim FROM vec JOIN c{k} USING (term) JOIN cn{k} USING (cluster_id) JOIN nrm USING (doc_id) GROUP BY doc_id, cluster_id)"
        out += f", m{k} AS (SELECT v.doc_id, CAST(coalesce(b.cluster_id, 0) AS INTEGER) AS cluster_id FROM (SELECT DISTINCT doc_id FROM vec) v LEFT JOIN (SELECT doc_id, cluster_id FROM sims{k} WHERE sim > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, cluster_id) = 1) b ON v.doc_id = b.doc_id)"
    return out


over_index("kmeans", lambda i: kmeans_of(i, 3, 5, SEEDS), kmeans_sql(5) + " SELECT doc_id, cluster_id FROM m4")
over_index("cluster_sizes", lambda i: cluster.cluster_sizes(kmeans_of(i, 3, 5, SEEDS)), kmeans_sql(5) + " SELECT cluster_id, count(*) AS docs FROM m4 GROUP BY cluster_id")

# statistics
for _kind in ("index", "matrix"):
    over_index(f"stats_{_kind}", lambda i, k=_kind: stats.stats(i, k), "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM lex) AS unique_keys, (SELECT count(*) FROM inv) AS occurrences, (SELECT CAST(sum(strlen(text)) AS BIGINT) FROM documents) AS total_bytes")
over_index("stats_biword", lambda i: stats.stats(i, "biword"), "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(DISTINCT biword) FROM bi) AS unique_keys, (SELECT count(*) FROM bi) AS occurrences, (SELECT CAST(sum(strlen(text)) AS BIGINT) FROM documents) AS total_bytes")
over_index("stats_positional", lambda i: stats.stats(i, "positional"), "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM lex) AS unique_keys, (SELECT count(*) FROM tokens) AS occurrences, (SELECT CAST(sum(strlen(text)) AS BIGINT) FROM documents) AS total_bytes")
over_index("derived_stats", stats.derived_stats, ", s AS (SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM lex) AS unique_keys, (SELECT count(*) FROM inv) AS occurrences, (SELECT sum(strlen(text)) FROM documents) AS total_bytes) SELECT documents, unique_keys, round(occurrences / documents::DOUBLE, 6) AS occurrences_per_doc, round(total_bytes / documents::DOUBLE, 6) AS bytes_per_doc, round(unique_keys / documents::DOUBLE, 6) AS terms_per_doc, (SELECT CAST(sum(length(term) + 1) AS BIGINT) FROM lex) AS rotations, (SELECT count(DISTINCT substr(x, k, 3)) FROM (SELECT '$' || term || '$' AS x, unnest(range(1, length(term) + 1)) AS k FROM lex)) AS grams FROM s")
over_index("top_terms", lambda i: stats.top_terms(i, 20), "SELECT term, count(*) AS df FROM inv GROUP BY term ORDER BY df DESC, term LIMIT 20")

# codecs
FRONT = """, n AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS rn FROM lex), p AS (SELECT term, rn // 8 AS block, rn, CASE WHEN rn % 8 = 0 THEN '' ELSE lag(term) OVER (ORDER BY rn) END AS prev FROM n),
q AS (SELECT *, len(list_filter(range(1, least(length(term), length(prev)) + 1), lambda k: substr(term, 1, k) = substr(prev, 1, k))) AS c FROM p),
fc AS (SELECT block, string_agg(c || ':' || substr(term, c + 1) || '|', '' ORDER BY rn) AS code, CAST(sum(length(term) + 1) AS BIGINT) AS original FROM q GROUP BY block)
"""
GAPS = """, g AS (SELECT term, doc_id, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term ORDER BY doc_id), 0) AS gap FROM inv)
"""
over_index("front_coding", lambda i: codecs.front_code(i.terms), FRONT + "SELECT block, code, original, length(code) AS coded FROM fc")
over_index("front_decode", lambda i: codecs.front_decode(codecs.front_code(i.terms)).select("term"), "SELECT term FROM lex")
over_index("vbyte_gaps", lambda i: posting_gaps(i).groupBy("term").agg(F.sum(codecs.vbyte_size(F.col("gap"))).alias("bytes")), GAPS + "SELECT term, CAST(sum(greatest(1, ceil(length(bin(gap)) / 7.0))) AS BIGINT) AS bytes FROM g GROUP BY term")
over_index("gamma_gaps", lambda i: posting_gaps(i).groupBy("term").agg((4 + F.ceil(F.sum(codecs.gamma_size(F.col("gap") + 1)) / 8)).cast("long").alias("bytes")), GAPS + "SELECT term, CAST(4 + ceil(sum(2 * length(bin(gap + 1)) - 1) / 8.0) AS BIGINT) AS bytes FROM g GROUP BY term")
over_index("compression_report", stats.compression_report, FRONT + GAPS + """, d AS (SELECT CAST(sum(original) AS BIGINT) AS od, CAST(sum(length(code)) AS BIGINT) AS cd FROM fc),
t AS (SELECT term, count(*) * 4 AS o, sum(greatest(1, ceil(length(bin(gap)) / 7.0))) AS v, 4 + ceil(sum(2 * length(bin(gap + 1)) - 1) / 8.0) AS m FROM g GROUP BY term), s AS (SELECT CAST(sum(o) AS BIGINT) AS o, CAST(sum(v) AS BIGINT) AS v, CAST(sum(m) AS BIGINT) AS m FROM t),
e AS (SELECT 'vbyte' AS method, o, v AS c FROM s UNION ALL SELECT 'gamma', o, m FROM s)
SELECT method, od AS original_dictionary, cd AS coded_dictionary, round(CAST(cd AS DOUBLE) * 100 / od, 4) AS dictionary_percent, o AS original_postings, c AS coded_postings, round(CAST(c AS DOUBLE) * 100 / o, 4) AS postings_percent FROM e, d""")
over_index("gap_roundtrip", stats.roundtrip_errors, "SELECT CAST(0 AS BIGINT) AS wrong")


def code_bytes(index: Index) -> DataFrame:
    """Both byte codes of each term's documents by ranges of ids, decoded again: whether they are the same, and the sizes."""
    coded = index_parts(index).withColumns({"v": codecs.vbyte_encode("ids", gaps=True), "g": codecs.gamma_encode("ids", gaps=True)})
    same = (codecs.vbyte_decode("v", gaps=True) == F.col("ids")) & (codecs.gamma_decode("g", gaps=True) == F.col("ids"))
    return coded.groupBy("term").agg(F.sum(F.octet_length("v").cast("long")).alias("vbyte"), F.sum(F.octet_length("g").cast("long")).alias("gamma"), F.bool_and(same).alias("same"))


over_index("code_bytes", code_bytes, GAPS + "SELECT term, CAST(sum(greatest(1, ceil(length(bin(gap)) / 7.0))) AS BIGINT) AS vbyte, CAST(4 + ceil(sum(2 * length(bin(gap + 1)) - 1) / 8.0) AS BIGINT) AS gamma, true AS same FROM g GROUP BY term")


# storage
def saved(fmt: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        import uuid

        path = f"{shared_dir(spark)}/saved-{uuid.uuid4().hex}"
        storage.save(index_of(spark, sf_dir), path, fmt)
        return storage.load(spark, path, fmt).tokens.select("doc_id", "pos", "term")

    return run


for _fmt in storage.FORMATS:
    over_table(f"save_load_{_fmt}", saved(_fmt), TOKENS + "SELECT doc_id, pos, term FROM tokens")
over_index("text_format", storage.index_lines, "SELECT term || ': ' || string_agg(doc_id || '[' || ps || ']', '; ' ORDER BY doc_id) AS value FROM (SELECT term, doc_id, string_agg(pos, ', ' ORDER BY pos) AS ps FROM tokens GROUP BY term, doc_id) GROUP BY term")
over_table("compare_formats", lambda s, d: storage.compare_formats(s.createDataFrame([("parquet", 9.0, 4.0, 100), ("text", 5.0, 6.0, 300), ("json", 7.0, 4.0, 200)], "fmt string, save_ms double, load_ms double, size_bytes bigint")), "SELECT * FROM (VALUES ('parquet', 9.0::DOUBLE, 4.0::DOUBLE, 100::BIGINT, 7, true), ('text', 5.0, 6.0, 300, 5, false), ('json', 7.0, 4.0, 200, 6, false)) v(fmt, save_ms, load_ms, size_bytes, points, best)")


def measured_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """compare_formats() over what saving and loading the documents' index takes; times differ by run, so there is no SQL."""
    import uuid

    found = storage.measure_formats(index_of(spark, sf_dir), f"{shared_dir(spark)}/measured-{uuid.uuid4().hex}")
    return storage.compare_formats(spark.createDataFrame([(m.fmt, m.save_ms, m.load_ms, m.size_bytes) for m in found], "fmt string, save_ms double, load_ms double, size_bytes bigint"))


over_table("measured_formats", measured_formats)


def compressed(method: str) -> Callable[[Index], DataFrame]:
    """The index coded and decoded again."""
    return lambda i: compress(i, method).inverted()


for _method in METHODS:
    over_index(f"compressed_{_method}", compressed(_method), "SELECT term, doc_id FROM inv")
over_index("compressed_search", lambda i: compress(i, "gamma").term_search("with"), "SELECT doc_id FROM inv WHERE term = 'with'")
over_index("compressed_terms", lambda i: compress(i).terms(), "SELECT term FROM lex")
over_index("compressed_sizes", lambda i: compress(i).sizes(), FRONT + GAPS + """, d AS (SELECT CAST(sum(original) AS BIGINT) AS od, CAST(sum(length(code)) AS BIGINT) AS cd FROM fc), o AS (SELECT CAST(count(*) * 4 AS BIGINT) AS op, CAST(sum(greatest(1, ceil(length(bin(gap)) / 7.0))) AS BIGINT) AS cp FROM g)
SELECT od AS original_dictionary, cd AS coded_dictionary, op AS original_postings, cp AS coded_postings, round((cd + cp) * 100.0::DOUBLE / (od + op), 4) AS ratio FROM d, o""")
# the SQL lists the endings that the stemmer takes off `thing`
over_table("stemmed_search", lambda s, d: retrieval.term_search(build_index(documents(s, d).select("doc_id", "text"), stem=True), "thing"), TOKENS + "SELECT DISTINCT doc_id FROM inv WHERE regexp_full_match(term, 'thing(e|s|es|ed|ing|ings|ly|edly|ingly|lying|lyed)?')")
