"""The queries of the core operators over the tables of a folder, and the SQL that checks them.

A toy embedding makes the scorers checkable without training: the word at rank r by (document frequency, word) has vector
number r - 1 of ``embeddings`` by ``vec_id``, and they begin anew when there are no more. Vectors go out one element per row, rounded to six digits."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import text as tx
from loomtext.functions.rank import global_rank
from loomtext.operators import analyze, counts, embedding, explain, importing, metacluster, parse, phrases, predict, rows, scoring
from loomtext.operators.reduce import reduce_vectors
from loomtext.plans.shared import materialize, shared_path, small, spread
from loomtext.sources import tables
from loomtext.streaming.scoring import score_stream

DIM = 64
_Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, _Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[_Query], _Query]:
    def add(f: _Query) -> _Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, _Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/{name}.parquet"))


def _r(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits) + F.lit(0.0)


def _long(vectors: DataFrame, *keys: str, vec: str = "vec") -> DataFrame:
    return vectors.select(*keys, F.posexplode(vec).alias("dim", "value")).withColumn("value", _r("value"))


# --- rows that fail to parse ---------------------------------------------------------------------------------------

_FIELD = '"(?:[^"]|"")*"|[^",]*'
_LINES = f"""WITH l AS (SELECT *, regexp_replace(raw, '\\r\\z', '') AS line FROM raw_records),
q AS (SELECT *, regexp_full_match(line, '(?s)(?:{_FIELD})(?:,(?:{_FIELD}))*') AS sound, length(regexp_replace(line, '"(?:[^"]|"")*"', '', 'g')) - length(replace(regexp_replace(line, '"(?:[^"]|"")*"', '', 'g'), ',', '')) + 1 AS n FROM l),
f AS (SELECT *, list_transform(CASE WHEN sound AND n = 6 THEN [{", ".join(f"regexp_extract(line, '(?s)^({'),('.join([_FIELD] * 6)})$', {i})" for i in range(1, 7))}] END,
  lambda x: CASE WHEN starts_with(x, '"') THEN replace(x[2:-2], '""', '"') WHEN x = '' THEN NULL ELSE x END) AS v FROM q),
e AS (SELECT *, CASE WHEN raw IS NULL THEN 'column_count' WHEN NOT sound THEN 'quoting' WHEN n <> 6 THEN 'column_count'
  WHEN NOT coalesce(regexp_full_match(v[1], '[0-9]{{1,8}}'), false) OR NOT coalesce(regexp_full_match(v[6], '(19|20)[0-9]{{2}}'), false)
    OR regexp_matches(coalesce(v[3], '') || coalesce(v[4], ''), '[\\x{{FFFD}}\\x00-\\x08\\x0b-\\x1f\\x7f-\\x{{9f}}]') THEN 'value' END AS reason FROM f)"""


@query(_LINES + " SELECT record_id, reason FROM e WHERE reason IS NOT NULL")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return rows.split_records(_t(spark, d, "raw_records"))[1].select("record_id", "reason")


@query(_LINES + " SELECT record_id, batch, src_file, line_no, v[1]::BIGINT AS pmid, v[2] AS title, v[3] AS abstract, v[4] AS specific_aims, v[5] AS journal, v[6]::INTEGER AS year FROM e WHERE reason IS NULL")
def p5_loaded(spark: SparkSession, d: str) -> DataFrame:
    return rows.split_records(_t(spark, d, "raw_records"))[0]


# --- import --------------------------------------------------------------------------------------------------------

def _merged_part(c: str) -> str:
    v = f"regexp_replace({c}, '\\A{tx.WS}+|{tx.WS}+\\z', '', 'g')"
    return f"CASE WHEN {v} = '' THEN NULL WHEN right({v}, 1) IN ('.', '?', '!', ',') THEN {v} ELSE {v} || '.' END"


@query(f"SELECT _ref, concat_ws(chr(10), {_merged_part('title')}, {_merged_part('abstract')}) AS text FROM source_csv")
def import_merge(spark: SparkSession, d: str) -> DataFrame:
    return importing.merge_columns(_t(spark, d, "source_csv").select("_ref", "title", "abstract"), ["title", "abstract"]).select("_ref", "text")


@query("SELECT src_file, _ref, row_number() OVER (ORDER BY src_file NULLS FIRST, _ref) - 1 AS new_ref FROM source_csv")
def ref_ids(spark: SparkSession, d: str) -> DataFrame:
    return importing.assign_refs(_t(spark, d, "source_csv").select("src_file", "_ref"), ["src_file", "_ref"], "new_ref")


@query(f"SELECT row_number() OVER (ORDER BY batch, _ref) - 1 AS _ref, concat_ws(chr(10), {_merged_part('title')}, {_merged_part('abstract')}, {_merged_part('specific_aims')}) AS text, journal FROM source_csv")
def import_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The corpus, and the original columns joined back to it."""
    raw = _t(spark, d, "source_csv").withColumnRenamed("_ref", "row")
    corpus, originals = importing.import_corpus(raw, ["title", "abstract", "specific_aims"], ["batch", "row"])
    return corpus.join(originals.select("_ref", "journal"), "_ref")


@query("SELECT _ref, src_file, coalesce(replace(title, chr(13), ' '), '') AS title, coalesce(replace(abstract, chr(13), ' '), '') AS abstract FROM source_csv")
def csv_source(spark: SparkSession, d: str) -> DataFrame:
    """Source rows written as CSV, one folder per source file, and read again."""
    src = _t(spark, d, "source_csv").select("_ref", "src_file", *[F.replace(F.col(c), F.lit("\r"), F.lit(" ")).alias(c) for c in ("title", "abstract")])
    path = shared_path(spark, "csv")
    tables.write_csv(src.withColumnRenamed("src_file", "origin"), path, ["origin"])
    back = tables.read_csv(spark, path, ["_ref", "title", "abstract"], folder="origin")
    return back.select(F.col("_ref").cast("long"), F.col("origin").alias("src_file"), "title", "abstract")


@query("SELECT _ref, batch::VARCHAR AS batch, coalesce(replace(title, chr(13), ' '), '') AS title FROM source_csv")
def source_folders(spark: SparkSession, d: str) -> DataFrame:
    """Source rows laid out in two folders of CSV files, read together; a file of another kind beside them isn't read."""
    src = _t(spark, d, "source_csv").select("_ref", "batch", F.replace("title", F.lit("\r"), F.lit(" ")).alias("title"))
    paths = [shared_path(spark, "source") for _ in range(2)]
    for i, path in enumerate(paths):
        tables.write_csv(src.where(F.pmod("_ref", F.lit(2)) == i), path)
        src.limit(1).select("title").write.mode("append").text(path)
    return tables.read_sources(spark, paths, ["_ref", "batch", "title"]).select(F.col("_ref").cast("long"), "batch", "title")


@query("SELECT unnest(['_ref', 'batch', 'title']) AS name, unnest([0, 1, 2])::INTEGER AS at")
def csv_header(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "header")
    tables.write_csv(_t(spark, d, "source_csv").select("_ref", "batch", "title"), path)
    return spark.createDataFrame([(c, i) for i, c in enumerate(tables.csv_columns(spark, path))], "name string, at int")


_LAST = "(SELECT _ref, max(text) AS text FROM parsed_documents WHERE _ref IS NOT NULL GROUP BY _ref)"


@query(f"SELECT _ref, coalesce(text, '') AS text FROM {_LAST}")
def parsed_source(spark: SparkSession, d: str) -> DataFrame:
    """Parsed texts written as a corpus and read again."""
    path = shared_path(spark, "corpus")
    tables.write_csv(_t(spark, d, "parsed_documents").where("_ref is not null").groupBy("_ref").agg(F.max("text").alias("text")), path)
    return tables.read_corpus(spark, path).select("_ref", "text")


# --- phrases and parse ---------------------------------------------------------------------------------------------


def _initials(spark: SparkSession, d: str) -> DataFrame:
    w = F.split("p_name", " ")
    return _t(spark, d, "part").withColumn("abbr", F.upper(F.concat(F.left(F.get(w, F.lit(0)), F.lit(1)), F.left(F.get(w, F.lit(1)), F.lit(1)))))


def _listed(spark: SparkSession, d: str) -> DataFrame:
    plural = F.when(F.col("p_partkey") % 2 == 0, "s").otherwise("")
    return _initials(spark, d).select("p_partkey", F.concat(F.lit("the new "), F.col("p_name"), plural, F.lit(" ("), F.col("abbr"), F.lit(") is listed")).alias("text"))


_PART = """WITH p AS (SELECT p_partkey, p_name, upper(left(split_part(p_name, ' ', 1), 1) || left(split_part(p_name, ' ', 2), 1)) AS abbr, p_name || CASE WHEN p_partkey % 2 = 0 THEN 's' ELSE '' END AS phrase FROM part),
pairs AS (SELECT phrase, abbr, count(*) AS "count" FROM p GROUP BY phrase, abbr),
best AS (SELECT * FROM (SELECT *, rtrim(lower(trim(phrase)), 's') AS key, row_number() OVER (PARTITION BY rtrim(lower(trim(phrase)), 's') ORDER BY "count" DESC, phrase, abbr) AS rn, sum("count") OVER (PARTITION BY rtrim(lower(trim(phrase)), 's'))::BIGINT AS total FROM pairs) WHERE rn = 1),
deduped AS (SELECT phrase, abbr, total AS "count" FROM best),
long AS (SELECT abbr, arg_min(phrase, struct_pack(c := -"count", p := phrase)) AS phrase FROM deduped GROUP BY abbr)"""


@query(_PART + ' SELECT phrase, abbr, "count" FROM pairs')
def abbreviations(spark: SparkSession, d: str) -> DataFrame:
    return phrases.abbreviation_pairs(_listed(spark, d))


@query(_PART + ' SELECT phrase, abbr, "count" FROM deduped')
def abbreviations_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return phrases.dedupe_abbreviations(abbreviations(spark, d))


@query(_PART + ' SELECT phrase, abbr, "count" FROM deduped ORDER BY "count" DESC, phrase, abbr LIMIT 5')
def abbreviations_top(spark: SparkSession, d: str) -> DataFrame:
    return phrases.most_frequent(abbreviations_dedupe(spark, d))


@query(_PART + ' SELECT phrase, abbr, "count", len(string_split(phrase, \' \'))::INTEGER AS n FROM deduped')
def stored_phrases(spark: SparkSession, d: str) -> DataFrame:
    """The abbreviations' report, and the phrases read from it."""
    path = shared_path(spark, "phrases")
    tables.save_reports({"abbreviations": abbreviations_dedupe(spark, d)}, path)
    return tables.read_phrases(spark, f"{path}/reports/abbreviations").select("phrase", "abbr", "count", F.size("words").alias("n"))


@query(_PART + " SELECT p_partkey, 'see ' || replace('PHRASE ' || long.phrase, ' ', '_') || ' of many' AS text FROM p JOIN long USING (abbr)")
def parse_acronyms(spark: SparkSession, d: str) -> DataFrame:
    docs = _initials(spark, d).select("p_partkey", F.concat(F.lit("see "), F.col("abbr"), F.lit(" of  many")).alias("text"))
    return parse.replace_acronyms(docs, abbreviations_dedupe(spark, d), "p_partkey", prefix="PHRASE", suffix="")


@query("SELECT p_partkey, 'a ' || replace(p_name, ' ', '_') || '_MeSH for all' AS text FROM part")
def parse_dictionary(spark: SparkSession, d: str) -> DataFrame:
    part = _t(spark, d, "part")
    docs = part.select("p_partkey", F.concat(F.lit("a "), F.initcap("p_name"), F.lit(" for all")).alias("text"))
    return parse.replace_from_dictionary(docs, part.select(F.col("p_name").alias("phrase"), F.col("p_name").alias("term")).distinct(), ident="p_partkey")


def _parsed(name: str) -> _Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        docs = _t(spark, d, "documents").select("doc_id", "text")
        if name == "dedash":
            docs = docs.withColumn("text", F.replace(F.col("text"), F.lit("tion"), F.lit("t-\n ion")))
        return parse.parse_chain(docs, [name])

    return run


_TOKENS = f"list_filter(string_split_regex(text, '{tx.WS}+'), lambda x: x <> '')"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_PARSED_SQL = {
    "unidecoder": f"translate({reduce(lambda c, x: f'replace({c}, {_lit(x[0])}, {_lit(x[1])})', tx.SEVERAL, 'text')}, {_lit(tx.FROM_CHARS)}, {_lit(tx.TO_CHARS)})",
    "dedash": f"regexp_replace(replace(text, 'tion', 't-' || chr(10) || ' ion'), '(\\w)-{tx.WS}+(\\w)', '\\1\\2', 'g')",
    "titlecaps": f"array_to_string(list_transform(regexp_extract_all(text, '{tx.SENTENCE}'), lambda s: CASE WHEN regexp_matches(s, '\\p{{Lu}}') AND NOT regexp_matches(s, '\\p{{Ll}}') THEN lower(s) ELSE s END), '')",
    "separated_parenthesis": f"concat_ws(' ', regexp_replace(text, '{tx.WS}*\\([^()]*\\)', '', 'g'), CASE WHEN len(list_filter(regexp_extract_all(text, '\\(([^()]*)\\)', 1), lambda x: length(x) >= 10)) > 0 THEN array_to_string(list_transform(list_filter(regexp_extract_all(text, '\\(([^()]*)\\)', 1), lambda x: length(x) >= 10), lambda x: x || '.'), ' ') END)",
    "token_replacement": "regexp_replace(" + reduce(lambda c, x: f"replace({c}, {_lit(x[0])}, {_lit(x[1])})", tx.SYMBOLS, "text") + ", ' +', ' ', 'g')",
    "decaps_text": f"array_to_string(list_transform({_TOKENS}, lambda w: CASE WHEN length(regexp_replace(w, '[^A-Z]', '', 'g')) <= 1 THEN lower(w) ELSE w END), ' ')",
    "pos_tokenizer": f"array_to_string(list_filter(list_transform({_TOKENS}, lambda w: regexp_replace(w, '[.,;:!?]+\\z', '')), lambda w: w <> '' AND lower(w) NOT IN ({', '.join(map(_lit, tx.closed_words()))}) AND NOT regexp_matches(w, '{tx.CARDINAL}') AND NOT regexp_matches(w, '{tx.SYMBOL}')), ' ')",
}
for _name in tx.CHAIN:
    QUERIES[f"parse_{_name}"] = _parsed(_name)
    SQL[f"parse_{_name}"] = f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN {_PARSED_SQL[_name]} END AS text FROM documents"


#: Tables of the chain in the query: (phrase, abbreviation, count) and (phrase, term), of phrases of two words.
_CHAIN = ("unidecoder", "dedash", "titlecaps", "replace_acronyms", "separated_parenthesis", "replace_from_dictionary", "token_replacement", "decaps_text", "pos_tokenizer")
_ABBREVIATIONS = (("pregnant women", "IFX", 3), ("young women", "IFX", 1), ("study staff", "XRL", 2))
_DICTIONARY = (("adverse events", "Adverse Event"), ("older adults", "Aged"), ("biopsy samples", "Biopsy"), ("risk of", "Risk"))


def _replaced_sql(entries: list[tuple[str, str]], own: list[tuple[str, str]]) -> str:
    """Phrases of two words, none of which begins as another ends, and single words in their own case, by tokens."""
    pairs = [(*map(_lit, p.split()), _lit(t)) for p, t in entries]
    cases = " ".join([f"WHEN lower(t[i]) = {a} AND lower(t[i + 1]) = {b} THEN {x}" for a, b, x in pairs] + [f"WHEN i > 1 AND lower(t[i - 1]) = {a} AND lower(t[i]) = {b} THEN NULL" for a, b, _ in pairs] + [f"WHEN t[i] = {_lit(w)} THEN {_lit(x)}" for w, x in own])
    return f"array_to_string(list_filter(list_transform(range(1, len(t) + 1), lambda i: CASE {cases} ELSE t[i] END), lambda x: x IS NOT NULL), ' ')"


def _chain_sql() -> str:
    tables_ = {
        "replace_acronyms": _replaced_sql([("pregnant women", "pregnant_women_ABBR"), ("study staff", "study_staff_ABBR")], [("IFX", "pregnant_women_ABBR"), ("XRL", "study_staff_ABBR")]),
        "replace_from_dictionary": _replaced_sql([(p, t.replace(" ", "_") + "_MeSH") for p, t in _DICTIONARY], []),
    }
    steps, before = [], "(SELECT doc_id, text FROM documents)"
    for i, name in enumerate(_CHAIN):
        if name in tables_:
            before = f"(SELECT doc_id, text, {_TOKENS} AS t FROM {before})"
        value = tables_.get(name) or _PARSED_SQL[name].replace("replace(text, 'tion', 't-' || chr(10) || ' ion')", "text")
        steps.append(f"s{i} AS MATERIALIZED (SELECT doc_id, CASE WHEN text IS NOT NULL THEN {value} END AS text FROM {before})")
        before = f"s{i}"
    return f"WITH {', '.join(steps)} SELECT doc_id, text FROM {before}"


@query(_chain_sql())
def parse_whole_chain(spark: SparkSession, d: str) -> DataFrame:
    """All nine functions in the order of the shipped configuration."""
    known = {"replace_acronyms": spark.createDataFrame(_ABBREVIATIONS, "phrase string, abbr string, count long"), "replace_from_dictionary": spark.createDataFrame(_DICTIONARY, "phrase string, term string")}
    return parse.parse_chain(_t(spark, d, "documents").select("doc_id", "text"), _CHAIN, tables=known, ident="doc_id")


# --- counts, embeddings, scores ------------------------------------------------------------------------------------

_DOCS = f"""docs AS (SELECT doc_id AS _ref, coalesce({_TOKENS}, []) AS tokens FROM documents),
tok AS (SELECT _ref, unnest(tokens) AS word FROM docs),
tdf AS (SELECT word, count(DISTINCT _ref) AS "count" FROM tok GROUP BY word),
nn AS (SELECT count(*) AS n FROM docs)"""
_TOY = f"""{_DOCS},
e AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, embedding::DOUBLE[] AS vec FROM embeddings),
toy AS (SELECT word, vec, "count" FROM (SELECT *, (row_number() OVER (ORDER BY "count" DESC, word) - 1) % (SELECT count(*) FROM embeddings) AS r FROM tdf) JOIN e USING (r)),
w AS (SELECT word, vec, row_number() OVER (ORDER BY "count" DESC, word) AS r FROM toy QUALIFY r <= 2),
dw AS (SELECT toy.word, toy.vec, exp(sum(least(0.0, -(CASE WHEN w.r = 1 THEN 1.0 ELSE 0.5 END) * list_dot_product(toy.vec, w.vec)))) AS n FROM toy, w GROUP BY ALL),
vocab AS (SELECT word, vec, dw.n AS n, ln(nn.n / ("count" + 1.0)) AS idf FROM dw JOIN tdf USING (word), nn)"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return counts.document_tokens(_t(spark, d, "documents"), "doc_id")


def _toy(spark: SparkSession, d: str, tdf: DataFrame) -> DataFrame:
    """(word, vec, count) of every word."""
    vectors = global_rank(_t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec")), ["vec_id"], into="r")
    ranked = global_rank(tdf.withColumn("less", -F.col("count")), ["less", "word"], into="at").withColumn("r", F.col("at") % vectors.count())
    return ranked.join(vectors, "r").select("word", "vec", "count")


def _vocab(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = _docs(spark, d)
    tdf = materialize(counts.term_document_frequency(docs), "tdf")
    toy = materialize(_toy(spark, d, tdf), "toy")
    first = [r.word for r in toy.orderBy(F.desc("count"), "word").limit(2).collect()]
    vocab = scoring.scoring_vocabulary(toy.select("word", "vec"), tdf, docs.count(), dict(zip(first, (1.0, 0.5), strict=False)))
    return docs, materialize(vocab, "vocab")


@query(f"WITH {_DOCS} SELECT word, count(*) AS \"count\" FROM tok GROUP BY word")
def term_frequency(spark: SparkSession, d: str) -> DataFrame:
    return counts.term_frequency(_docs(spark, d))


@query(f'WITH {_DOCS} SELECT word, "count" FROM tdf')
def term_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return counts.term_document_frequency(_docs(spark, d))


@query(f'WITH {_DOCS} SELECT word, "count", round(ln(n / ("count" + 1.0)), 6) + 0.0 AS idf FROM tdf, nn')
def idf(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return counts.inverse_document_frequency(counts.term_document_frequency(docs), docs.count()).withColumn("idf", _r("idf"))


@query(f'WITH {_DOCS} SELECT word, count(*) AS "count" FROM tok GROUP BY word HAVING count(*) >= 10')
def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return counts.vocabulary(counts.term_frequency(_docs(spark, d)), 10)


@query(f"WITH {_TOY} SELECT word, round(n, 6) + 0.0 AS n, round(idf, 6) + 0.0 AS idf FROM vocab")
def downsample_weights(spark: SparkSession, d: str) -> DataFrame:
    return _vocab(spark, d)[1].select("word", _r("n").alias("n"), _r("idf").alias("idf"))


def _scored(method: str) -> _Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        docs, vocab = _vocab(spark, d)
        return _long(scoring.METHODS[method](docs, vocab, DIM), "_ref")

    return run


def _scored_sql(distinct: bool, weighted: bool) -> str:
    rows_ = "(SELECT DISTINCT _ref, word FROM tok)" if distinct else "tok"
    coef = "n * idf" if weighted else "n"
    return f"""WITH {_TOY},
s AS (SELECT _ref, ix, sum({coef} * vec[ix]) AS x FROM {rows_} JOIN vocab USING (word), range(1, {DIM + 1}) g(ix) GROUP BY _ref, ix),
l AS (SELECT _ref, sqrt(sum(x * x)) AS len FROM s GROUP BY _ref)
SELECT docs._ref, (g.ix - 1)::INTEGER AS dim, round(coalesce(CASE WHEN len > 0 THEN x / len ELSE x END, 0.0), 6) + 0.0 AS value
FROM docs CROSS JOIN range(1, {DIM + 1}) g(ix) LEFT JOIN s ON s._ref = docs._ref AND s.ix = g.ix LEFT JOIN l ON l._ref = docs._ref"""


for _m, _q, _a in (("simple", "score_simple", (False, False)), ("unique", "score_unique", (True, False)), ("simple_IDF", "score_simple_idf", (False, True)), ("unique_IDF", "score_unique_idf", (True, True))):
    QUERIES[_q] = _scored(_m)
    SQL[_q] = _scored_sql(*_a)
QUERIES["score_common_component"] = _scored("IDF_common_component_removal")


@query(_scored_sql(True, True))
def score_stream_unique_idf(spark: SparkSession, d: str) -> DataFrame:
    """The same scores, of documents read as a stream of files."""
    _, vocab = _vocab(spark, d)
    base = shared_path(spark, "stream")
    docs = _t(spark, d, "documents")
    docs.select("doc_id", "text").write.parquet(f"{base}/in")
    stream = spark.readStream.schema(docs.select("doc_id", "text").schema).option("maxFilesPerTrigger", 64).parquet(f"{base}/in")
    writer = score_stream(stream, vocab, DIM, lambda df, n: df.write.mode("overwrite").parquet(f"{base}/out/batch={n}"), ident="doc_id")
    writer.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return _long(spark.read.parquet(f"{base}/out"), "_ref")


@query()
def word2vec(spark: SparkSession, d: str) -> DataFrame:
    """With the parameters of the shipped configuration, the texts in as many parts as there are cores."""
    texts = _t(spark, d, "parsed_documents").where("_ref is not null").groupBy("_ref").agg(F.max("text").alias("text"))
    return _long(embedding.fit_embedding(texts, "_ref", partitions=spark.sparkContext.defaultParallelism), "word")


@query()
def pca(spark: SparkSession, d: str) -> DataFrame:
    v = _t(spark, d, "embeddings").select(F.col("vec_id").alias("_ref"), F.col("embedding").cast("array<double>").alias("vec"))
    return _long(reduce_vectors(v, 8)[0], "_ref", vec="vec_reduced")


@query("SELECT DISTINCT score_method AS method, _ref, len(v) AS n, round(v[1]::DOUBLE, 6) + 0.0 AS first FROM document_vectors WHERE score_method = 'simple' AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x))) = 0")
def stored_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all methods stored by method; those of one method read back from their partition alone."""
    v = _t(spark, d, "document_vectors").select(F.col("score_method").alias("method"), "_ref", F.col("v").cast("array<double>").alias("vec"))
    path = shared_path(spark, "store")
    tables.save_vectors(v.where("vec is not null and not exists(vec, x -> x is null or isnan(x))").distinct(), path)
    held = tables.load_vectors(spark, path, "simple")
    return held.select(F.lit("simple").alias("method"), "_ref", F.size("vec").cast("long").alias("n"), _r(F.get("vec", F.lit(0))).alias("first"))


@query(f'WITH {_DOCS} SELECT word, "count" FROM tdf UNION ALL SELECT \'{tables.DOCUMENT_COUNTER}\', n FROM nn')
def stored_counts(spark: SparkSession, d: str) -> DataFrame:
    """Document frequencies exported as CSV with the counter's row, read again, and the counter put back as a row."""
    docs = _docs(spark, d)
    path = shared_path(spark, "counts")
    tables.write_counts(counts.term_document_frequency(docs), docs.count(), path)
    back, n = tables.read_counts(spark, path)
    return back.unionAll(spark.createDataFrame([(tables.DOCUMENT_COUNTER, n)], back.schema))


def _stored_vectors(spark: SparkSession, d: str) -> str:
    """The vectors of all methods, with their reduced ones, in a store."""
    v = _t(spark, d, "document_vectors").select(F.col("score_method").alias("method"), "_ref", F.col("v").cast("array<double>").alias("vec"), F.col("vx").cast("array<double>").alias("vec_reduced"))
    path = shared_path(spark, "store")
    tables.save_vectors(v.where("method is not null and vec is not null and not exists(vec, x -> x is null or isnan(x))").distinct(), path)
    return path


_STORE = "SELECT DISTINCT score_method AS method, _ref, v, vx FROM document_vectors WHERE score_method IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x))) = 0"


@query(f"SELECT DISTINCT method FROM ({_STORE})")
def score_methods(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(m,) for m in tables.score_methods(spark, _stored_vectors(spark, d))], "method string")


@query(f"SELECT _ref, len(vx) AS n, round(vx[1]::DOUBLE, 6) + 0.0 AS first, round(vx[16]::DOUBLE, 6) + 0.0 AS last FROM ({_STORE}) WHERE method = 'unique_IDF'")
def stored_reduced(spark: SparkSession, d: str) -> DataFrame:
    """The reduced vectors of one method."""
    held = tables.load_vectors(spark, _stored_vectors(spark, d), "unique_IDF", use_reduced=True)
    return held.select("_ref", F.when(F.col("vec").isNotNull(), F.size("vec")).cast("long").alias("n"), _r(F.get("vec", F.lit(0))).alias("first"), _r(F.get("vec", F.lit(15))).alias("last"))


# --- clusters ------------------------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("_ref"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").alias("cluster_id"))


_V = "v AS (SELECT vec_id AS _ref, embedding::DOUBLE[] AS vec, label AS cluster_id FROM embeddings)"
_CENTROIDS = f"""{_V},
cs AS (SELECT cluster_id, ix, avg(vec[ix]) AS x FROM v, range(1, {DIM + 1}) g(ix) GROUP BY cluster_id, ix),
cl AS (SELECT cluster_id, sqrt(sum(x * x)) AS len FROM cs GROUP BY cluster_id),
c AS (SELECT cluster_id, list(x / len ORDER BY ix) AS vec FROM cs JOIN cl USING (cluster_id) GROUP BY cluster_id)"""
_LABELS = f"""{_CENTROIDS},
lab AS (SELECT _ref, cluster_id, cosine FROM (SELECT v._ref, c.cluster_id, list_cosine_similarity(v.vec, c.vec) AS cosine,
  row_number() OVER (PARTITION BY v._ref ORDER BY round(1 - list_cosine_similarity(v.vec, c.vec), 12), c.cluster_id) AS rn FROM v, c) WHERE rn = 1)"""
#: Rows of a chunk in the chunk queries.
_M = 100
_CHUNKS = f"""{_V}, k AS (SELECT greatest(1, count(*) // {_M}) AS k FROM v),
ch AS (SELECT _ref, vec, rn, n, k FROM (SELECT *, row_number() OVER (ORDER BY md5('0:0:' || _ref), _ref) - 1 AS rn, count(*) OVER () AS n FROM v), k),
chunks AS (SELECT _ref, vec, (CASE WHEN rn < (n % k) * (n // k + 1) THEN rn // (n // k + 1) ELSE n % k + (rn - (n % k) * (n // k + 1)) // (n // k) END)::INTEGER AS chunk FROM ch)"""


def _centroids(spark: SparkSession, d: str) -> DataFrame:
    return metacluster.centroids(_vectors(spark, d), DIM)


def _labels(spark: SparkSession, d: str) -> DataFrame:
    c = np.array([r.vec for r in _centroids(spark, d).orderBy("cluster_id").collect()])
    return metacluster.assign_labels(_vectors(spark, d), c)


@query(f"WITH {_CHUNKS} SELECT 0 AS repeat, chunk, _ref FROM chunks")
def subset_chunks(spark: SparkSession, d: str) -> DataFrame:
    return metacluster.subset_chunks(_vectors(spark, d), _M)


@query(f"WITH {_CHUNKS} SELECT a.chunk, a._ref AS a, b._ref AS b, round(least(list_cosine_similarity(a.vec, b.vec), 1.0) + 1 + 1e-8, 6) + 0.0 AS affinity FROM chunks a JOIN chunks b USING (chunk)")
def cosine_affinity(spark: SparkSession, d: str) -> DataFrame:
    """Affinities within the chunks of all vectors."""
    v = _vectors(spark, d)
    chunked = v.join(metacluster.subset_chunks(v, _M), "_ref")
    return metacluster.cosine_affinity(chunked, by=["chunk"]).withColumn("affinity", _r("affinity"))


@query(f"WITH {_CENTROIDS} SELECT cluster_id, (g.ix - 1)::INTEGER AS dim, round(vec[g.ix], 6) + 0.0 AS value FROM c, range(1, {DIM + 1}) g(ix)")
def centroids(spark: SparkSession, d: str) -> DataFrame:
    return _long(_centroids(spark, d), "cluster_id")


@query(f"WITH {_LABELS} SELECT _ref, cluster_id, round(cosine, 6) + 0.0 AS cosine FROM lab")
def assign_labels(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).withColumn("cosine", _r("cosine"))


@query(f"WITH {_LABELS} SELECT cluster_id, count(*) AS counts FROM lab GROUP BY cluster_id")
def label_histogram(spark: SparkSession, d: str) -> DataFrame:
    return metacluster.label_histogram(_labels(spark, d))


@query(f"WITH {_LABELS} SELECT cluster_id, round(avg(cosine), 6) + 0.0 AS mean, round(stddev_pop(cosine), 6) + 0.0 AS std, round(min(cosine), 6) + 0.0 AS min FROM lab GROUP BY cluster_id")
def centroid_spread(spark: SparkSession, d: str) -> DataFrame:
    return metacluster.centroid_spread(_labels(spark, d)).select("cluster_id", *[_r(c).alias(c) for c in ("mean", "std", "min")])


@query()
def metaclusters(spark: SparkSession, d: str) -> DataFrame:
    """Spectral metaclusters of all vectors: labels with the spread of their cluster."""
    got = metacluster.metacluster(_vectors(spark, d).select("_ref", "vec"), DIM, m=200, kn=12, pcut=0.8)
    return got["labels"].join(got["spread"], "cluster_id").select("_ref", "cluster_id", "cosine", "mean", "std", "min")


_PAIRS_SQL = f"""WITH {_V}, u AS (SELECT cluster_id, _ref, vec FROM v),
x AS (SELECT a.cluster_id AS a, b.cluster_id AS b, 1 - list_cosine_similarity(a.vec, b.vec) AS dist FROM u a JOIN u b ON a._ref <> b._ref AND a.cluster_id <= b.cluster_id)
SELECT a, b, round(avg(dist), 6) + 0.0 AS dispersion FROM x GROUP BY a, b"""


@query(_PAIRS_SQL)
def dispersion(spark: SparkSession, d: str) -> DataFrame:
    return analyze.dispersion(_vectors(spark, d), DIM).withColumn("dispersion", _r("dispersion"))


@query(f"WITH {_CENTROIDS} SELECT cluster_id, round(avg(1 - list_cosine_similarity(v.vec, c.vec)), 6) + 0.0 AS avg_centroid_distance FROM v JOIN c USING (cluster_id) GROUP BY cluster_id")
def centroid_distance(spark: SparkSession, d: str) -> DataFrame:
    return analyze.centroid_distance(_vectors(spark, d), _centroids(spark, d)).withColumn("avg_centroid_distance", _r("avg_centroid_distance"))


_CPLAIN = _CENTROIDS[len(_V) + 1 :]
_WORDS = f"""{_TOY}, {_V}, {_CPLAIN},
near AS (SELECT c.cluster_id, word, row_number() OVER (PARTITION BY c.cluster_id ORDER BY round(list_cosine_similarity(toy.vec, c.vec), 12) DESC, word) AS ix FROM c, toy),
words AS (SELECT cluster_id, string_agg(word, ' ' ORDER BY ix) AS word2vec_description FROM near WHERE ix <= 10 GROUP BY cluster_id)"""


def _toy_embedding(spark: SparkSession, d: str) -> DataFrame:
    return materialize(_toy(spark, d, counts.term_document_frequency(_docs(spark, d))).select("word", "vec"), "toy")


@query(f"WITH {_WORDS} SELECT cluster_id, word2vec_description FROM words")
def top_words(spark: SparkSession, d: str) -> DataFrame:
    return analyze.top_words(_centroids(spark, d), _toy_embedding(spark, d))


@query(f"""WITH {_WORDS}, n AS (SELECT cluster_id, count(*) AS counts FROM v GROUP BY cluster_id),
dist AS (SELECT cluster_id, avg(1 - list_cosine_similarity(v.vec, c.vec)) AS x FROM v JOIN c USING (cluster_id) GROUP BY cluster_id)
SELECT cluster_id, (row_number() OVER (ORDER BY cluster_id) - 1)::INTEGER AS dispersion_order, counts, round(x, 6) + 0.0 AS avg_centroid_distance, -1.0::DOUBLE AS intra_document_dispersion, word2vec_description
FROM n JOIN dist USING (cluster_id) JOIN words USING (cluster_id)""")
def cluster_desc(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    desc = analyze.cluster_desc(v.select("_ref", "vec"), v.select("_ref", "cluster_id"), _centroids(spark, d), _toy_embedding(spark, d), DIM)
    return desc.withColumn("avg_centroid_distance", _r("avg_centroid_distance"))


@query()
def cluster_desc_dispersion(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return analyze.cluster_desc(v.select("_ref", "vec"), v.select("_ref", "cluster_id"), _centroids(spark, d), _toy_embedding(spark, d), DIM, compute_dispersion=True)


@query("""WITH l AS (SELECT _ref, min(meta_labels) AS cluster_id FROM cluster_master_labels WHERE meta_labels IS NOT NULL GROUP BY _ref),
o AS (SELECT cluster_id, (row_number() OVER (ORDER BY cluster_id) - 1)::INTEGER AS p FROM (SELECT DISTINCT cluster_id FROM l))
SELECT s._ref, l.cluster_id, coalesce(p, -1) AS dispersion_order, pmid, journal FROM source_csv s LEFT JOIN l ON s._ref = l._ref LEFT JOIN o ON l.cluster_id = o.cluster_id""")
def master_labels(spark: SparkSession, d: str) -> DataFrame:
    labels = _t(spark, d, "cluster_master_labels").where("meta_labels is not null").groupBy("_ref").agg(F.min("meta_labels").alias("cluster_id"))
    return analyze.master_labels(_t(spark, d, "source_csv"), labels, analyze.dispersion_order(None, labels), ["pmid", "journal"])


@query(f"WITH {_CENTROIDS}" + """, n AS (SELECT cluster_id, count(*) AS counts FROM v GROUP BY cluster_id),
dist AS (SELECT cluster_id, avg(1 - list_cosine_similarity(v.vec, c.vec)) AS x FROM v JOIN c USING (cluster_id) GROUP BY cluster_id)
SELECT cluster_id, counts, round(x, 6) + 0.0 AS avg_centroid_distance FROM n JOIN dist USING (cluster_id)""")
def cluster_desc_shown(spark: SparkSession, d: str) -> DataFrame:
    """The report stored, overwritten and loaded again, as it is shown when dispersion is off (its words are in ``cluster_desc``)."""
    v, path = _vectors(spark, d), shared_path(spark, "clusters")
    c = _centroids(spark, d)
    words = spark.createDataFrame([("word", [1.0] * DIM)], "word string, vec array<double>")
    desc = analyze.cluster_desc(v.select("_ref", "vec"), v.select("_ref", "cluster_id"), c, words, DIM)
    tables.save_tables({"desc": desc.limit(1), "centroids": c}, path)
    tables.save_tables({"desc": desc}, path)
    held = tables.load_tables(spark, path, ["desc", "centroids"])
    shown = analyze.without_dispersion(held["desc"]).join(held["centroids"].select("cluster_id"), "cluster_id")
    return shown.select("cluster_id", "counts", _r("avg_centroid_distance").alias("avg_centroid_distance"))


_HELD = """WITH l AS (SELECT _ref, min(meta_labels) AS cluster_id FROM cluster_master_labels WHERE meta_labels IS NOT NULL GROUP BY _ref),
v AS (SELECT _ref, min(v::DOUBLE[]) AS vec FROM document_vectors WHERE score_method = 'unique_IDF' AND len(v) = 64 AND len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = 64 GROUP BY _ref),
h AS (SELECT cluster_id, vec, len(list_filter(vec, lambda x: x <> 0)) > 0 AS ok FROM v JOIN l USING (_ref)),
cs AS (SELECT cluster_id, ix, avg(vec[ix]) AS x FROM h, range(1, 65) g(ix) GROUP BY cluster_id, ix), c AS (SELECT cluster_id, list(x ORDER BY ix) AS c FROM cs GROUP BY cluster_id)"""


@query(_HELD + " SELECT cluster_id, round(avg(1 - list_cosine_similarity(vec, c)), 6) + 0.0 AS avg_centroid_distance FROM h JOIN c USING (cluster_id) WHERE ok GROUP BY cluster_id")
def zero_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Distances to the centroids of the stored clusters, of stored vectors some of which are zero and left out."""
    labels = _t(spark, d, "cluster_master_labels").where("meta_labels is not null").groupBy("_ref").agg(F.min("meta_labels").alias("cluster_id"))
    v = _t(spark, d, "document_vectors").where("score_method = 'unique_IDF' and _ref is not null").select("_ref", F.col("v").cast("array<double>").alias("vec"))
    finite = F.coalesce((F.size("vec") == DIM) & F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))
    held = analyze.members(v.where(finite).groupBy("_ref").agg(F.min("vec").alias("vec")), labels)
    return analyze.centroid_distance(held, metacluster.centroids(held, DIM)).withColumn("avg_centroid_distance", _r("avg_centroid_distance"))


# --- prediction ----------------------------------------------------------------------------------------------------

FOLDS = 5


@query("SELECT lang AS y, count(*) AS \"count\", round(count(*) / (sum(count(*)) OVER ()), 6) + 0.0 AS share FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def class_balance(spark: SparkSession, d: str) -> DataFrame:
    return predict.class_balance(_t(spark, d, "documents"), "lang").withColumn("share", _r("share"))


@query("SELECT round(max(n) / sum(n), 6) + 0.0 AS baseline FROM (SELECT count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang)")
def majority_baseline(spark: SparkSession, d: str) -> DataFrame:
    return predict.majority_baseline(_t(spark, d, "documents"), "lang").withColumn("baseline", _r("baseline"))


@query("SELECT doc_id, lang, (dense_rank() OVER (ORDER BY lang) - 1)::INTEGER AS y_truth FROM documents WHERE lang IS NOT NULL")
def label_encode(spark: SparkSession, d: str) -> DataFrame:
    return predict.label_encode(_t(spark, d, "documents").select("doc_id", "lang"), "lang")


_FOLD = "(ntile({}) OVER (PARTITION BY {} ORDER BY {}) - 1)::INTEGER AS fold"


@query(f"SELECT _ref, journal, {_FOLD.format(10, 'journal', '_ref')} FROM source_csv WHERE journal IS NOT NULL")
def stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    src = _t(spark, d, "source_csv").select("_ref", "journal").where("journal is not null")
    return predict.stratified_folds(src, "journal", 10)


def _truth(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).withColumnRenamed("cluster_id", "y_truth")


def _predicted(spark: SparkSession, d: str, dim: int) -> DataFrame:
    cut = _truth(spark, d).withColumn("vec", F.slice("vec", 1, dim))
    return predict.centroid_cross_validate(cut, dim, FOLDS)


def _predicted_sql(dim: int, name: str) -> str:
    return f"""{name}_f AS (SELECT vec_id AS _ref, label AS y, list_slice(embedding::DOUBLE[], 1, {dim}) AS vec, {_FOLD.format(FOLDS, 'label', 'vec_id')} FROM embeddings),
{name}_m AS (SELECT t.fold, y, ix, avg(vec[ix]) AS x FROM {name}_f f JOIN (SELECT DISTINCT fold FROM {name}_f) t ON f.fold <> t.fold, range(1, {dim + 1}) g(ix) GROUP BY t.fold, y, ix),
{name}_c AS (SELECT fold, y, list(x ORDER BY ix) AS c FROM {name}_m GROUP BY fold, y),
{name} AS (SELECT _ref, fold, y_truth, y_pred FROM (SELECT f._ref, f.fold, f.y AS y_truth, c.y AS y_pred, row_number() OVER (PARTITION BY f._ref ORDER BY round(list_dot_product(c.c, c.c) - 2 * list_dot_product(f.vec, c.c), 9), c.y) AS rn FROM {name}_f f JOIN {name}_c c ON f.fold = c.fold) WHERE rn = 1)"""


@query(f"WITH {_predicted_sql(DIM, 'p')} SELECT _ref, fold, y_truth, y_pred FROM p")
def cross_validation(spark: SparkSession, d: str) -> DataFrame:
    return _predicted(spark, d, DIM)


@query(f"""WITH {_predicted_sql(DIM, 'p')},
s AS (SELECT fold, y_truth AS y, 1 AS t, 0 AS r, (y_truth = y_pred)::INTEGER AS tp FROM p UNION ALL SELECT fold, y_pred, 0, 1, 0 FROM p),
k AS (SELECT fold, y, 2.0 * sum(tp) / (sum(t) + sum(r)) AS f1 FROM s GROUP BY fold, y)
SELECT a.fold, round(a.acc, 6) + 0.0 AS accuracy, round(m.f1, 6) + 0.0 AS f1 FROM (SELECT fold, avg((y_truth = y_pred)::INTEGER) AS acc FROM p GROUP BY fold) a JOIN (SELECT fold, avg(f1) AS f1 FROM k GROUP BY fold) m USING (fold)""")
def fold_metrics(spark: SparkSession, d: str) -> DataFrame:
    return predict.fold_metrics(_predicted(spark, d, DIM), "macro").select("fold", _r("accuracy").alias("accuracy"), _r("f1").alias("f1"))


@query(f"""WITH {_predicted_sql(DIM, 'p')}, {_predicted_sql(DIM // 2, 'h')}, j AS (SELECT p.y_truth = p.y_pred AS a, h.y_truth = h.y_pred AS b FROM p JOIN h USING (_ref))
SELECT 'full' AS b, count_if(a) AS "full", count_if(b AND NOT a) AS half FROM j UNION ALL SELECT 'half', count_if(a AND NOT b), count_if(b) FROM j""")
def disagreement(spark: SparkSession, d: str) -> DataFrame:
    table = predict.prediction_table({"full": _predicted(spark, d, DIM), "half": _predicted(spark, d, DIM // 2)})
    return predict.disagreement(table, ["full", "half"])


@query(f"""WITH {_predicted_sql(DIM, 'p')} SELECT p._ref, y_truth, y_pred AS centroid, journal FROM p LEFT JOIN source_csv s ON s._ref = p._ref""")
def prediction_table(spark: SparkSession, d: str) -> DataFrame:
    return predict.prediction_table({"centroid": _predicted(spark, d, DIM)}, _t(spark, d, "source_csv"), ["journal"])


@query("""WITH v AS (SELECT vec_id AS r, label AS y, embedding::DOUBLE[] AS vec FROM embeddings)
SELECT _ref, rank::INTEGER AS rank, near FROM (SELECT a.r AS _ref, b.r AS near, row_number() OVER (PARTITION BY a.r ORDER BY round(list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 12), b.r) AS rank FROM v a JOIN v b ON a.y = b.y AND a.r <> b.r) WHERE rank <= 5""")
def smote_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return predict.class_neighbours(_truth(spark, d), DIM)


_SMOTE = """WITH v AS (SELECT vec_id AS r, label AS y, embedding::DOUBLE[] AS vec FROM embeddings),
sz AS (SELECT y, count(*) AS n FROM v GROUP BY y), mx AS (SELECT max(n) AS most FROM sz),
nb AS (SELECT r, list(near ORDER BY rank) AS nears FROM (SELECT a.r, b.r AS near, row_number() OVER (PARTITION BY a.r ORDER BY round(list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 12), b.r) AS rank FROM v a JOIN v b ON a.y = b.y AND a.r <> b.r) WHERE rank <= 5 GROUP BY r),
rk AS (SELECT v.r, v.y, vec, nears, n, most, row_number() OVER (PARTITION BY v.y ORDER BY v.r) - 1 AS pos FROM v JOIN sz USING (y) JOIN nb USING (r), mx WHERE n < most),
tm AS (SELECT *, (most - n) // n + CASE WHEN pos < (most - n) % n THEN 1 ELSE 0 END AS times FROM rk),
cp AS (SELECT *, unnest(range(1, times + 1)) AS cpy FROM tm WHERE times > 0),
dg AS (SELECT *, md5('0:' || r || ':' || cpy) AS h FROM cp),
pk AS (SELECT *, nears[(('0x' || substr(h, 1, 7))::BIGINT % len(nears))::BIGINT + 1] AS near, ('0x' || substr(h, 9, 7))::BIGINT / 268435456.0::DOUBLE AS u FROM dg),
made AS (SELECT -1 - (pk.r * most + cpy) AS _ref, pk.y, list_transform(list_zip(pk.vec, w.vec), lambda z: z[1] + u * (z[2] - z[1])) AS vec FROM pk JOIN v w ON w.r = pk.near),
al AS (SELECT r AS _ref, y, vec FROM v UNION ALL SELECT * FROM made)
SELECT _ref, y AS y_truth, (ix - 1)::INTEGER AS dim, round(vec[ix], 6) + 0.0 AS value FROM al, range(1, 65) g(ix)"""


@query(_SMOTE)
def smote(spark: SparkSession, d: str) -> DataFrame:
    return _long(predict.smote(_truth(spark, d), DIM), "_ref", "y_truth")


@query()
def forest_predict(spark: SparkSession, d: str) -> DataFrame:
    return predict.cross_validate(_truth(spark, d), predict.forest_predict, 10, lambda t: predict.smote(t, DIM))


@query("SELECT vec_id AS _ref, 96::BIGINT AS n, round(embedding[1]::DOUBLE, 6) + 0.0 AS first, round(embedding[32]::DOUBLE, 6) + 0.0 AS last FROM embeddings")
def meta_features(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d).select("_ref", "vec")
    both = predict.meta_features([v, v.withColumn("vec", F.slice("vec", 1, DIM // 2))])
    return both.select("_ref", F.size("vec").cast("long").alias("n"), _r(F.get("vec", F.lit(0))).alias("first"), _r(F.element_at("vec", -1)).alias("last"))


@query()
def meta_predict(spark: SparkSession, d: str) -> DataFrame:
    """The halves of the vectors stand for two methods."""
    v = _truth(spark, d)
    halves = [v.withColumn("vec", F.slice("vec", at, DIM // 2)) for at in (1, DIM // 2 + 1)]
    return predict.cross_validate(predict.meta_features(halves).join(v.select("_ref", "y_truth"), "_ref"), predict.forest_predict, 10)


# --- explanations --------------------------------------------------------------------------------------------------

CLOSE = 0.0


@query(f"WITH {_CENTROIDS} SELECT a.cluster_id AS i, b.cluster_id AS j, round(list_cosine_similarity(a.vec, b.vec), 6) + 0.0 AS similarity FROM c a JOIN c b ON a.cluster_id < b.cluster_id AND list_cosine_similarity(a.vec, b.vec) > {CLOSE}")
def lime_pairs(spark: SparkSession, d: str) -> DataFrame:
    return explain.close_pairs(_centroids(spark, d), CLOSE).withColumn("similarity", _r("similarity"))


_SUBSET = f"""{_CENTROIDS}, pr AS (SELECT a.cluster_id AS i, b.cluster_id AS j FROM c a JOIN c b ON a.cluster_id < b.cluster_id AND list_cosine_similarity(a.vec, b.vec) > {CLOSE}),
mem AS (SELECT i, j, 0 AS y, _ref FROM pr JOIN v ON v.cluster_id = i UNION ALL SELECT i, j, 1, _ref FROM pr JOIN v ON v.cluster_id = j),
rk AS (SELECT *, row_number() OVER (PARTITION BY i, j, y ORDER BY md5('0:' || _ref), _ref) AS ix, count(*) OVER (PARTITION BY i, j, y) AS n FROM mem),
sub AS (SELECT i, j, y, _ref FROM (SELECT *, min(n) OVER (PARTITION BY i, j) AS least FROM rk) WHERE ix <= least(least, 25))"""


@query(f"WITH {_SUBSET} SELECT i, j, y, _ref FROM sub")
def lime_subset(spark: SparkSession, d: str) -> DataFrame:
    pairs = explain.close_pairs(_centroids(spark, d), CLOSE)
    return explain.even_subset(explain.pair_members(_vectors(spark, d), pairs), 25)


@query("""WITH s AS (SELECT batch AS i, cluster_id AS j, src_word AS word, (length(src_word) - 14.0) * (CASE WHEN counts IS NULL THEN 1 ELSE counts END) AS score FROM (SELECT batch, cluster_id, counts, unnest(string_split(word2vec_description, ' ')) AS src_word FROM cluster_desc)),
a AS (SELECT i, j, word, CASE WHEN t = 0 THEN NULL ELSE score / t END AS score FROM (SELECT *, sum(abs(score)) OVER (PARTITION BY i, j) AS t FROM s)),
b AS (SELECT * FROM a WHERE abs(score) > 0.005)
SELECT i AS negative_class, j AS positive_class, word, round(100 * score / sum(abs(score)) OVER (PARTITION BY i, j), 6) + 0.0 AS score FROM b""")
def lime_normalise(spark: SparkSession, d: str) -> DataFrame:
    rows_ = _t(spark, d, "cluster_desc").select(F.col("batch").alias("i"), F.col("cluster_id").alias("j"), "counts", F.explode(F.split("word2vec_description", " ")).alias("word"))
    scores = rows_.select("i", "j", "word", ((F.length("word") - 14.0) * F.coalesce("counts", F.lit(1))).alias("score"))
    return explain.normalise_scores(scores).withColumn("score", _r("score"))


@query()
def lime_explain(spark: SparkSession, d: str) -> DataFrame:
    """Words that tell each two close stored clusters apart, from even subsets of their parsed texts."""
    labels = _t(spark, d, "cluster_master_labels").where("meta_labels is not null").select("_ref", F.col("meta_labels").alias("cluster_id")).distinct()
    v = _t(spark, d, "document_vectors").where("score_method = 'unique_IDF' and _ref is not null").select("_ref", F.col("v").cast("array<double>").alias("vec"))
    usable = F.coalesce((F.size("vec") == DIM) & F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0), F.lit(False))
    held = labels.join(v.where(usable).groupBy("_ref").agg(F.min("vec").alias("vec")), "_ref")
    pairs = materialize(explain.close_pairs(metacluster.centroids(held, DIM), CLOSE).select("i", "j"), "pairs")
    subset = explain.even_subset(explain.pair_members(labels, pairs), 25)
    texts = _t(spark, d, "parsed_documents").groupBy("_ref").agg(F.max("text").alias("text"))
    tokens = counts.document_tokens(texts, "_ref")
    emb = _toy(spark, d, counts.term_document_frequency(tokens)).select("word", "vec")
    members = tokens.join(small(materialize(subset, "subset")), "_ref")
    return explain.normalise_scores(explain.explain_pairs(members, materialize(emb, "emb"), DIM))
