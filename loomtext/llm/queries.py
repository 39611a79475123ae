"""Queries of the operators of this subpackage over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import normalize
from loomtext.llm.cluster import described, hashed_vectors, labelled_clusters, labelled_members, mislabelled
from loomtext.llm.knn import nearest_neighbours, similar_groups, similar_pairs
from loomtext.llm.leaks import leaked_items
from loomtext.llm.lookalike import canonical_columns, lookalike_groups, lookalike_pairs
from loomtext.llm.neardup import near_duplicate_groups, near_duplicate_pairs
from loomtext.llm.split import split_oversized
from loomtext.llm.terms import distinctive_terms, marked_terms
from loomtext.llm.tokens import decode_corpus, encode_corpus
from loomtext.plans.shared import spread


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/{name}.parquet"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike_pairs(_table(spark, d, "source_csv"), "_ref", ["title", "abstract"])


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return lookalike_groups(_table(spark, d, "source_csv"), "_ref", ["title", "abstract"]).withColumnRenamed("id", "_ref")


def p1_canonical(spark: SparkSession, d: str) -> DataFrame:
    return canonical_columns(_table(spark, d, "source_csv").select("_ref", "title", "abstract"), ["title", "abstract"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_pairs(_table(spark, d, "source_csv"), "_ref", ["title", "abstract"])


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_groups(_table(spark, d, "source_csv"), "_ref", ["title", "abstract"]).withColumnRenamed("id", "_ref")


#: In ln(N): a term is characteristic of a record when its weight is at least this.
CHARACTERISTIC = 3.05


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    # as ln(N / (d + 1)) < ln(N), a term of the record must stand there more often than the threshold
    scored = distinctive_terms(_table(spark, d, "parsed_documents"), least=math.floor(CHARACTERISTIC) + 1)
    return scored.where(F.col("weight") >= CHARACTERISTIC * F.log(F.col("n_records").cast("double"))).select(F.col("id").alias("_ref"), "word")


def p3_scores(spark: SparkSession, d: str) -> DataFrame:
    scored = distinctive_terms(_table(spark, d, "parsed_documents"))
    return scored.select(F.col("id").alias("_ref"), "word", "c", "d", (F.round("score", 4) + 0.0).alias("score"), (F.round("weight", 4) + 0.0).alias("weight"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    marked = marked_terms(_table(spark, d, "parsed_documents"), _table(spark, d, "term_document_frequency"))
    return marked.select("word", F.explode("marks").alias("mark"))


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    marked = marked_terms(_table(spark, d, "parsed_documents"), _table(spark, d, "term_document_frequency"))
    return marked.select("word", "occ", "recs", "stored", F.array_join("marks", ",").alias("marks"))


def _unique_idf(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "document_vectors").where("score_method = 'unique_IDF'")


def _stored_clusters(spark: SparkSession, d: str) -> int:
    return _table(spark, d, "cluster_desc").select("cluster_id").where("cluster_id is not null").distinct().count()


def _clusters(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return labelled_clusters(_unique_idf(spark, d), _table(spark, d, "cluster_master_labels"), _stored_clusters(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return mislabelled(*_clusters(spark, d)).withColumnRenamed("id", "_ref")


def p6_clusters(spark: SparkSession, d: str) -> DataFrame:
    return described(*_clusters(spark, d), _table(spark, d, "cluster_desc")).withColumn("mean_cosine", F.round("mean_cosine", 3) + 0.0)


def p6_text_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of the parsed texts themselves, by hashed weighted features, held against the same labels."""
    vectors = hashed_vectors(_table(spark, d, "parsed_documents"), "_ref", "text")
    members, right = labelled_members(vectors, _table(spark, d, "cluster_master_labels"), _stored_clusters(spark, d), 512, 0.0, still=1e-3)
    return described(members, right, _table(spark, d, "cluster_desc"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_pairs(_unique_idf(spark, d))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    return similar_groups(_unique_idf(spark, d)).withColumnRenamed("id", "_ref")


def p7_neighbours(spark: SparkSession, d: str) -> DataFrame:
    near = nearest_neighbours(_unique_idf(spark, d)).withColumnRenamed("id", "_ref")
    return near.withColumn("cosine", F.round("cosine", 3) + 0.0)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(_table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    return decode_corpus(encode_corpus(_table(spark, d, "documents"))).withColumnRenamed("id", "doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(_table(spark, d, "documents"), _table(spark, d, "eval_items")).select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """For each item that leaked: the documents that hold it and the runs found in them."""
    leaks = leaked_items(_table(spark, d, "documents"), _table(spark, d, "eval_items"))
    return leaks.groupBy(F.col("item").alias("item_id")).agg(F.count(F.lit(1)).alias("documents"), F.sum("runs").alias("runs"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = split_oversized(_table(spark, d, "documents"), texts=False)
    return pieces.where("piece = 1").select(F.col("id").alias("doc_id")).distinct()


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(_table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(v)}


_RECORDS = """
rec AS (SELECT _ref, max(struct_pack(t := parsed_at, x := text)).x AS text FROM parsed_documents WHERE _ref IS NOT NULL GROUP BY _ref),
tok AS (SELECT _ref, unnest(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS word FROM rec),
tc AS (SELECT _ref, word, count(*) AS c FROM tok GROUP BY _ref, word),
wc AS (SELECT word, sum(c)::BIGINT AS occ, count(*) AS d FROM tc GROUP BY word),
nn AS (SELECT count(DISTINCT _ref) AS n, sum(c)::DOUBLE AS total FROM tc),
ln AS (SELECT _ref, sum(c)::DOUBLE AS length FROM tc GROUP BY _ref)"""
_STORED = """
kept AS (SELECT word, coalesce(sum("count"), 0)::BIGINT AS stored FROM (SELECT DISTINCT batch, src_file, word, "count" FROM term_document_frequency WHERE word IS NOT NULL) GROUP BY word),
marked AS (SELECT word, occ, d AS recs, coalesce(stored, 0) AS stored, d < 3 AS rare, d > 0.15 * n AS common, d <> coalesce(stored, 0) AS wrong
  FROM wc LEFT JOIN kept USING (word), nn)"""


_UNITS = """WITH ok AS (SELECT DISTINCT _ref AS r, v::DOUBLE[] AS v FROM document_vectors WHERE score_method = 'unique_IDF' AND _ref IS NOT NULL AND len(v) = 64
  AND len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(v, lambda x: x <> 0)) > 0),
u AS (SELECT r, v, sqrt(list_dot_product(v, v)) AS n FROM ok)"""


def _form(text: str) -> str:
    """A text's form in SQL, by rules of single characters: every letter that looks like a Latin one is that letter, in
    Cyrillic words too, which tells the same texts apart and together as the operator's form does."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    alike = normalize.CYRILLIC + normalize.GREEK + "\u2010\u2011\u00b5" + wide
    plain = normalize.CYRILLIC_AS + normalize.GREEK_AS + "--\u03bc" + "".join(chr(ord(c) - 0xFEE0) for c in wide)
    parts = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\u2026": "..."}
    flat = reduce(lambda c, x: f"replace({c}, '{x[0]}', '{x[1]}')", parts.items(), text)
    shown = f"regexp_replace({flat}, '[\\x00-\\x08\\x0e-\\x1b\\x7f-\\x{{84}}\\x{{86}}-\\x{{9f}}\\p{{Cf}}\\x{{34f}}\\x{{fe00}}-\\x{{fe0f}}]', '', 'g')"
    spaced = f"trim(regexp_replace({shown}, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"
    return f"nfc_normalize(translate({spaced}, '{alike.replace(chr(39), chr(39) * 2)}', '{plain.replace(chr(39), chr(39) * 2)}'))"


def _words(text: str) -> str:
    return f"regexp_extract_all(lower({_form(text)}), '[\\p{{L}}\\p{{N}}]+')"


_ALIKE = f"""WITH t AS (SELECT 'title' AS field, _ref, title AS raw, {_form('title')} AS form FROM source_csv UNION ALL SELECT 'abstract', _ref, abstract, {_form('abstract')} FROM source_csv),
f AS (SELECT DISTINCT field, _ref, raw, form FROM t WHERE raw IS NOT NULL AND form <> '' AND lower(form) <> 'n/a' AND NOT regexp_full_match(form, '\\[[^\\]]*\\]'))"""
_LEAKED = f"""WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_words('text')} AS w FROM eval_items WHERE text IS NOT NULL),
dr AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k : k + 11], ' '))) AS run FROM d WHERE len(w) >= 12),
ir AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k : k + 11], ' '))) AS run FROM i WHERE len(w) >= 12),
leaked AS (SELECT doc_id, item_id, count(*) AS runs FROM dr JOIN ir USING (run) GROUP BY doc_id, item_id)"""
#: Words of records with their number of occurrence; pairs of different multisets by what they have in common.
_NEAR = f"""WITH RECURSIVE r AS (SELECT DISTINCT _ref AS id, {_words("concat_ws(' ', title, abstract)")} AS w FROM source_csv WHERE _ref IS NOT NULL),
k AS (SELECT id, list_sort(w) AS w, len(w) AS n FROM r WHERE len(w) >= 20),
members AS (SELECT id, min(id) OVER (PARTITION BY w) AS rep FROM k), c AS (SELECT DISTINCT k.id, w, n FROM k JOIN members m ON m.rep = k.id AND m.id = k.id),
e AS (SELECT id, n, unnest(list_transform(range(1, len(w) + 1), lambda x: w[x] || ' ' || (x - list_position(w, w[x])))) AS e FROM c),
df AS (SELECT e, count(*) AS f FROM e GROUP BY e), o AS (SELECT id, n, e, row_number() OVER (PARTITION BY id ORDER BY f, e) AS pos FROM e JOIN df USING (e)),
hd AS (SELECT id, n, e FROM o WHERE pos <= n - ceil(n * 0.8 - 1e-9) + 1),
met AS (SELECT DISTINCT x.id AS a, y.id AS b FROM hd x JOIN hd y ON x.e = y.e AND x.id < y.id AND least(x.n, y.n) >= 0.8 * greatest(x.n, y.n) - 1e-9),
pairs AS (SELECT a, b FROM (SELECT a, b, x.n AS na, y.n AS nb, count(*) AS common FROM met JOIN e x ON x.id = a JOIN e y ON y.id = b AND y.e = x.e GROUP BY ALL) WHERE common >= 0.8 * greatest(na, nb) - 1e-9)"""




def _lloyd(steps: int = 8) -> str:
    """Clusters in SQL: mean directions of the stored labels, moved as spherical k-means moves them; members (r, c, cosine)."""
    unit = _UNITS.replace("u AS (SELECT r, v, sqrt(list_dot_product(v, v)) AS n FROM ok)", "w AS (SELECT r, min(v) AS v FROM ok GROUP BY r), u AS MATERIALIZED (SELECT r, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM w)")
    lab = "lab AS (SELECT DISTINCT _ref AS r, meta_labels AS label FROM cluster_master_labels WHERE _ref IS NOT NULL AND meta_labels IS NOT NULL)"
    parts, source = [unit, lab], "(SELECT r, label AS c FROM lab)"
    for i in range(steps):
        parts.append(f"s{i} AS (SELECT c, ix, sum(v[ix]) AS x FROM {source} JOIN u USING (r), range(1, 65) g(ix) GROUP BY c, ix), l{i} AS (SELECT c, sqrt(sum(x * x)) AS n FROM s{i} GROUP BY c), m{i} AS MATERIALIZED (SELECT c, list(x / n ORDER BY ix) AS m FROM s{i} JOIN l{i} USING (c) GROUP BY c)")
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, c, cosine FROM (SELECT r, c, list_dot_product(v, m) AS cosine, row_number() OVER (PARTITION BY r ORDER BY list_dot_product(v, m) DESC) AS k FROM u, m{i}) WHERE k = 1 AND cosine >= 0.55)")
        source = f"a{i}"
    parts.append(f"members AS (SELECT {source}.r, c, cosine, label FROM {source} LEFT JOIN lab ON lab.r = {source}.r)")
    parts.append("votes AS (SELECT c, label, count(*) AS n FROM members WHERE label IS NOT NULL GROUP BY c, label), rgt AS (SELECT c, arg_max(label, n * 1000 - label) AS best FROM votes GROUP BY c)")
    return ", ".join(parts)


_LINKED = """ends AS (SELECT a AS rep, b AS other FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT DISTINCT rep, rep AS low FROM members UNION SELECT ends.other, reach.low FROM reach JOIN ends ON ends.rep = reach.rep),
grp AS (SELECT rep, min(low) AS group_id FROM reach GROUP BY rep),
lnk AS (SELECT rep, count(*) AS n FROM ends GROUP BY rep)
SELECT id AS _ref, rep AS class_id, coalesce(n, 0)::BIGINT AS n_links, group_id FROM members JOIN grp USING (rep) LEFT JOIN lnk USING (rep)"""


def _part(seen: str, row: str, column: str) -> str:
    return f"CASE WHEN {seen} > 0 THEN {seen} * ln({seen} * total / (({row}) * ({column}))) ELSE 0.0 END"


def oracle_sql() -> dict[str, str]:
    g = " + ".join([_part("c", "length", "occ"), _part("(occ - c)", "total - length", "occ"), _part("(length - c)", "length", "total - occ"), _part("(total - length - (occ - c))", "total - length", "total - occ")])
    similar = _UNITS.replace("WITH ok", "WITH RECURSIVE ok") + """, members AS (SELECT r AS id, min(r) OVER (PARTITION BY f) AS rep FROM (SELECT r, list_transform(v, lambda x: (x / n)::FLOAT) AS f FROM u)),
c AS (SELECT DISTINCT u.* FROM u JOIN members ON rep = r), pairs AS (SELECT a.r AS a, b.r AS b FROM c a JOIN c b ON a.r < b.r AND list_dot_product(a.v, b.v) >= 0.97 * a.n * b.n)"""
    return {
        "p1_found": _ALIKE + " SELECT DISTINCT a.field, least(a._ref, b._ref) AS ref_a, greatest(a._ref, b._ref) AS ref_b FROM f a JOIN f b ON a.field = b.field AND a.form = b.form AND a.raw <> b.raw AND a._ref < b._ref",
        "p1_groups": _ALIKE + ", v AS (SELECT field, form, raw, count(*) AS n, min(_ref) AS low FROM f GROUP BY ALL), g AS (SELECT field, form, sum(n) AS total, min(low) AS class_id FROM v GROUP BY ALL) SELECT f.field, _ref, class_id, (total - n)::BIGINT AS n_links FROM f JOIN v ON f.field = v.field AND f.form = v.form AND f.raw = v.raw JOIN g ON f.field = g.field AND f.form = g.form",
        "p2_found": _NEAR + " SELECT a.id AS ref_a, b.id AS ref_b FROM members a JOIN members b ON a.rep = b.rep AND a.id < b.id UNION SELECT least(x.id, y.id), greatest(x.id, y.id) FROM pairs JOIN members x ON x.rep = a JOIN members y ON y.rep = b",
        "p2_groups": _NEAR + ", " + _LINKED,
        "p6_found": _lloyd() + " SELECT DISTINCT r AS _ref, best AS cluster_id FROM members JOIN rgt USING (c) WHERE label <> best",
        "p6_clusters": _lloyd() + """, once AS (SELECT DISTINCT c, r, cosine FROM members), near AS (SELECT c, list(r ORDER BY k) AS typical FROM (SELECT c, r, row_number() OVER (PARTITION BY c ORDER BY cosine DESC, r) AS k FROM once) WHERE k <= 5 GROUP BY c),
sz AS (SELECT c, count(*) AS size, round(avg(cosine), 3) + 0.0 AS mean_cosine FROM once GROUP BY c), st AS (SELECT label, count(*) AS n FROM (SELECT DISTINCT r, label FROM members WHERE label IS NOT NULL) GROUP BY label), ds AS (SELECT cluster_id, sum(counts)::BIGINT AS n FROM cluster_desc GROUP BY cluster_id)
SELECT best AS cluster_id, size, mean_cosine, typical, st.n AS stored_members, ds.n AS stored_counts FROM sz JOIN near USING (c) LEFT JOIN rgt USING (c) LEFT JOIN st ON st.label = best LEFT JOIN ds ON ds.cluster_id = best""",
        "p7_groups": similar + ", " + _LINKED,
        "p7_neighbours": _UNITS.replace("SELECT DISTINCT _ref AS r, v::DOUBLE[] AS v FROM", "SELECT _ref AS r, min(v::DOUBLE[]) AS v FROM").replace("len(list_filter(v, lambda x: x <> 0)) > 0)", "len(list_filter(v, lambda x: x <> 0)) > 0 GROUP BY _ref)")
        + " SELECT _ref, rank::INTEGER AS rank, near, round(round(cosine, 7), 3) + 0.0 AS cosine FROM (SELECT a.r AS _ref, b.r AS near, list_dot_product(a.v, b.v) / (a.n * b.n) AS cosine, row_number() OVER (PARTITION BY a.r ORDER BY round(list_dot_product(a.v, b.v) / (a.n * b.n), 7) DESC, b.r) AS rank FROM u a JOIN u b ON a.r % 50 = 0 AND a.r <> b.r) WHERE rank <= 10",
        "p9_found": _LEAKED + " SELECT doc_id, item_id FROM leaked",
        "p9_report": _LEAKED + " SELECT item_id, count(*) AS documents, sum(runs)::BIGINT AS runs FROM leaked GROUP BY item_id",
        "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL",
        "p7_found": _UNITS + " SELECT a.r AS ref_a, b.r AS ref_b FROM u a JOIN u b ON a.r < b.r AND list_dot_product(a.v, b.v) >= 0.97 * a.n * b.n",
        "p3_found": f"WITH {_RECORDS} SELECT _ref, word FROM tc JOIN wc USING (word), nn WHERE c * ln(n / (d + 1.0)) >= {CHARACTERISTIC} * ln(n)",
        "p3_scores": f"WITH {_RECORDS} SELECT _ref, word, c, d, round(CASE WHEN c * total < occ * length THEN -1 ELSE 1 END * 2 * ({g}), 4) + 0.0 AS score, round(c * ln(n / (d + 1.0)), 4) + 0.0 AS weight FROM tc JOIN wc USING (word) JOIN ln USING (_ref), nn",
        "p4_found": f"WITH {_RECORDS}, {_STORED} SELECT word, 'rare' AS mark FROM marked WHERE rare UNION ALL SELECT word, 'common' FROM marked WHERE common UNION ALL SELECT word, 'miscounted' FROM marked WHERE wrong",
        "p4_terms": f"WITH {_RECORDS}, {_STORED} SELECT word, occ, recs, stored, concat_ws(',', CASE WHEN rare THEN 'rare' END, CASE WHEN common THEN 'common' END, CASE WHEN wrong THEN 'miscounted' END) AS marks FROM marked",
    }
