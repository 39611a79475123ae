"""The stages over folders: each reads the tables of earlier ones and writes its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators import analyze, counts, embedding, explain, importing, metacluster, parse, phrases, predict, reduce, scoring
from loomtext.plans.config import Config
from loomtext.plans.shared import materialize, small
from loomtext.sources import tables


def import_data(spark: SparkSession, sources: list[str], out: str, config: Config) -> None:
    raw = tables.read_sources(spark, sources).withColumn("_row", F.monotonically_increasing_id())
    corpus, originals = importing.import_corpus(raw, list(config.import_data.merge_columns), list(config.import_data.order), config.import_data.target)
    tables.save_tables({"corpus": corpus, "originals": originals.drop("_row")}, out)


def phrase(spark: SparkSession, out: str, config: Config) -> None:
    found = phrases.dedupe_abbreviations(phrases.abbreviation_pairs(spark.read.parquet(f"{out}/corpus"), config.import_data.target))
    tables.save_reports({"abbreviations": found}, out)


def parse_corpus(spark: SparkSession, out: str, config: Config) -> None:
    corpus = spark.read.parquet(f"{out}/corpus").withColumnRenamed(config.import_data.target, "text")
    p = config.parse
    known = {"replace_acronyms": spark.read.parquet(f"{out}/abbreviations")}
    if p.dictionary:
        known["replace_from_dictionary"] = tables.read_csv(spark, p.dictionary, ["phrase", "term"])
    options = {
        "separated_parenthesis": {"min_keep_length": p.min_keep_length}, "pos_tokenizer": {"blacklist": p.pos_blacklist},
        "replace_acronyms": {"prefix": p.acronym_prefix, "suffix": p.acronym_suffix}, "replace_from_dictionary": {"prefix": p.dictionary_prefix, "suffix": p.dictionary_suffix},
    }
    parsed = parse.parse_chain(corpus, p.functions, options=options, tables=known)
    tables.save_tables({"parsed": parsed}, out)


def embed(spark: SparkSession, out: str, config: Config) -> None:
    e = config.embed
    model = embedding.fit_embedding(spark.read.parquet(f"{out}/parsed"), "_ref", "text", e.size, e.window, e.min_count, e.epochs, e.skip_gram, e.hierarchical_softmax, e.negative, e.sample, e.seed, e.partitions or spark.sparkContext.defaultParallelism)
    tables.save_tables({"embedding": model}, out)


def score(spark: SparkSession, out: str, config: Config) -> None:
    docs = counts.document_tokens(spark.read.parquet(f"{out}/parsed"), "_ref")
    tables.save_tables({"tf": counts.term_frequency(docs), "tdf": counts.term_document_frequency(docs)}, out)
    vectors = scoring.score(docs, spark.read.parquet(f"{out}/embedding"), config.embed.size, config.score.methods, config.score.downsample_weights)
    if config.score.reduced:
        parts = []
        for m in config.score.methods:
            reduced, model = reduce.reduce_vectors(vectors.where(F.col("method") == m).select("_ref", "vec"), config.score.components)
            parts.append(reduced.withColumn("method", F.lit(m)))
            tables.save_tables({f"components_{m}": model}, out)
        vectors = parts[0]
        for p in parts[1:]:
            vectors = vectors.unionByName(p)
    tables.save_vectors(vectors, f"{out}/vectors")


def cluster(spark: SparkSession, out: str, config: Config) -> None:
    c = config.metacluster
    vectors = tables.load_vectors(spark, f"{out}/vectors", c.method)
    tables.save_tables(metacluster.metacluster(vectors, config.embed.size, c.m, c.kn, c.pcut, c.repeats, c.seed), out)


def report(spark: SparkSession, out: str, config: Config) -> None:
    held = tables.load_tables(spark, out, ["centroids", "labels", "embedding", "originals"])
    vectors = tables.load_vectors(spark, f"{out}/vectors", config.metacluster.method)
    a = config.analyze
    desc = analyze.cluster_desc(vectors, held["labels"], held["centroids"], held["embedding"], config.embed.size, a.compute_dispersion, a.topn)
    tables.save_reports({"cluster_desc": desc}, out)
    order = spark.read.parquet(f"{out}/cluster_desc").select("cluster_id", "dispersion_order")
    tables.save_reports({"cluster_master_labels": analyze.master_labels(held["originals"], held["labels"], order, list(a.master_columns))}, out)


def explain_clusters(spark: SparkSession, out: str, config: Config) -> None:
    """The words that tell every two close clusters apart."""
    e = config.explain
    held = tables.load_tables(spark, out, ["centroids", "labels", "embedding", "parsed"])
    pairs = materialize(explain.close_pairs(held["centroids"], e.closeness).select("i", "j"), "pairs")
    subset = materialize(explain.even_subset(explain.pair_members(held["labels"], pairs), e.texts, e.seed), "subset")
    members = counts.document_tokens(held["parsed"], "_ref").join(small(subset), "_ref")
    found = explain.explain_pairs(members, held["embedding"], config.embed.size, e.samples, e.features, e.trees, e.seed)
    tables.save_reports({"cluster_LIME": explain.normalise_scores(found)}, out)


def predict_column(spark: SparkSession, out: str, config: Config) -> None:
    p = config.predict
    originals = spark.read.parquet(f"{out}/originals")
    truth = predict.label_encode(originals.select("_ref", p.column), p.column).select("_ref", "y_truth")
    stored = {m: tables.load_vectors(spark, f"{out}/vectors", m, config.score.reduced) for m in p.methods}
    dim = config.score.components if config.score.reduced else config.embed.size
    done: dict[str, DataFrame] = {}
    for m, vectors in stored.items():
        over = (lambda t: predict.smote(t, dim)) if p.use_smote else None
        done[m] = materialize(predict.cross_validate(vectors.join(truth, "_ref"), lambda a, b: predict.forest_predict(a, b, p.trees), p.folds, over), "predicted")
    if p.use_meta:
        features = predict.meta_features(list(stored.values())).join(truth, "_ref")
        done["meta"] = materialize(predict.cross_validate(features, lambda a, b: predict.forest_predict(a, b, p.trees), p.folds), "predicted")
    table = predict.prediction_table(done, originals, list(p.extra_columns))
    tables.save_reports({f"{p.column}_prediction": table}, out)
    held = spark.read.parquet(f"{out}/{p.column}_prediction")
    tables.save_reports({f"{p.column}_disagreement": predict.disagreement(held, list(done))}, out)
    for m, found in done.items():
        tables.save_tables({f"{p.column}_probabilities_{m}": found}, out)


STAGES = {"phrase": phrase, "parse": parse_corpus, "embed": embed, "score": score, "metacluster": cluster, "analyze": report, "explain": explain_clusters, "predict": predict_column}
