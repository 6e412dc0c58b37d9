"""Learned operators: formula classifier, triplet vectors on a sphere, clustering quality."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import IDF, HashingTF, IndexToString, NGram, Normalizer, PCA, StringIndexer, VectorAssembler, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import latex
from .retrieval import dot, normalised


def training_set(rows: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Valid, reviewed, distinct examples: label, formula, context."""
    label = F.lower(F.trim("label"))
    kept = rows.where(label.isin(*labels) & (F.coalesce(F.col("needs_review"), F.lit(0)) == 0) & (F.trim("formula") != ""))
    return kept.select(label.alias("label"), F.trim("formula").alias("formula"), F.coalesce("context", F.lit("")).alias("context")).dropDuplicates(["label", "formula", "context"])


def with_features(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.split(F.col("formula"), "").alias("chars"), *[c.cast("double").alias(f"f_{n}") for n, c in latex.structural_features(F.col("formula"), F.col("context")).items()])


def train_formula_classifier(examples: DataFrame, seed: int = 42) -> PipelineModel:
    """Structural figures and character n-grams (hashed, weighted, reduced) into a random forest."""
    data = with_features(examples)
    figures = [c for c in data.columns if c.startswith("f_")]
    stages = [StringIndexer(inputCol="label", outputCol="y")]
    grams = []
    for n in (2, 3):
        stages += [NGram(n=n, inputCol="chars", outputCol=f"g{n}"), HashingTF(numFeatures=512, inputCol=f"g{n}", outputCol=f"t{n}"), IDF(inputCol=f"t{n}", outputCol=f"i{n}"), PCA(k=16, inputCol=f"i{n}", outputCol=f"p{n}")]
        grams.append(f"p{n}")
    stages += [VectorAssembler(inputCols=[*figures, *grams], outputCol="features"), RandomForestClassifier(labelCol="y", featuresCol="features", numTrees=40, maxDepth=8, seed=seed)]
    model = Pipeline(stages=stages).fit(data)
    back = IndexToString(inputCol="prediction", outputCol="predicted", labels=model.stages[0].labels)
    return PipelineModel(stages=[*model.stages[1:], back])


def classify_formulas(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """predicted, confidence."""
    out = model.transform(with_features(rows))
    return out.select(*rows.columns, "predicted", F.array_max(vector_to_array("probability")).alias("confidence"))


def macro_f1(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """label, precision, recall, f1 for every label of either side."""
    pairs = df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    by_t = pairs.groupBy(F.col(truth).alias("label")).agg(F.sum("n").alias("t"), F.sum(F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)).alias("h"))
    by_p = pairs.groupBy(F.col(predicted).alias("label")).agg(F.sum("n").alias("p"))
    j = by_t.join(by_p, "label", "full")
    p, r = F.coalesce(F.col("h") / F.col("p"), F.lit(0.0)), F.coalesce(F.col("h") / F.col("t"), F.lit(0.0))
    return j.select("label", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def propose_labels(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Unlabelled rows with the label of the longest known formula that starts them. Candidates meet on their first 4 characters."""
    a = rows.withColumn("_k", F.left("formula", F.lit(4)))
    b = known.select(F.col("formula").alias("_f"), F.col("label").alias("proposed"), F.left("formula", F.lit(4)).alias("_k"))
    hits = a.join(b, "_k", "left").withColumn("_ok", F.col("formula").startswith(F.col("_f")))
    best = hits.where("_ok").groupBy("formula").agg(F.max_by("proposed", F.struct(F.char_length("_f"), "_f")).alias("proposed"))
    return rows.join(best, "formula", "left")


# Triplets.


def dependency_triplets(tokens: DataFrame) -> DataFrame:
    """Subject, predicate, object of each verb. tokens: sent_id, id, head, deprel, upos, lemma."""
    verbs = tokens.where(F.col("upos").isin("VERB", "AUX")).select("sent_id", F.col("id").alias("head"), F.col("lemma").alias("predicate"))
    arm = lambda rels, name: tokens.where(F.col("deprel").isin(*rels)).select("sent_id", "head", F.col("lemma").alias(name), F.col("id").alias(f"{name}_id"))
    return verbs.join(arm(("nsubj", "nsubj:pass", "csubj"), "subject"), ["sent_id", "head"]).join(arm(("obj", "iobj", "obl", "xcomp", "ccomp"), "object"), ["sent_id", "head"]).select("sent_id", "subject", "predicate", "object").distinct()


def concept_filter(triplets: DataFrame, concepts: DataFrame) -> DataFrame:
    """Triplets whose subject or object is a key concept (lemma)."""
    c = concepts.select("lemma").distinct()
    return triplets.join(c, triplets.subject == c.lemma, "left_semi").unionByName(triplets.join(c, triplets.object == c.lemma, "left_semi")).distinct()


def keyword_groups(keywords: DataFrame) -> DataFrame:
    """lemma, score (largest), forms."""
    return keywords.groupBy("lemma").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("form")).alias("forms"))


def word_vectors(sentences: DataFrame, size: int = 40, window: int = 3, epochs: int = 10, seed: int = 1) -> DataFrame:
    """word, vector from a skip-gram model. sentences: words array."""
    return Word2Vec(vectorSize=size, windowSize=window, maxIter=epochs, minCount=1, seed=seed, inputCol="words", outputCol="v").fit(sentences).getVectors().select("word", vector_to_array("vector").alias("vector"))


def mean_vectors(items: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """key, vector: the mean of the vectors of each item's words. items: key, words."""
    seen = items.select(key, F.explode("words").alias("word")).join(vectors, "word").select(key, F.posexplode("vector").alias("i", "x"))
    means = seen.groupBy(key, "i").agg(F.avg("x").alias("x"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("vector"))


def reduce_dimensions(df: DataFrame, k: int) -> DataFrame:
    d = df.withColumn("_v", array_to_vector("vector"))
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(d).transform(d).withColumn("vector", vector_to_array("_p")).drop("_v", "_p")


def on_sphere(df: DataFrame) -> DataFrame:
    """Vectors at distance 1 from the origin; a zero vector stays."""
    return df.withColumn("vector", normalised(F.col("vector")))


def pair_distances(df: DataFrame, key: str) -> DataFrame:
    """a < b with cosine, angular and Euclidean distance. For a stated, small set of items: the caller bounds it."""
    x, y = df.select(F.col(key).alias("a"), F.col("vector").alias("va")), df.select(F.col(key).alias("b"), F.col("vector").alias("vb"))
    pairs = x.join(y, F.col("a") < F.col("b"))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(normalised(F.col("va")), normalised(F.col("vb")))))
    euclid = F.sqrt(F.aggregate(F.zip_with("va", "vb", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    return pairs.select("a", "b", cosine.alias("cosine"), F.acos(cosine).alias("angle"), euclid.alias("euclidean"))


def sphere_info(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg("angle").alias("mean_angle"), F.min("angle").alias("min_angle"), F.max("angle").alias("max_angle"), F.avg("cosine").alias("mean_cosine"))


def spherical_clusters(df: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """cluster and centre per row, by k-means under the cosine distance."""
    d = Normalizer(inputCol="_v", outputCol="_n").transform(df.withColumn("_v", array_to_vector("vector")))
    return KMeans(k=k, seed=seed, distanceMeasure="cosine", featuresCol="_n", predictionCol="cluster").fit(d).transform(d)


def silhouette(clustered: DataFrame) -> float:
    return ClusteringEvaluator(featuresCol="_n", predictionCol="cluster", distanceMeasure="cosine").evaluate(clustered)


def representatives(df: DataFrame, cluster: str, key: str, n: int = 5) -> DataFrame:
    """The n rows of each cluster nearest to its mean vector."""
    x = df.select(cluster, F.posexplode("vector").alias("i", "x")).groupBy(cluster, "i").agg(F.avg("x").alias("x"))
    centres = x.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("centre"))
    near: Column = dot(normalised(F.col("vector")), normalised(F.col("centre")))
    w = Window.partitionBy(cluster).orderBy(F.desc("cosine"), key)
    return df.join(centres, cluster).withColumn("cosine", near).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("centre")
