"""TF-IDF vectors as rows, cosines by joins on the term, and greedy article clusters."""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import words
from .ordered import walked


def tfidf(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, weight: count over the document's distinct terms, times one plus the log of documents over documents with the term."""
    terms = docs.select(key, F.explode(words.tokens(F.col(text))).alias("term"))
    tf = terms.groupBy(key, "term").agg(F.count("*").alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    size = tf.groupBy(key).agg(F.count("*").alias("size"))
    n = docs.count()
    return tf.join(df, "term").join(size, key).select(key, "term", (F.col("n") / F.col("size") * (1 + F.log(F.lit(float(n)) / F.col("df")))).alias("weight"))


def cosine_to(vectors: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """Query key q, key, cosine of each query vector with all vectors that share a term; both as term rows. The queries are a stated set, not the table itself."""
    norm = vectors.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    qn = queries.groupBy("q").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("qnorm"))
    dots = queries.select("q", "term", F.col("weight").alias("w")).join(vectors, "term").groupBy("q", key).agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    return dots.join(norm, key).join(qn, "q").select("q", key, (F.col("dot") / (F.col("norm") * F.col("qnorm"))).alias("cosine"))


def centroids(vectors: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """cluster, term, weight: mean vectors."""
    size = members.groupBy("cluster").agg(F.count("*").alias("n"))
    return vectors.join(members, key).groupBy("cluster", "term").agg(F.sum("weight").alias("w")).join(size, "cluster").select("cluster", "term", (F.col("w") / F.col("n")).alias("weight"))


def labels(members: DataFrame, text: str, top: int = 3) -> DataFrame:
    """cluster, label: its most frequent words of over three letters."""
    counts = members.select("cluster", F.explode(words.tokens(F.col(text))).alias("w")).where(F.length("w") > 3).groupBy("cluster", "w").agg(F.count("*").alias("n"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "w")))
    return counts.groupBy("cluster").agg(F.array_join(F.transform(F.slice(order, 1, top), lambda x: x.w), " ").alias("label"))


def cluster_intent(members: DataFrame) -> DataFrame:
    """cluster, intent_signal: three hosts or more are research, a page seen twice is reference, the rest browsing."""
    seen = members.groupBy("cluster", "url", "domain").agg(F.count("*").alias("n"))
    out = seen.groupBy("cluster").agg(F.count_distinct("domain").alias("hosts"), F.max("n").alias("most"))
    return out.select("cluster", F.when(F.col("hosts") >= 3, "research").when(F.col("most") > 1, "reference").otherwise("browsing").alias("intent_signal"))


def greedy(visits: DataFrame, keys: list[str], gap_minutes: int, similarity: float) -> DataFrame:
    """keys, seq, cluster (from 0): in order of time, a visit joins the first cluster whose last visit is near enough and whose mean vector is similar enough, else opens one.

    Each step depends on the one before, so a group (a user and day) is folded together; all groups of a partition in one call. The mean vectors are kept as sums, found by their terms; a cluster that time has left behind is
    never looked at again, so a visit costs what it shares with the clusters of the last minutes."""
    if similarity <= 0:
        raise ValueError("clusters are found by the terms that they share: the similarity must be above 0")
    gap = gap_minutes * 60_000_000

    def cluster(members: list[tuple]) -> list[int]:
        docs = [Counter(x) for _, _, x in members]
        df = Counter(chain.from_iterable(docs))
        idf = {t: 1 + np.log(len(docs) / n) for t, n in df.items()}
        sums: list[dict[str, float]] = []
        last: list[int] = []
        norms: list[float] = []
        holders: dict[str, dict[int, None]] = {}  # of each term the clusters that have it
        out = []
        for us, d in zip([float("nan") if us is None else us for us, _, _ in members], docs, strict=True):
            v = {t: d[t] / len(d) * idf[t] for t in sorted(d)}
            size = np.sqrt(sum(x * x for x in v.values()))
            near = set()
            for t in v:
                have = holders.get(t, {})
                left = [i for i in have if us - last[i] > gap]
                for i in left:
                    del have[i]
                near.update(have)
            for i in sorted(near):
                dot = sum(x * sums[i].get(t, 0.0) for t, x in v.items())
                norm = size * norms[i]
                if (dot / norm if norm else 0.0) >= similarity:
                    break
            else:
                i = len(sums)
                sums.append({})
                last.append(us)
                norms.append(0.0)
            last[i] = us
            for t, x in v.items():
                sums[i][t] = sums[i].get(t, 0.0) + x
                holders.setdefault(t, {})[i] = None
            norms[i] = np.sqrt(sum(x * x for x in sums[i].values()))
            out.append(i)
        return out

    return walked(visits, keys, ["us", "seq"], "terms", lambda: cluster, [*keys, "seq"], "cluster")
