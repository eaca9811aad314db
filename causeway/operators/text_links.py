"""Alerts that say alike things at about the same time, and the known incident that a cluster is most like.

Texts are weighted by TF-IDF over words and pairs of neighbouring words, and kept as sorted arrays of (term, weight). No
join goes over raw terms where it can be avoided:

* near(): the distance of two alerts is 1 - cosine + 2 min(minutes / 6, 1)^2. Which texts come near each other in time is
  looked up first, by slots of the widest gap that any cosine can bridge; a cosine is formed once for each such pair of
  different texts, however often they repeat; then alerts meet by (text, slot) only where both texts are told near that
  slot and their cosine allows the gap.
* Library.best(): the library's terms are few, so a text's other terms are dropped where they are read, before anything is
  grouped; cosines are sums over the terms that a cluster and an item share. A library of at most SMALL rows is broadcast,
  so that its most frequent terms meet no single task.

Defined cases: null and empty texts have no terms, and no cosine with any other; alerts of the same time are linked whatever
they say, as their distance is at most 1; equal alerts are told apart by id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written

EPS, MINUTES, PENALTY, LEAST = 1.0, 6.0, 2.0, 0.25
#: A library of at most so many (item, term) is broadcast (about 10 MB).
SMALL = 200_000


def _words(text: Column, stop: tuple[str, ...] = ()) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)
    return F.filter(words, lambda w: ~w.isin(*stop)) if stop else words


def _with_pairs(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
                       lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, pairs)


def terms(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Lower-case words of two or more characters without stop words, and pairs of neighbours among them."""
    return _with_pairs(_words(text, stop))


def listed(texts: DataFrame, *key: str, stop: tuple[str, ...] = ()) -> DataFrame:
    """(*key, term) of texts(*key, text), repeats too; a text's words are found once."""
    return texts.select(*key, _words(F.col("text"), stop).alias("words")).select(*key, F.explode(_with_pairs(F.col("words"))).alias("term"))


def counted(texts: DataFrame, *key: str, stop: tuple[str, ...] = ()) -> DataFrame:
    """(*key, term, tf) of texts(*key, text)."""
    return listed(texts, *key, stop=stop).groupBy(*key, "term").agg(F.count("*").alias("tf"))


def fitted(texts: DataFrame, stop: tuple[str, ...] = ()) -> DataFrame:
    """(term, idf) over texts(id, text, n), each counting n times: ln((1 + texts) / (1 + texts with the term)) + 1."""
    total = texts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("texts"))  # one row
    df = counted(texts, "id", "n", stop=stop).groupBy("term").agg(F.sum("n").alias("df"))
    return df.join(F.broadcast(total), F.lit(True)).select("term", (F.log((1 + F.col("texts")) / (1 + F.col("df"))) + 1).alias("idf"))


def weighted(texts: DataFrame, idf: DataFrame, *key: str, stop: tuple[str, ...] = ()) -> DataFrame:
    """(*key, term, w) of texts(*key, text), each text's weights of length 1; terms that aren't in idf are left out."""
    w = counted(texts, *key, stop=stop).join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    return _of_length_1(w, *key)


def _of_length_1(w: DataFrame, *key: str) -> DataFrame:
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*key)))
    return w.select(*key, "term", (F.col("w") / norm).alias("w"))


def vectors(weights: DataFrame, key: str) -> DataFrame:
    """(key, terms, ws): each one's terms in order and their weights."""
    rows = weights.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("v"))
    return rows.select(key, F.col("v.term").alias("terms"), F.col("v.w").alias("ws"))


def dot(terms_a: Column, ws_a: Column, terms_b: Column, ws_b: Column) -> Column:
    """Inner product of two sparse vectors, in the order of a's terms."""
    b = F.map_from_arrays(terms_b, ws_b)
    products = F.zip_with(terms_a, ws_a, lambda t, w: w * F.coalesce(F.try_element_at(b, t), F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def penalty(minutes: Column) -> Column:
    return PENALTY * F.pow(F.least(minutes / MINUTES, F.lit(1.0)), F.lit(2.0))


def near(alerts: DataFrame, eps: float = EPS, stop: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, semantic, time, distance) of the pairs of alerts(id, ts, text) with a < b whose distance is at most eps (at
    most PENALTY, so that far alerts never are), in nine decimals."""
    if not 0 < eps < PENALTY:
        raise ValueError("eps must lie between 0 and the time penalty")
    widest = math.ceil(MINUTES * math.sqrt(eps / PENALTY) * 6e7)
    slot = F.floor(F.col("ts") / widest)
    whole = alerts.where("id is not null and ts is not null").withColumn("text", F.coalesce("text", F.lit("")))
    texts = whole.groupBy("text").agg(F.min("id").alias("t"), F.count("*").alias("n"))
    told = written(whole.join(texts.select("text", "t"), "text").select("id", "ts", "t", slot.alias("slot")), "told")
    own = texts.select(F.col("t").alias("id"), "text", "n")
    v = vectors(weighted(own.select("id", "text"), fitted(own, stop), "id", stop=stop), "id")
    seen = told.select("t", "slot").distinct()
    step = seen.select(F.col("t").alias("u"), F.explode(F.array("slot", F.col("slot") + 1)).alias("slot"))
    met = seen.join(step, "slot").select(F.least("t", "u").alias("t"), F.greatest("t", "u").alias("u")).distinct()
    side = lambda c: v.select(F.col("id").alias(c), F.col("terms").alias(f"{c}_terms"), F.col("ws").alias(f"{c}_ws"))
    product = dot(*[F.col(x) for x in ("t_terms", "t_ws", "u_terms", "u_ws")])
    met = written(met, "met-texts")
    cosine = met.where("t <> u").join(side("t"), "t").join(side("u"), "u").select("t", "u", F.round(product, 9).alias("cosine"))
    # a text with itself: 1, or 0 without terms
    cosine = cosine.union(v.select("id", "id", F.lit(1.0)))
    if eps > 1:  # even texts without a common word are near for a while
        everyone = met.join(cosine.select("t", "u"), ["t", "u"], "left_anti").select("t", "u", F.lit(0.0))
        cosine = cosine.union(everyone)
    else:
        cosine = cosine.where("cosine > 0")
    cosine = written(cosine.union(cosine.where("t <> u").select("u", "t", "cosine").toDF("t", "u", "cosine")), "cosines")
    room = F.greatest(F.col("cosine") - (1 - eps), F.lit(0.0))
    reach = F.ceil(MINUTES * F.sqrt(room / PENALTY) * 6e7) + 1
    # which texts meet in which slots, with their cosine; an alert is not spread over all texts that are like its own
    there = seen.select("t", "slot", F.explode(F.array(*[F.col("slot") + k for k in (-1, 0, 1)])).alias("u_slot")).join(seen.toDF("u", "u_slot"), "u_slot")
    there = there.join(cosine, ["t", "u"]).withColumn("reach", reach)
    a = told.select(F.col("id").alias("a"), F.col("ts").alias("a_ts"), "t", "slot")
    b = told.select(F.col("id").alias("b"), F.col("ts").alias("b_ts"), F.col("t").alias("u"), F.col("slot").alias("u_slot"))
    close = there.join(a, ["t", "slot"]).join(b, ["u", "u_slot"]).where("a < b").where(F.abs(F.col("a_ts") - F.col("b_ts")) <= F.col("reach"))
    out = close.select("a", "b", "cosine", (F.abs(F.col("a_ts") - F.col("b_ts")) / 6e7).alias("gap"))
    if eps == 1:  # at one time even without a common word
        same = told.select(F.col("id").alias("a"), "ts", F.col("t").alias("t")).join(told.select(F.col("id").alias("b"), "ts", F.col("t").alias("u")), "ts")
        same = same.where("a < b").join(cosine.select("t", "u"), ["t", "u"], "left_anti")
        out = out.union(same.select("a", "b", F.lit(0.0), F.lit(0.0)))
    out = out.select("a", "b", F.round(1 - F.col("cosine"), 9).alias("semantic"), F.round(penalty(F.col("gap")), 9).alias("time"))
    distance = F.round(F.greatest(F.col("semantic") + F.col("time"), F.lit(0.0)), 9)
    return out.withColumn("distance", distance).where(F.col("distance") <= eps)


def centroids(weights: DataFrame, key: str) -> DataFrame:
    """(key, term, w): the sum of the vectors of weights(key, part, term, w), of length 1: their mean's direction."""
    return _of_length_1(weights.groupBy(key, "term").agg(F.sum("w").alias("w")), key)


class Library:
    """Known incidents(item, part, text), fitted once: the weights of terms by how many incidents have them, and the
    centroid of each incident's parts."""

    def __init__(self, incidents: DataFrame, stop: tuple[str, ...] = ()) -> None:
        self.stop = stop
        # neighbours across parts are no terms
        inside = counted(incidents, "item", "part", stop=stop).select("item", "term").distinct()
        n = incidents.agg(F.countDistinct("item").alias("items"))
        df = inside.groupBy("term").agg(F.count("*").alias("df"))
        self.idf = written(df.join(F.broadcast(n), F.lit(True)).select("term", (F.log((1 + F.col("items")) / (1 + F.col("df"))) + 1).alias("idf")), "idf")
        self.items = written(centroids(weighted(incidents, self.idf, "item", "part", stop=stop), "item"), "library")
        self.small = self.items.count() <= SMALL

    def best(self, alerts: DataFrame, least: float = LEAST) -> DataFrame:
        """(label, item, similarity) of alerts(label, part, text): for each cluster the item whose centroid is most like the
        cluster's, if by `least` or more; the smallest item on ties. Clusters without a match give no row."""
        near = F.broadcast if self.small else lambda df: df
        known = listed(alerts, "label", "part", stop=self.stop).join(near(self.idf), "term")
        # dealt by part once: counts and lengths of parts need no other order
        w = known.repartition("label", "part").groupBy("label", "part", "term").agg((F.count("*") * F.first("idf")).alias("w"))
        own = centroids(_of_length_1(w, "label", "part"), "label")
        both = own.join(near(self.items.withColumnRenamed("w", "item_w")), "term")
        like = both.groupBy("label", "item").agg(F.round(F.sum(F.col("w") * F.col("item_w")), 6).alias("similarity"))
        best = F.min(F.struct((-F.col("similarity")).alias("neg"), "item")).alias("m")
        return like.where(F.col("similarity") >= least).groupBy("label").agg(best).select("label", "m.item", (-F.col("m.neg")).alias("similarity"))
