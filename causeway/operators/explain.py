"""Why alerts stand together, which nearly did, and how an incident compares with what is known: the offline view's figures.

Figures over all pairs of a cluster come without making pairs: the mean gap from the order of times, the mean cosine from
the sum of vectors; only pairs that are near by wording and time are made, as links are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text_links

#: How far an alert may be to be told as nearly inside, and how many are.
NEARLY, TOLD = 1.6, 4


def explanation(alerts: DataFrame, labels: DataFrame, links: DataFrame) -> DataFrame:
    """(label, n, time_proximity, template_similarity, service_affinity, cohesion, confidence_pct) of clusters of two or more
    alerts(id, ts, service, text); labels(id, label), links: near(alerts) pairs. The four are shares: how far the mean gap is
    from six minutes, the mean cosine, the most frequent service's share, the share of pairs that are links."""
    own = alerts.join(labels, "id").select("label", "id", "ts", "service", "text")
    n = F.col("n")
    k = F.row_number().over(Window.partitionBy("label").orderBy("ts", "id"))
    size = F.count("*").over(Window.partitionBy("label"))
    # of n sorted times the k-th is added k - 1 times and taken off n - k times; times count from the cluster's first
    first = F.min("ts").over(Window.partitionBy("label"))
    placed = own.select("label", (2 * k - size - 1).alias("times"), (F.col("ts") - first).cast("decimal(38,0)").alias("at"))
    gaps = placed.groupBy("label").agg(F.sum(F.col("times") * F.col("at")).cast("double").alias("gaps"), F.count("*").alias("n"))
    texts = alerts.groupBy("text").agg(F.min("id").alias("t"), F.count("*").alias("n"))
    weights = text_links.weighted(texts.select(F.col("t").alias("id"), "text"), text_links.fitted(texts.select(F.col("t").alias("id"), "text", "n")), "id")
    told = own.join(texts.select("text", F.col("t")), "text").groupBy("label", "t").agg(F.count("*").alias("many"))
    each = told.join(weights, F.col("t") == F.col("id")).select("label", "t", "many", "term", "w")
    total = each.groupBy("label", "term").agg(F.sum(F.col("many") * F.col("w")).alias("w")).groupBy("label").agg(F.sum(F.col("w") * F.col("w")).alias("square"))
    alone = each.select("label", "t", "many").distinct().groupBy("label").agg(F.sum("many").alias("with_terms"))
    service = own.where("service is not null").groupBy("label", "service").agg(F.count("*").alias("c")).groupBy("label").agg(
        F.max("c").alias("most"), F.sum("c").alias("named"))
    one, two = labels.select(F.col("id").alias("a"), "label"), labels.select(F.col("id").alias("b"), F.col("label").alias("other"))
    inside = links.join(one, "a").join(two, "b").where("label = other").groupBy("label").agg(F.count("*").alias("close"))
    out = gaps.where(n > 1).join(total, "label", "left").join(alone, "label", "left").join(service, "label", "left").join(inside, "label", "left")
    pairs = n * (n - 1) / 2
    two_places = lambda c: F.round(F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0)) + 1e-9, 2)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    cosine = (zero(F.col("square")) - zero(F.col("with_terms"))) / (n * (n - 1))
    out = out.select(
        "label", "n", two_places(1 - F.col("gaps") / pairs / 6e7 / text_links.MINUTES).alias("time_proximity"), two_places(cosine).alias("template_similarity"),
        two_places(zero(F.try_divide("most", "named"))).alias("service_affinity"), two_places(zero(F.col("close") / pairs)).alias("cohesion"))
    mean = (F.col("time_proximity") + F.col("template_similarity") + F.col("service_affinity") + F.col("cohesion")) * 25
    return out.withColumn("confidence_pct", F.bround(F.round(mean, 6)).cast("int"))


def nearly(alerts: DataFrame, labels: DataFrame, most: int = TOLD, limit: float = NEARLY) -> DataFrame:
    """(label, id, distance, place): of the alerts in no cluster the `most` nearest to each cluster, by their nearest member,
    at most `limit` away; of equal ones the smaller id."""
    close = text_links.near(alerts, limit).select("a", "b", "distance")
    both = close.union(close.select("b", "a", "distance")).toDF("id", "member", "distance")
    outside = both.join(labels.select("id"), "id", "left_anti")
    best = outside.join(labels.select(F.col("id").alias("member"), "label"), "member").groupBy("label", "id").agg(F.min("distance").alias("distance"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("distance", "id"))
    return best.withColumn("place", place).where(F.col("place") <= most)


def confidence_graph(members: DataFrame, roots: DataFrame, matches: DataFrame) -> DataFrame:
    """(label, service, is_root, confidence): how sure each service of members(label, service, ts, sev_rank) is the cause: 0.35
    first to fail, 0.25 severity, 0.25 being the root, 0.15 a known incident (matches(label)), in percent; a root has 70 to 99,
    another 18 to 72."""
    own = members.groupBy("label", "service").agg(F.min("ts").alias("first"), F.min("sev_rank").alias("sev"))
    out = own.withColumn("start", F.min("first").over(Window.partitionBy("label"))).join(roots.select("label", "root"), "label").join(
        matches.select("label", F.lit(True).alias("match")).distinct(), "label", "left")
    root = F.col("service") == F.col("root")
    early = F.when(F.col("first") == F.col("start"), 100).otherwise(45)
    severe = F.when(F.col("sev") == 0, 100).when(F.col("sev") == 1, 75).otherwise(50)
    fan, known = F.when(root, 100).otherwise(40), F.when(root & F.col("match").isNotNull(), 90).otherwise(50)
    # in hundredths of percent, so that halves are halves
    pct = F.floor((35 * early + 25 * severe + 25 * fan + 15 * known + 50) / 100)
    sure = F.when(root, F.least(F.lit(99), F.greatest(F.lit(70), pct))).otherwise(F.least(F.lit(72), F.greatest(F.lit(18), pct)))
    return out.select("label", "service", root.alias("is_root"), sure.cast("int").alias("confidence"))


def compared(members: DataFrame, matches: DataFrame, history: DataFrame) -> DataFrame:
    """(label, item, symptom_pct, overlap_pct, services): each incident beside the known one it matches: matches(label, item,
    similarity), history(item, service). overlap_pct is the share of the incident's services that the known one had; services
    match where both had the same, are partial where they share some, else different."""
    now = members.select("label", "service").where("service is not null").distinct()
    then = history.select("item", "service").distinct()
    pair = matches.select("label", "item", "similarity")
    a = pair.join(now, "label").groupBy("label", "item").agg(F.count("*").alias("now"))
    b = then.groupBy("item").agg(F.count("*").alias("then"))
    both = pair.join(now, "label").join(then, ["item", "service"]).groupBy("label", "item").agg(F.count("*").alias("both"))
    out = pair.join(a, ["label", "item"], "left").join(b, "item", "left").join(both, ["label", "item"], "left").fillna(0, ["now", "then", "both"])
    kind = F.when((F.col("now") > 0) & (F.col("both") == F.col("now")) & (F.col("both") == F.col("then")), "match").when(F.col("both") > 0, "partial").otherwise("different")
    pct = F.bround(100 * F.col("both") / F.greatest("now", F.lit(1))).cast("int")
    return out.select("label", "item", F.bround(100 * F.col("similarity")).cast("int").alias("symptom_pct"), pct.alias("overlap_pct"), kind.alias("services"))
