"""Queries over embeddings. Queries are every row whose id is divisible by 20, against all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import knn as K
from .common import table

TOP = 10
BASE = "q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv, label AS ql FROM embeddings WHERE vec_id % 20 = 0), c AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS cv, label AS cl FROM embeddings)"
INT8 = "list_transform({v}, lambda x: CAST(trunc(least(greatest((x + 1.0) / (2.0 / 255.0) - 128.0, -128.0), 127.0)) AS DOUBLE))"
BITS = "list_transform({v}, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)"


def _sides(spark, d):
    corpus = table(spark, d, "embeddings")
    return corpus.filter(F.col("vec_id") % 20 == 0), corpus


def knn(metric, most=None):
    return lambda spark, d: K.knn(*_sides(spark, d), TOP, metric, most=most)


def top_sql(distance: str, where: str = "TRUE", name: str = "", k: int = TOP) -> str:
    """CTEs d and found: the nearest rows by a distance expression over qv and cv."""
    return f"""d{name} AS (SELECT query_id, id, round({distance}, 6) + 0.0 AS distance, cl FROM q, c WHERE {where}),
    found{name} AS (SELECT query_id, rank, id, distance, cl FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d{name}) WHERE rank <= {k})"""


def knn_sql(distance: str, after: str = "") -> str:
    return f"WITH {BASE}, {top_sql(distance)} SELECT query_id, rank, id, distance FROM found {after}"


def knn_ties(spark, d):
    """Many equal distances, of signs only, in the order of a store of chunks."""
    return K.knn(*_sides(spark, d), TOP, "hamming", ties="chunk")


def knn_filtered(spark, d):
    """Only rows of label 3 are candidates: the filter reaches the scan, before any distance."""
    queries, corpus = _sides(spark, d)
    return K.knn(queries, corpus.filter("label = 3"), TOP, "cosine")


def knn_int8_rerank(spark, d):
    queries, corpus = _sides(spark, d)
    return K.rerank(K.knn(queries, corpus, 3 * TOP, "int8"), queries, corpus, TOP)


def knn_label_vote(spark, d):
    queries, corpus = _sides(spark, d)
    return K.label_vote(K.knn(queries, corpus, TOP), corpus.select(F.col("vec_id").alias("id"), "label"))


def recall_at_k(spark, d):
    queries, corpus = _sides(spark, d)
    return K.recall(K.knn(queries, corpus, TOP, "int8"), K.knn(queries, corpus, TOP))


def hit_rate_at_k(spark, d):
    """Gold are all other rows with the query's label; queries without gold count as misses in the second rate, and not at all in the first.

    Hits are looked up from what was found, so no pairs of a label are made."""
    queries, corpus = _sides(spark, d)
    labels = corpus.select(F.col("vec_id").alias("id"), "label")
    n = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")).join(n.withColumnRenamed("label", "ql"), "ql").withColumn("has_gold", F.col("n") > 1)
    found = K.knn(queries, corpus, TOP).join(labels, "id").join(q.select("query_id", "ql"), "query_id").filter("label = ql and query_id != id")
    return K.hit_rates(q.select("query_id", "has_gold"), found.groupBy("query_id").agg(F.min("rank").alias("rank")), (1, 3, 5, 10))


def knn_between(spark, d):
    """Ranges, inequality and a list on the rows' columns: the filter reaches the scan."""
    queries, corpus = _sides(spark, d)
    return K.knn(queries, corpus.filter("label >= 2 and label < 8 and label != 5 and label in (2, 3, 4, 5, 7, 9)"), TOP)


def knn_rowids(spark, d):
    """Only rows whose id another table lists, here the documents in English."""
    docs = table(spark, d, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("vec_id"))
    return K.within(*_sides(spark, d), docs, TOP)


def knn_farther(spark, d):
    """Distance predicates of all kinds after the search: > 0.2 and < 0.9."""
    return knn("cosine")(spark, d).filter("distance > 0.2 and distance < 0.9")


def _probes(spark, d, lists=32):
    queries, corpus = _sides(spark, d)
    return K.build_index(corpus, lists), queries, corpus


def knn_ann(spark, d):
    """Approximate neighbours by inverted lists, with the recall against exact search kept: whether it is at least 0.9, and that each query has ten."""
    index, queries, corpus = _probes(spark, d)
    found = K.search_index(index, queries, TOP)
    recall = K.recall(found, K.knn(queries, corpus, TOP)).select((F.col("recall") >= 0.9).alias("good"), "n")
    sizes = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("k")).groupBy().agg(F.count(F.lit(1)).alias("queries"), F.min("k").alias("least"))
    return recall.crossJoin(sizes)  # one row each


def ann_neighbours(spark, d):
    """With every list probed the index is exact."""
    index, queries, _ = _probes(spark, d)
    return K.search_index(index, queries, TOP, probes=32)


def recall_curve(spark, d):
    """Recall never falls as more lists are probed, and reaches 1 with all of them."""
    index, queries, corpus = _probes(spark, d)
    exact = K.knn(queries, corpus, TOP)
    out = None
    for probes in (1, 4, 32):
        one = K.recall(K.search_index(index, queries, TOP, probes), exact).select(F.lit(probes).alias("probes"), "recall")
        out = one if out is None else out.unionByName(one)
    from pyspark.sql import Window

    before = F.lag("recall").over(Window.orderBy("probes"))  # three rows
    return out.select("probes", (F.col("recall") >= F.coalesce(before, F.lit(0.0))).alias("grows"), (F.col("recall") == 1.0).alias("whole")).select("probes", "grows", ((F.col("probes") < 32) | F.col("whole")).alias("ends"))


def vec_construct(spark, d):
    """Vectors from JSON text and back, as int8 and as bits from hex; their types and lengths."""
    e = table(spark, d, "embeddings").select("vec_id", F.to_json("embedding").alias("text"), F.transform(F.slice("embedding", 1, 4), lambda x: F.floor(x * 100)).alias("whole"))
    v = V.from_text(F.col("text"))
    b = V.bits(F.lower(F.hex(F.concat(F.lit("k"), F.col("vec_id").cast("string")))))
    return e.select(
        "vec_id", F.size(v).alias("length"), V.kind(v, "float").alias("type"), (V.to_text(v) == F.col("text")).alias("same"), F.array_join(V.int8(F.col("whole")).cast("array<string>"), ",").alias("int8"),
        V.kind(V.int8(F.col("whole")), "tinyint").alias("type8"), F.array_join(b.cast("array<string>"), ",").alias("bits"), V.from_text(F.lit("[1, x]")).isNull().alias("bad"),
    )


def vec_slice_bits(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", V.quantize_binary(F.col("embedding")).alias("w"))
    return e.select("vec_id", F.aggregate(V.slice_bits(F.col("w"), 8, 40), F.lit(0), lambda s, x: s + F.bit_count(x)).cast("bigint").alias("positive"), F.get(V.slice_bits(F.col("w"), 56, 64), F.lit(0)).alias("last"))


def vec_half(spark, d):
    """All elements in float16's rounding; the distance to what they were is at most 2**-11 of each."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.select("vec_id", F.posexplode(F.arrays_zip("v", V.half(F.col("v")).alias("h"))).alias("pos", "z")).select("vec_id", "pos", (F.abs(F.col("z.v") - F.col("z.h")) <= F.abs("z.v") / 2048 + 2.0**-25).alias("near"), (F.col("z.h") * 2.0**24 == F.rint(F.col("z.h") * 2.0**24)).alias("grid"))


def vec_upsert(spark, d):
    """Insert, update, delete and update again of rows by id, in the order of a sequence column."""
    from ..sources.files import upsert

    e = table(spark, d, "embeddings").select("vec_id", "label")
    changes = e.filter("label < 3").select("vec_id", (F.col("label") + 100).alias("label"), F.lit(1).alias("seq"), F.lit(False).alias("_deleted"))
    changes = changes.unionByName(e.filter("label < 2").select("vec_id", "label", F.lit(2).alias("seq"), (F.col("label") == 0).alias("_deleted")))
    changes = changes.unionByName(e.filter("label = 9").select((F.col("vec_id") + 10**6).alias("vec_id"), "label", F.lit(1).alias("seq"), F.lit(False).alias("_deleted")))
    return upsert(e, changes, "vec_id", "seq")


def vec_arith(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    both = e.withColumn("w", F.reverse("v"))
    v, w = F.col("v"), F.col("w")
    r = lambda c: F.round(c, 6) + 0.0
    return both.select(
        "vec_id",
        F.size("v").alias("n"),
        r(V.dot(v, w)).alias("dot"),
        r(V.l2(v, w)).alias("l2"),
        r(V.l2_squared(v, w)).alias("l2_squared"),
        r(V.l1(v, w)).alias("l1"),
        r(V.cosine_distance(v, w)).alias("cosine"),
        r(V.norm(V.normalize(v))).alias("unit"),
    )


def vec_add_sub(spark, d):
    """Every element of the sum and the difference."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    both = e.select("vec_id", F.posexplode(F.arrays_zip(V.add(F.col("v"), F.reverse("v")).alias("a"), V.sub(F.col("v"), F.reverse("v")).alias("s"))).alias("pos", "z"))
    return both.select("vec_id", "pos", (F.round("z.a", 6) + 0.0).alias("a"), (F.round("z.s", 6) + 0.0).alias("s"))


def vec_slice(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.posexplode(V.slice_of(F.col("embedding").cast("array<double>"), 8, 12)).alias("pos", "x")).select("vec_id", "pos", F.round("x", 6).alias("x"))


def vec_each(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x")).select("vec_id", "pos", "x")


def vec_quantize(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    bits = V.quantize_binary(F.col("v"))
    return e.select("vec_id", F.array_join(V.quantize_int8(F.col("v")).cast("array<string>"), ",").alias("int8"), F.aggregate(bits, F.lit(0), lambda s, x: s + F.bit_count(x)).cast("bigint").alias("positive"))


def vec_hamming(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.select("vec_id", V.hamming(V.quantize_binary(F.col("v")), V.quantize_binary(F.reverse("v"))).cast("bigint").alias("bits"))


def vec_normalize(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 3.0).alias("v"))
    return e.select("vec_id", F.posexplode(V.normalize(F.col("v"))).alias("pos", "x")).select("vec_id", "pos", (F.round("x", 6) + 0.0).alias("x"))


def knn_assessment(spark, d):
    """A word for each query from the share of its neighbours that have its own label."""
    queries, corpus = _sides(spark, d)
    q = queries.select(F.col("vec_id").alias("query_id"), "label")
    own = knn_label_vote(spark, d).join(q, ["query_id", "label"])
    return own.select("query_id", "percent", F.when(F.col("percent") >= 67, "strong").when(F.col("percent") >= 33, "weak").otherwise("none").alias("match"))


def semantic_search(spark, d):
    """Neighbours hydrated from the documents of the same id; ids without a document are left out."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source")
    return K.knn(*_sides(spark, d), TOP).join(docs, "id").select("query_id", "rank", "id", "source")


def vec_point(spark, d):
    """Lookup of listed ids: an IN filter that the scan gets."""
    return table(spark, d, "embeddings").filter(F.col("vec_id").isin(0, 7, 40, 10**9)).select("vec_id", "label")


COS = "1.0 - list_dot_product(qv, cv) / (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(cv, cv)))"
COS8 = "1.0 - list_dot_product(a8, b8) / (sqrt(list_dot_product(a8, a8)) * sqrt(list_dot_product(b8, b8)))"
#: float16's rounding as in the engine's scalar: 11 significant bits.
HALF = "list_transform({v}, lambda x: CASE WHEN x = 0 THEN 0.0 ELSE round_even(x / greatest(pow(2.0, floor(log2(abs(x))) - 10), pow(2.0, -24)), 0) * greatest(pow(2.0, floor(log2(abs(x))) - 10), pow(2.0, -24)) END)"
COS16 = f"1.0 - list_dot_product({HALF.format(v='qv')}, {HALF.format(v='cv')}) / (sqrt(list_dot_product({HALF.format(v='qv')}, {HALF.format(v='qv')})) * sqrt(list_dot_product({HALF.format(v='cv')}, {HALF.format(v='cv')})))"
BASE8 = f"q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv, {INT8.format(v='CAST(embedding AS DOUBLE[])')} AS a8 FROM embeddings WHERE vec_id % 20 = 0), c AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS cv, {INT8.format(v='CAST(embedding AS DOUBLE[])')} AS b8, label AS cl FROM embeddings)"
V0 = "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, list_reverse(CAST(embedding AS DOUBLE[])) AS w FROM embeddings)"

QUERIES = {
    "knn_cosine": (knn("cosine"), knn_sql(COS)),
    "knn_l2": (knn("l2"), knn_sql("list_distance(qv, cv)")),
    "knn_l1": (knn("l1"), knn_sql("list_sum(list_transform(list_zip(qv, cv), lambda z: abs(z[1] - z[2])))")),
    "knn_ip": (knn("ip"), knn_sql("-list_dot_product(qv, cv)")),
    "knn_hamming": (knn("hamming"), f"WITH {BASE}, qb AS (SELECT *, {BITS.format(v='qv')} AS qq FROM q), cb AS (SELECT *, {BITS.format(v='cv')} AS cc FROM c), d AS (SELECT query_id, id, CAST(list_sum(list_transform(list_zip(qq, cc), lambda z: abs(z[1] - z[2]))) AS DOUBLE) AS distance FROM qb, cb) SELECT query_id, rank, id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d) WHERE rank <= {TOP}"),
    "knn_ties": (
        knn_ties,
        f"WITH {BASE}, qb AS (SELECT *, {BITS.format(v='qv')} AS qq FROM q), cb AS (SELECT *, {BITS.format(v='cv')} AS cc FROM c), d AS (SELECT query_id, id, CAST(list_sum(list_transform(list_zip(qq, cc), lambda z: abs(z[1] - z[2]))) AS DOUBLE) AS distance FROM qb, cb) SELECT query_id, rank, id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id // 1024, id DESC) AS rank FROM d) WHERE rank <= {TOP}",
    ),
    "knn_distance_range": (knn("cosine", most=0.35), knn_sql(COS, "WHERE distance <= 0.35")),
    "knn_filtered": (knn_filtered, f"WITH {BASE}, {top_sql(COS, 'cl = 3')} SELECT query_id, rank, id, distance FROM found"),
    "knn_int8": (knn("int8"), f"WITH {BASE8}, {top_sql(COS8)} SELECT query_id, rank, id, distance FROM found"),
    "knn_int8_rerank": (
        knn_int8_rerank,
        f"WITH {BASE8}, {top_sql(COS8, k=3 * TOP)}, e AS (SELECT f.query_id, f.id, round({COS}, 6) + 0.0 AS distance FROM found f JOIN q USING (query_id) JOIN c ON c.id = f.id) SELECT query_id, rank, id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM e) WHERE rank <= {TOP}",
    ),
    "knn_label_vote": (knn_label_vote, f"WITH {BASE}, {top_sql(COS)} SELECT query_id, cl AS label, CAST(100 * count(*) // {TOP} AS BIGINT) AS percent FROM found GROUP BY 1, 2"),
    "recall_at_k": (recall_at_k, f"WITH {BASE8}, {top_sql(COS8)}, {top_sql(COS, name='t')} SELECT round(CAST(count(f.id) AS DOUBLE) / count(*), 6) AS recall, count(*) AS n FROM foundt t LEFT JOIN found f ON f.query_id = t.query_id AND f.id = t.id"),
    "hit_rate_at_k": (
        hit_rate_at_k,
        f"""WITH {BASE}, {top_sql(COS)}, n AS (SELECT cl, count(*) AS n FROM c GROUP BY 1), g AS (SELECT q.query_id, any_value(n.n) > 1 AS has, min(f.rank) FILTER (WHERE f.cl = ql AND f.id <> q.query_id) AS rank FROM q JOIN n ON n.cl = ql LEFT JOIN found f ON f.query_id = q.query_id GROUP BY 1)
        SELECT CAST(k AS INTEGER) AS k, round(avg(CASE WHEN rank <= k THEN 1 ELSE 0 END) FILTER (WHERE has), 6) AS hit_rate, round(sum(CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END) / count(*), 6) AS of_all FROM g, (VALUES (1), (3), (5), (10)) t(k) GROUP BY 1""",
    ),
    "vec_arith": (
        vec_arith,
        f"""{V0} SELECT vec_id, CAST(len(v) AS INTEGER) AS n, round(list_dot_product(v, w), 6) + 0.0 AS dot, round(list_distance(v, w), 6) + 0.0 AS l2, round(list_distance(v, w) * list_distance(v, w), 6) + 0.0 AS l2_squared,
        round(list_sum(list_transform(list_zip(v, w), lambda z: abs(z[1] - z[2]))), 6) + 0.0 AS l1, round(1 - list_cosine_similarity(v, w), 6) + 0.0 AS cosine, 1.0 AS unit FROM e""",
    ),
    "vec_add_sub": (vec_add_sub, f"{V0} SELECT vec_id, CAST(p AS INTEGER) AS pos, round(v[p + 1] + w[p + 1], 6) + 0.0 AS a, round(v[p + 1] - w[p + 1], 6) + 0.0 AS s FROM e, range(64) t(p)"),
    "knn_between": (knn_between, f"WITH {BASE}, {top_sql(COS, 'cl IN (2, 3, 4, 7)')} SELECT query_id, rank, id, distance FROM found"),
    "knn_rowids": (knn_rowids, f"WITH {BASE}, {top_sql(COS, 'id IN (SELECT doc_id FROM documents WHERE lang = ' + chr(39) + 'en' + chr(39) + ')')} SELECT query_id, rank, id, distance FROM found"),
    "knn_farther": (knn_farther, knn_sql(COS, "WHERE distance > 0.2 AND distance < 0.9")),
    "knn_ann": (knn_ann, f"SELECT TRUE AS good, {TOP} * count(*) AS n, count(*) AS queries, CAST({TOP} AS BIGINT) AS least FROM embeddings WHERE vec_id % 20 = 0"),
    "ann_neighbours": (ann_neighbours, knn_sql(COS)),
    "recall_curve": (recall_curve, "SELECT CAST(p AS INTEGER) AS probes, TRUE AS grows, TRUE AS ends FROM (VALUES (1), (4), (32)) t(p)"),
    "vec_construct": (
        vec_construct,
        """SELECT vec_id, 64 AS length, 'float32' AS type, TRUE AS same, array_to_string(list_transform(embedding[1:4], lambda x: CAST(floor(CAST(x AS FLOAT) * CAST(100 AS FLOAT)) AS INTEGER)), ',') AS int8, 'int8' AS type8,
        array_to_string(list_transform(range(length('k' || vec_id)), lambda i: ord(substr('k' || vec_id, i + 1, 1))), ',') AS bits, TRUE AS bad FROM embeddings""",
    ),
    "vec_slice_bits": (
        vec_slice_bits,
        f"{V0} SELECT vec_id, CAST(list_sum({BITS.format(v='v[9:40]')}) AS BIGINT) AS positive, CAST(list_sum(list_transform(range(8), lambda i: CASE WHEN v[57 + i] > 0 THEN pow(2, i) ELSE 0 END)) AS BIGINT) AS last FROM e",
    ),
    "vec_half": (vec_half, "SELECT vec_id, CAST(p AS INTEGER) AS pos, TRUE AS near, TRUE AS grid FROM embeddings, range(64) t(p)"),
    "vec_upsert": (vec_upsert, "SELECT vec_id, CASE WHEN label = 2 THEN 102 ELSE label END AS label FROM embeddings WHERE label <> 0 UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE label = 9"),
    "knn_f16": (knn("f16"), knn_sql(COS16)),
    "vec_slice": (vec_slice, f"{V0} SELECT vec_id, CAST(p AS INTEGER) AS pos, round(v[9 + p], 6) AS x FROM e, range(4) t(p)"),
    "vec_each": (vec_each, f"{V0} SELECT vec_id, CAST(p AS INTEGER) AS pos, v[p + 1] AS x FROM e, range(64) t(p)"),
    "vec_quantize": (vec_quantize, f"{V0} SELECT vec_id, array_to_string(list_transform({INT8.format(v='v')}, lambda x: CAST(x AS INTEGER)), ',') AS int8, CAST(list_sum({BITS.format(v='v')}) AS BIGINT) AS positive FROM e"),
    "vec_hamming": (vec_hamming, f"{V0} SELECT vec_id, CAST(list_sum(list_transform(list_zip({BITS.format(v='v')}, {BITS.format(v='w')}), lambda z: abs(z[1] - z[2]))) AS BIGINT) AS bits FROM e"),
    "knn_l2_squared": (knn("l2_squared"), knn_sql("list_sum(list_transform(list_zip(qv, cv), lambda z: (z[1] - z[2]) * (z[1] - z[2])))")),
    "vec_normalize": (vec_normalize, f"{V0} SELECT vec_id, CAST(p AS INTEGER) AS pos, round(v[p + 1] / sqrt(list_dot_product(v, v)), 6) + 0.0 AS x FROM e, range(64) t(p)"),
    "knn_assessment": (
        knn_assessment,
        f"WITH {BASE}, {top_sql(COS)}, v AS (SELECT query_id, cl, CAST(100 * count(*) // {TOP} AS BIGINT) AS percent FROM found GROUP BY 1, 2) SELECT v.query_id, percent, CASE WHEN percent >= 67 THEN 'strong' WHEN percent >= 33 THEN 'weak' ELSE 'none' END AS match FROM v JOIN q ON q.query_id = v.query_id AND ql = cl",
    ),
    "semantic_search": (semantic_search, f"WITH {BASE}, {top_sql(COS)} SELECT query_id, rank, id, source FROM found JOIN documents ON doc_id = id"),
    "vec_point": (vec_point, "SELECT vec_id, label FROM embeddings WHERE vec_id IN (0, 7, 40, 1000000000)"),
}
