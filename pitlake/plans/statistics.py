"""Queries of dependence statistics, p-value families and scored predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitlake.operators import stats as st
from pitlake.plans.registry import register
from pitlake.plans.views import monthly, r6, scores, with_views
from pitlake.session import table

P = ", pr AS (SELECT l.series AS a, r.series AS b, l.m, l.value AS x, r.value AS y FROM monthly l JOIN monthly r ON l.m = r.m AND l.series < r.series)"
COR = "CASE WHEN count(*) >= {k} AND stddev_pop({x}) * stddev_pop({y}) > 0 THEN round(greatest(-1, least(1, covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})))), 6) + 0.0 END"


def cor(x="x", y="y", k=3):
    return COR.format(x=x, y=y, k=k)


def sql(body: str) -> str:
    return with_views("monthly", "WITH z AS (SELECT 1)" + body)


def chosen(spark, sf):
    return st.pairs(monthly(spark, sf), ["m"])


SERIES = range(25)  # nation keys


@register("align_series", sql(" SELECT m, " + ", ".join(f"round(max(CASE WHEN series = {k} THEN value END), 2) AS s_{k}" for k in SERIES) + " FROM monthly GROUP BY m HAVING count(DISTINCT series) = 25"))
def align_series(spark, sf):
    """Months that all series share, one column each."""
    return st.align(monthly(spark, sf), list(SERIES), ["m"]).select("m", *[F.round(f"s_{k}", 2).alias(f"s_{k}") for k in SERIES])


@register("period_transform", sql(""" SELECT series, m, round(value - lag(value) OVER w, 2) + 0.0 AS change, CASE WHEN value > 0 AND lag(value) OVER w > 0 THEN
    round(ln(value / lag(value) OVER w), 6) + 0.0 END AS log_return FROM monthly WINDOW w AS (PARTITION BY series ORDER BY m)"""))
def period_transform(spark, sf):
    """Change and log return of each series."""
    m = monthly(spark, sf)
    a = st.transform(m, "change", ["m"]).select("series", "m", (F.round("value", 2) + F.lit(0.0)).alias("change"))
    return a.join(st.transform(m, "log_return", ["m"]).select("series", "m", r6("value").alias("log_return")), ["series", "m"])


@register("pair_correlations", sql(P + f""", rk AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2 AS rx, rank()
    OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2 AS ry FROM pr)
  SELECT a, b, count(*) AS n, {cor()} AS pearson, {cor('rx', 'ry')} AS spearman FROM rk GROUP BY a, b"""))
def pair_correlations(spark, sf):
    """Pearson and Spearman of every pair of series."""
    return st.pair_table(chosen(spark, sf)).select("a", "b", "n", r6("pearson").alias("pearson"), r6("spearman").alias("spearman"))


@register("lagged_xcorr", sql(P + f""", i AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY m) AS i FROM pr)
  SELECT l.a, l.b, CAST(k AS INTEGER) AS lag, count(*) AS n, {cor('l.x', 'r.y', 6)} AS pearson FROM i l CROSS JOIN range(-6, 7) AS g(k) JOIN i r ON l.a = r.a AND l.b =
    r.b AND l.i + k = r.i GROUP BY ALL"""))
def lagged_xcorr(spark, sf):
    """Correlation at lags of up to six months."""
    return st.lagged(chosen(spark, sf), ["m"], 6).select("a", "b", "lag", "n", r6("pearson").alias("pearson"))


@register("rolling_corr", sql(P + f""", i AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY m) AS i FROM pr), w AS (SELECT l.a, l.b, l.i AS "end", r.x, r.y
    FROM i l JOIN i r ON l.a = r.a AND l.b = r.b AND r.i BETWEEN l.i - 11 AND l.i WHERE l.i >= 12),
  rk AS (SELECT *, rank() OVER (PARTITION BY a, b, "end" ORDER BY x) + (count(*) OVER (PARTITION BY a, b, "end", x) - 1) / 2 AS rx, rank() OVER (PARTITION BY a, b, "end"
    ORDER BY y) + (count(*) OVER (PARTITION BY a, b, "end", y) - 1) / 2 AS ry FROM w)
  SELECT a, b, CAST("end" AS INTEGER) AS "end", {cor()} AS pearson, {cor('rx', 'ry')} AS spearman FROM rk GROUP BY ALL"""))
def rolling_corr(spark, sf):
    """Correlations over trailing windows of twelve months."""
    return st.rolling(chosen(spark, sf), ["m"], 12).select("a", "b", "end", r6("pearson").alias("pearson"), r6("spearman").alias("spearman"))


@register("ew_corr", sql(P + """, w AS (SELECT *, pow(0.9, row_number() OVER (PARTITION BY a, b ORDER BY m DESC) - 1) AS w FROM pr), c AS (SELECT *, sum(w * x) OVER p
    / sum(w) OVER p AS mx, sum(w * y) OVER p / sum(w) OVER p AS my FROM w WINDOW p AS (PARTITION BY a, b))
  SELECT a, b, round(sum(w * (x - mx) * (y - my)) / sqrt(sum(w * (x - mx) * (x - mx)) * sum(w * (y - my) * (y - my))), 6) + 0.0 AS ew_correlation FROM c GROUP BY a, b"""))
def ew_corr(spark, sf):
    """Correlation with exponentially falling weights."""
    return st.exponential(chosen(spark, sf), ["m"], 0.1).select("a", "b", r6("ew_correlation").alias("ew_correlation"))


@register("distance_corr", sql(P + """, i AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY x, y) AS i FROM pr), g AS (SELECT l.a, l.b, l.i, r.i AS j,
    abs(l.x - r.x) AS p, abs(l.y - r.y) AS q FROM i l JOIN i r ON l.a = r.a AND l.b = r.b),
  c AS (SELECT a, b, p - avg(p) OVER (PARTITION BY a, b, i) - avg(p) OVER (PARTITION BY a, b, j) + avg(p) OVER (PARTITION BY a, b) AS cp, q - avg(q) OVER (PARTITION BY a,
    b, i) - avg(q) OVER (PARTITION BY a, b, j) + avg(q) OVER (PARTITION BY a, b) AS cq FROM g)
  SELECT a, b, round(least(1, sqrt(greatest(0, sum(cp * cq) / sqrt(sum(cp * cp) * sum(cq * cq))))), 6) AS distance_correlation FROM c GROUP BY a, b"""))
def distance_corr(spark, sf):
    """Distance correlation of every pair."""
    return st.distance_correlation(chosen(spark, sf)).select("a", "b", r6("distance_correlation").alias("distance_correlation"))


@register("shift_null", sql(P + """, i AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY m) - 1 AS i, count(*) OVER (PARTITION BY a, b) AS n FROM pr), t AS
    (SELECT l.a, l.b, k AS shift, abs(covar_pop(l.x, r.y) / (stddev_pop(l.x) * stddev_pop(r.y))) AS r FROM i l CROSS JOIN LATERAL (SELECT unnest(range(l.n)) AS k) JOIN i
    r ON l.a = r.a AND l.b = r.b AND r.i = (l.i + k) % l.n WHERE l.n BETWEEN 20 AND 400 GROUP BY ALL),
  s AS (SELECT *, max(CASE WHEN shift = 0 THEN r END) OVER (PARTITION BY a, b) AS own FROM t) SELECT a, b, round(max(own), 6) AS statistic, count(*) AS shifts,
    round(count(*) FILTER (WHERE r >= own - 1e-14) / count(*), 6) AS p_value, 'completed' AS state FROM s GROUP BY a, b"""))
def shift_null(spark, sf):
    """Correlation against all rotations of one side."""
    return st.shift_null(chosen(spark, sf), ["m"]).select("a", "b", r6("statistic").alias("statistic"), "shifts", r6("p_value").alias("p_value"), "state")


def family(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (((F.col("p_partkey") * 7919) % 10007) / 10007).alias("p"))


FAM = "f AS (SELECT p_partkey AS id, (p_partkey * 7919 % 10007) / 10007 AS p FROM part), k AS (SELECT *, row_number() OVER (ORDER BY p, id) AS r, count(*) OVER () AS n FROM f)"


@register("bh_adjust", f"WITH {FAM} SELECT id, round(least(1, min(p * n / r) OVER (ORDER BY p DESC, id DESC)), 6) AS adjusted FROM k")
def bh_adjust(spark, sf):
    """Benjamini-Hochberg over a family of p-values."""
    return st.adjust(family(spark, sf), "BH", "id").select("id", r6("adjusted").alias("adjusted"))


@register("by_adjust", f"WITH {FAM}, h AS (SELECT sum(1.0::DOUBLE / r) AS c FROM k) SELECT id, round(least(1, min(p * n * c / r) OVER (ORDER BY p DESC, id DESC)), 6) AS adjusted FROM k, h")
def by_adjust(spark, sf):
    """Benjamini-Yekutieli over the same family."""
    return st.adjust(family(spark, sf), "BY", "id").select("id", r6("adjusted").alias("adjusted"))


COMPONENTS = 64  # of a vector
#: Centred products of all pairs of components by unnest; the shrinkage from traces and norms of the matrix.
LW = f"""WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), mu AS (SELECT i, avg(x) AS m
    FROM e GROUP BY i),
  z AS (SELECT e.vec_id, e.i, x - m AS z FROM e JOIN mu USING (i)), n AS (SELECT count(*) AS n FROM embeddings), s AS (SELECT a.i, b.i AS j, sum(a.z * b.z) / max(n) AS s
    FROM z a JOIN z b USING (vec_id), n GROUP BY ALL),
  f AS (SELECT avg(q * q) AS f FROM (SELECT vec_id, sum(z * z) AS q FROM z GROUP BY 1)), t AS (SELECT sum(CASE WHEN i = j THEN s END) / {COMPONENTS} AS tr, sum(s * s) AS
    ns FROM s),
  h AS (SELECT tr, least(greatest((f - ns) / ({COMPONENTS} * n), 0), (ns - {COMPONENTS} * tr * tr) / {COMPONENTS}) / ((ns - {COMPONENTS} * tr * tr) / {COMPONENTS}) AS h
    FROM t, f, n)
  SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round((1 - h) * s + CASE WHEN i = j THEN h * tr ELSE 0 END, 6) + 0.0 AS covariance, round(h, 6) AS shrinkage
    FROM s, h"""


@register("ledoit_wolf", LW)
def ledoit_wolf(spark, sf):
    """Shrunk covariance of all components of all vectors."""
    e = table(spark, sf, "embeddings").select(*[F.col("embedding")[k].cast("double").alias(f"x{k}") for k in range(COMPONENTS)])
    return st.ledoit_wolf(e, [f"x{k}" for k in range(COMPONENTS)]).select("i", "j", r6("covariance").alias("covariance"), r6("shrinkage").alias("shrinkage"))


@register("partial_correlations")
def partial_correlations(spark, sf):
    """Partial correlations of all components from the inverse; a test holds it against numpy."""
    e = table(spark, sf, "embeddings").select(*[F.col("embedding")[k].cast("double").alias(f"x{k}") for k in range(COMPONENTS)])
    return st.ledoit_wolf(e, [f"x{k}" for k in range(COMPONENTS)]).select("i", "j", r6("partial").alias("partial"))


@register("block_bootstrap", with_views("monthly", """WITH g AS (SELECT row_number() OVER (ORDER BY m) - 1 AS i, gain FROM (SELECT m, CAST(sum(CAST(value AS
    DECIMAL(20, 2))) AS DOUBLE) AS gain FROM monthly GROUP BY m)), n AS (SELECT count(*) AS n FROM g),
  d AS (SELECT rep, CAST('0x' || substr(md5(rep || '-' || k), 1, 8) AS BIGINT) % (n - 2) + o AS i FROM n, range(0, 200) AS a(rep), range(0, 100) AS b(k), range(0, 3) AS
    c(o) WHERE k * 3 + o < n),
  r AS (SELECT rep, avg(gain) AS m FROM d JOIN g USING (i) GROUP BY 1), q AS (SELECT m, row_number() OVER (ORDER BY m, rep) - 1 AS k FROM r)
  SELECT round((SELECT avg(gain) FROM g), 2) AS mean, round(max(CASE WHEN k = 5 THEN m END), 2) AS low, round(max(CASE WHEN k = 195 THEN m END), 2) AS high FROM q"""))
def block_bootstrap(spark, sf):
    """Moving-block interval of the mean monthly total; block starts from a hash, so that SQL can draw the same."""
    from pyspark.sql import Window

    rows = monthly(spark, sf).groupBy("m").agg(F.sum(F.col("value").cast("decimal(20,2)")).cast("double").alias("gain"))
    g = rows.select((F.row_number().over(Window.orderBy("m")) - 1).alias("i"), "gain")  # one row a month
    n = g.count()
    draws = spark.range(200).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-n // 3) - 1)))).alias("k"))
    starts = draws.withColumn("start", F.conv(F.substring(F.md5(F.concat_ws("-", "rep", "k")), 1, 8), 16, 10).cast("long") % (n - 2))
    return st.block_interval(g, starts, n, 3, 200).select(*[F.round(c, 2).alias(c) for c in ("mean", "low", "high")])


AP = "g AS (SELECT {k}p, sum(label) AS tp, count(*) AS n FROM {t} GROUP BY ALL), c AS (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM g WINDOW w AS ({part}ORDER BY p DESC))"


@register("pr_auc", with_views("scores", "WITH " + AP.format(k="part, ", t="scores", part="PARTITION BY part ") + " SELECT part, CAST(sum(n) AS BIGINT) AS rows, CASE WHEN sum(tp) > 0 THEN round(sum(tp * ctp / cn) / sum(tp), 6) END AS pr_auc FROM c GROUP BY part"))
def pr_auc(spark, sf):
    """Average precision by language."""
    return st.average_precision(scores(spark, sf), ["part"]).select("part", "rows", r6("pr_auc").alias("pr_auc"))


@register("brier_ece", with_views("scores", """WITH b AS (SELECT part, least(9, CAST(floor(p * 10) AS INTEGER)) AS bin, count(*) AS n, avg(label) AS rate, avg(p) AS
    mp FROM scores GROUP BY ALL), e AS (SELECT part, sum(n * abs(rate - mp)) / sum(n) AS ece FROM b GROUP BY 1) SELECT s.part, round(avg((label - p) * (label - p)), 6) AS
    brier, round(max(ece), 6) AS ece FROM scores s JOIN e ON s.part = e.part GROUP BY 1"""))
def brier_ece(spark, sf):
    """Brier score and calibration error by language."""
    s = scores(spark, sf)
    return s.groupBy("part").agg(r6(st.brier(F.col("label"), F.col("p"))).alias("brier")).join(st.calibration_error(s, ["part"]), "part").select("part", "brier", r6("ece").alias("ece"))


@register("scorecard", with_views("scores", """WITH y AS (SELECT *, id % 37 - 15.5 AS value, id * 1000 AS t FROM scores), x AS (SELECT 0 AS overall, part, p, label,
    value, t FROM y UNION ALL SELECT 1, NULL, p, label, value, t FROM y), g AS (SELECT overall, part, p, sum(label) AS tp, count(*) AS n FROM x GROUP BY ALL), c AS
    (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM g WINDOW w AS (PARTITION BY overall, part ORDER BY p DESC)),
  a AS (SELECT overall, part, CASE WHEN sum(tp) > 0 THEN sum(tp * ctp / cn) / sum(tp) END AS pr FROM c GROUP BY ALL), b AS (SELECT overall, part, least(9, CAST(floor(p *
    10) AS INTEGER)) AS bin, count(*) AS n, avg(label) AS rate, avg(p) AS mp FROM x GROUP BY ALL), e AS (SELECT overall, part, sum(n * abs(rate - mp)) / sum(n) AS ece
    FROM b GROUP BY ALL)
  SELECT x.overall, x.part, count(*) AS rows, round(avg((label - p) * (label - p)), 6) AS brier, round(max(pr), 6) AS pr_auc, round(max(ece), 6) AS ece, round(avg(label),
    6) AS positive_rate, round(avg(CAST(p < 0.3 AS INTEGER)), 6) AS quote_rate, min(t) AS first, max(t) AS last, round(avg(value), 6) + 0.0 AS baseline, round(sum(CASE
    WHEN p < 0.3 THEN value END) / count(*), 6) + 0.0 AS policy, round(-sum(CASE WHEN p >= 0.3 THEN value ELSE 0 END) / count(*), 6) + 0.0 AS lift FROM x JOIN a ON
    x.overall = a.overall AND x.part IS NOT DISTINCT FROM a.part JOIN e ON x.overall = e.overall AND x.part IS NOT DISTINCT FROM e.part GROUP BY 1, 2"""))
def scorecard(spark, sf):
    """The model's scorecard by language and overall."""
    rows = scores(spark, sf).withColumn("value", F.col("id") % 37 - 15.5).withColumn("t", F.col("id") * 1000)
    return st.scorecard(rows, "part", 0.3).select("overall", "part", "rows", "first", "last", *[r6(c).alias(c) for c in ("brier", "pr_auc", "ece", "positive_rate", "quote_rate", "baseline", "policy", "lift")])


@register("calibrate", with_views("scores", """SELECT id, round(CASE WHEN p <= 0.1 THEN 0.05 WHEN p <= 0.5 THEN 0.05 + (p - 0.1) * ((0.4 - 0.05) / (0.5 - 0.1)) WHEN p
    <= 0.9 THEN 0.4 + (p - 0.5) * ((0.95 - 0.4) / (0.9 - 0.5)) ELSE 0.95 END, 6) AS calibrated, CASE WHEN p <= 0.1 THEN 0.05 WHEN p <= 0.5 THEN 0.05 + (p - 0.1) * ((0.4 -
    0.05) / (0.5 - 0.1)) WHEN p <= 0.9 THEN 0.4 + (p - 0.5) * ((0.95 - 0.4) / (0.9 - 0.5)) ELSE 0.95 END < 0.3 AS quote FROM scores"""))
def calibrate(spark, sf):
    """isotonic calibration and the quote decision."""
    c = st.isotonic(F.col("p"), [(0.1, 0.05), (0.5, 0.4), (0.9, 0.95)])
    return scores(spark, sf).select("id", r6(c).alias("calibrated"), st.quote_below(c, 0.3).alias("quote"))


@register("nearest_rank", """WITH v AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
    SELECT min(v) AS min, max(CASE WHEN i = n // 2 THEN v END) AS p50, max(CASE WHEN i = CAST(floor((n - 1) * 0.95) AS BIGINT) THEN v END) AS p95, max(v) AS max, max(CASE
    WHEN i = floor((n - 1) * 0.5 + 0.5) THEN v END) AS r50, max(CASE WHEN i = floor((n - 1) * 0.95 + 0.5) THEN v END) AS r95, max(CASE WHEN i = floor((n - 1) * 0.99 +
    0.5) THEN v END) AS r99 FROM v""")
def nearest_rank(spark, sf):
    """Quantiles by position, with a distributed order."""
    return st.nearest_rank(table(spark, sf, "orders"), "o_totalprice", [F.col("o_totalprice"), F.col("o_orderkey")], F.floor(F.col("o_totalprice") / 1000))


@register("batch_scoring", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(1 / (1 + exp(-(0.5 * l_discount - 0.1 * l_tax + 0.01 * l_quantity))), 6) AS probability FROM lineitem")
def batch_scoring(spark, sf):
    """A predictor applied to batches of feature vectors."""
    rows = table(spark, sf, "lineitem")

    def load():
        import numpy as np

        return lambda x: 1 / (1 + np.exp(-(x @ np.array([0.5, -0.1, 0.01]))))

    out = st.batch_score(rows, ["l_discount", "l_tax", "l_quantity"], load)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6("probability").alias("probability"))
