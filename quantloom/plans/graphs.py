"""Graph, cluster, ledger, fold, survival, text and streaming plans, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.functions import symbols
from quantloom.operators import clustering, death, folds, graph, inference, ledger, panel, pca, portfolio, signals, walkforward
from quantloom.sources import readers
from quantloom.streaming import panels as streams

from . import data


def _pairs(spark, sf):
    """Correlations among vectors over their positions."""
    vectors = data.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("date", "x")).withColumn("r", F.round(F.col("x").cast("double"), 6))
    return graph.correlations(vectors).withColumn("corr", F.round("corr", 9))


def _edges(spark, sf):
    return graph.knn(_pairs(spark, sf), 5)


def _labels(spark, sf):
    return data.table(spark, sf, "embeddings").select(F.col("vec_id").alias("node"), "label")


def knn_signed_edges(spark, sf):
    return _edges(spark, sf).select("src", "dst", F.round("weight", 6).alias("weight"))


def signed_knn_split(spark, sf):
    return graph.signed_knn(_pairs(spark, sf), 3, 3).select("src", "dst", "layer", F.round("weight", 6).alias("weight"))


def rank_weighted_edges(spark, sf):
    return graph.rank_weighted(_edges(spark, sf)).select("src", "dst", F.round("weight", 6).alias("weight"))


def graph_diagnostics(spark, sf):
    out = graph.diagnostics(_edges(spark, sf))
    return out.select("n_nodes", *(F.round(c, 5).alias(c) for c in ("mean_degree", "min_degree", "max_degree")), "n_edges", "n_pos", "n_neg", F.round("negative_share", 6).alias("negative_share"))


def connected_components(spark, sf):
    strong = graph.both_ways(_pairs(spark, sf)).where(F.abs("weight") > 0.4)
    nodes = data.table(spark, sf, "embeddings").select(F.col("vec_id").alias("node"))
    return graph.components(strong.select("src", "dst"), nodes)


def signed_laplacian(spark, sf):
    return graph.signed_laplacian(_edges(spark, sf)).select("src", "dst", F.round("value", 6).alias("value"))


def cluster_quality(spark, sf):
    out = graph.cluster_quality(_edges(spark, sf), _labels(spark, sf))
    return out.select(*(F.round(c, 5).alias(c) for c in out.columns))


def balanced_cut(spark, sf):
    return graph.balanced_cut(_edges(spark, sf), _labels(spark, sf)).select("label", F.round("cut", 5).alias("cut"), F.round("volume", 5).alias("volume"), F.round("ratio", 6).alias("ratio"))


def cluster_cohesion_drop(spark, sf):
    return graph.cohesion(_pairs(spark, sf), _labels(spark, sf)).select("label", "members", F.round("cohesion", 7).alias("cohesion"), "dropped")


def ari_stability(spark, sf):
    other = data.table(spark, sf, "embeddings").select(F.col("vec_id").alias("node"), ((F.col("label") + F.col("vec_id") % 3) % 10).alias("label"))
    return graph.adjusted_rand(_labels(spark, sf), other).select("n", F.round("ari", 8).alias("ari"))


def _brand_edges(spark, sf):
    dense = data.dense_week(spark, sf).withColumn("fold", F.year("date"))
    x = dense.where("r IS NOT NULL").select("fold", "date", F.col("id").alias("a"), F.col("r").alias("x"))
    y = x.select("fold", "date", F.col("a").alias("b"), F.col("x").alias("y"))
    pairs = x.join(y, ["fold", "date"]).where("a <> b").groupBy("fold", "a", "b").agg(F.round(F.corr("x", "y"), 9).alias("weight"))
    return pairs.select("fold", F.col("a").alias("src"), F.col("b").alias("dst"), "weight")


def _labels_by(name):
    def plan(spark, sf):
        return clustering.cluster_folds(_brand_edges(spark, sf), name, 3)

    plan.__name__ = "labels_" + "".join(c if c.isalnum() else "_" for c in name.lower()).strip("_")
    return plan


def labels_signflip_k(spark, sf):
    return clustering.cluster_folds(_brand_edges(spark, sf), "SignedSpectral", None)


def market_mode_residuals(spark, sf):
    dense = data.dense_week(spark, sf)
    out = pca.residualise(dense, pca.fit_modes(dense, 1))
    return out.select("date", "id", F.round("residual", 6).alias("residual"))


def market_mode_betas(spark, sf):
    dense = data.dense_week(spark, sf)
    modes = pca.fit_modes(dense, 2)
    return pca.factor_betas(dense, pca.factor_returns(dense, modes)).select("id", "pc", F.round("beta", 6).alias("beta"))


def _ledger_rows(spark, sf):
    dense = data.clusters(data.dense_week(spark, sf)).where("r IS NOT NULL").withColumn("signal", F.round("r", 6))
    w = signals.quantile_weights(dense).withColumn("w", portfolio.gross_to("w", 1.0))
    return w.select(F.explode(F.array(F.lit("0"), F.lit("25"), F.lit("50"))).alias("book"), "date", "id", F.col("w").alias("target"), F.round(F.greatest(F.lit(-0.9), F.least(F.expm1("r"), F.lit(0.9))) / 20, 9).alias("r"))


def ledger_replay(spark, sf):
    return ledger.ledger(_ledger_rows(spark, sf).withColumn("cost_bps", F.col("book").cast("double")), every=2, band=0.01)


def limited_weights(spark, sf):
    return ledger.limited_weights(_ledger_rows(spark, sf).where("book = '0'").select("book", "date", "id", F.col("target").alias("w")), 0.3)


def walkforward_folds(spark, sf):
    n = panel.calendar(data.week_panel(spark, sf)).count()
    return folds.folds(spark, n, train=104, test=13, gap=1)


def fold_eligibility(spark, sf):
    dense = data.dense_week(spark, sf)
    table = folds.folds(spark, panel.calendar(data.week_panel(spark, sf)).count(), train=104, test=13)
    return folds.eligible(folds.fold_rows(dense, table, 20), share=0.99).groupBy("fold").agg(F.count("*").alias("n_ids"))


def _calm(spark, sf):
    """Weekly returns scaled down, so that books of brands stay solvent."""
    dense = data.dense_week(spark, sf).withColumn("r", F.round(F.col("r") / 20, 9))
    return dense, panel.calendar(data.week_panel(spark, sf)).count()


def walkforward_weights(spark, sf):
    return walkforward.fold_weights(*_calm(spark, sf)).withColumn("w", F.round("w", 9))


def walkforward_book(spark, sf):
    return walkforward.run(*_calm(spark, sf))


def romano_wolf(spark, sf):
    dense = data.dense_week(spark, sf)
    full = dense.select("date", F.col("id").alias("strategy"), F.coalesce("r", F.lit(0.0)).alias("ret"))
    return inference.romano_wolf(full, reps=200, seed=7)


def _listings(spark, sf):
    u = data.user_days(spark, sf)
    return u.select("date", "id", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("value"), "id")).alias("rank"), (F.abs("value") + 1).alias("price"), (F.col("n") * 1.0).alias("volume"))


def _ends(spark, sf):
    return _listings(spark, sf).groupBy("id").agg(F.max("date").alias("last")).select("id", F.when(F.col("id") % 3 == 0, F.col("last")).alias("delisting_date"))


def death_features(spark, sf):
    out = death.build_features(_listings(spark, sf), _ends(spark, sf), 5, 5, 2)
    return out.select("date", "id", *(F.round(c, 6).alias(c) for c in death.FEATURES), "label")


def auc_by_rank(spark, sf):
    x = death.build_features(_listings(spark, sf), _ends(spark, sf), 5, 5, 2)
    return death.auc(x.withColumn("ret", F.round("ret", 6)), "ret", "label").select("n", "n_pos", F.round("auc", 8).alias("auc"))


def event_study(spark, sf):
    out = death.event_study(_listings(spark, sf), _ends(spark, sf).where("delisting_date IS NOT NULL"), "volume", 10)
    return out.select("offset", "n", F.round("mean", 6).alias("mean"))


def normalize_symbols(spark, sf):
    p = data.table(spark, sf, "part")
    made = F.concat(F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))), F.element_at(F.array(*map(F.lit, ("USDT", "-USD", "_USDC-PERPETUAL", "", "PERP"))), (F.col("p_partkey") % 5 + 1).cast("int")))
    lead = F.element_at(F.array(*map(F.lit, ("", "1000", "K", "10", "M"))), (F.floor(F.col("p_partkey") / 5) % 5 + 1).cast("int"))
    raw = F.concat(lead, made)
    return p.select("p_partkey", raw.alias("symbol"), symbols.normal_base(raw).alias("base"))


def derivative_filter(spark, sf):
    p = data.table(spark, sf, "part")
    ticker = F.element_at(F.array(*map(F.lit, ("usdt", "ABC", " wbtc ", "DOGE", "PAXG"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    name = F.concat(F.element_at(F.array(*map(F.lit, ("Wrapped ", "Usual ", "Mega USD ", "", "euro ", "Plain "))), (F.col("p_partkey") % 6 + 1).cast("int")), F.col("p_name"))
    return p.select("p_partkey", symbols.is_pegged(ticker, name).alias("excluded"))


def formatted_money(spark, sf):
    o = data.table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year"), "o_orderpriority").agg(F.sum(F.col("o_totalprice").cast(data.MONEY)).cast("double").alias("v"))
    return o.select("year", "o_orderpriority", symbols.money(F.col("v")).alias("shown"), symbols.money(F.col("v") / 4096).alias("small"))


def json_props_flatten(spark, sf):
    e = data.table(spark, sf, "events").select("event_type", F.from_json("props", "struct<k:bigint>")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("k"), F.count("k").alias("n"))


def _rates(spark, sf):
    e = data.table(spark, sf, "events").select("ts", F.col("event_type").alias("base"), "value")
    return e.select(F.window("ts", "8 hours")["start"].alias("ts"), "base", F.round("value", 2).cast(data.MONEY).alias("rate")).groupBy("ts", "base").agg(F.sum("rate").cast("double").alias("rate"))


def funding_daily(spark, sf):
    return readers.daily_funding(_rates(spark, sf), "base").select("date", "base", F.round("rate", 4).alias("rate"))


def funding_summary(spark, sf):
    out = readers.funding_summary(funding_daily(spark, sf))
    return out.select("base", "days", *(F.round(c, 3).alias(c) for c in ("mean", "annual", "vol")))


def keep_last_dedup(spark, sf):
    e = data.table(spark, sf, "events").select(F.to_date("ts").alias("date"), F.col("user_id").alias("id"), "event_id", "ts", F.round("value", 4).alias("value"))
    return panel.dedup(e, ["date", "id"], F.desc("ts"), F.desc("event_id")).select("date", "id", "event_id", "value")


BRANDS = [f"Brand#{a}{b}" for a in range(1, 6) for b in range(1, 6)]


def wide_pivot(spark, sf):
    return panel.wide(data.week_panel(spark, sf).withColumn("volume", F.round("volume", 2)), "volume", BRANDS)


def set_operations(spark, sf):
    users = data.user_days(spark, sf)
    a, b = users.where("n >= 3").select("id", "date"), users.where("value > 200").select("id", "date")
    kinds = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.exceptAll(b)}
    out = None
    for name, df in kinds.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = part if out is None else out.union(part)
    return out


def _stream(spark, sf, build, mode="complete"):
    """A streaming plan run over the events to its end, and its result as a table."""
    import uuid

    source = spark.readStream.schema(data.table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))
    path, result = f"{panel.shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex[:8]}", build(source)
    query = result.writeStream.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/result")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{path}/result")


def stream_daily_resample(spark, sf):
    return _stream(spark, sf, lambda e: streams.daily_resample(e.withColumn("value", F.round("value", 2).cast(data.MONEY)))).select("date", "event_type", "n", F.col("total").cast("double").alias("total"))


def stream_rolling_mean(spark, sf):
    return _stream(spark, sf, lambda e: streams.rolling_mean(e, days=3)).select("until", "event_type", F.round("mean", 6).alias("mean"), "n")


QUERIES = [
    knn_signed_edges, signed_knn_split, rank_weighted_edges, graph_diagnostics, connected_components, signed_laplacian, cluster_quality, balanced_cut, cluster_cohesion_drop, ari_stability,
    *(_labels_by(n) for n in clustering.KERNELS), labels_signflip_k, market_mode_residuals, market_mode_betas, ledger_replay, limited_weights, walkforward_folds, fold_eligibility, walkforward_weights, walkforward_book, romano_wolf,
    death_features, auc_by_rank, event_study, normalize_symbols, derivative_filter, formatted_money, json_props_flatten, funding_daily, funding_summary, keep_last_dedup, wide_pivot, set_operations, stream_daily_resample, stream_rolling_mean,
]

_P = """WITH v AS (SELECT vec_id AS id, generate_subscripts(embedding, 1) AS pos, round(CAST(unnest(embedding) AS DOUBLE), 6) AS x FROM embeddings),
pr AS (SELECT a.id AS a, b.id AS b, round(corr(a.x, b.x), 9) AS corr FROM v a JOIN v b ON a.pos = b.pos AND a.id < b.id GROUP BY 1, 2),
bw AS (SELECT a AS src, b AS dst, corr AS weight FROM pr UNION ALL SELECT b, a, corr FROM pr)"""


def _sym(chosen: str, name: str) -> str:
    return f"{name} AS (SELECT src, dst, sum(weight) / 2 AS weight FROM (SELECT src, dst, weight FROM {chosen} UNION ALL SELECT dst, src, weight FROM {chosen}) GROUP BY 1, 2)"


_E = _P + ", tk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY abs(weight) DESC, dst) AS n FROM bw) WHERE n <= 5), " + _sym("tk", "ed") + ", dg AS (SELECT src, sum(abs(weight)) AS degree FROM ed GROUP BY 1)"
_L = _E + ", lb AS (SELECT e.src, e.dst, e.weight AS w, x.label AS ls, y.label AS ld FROM ed e JOIN embeddings x ON e.src = x.vec_id JOIN embeddings y ON e.dst = y.vec_id)"
_LIST = data.USER + ", lst AS (SELECT date, id, row_number() OVER (PARTITION BY date ORDER BY value DESC, id) AS rank, abs(value) + 1 AS price, n * 1.0 AS volume FROM usr), ends AS (SELECT id, CASE WHEN id % 3 = 0 THEN max(date) END AS dd FROM lst GROUP BY 1)"
_FEAT = "WITH " + _LIST + """, a AS (SELECT *, CASE WHEN count(volume) OVER w5 >= 5 THEN avg(volume) OVER w5 END AS v, count(*) OVER (PARTITION BY id) AS n, min(date) OVER (PARTITION BY id) AS first FROM lst WINDOW w5 AS (PARTITION BY id ORDER BY date ROWS 4 PRECEDING)),
b AS (SELECT date, id, n, ln(price / lag(price, 5) OVER w) AS ret, ln(v / lag(v, 5) OVER w) AS dvol, CAST(rank - lag(rank, 5) OVER w AS DOUBLE) AS drank, CAST(date - first AS DOUBLE) AS age FROM a WINDOW w AS (PARTITION BY id ORDER BY date)),
ft AS (SELECT date, b.id, round(ret, 6) AS ret, round(dvol, 6) AS dvol, round(drank, 6) AS drank, round(age, 6) AS age, CASE WHEN coalesce(dd - date BETWEEN 0 AND 5, FALSE) THEN 1 ELSE 0 END AS label FROM b JOIN ends USING (id) WHERE (date - DATE '1970-01-01') % 2 = 0 AND n >= 11 AND ret IS NOT NULL AND dvol IS NOT NULL AND drank IS NOT NULL AND age IS NOT NULL)"""
_RATE = """WITH r AS (SELECT CAST(ts AS DATE) AS date, event_type AS base, CAST(sum(CAST(round(value, 2) AS DECIMAL(18,2))) AS DOUBLE) AS rate FROM events GROUP BY 1, 2),
sp AS (SELECT base, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM r GROUP BY 1), fd AS (SELECT sp.date, sp.base, round(coalesce(rate, 0), 4) AS rate FROM sp LEFT JOIN r USING (date, base))"""

SQL = {
    "knn_signed_edges": _E + " SELECT src, dst, round(weight, 6) AS weight FROM ed",
    "signed_knn_split": _P + ", up AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS n FROM bw WHERE weight > 0) WHERE n <= 3), dn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight, dst) AS n FROM bw WHERE weight < 0) WHERE n <= 3), "
    + _sym("up", "su") + ", " + _sym("dn", "sd") + " SELECT src, dst, 'pos' AS layer, round(weight, 6) AS weight FROM su UNION ALL SELECT src, dst, 'neg', round(weight, 6) FROM sd",
    "rank_weighted_edges": _E + " SELECT src, dst, round(weight * (count(*) OVER (PARTITION BY src) - row_number() OVER (PARTITION BY src ORDER BY abs(weight) DESC, dst) + 1) / count(*) OVER (PARTITION BY src), 6) AS weight FROM ed",
    "graph_diagnostics": _E + " SELECT a.*, b.* FROM (SELECT count(*) AS n_nodes, round(avg(degree), 5) AS mean_degree, round(min(degree), 5) AS min_degree, round(max(degree), 5) AS max_degree FROM dg) a, (SELECT count(*) AS n_edges, count(CASE WHEN weight > 0 THEN 1 END) AS n_pos, count(CASE WHEN weight < 0 THEN 1 END) AS n_neg, round(count(CASE WHEN weight < 0 THEN 1 END) / count(*), 6) AS negative_share FROM ed WHERE src < dst) b",
    "connected_components": _P.replace("WITH v", "WITH RECURSIVE v") + ", st AS (SELECT src, dst FROM bw WHERE abs(weight) > 0.4), rc AS (SELECT vec_id AS node, vec_id AS c FROM embeddings UNION SELECT st.dst, rc.c FROM rc JOIN st ON rc.node = st.src) SELECT node, min(c) AS component FROM rc GROUP BY 1",
    "signed_laplacian": _E + " SELECT e.src, e.dst, round(-weight / sqrt(a.degree * b.degree), 6) AS value FROM ed e JOIN dg a ON e.src = a.src JOIN dg b ON e.dst = b.src UNION ALL SELECT src, src, 1.0 FROM dg",
    "cluster_quality": _L + ", q AS (SELECT sum(CASE WHEN ls = ld AND w > 0 THEN w ELSE 0 END) AS pw, sum(CASE WHEN ls = ld AND w < 0 THEN -w ELSE 0 END) AS nw, sum(CASE WHEN ls <> ld AND w > 0 THEN w ELSE 0 END) AS pb, sum(CASE WHEN ls <> ld AND w < 0 THEN -w ELSE 0 END) AS nb FROM lb WHERE src < dst) "
    "SELECT round(pw, 5) AS pos_within, round(nw, 5) AS neg_within, round(pb, 5) AS pos_between, round(nb, 5) AS neg_between, round((pw + nb) / (pw + nw + pb + nb), 5) AS satisfied, round((nw + pb) / (pw + nw + pb + nb), 5) AS frustration, round(nw + 2 * pb, 5) AS objective FROM q",
    "balanced_cut": _L + ", q AS (SELECT ls AS label, sum(CASE WHEN (ls <> ld AND w > 0) OR (ls = ld AND w < 0) THEN abs(w) ELSE 0 END) AS cut, sum(abs(w)) AS volume FROM lb GROUP BY 1) SELECT label, round(cut, 5) AS cut, round(volume, 5) AS volume, round(cut / volume, 6) AS ratio FROM q",
    "cluster_cohesion_drop": _P + ", c AS (SELECT x.label, avg(corr) AS c FROM pr JOIN embeddings x ON pr.a = x.vec_id JOIN embeddings y ON pr.b = y.vec_id WHERE x.label = y.label GROUP BY 1), m AS (SELECT label, count(*) AS members FROM embeddings GROUP BY 1), k AS (SELECT label, members, CASE WHEN members < 2 THEN -1 ELSE c END AS cohesion FROM m LEFT JOIN c USING (label)) SELECT label, members, round(cohesion, 7) AS cohesion, row_number() OVER (ORDER BY cohesion NULLS FIRST, label) = 1 AS dropped FROM k",
    "ari_stability": "WITH t AS (SELECT label AS la, (label + vec_id % 3) % 10 AS lb FROM embeddings), c AS (SELECT la, lb, count(*) AS n FROM t GROUP BY 1, 2), s AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2) AS s FROM c), a AS (SELECT sum(n * (n - 1) / 2) AS sa FROM (SELECT sum(n) AS n FROM c GROUP BY la)), b AS (SELECT sum(n * (n - 1) / 2) AS sb FROM (SELECT sum(n) AS n FROM c GROUP BY lb)) "
    "SELECT CAST(n AS BIGINT) AS n, round((s - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)), 8) AS ari FROM s, a, b",
    "walkforward_folds": f"WITH {data.WEEK}, n AS (SELECT count(DISTINCT date) AS n FROM week), t AS (SELECT n, CAST(unnest(range(105, CAST(n AS BIGINT) - 13 + 1, 13)) AS INTEGER) AS t FROM n) SELECT CAST(row_number() OVER (ORDER BY t) - 1 AS INTEGER) AS fold, t - 105 AS train_lo, t - 1 AS train_hi, t AS test_lo, t + 13 AS test_hi FROM t",
    "fold_eligibility": f"WITH {data.DENSE}, n AS (SELECT count(*) AS n FROM cal), t AS (SELECT CAST(unnest(range(104, CAST(n AS BIGINT) - 13 + 1, 13)) AS INTEGER) AS t FROM n), f AS (SELECT CAST(row_number() OVER (ORDER BY t) - 1 AS INTEGER) AS fold, t FROM t), e AS (SELECT fold, id FROM f JOIN dense d ON d.date_idx >= t - 104 AND d.date_idx < t GROUP BY 1, 2 HAVING count(r) >= 0.99 * count(*)) SELECT fold, count(*) AS n_ids FROM e GROUP BY 1",
    "death_features": _FEAT + " SELECT * FROM ft",
    "auc_by_rank": _FEAT + ", k AS (SELECT label, rank() OVER (ORDER BY ret) + (count(*) OVER (PARTITION BY ret) - 1) / 2 AS r FROM ft), s AS (SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS p, sum(r) FILTER (label = 1) AS s FROM k) SELECT n, p AS n_pos, round((s - p * (p + 1) / 2) / (p * (n - p)), 8) AS auc FROM s",
    "event_study": "WITH " + _LIST + ", k AS (SELECT l.id, l.date, volume, 1 - row_number() OVER (PARTITION BY l.id ORDER BY l.date DESC) AS o FROM lst l JOIN ends USING (id) WHERE dd IS NOT NULL AND l.date <= dd), f AS (SELECT *, first_value(volume) OVER (PARTITION BY id ORDER BY date) AS f FROM k WHERE o >= -10) SELECT CAST(o AS INTEGER) AS \"offset\", count(*) AS n, round(avg(volume / f), 6) AS mean FROM f GROUP BY 1",
    "normalize_symbols": "WITH p AS (SELECT p_partkey, (['', '1000', 'K', '10', 'M'])[CAST(floor(p_partkey / 5) % 5 AS INTEGER) + 1] || upper(split_part(p_name, ' ', 1)) || (['USDT', '-USD', '_USDC-PERPETUAL', '', 'PERP'])[CAST(p_partkey % 5 AS INTEGER) + 1] AS symbol FROM part), c AS (SELECT *, split_part(split_part(upper(trim(symbol)), '-', 1), '_', 1) AS s FROM p), "
    "q AS (SELECT *, CASE " + " ".join(f"WHEN suffix(s, '{x}') AND length(s) > {len(x)} THEN left(s, length(s) - {len(x)})" for x in symbols.QUOTES) + " ELSE s END AS b FROM c) "
    "SELECT p_partkey, symbol, CASE " + " ".join(f"WHEN regexp_matches(b, '^{x}[A-Z0-9][A-Z0-9]') THEN substr(b, {len(x) + 1})" for x in symbols.MULTIPLIERS) + " ELSE b END AS base FROM q",
    "derivative_filter": "WITH p AS (SELECT p_partkey, upper(trim((['usdt', 'ABC', ' wbtc ', 'DOGE', 'PAXG'])[CAST(p_partkey % 5 AS INTEGER) + 1])) AS t, lower(trim((['Wrapped ', 'Usual ', 'Mega USD ', '', 'euro ', 'Plain '])[CAST(p_partkey % 6 AS INTEGER) + 1] || p_name)) AS n FROM part) SELECT p_partkey, CASE WHEN t IN ("
    + ", ".join(f"'{t}'" for t in (*symbols.STABLE_TICKERS, *symbols.WRAPPED_TICKERS)) + ") THEN TRUE WHEN " + " OR ".join(f"contains(n, '{x}')" for x in symbols.ORDINARY_NAMES) + " THEN FALSE ELSE " + " OR ".join(f"contains(n, '{x}')" for x in (*symbols.DERIVATIVE_PARTS, *symbols.STABLE_PARTS)) + " END AS excluded FROM p",
    "formatted_money": "WITH o AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM orders GROUP BY 1, 2), u AS (SELECT *, v / 4096 AS w FROM o) SELECT year, o_orderpriority, "
    + ", ".join("CASE " + " ".join(f"WHEN {v} >= {size} THEN format('{{:.1f}}', {v} / {size}) || '{unit}'" for size, unit in (("1e12", "T"), ("1e9", "B"), ("1e6", "M"), ("1e3", "k"))) + f" ELSE format('{{:.0f}}', {v}) END AS {n}" for v, n in (("v", "shown"), ("w", "small"))) + " FROM u",
    "json_props_flatten": "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(json_extract(props, '$.k')) AS n FROM events GROUP BY 1",
    "funding_daily": _RATE + " SELECT date, base, rate FROM fd",
    "funding_summary": _RATE + " SELECT base, count(*) AS days, round(avg(rate), 3) AS mean, round(avg(rate) * 365, 3) AS annual, round(stddev_samp(rate), 3) AS vol FROM fd GROUP BY 1",
    "keep_last_dedup": "SELECT date, id, event_id, value FROM (SELECT CAST(ts AS DATE) AS date, user_id AS id, event_id, round(value, 4) AS value, row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "wide_pivot": f"WITH {data.WEEK} SELECT date, " + ", ".join(f"max(round(volume, 2)) FILTER (id = '{b}') AS \"{b}\"" for b in BRANDS) + " FROM week GROUP BY 1",
    "set_operations": f"WITH {data.USER}, a AS (SELECT id, date FROM usr WHERE n >= 3), b AS (SELECT id, date FROM usr WHERE value > 200) SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)",
    "stream_daily_resample": "SELECT CAST(ts AS DATE) AS date, event_type, count(*) AS n, CAST(sum(CAST(round(value, 2) AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2",
    "stream_rolling_mean": "SELECT CAST(CAST(ts AS DATE) + k AS TIMESTAMP) AS until, event_type, round(avg(value), 6) AS mean, count(*) AS n FROM events, (SELECT unnest([1, 2, 3]) AS k) GROUP BY 1, 2",
}
