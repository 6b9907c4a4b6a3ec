"""Signal operators on numeric series and synthetic sound."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalune.operators import signals as S
from catalune.queries import query


@query("step_lookup", "D12", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, CASE WHEN l_quantity >= 40 THEN 20000 WHEN l_quantity >= 25 THEN 18500 WHEN l_quantity >= 10 THEN 16000 ELSE 11000 END AS cutoff FROM lineitem")
def step_lookup(t):
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", S.step(F.col("l_quantity"), [(0, 11000), (10, 16000), (25, 18500), (40, 20000)]).alias("cutoff"))


@query("argmin_source", "D13", "SELECT o_orderkey, min_by(r, (abs(x - 0.955), r)) AS source FROM (SELECT o_orderkey, r, (o_totalprice / 10) / (r / 2.0) AS x FROM orders, (SELECT unnest([32000, 44100, 48000, 88200, 96000]) AS r)) WHERE x BETWEEN 0.86 AND 1.01 GROUP BY o_orderkey")
def argmin_source(t):
    d = t.orders.select("o_orderkey", S.resample_source(F.col("o_totalprice") / 10, [32000, 44100, 48000, 88200, 96000]).alias("source"))
    return d.where("source is not null")


@query("band_corr", "D9 D5", "SELECT label, round(corr(embedding[1], embedding[2]), 6) AS r, round(quantile_disc(embedding[1]::DOUBLE, 0.25), 6) AS floor FROM embeddings GROUP BY label")
def band_corr(t):
    a, b = F.get("embedding", F.lit(0)).cast("double"), F.get("embedding", F.lit(1)).cast("double")
    return t.embeddings.select("label", a.alias("a"), b.alias("b")).groupBy("label").agg(F.round(F.corr("a", "b"), 6).alias("r"), F.expr("round(percentile_disc(0.25) WITHIN GROUP (ORDER BY a), 6)").alias("floor_")).select("label", "r", F.col("floor_").cast("double").alias("floor"))


@query("rule_engine", "D11 D10", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, CASE WHEN l_tax > 0.07 THEN 'bad' WHEN l_discount > 0.08 OR l_quantity < 3 THEN 'warn' ELSE 'ok' END AS grade,
       concat_ws('; ', CASE WHEN l_tax > 0.07 THEN 'bad: cut off' END, CASE WHEN l_discount > 0.08 THEN 'warn: padded' END, CASE WHEN l_quantity < 3 THEN 'warn: short' END) AS findings FROM lineitem""")
def rule_engine(t):
    rules = [("bad", "cut off", F.col("l_tax") > 0.07), ("warn", "padded", F.col("l_discount") > 0.08), ("warn", "short", F.col("l_quantity") < 3)]
    v = S.verdict(rules)
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", v["grade"].alias("grade"), F.array_join(F.transform(v["findings"], lambda f: F.concat_ws(": ", f["sev"], f["title"])), "; ").alias("findings"))


@query("keep_range", "D14", "SELECT event_id, cast(greatest(0, floor(-least(0, value - 50) * 44.1)) AS BIGINT) AS first, cast(least(200000, 150000 + greatest(0, floor(-least(0, value - 50) * 44.1))) AS BIGINT) AS last FROM events")
def keep_range(t):
    first, last = S.keep_range(F.lit(200000), F.lit(44100), (F.col("value") - 50) / 1000, F.lit(150000 / 44100))
    return t.events.select("event_id", first.alias("first"), last.alias("last"))


@query("spectrum_peaks", "D1 D2")
def spectrum_peaks(t):
    return S.analysed(S.tones(t.nation.select(F.col("n_nationkey").alias("id"), (110.0 * F.pow(F.lit(2.0), F.col("n_nationkey") / 12)).alias("hz"), (90 + F.col("n_nationkey") * 3).cast("double").alias("bpm")))).select("id", F.round("peak_hz", 3).alias("peak_hz"), F.round("rms", 6).alias("rms"))


@query("tempo_and_key", "D3 D4 D5")
def tempo_and_key(t):
    return S.analysed(S.tones(t.nation.select(F.col("n_nationkey").alias("id"), (220.0 * F.pow(F.lit(2.0), F.col("n_nationkey") / 12)).alias("hz"), (90 + F.col("n_nationkey") * 12).cast("double").alias("bpm")))).select("id", F.round("bpm", 2).alias("bpm"), "tonic", "minor")


@query("sound_fingerprints", "D6 S22")
def sound_fingerprints(t):
    d = S.tones(t.nation.select(F.col("n_nationkey").alias("id"), (220.0 * F.pow(F.lit(2.0), F.col("n_nationkey") / 12)).alias("hz"), F.lit(120.0).alias("bpm")))
    return S.fingerprints(d).select("id", F.size("words").alias("n"), F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s.bitwiseXOR(w)).alias("mix"))


@query("sound_examined", "D8 D9 D10")
def sound_examined(t):
    from catalune.operators import sound

    d = S.tones(t.nation.select(F.col("n_nationkey").alias("id"), (220.0 * F.pow(F.lit(2.0), F.col("n_nationkey") / 12)).alias("hz"), F.lit(120.0).alias("bpm"))).withColumn("bpm", F.lit(120.0))
    most = lambda c: F.array_max(c).alias(c)
    return sound.examined(d).select("id", F.round("fc", 3).alias("fc"), "wall", F.round("reach", 3).alias("reach"), F.round("beat0", 4).alias("beat0"), "bar", F.size("low").alias("points"), most("low"), most("peak"))
