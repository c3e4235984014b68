"""Operators on small hand-made inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.functions import fixed
from faultline.functions import recurrences as rec
from faultline.operators import agent, align, datasets, features, filters, graph, quantize, retrieval, safety, scan, segments, simulate, text, transforms
from faultline.plans import signals
from faultline.sources import readers, writers
from faultline.streaming import processors


def rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def readings(spark, n=120, keys=3):
    data = [(k, i, float(14 + (i * 7 + k) % 5)) for k in range(keys) for i in range(n)]
    return spark.createDataFrame(data, "tag int, seq int, value double")


# filters


def test_scan_does_not_depend_on_partitions(spark):
    df = readings(spark)
    one = rows(filters.two_stage(df.coalesce(1), "tag", ["seq"], "value"), "tag", "seq", "x")
    many = rows(filters.two_stage(df.repartition(7), "tag", ["seq"], "value"), "tag", "seq", "x")
    assert sorted(one) == sorted(many) and len(one) == df.count()


def test_scan_of_no_rows(spark):
    assert filters.kalman(readings(spark).filter("false"), "tag", ["seq"], "value").count() == 0


def test_final_state_equals_the_scan(spark):
    df = readings(spark)
    last = {t: x for t, s, x in rows(filters.kalman(df, "tag", ["seq"], "value"), "tag", "seq", "x") if s == 119}
    assert dict(rows(filters.final_state(df, "tag", ["seq"], "value"), "tag", "x")) == pytest.approx(last)


def test_gains_equal_the_filter(spark):
    got = rows(filters.gains(spark, 20).orderBy("n"), "gain")
    want = rows(filters.kalman(readings(spark, 20, 1), "tag", ["seq"], "value").orderBy("seq"), "gain")
    assert [g for (g,) in got] == pytest.approx([g for (g,) in want])


def test_windows_cover_every_value(spark):
    out = rows(filters.windows(readings(spark, 70, 1), "tag", ["seq"], "value").orderBy("window_id"), "window_id", "n")
    assert out == [(0, 32), (1, 32), (2, 32), (3, 22)]
    assert rows(filters.windows(readings(spark, 10, 1), "tag", ["seq"], "value"), "n") == [(10,)]


def test_overrides_by_class(spark):
    df = readings(spark, 10, 2).withColumn("kind", F.when(F.col("tag") == 0, "slow").otherwise(None))
    out = filters.two_stage_by_class(df, "tag", ["seq"], "value", "kind", {"slow": {"first": (1e-9, 10.0, 1.0)}})
    last = dict(rows(out.filter("seq = 9"), "tag", "x1"))
    assert last[0] != pytest.approx(last[1], rel=0.05)


def test_segments_equal_the_scan(spark):
    df = readings(spark, 400, 2).union(spark.createDataFrame([(9, i, float(i % 7)) for i in range(3)], "tag int, seq int, value double"))
    cut = F.floor(F.col("seq") / 37)
    got = {(t, i): x for t, i, x in rows(segments.two_stage(df, "tag", ["seq"], "value", cut), "tag", "seq", "x")}
    want = {(t, i): x for t, i, x in rows(filters.two_stage(df, "tag", ["seq"], "value"), "tag", "seq", "x")}
    assert len(got) == 803 and got == pytest.approx(want)
    names = ("mean", "variance", "z", "upper")
    got = {(t, i): tuple(x) for t, i, *x in rows(segments.baseline(df, "tag", ["seq"], "value", cut, min_window=5), "tag", "seq", *names)}
    want = {(t, i): tuple(x) for t, i, *x in rows(features.baseline(df, "tag", ["seq"], "value", min_window=5), "tag", "seq", *names)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    sides = ("v_rolling_mean", "v_rolling_std")
    got = {(t, i): tuple(x) for t, i, *x in rows(segments.rolling(df, "tag", ["seq"], "value", "v", cut, 10, 25), "tag", "seq", *sides)}
    want = {(t, i): tuple(x) for t, i, *x in rows(features.rolling(df, ["tag"], ["seq"], "value", "v", 10), "tag", "seq", *sides)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    places = rows(segments.numbered(df, "tag", ["seq"], cut), "tag", "seq", segments.PLACE)
    assert all(n == i + 1 for _, i, n in places)
    assert segments.two_stage(df.filter("false"), "tag", ["seq"], "value", cut).count() == 0


# alignment


def test_unknown_source_fails(spark):
    events = spark.createDataFrame([("plc", 1, "a"), ("lab", 2, "b")], readers.EVENTS)
    sources = spark.createDataFrame([("plc", 0, 1)], readers.SOURCES)
    with pytest.raises(Exception, match="unknown source"):
        align.keyed(events, sources).collect()


def test_bundles(spark):
    data = [("l", 0, "a"), ("l", 5, "b"), ("l", 9, "a"), ("l", 30, "b"), ("l", 31, "a")]
    events = spark.createDataFrame(data, "line string, at long, source string")
    out = align.bundles(events, ["line"], "at", "source", 2, 10, F.col("source"))
    assert sorted(rows(out, "at", "n_events")) == [(5, 2), (9, 3), (31, 2)]
    apart = align.bundles(events, ["line"], "at", "source", 2, 10, non_overlapping=True)
    assert sorted(rows(apart, "at")) == [(5,), (31,)]
    assert rows(align.alignment_rate(events, out), "rate") == [(0.6,)]


def brute_warp(a, b, band):
    n, m = len(a), len(b)
    cost = np.full((n + 1, m + 1), np.inf)
    cost[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(max(1, i - band), min(m, i + band) + 1):
            cost[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(cost[i - 1, j - 1], cost[i - 1, j], cost[i, j - 1])
    return cost[n, m]


def test_warp_equals_brute_force():
    rng = np.random.default_rng(1)
    for n, m, w in ((5, 5, None), (30, 20, 5), (20, 31, 12), (1, 7, None)):
        a, b = rng.normal(size=n), rng.normal(size=m)
        distance, path = align.warp(a, b, w)
        assert distance == pytest.approx(brute_warp(a, b, max(n, m) if w is None else max(w, abs(n - m))))
        assert tuple(path[0]) == (0, 0) and tuple(path[-1]) == (n - 1, m - 1)
        assert set(map(tuple, np.diff(path, axis=0))) <= {(0, 1), (1, 0), (1, 1)}
        assert sum((a[i] - b[j]) ** 2 for i, j in path) == pytest.approx(distance)


def test_warp_of_equal_and_empty_series(spark):
    assert align.warp(np.arange(5.0), np.arange(5.0))[0] == 0
    with pytest.raises(ValueError):
        align.warp(np.zeros(0), np.zeros(3))
    with pytest.raises(ValueError):
        align.warp(np.zeros(2), np.zeros(3), 0)
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0], [1.0, 2.0, 3.0])], "k int, a array<double>, b array<double>")
    assert rows(align.dtw(df, "k", "a", "b"), "distance", "lag_mean", "lag_std") == [(0.0, 0.0, 0.0)]


def test_as_of(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (1, 8, "c")], "k int, t int, v string")
    assert sorted(rows(align.as_of(left, right, ["k"], "t", "v"), "k", "t", "asof_v"), key=str) == [(1, 1, None), (1, 5, "b"), (2, 9, None)]


# quantisation


def merge_closest(values, k):
    """Plain merging of the closest neighbours, ties at the smaller value."""
    groups = [[v] for v in sorted(set(np.float32(values)))]
    while len(groups) > k:
        gaps = [np.float32(b[0] - a[-1]) for a, b in zip(groups, groups[1:])]
        i = min(range(len(gaps)), key=lambda j: (gaps[j], j))
        groups[i : i + 2] = [groups[i] + groups[i + 1]]
    return {float(v): n for n, g in enumerate(groups) for v in g}


def test_codes_equal_merging(spark):
    rng = np.random.default_rng(3)
    values = [float(v) for v in rng.normal(14, 0.5, 60)] + [1.0, 2.0, 1.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = dict(rows(quantize.dictionary(df, [], "v", 2), "value", "code"))
    assert got == merge_closest(values, 4)


def test_quantise_example_and_cost(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (11.0,)], "v double")
    df4 = quantize.dictionary(df, [], "v", 2)
    assert df4.count() == 4
    row = spark.range(1).select(quantize.stored_bytes(F.lit(5), F.lit(3), 8).alias("b"))
    assert rows(row, "b") == [(29,)]
    with pytest.raises(ValueError):
        quantize.dictionary(df, [], "v", 1)
    constant = spark.createDataFrame([(3.14,)] * 100, "v double")
    assert rows(quantize.statistics(constant, [], "v", 8), "clusters", "rms_error") == [(1, 0.0)]


def test_triangle_round_trip(spark):
    m = [[float(min(i, j) * 10 + max(i, j)) for j in range(5)] for i in range(5)]
    df = spark.createDataFrame([(m,)], "m array<array<double>>").withColumn("p", quantize.lower_triangle(F.col("m")))
    out = df.select("p", quantize.full_matrix(F.col("p"), 5).alias("back")).first()
    assert len(out.p) == 15 and out.back == m
    packet = writers.packets(df.withColumn("s", F.array(*map(F.lit, range(5)))).withColumn("t", F.lit(1)), "s", "m", "t").first().packet
    assert len(packet) == 22


# wavelets and scalograms


def test_filter_taps():
    want = [0.2303778133, 0.7148465706, 0.6308807679, -0.0279837694, -0.1870348117, 0.0308413818, 0.0328830117, -0.0105974018]
    assert transforms.daubechies(4) == pytest.approx(want, abs=1e-9)
    for order in (1, 2, 6):
        taps = transforms.daubechies(order)
        assert taps.sum() == pytest.approx(2**0.5) and (taps**2).sum() == pytest.approx(1)


def test_perfect_reconstruction_and_denoising():
    rng = np.random.default_rng(42)
    clean = np.sin(np.linspace(0, 8, 256))
    noisy = clean + rng.normal(0, 0.2, 256)
    assert transforms.recompose(transforms.decompose(noisy, "db4", 3), "db4") == pytest.approx(noisy)
    out = transforms.denoise_array(noisy)
    assert len(out) == 256 and np.std(out - clean) < np.std(noisy - clean)
    assert len(transforms.denoise_array(noisy[:201], level=2)) == 201
    with pytest.raises(ValueError):
        transforms.denoise_array(noisy[:16], level=5)


def test_scalogram_finds_a_sinusoid():
    n, f = 1024, 1 / 16
    power = transforms.morlet(np.sin(2 * np.pi * f * np.arange(n)), np.arange(1.0, 65.0))
    assert abs(int(np.argmax(power[:, n // 2])) + 1 - 16) <= 1
    # the transform of a unit sinusoid at its own scale a is sqrt(a) / 2 in the middle
    assert power[15, n // 2] == pytest.approx(0.5 * 16**0.5, rel=0.02)


# features and scores


def test_physics_values(spark):
    df = spark.createDataFrame([(1.0, 4.0, -3.0, 50.0), (None, None, None, None)], "dp double, rr double, tg double, flow double")
    parts = features.indicators(*(F.col(c) for c in df.columns))
    out = rows(df.select(features.physics_score(parts).alias("s"), parts["flooding_index"].alias("f"), features.explanations(parts).alias("e")), "s", "f", "e")
    assert out[0][0] == pytest.approx(0.2273809524) and out[0][1] == -0.5 and out[1][0] == pytest.approx(out[0][0]) and out[0][2] == []
    high = spark.createDataFrame([(3.0, 4.0, -3.0, 20.0)], "dp double, rr double, tg double, flow double")
    (texts,) = rows(high.select(features.explanations(features.indicators(*(F.col(c) for c in high.columns))).alias("e")), "e")[0]
    assert texts == ["flooding_index: high deviation (z=2.75)", "dp_deviation: high deviation (z=2.33)"]


def test_soft_sensor(spark):
    out = spark.createDataFrame([(100.0, 15.0), (None, 1.0)], "t double, p double").select(features.abundance(F.col("t"), F.col("p")).alias("a"))
    assert rows(out, "a") == [(96.5,), (50.0,)]


def test_rolling_back_fills(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(6)] + [(2, 0, 4.0), (2, 1, 6.0)], "k int, i int, v double")
    out = rows(features.rolling(df, ["k"], ["i"], "v", "v", 3).orderBy("k", "i"), "v_rolling_mean")
    assert [m for (m,) in out] == [1.0, 1.0, 1.0, 2.0, 3.0, 4.0, 5.0, 5.0]


def test_feature_groups(spark):
    df = spark.createDataFrame([(1, 1, 2.0, 3.0)], "k int, i int, `PT-301` double, `PT-302` double")
    out = features.features(df, ["k"], ["i"])
    assert out.columns == ["k", "i", *features.feature_names()] and out.first()["delta_p"] == 1.0
    with pytest.raises(ValueError):
        features.features(df, ["k"], ["i"], ())


def test_density_of_few_values(spark):
    df = spark.createDataFrame([("a", 1.0)] * 3 + [("b", float(i)) for i in range(20)], "k string, v double")
    out = features.density(df, "k", "v")
    assert set(rows(out.filter("k = 'a'"), "density")) == {(1.0,)}
    grid = sorted(rows(out.filter("k = 'b'"), "x", "density"))
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(grid, grid[1:]))
    assert len(grid) == 100 and 0.8 < area < 1.01


# text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tables(spark):
    md = "| a | b |\n\n| Tag | failure_mode | Severity | severity |\n|---|---|---|---|\n| TE-301 | flooding | 8 | 9 |\n| x |\ntext"
    docs = spark.createDataFrame([(1, md), (2, None), (3, "")], "k int, text string")
    out = text.rewritten(text.table_rows(docs, "k", "text")).collect()
    assert len(out) == 1 and out[0].tag == "TE-301" and out[0].severity == 9 and "[flooding]" in out[0].page_content


def test_pieces(spark):
    df = spark.createDataFrame([(1, "x" * 3000), (2, "short"), (3, "")], "k int, text string")
    out = rows(text.split_long(df, "text").withColumn("n", F.length("text")).orderBy("k", "piece"), "k", "n")
    assert out == [(1, 1500), (1, 1500), (1, 200), (2, 5), (3, 0)]


def test_citations_and_claims(spark):
    t = F.lit("TE-301 is hot [Source: fmea_042]. Fine. See [fmea #7] (Source: a b ) and [REF:x].\nNo number!")
    assert one(spark, text.citations(t)) == ["7", "a b", "fmea_042", "x"]
    assert one(spark, text.claims(t)) == 2
    assert one(spark, text.claims(F.lit(""))) == 0


def test_tokens_and_trimming(spark):
    assert one(spark, text.token_estimate(F.lit("abcdefgh"))) == 2
    assert one(spark, text.token_estimate(F.lit("温度报警"))) == 2
    assert one(spark, text.trimmed_text(F.lit("abcdefgh"), 1)) == "…[trimmed]…\nefgh"
    turns = spark.createDataFrame([(1, k, "user", "x" * 400) for k in range(10)] + [(2, 0, None, None)], "conv int, turn int, role string, text string")
    kept = rows(text.trim_history(turns, "conv", "turn", "role", "text", 700, 3).orderBy("conv", "turn"), "conv", "turn")
    assert kept == [(1, k) for k in range(4, 10)] + [(2, 0)]


def test_summary_falls_back(spark):
    turns = spark.createDataFrame([(1, 0, "An alarm rang. Nothing"), (1, 1, "ok"), (2, 0, "hello"), (2, 1, None)], "conv int, turn int, text string")
    assert dict(rows(text.summaries(turns, "conv", "turn", "text"), "conv", "digest")) == {1: "An alarm rang", 2: "hello | "}


def test_intents(spark):
    for said, want in (("Alarm high", "fmea_query"), ("what is the SOP?", "status_check"), ("", "unknown"), (None, "unknown")):
        assert one(spark, text.intent(F.lit(said))[0]) == want


def test_reward(spark):
    for said, want in (("[Source: a] TE-301 severity occurrence detection manual inspection", 2.0), ("shutdown XX-999", -2.0), ("AB-123", -1.0), ("", 0.0)):
        assert one(spark, text.reward(F.lit(said))) == pytest.approx(want)


def test_prompts(spark):
    prompt = one(spark, text.refusal_prompt(F.lit("ctx"), F.lit("TE-301"), F.create_map(F.lit("PT-301"), F.lit(1.5))))
    assert prompt.startswith(fixed.REFUSAL_SYSTEM) and "  PT-301 = 1.5\n" in prompt and "### Example 2" in prompt and "### Example 3" not in prompt


# retrieval and graphs


def test_bm25_and_fusion(spark):
    docs = spark.createDataFrame([(1, "pump bearing hot hot"), (2, "valve stuck"), (3, "pump valve seal"), (4, "cold leak"), (5, "dry bed")], "doc_id int, text string")
    asked = spark.createDataFrame([(0, "hot bearing", [1.0, 0.0])], "query_id int, query string, query_vector array<double>")
    assert rows(retrieval.bm25(docs, "doc_id", "text", asked), "doc_id", "score", "rank0") == [(1, 1.0, 0)]
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.5, 0.5])], "vec_id int, v array<double>")
    out = rows(retrieval.hybrid(docs, "doc_id", "text", vectors, "vec_id", "v", asked), "doc_id", "score")
    assert out[0][0] == 1 and out[0][1] == pytest.approx(1 / 61) and [d for d, _ in out] == [1, 3]


def test_metadata(spark):
    m = F.create_map(F.lit("lang"), F.lit("en"))
    assert one(spark, retrieval.matches(m, {"lang": "en", "x": ""})) and not one(spark, retrieval.matches(m, {"lang": "en", "x": "y"}))
    assert one(spark, retrieval.matches(m, {"lang": "de", "x": ""}, every=False)) and one(spark, retrieval.matches(m, {}))


def fmea(spark):
    data = [(1, "TE-301", "T", "overheat", "oil", "check", 8, 192), (2, "PT-301", "T", "overheat", "", "x", 5, 60), (3, "", "T", "y", "", "", 1, 1), (4, "FT-301", "U", "stuck", "wear", None, 2, 9)]
    return spark.createDataFrame(data, "at int, tag string, system string, failure_mode string, root_cause string, mitigation string, severity int, rpn int")


def test_graph(spark):
    nodes, edges = graph.load(fmea(spark), "at")
    assert nodes.count() == 8 and edges.count() == 6
    both = graph.paired(graph.checked(edges, nodes))
    seed = graph.first_where(nodes, "TE-301", "node_id")
    found = dict(rows(graph.search(both, seed).join(nodes, "node_id"), "tag", "depth"))
    assert found == {"overheat": 1, "oil": 2, "PT-301": 2, "check": 3}
    strong = dict(rows(graph.search(both, seed, min_weight=0.85).join(nodes, "node_id"), "tag", "depth"))
    assert strong == {}
    groups = rows(graph.components(spark, nodes, edges).groupBy("component").count(), "count")
    assert sorted(groups) == [(3,), (5,)]
    with pytest.raises(Exception, match="unknown node"):
        graph.checked(edges, nodes.filter("tag <> 'oil'")).collect()
    context = graph.context_text(graph.search(both, seed), nodes).first().context
    assert "Potential Root Cause" in context and "overheat [S=8] (T)" in context


# rules and reports


def test_guard_last_rule_wins(spark):
    rules = spark.createDataFrame([(1, 1, None, None, False), (2, 1, 5, 0, True), (3, None, None, 3, False)], safety.RULES)
    events = spark.createDataFrame([(1, 5, 0), (1, 6, 2), (2, 6, 3), (2, 6, 2), (-1, 6, 3), (None, 1, 3)], "device_type int, sensor_id int, severity int")
    assert rows(safety.guard(events, rules), "allowed", "route") == [(True, "pass"), (False, "block"), (False, "block"), (True, "llm"), (True, "llm"), (True, "llm")]
    assert rows(safety.guard(events, rules.filter("false")), "allowed") == [(True,)] * 6
    with pytest.raises(Exception, match="outside"):
        safety.check_indexes(spark.createDataFrame([(1, 99, None, None, False)], safety.RULES)).collect()


def test_guardrails(spark):
    schema = "abundance_pct double, valve_opening_pct double, temperature_c double, pressure_bar double, flow_rate double, matched_fmea array<struct<confidence: double>>, diagnostic_summary string"
    data = [(97.0, 50.0, 20.0, 5.0, 1.0, [(0.9,)], "ok"), (105.0, 50.0, 20.0, 5.0, 1.0, [], "ok"), (None, None, None, None, None, [(0.45,)], ""), (None, None, -300.0, None, None, None, None), (None, None, None, None, float("nan"), [], "Guaranteed fix"), (float("nan"), None, None, None, None, None, None), (None, None, None, None, None, [(None,)], "")]
    df = spark.createDataFrame(data, schema)
    assert rows(df.select(safety.guardrail_failure(df).alias("f")), "f") == [(None,), ("abundance",), ("confidence",), ("temperature",), ("language",), ("abundance",), ("confidence",)]
    cut = rows(safety.sanitized(df), "abundance_pct", "temperature_c")
    assert cut[1][0] == 100.0 and cut[3] == (None, -273.15)


def test_diagnosis(spark):
    alarms = spark.createDataFrame([(1, "TE-301", 85.0, "PLC", "", None), (2, "XX-1", 1.0, None, "", None), (3, "PT-301", None, "PLC", "no", None)], "alarm_id int, tag string, value double, source string, engineer_feedback string, history array<struct<role: string, content: string>>")
    out = {r.alarm_id: r for r in agent.diagnose(alarms, agent.failure_base(spark), agent.topology(spark), F.lit("now")).collect()}
    assert {k: r.route for k, r in out.items()} == {1: "end", 2: "fallback", 3: "reflect"}
    assert [m.failure_mode for m in out[1].report.matched_fmea] == ["bearing_overheat", "sensor_drift"]
    assert "Upstream: Cryogenic_Column_T-301" in out[1].device_context
    assert out[2].report.matched_fmea == [] and "FALLBACK" in out[2].report.diagnostic_summary
    assert out[3].history[0].content == "no" and out[3].engineer_feedback == ""


def test_advice(spark):
    df = spark.createDataFrame([(1, "a", 0.85, None, 0), (1, "b", 0.8, "x", 1), (1, "c", 0.1, None, 2), (1, "d", 0.05, None, 3), (2, "z", 0.2, None, 0)], "k int, hypothesis string, confidence double, fmea_action string, place int")
    out = {r.k: r for r in agent.advise(df, "k").collect()}
    assert "manual inspection" in out[1].recommendations[0] and "gap=0.05" in out[1].disambiguation_action and out[1].summary.count("\n") == 3
    assert out[2].recommendations == [out[2].disambiguation_action]


# simulation and training rows


def test_simulator(spark):
    starts = simulate.initial(spark, 2).withColumns({"feed_mult": F.lit(1.0), "reflux_mult": F.lit(1.0), "duty_mult": F.lit(1.0)})
    out = rows(simulate.trajectories(starts, 10), "episode", "step", "abundance", "reward")
    assert len(out) == 20 and all(a == 97.0 and r == 0.9 for _, _, a, r in out)
    noisy = lambda df: sorted(rows(simulate.trajectories(df, 5, seed=1), "episode", "step", "abundance"))
    assert noisy(starts.repartition(2)) == noisy(starts.coalesce(1))
    low = starts.withColumn("reflux_mult", F.lit(0.0))
    assert rows(simulate.trajectories(low, 100).filter("terminated"), "step") == [(12,), (12,)]


def test_rollouts(spark):
    df = spark.createDataFrame([(3.0, 97.0), (1.0, 90.0), (1.2, 97.0)], "dp double, a double")
    assert [v for (v,) in rows(df.select(simulate.rollout_value(F.col("dp"), F.col("a")).alias("v")), "v")] == pytest.approx([-1, -19.7496966, 3.9499393])


def test_training_rows(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "TE-301", None, "page"), (2, None, "S", None)], "chunk_id int, tag string, system string, page_content string")
    sft = datasets.sft_rows(chunks, refusals=spark.createDataFrame([(0, "FV-999", "why")], "chunk_id int, tag string, reason string"))
    assert sft.count() == 3 and datasets.sft_rows(chunks, cap=1).count() == 1
    wide = chunks.withColumns({"source": F.lit(None).cast("string"), "recommended_action": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    dpo = datasets.dpo_rows(wide)
    assert dpo.count() == 3 and dpo.first().chosen.startswith("[Source: fmea_XXX] page")
    writers.jsonl(sft, str(tmp_path / "sft"), 1)
    assert spark.read.json(str(tmp_path / "sft")).count() == 3


def test_readers(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\nx")
    assert rows(readers.markdown(spark, str(tmp_path / "a.md")), "text") == [("# T\nx",)]
    assert rows(readers.office(spark, str(tmp_path), lambda c, p: c.decode().upper(), "*.md"), "text") == [("# T\nX",)]
    (tmp_path / "f.json").write_text('[{"id": "1", "tag": "TE-301", "cause": "c", "recommended_action": "r", "severity": 8}]')
    assert rows(readers.failure_table(spark, str(tmp_path / "f.json")), "root_cause", "mitigation", "severity") == [("c", "r", 8)]
    assert readers.asset_tags(spark).count() == 36
    odd = spark.createDataFrame([("PT-304",), ("TE-301",)], "tag string")
    assert rows(readers.unknown_assets(odd, "tag", "tag", spark), "tag") == [("PT-304",)]


# streams


def drain(stream, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def test_stream_equals_batch(spark, tmp_path):
    df = readings(spark, 40, 2)
    for k in range(2):
        df.filter(F.floor(F.col("seq") / 20) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, what in signals.RECURRENCES.items():
        got = drain(processors.scan_stream(stream, "tag", ["seq"], "value", what), f"out_{name}")
        want = scan.scan(df, "tag", ["seq"], "value", what)
        last = what.outputs[0]
        one, two = ({(t, s): x for t, s, x in rows(df, "tag", "seq", last)} for df in (got, want))
        assert len(one) == 80 and one == pytest.approx(two)


def test_align_stream(spark, tmp_path):
    data = [("l", 1_000_000_000 + t, s) for t, s in ((0, "a"), (5, "b"), (9, "a"), (30, "b"), (31, "a"))]
    df = spark.createDataFrame(data, "line string, at long, source string").withColumn("ts", F.timestamp_micros((F.col("at") / 1000).cast("long")))
    df.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "ev"))
    got = drain(processors.align_stream(stream, "line", "at", "source", "ts", 2, 10), "bundles_out")
    assert sorted(rows(got, "at", "n_events")) == [(1_000_000_005, 2), (1_000_000_009, 3), (1_000_000_031, 2)]


def test_ranks_by_bucket_equal_ranks_of_whole_keys(spark):
    data = [("a" if k % 3 else None, float((k * 37) % 50) if k % 11 else None, k) for k in range(200)] + [("few", 1.0, 900), ("few", 2.0, 901)]
    df = spark.createDataFrame(data, "tag string, value double, seq int").withColumn("by", F.struct("value", "seq"))
    for bins in (1, 7, 8):
        whole, cut = (quantize.equal_frequency(df, ["tag"], "by", bins, b) for b in (None, quantize.value_bucket(F.col("value"))))
        assert sorted(rows(cut, "seq", "bin")) == sorted(rows(whole, "seq", "bin")) and cut.columns == whole.columns
    placed = segments.numbered(df, "tag", ["value", "seq"], F.floor("value"))
    plain = {tag: sorted(((v is not None, v or 0.0, k) for t, v, k in data if t == tag)) for tag in ("a", None, "few")}
    want = sorted((k, n + 1) for each in plain.values() for n, (_, _, k) in enumerate(each))
    assert sorted(rows(placed, "seq", segments.PLACE)) == want
    known = df.filter("tag is not null and value is not null")
    whole, cut = (quantize.blocks(known, "tag", ["seq"], "value", 16, 3, b) for b in (None, F.floor(F.col("seq") / 20)))
    assert sorted(rows(cut, "seq", "block", "code")) == sorted(rows(whole, "seq", "block", "code"))
    assert quantize.equal_frequency(df.filter("false"), ["tag"], "by", 3, F.floor("value")).count() == 0


def test_quantize_stream(spark, tmp_path):
    df = readings(spark, 50, 1)
    df.coalesce(1).write.parquet(str(tmp_path / "q"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "q"))
    processors.quantize_batches(stream, "tag", ["seq"], "value", str(tmp_path / "coded"), str(tmp_path / "cp"), 16, 4).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "coded"))
    assert out.count() == 50 and out.select("block").distinct().count() == 4
    assert rec.kalman().outputs == ("x", "p", "gain")
