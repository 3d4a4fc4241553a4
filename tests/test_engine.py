"""Closed forms, numpy kernels and defined edge cases of the signal operators."""

import io
import json
import math
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import checks, generators, scalars
from tidemark.functions.arrays import METRICS
from tidemark.operators import features, hmm, onsets, phase_space, segment, som, spectral
from tidemark.params import CorrDimParams, DftParams, PeakPickingParams, SegmentationParams, StftParams
from tidemark.sources import audio, sinks
from tidemark.streaming import windows


def signal(spark, x, name="a"):
    return spark.createDataFrame([(name, k, float(v)) for k, v in enumerate(x)], "series_id string, frame long, value double")


def column(df, order, name):
    return [r[name] for r in df.orderBy(order).collect()]


def by_formula(x, p, o, extend, pad):
    n, step, ext = len(x), p - o, p // 2 if extend else 0
    more = (-(n - p) % step) % p if pad else 0
    padded = np.r_[np.zeros(ext), x, np.zeros(ext + more)]
    return [padded[i * step : i * step + p].tolist() for i in range((n + 2 * ext + more - o) // step)]


@pytest.mark.parametrize(("n", "p", "o", "extend", "pad"), [(10, 4, 2, True, True), (10, 4, 2, False, False), (11, 4, 1, False, True), (23, 7, 3, True, False), (9, 9, 8, True, True), (50, 16, 1, True, True)])
def test_segmentation(spark, n, p, o, extend, pad):
    x = np.arange(1.0, n + 1)
    out = segment.segmentation(signal(spark, x), SegmentationParams(p, o, extend, pad))
    assert column(out, "seg", "data") == by_formula(x, p, o, extend, pad)
    first = out.orderBy("seg").first()
    assert first.hi - first.lo == p
    assert not extend or first.lo == -(p // 2)


def test_short_and_empty_series_have_no_segments(spark):
    assert segment.segmentation(signal(spark, [1.0, 2.0]), SegmentationParams(4, 2)).count() == 0
    assert segment.segmentation(signal(spark, []), SegmentationParams(4, 2)).count() == 0


@pytest.mark.parametrize(("hop", "want"), [(0, [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 0, 0]]), (4, [[0, 1, 2, 3], [4, 5, 6, 7]]), (3, [[0, 1, 2, 3], [3, 4, 5, 6], [6, 7, 8, 9]])])
def test_by_samples(spark, hop, want):
    assert column(segment.by_samples(signal(spark, range(10)), 4, hop), "seg", "data") == want


def test_by_onsets(spark):
    at = spark.createDataFrame([("a", 0, 8)], "series_id string, seg long, index long")
    assert column(segment.by_onsets(signal(spark, range(10)), 4, at), "seg", "data") == [[8, 9, 0, 0]]


def test_delay_embedding(spark):
    rows = segment.delay_embedding_frames(signal(spark, range(10)), 2, 3).orderBy("frame").collect()
    assert [r.vec for r in rows] == [[i, i + 2, i + 4] for i in range(6)]
    d = spark.range(1).select(phase_space.embedding_dists(F.array(*[F.lit(float(i)) for i in range(10)]), 2, 3).alias("d")).first().d
    assert np.allclose(d, [abs(i - j) * math.sqrt(3) for i in range(6) for j in range(i + 1, 6)])


@settings(max_examples=5, deadline=None)
@given(bin_=st.integers(1, 31), a=st.floats(0.1, 5))
def test_unit_spectrum_of_sinusoid(spark, bin_, a):
    data = F.array(*[F.lit(a * math.sin(2 * math.pi * bin_ * j / 64)) for j in range(64)])
    df = spark.range(1).select(F.lit("a").alias("series_id"), F.lit(0).alias("seg"), data.alias("data"))
    x = spectral.magnitudes(spectral.dft(df, DftParams(64, "rect", 64)), 64, 64)
    r = x.select("amp", features.spectral_centroid(F.col("frq"), F.col("amp")).alias("c"), features.spectral_spread(F.col("frq"), F.col("amp")).alias("s")).first()
    assert len(r.amp) == 33
    assert abs(r.amp[bin_] - a) < 1e-9
    assert abs(r.c - bin_) < 1e-6
    assert r.s < 1e-3


@pytest.mark.parametrize("window", ["rect", "hamming", "hann", "blackman"])
def test_expressions_equal_the_arrow_kernel(spark, window, monkeypatch):
    x = np.random.default_rng(1).normal(size=12)
    df = spark.range(1).select(F.lit("a").alias("series_id"), F.lit(0).alias("seg"), F.array(*map(F.lit, x.tolist())).alias("data"))
    for n_fft in (8, 16):
        a = spectral.dft(df, DftParams(1, window, n_fft)).first()
        monkeypatch.setattr(spectral, "EXPRESSIONS", 0)
        b = spectral.dft(df, DftParams(1, window, n_fft)).first()
        monkeypatch.setattr(spectral, "EXPRESSIONS", 16)
        assert np.allclose(a.re, b.re)
        assert np.allclose(a.im, b.im)


def test_unknown_window_and_parameters():
    with pytest.raises(ValueError, match="unknown window"):
        DftParams(44100, "nope")
    with pytest.raises(TypeError):
        DftParams("44100")
    with pytest.raises(ValueError, match="n_overlap"):
        SegmentationParams(4, 4)
    with pytest.raises(ValueError, match="unknown parameters"):
        CorrDimParams.from_dict({"delay": 14, "m_dim": 80, "extra": 1})
    p = StftParams(44100, "hamming", None, 1024, 512, True, True)
    assert StftParams.from_json(p.to_json()) == p


def test_levels(spark):
    a = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    r = spark.range(1).select(
        features.fspl_total(a(2e-5)).alias("q"), features.fspl_total(a(2e-4)).alias("w"), scalars.level(F.lit(0.0)).alias("l0"), scalars.level(F.lit(1e-10)).alias("l1"), features.spl(a(0, 0)).alias("s"), scalars.fti16(F.lit(1.0)).alias("i1"), scalars.fti16(F.lit(-1.0)).alias("i2")
    ).first()
    assert (round(r.q, 9), round(r.w, 9), round(r.l0, 9), round(r.l1, 9), r.s, r.i1, r.i2) == (0, 20, 0, 10, None, 32767, -32768)


def test_energy_refuses_nan(spark):
    df = spark.createDataFrame([([1.0, float("nan")],)], "data array<double>")
    with pytest.raises(Exception, match="finite"):
        df.select(features.energy(F.col("data"))).collect()


def test_flux(spark):
    df = spark.createDataFrame([("a", k, [v]) for k, v in enumerate([1.0, 3.0, 2.0])], "series_id string, seg long, amp array<double>")
    assert column(features.spectral_flux(df), "seg", "flux") == [2.0, 0.5, 0.0]


def peaks_by_hand(x, b, a, alpha, delta):
    out, g = [], 0.0
    for n, v in enumerate(x):
        near = [x[min(max(k, 0), len(x) - 1)] for k in range(n - b, n + a + 1)]
        if v >= max(near) and v >= sum(near) / len(near) + delta and v >= g:
            out.append(n)
        g = max(v, alpha * g + (1 - alpha) * v)
    return out


def test_peaks(spark):
    rng = np.random.default_rng(3)
    for x, p in (([0, 0, 5, 0, 0], PeakPickingParams(1, 1)), (rng.integers(0, 100, 100) + rng.random(100), PeakPickingParams()), ([1.0], PeakPickingParams())):
        odf = signal(spark, x).select("series_id", F.col("frame").alias("seg"), "frame", F.col("frame").cast("double").alias("time"), "value")
        got = [r.frame for r in onsets.pick(odf, p).where("is_peak").orderBy("frame").collect()]
        assert got == peaks_by_hand(list(map(float, x)), p.n_before, p.n_after, p.alpha, p.delta)


def test_evaluation(spark):
    t = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("y", 1.0)], "name string, time double")
    e = spark.createDataFrame([("x", 1.04), ("x", 1.03), ("z", 1.0)], "name string, time double")
    got = {r.name: (r.precision, r.recall) for r in onsets.evaluate_onsets(t, e).collect()}
    assert got == {"x": (0.5, 0.5), "y": (0.0, 0.0), "z": (0.0, 0.0)}


def test_equal_histograms_have_equal_entropies(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.permutation(np.repeat(np.arange(6.0), (18, 5, 3, 2, 1, 1))).tolist()) for k in range(40)]
    df = spark.createDataFrame(rows, "series_id long, data array<double>")
    assert len({r.h for r in df.select(phase_space.embedding_entropy(F.col("data"), 1, 1, 6).alias("h")).collect()}) == 1


def test_onsets_at_tied_entropies_are_evaluated_as_hits(spark):
    """Segment 1 has the values of segment 0 in another order, so it ties with it, and segment 2 has less entropy."""
    rng = np.random.default_rng(5)
    signals = {}
    for k in range(40):
        a, b = rng.permutation(np.repeat(np.arange(6.0), (9, 2, 2, 1, 1, 1))), rng.permutation(np.repeat(np.arange(6.0), (9, 3, 1, 1, 1, 1)))
        signals[k] = [*a, *b, *rng.permutation(a), *np.zeros(16)]
    signal = spark.createDataFrame([(k, j, float(v)) for k, x in signals.items() for j, v in enumerate(x)], "series_id long, frame long, value double")
    found = onsets.entropy_onsets(signal, 16, SegmentationParams(32, 16, False, False), PeakPickingParams(1, 1, 0.1, 0.01), m_dim=1, delay=1, n_bins=6)
    targets = spark.createDataFrame([(k, 2.0) for k in signals], "name long, time double")
    got = onsets.evaluate_onsets(targets, found.select(F.col("series_id").alias("name"), "time")).collect()
    assert sorted((r.name, r.precision, r.recall) for r in got) == [(k, 1.0, 1.0) for k in sorted(signals)]


def test_entropy_against_numpy(spark):
    x = np.random.default_rng(5).normal(size=60)
    got = spark.range(1).select(phase_space.embedding_entropy(F.array(*map(F.lit, x.tolist())), 3, 2, 6).alias("h")).first().h
    h, _ = np.histogramdd(np.stack([x[:-3], x[3:]], 1), 6)
    p = h[h > 0] / h.sum()
    assert abs(got + (p * np.log(p)).sum()) < 1e-9


def test_distances(spark):
    a, b, c = (F.array(*[F.lit(float(x)) for x in v]) for v in ([1, 0, 0], [0, 0.5, 0.5], [0, 1, 0]))
    r = spark.range(1).select(METRICS["hellinger"](a, b).alias("x"), METRICS["hellinger"](a, a).alias("y"), METRICS["cosine"](a, c).alias("z"), METRICS["chebyshev"](a, b).alias("w")).first()
    assert np.allclose(tuple(r), (1, 0, 1, 1))


def test_map(spark):
    w = spark.createDataFrame([(k, [0.0, 1.0, float(k)]) for k in range(25)], "unit long, w array<double>")
    u = np.array(column(som.umatrix(w, 5, 5), "unit", "value")).reshape(5, 5)
    assert u.max() == 1
    assert u[0, 0] == u[4, 4]
    obs = spark.createDataFrame([(0, [0.0, 1.0, 3.2]), (1, [0.0, 1.0, 3.5])], "id long, x array<double>")
    m = {r.id: (r.unit, r.second) for r in som.best_match(obs, w).collect()}
    assert m == {0: (3, 4), 1: (3, 4)}  # a tie goes to the lower number
    assert {r.nbr for r in som.von_neumann(spark, 3, 3).where("unit = 0").collect()} == {3, 1}
    assert som.decrease_linear(4, 3) == [4, 2.5, 1]
    assert som.decrease_expo(4, 3) == [4, 2, 1]


def test_batch_training_unfolds_the_map(spark):
    obs = generators.norm_circle(spark, 4, 30, 0.01, radius=5.0).select((F.monotonically_increasing_id()).alias("id"), F.array("x", "y").alias("x")).cache()
    _, errors = som.fit_batch(obs, 6, 6, 6, 3.0)
    assert errors[-1] < errors[1]  # a wide neighbourhood draws the map together; then it unfolds as the radius falls


def test_hmm_recovers_means(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.poisson(lam, 60) for lam in (5, 40, 5, 40)])
    df = spark.createDataFrame([("a", k, int(v)) for k, v in enumerate(x)], "series_id string, t long, n long")
    r = hmm.fit(df, 2).first()
    assert np.allclose(sorted(r.lam), [5, 40], rtol=0.15)
    assert np.allclose(np.sum(r.gamma, 1), 1)
    g = np.array([[0.8, 0.2], [0.2, 0.8]])
    assert np.allclose(hmm.stationary_distr(g), [0.5, 0.5])
    fit = hmm.baum_welch(x, np.array([4.0, 30.0]), g, np.array([0.5, 0.5]))
    assert (np.diff(fit["history"]) <= 1e-6).all()
    assert set(hmm.viterbi(x, fit["lam"], fit["gamma"], fit["delta"])) == {0, 1}


def test_lambda_quantile(spark):
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate([1, 2, 4, 9])], "series_id string, t long, n long")
    assert np.allclose(hmm.lambda_quantile(df, 2).first().lam, [1.75, 5.25])


def wav(x, fps, bits=16):
    body = (np.asarray(x) * 2 ** (bits - 1)).astype({16: "<i2", 32: "<i4"}[bits]).tobytes()
    ch = np.asarray(x).shape[1]
    head = struct.pack("<HHIIHH", 1, ch, fps, fps * ch * bits // 8, ch * bits // 8, bits)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(body)) + body


def test_wav(spark, tmp_path):
    x = np.round(np.random.default_rng(0).uniform(-1, 1, (50, 2)) * 1000) / 32768
    (tmp_path / "a.wav").write_bytes(wav(x, 8000))
    s = audio.read_wav(spark, str(tmp_path))
    got = np.array([r.value for r in s.orderBy("frame", "channel").collect()]).reshape(50, 2)
    assert np.allclose(got, x)
    m = audio.mono(s).orderBy("frame").collect()
    assert np.allclose([r.value for r in m], x.mean(1))
    cut = audio.read_frames(audio.mono(s), 10, 45).orderBy("frame").collect()
    assert np.allclose([r.value for r in cut], np.r_[x.mean(1)[45:], np.zeros(5)])
    info = audio.audio_info(spark, str(tmp_path)).first()
    assert (info.fps, info.n_frames, info.n_channels) == (8000, 50, 2)
    with pytest.raises(ValueError, match="RIFF"):
        audio.decode_wav(b"nothing")


def test_npy_json_and_csv(spark, tmp_path):
    buffer = io.BytesIO()
    np.save(buffer, np.arange(6.0).reshape(2, 3))
    (tmp_path / "a.npy").write_bytes(buffer.getvalue())
    r = audio.load_npy(spark, str(tmp_path)).first()
    assert (r["shape"], r["data"]) == ([2, 3], [0, 1, 2, 3, 4, 5])
    df = spark.createDataFrame([([1.0, float("nan")],)], "data array<double>")
    back = df.select(audio.decode_ndarray(audio.encode_ndarray(F.col("data"))).alias("x"), audio.decode_ndarray(F.lit('{"a": 1}')).alias("y")).first()
    assert back.x[0] == 1
    assert math.isnan(back.x[1])
    assert back.y is None
    f = spark.createDataFrame([(([1.0, 2.0, 3.0],), [7.0, 8.0])], "spec struct<a:array<double>>, b array<double>")
    rows = sinks.feature_rows(f)
    assert [tuple(r) for r in rows.collect()] == [(0, 1.0, 7.0), (1, 2.0, 8.0)]
    assert sinks.generate_outpath("/x/beat.wav", "/out", "feat") == "/out/beat.feat"


def test_streaming(spark, tmp_path):
    src = spark.sql("SELECT 'a' AS series_id, timestamp_seconds(id) AS ts, cast(id % 7 AS double) AS value FROM range(0, 120)")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = windows.windowed(stream, "20 seconds").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").count() == 6
    p = PeakPickingParams()
    q = windows.peak_threshold(stream, p).writeStream.outputMode("append").format("memory").queryName("p").start()
    q.processAllAvailable()
    q.stop()
    g, want = 0.0, []
    for v in [k % 7 for k in range(120)]:
        want.append(v >= g)
        g = max(v, p.alpha * g + (1 - p.alpha) * v)
    assert [r.above for r in spark.table("p").orderBy("ts").collect()] == want


def test_windows_in_closed_form():
    n = 9
    half = (n - 1) / 2
    t = [abs(i - half) / half for i in range(n)]
    forms = {
        "bartlett": [1 - x for x in t],
        "cosine": [math.sin(math.pi * (i + 0.5) / n) for i in range(n)],
        "lanczos": [float(np.sinc(x)) for x in t],
        "tukey": [1.0 if x <= 0.5 else 0.5 * (1 - math.cos(2 * math.pi * (1 - x))) for x in t],
        "hann": [math.sin(math.pi * i / (n - 1)) ** 2 for i in range(n)],
    }
    for name, want in forms.items():
        assert np.allclose(spectral.window(name, n, symmetric=True), want)
    for name in [*spectral.COSINES, *spectral.SHAPES]:
        w = np.array(spectral.window(name, 16, symmetric=True))
        assert np.allclose(w, w[::-1]) and abs(spectral.window(name, 17, symmetric=True)[8] - 1) < 2e-3
        assert np.allclose(spectral.window(name, 16), spectral.window(name, 17, symmetric=True)[:16])
        assert spectral.window(name, 1) == [1.0]
        DftParams(1, name)


def test_band_pass_edges_and_batches(spark):
    b, a = spectral.butter_bandpass(64.0, 4.0, 12.0)
    gain = lambda f: abs(np.polyval(b, np.exp(2j * np.pi * f / 64)) / np.polyval(a, np.exp(2j * np.pi * f / 64)))
    assert np.allclose([gain(4), gain(12)], math.sqrt(0.5)) and gain(7) > 0.999 and gain(1) < 0.01 and gain(25) < 0.01
    rng = np.random.default_rng(5)
    rows = [(f"s{k}", 0, rng.normal(size=n).tolist()) for k, n in enumerate((0, 1, 40, 64))]
    got = {r.series_id: r.data for r in spectral.bandpass_filter(spark.createDataFrame(rows, "series_id string, seg long, data array<double>").coalesce(1), 64.0, 4.0, 12.0).collect()}
    for name, _, x in rows:
        y = []
        for i in range(len(x)):
            y.append(sum(b[k] * x[i - k] for k in range(len(b)) if i >= k) - sum(a[k] * y[i - k] for k in range(1, len(a)) if i >= k))
        assert np.allclose(got[name], y)


def test_long_series_are_picked_in_linear_time(spark):
    odf = spark.range(200_000).select(F.lit("a").alias("series_id"), F.col("id").alias("seg"), F.col("id").alias("frame"), (F.col("id") / 10).alias("time"), (F.col("id") % 1000).cast("double").alias("value"))
    got = onsets.pick(odf, PeakPickingParams(3, 3, 0.1, 0.5)).where("is_peak").select("frame").collect()
    assert sorted(r.frame for r in got) == list(range(999, 200_000, 1000))


def test_fsplc_of_bins(spark):
    r = spark.range(1).select(features.fsplc(F.array(F.lit(1000.0), F.lit(50.0)), F.array(F.lit(0.02), F.lit(0.02))).alias("l")).first().l
    weight = lambda f: 148693636.0 * f * f / ((f * f + 148693636.0) * (f * f + 424.36))
    assert np.allclose(r, [20 * math.log10(weight(f) * 0.02 / 2e-5) for f in (1000.0, 50.0)])


def likelihood(x, lam, gamma, delta):
    """Summed over all sequences of states."""
    import itertools

    p = lambda n, v: math.exp(-v) * v**n / math.factorial(n)
    return sum(delta[s[0]] * math.prod(gamma[a][b] for a, b in itertools.pairwise(s)) * math.prod(p(n, lam[k]) for n, k in zip(x, s, strict=True)) for s in itertools.product(range(len(lam)), repeat=len(x)))


def test_hmm_score_sums_over_all_paths(spark):
    x, lam, gamma, delta = [3, 0, 7, 2, 9], [1.5, 6.0, 3.0], [[0.7, 0.2, 0.1], [0.3, 0.5, 0.2], [0.25, 0.25, 0.5]], [0.5, 0.2, 0.3]
    counts = spark.createDataFrame([("a", t, n) for t, n in enumerate(x)], "series_id string, t long, n long")
    model = spark.createDataFrame([("a", lam, gamma, delta)], "series_id string, lam array<double>, gamma array<array<double>>, delta array<double>")
    got = hmm.score(counts, model).first()
    assert math.isclose(got.log_likelihood, math.log(likelihood(x, lam, gamma, delta)), rel_tol=1e-9)
    import itertools

    best = max(itertools.product(range(3), repeat=5), key=lambda s: delta[s[0]] * math.prod(gamma[a][b] for a, b in itertools.pairwise(s)) * math.prod(math.exp(-lam[k]) * lam[k] ** n / math.factorial(n) for n, k in zip(x, s, strict=True)))
    assert got.states == list(best)


def test_hmm_fit_never_lowers_the_likelihood_and_takes_all_initial_values(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.poisson(v, 15) for v in (5, 30, 5)])
    fitted = hmm.baum_welch(x, np.array([4.0, 25.0]), np.array([[0.8, 0.2], [0.2, 0.8]]), np.array([0.5, 0.5]))
    assert all(b <= a + 1e-9 for a, b in zip(fitted["history"], fitted["history"][1:], strict=False))
    counts = spark.createDataFrame([("a", t, int(n)) for t, n in enumerate(x)], "series_id string, t long, n long")
    given = ((3.0, 40.0), ((0.9, 0.1), (0.2, 0.8)), (0.3, 0.7))
    options = [dict(init_lambda=given[0], init_gamma=given[1], init_delta=given[2]), dict(init_gamma="softmax", init_delta="softmax"), dict(init_gamma="dirichlet", gamma_dp=(4.0, 1.0), init_delta="dirichlet", delta_dp=(1.0, 1.0)), dict(init_lambda="linear", init_delta="uniform"), dict(init_lambda="hist")]
    for o in options:
        p = hmm.HmmParams(2, **o)
        r = hmm.fit(counts, p).first()
        assert r.success and np.allclose(sorted(r.lam), sorted(fitted["lam"]), rtol=1e-2) and np.allclose(np.sum(r.gamma, 1), 1)
    text = json.loads(hmm.models_json(hmm.fit(counts, p), p).first().model)
    assert text["hyper_params"]["init_lambda"] == "hist" and set(text) == {"hyper_params", "params", "quality", "success"}
    assert hmm.fit(counts, hmm.HmmParams(2, init_lambda="random", seed=3)).first().n_iter > 0


@pytest.mark.parametrize("bad", [dict(m_states=0), dict(m_states=2, init_lambda="x"), dict(m_states=2, init_lambda=(1.0,)), dict(m_states=2, init_lambda=(1.0, -1.0)), dict(m_states=2, init_gamma="dirichlet"), dict(m_states=2, init_delta="dirichlet"), dict(m_states=2, init_gamma=((0.5, 0.6), (0.5, 0.5))), dict(m_states=2, init_delta=(0.5, 0.6)), dict(m_states=2, fill_diag=2.0), dict(m_states=2, gamma_dp=(1.0,)), dict(m_states=2, fill_diag=None)])
def test_hmm_parameters_are_checked(bad):
    with pytest.raises(ValueError):
        hmm.HmmParams(**bad)


def test_hmm_refuses_negative_counts(spark):
    with pytest.raises(Exception, match="non-negative"):
        hmm.fit(spark.createDataFrame([("a", 0, -1), ("a", 1, 2)], "series_id string, t long, n long"), 1).collect()


def observations(spark, n=60, f=4, seed=2):
    x = np.random.default_rng(seed).random((n, f))
    return x, spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, x array<double>")


def test_pca_equals_singular_values(spark):
    x, obs = observations(spark)
    sv, comps, mean = som.pca(obs, 2)
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(sv, s[:2]) and np.allclose(mean, x.mean(0)) and np.allclose(np.abs((comps * vt[:2]).sum(1)), 1)


@pytest.mark.parametrize(("metric", "shape"), [("euclidean", "gaussian"), ("cityblock", "mexican"), ("cosine", "star"), ("canberra", "rect")])
def test_incremental_map_by_hand(spark, metric, shape):
    x, obs = observations(spark, 20)
    start = np.random.default_rng(4).random((6, 4))
    got = np.array([r.w for r in som.fit_incremental(obs, 2, 3, 3, 0.5, 1.5, metric=metric, nh_shape=shape, init=start).orderBy("unit").collect()])
    w, rng = start.copy(), np.random.RandomState(10)
    far = {"euclidean": lambda a, b: math.dist(a, b), "cityblock": lambda a, b: sum(abs(a - b)), "cosine": lambda a, b: 1 - a @ b / math.sqrt((a @ a) * (b @ b)), "canberra": lambda a, b: sum(abs(a - b) / (abs(a) + abs(b)))}[metric]
    near = {"gaussian": lambda a, b, r: math.exp(-(a * a + b * b) / (2 * r * r)), "mexican": lambda a, b, r: (1 - (a * a + b * b) / r**2) * math.exp(-(a * a + b * b) / (2 * r * r)), "star": lambda a, b, r: abs(a) + abs(b) <= r, "rect": lambda a, b, r: max(abs(a), abs(b)) <= r}[shape]
    for k in range(3):
        eta, r = 0.5 * (1 - k / 2), 1.5 * (1 / 1.5) ** (k / 2)
        for i in rng.permutation(20):
            best = min(range(6), key=lambda u: far(w[u], x[i]))
            for u in range(6):
                w[u] += eta * near(u // 3 - best // 3, u % 3 - best % 3, r) * (x[i] - w[u])
    assert np.allclose(got, w)


@pytest.mark.parametrize("shape", ["gaussian", "rect"])
def test_batch_map_by_hand(spark, shape):
    x, obs = observations(spark, 30)
    start = np.random.default_rng(4).random((6, 4))
    units, errors = som.fit_batch(obs, 2, 3, 3, 1.0, nh_shape=shape, init=start)
    w = start.copy()
    for k, r in enumerate(som.decrease_linear(1.0, 3)):
        d = np.linalg.norm(x[:, None] - w[None], axis=2)
        assert math.isclose(errors[k], d.min(1).mean(), rel_tol=1e-9)
        h = np.array([[math.exp(-((a // 3 - b // 3) ** 2 + (a % 3 - b % 3) ** 2) / (2 * r * r)) if shape == "gaussian" else float(max(abs(a // 3 - b // 3), abs(a % 3 - b % 3)) <= r) for b in range(6)] for a in range(6)])
        share = h[:, d.argmin(1)]
        hit = share.sum(1) > 0  # other units stay as they are
        w[hit] = (share @ x)[hit] / share.sum(1, keepdims=True)[hit]
    assert np.allclose([u.w for u in units.orderBy("unit").collect()], w)


def test_initial_weights_and_bad_options(spark):
    _, obs = observations(spark)
    for init in ("rnd", "hist", "stm", "pca"):
        units = som.fit_batch(obs, 2, 2, 1, 1.0, init=init)[0].collect()
        assert len(units) == 4 and all(len(u.w) == 4 for u in units)
    assert np.allclose([sum(u.w) for u in som.sample_hist(spark, 5, 4).collect()], 1)
    assert np.allclose([[sum(u.w[:2]), sum(u.w[2:])] for u in som.sample_stm(spark, 5, 4).collect()], 1)
    for bad in (dict(init="x"), dict(nh_shape="x"), dict(init=np.zeros((3, 4)))):
        with pytest.raises(ValueError):
            som.fit_batch(obs, 2, 2, 1, 1.0, **bad)
    with pytest.raises(ValueError):
        som.fit_incremental(obs, 2, 2, 1, 0.0, 1.0)


def test_metrics_equal_numpy(spark):
    from tidemark.functions.arrays import DISTANCES

    rng = np.random.default_rng(7)
    a, b = rng.random(6), rng.random(6)
    c = lambda v: F.array(*[F.lit(float(x)) for x in v])
    assert set(METRICS) == set(DISTANCES)
    got = spark.range(1).select(*[m(c(a), c(b)).alias(n) for n, m in METRICS.items()]).first()
    assert all(math.isclose(got[n], d(a[None], b)[0], rel_tol=1e-9) for n, d in DISTANCES.items())


def test_correlation_dimension_by_hand(spark):
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.integers(-300, 300, 90)).astype(float)
    got = phase_space.cdim(spark.createDataFrame([("a", 0, x.tolist()), ("b", 0, x[:20].tolist())], "series_id string, seg long, data array<double>"), 2, 3, 200, 10, vectors=80)
    emb = [[x[i + 2 * k] for k in range(3)] for i in range(80)]
    dists = [math.dist(emb[i], emb[j]) for i in range(80) for j in range(i, 80)]
    step = max(1, int(max(dists) / 1000))
    hist = [0] * 200
    for d in dists:
        at = 0 if d < 1 else (math.floor(d) - 1) // step + 1
        if d < 1 or at + 1 < 200:
            hist[at] += 1
    peak = max(range(120), key=lambda k: (hist[k], -k))
    end = min(peak + 10, 199)
    c = lambda k: math.log(sum(hist[: k + 1]) / len(dists))
    want = (c(end) - c(peak)) / (math.log(end * step + 1) - math.log(peak * step + 1))
    rows = {r.series_id: r.cdim for r in got.collect()}
    assert math.isclose(rows["a"], want, rel_tol=1e-9) and rows["b"] is None


def test_saved_arrays_and_maps_are_read_back(spark, tmp_path):
    sinks.save_npy(spark, np.arange(6.0).reshape(2, 3), f"{tmp_path}/a.npy")
    r = audio.load_npy(spark, str(tmp_path)).first()
    assert list(r["shape"]) == [2, 3] and r.data == [0, 1, 2, 3, 4, 5]
    units = spark.createDataFrame([(1, [3.0, 4.0]), (0, [1.0, 2.0])], "unit long, w array<double>")
    sinks.save_map(units, f"{tmp_path}/m.json", rows=2)
    assert sorted((u.unit, u.w) for u in sinks.load_map(spark, f"{tmp_path}/m.json").collect()) == [(0, [1.0, 2.0]), (1, [3.0, 4.0])]
    sinks.save_weights(units, f"{tmp_path}/w/w.npy")
    assert np.load(f"{tmp_path}/w/w.npy").tolist() == [[1.0, 2.0], [3.0, 4.0]]


def test_checks_and_sums(spark):
    checks.assert_array(np.zeros((2, 2)), 2, 4, 0, 1)
    for bad in ((np.zeros(3), 2, 3), (np.zeros(3), 1, 4), (np.full(3, -1), 1, 3, 0), (np.full(3, 2), 1, 3, 0, 1)):
        with pytest.raises(ValueError):
            checks.assert_array(*bad)
    assert checks.assert_and_pass(lambda v: None, 3) == 3 and checks.assert_and_pass(lambda v: 1 / 0, None) is None
    assert json.dumps([checks.jsonify(v) for v in (None, 1, "a", np.arange(2), np.float64(0.5), {1})]) == '[null, 1, "a", [0, 1], 0.5, "{1}"]'
    assert checks.time_stamp("%Y") == checks.time_stamp()[:4]
    values = [1e16, 1.0, -1e16, 3.0, 1e-3]
    assert math.isclose(spark.range(1).select(checks.fsum(F.array(*map(F.lit, values))).alias("s")).first().s, math.fsum(values), rel_tol=1e-15)
    schema = StftParams.json_schema()
    assert schema["required"] == ["fps"] and schema["properties"]["n_fft"]["type"] == ["integer", "null"] and not schema["additionalProperties"]
