"""Simulation identities, metrics, bootstrap, folds, models and the panel's contract."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import labels as L
from tidegrid.operators import market as M
from tidegrid.operators import metrics as A
from tidegrid.operators import models as ML
from tidegrid.operators import portfolio as B
from tidegrid.plans import panel as P


def days(n, start=dt.date(2023, 1, 2)):
    return [start + dt.timedelta(days=i) for i in range(n)]


def prices(spark, n=60, names=6, seed=35):
    rng = np.random.default_rng(seed)
    rows = [(f"N{j}", d, float(p), float(p * 1.001), 1e9) for j in range(names) for d, p in zip(days(n), 50 * np.exp(np.cumsum(rng.normal(0, 0.02, n))), strict=True)]
    return spark.createDataFrame(rows, "ticker string, date date, adj_close_eur double, adj_open_eur double, adv_eur_21 double")


FREE = B.CostModel.flat(0.0)


def test_constant_score_is_buy_and_hold(spark):
    p = prices(spark)
    got = B.equity_of(B.run_backtest(p, B.constant_scores(p), k=6, cost=FREE, fill="close")).orderBy("date").toPandas()
    w = p.toPandas().pivot(index="date", columns="ticker", values="adj_close_eur")
    want = (w / w.iloc[0]).mean(axis=1) * B.CAPITAL
    assert np.abs(got.equity_eur.to_numpy(float) / want.to_numpy() - 1).max() < 1e-12


def test_simulation_steps(spark):
    p = prices(spark, 50)
    s = p.select(F.lit("m").alias("scenario"), "date", "ticker", F.pmod(F.xxhash64("ticker", F.dayofyear("date") % 21), F.lit(97)).cast("double").alias("score"))
    book = B.run_backtest(p, s, k=2, hold=10)
    trades, equity, held = (x.toPandas() for x in (B.trades_of(book), B.equity_of(book), B.positions_of(book)))
    assert (trades.date > trades.decided).all() and set(trades.side) == {"buy", "sell"} and len(equity) == 50
    assert held.groupby("date").size().max() <= 2 and equity.rebalance.sum() == 5
    worth = held.groupby("date").value_eur.sum()
    for r in equity.itertuples():
        assert r.equity_eur == pytest.approx(r.cash_eur + worth.get(r.date, 0.0))
    rate = B.CostModel().rates(np.array([1e9]))[0]
    assert trades.cost_eur.to_numpy(float) == pytest.approx(trades.value_eur.to_numpy(float) * rate)


def plain_book(rows, scores, k, hold, rate_of, reweight, fill, start=None, end=None):
    """The portfolio rules name by name, with dicts: rows are {(date, ticker): (close, open, adv)}."""
    axis = sorted({d for d, _ in rows if d >= (start or min(d for d, _ in scores)) and (end is None or d <= end)})
    names = sorted({t for _, t in rows})
    last, adv = {}, {}
    for d, t in sorted(rows):  # what is known before the axis
        if d < axis[0]:
            last.update({t: rows[d, t][0]} if rows[d, t][0] is not None else {})
            adv.update({t: rows[d, t][2]} if rows[d, t][2] is not None else {})
    cash, held, waiting, equity, trades = B.CAPITAL, {}, [], [], []

    def do(day, side, t, amount, price, rate, decided):
        nonlocal cash
        if side == "sell":
            shares = min(amount, held[t])
            held[t] -= shares
            if amount >= shares and held[t] <= 0:
                del held[t]
            cash += shares * price * (1 - rate)
        else:
            shares = amount / (price * (1 + rate))
            held[t] = held.get(t, 0.0) + shares
            cash -= amount
        trades.append((day, t, side, shares, price, shares * price * rate, decided))

    for i, d in enumerate(axis):
        for t in names:
            close, _, a = rows.get((d, t), (None, None, None))
            if close is not None:
                last[t] = close
            if a is not None:
                adv[t] = a
        for side in ("sell", "buy"):
            for o in [o for o in waiting if o[0] == side and rows.get((d, o[1]), (None, None, None))[1] is not None]:
                waiting.remove(o)
                do(d, *o[:3], rows[d, o[1]][1], o[3], o[4])
        if i % hold == 0:
            unscored = {t for t in held if (d, t) not in scores}
            able = [t for t in names if (d, t) in scores and (rows.get((d, t), (None,))[0] is not None or (t in held and t in last))]
            keep = unscored | set(sorted(able, key=lambda t: (-scores[d, t], t))[: max(0, k - len(unscored))])
            orders, part = [], (cash + sum(n * last[t] for t, n in held.items())) / max(1, len(keep))
            for t, n in held.items():
                if t not in keep:
                    orders.append(("sell", t, n))
                elif reweight and n * last[t] > part:
                    orders.append(("sell", t, (n * last[t] - part) / last[t]))
            money = cash + sum(n * last[t] * (1 - rate_of(adv.get(t))) for _, t, n in orders)
            if reweight:
                want = {t: part - held.get(t, 0.0) * last.get(t, 0.0) for t in keep if part > held.get(t, 0.0) * last.get(t, 0.0)}
            else:
                want = {t: 1.0 for t in keep if t not in held}
            if want and money > 0:
                share = money / sum(want.values())
                orders += [("buy", t, w * (min(1.0, share) if reweight else share)) for t, w in want.items()]
            orders = [(s, t, x, rate_of(adv.get(t)), d) for s, t, x in orders]
            if fill == "close":
                for s, t, x, r, _ in sorted(orders, key=lambda o: o[0] != "sell"):
                    do(d, s, t, x, last[t], r, d)
            else:
                waiting = orders
        cash = 0.0 if abs(cash) < 1e-9 * B.CAPITAL else cash
        equity.append((d, cash + sum(n * last[t] for t, n in held.items()), cash, len(held)))
    return equity, trades


@pytest.mark.parametrize("fill", ["open", "close"])
@pytest.mark.parametrize("reweight", [False, True])
@pytest.mark.parametrize("few", [1_000_000, 0])
def test_books_match_the_rules_name_by_name(spark, monkeypatch, fill, reweight, few):
    """With missing closes, opens, values and scores, and ties; prices broadcast, then dealt to the books."""
    monkeypatch.setattr(B, "BROADCAST_ROWS", few)
    rng = np.random.default_rng(4)
    rows, scores = {}, {}
    for j in range(9):
        p = 50 * np.exp(np.cumsum(rng.normal(0, 0.03, 70)))
        for d, x in zip(days(70), p, strict=True):
            if rng.random() < 0.85:
                rows[d, f"N{j}"] = (float(x) if rng.random() < 0.95 else None, float(x * 1.01) if rng.random() < 0.8 else None, float(rng.choice([1e6, 3e7, 1e9])) if rng.random() < 0.6 else None)
            if rng.random() < 0.7 and d >= days(70)[6]:
                scores[d, f"N{j}"] = float(rng.integers(0, 5))
    frame = spark.createDataFrame([(t, d, *x) for (d, t), x in rows.items()], "ticker string, date date, adj_close_eur double, adj_open_eur double, adv_eur_21 double")
    scored = spark.createDataFrame([(n, d, t, x) for n in ("m", "other") for (d, t), x in scores.items()], "scenario string, date date, ticker string, score double")
    rate = lambda a: float(B.CostModel().rates(np.array([np.nan if a is None else a]))[0])
    for start, end in ((None, None), (days(70)[10], days(70)[55])):
        want, traded = plain_book(rows, scores, 3, 5, rate, reweight, fill, start, end)
        got = B.run_backtest(frame, scored, k=3, hold=5, reweight=reweight, fill=fill, start=start, end=end).where("scenario = 'm'").persist()
        mine = sorted((r.date, r.equity_eur, r.cash_eur, r.n_names) for r in B.equity_of(got).collect())
        assert [x[0] for x in mine] == [x[0] for x in want] and [x[3] for x in mine] == [x[3] for x in want]
        assert np.array([x[1:3] for x in mine]) == pytest.approx(np.array([x[1:3] for x in want]), rel=1e-9, abs=1e-6)
        fills = sorted((r.date, r.ticker, r.side, r.shares, r.price_eur, r.cost_eur, r.decided) for r in B.trades_of(got).collect())
        traded = sorted(x for x in traded if x[3] > 0)
        assert [(*x[:3], x[6]) for x in fills] == [(*x[:3], x[6]) for x in traded]
        assert np.array([x[3:6] for x in fills]) == pytest.approx(np.array([x[3:6] for x in traded]), rel=1e-8)


def test_baselines_share_one_axis(spark):
    p = prices(spark, 60)
    bench = p.where("ticker = 'N0'").withColumn("ticker", F.lit("BENCH"))
    momentum = p.where(F.col("date") >= days(60)[30]).select("ticker", "date", F.col("adj_close_eur").alias("mom_12_1"))
    rules = dict(k=2, hold=7, start=days(60)[20], end=days(60)[50])
    e = B.equity_of(B.baselines(p, bench, momentum, seeds=3, **rules)).toPandas()
    assert set(e.scenario) == {"benchmark", "equal_weight_hold", "equal_weight_rebalanced", "momentum", "random_0", "random_1", "random_2"}
    assert e.groupby("scenario").date.agg(list).map(tuple).nunique() == 1 and len(e) == 7 * 31
    with pytest.raises(ValueError):
        B.baselines(p, p.where("ticker = 'N0'"), momentum, seeds=1, **rules)


def test_rules_that_cannot_be_raise(spark):
    p = prices(spark, 5)
    for bad in ({"k": 0}, {"hold": 0}, {"capital": 0.0}, {"fill": "noon"}):
        with pytest.raises(ValueError):
            B.run_backtest(p, B.constant_scores(p), **bad)


def test_costs(spark):
    c = B.CostModel()
    adv = [1e9, 5e7, 1e3, float("nan"), 0.0]
    got = spark.createDataFrame([(a,) for a in adv[:3]] + [(None,), (0.0,)], "adv double").select(c.rate_column(F.col("adv")).alias("r")).collect()
    assert [r.r for r in got] == pytest.approx(c.rates(np.array(adv)).tolist()) and c.rates(np.array(adv))[0] == pytest.approx(15e-4) and c.rates(np.array(adv))[2] == pytest.approx(105e-4)


def test_scenarios_are_independent_and_costs_bite(spark):
    p = prices(spark, 45)
    s = B.random_scores(p, 3)
    alone = B.equity_of(B.run_backtest(p, s.where("scenario = 'random_1'"), k=2)).orderBy("date").collect()
    together = B.equity_of(B.run_backtest(p, s, k=2)).where("scenario = 'random_1'").orderBy("date").collect()
    assert alone == together
    sweep = B.equity_of(B.run_backtest(p, B.cost_sweep(s.where("scenario = 'random_1'"), [0, 50]), k=2, hold=5)).groupBy("scenario").agg(F.max_by("equity_eur", "date").alias("e"))
    ends = {r.scenario: r.e for r in sweep.collect()}
    assert ends["random_1@50.0"] < ends["random_1@0.0"]


# ---- metrics ----------------------------------------------------------------------------------


def test_year_fraction(spark):
    cases = [(dt.date(2020, 2, 29), dt.date(2021, 2, 28), 1.0), (dt.date(2023, 1, 1), dt.date(2024, 7, 1), 1 + 182 / 366), (dt.date(2023, 3, 1), dt.date(2023, 3, 31), 30 / 366)]
    df = spark.createDataFrame([c[:2] for c in cases], "a date, b date").select(A.year_fraction_column(F.col("a"), F.col("b")).alias("y"))
    for (a, b, want), got in zip(cases, df.collect(), strict=True):
        assert A.year_fraction(a, b) == pytest.approx(want) == pytest.approx(got.y)


def test_bootstrap_by_blocks_is_the_plain_bootstrap(spark):
    n, block = 100, 21
    x = np.random.default_rng(1).normal(0.0005, 0.01, n)
    line = spark.createDataFrame([(d, float(v)) for d, v in zip(days(n), x, strict=True)], "date date, excess double")
    starts = A.block_starts(n, resamples=50, block=block)
    got = A.bootstrap_moments(line, A.starts_table(spark, n, resamples=50, block=block), n, ["excess"], block).orderBy("replicate").toPandas()
    for r, s in zip(got.itertuples(), starts, strict=True):
        sample = np.concatenate([x[(b + np.arange(block)) % n] for b in s])[:n]
        assert r.mean_excess == pytest.approx(sample.mean(), abs=1e-14) and r.std_excess == pytest.approx(sample.std(ddof=1))
    assert A.hashed_starts(spark, n, 10).count() == 50
    both = A.sharpe_intervals(line, A.starts_table(spark, n, resamples=20), n, ["excess"]).first()
    assert both.low <= both.high and both.series == "excess"
    same = A.bootstrap_difference(line.withColumn("b", F.col("excess")), A.starts_table(spark, n, resamples=20), n, "excess", "b").first()
    assert same.low == same.high == 0.0


def test_summary_with_a_gap_in_excess(spark):
    r = spark.createDataFrame([("s", d, 100.0 + i, 0.01 * (-1) ** i if i else None, None if i == 3 else 0.001) for i, d in enumerate(days(6))], "series string, date date, value double, ret double, excess double")
    row = A.summary(r).first()
    assert row.sharpe is None and row.hit_rate == pytest.approx(2 / 5) and row.vol is not None


def test_turnover_skips_the_first_decision(spark):
    t = spark.createDataFrame([("s", days(9)[0], 100.0), ("s", days(9)[4], 50.0)], "series string, decided date, value_eur double")
    e = spark.createDataFrame([("s", d, 100.0) for d in days(9)], "series string, date date, equity_eur double")
    assert A.turnover(t, e).first().turnover == pytest.approx(50 / 2 / 100 * 252 / 8)


# ---- folds and models -------------------------------------------------------------------------


def test_folds_are_purged():
    axis = days(60)
    ends = {d: axis[i + 5] if i + 5 < 60 else L.OPEN_END for i, d in enumerate(axis)}
    folds = L.walk_forward_splits(axis, ends, min_train=20, test=10, embargo=5, horizon=5)
    assert [f[0] for f in folds] == list(range(len(folds)))
    for _, train, test in folds:
        assert max(ends[d] for d in train) < test[0] and len(train) >= 20
    with pytest.raises(ValueError):
        L.walk_forward_splits(axis, ends, min_train=20, test=10, embargo=4, horizon=5)


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    rows = []
    for d in days(40):
        for j in range(8):
            a, b = rng.random(2)
            rows.append((d, f"N{j}", float(a), float(b), float(0.7 * a - 0.2 * b + 0.05 * rng.normal())))
    return spark.createDataFrame(rows, "date date, ticker string, a double, b double, target double").persist()


def test_ridge_from_sums_is_ridge(spark, frame):
    axis = days(40)
    folds = [(0, axis[:30], axis[30:])]
    pred, coefs = ML.ridge_walk_forward(frame, L.fold_table(spark, folds), ["a", "b"], alpha=1.0)
    t = frame.toPandas()
    tr = t[t.date < axis[30]]
    x, y = tr[["a", "b"]].to_numpy(), tr.target.to_numpy()
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ yc)
    got = {r.feature: r.value for r in coefs.collect()}
    assert [got["a"], got["b"]] == pytest.approx(w.tolist()) and pred.count() == 80
    assert ML.coefficient_table(coefs).where("feature = 'a'").first().positive == 1.0


def test_classifier_and_calibration(spark, frame):
    f = frame.withColumn("target", (F.col("target") > 0.25).cast("double"))
    m = ML.model("logit", ["a", "b"]).fit(f)
    p = m.predict(f)
    s = ML.probability_scores(p, "score").first()
    assert s.auc > 0.9 and s.n == 320
    for kind in ("isotonic", "platt", "none"):
        out = ML.calibrate(p, p, kind)
        assert ML.probability_scores(out, f"prob_{kind}").first().brier <= s.brier + 1e-3
    bins = ML.reliability(ML.calibrate(p, p, "isotonic"), "prob_isotonic")
    assert ML.calibration_check(bins).first().ece < 0.02
    with pytest.raises(ValueError):
        ML.model("logit", ["a", "b"]).fit(frame)
    with pytest.raises(KeyError):
        ML.model("nothing", ["a"])
    early, late = ML.calibration_split(days(10), {d: d + dt.timedelta(days=2) for d in days(10)})
    assert late == days(10)[6:] and early == days(10)[:4]


def test_pruning_and_fairness(spark, frame):
    f = frame.withColumn("c", F.col("a") * 2)
    corr = ML.rank_correlation(f, ["a", "b", "c"])
    assert ML.correlation_prune(corr, ["a", "b", "c"]) == [("a", None), ("b", None), ("c", "a")]
    chosen = [{"name": n, "use": "model", "why": "x"} for n in ("a", "c")] + [{"name": "z", "use": "?", "why": ""}]
    assert ML.check_selection(chosen, ["a", "b", "c"], corr) == ["b: not decided", "z: use '?'", "z: no reason", "a and c: correlation 1.000"]
    twin = frame.select("date", "ticker", F.col("a").alias("score"))
    assert {(r.overlap, round(r.ic, 9)) for r in ML.head_to_head(twin, twin, 3).collect()} == {(1.0, 1.0)}
    share = dict(ML.explained_share(f, ["a", "b", "c"]))
    assert share["c"] == pytest.approx(1.0) and share["b"] < 0.1


def test_ten_checks_of_fairness(spark):
    rows = [(k, days(8)[2 * k + i], f"N{j}", 0.1 * j, 1.0) for k in range(3) for i in range(2) for j in range(3)]
    table = lambda rows: spark.createDataFrame(rows, "fold int, date date, ticker string, score double, target double")
    failed = lambda a, b: {r.check for r in ML.fairness(table(a), table(b)).collect() if not r.passed}
    assert ML.fairness(table(rows), table(rows)).count() == 10 and failed(rows, rows) == set()
    assert failed(rows, rows + rows[:1]) == {"unique", "coverage"}
    assert failed(rows, [(0 if k == 1 else 1 if k == 0 else k, *x) for k, *x in rows]) == {"folds", "order"}
    assert failed(rows, [(*x[:3], float("nan"), x[4]) if i == 4 else x for i, x in enumerate(rows)]) == {"scores"}
    assert failed(rows, [(*x[:4], 2.0) if i == 4 else x for i, x in enumerate(rows)]) == {"targets"}
    assert failed(rows, [x for x in rows if x[2] != "N1"]) == {"rows", "targets", "names", "coverage"}
    assert failed(rows, [x for x in rows if x[1] != days(8)[5]]) == {"rows", "folds", "targets", "axis", "span", "coverage"}
    assert failed(rows, [x for x in rows if x[1] != days(8)[3]]) == {"rows", "folds", "targets", "axis", "coverage"}


def test_panel_ranks_match_the_windows(spark):
    from tidegrid.operators.frames import cross_rank, cross_zscore

    rng = np.random.default_rng(2)
    rows = [(d, f"N{j}", float(rng.integers(0, 6)) if rng.random() < 0.9 else None, float(rng.normal()) if rng.random() < 0.8 else float("nan"), 3.0) for d in days(30) for j in range(int(rng.integers(8, 16)))]
    df = spark.createDataFrame(rows, "date date, ticker string, ret_1d double, mom_12_1 double, vol_21d double").repartition(5)
    cols, key = ["ret_1d", "mom_12_1", "vol_21d"], "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "17")
    try:
        got = P.normalise(df, cols).orderBy("date", "ticker").toPandas()
    finally:
        spark.conf.unset(key)
    want = df.select("date", "ticker", *[f(F.col(c)).alias(f"{c}_{n}") for c in cols for n, f in (("rank", cross_rank), ("z", cross_zscore))]).orderBy("date", "ticker").toPandas()
    for c in want.columns[2:]:
        a, b = got[c].to_numpy(float), want[c].to_numpy(float)
        assert (np.isnan(a) == np.isnan(b)).all() and np.nanmax(np.abs(a - b)) < 1e-12, c


# ---- market data and panel --------------------------------------------------------------------


def test_adjustment_by_hand(spark):
    d = days(6)
    b = spark.createDataFrame([("A", x, c) for x, c in zip(d, [100.0, 100.0, 50.0, 50.0, 49.0, 50.0], strict=True)], "ticker string, date date, close double")
    acts = spark.createDataFrame([("A", d[2], "split", 2.0), ("A", d[4], "dividend", 1.0), ("A", d[0], "dividend", 9.0), ("A", d[3], "split", 1.1)], "ticker string, date date, action string, value double")
    vis = {r.date: (r.ambiguous, r.in_bars) for r in M.split_visibility(b, acts).collect()}
    assert vis == {d[2]: (False, True), d[3]: (True, False)}
    got = [r.adj_close for r in M.adjust(b, acts).orderBy("date").collect()]
    assert got == pytest.approx([49.0, 49.0, 49.0, 49.0, 49.0, 50.0])
    big = acts.where("value = 1.0").withColumn("value", F.lit(60.0))
    with pytest.raises(Exception, match="dividend of the price"):
        M.adjust(b, big).collect()


def test_panel_contract():
    assert len(P.COLUMNS) == 151 == len(set(P.COLUMNS)) and len(P.FEATURES) == 52 and len(P.COMPARABLE) == 46
    reg = {r["name"]: r for r in P.registry()}
    assert list(reg) == P.COLUMNS and reg["slope_sma_50"]["window"] == 55 and reg["mom_12_1_sec_z"]["window"] == 252 and reg["vol_63d_rank"]["direction"] == "negative" and reg["tradable"]["kind"] == "flag"
    assert math.isclose(A.familywise_level(0.95, 10), 0.995)


def test_panel_update_equals_build(spark):
    rng = np.random.default_rng(31)
    axis = [d for d in days(90) if d.weekday() < 5]
    rows = []
    for j in range(12):
        p = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, len(axis))))
        rows += [(f"T{j:02d}", d, x * 0.99, x * 1.02, x * 0.98, x, 1e5, x, x, x) for d, x in zip(axis, map(float, p), strict=True)]
    px = spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double, adj_close double, close_eur double, adj_close_eur double")
    ls = spark.createDataFrame([(f"T{j:02d}", "V", f"S{j % 3}") for j in range(12)], "ticker string, venue string, sector string")
    sessions = spark.createDataFrame([("V", d) for d in axis], "venue string, date date")
    bench = px.groupBy("date").agg(F.avg("close").alias("bench"))
    args = px, sessions, ls, bench
    full = P.build(*args, as_of=axis[-1])
    old = P.build(*args, as_of=axis[-6])
    spoiled = old.withColumn("ret_1d", F.when(F.col("date") > axis[-9], F.lit(9.0)).otherwise(F.col("ret_1d")))
    new = P.update(spoiled, P.registry_digest(), *args, as_of=axis[-1])
    cols = ["date", "ticker", "ret_1d", "vol_21d", "mom_12_1_rank", "rsi_14", "ret_5d_z"]
    a, b = (x.select(cols).orderBy("date", "ticker").toPandas() for x in (full, new))
    assert full.columns == P.COLUMNS and len(a) == 12 * len(axis) and a.astype(str).equals(b.astype(str))
    with pytest.raises(ValueError):
        P.update(old, "other", *args, as_of=axis[-1])
    with pytest.raises(ValueError):
        P.update(full, P.registry_digest(), *args, as_of=axis[-6])
