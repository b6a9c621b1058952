"""Boosted trees against a plain version that looks at every cut."""

import numpy as np

from stationqc.operators import boosting, models

NAMES = ["a", "b", "c"]


def frame(spark, seed=0, n=600):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 1)
    x[rng.random(n) < 0.1, 1] = np.nan
    y = ((x[:, 0] > 0.3) ^ (np.nan_to_num(x[:, 1], nan=9) > 0.5) ^ (rng.random(n) < 0.05)).astype(float)
    w = rng.choice([0.35, 1.0, 3.0], n)
    rows = [(*(None if np.isnan(v) else float(v) for v in r), float(t), float(u), bool(k % 10 == 0)) for k, (r, t, u) in enumerate(zip(x, y, w))]
    return spark.createDataFrame(rows, "a double, b double, c double, label double, weight double, held boolean"), x, y, w, np.arange(n) % 10 == 0


def plain(x, y, w, rounds, depth, rate, l2, least):
    """Scores after ``rounds`` trees; cuts between any two values, missing values on the right."""
    x = np.where(np.isnan(x), np.inf, x)
    base = np.log((y * w).sum() / ((1 - y) * w).sum())
    raw = np.full(len(y), base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = w * (p - y), w * p * (1 - p)
        part = lambda at: g[at].sum() ** 2 / (h[at].sum() + l2)

        def leaf(at, level):
            best = (1e-12, None)
            for f in range(x.shape[1]) if level < depth else []:
                for v in np.unique(x[at, f])[:-1]:
                    lo, hi = at[x[at, f] <= v], at[x[at, f] > v]
                    if min(len(lo), len(hi)) >= least and min(h[lo].sum(), h[hi].sum()) >= 1e-3 and part(lo) + part(hi) - part(at) > best[0] + 1e-9:
                        best = (part(lo) + part(hi) - part(at), (lo, hi))
            if best[1] is None:
                raw[at] += -rate * g[at].sum() / (h[at].sum() + l2)
            else:
                for side in best[1]:
                    leaf(side, level + 1)

        leaf(np.arange(len(y)), 0)
    return raw


def test_trees_equal_a_plain_version_in_one_block_and_in_many(spark):
    df, x, y, w, held = frame(spark)
    settings = {"rounds": 4, "depth": 3, "rate": 0.3, "l2": 1.0, "least": 20}
    keep = ~held
    want = plain(x[keep], y[keep], w[keep], **settings)
    for size in (1 << 20, 97):
        model = boosting.fit(df, NAMES, patience=0, block_rows=size, **settings)
        assert len(model.trees) == 4 and np.abs(model.raw(model.codes(x[keep])) - want).max() < 1e-8
    scored = df.select(model.probability(*NAMES).alias("p")).toPandas().p.to_numpy()
    assert np.abs(scored - 1 / (1 + np.exp(-model.raw(model.codes(x))))).max() < 1e-12


def test_scores_are_stored_anew_in_between(spark, monkeypatch):
    df, x, *_ = frame(spark, 3, 300)
    monkeypatch.setattr(boosting, "REFRESH", 2)
    one, many = (boosting.fit(df, NAMES, rounds=5, depth=2, least=10, block_rows=size) for size in (1 << 20, 80))
    assert len(one.trees) == len(many.trees) and np.abs(one.raw(one.codes(x)) - many.raw(many.codes(x))).max() < 1e-9


def test_it_stops_when_held_rows_gain_no_more_and_takes_odd_tables(spark):
    df, x, y, *_ = frame(spark)
    stopped = boosting.fit(df, NAMES, rounds=400, depth=3, rate=0.5, least=5, patience=6)
    assert 6 <= len(stopped.trees) < 200
    right = ((stopped.raw(stopped.codes(x)) > 0) == (y > 0)).mean()
    assert right > 0.9
    assert boosting.fit(df.limit(0), NAMES).trees == []
    same = boosting.fit(df.where("label = 1"), NAMES, rounds=3)
    assert (same.raw(same.codes(x)) > 10).all()


def test_the_autoencoder_stops_when_held_rows_gain_no_more_and_keeps_its_best():
    x = np.random.default_rng(4).normal(size=(600, 6))
    x[:, 3:] = x[:, :3] * 2
    short = models.Autoencoder(epochs=5, patience=6).fit(x)
    assert len(short.losses) == 5
    long = models.Autoencoder(epochs=80, patience=1).fit(x, rate=0.05)
    assert len(long.losses) < 80 and long.losses[-1] > min(long.losses) * (1 - 1e-4)
    held = np.clip(x, -10, 10)[np.random.default_rng(0).permutation(len(x))][:60]
    assert abs(((long._forward(held)[-1] - held) ** 2).mean() - min(long.losses)) < 1e-9


def test_many_blocks_are_grown_in_one_stage_and_more_in_jobs(spark, monkeypatch):
    df, x, *_ = frame(spark, 3, 300)
    settings = {"rounds": 5, "depth": 3, "least": 10}
    one = boosting.fit(df, NAMES, **settings)
    seen, group = spark.sparkContext.statusTracker(), spark.sparkContext
    jobs = []
    for held in (boosting.HELD, 0):  # blocks in tasks; blocks in the scratch folder
        monkeypatch.setattr(boosting, "HELD", held)
        group.setJobGroup(f"held {held}", "trees")
        many = boosting.fit(df, NAMES, block_rows=80, **settings)
        jobs.append(len(seen.getJobIdsForGroup(f"held {held}")))
        assert len(one.trees) == len(many.trees) and np.abs(one.raw(one.codes(x)) - many.raw(many.codes(x))).max() < 1e-9
    group.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] < 10 < jobs[1]
