"""Bootstrap queries prepare the analysis set once, for the observed fit and for its replicates."""

import numpy as np
import pandas as pd

from survspan.catalog import models, resampling


def test_analysis_set_is_prepared_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    n = 400
    start = np.round(rng.exponential(3.0, n), 3)
    race = rng.integers(1, 4, n)
    pdf = pd.DataFrame({"id": [str(i // 4) for i in range(n)], "visit": [i % 4 + 1 for i in range(n)], "t_start": start,
                        "t_stop": start + np.round(rng.weibull(1.3, n) * 4, 3) + 0.001, "outcome": (rng.random(n) < 0.4).astype(int),
                        "sbp_group": 1, **{c: 0 for c in models.ADJUST}})
    for k in (2, 3):
        pdf[f"race_recode{k}"] = (race == k).astype(int)
    prepared = []

    def design_frame(spark, sf):
        prepared.append(sf)
        return spark.createDataFrame(pdf)

    for module in (models, resampling):
        monkeypatch.setattr(module, "design_frame", design_frame, raising=False)
    monkeypatch.setattr(models, "_FITS", {})
    bootstrap = resampling.resample.bootstrap_aft
    monkeypatch.setattr(resampling.resample, "bootstrap_aft", lambda *args: bootstrap(*args, reps=6))
    rows = resampling.q_boot_table_conventional(spark, "built").collect()
    assert [r["reps"] for r in rows] == [6] * 5 and {r["term"] for r in rows} == {"race_recode2", "race_recode3", "_cons"}
    assert prepared == ["built"]
