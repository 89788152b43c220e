"""The registered model queries use the library defaults."""

import pytest

SF = "/root/testdata/sf0.001"


def test_model_queries_fit_library_defaults(spark, monkeypatch):
    from gaugeworks.operators import models
    from gaugeworks.plans import model_queries
    asked = []

    def stop(*args, **more):
        asked.append(more)
        raise InterruptedError

    runs = {"rf_regress": lambda: model_queries._surface(spark, SF, models.rf_regress), "gbt_regress": lambda: model_queries._nowcast(spark, SF, []),
            "rf_classify": lambda: model_queries._landcover(spark, SF), "gbt_calibrated": lambda: model_queries._boosted(spark, SF)}
    for name, run in runs.items():
        monkeypatch.setattr(models, name, stop)
        with pytest.raises(InterruptedError):
            run()
    assert len(asked) == 4 and not any({"trees", "depth"} & set(more) for more in asked)
