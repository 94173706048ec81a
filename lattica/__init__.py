"""Fixed-effects regression on Spark.

    from lattica import fit
    fit(df, "y ~ x1 i.x2 (x1 ~ z1), fe(a b) cluster(a)").summary()
"""

from lattica.plans.estimate import fit
from lattica.plans.spec import EstimationResult, FitOptions, ModelSpec

__all__ = ["EstimationResult", "FitOptions", "ModelSpec", "fit"]
