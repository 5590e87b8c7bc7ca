"""tastemap: interest profiling and news recommendation as Spark DataFrame plans.

Every public function takes and returns DataFrames (or Columns); nothing is
collected to the driver except bounded results (a vocabulary of at most
``n_topics * vocab_multiplier`` terms, model metadata).
"""

from tastemap.config import Params, DEFAULT_PARAMS

__all__ = ["Params", "DEFAULT_PARAMS"]
