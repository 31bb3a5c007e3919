"""terrapanel: governed panel analytics on Spark.

Every operator is a function from DataFrame(s) to a lazy DataFrame; keys,
bounds and tolerances come from the dataset registry (``terrapanel.registry``).
"""

from terrapanel.registry import DATASETS, Dataset, dataset
from terrapanel.session import checkpoint_dir, get_spark

__all__ = ["DATASETS", "Dataset", "dataset", "checkpoint_dir", "get_spark"]
