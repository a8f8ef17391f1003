"""Evaluation analytics on Spark: what changed between a base model and its edited versions.

Tables in (items, predictions, activations, token likelihoods, probe responses, weights,
run results), audit tables out.  Every operator takes and returns DataFrames.
"""

from pyspark import cloudpickle

from remnant.functions import kernels as _kernels

# The NumPy helpers travel to executors inside the serialized task, so a cluster needs no
# separate installation of this package on its workers.
cloudpickle.register_pickle_by_value(_kernels)
