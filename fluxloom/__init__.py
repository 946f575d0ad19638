"""fluxloom: a Spark-native engine for declarative change-data pipelines.

Pipelines are described as data (sources, row steps, targets) and evaluated as
DataFrame plans.  Every operator takes and returns DataFrames, so Catalyst sees
the whole plan, in batch and in Structured Streaming alike.
"""

__version__ = "0.1.0"
