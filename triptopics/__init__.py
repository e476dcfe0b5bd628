"""triptopics: Spark-native trip-topic analytics.

Trips -> flows and sparse tensors -> passenger documents -> graph-regularised
tensor topic models -> evaluation and mining, each step a plain
``DataFrame -> DataFrame`` function.
"""

__version__ = "0.1.0"
