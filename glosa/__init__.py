"""glosa — comment analytics on Spark.

Text features, lookup joins, stratified folds, Spark ML model search,
fold ensembles and evaluation tables, all expressed as DataFrame plans.
"""

__version__ = "0.1.0"
