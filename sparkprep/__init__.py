"""sparkprep: profile, restructure, clean, score and standardise tables on Spark.

Every operator takes a DataFrame and returns a DataFrame (or a handful of
statistics), so pipelines are ordinary DataFrame code that Catalyst plans.
"""
