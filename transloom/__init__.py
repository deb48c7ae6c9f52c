"""transloom: bulk and streaming text translation written as Spark plans.

Requests, segments, translation memory, model replies, progress logs and
change feeds are DataFrames; the only Python in the hot path is the model
call itself, run per Arrow batch inside executors (``mapInPandas``).
"""

__version__ = "0.1.0"
