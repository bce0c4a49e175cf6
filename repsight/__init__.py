"""repsight: pose time-series analytics on Spark.

Landmark frames and session control events in; joint angles, form checks,
repetition counts, sets, stored tables and per-set analytics out, in batch over
many sessions at once and incrementally with Structured Streaming.
"""

__version__ = "0.1.0"
