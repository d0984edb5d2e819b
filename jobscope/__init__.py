"""jobscope: fleet-scale analytics over Apache Spark listener logs.

DataFrames in, DataFrames out.  Every table is keyed by ``log_id`` so one job
analyses any number of application logs at once.
"""

__version__ = "0.1.0"
