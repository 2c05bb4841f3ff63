"""Panel analytics as DataFrame -> DataFrame functions on Spark.

The engine works on *panels*: one row per (entity, period), with measures as
columns, and on the prediction and attribution tables derived from them.
"""

__version__ = "0.1.0"
