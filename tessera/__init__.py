"""tessera — incident analytics as Spark DataFrame jobs.

Every operator is a function ``DataFrame -> DataFrame`` written with the public
Spark SQL / MLlib / Structured Streaming API.  See README.md for the layout.
"""

from tessera.session import get_spark, checkpoint_dir, scratch_path

__all__ = ["get_spark", "checkpoint_dir", "scratch_path"]
