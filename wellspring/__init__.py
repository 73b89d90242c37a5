"""wellspring: chat, journal and account analytics as whole-table Spark jobs.

Every operator is a function ``DataFrame(s) -> DataFrame`` that works for all
users at once.  Nothing is collected to the driver; small fixed dimensions
(hotlines, mood scores, keyword lists) are literal maps inside expressions, a
dimension table is broadcast only behind a row-count check, and all keyed work
runs through Spark shuffles, aggregates and windows.
"""

from wellspring.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
