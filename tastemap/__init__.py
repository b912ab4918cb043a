"""tastemap: collaborative filtering on explicit ratings as Spark DataFrame jobs.

The service's jobs, for whole batches:

* train:      ``train_snapshot`` (ratings -> ALS -> run snapshot), ``Snapshot``
* recommend:  ``serve_recommendations`` or ``foldin`` + ``recommend``
* similar:    ``serve_similar`` or ``projected_units`` + ``similar_items``
* search:     ``search``
* quotas:     ``over_quota`` (batch), ``run_stream`` (Structured Streaming)
"""

__version__ = "0.1.0"

import sys as _sys  # noqa: E402

from pyspark import cloudpickle as _cloudpickle  # noqa: E402

# The pandas functions of this package reach Python workers pickled by value,
# so executors need no installed copy of the package (a cluster may still ship
# it with --py-files; then this only adds bytes to each task's function).
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from .operators.foldin import foldin  # noqa: E402
from .operators.recommend import enrich_recommendations, recommend  # noqa: E402
from .operators.search import search  # noqa: E402
from .operators.similar import enrich_similar, projected_units, similar_items  # noqa: E402
from .plans.jobs import Snapshot, serve_recommendations, serve_similar, train_snapshot  # noqa: E402
from .session import build_session  # noqa: E402
from .streaming.quota import over_quota, run_stream  # noqa: E402

__all__ = [
    "Snapshot", "build_session", "enrich_recommendations", "enrich_similar", "foldin",
    "over_quota", "projected_units", "recommend", "run_stream", "search",
    "serve_recommendations", "serve_similar", "similar_items", "train_snapshot",
]
