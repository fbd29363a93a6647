"""Record- and text-processing operators on Spark DataFrames.

Scalar operators are ``Column -> Column`` (``weir.functions``), relational ones
``DataFrame -> DataFrame`` (``weir.operators``, ``weir.streaming``), so that both
compose with ``DataFrame.transform`` and leave the physical plan to Catalyst.
"""

from __future__ import annotations

import os
import shutil
import tempfile


def ship(spark) -> None:
    """Sends this package to the executors of a running session, for clusters where it isn't installed or given by ``--py-files``."""
    home = os.path.dirname(os.path.abspath(__file__))
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="weir-"), "weir"), "zip", os.path.dirname(home), os.path.basename(home))
    spark.sparkContext.addPyFile(made)
