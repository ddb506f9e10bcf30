"""Code frequencies kept up to date over a stream of observations."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyloom.operators.describe import code_frequencies


def stream_frequencies(observations: DataFrame) -> DataFrame:
    """``code_frequencies`` of a streaming table; write it in update or complete mode.

    State is one row of four counts per code, so it grows with the codes, not with the rows.
    """
    if not observations.isStreaming:
        raise ValueError("observations aren't a stream")
    return code_frequencies(observations)
