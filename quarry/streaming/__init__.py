"""Models and statistics kept up to date from a stream of rows."""

from quarry.streaming.incremental import fit_stream
from quarry.streaming.moments import running_moments, score_stream

__all__ = ["fit_stream", "running_moments", "score_stream"]
