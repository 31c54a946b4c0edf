"""Structured Streaming use of the stateless operators.

The reference has no streams.  Tokenising, rule scoring, nearest-centre
assignment and similarity scoring are row-local, so they run unchanged on a
``readStream`` source; this package wires them to a checkpointed sink.
"""

from labelprism.streaming.score_stream import *  # noqa: F401,F403
