"""Streaming form of the edge-list scan.

The detection itself is a batch computation over a bounded graph (as is the
behaviour being matched): communities are recomputed from a complete edge set. What
streams is the input: new edge files landing in a folder are parsed with exactly the
batch scan rules, and can be appended to an edge table that a later batch run reads.
"""

from commune.streaming.edges import edge_stream

__all__ = ["edge_stream"]
