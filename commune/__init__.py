"""commune: multi-level community detection with the CEIL score on Spark DataFrames."""

from commune.operators.graph import build_level
from commune.plans.detect import Result, compress, detect, local_moving
from commune.sources.edges import parse_edge_lines, read_edges

__all__ = ["Result", "build_level", "compress", "detect", "local_moving", "parse_edge_lines", "read_edges"]
