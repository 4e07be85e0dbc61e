from commune.sources.edges import EDGE_SCHEMA, ScanResult, classify, edges_to_lines, parse_edge_lines, read_edges

__all__ = ["EDGE_SCHEMA", "ScanResult", "classify", "edges_to_lines", "parse_edge_lines", "read_edges"]
