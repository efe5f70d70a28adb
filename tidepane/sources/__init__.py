from tidepane.sources.arrivals import arrivals, rejected
from tidepane.sources.lines import line_arrivals, number_lines, parse_lines, read_lines

__all__ = ["arrivals", "line_arrivals", "number_lines", "parse_lines", "read_lines", "rejected"]
