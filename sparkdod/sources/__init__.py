from .points import lines_from_table, parse_points, points_from_table, read_text_points
from .sinks import window_outlier_lines, write_lines, write_result

__all__ = ["parse_points", "read_text_points", "points_from_table", "lines_from_table",
           "window_outlier_lines", "write_result", "write_lines"]
