from .metrics import abs_distance, euclidean, resolve_metric

__all__ = ["abs_distance", "euclidean", "resolve_metric"]
