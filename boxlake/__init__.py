"""Analytics over image annotations and detections, written for Spark."""
