"""Span analytics on Spark: overlaps between spans and gaps between consecutive spans."""
