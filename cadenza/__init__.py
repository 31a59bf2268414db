"""Bulk recommendation, catalogue and comment-moderation jobs as Spark DataFrames."""
