"""Impression-log feature building, sampling, batch scoring and ranking evaluation on Spark."""
