"""Edge sources, sinks and generators."""
