"""The three pipelines, composed of operators."""
