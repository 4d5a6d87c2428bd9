"""Operators for large training-data pipelines. Nothing else in webdistill imports this subpackage."""
