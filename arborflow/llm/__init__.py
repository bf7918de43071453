"""Operators for training-data pipelines. Nothing else in the library imports this package.

Executors import these modules by name, so the package must be on their path
(``--py-files`` or an installed wheel on a cluster).
"""
