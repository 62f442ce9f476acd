"""Operators for large-scale training-data pipelines.

One module per operator, `queries` and `oracles` for the driver contract. Nothing outside this
subpackage imports it.
"""
