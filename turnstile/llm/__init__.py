"""Operators for training-data pipelines; nothing outside imports them but
``__spark_entry__.py``, if this subpackage is there."""
