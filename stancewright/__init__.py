"""Stance labelling and label evaluation for social-media posts on Spark.

Import the layer you need:

- ``stancewright.sources``    readers, writers, model directories
- ``stancewright.functions``  column expressions
- ``stancewright.operators``  DataFrame -> DataFrame steps
- ``stancewright.plans``      whole jobs made of those steps
- ``stancewright.streaming``  the stateless steps over a stream
"""

__version__ = "0.1.0"
