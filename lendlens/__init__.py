"""Instalment-credit risk analytics as Spark DataFrame jobs.

Operators are functions from DataFrame to DataFrame. What has to be learned from data
(levels, medians, scales, coefficients) is fitted first and then applied as a projection.
"""

__version__ = "0.1.0"
