"""Arithmetic on array<double> columns, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def product(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)
