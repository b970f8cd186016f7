"""Contracts of tables, checked in the pass that makes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.errors import ContractViolation


def guarded(rows: DataFrame, broken: Column, message: str) -> DataFrame:
    """rows; reading one for which `broken` holds is an error that names the contract's code."""
    return rows.where(F.when(broken, F.raise_error(F.lit(f"{ContractViolation.code}: {message}")).cast("boolean")).otherwise(F.lit(True)))
