"""Severities as ranks and back."""
from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}
SEVERITIES = list(SEVERITY_RANK)
SEVERITY_NUMBER = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}


def lookup(table: dict, key: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.try_element_at(pairs, key)


def severity_rank(severity: Column) -> Column:
    """4 for critical down to 0; unknown counts as 0."""
    return F.coalesce(lookup(SEVERITY_RANK, severity), F.lit(0))


def severity_to_int(severity: Column) -> Column:
    """5 for critical down to 1; unknown is 0."""
    return F.coalesce(lookup(SEVERITY_NUMBER, F.lower(severity)), F.lit(0))


def int_to_severity(number: Column) -> Column:
    return F.coalesce(lookup({v: k for k, v in SEVERITY_NUMBER.items()}, number), F.lit("info"))


def meets(severity: Column, threshold: str) -> Column:
    return severity_rank(severity) >= SEVERITY_RANK.get(threshold, 0)
