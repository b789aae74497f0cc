"""Display scalars of the list and board views (Q15)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hiretide import names
from hiretide.functions.expr import mapped


def title_case(value: Column) -> Column:
    words = F.filter(F.split(F.replace(value, F.lit("_"), F.lit(" ")), " "), lambda w: w != "")
    upper_first = F.transform(
        words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))
    )
    return F.array_join(upper_first, " ")


def compact_location(location: Column) -> Column:
    count = F.size(location)
    return (
        F.when(F.coalesce(count, F.lit(0)) < 1, F.lit("Unspecified"))
        .when(count == 1, F.get(location, F.lit(0)))
        .otherwise(F.concat(F.get(location, F.lit(0)), F.lit(" +"), (count - 1).cast("string")))
    )


def company_label(company: Column) -> Column:
    return F.coalesce(mapped(company, names.DISPLAY_NAMES), company)


def company_initials(company: Column) -> Column:
    words = F.filter(F.split(company_label(company), r"\s+"), lambda w: w != "")
    return F.upper(
        F.when(F.size(words) == 1, F.substring(F.get(words, F.lit(0)), 1, 2)).otherwise(
            F.array_join(F.transform(F.slice(words, 1, 2), lambda w: F.substring(w, 1, 1)), "")
        )
    )
