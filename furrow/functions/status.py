"""Status of a run, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The classes a validator may reject a run for.
REJECTION_CLASSES = ("empty_path", "discontinuous_endpoints", "collision", "curvature_limit", "reverse_without_gear", "outside_area", "forbidden_crossing", "coverage_threshold", "nonfinite_metric")
#: Statuses that the algorithm-selection exchange format knows.
EXCHANGE_STATUSES = ("ok", "timeout", "memout", "not_applicable", "crash")
#: Statuses of a pipeline run that keep their name in the corpus.
NAMED_STATUSES = ("ok", "timeout", "memout", "crash", "invalid_input")
#: Statuses of a pipeline run that mean that a configuration doesn't apply.
INAPPLICABLE = ("unsupported", "infeasible", "infeasible_kinematics", "not_applicable")
_PREFIX = "validator_rejected:"


def rejection_class(reason: Column) -> Column:
    """The class in a validator's rejection; null for other reasons; an error for a class that isn't known."""
    name = F.substring(reason, len(_PREFIX) + 1, 1 << 20)
    known = F.when(name.isin(*REJECTION_CLASSES), name).otherwise(F.raise_error(F.concat(F.lit("unknown rejection class: "), name)))
    return F.when(reason.startswith(_PREFIX), known)


def derived_status(runstatus: Column, reason: Column) -> Column:
    """A validator's rejection counts before the runtime's status."""
    return F.coalesce(rejection_class(reason), runstatus)


def exchange_status(status: Column) -> Column:
    return F.when(status.isin(*EXCHANGE_STATUSES), status).otherwise(F.lit("other"))


def corpus_status(status: Column, reason: Column, headland: Column, turning_radius: Column) -> Column:
    """The corpus's name for a pipeline run's status.

    A violated constraint is not applicable where there is no headland and the vehicle can't turn in place, else
    the class that the validator told; an unknown status is an error.
    """
    rejected = F.when((headland == "no_headland") & (turning_radius > 0), F.lit("not_applicable")).otherwise(F.coalesce(rejection_class(reason), F.raise_error(F.lit("a violated constraint without a class"))))
    named = F.when(status.isin(*NAMED_STATUSES), status).when(status.isin(*INAPPLICABLE), F.lit("not_applicable"))
    named = named.when(status.isin("collision", "numerical_error"), status).when(status == "constraint_violation", rejected)
    return named.otherwise(F.raise_error(F.concat(F.lit("unknown status: "), status)))
