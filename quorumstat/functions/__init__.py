"""Column functions shared by every operator."""

from .core import (  # noqa: F401
    chi2_95,
    corr,
    div,
    mean_abs,
    nan_to_null,
    normal,
    norm_p_two_sided,
    r4,
    r6,
    replicates,
    seconds,
    u01,
    with_row,
)
