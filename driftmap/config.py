"""Settings of a run, checked when made."""

from __future__ import annotations

from dataclasses import dataclass

LAPLACIANS = ("symmetric", "random_walk", "plain")


@dataclass(frozen=True)
class Settings:
    """The defaults reproduce the observed behaviour; see ``README.md`` for what each switch corrects."""

    neighbours_kept: int = 1000
    neighbours_used: int = 1000
    keep_diagonal: bool = False
    shift_by_mean: bool = True
    divide_by_std: bool = True
    inner_norm: str = "total"
    laplacian: str = "symmetric"
    kernel_sign: int = -1
    diagonal: str = "one"
    which: str = "largest"
    eigenpairs: int = 10
    tau: float | str = 0.5
    column_batches: int = 1

    def __post_init__(self):
        for name in ("neighbours_kept", "neighbours_used", "eigenpairs", "column_batches"):
            value = getattr(self, name)
            if not isinstance(value, int) or isinstance(value, bool) or value < 1:
                raise ValueError(f"{name} must be a positive integer")
        for name in ("keep_diagonal", "shift_by_mean", "divide_by_std"):
            if not isinstance(getattr(self, name), bool):
                raise ValueError(f"{name} must be a boolean")
        if self.neighbours_used > self.neighbours_kept:
            raise ValueError("neighbours_used can't be more than neighbours_kept")
        if self.tau != "auto" and not (isinstance(self.tau, float) and self.tau > 0):
            raise ValueError("tau must be a positive float or 'auto'")
        for name, allowed in (("inner_norm", ("total", "masked")), ("laplacian", LAPLACIANS), ("kernel_sign", (-1, 1)), ("diagonal", ("one", "zero", "keep")), ("which", ("largest", "smallest"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}")

    @property
    def mode(self) -> str:
        return {(True, True): "pearson", (True, False): "covariance", (False, True): "normalized", (False, False): "inner"}[self.shift_by_mean, self.divide_by_std]

    @property
    def columns_stored(self) -> int:
        """The match of a pattern with itself takes one place."""
        return self.neighbours_kept + (not self.keep_diagonal)
