"""SQL text of the distribution functions, for the SQL twins of the tests that need them."""

from __future__ import annotations

from tidemill.functions import distributions as d


def poly(x: str, coefficients) -> str:
    out = f"{float(coefficients[0])!r}::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * ({x}) + ({float(c)!r}::DOUBLE))"
    return out


def ppf(p: str) -> str:
    """Normal quantile of a column name."""
    q = f"({p} - 0.5)"
    rc = f"(0.180625 - {q} * {q})"
    root = f"sqrt(-ln(CASE WHEN {q} <= 0 THEN {p} ELSE 1 - {p} END))"
    side = (
        f"CASE WHEN {root} <= 5 THEN {poly(f'{root} - 1.6', d.MIDDLE_NUM)} / {poly(f'{root} - 1.6', d.MIDDLE_DEN)} "
        f"ELSE {poly(f'{root} - 5', d.TAIL_NUM)} / {poly(f'{root} - 5', d.TAIL_DEN)} END"
    )
    return (
        f"CASE WHEN ABS({q}) <= 0.425 THEN {q} * {poly(rc, d.CENTRE_NUM)} / {poly(rc, d.CENTRE_DEN)} "
        f"WHEN {q} < 0 THEN -({side}) ELSE ({side}) END"
    )


def cdf(z: str) -> str:
    """Normal distribution function of a column name."""
    x = f"ABS({z})"
    b = f"({x} + 0.65)"
    for k in (4, 3, 2, 1):
        b = f"({x} + {k}e0 / {b})"
    e = f"exp(-({z}) * ({z}) / 2e0)"
    near = f"{e} * {poly(x, d.WEST_NUM)} / {poly(x, d.WEST_DEN)}"
    tail = f"CASE WHEN {x} > 37 THEN 0e0 WHEN {x} < 7.07106781186547 THEN {near} ELSE {e} / {b} / 2.506628274631 END"
    return f"CASE WHEN ({z}) > 0 THEN 1e0 - ({tail}) ELSE ({tail}) END"
