"""SQL of the smoother and of special functions, for the oracles of queries that use them."""

from __future__ import annotations

from drygrid.functions.special import ACKLAM_A, ACKLAM_B, ACKLAM_C, ACKLAM_D, ACKLAM_LOW, LARGE_SHAPE, TEMME_0, TEMME_1, TEMME_2


def smoother(source: str, value: str, lam: float, out: str = "curve") -> str:
    """Tables that end in ``out`` (cell_id, time, smoothed): the penalised smoother of ``value`` in the table ``source``.

    The banded system is eliminated day by day from the first to the last and solved back, one recursion each. Use in WITH RECURSIVE.
    """
    lam_ = f"{lam!r}::DOUBLE"
    coefficients = f"""sm_rows AS MATERIALIZED (SELECT cell_id, time, i, n, {value} AS y, CAST({value} IS NOT NULL AS DOUBLE) AS w,
  {lam_} * ((i <= n - 3)::INTEGER + 4 * (i BETWEEN 1 AND n - 2)::INTEGER + (i >= 2)::INTEGER) AS main,
  {lam_} * (-2 * (i <= n - 3)::INTEGER - 2 * (i BETWEEN 1 AND n - 2)::INTEGER) AS one, {lam_} * (i <= n - 3)::INTEGER AS two
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cell_id ORDER BY time) - 1 AS i, COUNT(*) OVER (PARTITION BY cell_id) AS n, COUNT({value}) OVER (PARTITION BY cell_id) AS known FROM {source}) WHERE known > 0 AND n >= 3)"""
    forward = """sm_fwd AS (SELECT cell_id, time, i, n, d, CASE WHEN d = 0 THEN one ELSE one / d END AS e, CASE WHEN d = 0 THEN two ELSE two / d END AS f, z, 0::DOUBLE AS pd, 0::DOUBLE AS pf, 0::DOUBLE AS pz
  FROM (SELECT *, w + main AS d, w * COALESCE(y, 0) AS z FROM sm_rows WHERE i = 0)
 UNION ALL
 SELECT cell_id, time, i, n, d, CASE WHEN i = n - 1 THEN 0 WHEN d = 0 THEN s ELSE s / d END, CASE WHEN d = 0 THEN two ELSE two / d END, z, pd, pf, pz FROM (
  SELECT r.cell_id, r.time, r.i, r.n, r.two, p.d AS pd, p.f AS pf, p.z AS pz,
   (w + main - p.e * p.e * p.d) - p.pf * p.pf * p.pd AS d, one - p.e * p.f * p.d AS s, (w * COALESCE(y, 0) - p.e * p.z) - p.pf * p.pz AS z
  FROM sm_fwd p JOIN sm_rows r ON r.cell_id = p.cell_id AND r.i = p.i + 1)),
sm_done AS MATERIALIZED (SELECT cell_id, time, i, n, e, f, CASE WHEN d = 0 THEN z ELSE z / d END AS z FROM sm_fwd)"""
    backward = """sm_back AS (SELECT cell_id, time, i, z, 0::DOUBLE AS nz FROM sm_done WHERE i = n - 1
 UNION ALL
 SELECT r.cell_id, r.time, r.i, r.z - (r.e * p.z + r.f * p.nz), p.z FROM sm_back p JOIN sm_done r ON r.cell_id = p.cell_id AND r.i = p.i - 1)"""
    whole = f"""{out} AS (SELECT cell_id, time, z AS smoothed FROM sm_back
 UNION ALL SELECT cell_id, time, CASE WHEN known > 0 THEN COALESCE(y, 0) END FROM (SELECT cell_id, time, {value} AS y, COUNT(*) OVER (PARTITION BY cell_id) AS n, COUNT({value}) OVER (PARTITION BY cell_id) AS known FROM {source}) WHERE known = 0 OR n < 3)"""
    return ", ".join((coefficients, forward, backward, whole))


def _series(shape: str, x: str) -> str:
    """The incomplete gamma ratio as the sum of x^(a + n) e^-x / Gamma(a + n + 1)."""
    return f"LIST_SUM(LIST_TRANSFORM(RANGE(0, CAST({x} + 14 * SQRT({x}) + 60 AS BIGINT)), lambda k: EXP(({shape} + k) * LN({x}) - {x} - LGAMMA({shape} + k + 1))))"


def _polynomial(coefficients: tuple[float, ...], x: str) -> str:
    """Coefficients from the constant up."""
    return " + ".join(f"{c!r}::DOUBLE * {x} ** {i}" for i, c in enumerate(coefficients))


def gamma_ratio(source: str, shape: str = "shape", x: str = "x", out: str = "g") -> str:
    """SELECT of all rows of ``source`` with ``out``, the gamma CDF of ``x`` / scale; large shapes take the uniform expansion, whose error function is a series too."""
    small = f"CASE WHEN {shape} <= {LARGE_SHAPE} AND {x} > 0 THEN {_series(shape, x)} END"
    half = f"SELECT *, ({x} - {shape}) / {shape} AS mu FROM {source}"
    parts = f"SELECT *, CASE WHEN {shape} > {LARGE_SHAPE} AND {x} > 0 THEN CASE WHEN ABS(mu) < 1e-3 THEN mu * mu * (1/2::DOUBLE - mu * (1/3::DOUBLE - mu * (1/4::DOUBLE - mu * (1/5::DOUBLE - mu * (1/6::DOUBLE - mu / 7))))) ELSE mu - LN(1 + mu) END END AS half FROM ({half})"
    near = f"SELECT *, {shape} * half AS u, GREATEST(LEAST(SIGN(mu) * SQRT(2 * half), 1), -1) AS eta FROM ({parts})"
    error = f"CASE WHEN half IS NULL THEN NULL WHEN u = 0 THEN 0 WHEN u > 40 THEN 1 ELSE {_series('0.5::DOUBLE', 'u')} END"
    large = (f"0.5 * (1 + SIGN(mu) * erf) - EXP(-u) / SQRT(2 * PI() * {shape}) * (({_polynomial(TEMME_0, 'eta')}) + ({_polynomial(TEMME_1, 'eta')}) / {shape} + ({_polynomial(TEMME_2, 'eta')}) / {shape} ** 2)")
    return f"SELECT * EXCLUDE (mu, half, u, eta, erf), CASE WHEN {x} = 0 THEN 0 WHEN half IS NULL THEN {small} ELSE {large} END AS {out} FROM (SELECT *, {error} AS erf FROM ({near}))"


def _horner(coefficients: tuple[float, ...], x: str, tail: float | None = None) -> str:
    total = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:] + (() if tail is None else (tail,)):
        total = f"({total} * {x} + {c!r}::DOUBLE)"
    return total


def normal_quantile(p: str) -> str:
    """Quantile of the standard normal distribution for 0 < p < 1."""
    low, high, q = f"SQRT(-2 * LN({p}))", f"SQRT(-2 * LN(1 - {p}))", f"({p} - 0.5)"
    r = f"({q} * {q})"
    return (f"CASE WHEN {p} < {ACKLAM_LOW!r} THEN {_horner(ACKLAM_C, low)} / {_horner(ACKLAM_D, low, 1.0)} WHEN {p} > {1 - ACKLAM_LOW!r} THEN -{_horner(ACKLAM_C, high)} / {_horner(ACKLAM_D, high, 1.0)} "
            f"ELSE {_horner(ACKLAM_A, r)} * {q} / {_horner(ACKLAM_B, r, 1.0)} END")


def digamma(x: str) -> str:
    y = f"({x} + 6)"
    return (f"(LN({y}) - 0.5 / {y} - (1 / ({y} * {y})) * (1 / 12::DOUBLE - (1 / ({y} * {y})) * (1 / 120::DOUBLE - (1 / ({y} * {y})) / 252))"
            + "".join(f" - 1 / ({x} + {i})" for i in range(6)) + ")")


def trigamma(x: str) -> str:
    y = f"({x} + 6)"
    inverse = f"(1 / ({y} * {y}))"
    return (f"(1 / {y} + {inverse} * 0.5 + {inverse} / {y} * (1 / 6::DOUBLE - {inverse} * (1 / 30::DOUBLE - {inverse} / 42))"
            + "".join(f" + 1 / (({x} + {i}) * ({x} + {i}))" for i in range(6)) + ")")
