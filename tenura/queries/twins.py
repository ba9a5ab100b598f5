"""Building blocks of the SQL twins."""

from __future__ import annotations

from collections.abc import Sequence

from tenura.plans.accounts import accounts_sql

ACC = f"WITH {accounts_sql()}"


def long_sql(source: str, columns: Sequence[str], keep: str = "churn AS y", cast: str = "DOUBLE") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS variable, CAST({c} AS {cast}) AS v, {keep} FROM {source} WHERE {c} IS NOT NULL"
        for c in columns
    )


def auc_ctes(source: str = "long", keys: str = "variable") -> str:
    """CTEs mr, ti, auc(keys, n, n_pos, n_neg, auc, u, z) from source(keys, v, y)."""
    return f"""mr AS (SELECT {keys}, v, y, rank() OVER (PARTITION BY {keys} ORDER BY v)
        + (count(*) OVER (PARTITION BY {keys}, v) - 1) / 2.0 AS rk FROM {source} WHERE y IS NOT NULL),
    ti AS (SELECT {keys}, CAST(sum(t * t * t - t) AS DOUBLE) AS ties FROM
        (SELECT {keys}, v, CAST(count(*) AS DOUBLE) AS t FROM mr GROUP BY {keys}, v) GROUP BY {keys}),
    us AS (SELECT {keys}, count(*) AS n, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg,
        CAST(coalesce(sum(rk) FILTER (y = 1), 0) AS DOUBLE) - CAST(count(*) FILTER (y = 1) AS DOUBLE)
          * (count(*) FILTER (y = 1) + 1) / 2.0 AS u FROM mr GROUP BY {keys}),
    auc AS (SELECT us.*, CASE WHEN n_pos > 0 AND n_neg > 0 THEN u / (CAST(n_pos AS DOUBLE) * n_neg) END AS auc,
        CASE WHEN n_pos > 0 AND n_neg > 0 THEN greatest(0, abs(u - CAST(n_pos AS DOUBLE) * n_neg / 2.0) - 0.5)
          / sqrt(CAST(n_pos AS DOUBLE) * n_neg / 12.0 * (n + 1.0 - ties / (CAST(n AS DOUBLE) * (n - 1)))) END AS z
        FROM us JOIN ti USING ({keys}))"""


def binary_chi2_ctes(levels: str = "lv", keys: str = "variable", yates: bool = True, name: str = "chi") -> str:
    """CTE chi(keys, n, lignes, ddl, chi2, v_cramer) from levels(keys, niveau, n, pos)."""
    shrink = "CASE WHEN lignes = 2 AND colonnes = 2 THEN least(0.5, abs(o - e)) ELSE 0 END" if yates else "0"
    return f"""{name}_t AS (SELECT {keys}, CAST(sum(n) AS DOUBLE) AS nn, CAST(sum(pos) AS DOUBLE) AS pp,
        count(*) AS lignes, CASE WHEN sum(pos) > 0 AND sum(pos) < sum(n) THEN 2 ELSE 1 END AS colonnes
        FROM {levels} GROUP BY {keys}),
    {name}_g AS (SELECT {keys}, nn, lignes, colonnes, CAST(pos AS DOUBLE) AS o, n * pp / nn AS e
        FROM {levels} JOIN {name}_t USING ({keys}) UNION ALL
        SELECT {keys}, nn, lignes, colonnes, CAST(n - pos AS DOUBLE), n * (nn - pp) / nn
        FROM {levels} JOIN {name}_t USING ({keys})),
    {name} AS (SELECT {keys}, CAST(max(nn) AS BIGINT) AS n, max(lignes) AS lignes,
        (max(lignes) - 1) * (max(colonnes) - 1) AS ddl,
        CASE WHEN max(lignes) > 1 AND max(colonnes) > 1 THEN sum(power(abs(o - e) - {shrink}, 2) / e) ELSE 0 END AS chi2,
        CASE WHEN max(lignes) > 1 AND max(colonnes) > 1 THEN
          sqrt(sum(power(abs(o - e) - {shrink}, 2) / e) / (max(nn) * 1)) ELSE 0 END AS v_cramer
        FROM {name}_g WHERE e > 0 GROUP BY {keys})"""


def levels_sql(source: str, columns: Sequence[str], target: str = "churn") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS variable, CAST({c} AS VARCHAR) AS niveau, count(*) AS n, "
        f"CAST(sum({target}) AS BIGINT) AS pos FROM {source} WHERE {c} IS NOT NULL AND {target} IS NOT NULL GROUP BY {c}"
        for c in columns
    )


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    z = "CAST(1.959963984540054 AS DOUBLE)"
    p = f"(CAST({k} AS DOUBLE) / {n})"
    den = f"(1 + {z} * {z} / {n})"
    centre = f"({p} + {z} * {z} / (2 * {n})) / {den}"
    margin = f"{z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4 * CAST({n} AS DOUBLE) * {n})) / {den}"
    return f"greatest(0, {centre} - {margin})", f"least(1, {centre} + {margin})"
