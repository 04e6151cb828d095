"""SQL text for least-squares twins: successive orthogonalization in windows."""

from __future__ import annotations


def ols_ctes(src: str, y: str, xs: list[str], tag: str, center: bool = True, keep: str = "") -> str:
    """CTEs ending in ``{tag}`` with columns y, r1..rk (orthogonal regressors)."""
    k = len(xs)
    extra = f", {keep}" if keep else ""
    mid = (lambda c: f"({c})-avg({c}) OVER ()") if center else (lambda c: f"({c})")
    out = [f"{tag}0 AS (SELECT {mid(y)} AS y, " + ", ".join(f"{mid(x)} AS r{i + 1}" for i, x in enumerate(xs)) + f"{extra} FROM {src})"]
    for i in range(1, k):
        cols = ", ".join(f"r{j + 1}" if j < i else f"r{j + 1}-r{i}*(sum(r{j + 1}*r{i}) OVER ()/sum(r{i}*r{i}) OVER ()) AS r{j + 1}" for j in range(k))
        out.append(f"{tag}{i} AS (SELECT y, {cols}{extra} FROM {tag}{i - 1})")
    out.append(f"{tag} AS (SELECT * FROM {tag}{k - 1})")
    return ", ".join(out)


def ols_term(src: str, y: str, xs: list[str], term: str, tag: str, center: bool = True) -> tuple[str, str]:
    """(ctes, select) of coef, se, t for one term, put last in the order."""
    order = [x for x in xs if x != term] + [term]
    k = len(xs)
    ssr = "sum(y*y)" + "".join(f"-pow(sum(y*r{i + 1}),2)/sum(r{i + 1}*r{i + 1})" for i in range(k))
    df = f"(count(*)-{k + (1 if center else 0)})"
    ctes = ols_ctes(src, y, order, tag, center)
    sel = f"SELECT sum(y*r{k})/sum(r{k}*r{k}) AS coef, sqrt(({ssr})/{df}/sum(r{k}*r{k})) AS se, count(*) AS n FROM {tag}"
    return ctes, sel


def ols_sql(head: str, src: str, y: str, xs: list[str], method: str, digits: int = 4, names: dict[str, str] | None = None) -> str:
    """Coefficient table (method, term, coef, se, t_stat), one row per term."""
    ctes, rows = [], []
    for i, x in enumerate(xs):
        c, sel = ols_term(src, y, xs, x, f"t{i}_")
        ctes.append(c)
        rows.append(f"SELECT '{method}' AS method, '{(names or {}).get(x, x)}' AS term, round(coef,{digits}) AS coef, round(se,{digits}) AS se, "
                    f"round(coef/se,{digits}) AS t_stat FROM ({sel})")
    return f"WITH {head}, " + ", ".join(ctes) + " " + " UNION ALL ".join(rows)
