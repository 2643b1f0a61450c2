"""SQL forms of the segment, general, tail and quantile models, for the checks."""

from __future__ import annotations

LINE = """CASE WHEN vaa * voo - vao * vao > 1e-9 * vaa * voo
              THEN (cay * voo - coy * vao) / (vaa * voo - vao * vao)
              WHEN voo = 0 AND vaa > 0 THEN cay / vaa ELSE 0 END AS b_age,
         CASE WHEN vaa * voo - vao * vao > 1e-9 * vaa * voo
              THEN (coy * vaa - cay * vao) / (vaa * voo - vao * vao)
              WHEN voo > 0 THEN coy / voo ELSE 0 END AS b_odometer,
         my - b_age * ma - b_odometer * mo AS intercept"""
MOMENTS = """count(*) AS n, avg(price) AS my, avg(age) AS ma, avg(odometer) AS mo, var_pop(age) AS vaa,
         var_pop(odometer) AS voo, covar_pop(age, odometer) AS vao, covar_pop(age, price) AS cay,
         covar_pop(odometer, price) AS coy"""


def lines(source: str, keys: str = "make, model", name: str = "lines") -> str:
    group = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""
{name}_moments AS (SELECT {lead}{MOMENTS} FROM {source} {group}),
{name} AS (SELECT {lead}n, {LINE} FROM {name}_moments)"""


def specific(source: str) -> str:
    """CTEs ``lines`` and ``effects`` of the segment models."""
    return (
        lines(source)
        + f""",
effects AS (SELECT make, model, region,
                   sum(price - (intercept + b_age * age + b_odometer * odometer)) / (count(*) + 20) AS effect
            FROM {source} JOIN lines USING (make, model) GROUP BY make, model, region)"""
    )


def general(source: str) -> str:
    """CTEs ``pooled``, ``make_effects`` and ``model_effects`` of the general model."""
    rest = "price - (p.intercept + p.b_age * age + p.b_odometer * odometer)"
    return (
        lines(source, "", "pooled")
        + f""",
make_effects AS (SELECT make, sum({rest}) / (count(*) + 20) AS make_effect FROM {source}, pooled p GROUP BY make),
model_effects AS (SELECT make, model, sum({rest} - make_effect) / (count(*) + 20) AS model_effect
                  FROM {source} JOIN make_effects USING (make), pooled p GROUP BY make, model)"""
    )


def predicted(source: str, name: str = "predicted") -> str:
    """CTE with ``s_n``, ``specific`` and ``general`` next to the source's columns."""
    return f"""
{name} AS (
  SELECT f.*, l.n AS s_n, l.intercept AS s_intercept, l.b_age AS s_b_age, l.b_odometer AS s_b_odometer,
         l.intercept + l.b_age * f.age + l.b_odometer * f.odometer + coalesce(e.effect, 0) AS specific,
         coalesce(e.effect, 0) AS s_effect,
         p.intercept + p.b_age * f.age + p.b_odometer * f.odometer + coalesce(make_effect, 0)
           + coalesce(model_effect, 0) AS general
  FROM {source} f LEFT JOIN lines l USING (make, model) LEFT JOIN effects e USING (make, model, region)
       LEFT JOIN make_effects USING (make) LEFT JOIN model_effects USING (make, model), pooled p)"""


def gate(source: str, minimum: int, name: str, counted: str | None = None) -> str:
    """CTE with the source's rows of segments that have ``minimum`` rows in ``counted``, the source itself by default."""
    return f"""
{name} AS (SELECT * FROM {source} SEMI JOIN (SELECT make, model FROM {counted or source} GROUP BY ALL
           HAVING count(*) >= {minimum}) USING (make, model))"""


def ridge(source: str, keys: str = "make, model", name: str = "ridges", alpha: float = 1.0) -> str:
    """CTE with the ridge on age and distance: the normal equations with alpha added to both squares."""
    return f"""
{name}_moments AS (SELECT {keys}, {MOMENTS} FROM {source} GROUP BY {keys}),
{name} AS (SELECT {keys}, n,
     ((n * cay) * (n * voo + {alpha}) - (n * coy) * (n * vao))
       / ((n * vaa + {alpha}) * (n * voo + {alpha}) - (n * vao) * (n * vao)) AS b_age,
     ((n * coy) * (n * vaa + {alpha}) - (n * cay) * (n * vao))
       / ((n * vaa + {alpha}) * (n * voo + {alpha}) - (n * vao) * (n * vao)) AS b_odometer,
     my - b_age * ma - b_odometer * mo AS intercept FROM {name}_moments)"""


def bagged(source: str) -> str:
    """CTE ``bags``: the mean of the ridges that each leave one of five folds out."""
    return f"""
folded AS (SELECT *, ('0x' || substr(md5('42|' || listing_id), 1, 8))::BIGINT % 5 AS fold FROM {source}),
without AS (SELECT f.* EXCLUDE (fold), k.fold AS left_out FROM folded f
            JOIN (SELECT DISTINCT make, model, fold FROM folded) k
            ON f.make = k.make AND f.model = k.model AND f.fold <> k.fold),
{ridge("without", "make, model, left_out", "fold_ridges")},
bags AS (SELECT make, model, count(*) AS folds, avg(intercept) AS intercept, avg(b_age) AS b_age,
                avg(b_odometer) AS b_odometer FROM fold_ridges GROUP BY ALL)"""


WEIGHT = "CASE WHEN coalesce(s_n, 0) < 50 THEN 0.0 WHEN s_n >= 200 THEN 1.0 ELSE (s_n - 50) / 150.0 END"
BLENDED = f"coalesce({WEIGHT} * specific + (1 - {WEIGHT}) * general, specific, general)"

ROBUST = """
centre AS (SELECT make, model, median(price) AS mp, median(km_per_year) AS mk FROM {source} GROUP BY ALL),
spread AS (SELECT make, model, median(abs(price - mp)) AS dp, median(abs(km_per_year - mk)) AS dk
           FROM {source} JOIN centre USING (make, model) GROUP BY ALL),
flagged AS (SELECT f.*, greatest(coalesce(0.6745 * abs(price - mp) / nullif(dp, 0), 0),
                                 coalesce(0.6745 * abs(km_per_year - mk) / nullif(dk, 0), 0)) > 3.5 AS is_outlier
            FROM {source} f JOIN centre USING (make, model) JOIN spread USING (make, model))"""


def robust(source: str = "features") -> str:
    """CTE ``flagged``: the source with ``is_outlier`` by the robust rule."""
    return ROBUST.format(source=source)


def quantile_columns() -> str:
    levels = {"q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9}
    return ", ".join(f"quantile_cont(price, {p}) AS {q}" for q, p in levels.items())


def quantiles(source: str, fitted: str | None = None) -> str:
    """CTE ``with_q``: the source with the quantiles of its leaf, segment or everything among ``fitted`` rows."""
    picks = ", ".join(
        f"CASE WHEN lf.leaf_n >= 10 THEN lf.{q} ELSE coalesce(sg.{q}, al.{q}) END AS {q}"
        for q in ("q10", "q25", "q50", "q75", "q90")
    )
    return f"""
banded AS (SELECT *, floor(age / 2)::INT AS age_band, floor(odometer / 50000)::INT AS km_band FROM {source}),
learned AS (SELECT *, floor(age / 2)::INT AS age_band, floor(odometer / 50000)::INT AS km_band FROM {fitted or source}),
leaf_q AS (SELECT make, model, age_band, km_band, count(*) AS leaf_n, {quantile_columns()} FROM learned GROUP BY ALL),
segment_q AS (SELECT make, model, {quantile_columns()} FROM learned GROUP BY ALL),
all_q AS (SELECT {quantile_columns()} FROM learned),
with_q AS (SELECT b.*, {picks} FROM banded b LEFT JOIN leaf_q lf USING (make, model, age_band, km_band)
           LEFT JOIN segment_q sg USING (make, model), all_q al)"""


def tails(source: str) -> str:
    """CTEs ``bounds`` and ``tail_lines``: quartiles and line models of both tails."""
    return (
        f"""
bounds AS (SELECT make, model, quantile_cont(price, 0.25) AS q25, quantile_cont(price, 0.75) AS q75
           FROM {source} GROUP BY ALL),
sides AS (SELECT f.*, CASE WHEN price < q25 THEN 'low' WHEN price > q75 THEN 'high' END AS side
          FROM {source} f JOIN bounds USING (make, model)),
tail_rows AS (SELECT * FROM sides WHERE side IS NOT NULL),"""
        + lines("tail_rows", "make, model, side", "tail_lines")
    )

