"""SQL text shared by several queries: fold scoring and classification metrics.

The weights are written out as numbers, so the SQL is plain arithmetic on the
letters' z-scales and their neighbours.
"""

from __future__ import annotations

from . import views as v

KERNEL, CHANNELS, HIDDEN = 3, 2, 4
_TAPS = "pqr"  # previous, current and next position


def _n(x: float) -> str:
    return f"({x!r}::DOUBLE)"


def _sum(terms: list[str]) -> str:
    return " + ".join(terms)


def conv_expr(f: int, layer: int, k: int) -> str:
    terms = [
        f"{_n(v.weight(f, layer, i, j, k))} * {_TAPS[i]}{j}" for i in range(KERNEL) for j in range(5)
    ]
    return _sum([*terms, _n(v.weight(f, layer, 5, 0, k))])


def head_expr(f: int, inputs: list[str]) -> str:
    terms = []
    for k in range(HIDDEN):
        z = _sum(
            [f"{_n(v.weight(f, 3, 0, j, k))} * {x}" for j, x in enumerate(inputs)]
            + [_n(v.weight(f, 3, 5, 0, k))]
        )
        gain, offset = 1.0 + v.weight(f, 4, 0, 0, k), v.weight(f, 4, 5, 0, k)
        hidden = f"(greatest({z}, 0) * {_n(gain)} + {_n(offset)})"
        terms.append(f"{_n(v.weight(f, 5, 0, k, 0))} * {hidden}")
    return _sum([*terms, _n(v.weight(f, 5, 5, 0, 0))])


CONTEXT = (
    v.RESIDUES
    + f""", {v.ZBOOK}, encoded AS (
  SELECT seq_id, pos, aa, d0, d1, d2, d3, d4 FROM residues JOIN zbook USING (aa)),
context AS (
  SELECT seq_id, pos, aa, """
    + ", ".join(
        f"coalesce(lag(d{j}) OVER w, 0) AS p{j}, d{j} AS q{j}, coalesce(lead(d{j}) OVER w, 0) AS r{j}"
        for j in range(5)
    )
    + " FROM encoded WINDOW w AS (PARTITION BY seq_id ORDER BY pos))"
)


def convolved(folds: range) -> str:
    columns = [
        f"{conv_expr(f, layer, k)} AS {name}{f}_{k}"
        for f in folds
        for layer, name in ((1, "f"), (2, "a"))
        for k in range(CHANNELS)
    ]
    return ", conv AS (SELECT seq_id, pos, " + ", ".join(columns) + " FROM context)"


def applied(folds: range) -> str:
    pairs = [(f, k) for f in folds for k in range(CHANNELS)]
    norms = ", ".join(f"sum(exp(a{f}_{k})) AS n{f}_{k}" for f, k in pairs)
    values = ", ".join(f"f{f}_{k} * exp(a{f}_{k}) / n{f}_{k} AS x{f}_{k}" for f, k in pairs)
    return (
        f", norms AS (SELECT seq_id, {norms} FROM conv GROUP BY seq_id)"
        f", applied AS (SELECT conv.seq_id, pos, {values} FROM conv JOIN norms USING (seq_id))"
    )


def heads(folds: range) -> str:
    columns = ", ".join(
        f"{head_expr(f, [f'x{f}_{k}' for k in range(CHANNELS)])} AS o{f}" for f in folds
    )
    return f", heads AS (SELECT seq_id, pos, {columns} FROM applied)"


_ALL = range(1, 6)

FOLD_SCORES = (
    "WITH "
    + CONTEXT
    + convolved(_ALL)
    + applied(_ALL)
    + heads(_ALL)
    + ", probs AS (SELECT seq_id, 'doc_' || seq_id AS name, pos, "
    + ", ".join(f"1.0::DOUBLE / (1.0::DOUBLE + exp(-o{f})) AS p{f}, exp(o{f} / {_n(1.0 + f * 0.1)}) AS e{f}" for f in _ALL)
    + " FROM heads), seq_scores AS (SELECT seq_id, name, "
    + ", ".join(f"least(sum(p{f} * e{f}) / sum(e{f}), 1.0::DOUBLE) AS s{f}" for f in _ALL)
    + " FROM probs GROUP BY seq_id, name) "
)

ENSEMBLE = "(s1 + s2 + s3 + s4 + s5) / 5.0::DOUBLE"
ENSEMBLE_RESIDUE = "(p1 + p2 + p3 + p4 + p5) / 5.0::DOUBLE"


def folds_wide_sql(prefix: str = "model_") -> str:
    columns = ", ".join(f"{v.sql_r6(f's{f}')} AS {prefix}fold{f}_seq_score" for f in _ALL)
    return f"SELECT name, {columns}, {v.sql_r6(ENSEMBLE)} AS {prefix}ensemble_seq_score FROM seq_scores"


def mcc_sql() -> str:
    return (
        "CASE WHEN (tp+fp) > 0 AND (tp+fn) > 0 AND (tn+fp) > 0 AND (tn+fn) > 0 THEN "
        "(tp*tn - fp*fn) / (sqrt(tp+fp)*sqrt(tp+fn)*sqrt(tn+fp)*sqrt(tn+fn)) ELSE 0::DOUBLE END"
    )


GROUPED = """grouped AS (
  SELECT data_split, "group", y, y_pred, y_pred_prob FROM scored
  UNION ALL SELECT data_split, '' AS "group", y, y_pred, y_pred_prob FROM scored)"""

CONFUSION = """conf AS (
  SELECT data_split, "group", sum((y = 1 AND y_pred = 1)::INT)::DOUBLE AS tp,
    sum((y = 0 AND y_pred = 1)::INT)::DOUBLE AS fp, sum((y = 0 AND y_pred = 0)::INT)::DOUBLE AS tn,
    sum((y = 1 AND y_pred = 0)::INT)::DOUBLE AS fn, count(*) AS total
  FROM grouped GROUP BY data_split, "group")"""

METRICS = f"""metrics AS (
  SELECT *, (tp + tn) / total AS accuracy, tp / nullif(tp + fp, 0) AS precision,
    tp / nullif(tp + fn, 0) AS recall, tn / nullif(tn + fp, 0) AS specificity,
    2 * tp / nullif(2 * tp + fp + fn, 0) AS f_score, {mcc_sql()} AS matthews_corr_coef,
    coalesce((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, tp / nullif(tp + fn, 0),
      tn / nullif(tn + fp, 0)) AS balanced_accuracy
  FROM conf)"""

CLASSIFICATION_SQL = f"WITH {v.SCORED}, {GROUPED}, {CONFUSION}, {METRICS} "

AUC = """ranked AS (
  SELECT data_split, "group", y, rank() OVER (PARTITION BY data_split, "group" ORDER BY y_pred_prob)
    + (count(*) OVER (PARTITION BY data_split, "group", y_pred_prob) - 1) / 2.0::DOUBLE AS r FROM grouped),
auc AS (
  SELECT data_split, "group", CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN
    (sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE)
      / (sum(y)::DOUBLE * sum(1 - y)::DOUBLE) END AS roc_auc_score
  FROM ranked GROUP BY data_split, "group")"""

CUTOFF = f"""cuts AS (SELECT i AS step, i * 0.01::DOUBLE AS c FROM range(101) t(i)),
cutconf AS (
  SELECT data_split, "group", step, c, sum((y = 1 AND y_pred_prob > c)::INT)::DOUBLE AS tp,
    sum((y = 0 AND y_pred_prob > c)::INT)::DOUBLE AS fp, sum((y = 0 AND NOT y_pred_prob > c)::INT)::DOUBLE AS tn,
    sum((y = 1 AND NOT y_pred_prob > c)::INT)::DOUBLE AS fn
  FROM grouped, cuts GROUP BY data_split, "group", step, c),
cutmcc AS (SELECT *, round({mcc_sql()}, 12) AS mcc FROM cutconf),
best AS (
  SELECT data_split, "group", c AS optimal_mcc_cutoff, mcc AS optimal_mcc,
    row_number() OVER (PARTITION BY data_split, "group" ORDER BY mcc DESC, step) AS rn FROM cutmcc)"""

SPEARMAN = """ranks AS (
  SELECT *, rank() OVER (PARTITION BY data_split, "group" ORDER BY y)
      + (count(*) OVER (PARTITION BY data_split, "group", y) - 1) / 2.0::DOUBLE AS ry,
    rank() OVER (PARTITION BY data_split, "group" ORDER BY y_pred)
      + (count(*) OVER (PARTITION BY data_split, "group", y_pred) - 1) / 2.0::DOUBLE AS rp
  FROM rgrouped)"""

REGRESSION_SQL = f"""WITH {v.REGRESSION}, rgrouped AS (
  SELECT data_split, "group", y, y_pred FROM reg UNION ALL SELECT data_split, '', y, y_pred FROM reg),
{SPEARMAN}, stats AS (
  SELECT data_split, "group", count(*) AS n_rows,
    CASE WHEN count(*) > 2 THEN corr(y, y_pred) END AS pearson_r,
    CASE WHEN count(*) > 2 THEN corr(ry, rp) END AS spearman_r,
    avg((y - y_pred) * (y - y_pred)) AS mse, avg(abs(y - y_pred)) AS mae,
    CASE WHEN count(*) > 2 THEN 1 - avg((y - y_pred) * (y - y_pred)) / var_pop(y) END AS r_squared
  FROM ranks GROUP BY data_split, "group") """


# -- loss and gradient of the first training step -------------------------------

STEP_HIDDEN = 3
_EPS = "1e-5::DOUBLE"


def start_params() -> list:
    """Parameters by formula: two convolutions, one hidden layer, batch norm, temperature."""
    import numpy as np

    def conv(layer: int) -> list:
        taps = [[[v.weight(1, layer, i, j, k) for k in range(CHANNELS)] for j in range(5)] for i in range(KERNEL)]
        return [np.array(taps), np.array([v.weight(1, layer, 5, 0, k) for k in range(CHANNELS)])]

    hidden = range(STEP_HIDDEN)
    return [
        *conv(1),
        *conv(2),
        np.array([[v.weight(1, 3, 0, j, k) for k in hidden] for j in range(CHANNELS)]),
        np.array([v.weight(1, 3, 5, 0, k) for k in hidden]),
        np.array([[v.weight(1, 5, 0, k, 0)] for k in hidden]),
        np.array([v.weight(1, 5, 5, 0, 0)]),
        np.array([1.0 + v.weight(1, 4, 0, 0, k) for k in hidden]),
        np.array([v.weight(1, 4, 5, 0, k) for k in hidden]),
        np.array([1.1]),
    ]


def first_step_sql() -> str:
    c, h = range(CHANNELS), range(STEP_HIDDEN)
    gamma = [_n(1.0 + v.weight(1, 4, 0, 0, k)) for k in h]
    beta = [_n(v.weight(1, 4, 5, 0, k)) for k in h]
    w1 = [[_n(v.weight(1, 3, 0, j, k)) for k in h] for j in c]
    w2 = [_n(v.weight(1, 5, 0, k, 0)) for k in h]
    out = [f"({gamma[k]} * g{k} + {beta[k]})" for k in h]

    def each(text: str, over=c) -> str:
        return ", ".join(text.replace("@", str(k)) for k in over)

    def z(k: int) -> str:
        return _sum([f"{w1[j][k]} * x{j}" for j in c] + [_n(v.weight(1, 3, 5, 0, k))])

    def norm(terms: list[str]) -> str:
        return "sqrt(" + " + ".join(f"power(sum({t}), 2)" for t in terms) + ")"

    taps = [f"{t}{j}" for t in _TAPS for j in range(5)]
    feature = [f"{x} * df{j}" for j in c for x in taps] + [f"df{j}" for j in c]
    attention = [f"{x} * da{j}" for j in c for x in taps] + [f"da{j}" for j in c]
    head = [f"x{j} * dh{k}" for j in c for k in h] + [f"dh{k}" for k in h] + [f"dl * {o}" for o in out] + ["dl"]
    normed = [f"o{k} * g{k}" for k in h] + [f"o{k}" for k in h]
    r = v.sql_r6
    return f"""WITH {CONTEXT}, used AS (
  SELECT seqs.seq_id, labels.quality::DOUBLE AS y, data_split = 'val' AS held
  FROM seqs JOIN labels ON labels.doc_id = seqs.seq_id
  WHERE labels.quality IS NOT NULL AND data_split IN ('train', 'val') AND length(sequence) > 0),
conv AS (
  SELECT context.*, y, held, {", ".join(f"{conv_expr(1, 1, k)} AS f{k}, {conv_expr(1, 2, k)} AS a{k}" for k in c)}
  FROM context JOIN used USING (seq_id)),
top AS (SELECT *, {each("exp(a@ - max(a@) OVER (PARTITION BY seq_id)) AS e@")} FROM conv),
att AS (SELECT *, {each("e@ / sum(e@) OVER (PARTITION BY seq_id) AS w@")} FROM top),
app AS (SELECT *, {each("f@ * w@ AS x@")} FROM att),
hid AS (SELECT *, {", ".join(f"greatest({z(k)}, 0) AS h{k}" for k in h)} FROM app),
mom AS (SELECT count(*) AS n, {each("avg(h@) AS m@, avg(h@ * h@) - avg(h@) * avg(h@) AS v@", h)} FROM hid WHERE NOT held),
nor AS (
  SELECT hid.*, {each(f"CASE WHEN held THEN (h@ - 0.1::DOUBLE * m@) / sqrt(0.9::DOUBLE + 0.1::DOUBLE * v@ * n / (n - 1) + {_EPS}) ELSE (h@ - m@) / sqrt(v@ + {_EPS}) END AS g@, v@", h)}
  FROM hid, mom),
log AS (SELECT *, {_sum([f"{w2[k]} * {out[k]}" for k in h] + [_n(v.weight(1, 5, 5, 0, 0))])} AS l FROM nor),
pro AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-l)) AS p, exp((l - max(l) OVER (PARTITION BY seq_id)) / 1.1::DOUBLE) AS e FROM log),
wei AS (SELECT *, e / sum(e) OVER (PARTITION BY seq_id) AS w FROM pro),
sco AS (SELECT *, sum(p * w) OVER (PARTITION BY seq_id) AS s FROM wei),
cut AS (SELECT *, least(greatest(least(s, 1.0), 1e-12::DOUBLE), 1.0::DOUBLE - 1e-12::DOUBLE) AS q FROM sco),
per AS (SELECT seq_id, any_value(held) AS held, -(any_value(y) * ln(any_value(q)) + (1 - any_value(y)) * ln(1 - any_value(q))) AS loss FROM cut GROUP BY seq_id),
dlo AS (SELECT *, (q - y) / (q * (1 - q)) * (w * p * (1 - p) + w * (p - s) / 1.1::DOUBLE) AS dl,
               -(q - y) / (q * (1 - q)) * w * (p - s) * l / 1.21::DOUBLE AS dt FROM cut WHERE NOT held),
ups AS (SELECT *, {", ".join(f"dl * {w2[k]} AS o{k}" for k in h)} FROM dlo),
pul AS (SELECT {each("avg(o@) AS u@, avg(o@ * g@) AS t@", h)} FROM ups),
dhi AS (SELECT ups.*, {", ".join(f"CASE WHEN h{k} > 0 THEN {gamma[k]} / sqrt(v{k} + {_EPS}) * (o{k} - u{k} - g{k} * t{k}) ELSE 0 END AS dh{k}" for k in h)} FROM ups, pul),
dac AS (SELECT *, {", ".join(_sum([f"{w1[j][k]} * dh{k}" for k in h]) + f" AS dx{j}" for j in c)} FROM dhi),
inn AS (SELECT *, {each("sum(w@ * dx@ * f@) OVER (PARTITION BY seq_id) AS i@")} FROM dac),
gra AS (SELECT *, {each("dx@ * w@ AS df@, w@ * (dx@ * f@ - i@) AS da@")} FROM inn)
SELECT {r("(SELECT avg(loss) FROM per WHERE NOT held)")} AS train_loss,
       {r("(SELECT avg(loss) FROM per WHERE held)")} AS val_loss,
       {r(norm(feature))} AS feature_norm, {r(norm(attention))} AS attention_norm,
       {r(norm(head))} AS head_norm, {r(norm(normed))} AS batch_norm_norm, {r("abs(sum(dt))")} AS temperature_norm
FROM gra"""
