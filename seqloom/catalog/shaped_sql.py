"""SQL of scorers at other shapes: one-hot input, deep and linear heads, residue vectors.

All folds are rows of a table, so the text holds one fold whose number is a column.
"""

from __future__ import annotations

from . import views as v

FOLDS = "folds AS (SELECT unnest(range(1, 6)) AS f)"


def weight(layer: int, i: str | int, j: str | int, k: str | int) -> str:
    """The formula of ``views.weight`` for the fold in column f."""
    return f"(((f * 13 + {layer * 11} + ({i}) * 31 + ({j}) * 17 + ({k}) * 7) % 19 - 9) / 20.0::DOUBLE)"


def context(taps: int) -> str:
    """Per residue the codes (place in the alphabet) of its neighbours; null beyond the ends."""
    half = taps // 2
    columns = [
        f"{'lag' if t < half else 'lead'}(code, {abs(t - half)}) OVER w AS c{t}" for t in range(taps)
    ]
    return (
        v.RESIDUES
        + f""", coded AS (SELECT seq_id, pos, strpos('{v.ALPHABET}', aa) - 1 AS code FROM residues),
        context AS (SELECT seq_id, pos, {", ".join(columns)} FROM coded WINDOW w AS (PARTITION BY seq_id ORDER BY pos))"""
    )


def onehot_conv(layer: int, taps: int, k: int) -> str:
    terms = [f"coalesce({weight(layer, t, f'c{t}', k)}, 0)" for t in range(taps)]
    return " + ".join([*terms, weight(layer, 5, 0, k)])


def dense(layer: int, inputs: list[str], k: int) -> str:
    scale = f"{v.dense_scale(len(inputs))!r}::DOUBLE"
    terms = [f"{weight(layer, 0, j, k)} * {scale} * {x}" for j, x in enumerate(inputs)]
    return " + ".join([*terms, weight(layer, 5, 0, k)])


def normed_relu(layer: int, z: str, k: int) -> str:
    gain, offset = weight(layer + 1, 0, 0, k), weight(layer + 1, 5, 0, k)
    return f"greatest({z}, 0) * (1.0::DOUBLE + {gain}) + {offset}"


def attended(channels: int) -> str:
    """From conv(f, seq_id, pos, f0.., a0..) to applied(f, seq_id, pos, x0..)."""
    ks = range(channels)
    norms = ", ".join(f"sum(exp(a{k})) AS n{k}" for k in ks)
    values = ", ".join(f"f{k} * exp(a{k}) / n{k} AS x{k}" for k in ks)
    return f"""norms AS (SELECT f, seq_id, {norms} FROM conv GROUP BY f, seq_id),
        applied AS (SELECT f, seq_id, pos, {values} FROM conv JOIN norms USING (f, seq_id))"""


WEIGHTED_THREE = "least(sum(p * exp(o / (1.0::DOUBLE + f * 0.1::DOUBLE))) / sum(exp(o / (1.0::DOUBLE + f * 0.1::DOUBLE))), 1.0::DOUBLE)"


def scores(logits: str, pool: str) -> str:
    """Sequence scores of each fold and their mean, from a table (f, seq_id, pos, o)."""
    each = ", ".join(f"{v.sql_r6(f'max(score) FILTER (f = {f})')} AS fold{f}_seq_score" for f in range(1, 6))
    return f"""probs AS (SELECT f, seq_id, o, 1.0::DOUBLE / (1.0::DOUBLE + exp(-o)) AS p FROM {logits}),
        pooled AS (SELECT f, seq_id, {pool} AS score FROM probs GROUP BY f, seq_id)
        SELECT seq_id, {each}, {v.sql_r6("avg(score)")} AS ensemble_seq_score FROM pooled GROUP BY seq_id"""


def onehot_sql(taps: int, channels: int, hidden: int) -> str:
    ks = range(channels)
    conv = ", ".join(
        f"{onehot_conv(layer, taps, k)} AS {name}{k}" for layer, name in ((1, "f"), (2, "a")) for k in ks
    )
    x = [f"x{k}" for k in ks]
    units = ", ".join(f"{normed_relu(3, dense(3, x, k), k)} AS h{k}" for k in range(hidden))
    return f"""WITH {context(taps)}, {FOLDS},
        conv AS (SELECT f, seq_id, pos, {conv} FROM context, folds),
        {attended(channels)},
        hidden AS (SELECT f, seq_id, pos, {units} FROM applied),
        logits AS (SELECT f, seq_id, pos, {dense(5, [f"h{k}" for k in range(hidden)], 0)} AS o FROM hidden),
        {scores("logits", WEIGHTED_THREE)}"""


def _list_layer(name: str, source: str, layer: int, inputs: int, outputs: int, last_hidden: bool) -> str:
    """One dense layer on lists of values; a hidden one ends in ReLU, the last of them in a batch norm."""
    z = f"list_dot_product(h, w) + {weight(layer, 5, 0, 'k')}"
    z = normed_relu(layer, z, "k") if last_hidden else f"greatest({z}, 0)"
    return f"""w_{name} AS (
          SELECT f, k, list({weight(layer, 0, "j", "k")} * {v.dense_scale(inputs)!r}::DOUBLE ORDER BY j) AS w
          FROM folds, unnest(range({inputs})) AS a(j), unnest(range({outputs})) AS b(k) GROUP BY f, k),
        {name} AS (SELECT f, c0, c1, c2, list({z} ORDER BY k) AS h FROM {source} JOIN w_{name} USING (f) GROUP BY f, c0, c1, c2)"""


def deep_sql(channels: int, hidden: tuple[int, ...]) -> str:
    """Without attention a logit depends on three letters: each such triple is worked out once."""
    sizes = (channels, *hidden)
    conv = ", ".join(onehot_conv(1, 3, k) for k in range(channels))
    layers, source = [], "layer0"
    for n, (a, b) in enumerate(zip(sizes, sizes[1:])):
        layers.append(_list_layer(f"layer{n + 1}", source, 3 + 2 * n, a, b, n == len(hidden) - 1))
        source = f"layer{n + 1}"
    out = 3 + 2 * len(hidden)
    last = " + ".join(
        [f"h[{j + 1}] * {weight(out, 0, j, 0)} * {v.dense_scale(hidden[-1])!r}::DOUBLE" for j in range(hidden[-1])]
    )
    return f"""WITH {context(3)}, {FOLDS},
        triples AS (SELECT DISTINCT coalesce(c0, -1) AS c0, c1, coalesce(c2, -1) AS c2 FROM context),
        layer0 AS (SELECT f, c0, c1, c2, [{conv}] AS h
          FROM (SELECT f, nullif(c0, -1) AS c0, c1, nullif(c2, -1) AS c2 FROM triples, folds)),
        {", ".join(layers)},
        known AS (SELECT f, c0, c1, c2, {last} + {weight(out, 5, 0, 0)} AS o FROM {source}),
        logits AS (SELECT f, seq_id, pos, o FROM context x JOIN known t
          ON x.c1 = t.c1 AND x.c0 IS NOT DISTINCT FROM t.c0 AND x.c2 IS NOT DISTINCT FROM t.c2),
        {scores("logits", "avg(p)")}"""


def linear_sql(channels: int, outputs: int) -> str:
    x = [f"x{k}" for k in range(channels)]
    mean = " + ".join(f"({dense(3, x, k)})" for k in range(outputs))
    conv = ", ".join(
        f"{onehot_conv(layer, 3, k)} AS {name}{k}" for layer, name in ((1, "f"), (2, "a")) for k in range(channels)
    )
    return f"""WITH {context(3)}, {FOLDS},
        conv AS (SELECT f, seq_id, pos, {conv} FROM context, folds),
        {attended(channels)},
        logits AS (SELECT f, seq_id, pos, ({mean}) / {outputs} AS o FROM applied),
        {scores("logits", "least(sum(p * exp(o)) / sum(exp(o)), 1.0::DOUBLE)")}"""


def vector_sql(width: int, places: int, channels: int, hidden: int) -> str:
    """Residue vectors: ``places`` slices of an embedding, cut to the sequence's length."""
    ks = range(channels)

    def conv(layer: int, k: int) -> str:
        terms = [
            f"coalesce({weight(layer, t, j, k)} * {name}[{j + 1}], 0)"
            for t, name in enumerate(("before", "here", "after")) for j in range(width)
        ]
        return " + ".join([*terms, weight(layer, 5, 0, k)])

    columns = ", ".join(f"{conv(layer, k)} AS {name}{k}" for layer, name in ((1, "f"), (2, "a")) for k in ks)
    units = ", ".join(f"{normed_relu(3, dense(3, [f'x{k}' for k in ks], k), k)} AS h{k}" for k in range(hidden))
    return f"""WITH {v.SEQS}, {FOLDS}, vec AS (
          SELECT s.seq_id, pos, (e.embedding::DOUBLE[])[{width} * pos + 1 : {width} * pos + {width}] AS x
          FROM seqs s JOIN embeddings e ON s.seq_id = e.vec_id, (SELECT unnest(range({places})) AS pos)
          WHERE pos < length(s.sequence)),
        near AS (SELECT seq_id, pos, lag(x) OVER w AS before, x AS here, lead(x) OVER w AS after
          FROM vec WINDOW w AS (PARTITION BY seq_id ORDER BY pos)),
        conv AS (SELECT f, seq_id, pos, {columns} FROM near, folds),
        {attended(channels)},
        hidden AS (SELECT f, seq_id, pos, {units} FROM applied),
        logits AS (SELECT f, seq_id, pos, {dense(5, [f"h{k}" for k in range(hidden)], 0)} AS o FROM hidden),
        {scores("logits", WEIGHTED_THREE)}"""
