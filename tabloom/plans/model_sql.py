"""SQL text for DuckDB that fits trees level by level and nets step by step, to hold the fitted models against."""

from __future__ import annotations

from tabloom.operators import mlp, trees
from tabloom.plans import views


def _entropy(side: str, classes: int) -> str:
    n = "(" + " + ".join(f"{side}{k}" for k in range(classes)) + ")"
    return "(" + " + ".join(f"CASE WHEN {side}{k} > 0 THEN -({side}{k} / {n}) * log2({side}{k} / {n}) ELSE 0 END" for k in range(classes)) + ")"


def grow(base: str, classes: int, features: int, depth: int, leaf: int, split: int, subset: int | None = None, seed: int = 0) -> str:
    """CTEs up to nodes (tree, node, depth, prediction, feature, threshold) over base (tree, id, weight, code, features)."""
    n = {s: "(" + " + ".join(f"{s}{k}" for k in range(classes)) + ")" for s in "ltr"}
    each = ", ".join(f"CAST(coalesce(sum(weight) FILTER (code = {k}), 0) AS DOUBLE) AS c{k}" for k in range(classes))
    left = ", ".join(f"sum(c{k}) OVER w AS l{k}, sum(c{k}) OVER (PARTITION BY tree, node, feature) AS t{k}" for k in range(classes))
    right = ", ".join(f"t{k} - l{k} AS r{k}" for k in range(classes))
    gain = f"round({_entropy('t', classes)} - {n['l']} / {n['t']} * {_entropy('l', classes)} - {n['r']} / {n['t']} * {_entropy('r', classes)}, 12)"
    u = views.uniform_sql("duck", f"CAST(tree AS STRING) || '/' || CAST(node AS STRING) || ':' || CAST(feature AS STRING) || ':{seed}'")
    out = [f"at0 AS MATERIALIZED (SELECT tree, id, weight, code, features, CAST(0 AS BIGINT) AS node FROM ({base}))"]
    for d in range(depth + 1):
        out.append(
            f"""n{d} AS MATERIALIZED (SELECT tree, node, count(*) AS classes, sum(w) AS total, first(code ORDER BY w DESC, code) AS prediction
      FROM (SELECT tree, node, code, sum(weight) AS w FROM at{d} GROUP BY tree, node, code) GROUP BY tree, node)"""
        )
        if d == depth:
            out.append(f"b{d} AS (SELECT tree, node, CAST(0 AS INT) AS feature, CAST(0 AS DOUBLE) AS threshold FROM n{d} WHERE false)")
            break
        allowed = ""
        if subset:
            out.append(
                f"""a{d} AS MATERIALIZED (SELECT tree, node, feature FROM n{d}, (SELECT unnest(range({features})) AS feature)
      QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY {u}, feature) <= {subset})"""
            )
            allowed = f" JOIN a{d} USING (tree, node, feature)"
        out.append(
            f"""x{d} AS (SELECT tree, node, feature, value, {each}, min(code) AS low, max(code) AS high
      FROM (SELECT tree, node, weight, code, feature, features[feature + 1] AS value FROM at{d} JOIN n{d} USING (tree, node), (SELECT unnest(range({features})) AS feature) WHERE classes > 1 AND total >= {split}){allowed}
      GROUP BY tree, node, feature, value),
    g{d} AS (SELECT tree, node, feature, value, high, {left}, lead(value) OVER w AS nv, lead(low) OVER w AS nl FROM x{d} WINDOW w AS (PARTITION BY tree, node, feature ORDER BY value)),
    h{d} AS (SELECT *, {right} FROM g{d} WHERE nv IS NOT NULL AND high <> nl),
    b{d} AS MATERIALIZED (SELECT tree, node, CAST(feature AS INT) AS feature, threshold FROM (SELECT tree, node, feature, (value + nv) / 2 AS threshold, {gain} AS gain FROM h{d} WHERE {n["l"]} >= {leaf} AND {n["r"]} >= {leaf})
      WHERE gain >= {trees.LEAST_GAIN} QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY gain DESC, feature, threshold) = 1),
    at{d + 1} AS MATERIALIZED (SELECT tree, id, weight, code, features, 2 * node + 1 + CAST(features[feature + 1] > threshold AS BIGINT) AS node FROM at{d} JOIN b{d} USING (tree, node))"""
        )
    one = lambda d: f"SELECT CAST(tree AS INT) AS tree, node, {d} AS depth, CAST(prediction AS INT) AS prediction, coalesce(feature, -1) AS feature, threshold FROM n{d} LEFT JOIN b{d} USING (tree, node)"
    out.append("nodes AS MATERIALIZED (" + " UNION ALL ".join(one(d) for d in range(depth + 1)) + ")")
    return ",\n    ".join(out)


def descend(rows: str, depth: int) -> str:
    """CTEs up to reached (id, code, split, tree, cut, prediction): where rows get in trees that end at each depth."""
    out = [f"s0 AS MATERIALIZED (SELECT r.id, r.code, r.split, r.features, t.tree, t.node, t.prediction, t.feature, t.threshold FROM ({rows}) r, nodes t WHERE t.node = 0)"]
    for d in range(1, depth + 1):
        out.append(
            f"""s{d} AS MATERIALIZED (SELECT s.id, s.code, s.split, s.features, s.tree, coalesce(t.node, s.node) AS node, coalesce(t.prediction, s.prediction) AS prediction,
      coalesce(t.feature, s.feature) AS feature, coalesce(t.threshold, s.threshold) AS threshold FROM s{d - 1} s
      LEFT JOIN nodes t ON s.feature >= 0 AND t.tree = s.tree AND t.node = 2 * s.node + 1 + CAST(s.features[s.feature + 1] > s.threshold AS BIGINT))"""
        )
    out.append("reached AS (" + " UNION ALL ".join(f"SELECT id, code, split, tree, {d} AS cut, prediction FROM s{d}" for d in range(depth + 1)) + ")")
    return ",\n    ".join(out)


#: The winner of the trees' votes, ties to the smallest label.
VOTE = "SELECT id, code, split, cut, prediction FROM reached GROUP BY id, code, split, cut, prediction QUALIFY row_number() OVER (PARTITION BY id, cut ORDER BY count(*) DESC, prediction) = 1"


# --- nets ---------------------------------------------------------------------------------------


def net(n: mlp.Net) -> str:
    """One row: w1, b1, w2, b2 as lists."""
    vec = lambda row: "[" + ", ".join(repr(float(v)) for v in row) + "]"
    mat = lambda m: "[" + ", ".join(vec(r) for r in m) + "]"
    return f"SELECT CAST({mat(n.w1)} AS DOUBLE[][]) AS w1, CAST({vec(n.b1)} AS DOUBLE[]) AS b1, CAST({mat(n.w2)} AS DOUBLE[][]) AS w2, CAST({vec(n.b2)} AS DOUBLE[]) AS b2"


def forward(name: str, weights: str, rows: str, mask: str | None = None) -> str:
    """CTE name (rows' columns, h, p) by the one-row table weights; mask: SQL of a list that hidden values are multiplied with."""
    dot = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda q: q[1] * q[2]))"
    hidden = f"list_transform(list_zip(w1, b1), lambda r: greatest({dot('r[1]', 'features')} + r[2], CAST(0 AS DOUBLE)))"
    masked = f"list_transform(list_zip({hidden}, {mask}), lambda q: q[1] * q[2])" if mask else hidden
    return f"""{name}h AS (SELECT r.*, w2, b2, {masked} AS h FROM ({rows}) r, {weights}),
    {name}z AS (SELECT * EXCLUDE (w2, b2), list_transform(list_zip(w2, b2), lambda r: {dot('r[1]', 'h')} + r[2]) AS z FROM {name}h),
    {name}e AS (SELECT * EXCLUDE (z), list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM {name}z),
    {name} AS MATERIALIZED (SELECT * EXCLUDE (e), list_transform(e, lambda x: x / list_sum(e)) AS p FROM {name}e)"""


def gradient(name: str, scored: str, weights: str, hidden: int, features: int, classes: int, l2: float, class_weights: list[float], mask: str | None = None) -> str:
    """CTEs name_w1 (j, i, v), name_b1 (j, v), name_w2, name_b2 and name_loss (v) over scored rows."""
    cw = "[" + ", ".join(repr(float(w)) for w in class_weights) + "]"
    keep = f"* ({mask})[j + 1]" if mask else ""
    ranges = lambda n, x: f"(SELECT unnest(range({n})) AS {x})"
    return f"""{name}d AS MATERIALIZED (SELECT *, CAST({cw} AS DOUBLE[])[code + 1] AS weight, list_transform(list_zip(p, range({classes})), lambda q: (q[1] - CASE WHEN q[2] = code THEN 1 ELSE 0 END) * CAST({cw} AS DOUBLE[])[code + 1]) AS d FROM {scored}),
    {name}n AS (SELECT sum(weight) AS n FROM {name}d),
    {name}_w2 AS (SELECT c AS j, i, sum(d[c + 1] * h[i + 1]) / any_value(n) + {l2} * any_value(w2[c + 1][i + 1]) AS v FROM {name}d, {name}n, {weights}, {ranges(classes, 'c')}, {ranges(hidden, 'i')} GROUP BY c, i),
    {name}_b2 AS (SELECT c AS j, sum(d[c + 1]) / any_value(n) AS v FROM {name}d, {name}n, {ranges(classes, 'c')} GROUP BY c),
    {name}k AS MATERIALIZED (SELECT id, j, features, CASE WHEN h[j + 1] > 0 THEN list_sum(list_transform(list_zip(d, w2), lambda q: q[1] * q[2][j + 1])) {keep} ELSE 0 END AS back FROM {name}d, {weights}, {ranges(hidden, 'j')}),
    {name}_w1 AS (SELECT j, i, sum(back * features[i + 1]) / any_value(n) + {l2} * any_value(w1[j + 1][i + 1]) AS v FROM {name}k, {name}n, {weights}, {ranges(features, 'i')} GROUP BY j, i),
    {name}_b1 AS (SELECT j, sum(back) / any_value(n) AS v FROM {name}k, {name}n GROUP BY j),
    {name}_loss AS (SELECT sum(-weight * ln(greatest(p[code + 1], CAST({mlp.FLOOR} AS DOUBLE)))) / any_value(n) AS v FROM {name}d, {name}n)"""


def step(name: str, g: str, weights: str, rate: float) -> str:
    """CTE name: the one-row table weights after a step along gradient g."""
    mat = lambda w: f"(SELECT list(r ORDER BY j) FROM (SELECT j, list({weights}.{w}[j + 1][i + 1] - {rate} * v ORDER BY i) AS r FROM {g}_{w}, {weights} GROUP BY j))"
    vec = lambda b: f"(SELECT list({weights}.{b}[j + 1] - {rate} * v ORDER BY j) FROM {g}_{b}, {weights})"
    return f"{name} AS MATERIALIZED (SELECT {mat('w1')} AS w1, {vec('b1')} AS b1, {mat('w2')} AS w2, {vec('b2')} AS b2)"


def train(rows: str, start: mlp.Net, epochs: int, steps: int, rate: float, l2: float, patience: int | None, batch_seed: int | None = None) -> str:
    """CTEs: net1 ... (the net after each epoch) and history (epoch, losses, accuracies) up to the epoch that stops.

    With batch_seed a step has a mini-batch of the epoch's own deal instead of all rows."""
    hidden, features = start.w1.shape
    classes = len(start.b2)
    ones = [1.0] * classes
    out, weights, each = [f"rows AS MATERIALIZED ({rows})", f"net0 AS MATERIALIZED ({net(start)})"], "net0", []
    for epoch in range(1, epochs + 1):
        for s in range(steps):
            name = f"g{epoch}s{s}"
            new = f"net{epoch}" if s == steps - 1 else f"net{epoch}s{s}"
            fit = "SELECT * FROM rows WHERE split = 'train'"
            if batch_seed is not None:
                u = views.uniform_sql("duck", f"CAST(id AS STRING) || ':batch.{epoch}:{batch_seed}'")
                fit += f" AND least(CAST(floor({u} * {steps}) AS INT), {steps - 1}) = {s}"
            out += [forward(f"{name}f", weights, fit), gradient(name, f"{name}f", weights, hidden, features, classes, l2, ones), step(new, name, weights, rate)]
            weights = new
        out.append(forward(f"m{epoch}", weights, "SELECT * FROM rows"))
        loss = lambda part, e=epoch: f"(SELECT avg(-ln(greatest(p[code + 1], CAST({mlp.FLOOR} AS DOUBLE)))) FROM m{e} WHERE split = '{part}')"
        acc = lambda part, e=epoch: f"(SELECT avg(CAST(list_position(p, list_max(p)) - 1 = code AS DOUBLE)) FROM m{e} WHERE split = '{part}')"
        update = f"(SELECT v FROM g{epoch}s{steps - 1}_loss)"
        if batch_seed is not None:
            update = "(SELECT sum(v * n) / sum(n) FROM (" + " UNION ALL ".join(f"SELECT v, n FROM g{epoch}s{s}_loss, g{epoch}s{s}n" for s in range(steps)) + "))"
        each.append(
            f"SELECT {epoch} AS epoch, {update} AS train_update_loss, {loss('train')} AS train_loss, {loss('val')} AS val_loss, {acc('train')} AS train_accuracy, {acc('val')} AS val_accuracy, CAST({rate} AS DOUBLE) AS learning_rate, {acc('test')} AS test_accuracy"
        )
        rate = rate * 0.85 if epoch % 10 == 0 else rate
    out.append("every_epoch AS MATERIALIZED (" + " UNION ALL ".join(each) + ")")
    better = "SELECT *, val_accuracy > coalesce(max(val_accuracy) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS better FROM every_epoch"
    stale = f"SELECT *, epoch - max(CASE WHEN better THEN epoch END) OVER (ORDER BY epoch) AS stale FROM ({better})"
    stop = f"epoch <= coalesce((SELECT min(epoch) FROM ({stale}) WHERE stale >= {patience}), {epochs})" if patience is not None else "true"
    out.append(f"history AS MATERIALIZED (SELECT * EXCLUDE (better, stale) FROM ({stale}) WHERE {stop})")
    return ",\n    ".join(out)


def best_predictions(epochs: int) -> str:
    """(id, split, code, predicted) of the net of the epoch with the best validation accuracy in history, the first of equals."""
    every = " UNION ALL ".join(f"SELECT {e} AS epoch, id, split, code, CAST(list_position(p, list_max(p)) - 1 AS INT) AS predicted FROM m{e}" for e in range(1, epochs + 1))
    return f"SELECT id, split, code, predicted FROM ({every}) WHERE epoch = (SELECT epoch FROM history ORDER BY val_accuracy DESC, epoch LIMIT 1)"
