"""Grouped, stratified cross-validation of a softmax regression over a grid of strengths.

Each fit of (strength, fold) is one task of an Arrow-grouped map, if the development set is small. Of a larger one, tasks
see parts: a pass over the rows evaluates all fits at once, sums of a fit meet in a task that makes its next Newton
step, and what comes to the driver is a vector of weights a fit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetra.plans.session import cut

#: Rows of a development set that one task takes; a larger set is fitted by parts of as many.
MOST_ROWS = 50_000


def balanced(y: np.ndarray, classes: int) -> np.ndarray:
    """Weights n / (classes present x rows of the class)."""
    n = np.bincount(y, minlength=classes)
    return len(y) / ((n > 0).sum() * np.maximum(n, 1))[y]


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, c: float, max_iter: int = 5_000, tol: float = 1e-8) -> np.ndarray:
    """Weights (features + 1, classes), the intercept last, of least c * weighted log-loss + half the squared weights.

    Newton steps with halving; the intercepts carry no penalty. Classes without rows get no probability.
    With more features than rows, the fit is in the coordinates of the rows' span, where the weights lie.
    """
    if x.shape[1] > len(x):
        q, r = np.linalg.qr(x.T)
        inner = fit_softmax(r.T, y, classes, c, max_iter, tol)
        return np.vstack([q @ inner[:-1], inner[-1:]])
    n, w = len(x), balanced(y, classes)
    x1 = np.column_stack([x, np.ones(n)])
    width = x1.shape[1]
    present = np.bincount(y, minlength=classes) > 0
    hot = np.zeros((n, classes))
    hot[np.arange(n), y] = 1
    penalty = np.ones(width)
    penalty[-1] = 1e-8  # intercepts are free up to a constant of all classes
    beta = np.zeros((width, classes))

    def losses(b: np.ndarray):
        z = np.where(present, x1 @ b, -np.inf)
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        whole = p.sum(axis=1)
        return c * float((w * (np.log(whole) - z[np.arange(n), y])).sum()) + 0.5 * float((penalty[:, None] * b * b).sum()), p / whole[:, None]

    loss, p = losses(beta)
    for _ in range(max_iter):
        slope = c * x1.T @ (w[:, None] * (p - hot)) + penalty[:, None] * beta
        bend = np.zeros((classes, width, classes, width))
        for i in range(classes):
            for j in range(i, classes):
                part = c * (x1 * (w * p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ x1
                bend[i, :, j, :] = part
                bend[j, :, i, :] = part.T
            bend[i, :, i, :] += np.diag(penalty)
        step = np.linalg.solve(bend.reshape(classes * width, -1), slope.T.reshape(-1)).reshape(classes, width).T
        size = 1.0
        while True:
            now, chance = losses(beta - size * step)
            if now <= loss or size < 1e-10:
                break
            size /= 2
        gain = loss - now
        beta, loss, p = beta - size * step, now, chance
        if gain <= tol * max(1.0, abs(loss)):
            return beta
    raise RuntimeError(f"the fit has not settled in {max_iter} steps")


def probabilities(beta: np.ndarray, x: np.ndarray, present: np.ndarray) -> np.ndarray:
    z = np.where(present, np.column_stack([x, np.ones(len(x))]) @ beta, -np.inf)
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def out_of_fold(rows: DataFrame, folds: int, grid: tuple[float, ...], classes: int, max_iter: int = 5_000, on_views: bool = False, most_rows: int = MOST_ROWS) -> DataFrame:
    """c, fold, id, label, said, p (of the true class) for every row and strength, each from a fit without its fold.

    ``rows``: id, label (0 to classes - 1), fold, v and, where it learns ``on_views``, views: equally many vectors a row, each
    of them a row of the fit. What is predicted is always v.
    """
    rows = cut(rows.select("id", "label", "fold", "v", *(["views"] if on_views else [])))
    many = rows.agg(F.sum(F.size("views") if on_views else F.lit(1)).alias("n")).first()["n"] or 0
    if many > most_rows:
        return _by_parts(rows, folds, grid, classes, max_iter, on_views, -(-many // most_rows))
    tasks = rows.sparkSession.createDataFrame([(float(c), k, i) for i, (c, k) in enumerate((c, k) for c in grid for k in range(folds))], "c double, out int, task int")

    def run(key, tab):
        tab = tab.sort_by("id")
        c, out = tab.column("c")[0].as_py(), tab.column("out")[0].as_py()
        y, fold = tab.column("label").to_numpy().astype(int), tab.column("fold").to_numpy()
        x = np.stack(tab.column("v").to_pylist())
        train, test = fold != out, fold == out
        if not train.any() or not test.any():
            return tab.slice(0, 0).select(["c", "fold", "id", "label"]).append_column("said", pa.array([], pa.int64())).append_column("p", pa.array([], pa.float64()))
        own, of = x[train], y[train]
        if on_views:
            seen = np.array(tab.column("views").to_pylist())[train]
            own, of = seen.reshape(-1, seen.shape[2]), np.repeat(of, seen.shape[1])
        beta = fit_softmax(own, of, classes, c, max_iter)
        p = probabilities(beta, x[test], np.bincount(y[train], minlength=classes) > 0)
        kept = tab.filter(pa.array(test)).select(["c", "fold", "id", "label"])
        return kept.append_column("said", pa.array(p.argmax(axis=1))).append_column("p", pa.array(p[np.arange(len(p)), y[test]]))

    spread = rows.join(F.broadcast(tasks))  # grid x folds copies of a small set: the fits run side by side
    return spread.groupBy("task").applyInArrow(run, "c double, fold int, id long, label long, said long, p double")


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    while pa.types.is_list(column.type):
        column = column.flatten()
    return column.to_numpy().reshape(-1, width)


_SLICE = 1_000


def _sums(fits: dict, betas, weights: dict, classes: int, width: int, on_views: bool):
    """For rows with a column deal: of each fit of that deal the sums of losses, slopes and second derivatives over the rows outside its fold."""
    upper = [(i, j) for i in range(classes) for j in range(i, classes)]

    def run(batches):
        out: dict[int, list] = {}
        for batch in batches:
            deal = batch.column(0).to_numpy()
            for lo in range(0, batch.num_rows, _SLICE):
                part = batch.slice(lo, _SLICE)
                y, fold = part.column(1).to_numpy().astype(int), part.column(2).to_numpy()
                x = _vectors(part.column(3), width - 1)
                each = len(x) // max(1, len(y))
                y, fold = np.repeat(y, each), np.repeat(fold, each)
                x = np.column_stack([x, np.ones(len(x))])
                for f, beta in betas.value.items():
                    if f % fits["deals"] != deal[lo]:
                        continue
                    k = fits["of"][f][1]
                    own = np.flatnonzero(fold != k)
                    if not len(own):
                        continue
                    x1, y1, w = x[own], y[own], weights[k][y[own]]
                    z = np.where(weights[k] > 0, x1 @ beta, -np.inf)
                    z -= z.max(axis=1, keepdims=True)
                    p = np.exp(z)
                    whole = p.sum(axis=1)
                    loss = float((w * (np.log(whole) - z[np.arange(len(own)), y1])).sum())
                    p /= whole[:, None]
                    apart = p.copy()
                    apart[np.arange(len(own)), y1] -= 1
                    slope = x1.T @ (w[:, None] * apart)
                    bends = np.stack([w * p[:, i] * ((i == j) - p[:, j]) for i, j in upper], axis=1)
                    bend = x1.T @ (bends[:, :, None] * x1[:, None, :]).reshape(len(own), -1)
                    if f not in out:
                        out[f] = [0.0, np.zeros_like(slope), np.zeros_like(bend)]
                    out[f][0] += loss
                    out[f][1] += slope
                    out[f][2] += bend
        for f, (loss, slope, bend) in out.items():  # a record batch a fit
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([loss]), pa.array([slope.tobytes()]), pa.array([bend.tobytes()])], names=["fit", "loss", "slope", "bend"])

    return run


def _next(fits: dict, betas, classes: int, width: int):
    """For groupBy(fit): the loss at the fit's weights, and the Newton step from them."""
    upper = [(i, j) for i in range(classes) for j in range(i, classes)]

    def run(key, tab):
        f = key[0].as_py()
        tab = tab.sort_by("loss")  # added in one order whatever the order of arrival
        beta, c = betas.value[f], fits["of"][f][0]
        penalty = np.ones(width)
        penalty[-1] = 1e-8
        slope = c * sum(np.frombuffer(b).reshape(width, classes) for b in tab.column("slope").to_pylist()) + penalty[:, None] * beta
        parts = c * sum(np.frombuffer(b).reshape(width, len(upper), width) for b in tab.column("bend").to_pylist())
        bend = np.zeros((classes, width, classes, width))
        for at, (i, j) in enumerate(upper):
            bend[i, :, j, :] = parts[:, at]
            bend[j, :, i, :] = parts[:, at].T
        for i in range(classes):
            bend[i, :, i, :] += np.diag(penalty)
        step = np.linalg.solve(bend.reshape(classes * width, -1), slope.T.reshape(-1)).reshape(classes, width).T
        loss = c * float(tab.column("loss").to_numpy().sum()) + 0.5 * float((penalty[:, None] * beta * beta).sum())
        return pa.table({"fit": pa.array([f], pa.int32()), "loss": [loss], "step": [step.tobytes()]})

    return run


def _by_parts(rows: DataFrame, folds: int, grid: tuple[float, ...], classes: int, max_iter: int, on_views: bool, parts: int, tol: float = 1e-8) -> DataFrame:
    """``out_of_fold`` where no task takes all rows: the steps of ``fit_softmax``, of all fits at once, a pass over ``parts`` parts each."""
    spark = rows.sparkSession
    rows = cut(rows.repartition(parts))
    size = F.sum(F.size("views") if on_views else F.lit(1))
    counts = np.zeros((folds + 1, classes), np.int64)  # of each fold, and of rows in none of them
    tested = set()
    for r in rows.groupBy("fold", "label").agg(size.alias("n")).collect():  # folds x classes rows
        at = r["fold"] if 0 <= r["fold"] < folds else folds
        counts[at, r["label"]] += r["n"]
        tested.add(r["fold"])
    train = counts.sum(axis=0)[None, :] - counts[:folds]
    of = {i: (float(c), k) for i, (c, k) in enumerate((c, k) for c in grid for k in range(folds)) if k in tested and train[k].any()}
    weights = {k: np.where(train[k] > 0, train[k].sum() / ((train[k] > 0).sum() * np.maximum(train[k], 1)), 0.0) for k in range(folds)}
    width = rows.agg(F.max(F.size("v"))).first()[0] + 1
    deals = min(len(of), max(1, -(-spark.sparkContext.defaultParallelism // parts))) or 1  # fits are dealt too, where parts are few
    fits = {"of": of, "deals": deals}
    seen = rows.select("label", "fold", "views" if on_views else "v")
    dealt = seen.select(F.lit(0).alias("deal"), "*")
    for k in range(1, deals):
        dealt = dealt.unionByName(seen.select(F.lit(k).alias("deal"), "*"))
    beta = {f: np.zeros((width, classes)) for f in of}
    loss, step, length, done = dict.fromkeys(of, np.inf), {f: np.zeros((width, classes)) for f in of}, dict.fromkeys(of, 1.0), {}
    for _ in range(max_iter):
        if not beta:
            break
        tried = {f: beta[f] - length[f] * step[f] for f in beta}
        betas = spark.sparkContext.broadcast(tried)
        summed = dealt.mapInArrow(_sums(fits, betas, weights, classes, width, on_views), "fit int, loss double, slope binary, bend binary")
        found = summed.groupBy("fit").applyInArrow(_next(fits, betas, classes, width), "fit int, loss double, step binary").collect()  # the weights of each fit
        betas.unpersist()
        for r in found:
            f, now = r["fit"], r["loss"]
            if now > loss[f] and length[f] >= 1e-10:
                length[f] /= 2
                continue
            gain, beta[f], loss[f] = loss[f] - now, tried[f], now
            if gain <= tol * max(1.0, abs(now)):
                done[f] = beta.pop(f)
            else:
                step[f], length[f] = np.frombuffer(r["step"]).reshape(width, classes), 1.0
    if beta:
        raise RuntimeError(f"the fit has not settled in {max_iter} steps")
    final = spark.sparkContext.broadcast(done)

    def predict(batches):
        for batch in batches:
            label, fold = batch.column(1).to_numpy().astype(int), batch.column(2).to_numpy()
            x = _vectors(batch.column(3), width - 1)
            for f, (c, k) in of.items():
                test = np.flatnonzero(fold == k)
                if len(test):
                    p = probabilities(final.value[f], x[test], train[k] > 0)
                    columns = [np.full(len(test), c), np.full(len(test), k, np.int32), batch.column(0).to_numpy()[test], label[test], p.argmax(axis=1), p[np.arange(len(p)), label[test]]]
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names=["c", "fold", "id", "label", "said", "p"])

    whole = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "fold", "v")
    return whole.mapInArrow(predict, "c double, fold int, id long, label long, said long, p double")


def by_strength(predictions: DataFrame, floor_at: float = 1e-15) -> DataFrame:
    """c, fold accuracies in fold order, pooled accuracy and log-loss."""
    right = (F.col("said") == F.col("label")).cast("long")
    per = predictions.groupBy("c", "fold").agg(F.sum(right).alias("right"), F.count(F.lit(1)).alias("n"), F.sum(-F.ln(F.greatest("p", F.lit(floor_at)))).alias("loss"))
    folds = F.transform(F.array_sort(F.collect_list(F.struct("fold", (F.col("right") / F.col("n")).alias("a")))), lambda s: s["a"])
    return per.groupBy("c").agg(folds.alias("fold_accuracies"), (F.sum("right") / F.sum("n")).alias("accuracy"), (F.sum("loss") / F.sum("n")).alias("log_loss"))


def best(scores: DataFrame) -> DataFrame:
    """The strength of least log-loss; ties to the smaller one."""
    return scores.agg(F.min_by(F.struct("c", "fold_accuracies", "accuracy", "log_loss"), F.struct("log_loss", "c")).alias("b")).select("b.*")
