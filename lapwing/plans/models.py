"""Model fitting and scoring with Spark ML, under chronological walk-forward folds."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.operators.skew import find_hot, group_percentile
from lapwing.plans import boosting, forest, gram
from lapwing.plans.forest import ForestParams
from lapwing.plans.gram import MIN_TRAIN_ROUNDS

# Blend weights by circuit type, and default model parameters.
CIRCUIT_BLEND = {"street": (0.50, 0.50), "permanent": (0.65, 0.35), "temporary": (0.55, 0.45)}
DEFAULT_BLEND = (0.65, 0.35)
ENSEMBLE = {"rf": 0.40, "xgb": 0.30, "ridge": 0.30}
FIXED_PAIR = {"rf": 0.60, "xgb": 0.40, "ridge": 0.0}

@dataclass(frozen=True)
class ModelParams:
    forest: ForestParams = field(default_factory=ForestParams)
    boost: boosting.Penalised = field(default_factory=boosting.Penalised)
    ridge_alpha: float = 100.0


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact median of every column in one melted pass; a column without values gets zero.

    The result is one number per column, so reading it on the driver is safe.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(F.inline(cells)).where(F.col("value").isNotNull())
    found = group_percentile(long, ["feature"], "value", 0.5, "median", find_hot(long, ["feature"]))
    known = {r["feature"]: r["median"] for r in found.collect()}
    return {c: known.get(c, 0.0) for c in columns}


def impute(df: DataFrame, fill: dict[str, float]) -> DataFrame:
    """Fills nulls with fitted medians; every feature is kept."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(v))) for c, v in fill.items()})


def scaling(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population spread per column (spread one for a constant), in one aggregate row."""
    row = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]
    ).first()
    out = {}
    for i, c in enumerate(columns):
        spread = row[f"s{i}"] or 0.0
        out[c] = (row[f"m{i}"] or 0.0, spread if spread > 1e-12 else 1.0)
    return out


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=out).transform(df)


class Ridge:
    """Least squares with a squared penalty on standardised inputs.

    The linear solver divides the loss by ``2n`` and scales the label by its
    spread, so the penalty ``alpha`` becomes ``alpha / n * spread(label)``.
    """

    def __init__(self, columns: Sequence[str], label: str, alpha: float = 100.0):
        self.columns, self.label, self.alpha = list(columns), label, alpha

    def fit(self, df: DataFrame) -> Ridge:
        self.scale = scaling(df, self.columns)
        stats = df.agg(F.count(self.label).alias("n"), F.stddev_pop(self.label).alias("s"), F.avg(self.label).alias("m")).first()
        self.constant = None if stats["s"] else float(stats["m"])
        if self.constant is not None:
            return self
        rows = assemble(self._scaled(df), [f"z_{c}" for c in self.columns], "z_features")
        solver = LinearRegression(
            featuresCol="z_features", labelCol=self.label, regParam=self.alpha / stats["n"] * stats["s"],
            elasticNetParam=0.0, standardization=False, solver="normal",
        )
        model = solver.fit(rows.select("z_features", F.col(self.label).cast("double").alias(self.label)))
        self.weights, self.intercept = [float(w) for w in model.coefficients], float(model.intercept)
        return self

    def _scaled(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"z_{c}": (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in self.scale.items()})

    def score(self) -> Column:
        """The prediction as a plain expression: no model object travels to the executors."""
        if self.constant is not None:
            return F.lit(self.constant)
        total = F.lit(self.intercept)
        for c, w in zip(self.columns, self.weights):
            m, s = self.scale[c]
            total = total + F.lit(w) * ((F.col(c) - F.lit(m)) / F.lit(s))
        return total


def fit_forest(train: DataFrame, columns: Sequence[str], label: str, p: ForestParams) -> forest.Forest:
    """One forest of all rows, which are told apart by their values alone."""
    rows = train.withColumn("_round", F.lit(0))
    found = boosting.ranges(rows.where(gram._known(label).isNotNull()), columns, [1], p.bins, "_round")
    return forest.fit(rows, columns, label, [1], p, found, [*columns, label], "_round")[1]


MODELS = ("rf", "xgb", "ridge")


@dataclass
class Fitted:
    columns: list[str]
    fill: dict[str, float]
    rf: forest.Forest | None = None
    ridge: Ridge | None = None

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds one column per fitted model."""
        out = impute(df, self.fill)
        if self.rf is not None:
            out = out.withColumn("rf", self.rf.score(self.columns))
        if self.ridge is not None:
            out = out.withColumn("ridge", self.ridge.score())
        return out


def fold_medians(rows: DataFrame, columns: Sequence[str], folds: Sequence[int], round_col: str = "rnd") -> dict[int, dict[str, float]]:
    """Exact medians of the known values before each fold, of all folds in one search; a column without values gets zero.

    One number a fold and column, so reading them on the driver is safe.
    """
    out = {int(f): dict.fromkeys(columns, 0.0) for f in folds}
    for r in gram.prefix_medians(rows, columns, list(out), round_col).collect():
        out[r["fold"]][columns[r["feature"]]] = r["median"]
    return out


def fit_models(
    train: DataFrame,
    columns: Sequence[str],
    label: str,
    params: ModelParams = ModelParams(),
    models: Iterable[str] = ("rf", "ridge"),
    rf: forest.Forest | None = None,
    fill: dict[str, float] | None = None,
) -> Fitted:
    """Imputes with training medians, unless ``fill`` has them, and fits a forest, unless ``rf`` has been grown already, a ridge or both."""
    columns, models = list(columns), set(models)
    if fill is None:
        whole = train.select(F.lit(0).alias("_round"), *[F.col(f"`{c}`") for c in columns])
        fill = fold_medians(whole, columns, [1], "_round")[1]
    out = Fitted(columns, fill)
    if "rf" in models:
        out.rf = rf or fit_forest(train, columns, label, params.forest)
    if "ridge" in models:
        rows = impute(train, fill).select(F.col(label).cast("double").alias(label), *[F.col(f"`{c}`") for c in columns])
        # fitting makes many passes; the cache spills to disk and lost blocks are recomputed from the source files
        rows = rows.persist()
        try:
            out.ridge = Ridge(columns, label, params.ridge_alpha).fit(rows)
        finally:
            rows.unpersist()
    return out


def _forests(
    features: DataFrame,
    columns: Sequence[str],
    label: str,
    folds: Sequence[int],
    params: ModelParams,
    keys: Sequence[str],
    round_col: str,
    found: boosting.Ranges | None = None,
) -> DataFrame:
    """Each fold's rows scored by its forest; all forests are grown together, from one binned table.

    The medians and bins of all folds come from one search, unless ``found`` has them.
    """
    columns = list(columns)
    known = features.where(gram._known(label).isNotNull())
    found = found or boosting.ranges(known, columns, folds, params.forest.bins, round_col)
    grown = forest.fit(known, columns, label, folds, params.forest, found, keys, round_col)
    fitted = {}
    for r in folds:
        fill = dict(zip(columns, found.medians[r].tolist()))
        fitted[r] = fit_models(known.where(F.col(round_col) < r), columns, label, params, ("rf",), grown[r], fill).rf
    return forest.score_folds(features, columns, keys, round_col, fitted)


def predict_folds(
    features: DataFrame,
    columns: Sequence[str],
    label: str,
    folds: Sequence[int],
    params: ModelParams = ModelParams(),
    models: Iterable[str] = MODELS,
    keys: Sequence[str] = ("series", "rnd", "entity"),
    round_col: str = "rnd",
) -> DataFrame:
    """The rows whose round is a fold, labelled or not, with a column for each model as fitted on earlier labelled rows.

    Every model takes all folds together.  Where there are boosted trees, all models
    take the medians that are found along with their bins.  ``keys`` name a row; ``features`` should be a stored table.
    """
    models, keys, columns = set(models), list(keys), list(columns)
    out = features.where(F.col(round_col).isin([int(f) for f in folds]))
    found = fills = None
    if "xgb" in models:
        found = boosting.ranges(features.where(gram._known(label).isNotNull()), columns, folds, params.boost.bins, round_col)
        fills = {f: dict(zip(columns, own.tolist())) for f, own in found.medians.items()}
    if "ridge" in models:
        out = gram.predict(features, columns, label, folds, None, params.ridge_alpha, round_col, fills)
    if "xgb" in models:
        held = boosting.fit(features, columns, label, folds, params.boost, keys, round_col, found).held
        out = out.join(held.select(*keys, "xgb"), keys)
    if "rf" in models:
        out = out.join(_forests(features, columns, label, folds, params, keys, round_col, found), keys)
    return out


def walk_forward(
    features: DataFrame,
    columns: Sequence[str],
    label: str = "ActualFinish",
    rounds: Sequence[int] | None = None,
    params: ModelParams = ModelParams(),
    models: Iterable[str] = MODELS,
    min_rounds: int = MIN_TRAIN_ROUNDS,
    round_col: str = "rnd",
    keys: Sequence[str] = ("series", "rnd", "entity"),
) -> DataFrame:
    """Out-of-fold predictions: train on rounds before r, predict round r, all folds in one long table.

    With too few rounds for a fold, the models are fitted and scored in sample.
    """
    have = gram.rounds_of(features, label, round_col)
    folds = [r for r in have[min_rounds:] if rounds is None or r in set(rounds)]
    if folds:
        known = features.where(F.col(label).isNotNull())
        return predict_folds(known, columns, label, folds, params, models, keys, round_col).withColumn("in_sample", F.lit(False))
    both = gram.as_one_fold(features, label, round_col)
    scored = predict_folds(both, columns, "_label", [1], params, models, keys, "_rnd")
    return scored.drop("_rnd", "_label").withColumn("in_sample", F.lit(True))


def blend_scores(mode: str, rf: Column, xgb: Column, ridge: Column, weights: dict[str, float] | None = None) -> Column:
    """Model score by mode: rf, xgb, ridge, hybrid (given weights, repaired) or ensemble."""
    scores = {"rf": rf, "xgb": F.coalesce(xgb, rf), "ridge": F.coalesce(ridge, rf)}
    mode = mode.lower().strip()
    if weights and (weights.get("ridge") or 0.0) >= 0.99:
        mode = "ridge"
    if mode in ("rf", "fixed_rf"):
        return scores["rf"]
    if mode in ("xgb", "fixed_xgb"):
        return scores["xgb"]
    if mode == "ridge":
        return scores["ridge"]
    base = ENSEMBLE if mode in ("ensemble", "multi") else FIXED_PAIR
    chosen = {k: (base[k] if not weights or weights.get(k) is None else float(weights[k])) for k in MODELS}
    if weights and mode not in ("ensemble", "multi"):
        chosen = {k: (float(weights[k]) if weights.get(k) is not None and float(weights[k]) >= 0 else 0.0) for k in MODELS}
    total = sum(chosen.values())
    if total <= 1e-6:
        chosen, total = dict(FIXED_PAIR), 1.0
    return sum((scores[k] * F.lit(w / total) for k, w in chosen.items()), F.lit(0.0))


def blend_with_grid(ml: Column, start_rank: Column, circuit_type: Column | None = None, weights: tuple[float, float] | None = None) -> Column:
    """``w_ml * model + w_grid * start slot``, the weights by circuit type unless given."""
    slot = F.coalesce(start_rank.cast("double"), F.lit(12.0))
    if weights is not None:
        return F.lit(weights[0]) * ml + F.lit(weights[1]) * slot
    ml_w, grid_w = F.lit(DEFAULT_BLEND[0]), F.lit(DEFAULT_BLEND[1])
    if circuit_type is not None:
        key = F.lower(F.trim(circuit_type))
        for kind, (a, b) in CIRCUIT_BLEND.items():
            ml_w = F.when(key == kind, F.lit(a)).otherwise(ml_w)
            grid_w = F.when(key == kind, F.lit(b)).otherwise(grid_w)
    return ml_w * ml + grid_w * slot


def baseline(rows: DataFrame, race: Sequence[str], start_rank: str = "start_rank") -> DataFrame:
    """The start slot as the forecast, with its ordinal rank."""
    line = Window.partitionBy(*race).orderBy(start_rank, "entity")
    return rows.withColumn("score", F.col(start_rank)).withColumn("pred_rank", F.row_number().over(line).cast("long"))


def importance(
    features: DataFrame, columns: Sequence[str], label: str, before: int, params: ModelParams = ModelParams(), round_col: str = "rnd"
) -> DataFrame:
    """Composite importance before a round: forest 0.4, boosting 0.3, absolute ridge weight 0.3, each scaled by its largest."""
    train = features.where((F.col(round_col) < before) & F.col(label).isNotNull())
    found = boosting.ranges(train.where(gram._known(label).isNotNull()), columns, [before], params.boost.bins, round_col)
    grown = forest.fit(train, columns, label, [before], params.forest, found, round_col=round_col)[before]
    fitted = fit_models(train, columns, label, params, rf=grown, fill=dict(zip(columns, found.medians[before].tolist())))
    rf = fitted.rf.importance()
    xgb = boosting.fit(train, columns, label, [before], params.boost, round_col=round_col, found=found).importance(before)
    ridge = [abs(w) for w in getattr(fitted.ridge, "weights", [0.0] * len(fitted.columns))]
    rows = [(c, float(a), float(b), float(r)) for c, a, b, r in zip(fitted.columns, rf, xgb, ridge)]  # one row per feature
    df = features.sparkSession.createDataFrame(rows, "feature string, rf double, xgb double, ridge double")
    top = df.agg(*[F.greatest(F.max(m), F.lit(1e-12)).alias(f"top_{m}") for m in MODELS]).first()
    scaled = {m: F.col(m) / F.lit(top[f"top_{m}"]) for m in MODELS}
    return df.withColumn("importance", scaled["rf"] * 0.4 + scaled["xgb"] * 0.3 + scaled["ridge"] * 0.3)
