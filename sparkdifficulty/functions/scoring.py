"""Score, band, signature and advice from the seven dimensions: on values, and as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..result import DIMENSIONS, ActionRecommendation, ComplexityProfile, DifficultyScore, DimensionResult, clip01

# Weights, thresholds, names and texts of the method.
WEIGHTS = (0.10, 0.22, 0.18, 0.15, 0.10, 0.12, 0.13)
BANDS = (("Low", 0.25), ("Moderate", 0.50), ("High", 0.75), ("Extreme", None))
TAU, TAU_PRIME = 0.50, 0.35
SIGNATURES = {"I": "Imbalance-dominated", "II": "Overlap-dominated", "III": "Fragmented", "IV": "Dimensionality-dominated", "V": "Compound"}
DOMINANT = {"D1": "I", "D2": "II", "D4": "III", "D5": "IV"}
SIGNATURE_PREPROCESSING = {
    "I": "Random Oversampling or SMOTE",
    "II": "Borderline-SMOTE or ADASYN",
    "III": "DBSMOTE or MWMOTE (cluster-aware oversampling)",
    "IV": "PCA or UMAP dimensionality reduction BEFORE resampling, then SMOTE",
    "V": "Ensemble of strategies; start with SMOTE+ENN (combined over+under)",
}
SIGNATURE_MODELS = {
    "I": ("Logistic Regression", "Linear SVM"),
    "II": ("RBF-SVM", "Kernel methods"),
    "III": ("Random Forest", "Gradient Boosting"),
    "IV": ("Linear models after dimensionality reduction", "Kernel SVM"),
    "V": ("Gradient Boosting (XGBoost/LightGBM)", "Balanced Random Forest"),
}
# Fixed rules: list, measure, comparison, threshold, text, reason. They apply in this order.
RULES = (
    ("metrics", None, "", 0, "AUC-PR", "Always recommended for imbalanced data"),
    ("metrics", None, "", 0, "F1-score (minority class)", "Always recommended for imbalanced data"),
    ("metrics", "DS", ">=", 0.50, "G-mean", "DS >= 0.50: high difficulty requires balanced recall"),
    ("metrics", "DS", ">=", 0.75, "MCC", "DS >= 0.75: extreme difficulty requires robust metric"),
    ("metrics", "D2", ">=", 0.55, "AUC-ROC", "D2 >= 0.55: overlap present, track global discrimination"),
    ("metrics", "D3", ">=", 0.55, "Recall (minority)", "D3 >= 0.55: rare/outlier sensitivity needed"),
    ("preprocessing", "DS", "<", 0.25, "No resampling recommended; standard training", "DS < 0.25: low difficulty"),
    ("resampling", None, "", 0, SIGNATURE_PREPROCESSING, "Signature {sig}: {name}"),
    ("resampling", "D3", ">=", 0.60, "Remove outlier instances before oversampling", "D3 >= 0.60: high outlier/rare fraction"),
    ("resampling", "D5", ">=", 0.70, "Mandatory: dimensionality reduction before any resampling", "D5 >= 0.70: severe dimensionality burden"),
    ("resampling", "IR", ">", 100, "Under-sampling of majority class (RandomUnderSampler or NearMiss)", "IR > 100: extreme imbalance"),
    ("models", None, "", 0, {k: v[0] for k, v in SIGNATURE_MODELS.items()}, "Signature {sig}: {name}"),
    ("models", None, "", 0, {k: v[1] for k, v in SIGNATURE_MODELS.items()}, "Signature {sig}: {name}"),
    ("models", "DS", ">=", 0.75, "Cost-sensitive learning (class_weight='balanced' or custom)", "DS >= 0.75: extreme difficulty"),
    ("models", "D3", ">=", 0.60, "One-class classification or isolation forest (baseline comparison)", "D3 >= 0.60: high outlier fraction"),
    ("models", "N", ">", 100_000, "Prefer linear or tree-based models (scalability)", "N > 100,000: large dataset"),
    ("validation", None, "", 0, "Stratified k-fold cross-validation (k=5 or k=10)", "Always: preserves IR in folds"),
    ("validation", None, "", 0, "Report confidence intervals over folds", "Always: assess stability"),
    ("validation", "IR", ">", 20, "Use k=10 folds minimum (minority class too small for k=5)", "IR > 20: minority too small for k=5"),
    ("validation", "DS", ">=", 0.75, "Repeated stratified k-fold (5x10) for stability", "DS >= 0.75: extreme difficulty requires stability"),
    ("validation", "N", "<", 500, "Leave-one-out CV or stratified 5-fold with bootstrap", "N < 500: very small dataset"),
    ("validation", "D4", ">=", 0.55, "Validate that each fold contains all sub-concepts", "D4 >= 0.55: fragmented minority"),
    ("validation", "D2", ">=", 0.70, "Compare with and without resampling to quantify overlap impact", "D2 >= 0.70: high overlap"),
)
# Fixed warnings: conditions that all hold, and the text.
WARNINGS = (
    ((("IR", ">", 5),), "Accuracy is not a reliable metric for this dataset (IR={ir:.1f}). Use AUC-PR."),
    ((("IR", ">", 5),), "Random (non-stratified) train/test split not recommended (IR={ir:.1f})."),
    ((("DS", ">=", 0.75), ("D4", ">=", 0.60)), "High fragmentation detected. Standard SMOTE may generate noisy synthetic samples between disjunct sub-concepts. Use cluster-aware oversampling."),
    ((("D5", ">=", 0.70),), "Effective dimensionality is high relative to minority density. k-NN based methods (SMOTE, kDN) may be unreliable without prior dimensionality reduction."),
    ((("N", "<", 200), ("DS", ">=", 0.50)), "Very small dataset with high difficulty. Results may be highly variable across validation folds."),
    ((("D3", ">=", 0.70),), "Majority of minority instances are rare or outliers. Consider whether these are genuine minority instances or mislabeled noise."),
)


def check_weights(weights: tuple[float, ...]) -> tuple[float, ...]:
    if len(weights) != 7 or abs(sum(weights) - 1) > 1e-9 or min(weights) < 0:
        raise ValueError("seven weights of at least 0 that sum to 1 are needed")
    return tuple(weights)


def band(value: float) -> str:
    return next(name for name, below in BANDS if below is None or value < below)


def difficulty_score(dimensions: list[DimensionResult], weights: tuple[float, ...] = WEIGHTS) -> DifficultyScore:
    check_weights(weights)
    if tuple(d.dimension_id for d in dimensions) != DIMENSIONS:
        raise ValueError("the dimensions must be D1 to D7, in order")
    value = clip01(sum(w * d.value for w, d in zip(weights, dimensions, strict=True)))
    return DifficultyScore(value, band(value), tuple(weights), dimensions)


def profile(score: DifficultyScore, tau: float = TAU, tau_prime: float = TAU_PRIME) -> ComplexityProfile:
    values = {d.dimension_id: d.value for d in score.dimensions}
    over = lambda t: sorted((k for k, v in values.items() if v > t), key=lambda k: -values[k])
    top = max(DOMINANT, key=values.__getitem__)  # the first of equal ones
    dominant = top if values[top] > tau else None
    signature = DOMINANT[dominant] if dominant else "V"
    elevated = over(tau_prime)
    qualifier = None if dominant else ("low", "single", "compound")[min(len(elevated), 2)]
    return ComplexityProfile(tuple(values.values()), signature, SIGNATURES[signature], dominant, qualifier, over(tau), elevated, tau, tau_prime)


_holds = {">=": lambda a, b: a >= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b}


def action(found: ComplexityProfile, score: DifficultyScore, n: int, ir: float) -> ActionRecommendation:
    known = dict(zip(DIMENSIONS, found.vector, strict=True)) | {"DS": score.value, "N": n, "IR": ir}
    lists: dict[str, list[str]] = {k: [] for k in ("metrics", "preprocessing", "models", "validation")}
    why: dict[str, str] = {}
    for kind, measure, sign, threshold, text, reason in RULES:
        if kind == "resampling" and score.value < 0.25 or measure and not _holds[sign](known[measure], threshold):
            continue
        item = text[found.signature] if isinstance(text, dict) else text
        into = lists["preprocessing" if kind == "resampling" else kind]
        if item not in into:
            into.append(item)
            why[item] = reason.format(sig=found.signature, name=found.signature_name)
    said = [text.format(ir=ir) for conditions, text in WARNINGS if all(_holds[s](known[m], t) for m, s, t in conditions)]
    return ActionRecommendation(lists["metrics"], lists["preprocessing"], lists["models"], lists["validation"], why, said)


# the same as expressions on columns D1..D7


def score_column(weights: tuple[float, ...] = WEIGHTS) -> Column:
    total = F.lit(0.0)
    for w, d in zip(check_weights(weights), DIMENSIONS, strict=True):
        total = total + F.lit(w) * F.col(d)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def band_column(value: Column) -> Column:
    out = F.lit(BANDS[-1][0])
    for name, below in reversed(BANDS[:-1]):
        out = F.when(value < below, F.lit(name)).otherwise(out)
    return out


def dominant_column(tau: float = TAU) -> Column:
    peak = F.greatest(*[F.col(d) for d in DOMINANT])
    out = F.lit(None).cast("string")
    for d in reversed(DOMINANT):
        out = F.when(F.col(d) == peak, F.lit(d)).otherwise(out)
    return F.when(peak > tau, out)


def signature_column(tau: float = TAU) -> Column:
    out = F.lit("V")
    for d, s in DOMINANT.items():
        out = F.when(dominant_column(tau) == d, F.lit(s)).otherwise(out)
    return out


def over_column(threshold: float) -> Column:
    """Ids of the dimensions over the threshold, largest first, ties by id."""
    pairs = F.array(*[F.struct((-F.col(d)).alias("v"), F.lit(d).alias("d")) for d in DIMENSIONS])
    return F.transform(F.array_sort(F.filter(pairs, lambda p: p["v"] < -threshold)), lambda p: p["d"])


def qualifier_column(tau: float = TAU, tau_prime: float = TAU_PRIME) -> Column:
    n = F.size(over_column(tau_prime))
    return F.when(dominant_column(tau).isNull(), F.when(n >= 2, "compound").when(n == 1, "single").otherwise("low"))
