"""Queries of Spark ML jobs over the account view."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenura.functions import maths
from tenura.functions.maths import signed_log
from tenura.operators import features, many, ml, references, search, splits
from tenura.operators.features import rule_baseline
from tenura.operators.metrics import threshold_for_recall
from tenura.plans import scoring
from tenura.plans.accounts import DECOYS, accounts
from tenura.queries.exploration import rounded
from tenura.queries.registry import query
from tenura.queries.twins import ACC
from tenura.sources import files
from tenura.streaming.monitoring import run_to_table

NUMERIC = ["anciennete_mois", "derniere_connexion_jours", "csat", "connexions_30j", "tickets_support_90j",
           "retards_paiement_12m", "heures_usage_30j"]
LABELS = ["taille_entreprise", "plan"]
KEY, Y, MRR = "client_id", "churn", "revenu_mensuel_recurrent_eur"
ORDER = "(k * 7919) % 10007"


def sample(spark, folder, *extra):
    """Narrow training columns."""
    return accounts(spark, folder).select("k", KEY, Y, MRR, *NUMERIC, *LABELS, *extra)


def parts(spark, folder, *extra):
    """Train and test rows; the split is written once because every fit reads it several times."""
    split = splits.stratified_split(sample(spark, folder, *extra), Y, KEY)
    split = files.materialise(split, "split")
    return split.where("part = 'train'").drop("part"), split.where("part = 'test'").drop("part")


def everyone(spark, folder):
    """The training rows, and the whole portfolio to score."""
    split = splits.stratified_split(sample(spark, folder), Y, KEY)
    split = files.materialise(split, "split")
    return split.where("part = 'train'").drop("part"), split.drop("part")


FOLDS, REPEATS = 5, 3
REPEATED = [f"pli_{r}" for r in range(REPEATS)]


def folded(spark, folder, repeats=1):
    """Training columns and folds; written before ranking too, which reads the rows several times."""
    folds = splits.repeated_stratified_folds(
        files.materialise(sample(spark, folder), "sample"), Y, KEY, FOLDS, repeats
    )
    return files.materialise(folds, "folds")


@query(
    "stratified_split",
    f"""{ACC}, r AS (SELECT client_id, churn, row_number() OVER (PARTITION BY churn ORDER BY {ORDER}, client_id) AS r,
      count(*) OVER (PARTITION BY churn) AS n FROM accounts)
    SELECT client_id, churn, CASE WHEN r <= round_even(0.8 * n, 0) THEN 'train' ELSE 'test' END AS part FROM r""",
)
def stratified_split(spark, folder):
    df = accounts(spark, folder)
    out = splits.stratified_split(df, Y, KEY, order=F.expr(ORDER))
    return out.select(KEY, Y, "part")


@query(
    "quartile_stratified_split",
    f"""{ACC}, v AS (SELECT * FROM accounts WHERE valeur_vie_client_eur IS NOT NULL),
    q AS (SELECT [quantile_cont(valeur_vie_client_eur, 0.25), quantile_cont(valeur_vie_client_eur, 0.5),
      quantile_cont(valeur_vie_client_eur, 0.75)] AS q FROM v),
    s AS (SELECT v.*, CAST(len(list_filter(q, lambda e: e < valeur_vie_client_eur)) AS INTEGER) AS strate FROM v, q),
    r AS (SELECT client_id, strate, row_number() OVER (PARTITION BY strate ORDER BY {ORDER}, client_id) AS r,
      count(*) OVER (PARTITION BY strate) AS n FROM s)
    SELECT client_id, strate, CASE WHEN r <= round_even(0.8 * n, 0) THEN 'train' ELSE 'test' END AS part FROM r""",
)
def quartile_stratified_split(spark, folder):
    known = accounts(spark, folder).where("valeur_vie_client_eur IS NOT NULL")
    out = splits.quartile_stratified_split(
        known, "valeur_vie_client_eur", KEY, order=F.expr(ORDER)
    )
    return out.select(KEY, "strate", "part")


@query(
    "repeated_stratified_folds",
    ACC + " SELECT client_id, " + ", ".join(
        f"CAST((row_number() OVER (PARTITION BY churn ORDER BY ({ORDER} * {r + 1}) % 10007, client_id) - 1) % 5 AS INTEGER) AS pli_{r}"
        for r in range(3)
    ) + " FROM accounts",
)
def repeated_stratified_folds(spark, folder):
    out = splits.repeated_stratified_folds(
        accounts(spark, folder), Y, KEY, 5, 3, order=F.expr(ORDER)
    )
    return out.select(KEY, "pli_0", "pli_1", "pli_2")


@query("preprocessing")
def preprocessing(spark, folder):
    train, portfolio = everyone(spark, folder)
    from pyspark.ml import Pipeline

    model = Pipeline(stages=ml.preprocessing(NUMERIC, LABELS)).fit(ml.typed_inputs(train, NUMERIC, LABELS))
    out = model.transform(ml.typed_inputs(portfolio, NUMERIC, LABELS))
    x = ml.vector_to_array("features")
    return out.select(KEY, F.size(x).alias("n_features"), F.round(F.aggregate(x, F.lit(0.0), lambda a, b: a + b), 6).alias("somme"))


@query("fit_logistic_recalibrated")
def fit_logistic_recalibrated(spark, folder):
    train, portfolio = everyone(spark, folder)
    return ml.fit_logistic(train, Y, NUMERIC, LABELS).score(portfolio).select(KEY, Y, "p")


_COEF, _MEAN = (0.04, -0.3, 0.02), (20.0, 3.0, 15.0)


@query(
    "linear_contributions",
    ACC + " SELECT client_id, " + ", ".join(
        f"round((CAST(coalesce({c}, 0) AS DOUBLE) - {m}) * {b}, 6) AS c_{c}"
        for c, b, m in zip(("derniere_connexion_jours", "csat", "tickets_support_90j"), _COEF, _MEAN, strict=True)
    ) + " FROM accounts",
)
def linear_contributions(spark, folder):
    columns = ("derniere_connexion_jours", "csat", "tickets_support_90j")
    x = F.array(*[F.coalesce(F.col(c), F.lit(0)).cast("double") for c in columns])
    df = accounts(spark, folder).select(KEY, ml.linear_contributions(x, _COEF, _MEAN).alias("c"))
    return df.select(KEY, *[F.round(F.col("c")[i], 6).alias(f"c_{c}") for i, c in enumerate(columns)])


@query(
    "top_factors",
    ACC + """, c AS (SELECT client_id, unnest([{'v': 'derniere_connexion_jours', 'w': (CAST(coalesce(derniere_connexion_jours, 0) AS DOUBLE) - 20) * 0.04},
        {'v': 'csat', 'w': (CAST(coalesce(csat, 0) AS DOUBLE) - 3) * -0.3},
        {'v': 'tickets_support_90j', 'w': (CAST(coalesce(tickets_support_90j, 0) AS DOUBLE) - 15) * 0.02}]) AS f FROM accounts),
    g AS (SELECT client_id, string_agg(f.v, ' > ' ORDER BY f.w DESC, f.v DESC) AS facteurs FROM c WHERE f.w > 0 GROUP BY client_id)
    SELECT client_id, coalesce(facteurs, '') AS facteurs FROM accounts LEFT JOIN g USING (client_id)""",
)
def top_factors(spark, folder):
    columns = ("derniere_connexion_jours", "csat", "tickets_support_90j")
    x = F.array(*[F.coalesce(F.col(c), F.lit(0)).cast("double") for c in columns])
    df = accounts(spark, folder).withColumn("c", ml.linear_contributions(x, _COEF, _MEAN))
    found = ml.top_factors(F.col("c"), [(c, None) for c in columns])
    return df.select(KEY, F.array_join(F.transform(found, lambda f: f["variable"]), " > ").alias("facteurs"))


@query("score_and_explain")
def score_and_explain(spark, folder):
    train, portfolio = everyone(spark, folder)
    out = ml.fit_logistic(train, Y, NUMERIC, LABELS).score_and_explain(portfolio)
    return out.select(KEY, "p", F.array_join(F.transform("facteurs", lambda f: f["libelle"]), " | ").alias("facteurs"))


@query("cross_validate")
def cross_validate(spark, folder):
    df = folded(spark, folder, REPEATS)
    scores = search.cross_validate_logistic(df, Y, KEY, NUMERIC, LABELS, REPEATED, FOLDS)
    return ml.summarise_folds(scores)


def out_of_fold(spark, folder):
    """(key, y, p) of five models that did not see their fold, fitted together."""
    encoded = many.encode(folded(spark, folder), Y, KEY, NUMERIC, LABELS, ["pli_0"])
    return many.held_out_scores(encoded, many.fit(encoded, many.fold_specs(["pli_0"], FOLDS)))


@query("out_of_fold_scores")
def out_of_fold_scores(spark, folder):
    return out_of_fold(spark, folder).select(F.col("key").alias(KEY), F.col("pli").alias("pli_0"), "p")


@query("vigilance_threshold")
def vigilance_threshold(spark, folder):
    return threshold_for_recall(out_of_fold(spark, folder).select("y", "p"))


@query("compare_models")
def compare_models(spark, folder):
    """Draw, rule, logistic, forest of 200 trees, 200 boosting rounds: 5 folds, 3 repetitions."""
    df = folded(spark, folder, REPEATS)
    rate = df.agg(F.avg(Y)).first()[0]
    plain = {"dummy": (maths.uniform(F.col(KEY), 42) < rate).cast("double"), "regle": rule_baseline(df).cast("double")}
    scores = search.compare_models(df, Y, KEY, NUMERIC, LABELS, REPEATED, plain, FOLDS)
    return ml.summarise_folds(scores, ["modele"])


@query("imbalance_comparison")
def imbalance_comparison(spark, folder):
    return search.imbalance_comparison(folded(spark, folder), Y, KEY, NUMERIC, LABELS, "pli_0", FOLDS)


@query("hyperparameter_search")
def hyperparameter_search(spark, folder):
    """30 trials of each of two families on shared folds; the defaults are trial 0."""
    df = folded(spark, folder)
    return search.random_search(df, Y, KEY, NUMERIC, LABELS, "pli_0", families=("logistique", "foret"))


# fold scores for the paired tests: one mean per "model" (plan) and fold (key modulo 15)
_FOLDS = """, fs AS (SELECT CASE k % 4 WHEN 0 THEN 'regle' WHEN 1 THEN 'logistique' WHEN 2 THEN 'foret' ELSE 'arbres_boostes' END AS modele,
    CAST(k // 4 % 15 AS INTEGER) AS pli, round(avg(p), 4) AS pr_auc FROM accounts GROUP BY 1, 2),
  me AS (SELECT modele, avg(pr_auc) AS m FROM fs GROUP BY 1), ch AS (SELECT arg_max(modele, m) AS champion FROM me),
  d AS (SELECT f.modele, champion, t.pr_auc - f.pr_auc AS d FROM fs f CROSS JOIN ch JOIN fs t ON t.modele = champion AND t.pli = f.pli
    WHERE f.modele <> champion),
  rk AS (SELECT *, rank() OVER (PARTITION BY modele ORDER BY abs(d)) + (count(*) OVER (PARTITION BY modele, abs(d)) - 1) / 2.0 AS r
    FROM d WHERE d <> 0)"""


def _fold_scores(spark, folder):
    name = F.element_at(
        F.array(*[F.lit(m) for m in ("regle", "logistique", "foret", "arbres_boostes")]), (F.col("k") % 4 + 1).cast("int")
    )
    fold = F.expr("CAST(k div 4 % 15 AS INT)")
    return accounts(spark, folder).groupBy(name.alias("modele"), fold.alias("pli")).agg(
        F.round(F.avg("p"), 4).alias("pr_auc")
    )


@query(
    "superiority_tests",
    ACC + _FOLDS + """ SELECT modele, champion, (SELECT count(*) FROM d x WHERE x.modele = d.modele) AS n_plis,
      count(*) FILTER (d > 0) AS victoires, round(avg(d), 6) AS ecart_moyen,
      CAST(coalesce((SELECT sum(r) FROM rk WHERE rk.modele = d.modele AND rk.d > 0), 0) AS DOUBLE) AS w_plus
    FROM d GROUP BY modele, champion""",
)
def superiority_tests(spark, folder):
    return rounded(ml.superiority_tests(_fold_scores(spark, folder), with_p=False), "ecart_moyen")


@query("superiority_p_values")
def superiority_p_values(spark, folder):
    return ml.superiority_tests(_fold_scores(spark, folder))


@query(
    "select_parsimonious",
    ACC + _FOLDS + """, t AS (SELECT modele, avg(d) > 0.002 AND avg(d) >= 0.003 AS battu FROM d GROUP BY 1),
    c AS (SELECT me.modele, m, CASE me.modele WHEN 'regle' THEN 1 WHEN 'logistique' THEN 2 WHEN 'foret' THEN 3 ELSE 4 END AS l
      FROM me LEFT JOIN t USING (modele) WHERE NOT coalesce(battu, false))
    SELECT count(*) AS n_candidats, arg_min(modele, (l, -m)) AS retenu FROM c""",
)
def select_parsimonious(spark, folder):
    scores = _fold_scores(spark, folder)
    tests = ml.superiority_tests(scores, with_p=False).withColumn("significatif", F.col("ecart_moyen") > 0.002)
    means = scores.groupBy("modele").agg(F.avg("pr_auc").alias("pr_auc_moyenne"))
    return ml.select_parsimonious(means, tests, gain=0.003)


@query("log_ablation")
def log_ablation(spark, folder):
    df = folded(spark, folder, REPEATS)
    logged = df.withColumns({c: signed_log(F.col(c).cast("double")) for c in ("derniere_connexion_jours", "tickets_support_90j")})
    scores = [
        search.cross_validate_logistic(t, Y, KEY, NUMERIC, LABELS, REPEATED, FOLDS, name=name)
        for name, t in (("brut", df), ("log", logged))
    ]
    return ml.superiority_tests(scores[0].unionByName(scores[1]))


@query("value_regression")
def value_regression(spark, folder):
    df = sample(spark, folder, "valeur_vie_client_eur")
    return ml.value_regression(df, "valeur_vie_client_eur", KEY, [MRR, *NUMERIC], LABELS)


@query("native_importance")
def native_importance(spark, folder):
    train, _ = parts(spark, folder)
    return ml.native_importance(ml.fit_logistic(train, Y, NUMERIC, LABELS), train)


@query("permutation_importance")
def permutation_importance(spark, folder):
    train, test = parts(spark, folder)
    scorer = ml.fit_logistic(train, Y, NUMERIC, LABELS)
    return ml.permutation_importance(
        test, scorer.score, Y, KEY, [*NUMERIC, *LABELS], 20
    )


def split_with(spark, folder, *extra):
    """The account rows with `part`, once written."""
    return files.materialise(splits.stratified_split(sample(spark, folder, *extra), Y, KEY), "split")


@query("drop_column_importance")
def drop_column_importance(spark, folder):
    """Every column of the model and the suspected decoys."""
    return search.drop_column_importance(split_with(spark, folder, *DECOYS), Y, KEY, NUMERIC, [*LABELS, *DECOYS])


@query("leak_experiment")
def leak_experiment(spark, folder):
    suspect = "sante_compte_fin_periode"
    return search.leak_experiment(split_with(spark, folder, suspect), Y, KEY, NUMERIC, suspect)


@query("robustness_curve")
def robustness_curve(spark, folder):
    train, test = parts(spark, folder)
    scorer = ml.fit_logistic(train, Y, NUMERIC, LABELS)
    return ml.robustness_curve(test, scorer.score, Y, KEY, NUMERIC)


@query("retrain")
def retrain(spark, folder):
    df = sample(spark, folder).drop("k")
    _, report = scoring.retrain(df, Y, KEY)
    return report


@query("score_accounts")
def score_accounts(spark, folder):
    train, portfolio = everyone(spark, folder)
    return scoring.score_accounts(portfolio, ml.fit_logistic(train, Y, NUMERIC, LABELS), 0.4, KEY, MRR)


@query("nightly_scoring")
def nightly_scoring(spark, folder):
    """Retrain, store, load the stored model, score and publish a date. The gate is open: these tables have no signal."""
    df = files.materialise(sample(spark, folder).drop("k"), "accounts")  # the split reads it several times, then the scoring
    path = files.scratch(spark, "model")
    scoring.save_model(*scoring.retrain(df, Y, KEY, least=0.0), path)
    scorer, watch = scoring.load_model(spark, path)
    return scoring.nightly_scoring(df, scorer, watch, files.scratch(spark, "nightly"), "2024-01-31")


# What this deployment does about a factor, by fragment of its name.
FOLLOW_UP = {"tickets": "point avec le support", "csat": "entretien client", "connexion": "prise de contact"}


@query("account_sheets")
def account_sheets(spark, folder):
    train, portfolio = everyone(spark, folder)
    scorer = ml.fit_logistic(train, Y, NUMERIC, LABELS)
    sheets = scoring.account_sheets(portfolio, scorer, 0.4, KEY, MRR, FOLLOW_UP, "relecture du compte")
    names = lambda c: F.array_join(F.transform(c, lambda f: f["libelle"]), " | ").alias(c)
    return sheets.select(
        KEY, "proba_churn", "niveau_risque", "valeur_risque_eur", names("facteurs_churn"),
        names("facteurs_protection"), "action_preventive",
    )


@query("score_requests")
def score_requests(spark, folder):
    train, _ = parts(spark, folder)
    scorer = ml.fit_logistic(train, Y, NUMERIC, LABELS)
    requests = features.rebuild_adoption_rate(accounts(spark, folder)).drop("p", "t0")
    out = scoring.score_requests(requests, scorer, references.catalogue(spark), 0.4)
    return out.select(KEY, "p", "decision", "valeur_a_risque_eur", F.array_join("signaux", " | ").alias("signaux"))


@query("score_requests_stream")
def score_requests_stream(spark, folder):
    """The same requests arriving as a stream; the fitted model scores each micro-batch."""
    train, _ = parts(spark, folder)
    scorer = ml.fit_logistic(train, Y, NUMERIC, LABELS)
    arriving = files.scratch(spark, "requests")
    requests = features.rebuild_adoption_rate(accounts(spark, folder)).drop("p", "t0")
    requests.write.parquet(arriving)
    stream = spark.readStream.schema(requests.schema).parquet(arriving)
    scored = scoring.score_requests(stream, scorer, references.catalogue(spark), 0.4)
    kept = scored.select(KEY, "p", "decision", "valeur_a_risque_eur", F.array_join("signaux", " | ").alias("signaux"))
    return run_to_table(kept, files.scratch(spark, "requests-scored"), "append")
