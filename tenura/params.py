"""Business parameters, passed to operators; nothing reads them as globals."""

from __future__ import annotations

from dataclasses import dataclass

# Missing-value markers, compared after strip and lower-casing.
MISSING_MARKERS = ("", "n/a", "na", "nan", "null", "none", "#n/a", "-", "nd", "nr", "inconnu")

# Columns that must never reach a model.
DENIED_COLUMNS = (
    "client_id",
    "churn",
    "valeur_vie_client_eur",
    "sante_compte_fin_periode",
    "commentaire_csm",
)

# Suspected decoys, screened before any decision.
SUSPECTED_DECOYS = (
    "couleur_theme_interface",
    "code_datacenter",
    "groupe_experimentation",
    "commentaire_csm",
)

# Kept in the gold table, used for splits, not modelled.
UNMODELLED_COLUMNS = ("date_souscription", "jour_souscription")

# Columns that cannot be negative, by name and by prefix.
POSITIVE_COLUMNS = (
    "anciennete_mois",
    "sieges_souscrits",
    "utilisateurs_actifs",
    "connexions_30j",
    "heures_usage_30j",
    "fonctionnalites_total",
    "fonctionnalites_utilisees",
    "nb_integrations",
    "derniere_connexion_jours",
    "tickets_support_90j",
    "delai_reponse_support_h",
    "retards_paiement_12m",
    "revenu_mensuel_recurrent_eur",
    "valeur_vie_client_eur",
)
POSITIVE_PREFIXES = (
    "mrr",
    "arr",
    "nb_",
    "nombre_",
    "sieges",
    "utilisateurs",
    "anciennete",
    "score",
    "valeur",
    "montant",
    "revenue",
    "ca_",
)

# Fixed values: (id, variable, expected direction of the link with churn).
HYPOTHESES = (
    ("H1", "taux_adoption_pct", "-"),
    ("H2", "connexions_30j", "-"),
    ("H3", "heures_usage_30j", "-"),
    ("H4", "fonctionnalites_utilisees", "-"),
    ("H5", "derniere_connexion_jours", "+"),
    ("H6", "tickets_support_90j", "+"),
    ("H7", "csat", "-"),
    ("H8", "retards_paiement_12m", "+"),
    ("H9", "taux_utilisation_sieges", "-"),
    ("H10", "connexions_par_utilisateur", "-"),
    ("H11", "nb_integrations", "-"),
    ("H12", "taux_couverture_fonctionnelle", "-"),
    ("H13", "csat", "-"),
    ("H14", "anciennete_mois", "-"),
)
TOP_OF_DISTRIBUTION = ("H13",)

DAYS_PER_MONTH = 30.44


@dataclass(frozen=True)
class Economics:
    """Hypotheses behind every money figure."""

    gross_margin: float = 0.72
    horizon_months: int = 12
    success_rate: float = 0.30
    hourly_cost: float = 55.0
    hours_per_action: float = 2.0
    capacity: int = 45
    success_range: tuple[float, ...] = (0.20, 0.25, 0.30, 0.35, 0.40)
    capacity_range: tuple[int, ...] = (15, 30, 45, 60, 90, 120)

    @property
    def action_cost(self) -> float:
        return self.hourly_cost * self.hours_per_action

    @property
    def revenue_multiple(self) -> float:
        return self.horizon_months * self.gross_margin


@dataclass(frozen=True)
class Thresholds:
    """Decision thresholds fixed before any result is seen."""

    red_alert: float = 0.60
    watch: float = 0.40
    vigilance_recall: float = 0.80
    inactivity_days: int = 30
    low_csat: int = 2
    redundancy: float = 0.70
    leak_auc: float = 0.85
    skew_log: float = 1.0
    adoption_gap_points: float = 1.0
    tenure_tolerance_months: int = 3
    fairness_tpr_gap: float = 0.15
    fairness_calibration_gap: float = 0.05
    fairness_min_positives: int = 30
    pr_auc_min: float = 0.65
    pr_auc_critical: float = 0.60
    promotion_tolerance: float = 0.01
    complexity_gain: float = 0.02
    rollback_points: float = 10.0
    value_r2_min: float = 0.50
    value_mae_gain_min: float = 0.30
    value_r2_leak: float = 0.99
    psi_stable: float = 0.10
    psi_attention: float = 0.20
    alpha: float = 0.05


ECONOMICS = Economics()
THRESHOLDS = Thresholds()

# Business labels of the model's variables, as account sheets print them.
FACTOR_LABELS = {
    "anciennete_mois": "Ancienneté (mois)",
    "sieges_souscrits": "Sièges souscrits",
    "utilisateurs_actifs": "Utilisateurs actifs",
    "taux_adoption_pct": "Taux d'adoption des sièges (%)",
    "connexions_30j": "Connexions sur 30 jours",
    "heures_usage_30j": "Heures d'usage sur 30 jours",
    "fonctionnalites_total": "Fonctionnalités disponibles",
    "fonctionnalites_utilisees": "Fonctionnalités utilisées",
    "nb_integrations": "Intégrations actives",
    "derniere_connexion_jours": "Jours depuis la dernière connexion",
    "tickets_support_90j": "Tickets support sur 90 jours",
    "delai_reponse_support_h": "Délai de réponse du support (h)",
    "csat": "Satisfaction client (CSAT, sur 5)",
    "retards_paiement_12m": "Retards de paiement sur 12 mois",
    "revenu_mensuel_recurrent_eur": "Revenu mensuel récurrent (€)",
    "taux_utilisation_sieges": "Taux d'utilisation des sièges",
    "surdimensionnement": "Sièges payés mais inutilisés",
    "intensite_usage_par_utilisateur": "Heures d'usage par utilisateur",
    "connexions_par_utilisateur": "Connexions par utilisateur",
    "taux_couverture_fonctionnelle": "Part des fonctionnalités utilisées",
    "arpu_par_siege": "Revenu par siège (€)",
    "recence_normalisee": "Inactivité rapportée à l'ancienneté",
    "compte_dormant": "Compte dormant",
    "pression_support": "Pression support (tickets par utilisateur)",
    "csat_manquant": "CSAT non renseigné",
    "heures_usage_30j_manquant": "Heures d'usage non renseignées",
    "delai_reponse_support_h_manquant": "Délai support non renseigné",
    "prix_mensuel_par_siege_eur": "Prix catalogue par siège (€)",
    "fonctionnalites_incluses": "Fonctionnalités incluses dans le plan",
    "sla_reponse_h": "Engagement de réponse du plan (h)",
    "quota_stockage_go": "Quota de stockage du plan (Go)",
    "support_dedie": "Support dédié",
    "remise_consentie": "Remise consentie",
    "adequation_plan": "Adéquation du plan",
    "taux_churn_median_saas_pct": "Churn médian du secteur (%)",
    "dynamique_croissance": "Dynamique du secteur",
    "ecart_adoption_secteur": "Adoption comparée au secteur",
    "zone_reglementaire": "Zone réglementaire",
    "langue_support_fr": "Support en français",
    "decalage_horaire_paris_h": "Décalage horaire avec Paris (h)",
    "ecart_csat_secteur": "CSAT comparé au secteur",
    "secteur": "Secteur",
    "pays": "Pays",
    "taille_entreprise": "Taille d'entreprise",
    "plan": "Plan",
    "tranche_anciennete": "Phase de vie du compte",
    "tranche_integrations": "Niveau d'intégration",
    "couleur_theme_interface": "Thème d'interface",
    "code_datacenter": "Datacenter",
    "groupe_experimentation": "Groupe d'expérimentation",
}
