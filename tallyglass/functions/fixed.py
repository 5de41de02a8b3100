"""Fixed values. Results must agree with the reference, so these are stated as they are."""

# --- fixed values: patterns for personal data, in order of priority -------------------------
PII_PATTERNS = {
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "iban": r"^[A-Z]{2}\d{2}[A-Z0-9]{10,30}$",
    "siret": r"^\d{14}$",
    "ipv4": r"^(\d{1,3}\.){3}\d{1,3}$",
    "phone": r"^\+?[\d\s().-]{8,20}$",
}
PII_SHARE = 0.8
DATE_LIKE = r"^\d{4}-\d{2}-\d{2}([ T].*)?$"
PHONE_DIGITS = (10, 15)

# --- fixed values: column-name hints for personal data --------------------------------------
PII_NAME_HINTS = {
    "email": ("email", "mail", "courriel"),
    "phone": ("phone", "tel", "telephone", "mobile", "gsm"),
    "iban": ("iban", "rib"),
    "siret": ("siret", "siren"),
    "name": ("nom", "name", "prenom", "firstname", "lastname", "surname"),
    "address": ("adresse", "address", "rue", "street"),
}

# --- fixed values: types hidden in text, and formats checked for validity -------------------
TEXT_DATE = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2})?)?$"
TEXT_INTEGER = r"^-?\d+$"
TEXT_DECIMAL = r"^-?\d+[.,]\d+$"
TEXT_BOOLEANS = ("true", "false", "t", "f", "0", "1", "yes", "no", "oui", "non")
FORMATS = {
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "phone": r"^\+?[0-9 ().-]{8,20}$",
    "iban": r"^[A-Z]{2}\d{2}[A-Z0-9]{10,30}$",
    "siret": r"^\d{14}$",
    "date": TEXT_DATE,
    "integer": TEXT_INTEGER,
    "numeric": r"^-?\d+([.,]\d+)?$",
}

# --- fixed values: delimited files -----------------------------------------------------------
DELIMITERS = ",;\t|"
FILE_INTEGER = r"^-?\d+$"
FILE_REAL = r"^-?\d+[.]?\d*$"

# --- fixed values: quality dimensions --------------------------------------------------------
QUALITY_WEIGHTS = {
    "completeness": 0.30,
    "validity": 0.25,
    "uniqueness": 0.15,
    "consistency": 0.15,
    "freshness": 0.15,
}
FRESH_DAYS = 90
STALE_DAYS = 730
NEAR_UNIQUE_RATIO = 0.98
NEAR_UNIQUE_ROWS = 20

# --- fixed values: the concept lexicon, in order ---------------------------------------------
LEXICON = (
    {
        "concept": "Client",
        "description": "A person or company that buys.",
        "name_hints": ("customer", "client", "cust", "buyer", "acheteur", "compte"),
        "table_hints": ("customers", "clients", "accounts"),
    },
    {
        "concept": "Produit",
        "description": "A good or service on sale.",
        "name_hints": ("product", "produit", "article", "item", "sku"),
        "table_hints": ("products", "produits", "articles", "items"),
    },
    {
        "concept": "Commande",
        "description": "A purchase order or sale.",
        "name_hints": ("order", "commande", "purchase", "vente", "sale"),
        "table_hints": ("orders", "commandes", "sales", "ventes"),
    },
    {
        "concept": "Montant",
        "description": "An amount of money.",
        "name_hints": ("amount", "price", "total", "montant", "prix", "cost", "revenue", "ca"),
        "numeric_only": True,
    },
    {
        "concept": "Quantité",
        "description": "A number of units.",
        "name_hints": ("quantity", "qty", "quantite", "nombre", "count", "units"),
        "numeric_only": True,
    },
    {
        "concept": "Magasin",
        "description": "A place of sale.",
        "name_hints": ("store", "shop", "magasin", "boutique", "pos"),
        "table_hints": ("stores", "magasins", "shops"),
    },
    {
        "concept": "Paiement",
        "description": "The settlement of an order.",
        "name_hints": ("payment", "paiement", "reglement", "paid"),
        "table_hints": ("payments", "paiements"),
    },
    {
        "concept": "Email",
        "description": "An e-mail address.",
        "name_hints": ("email", "mail", "courriel"),
        "pii": "email",
    },
    {
        "concept": "Téléphone",
        "description": "A telephone number.",
        "name_hints": ("phone", "tel", "telephone", "mobile"),
        "pii": "phone",
    },
    {
        "concept": "Nom",
        "description": "What a person or thing is called.",
        "name_hints": ("name", "nom", "prenom", "firstname", "lastname", "full_name"),
        "pii": "name",
    },
    {
        "concept": "Date",
        "description": "A point in time.",
        "name_hints": ("date", "_at", "created", "updated", "signup", "paid_at", "jour"),
        "temporal": True,
    },
    {
        "concept": "Localisation",
        "description": "A place.",
        "name_hints": (
            "city", "ville", "region", "address", "adresse", "country", "pays", "zip", "postal",
        ),
    },
    {
        "concept": "Identifiant",
        "description": "A technical key.",
        "name_hints": (),
    },
)
NET_TOKENS = ("net", "ht", "excl", "hors_taxe", "horstaxe")
NET_PARTS = ("net_", "_ht")
GROSS_TOKENS = ("ttc", "gross", "incl", "brut")
GROSS_PARTS = ("_ttc",)

# --- fixed values: money columns a total may be taken from, and their basis ------------------
MONEY_NAME = (
    r"(?i)amount|montant|\bprice\b|prix|revenue|revenu|turnover|\bca\b|sales?_?value|net_price"
)
BASIS_GROSS_TOKENS = ("ttc", "gross", "incl", "brut")
BASIS_NET_TOKENS = ("ht", "net", "hors")

# --- fixed values: additive measures ---------------------------------------------------------
MEASURE_HINTS = (
    "amount", "montant", "price", "prix", "total", "ca", "revenue", "revenu",
    "chiffre", "net", "cost", "cout", "sales", "vente", "quantity", "qty",
    "quantite", "points", "score", "solde", "balance", "sum",
)

# --- fixed values: segmentation --------------------------------------------------------------
MIN_GROUPS = 2
MAX_GROUPS = 25
MAX_CATEGORY_RATIO = 0.9
BANDS = 5
READABLE_GROUPS = 8
READABLE_BONUS = 0.03
GRADIENT = 1.2
CROSSTAB_REPORTED = 6

# --- fixed values: confidence ----------------------------------------------------------------
CONFIDENCE_WEIGHTS = {
    "quality": 0.35,
    "concepts": 0.25,
    "relations": 0.18,
    "query": 0.12,
    "coverage": 0.06,
    "hypotheses": 0.04,
}
MONEY_CHECK_NAME = r"(?i)amount|price|montant|revenue|ca\b|total|net"
GROSS_CHECK_NAME = r"(?i)ttc"
DATE_CHECK_NAME = r"(?i)date|_at$|jour|day"

# --- fixed values: tokens that stand in for personal data ------------------------------------
TOKEN_PREFIXES = {
    "email": "EMAIL",
    "phone": "TEL",
    "iban": "IBAN",
    "siret": "SIRET",
    "name": "NOM",
    "address": "ADR",
    "ipv4": "IP",
}
OTHER_PREFIX = "PII"
TOKEN = r"\b(?:EMAIL|TEL|IBAN|SIRET|NOM|ADR|IP|PII)-\d{3,}\b"

# --- fixed values: column roles --------------------------------------------------------------
ROLE_DATE = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"
ROLE_NUMBER = r"^-?\d+([.,]\d+)?$"
ROLE_TIME_NAME = r"(?i)(date|_at$|month|mois|jour|day|year|annee|week|semaine)"
ROLE_ID_NAME = r"(?i)(^id$|_id$|^code|_code$)"

# --- fixed values: product usage -------------------------------------------------------------
USAGE_EVENTS = ("insight_drill", "chart_export", "report_open", "concept_use", "whatif_run")
