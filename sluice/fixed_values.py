"""Values that results depend on. They are fixed: change one and the outputs change."""

# ---- Fixed values: label domains -------------------------------------------------------------
CATEGORIES = ("bug", "datos", "acceso", "automatizacion", "consulta", "otro")
PRIORITIES = ("alta", "media", "baja")
AREAS = ("backend", "frontend", "data", "devops", "producto", "digital_transformation")
LANGUAGES = ("es", "pt")

# ---- Fixed values: record fields -------------------------------------------------------------
CONTENT_FIELDS = (
    "categoria", "prioridad", "area_sugerida", "idioma", "resumen", "requiere_info", "pregunta_seguimiento",
)
CLASSIFICATION_FIELDS = (*CONTENT_FIELDS, "confianza", "id", "version_prompt")
SCORED_FIELDS = ("categoria", "prioridad", "area_sugerida", "idioma", "requiere_info")
ATTEMPT_LOG_FIELDS = (
    "event", "message_id", "model", "prompt_version", "attempt", "latency_ms", "input_tokens", "output_tokens",
    "cached_input_tokens", "estimated_cost_usd", "success", "error_type",
)
ATTEMPT_EVENT = "model_call"

# ---- Fixed values: states --------------------------------------------------------------------
REQUEST_STATES = ("processing", "completed", "failed")
OUTCOME_STATES = ("pending", "running", "succeeded", "failed", "interrupted_unknown")

# ---- Fixed values: limits and defaults -------------------------------------------------------
SUMMARY_MAX_WORDS = 20
PAGE_DEFAULT, PAGE_MAX = 20, 100
ATTEMPT_BUDGET = 3
BACKOFF_BASE_SECONDS, BACKOFF_MAX_SECONDS = 0.5, 8.0
LANGUAGE_POLICY = "spanish-summary-v1"
ARTIFACT_VERSION = 1
DEFAULT_FAILURE_CATEGORY = "execution_error"

# ---- Fixed values: failure kinds (kind, retryable, stops the whole run) ----------------------
ERROR_KINDS = (
    ("timeout", True, False),
    ("connection", True, False),
    ("rate_limit", True, False),
    ("server_error", True, False),
    ("authentication", False, True),
    ("configuration", False, True),
    ("refusal", False, False),
    ("invalid_response", True, False),
    ("invalid_summary_language", True, False),
    ("provider_error", False, False),
    ("invalid_classification", True, False),
    ("unexpected_error", False, False),
)

# ---- Fixed values: masking patterns (Java regular expressions) -------------------------------
LEFT_EDGE = r"(?<![A-Za-z0-9])"
RIGHT_EDGE = r"(?![A-Za-z0-9])"
EMAIL = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+"
    r"@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
    r"(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?![A-Za-z0-9_%+-]))++"
)
CNPJ_FORMATTED = r"[0-9]{2}\.[0-9]{3}\.[0-9]{3}/[0-9]{4}-[0-9]{2}"
CNPJ_BARE = r"[0-9]{14}"
CNPJ_WORD = "CNPJ"
RFC = (
    r"[A-ZÑ&]{3,4}[- ]?[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[- ]?[A-Z0-9]{3}"
)
COUNTRY_PHONE = (
    r"(?:\+52[ .-]?(?:1[ .-]?)?(?:"
    r"(?:\([0-9]{2}\)|[0-9]{2})[ .-]?[0-9]{4}[ .-]?[0-9]{4}"
    r"|(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4})"
    r"|\+55[ .-]?(?:\([0-9]{2}\)|[0-9]{2})[ .-]?(?:"
    r"9[ .-]?[0-9]{4}[ .-]?[0-9]{4}|[0-9]{4}[ .-]?[0-9]{4}))"
)
LOCAL_PHONE = (
    r"(?:(?:\([0-9]{2}\)|[0-9]{2})[ .-]*9[ .-]?[0-9]{4}[ .-]?[0-9]{4}"
    r"|(?:\([0-9]{2}\)|[0-9]{2})[ .-]*[0-9]{4}[ .-]+[0-9]{4}"
    r"|(?:\([0-9]{3}\)|[0-9]{3})[ .-]+[0-9]{3}[ .-]+[0-9]{4})"
)
BARE_PHONE = r"[0-9]{10,11}"
PHONE_WORD = (
    r"(?:tel(?:e(?:fone|fono)|éfono)?|celular|m[oó]vil|whats?app|phone|fone|contato|contacto)"
)
REFERENCE_WORD = r"(?:ord(?:er|en)?|pedido|ref(?:erencia)?|id)"
CONTEXT = 24

# ---- Fixed values: identifier and code formats -----------------------------------------------
VERSION_NAME = r"^v[1-9][0-9]*$"
FAILURE_CODE = r"^[a-z_]+$"

# ---- Fixed values: check-digit weights of the 14-digit company number -------------------------
CNPJ_WEIGHTS_FIRST = (5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)
CNPJ_WEIGHTS_SECOND = (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)
