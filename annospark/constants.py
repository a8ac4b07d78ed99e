"""Constants shared by operators.

FIXED VALUES (must equal the study's values for parity of results):
  - model keys and their display names
  - prompt ids
  - excluded model keys
  - period bins (right-closed) and their labels
  - true prevalence of the positive class in the full labelled corpus
  - Cohen's kappa verbal bands (strict upper bounds)
  - confidence vocabularies (English and Italian)
  - null defaults of the bibliographic context in request texts
"""

# ---- FIXED VALUES -------------------------------------------------------
MODEL_LABELS = {
    "claude_sonnet46": "Claude Sonnet 4.6",
    "gpt55": "GPT-5.5",
    "gemini35flash": "Gemini 3.5 Flash",
    "qwen3_35b": "Qwen3-35B-A3B",
    "gpt_oss_120b": "GPT-OSS-120B",
}
PROMPTS = ["A", "B", "C"]
EXCLUDE_MODELS = {"minerva7b"}
CONDITION_COLUMN_RE = r"^DIL_(.+)_prompt([ABC])$"

PERIOD_EDGES = [1820, 1870, 1900, 1935]
PERIOD_LABELS = ["1830-1870", "1871-1900", "1901-1930"]

PREVALENCE_POS = 865
PREVALENCE_TOTAL = 29293
PREVALENCE_NEG = PREVALENCE_TOTAL - PREVALENCE_POS   # 28428

KAPPA_BANDS = [  # (strict upper bound, label)
    (0.0, "Accordo inferiore al caso"),
    (0.20, "Accordo minimo"),
    (0.40, "Accordo debole"),
    (0.60, "Accordo moderato"),
    (0.80, "Accordo sostanziale"),
]
KAPPA_BAND_TOP = "Accordo quasi perfetto"

CONFIDENCE_EN = ["high", "medium", "low"]
CONFIDENCE_IT = {"alta": "high", "media": "medium", "bassa": "low", "sconosciuta": "unknown"}

DEFAULT_AUTHOR = "Autore sconosciuto"
DEFAULT_WORK = "Opera sconosciuta"
DEFAULT_YEAR = "anno ignoto"

# Contrasts of the paired bootstrap: between models at prompt C ...
CONTRAST_MODEL_PAIRS = [
    ("Claude Sonnet 4.6", "GPT-5.5"),
    ("Claude Sonnet 4.6", "Gemini 3.5 Flash"),
    ("GPT-5.5", "Gemini 3.5 Flash"),
    ("Claude Sonnet 4.6", "Qwen3-35B-A3B"),
    ("GPT-5.5", "Qwen3-35B-A3B"),
    ("Gemini 3.5 Flash", "Qwen3-35B-A3B"),
]
# ... and within each model: C - A and B - A.
COMMERCIAL_MODELS = ["Claude Sonnet 4.6", "GPT-5.5", "Gemini 3.5 Flash"]
HIGHCONF_MODELS = ["Claude Sonnet 4.6", "GPT-5.5", "Gemini 3.5 Flash", "GPT-OSS-120B"]
# -------------------------------------------------------------------------

# Display-name order used by the inferential tables (the study's dict order).
MODEL_ORDER = ["Claude Sonnet 4.6", "GPT-5.5", "Gemini 3.5 Flash", "Qwen3-35B-A3B", "GPT-OSS-120B"]
