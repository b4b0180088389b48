"""Fixed schemas of the engine's tables; readers never infer."""

DOCUMENTS = "patent LONG, file STRING, contents STRING, year INT"
CODES = "pat LONG, progr INT, CPC STRING"
YEARS = "pat LONG, year INT"
WINDOWS = "window STRING, start INT, end INT"
WINDOW_DOCS = "window STRING, patent LONG, year INT"
EMBEDDINGS = "model STRING, window STRING, patent LONG, year INT, embedding ARRAY<DOUBLE>"
SPARSE_EMBEDDINGS = "model STRING, window STRING, patent LONG, year INT, term STRING, w DOUBLE"
CODE_PAIRS = "window STRING, i LONG, j LONG, correlation DOUBLE"
MODEL_SCORES = "model STRING, window STRING, spearman DOUBLE"
SCORES = (
    "model STRING, window STRING, exponent DOUBLE, focal_year INT, patent LONG, "
    "novelty DOUBLE, impact DOUBLE"
)
SETTINGS = "name STRING, kind STRING, type STRING, params MAP<STRING,STRING>"
TRIALS = "label STRING, params MAP<STRING,STRING>, loss DOUBLE"
