"""Constants that define result semantics; every operator takes them as defaults."""

from __future__ import annotations

# Label domain and thresholds.
DOWN, NEUTRAL, UP = 0, 1, 2
UNLABELED = -1
CLASSES = (DOWN, NEUTRAL, UP)
LABEL_NAMES = {DOWN: "DOWN", NEUTRAL: "NEUTRAL", UP: "UP"}
UP_THRESHOLD = 0.01
DOWN_THRESHOLD = -0.01
HORIZON_BARS = 1

# Training protocol.
SEED = 42
TEST_SHARE = 0.2
FOLDS = 5

# Term weighting.
MAX_TERMS = 5000
MIN_DOC_FREQ = 2
NGRAM_MIN, NGRAM_MAX = 1, 3

# Indicator windows, in bars.
MA_WINDOWS = (5, 10, 20, 50)
VOLATILITY_WINDOW = 20
MOMENTUM_LAG = 14
VOLUME_WINDOW = 20
RSI_WINDOW = 14
CHART_WINDOWS = (20, 50)

# Ensemble safety rules.
MIN_CONFIDENCE = 0.70
MIN_AGREEMENT = 0.60
MIN_OPPOSITE_GAP = 0.15
ACTIONS = {
    "UP": "📈 Bullish signal",
    "DOWN": "📉 Bearish signal",
    "NEUTRAL": "➡️ Neutral/Hold",
}
SAFE_ACTIONS = {
    "UP": "🟢 CONSIDER BUYING - But start small, use stop-loss",
    "DOWN": "🔴 CONSIDER SELLING - Or wait for better entry",
    "NEUTRAL": "🟡 HOLD/WAIT - Not a clear signal right now",
}

# Request limits, period codes (days) and report bands.
MIN_HEADLINE, MAX_HEADLINE = 5, 1000
PERIOD_DAYS = {"1w": 7, "1mo": 30, "3mo": 90, "6mo": 180, "1y": 365}
CHART_PERIOD_DAYS = {"30d": 30, "90d": 90, "180d": 180, "1y": 365}
DEFAULT_PERIOD_DAYS = 30
DISPLAY_WIDTH = 80
POLARITY_BAND = 0.3
HISTOGRAM_BINS = 20

# Default instruments.
DEFAULT_TICKERS = ("AAPL", "GOOGL", "MSFT", "AMZN", "TSLA", "META", "NVDA")

EMBEDDING_DIM = 384
SAMPLE_ROWS = 500
TOP_IMPORTANCE = 20
TOP_ATTRIBUTION = 15
